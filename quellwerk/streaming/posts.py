"""Posts as a stream: first-wins dedup with data committed before state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quellwerk.operators.dedup import layered_dedup, new_posts


class PostStream:
    """Sink of micro-batches of posts; accepted posts and known keys are tables under `path`.

    A batch writes its posts first and their keys after them, both into a folder named by the batch,
    so a batch that is run again after a crash replaces its own rows: none is lost, none doubled.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema + ", batch long").parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def keys(self, before: int | None = None) -> DataFrame:
        return self._read("keys", "key string", before)

    def hashes(self, before: int | None = None) -> DataFrame:
        return self._read("hashes", "hash string", before)

    def posts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/posts")

    def write(self, batch: DataFrame, number: int) -> None:
        """One micro-batch (`foreachBatch`)."""
        batch = batch.persist()  # read three times; what is lost with an executor is read again
        try:
            known, stored = self.keys(number), self.hashes(number)
            fresh = layered_dedup(batch, known, stored, self.order)
            for name, rows in (("posts", fresh), ("hashes", fresh.select("hash")),
                               ("keys", new_posts(batch, known, self.order).filter("is_new").select("key"))):
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        finally:
            batch.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Drains what the source has, then ends (T4); a later call goes on from the checkpoint."""
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
