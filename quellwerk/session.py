"""Where intermediate tables go, so that jobs survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: `spark.checkpoint.dir`, or where that is unset a local one.

    The local folder is meant for local mode (tests, bench); a cluster must name its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="quellwerk-")
        shared_dir.local = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/quellwerk/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`df` written as a table in the shared folder, laid out by the column `by` if any, and read again: a cut in the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.partitionBy(*[by] if by else []).option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables made by `written` that nothing unfinished reads any more; other DataFrames are passed over."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def default_partitions(spark: SparkSession, per: int = 1) -> int:
    """Number of partitions for an explicit repartition: `per` times the shuffle partitions."""
    return max(1, per * int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once an application."""
    context = spark.sparkContext
    if getattr(ship, "to", None) == context.applicationId:
        return
    package = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="quellwerk-")) / "quellwerk.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    ship.to = context.applicationId
