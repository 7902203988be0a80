"""Size-rotated JSON files and crawl state."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.functions.text import clean_tags, content_hash, js_trim
from quellwerk.operators.dedup import first_wins
from quellwerk.session import default_partitions, written

#: Records of a file before it is rotated.
FILE_MAX = 500
ANECDOTE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
                         T.StructField("addedAt", T.TimestampType()), T.StructField("url", T.StringType())])
FILE = T.StructType([T.StructField("title", T.StringType()), T.StructField("anecdotes", T.ArrayType(ANECDOTE))])
VISITED = T.MapType(T.StringType(), T.StructType([T.StructField("processedAt", T.TimestampType()), T.StructField("next", T.StringType()),
                                                  T.StructField("tag", T.StringType())]))


def rotated(batches: DataFrame, order: list[str], size: str, limit: int = FILE_MAX, active: int = 0) -> DataFrame:
    """`batches` with `file_no` (W4): files are filled in order, `active` records are in the first one already.

    A batch is never split; it opens a new file if the file is not empty and would grow beyond
    `limit`.  The walk over the batches is a fold over ranges of them: each range is
    turned into the table that says, for each number of records the file may have before it, how
    many files it opens and what the last one has after it.  Only these small tables (limit + 2
    rows a range) meet on the driver; then all ranges are numbered side by side.
    """
    parts = default_partitions(batches.sparkSession)
    at = batches.select(*order, F.col(size).cast("long").alias(size)).repartitionByRange(parts, *order)
    at = written(at.withColumn("_part", F.spark_partition_id()), "batches")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        n, files = np.arange(limit + 2), np.zeros(limit + 2, np.int64)  # more than the limit is as good as one more
        for k in rows.sort_values(order)[size]:
            full = (n > 0) & (n + k > limit)
            files += full
            n = np.minimum(np.where(full, k, n + k), limit + 1)
        return pd.DataFrame({"part": rows["_part"].iloc[0], "before": np.arange(limit + 2), "files": files, "after": n})

    table = {(r.part, r.before): (r.files, r.after) for r in at.groupBy("_part").applyInPandas(fold, "part int, before long, files long, after long").collect()}
    starts, file, n = {}, 0, min(active, limit + 1)
    for part in sorted({p for p, _ in table}):
        starts[part] = (file, n)
        more, n = table[part, n]
        file += more

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        file, n = starts[rows["_part"].iloc[0]]
        rows, out = rows.sort_values(order), []
        for k in rows[size]:
            if n > 0 and n + k > limit:
                file, n = file + 1, 0
            n += k
            out.append(file)
        return rows.drop(columns="_part").assign(file_no=out)

    return at.groupBy("_part").applyInPandas(number, T.StructType([*at.drop("_part").schema, T.StructField("file_no", T.LongType())]))


def entries(posts: DataFrame, tag: Column, default_tags: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Stored form of posts (K3): text trimmed, tags cleaned, no url where it is empty; blank texts are dropped."""
    tags = clean_tags(F.when(tag.isNotNull(), F.array(tag)).otherwise(F.array(*map(F.lit, default_tags)).cast("array<string>")))
    rows = posts.withColumn("text", js_trim("text")).filter("text <> ''")
    url = F.when(F.col("post_url") != "", F.col("post_url"))
    return rows.select(*keep, F.lit("").alias("title"), "text", tags.alias("tags"), F.current_timestamp().alias("addedAt"), url.alias("url"))


def write_json(path: str | Path, data) -> None:
    """Atomic write of one JSON file (K1): beside it first, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".tmp")
    with beside.open("w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2, default=str)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def read_json(path: str | Path, fallback):
    """Content of a state file, `fallback` if it is missing (S5); a corrupt file is set aside, not lost."""
    path = Path(path)
    try:
        return json.loads(path.read_text("utf-8"))
    except FileNotFoundError:
        return fallback
    except ValueError:
        os.replace(path, path.with_name(path.name + ".corrupt"))
        return fallback


class AnecdoteFiles:
    """Folder of anecdotes.json and anecdotes_<n>.json with rotation."""

    def __init__(self, folder: str | Path, limit: int = FILE_MAX):
        self.folder, self.limit = Path(folder), limit
        self.active = self.folder / "anecdotes.json"

    def next_index(self) -> int:
        taken = [int(m[1]) for f in self.folder.glob("anecdotes_*.json") if (m := re.fullmatch(r"anecdotes_(\d+)\.json", f.name))]
        return max(taken, default=0) + 1

    def append(self, batch: list[dict]) -> None:
        """Adds one batch; the active file is renamed first if it would grow beyond the limit."""
        if not batch:
            return
        now = read_json(self.active, {"anecdotes": []}).get("anecdotes") or []
        if now and len(now) + len(batch) > self.limit:
            os.replace(self.active, self.folder / f"anecdotes_{self.next_index()}.json")
            now = []
        write_json(self.active, {"title": "Anecdotes", "anecdotes": now + batch})


def append_entries(fresh: DataFrame, folder: str | Path, page: list[str], order: list[str], limit: int = FILE_MAX) -> int:
    """Adds rows (title, text, tags, addedAt, url) to the files of a folder, each `page` a batch; the number of files written.

    Files are filled and written by the executors, side by side, so `folder` must be one that all
    of them share; only the number of records of the active file is looked at first.  The numbered
    files are written before the active one: a crash in between repeats records, which loading drops.
    """
    files = AnecdoteFiles(folder, limit)
    now = read_json(files.active, {"anecdotes": []}).get("anecdotes") or []  # at most a file
    sizes = fresh.groupBy(*page).agg(F.count("*").alias("_size"))
    placed = written(rotated(sizes, page, "_size", limit, len(now)).drop("_size"), "placed")
    last = placed.agg(F.max("file_no")).first()[0]
    if last is None:
        return 0
    first = files.next_index()

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        no = int(rows["file_no"].iloc[0])
        out = [{"title": r.title, "text": r.text, "tags": list(r.tags), "addedAt": r.addedAt} | ({"url": r.url} if r.url else {})
               for r in rows.sort_values(order).itertuples(index=False)]
        target = files.active if no == last else files.folder / f"anecdotes_{first + no}.json"
        write_json(target, {"title": "Anecdotes", "anecdotes": (now if no == 0 else []) + out})
        return pd.DataFrame({"file_no": [no]})

    rows = fresh.join(placed, page).withColumn("addedAt", F.date_format("addedAt", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
    rows = written(rows.select("file_no", *order, "title", "text", "tags", "addedAt", "url"), "to-write")
    for part in (rows.filter(F.col("file_no") < last), rows.filter(F.col("file_no") == last)):
        part.groupBy("file_no").applyInPandas(write, "file_no long").count()
    return last + 1


def read_keys(spark: SparkSession, home: str | Path) -> DataFrame:
    """(key) of all known posts: a visited-posts.json file and what runs have added in the folder visited-posts."""
    home = Path(home)
    keys = spark.createDataFrame([], "key string")
    if (home / "visited-posts.json").exists() and isinstance(read_json(home / "visited-posts.json", {}), dict) and (home / "visited-posts.json").exists():
        old = spark.read.schema("posts array<string>").option("multiLine", True).json(str(home / "visited-posts.json"))
        keys = keys.union(old.select(F.explode("posts")))
    if (home / "visited-posts").exists():
        keys = keys.union(spark.read.schema("key string").json(str(home / "visited-posts")))
    return keys.filter("key is not null")


def read_anecdotes(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, pos, title, text, tags, addedAt, url) of all files of a folder; a corrupt file gives no rows."""
    files = spark.read.schema(FILE).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "anecdotes*.json").json(folder)
    files = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(anecdotes(?:_\d+)?\.json)$", 1).alias("file_name"), "anecdotes").filter("file_name <> ''")
    return files.select("file_name", F.posexplode("anecdotes").alias("pos", "a")).select("file_name", "pos", "a.*")


def file_order(name: Column) -> Column:
    """Files by index, the active one last."""
    n = F.regexp_extract(name, r"_(\d+)\.json$", 1)
    return F.when(n != "", n.cast("long")).otherwise(F.lit(2**62))


def stored(anecdotes: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Loaded anecdotes (S7) with their content `hash`: blank texts dropped, the first of each hash kept, null tags made [].

    `keep` names the columns wanted beside the hash (default all).
    """
    keep = anecdotes.columns if keep is None else keep
    rows = anecdotes.filter(F.length(js_trim("text")) > 0).withColumn("hash", content_hash(F.col("text")))
    rows = first_wins(rows, ["hash"], order, list(dict.fromkeys([*keep, "hash"])))
    return rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))) if "tags" in keep else rows


def file_counts(anecdotes: DataFrame) -> DataFrame:
    """(file_name, records) of each file, before anything is dropped (A4)."""
    return anecdotes.groupBy("file_name").agg(F.count("*").alias("records"))


def next_index(anecdotes: DataFrame) -> DataFrame:
    """(next_index): largest file index and one (A5)."""
    n = F.regexp_extract("file_name", r"^anecdotes_(\d+)\.json$", 1)
    return anecdotes.agg((F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)) + 1).alias("next_index"))


def read_visited(spark: SparkSession, path: str) -> DataFrame:
    """(url, processedAt, next_url, tag) of a visited-pages file (S8, D7); a missing or corrupt file is empty."""
    schema = "url string, processedAt timestamp, next_url string, tag string"
    data = read_json(path, {})
    if not isinstance(data, dict) or not data:
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", VISITED)).alias("url", "v")).select("url", "v.processedAt", F.col("v.next").alias("next_url"), "v.tag")
