"""Media file names and download outcomes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.config import Config
from quellwerk.functions import urls
from quellwerk.functions.text import SPACE, js_trim, utf16_start
from quellwerk.operators import sink

# Extensions of picture types.
EXTENSIONS = {"image/jpeg": "jpg", "image/jpg": "jpg", "image/png": "png", "image/webp": "webp", "image/gif": "gif"}


def extension_of_type(content_type: Column) -> Column:
    """File extension of a content type (X13), "" for others and null."""
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[kind], F.lit(""))


def title_filename(title: Column) -> Column:
    """Title as a file name (X15): illegal signs made -, white space one space, no dots or spaces at the end, 150 units at most."""
    # Signs that file names can't have, and the longest name.
    t = F.regexp_replace(js_trim(F.coalesce(title, F.lit(""))), '[<>:"/\\\\|?*\\x00-\\x1F]', "-")
    t = F.regexp_replace(F.regexp_replace(t, f"{SPACE}+", " "), "[ .]+$", "")
    t = js_trim(utf16_start(t, 150))
    return F.when(t != "", t).otherwise("post")


def filename(config: Config, url: Column, title: Column, ordinal: Column) -> Column:
    """Wanted file name (X17): title, number and extension, or the source's own name without a title."""
    allowed = [*config.image_extensions, *config.video_extensions]
    ext = urls.extension_col(url)
    known = ext.isin(allowed)
    number = F.coalesce(urls.trailing_number_col(url), F.coalesce(ordinal, F.lit(0)).cast("string"))
    named = F.concat(title_filename(title), F.lit("_"), number, F.lit("."), F.when(known, ext).otherwise("jpg"))
    own = urls.safe_filename_col(url)
    own = F.when(known | own.rlike(r"[^.]\.[^.]*$"), own).otherwise(F.concat(own, F.lit(".jpg")))
    return F.when(F.coalesce(title, F.lit("")) != "", named).otherwise(own)


def split_name(name: str) -> tuple[str, str]:
    m = re.search(r"(?<=[^./])\.[^./]*$", name)
    return (name[:m.start()], name[m.start():]) if m else (name, "")


def unique_filenames(wanted: DataFrame, used: DataFrame, order: list[str]) -> DataFrame:
    """`wanted` (with `name`) plus `unique_name`: the first free of name, name_2, name_3 ....

    Names can only meet within a family (the stem without its _<n> endings, and the extension), so each
    family is settled by itself, in `order`, against the names in `used` (name).
    """
    family = lambda c: F.regexp_replace(c, r"(_\d+)*(\.[^./]*)?$", "$2")
    taken = used.select("name").distinct().withColumn("_f", family(F.col("name")))
    wanted = wanted.withColumn("_f", family(F.col("name")))
    # a family of one name can only meet itself: its copies are numbered as they come, however many
    kinds = wanted.groupBy("_f").agg((F.min("name") == F.max("name")).alias("_one")).join(taken.select("_f").distinct().withColumn("_met", F.lit(True)), "_f", "left")
    several = kinds.filter(~F.col("_one") | F.col("_met").isNotNull()).select("_f")
    place = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    stem, ext = F.regexp_replace("name", r"(?<=[^./])\.[^./]*$", ""), F.regexp_extract("name", r"(?<=[^./])(\.[^./]*)$", 1)
    alone = wanted.join(several, "_f", "left_anti").drop("_f").withColumn("_n", place)
    alone = alone.withColumn("unique_name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")
    wanted = wanted.join(several, "_f", "left_semi").drop("_f")
    schema = T.StructType([*wanted.schema, T.StructField("unique_name", T.StringType())])
    columns = wanted.columns

    def settle(rows: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        names, after = set(taken["name"]), {}
        out = []
        for name in rows.sort_values(order)["name"]:
            stem, ext = split_name(name)
            free, i = name, after.get(name, 2)
            while free in names:
                free, i = f"{stem}_{i}{ext}", i + 1
            after[name] = i
            names.add(free)
            out.append(free)
        return rows.sort_values(order).assign(unique_name=out)[[*columns, "unique_name"]]

    met = (wanted.groupBy(family(F.col("name")).alias("_f")).cogroup(taken.select("name").groupBy(family(F.col("name")).alias("_f")))
           .applyInPandas(settle, schema))
    return alone.select(*met.columns).union(met)


def outcomes(downloads: DataFrame, records: DataFrame, config: Config) -> DataFrame:
    """(ord, url, normalized_url, status, reason) of downloads in order of `ord` (K7).

    `downloads` has (ord, url, sha256, bytes, error), `records` (normalized_url, sha256) what is stored.
    The ladder: url known, dry run, request failed, too small, content known, downloaded.  Of new
    urls and contents the first in order counts.
    """
    d = downloads.withColumn("normalized_url", urls.normalize_url_col("url"))
    stored_url = records.select("normalized_url").distinct().withColumn("_u", F.lit(True))
    stored_sha = records.filter("sha256 is not null").select("sha256").distinct().withColumn("_s", F.lit(True))
    d = d.join(stored_url, "normalized_url", "left").join(stored_sha, "sha256", "left")
    fetched = F.col("_u").isNull() & F.col("error").isNull() & (F.col("bytes") >= config.min_bytes)
    first_sha = d.filter(fetched & F.col("_s").isNull()).groupBy("sha256").agg(F.min("ord").alias("_first_sha"))
    d = d.join(first_sha, "sha256", "left")
    won = fetched & F.col("_s").isNull() & (F.col("ord") == F.col("_first_sha"))
    first_url = d.filter(won).groupBy("normalized_url").agg(F.min("ord").alias("_first_url"))
    d = d.join(first_url, "normalized_url", "left")
    is_known = F.col("_u").isNotNull() | (F.col("_first_url") < F.col("ord"))
    def way(status: str, reason: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), reason.cast("string").alias("reason"))

    status = (F.when(is_known, way("duplicate", F.lit("url")))
              .when(F.lit(config.dry_run), way("dry-run", F.lit(None)))
              .when(F.col("error").isNotNull(), way("failed", F.col("error")))
              .when(F.col("bytes") < config.min_bytes, way("skipped", F.lit("min-bytes")))
              .when(F.col("_s").isNotNull() | (F.col("_first_sha") < F.col("ord")), way("duplicate", F.lit("hash")))
              .otherwise(way("downloaded", F.lit(None))))
    return d.withColumn("_r", status).select("ord", "url", "normalized_url", "_r.status", "_r.reason")


def run_stats(results: DataFrame, pages: int = 0, posts: int = 0, retries: int = 0) -> DataFrame:
    """The nine counters of a run (A2) from outcomes with `bytes`."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        F.lit(pages).cast("long").alias("pages_visited"), F.lit(posts).cast("long").alias("posts_processed"), F.count("*").alias("images_discovered"),
        n("downloaded").alias("images_downloaded"), n("skipped").alias("images_skipped"), n("duplicate").alias("duplicates"), n("failed").alias("failures"),
        F.lit(retries).cast("long").alias("retries"), F.coalesce(F.sum(F.when(F.col("status") == "downloaded", F.col("bytes"))), F.lit(0)).alias("bytes_downloaded"))


def image_records(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Stored records of the downloads that succeeded (D11, K8): `facts` has (ord, filename, sha256, bytes)."""
    kept = results.filter("status = 'downloaded'").join(facts.select("ord", "filename", "sha256", "bytes"), "ord")
    return kept.select("url", F.col("normalized_url").alias("normalizedUrl"), "filename", "sha256", "bytes", F.current_timestamp().alias("downloadedAt"))


def images_per_second(downloaded: Column, elapsed_ms: Column) -> Column:
    """Rate of a run (A7); less than a second counts as one."""
    return downloaded / F.greatest(F.lit(1.0), elapsed_ms / 1000)


def record_keys(records: DataFrame) -> DataFrame:
    """(kind, value): the urls, digests and file names that stored image records take (S9); null and empty ones are skipped."""
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("url", "normalizedUrl"), ("hash", "sha256"), ("filename", "filename"))))
    return records.select(F.inline(keys)).filter("value <> ''").distinct()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored image records of a JSON file (S9); a missing or corrupt file has none."""
    schema = "url string, normalizedUrl string, filename string, sha256 string, bytes long, downloadedAt timestamp"
    if not isinstance(sink.read_json(path, []), list):
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(str(path))
    except AnalysisException:  # no such file
        return spark.createDataFrame([], schema)
