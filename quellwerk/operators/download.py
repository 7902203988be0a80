"""Download of media files (S11, K7, K8, W8): fetch, facts, outcome of each, contents of those kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.config import Config
from quellwerk.operators import media
from quellwerk.session import written
from quellwerk.sources.images import image_facts
from quellwerk.sources.pages import http_get, requested


def download(spark: SparkSession, wanted: DataFrame, records: DataFrame, config: Config, get: Callable = http_get) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, records, contents) of downloading `wanted` (ord, url, referer, title, ordinal) beside the stored `records`.

    Urls that are known are not asked for, in a dry run none is.  Each request carries its Referer; an empty
    body counts as a failure.  File names are made unique before anything is fetched and stay
    reserved whatever comes of it.  `results` has (ord, url, status, reason, filename, bytes, retries), `records` the new
    stored records, `contents` (filename, content) what is to be kept: duplicates by digest and files that are
    too small are in neither.  ord is unique; null urls are left out.
    """
    wanted = wanted.filter("url is not null")
    named = wanted.withColumn("name", media.filename(config, F.col("url"), F.col("title"), F.col("ordinal")))
    named = media.unique_filenames(named, records.filter("filename is not null").select(F.col("filename").alias("name")), ["ord"])
    named = written(named.select("ord", "url", "referer", F.col("unique_name").alias("filename")), "named")
    none = F.lit(None)
    if config.dry_run:
        got = named.select("ord", none.cast("binary").alias("content"), none.cast("string").alias("error"), F.lit(0).alias("retries"))
    else:
        known = media.outcomes(named.select("ord", "url", none.cast("string").alias("sha256"), F.lit(0).cast("long").alias("bytes"), F.lit("x").alias("error")), records, config)
        asked = named.join(known.filter("status <> 'duplicate'").select("ord"), "ord", "left_semi")
        got = written(requested(asked.select("ord", "url", "referer"), config, get).select(
            "ord", "content", F.when(F.length("content") > 0, none).otherwise(F.coalesce("error", F.lit("empty body"))).cast("string").alias("error"), "retries"), "got")
    facts = named.join(image_facts(got.select("ord", "content")).join(got.drop("content"), "ord"), "ord", "left")
    facts = written(facts.select("ord", "url", "filename", "sha256", "bytes", "error", F.coalesce("retries", F.lit(0)).alias("retries")), "facts")
    results = written(media.outcomes(facts, records, config), "results")
    kept = results.filter("status = 'downloaded'").select("ord")
    contents = got.join(kept, "ord", "left_semi").join(named.select("ord", "filename"), "ord").select("filename", "content")
    return (results.join(facts.select("ord", "filename", "bytes", "retries"), "ord").select("ord", "url", "status", "reason", "filename", "bytes", "retries"),
            media.image_records(results, facts), contents)
