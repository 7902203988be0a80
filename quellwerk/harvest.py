"""The whole harvest: tag index, listing pages, posts, deduplication, files and state (command line entry)."""

from __future__ import annotations

import logging
import shutil
import sys
from collections import Counter
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.config import Config, from_args, from_env
from quellwerk.functions.text import content_hash, post_key
from quellwerk.functions.urls import normalize_url
from quellwerk.log import Progress, Stop, open_log
from quellwerk.operators import crawl, dedup, extract, sink
from quellwerk.session import release, ship, written
from quellwerk.sources.pages import decoded, fetch, http_get

POST = "tag_ord long, page_ord long, box_ord long, tag string, url string, id string, text string, post_url string"
POST_COLUMNS = [c.split()[0] for c in POST.split(", ")]


def listing(spark: SparkSession, urls: list[str], config: Config, get: Callable) -> DataFrame:
    """(url, status, retries, html) of fetched pages."""
    pages = fetch(spark, urls, config, get)
    return written(pages.select("url", "status", "retries", decoded(F.col("content"), F.col("content_type")).alias("html")), "listing")


def tags(spark: SparkSession, config: Config, get: Callable = http_get) -> list[tuple[str, str]]:
    """(url, name) of the tags of the index page, in its order."""
    rows = extract.tags_of(listing(spark, [config.start_url], config, get), config).orderBy("tag_ord").collect()
    return [(r.tag_url, r.name) for r in rows]


def full(spark: SparkSession, config: Config, found: list[tuple[str, str]], get: Callable = http_get, stage: Path | None = None,
         stop: Callable[[], bool] = lambda: False, progress: Counter | None = None) -> tuple[DataFrame, dict[str, dict], set[str]]:
    """(posts, visited pages, complete tags) of a full walk.

    Which pages a full walk visits does not depend on what is known, so it goes in waves: the k-th
    pages of all tags are one fetch and one extraction.  Order columns keep the sequence that
    first-wins rules go by.  With `stage`, each finished wave is kept there, posts first and then the
    walk's state: a walk that was cut off goes on after its last whole wave.  `stop` is asked before each wave.
    """
    progress = Counter() if progress is None else progress
    at = [(i, name, url) for i, (url, name) in enumerate(found)]
    visited: dict[str, dict] = {}
    seen: dict[int, set[str]] = {i: set() for i in range(len(found))}
    complete: set[str] = set()
    waves, wave = [], 0
    old = sink.read_json(stage / "state.json", None) if stage else None
    if old and old["found"] == [list(x) for x in found]:
        at, visited, complete, wave = [tuple(x) for x in old["at"]], old["visited"], set(old["complete"]), old["wave"]
        seen = {int(k): set(v) for k, v in old["seen"].items()}
        waves = [spark.read.schema(POST).parquet(str(stage / f"wave-{k}")) for k in range(wave)]
    while at and not stop() and not (config.max_pages and wave >= config.max_pages):
        for i, name, url in at:
            seen[i].add(normalize_url(url))
        heads = spark.createDataFrame([(i, name, url) for i, name, url in at], "tag_ord long, tag string, url string")
        pages = written(heads.join(listing(spark, sorted({u for *_, u in at}), config, get), "url"), "pages")
        posts = extract.posts_of(pages, config, keep=["tag_ord", "tag"]).withColumn("page_ord", F.lit(wave).cast("long")).select(*POST_COLUMNS)
        if stage:
            posts.write.mode("overwrite").parquet(str(stage / f"wave-{wave}"))
            posts = spark.read.schema(POST).parquet(str(stage / f"wave-{wave}"))
        else:
            posts = written(posts, "posts")
        waves.append(posts)
        counts = posts.groupBy("tag_ord").agg(F.count("*").alias("total"))
        nexts = extract.next_pages(pages.select("url", "html").distinct(), config)
        outcome = crawl.page_outcome(F.col("status"), F.coalesce("total", F.lit(0)), F.col("next_url"), config.stop_on_empty)
        rows = pages.drop("html").join(counts, "tag_ord", "left").join(nexts, "url").select("tag_ord", "tag", "url", "total", "retries", outcome.alias("o")).collect()
        release(pages)
        at = []
        for r in sorted(rows, key=lambda r: r.tag_ord):  # a row a tag
            progress.update(pages=1, posts=r.total or 0, retries=r.retries or 0)
            following = r.o.next_url
            visited[normalize_url(r.url)] = {"processedAt": datetime.now(UTC).isoformat(), "next": following, "tag": r.tag}
            loop = following is not None and normalize_url(following) in seen[r.tag_ord]
            if loop or (following is None and r.o.reached_end):
                complete.add(normalize_url(found[r.tag_ord][0]))
            elif following:
                at.append((r.tag_ord, r.tag, following))
        wave += 1
        if stage:
            sink.write_json(stage / "state.json", {"found": found, "at": at, "visited": visited, "complete": sorted(complete), "wave": wave,
                                                   "seen": {k: sorted(v) for k, v in seen.items()}})
    posts = reduce(DataFrame.unionByName, waves) if waves else spark.createDataFrame([], POST)
    return posts, visited, complete


class Known:
    """Keys that a walk has met so far.  `meet` looks those of one page up in the stored table; only keys met are held."""

    def __init__(self, stored: DataFrame):
        self.stored, self.met = stored, set()

    def meet(self, keys: list[str]) -> None:
        new = [k for k in set(keys) - {None} if k not in self.met]
        if new:
            self.met |= {r.key for r in self.stored.filter(F.col("key").isin(new)).distinct().collect()}  # at most a page's keys

    def __contains__(self, key: str | None) -> bool:
        return key in self.met

    def update(self, keys: set) -> None:
        self.met |= set(keys)


def run(spark: SparkSession, config: Config, get: Callable = http_get) -> dict:
    """One harvest into `config.output`, a folder that driver and executors share; returns its metadata.

    New texts are written first and the state after them: a crash in between repeats work and
    loses nothing, and a full walk that was cut off goes on after its last whole wave.  SIGINT or SIGTERM end the walk
    after the work at hand; what was found is written and the tags left stay incomplete.  A dry
    run writes nothing.  In incremental mode tags whose mirror is complete are walked page by page
    and end at known pages; the others are walked in full.
    """
    ship(spark)
    home = Path(config.output)
    log = open_log(None if config.dry_run else home / "logs")
    with Stop(log) as stop, Progress(log) as progress:
        return _run(spark, config, get, home, log, lambda: stop.asked, progress.counts)


def _run(spark: SparkSession, config: Config, get: Callable, home: Path, log: logging.Logger, stop: Callable[[], bool], progress: Counter) -> dict:
    files = sink.AnecdoteFiles(home / "anecdotes")
    meta = sink.read_json(home / "metadata.json", {})
    complete = set(meta.get("completedTags") or [])
    visited = sink.read_json(home / "visited-pages.json", {})
    known = sink.read_keys(spark, home)
    stored = sink.read_anecdotes(spark, str(home / "anecdotes")) if files.active.exists() else spark.createDataFrame([], "text string")
    stored = stored.select(content_hash(F.col("text")).alias("hash"))
    found = tags(spark, config, get)
    log.info("%d tags at %s", len(found), config.start_url)
    quick = [i for i, (url, _) in enumerate(found) if config.mode != "full" and normalize_url(url) in complete]
    slow = [i for i in range(len(found)) if i not in set(quick)]
    stage = None if config.dry_run else home / "unfinished"
    posts, pages, done = full(spark, config, [found[i] for i in slow], get, stage, stop, progress)
    order = F.create_map(*[F.lit(x) for i, j in enumerate(slow) for x in (i, j)]) if slow else None
    if order is not None:
        posts = posts.withColumn("tag_ord", order[F.col("tag_ord").cast("int")].cast("long"))
    posts = written(posts.select(*POST_COLUMNS), "full")
    batches: list[tuple] = []
    seen = Known(known.union(posts.select(post_key(F.col("id"), F.col("text")).alias("key"))))

    def one_page(url: str) -> tuple[int | None, DataFrame | None]:
        page = listing(spark, [url], config, get)
        r = page.first()
        progress.update(pages=1, retries=r.retries or 0)
        return r.status, page if r.status and 200 <= r.status < 300 else None

    def page_posts(page: DataFrame, url: str) -> tuple[list[dict], str | None]:
        rows = extract.posts_of(page, config).withColumn("key", post_key(F.col("id"), F.col("text"))).orderBy("box_ord").collect()  # one page
        seen.meet([r.key for r in rows])
        progress.update(posts=len(rows))
        return [r.asDict() for r in rows], extract.next_pages(page, config).first().next_url

    if quick:
        at = {found[i][1]: i for i in quick}
        walked = crawl.crawl(config, [found[i] for i in quick], one_page, page_posts, seen, complete, lambda p: p["key"],
                             lambda name, url, new: batches.extend((at[name], len(batches), p["box_ord"], name, url, p["id"], p["text"], p["post_url"]) for p in new), stop)
        pages |= {k: {"processedAt": datetime.now(UTC).isoformat(), "next": v["next_url"], "tag": v["tag"]} for k, v in walked.items()}
        posts = posts.unionByName(spark.createDataFrame(batches, POST))
    sequence = ["tag_ord", "page_ord", "box_ord"]
    fresh = written(dedup.layered_dedup(posts, known, stored, sequence), "fresh")
    result = {"startUrl": config.start_url, "mode": config.mode, "tags": len(found), "pages": len(pages), "posts": posts.count(), "new": fresh.count(),
              "dryRun": config.dry_run, "stopped": stop()}
    log.info("%d pages, %d posts, %d new", result["pages"], result["posts"], result["new"])
    if config.dry_run:
        return result
    entries = sink.entries(fresh, F.when(F.col("tag") != "", F.col("tag")), keep=sequence)
    sink.append_entries(entries, home / "anecdotes", sequence[:2], sequence)
    new_keys = dedup.unknown(posts.select(post_key(F.col("id"), F.col("text")).alias("key")).filter("key is not null").distinct(), known, "key")
    new_keys.write.mode("append").json(str(home / "visited-posts"))
    sink.write_json(home / "visited-pages.json", visited | pages)
    keys = sink.read_keys(spark, home).agg(F.count_distinct("key")).first()[0]
    sink.write_json(home / "metadata.json", result | {"completedTags": sorted(complete | done), "knownPosts": keys, "stats": dict(progress), "updatedAt": datetime.now(UTC).isoformat()})
    shutil.rmtree(stage, ignore_errors=True)
    return result


def main(argv: list[str] | None = None) -> None:
    config = from_args(from_env(), sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("quellwerk").getOrCreate()
    print(run(spark, config))
    spark.stop()


if __name__ == "__main__":
    main()
