"""Crawl order and its end (W1-W3, W5, W6, D-7, A1), and the driver loop over tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quellwerk.config import Config
from quellwerk.functions import urls
from quellwerk.session import written


def page_counts(posts: DataFrame, page: list[str]) -> DataFrame:
    """(page, total_posts, new_posts) of each page, from posts with `is_new` (A1)."""
    return posts.groupBy(*page).agg(F.count("*").alias("total_posts"), F.count_if("is_new").alias("new_posts"))


def until_known(pages: DataFrame, tag: str, page: str, limit: int = 2, early_stop: Column | None = None) -> DataFrame:
    """Pages that are visited before a tag is caught up (W1), with `known_run`.

    Per tag in page order, pages with posts of which none is new count up, pages with new posts
    reset the count, empty pages change nothing; the page at which the count reaches `limit` (at
    least 1) is the last.  Where `early_stop` is false or null all pages stay.  A tag's pages are
    one listing, so a window by tag holds no more than a site's pages of it.
    """
    w = Window.partitionBy(tag).orderBy(page)
    runs = pages.withColumn("_run", F.sum((F.col("new_posts") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = ((F.col("total_posts") > 0) & (F.col("new_posts") == 0)).cast("long")
    r = Window.partitionBy(tag, "_run").orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("known_run", F.sum(known).over(r))
    stop = (F.col("known_run") >= max(limit, 1)) & (known > 0)
    if early_stop is not None:
        stop &= F.coalesce(early_stop, F.lit(False))
    before = F.coalesce(F.max(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return runs.withColumn("_stopped", before).filter("_stopped = 0").drop("_stopped", "_run")


def first_pages(pages: DataFrame, tag: str, page: str, limit: int) -> DataFrame:
    """At most `limit` pages of each tag (W2); 0 is no limit."""
    if limit <= 0:
        return pages
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(tag).orderBy(page))).filter(F.col("_n") <= limit).drop("_n")


def page_outcome(status: Column, total: Column, next_url: Column, stop_on_empty: bool = True) -> Column:
    """struct(next_url, reached_end) of a fetched page.

    A permanent error (any status but 2xx, 429 and 5xx) ends the tag, another error leaves it for
    the next run, a page without posts ends it if `stop_on_empty`, else the end is where no next
    page is.  A null status is a failed request.
    """
    fine = status.between(200, 299)
    gone = ~fine & ~((status >= 500) | (status == 429))
    nothing = F.lit(None).cast("string")
    end = lambda url, flag: F.struct(url.alias("next_url"), flag.alias("reached_end"))
    return (F.when(F.coalesce(gone, F.lit(False)), end(nothing, F.lit(True))).when(~F.coalesce(fine, F.lit(False)), end(nothing, F.lit(False)))
            .when(F.lit(stop_on_empty) & (total == 0), end(nothing, F.lit(True))).otherwise(end(next_url, next_url.isNull())))


def completed(pages: DataFrame, tag: str) -> DataFrame:
    """(tag, complete): a tag is complete if a page of it is its end or leads back into it."""
    return pages.groupBy(tag).agg(F.coalesce(F.bool_or((F.col("next_url").isNull() & F.col("reached_end")) | F.col("is_loop")), F.lit(False)).alias("complete"))


def page_chains(starts: DataFrame, edges: DataFrame, max_pages: int = 0) -> DataFrame:
    """(tag, page_no, key, url, next_url, is_loop): pages reached from each tag's start (W3, D-7).

    `starts` has (tag, url), `edges` (key, url, next_url) with one row a normalised url.  A chain
    ends where no next page is known, at `max_pages`, or before a page it has had; the page whose next
    page that is has is_loop.  Pointers are doubled: round k adds the pages 2^k further on and
    squares the jumps, so a chain of a million pages takes twenty rounds, and all chains advance
    together.
    """
    edges = written(edges.select("key", F.col("url").alias("page_url"), "next_url").withColumn("next_key", urls.normalize_url_col("next_url")), "edges")
    jumps = edges.filter("next_key is not null").select("key", F.col("next_key").alias("to")).join(edges.select(F.col("key").alias("to")), "to", "left_semi")
    reached = starts.select("tag", urls.normalize_url_col("url").alias("key")).join(edges.select("key"), "key", "left_semi")
    reached = written(reached.groupBy("tag", "key").agg(F.lit(1).cast("long").alias("page_no")), "reached")
    step, count = 1, reached.count()
    while True:
        jumps = written(jumps.select("key", "to"), "jumps")
        further = reached.join(jumps, "key").select("tag", F.col("to").alias("key"), (F.col("page_no") + step).alias("page_no"))
        grown = written(reached.select("tag", "key", "page_no").unionByName(further).groupBy("tag", "key").agg(F.min("page_no").alias("page_no")), "reached")
        before, count, reached, step = count, grown.count(), grown, 2 * step
        if count == before:
            break
        jumps = jumps.join(jumps.select(F.col("key").alias("to"), F.col("to").alias("on")), "to").select("key", F.col("on").alias("to"))
    seen = reached.join(edges, "key")
    back = reached.select("tag", F.col("key").alias("next_key"), F.col("page_no").alias("_no"))
    out = seen.join(back, ["tag", "next_key"], "left")
    loop = F.coalesce(F.col("_no") <= F.col("page_no"), F.lit(False))
    out = out.select("tag", "page_no", "key", F.col("page_url").alias("url"), "next_url", loop.alias("is_loop"))
    return out.filter(F.col("page_no") <= max_pages) if max_pages else out


def latest_pages(visits: DataFrame) -> DataFrame:
    """(key, url, processedAt, next_url, tag): the last visit of each normalised url (D7); ties by url and next page."""
    keyed = visits.filter("url is not null").withColumn("key", urls.normalize_url_col("url"))
    order = F.struct(F.coalesce(F.col("processedAt").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")), F.col("url"), F.coalesce("next_url", F.lit("")))
    best = keyed.groupBy("key").agg(F.max_by(F.struct("url", "processedAt", "next_url", "tag"), order).alias("r"))
    return best.select("key", "r.*")


def crawl(config: Config, tags: list[tuple[str, str]], fetch_page: Callable[[str], tuple[int | None, str | None]],
          posts_of: Callable[[str, str], tuple[list[dict], str | None]], known: set[str], complete: set[str], key_of: Callable[[dict], str],
          emit: Callable[[str, str, list[dict]], None], stop: Callable[[], bool] = lambda: False) -> dict[str, dict]:
    """Visits the pages of `tags` (url, name) one after another; the visited pages by normalised url.

    What a later tag visits depends on what earlier ones have made known, so this loop over pages
    is the driver's; each page's posts go to `emit` as one batch before their keys count as known
    (a crash repeats a batch, it never loses one).  `known` and `complete` are updated, unless
    the run is dry.  `stop` is asked before each page; pages left out then leave their tag incomplete.
    """
    visited: dict[str, dict] = {}
    dry = set() if config.dry_run else None
    for url, name in tags:
        tag = urls.normalize_url(url)
        early = config.mode != "full" and tag in complete
        page, seen, idle, done = url, set(), 0, False
        while page and not stop() and not (config.max_pages and len(seen) >= config.max_pages):
            key = urls.normalize_url(page)
            if key in seen:
                done = True
                break
            seen.add(key)
            status, html = fetch_page(page)
            if html is None:
                done, following, total, new = status is not None and status < 500 and status != 429, None, 0, []
            else:
                posts, following = posts_of(html, page)
                total, new, mine = len(posts), [], set()
                for p in posts:
                    k = key_of(p)
                    if k not in known and k not in mine and not (dry and k in dry):
                        mine.add(k)
                        new.append(p)
                if new:
                    emit(name, page, new)
                (known if dry is None else dry).update(mine)
                if not total and config.stop_on_empty:
                    following = None
                done = following is None
            visited[key] = {"url": page, "next_url": following, "tag": name}
            idle = 0 if new else idle + 1 if total else idle
            if early and total and not new and idle >= max(config.stop_after_known, 1):
                done = False
                break
            page = following
        if done and dry is None:
            complete.add(tag)
    return visited
