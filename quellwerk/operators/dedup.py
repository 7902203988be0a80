"""First-wins deduplication and membership (D-1..D-6, J1-J4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.functions.text import content_hash, post_key


def first_wins(rows: DataFrame, key: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """First row of each key in `order`, with the columns `keep` (default all); `key` columns that start with _ are dropped.

    The row is carried through `min_by`, which combines before the shuffle: a key of which there
    are billions sends one row from each task.  Null keys are one key.  Equal orders are settled
    by the columns kept.  Only what is kept is carried, so leave out texts that nobody reads.
    """
    if keep is not None:
        rows = rows.select(*dict.fromkeys([*keep, *key, *order]))
    row = F.struct(*rows.columns)
    best = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct(*order, F.xxhash64(*rows.columns))).alias("_r"))
    named = rows.columns if keep is None else keep
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in named if c not in key or not c.startswith("_")])


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose `key` is not in `known` (J1-J3), which may have repeats; rows of null key are kept."""
    return rows.join(known.select(key), key, "left_anti")


def new_posts(posts: DataFrame, known: DataFrame, order: list[str], id: str = "id", text: str = "text") -> DataFrame:
    """Posts with `key` and `is_new` (D-3a, J1): the first of its key in `order`, and its key not in `known` (key).

    Posts without id and text have a null key and are not new.
    """
    keyed = posts.withColumn("key", post_key(F.col(id), F.col(text)))
    rank = F.struct(*order)
    first = keyed.filter("key is not null").groupBy("key").agg(F.min(rank).alias("_first"))
    both = keyed.join(unknown(first, known, "key"), "key", "left")
    return both.withColumn("is_new", F.coalesce(F.col("_first") == rank, F.lit(False))).drop("_first")


def layered_dedup(posts: DataFrame, known: DataFrame, stored: DataFrame, order: list[str], id: str = "id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Posts to be stored: new by key, then first by content hash among those, then not in `stored` (hash).

    The set form of a loop over posts in `order` (D-3a, D-3b, J1, J2).  Blank texts are not stored.
    `keep` names the columns wanted beside key and hash (default all).
    """
    fresh = new_posts(posts, known, order, id, text).filter("is_new").drop("is_new")
    hashed = fresh.filter(F.col(text).rlike(r"[^\s\x{A0}\x{FEFF}]")).withColumn("hash", content_hash(F.col(text)))
    return unknown(first_wins(hashed, ["hash"], order, keep and list(dict.fromkeys([*keep, "key", "hash"]))), stored, "hash")
