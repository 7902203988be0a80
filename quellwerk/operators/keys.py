"""Joins and components on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.session import release, written

#: A key is hot from this share of the rows on; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 1000
#: ... and from this many rows on; below it a plain join does no harm.
HOT_ROWS = 50_000
SALTS = 64


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `per_key` (`count` = the number of rows of its key in `rows`, the same in all rows of a key).

    Hot keys, of which there are at most 1 / HOT_SHARE, are spread over SALTS tasks: their row of
    `per_key` is repeated and their rows get a random-free salt.  `per_key` should be materialised;
    it is scanned once more for the sizes.  Null keys match nothing.  `count` is dropped.
    """
    total, largest = per_key.agg(F.sum(count), F.max(count)).first()
    bound = max(HOT_ROWS, (total or 0) * HOT_SHARE)
    if (largest or 0) < bound:
        return rows.join(per_key.drop(count), key, how)
    hot = per_key.filter(F.col(count) >= bound).select(key, F.lit(True).alias("_hot")).distinct()
    salted = (rows.join(F.broadcast(hot), key, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0))
              .drop("_hot"))
    copies = F.when(F.col(count) >= bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(per_key.withColumn("_salt", F.explode(copies)).drop(count), [key, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def smallest_of_key(rows: DataFrame, key: str, id: str, min_members: int = 2) -> DataFrame:
    """(id, key, rep, members): the smallest id of each row's key, for keys of `min_members` or more.

    Rows with a null key are left out.  `rows` should be materialised; it is scanned twice.
    """
    rows = rows.filter(F.col(key).isNotNull()).select(id, key)
    per_key = rows.groupBy(key).agg(F.min(id).alias("rep"), F.count("*").alias("members"))
    per_key = written(per_key.filter(F.col("members") >= min_members).withColumn("_n", F.col("members")), "keys")
    return spread_join(rows, per_key, key, "_n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): connected components of an undirected edge list; root = smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each an aggregation by
    node and a join back that spreads hub nodes; edges stay in tables of the shared folder, only
    their count and checksum reach the driver, and each round's tables are deleted once the next
    ones are written; rounds end when nothing changes, after about the logarithm of the longest
    chain.  Nodes without an edge to another node are not
    returned.  Self-loops, repeated edges and nulls are dropped.
    """
    at = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
          .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    at, before = written(at, "edges"), None
    while True:
        both = at.union(at.select("v", "u"))
        near = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n")), "near")
        large = written(spread_join(both, near, "u", "_n").filter(F.col("v") > F.col("u"))
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        release(at, near)
        near = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")), "near")
        joined = spread_join(large, near, "u", "_n")
        at = written(joined.select("u", F.col("m").alias("v"))
                     .union(joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        release(large, near)
        now = at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
