"""Groups of copies: collapse of formatting differences (problem 6), one survivor a group (problem 2)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.columns import Letters, inspect, map_batches, struct_of
from quellwerk.operators.keys import broadcast_if_small, components, smallest_of_key, spread_join
from quellwerk.session import release, written

#: Rows of one group that a window sorts in one partition; larger groups are ranked in slices first.
SLICE_ROWS = 100_000


def with_letters(df: DataFrame, id: str, text: str, cheap: bool, keep: list[str] = (), garbled: bool = False) -> DataFrame:
    """`id`, `keep` and a key of the letters of each text: null where it is null, garbled or without letters.

    With `cheap`, `_cheap` (number of letters and their histogram as one number); else `_key`, the
    128-bit digest of the letters.  With `garbled`, also `_garbled`.
    """
    df = df.select(id, text, *keep)
    more = {"_cheap": T.LongType()} if cheap else {"_key": T.BinaryType()}
    schema = struct_of(df, [id, *keep], **more, **({"_garbled": T.BooleanType()} if garbled else {}))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        bad, forms = inspect(b.column(1))
        own = Letters(forms)
        out = [pa.array(own.cheap(), mask=own.count == 0) if cheap else pa.array(own.digests(), pa.binary())]
        return pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *out, *([pa.array(bad)] if garbled else [])], names=schema.names)

    return map_batches(df, schema, one)


def collapse_formatting(df: DataFrame, id: str = "anecdote_id", text: str = "text") -> DataFrame:
    """(rep_id, id, copies) of each row whose letters another row has too (problem 6).

    Progressive partition refinement.  The first partition is by a number made of cheap
    invariants, counted on whole batches: how many letters there are and their histogram.  Rows
    alone in their class leave.  Only the texts of classes of several members are read again for
    the costly key, a 128-bit digest of the letters, which splits the class.  rep_id is the
    smallest id of the final class.

    Rows with null, blank or garbled text, or without any letter, are in no class.  Ids are taken
    to be unique and not null.  Classes of any size are spread.
    """
    rows = written(with_letters(df, id, text, True).filter(F.col("_cheap").isNotNull()), "cheap")
    inside = written(smallest_of_key(rows, "_cheap", id).select(id), "inside")
    texts = df.select(id, text).join(broadcast_if_small(inside, 200_000), id, "left_semi")
    refined = written(with_letters(texts, id, text, False).filter(F.col("_key").isNotNull()), "refined")
    found = written(smallest_of_key(refined, "_key", id).select(F.col("rep").alias("rep_id"), id, F.col("members").alias("copies")), "classes")
    release(rows, inside, refined)
    return found


def post_number(url: Column) -> Column:
    """Number after `/id/` in a url, without leading zeros; null if there is none."""
    n = F.regexp_extract(url, r"/id/0*(\d+)", 1)
    return F.when(n != "", n)


def same_post(df: DataFrame, id: str = "anecdote_id", text: str = "text", url: str = "url") -> DataFrame:
    """(id, rep_id): the smallest id of each row's group, for groups of two and more (problem 2).

    Two rows are the same post if their urls name the same post number or if their letters are
    equal and not empty; groups are closed over chains.  Null urls and texts link nothing.
    """
    base = df.select(F.col(id), F.col(text).alias("_text"), post_number(F.col(url)).alias("_post"))
    return _closed(with_letters(base, id, "_text", False, ["_post"]), id)


def _closed(rows: DataFrame, id: str) -> DataFrame:
    """(id, rep_id) of the groups of rows linked by `_key` or `_post`.

    Each key is turned into a star around its smallest id, so a key that holds a third of all
    rows gives as many edges as rows, not pairs; the stars are joined by :func:`components`.
    """
    links = written(rows.select(id, F.explode(F.array_compact(F.array(
        F.concat(F.lit("l"), F.hex("_key")), F.concat(F.lit("u"), F.col("_post"))))).alias("_key")), "links")
    stars = smallest_of_key(links, "_key", id)
    return components(stars, id, "rep").select(F.col("node").alias(id), F.col("root").alias("rep_id"))


def _values() -> dict[str, Column]:
    """Fields of a survivor and what makes a value of theirs usable: the value itself where it is not null."""
    tags = F.array_distinct(F.filter(F.transform("tags", lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))
    return {
        "text": F.when(F.col("text").rlike(r"\S"), F.col("text")),
        "tags": F.when(F.size(tags) > 0, tags),
        "url": F.when(F.trim("url") != "", F.trim("url")),
        "addedAt": F.when(F.col("addedAt") > F.lit("1970-01-01 00:00:00").cast("timestamp"), F.col("addedAt")),
    }


def _leaders(rows: DataFrame, by: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """`rows` with `_top` and `_of_<field>`: whether a row is the first of its partition, and the first that has the field.

    One window ordering; its frames run up to the row at hand, so a partition streams through.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.row_number().over(w).alias("_place"), *(F.sum(F.col(f"_has_{f}").cast("int")).over(upto).alias(f"_n_{f}") for f in fields))
    flags = [(F.col("_place") == 1).alias("_top"), *((F.col(f"_has_{f}") & (F.col(f"_n_{f}") == 1)).alias(f"_of_{f}") for f in fields)]
    return rows.select("*", *flags).drop("_place", *(f"_n_{f}" for f in fields))


def ranked(anecdotes: DataFrame, origins: DataFrame, id: str = "anecdote_id") -> DataFrame:
    """Each row of `anecdotes` with its post, ranked among the copies of it (problem 2).

    (id, rep_id, copies, ranking columns, `_slice`, `_top`, `_of_<field>`).  Rank: texts that are not garbled
    first, then trust of the origin (unknown origins last), then completeness (number of usable
    fields), then recency of `addedAt`, then the smallest id.  A group of more than
    SLICE_ROWS rows is ranked in slices, so no window sorts a hot group as a whole: the flags name
    the best of each slice, among which :func:`survivors` ranks once more.
    """
    values = _values()
    trust = origins.groupBy("origin").agg(F.max("trust").alias("_trust"))
    base = anecdotes.select(id, F.col("text").alias("_text"), post_number(F.col("url")).alias("_post"), "origin",
                            F.coalesce(F.unix_micros(values["addedAt"].cast("timestamp")), F.lit(0)).alias("_at"),
                            *(v.isNotNull().alias(f"_has_{k}") for k, v in values.items()))
    keep = ["_post", "_at", "_trust", *(f"_has_{k}" for k in values)]
    base = base.join(broadcast_if_small(trust), "origin", "left").withColumn("_trust", F.coalesce("_trust", F.lit(-1)))
    rows = written(with_letters(base, id, "_text", False, keep, garbled=True), "records")
    root = _closed(rows, id)
    sizes = written(root.groupBy("rep_id").agg((F.count("*") + 1).alias("copies")), "sizes")  # the root itself has no row
    grouped = spread_join(root, sizes.withColumn("_n", F.col("copies")), "rep_id", "_n")
    grouped = grouped.union(sizes.select("rep_id", F.col("rep_id").alias(id), "copies").select(*grouped.columns))
    rows = (rows.drop("_key", "_post").join(grouped, id, "left").withColumn("rep_id", F.coalesce("rep_id", id)).withColumn("copies", F.coalesce("copies", F.lit(1)))
            .withColumn("_slice", F.pmod(F.xxhash64(id), F.ceil(F.col("copies") / SLICE_ROWS))))
    return written(_leaders(rows, ["rep_id", "_slice"], _order(values, id), list(values)), "ranked")


def _order(values: dict, id: str) -> list[Column]:
    usable = sum((F.col(f"_has_{k}").cast("int") for k in values), F.lit(0))
    return [F.col("_garbled"), F.col("_trust").desc(), usable.desc(), F.col("_at").desc(), F.col(id)]


def survivors(anecdotes: DataFrame, origins: DataFrame, id: str = "anecdote_id") -> DataFrame:
    """One record for each post of `anecdotes`, built field by field from its copies (problem 2).

    (rep_id, best_id, copies, text, tags, url, addedAt): `best_id` is the best-ranked row, each field the value of
    the best-ranked row that has one.  `text` is the best non-blank one; `tags` the best non-empty
    list, trimmed and without blanks and repeats; `url` the best non-empty one; `addedAt` the best
    that is later than the epoch.  A field no copy has is null.  Posts without copies come out as
    they are, cleaned.  Only ranking columns are ranked; the values are fetched by the ids that won.
    """
    values = _values()
    fields = list(values)
    first = ranked(anecdotes, origins, id)
    flags = ["_top", *(f"_of_{f}" for f in fields)]
    won = first.filter(F.greatest(*(F.col(f) for f in flags)))  # at most one row a flag and slice
    won = _leaders(won.drop(*flags), ["rep_id"], _order(values, id), fields).filter(F.greatest(*(F.col(f) for f in flags)))
    named = anecdotes.select(id, *(v.alias(f"_v_{k}") for k, v in values.items()))
    rows = won.select("rep_id", id, "copies", *flags).join(named, id)
    return rows.groupBy("rep_id", "copies").agg(
        F.max(F.when(F.col("_top"), F.col(id))).alias("best_id"),
        *(F.first(F.when(F.col(f"_of_{f}"), F.col(f"_v_{f}")), ignorenulls=True).alias(f) for f in fields))
