"""Queries of the training-data operators, named p<problem>_..., over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.llm import abuse, alike, bpe, chunks, columns, groups, incoming, mixing, near

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return columns.garbled_rows(_table(spark, sf, "anecdotes"))


def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled anecdotes with their text as it was meant."""
    return columns.garbled_rows(_table(spark, sf, "anecdotes"), repaired=True)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = groups.ranked(_table(spark, sf, "anecdotes"), _table(spark, sf, "origins"))
    return found.filter("rep_id <> anecdote_id").select("rep_id", "anecdote_id")


def p2_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One record a post, its fields each the best available."""
    return groups.survivors(_table(spark, sf, "anecdotes"), _table(spark, sf, "origins"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    scores = abuse.scored(_table(spark, sf, "anecdotes"), _table(spark, sf, "review_labels"))
    return scores.filter(F.col("score") >= abuse.THRESHOLD).select("anecdote_id")


def p3_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score of each anecdote with its evidence."""
    return abuse.scored(_table(spark, sf, "anecdotes"), _table(spark, sf, "review_labels"))


def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rate of abusive anecdotes of each origin."""
    scores = abuse.scored(_table(spark, sf, "anecdotes"), _table(spark, sf, "review_labels"), keep=["origin"])
    bad = (F.col("score") >= abuse.THRESHOLD).cast("long")
    return scores.groupBy("origin").agg(F.count("*").alias("records"), F.sum(bad).alias("abusive"), F.avg(bad).alias("rate"), F.avg("score").alias("mean_score"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    index = incoming.PostIndex.build(_table(spark, sf, "anecdotes"), _table(spark, sf, "visited_posts"))
    return incoming.ingest_batches(index, _table(spark, sf, "incoming_posts")).filter("case").select("in_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_pairs(_table(spark, sf, "anecdotes"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = groups.collapse_formatting(_table(spark, sf, "anecdotes"))
    return found.filter("rep_id <> anecdote_id").select("rep_id", "anecdote_id")


def p6_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of each class of anecdotes that differ in formatting only."""
    found = groups.collapse_formatting(_table(spark, sf, "anecdotes"))
    return found.filter("rep_id = anecdote_id").select("rep_id", "copies")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return alike.lookalike_pairs(_table(spark, sf, "anecdotes"))


def p7_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Consistent form of each anecdote."""
    return alike.consistent_forms(_table(spark, sf, "anecdotes")).select(F.col("id").alias("anecdote_id"), "form")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_table(spark, sf, "documents"), bpe.Tokenizer(spark))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mix, a row for each copy."""
    return mixing.mixed(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"), bpe.Tokenizer(spark))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares that the mix reaches."""
    return mixing.mixed(_table(spark, sf, "documents"), _table(spark, sf, "mix_targets"), bpe.Tokenizer(spark))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    pieces = chunks.split_oversized(_table(spark, sf, "documents"), bpe.Tokenizer(spark))
    return pieces.filter("piece = 0").select("doc_id")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the oversized documents."""
    return chunks.split_oversized(_table(spark, sf, "documents"), bpe.Tokenizer(spark))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
