"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.bpe import Tokenizer, count_tokens
from quellwerk.session import written

MAX_SOURCES = 100_000


def repetition_rates(sources: list[tuple[str, float, int, int]], total: float | None = None, least: float = 0.0) -> dict[str, float]:
    """How often each source is used: {source: rate}, 0 <= rate <= max_repeats.

    `sources` holds (source, target share, max repeats, tokens).  Without `total` the mix is the
    largest one in which every source that has tokens still reaches its share: closeness to the
    targets comes first, size second, so one tiny source may make it small.  `least` is the part
    of the available tokens that it has then at least, at the cost of the shares of such sources.
    Sources that would need more than their cap get the cap, and what they miss is spread over
    the others in proportion to their targets until it fits or all are capped.  Sources without
    tokens, with a null or non-positive share or cap have rate 0.
    """
    open_ = {s: (share, cap, n) for s, share, cap, n in sources if n and share and cap and share > 0 and cap > 0}
    rates = {s: 0.0 for s, *_ in sources}
    if total is None and open_:
        reach = sum(share for share, _, _ in open_.values()) * min(cap * n / share for share, cap, n in open_.values())
        total = max(reach, least * sum(n for _, _, n in open_.values()))
    elif total is None:
        return rates
    left = float(total)
    while open_ and left > 0:
        whole = sum(share for share, _, _ in open_.values())
        full = {s for s, (share, cap, n) in open_.items() if left * share / whole >= cap * n}
        if not full:
            return rates | {s: left * share / whole / n for s, (share, _, n) in open_.items()}
        for s in full:
            _, cap, n = open_.pop(s)
            rates[s] = float(cap)
            left -= cap * n
    return rates


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: Tokenizer, total: float | None = None, seed: int = 0,
          least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of a mix of `documents` to the shares of `targets` (problem 9).

    Sizes are counts of tokens.  Each document is emitted floor(rate) times, and once more if a
    number in [0, 1) made from `seed` and its id is below the rest of the rate: the same seed
    gives the same mix on any cluster.  `total` and `least` are those of
    `repetition_rates`.  `copies` has (doc_id, source, copy, tokens), copy from 1;
    `shares` has a row a target: what it asked for, had, got, and the shares reached.

    Documents of null sources or sources without target are left out; documents without tokens
    follow their source's rate.  Sources missing from `documents` are reported with 0.  The
    aggregate by source combines map-side, and only `targets` (at most MAX_SOURCES rows) is
    broadcast, so one source may hold any part of the rows.
    """
    spark = documents.sparkSession
    targets = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    if targets.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    wanted = F.broadcast(targets.select("source"))
    sized = written(count_tokens(documents.join(wanted, "source", "left_semi"), tokenizer, keep=["source"]), "sized")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    rows = targets.join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)), F.coalesce("documents", F.lit(0))).collect()
    rates = repetition_rates([tuple(r[:4]) for r in rows], total, least)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()),
                           T.StructField("max_repeats", T.IntegerType()), T.StructField("tokens_available", T.LongType()),
                           T.StructField("documents", T.LongType()), T.StructField("rate", T.DoubleType())])
    plan = spark.createDataFrame([(*r, rates[r[0]]) for r in rows], schema)
    # 53 bits of the hash as a number in [0, 1)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    whole = F.floor("rate")
    times = (whole + (chance < F.col("rate") - whole).cast("long")).cast("int")
    chosen = sized.join(F.broadcast(plan.select("source", "rate")), "source").withColumn("times", times).filter("times > 0")
    copies = chosen.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "tokens")
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("records"))
    all_tokens = got.agg(F.sum("tokens")).first()[0] or 0
    shares = plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "tokens_available", "rate",
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(max(all_tokens, 1))).alias("share"))
    return copies, shares
