"""Visually identical text with different characters (problem 7)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm import form as M
from quellwerk.llm.columns import irregular, map_batches, struct_of
from quellwerk.llm.garble import repair
from quellwerk.llm.near import expanded
from quellwerk.operators.keys import spread_join
from quellwerk.session import default_partitions, release, written

#: Classes of one form that are met together in a task.
SLICE = 1_000


def _screened(df: DataFrame) -> DataFrame:
    """(id, text, irregular, tokens) of each row that is not garbled; `tokens` has the irregular words of irregular rows."""
    schema = struct_of(df, ["id", "text"], irregular=T.BooleanType(), tokens=T.ArrayType(T.StringType()))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        odd = irregular(b.column(1))
        keep, tokens = np.ones(len(odd), bool), [None] * len(odd)
        where = np.flatnonzero(odd)
        for i, t in zip(where, b.column(1).take(pa.array(where)).to_pylist(), strict=True):
            keep[i] = not repair(t)[0]
            if keep[i]:
                tokens[i] = list({w for w in M.TOKEN.findall(t) if M.irregular_word(w)})
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(odd), pa.array(tokens, pa.list_(pa.string()))],
                                          names=schema.names).filter(pa.array(keep))

    return map_batches(df, schema, one)


@F.pandas_udf(T.StringType())
def _respelled(texts: pd.Series, words: pd.Series, spellings: pd.Series) -> pd.Series:
    def one(text: str, words, spellings) -> str:
        known = {w: s for w, s in zip(words, spellings, strict=True)} if words is not None else {}
        return M.consistent(M.TOKEN.sub(lambda m: known.get(m.group(), m.group()), text) if known and text else text)

    return pd.Series([one(*row) for row in zip(texts, words, spellings, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _skeletons(tokens: pd.Series) -> pd.Series:
    return tokens.map(M.skeleton)


def canonical_spellings(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, spelling): the word of `vocabulary` (word, n) that each `token` looks like.

    Both sides meet by the hash of their skeleton, so no task and no driver holds the whole
    vocabulary: each bucket builds the trie of its words and lets its tokens traverse it.  Tokens
    that match no word are left out.  Null tokens and words match nothing.
    """
    # words that no token can look like never enter a trie
    skeletons = tokens.select("skeleton").distinct()
    vocabulary = (vocabulary.withColumn("skeleton", F.translate("word", M.ALIKE_FROM, M.ALIKE_TO))
                  .join(skeletons, "skeleton", "left_semi"))
    buckets = default_partitions(tokens.sparkSession)

    def match(words: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
        trie = M.VocabularyTrie(zip(words["word"], words["n"], strict=True))  # a bucket's words that some token looks like
        found = [(t, trie.canonical(t)) for t in tokens["token"]]
        return pd.DataFrame([(t, s) for t, s in found if s], columns=["token", "spelling"])

    bucket = F.pmod(F.xxhash64("skeleton"), F.lit(buckets * 8))
    return (vocabulary.groupBy(bucket.alias("bucket")).cogroup(tokens.groupBy(bucket.alias("bucket")))
            .applyInPandas(match, "token string, spelling string"))


def consistent_forms(df: DataFrame, id: str = "anecdote_id", text: str = "text") -> DataFrame:
    """(id, text, form, irregular): consistent form of each text (problem 7).

    Words of one script in plain characters are their own form.  Every other word, be it full-width,
    decomposed, broken by ignorables or of mixed scripts, is looked up in tries of the words that
    the regular rows use, at zero cost for ignorables, compatibility forms, accents and
    look-alikes, and takes the most frequent spelling that keeps its own script; what the
    vocabulary does not have is put right by table, like everything beside words.

    Null texts have a null form, "" is its own form; garbled texts take no part and are left out.
    """
    seen = written(_screened(df.select(F.col(id).alias("id"), F.col(text).alias("text"))), "screened")
    odd = F.col("irregular")
    tokens = written(seen.select(F.explode("tokens").alias("token")).distinct().withColumn("skeleton", _skeletons("token")), "tokens")
    vocabulary = (seen.filter(~odd).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word"))
                  .groupBy("word").agg(F.count("*").alias("n")))
    spellings = canonical_spellings(tokens, vocabulary)
    known = (seen.select("id", F.explode("tokens").alias("token")).join(spellings, "token")
             .groupBy("id").agg(F.collect_list("token").alias("_w"), F.collect_list("spelling").alias("_s")))
    respelled = (seen.filter(odd).join(known, "id", "left")
                 .select("id", "text", _respelled("text", "_w", "_s").alias("form"), odd))
    return seen.filter(~odd).select("id", "text", F.col("text").alias("form"), odd).union(respelled)


def lookalike_classes(df: DataFrame, id: str = "anecdote_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members) of the texts that differ as stored but have one consistent form.

    A class is all rows of one stored text; `links` has (a, b), a < b: classes of one form, each named by
    its smallest id; `members` has (unit, id, copies) for each row of a linked class.  Two regular rows with
    one form are equal as stored, so only forms that an irregular row has can give links.  Copies
    meet only in their class; a form of many classes is met in slices of SLICE classes.  Forms
    without letters or digits, null and garbled texts give no links.
    """
    forms = consistent_forms(df, id, text).filter(F.col("form").rlike(r"[\p{L}\p{N}]"))
    keyed = written(forms.select(F.col("id"), F.unhex(F.md5("form")).alias("key"), F.unhex(F.md5(F.concat("form", F.lit("\0"), "text"))).alias("raw"), "irregular"), "forms")
    classes = written(keyed.groupBy("key", "raw").agg(F.min("id").alias("unit"), F.count("*").alias("copies"), F.max("irregular").alias("odd")), "classes")
    per_key = written(classes.groupBy("key").agg(F.count("*").alias("n"), F.max("odd").alias("odd")).filter(F.col("odd") & (F.col("n") > 1))
                      .select("key", "n", F.col("n").alias("_n")), "per-key")
    several = written(spread_join(classes.select("key", "raw", "unit", "copies"), per_key, "key", "_n"), "several")
    slices = F.ceil(F.col("n") / SLICE)
    left = several.select("key", F.pmod(F.xxhash64("raw"), slices).alias("slice"), F.col("unit").alias("a"))
    right = several.select("key", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("slice"), F.col("unit").alias("b"))
    links = written(left.join(right, ["key", "slice"]).filter("a < b").select("a", "b"), "links")
    members = written(spread_join(keyed.select("id", "raw"), several.select("raw", "unit", "copies", F.col("copies").alias("_n")), "raw", "_n")
                      .select("unit", F.col("id").alias(id), "copies"), "members")
    release(keyed, classes, per_key, several)
    return links, members


def lookalike_pairs(df: DataFrame, id: str = "anecdote_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b, of texts that differ as stored but have one consistent form: the links between classes, expanded."""
    return expanded(*lookalike_classes(df, id, text), id)
