"""Operators on groups and pairs, against brute force on small tables."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quellwerk.llm import abuse, alike, columns, form, garble, groups, incoming, mixing, near
from quellwerk.llm.bpe import Tokenizer
from quellwerk.operators import keys

SCHEMA = "anecdote_id long, origin string, text string, tags array<string>, addedAt timestamp, url string, rep_id string, _key string, members string"


def table(spark, rows):
    """Rows (id, text, url, tags, day, origin), with columns whose names clash with those used inside."""
    full = [(i, o, t, g, d and dt.datetime(2024, 1, d), u, "clash", "clash", "clash") for i, t, u, g, d, o in ((*r, *(None,) * (6 - len(r))) for r in rows)]
    return spark.createDataFrame(full, SCHEMA)


def letters(text):
    if not text or garble.repair(text)[0]:
        return ""
    return "".join(regex.findall(r"[\p{L}\p{N}]+", form.consistent(text).lower()))


TEXTS = ["Кот спит.", "кот, спит", "КОТ СПИТ!", "Koт сп​ит", "Кот не спит", None, "", " ... ", "ÐšÐ¾Ñ‚ ÑÐ¿Ð¸Ñ‚ Ð½Ð° Ð´Ð¸Ð²Ð°Ð½Ðµ", "Кот спит."]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_collapse_and_same_post(spark, monkeypatch, hot):
    monkeypatch.setattr(keys, "HOT_ROWS", hot)
    urls = [None, "https://h.example/id/7/", None, None, "http://m.h.example/id/007?x", "", "https://h.example/about", None, None, "https://h.example/id/8"]
    df = table(spark, [(i, t, u) for i, (t, u) in enumerate(zip(TEXTS, urls, strict=True))])
    got = {(r.rep_id, r.anecdote_id, r.copies) for r in groups.collapse_formatting(df).collect()}
    assert got == {(0, i, 5) for i in (0, 1, 2, 3, 9)}
    assert {(r.anecdote_id, r.rep_id) for r in groups.same_post(df).collect()} == {(i, 0) for i in (1, 2, 3, 4, 9)}
    assert groups.collapse_formatting(df.limit(0)).count() == groups.same_post(df.limit(0)).count() == 0


def test_garbled_columns(spark):
    df = table(spark, list(enumerate(TEXTS)))
    assert [r.anecdote_id for r in columns.garbled_rows(df).collect()] == [8]
    assert columns.garbled_rows(df, repaired=True).first().repaired.startswith("Кот")
    assert columns.garbled_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("slice_rows", [100_000, 1])
def test_survivors(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(groups, "SLICE_ROWS", slice_rows)
    df = table(spark, [(1, "кот спит", "u/id/1", [" a", ""], None, "low"), (2, None, "https://h.example/id/1", ["b", "b"], 5, "high"), (3, " ", "/id/1", [], 9, None),
                       (4, "Кот спит", None, None, 7, "high"), (5, None, None, None, None, None), (6, "same", None, None, 1, "low"), (7, "same", None, None, 1, "low")])
    origins = spark.createDataFrame([("low", 10), ("high", 90), ("high", 80), ("none", None)], "origin string, trust int")
    rows = {r.rep_id: r for r in groups.survivors(df, origins).collect()}
    one = rows[1]
    assert sorted(rows) == [1, 5, 6] and (one.best_id, one.copies) == (2, 4)
    assert (one.text, one.tags, one.url, one.addedAt.day) == ("Кот спит", ["b"], "https://h.example/id/1", 5)
    assert rows[5].text is None and rows[6].best_id == 6


def test_lookalike_pairs(spark):
    rows = [(1, "Кот спит"), (2, "Koт спит"), (3, "Кот\xa0спит"), (4, "кот спит"), (5, "Кот спит"), (6, "…"), (7, "..."), (8, None), (9, "")]
    df = table(spark, rows)
    forms = {r.id: r.form for r in alike.consistent_forms(df).collect()}
    assert forms == {i: form.consistent(t) for i, t in rows}
    got = {(r.id_a, r.id_b) for r in alike.lookalike_pairs(df).collect()}
    assert got == {(a, b) for a, ta in rows for b, tb in rows if a < b and ta and tb and ta != tb and letters(ta) and form.consistent(ta) == form.consistent(tb)}
    assert alike.lookalike_pairs(df.limit(0)).count() == 0


def test_lookalikes_of_a_hot_form(spark, monkeypatch):
    """Equal texts meet in their class only, forms of many spellings in slices."""
    monkeypatch.setattr(alike, "SLICE", 2)
    monkeypatch.setattr(keys, "HOT_ROWS", 50)
    spellings = ["K\u043e\u0442 спит", "К\u006f\u0442 спит", "Кот\xa0спит", "Кот с\u200bпит"]
    df = table(spark, [(i, "Кот спит") for i in range(3000)] + [(5000 + i, t) for i, t in enumerate(spellings)])
    links, members = alike.lookalike_classes(df)
    assert links.count() == 10 and members.count() == 3004
    assert alike.lookalike_pairs(df).count() == 3000 * 4 + 6


def retellings(n, seed):
    """Texts of 30 to 60 words, many of them edits of one another."""
    r = random.Random(seed)
    common, out = [f"слово{i}" for i in range(60)], []
    for i in range(n):
        if out and r.random() < 0.7:
            words = r.choice(out)[:]
            for _ in range(r.randrange(14)):
                k = r.randrange(len(words))
                words[k:k + r.randrange(2)] = [r.choice(common + [f"имя{i}{k}"])] * r.randrange(2)
        else:
            words = r.sample(common, r.randrange(28, 45)) + [f"имя{i}"]
        r.shuffle(words)
        out.append(words)
    return [" ".join(w) for w in out]


def similar(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return min(len(a), len(b)) >= 30 and 5 * len(a & b) >= 3 * len(a | b)


@pytest.mark.parametrize("node_max", [100_000, 20])
def test_near_pairs(spark, monkeypatch, node_max):
    monkeypatch.setattr(near, "NODE_MAX", node_max)
    texts = retellings(150, 4)
    rows = [*enumerate(texts), (900, texts[0]), (901, texts[0].upper()), (902, None), (903, ""), (904, "мало слов")]
    got = {(r.id_a, r.id_b) for r in near.near_pairs(table(spark, rows)).collect()}
    want = {(a, b) for a, ta in rows for b, tb in rows if a < b and ta and tb and letters(ta) != letters(tb) and similar(ta, tb)}
    assert len(want) > 100 and got == want
    assert near.near_pairs(table(spark, rows[-3:])).count() == 0


def test_tree_opens_heavy_nodes(monkeypatch):
    """The in-task tree gives the same candidates however far it is opened."""
    r = np.random.default_rng(2)
    n, k = 300, 36
    sets = [np.sort(r.choice(70, k, replace=False)) for _ in range(n)] + [np.arange(k)] * 2
    node, unit, skip, windows = [], [], [], []
    bound = int(near.most_skipped(np.array(k)))
    for i, s in enumerate(sets):
        for p in range(bound + 1):
            node.append(int(s[p])), unit.append(i), skip.append(p), windows.append(s[p + 1:bound + near.DEPTH].astype(np.uint16))
    off, values = np.concatenate(([0], np.cumsum([len(w) for w in windows]))), np.concatenate(windows)
    size, side = np.full(len(node), k, np.int32), np.zeros(len(node), np.int8)
    zero = np.zeros(len(node), np.int64)
    args = (np.array(node, np.int64), np.array(unit, np.int64), side, size, np.array(skip, np.int32), zero, zero, off, values)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= near.overlap_needed(k, k)}
    for light, chunk in ((10**9, 10**6), (4, 10**6), (2, 400)):
        monkeypatch.setattr(near, "LIGHT", light)
        monkeypatch.setattr(near, "CHUNK", chunk)
        got = {(int(b), int(a)) for p in near.tree_pairs(*args) for a, b in p.T}
        assert {(i, j) for i, j in got if len(np.intersect1d(sets[i], sets[j])) >= near.overlap_needed(k, k)} == want


def test_opened_nodes_hold_what_a_query_can_reach(monkeypatch):
    """Below the root stored entries are compared only where a query of their node can be near; no pair is lost."""
    r = np.random.default_rng(3)
    sets = [np.sort(r.choice(80, k, replace=False)) for k in r.integers(30, 70, 100)]
    asked = [i for i in range(len(sets)) if i % 8 == 0]
    node, unit, skip, windows, sizes = [], [], [], [], []
    for i, s in enumerate(sets):
        bound = int(near.most_skipped(np.array(len(s))))
        for p in range(bound + 1):
            node.append(int(s[p])), unit.append(i), skip.append(p), sizes.append(len(s)), windows.append(s[p + 1:bound + near.DEPTH].astype(np.uint16))
    off, values = np.concatenate(([0], np.cumsum([len(w) for w in windows]))), np.concatenate(windows)
    zero, side = np.zeros(len(node), np.int64), np.isin(unit, asked).astype(np.int8)
    args = (np.array(node, np.int64), np.array(unit, np.int64), side, np.array(sizes, np.int32), np.array(skip, np.int32), zero, zero, off, values)
    compared, idle, pairs = 0, 0, near._pairs

    def watched(start, n, order, unit, side, size, skip, *rest):
        nonlocal compared, idle
        for a, z in zip(start, start + n, strict=True):
            e = order[a:z]
            v, u, q = near.NUM * size[e].astype(int), near.DEN * size[e].astype(int) - (near.NUM + near.DEN) * skip[e], side[e] & 1 > 0
            compared += int((~q).sum())
            idle += int((~q & ((u < v[q].min()) | (v > u[q].max()))).sum())
        return pairs(start, n, order, unit, side, size, skip, *rest)

    monkeypatch.setattr(near, "_pairs", watched)
    monkeypatch.setattr(near, "LIGHT", 2)
    monkeypatch.setattr(near, "FEW", 0)
    both = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= near.overlap_needed(len(sets[i]), len(sets[j]))}
    for cross, want in ((near.STORED, {p for p in both if sum(i in asked for i in p) == 1}), (near.AMONG, {p for p in both if any(i in asked for i in p)})):
        got = {(int(a), int(b)) for p in near.tree_pairs(*args, cross) for a, b in p.T}
        assert got & both == want and len(want) > 20
        assert compared > 1000 and idle < compared / 8  # slots may collide
        compared = idle = 0


def test_a_query_looks_only_at_entries_of_its_reach(monkeypatch):
    """A node whose pairs are few beside its children is compared at once, and pairs too far apart in size are not even made."""
    n = 260
    size = np.random.default_rng(3).integers(30, 120, n).astype(np.int32)
    side = (np.arange(n) < 60).astype(np.int8)
    looked, ranges = 0, near._ranges

    def counted(starts, lengths):
        nonlocal looked
        looked += int(lengths.sum())
        return ranges(starts, lengths)

    def never(*_):
        raise AssertionError("opened")

    monkeypatch.setattr(near, "_ranges", counted)
    monkeypatch.setattr(near, "_children", never)
    zero = np.zeros(n, np.int64)
    off = np.concatenate(([0], np.cumsum(np.minimum(near.most_skipped(size.astype(np.int64)) + near.DEPTH, size) - 1)))
    args = (zero + 7, np.arange(n), side, size, zero.astype(np.int32), zero, zero, off, np.zeros(off[-1], np.uint16))
    got = [(int(a), int(b)) for p in near.tree_pairs(*args, near.STORED) for a, b in p.T]
    want = {(i, j) for i in range(60) for j in range(60, n) if near.NUM * max(size[i], size[j]) <= near.DEN * min(size[i], size[j])}
    assert set(got) == want and len(got) == len(want) > 1000
    assert looked <= 2 * n + len(want)  # the node's entries twice, and the pairs


def test_known_keys_are_read_once_a_batch(spark, monkeypatch):
    joined, spread = [], incoming.spread_join
    monkeypatch.setattr(incoming, "spread_join", lambda rows, per_key, *args: joined.append(per_key) or spread(rows, per_key, *args))
    index = incoming.PostIndex.build(spark.createDataFrame([(1, "Кот спит")], "anecdote_id long, text string"), spark.createDataFrame([(["anek:id:7"],)], "posts array<string>"))
    posts = spark.createDataFrame([(1, "7", "Пёс"), (2, "8", "кот спит!"), (3, "9", "Рыба")], "in_id long, id string, text string")
    assert sorted(r.in_id for r in index.ingest(posts).filter("case").collect()) == [1, 2]
    assert joined and all(hasattr(x, "_written_to") for x in joined)  # a table of the keys found, not the index itself


def test_inspection_stops_at_the_first_sufficient_repair(monkeypatch):
    texts = ["Кот спит на диване и ждёт ужина.".encode().decode("cp1252", "replace"), "Кот спит на диване".encode("koi8-r").decode("cp1251"), *TEXTS,
             "Старый кот спит. " + "Молодой пёс громко лает.".encode("cp1251").decode("koi8-r"), "Ãëàäèò êîòà", "Le café déjà vu", "Кoт и пёс &amp; кролик"]
    found, expanded, neighbours = [], 0, garble.neighbours

    def counted(*args):
        nonlocal expanded
        expanded += 1
        return neighbours(*args)

    monkeypatch.setattr(garble, "neighbours", counted)
    for look in (lambda: [garble.repair(t)[0] for t in texts], lambda: columns.inspect(columns.pa.array(texts))[0].tolist()):
        garble._search_word.cache_clear()
        found.append((look(), expanded))
        expanded = 0
    (want, all_of_them), (got, fewer) = found
    assert got == want and 3 < sum(want) < len(texts) - 3 and fewer < all_of_them


@pytest.mark.parametrize("node_max", [4, 50])
def test_nodes_opened_before_and_in_the_task(spark, monkeypatch, node_max):
    """Texts that pass over as many words as they may are met however far the nodes were opened before."""
    monkeypatch.setattr(near, "NODE_MAX", node_max)
    k, n = 30, near.LIGHT + 12  # workers keep LIGHT, so the node has more texts than that
    bound = int(near.most_skipped(np.array(k)))
    shared = [f"общее{i}" for i in range(k)]
    # own words come first: a retelling passes over `bound` words; the others make the template's last words the most frequent, so it passes over none
    rows = [(0, " ".join(shared))] + [(1 + i, " ".join([f"своё{i}x{j}" for j in range(bound)] + shared[bound:])) for i in range(n)]
    rows += [(1000 + i, " ".join(shared[:bound] + [f"чужое{i}x{j}" for j in range(k - bound)])) for i in range(n + 20)]
    got = {(r.id_a, r.id_b) for r in near.near_pairs(table(spark, rows)).collect()}
    assert got == {(a, b) for a in range(n + 1) for b in range(a + 1, n + 1)}


@pytest.mark.parametrize("hot_nodes", [200_000, 1])
def test_one_long_text_among_many_short_ones(spark, monkeypatch, hot_nodes):
    """Nodes that stay large whatever is opened are compared block by block, and lose nothing."""
    monkeypatch.setattr(near, "NODE_MAX", 50)
    monkeypatch.setattr(near, "BLOCK_TEXTS", 30)
    monkeypatch.setattr(near, "HOT_NODES", hot_nodes)
    shared = [f"общее{i}" for i in range(27)]
    rows = [(0, " ".join(shared + [f"длинное{j}" for j in range(13)]))]
    rows += [(1 + i, " ".join(shared + [f"своё{i}x{j}" for j in range(3)])) for i in range(200)]
    got = {(r.id_a, r.id_b) for r in near.near_pairs(table(spark, rows)).collect()}
    assert got == {(a, b) for a in range(201) for b in range(a + 1, 201)}
    # the same with 120 of them stored and the others asked
    units = near.units_of(near.word_sets(table(spark, rows), "anecdote_id", "text"), "anecdote_id")
    order, _ = near.word_order(units)
    met = near.candidates(near.entries(units.withColumn("side", (F.col("unit") >= 120).cast("int")), order), cross=True)
    assert {(r.a, r.b) for r in near.checked(met, units).collect()} == {(a, b) for a, b in got if b >= 120}


def sequential(anecdotes, visited, posts):
    ids, texts = set(), [t for t in anecdotes if t]
    known, out = {letters(t) for t in texts} - {""}, []
    for i, id_, text in posts:
        tid = (id_ or "").strip()
        key = f"anek:id:{tid}" if tid else "anek:txt:" + hashlib.sha256(" ".join(text.split()).encode()).hexdigest() if text else None
        if key in visited or tid in ids or letters(text) in known or (text and any(similar(text, t) for t in texts)):
            out.append(i)
        else:
            ids |= {tid} - {""}
            known |= {letters(text)} - {""}
            texts += [text] if text else []
    return out


@pytest.mark.parametrize("limit, settle", [(200_000, 500_000), (3, 2)])
def test_incoming(spark, monkeypatch, limit, settle):
    texts = retellings(120, 9)
    anecdotes = [*texts[:30], None, ""]
    r = random.Random(1)
    posts = []
    for i, t in enumerate([*texts[30:], *texts[60:70], None, "", " ", texts[40].upper(), "коротко", "Коротко!", "ново"]):
        posts.append((i, r.choice([None, "", " ", f" {r.randrange(60)} "]), t))
    visited = ["anek:id:7", "anek:id:8", "anek:txt:" + hashlib.sha256("ново".encode()).hexdigest(), None]
    stored = spark.createDataFrame(list(enumerate(anecdotes)), "anecdote_id long, text string")
    states = spark.createDataFrame([(visited,), (None,), ([],), (visited[:1],)], "posts array<string>")
    df = spark.createDataFrame([(*p, i // 40) for i, p in enumerate(posts)], "in_id long, id string, text string, key long")
    want = sequential(anecdotes, set(visited) - {None}, posts)
    assert 20 < len(want) < len(posts) - 20
    if limit > 10:
        once = incoming.PostIndex.build(stored, states).ingest(df)
        assert sorted(x.in_id for x in once.filter("case").collect()) == want
    monkeypatch.setattr(incoming, "BROADCAST_KEYS", limit)
    monkeypatch.setattr(incoming, "SETTLE", settle)
    monkeypatch.setattr(incoming, "PROBE_ENTRIES", 0 if limit < 10 else 1_000_000)
    index, found = incoming.PostIndex.build(stored, states), []
    for batch in range(4):  # each by a job that knows the path only
        found += [x.in_id for x in incoming.PostIndex.open(spark, index.path).ingest(df.filter(F.col("key") == batch)).filter("case").collect()]
    assert sorted(found) == want
    if limit < 10:
        return
    batches = incoming.ingest_batches(incoming.PostIndex.build(stored, states), df.withColumn("batch", F.when(F.col("key") > 1, F.col("key"))), "batch")
    assert sorted(x.in_id for x in batches.filter("case").collect()) == want
    assert incoming.ingest_batches(incoming.PostIndex.open(spark, index.path), df.limit(0), "key").count() == 0
    with pytest.raises(RuntimeError):  # others have appended since it was opened
        index.ingest(df.limit(1))
    empty = incoming.PostIndex.build(stored.limit(0), states.limit(0))
    assert empty.ingest(df.limit(0)).count() == 0


@pytest.mark.parametrize("probe", [300, 60])
def test_large_batch_is_probed_in_slices(spark, monkeypatch, probe):
    r = random.Random(9)
    words = ["".join(r.choice("абвгдежзиклмн") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(r.sample(words, 36)) for _ in range(30)]
    near_ones = [" ".join([*t.split()[:30], *r.sample(words, 6)]) for t in texts for _ in range(2)]
    stored = spark.createDataFrame(list(enumerate([*texts, *near_ones[:20]])), "anecdote_id long, text string")
    states = spark.createDataFrame([], "posts array<string>")
    posts = spark.createDataFrame([(i, None, t) for i, t in enumerate([*near_ones[20:], *(" ".join(r.sample(words, 36)) for _ in range(20))])], "in_id long, id string, text string")
    want = sorted(tuple(x) for x in incoming.PostIndex.build(stored, states).ingest(posts).collect())
    shuffled, asked, candidates, probed = [], [], near.candidates, near.probed

    def all_candidates(at, cross=False, **k):
        if cross:
            shuffled.append(at.filter("side = 0").count())
        return candidates(at, cross, **k)

    def all_probed(cells, queries):
        asked.append(queries.count())
        return probed(cells, queries)

    monkeypatch.setattr(incoming, "PROBE_ENTRIES", probe)
    monkeypatch.setattr(near, "candidates", all_candidates)
    monkeypatch.setattr(near, "probed", all_probed)
    index = incoming.PostIndex.build(stored, states)
    assert sorted(tuple(x) for x in index.ingest(posts).collect()) == want and {True, False} == {x[1] for x in want}
    assert len(asked) > 1 and max(asked) <= probe
    cells = index.table("cells").filter("unit >= 0").count()
    assert len(shuffled) <= 1 and sum(shuffled) < cells  # never all cells


def test_rates():
    assert mixing.repetition_rates([("a", 0.5, 1, 100), ("b", 0.5, 4, 10), ("c", 0.0, 1, 5), ("d", 0.2, 3, 0), ("e", None, 1, 9)]) == pytest.approx({"a": 0.4, "b": 4.0, "c": 0, "d": 0, "e": 0})
    got = mixing.repetition_rates([("a", 0.5, 1, 100), ("b", 0.5, 4, 10)], 110)
    assert got == pytest.approx({"a": 0.7, "b": 4.0})
    assert mixing.repetition_rates([("a", 0.5, 1, 100), ("b", 0.5, 4, 10)], 10_000) == {"a": 1.0, "b": 4.0}
    assert mixing.repetition_rates([]) == {}


def test_scarce_source_keeps_its_share():
    """A mix without a given size isn't enlarged at the cost of a share that a smaller one reaches."""
    sources = [("a", 0.5, 1, 1000), ("b", 0.5, 2, 10)]
    assert mixing.repetition_rates(sources) == pytest.approx({"a": 0.02, "b": 2.0})
    assert mixing.repetition_rates(sources, least=0.5) == pytest.approx({"a": 0.485, "b": 2.0})


def test_mix(spark):
    docs = spark.createDataFrame([(i, "слово " * (1 + i % 3), "big" if i % 4 else "small", "x") for i in range(2000)] + [(5000, None, "big", "x"), (5001, "a", None, "x"), (5002, "a", "other", "x")],
                                 "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("gone", 0.1, 2), ("big", 0.5, 2)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mixed(docs, targets, Tokenizer(spark))
    s = {r.source: r for r in shares.collect()}
    assert s["gone"].tokens == 0 and s["big"].share == pytest.approx(5 / 9, abs=0.02) and s["small"].share == pytest.approx(4 / 9, abs=0.02)
    by = {r.source: r.n for r in copies.groupBy("source").agg(F.max("copy").alias("n")).collect()}
    assert set(by) == {"big", "small"} and by["small"] <= 3
    again = mixing.mixed(docs.repartition(7), targets, Tokenizer(spark))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies.collect()))
    assert mixing.mixed(docs.limit(0), targets, Tokenizer(spark))[0].count() == 0


def test_abuse(spark):
    r = random.Random(2)
    calm = ["кот спит на диване у окна", "рыбак чинит старую лодку", "повар варит густой суп", "дети рисуют большой дом"]
    bad = "закрой рот {} безмозглый"
    rows, labels = [], []
    for i in range(240):
        text = ". ".join(r.sample(calm, 2))
        mean = i % 4 == 0
        rows.append((i, text + (". " + bad.format(r.choice(["дурак", "идиот", "кретин"])) if mean else ""), ["смех"] if i % 3 else None))
        labels += [(i, 1 if mean else 0)] * (i % 2 + 1) if i < 200 else []
        if i == 50:
            labels += [(i, None), (51, 1), (51, 0)]
    odd = {300: "Закрой рот, и д и о т безмозглый!", 301: "закрой рот, кр@тин безмозглый", 302: "З​акрой рот дypaк безмозглый", 303: None, 304: "", 305: "кот закрыл окно", 306: "закрой рот кретиииин безмозглый"}
    rows += [(i, t, None) for i, t in odd.items()]
    df = spark.createDataFrame(rows, "anecdote_id long, text string, tags array<string>")
    lab = spark.createDataFrame(labels, "anecdote_id long, abusive int")
    got = {x.anecdote_id: x for x in abuse.scored(df, lab).collect()}
    assert {i for i, x in got.items() if x.score >= abuse.THRESHOLD} == {i for i in range(240) if i % 4 == 0} | {300, 301, 302, 306}
    assert got[0].evidence and got[305].score == 0 and got[303].score == got[304].score == 0
    assert {x.score for x in abuse.scored(df, lab.limit(0)).collect()} == {0.0}
    assert abuse.scored(df.limit(0), lab).count() == 0


def test_neighbours_are_exact(monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    records = [(r.random() < 0.4, [tuple(sorted(r.sample(words, r.randrange(2, 7))))]) for _ in range(400)]
    monkeypatch.setattr(abuse, "BLOCK", 16)
    ex = abuse.Examples(records).fit({w: r.randrange(1, 90) for w in words}, 400)
    for _ in range(60):
        ids = sorted(r.sample(range(len(ex.words)), 4))
        q = ex.idf[ids] / np.sqrt((ex.idf[ids] ** 2).sum())
        cos = [sum(float(w * q[ids.index(t)]) for t, w in zip(ex.term[a:b], ex.weight[a:b], strict=True) if t in ids) for a, b in zip(ex.start[:-1], ex.start[1:], strict=True)]
        want = sorted((-c for c in cos if c >= abuse.NEAR))[:abuse.NEIGHBOURS]
        assert [c for c, _ in ex.neighbours(ids)] == pytest.approx([-c for c in want])


def test_words_of_a_batch_are_those_of_its_segments():
    """The known words found in arrays are those found sentence by sentence."""
    import pyarrow as pa

    texts = ["Кот спит. Пёс — нет! «Да?» Нет\nа вот (так.) и «всё.» Конец", "", None, "one two. Three four… five", "сп@ит к о т а. кот", "a.b c", "?! да", "кот\n\nкот кот", "ab1 cd", "Ты «кот». Да"]
    tags = [["кот", None, ""], None, ["да", "нет"], [], ["кот"], None, None, None, None, ["КОТ!"]]
    words = sorted({w for t, g in zip(texts, tags, strict=True) for s in abuse.segments(t, g, True) + abuse.segments(t, g, False) for w in s})
    ex = abuse.Examples([(False, [(w,)]) for w in words] * 2)
    row, seg, word = ex.told(pa.array(texts), pa.array(tags, pa.list_(pa.string())))
    got = [set() for _ in texts]
    for i in range(len(texts)):
        for x in np.unique(seg[row == i]):
            got[i].add(tuple(word[(row == i) & (seg == x)].tolist()))
    odd = abuse.disguised(pa.array(texts))
    assert odd[4] and not odd[0]
    assert got == [{tuple(ex._ids(s)) for s in abuse.segments(t, g, bool(o))} for t, g, o in zip(texts, tags, odd, strict=True)]
