"""Near-duplicate texts: an exact set-similarity join over a distributed prefix tree (problem 5).

Each text is the set of its words, written in one global order: rare words first (by hash), then
frequent ones by rising frequency.  The sets are the paths of a tree in which a text sits in each
node whose path may be the *first* words it shares with another text; what it passes over on the
way is lost to the overlap, so a node is entered only while the words left can still reach the
overlap that the threshold asks for (the remaining-length bound).  Two similar texts share a node
at each depth up to their overlap.  Nodes of few texts compare them; larger nodes are opened one
word further, subtrees in which no pair can reach its overlap any more are cut.

The level below the root is cut by a shuffle on its nodes; deeper levels are opened inside the
task as sorts of integer arrays, nodes of too many texts already before the shuffle.  Nodes that
no opening makes small (retellings of one template) are cut into blocks, and each pair of blocks is
a task of its own.  Pairs that meet are sifted by size, by the words passed over and by a 128-bit sketch (which never loses a
pair), and what is left is checked exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.llm.columns import Letters, _mix, inspect, map_batches, struct_of
from quellwerk.operators.keys import spread_join
from quellwerk.session import default_partitions, release, written

MIN_WORDS = 30
#: Similarity of 3/5 or more, kept as whole numbers so that bounds are exact.
NUM, DEN = 3, 5
#: Most words that the broadcast order lists; a word is listed if it makes up this share of all.
LISTED = 100_000
#: A node of more texts than this is opened before the shuffle ...
NODE_MAX = 100_000
#: ... and one of more texts than this inside the task, if queries are asked and it has more than so many.
LIGHT, FEW = 128, 48
DEPTH = 4
#: A node that is still larger than NODE_MAX at DEPTH is cut into blocks of about this many texts.
BLOCK_TEXTS = 20_000
#: Hot nodes are broadcast up to this number, beyond it they are joined by a shuffle.
HOT_NODES = 200_000
CHUNK = 2_000_000
#: Pairs that are sifted at a time; their arrays stay in the processor's cache.
PAIRS_AT_ONCE = 1 << 17
#: Pairs of a node, near or far in size, that are sifted in the time in which one child of an entry is made and looked at.
PAIRS_A_CHILD = 32
#: Slots that tree_pairs looks up in which children of a node can meet; any number is exact.
SLOTS = 1 << 20
#: Entries that are worth a task, where their number is known.
ENTRIES_A_TASK = 20_000


def overlap_needed(a, b):
    """Least number of shared words of two sets of sizes a and b that are similar."""
    return -(-NUM * (a + b) // (NUM + DEN))


def most_skipped(size):
    """Most words that a set of `size` may lose to any similar set."""
    smallest = np.maximum(MIN_WORDS, -(-NUM * size // DEN))
    return size - overlap_needed(size, smallest)


def word_sets(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, _unit, _letters, _words) of the texts with at least MIN_WORDS distinct words.

    `_letters` and `_unit` are 128-bit digests of the letters, and of letters and words together;
    texts of one unit are interchangeable.  Null and garbled texts have no words.
    """
    df = df.select(id, text)
    schema = struct_of(df, [id], _unit=T.BinaryType(), _letters=T.BinaryType(), _words=T.ArrayType(T.LongType(), False))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        own = Letters(inspect(b.column(1))[1])
        hashes, offsets = own.words()
        rows = np.flatnonzero(np.diff(offsets) >= MIN_WORDS)
        digests = own.digests()
        letters = [digests[i] for i in rows]
        sets = [hashes[offsets[i]:offsets[i + 1]] for i in rows]
        units = [hashlib.blake2b(d + s.tobytes(), digest_size=16).digest() for d, s in zip(letters, sets, strict=True)]
        ends = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
        out = [b.column(0).take(pa.array(rows)), pa.array(units, pa.binary()), pa.array(letters, pa.binary()),
               pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))]
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    return map_batches(df, schema, one)


def units_of(sets: DataFrame, id: str) -> DataFrame:
    """(unit, _unit, _letters, _words, copies): one row a unit, `unit` its smallest id.

    Copies are combined map-side before the shuffle: a unit that holds a third of all rows sends
    one row from each task.
    """
    return (sets.groupBy("_unit").agg(F.min(id).alias("unit"), F.first("_letters").alias("_letters"), F.first("_words").alias("_words"),
                                      F.count("*").alias("copies")))


def word_order(units: DataFrame) -> tuple[np.ndarray, int]:
    """(hashes of the frequent words by rising frequency, units that have the most frequent word at most).

    A word is frequent if its count is at least 1/LISTED of all words, so at most LISTED words
    reach the driver however large the corpus is.
    """
    counts = units.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = units.agg(F.sum(F.size("_words"))).first()[0] or 0
    least = max(2, -(-total // LISTED))
    found = counts.filter(F.col("n") >= least).orderBy("n", "word").toPandas()
    return found["word"].to_numpy(np.int64), max(least, int(found["n"].max() if len(found) else 0))


#: Which pairs count beside all: those with a query, or those of a query and a stored text only.
AMONG, STORED = 1, 2

_ENTRY = {"node": T.LongType(), "unit": T.LongType(), "side": T.ByteType(), "size": T.IntegerType(), "skip": T.IntegerType(),
          "s1": T.LongType(), "s2": T.LongType(), "window": T.BinaryType()}
ENTRIES = T.StructType([T.StructField(k, v) for k, v in _ENTRY.items()])


def entries(units: DataFrame, order: np.ndarray) -> DataFrame:
    """Entries of `units` (unit, side, _words) in the nodes below the root.

    (node, unit, side, size, skip, s1, s2, window): `skip` words come before the node's word,
    `window` has 16 bits of each word after it as far as deeper nodes may need them, (s1, s2) is
    the sketch: the parity of the number of words in each of 128 classes.  The lowest bit of `side`
    marks queries, the others the half of a block pair that an entry belongs to (0: none).
    """
    spark = units.sparkSession
    at = np.argsort(order, kind="stable")
    shared = spark.sparkContext.broadcast((order[at], at.astype(np.int64)))  # at most LISTED words

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        listed, ranks = shared.value
        words = b.column(2)
        n = len(words)
        offsets = np.asarray(words.offsets, dtype=np.int64)
        w = np.asarray(words.values)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        row = np.repeat(np.arange(n), sizes)
        k = np.searchsorted(listed, w)
        hit = k < len(listed)
        hit[hit] = listed[k[hit]] == w[hit]
        rank = np.where(hit, ranks[np.minimum(k, max(len(listed) - 1, 0))] if len(listed) else 0, -1)
        o = np.lexsort((w, rank, row))
        w = w[o]
        pos = np.arange(len(w)) - offsets[row]
        bit = (_mix(w.view(np.uint64) ^ np.uint64(0x5bd1e995)) >> np.uint64(57)).astype(np.int64)
        sketch = np.zeros((n, 128), np.int64)
        np.add.at(sketch, (row, bit), 1)
        packed = np.packbits((sketch & 1).astype(np.uint8), axis=1).reshape(n, 2, 8).view(np.int64).reshape(n, 2) if n else np.zeros((0, 2), np.int64)
        bound = most_skipped(sizes)
        keep = np.flatnonzero(pos <= bound[row])
        short = (_mix(w.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
        r = row[keep]
        ends = np.minimum(offsets[r] + bound[r] + DEPTH, offsets[r + 1])
        lengths = 2 * (ends - keep - 1)
        idx = _ranges(keep + 1, ends - keep - 1)
        window = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)),
                                                               pa.py_buffer(short[idx].tobytes())])
        take = pa.array(r)
        return pa.RecordBatch.from_arrays([
            pa.array(w[keep]), b.column(0).take(take), b.column(1).take(take), pa.array(sizes[r].astype(np.int32)),
            pa.array(pos[keep].astype(np.int32)), pa.array(packed[r, 0]), pa.array(packed[r, 1]), window], names=ENTRIES.names)

    return map_batches(units.select(F.col("unit").cast("long"), F.col("side").cast("byte").alias("side"), "_words"), ENTRIES, one)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def _depths(size: np.ndarray, skip: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Depth of the nodes that entries are in, from the lengths of their windows.

    A window always ends with the last word that a node of depth DEPTH may need, so what is left
    of it tells the place of the node's word: the words passed over and the path lie before.
    """
    size = size.astype(np.int64)
    return np.minimum(most_skipped(size) + DEPTH, size) - lengths - skip


def opened(at: DataFrame) -> DataFrame:
    """Entries of `at` moved one word down."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        node, size, skip = (np.asarray(b.column(i)) for i in (0, 3, 4))
        window = b.column(7).cast(pa.large_binary())
        off = np.frombuffer(window.buffers()[1], np.int64)[window.offset:window.offset + len(window) + 1] // 2
        values = np.frombuffer(window.buffers()[2] or b"", np.uint16)
        e, j, key, skips = _children(node, size, skip, np.full(len(node), -1), off, values)
        lengths = off[e + 1] - off[e] - j - 1
        data = values[_ranges(off[e] + j + 1, lengths)]
        take = pa.array(e)
        return pa.RecordBatch.from_arrays([
            pa.array(key), *(b.column(i).take(take) for i in (1, 2, 3)), pa.array(skips.astype(np.int32)),
            *(b.column(i).take(take) for i in (5, 6)),
            pa.Array.from_buffers(pa.binary(), len(e), [None, pa.py_buffer(np.concatenate(([0], 2 * np.cumsum(lengths))).astype(np.int32)),
                                                        pa.py_buffer(data.tobytes())])], names=ENTRIES.names)

    return map_batches(at, ENTRIES, one)


def _children(node, size, skip, cur, off, values):
    """Children of entries: (index of the entry, place in its window, node, skip)."""
    lengths = off[1:] - off[:-1] - cur - 1
    room = most_skipped(size.astype(np.int64)) - skip + 1  # words that may be passed over, and one taken
    lengths = np.maximum(np.minimum(lengths, room), 0)
    e = np.repeat(np.arange(len(node)), lengths)
    j = _ranges(cur + 1, lengths)
    key = _mix(node[e].view(np.uint64) * np.uint64(31) + values[off[e] + j].astype(np.uint64) + np.uint64(1)).view(np.int64)
    return e, j, key, skip[e].astype(np.int64) + (j - cur[e] - 1)


def _alive(start, stop, order, size, skip, side, cross):
    """Entries (places in `order`) that some pair of their node may still need."""
    n = stop - start
    group = np.repeat(np.arange(len(start)), n)
    idx = order[_ranges(start, n)]
    b, s = size[idx].astype(np.int64), skip[idx].astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    least, gmin = np.minimum.reduceat(b, first)[group], np.minimum.reduceat(s, first)[group]
    largest = (DEN + NUM) * (b - s) // NUM - b  # the partner's size at most
    smallest = np.maximum(least, -(-((NUM + DEN) * gmin + NUM * b) // DEN))  # and at least
    ok = smallest <= largest
    if cross:
        ok &= np.maximum.reduceat(side[idx] & 1, first)[group] > 0
    return idx[ok]


def _reachable(key, size, skip, asked, cross) -> np.ndarray:
    """Places of the entries that may pair with one in their node (`key`): stored ones with a query, with STORED queries with a stored one.

    Two entries can reach their overlap only if each one's u is at least the other's v (see `_pairs`), so
    the smallest v and the largest u of a slot tell; skips only grow in deeper nodes.
    """
    slot, v = key & (SLOTS - 1), NUM * size
    u = DEN * size - (NUM + DEN) * skip

    def reached(some, by) -> np.ndarray:
        least, most = np.full(SLOTS, np.iinfo(np.int64).max), np.full(SLOTS, -1)
        np.minimum.at(least, slot[by], v[by])
        np.maximum.at(most, slot[by], u[by])
        at = slot[some]
        return some[(u[some] >= least[at]) & (v[some] <= most[at])]

    queries, stored = np.flatnonzero(asked), np.flatnonzero(~asked)
    stored = reached(stored, queries)
    return np.concatenate((reached(queries, stored) if cross == STORED else queries, stored))


def _in_reach(start, n, order, size, skip, side) -> tuple[np.ndarray, np.ndarray]:
    """Entries of nodes (ranges of `order`) that are queries or can pair with one of their node (see `_reachable`), and their number in each node."""
    idx = order[_ranges(start, n)]
    first, group = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    asked, v = side[idx] & 1 > 0, NUM * size[idx].astype(np.int64)
    u = DEN * size[idx].astype(np.int64) - (NUM + DEN) * skip[idx]
    least = np.minimum.reduceat(np.where(asked, v, np.iinfo(np.int64).max), first)[group]
    most = np.maximum.reduceat(np.where(asked, u, -1), first)[group]
    keep = asked | (u >= least) & (v <= most)
    return idx[keep], np.bincount(group[keep], minlength=len(n))


def _pairs(start, n, order, unit, side, size, skip, s1, s2, cross) -> Iterator[np.ndarray]:
    """Pairs of entries of nodes (ranges of `order`) that the sieves let through.

    With v = 3 size and u = 5 size - 8 skip, two entries can reach their overlap if and only if
    each one's u is at least the other's v.  Sorted by v within its node, an entry's partners
    are a range.
    """
    idx = order[_ranges(start, n)]
    big = NUM * int(size.max()) + 2
    node = np.repeat(np.arange(len(n)), n)
    least = np.minimum.reduceat(skip[idx], np.cumsum(n) - n)  # words that all of a node's entries pass over
    v = NUM * size[idx].astype(np.int64)
    o = np.argsort(node * big + v, kind="stable")
    idx, v = idx[o], v[o]  # `node` stays: the sort is by node first
    u = DEN * size[idx].astype(np.int64) - (NUM + DEN) * skip[idx]
    sides = side[idx]
    left = np.flatnonzero(sides & 1) if cross else np.arange(len(idx))
    right = np.flatnonzero(sides & 1 == 0) if cross == STORED else np.arange(len(idx))
    places = node[right] * big + v[right]
    until = np.searchsorted(places, node[left] * big + np.minimum(u[left], big - 1), "right")
    if cross:  # queries also look at smaller entries, as far down as those that pass over fewest words can reach
        begin = -(-NUM * (v[left] + (NUM + DEN) * least[node[left]]) // DEN)
        begin = np.searchsorted(places, node[left] * big + np.minimum(begin, big - 1), "left")
    else:
        begin = left + 1
    rest = np.maximum(until - begin, 0)
    mine, theirs = idx[left], idx[right]
    v, u = v[left].astype(np.int32), u[right].astype(np.int32)
    a, b = size[mine].astype(np.int32), size[theirs].astype(np.int32)
    total = np.arange(2 * (big // NUM) + 1)
    far = (total - 2 * overlap_needed(total, 0)).astype(np.int32)  # sketches of similar sets differ in so many bits at most
    p1, p2, q1, q2 = (x.view(np.uint64) for x in (s1[mine], s2[mine], s1[theirs], s2[theirs]))
    ends = np.cumsum(rest)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
        j = _ranges(begin[lo:hi], rest[lo:hi])
        i = np.repeat(np.arange(lo, hi), rest[lo:hi])
        ok = np.flatnonzero(u[j] >= v[i])
        i, j = i[ok], j[ok]
        lo = hi
        ok = np.flatnonzero(np.bitwise_count(p1[i] ^ q1[j]) + np.bitwise_count(p2[i] ^ q2[j]) <= far[a[i] + b[j]])
        i, j = i[ok], j[ok]
        if cross == AMONG:  # two queries meet once
            ok = (sides[right[j]] & 1 == 0) | (right[j] > left[i])
            i, j = i[ok], j[ok]
        i, j = mine[i], theirs[j]
        ok = (unit[i] != unit[j]) & ((side[i] < 2) | (side[i] >> 1 != side[j] >> 1))
        i, j = unit[i[ok]], unit[j[ok]]
        yield np.stack((np.minimum(i, j), np.maximum(i, j)))


def tree_pairs(node, unit, side, size, skip, s1, s2, off, values, cross=0) -> Iterator[np.ndarray]:
    """Candidate pairs of one task's entries; the tree below them is opened as far as it pays.

    Entries may come from any depth; nodes at DEPTH are compared whole, since windows reach no further.
    `cross` says which pairs count: 0 all, AMONG those with a query, STORED those of a query and another text.
    """
    depths = _depths(size, skip, np.diff(off))
    stack = []
    for d in np.unique(depths):
        e = np.flatnonzero(depths == d)
        stack.append((node[e], e, skip[e].astype(np.int64), np.full(len(e), -1), int(d)))
    while stack:
        key, entry, skips, cur, depth = stack.pop()
        order = np.argsort(key, kind="stable")
        ks = key[order]
        start = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1]))) if len(ks) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate((start, [len(ks)])))
        heavy = (n > LIGHT) & (depth < DEPTH)
        light = ~heavy & (n > 1)
        if cross and len(n):  # nodes without a query have no pairs, those of few are compared sooner than opened
            asked = np.add.reduceat((side[entry[order]] & 1).astype(np.int64), start)
            light = (light | (asked <= FEW)) & (asked > 0) & (n > 1)
            heavy &= asked > FEW
            if cross == STORED and heavy.any():  # opened where that makes fewer entries than there are pairs to sift
                room = np.maximum(np.minimum(off[entry + 1] - off[entry] - cur - 1, most_skipped(size[entry].astype(np.int64)) - skips + 1), 0)
                sooner = heavy & (asked * (n - asked) <= PAIRS_A_CHILD * np.add.reduceat(room[order], start))
                heavy &= ~sooner
                if sooner.any():
                    at, count = _in_reach(start[sooner], n[sooner], order, size[entry], skips, side[entry])
                    yield from _pairs(np.cumsum(count) - count, count, at, unit[entry], side[entry], size[entry], skips, s1[entry], s2[entry], cross)
        if light.any():
            yield from _pairs(start[light], n[light], order, unit[entry], side[entry], size[entry], skips, s1[entry], s2[entry], cross)
        begin, count = start[heavy], n[heavy]
        at = 0
        while at < len(begin):  # so many nodes at a time that their children fit
            to = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), CHUNK // 16, "right")) + at)
            idx = _alive(begin[at:to], begin[at:to] + count[at:to], order, size[entry], skips, side[entry], cross)
            at = to
            if not len(idx):
                continue
            en = entry[idx]
            offs = np.concatenate(([0], np.cumsum(off[en + 1] - off[en])))
            vals = values[_ranges(off[en], off[en + 1] - off[en])]
            e, j, k, sk = _children(key[idx], size[en], skips[idx], cur[idx], offs, vals)
            if cross:  # only children that a query in the same place can reach, but for collisions
                keep = _reachable(k, size[en][e].astype(np.int64), sk, (side[en] & 1 > 0)[e], cross)
                e, j, k, sk = e[keep], j[keep], k[keep], sk[keep]
            stack.append((k, en[e], sk, j, depth + 1))


def _blocks(at: DataFrame, cross: bool) -> DataFrame:
    """Entries of nodes (with `n` texts, `q` of them queries) once for each pair of blocks they take part in."""
    other = ~F.col("side").cast("boolean") if cross else F.lit(False)
    mine, theirs = F.greatest(F.ceil(F.col("q") / BLOCK_TEXTS), F.lit(1)), F.greatest(F.ceil((F.col("n") - F.col("q")) / BLOCK_TEXTS), F.lit(1))
    own = F.pmod(F.xxhash64("unit"), F.when(other, theirs).otherwise(mine))

    def place(kind: int, a, b, half) -> F.Column:
        return F.struct(F.xxhash64("node", F.lit(kind), a, b).alias("node"), (F.col("side") + F.lit(2) * half).cast("byte").alias("side"))

    def among(x) -> F.Column:  # two blocks of one kind
        return place(0, F.least(own, x), F.greatest(own, x), F.when(own == x, 0).when(own < x, 1).otherwise(2))

    places = F.transform(F.sequence(F.lit(0).cast("long"), mine - 1), among)
    if cross:
        places = F.when(other, F.transform(F.sequence(F.lit(0).cast("long"), mine - 1), lambda x: place(1, own, x, F.lit(1)))).otherwise(
            F.concat(places, F.transform(F.sequence(F.lit(0).cast("long"), theirs - 1), lambda x: place(1, x, own, F.lit(2)))))
    rest = [c for c in ENTRIES.names if c not in ("node", "side")]
    return at.select(F.explode(places).alias("_p"), *rest).select("_p.node", "unit", "_p.side", *rest[1:])


def candidates(at: DataFrame, cross: bool = False, most: int | None = None, size: int | None = None) -> DataFrame:
    """(a, b), a < b: pairs of units that meet in the tree and pass the sieves, each once.

    With `cross`, pairs of two stored texts (even `side`) are left out.  Nodes of more than NODE_MAX texts
    are opened before the shuffle, until none is left or the window is used up; those still as
    large then are cut into blocks, and each two blocks meet in a task.  `most` is a known bound of
    a node's texts: no larger nodes are looked for if it is at most NODE_MAX.  `size`, the number of
    entries where it is known, spares tasks for few of them.
    """
    spark = at.sparkSession
    done, kept = None, []
    for level in range(DEPTH if most is None or most > NODE_MAX else 0):
        counts = written(at.groupBy("node").agg(F.count("*").alias("n"), F.sum((F.col("side") % 2) if cross else F.lit(1)).alias("q"))
                         .filter(F.col("n") > NODE_MAX), "hot-nodes")
        kept.append(counts)
        found = counts.limit(HOT_NODES + 1).count()
        if not found:
            break
        at = written(at, "entries")
        kept.append(at)
        marked = (at.join(F.broadcast(counts), "node", "left") if found <= HOT_NODES else
                  spread_join(at, counts.withColumn("_n", F.col("n")), "node", "_n", "left"))
        part = marked.filter("n is null").select(*ENTRIES.names)
        done = part if done is None else done.union(part)
        hot = marked.filter("q > 0")  # without a query a node has no pairs
        at = opened(hot.select(*ENTRIES.names)) if level < DEPTH - 1 else _blocks(hot, cross)
    at = at if done is None else done.union(at)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _concat(batches)
        if table is not None:
            yield from _met(_columns(table), AMONG if cross else 0)

    parts = default_partitions(spark, 4)
    if size is not None:
        parts = max(1, min(parts, size // ENTRIES_A_TASK))
    pairs = written(at.repartition(parts, "node").mapInArrow(run, PAIRS).distinct(), "pairs")
    release(*kept)
    return pairs


def probed(stored: DataFrame, queries: DataFrame) -> DataFrame:
    """(a, b), a < b: like `candidates`, pairs of a query and a stored text only.

    `queries` (entries of odd side) are taken to be few and sent to every task; `stored` is read
    where it lies, in chunks, without a shuffle.  A node may be in any number of chunks.
    """
    shared = stored.sparkSession.sparkContext.broadcast(_packed(queries.select(*ENTRIES.names).toArrow()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for table in _chunks(batches, CHUNK // 8):
            if asked is None:
                asked = pa.ipc.open_stream(shared.value).read_all()
                nodes = asked.column(0).to_numpy()
            mine = np.flatnonzero(np.isin(nodes, table.column(0).to_numpy()))
            if len(mine):
                yield from _met(_columns(pa.concat_tables([table, asked.take(pa.array(mine))])), STORED)

    return written(stored.select(*ENTRIES.names).mapInArrow(run, PAIRS).distinct(), "pairs")


PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Columns of entries as arrays, windows as offsets and values."""
    windows = table.column(7).cast(pa.large_binary()).combine_chunks()
    windows = windows.chunk(0) if isinstance(windows, pa.ChunkedArray) else windows
    off = np.frombuffer(windows.buffers()[1], np.int64)[windows.offset:windows.offset + len(windows) + 1] // 2
    return *(table.column(i).to_numpy() for i in range(7)), off, np.frombuffer(windows.buffers()[2] or b"", np.uint16)


def _met(columns: tuple[np.ndarray, ...], cross: int) -> Iterator[pa.RecordBatch]:
    """Pairs of a task's entries, each once."""
    found, parts, size = np.zeros((2, 0), np.int64), [], 0
    for p in tree_pairs(*columns, cross):
        parts.append(p)
        size += p.shape[1]
        if size > CHUNK:
            found, parts, size = _distinct(np.concatenate([found, *parts], 1)), [], 0
    found = _distinct(np.concatenate([found, *parts], 1))
    for lo in range(0, found.shape[1], 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[0, lo:lo + 100_000]), pa.array(found[1, lo:lo + 100_000])], names=["a", "b"])


def _chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about so many rows."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _concat(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def _distinct(pairs: np.ndarray) -> np.ndarray:
    o = np.lexsort(pairs)
    p = pairs[:, o]
    keep = np.ones(p.shape[1], bool)
    keep[1:] = (p[:, 1:] != p[:, :-1]).any(0)
    return p[:, keep]


def checked(pairs: DataFrame, units: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """(a, b) of the pairs whose words are similar and whose letters differ, by the sets themselves.

    `left` has the units that a is among, where that is known to be fewer than all.
    """
    u, v = (x.select("unit", "_words", "_letters") for x in (units if left is None else left, units))
    both = (pairs.join(u.toDF("a", "_wa", "_la"), "a").join(v.toDF("b", "_wb", "_lb"), "b"))
    shared = F.size(F.array_intersect("_wa", "_wb"))
    return both.filter((F.col("_la") != F.col("_lb")) & (shared * (NUM + DEN) >= NUM * (F.size("_wa") + F.size("_wb")))).select("a", "b")


def near_units(df: DataFrame, id: str = "anecdote_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members) of a table's near-duplicates.

    `links` has (a, b): units whose texts are near and whose letters differ; `members` has
    (unit, id, copies) for each row of enough words.  Every link between different texts is there; copies are
    not expanded.  Ids must be unique and not null.
    """
    sets = written(word_sets(df, id, text), "sets")
    units = written(units_of(sets, id), "units")
    members = written(spread_join(sets.select(id, "_unit"), units.select("_unit", "unit", "copies", F.col("copies").alias("_n")), "_unit", "_n")
                      .select("unit", id, "copies"), "members")
    release(sets)
    order, most = word_order(units)
    pairs = candidates(entries(units.withColumn("side", F.lit(0)), order), most=most)
    links = written(checked(pairs, units), "links")
    release(pairs, units)
    return links, members


def near_pairs(df: DataFrame, id: str = "anecdote_id", text: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts are near and whose letters differ (problem 5).

    Two texts are near if each has at least MIN_WORDS distinct words and the words in both are
    at least 3/5 of the words in either.  Null, short and garbled texts are in no pair.
    """
    return expanded(*near_units(df, id, text), id)


def expanded(links: DataFrame, members: DataFrame, id: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the rows of linked units.  Both sides are spread, so a unit may hold any part of the rows."""
    rows = members.select(F.col("unit").alias("a"), F.col(id).alias("_ia"))
    sizes = members.groupBy("unit").agg(F.max("copies").alias("_n"))
    left = spread_join(rows, written(links.join(sizes.toDF("a", "_n"), "a"), "sized"), "a", "_n")
    left = written(left.join(sizes.toDF("b", "_n"), "b"), "left")
    both = spread_join(members.select(F.col("unit").alias("b"), F.col(id).alias("_ib")), left, "b", "_n")
    return both.select(F.least("_ia", "_ib").alias("id_a"), F.greatest("_ia", "_ib").alias("id_b"))
