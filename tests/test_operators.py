import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quellwerk.config import Config
from quellwerk.operators import crawl, dedup, extract, keys, media, sink
from quellwerk.sources import pages as src
from quellwerk.streaming.posts import PostStream

PAGE = """<div class="tags-cloud"><a href="/tags/a">A</a><a href="/tags/a/">again</a><a href="mailto:x@y">m</a><a>no</a><a href="/other/x">o</a><a href="/tags/%D0%B1/2">b</a></div>
<div class="topicbox" data-id=" 5 "><div class="text">first&nbsp; post<br> of all time</div><div class="text">second text</div></div>
<div class="ad"><div class="topicbox" data-id="6"><div class="text">an advertisement, long enough</div></div></div>
<div class="topicbox" data-id="7"><div class="text">with a picture <img src=x> inside it</div></div>
<div class="topicbox" data-id="8"><div class="text">14 units only!</div></div>
<div class="topicbox"><div class="text">15 units exactly</div></div>
<div class="topicbox" data-id="5"><div class="text">the same id once more</div></div><div class="topicbox" data-id="9"></div>
<div class="pageslist"><a href="?p=0">назад</a><a href="/tags/a/2"> След. →</a></div>"""


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame([("https://h.example/tags/a", PAGE, "x"), ("https://h.example/tags/e", None, "x"), ("https://h.example/tags/l", '<p class="pageslist"><a href="#">след</a></p>', "x")],
                                 "url string, html string, text string")


def test_tags(listing):
    rows = extract.tags_of(listing, Config()).orderBy("tag_ord").collect()
    assert [(r.tag_url, r.name) for r in rows] == [("https://h.example/tags/a", "a"), ("https://h.example/tags/%D0%B1/2", "б")]


def test_posts(listing):
    rows = extract.posts_of(listing, Config()).orderBy("box_ord").collect()
    assert [(r.id, r.text, r.post_url) for r in rows] == [("5", "first post\nof all time", "https://h.example/id/5/"), ("", "15 units exactly", "")]


def test_next(listing):
    rows = {r.url[-1]: r.next_url for r in extract.next_pages(listing, Config()).collect()}
    assert rows == {"a": "https://h.example/tags/a/2", "e": None, "l": None}
    rows = {r.url[-1]: r.next_url for r in extract.next_pages(listing, Config(next_text="", url_pattern="/tags/a{n}")).collect()}
    assert rows == {"a": "https://h.example/tags/a?p=0", "e": None, "l": None}


def test_images(spark):
    body = ('<body><a href="/i/a-300x200.jpg">x</a><a href="/page">y</a><img src="/i/a.jpg" data-src="/i/b.png" srcset="/s/1.jpg 1x, /s/2.jpg 2x"><img src="/thumb/c.jpg">'
            '<img srcset="/w/1.jpg 100w, /w/2.jpg 300w, /w/3.jpg 200w"><video src="/v.mp4"><source src="/v2.webm"></video></body>')
    df = spark.createDataFrame([("https://h.example/p", '<meta property="og:image" content="/og.gif">' + body)], "url string, html string")
    sizes = spark.createDataFrame([("https://h.example/i/b.png", 10, 900), ("https://h.example/og.gif", 500, 500)], "image_url string, width int, height int")
    rows = sorted((r.image_url[17:], r.width) for r in extract.images_of(df, Config(), sizes=sizes).collect())
    assert rows == [("/i/a.jpg", 0), ("/og.gif", 500), ("/s/2.jpg", 0), ("/v.mp4", 0), ("/v2.webm", 0), ("/w/2.jpg", 0)]


def fold(posts, known, stored):
    """Sequential loop that the set form of layered dedup stands for."""
    known, stored, out = set(known), set(stored), []
    for i, key, text in posts:
        if key in known:
            continue
        known.add(key)
        h = " ".join(text.split())
        if h and h not in stored:
            stored.add(h)
            out.append(i)
    return out


def test_layered_dedup_is_the_loop(spark):
    r = random.Random(3)
    posts = [(i, str(r.randrange(12)), r.choice(["a b", " a  b", "c", "d", "", " "]) + str(r.randrange(4))) for i in range(120)]
    df = spark.createDataFrame(posts, "i int, id string, text string")
    known = spark.createDataFrame([("anek:id:3",), ("anek:id:4",)], "key string")
    from quellwerk.functions.text import content_hash

    stored = spark.createDataFrame([("c 1".replace(" ", ""),)], "t string").select(content_hash(F.col("t")).alias("hash"))
    got = sorted(x.i for x in dedup.layered_dedup(df, known, stored, ["i"]).collect())
    assert got == fold([(i, "anek:id:" + k, t) for i, k, t in posts], {"anek:id:3", "anek:id:4"}, {"c1"})


def test_first_wins_keeps_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (0, "k", None), (2, "k", "z")], "o int, k string, v string")
    rows = dedup.first_wins(df, ["k"], ["o"]).collect()
    assert len(rows) == 2 and any(r.k == "k" and r.o == 0 and r.v is None for r in rows)
    assert dedup.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def stop(pages, n):
    out, run = [], 0
    for total, new in pages:
        out.append((total, new))
        if total and not new:
            run += 1
            if run >= max(n, 1):
                break
        elif new:
            run = 0
    return out


def test_until_known_is_the_loop(spark):
    cases = [[(5, 0), (0, 0), (5, 0), (5, 3)], *([(5 * a, a * b) for a, b in c] for c in itertools.product([(0, 0), (1, 0), (1, 2)], repeat=4))]
    rows = [(t, p, total, new) for t, case in enumerate(cases) for p, (total, new) in enumerate(case)]
    df = spark.createDataFrame(rows, "tag int, page int, total_posts long, new_posts long")
    for n in (0, 1, 2):
        got = {}
        for r in crawl.until_known(df, "tag", "page", n).orderBy("tag", "page").collect():
            got.setdefault(r.tag, []).append((r.total_posts, r.new_posts))
        assert got == {t: stop(c, n) for t, c in enumerate(cases)}
    assert crawl.until_known(df, "tag", "page", 1, F.lit(False)).count() == len(rows)


def test_outcome(spark):
    rows = spark.createDataFrame([(200, 3, "n"), (200, 0, "n"), (200, 3, None), (404, 0, None), (403, 0, None), (429, 0, None), (500, 0, None), (None, 0, None)], "s int, t int, n string")
    got = [tuple(r[0]) for r in rows.select(crawl.page_outcome(F.col("s"), F.col("t"), F.col("n"))).collect()]
    assert got == [("n", False), (None, True), (None, True), (None, True), (None, True), (None, False), (None, False), (None, False)]


def test_chains(spark):
    e = [(f"https://h.example/{i}", f"https://h.example/{i + 1}") for i in range(40)] + [("https://h.example/40", "https://h.example/38/"), ("https://h.example/z", None)]
    edges = spark.createDataFrame([(u, u, n) for u, n in e], "key string, url string, next_url string")
    starts = spark.createDataFrame([("a", "https://h.example/0#x"), ("z", "https://h.example/z"), ("none", "https://h.example/no")], "tag string, url string")
    rows = crawl.page_chains(starts, edges).orderBy("tag", "page_no").collect()
    assert [r.page_no for r in rows if r.tag == "a"] == list(range(1, 42)) and [r.tag for r in rows if r.is_loop] == ["a"] and rows[-1].tag == "z"
    assert crawl.page_chains(starts, edges, max_pages=3).filter("tag = 'a'").count() == 3


def test_crawl_resumes_and_stops():
    web = {f"https://h.example/t?p={i}": ([{"id": str(10 * i + j)} for j in range(3)], f"https://h.example/t?p={i + 1}" if i < 5 else None) for i in range(6)}

    def go(known, complete, **kw):
        got = []
        crawl.crawl(Config(**kw), [("https://h.example/t?p=0", "t")], lambda u: (200, u), lambda html, u: web[u], known, complete, lambda p: p["id"], lambda n, u, b: got.append((u, len(b))))
        return got

    known, complete = set(), set()
    assert len(go(known, complete, max_pages=3)) == 3 and not complete
    assert len(go(known, complete, mode="full")) == 3 and complete and len(known) == 18
    assert go(known, complete) == []
    assert len(go(set(), set(), dry_run=True)) == 6
    fresh = set()
    go(fresh, set(), dry_run=True)
    assert fresh == set()


def test_rotation(spark, tmp_path):
    for active, sizes in ((0, [300, 200, 1, 600]), (0, [600]), (499, [1, 0, 1, 700, 0, 1]), (0, [7] * 400), (0, [])):
        df = spark.createDataFrame([(i, k) for i, k in enumerate(sizes)], "o int, size int")
        got = [r.file_no for r in sink.rotated(df, ["o"], "size", active=active).orderBy("o").collect()]
        out, n, f = [], active, 0
        for k in sizes:
            if n and n + k > 500:
                f, n = f + 1, 0
            n += k
            out.append(f)
        assert got == out
    folder = sink.AnecdoteFiles(tmp_path, 5)
    for batch in ([1, 2, 3], [4, 5], [6], [7] * 7):
        folder.append([{"text": str(x), "addedAt": "2024-01-02T03:04:05Z", "tags": ["t"]} for x in batch])
    counts = {f.name: len(json.loads(f.read_text())["anecdotes"]) for f in tmp_path.glob("*.json")}
    assert counts == {"anecdotes_1.json": 5, "anecdotes_2.json": 1, "anecdotes.json": 7}
    (tmp_path / "anecdotes_3.json").write_text("{broken")
    rows = sink.read_anecdotes(spark, str(tmp_path))
    assert rows.count() == 13 and sink.next_index(rows).first()[0] == 3
    loaded = sink.stored(rows.withColumn("o", sink.file_order(F.col("file_name"))), ["o", "pos"])
    assert loaded.count() == 7


def test_corrupt_state_is_set_aside(spark, tmp_path):
    f = tmp_path / "visited.json"
    f.write_text("{")
    assert sink.read_visited(spark, str(f)).count() == 0 and (tmp_path / "visited.json.corrupt").exists()
    sink.write_json(f, {"https://h.example/": {"processedAt": "2024-01-01T00:00:00Z", "next": None, "tag": "t"}})
    assert sink.read_visited(spark, str(f)).first().tag == "t"


def test_charset(spark):
    text = "Привет, мир"
    rows = [(text.encode("cp1251"), "text/html; charset=Windows-1251"), (('<meta charset="koi8-r">' + text).encode("koi8-r"), None), (text.encode(), "text/html; charset=nonsense"),
            (b"\xef\xbb\xbf" + text.encode(), "text/html"), (None, None), (b"", "")]
    df = spark.createDataFrame(rows, "content binary, content_type string")
    got = [r[0] for r in df.select(src.decoded(F.col("content"), F.col("content_type"))).collect()]
    assert got == [text, '<meta charset="koi8-r">' + text, text, text, None, ""]


def test_fetch(spark):
    def get(url, config):
        if "404" in url:
            raise src.FetchError("gone", 404)
        return 200, b"<p>", "text/html"

    rows = {r.url: (r.content, r.status) for r in src.fetch(spark, ["http://a.example/1", "http://b.example/404"], Config(delay_ms=0, retries=0), get).collect()}
    assert rows == {"http://a.example/1": (b"<p>", 200), "http://b.example/404": (None, 404)}


def test_retry():
    waits, seen = [], []

    def call():
        raise src.FetchError("later", 503)

    with pytest.raises(src.FetchError):
        src.with_retry(call, 2, 100, lambda e, n, again: seen.append((n, again)), waits.append, lambda: 0)
    assert seen == [(1, True), (2, True), (3, False)] and waits == [0.1, 0.2]
    now = [0.0]
    limit = src.RateLimit(1000, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    limit.wait(), limit.wait()
    assert now[0] == 1.0


def test_unique_filenames(spark):
    wanted = spark.createDataFrame([(1, "i.jpg"), (2, "i.jpg"), (3, "i_2.jpg"), (4, "j"), (5, "j"), (6, "i.png")], "o int, name string")
    used = spark.createDataFrame([("i.jpg",), ("i_2.jpg",)], "name string")
    got = [r.unique_name for r in media.unique_filenames(wanted, used, ["o"]).orderBy("o").collect()]
    assert got == ["i_3.jpg", "i_4.jpg", "i_2_2.jpg", "j", "j_2", "i.png"]


def test_filename(spark):
    df = spark.createDataFrame([("https://h.example/x/image_3.jpg", 'A: "b"  c. ', 9), ("https://h.example/x/a.php", "t", None), ("https://h.example/b", None, 1), ("https://h.example/c.webp", "", 1)], "u string, t string, o int")
    got = [r[0] for r in df.select(media.filename(Config(), F.col("u"), F.col("t"), F.col("o"))).collect()]
    assert got == ["A- -b- c_3.jpg", "t_0.jpg", "b.jpg", "c.webp"]
    types = spark.createDataFrame([("image/PNG; q=1",), ("text/html",), (None,)], "c string")
    assert [r[0] for r in types.select(media.extension_of_type(F.col("c"))).collect()] == ["png", "", ""]


def test_stream(spark, tmp_path):
    schema = "i int, id string, text string"
    for n, rows in enumerate([[(1, "a", "x"), (2, "a", "y")], [(3, "b", "x "), (4, "c", "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        sink_ = PostStream(spark, str(tmp_path / "out"), ["i"])
        sink_.run(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.i for r in sink_.posts().collect()) == [1, 4] and sorted(r.key for r in sink_.keys().collect()) == ["anek:id:a", "anek:id:b", "anek:id:c"]


def test_streamed_table_is_file_or_folder(spark, tmp_path):
    from quellwerk.plans.pages import streamed_posts

    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x "), (4, "c", "z")], "in_id long, id string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder/incoming_posts.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file/incoming_posts.parquet")
    for d in ("folder", "file"):
        assert sorted(r.in_id for r in streamed_posts(spark, str(tmp_path / d)).collect()) == [1, 4], d


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(keys, "HOT_ROWS", 50)
    rows = spark.range(400).withColumn("k", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 10))
    got = {r.id: (r.rep, r.members) for r in keys.smallest_of_key(rows, "k", "id").collect()}
    assert len(got) == 400 and got[299] == (0, 310) and got[301] == (301, 10)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(7, None), (3, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x.node: x.root for x in keys.components(df).collect()}
    assert got == {n: find(n) for n in parent if find(n) != n}
    assert keys.components(df.limit(0)).count() == 0
