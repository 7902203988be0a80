import hashlib
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quellwerk import config
from quellwerk.functions import html, text, urls


@pytest.mark.parametrize("url,expected", [
    ("http://A.example:80/x/../y/#f", "http://a.example/y"), ("http://a.example/x/?b=2&a=1&a=0", "http://a.example/x/?a=1&a=0&b=2"),
    ("http://a.example/x?q=a%20b~", "http://a.example/x?q=a+b%7E"), ("not a url", "not a url"), ("https://h.example/?a", "https://h.example/?a="),
    ("https://h.example/x?", "https://h.example/x"), ("https://h.example/x//", "https://h.example/x/"), ("//h.example/x/", "//h.example/x/"), (None, None), ("", "")])
def test_normalize(url, expected):
    assert urls.normalize_url(url) == expected


@pytest.mark.parametrize("href,base,expected", [
    ("mailto:a@b", "https://h.example/", None), ("?page=2", "https://h.example/d/x?q", "https://h.example/d/x?page=2"), ("../a b", "https://h.example/x/y/z", "https://h.example/x/a%20b"),
    ("//O.example:443/é", "https://h.example/", "https://o.example/%C3%A9"), ("#t", "https://h.example/a?b#c", "https://h.example/a?b#t"), ("", "https://h.example/a?b#c", "https://h.example/a?b"),
    ("\\x\\y", "https://h.example/a/b", "https://h.example/x/y"), ("/x", None, None), ("https:///h.example", None, "https://h.example/"), ("http://h example/", None, None),
    ("http://h.example:99999/", None, None), ("http://0x7f.1/", None, "http://127.0.0.1/"), ("https://пример.example/", None, "https://xn--e1afmkfd.example/"), (None, "https://h.example/", None)])
def test_resolve(href, base, expected):
    assert urls.resolve_url(href, base) == expected


@given(st.sampled_from(["http", "https"]), st.text("abcZ.-%?&=#/~+ é", max_size=20))
def test_normalize_is_idempotent(scheme, rest):
    once = urls.normalize_url(f"{scheme}://h.example/{rest}")
    if not once.endswith("/"):
        assert urls.normalize_url(once) == once


@pytest.mark.parametrize("url,name", [("https://h.example/tags/%D0%B0/3", "а"), ("https://h.example/tags/2020", "tags"), ("https://h.example/tags/%zz", "%zz"), ("bad", ""), (None, "")])
def test_tag_name(url, name):
    assert urls.tag_name(url) == name


@pytest.mark.parametrize("url,pattern,expected", [
    ("https://h.example/list?page=9", "/list?page={n}", "https://h.example/list?page=10"), ("https://h.example/", "/page/{n}/", "https://h.example/page/2/"),
    ("https://h.example/about", "/page/{n}/", None), ("https://h.example/page", "/page/{n}/", "https://h.example/page/2/"), ("bad", "/page/{n}", None), ("https://h.example/", "", None)])
def test_next_by_pattern(url, pattern, expected):
    assert urls.next_by_pattern(url, pattern) == expected


def test_text_columns(spark):
    rows = spark.createDataFrame([(1, " k \n l "), (2, "k l"), (3, "x  y\t\n z"), (4, "p\r\rq\n\n\n\n\nr"), (5, "\xa0😀﻿"), (6, None), (7, "")], "i int, s string")
    s = F.col("s")
    out = {r.i: r for r in rows.select("i", text.content_hash(s).alias("h"), text.tidy(s).alias("t"), text.utf16_length(s).alias("n"), text.js_trim(s).alias("j")).collect()}
    assert out[1].h == out[2].h == hashlib.sha256(b"k l").hexdigest()
    assert out[3].t == "x y\nz" and out[4].t == "p\n\nq\n\nr"
    assert out[5].n == 4 and out[5].j == "😀"
    assert out[6].h is None and out[6].t is None and out[7].t == ""


def test_formats(spark):
    rows = spark.createDataFrame([(1023, 3_723_000), (1024, 125_000), (1536, 3_999), (5 * 1024**4, 0)], "n long, ms long")
    out = [tuple(r) for r in rows.select(text.format_bytes(F.col("n")), text.format_duration(F.col("ms"))).collect()]
    assert out == [("1023 B", "1h 02m 03s"), ("1.0 KB", "2m 05s"), ("1.5 KB", "3s"), ("5120.0 GB", "0s")]


def test_keys_and_tags(spark):
    rows = spark.createDataFrame([(" 7 ", "t", ["a", " a", "", None]), ("", "t", None), (None, None, []), (None, "", ["b"])], "id string, text string, tags array<string>")
    out = [tuple(r) for r in rows.select(text.post_key(F.col("id"), F.col("text")), text.clean_tags(F.col("tags"))).collect()]
    assert out == [("anek:id:7", ["a"]), ("anek:txt:" + hashlib.sha256(b"t").hexdigest(), []), (None, []), (None, ["b"])]


def test_tree():
    root = html.tree('<div class="a b" id=q><p>x<p>y<br>z<ul><li>1<li>2</ul></div><script>"</p>"</script>')
    assert [n.text() for n in html.select(root, "p")] == ["x", "yz"]
    assert [n.text() for n in html.select(root, ".a li")] == ["1", "2"]
    assert html.select(root, 'div.b[id="q"], script')[0].tag == "div" and len(html.select(root, "[id=z]")) == 0
    assert html.tree(None).children == [] and html.tree("").text() == ""
    assert html.tree("<b>" * 5000 + "x").text() == "x"


def test_config():
    c = config.from_env({"REQUEST_DELAY_MS": "25x", "DRY_RUN": "maybe", "MAX_PAGES": "", "ALLOWED_EXTENSIONS": "a, ,b", "STOP_ON_EMPTY_PAGE": "Yes"})
    assert (c.delay_ms, c.dry_run, c.max_pages, c.image_extensions, c.stop_on_empty) == (25, False, 0, ("a", "b"), True)
    c = config.from_args(c, ["--full", "--max-pages", "3", "--dry-run"])
    assert (c.mode, c.max_pages, c.dry_run) == ("full", 3, True)
    with pytest.raises(SystemExit):
        config.from_args(c, ["--no-such-flag"])


def test_nothing_outside_llm_imports_it():
    package = Path(config.__file__).parent
    for f in package.rglob("*.py"):
        if "llm" not in f.relative_to(package).parts:
            assert "quellwerk.llm" not in f.read_text(), f
