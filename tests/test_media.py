import struct
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quellwerk.config import Config
from quellwerk.operators import media
from quellwerk.sources.images import dimensions, image_facts

PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
JPEG = b"\xff\xd8\xff\xe0\x00\x04xx\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40)


@pytest.mark.parametrize("raw,size", [
    (PNG, (640, 480)), (b"GIF89a" + struct.pack("<HH", 3, 4), (3, 4)), (JPEG, (40, 30)), (b"RIFF....WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x04\0\0", (10, 5)),
    (b"RIFF....WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 7, 8), (7, 8)), (PNG[:18], None), (JPEG[:9], None), (b"text", None), (b"", None), (None, None)])
def test_dimensions(raw, size):
    assert dimensions(raw) == size


def test_facts(spark):
    rows = spark.createDataFrame([(1, PNG), (2, b"x"), (3, None)], "ord int, content binary")
    got = {r.ord: (r.bytes, r.width, r.height) for r in image_facts(rows).collect()}
    assert got == {1: (24, 640, 480), 2: (1, None, None), 3: (None, None, None)}


def test_outcomes(spark):
    u = "https://h.example/"
    rows = [(1, u + "a", "s1", 900, None), (2, u + "a/#x", "s2", 900, None), (3, u + "b", "s1", 900, None), (4, u + "c", "s3", 10, None), (5, u + "d", None, None, "HTTP 404"),
            (6, u + "old", "s6", 900, None), (7, u + "e", "sold", 900, None), (8, u + "c", "s3", 900, None)]
    downloads = spark.createDataFrame(rows, "ord int, url string, sha256 string, bytes long, error string")
    records = spark.createDataFrame([(u + "old", "sold"), (u + "x", None)], "normalized_url string, sha256 string")
    config = replace(Config(), min_bytes=100)
    results = media.outcomes(downloads, records, config)
    got = {r.ord: (r.status, r.reason) for r in results.collect()}
    assert got == {1: ("downloaded", None), 2: ("duplicate", "url"), 3: ("duplicate", "hash"), 4: ("skipped", "min-bytes"), 5: ("failed", "HTTP 404"), 6: ("duplicate", "url"),
                   7: ("duplicate", "hash"), 8: ("downloaded", None)}
    facts = downloads.withColumn("filename", F.lit("f.jpg"))
    assert sorted(r.url for r in media.image_records(results, facts).collect()) == [u + "a", u + "c"]
    stats = media.run_stats(results.join(downloads.select("ord", "bytes"), "ord"), 2, 3, 1).first()
    assert (stats.images_discovered, stats.images_downloaded, stats.images_skipped, stats.duplicates, stats.failures, stats.bytes_downloaded) == (8, 2, 1, 4, 1, 1800)
    assert set(r.status for r in media.outcomes(downloads.filter("ord = 1"), records, replace(config, dry_run=True)).collect()) == {"dry-run"}
    rate = spark.range(1).select(media.images_per_second(F.lit(6), F.lit(3000)), media.images_per_second(F.lit(6), F.lit(10))).first()
    assert tuple(rate) == (2.0, 6.0)


def test_download(spark):
    from quellwerk.operators.download import download

    asked = {"https://h.example/a.png": PNG, "https://h.example/b.png": PNG, "https://h.example/c.jpg": JPEG, "https://h.example/e.gif": b""}

    def get(url, config, referer):
        if url not in asked:
            raise ValueError("gone")
        return 200, asked[url] + (referer or "").encode(), "image/png"

    rows = [(1, "https://h.example/a.png", "r", "T", 1), (2, "https://h.example/b.png", "r", "T", 1), (3, "https://h.example/c.jpg", None, "T", None), (4, "https://h.example/d.png", "r", None, 1),
            (5, "https://h.example/e.gif", None, None, 2), (6, "https://h.example/old.png", "r", None, 1), (7, None, None, None, None)]
    wanted = spark.createDataFrame(rows, "ord long, url string, referer string, title string, ordinal int")
    records = spark.createDataFrame([("https://h.example/old.png", None, "T_0.jpg")], "normalizedUrl string, sha256 string, filename string").withColumnRenamed("normalizedUrl", "normalized_url")
    config = Config(delay_ms=0, retries=1, retry_base_ms=0, min_bytes=len(JPEG) + 1)
    results, new, contents = download(spark, wanted, records, config, get)
    got = {r.ord: (r.status, r.reason, r.retries) for r in results.collect()}
    assert got == {1: ("downloaded", None, 0), 2: ("duplicate", "hash", 0), 3: ("skipped", "min-bytes", 0), 4: ("failed", "gone", 1), 5: ("failed", "empty body", 0), 6: ("duplicate", "url", 0)}
    assert [(r.filename, bytes(r.content)) for r in contents.collect()] == [("T_1.png", PNG + b"r")] and new.count() == 1
    assert {r.filename for r in results.collect()} == {"T_1.png", "T_1_2.png", "T_0_2.jpg", "d.png", "e.gif", "old.png"}
    dry, none, _ = download(spark, wanted, records, replace(config, dry_run=True), get)
    assert {r.status for r in dry.collect()} == {"dry-run", "duplicate"} and none.count() == 0


def test_stored_records(spark, tmp_path):
    f = tmp_path / "images.json"
    assert media.read_records(spark, str(f)).count() == 0
    f.write_text('[{"url": "u", "normalizedUrl": "n", "filename": "", "sha256": null, "bytes": 3}, {"url": "v", "normalizedUrl": "n", "filename": "f", "sha256": "s", "bytes": 3}]')
    keys = {tuple(r) for r in media.record_keys(media.read_records(spark, str(f))).collect()}
    assert keys == {("url", "n"), ("filename", "f"), ("hash", "s")}
    f.write_text("{")
    assert media.read_records(spark, str(f)).count() == 0
