import json

from quellwerk import harvest
from quellwerk.config import Config


def site(fresh=()):
    """Two tags of three pages that share a post; `fresh` posts are put on the first page of tag a."""
    box = '<div class="topicbox" data-id="{0}"><div class="text">the text of post number {0}</div></div>'
    index = '<div class="tags-cloud"><a href="/tags/a">a</a><a href="/tags/b">b</a></div>'
    pages = {"https://h.example/tags/": index}
    for tag in "ab":
        for i in range(3):
            ids = [*(fresh if tag == "a" and i == 0 else ()), f"{tag}{i}1", "both", f"{tag}{i}2"]
            link = f'<div class="pageslist"><a href="/tags/{tag}/{i + 1}">след. →</a></div>' if i < 2 else ""
            pages[f"https://h.example/tags/{tag}" + (f"/{i}" if i else "")] = "".join(map(box.format, ids)) + link
    asked = []

    def get(url, config):
        asked.append(url)
        return 200, pages[url].encode("cp1251", "xmlcharrefreplace"), "text/html; charset=windows-1251"

    return get, asked


def texts(folder):
    return sorted(a["text"].split()[-1] + ":" + a["tags"][0] for f in folder.glob("anecdotes/*.json") for a in json.loads(f.read_text())["anecdotes"])


def test_full_resume_and_dry_run(spark, tmp_path):
    config = Config(start_url="https://h.example/tags/", output=str(tmp_path), delay_ms=0)
    get, _ = site()
    dry = harvest.run(spark, Config(start_url=config.start_url, output=str(tmp_path), delay_ms=0, dry_run=True), get)
    assert dry["new"] == 13 and not list(tmp_path.iterdir())
    harvest.run(spark, Config(start_url=config.start_url, output=str(tmp_path), delay_ms=0, max_pages=1), get)
    assert json.loads((tmp_path / "metadata.json").read_text())["completedTags"] == []
    harvest.run(spark, config, get)
    want = sorted([f"{t}{i}{j}:{t}" for t in "ab" for i in range(3) for j in (1, 2)] + ["both:a"])
    assert texts(tmp_path) == want
    meta = json.loads((tmp_path / "metadata.json").read_text())
    assert meta["completedTags"] == ["https://h.example/tags/a", "https://h.example/tags/b"] and meta["knownPosts"] == 13
    get, _ = site(["new"])
    assert harvest.run(spark, config, get)["new"] == 1
    assert texts(tmp_path) == sorted([*want, "new:a"])
    assert len(json.loads((tmp_path / "visited-pages.json").read_text())) == 6


def test_a_walk_cut_off_goes_on(spark, tmp_path):
    """A crash in the second wave repeats that wave only; a stop writes what was found."""
    config = Config(start_url="https://h.example/tags/", output=str(tmp_path), delay_ms=0, retries=0)
    get, asked = site()
    tags = harvest.tags(spark, config, get)
    stage, calls = tmp_path / "unfinished", []
    first, _, done = harvest.full(spark, config, tags, get, stage, lambda: calls.append(1) or len(calls) > 1)  # ends after one wave
    assert first.count() == 6 and not done and (stage / "state.json").exists()
    posts, pages, done = harvest.full(spark, config, tags, get, stage)
    assert posts.count() == 18 and len(pages) == 6 and len(done) == 2
    assert json.loads((stage / "state.json").read_text())["wave"] == 3
    result = harvest.run(spark, config, get)
    assert result["new"] == 13 and not stage.exists() and not result["stopped"]
    assert list((tmp_path / "logs").glob("*.log"))[0].read_text().count("[INFO]") >= 2


def test_log_stop_and_progress(tmp_path, capsys):
    import os
    import signal
    import time

    from quellwerk.log import Progress, Stop, open_log

    log = open_log(tmp_path, "warn")
    log.debug("small")
    with Stop(log) as stop, Progress(log, 0.05) as progress:
        assert not stop.asked
        progress.counts.update(pages=2)
        os.kill(os.getpid(), signal.SIGTERM)
        time.sleep(0.2)
        assert stop.asked
    lines = next(tmp_path.glob("*.log")).read_text()
    assert "[DEBUG] small" in lines and "progress: pages=2" in lines and "done: pages=2" in lines
    out = capsys.readouterr()
    assert "SIGTERM" in out.err and "[WARN]" in out.err and not out.out


def test_stream_log(spark, tmp_path):
    from quellwerk.log import StreamLog
    from quellwerk.streaming.posts import PostStream

    said = []
    listener = StreamLog(said.append)
    spark.streams.addListener(listener)
    spark.createDataFrame([(1, "7", "a text"), (2, "7", "a text"), (3, None, None)], "o long, id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = PostStream(spark, str(tmp_path / "out"), ["o"])
    source = spark.readStream.schema("o long, id string, text string").parquet(str(tmp_path / "in"))
    stream.run(source, str(tmp_path / "check")).awaitTermination()
    assert stream.posts().count() == 1
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    spark.streams.removeListener(listener)
    assert any("rows=3" in x for x in said)
