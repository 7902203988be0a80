"""Queries of page, link, media and state operators.

The test tables hold few pages, so each query writes the markup its operator reads from rows of a table (all of
them) and the SQL says what must come out of those rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from quellwerk.functions import text, urls
from quellwerk.operators import crawl, extract, media, sink
from quellwerk.plans.queries import CONFIG, KEY, KNOWN, LATEST, _hash, _normal, _tidy_sql, _trim, known_keys, query, table
from quellwerk.sources import images, pages

BASE = "https://anekbox.example"


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _path(c: str) -> str:
    return f"regexp_replace({c}, '^https?://[^/]+', '')"


@query(f"""WITH t AS (SELECT *, (row_number() OVER (ORDER BY tag_id) - 1)::BIGINT AS ord FROM tag_index WHERE url IS NOT NULL),
 f AS (SELECT ord, '{BASE}' || {_path('url')} AS link FROM t QUALIFY row_number() OVER (PARTITION BY {_normal(f"'{BASE}' || " + _path('url'))} ORDER BY ord) = 1),
 s AS (SELECT *, string_split(regexp_replace(regexp_replace(link, '[?#].*$', ''), '/+$', ''), '/') AS p FROM f)
 SELECT ord AS tag_ord, link AS tag_url, url_decode(CASE WHEN regexp_full_match(p[-1], '[0-9]+') AND len(p) > 4 THEN p[-2] ELSE p[-1] END) AS name FROM s""")
def tag_links(spark, sf):
    """G1, X1, D-1: the index page of all tags, links relative to it."""
    t = table(spark, sf, "tag_index").filter("url is not null").select("tag_id", F.regexp_replace("url", "^https?://[^/]+", "").alias("href"))
    page = t.agg(F.array_sort(F.collect_list(F.struct("tag_id", "href"))).alias("a"))  # a fixed table: one page
    links = F.array_join(F.transform("a", lambda x: F.concat(F.lit('<a href="'), _escaped(x["href"]), F.lit('">x</a>'))), "\n")
    page = page.select(F.lit(f"{BASE}/").alias("url"), F.concat(F.lit('<a href="/tags/out/">out</a><div class="tags-cloud"><a>no link</a>'), links, F.lit("</div>")).alias("html"))
    found = extract.tags_of(page, CONFIG)
    return found.select((F.col("tag_ord") - 1).alias("tag_ord"), "tag_url", "name")


@query(f"SELECT url, next_url, regexp_extract(url, '^(https?://[^/]*)', 1) || {_path('next_url')} AS resolved FROM visited_pages WHERE url IS NOT NULL AND next_url IS NOT NULL")
def resolved_links(spark, sf):
    """Next pages as links relative to the host."""
    rows = table(spark, sf, "visited_pages").filter("url is not null and next_url is not null")
    return rows.withColumn("_href", F.regexp_replace("next_url", "^https?://[^/]+", "")).select("url", "next_url", urls.resolve_url_col("_href", "url").alias("resolved"))


def _listing(spark, sf):
    rows = table(spark, sf, "visited_pages").filter("url is not null")
    link = F.coalesce(F.concat(F.lit('<a href="'), _escaped(F.col("next_url")), F.lit('"> СЛЕДующая </a>')), F.lit(""))
    return rows.select("url", F.concat(F.lit('<p><a href="/other">следующая</a></p><div class="pageslist"><a href="/tags/first/1">назад</a>'), link, F.lit("</div>")).alias("html"))


@query(f"SELECT url, CASE WHEN {_normal('next_url')} <> {_normal('url')} THEN next_url END AS next_url FROM visited_pages WHERE url IS NOT NULL")
def next_links(spark, sf):
    """The next page by link text."""
    return extract.next_pages(_listing(spark, sf), CONFIG)


@query("SELECT url, CASE WHEN host || '/tags/first/1' <> regexp_replace(url, '/$', '') THEN host || '/tags/first/1' END AS next_url FROM (SELECT url, lower(regexp_extract(url, '^(https?://[^/]*)', 1)) AS host FROM visited_pages WHERE url IS NOT NULL)")
def next_first_links(spark, sf):
    """The next page by the first link."""
    return extract.next_pages(_listing(spark, sf), replace(CONFIG, next_text=""))


POSTS = f"""SELECT in_id, page, id, tidy AS post, CASE WHEN id <> '' THEN '{BASE}/id/' || id || '/' ELSE '' END AS post_url FROM (
 SELECT in_id, '{BASE}/tags/t' || tag_ord || '/' || page_ord AS page, coalesce({_trim('id')}, '') AS id, {_tidy_sql("text")} AS tidy, tag_ord, page_ord, url FROM incoming_posts WHERE text IS NOT NULL)
 WHERE length(tidy) + length(regexp_replace(tidy, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) >= 15"""


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY page, CASE WHEN id <> '' THEN 'id:' || id ELSE 'txt:' || left(post, 120) END ORDER BY in_id) AS n
  FROM ({POSTS.replace("in_id, page,", "in_id, page, url, tag_ord,")}) WHERE tag_ord % 5 <> 1 AND coalesce(url, '') <> '')
 SELECT in_id, page, id, post, post_url FROM p WHERE n = 1""")
def page_posts(spark, sf):
    """G2, F1-F5, D-2, X7: listing pages of all incoming posts.

    Boxes of one tag in five stand in an advertisement, those without url hold a picture, and each
    page has a box without text.
    """
    p = table(spark, sf, "incoming_posts").filter("text is not null")
    picture = F.when(F.coalesce("url", F.lit("")) == "", F.lit('<img src="/x.png">')).otherwise(F.lit(""))
    box = F.concat(F.lit('<div class="topicbox" data-id="'), _escaped(F.coalesce("id", F.lit(""))), F.lit('" data-in="'), F.col("in_id").cast("string"),
                   F.lit('"><div class="text">'), F.replace(_escaped(F.col("text")), F.lit("\n"), F.lit("<br>")), picture, F.lit("</div></div>"))
    box = F.when(F.col("tag_ord") % 5 == 1, F.concat(F.lit('<div class="ad">'), box, F.lit("</div>"))).otherwise(box)
    page = F.concat(F.lit(f"{BASE}/tags/t"), F.col("tag_ord").cast("string"), F.lit("/"), F.col("page_ord").cast("string"))
    listed = p.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("in_id", box.alias("b")))).alias("a"))  # a page of a site
    listed = listed.select("page", F.concat(F.array_join("a.b", "\n"), F.lit('<div class="topicbox" data-id="1"><p>no text here at all</p></div>')).alias("html"), F.col("a.in_id").alias("ids"))
    found = extract.posts_of(listed, CONFIG, "page", "html", ["ids"])
    return found.select(F.get("ids", F.col("box_ord").cast("int")).alias("in_id"), "page", "id", F.col("text").alias("post"), "post_url")


IMAGES = f"SELECT anecdote_id AS n, '{BASE}/id/' || anecdote_id || '/' AS url, 200 + anecdote_id % 400 AS w FROM anecdotes"


@query(f"""WITH p AS ({IMAGES})
 SELECT url, '{BASE}/files/a' || n || '.jpg' AS image_url, 0 AS width, 0 AS height FROM p
 UNION ALL SELECT url, '{BASE}/i/b' || n || '.png', w, 500 FROM p WHERE w >= 400
 UNION ALL SELECT url, '{BASE}/i/wide' || n || '.webp', 0, 0 FROM p
 UNION ALL SELECT url, '{BASE}/v/c' || n || '.mp4', 0, 0 FROM p
 UNION ALL SELECT url, 'https://cdn.example/o' || n || '.gif', 0, 0 FROM p""")
def page_images(spark, sf):
    """G3, G4, U1, X18, D-4, F7-F10: a page of pictures for each anecdote.

    Links, size suffixes, a srcset, a video, page hints, repeats, blocked words, other extensions, and probed sizes of which some are too small.
    """
    n = F.col("anecdote_id").cast("string")
    parts = ['<html><head><meta property="og:image" content="https://cdn.example/o', n, '.gif"></head><body><a href="/files/a', n, '.jpg">x</a><a href="/files/a', n,
             '.zip">x</a><img src="/i/b', n, '-1024x768.png"><img src="/i/b', n, '.png#again"><img srcset="/i/small', n, '.webp 100w, /i/even', n, '.webp 800w, /i/wide', n,
             '.webp 800w"><img src="/thumb/t', n, '.jpg"><video src="/v/c', n, '.mp4"></video></body></html>']
    a = table(spark, sf, "anecdotes")
    p = a.select(F.concat(F.lit(f"{BASE}/id/"), n, F.lit("/")).alias("url"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("html"))
    sizes = a.select(F.concat(F.lit(f"{BASE}/i/b"), n, F.lit(".png")).alias("image_url"), (200 + F.col("anecdote_id") % 400).cast("int").alias("width"), F.lit(500).alias("height"))
    return extract.images_of(p, CONFIG, sizes=sizes)


@query("""SELECT doc_id, CASE WHEN greatest(v, w) = 0 THEN 'c.png' WHEN w >= v THEN 'b.png' ELSE 'a.png' END AS largest FROM (SELECT doc_id, n_chars AS v, (n_chars * 7919) % 5000 AS w FROM documents WHERE n_chars IS NOT NULL)""")
def srcset_largest(spark, sf):
    """The widest candidate, the last of equals."""
    n = F.col("n_chars")
    srcset = F.concat(F.lit("first.png, a.png "), n.cast("string"), F.lit("w , b.png   "), (n * 7919 % 5000).cast("string"), F.lit("w, ,c.png 2x"))
    return table(spark, sf, "documents").filter(n.isNotNull()).select("doc_id", extract.largest_of_srcset(srcset).alias("largest"))


_UNITS = "length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"


def _cut_sql(c: str, n: int) -> str:
    """First `n` UTF-16 units of a text in SQL; a halved character becomes U+FFFD."""
    fits = f"len(list_filter(range(1, {n + 1}), lambda i: i <= length({c}) AND {_UNITS.format(f'left({c}, i)')} <= {n}))"
    return f"left({c}, {fits}) || CASE WHEN length({c}) > {fits} AND {_UNITS.format(f'left({c}, {fits})')} < {n} THEN chr(65533) ELSE '' END"


_TITLE = f"regexp_replace(regexp_replace(regexp_replace({_trim('coalesce(title, ' + chr(39) * 2 + ')')}, '[<>:\"/\\\\|?*\\x00-\\x1F]', '-', 'g'), '[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'), '[ .]+$', '')"
TITLED = f"SELECT anecdote_id, coalesce(nullif({_trim('CASE WHEN length(c) > 70 THEN ' + _cut_sql('c', 150) + ' ELSE c END')}, ''), 'post') AS title FROM (SELECT anecdote_id, {_TITLE} AS c FROM anecdotes)"


@query(TITLED)
def title_names(spark, sf):
    """Titles as file names."""
    return table(spark, sf, "anecdotes").select("anecdote_id", media.title_filename(F.col("title")).alias("title"))


@query(f"""SELECT anecdote_id, CASE WHEN coalesce(a.title, '') <> '' THEN t.title || '_' || anecdote_id || '.png' ELSE 'pic-' || anecdote_id || '.png' END AS own,
 CASE WHEN coalesce(a.title, '') <> '' THEN t.title || '_7.jpg' ELSE 'image.jpg' END AS other FROM anecdotes AS a JOIN ({TITLED}) AS t USING (anecdote_id)""")
def media_names(spark, sf):
    """X17 with X12, X14, X16: names of a picture and of a link without extension."""
    a = table(spark, sf, "anecdotes")
    picture = F.concat(F.lit(f"{BASE}/pic-"), F.col("anecdote_id").cast("string"), F.lit(".PNG?x=1"))
    name = lambda url, n: media.filename(CONFIG, url, F.col("title"), n)
    rows = a.select("anecdote_id", name(picture, F.lit(None).cast("int")).alias("own"), name(F.lit(f"{BASE}/dir/"), F.lit(7)).alias("other"))
    return rows.withColumn("own", F.regexp_replace("own", r"\.PNG$", ".png"))


@query(f"""SELECT anecdote_id, name, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.txt$', '') || '_' || n || '.txt' END AS unique_name FROM (
 SELECT anecdote_id, title || '.txt' AS name, row_number() OVER (PARTITION BY title ORDER BY anecdote_id) AS n FROM ({TITLED}))""")
def unique_names(spark, sf):
    """Each title a file name of its own."""
    wanted = table(spark, sf, "anecdotes").select("anecdote_id", F.concat(media.title_filename(F.col("title")), F.lit(".txt")).alias("name"))
    return media.unique_filenames(wanted, spark.createDataFrame([], "name string"), ["anecdote_id"])


_TYPES = {"post": " IMAGE/JPEG ; q=1", "page": "image/png", "story": "image/webp;x", "digest": "image/gif", "log": "text/html"}


@query("SELECT doc_id, CASE kind WHEN 'post' THEN 'jpg' WHEN 'page' THEN 'png' WHEN 'story' THEN 'webp' WHEN 'digest' THEN 'gif' ELSE '' END AS extension FROM documents")
def content_types(spark, sf):
    """X13."""
    kind = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])[F.col("kind")]
    return table(spark, sf, "documents").select("doc_id", media.extension_of_type(kind).alias("extension"))


def _raw_pages(spark, sf):
    d = table(spark, sf, "documents")
    wide = F.col("kind") == "page"
    content = F.when(wide, F.encode("text", "UTF-16LE")).otherwise(F.encode(F.concat(F.when(F.col("kind") == "post", F.lit('<meta charset="UTF-8">')).otherwise(F.lit("")), "text"), "UTF-8"))
    kind = F.when(wide, F.lit("text/html; Charset='UTF-16LE'")).when(F.col("kind") == "story", F.lit("text/html; charset=no-such-one")).otherwise(F.lit("text/html"))
    return d.select("doc_id", "kind", content.alias("content"), kind.alias("content_type"))


@query("""SELECT doc_id, CASE WHEN kind = 'page' THEN 'utf-16le' WHEN kind = 'story' THEN 'no-such-one' WHEN text IS NULL THEN 'utf-8'
 ELSE coalesce(nullif(lower(regexp_extract(decode(array_slice(encode(text), 1, 2048)::BLOB), '(?i)charset=["'']?([A-Za-z0-9_-]+)', 1)), ''), 'utf-8') END AS charset FROM documents""".replace(
     "decode(array_slice(encode(text), 1, 2048)::BLOB)", "left(text, 2048)"))
def page_charsets(spark, sf):
    """S3, X11: from the header, the page's head, or the default."""
    return _raw_pages(spark, sf).select("doc_id", pages.charset(F.col("content"), F.col("content_type")).alias("charset"))


@query("SELECT doc_id, regexp_replace(CASE WHEN kind = 'post' THEN '<meta charset=\"UTF-8\">' ELSE '' END || text, '^\\x{FEFF}', '') AS html FROM documents")
def page_texts(spark, sf):
    """Decoded pages; an unknown charset is read as UTF-8."""
    return _raw_pages(spark, sf).select("doc_id", pages.decoded(F.col("content"), F.col("content_type")).alias("html"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes, NULL::INT AS width, NULL::INT AS height FROM documents")
def content_facts(spark, sf):
    """Digest, size and dimensions of contents (texts have none)."""
    return images.image_facts(table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")))


STATUS = "CASE WHEN s < 40 THEN 200 WHEN s < 44 THEN 404 WHEN s < 48 THEN 503 WHEN s < 52 THEN 429 END"


@query(f"""SELECT url, status, CASE WHEN status = 200 AND total > 0 THEN next_url END AS next_url,
 CASE WHEN status = 404 THEN true WHEN status IS NULL OR status <> 200 THEN false WHEN total = 0 THEN true ELSE next_url IS NULL END AS reached_end
 FROM (SELECT url, next_url, minute(processedAt) % 3 AS total, {STATUS} AS status FROM (SELECT *, second(processedAt) AS s FROM visited_pages WHERE processedAt IS NOT NULL))""")
def page_outcomes(spark, sf):
    """All ways a page may end, its status and posts made from the time of the visit."""
    v = table(spark, sf, "visited_pages").filter("processedAt is not null")
    s = F.second(F.col("processedAt").cast("timestamp"))
    status = F.when(s < 40, 200).when(s < 44, 404).when(s < 48, 503).when(s < 52, 429)
    o = crawl.page_outcome(status, F.minute(F.col("processedAt").cast("timestamp")) % 3, F.col("next_url"))
    return v.select("url", status.alias("status"), o["next_url"].alias("next_url"), o["reached_end"].alias("reached_end"))


@query(f"""WITH RECURSIVE e AS ({LATEST}), s AS (SELECT tag, min(key) AS key FROM e WHERE tag IS NOT NULL GROUP BY tag),
 c(tag, key, path) AS (SELECT s.tag, e.key, [e.key] FROM s JOIN e USING (key)
  UNION ALL SELECT c.tag, n.key, list_append(c.path, n.key) FROM c JOIN e ON e.key = c.key JOIN e AS n ON n.key = {_normal('e.next_url')}
  WHERE e.next_url IS NOT NULL AND NOT list_contains(c.path, n.key))
 SELECT c.tag, bool_or(e.next_url IS NULL OR list_contains(c.path, {_normal('e.next_url')})) AS complete FROM c JOIN e USING (key) GROUP BY c.tag""")
def walked_tags(spark, sf):
    """W5, D-7: tags whose walk ended or came back into itself."""
    latest = crawl.latest_pages(table(spark, sf, "visited_pages"))
    starts = latest.filter("tag is not null").groupBy("tag").agg(F.min_by("url", "key").alias("url"))
    return crawl.completed(crawl.page_chains(starts, latest).withColumn("reached_end", F.col("next_url").isNull()), "tag")


DOWNLOADS = f"""WITH d AS (SELECT in_id, url, {_normal("coalesce(url, '')")} AS key, {_hash('text')} AS sha, strlen(text) AS bytes FROM incoming_posts WHERE text IS NOT NULL AND url <> ''),
 a AS (SELECT *, CASE WHEN bytes >= 300 THEN min(CASE WHEN bytes >= 300 THEN in_id END) OVER (PARTITION BY sha) END AS fs FROM d),
 w AS (SELECT *, min(CASE WHEN fs = in_id THEN in_id END) OVER (PARTITION BY key) AS fu FROM a),
 r AS (SELECT *, CASE WHEN fu < in_id THEN 'duplicate' WHEN bytes < 300 THEN 'skipped' WHEN fs < in_id THEN 'duplicate' ELSE 'downloaded' END AS status FROM w)"""


def _downloads(spark, sf):
    d = table(spark, sf, "incoming_posts").filter("text is not null and url <> ''")
    d = d.select(F.col("in_id").alias("ord"), "url", text.content_hash(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.lit(None).cast("string").alias("error"))
    return d, media.outcomes(d, spark.createDataFrame([], "normalized_url string, sha256 string"), replace(CONFIG, min_bytes=300))


@query(f"""{DOWNLOADS} SELECT (SELECT count(*) FROM visited_pages) AS pages_visited, (SELECT count(*) FROM incoming_posts) AS posts_processed, count(*) AS images_discovered,
 count(*) FILTER (status = 'downloaded') AS images_downloaded, count(*) FILTER (status = 'skipped') AS images_skipped, count(*) FILTER (status = 'duplicate') AS duplicates,
 0::BIGINT AS failures, 3::BIGINT AS retries, coalesce(sum(bytes) FILTER (status = 'downloaded'), 0)::BIGINT AS bytes_downloaded,
 count(*) FILTER (status = 'downloaded') / 2.5 AS images_per_second FROM r""")
def run_counters(spark, sf):
    """A2, A7."""
    d, results = _downloads(spark, sf)
    counts = table(spark, sf, "visited_pages").agg(F.count("*").alias("p")).crossJoin(table(spark, sf, "incoming_posts").agg(F.count("*").alias("q")))  # two rows of one count each
    stats = media.run_stats(results.join(d.select("ord", "bytes"), "ord"), retries=3).drop("pages_visited", "posts_processed").crossJoin(counts)
    return stats.select(F.col("p").alias("pages_visited"), F.col("q").alias("posts_processed"), *[c for c in stats.columns if c not in ("p", "q")],
                        media.images_per_second(F.col("images_downloaded"), F.lit(2500)).alias("images_per_second"))


@query(f"""{DOWNLOADS} SELECT url, key AS normalized, 'f' || in_id AS filename, sha AS sha256, bytes::BIGINT AS bytes FROM r WHERE status = 'downloaded'""")
def stored_images(spark, sf):
    """Records of what was downloaded."""
    d, results = _downloads(spark, sf)
    facts = d.withColumn("filename", F.concat(F.lit("f"), F.col("ord").cast("string")))
    return media.image_records(results, facts).select("url", F.col("normalizedUrl").alias("normalized"), "filename", "sha256", "bytes")


@query(f"""SELECT 'url' AS kind, key AS value FROM (SELECT DISTINCT {_normal('url')} AS key FROM incoming_posts WHERE url <> '')
 UNION ALL SELECT DISTINCT 'hash', {_hash('text')} FROM incoming_posts WHERE text <> '' UNION ALL SELECT DISTINCT 'filename', id FROM incoming_posts WHERE id <> ''""")
def image_keys(spark, sf):
    """S9, D-5: the three key sets of stored image records."""
    p = table(spark, sf, "incoming_posts")
    sha = F.when(F.col("text") != "", text.content_hash(F.col("text")))
    return media.record_keys(p.select(urls.normalize_url_col("url").alias("normalizedUrl"), sha.alias("sha256"), F.col("id").alias("filename")))


@query(f"""SELECT in_id, '' AS title, {_trim('text')} AS text, CASE WHEN coalesce({_trim('id')}, '') <> '' THEN [{_trim('id')}] ELSE [] END AS tags, nullif(url, '') AS url FROM incoming_posts WHERE {_trim('text')} <> ''""")
def stored_entries(spark, sf):
    """Posts as they are stored."""
    p = table(spark, sf, "incoming_posts").select("in_id", "text", F.col("url").alias("post_url"), "id")
    return sink.entries(p, F.coalesce("id", F.lit("")), keep=["in_id"]).drop("addedAt")


@query(f"SELECT doc_id, {_cut_sql('text', 50)} AS start, replace({_cut_sql('text', 50)}, chr(10), ' ') || '...' AS preview FROM documents")
def log_previews(spark, sf):
    """The first 50 UTF-16 units."""
    return table(spark, sf, "documents").select("doc_id", text.utf16_start(F.col("text"), 50).alias("start"), text.preview(F.col("text")).alias("preview"))


@query(f"""WITH k AS (SELECT in_id, text, {KEY} AS key FROM incoming_posts),
 fresh AS (SELECT in_id, text, key FROM k WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY in_id) = 1)
 SELECT in_id, key, {_hash('text')} AS hash FROM fresh WHERE {_trim('text')} <> '' QUALIFY row_number() OVER (PARTITION BY {_hash('text')} ORDER BY in_id) = 1""")
def streamed_posts(spark, sf):
    """The incoming posts as a stream that is drained and committed batch by batch."""
    from quellwerk.session import fresh_path
    from quellwerk.streaming.posts import PostStream

    path = fresh_path(spark, "stream")
    schema = table(spark, sf, "incoming_posts").schema
    # a pattern, since a stream reads no single file by its plain path; the table may be a file or a folder of files
    source = spark.readStream.schema(schema).parquet(f"{sf}/incoming_posts.parque[t]")
    stream = PostStream(spark, path, ["in_id"])
    stream.run(source, f"{path}-checkpoint").awaitTermination()
    return stream.posts().select("in_id", "key", "hash")


@query(f"SELECT 'posts' AS name, count(*) AS n FROM {KNOWN} UNION ALL SELECT 'pages', count(*) FROM ({LATEST}) UNION ALL SELECT 'anecdotes', count(*) FROM anecdotes")
def state_sizes(spark, sf):
    """Sizes of the known sets."""
    sets = (("posts", known_keys(spark, sf).distinct()), ("pages", crawl.latest_pages(table(spark, sf, "visited_pages"))), ("anecdotes", table(spark, sf, "anecdotes")))
    rows = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, x in sets]
    return rows[0].union(rows[1]).union(rows[2])
