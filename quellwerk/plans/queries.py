"""Queries of the harvesting operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quellwerk.config import Config
from quellwerk.functions import text, urls
from quellwerk.operators import crawl, dedup, extract, media, sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIG = Config()

# Parts of the SQL: white space as one class, collapse, key.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _hash(c: str) -> str:
    return f"sha256(regexp_replace({_trim(c)}, '{WS}+', ' ', 'g'))"


KEY = f"CASE WHEN {_trim('id')} <> '' THEN 'anek:id:' || {_trim('id')} WHEN text <> '' THEN 'anek:txt:' || {_hash('text')} END"
KNOWN = "(SELECT DISTINCT key FROM (SELECT unnest(posts) AS key FROM visited_posts) WHERE key IS NOT NULL)"


def _normal(c: str) -> str:
    """Normalised url in SQL, for urls with plain paths and parameters of different names."""
    low = f"regexp_replace({c}, '#.*$', '')"
    host = f"lower(regexp_extract({low}, '^(https?://[^/?]*)', 1))"
    path = f"regexp_extract({low}, '^https?://[^/?]*([^?]*)', 1)"
    found = f"regexp_extract({low}, '\\?(.*)$', 1)"
    query = f"(CASE WHEN {found} <> '' THEN '?' || array_to_string(list_sort(string_split({found}, '&')), '&') ELSE '' END)"
    return f"CASE WHEN {c} LIKE 'http%' THEN regexp_replace({host} || {path} || {query}, '/$', '') ELSE {c} END"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def known_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the saved states, with their repeats."""
    return table(spark, sf, "visited_posts").select(F.explode("posts").alias("key")).filter("key is not null")


@query(f"SELECT in_id, {KEY} AS key FROM incoming_posts")
def post_keys(spark, sf):
    """X5, X6."""
    return table(spark, sf, "incoming_posts").select("in_id", text.post_key(F.col("id"), F.col("text")).alias("key"))


@query(f"SELECT in_id, {KEY} AS key FROM incoming_posts WHERE {KEY} IS NULL OR {KEY} NOT IN (SELECT key FROM {KNOWN})")
def known_anti_join(spark, sf):
    """J1."""
    posts = table(spark, sf, "incoming_posts").select("in_id", text.post_key(F.col("id"), F.col("text")).alias("key"))
    return dedup.unknown(posts, known_keys(spark, sf), "key")


@query(f"""WITH k AS (SELECT in_id, text, {KEY} AS key FROM incoming_posts),
 fresh AS (SELECT in_id, text, key FROM k WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM {KNOWN})
   QUALIFY row_number() OVER (PARTITION BY key ORDER BY in_id) = 1),
 h AS (SELECT in_id, key, {_hash('text')} AS hash FROM fresh WHERE {_trim('text')} <> '' QUALIFY row_number() OVER (PARTITION BY {_hash('text')} ORDER BY in_id) = 1)
 SELECT in_id, key, hash FROM h WHERE hash NOT IN (SELECT {_hash('text')} FROM anecdotes WHERE text IS NOT NULL)""")
def layered_dedup(spark, sf):
    """D-3a, D-3b, J1, J2."""
    stored = table(spark, sf, "anecdotes").filter("text is not null").select(text.content_hash(F.col("text")).alias("hash"))
    return dedup.layered_dedup(table(spark, sf, "incoming_posts"), known_keys(spark, sf), stored, ["in_id"], keep=["in_id"])


@query(f"""SELECT anecdote_id, {_hash('text')} AS hash FROM anecdotes WHERE {_trim('text')} <> ''
 QUALIFY row_number() OVER (PARTITION BY {_hash('text')} ORDER BY anecdote_id) = 1""")
def content_dedup(spark, sf):
    """D-3b, S7, F6: stored anecdotes, the first of each content hash."""
    return sink.stored(table(spark, sf, "anecdotes"), ["anecdote_id"], ["anecdote_id"])


@query("SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS units FROM documents WHERE length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) >= 15")
def utf16_min_length(spark, sf):
    """F3."""
    return table(spark, sf, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("units")).filter("units >= 15")


def _tidy_sql(c: str) -> str:
    for pattern, to in ((r"\x{A0}", " "), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return _trim(c)


@query(f"SELECT in_id, {_tidy_sql('text')} AS tidy FROM incoming_posts")
def text_clean(spark, sf):
    """X4."""
    return table(spark, sf, "incoming_posts").select("in_id", text.tidy(F.col("text")).alias("tidy"))


@query(f"""WITH t AS (SELECT anecdote_id, {_trim('tag')} AS tag, pos FROM (SELECT anecdote_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM anecdotes)),
 f AS (SELECT anecdote_id, tag, min(pos) AS pos FROM t WHERE tag <> '' GROUP BY ALL)
 SELECT anecdote_id, tag, row_number() OVER (PARTITION BY anecdote_id ORDER BY pos)::BIGINT AS place FROM f""")
def clean_tags(spark, sf):
    """D-6, F12."""
    rows = table(spark, sf, "anecdotes").select("anecdote_id", F.posexplode(text.clean_tags(F.col("tags"))).alias("place", "tag"))
    return rows.select("anecdote_id", "tag", (F.col("place") + 1).cast("long").alias("place"))


@query(f"SELECT anecdote_id, {_normal('url')} AS key FROM anecdotes WHERE url IS NOT NULL")
def url_normalize(spark, sf):
    """X2."""
    return table(spark, sf, "anecdotes").filter("url is not null").select("anecdote_id", urls.normalize_url_col("url").alias("key"))


@query(f"""SELECT tag_id, url FROM tag_index QUALIFY row_number() OVER (PARTITION BY {_normal('url')} ORDER BY tag_ord) = 1""")
def tag_first_wins(spark, sf):
    """D-1."""
    rows = table(spark, sf, "tag_index").withColumn("_key", urls.normalize_url_col("url"))
    return dedup.first_wins(rows, ["_key"], ["tag_ord"]).select("tag_id", "url")


@query("""WITH s AS (SELECT tag_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/') AS p FROM tag_index)
 SELECT tag_id, url_decode(CASE WHEN regexp_full_match(p[-1], '[0-9]+') AND len(p) > 4 THEN p[-2] ELSE p[-1] END) AS tag_name FROM s""")
def tag_names(spark, sf):
    """X3."""
    return table(spark, sf, "tag_index").select("tag_id", urls.tag_name_col("url").alias("tag_name"))


@query("""SELECT url, regexp_extract(url, '^(https?://[^/]*)', 1) || '/tags/x/' || (CAST(regexp_extract(url, '/tags/x/([0-9]+)', 1) AS BIGINT) + 1) AS next_url
 FROM visited_pages WHERE regexp_matches(url, '/tags/x/[0-9]+') UNION ALL SELECT url, NULL FROM visited_pages WHERE NOT regexp_matches(url, '/tags/x/[0-9]+')""")
def next_page_pattern(spark, sf):
    """X10."""
    return table(spark, sf, "visited_pages").select("url", urls.next_by_pattern_col("/tags/x/{n}")("url").alias("next_url"))


LATEST = f"""SELECT {_normal('url')} AS key, url, processedAt, next_url, tag FROM visited_pages WHERE url IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY {_normal('url')} ORDER BY coalesce(processedAt, TIMESTAMP '1970-01-01') DESC, url DESC, coalesce(next_url, '') DESC) = 1"""


@query(f"SELECT key, url, next_url, tag FROM ({LATEST})")
def latest_pages(spark, sf):
    """The map of visited pages, the last visit of each counts."""
    return crawl.latest_pages(table(spark, sf, "visited_pages")).select("key", "url", "next_url", "tag")


@query(f"""WITH RECURSIVE e AS ({LATEST}), s AS (SELECT tag, min(key) AS key FROM e WHERE tag IS NOT NULL GROUP BY tag),
 c(tag, page_no, key, path) AS (SELECT s.tag, 1::BIGINT, e.key, [e.key] FROM s JOIN e USING (key)
  UNION ALL SELECT c.tag, c.page_no + 1, n.key, list_append(c.path, n.key) FROM c JOIN e ON e.key = c.key JOIN e AS n ON n.key = {_normal('e.next_url')}
  WHERE e.next_url IS NOT NULL AND NOT list_contains(c.path, n.key))
 SELECT tag, page_no, key FROM c""")
def page_chain(spark, sf):
    """W3, D-7, J5: pages reached from each tag's first page."""
    pages = crawl.latest_pages(table(spark, sf, "visited_pages"))
    starts = pages.filter("tag is not null").groupBy("tag").agg(F.min_by("url", "key").alias("url"))
    return crawl.page_chains(starts, pages).select("tag", F.col("page_no").cast("long").alias("page_no"), "key")


def _counted(spark, sf):
    new = dedup.new_posts(table(spark, sf, "incoming_posts"), known_keys(spark, sf), ["in_id"])
    return crawl.page_counts(new, ["tag_ord", "page_ord"])


COUNTED = f"""SELECT tag_ord, page_ord, count(*) AS total_posts, count(*) FILTER (is_new) AS new_posts FROM (
 SELECT tag_ord, page_ord, key IS NOT NULL AND key NOT IN (SELECT key FROM {KNOWN}) AND row_number() OVER (PARTITION BY key ORDER BY in_id) = 1 AS is_new
 FROM (SELECT *, {KEY} AS key FROM incoming_posts)) GROUP BY ALL"""


@query(COUNTED)
def page_counts(spark, sf):
    """A1."""
    return _counted(spark, sf)


@query(f"""WITH p AS ({COUNTED}),
 g AS (SELECT *, sum((new_posts > 0)::INT) OVER (PARTITION BY tag_ord ORDER BY page_ord) AS grp FROM p),
 k AS (SELECT *, sum((total_posts > 0 AND new_posts = 0)::INT) OVER (PARTITION BY tag_ord, grp ORDER BY page_ord) AS known_run FROM g),
 s AS (SELECT tag_ord, min(page_ord) AS stop FROM k WHERE known_run >= 2 GROUP BY tag_ord)
 SELECT tag_ord, page_ord, total_posts, new_posts, known_run::BIGINT AS known_run FROM k LEFT JOIN s USING (tag_ord) WHERE stop IS NULL OR page_ord <= stop""")
def known_page_stop(spark, sf):
    """W1."""
    return crawl.until_known(_counted(spark, sf), "tag_ord", "page_ord", 2)


@query(f"SELECT tag_ord, page_ord, total_posts, new_posts FROM ({COUNTED}) QUALIFY row_number() OVER (PARTITION BY tag_ord ORDER BY page_ord) <= 3")
def max_pages(spark, sf):
    """The limit of pages a tag is the feature."""
    return crawl.first_pages(_counted(spark, sf), "tag_ord", "page_ord", 3)


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (ORDER BY tag_ord, page_ord) AS i FROM ({COUNTED})),
 r(i, file_no, n) AS (SELECT i, 0::BIGINT, total_posts FROM b WHERE i = 1
  UNION ALL SELECT b.i, CASE WHEN r.n + b.total_posts > 500 THEN r.file_no + 1 ELSE r.file_no END, CASE WHEN r.n + b.total_posts > 500 THEN b.total_posts ELSE r.n + b.total_posts END
  FROM r JOIN b ON b.i = r.i + 1)
 SELECT tag_ord, page_ord, total_posts, file_no FROM r JOIN b USING (i)""")
def rotation_buckets(spark, sf):
    """Each page is a batch."""
    return sink.rotated(_counted(spark, sf).select("tag_ord", "page_ord", "total_posts"), ["tag_ord", "page_ord"], "total_posts")


@query("SELECT file_name, count(*) AS records FROM anecdotes GROUP BY file_name")
def file_counts(spark, sf):
    """A4."""
    return sink.file_counts(table(spark, sf, "anecdotes"))


@query("SELECT coalesce(max(CAST(nullif(regexp_extract(file_name, '^anecdotes_([0-9]+)\\.json$', 1), '') AS BIGINT)), 0) + 1 AS next_index FROM anecdotes")
def next_file_index(spark, sf):
    """A5."""
    return sink.next_index(table(spark, sf, "anecdotes"))


@query("SELECT count(DISTINCT key) AS known_posts, (SELECT count(*) FROM anecdotes) AS anecdotes FROM (SELECT unnest(posts) AS key FROM visited_posts) WHERE key IS NOT NULL")
def set_sizes(spark, sf):
    """A3, A9."""
    keys = known_keys(spark, sf).agg(F.count_distinct("key").alias("known_posts"))
    return keys.crossJoin(table(spark, sf, "anecdotes").agg(F.count("*").alias("anecdotes")))  # one row each


@query("""SELECT doc_id, line::BIGINT AS line, regexp_extract(l, '^([0-9T:.Z-]+) \\[([A-Z]+)\\] ', 1) AS at, regexp_extract(l, '^([0-9T:.Z-]+) \\[([A-Z]+)\\] ', 2) AS level,
 regexp_replace(l, '^[0-9T:.Z-]+ \\[[A-Z]+\\] ', '') AS message FROM (
 SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE kind = 'log')
 WHERE regexp_matches(l, '^[0-9T:.Z-]+ \\[[A-Z]+\\] ')""")
def log_lines(spark, sf):
    """Lines of crawl logs."""
    d = table(spark, sf, "documents").filter("kind = 'log'")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    head = r"^([0-9T:.Z-]+) \[([A-Z]+)\] "
    return lines.filter(F.col("l").rlike(head)).select(
        "doc_id", (F.col("line") + 1).cast("long").alias("line"), F.regexp_extract("l", head, 1).alias("at"), F.regexp_extract("l", head, 2).alias("level"),
        F.regexp_replace("l", head, "").alias("message"))


@query("""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars * 10 / 1024.0 + 0.5) / 10) END AS size,
 CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration
 FROM (SELECT doc_id, n_chars, n_chars * 977 // 1000 AS s FROM documents WHERE n_chars IS NOT NULL)""")
def formats(spark, sf):
    """X19, X20."""
    n = F.col("n_chars")
    return table(spark, sf, "documents").filter(n.isNotNull()).select("doc_id", text.format_bytes(n).alias("size"), text.format_duration(n * 977).alias("duration"))


@query("""WITH b AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)<div class="topicbox" data-id="[^"]*"><div class="text">.*?</div>', 0)) AS box,
  generate_subscripts(regexp_extract_all(text, '(?s)<div class="topicbox" data-id="[^"]*"><div class="text">.*?</div>', 0), 1) AS i FROM documents WHERE kind = 'markup' AND text IS NOT NULL)
 SELECT doc_id, (i - 1)::BIGINT AS box_ord, regexp_extract(box, 'data-id="([^"]*)"', 1) AS id FROM b""")
def post_boxes(spark, sf):
    """Boxes of listing markup."""
    d = table(spark, sf, "documents").filter("kind = 'markup' and text is not null")
    return extract.boxes_of(d, CONFIG, "text", ["doc_id"]).filter("has_text").select("doc_id", "box_ord", "id")


@query(f"""WITH b AS (SELECT doc_id, tag_url, unnest(regexp_extract_all(text, '(?s)<div class="topicbox" data-id="[^"]*"><div class="text">.*?</div>', 0)) AS box,
  generate_subscripts(regexp_extract_all(text, '(?s)<div class="topicbox" data-id="[^"]*"><div class="text">.*?</div>', 0), 1) AS i FROM documents WHERE kind = 'markup' AND text IS NOT NULL),
 t AS (SELECT doc_id, (i - 1)::BIGINT AS box_ord, {_trim("regexp_extract(box, 'data-id=" + chr(34) + "([^" + chr(34) + "]*)" + chr(34) + "', 1)")} AS id,
  coalesce(regexp_extract(tag_url, '^(https?://[^/?#]*)', 1), 'https://example.org') AS host,
  {_tidy_sql("html_unescape(regexp_replace(regexp_replace(regexp_extract(box, '(?s)<div class=" + chr(34) + "text" + chr(34) + ">(.*)</div>$', 1), '<br>', chr(10), 'g'), '<[^>]*>', '', 'g'))")} AS post FROM b)
 SELECT doc_id, box_ord, id, post, CASE WHEN id <> '' THEN lower(host) || '/id/' || id || '/' ELSE '' END AS post_url FROM t WHERE length(post) >= 15
 QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN id <> '' THEN 'id:' || id ELSE 'txt:' || left(post, 120) END ORDER BY box_ord) = 1""".replace("html_unescape", ""))
def posts(spark, sf):
    """G2, X7, D-2: text posts of listing markup."""
    d = table(spark, sf, "documents").filter("kind = 'markup' and text is not null").select("doc_id", "tag_url", "text")
    d = d.withColumn("page", F.concat(F.coalesce("tag_url", F.lit("https://example.org/tags/x")), F.lit("/"), F.col("doc_id").cast("string")))
    return extract.posts_of(d, CONFIG, "page", "text", ["doc_id"]).select("doc_id", "box_ord", "id", F.col("text").alias("post"), "post_url")


@query(f"""WITH e AS ({LATEST}), t AS (SELECT tag, bool_or(next_url IS NULL) AS complete FROM e GROUP BY tag) SELECT * FROM t""")
def completed_tags(spark, sf):
    """W5, W6."""
    pages = crawl.latest_pages(table(spark, sf, "visited_pages"))
    outcome = crawl.page_outcome(F.lit(200), F.lit(1), F.col("next_url"))
    return crawl.completed(pages.withColumn("reached_end", outcome["reached_end"]).withColumn("is_loop", F.lit(False)), "tag")


@query("""SELECT anecdote_id, regexp_replace(url, '-[0-9]{2,5}x[0-9]{2,5}(\\.[a-zA-Z]{3,4})(\\?.*)?$', '\\1\\2') AS upgraded,
 CASE WHEN regexp_matches(seg, '[^.].*\\.[^.]*$') THEN lower(regexp_extract(seg, '\\.([^.]*)$', 1)) ELSE '' END AS extension,
 CASE WHEN name IN ('', '.', '..') THEN 'image' ELSE name END AS filename, nullif(regexp_extract(regexp_replace(seg, '\\.[A-Za-z0-9]+$', ''), '([0-9]+)$', 1), '') AS number
 FROM (SELECT *, regexp_replace(regexp_replace(coalesce(nullif(url_decode(seg), ''), 'image'), '[^a-zA-Z0-9._-]', '_', 'g'), '_+', '_', 'g') AS name FROM (
 SELECT anecdote_id, url, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', ''), '([^/]*)$', 1) AS seg FROM (
  SELECT anecdote_id, regexp_replace(url, '/([?#].*)?$', '-640x480.jpg') AS url FROM anecdotes WHERE url LIKE 'http%')))""")
def media_urls(spark, sf):
    """Parts of urls, those of anecdotes made pictures where they end in a folder."""
    rows = table(spark, sf, "anecdotes").filter("url like 'http%'").select("anecdote_id", F.regexp_replace("url", r"/([?#].*)?$", "-640x480.jpg").alias("url"))
    return rows.select("anecdote_id", urls.upgraded(F.col("url")).alias("upgraded"), urls.extension_col("url").alias("extension"),
                       urls.safe_filename_col("url").alias("filename"), urls.trailing_number_col("url").alias("number"))


@query(f"""WITH d AS (SELECT in_id, coalesce(url, '') AS url, {_normal("coalesce(url, '')")} AS key, {_hash('text')} AS sha, strlen(text) AS bytes FROM incoming_posts WHERE text IS NOT NULL AND url <> ''),
 a AS (SELECT *, CASE WHEN bytes >= 300 THEN min(CASE WHEN bytes >= 300 THEN in_id END) OVER (PARTITION BY sha) END AS fs FROM d),
 w AS (SELECT *, min(CASE WHEN fs = in_id THEN in_id END) OVER (PARTITION BY key) AS fu FROM a)
 SELECT CASE WHEN fu < in_id THEN 'duplicate' WHEN bytes < 300 THEN 'skipped' WHEN fs < in_id THEN 'duplicate' ELSE 'downloaded' END AS status,
 CASE WHEN fu < in_id THEN 'url' WHEN bytes < 300 THEN 'min-bytes' WHEN fs < in_id THEN 'hash' END AS reason, count(*) AS n FROM w GROUP BY ALL""")
def download_outcomes(spark, sf):
    """The status ladder over posts taken as downloads."""
    d = table(spark, sf, "incoming_posts").filter("text is not null and url <> ''")
    d = d.select(F.col("in_id").alias("ord"), "url", text.content_hash(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"),
                 F.lit(None).cast("string").alias("error"))
    none = spark.createDataFrame([], "normalized_url string, sha256 string")
    from dataclasses import replace

    return media.outcomes(d, none, replace(CONFIG, min_bytes=300)).groupBy("status", "reason").agg(F.count("*").alias("n"))

