"""Records from HTML pages.

An Arrow UDF builds the tree and emits plain facts (attributes, texts, flags) in document order;
every rule over them is SQL, so it can be pushed, pruned and read in a plan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.config import Config
from quellwerk.functions import urls
from quellwerk.functions.html import matches, select, tree
from quellwerk.functions.text import js_trim, tidy, utf16_length
from quellwerk.operators.dedup import first_wins

# Elements that make a post something else than text.
MEDIA = "img, video, iframe, picture, source, object, embed"


def _facts(fields: str, one):
    schema = T.ArrayType(T.StructType([T.StructField(n, {"b": T.BooleanType(), "i": T.LongType()}.get(k, T.StringType()))
                                       for n, _, k in (f.partition(":") for f in fields.split())]))

    @F.pandas_udf(schema)
    def udf(html: pd.Series) -> pd.Series:
        return pd.Series([[] if h is None else one(tree(h)) for h in html])

    return udf


def anchors(html: Column, selector: str) -> Column:
    """Array of (ord, href, label) of the selected elements; null html gives []."""
    return _facts("ord:i href label", lambda root: [(i, a.attrs.get("href"), a.text()) for i, a in enumerate(select(root, selector))])(html)


def tags_of(pages: DataFrame, config: Config, url: str = "url", html: str = "html") -> DataFrame:
    """(url, tag_ord, tag_url, name): the tag links of index pages (G1).

    Links without href, to other schemes or outside /tags/ are dropped; of links to one
    normalised url a page's first is kept.
    """
    a = pages.select(F.col(url).alias("page"), F.explode(anchors(F.col(html), config.tag_link)).alias("a"))
    a = a.select("page", "a.ord", urls.resolve_url_col(F.when(F.col("a.href") != "", F.col("a.href")), "page").alias("tag_url"))
    path = F.regexp_replace(F.regexp_extract("tag_url", r"^https?://[^/?#]*([^?#]*)", 1), "", "")
    a = a.filter(path.rlike("/tags/[^/]+")).withColumn("_key", urls.normalize_url_col("tag_url"))
    a = first_wins(a, ["page", "_key"], ["ord"])
    return a.select(F.col("page").alias("url"), F.col("ord").alias("tag_ord"), "tag_url", urls.tag_name_col("tag_url").alias("name"))


def boxes_of(pages: DataFrame, config: Config, html: str = "html", keep: list[str] = ()) -> DataFrame:
    """One row a post box with its facts: (keep, box_ord, is_ad, has_text, has_media, raw, id)."""

    def one(root):
        out = []
        for i, box in enumerate(select(root, config.post)):
            body = next(iter(select(box, config.post_text)), None)
            ad = bool(config.ad) and any(matches(n, config.ad) for n in box.up())
            out.append((i, ad, body is not None, body is not None and bool(select(body, MEDIA)), body.text(br="\n") if body else None, box.attrs.get("data-id")))
        return out

    facts = _facts("box_ord:i is_ad:b has_text:b has_media:b raw id", one)
    return pages.select(*keep, F.inline(facts(F.col(html)))).withColumn("id", F.coalesce(js_trim("id"), F.lit("")))


def posts_of(pages: DataFrame, config: Config, url: str = "url", html: str = "html", keep: list[str] = ()) -> DataFrame:
    """(keep, url, box_ord, id, text, post_url): text posts of listing pages.

    Advertisements, boxes without text or with media, and texts shorter than the least number of
    UTF-16 units are dropped; of posts with one id (or, without id, one beginning of 120 units) a
    page's first is kept.  post_url is "" without id.
    """
    keep = list(dict.fromkeys([*keep, url]))
    b = boxes_of(pages, config, html, keep).filter("not is_ad and has_text and not has_media").withColumn("text", tidy(F.col("raw")))
    b = b.filter(utf16_length(F.col("text")) >= (config.min_length or 15))
    start = F.substring(F.hex(F.encode("text", "UTF-16BE")), 1, 480)
    b = first_wins(b.withColumn("_key", F.when(F.col("id") != "", F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("txt:"), start))), [url, "_key"], ["box_ord"])
    link = urls.resolve_url_col(F.concat(F.lit("/id/"), "id", F.lit("/")), url)
    return b.select(*keep, "box_ord", "id", "text", F.when(F.col("id") != "", F.coalesce(link, F.lit(""))).otherwise("").alias("post_url"))


def next_pages(pages: DataFrame, config: Config, url: str = "url", html: str = "html") -> DataFrame:
    """(url, next_url) of listing pages: by link text or first link, then by pattern (X8-X10); null at the end."""
    a = F.filter(anchors(F.col(html), config.next_page), lambda x: F.contains(F.lower(js_trim(x["label"])), F.lit(config.next_text.lower()))) \
        if config.next_text else anchors(F.col(html), config.next_page)
    p = pages.select(F.col(url).alias("url"), F.get(a, F.lit(0))["href"].alias("_href"))
    p = p.withColumn("_link", urls.resolve_url_col(F.when(F.col("_href") != "", F.col("_href")), "url"))
    other = urls.normalize_url_col("_link") != urls.normalize_url_col("url")
    by_link = F.when(other, F.col("_link"))
    found = F.coalesce(by_link, urls.next_by_pattern_col(config.url_pattern)("url")) if config.url_pattern else by_link
    return p.select("url", found.alias("next_url"))


def largest_of_srcset(srcset: Column) -> Column:
    """Url of the widest candidate (G4); candidates without a width rank 0, the last of equals wins."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: p[0] != "")
    width = lambda p: F.when(F.size(p) > 1, F.coalesce(F.regexp_extract(p[1], r"^(\d+).*w$", 1).try_cast("int"), F.lit(0))).otherwise(0)
    return F.array_max(F.transform(parts, lambda p, i: F.struct(width(p).alias("w"), i.alias("i"), p[0].alias("u"))))["u"]


def images_of(pages: DataFrame, config: Config, url: str = "url", html: str = "html", sizes: DataFrame | None = None) -> DataFrame:
    """(url, image_url, width, height): pictures and videos of post pages (G3, U1, D-4, F7-F10).

    Candidates are links to media files, the picture attributes, the largest of a srcset, videos
    and page hints.  Size suffixes are stripped, the first of equal normalised urls is kept, the
    lists of extensions and blocked words apply.  `sizes` (image_url, width, height) are probed
    dimensions: pictures below the least size are dropped, unknown sizes and videos stay 0 x 0.
    """

    def one(root):
        scope = (select(root, config.post_content) or [root])[0]
        out = [("link", a.attrs.get("href"), None) for a in select(scope, "a")]
        for img in select(scope, "img"):
            out += [("img", img.attrs.get(k), None) for k in ("data-large-file", "data-original", "data-src", "src")] + [("img", None, img.attrs.get("srcset"))]
        out += [("video", v.attrs.get("src"), None) for v in select(scope, "video, video source")]
        out += [("hint", m.attrs.get("content"), None) for m in select(root, '[property="og:image"], [name="og:image"]') if m.tag == "meta"]
        out += [("hint", m.attrs.get("href"), None) for m in select(root, 'link[rel="image_src"]')]
        return [(i, *x) for i, x in enumerate(out)]

    c = pages.select(F.col(url).alias("url"), F.inline(_facts("ord:i kind href srcset", one)(F.col(html))))
    href = F.coalesce(F.when(F.col("href") != "", F.col("href")), largest_of_srcset(F.col("srcset")))
    c = c.withColumn("image_url", urls.upgraded(urls.resolve_url_col(href, "url"))).filter("image_url is not null")
    ext = urls.extension_col("image_url")
    media = [*config.image_extensions, *config.video_extensions]
    blocked = F.exists(F.array(*map(F.lit, config.blocked)), lambda p: F.contains(F.lower("image_url"), p)) if config.blocked else F.lit(False)
    c = first_wins(c.withColumn("_key", urls.normalize_url_col("image_url")), ["url", "_key"], ["ord"]).withColumn("_ext", ext)
    c = c.filter(F.col("_ext").isin(media) & ~blocked)
    if sizes is None:
        return c.select("url", "image_url", F.lit(0).alias("width"), F.lit(0).alias("height"))
    c = c.join(sizes, "image_url", "left")
    video = F.col("_ext").isin(list(config.video_extensions))
    fits = F.col("width").isNull() | ((F.col("width") >= config.min_width) & (F.col("height") >= config.min_height))
    known = lambda x: F.when(video | F.col(x).isNull(), 0).otherwise(F.col(x)).alias(x)
    return c.filter(video | fits).select("url", "image_url", known("width"), known("height"))
