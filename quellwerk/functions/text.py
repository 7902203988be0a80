"""Text functions as column expressions (X4-X6, X19, X20, X23, F3, D-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of ECMAScript, for Java and RE2 alike.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def js_trim(s: Column) -> Column:
    """`s` without leading and trailing white space of any kind; null stays null."""
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def collapse(s: Column) -> Column:
    """`s` trimmed, runs of white space made one space."""
    return F.regexp_replace(js_trim(s), f"{SPACE}+", " ")


def content_hash(s: Column) -> Column:
    """SHA-256 in hex of the collapsed text (X5); case counts, null stays null."""
    return F.sha2(F.encode(collapse(s), "UTF-8"), 256)


def post_key(id: Column, text: Column) -> Column:
    """Key of a known post (X6): by its trimmed id, else by the hash of its text; null without both."""
    own = js_trim(id)
    return F.when(own != "", F.concat(F.lit("anek:id:"), own)).when(text != "", F.concat(F.lit("anek:txt:"), content_hash(text)))


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def tidy(s: Column) -> Column:
    """Post text tidied, its line breaks kept (X4).  The steps' order matters."""
    # What is replaced, in this order.
    for pattern, to in ((r"\x{A0}", " "), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        s = F.regexp_replace(s, pattern, to)
    return js_trim(s)


def clean_tags(tags: Column) -> Column:
    """Tags trimmed, blanks and repeats dropped, order kept (D-6, F12); null gives []."""
    kept = F.filter(F.transform(tags, js_trim), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def utf16_start(s: Column, n: int) -> Column:
    """First `n` UTF-16 units of a text (O4); half of a character becomes U+FFFD."""
    head = F.substring(s, 1, n)  # at least as many units
    units = F.substring(F.hex(F.encode(head, "UTF-16BE")), 1, 4 * n)
    half = units.rlike("D[89AB]..$")
    cut = F.concat(F.decode(F.unhex(F.when(half, F.regexp_replace(units, "....$", "")).otherwise(units)), "UTF-16BE"), F.when(half, F.lit("\ufffd")).otherwise(F.lit("")))
    return F.when(head.rlike(r"[\x{10000}-\x{10FFFF}]"), cut).otherwise(head)


def preview(s: Column, n: int = 50) -> Column:
    """First `n` UTF-16 units on one line, as log lines show a text."""
    return F.concat(F.replace(utf16_start(s, n), F.lit("\n"), F.lit(" ")), F.lit("..."))


def format_bytes(n: Column) -> Column:
    """1023 B, 1.0 KB, 1.5 MB ... capped at GB."""
    k, size = 1024.0, n.cast("double")
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1024**2, F.format_string("%.1f KB", size / k)).when(n < 1024**3, F.format_string("%.1f MB", size / k**2))
            .otherwise(F.format_string("%.1f GB", size / k**3)))


def format_duration(ms: Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s."""
    s = F.floor(ms / 1000)
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, rest)).when(m > 0, F.format_string("%dm %02ds", m, rest))
            .otherwise(F.format_string("%ds", rest)))
