"""URL functions after the WHATWG URL Standard, for http and https.

Plain functions over one value, and Arrow UDFs of the same names with `_col`.  Python's urljoin
is no substitute: it keeps host case, default ports, spaces and non-ASCII characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_PORT = {"http": 80, "https": 443}
# What the standard's percent-encode sets add to controls and non-ASCII.
PATH_SET, QUERY_SET, FRAGMENT_SET, USER_SET = ' "#<>?`{}^', ' "#<>\'', ' "<>`', " \"#<>?`{}/:;=@[\\]^|"
FORBIDDEN_HOST = set("\0\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(i) for i in range(32)}


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port is not None else "")

    def __str__(self) -> str:
        at = f"{self.user}@" if self.user else ""
        out = f"{self.scheme}://{at}{self.origin.split('://', 1)[1]}{self.path}"
        return out + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


def _encode(s: str, more: str) -> str:
    return "".join(c if " " <= c <= "~" and c not in more else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def percent_decode(s: str) -> bytes:
    return re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "replace"))


def _host(raw: str) -> str | None:
    host = percent_decode(raw).decode("utf-8", "replace")
    if not host.isascii():
        try:
            host = ".".join(p.encode("idna").decode() if not p.isascii() else p for p in host.lower().split("."))
        except UnicodeError:
            return None
    host = host.lower()
    if not host or set(host) & FORBIDDEN_HOST:
        return None
    last = host.rstrip(".").rsplit(".", 1)[-1]
    if last.isdigit() or re.fullmatch("0x[0-9a-f]*", last):
        return _ipv4(host.removesuffix("."))
    return host


def _ipv4(host: str) -> str | None:
    try:
        parts = [int(p, 16) if p.startswith("0x") and len(p) > 2 else 0 if p == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p)
                 for p in host.split(".")]
    except ValueError:
        return None
    if len(parts) > 4 or any(p > 255 for p in parts[:-1]) or parts[-1] >= 256 ** (5 - len(parts)):
        return None
    n = sum(p << 8 * (3 - i) for i, p in enumerate(parts[:-1])) + parts[-1]
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _path(segments: list[str], rest: str) -> str:
    parts = re.split(r"[/\\]", rest)
    for i, part in enumerate(parts):
        kind, last = part.lower().replace("%2e", "."), i == len(parts) - 1
        if kind == "..":
            if segments:
                segments.pop()
            if last:
                segments.append("")
        elif kind == ".":
            if last:
                segments.append("")
        else:
            segments.append(_encode(part, PATH_SET))
    return "/" + "/".join(segments)


def parse(url: str | None, base: Url | None = None) -> Url | None:
    """Parsed http(s) url, relative to `base` if need be; None for other schemes and invalid input."""
    if url is None:
        return None
    s = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    s, hash_, fragment = s.partition("#")
    fragment = _encode(fragment, FRAGMENT_SET) if hash_ else None
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", s)
    scheme = m[1].lower() if m else None
    if scheme and scheme not in DEFAULT_PORT:
        return None
    rest = s[m.end():] if m else s
    if scheme and not (base and base.scheme == scheme and rest[:1] not in ("/", "\\")):
        rest = "//" + rest.lstrip("/\\")
    elif not base:
        return None
    scheme = scheme or base.scheme
    rest, mark, query = rest.partition("?")
    query = _encode(query, QUERY_SET) if mark else None
    if re.match(r"[/\\]{2}", rest):
        authority = re.split(r"[/\\]", rest.lstrip("/\\") if m else rest[2:].lstrip("/\\"), maxsplit=1)
        user, at, where = authority[0].rpartition("@")
        h = re.fullmatch(r"(.*?)(?::(\d*))?", where)
        host = _host(h[1]) if h else None
        port = int(h[2]) if h and h[2] else None
        if host is None or (port or 0) > 65535:
            return None
        if at:
            name, colon, word = user.partition(":")
            user = _encode(name, USER_SET) + (":" + _encode(word, USER_SET) if colon and word else "")
        return Url(scheme, user, host, None if port == DEFAULT_PORT[scheme] else port, _path([], authority[1]) if len(authority) > 1 else "/",
                   query, fragment)
    if rest[:1] in ("/", "\\") and rest:
        return replace(base, path=_path([], rest[1:]), query=query, fragment=fragment)
    if rest:
        return replace(base, path=_path(base.path.split("/")[1:-1], rest), query=query, fragment=fragment)
    return replace(base, query=query if mark else base.query, fragment=fragment)


def resolve_url(href: str | None, base: str | None) -> str | None:
    """`href` made absolute (X1); None unless the result is http(s)."""
    if href is None:
        return None
    url = parse(href, parse(base))
    return str(url) if url else None


def _form(query: str) -> list[tuple[str, str]]:
    out = []
    for part in query.split("&"):
        if part:
            name, _, value = part.replace("+", " ").partition("=")
            out.append((percent_decode(name).decode("utf-8", "replace"), percent_decode(value).decode("utf-8", "replace")))
    return out


def _form_encode(s: str) -> str:
    return "".join("+" if c == " " else c if c.isascii() and (c.isalnum() or c in "*-._") else "".join(f"%{b:02X}" for b in c.encode("utf-8"))
                   for c in s)


def normalize_url(url: str | None) -> str | None:
    """Key of a url (X2): no fragment, parameters stably sorted by name, one trailing slash less.  Invalid input stays."""
    u = parse(url)
    if u is None:
        return url
    pairs = sorted(_form(u.query or ""), key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
    query = "&".join(f"{_form_encode(k)}={_form_encode(v)}" for k, v in pairs) or None
    return str(replace(u, fragment=None, query=query)).removesuffix("/")


def decode_component(s: str) -> str:
    """Percent-decoded text, the input itself if it is malformed."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", s):
        return s
    try:
        return percent_decode(s).decode("utf-8")
    except UnicodeDecodeError:
        return s


def tag_name(url: str | None) -> str:
    """Name of a tag (X3): its url's last segment, or the one before if that is a number."""
    u = parse(url)
    parts = [p for p in u.path.split("/") if p] if u else []
    if not parts:
        return ""
    numbered = re.fullmatch(r"[0-9]+", parts[-1]) and len(parts) > 1
    return decode_component(parts[-2 if numbered else -1])


def next_by_pattern(url: str | None, pattern: str) -> str | None:
    """Next page by a pattern with `{n}` (X10), relative to the origin; page 2 from a listing's root."""
    u = parse(url)
    if u is None or not pattern:
        return None
    before, _, after = pattern.partition("{n}")
    m = re.search(re.escape(before) + "([0-9]+)" + re.escape(after), u.path + (f"?{u.query}" if u.query else ""))
    if m:
        n = int(m[1]) + 1
    elif u.path.rstrip("/") in ("", before.split("?")[0].rstrip("/")):
        n = 2
    else:
        return None
    return resolve_url(pattern.replace("{n}", str(n), 1), u.origin + "/")


def _last_segment(url: str | None) -> str:
    """Last part of the path of a url, absolute or not."""
    if url is None:
        return ""
    u = parse(url)
    path = u.path if u else re.split(r"[?#]", url.strip().replace("\\", "/"), maxsplit=1)[0]
    return path.rsplit("/", 1)[-1]


def extension(url: str | None) -> str:
    """Lower-cased extension of a url's path (X12), "" without one; leading dots are no extension."""
    m = re.search(r"(?!^)\.([^.]*)$", _last_segment(url).lstrip(".") and _last_segment(url))
    return m[1].lower() if m else ""


def safe_filename(url: str | None) -> str:
    """File name from a url (X14): other characters than letters, digits, dot, dash become one _."""
    u = parse(url)
    name = decode_component(u.path.rsplit("/", 1)[-1]) if u else ""
    # Fixed value: the characters that stay.
    name = re.sub("_+", "_", re.sub(r"[^a-zA-Z0-9._-]", "_", name or "image"))
    return "image" if name in ("", ".", "..") else name


def trailing_number(url: str | None) -> str | None:
    """Digits at the end of a file's stem (X16), as written; None without."""
    m = re.search(r"(\d+)$", re.sub(r"\.[A-Za-z0-9]+$", "", _last_segment(url)), re.ASCII)
    return m[1] if m else None


def _udf(f):
    @F.pandas_udf(T.StringType())
    def one(a: pd.Series) -> pd.Series:
        known: dict = {}  # urls repeat
        return a.map(lambda x: known[x] if x in known else known.setdefault(x, f(x)), na_action="ignore")

    return one


normalize_url_col = _udf(normalize_url)
tag_name_col = _udf(tag_name)
extension_col = _udf(extension)
safe_filename_col = _udf(safe_filename)
trailing_number_col = _udf(trailing_number)


@F.pandas_udf(T.StringType())
def resolve_url_col(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_url(h, b) for h, b in zip(href, base, strict=True)], dtype=object)


def next_by_pattern_col(pattern: str):
    return _udf(lambda u: next_by_pattern(u, pattern))


def upgraded(url):
    """Url without a `-WxH` size suffix before its extension (X18); a column expression."""
    return F.regexp_replace(url, r"-\d{2,5}x\d{2,5}(\.[a-zA-Z]{3,4})(\?.*)?$", "$1$2")
