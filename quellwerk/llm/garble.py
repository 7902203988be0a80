"""Repair of text that was decoded with the wrong character encoding (problem 1).

A garbled text is a node of a graph whose edges are "encode with E, decode with D" for every
pair of charsets, and "unescape".  :func:`search` walks the graph best-first: the frontier is a
heap ordered by :func:`cost`, states already seen are dropped by their hash, and the cheapest
text met is the answer.  A text counts as garbled when the answer is clearly cheaper than the
text itself.  If the whole text has no such answer, its sentences are tried, then runs of
suspicious words, so that a garbled piece inside a sound text is found too.

Everything here is plain Python over one text; :func:`irregular` and :func:`may_be_garbled`
are column expressions that keep clean rows inside the JVM.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np

from quellwerk.llm import form

# Charsets that web pages in these languages are confused among, and less usual ones.
CHARSETS = ("cp1251", "cp1252", "koi8-r", "cp866", "iso8859-5", "cp1250", "mac-cyrillic", "mac-roman", "cp437")
USUAL, RARE = CHARSETS[:5], CHARSETS[5:]
#: Bits that a less usual charset adds to the price of an operation.
RARE_BITS = 8.0
#: A state this many bits dearer than the best text met so far is not expanded, nor is anything behind it.
HORIZON = 10.0

# Bits a letter costs, from published letter frequencies of Russian/Ukrainian and
# English/German text, in alphabetical order.
CYRILLIC_BITS = dict(zip(
    "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ",
    (3.6, 6.0, 4.5, 5.9, 5.0, 3.6, 6.7, 5.9, 3.8, 6.4, 4.9, 4.5, 5.0, 3.9, 3.2, 5.1, 4.4, 4.2, 4.0,
     5.3, 8.6, 6.7, 7.7, 6.1, 7.1, 8.1, 10.5, 5.7, 5.8, 8.3, 7.3, 5.6, 9.0, 4.8, 7.5, 7.5, 11.0), strict=True))
LATIN_BITS = dict(zip(
    "abcdefghijklmnopqrstuvwxyzäöüß",
    (3.7, 6.0, 5.2, 4.6, 3.0, 5.5, 5.4, 4.2, 3.8, 9.0, 6.5, 4.7, 5.3, 3.8, 3.8, 5.7, 10.0, 4.0, 4.0,
     3.6, 5.0, 6.7, 5.6, 9.0, 6.2, 8.0, 7.0, 7.5, 7.0, 7.5), strict=True))
PLAIN_SIGNS = set(" \n\t\r.,!?:;-()\"'…—–«»“”„’‘0123456789")
LESS_PLAIN_SIGNS = set("°£€№§%&/+*=_@#$<>[]{}|~^`\\")

def _tables() -> tuple[dict[str, dict[int, int]], dict[str, str]]:
    """Byte tables of each charset; bytes that a charset leaves undefined stand for themselves."""
    to_byte, to_char = {}, {}
    for name in CHARSETS:
        to_char[name] = "".join(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))
        to_byte[name] = {ord(c): b for b, c in enumerate(to_char[name])}
        if name in ("cp1252", "cp1251"):  # pages labelled so are read by browsers with C1 controls kept
            for b in range(0x80, 0xA0):
                to_byte[name].setdefault(b, b)
    return to_byte, to_char


def _bits(c: str) -> float:
    """Cost of a character by itself."""
    low = c.lower()
    if low in CYRILLIC_BITS:
        return CYRILLIC_BITS[low]
    if low in LATIN_BITS:
        return LATIN_BITS[low]
    if c in PLAIN_SIGNS:
        return 4.0
    if c in LESS_PLAIN_SIGNS:
        return 6.0
    if c == "\ufffd":
        return 30.0
    if c < " " or "\x7f" <= c < "\xa0":
        return 16.0
    if "─" <= c <= "◿":
        return 14.0
    if c.isalpha():
        return 7.0 if "À" <= c <= "ÿ" else 11.0 if c <= "ɏ" else 12.0 if "Ѐ" <= c <= "ӿ" else 8.0
    if c == "\xad":
        return 10.0
    if c.isspace() or unicodedata.category(c) == "Cf" or "＀" <= c <= "￯" or unicodedata.category(c)[0] == "M":
        return 6.0
    return 12.0


_TO_BYTE, _TO_CHAR = _tables()
_BITS = np.array([_bits(chr(i)) if not 0xD800 <= i < 0xE000 else 16.0 for i in range(0x10000)], np.float32)
_BYTE_BITS = np.array([[_BITS[ord(c)] for c in _TO_CHAR[d]] for d in CHARSETS], np.float32)
_CYR = "Ѐ-ӿ"
_LAT = "A-Za-zÀ-ÖØ-öø-ɏ"
_MIXED = re.compile(f"[{_LAT}{_CYR}]+")
_SEAM = re.compile(f"[{_LAT}][{_CYR}]|[{_CYR}][{_LAT}]")
_HUMP = re.compile("[a-zß-öø-ÿа-яёіїєґ][A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ]")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ](?=[A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ])")
_SWITCH = re.compile(f"[{_LAT}][^{_LAT}{_CYR}]+(?=[{_CYR}])|[{_CYR}][^{_LAT}{_CYR}]+(?=[{_LAT}])")
_ACCENTS = re.compile("[À-ÖØ-öø-ɏ](?=[À-ÖØ-öø-ɏ])")
_INSIDE = re.compile(f"[{_LAT}{_CYR}][^\\w\\s'’.\\-­\\u200b-\\u200f\\u2060\\ufeff\\u0300-\\u036f][{_LAT}{_CYR}]")
_ALIKE = set(form._CLASS)


def _seams(text: str) -> float:
    """Weighted number of places inside words where the script changes."""
    n = 0.0
    if _SEAM.search(text):
        for word in _MIXED.findall(text):
            if k := len(_SEAM.findall(word)):
                n += k if len({c > "Ѐ" for c in word if c not in _ALIKE}) > 1 else 0.5 * k
    return n


def _folded(text: str) -> str:
    """`text` with look-alike letters made letters of their word's script."""
    if not _SEAM.search(text):  # no word of two scripts
        return text
    return _MIXED.sub(lambda m: form.fold_word(m.group()), text)


def _units(text: str) -> float:
    raw = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    return float(_BITS[raw].sum())


def _shape(text: str) -> float:
    """Bits for how the characters stand together."""
    if text.isascii():
        return 5.0 * len(_HUMP.findall(text)) + 0.4 * len(_CAPITALS.findall(text))
    return (9.0 * _seams(text) + 5.0 * len(_HUMP.findall(text)) + 0.4 * len(_CAPITALS.findall(text)) + 4.0 * len(_SWITCH.findall(text))
            + 5.0 * len(_ACCENTS.findall(text)) + 8.0 * len(_INSIDE.findall(text)))


def cost(text: str) -> float:
    """Bits that `text` takes under the character model; lower is more plausible.  "" costs 0."""
    return _units(text) + _shape(text)


_ESCAPE = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m.group()
        return chr(int(s[2:], 16)) if s[0] == "\\" else html.unescape(s)

    return _ESCAPE.sub(one, text)


def neighbours(text: str, below: float = float("inf"), price: float = 10.0, charsets: tuple[str, ...] = CHARSETS):
    """(text, cost) one operation away from `text`, those that can cost less than `below`.

    The operations are unescape, and encode with one charset followed by decode with another.
    Their own price is in the cost: 4 bits for reading bytes as UTF-8, `price` for another charset.
    """
    if _ESCAPE.search(text):
        t = _unescape(text)
        yield t, cost(t) + 4.0
    if text.isascii():
        return
    for enc in charsets:
        extra = RARE_BITS * (enc in RARE)
        try:
            raw = codecs.charmap_encode(text, "strict", _TO_BYTE[enc])[0]
        except UnicodeEncodeError:
            continue
        try:
            t = raw.decode("utf-8")
        except UnicodeDecodeError:
            units = _BYTE_BITS[:len(charsets), np.frombuffer(raw, np.uint8)].sum(1)
            for dec, u in zip(charsets, units, strict=True):
                paid = price + extra + RARE_BITS * (dec in RARE)
                if dec != enc and u + paid < below:
                    t = codecs.charmap_decode(raw, "strict", _TO_CHAR[dec])[0]
                    yield t, float(u) + paid + _shape(t)
        else:
            yield t, cost(t) + 4.0 + extra


def search(text: str, price: float = 10.0, charsets: tuple[str, ...] = CHARSETS, depth: int | None = None,
           expansions: int | None = None, enough: Callable[[float, float], bool] | None = None) -> tuple[str, float, float]:
    """Cheapest text reachable from `text`: (text, its cost, cost of the original).  `charsets` are the first ones of CHARSETS.

    Best-first: the cheapest open state is expanded next, so the search ends with the first
    state that lies beyond the HORIZON of the best text met.  Each operation adds its price to all states behind it,
    which keeps the search finite.  `depth` and `expansions` can limit it
    further and are off by default.  Among equal costs the smaller text is taken first.
    With `enough` the search ends with the first text whose cost, beside that of the original, is enough.
    """
    start = cost(text)
    if _SEAM.search(text):  # look-alike letters are a matter of spelling, not of encoding
        start = min(start, cost(_folded(text)) + 2.0)
    best, best_cost = text, start
    seen, heap = {hash(text)}, [(start, text, 0, 0.0)]
    while heap and expansions != 0:
        c, state, at, paid = heapq.heappop(heap)
        if c > best_cost + HORIZON:
            break
        if at == depth:
            continue
        expansions = expansions and expansions - 1
        for nxt, k in neighbours(state, best_cost + HORIZON - paid, price, charsets):
            if (h := hash(nxt)) in seen:
                continue
            seen.add(h)
            own = k + paid
            if own < best_cost:
                best, best_cost = nxt, own
                if enough and enough(own, start):
                    return best, best_cost, start
            if own < best_cost + HORIZON:
                heapq.heappush(heap, (own, nxt, at + 1, own - cost(nxt)))
    return best, best_cost, start


_search_word = lru_cache(100_000)(search)  # odd words come up again and again


def _better(now: float, before: float, margin: float = 12.0) -> bool:
    return before - now >= margin and now <= (1 - margin / 600) * before


def _cleared(text: str, best: str, now: float, before: float) -> bool:
    """Whether `best` is sound while `text` has words of two scripts that no look-alikes explain: then less has to be saved."""
    return before - now >= 2.0 and _seams(_folded(text)) > 0 and not _suspicious(best)


_SENTENCES = re.compile(r"(?<=[.!?])(?=[ \n])|(?<=\n)")
_SOUND = "\\x00-\\x7fА-Яа-яЁёІіЇїЄєҐґÄÖÜäöüß«»“”„’‘…–—№ ­\u2000-\u200f\u202f\u2060\u3000\ufeff！-～ﬀ-ﬆ̀-ͯΑ-ω"
# accented letters are sound between plain letters, not in a row or beside other signs
_ODD = re.compile(f"[^{_SOUND}À-ÖØ-öø-ÿ°£]|[À-ÃÅ-ÕØ-ÛÝÞà-ãå-õø-ûýþÿ](?:[^\\x00-\\x7f«»“”„’‘…–—  ]|(?![A-Za-z]))(?<![a-zA-Z].)|"
                  "[À-ÃÅ-ÕØ-ÛÝÞà-ãå-õø-ûýþÿ][^\\x00-\\x7f«»“”„’‘…–—  ]|[^\\x00-\\x7f«»“”„’‘…–—  ][À-ÃÅ-ÕØ-ÛÝÞà-ãå-õø-ûýþÿ]|[°£][^\\x00-\\x7f]|[^\\x00-\\x7f][°£]")
_CASES = re.compile("[а-яёіїєґ][А-ЯЁІЇЄҐ]|[А-ЯЁІЇЄҐ]{3}")


def _suspicious(piece: str) -> bool:
    return bool(_ODD.search(piece) or _CASES.search(piece) or _seams(piece) or _ESCAPE.search(piece))


def garbled(text: str | None) -> bool:
    """Whether a text is garbled: what `repair` says, without looking for the best repair once there is one."""
    return repair(text, tell=True)[0]


def repair(text: str | None, tell: bool = False) -> tuple[bool, str | None]:
    """(garbled?, text as it was meant).  With `tell` only the first counts, and any repair that is good enough settles it.

    None and texts without suspicious characters give (False, text).  A text holding U+FFFD was
    decoded with the wrong charset beyond repair: it is garbled, and those places stay U+FFFD.
    """
    if text is None or not text:
        return False, text
    lost = "�" in text
    if lost and tell:
        return True, text
    if not _suspicious(text):
        return lost, text
    if not lost and _SEAM.search(text) and not _suspicious(_folded(text)):
        return False, text
    found, best = _repaired(text, lost, USUAL, tell)
    if found and tell:
        return True, best
    if _ODD.search(best):  # less usual charsets where the others leave signs that sound text doesn't have
        also, other = _repaired(text, lost, CHARSETS)
        if also and cost(other) + 3 * RARE_BITS < cost(best):
            found, best = True, other
    return lost or found, best if found else text


def _repaired(text: str, lost: bool, charsets: tuple[str, ...], tell: bool = False) -> tuple[bool, str]:
    best, now, before = search(text, charsets=charsets, enough=_better if tell else None)
    found = _better(now, before) or _cleared(text, best, now, before)
    if found and (tell or lost or not _suspicious(best)):
        return True, best
    found_in, pieced = _pieces(text, charsets, tell=tell)
    if found_in and (not found or cost(pieced) < now):
        return True, pieced
    return found, best if found else text


@lru_cache(50_000)
def _odd(word: str) -> bool:
    return bool(_ODD.search(word) or _ESCAPE.search(word) or _seams(_folded(word)))


def _runs(marks: list[int]) -> set[tuple[int, int]]:
    """Ranges of words to try: from the first mark to the last, marks side by side, single ones."""
    if not marks:
        return set()
    cuts = [0, *(k for k in range(1, len(marks)) if marks[k] > marks[k - 1] + 2), len(marks)]
    beside = {(marks[i], marks[j - 1] + 1) for i, j in zip(cuts[:-1], cuts[1:], strict=True)}
    return {(marks[0], marks[-1] + 1), *beside, *((i, i + 1) for i in marks)}


def _pieces(text: str, charsets: tuple[str, ...], margin: float = 12.0, tell: bool = False) -> tuple[bool, str]:
    found, out = False, []
    for piece in _SENTENCES.split(text):
        if not piece or not _suspicious(piece):
            out.append(piece)
            continue
        best, now, before = search(piece, min(10.0, margin), charsets, enough=partial(_better, margin=margin) if tell else None)
        if _better(now, before, margin) or _cleared(piece, best, now, before):
            if tell:
                return True, text
            found = True
            out.append(best)
            continue
        words = re.split(r"([ \t\r\n]+)", piece)
        odd = [i for i in range(0, len(words), 2) if words[i] and _odd(words[i])]
        marks = [i for i in range(0, len(words), 2) if words[i] and (i in odd or _CASES.search(words[i]))]
        tried = []
        for a, b in _runs(marks) | _runs(odd):
            single = b - a == 1
            # among other odd words, or if only its capitals are odd, a single word needs more evidence
            strict = single and odd != [a]
            best, now, before = (_search_word if single else search)("".join(words[a:b]), 10.0, charsets)
            if before - now >= 16 and now <= 0.75 * before if strict else _better(now, before):
                if tell:
                    return True, text
                tried.append((now - before, a, b, best))
        done = set()  # places of repaired words
        for _, a, b, best in sorted(tried):  # what saves most first
            if not done.intersection(range(a, b)):
                words[a:b] = [best] + [""] * (b - a - 1)
                done.update(range(a, b))
                found = True
        out.append("".join(words) if done else piece)
    text = "".join(out)
    if found and margin > 1.0:  # its other pieces were probably misread the same way: less evidence will do
        return True, _pieces(text, charsets, 1.0)[1]
    return found, text
