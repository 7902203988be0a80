"""The consistent form of a text (problem 7).

Terms: *form* - the consistent form; *letters* - its letters and digits, lower-cased; *words* -
the set of maximal runs of letters and digits of the lower-cased form.  A garbled text has no
letters and no words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import regex

# Letters that look the same, a column for each of Latin, Cyrillic and Greek; a
# blank where a script has no such letter.
LATIN = "ABCEHIJKMNOPSTXYZaceijopsxyvuëïËÏ"
CYRILLIC = "АВСЕНІЈКМ ОРЅТХУ асеіјорѕху  ёїЁЇ"
GREEK = "ΑΒϹΕΗΙͿΚΜΝΟΡ ΤΧΥΖαϲ ιϳορ χγνυ    "
SCRIPTS = ("latin", "cyrillic", "greek")

_ALIKE: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}  # script -> foreign letter -> its own letter
_CLASS: dict[str, str] = {}  # letter -> representative of its look-alikes
for _row in zip(LATIN, CYRILLIC, GREEK, strict=True):
    for _s, _own in zip(SCRIPTS, _row, strict=True):
        for _c in _row:
            if _c != " " and _own != " " and _c != _own:
                _ALIKE[_s][_c] = _own
    for _c in _row:
        if _c != " ":
            _CLASS[_c] = _row[0]
# The Greek capital nu is drawn like the Latin N, but also written for the Cyrillic letter of its sound.
_ALIKE["cyrillic"]["Ν"] = "Н"
ALIKE_FROM = "".join(c for c, r in _CLASS.items() if c != r)
ALIKE_TO = "".join(r for c, r in _CLASS.items() if c != r)
_TO_CLASS = str.maketrans(ALIKE_FROM, ALIKE_TO)

_LETTERS = {"latin": "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ", "cyrillic": "Ѐ-ԯ", "greek": "Ͱ-ͳͶ-ͽͿΆΈ-Ͽἀ-῾"}
_WORD = re.compile("[" + "".join(_LETTERS.values()) + "̀-ͯ]+")
_TWO = re.compile("|".join(f"[{a}]̀*[{b}]" for x, a in _LETTERS.items() for y, b in _LETTERS.items() if x != y))

def script(c: str) -> str | None:
    return ("latin" if c < "Ͱ" or "Ḁ" <= c <= "ỿ" else "cyrillic" if "Ѐ" <= c <= "ԯ" else
            "greek" if c < "Ѐ" or "ἀ" <= c <= "῿" else None) if c.isalpha() else None


@lru_cache(50_000)  # words come up again and again
def fold_word(word: str) -> str:
    """`word` with its foreign look-alike letters made letters of its own script.

    Its own script is the one of its letters that look like no other script's.  If it has no such
    letters it is the script of most letters, the first on a tie; if it has them of two scripts
    the word stays as it is.
    """
    own = {script(c) for c in word if c not in _CLASS} - {None}
    if len(own) > 1:
        return word
    if own:
        to = own.pop()
    else:
        kinds = [k for c in word if (k := script(c))]
        if len(set(kinds)) < 2:
            return word
        to = max(kinds, key=lambda k: (kinds.count(k), -kinds.index(k)))
    return word.translate(_TRANSLATE[to])


_TRANSLATE = {s: str.maketrans(t) for s, t in _ALIKE.items()}


def _ignorable(c: str) -> bool:
    return (unicodedata.category(c) in ("Cf", "Cc") and c not in "\t\n\r\v\f\x85") or c in "͏ᅟᅠ឴឵" or "︀" <= c <= "️"


class _Gone(dict):
    """Translation that removes ignorables and makes each special space an ordinary one."""

    def __missing__(self, o: int) -> int | None:
        c = chr(o)
        self[o] = v = None if _ignorable(c) else 32 if unicodedata.category(c) == "Zs" else o
        return v


_GONE = _Gone()


def plain(text: str) -> str:
    """`text` with ignorables removed, compatibility forms replaced, accents composed, spaces ordinary."""
    text = text.translate(_GONE)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text).translate(_GONE)


def consistent(text: str | None) -> str | None:
    """Consistent form of one text by table.  None and "" stay what they are."""
    if not text:
        return text
    text = plain(text)
    return _WORD.sub(lambda m: fold_word(m.group()), text) if _TWO.search(text) else text


def skeleton(word: str) -> str:
    """Key equal for words that differ in look-alikes and ignorables only (case kept)."""
    return plain(word).translate(_TO_CLASS)


#: A word with the marks and ignorables in and beside it.
TOKEN = regex.compile(r"[\p{L}\p{M}\p{Cf}]+")
_REGULAR = regex.compile(r"[A-Za-zÄÖÜäöüßА-яЁІЇЄҐёіїєґ]*")


def irregular_word(word: str) -> bool:
    """Whether a word may be another word in disguise: odd characters, or letters of two scripts."""
    return not _REGULAR.fullmatch(word) or bool(_TWO.search(word))


class VocabularyTrie:
    """Words with their frequencies in a trie of their decomposed characters, searched by a weighted edit automaton.

    Reading an ignorable costs 0, as does a character whose decomposed compatibility form follows the
    edges or looks like them; anything else costs 1 and is cut off at once by the bound of 0: what
    remains is exactly the set of words that look like the token.
    """

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            ends = node.setdefault("", {})
            ends[word] = ends.get(word, 0) + n

    def matches(self, token: str) -> list[tuple[str, int]]:
        """(word, frequency) of the words at distance 0."""
        nodes = [self.root]
        for c in token:
            if _ignorable(c):
                continue
            for d in unicodedata.normalize("NFKD", c):
                rep = _CLASS.get(d, d)
                nodes = [child for node in nodes for e, child in node.items() if e and (e == d or _CLASS.get(e, e) == rep)]
            if not nodes:
                return []
        return [x for node in nodes for x in node.get("", {}).items()]

    def canonical(self, token: str) -> str | None:
        """Most frequent word that looks like `token` and keeps its own script, else None.

        Its own script is that of its letters that look like no other script's; a token of one script keeps it.
        """
        letters = plain(token)
        own = {script(c) for c in letters if c not in _CLASS} - {None}
        kinds = {script(c) for c in letters} - {None}
        if len(kinds) == 1:
            found = [(n, w) for w, n in self.matches(token) if w == letters]
        else:
            found = [(n, w) for w, n in self.matches(token) if not own or {script(c) for c in w if c not in _CLASS} - {None} <= own]
        return max(found, key=lambda x: (x[0], [-ord(c) for c in x[1]]))[1] if found else None
