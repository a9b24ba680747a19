"""Words of a text as they read, whatever its markup and character forms."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсхуіјѕԁһӏвкмнтАЕОРСХУІЈЅВКМНТαεορυιν", "aeopcxyijsdhlbkmhtAEOPCXYIJSBKMHTaeopuiv")
#: Longer tags need an attribute, so that prose between two signs stays; longer comments end before the next one begins.
_TAGS = re.compile(r"</?[a-z][^<>]{0,300}>|<[a-z][a-z0-9]*\s[^<>=]*=[^<>]*>|<!--.{0,300}?-->|<!--(?:(?!<!--).)*?-->", re.S)
_MARKS = re.compile(r"\[\^?\d[\d\s,;\u2013\u2014-]*\]|\((?:ibid|op\. ?cit|loc\. ?cit)\.?\)|[\u00b9\u00b2\u00b3\u2070-\u2079]+")
_BROKEN = re.compile(r"[-\u2010\u2011](?<=[^\W\d_].)\s*\n[>\s]*(?=[^\W\d_])")
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u2060\ufeff]")
#: Scripts written without spaces: every character is a word.
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"[^\W_{_SPACELESS}]+|(?!_)(?=\w)[{_SPACELESS}]")
_PLAIN = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})

_PLAIN_LINES = {k: v for k, v in _PLAIN.items() if k != ord("\n")}


def visible(text: str) -> str:
    """A text in lower case without tags, entities, reference marks, invisible characters and word breaks at line ends, in one character form."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", text)
    if "<" in text:
        text = _TAGS.sub(" ", text)
    if "[" in text or "(" in text or not text.isascii():
        text = _MARKS.sub(" ", text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def folded(word: str) -> str:
    """A word with look-alike letters read as Latin if it has Latin letters too, and without accents."""
    if word.isascii():
        return word
    latin = word.translate(LOOKALIKES)
    word = latin if any(c.isascii() and c.isalpha() for c in word) or latin.isascii() else word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """The words of a text in order, in one case."""
    return words_of(visible(text.lower()))


def words_of(text: str) -> list[str]:
    """The words of a text that is `visible`."""
    if text.isascii():
        return text.translate(_PLAIN).split()
    return [w if w.isascii() else folded(w) for w in _WORDS.findall(unicodedata.normalize("NFC", text.casefold()))]


def lines_of(text: str) -> list[list[str]]:
    """The words of each line of a text that is `visible`, without empty lines."""
    if text.isascii():
        return [w for line in text.translate(_PLAIN_LINES).split("\n") if (w := line.split())]
    return [w for line in text.split("\n") if line and (w := words_of(line))]
