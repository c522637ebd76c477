"""The one place that turns patterns into Java regular expressions with Unicode classes and plain newlines.

``(?U)`` makes ``\\w \\d \\s \\b`` Unicode-aware, ``(?d)`` makes only ``\\n`` end a line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str, flags: str = "") -> str:
    """``pattern`` with the library's flags; ``flags``: i (ignore case), m (anchors at lines), s (dot takes newlines)."""
    return f"(?Ud{flags}){pattern}"


def sub(text: Column, pattern: str, to: str, flags: str = "") -> Column:
    return F.regexp_replace(text, rx(pattern, flags), to)


def has(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(rx(pattern, flags))


def first(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The group of the first match, or null."""
    return F.when(has(text, pattern, flags), F.regexp_extract(text, rx(pattern, flags), group))


def count(text: Column, pattern: str, flags: str = "") -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, flags)))


def all_of(text: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(rx(pattern, flags)), F.lit(group))


#: Unicode's white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: What Java takes for an ASCII letter besides its two cases where case is ignored.
_FOLDED = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def either(word: str) -> str:
    """A pattern of the ASCII ``word`` in any case: finds what flag i does, by classes, which a search passes far faster."""
    return "".join(f"[{c.lower()}{c.upper()}{_FOLDED.get(c.lower(), '')}]" if c.isalpha() else re.escape(c) for c in word)


def any_start(words: list[str]) -> str:
    """A pattern of any of ``words``, in any case."""
    return f"(?:{'|'.join(map(either, words))})"


def swap(text: Column, signs: dict[str, str]) -> Column:
    """Each sign's replacement in its place; unlike ``translate`` this looks for bytes, not at every character."""
    for a, b in signs.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip(text: Column) -> Column:
    """Without white space at both ends.  No regular expression: that would search the whole text for its end."""
    return F.btrim(text, F.lit(BLANKS))


def strip_line(line: Column) -> Column:
    """``strip`` of a column that costs nothing to look at twice (a lambda's parameter).

    Spark's trim of given characters measures every character of a text to find its end, so a last byte that is a visible ASCII
    character is looked at first.
    """
    seen = F.substring(line.cast("binary"), -1, 1).between(F.lit(b"\x21"), F.lit(b"\x7e"))
    return F.when(seen, F.ltrim(line, F.lit(BLANKS))).otherwise(strip(line))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def blank(text: Column) -> Column:
    return strip(text) == ""


def any_of(text: Column, patterns: list[str], flags: str = "") -> Column:
    """Whether one of the patterns is found: one alternation, so one pass."""
    return has(text, "|".join(f"(?:{p})" for p in patterns), flags)


def upper_share(text: Column) -> Column:
    """Upper-case letters among letters; null without letters."""
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.char_length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters)


def all_upper(text: Column) -> Column:
    """Some cased letter, and none in lower case."""
    return text.rlike(r"^(?=[^\p{Lu}]*+\p{Lu})[^\p{Ll}]*+\z")
