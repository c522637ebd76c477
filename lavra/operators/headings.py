"""Heading hierarchy of Markdown."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import flat_map_lines, join, let, map_lines, one, split, stepped

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
# Words at which a sentence that was glued to a heading begins.
STARTERS = [
    "A", "O", "É", "Um", "Uma", "Esta", "Este", "Estes", "Estas", "Aquele", "Isto", "Isso", "No", "Na", "Os", "As", "Em", "Para", "Por", "De", "Do", "Da", "Nos", "Nas", "Sua", "Seu",
]
VERBS = [
    "é", "são", "foi", "está", "pode", "deve", "tem", "há", "não", "será", "consiste", "define", "trata", "configura", "constitui", "representa", "caracteriza", "compreende", "abrange",
    "inclui", "prevê", "dispõe", "estabelece", "determina", "aplica", "regula", "disciplina", "prescreve", "estipula", "assegura", "garante", "veda", "proíbe", "autoriza", "permite",
    "exige", "obriga", "impõe", "reconhece", "admite",
]


def remove_duplicate_numbering(text: Column) -> Column:
    """``### 3.1. ### 3.1. Title`` becomes ``### 3.1. Title``."""
    text = rx.sub(text, r"^(#{1,6})[^\S\n]+(\d+(?:\.\d+)*\.?)[^\S\n]+\1[^\S\n]+\2[^\S\n]+", "$1 $2 ", "m")
    return rx.sub(text, r"^(#{1,6})[^\S\n]+(\d+(?:\.\d+)*\.?)[^\S\n]+\1[^\S\n]+\2", "$1 $2 ", "m")


def fixed_levels(levels: Column) -> Column:
    """An array of levels (0: no heading) in which none is more than one below the heading before: a fold."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        level = F.when((acc["last"] > 0) & (x > acc["last"] + 1), acc["last"] + 1).otherwise(x)
        return F.struct(F.when(x > 0, level).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.when(x > 0, level).otherwise(0))).alias("out"))

    return F.aggregate(levels, start, step)["out"]


def fix_level_jumps(text: Column) -> Column:
    """A heading is at most one level below the one before.  The fold runs over headings only, so it stays short."""

    def body(all_: Column) -> Column:
        level = lambda x: F.char_length(F.regexp_extract(x, rx.rx(HEADING), 1))
        at = F.filter(F.transform(all_, lambda x, i: F.struct(level(x).alias("level"), i.alias("i"))), lambda h: h["level"] > 0)

        def put(heads: Column) -> Column:
            fixed = fixed_levels(F.transform(heads, lambda h: h["level"]))
            numbers = F.transform(heads, lambda h: h["i"])
            change = lambda f, n: F.transform(all_, lambda x, i: F.when(level(x) > 0, let(F.get(f, F.array_position(n, i).cast("int") - 1), lambda v: F.when(v == level(x), x).otherwise(F.concat(F.repeat(F.lit("#"), v), F.lit(" "), F.regexp_extract(x, rx.rx(HEADING), 2))))).otherwise(x))
            return let(fixed, lambda f: let(numbers, lambda n: join(change(f, n))))

        return let(at, put)

    return let(split(text), body)


def ensure_blank_lines(text: Column) -> Column:
    """A blank line before and behind each heading that stands by text."""

    def body(x: Column, i: Column, all_: Column) -> Column:
        is_head = lambda y: rx.has(y, HEADING)
        before, after = F.get(all_, i - 1), F.get(all_, i + 1)
        #: A heading before has put a blank line between already.
        above = F.when((i > 0) & ~rx.blank(before) & ~is_head(before), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        below = F.when(after.isNotNull() & ~rx.blank(after), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(is_head(x), F.concat(above, one(x), below)).otherwise(one(x))

    return flat_map_lines(text, body)


def truncate_headings(text: Column, most: int = 15) -> Column:
    """Headings of over ``most`` words end where a sentence seems to start, between the fifth and twentieth word.

    A word that starts sentences is looked for first, then a verb; what is cut off becomes a paragraph.
    """

    def cut(line: Column, words: Column) -> Column:
        n = F.size(words)
        span = F.filter(F.sequence(F.lit(4), F.lit(most + 4)), lambda i: i < n)
        starts = F.get(F.filter(span, lambda i: F.get(words, i).isin(STARTERS) & (i + 1 < n)), 0)
        verb = F.get(F.filter(span, lambda i: rx.has(F.get(words, i), rf"^(?:{'|'.join(VERBS)})\b", "i")), 0)
        parted = lambda at: F.concat(F.regexp_extract(line, rx.rx(HEADING), 1), F.lit(" "), F.array_join(F.slice(words, 1, at), " "), F.lit("\n\n"), F.array_join(F.slice(words, at + 1, n), " "))
        return F.when(n > most, let(F.coalesce(starts, verb), lambda at: F.when(at.isNotNull(), parted(at))))

    words = lambda x: F.split(rx.strip(F.regexp_extract(x, rx.rx(HEADING), 2)), rx.rx(r"\s+"), -1)
    return map_lines(text, lambda x: F.when(x.startswith("#"), F.coalesce(let(words(x), lambda w: cut(x, w)), x)).otherwise(x))


def normalize_headings(docs: DataFrame, column: str = "text", most_words: int = 15) -> DataFrame:
    """``docs`` with all of these applied to ``column``."""
    return stepped(docs, column, remove_duplicate_numbering, fix_level_jumps, partial(truncate_headings, most=most_words), ensure_blank_lines)
