"""Runs of lines as regular expressions.

A line lexer puts a code of fixed width before each line; which runs of lines belong together is then a regular
expression over codes, and a rewriter of such runs is a split and a transform: linear, within the row, in the JVM.  Quantifiers are
possessive, so the matcher neither recurses nor goes back however many lines a text has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import let, split

#: Stands around a run while it is cut out; Unicode keeps it from being a character of any text.
CUT = "\ufdd0"
Code = Callable[[Column, Column, Column], Column]


def coded(text: Column, code: Code) -> Column:
    """Each line behind ``code(stripped line, number, all lines)`` and before a newline."""
    return let(split(text), lambda all_: F.concat_ws("", F.transform(all_, lambda x, i: F.concat(let(rx.strip_line(x), lambda s: code(s, i, all_)), x, F.lit("\n")))))


def flags(*tests: tuple[str, Column]) -> Column:
    """A code of several signs: each is its letter if its test holds, else a hyphen."""
    return F.concat(*(F.when(test, sign).otherwise("-") for sign, test in tests))


def plain(text: Column, width: int) -> Column:
    """Lines without their codes."""
    return F.regexp_replace(rx.sub(text, f"^.{{{width}}}", "", "m"), r"\n\z", "")


def line(code: str) -> str:
    """The pattern of one line whose code is as ``code`` says."""
    return rf"(?:{code}[^\n]*+\n)"


def _lines(run: Column) -> Column:
    return F.split(F.regexp_replace(run, r"\n\z", ""), "\n", -1)


def of(coded_line: Column, width: int) -> Column:
    """A coded line's text without blanks at its ends."""
    return rx.strip(F.substring(coded_line, width + 1, 1 << 30))


def drop(text: Column, pattern: str) -> Column:
    """Without the runs that match."""
    return rx.sub(text, f"^(?:{pattern})", "", "m")


def rewrite(text: Column, width: int, pattern: str, body: Callable[[Column], Column]) -> Column:
    """Each run of coded lines that matches becomes the lines ``body(its coded lines)``."""
    out = lambda lines: F.concat_ws("", F.transform(lines, lambda x: F.concat(F.lit("~" * width), x, F.lit("\n"))))
    parts = F.split(rx.sub(text, f"^(?:{pattern})", f"{CUT}$0{CUT}", "m"), CUT, -1)
    return F.concat_ws("", F.transform(parts, lambda p, i: F.when(i % 2 == 1, out(let(_lines(p), body))).otherwise(p)))


def recode(text: Column, start: str, run: str, test: Callable[[Column], Column], sign: Callable[[Column], Column]) -> Column:
    """Wherever a line of ``start`` begins a ``run`` whose coded lines pass ``test``, its code's first letter becomes ``sign(letter)``.

    Every such line is looked at by itself, also one inside the run of another.
    """
    def put(whole: Column) -> Column:
        runs = rx.all_of(whole, rf"(?<=\n)(?=({run}))", 1)
        changed = lambda p: F.concat(sign(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))
        judged = lambda rs: F.transform(F.split(whole, rf"(?<=\n)(?={start})", -1), lambda p, i: F.when((i > 0) & let(_lines(F.get(rs, i - 1)), test), changed(p)).otherwise(p))
        return F.substring(F.concat_ws("", let(runs, judged)), 2, 1 << 30)

    # coding the lines is dear, so the coded text is a value, not an expression that each use computes again
    return let(text, lambda t: F.when(rx.has(t, f"^{start}", "m"), let(F.concat(F.lit("\n"), t), put)).otherwise(t))
