"""Scalars that Spark has no function for."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import rx


#: No character below this range changes, or joins another, in composed form.
_MAY_COMPOSE = "[^\u0000-\u02ff]"


def nfc(text: Column) -> Column:
    """Unicode's composed form.  Only texts that can change travel to Python."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.coalesce(F.pandas_udf(run, "string")(F.when(text.rlike(_MAY_COMPOSE), text)), text)


def slug(title: Column, limit: int = 60) -> Column:
    """An anchor: lower case, no marks, blanks as hyphens, cut at the last hyphen within ``limit``."""
    plain = rx.sub(rx.strip(rx.sub(F.lower(title), r"[^\w\s-]", "")), r"\s+", "-")
    head = F.substring(plain, 1, limit)
    return F.when(F.char_length(plain) > limit, F.when(head.contains("-"), F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)).otherwise(plain)


def roman_to_int(numeral: Column) -> Column:
    """The value of a Roman numeral in I, V, X, L, C; letters before larger ones count as negative; null if empty."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10).when(c == "L", 50).when(c == "C", 100).otherwise(0)
    digits = F.transform(F.filter(F.split(numeral, ""), lambda c: c != ""), value)
    signed = F.transform(digits, lambda v, i: F.when(v < F.coalesce(F.get(digits, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(F.char_length(numeral) > 0, F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def int_to_roman(number: Column) -> Column:
    """The numeral of a number from 1 to 399."""
    tens = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    pick = lambda names, digit: F.try_element_at(F.array(*map(F.lit, names)), digit.cast("int") + 1)
    hundreds = F.repeat(F.lit("C"), F.floor(number / 100).cast("int"))
    return F.concat(hundreds, pick(tens("X", "L", "C"), F.floor(number / 10) % 10), pick(tens("I", "V", "X"), number % 10))


def argmax(counts: Column, names: list[str]) -> Column:
    """The name with the greatest count; the first declared wins ties."""
    return F.try_element_at(F.array(*map(F.lit, names)), F.array_position(counts, F.array_max(counts)).cast("int"))
