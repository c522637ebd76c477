"""Texts as arrays of lines.  All narrow: a document's lines never leave its row unless exploded on purpose."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stepped(docs: DataFrame, column: str, *steps: Callable[[Column], Column]) -> DataFrame:
    """``docs`` with ``steps`` applied to ``column`` one after the other, each value computed once.

    The projection looks at the column twice, so Spark does not inline the projection below it: chains of rewriters would
    else become one expression that takes minutes to plan.
    """
    bound = lambda step: lambda x: step(x)  # noqa: E731  Spark counts a function's parameters, optional ones too
    text = F.col(column)
    for step in steps:
        text = let(text, bound(step))
    return docs.withColumn(column, F.when(F.col(column).isNotNull(), text))


def where(text: Column, likely: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change(text)`` where ``likely(text)``, else the text: for dear changes, with a cheap test that holds wherever they change anything."""
    return let(text, lambda t: F.when(likely(t), change(t)).otherwise(t))


def holding(text: Column, *signs: str, change: Callable[[Column], Column]) -> Column:
    """``change(text)`` where the text holds one of ``signs``."""
    return where(text, lambda t: functools.reduce(lambda a, b: a | b, (t.contains(s) for s in signs)), change)


def split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def join(lines: Column) -> Column:
    """Lines as one text; nulls are left out, and null stands for no lines.

    Unlike ``array_join`` its nullability is known at once; Spark would else ask a chain of rewriters again and again.
    """
    return F.concat_ws("\n", lines)


def map_lines(text: Column, body: Callable[[Column], Column]) -> Column:
    return join(F.transform(split(text), body))


def filter_lines(text: Column, keep: Callable[[Column, Column, Column], Column]) -> Column:
    """Lines for which ``keep(line, number, all lines)`` holds."""
    return let(split(text), lambda all_: join(F.filter(all_, lambda x, i: keep(x, i, all_))))


def flat_map_lines(text: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body(line, number, all lines)`` gives the array of lines that stands for a line."""
    return let(split(text), lambda all_: join(F.flatten(F.transform(all_, lambda x, i: body(x, i, all_)))))


def one(line: Column | str) -> Column:
    return F.array(F.lit(line) if isinstance(line, str) else line)


def none() -> Column:
    return F.array().cast("array<string>")


def exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line`` with numbers from 0; a null text has no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split(F.col(text_col))).alias("line_no", "line"))


def collapsed(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """``doc_id, text`` of exploded lines, in their order."""
    rows = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("rows"))
    return rows.select("doc_id", F.array_join(F.col("rows.line"), "\n").alias("text"))


def islands(lines: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of lines within a document; a run starts where ``starts`` holds."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
