"""Markdown tables as arrays of rows of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import exploded, islands, join, let, split

#: Fixed value: signs that make a table a drawing.
ARROWS = "→←↓↑⇒⇐↔➡⬇⬆"
TABLE_LINE = r"^\s*\|.*\|\s*$"


def split_row(line: Column) -> Column:
    s = F.regexp_replace(rx.strip(line), r"^\||\|$", "")
    return F.transform(F.split(s, r"\|", -1), rx.strip)


def join_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c == "") | rx.has(c, r"^[-:]+$"))


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def padded(rows: Column) -> Column:
    """All rows as wide as the widest."""
    return let(width(rows), lambda n: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))))


def _columns(rows: Column, keep) -> Column:
    """The rows with only the columns ``keep(index)`` holds for."""
    kept = F.filter(F.sequence(F.lit(0), F.size(F.get(rows, 0)) - 1), keep)
    return let(kept, lambda k: F.transform(rows, lambda r: F.transform(k, lambda i: F.get(r, i))))


def dedupe_columns(rows: Column) -> Column:
    """Drops a column equal in all rows to its left neighbour; equality carries over, so the kept one need not be sought."""
    same = lambda r, i: F.forall(r, lambda x: F.get(x, i) == F.get(x, i - 1))
    narrow = (F.size(rows) == 0) | (F.size(F.get(rows, 0)) < 2)
    return F.when(narrow, rows).otherwise(let(padded(rows), lambda r: _columns(r, lambda i: (i == 0) | ~same(r, i))))


def drop_empty_columns(rows: Column) -> Column:
    wide = let(padded(rows), lambda r: F.when(F.size(F.get(r, 0)) > 0, _columns(r, lambda i: F.exists(r, lambda x: rx.strip(F.get(x, i)) != ""))).otherwise(r))
    return F.when(F.size(rows) == 0, rows).otherwise(wide)


def is_drawing(rows: Column, share: float = 0.3) -> Column:
    """Arrows in over ``share`` of the cells that are not empty."""
    cells = F.filter(F.flatten(rows), lambda c: rx.strip(c) != "")
    return let(cells, lambda c: (F.size(c) > 0) & (F.size(F.filter(c, lambda x: x.rlike(f"[{ARROWS}]"))) / F.size(c) > share))


def drawing_to_list(rows: Column) -> Column:
    """Lines of a nested list: a row's first cell, and below it the others."""
    cells = F.transform(rows, lambda r: F.filter(F.transform(r, rx.strip), lambda c: c != ""))
    real = F.filter(cells, lambda r: (F.size(r) > 0) & ~F.forall(r, lambda c: rx.has(c, r"^[-:]+$")))
    return F.flatten(F.transform(real, lambda r: F.transform(r, lambda c, i: F.concat(F.when(i == 0, "- ").otherwise("  - "), c))))


def column_to_list(rows: Column) -> Column:
    """A table of one column as a quote (one cell) or a list; null for other tables."""
    cells = F.transform(F.filter(rows, lambda r: (rx.strip(F.get(r, 0)) != "") & ~is_separator(r)), lambda r: F.get(r, 0))
    single = (F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == 1)
    made = lambda c: F.when(F.size(c) == 1, F.array(F.concat(F.lit("> "), F.get(c, 0)))).when(F.size(c) > 1, F.transform(c, lambda x: F.concat(F.lit("- "), x)))
    return F.when(single, let(cells, made))


def normalize_table(lines: Column) -> Column:
    """The lines of one table, normalised: equal and empty columns go, drawings and single columns become lists."""

    def parsed(rows: Column) -> Column:
        separator = F.array_position(F.transform(rows, is_separator), True)
        headed = separator == 2
        body = F.when(headed, F.concat(F.slice(rows, 1, 1), F.slice(rows, 3, F.size(rows)))).otherwise(rows)

        def written(r: Column) -> Column:
            rule = F.when(headed, F.array(join_row(F.array_repeat(F.lit("---"), width(r))))).otherwise(F.array().cast("array<string>"))
            out = F.transform(padded(r), join_row)
            table = F.concat(F.slice(out, 1, 1), rule, F.slice(out, 2, F.size(out)))
            return F.when(is_drawing(r), F.array(join(drawing_to_list(r)))).otherwise(F.coalesce(column_to_list(r), F.when((F.size(r) == 0) | (F.size(F.get(r, 0)) == 0), lines).otherwise(table)))

        return let(drop_empty_columns(dedupe_columns(body)), written)

    return F.when(F.size(lines) < 2, lines).otherwise(let(F.transform(lines, split_row), parsed))


def normalize_tables(text: Column) -> Column:
    """Every run of table lines in a text, normalised in place."""

    def body(all_: Column) -> Column:
        table = lambda i: rx.has(F.get(all_, i), TABLE_LINE)
        numbers = F.sequence(F.lit(0), F.size(all_) - 1)
        starts = F.filter(numbers, lambda i: (i == 0) | (F.coalesce(table(i), F.lit(False)) != F.coalesce(table(i - 1), F.lit(False))))

        def runs(s: Column) -> Column:
            ends = F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(all_)))
            run = lambda b, k: F.slice(all_, b + 1, F.get(ends, k) - b)
            return join(F.flatten(F.transform(s, lambda b, k: F.when(table(b), normalize_table(run(b, k))).otherwise(run(b, k)))))

        return F.when(F.exists(all_, lambda x: rx.has(x, TABLE_LINE)), let(starts, runs)).otherwise(join(all_))

    return let(split(text), body)


def tables(docs: DataFrame) -> DataFrame:
    """``doc_id, tbl_idx, rows``: every table of the texts, by islands of table lines."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = exploded(docs).withColumn("is_table", rx.has(F.col("line"), TABLE_LINE))
    change = F.col("is_table") & ~F.coalesce(F.lag("is_table").over(order), F.lit(False))
    numbered = islands(marked.withColumn("starts", change), F.col("starts"), "tbl_idx").filter("is_table")
    grouped = numbered.groupBy("doc_id", "tbl_idx").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("r"))
    return grouped.select("doc_id", (F.col("tbl_idx") - 1).cast("int").alias("tbl_idx"), F.transform(F.col("r.line"), split_row).alias("rows"))


def to_markdown(rows: Column) -> Column:
    """A table of cells (nulls allowed) as a pipe table with the first row as its header."""
    tidy = F.transform(rows, lambda r: F.transform(r, lambda c: rx.strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))))

    def written(t: Column) -> Column:
        n = F.size(F.get(t, 0))
        fit = F.transform(t, lambda r: join_row(F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0)))), 1, n)))
        return F.when(F.size(t) == 0, "").otherwise(join(F.concat(F.slice(fit, 1, 1), F.array(join_row(F.array_repeat(F.lit("---"), n))), F.slice(fit, 2, F.size(fit)))))

    return F.when((F.size(rows) == 0), F.lit("")).otherwise(let(tidy, written))
