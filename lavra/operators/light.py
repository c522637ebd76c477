"""Counts over Markdown, and the light post-processing with five switches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import exploded, join, let, map_lines, split

PREPOSITIONS = "de da do das dos para com sob por no na nos nas ao à aos às em entre sobre a o as os e ou que".split()


def count_headings(docs: DataFrame) -> DataFrame:
    """``doc_id, level, n`` of lines that begin with one to six ``#``."""
    level = F.char_length(F.regexp_extract(F.col("line"), "^(#+)", 1))
    return exploded(docs).withColumn("level", level).filter("level between 1 and 6").groupBy("doc_id", "level").agg(F.count("*").alias("n"))


def count_elements(text: Column) -> Column:
    """``struct`` of counts of lines, characters, words and Markdown elements."""
    line_starts = lambda c: rx.count(text, rf"^{c}", "m")
    return F.struct(
        F.size(split(text)).alias("lines"),
        F.char_length(text).alias("chars"),
        rx.count(text, r"\S+").alias("words"),
        line_starts(">").alias("quotes"),
        line_starts(r"\|").alias("table_lines"),
        rx.count(text, r"\*\*[^*]+\*\*").alias("bold"),
        rx.count(text, r"(?<!\*)\*[^*]+\*(?!\*)").alias("italic"),
        rx.count(text, r"\[.+?\]\(.+?\)").alias("links"),
        rx.count(text, r"!\[.*?\]\(.+?\)").alias("images"),
    )


def contents(text: Column, deepest: int = 4) -> Column:
    """``array<struct<level, title>>`` of headings down to ``deepest`` with a title."""
    marks = lambda x: F.char_length(F.regexp_extract(x, "^(#*)", 1))
    found = F.transform(split(text), lambda x: F.struct(marks(x).alias("level"), rx.strip(F.regexp_replace(x, "^#+", "")).alias("title")))
    return F.filter(found, lambda h: h["level"].between(1, deepest) & (h["title"] != ""))


def join_lines(text: Column) -> Column:
    """Joins a line that ends in a preposition to the next; a line that was joined to joins no further."""
    ends = rf"\b(?:{'|'.join(PREPOSITIONS)})\s*$"

    def body(all_: Column) -> Column:
        wants = F.transform(all_, lambda x, i: F.coalesce(rx.has(x, ends) & ~rx.blank(F.get(all_, i + 1)) & ~F.get(all_, i + 1).rlike(r"^[#>|\-*]"), F.lit(False)))
        # a line joins its successor if the run of wanting lines that ends with it is odd
        runs = F.aggregate(wants, F.struct(F.lit(False).alias("took"), F.array().cast("array<boolean>").alias("out")), lambda a, w: F.struct((w & ~a["took"]).alias("took"), F.concat(a["out"], F.array(w & ~a["took"])).alias("out")))["out"]

        def put(takes: Column) -> Column:
            one = lambda x, i: F.when(F.get(takes, i), F.concat(rx.rstrip(x), F.lit(" "), F.regexp_replace(F.get(all_, i + 1), r"(?U)\A\s+", ""))).when((i > 0) & F.get(takes, i - 1), F.lit(None)).otherwise(x)
            return join(F.filter(F.transform(all_, one), lambda x: x.isNotNull()))

        return let(runs, put)

    return let(split(text), body)


def light_postprocess(text: Column, underscores: bool = False, heading_levels: bool = False, line_breaks: bool = False, blanks: bool = False, quotes: bool = False) -> Column:
    if underscores:
        text = F.regexp_replace(F.regexp_replace(text, r"(\\_){2,}", ""), "_{3,}", "")
        text = F.regexp_replace(text, "(?dm)^[ \t]+", "")
    if heading_levels:
        numeral = r"(?:I{1,3}|IV|V|VI{0,3}|IX|X{0,3}|XI{0,3}|XII{0,3})"
        text = map_lines(text, lambda x: F.when(rx.has(rx.strip(x), rf"^#{{1,6}}\s+(.*?\b{numeral}\b[.\s\-–—]+.+)$"), F.concat(F.lit("## "), F.regexp_extract(rx.strip(x), rx.rx(r"^#{1,6}\s+(.*)$"), 1))).otherwise(x))
    if line_breaks:
        text = join_lines(text)
    if blanks:
        text = F.regexp_replace(text, "\n{4,}", "\n\n\n")
    return F.translate(text, '"', "“") if quotes else text
