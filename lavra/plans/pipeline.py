"""The document pipeline: native projections, all narrow; no shuffle."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import stepped
from lavra.operators import blocks, cleaning, enrich, guarded, headings, metadata, strip, structure, tables
from lavra.plans.options import Options
from lavra.sources import files as sources
from lavra.sources import sinks


#: Output formats that Python makes of Markdown: type and function.
RENDERED = {"html": ("string", sinks.to_html), "docx": ("binary", sinks.to_docx)}


def rag_fields(text: Column, today: Column) -> list[tuple[str, Column]]:
    area = enrich.legal_area(text)
    return [("area", area["area"]), ("subarea", area["subarea"]), ("tags", F.array_join(enrich.tag_list(text), ", ")), ("ultima_revisao", F.date_format(today, "yyyy-MM-dd"))]


def convert(docs: DataFrame, options: Options | None = None, today: datetime.date | None = None, extra: Sequence[Callable[[str], str]] = ()) -> DataFrame:
    """``doc_id, filename, mode, output_format, markdown, html, docx, pieces, success, error, stats`` per row of ``docs``.

    ``docs`` has ``doc_id, filename, text`` and may have ``error``.  A blank or null text, or one with an error, is a
    row with ``success`` false.  ``today`` stands in the front matter; without it, the current date.  ``extra`` are a
    caller's own rewriters, applied to cleaned texts.  Whatever raises in Python on one document, be it one of these or the
    making of HTML or DOCX, is the ``error`` of that document's row, and no other row changes.
    """
    o = options or Options()
    day = F.lit(today) if today else F.current_date()
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", F.coalesce("filename", F.lit("unknown")).alias("filename"), F.col("text").alias("raw"), error.alias("error"))
    base = base.withColumn("error", F.coalesce("error", F.when(F.col("raw").isNull() | rx.blank(F.col("raw")), "the document has no text")))
    step = cleaning.clean(base.withColumn("t", F.when(F.col("error").isNull(), F.col("raw"))), "t", o.remove_headers_footers)
    step = guarded.derived(step, "t", "t", "string", *extra) if extra else step
    step = step.withColumn("chars_cleaned", F.char_length("t").cast("long"))
    step = structure.heuristics(step, "t", o.mode, o.detect_citations, o.separate_enums, o.wrap_notes, composed=True)
    step = headings.normalize_headings(stepped(step, "t", tables.normalize_tables), "t")
    if o.rag_optimize:
        step = stepped(step, "t", enrich.semantic_format, enrich.smart_callouts, enrich.section_summaries, enrich.normalize_footnotes)
    step = step.withColumn("yaml", metadata.front_matter(F.col("t"), F.col("filename"), day, o.extract_metadata, o.extract_procedural and o.mode == "forense"))
    if o.rag_optimize:
        step = step.withColumn("yaml", F.concat(F.regexp_replace("yaml", r"---\z", ""), F.array_join(metadata.yaml_lines(rag_fields(F.col("t"), day)), "\n"), F.lit("\n---")))
    titled = F.regexp_extract("yaml", 'titulo: "(.+?)"', 1)
    step = step.withColumn("toc", structure.contents(F.col("t")) if o.generate_toc else F.lit(""))
    whole_h1 = rx.has(F.col("t"), r"^\s*# [^\n]*\S", "m")
    h1 = F.when(whole_h1 | (titled == ""), F.lit("")).otherwise(F.concat(F.lit("# "), titled, F.lit("\n\n")))
    step = step.withColumn("t", F.concat("yaml", F.lit("\n\n"), h1, F.when(F.col("toc") != "", F.concat("toc", F.lit("\n"))).otherwise(F.lit("")), "t"))
    none = F.array().cast("array<struct<title:string,content:string>>")
    step = step.withColumn("pieces", structure.piece_array(F.col("t")) if o.separate else none)
    if o.separate:
        step = step.withColumn("t", F.when(F.size("pieces") > 1, structure.format_pieces(F.col("pieces"))).otherwise(F.col("t")))
    step = stepped(step, "t", strip.clean_artifacts, strip.relocate_footnotes, strip.fix_urls, strip.strip_ui)
    removed = [strip.strip_inline_references] * o.strip_references + [strip.strip_footnotes] * o.strip_footnotes + [strip.strip_artifacts] * o.strip_artifacts + [blocks.strip_references] * o.strip_references
    step = stepped(step, "t", *removed, strip.polish)
    if o.output_format in RENDERED:
        step = guarded.derived(step, "t", o.output_format, *RENDERED[o.output_format])
    good = F.col("error").isNull()
    lines = lambda c: F.size(F.split(c, "\n", -1)).cast("long")
    stats = F.create_map(
        F.lit("chars_raw"), F.char_length("raw").cast("long"), F.lit("lines_raw"), lines("raw"), F.lit("chars_cleaned"), F.col("chars_cleaned"), F.lit("pieces_count"), F.size("pieces").cast("long"),
        F.lit("chars_final"), F.char_length("t").cast("long"), F.lit("lines_final"), lines("t"),
    )
    markdown = F.when(good, F.col("t"))
    return step.select(
        "doc_id", "filename", F.lit(o.mode).alias("mode"), F.lit(o.output_format).alias("output_format"), markdown.alias("markdown"),
        (F.col("html") if o.output_format == "html" else F.lit(None).cast("string")).alias("html"),
        (F.col("docx") if o.output_format == "docx" else F.lit(None).cast("binary")).alias("docx"),
        F.when(good, F.col("pieces")).alias("pieces"), good.alias("success"), "error", F.when(good, stats).alias("stats"),
    )


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` dealt out evenly, whatever they hold.

    A table's file may be one row group, which one task reads; converting costs far more than moving a text once.  The number of a row
    depends on the input only, so a task that is run again deals the same.
    """
    return docs.withColumn("__at", F.monotonically_increasing_id()).repartition("__at").drop("__at")


def convert_folder(spark: SparkSession, path: str, options: Options | None = None, glob: str | None = None, today: datetime.date | None = None) -> DataFrame:
    """All files of a folder; ``doc_id`` is a number of the path, which is carried as ``filename`` by its last part."""
    o = options or Options()
    found = sources.extract(sources.read_files(spark, path, glob), o.preserve_inline_formatting, o.page_range, o.detect_columns)
    return convert(found.withColumnRenamed("seq", "doc_id"), o, today)


def rollup(results: DataFrame) -> DataFrame:
    """Documents in all, converted, and failed."""
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("converted"), F.count_if(~F.col("success")).alias("failed"))
