"""Rewriters as expressions against plain loops, over random texts of lines that the rules are about, and the error channel."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lavra.functions import runs, rx
from lavra.operators import blocks, cleaning, guarded, metadata, paragraphs, strip, structure
from lavra.plans.options import Options
from lavra.plans.pipeline import convert, rollup, spread
from lavra.sources import sinks

from . import brute

HEADS = [
    "1.", "12.", "  3.  ", "DOS FATOS", "DO DIREITO DE", "DA LEI", "Fatos e Atos", "AB", "I", "1. DO PEDIDO DE", "2. Texto que é muito longo para ser título de alguma coisa", "", "texto comum de linha",
    "PRELIMINAR DE", "VOTO X", "CASA", "DA", "E OUTROS", "LEI E", "9. A", "   DOS  AUTOS ", "Um título que CONTINUA COM", "RELATÓRIO FINAL DA AÇÃO PENAL PÚBLICA INCONDICIONADA E", "café",
]
QUOTES = [
    "EMENTA: direito penal", "# EMENTA", "Ementa.", "“Este é um texto citado bem longo que passa de cinquenta letras sem fim", '"Este é um texto citado bem longo que passa de cinquenta letras sem fim',
    "“Este é um texto citado que fecha e passa de cinquenta letras (STF, HC 1)” fim", "continua aqui (STJ, REsp 1.2) e mais", "fecha aqui”", 'fecha assim"', "(RE 123.456)", "No HC 123.456, o relator disse",
    "No REsp 12 (STJ, x) veio", "texto comum", "", "", "# Título", "1. DOS FATOS", "II - DO DIREITO", "3. Do pedido", "(STF", " de 2010) segue",
]
FRONT = ["---", "titulo: x", "# Sumário", "- [a](#a)", "- [b](b)", "- [c] x", "", "# T1", "## T2", "### T3", " # T4", "#sem", "texto", "autor : y", "chave: 'x' outro: \"y\"", "Sumário", "## T5", "data:1"]
GAPS = [
    "## 1. DOS FATOS", "## 3. DO PEDIDO", "2. DA CAUSA DE", "AÇÃO PENAL", "5. DO FIM", "> 4. DA PROVA", "texto", "", "1.1. sub", "**2.1** sub", "### 3.2. sub", "TÍTULO SOLTO", "OUTRO TÍTULO", "I – DOS FATOS",
    "III - DO DIREITO", "## V – DA LEI", "> VII – DO MAR", "texto longo que vai bem além de oitenta letras e nele está embutido 7. DOS PEDIDOS FINAIS aqui", "8. Tudo Misto", "## 2. X", " ", "**1.3.** sub",
]
NOTES = ["Nota interna: x", "## Observações ao advogado", "instruções para protocolo", "corpo", "  mais ", "", "", "", "# Título", "texto", "Nota de adequacao"]


@pytest.mark.parametrize(
    ("native", "loop", "pool"),
    [
        (paragraphs.rebuild_headings, brute.rebuild_headings, HEADS), (blocks.detect_quotes, brute.detect_quotes, QUOTES), (lambda t: blocks.detect_quotes(t, False), lambda t: brute.detect_quotes(t, False), QUOTES),
        (blocks.strip_front_matter, brute.strip_front_matter, FRONT), (blocks.fill_heading_gaps, brute.fill_heading_gaps, GAPS), (blocks.wrap_notes, brute.wrap_notes, NOTES),
    ],
)
def test_expressions_are_their_loops(spark, native, loop, pool):
    rng = random.Random(7)
    texts = ["", pool[0], *("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(250))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(native(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [loop(t) for t in texts]


def test_very_long_texts_do_not_exhaust_the_matcher(spark):
    text = "Nota interna\n" + "corpo da nota\n" * 60_000 + "# fim"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(blocks.wrap_notes(F.col("t")).alias("x"), blocks.remove_contents(F.col("t")).alias("y")).collect()
    assert got[0]["x"] == brute.wrap_notes(text) and got[0]["y"] == text and got[1]["x"] == ""


def test_runs(spark):
    df = spark.createDataFrame([("a\n- x\n- y\nb\n- z",)], "t string")
    code = lambda s, i, all_: F.when(s.startswith("- "), "i").otherwise("o")
    coded = runs.coded(F.col("t"), code)
    joined = runs.rewrite(coded, 1, runs.line("i") + "++", lambda r: F.array(F.array_join(F.transform(r, lambda x: runs.of(x, 1)), "; ")))
    row = df.select(runs.plain(joined, 1).alias("joined"), runs.plain(runs.drop(coded, runs.line("i")), 1).alias("dropped"), runs.plain(coded, 1).alias("same")).first()
    assert row["joined"] == "a\n- x; - y\nb\n- z" and row["dropped"] == "a\nb" and row["same"] == "a\n- x\n- y\nb\n- z"


def test_gaps_and_runs_as_relations(spark):
    heads = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (1, 5), (1, None), (2, 7)], "doc_id long, n int")
    assert sorted(map(tuple, structure.next_existing(heads).collect())) == [(1, 2, 4), (1, 3, 4)]
    lines = spark.createDataFrame([(1, i, c == "x") for i, c in enumerate("xx-xxx-x")] + [(2, 0, None), (2, 1, True)], "doc_id long, line_no int, kind boolean")
    assert sorted(map(tuple, structure.long_runs(lines, 2).collect())) == [(1, 0, 2), (1, 1, 2), (1, 3, 3), (1, 4, 3), (1, 5, 3)]


def test_one_bad_row_fails_alone(spark):
    def picky(text):
        if "ruim" in text:
            raise ValueError("texto ruim")
        return 7 if "número" in text else text.upper()

    docs = spark.createDataFrame([(1, "bom", None), (2, "ruim", None), (3, None, None), (4, "bom", "antes"), (5, "número", None)], "doc_id long, t string, error string")
    got = {r["doc_id"]: (r["t"], r["error"]) for r in guarded.derived(docs, "t", "t", "string", picky).collect()}
    assert got[1] == ("BOM", None) and got[2] == (None, "ValueError: texto ruim") and got[3] == (None, None) and got[4] == (None, "antes")
    assert got[5][0] is None and got[5][1].startswith("ArrowTypeError")
    assert guarded.derived(docs.drop("error"), "t", "size", "long", len).filter("doc_id = 1").first()["size"] == 3


def test_the_pipeline_goes_on_past_bad_rows(spark, monkeypatch):
    from lavra.plans import pipeline

    docs = spark.createDataFrame([(1, "a.txt", "um texto bom"), (2, "b.txt", "texto ruim"), (3, "c.txt", "outro texto bom")], "doc_id long, filename string, text string")

    def picky(text):
        return text[{"ruim": 10**6}.get(text.split()[-1], 0) :] if "ruim" not in text else {}["ruim"]

    day = datetime.date(2024, 1, 1)
    alone = {r["doc_id"]: r["markdown"] for r in convert(docs.filter("doc_id <> 2"), Options(), day).collect()}
    got = {r["doc_id"]: r for r in convert(docs, Options(), day, [picky]).collect()}
    assert (got[2]["success"], got[2]["error"], got[2]["markdown"], got[2]["pieces"]) == (False, "KeyError: 'ruim'", None, None)
    assert all(got[i]["success"] and got[i]["markdown"] == alone[i] for i in (1, 3))

    def broken(md):
        if "ruim" in md:
            raise RuntimeError("no page")
        return sinks.to_html(md)

    monkeypatch.setitem(pipeline.RENDERED, "html", ("string", broken))
    results = convert(docs, Options(output_format="html"), day)
    got = {r["doc_id"]: r for r in results.collect()}
    assert got[2]["error"] == "RuntimeError: no page" and got[2]["html"] is None and got[1]["html"].startswith("<!DOCTYPE html>")
    assert rollup(results).first().asDict() == {"total": 3, "converted": 2, "failed": 1}


def test_one_row_group_is_converted_by_all_tasks(spark, tmp_path):
    """A table of one row group, its rows equal, is dealt out evenly; the pipeline's query does so."""
    one = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("Um texto.").alias("text"))
    one.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = [r["count"] for r in spread(one.coalesce(1)).groupBy(F.spark_partition_id()).count().collect()]
        tasks = __spark_entry__.queries()["document_pipeline"](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(dealt) == 400 and len(dealt) == 4 and min(dealt) > 50
    assert tasks == 4


def test_cheap_tests_let_all_pass_that_a_rule_changes(spark):
    """Lines in letters that only fold to those of a rule, and such as a rule alone would find."""
    letters = spark.createDataFrame([(chr(i),) for i in range(0x20, 0xD800)], "x string").cache()
    for c in "abcdefghijklmnopqrstuvwxyz":
        assert letters.filter(rx.has(F.col("x"), f"^{c}$", "i") != rx.has(F.col("x"), f"^{rx.either(c)}$")).count() == 0, c
    assert all(any(s in w for s in cleaning.READER_SIGNS) for w in cleaning.READER_WORDS)
    cases = [
        (structure.mark_headings, "iii – do direito", "## iii – do direito"), (structure.mark_headings, "\u200bcláusula x", "## cláusula x"), (structure.mark_headings, "o recurso\u200b ", "o recurso"),
        (strip.strip_ui, "a\n ſaiba maıs em x", "a\n"), (strip.strip_catalog, "a\nıſbn 1\n\nCDD 2\nb\nc\nd", "d"), (strip.fix_urls, "httpswww.a", "https://www.a"),
        (strip.strip_artifacts, "a\n---\n\nPág. 3\nb", "a\n---\n\nb"), (strip.strip_inline_references, "SILVA, J. Acesso\nSILVA, J. Acesso em: x", "SILVA, J. Acesso\n"),
        (cleaning.normalize_whitespace, "a\u2003\n\x0bb\u3000", "a\nb"), (cleaning.remove_residual_pagination, "a\n\u2003pág. 3\nb", "a\nb"),
        (blocks.strip_references, "a\n# REFERÊNCIAS\nb", "a"), (blocks.strip_front_matter, "a\n  titulo : x\nb", "a\nb"),
        (metadata.issuer, "do tribunal de justiça\nx", "tribunal de justiça"), (metadata.issuer, "tribunal, x\n", None),
    ]
    for fn, before, after in cases:
        got = spark.createDataFrame([(before,)], "t string").select(fn(F.col("t"))).first()[0]
        assert got == after, (fn.__name__, got)
