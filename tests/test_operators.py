import datetime
import random

import pytest
from pyspark.sql import functions as F

from lavra.functions import rx, scalars
from lavra.operators import blocks, cleaning, enrich, headings, layout, light, metadata, paragraphs, strip, structure, tables
from lavra.plans.options import Options, load
from lavra.plans.pipeline import convert, rollup
from lavra.sources import sinks


def apply(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", fn(F.col("text")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows] if len(texts) > 1 else rows[0]["x"]


@pytest.mark.parametrize(
    ("fn", "before", "after"),
    [
        (cleaning.fix_hyphenation, "cele-\nbrou e vice-\nprefeito", "celebrou e vice-prefeito"),
        (cleaning.normalize_whitespace, " a\t b  c \n d ", "a b c\nd"),
        (cleaning.normalize_bullets, "• um\n– dois", "- um\n- dois"),
        (cleaning.remove_ocr_noise, "ok....... ____ ------\n***\nfim", "ok  ---\n\nfim"),
        (cleaning.remove_corrupted_glyphs, "жжжж\nabcdefghijkж z", "abcdefghijk z"),
        (cleaning.remove_residual_pagination, "12\na\nb\nc\n34\nd\ne\nf\nPágina 3\n- 4 -\n9", "a\nb\nc\n34\nd\ne\nf"),
        (cleaning.reconnect_case_numbers, "HC\n 1234567-89.2024", "HC 1234567-89.2024"),
        (cleaning.split_fused_headings, "## 6. Fontes formais Capítulo 1 Empresa", "## 6. Fontes formais\n\n## Capítulo 1 Empresa"),
        (cleaning.fix_word_spacing, "direitoAlheio McX", "direito Alheio McX"),
        (cleaning.fix_enum_spacing, "a)um\n1)dois\nii)x\nb) c", "a) um\n1) dois\nii) x\nb) c"),
        (cleaning.separate_enumerations, "texto\na) um\n\nb) dois", "texto\n\na) um\n\nb) dois"),
        (cleaning.normalize_citations, "artigo 5o, parágrafo 1 e §§ 2 da alinea", "Art. 5º, § 1 e § 2 da alínea"),
        (cleaning.normalize_paragraphs, "a\n\n\n\n\nb", "a\n\n\nb"),
        (paragraphs.rebuild_headings, "8.\nDA RESERVA DE BENS\ntexto comum", "8. DA RESERVA DE BENS\ntexto comum"),
        (paragraphs.rebuild_headings, "8. DA RESERVA E DO\nPROSSEGUIMENTO DO ARROLAMENTO DOS BENS\n\nx", "8. DA RESERVA E DO PROSSEGUIMENTO DO ARROLAMENTO DOS BENS\n\nx"),
        (paragraphs.rejoin_paragraphs, "o autor da\nCasa foi\nembora.\nOutra linha\n\na) item\ncontinua", "o autor da Casa foi embora.\nOutra linha\n\na) item continua"),
        (blocks.remove_contents, "SUMÁRIO\n1. Intro .... 3\n2. Fim\n\n\nTexto", "Texto"),
        (blocks.detect_quotes, "EMENTA: algo\nmais\n\n\nfim", "> EMENTA: algo\n> mais\n\n\nfim"),
        (blocks.separate_items, "Pede o seguinte:\na) um;\nb) dois.", "Pede o seguinte:\n\n- um;\n- dois.\n"),
        (blocks.wrap_notes, "Nota interna\nx\n# T", f"\n{blocks.NOTE_BANNER}\n>\n> Nota interna\n> x\n\n# T"),
        (blocks.fill_heading_gaps, "## 1. UM\nx\n## 3. TRES", "## 1. UM\nx\n\n## 2. [SEÇÃO SEM TÍTULO DETECTADO]\n\n## 3. TRES"),
        (blocks.fill_heading_gaps, "I – DOS FATOS\nIII – DO DIREITO", "## I – DOS FATOS\n\n## II – [SEÇÃO SEM TÍTULO DETECTADO]\n\n## III – DO DIREITO"),
        (blocks.strip_front_matter, "---\na: b\n---\ntitulo: x\n# T\ny", "# T\ny"),
        (blocks.strip_front_matter, "# a\n# b\n# c\n# d\n# e\ntexto", "# e\ntexto"),
        (enrich.semantic_format, "o habeas corpus do STF\ncontrato e contrato", "o *habeas corpus* do **STF**\n**contrato** e contrato"),
        (enrich.smart_callouts, "Art. 5 da lei\nsegue\n\nprosa", "> [!QUOTE] Legislação\n> Art. 5 da lei\n> segue\n\nprosa"),
        (enrich.normalize_footnotes, "texto (2) e\n2) uma nota bem comprida aqui", "texto [^2] e\n\n---\n\n[^2]: uma nota bem comprida aqui"),
        (strip.remove_note_numbers, "outrem.1 Art. 12, palavra 3 outra\n# a1", "outrem. Art. 12, palavra outra\n# a1"),
        (blocks.strip_references, "a\n## Referências\nx\n### y\n## Fim\nb", "a\n## Fim\nb"),
        (headings.remove_duplicate_numbering, "### 3.1. ### 3.1. Fonte", "### 3.1. Fonte"),
        (headings.fix_level_jumps, "## a\n#### b\n#### c\n# d", "## a\n### b\n#### c\n# d"),
        (headings.ensure_blank_lines, "x\n## a\n## b\ny", "x\n\n## a\n\n## b\n\ny"),
        (headings.truncate_headings, "## " + " ".join(f"p{i}" for i in range(6)) + " A noção " + "x " * 12 + "z", "## p0 p1 p2 p3 p4 p5\n\nA noção " + "x " * 12 + "z"),
        (tables.normalize_tables, "t\n| a | a | b |\n|---|---|---|\n| 1 | 1 |  |\nf", "t\n| a | b |\n| --- | --- |\n| 1 |  |\nf"),
        (tables.normalize_tables, "| a → b | c ← |\n| d | e |", "- a → b\n  - c ←\n- d\n  - e"),
        (tables.normalize_tables, "| a |\n| b |", "- a\n- b"),
        (strip.clean_artifacts, "a\n\n12\n\nb\n*Resumo: x Palavras-chave: y.*", "a\n\n\nb\n"),
        (strip.strip_catalog, "a\nb\nc\n# T\nISBN 1-2\nx\nCDD: 3\ny\nz\nw", "a\nb\nc\n# T\nw"),
        (strip.relocate_footnotes, "corpo [^1]\n[^1]: um\n[^2]: dois", "corpo [^1]\n\n> [!NOTE]\n> **Nota:** dois\n\n\n\n---\n\n[^1]: um\n"),
        (strip.fix_urls, "httpswww.a.com httpwwwb.com", "https://www.a.com http://www.b.com"),
        (strip.strip_ui, "a\nSaiba mais em x\nb", "a\n\nb"),
        (strip.strip_inline_references, "SILVA, João. Livro. Disponível em: x.", ""),
        (strip.polish, "**1. **item\n***ad hoc*** ***A primeira***\n12345abc", "1. item\n*ad hoc* **A primeira**\n12345 abc"),
        (strip.strip_inline_marks, "***a*** **b** *c* [d](e)", "a b c d"),
        (strip.strip_yaml, "---\na: 1\n---\nx\n---", "x\n---"),
        (strip.strip_yaml, "---\na: 1\nx", "---\na: 1\nx"),
        (structure.contents, "# Um Dois\n## Três!\n### d", "## Sumário\n\n- [Um Dois](#um-dois)\n  - [Três!](#três)\n    - [d](#d)\n"),
        (structure.format_signature, "x\nNestes termos\nANA SILVA\nOAB/SP 12", "x\n\n---\n\nNestes termos\n\n**ANA SILVA**\n**OAB/SP 12**"),
        (structure.italicize_summary, "PETIÇÃO\nresumo\n1. Fatos", "PETIÇÃO\n*resumo*\n1. Fatos"),
        (enrich.insert_callouts, "Atenção: x\n# t", "> [!IMPORTANT]\n> Atenção: x\n# t"),
        (light.join_lines, "a casa de\nMaria de\nRita\nfim", "a casa de Maria de\nRita\nfim"),
        (scalars.slug, "Título de Teste!", "título-de-teste"),
        (scalars.nfc, "café", "café"),
    ],
)
def test_rewrites(spark, fn, before, after):
    assert apply(spark, fn, before) == after


def test_headings_by_mode(spark):
    lines = ["I – DOS FATOS", "3. DO DIREITO", "PETIÇÃO INICIAL", "AO JUÍZO DA VARA", "DOS PEDIDOS", "II.1 – tema", "a) item", "1.1. sub", "Da responsabilidade", "texto", "1.2.3 fundo"]
    want = ["## I – DOS FATOS", "## 3. DO DIREITO", "# PETIÇÃO INICIAL", "## AO JUÍZO DA VARA", "## DOS PEDIDOS", "### II.1 – tema", "a) item", "1.1. sub", "### Da responsabilidade", "texto", "#### 1.2.3 fundo"]
    got = apply(spark, lambda t: structure.mark_headings(t, "forense"), *lines)
    assert got == want
    assert apply(spark, lambda t: structure.mark_headings(t, "doutrina"), "CAPÍTULO II - Da posse", "1. O que é isto", "2.3. Sub") == ["# CAPÍTULO II - Da posse", "1. O que é isto", "### 2.3. Sub"]
    assert apply(spark, lambda t: structure.mark_headings(t, "google"), "# Título", "Autor: Ana", "texto") == ["**Título**", "**Autor: Ana**", "texto"]


def test_languages_and_areas(spark):
    en = "the court and the judge have been in this case for the law and the section that was not " * 2
    pt = "o juiz do tribunal que não foi para a sentença do processo com a lei da parte por uma " * 2
    assert apply(spark, enrich.detect_language, en, pt, "curto", None) == ["eng", "por", "por", "por"]
    assert [tuple(x) for x in apply(spark, enrich.legal_area, "o crime de furto e roubo", "nada", None)] == [("Direito Penal", "Crimes contra o patrimônio"), ("Direito Civil", "Geral"), ("Direito Civil", "Geral")]
    assert apply(spark, enrich.tag_list, "casa casa livro livro mesa") == ["casa", "livro", "mesa"]
    pages = spark.createDataFrame([(1, i, pt if i % 3 == 1 else en) for i in range(30)] + [(2, 0, "x")], "doc_id int, page_idx int, text string")
    assert {r["doc_id"]: r["language"] for r in enrich.vote_language(pages).collect()} == {1: "eng", 2: "por"}


def test_repeated_lines_both_ways(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(["Rodapé 1", "Rodapé 22", "Dos fatos", "abc", "linha única " + str(rng.random()), "x" * 70]) for _ in range(rng.randint(15, 30))) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = cleaning.remove_repeated_lines(docs).orderBy("doc_id", "line_no").collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append(r["line"])
    assert ["\n".join(whole[i]) for i in range(len(texts))] == apply(spark, cleaning.remove_repeated, *texts)


def test_pieces_both_ways(spark):
    text = "abertura\nPETIÇÃO INICIAL\num\n## SENTENÇA\ndois\n\n"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = [(r["title"], r["content"]) for r in structure.pieces(docs).orderBy("piece_no").collect()]
    assert rows == [("Documento Principal", "abertura"), ("PETIÇÃO INICIAL", "PETIÇÃO INICIAL\num"), ("SENTENÇA", "## SENTENÇA\ndois")]
    assert [tuple(p) for p in apply(spark, structure.piece_array, text)] == rows


def test_metadata(spark):
    text = "PETIÇÃO INICIAL\nAutor: JOSÉ DA SILVA, CPF nº 123.456.789-00\nRéu: Banco X\nComarca de Santos - SP\npedido liminar\n61 de março de 2020 e 4 de abril de 2021\nindenização por danos morais"
    yaml = apply(spark, lambda t: metadata.front_matter(t, F.lit("a_b (1).txt"), F.lit(datetime.date(2024, 1, 2)), True, True), text)
    for line in ('titulo: "PETIÇÃO INICIAL"', 'data: "4 de abril de 2021"', 'tipo_peca: "Petição Inicial"', 'pedido_liminar: "true"', 'comarca: "Santos"', 'autor: "JOSÉ DA SILVA (CPF: 123.456.789-00)"', 'acoes_cumuladas: "indenização por danos morais"', 'convertido_em: "2024-01-02"'):
        assert line in yaml.split("\n")
    assert apply(spark, lambda t: metadata.title(t, F.lit("meu_arquivo (1).pdf")), "") == "meu arquivo"
    assert apply(spark, lambda t: metadata.title(t, F.lit("")), "MARIA SOUZA\nManual de Direito Civil. 2ª ed") == "Manual de Direito Civil"


def test_page_lists(spark):
    assert apply(spark, lambda t: layout.page_list(t, F.lit(6)), "1,5, 2-3,9", "", None, "4-99") == [[0, 1, 2, 4], [0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5], [3, 4, 5]]
    for bad in ("0", "3-2", "x", "1-"):
        with pytest.raises(Exception, match="not a page list"):
            apply(spark, lambda t: layout.page_list(t, F.lit(6)), bad)


def test_headers_footers_and_columns(spark):
    blocks = [(1, p, b, 0, x, y, x + 200, y + 20, f"{t} {p}") for p in range(6) for b, (x, y, t) in enumerate([(50.0, 20.0, "Cabeçalho"), (50.0, 300.0 + 7 * p, "corpo"), (350.0, 100.0, "direita"), (350.0, 400.0, "direita"), (50.0, 500.0, "corpo")])]
    b = spark.createDataFrame(blocks, "doc_id long, page_idx int, blk_idx int, type int, x0 double, y0 double, x1 double, y1 double, text string")
    p = spark.createDataFrame([(1, i, 612.0, 792.0) for i in range(6)], "doc_id long, page_idx int, width double, height double")
    assert {(r["page_idx"], r["blk_idx"]) for r in layout.header_footer_blocks(b, p).collect()} == {(i, 0) for i in range(6)}
    assert all(r["two_columns"] for r in layout.two_columns(b, p).collect())
    order = [r["blk_idx"] for r in layout.reading_order(b, p).filter("page_idx = 0").orderBy("pos").collect()]
    assert order == [0, 1, 4, 2, 3]
    plain = layout.page_texts(b, p, columns=False).filter("page_idx = 0").first()["text"]
    assert "Cabeçalho" not in plain and plain.startswith("corpo 0")
    rects = spark.createDataFrame([(1, 0, 40.0, 290.0, 260.0, 330.0)], "doc_id long, page_idx int, x0 double, y0 double, x1 double, y1 double")
    assert layout.outside_tables(b, rects).count() == len(blocks) - 1


def test_page_texts_with_tables_and_empty_pages(spark):
    one = [(1, 0, 50.0, 300.0, "b"), (1, 1, 50.0, 500.0, " a "), (1, 2, 50.0, 700.0, "c")]
    two = [(2, b, x, y, t) for b, (x, y, t) in enumerate([(50.0, 400.0, "l2"), (350.0, 100.0, "r1"), (50.0, 300.0, "l1"), (350.0, 400.0, "r2")])]
    b = spark.createDataFrame([(d, 0, k, 0, x, y, x + 200, y + 20, t) for d, k, x, y, t in one + two], "doc_id long, page_idx int, blk_idx int, type int, x0 double, y0 double, x1 double, y1 double, text string")
    p = spark.createDataFrame([(d, 0, 612.0, 792.0) for d in (1, 2, 3, 4)], "doc_id long, page_idx int, width double, height double")
    rects = spark.createDataFrame([(d, 0, 40.0, 290.0, 260.0, 330.0) for d in (1, 2)], "doc_id long, page_idx int, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([(d, 0, k, f"|t{k}|") for d in (1, 2, 3) for k in (1, 0)], "doc_id long, page_idx int, tbl_idx int, markdown string")
    texts = lambda *a, **k: {r["doc_id"]: r["text"] for r in layout.page_texts(b, p, *a, **k).collect()}
    assert texts(rects, tables) == {1: "a\nc\n|t0|\n|t1|", 2: "l1\nl2\nr1\nr2", 3: "|t0|\n|t1|", 4: ""}
    assert texts(rects, tables, columns=False) == {1: "a\nc\n|t0|\n|t1|", 2: "l2\nr1\nr2\n|t0|\n|t1|", 3: "|t0|\n|t1|", 4: ""}
    assert texts() == {1: "b\na\nc", 2: "l1\nl2\nr1\nr2", 3: "", 4: ""}


def test_page_cache(spark):
    cache = spark.createDataFrame([("a", "por", "um", datetime.datetime(2024, 1, 1)), ("a", "por", "dois", datetime.datetime(2024, 2, 1)), ("b", "por", " ", datetime.datetime(2024, 2, 1))], "page_hash string, lang string, text string, created_at timestamp")
    put = layout.cache_put(cache.limit(0), cache)
    assert [r["text"] for r in put.collect()] == ["dois"]
    known, missing = layout.cached_pages(spark.createDataFrame([("a", "por"), ("b", "por")], "page_hash string, lang string"), put)
    assert known.count() == missing.count() == 1
    assert layout.cache_expire(cache, 10, F.lit(datetime.datetime(2024, 2, 2))).count() == 2
    assert layout.cache_stats(put).first()["entries"] == 1


def test_unicode_rules(spark):
    assert apply(spark, lambda t: rx.sub(t, r"\w", "X"), "ação é") == "XXXX X"
    assert apply(spark, rx.strip, "  a  ") == "a"
    assert apply(spark, lambda t: rx.has(t, "ç", "i"), "Ç")


def test_pipeline_rows(spark):
    text = "PETIÇÃO INICIAL\n\nI – DOS FATOS\nO autor cele-\nbrou contrato.\n\n3. DO DIREITO\nx\n5. DOS PEDIDOS\ny\n"
    docs = spark.createDataFrame([(1, "a.txt", text), (2, "b.txt", None), (3, None, "  ")], "doc_id long, filename string, text string")
    for mode in ("forense", "doutrina", "google"):
        got = convert(docs, Options(mode=mode, separate=True, generate_toc=True, output_format="html"), datetime.date(2024, 1, 1)).orderBy("doc_id").collect()
        assert [r["success"] for r in got] == [True, False, False]
        assert "celebrou" in got[0]["markdown"] and got[0]["html"].startswith("<!DOCTYPE html>")
    first = convert(docs, Options(), datetime.date(2024, 1, 1))
    assert "## 4. [SEÇÃO SEM TÍTULO DETECTADO]" in first.orderBy("doc_id").first()["markdown"]
    assert rollup(first).first().asDict() == {"total": 3, "converted": 1, "failed": 2}


def test_options(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"mode": "doutrina", "unknown": 1}')
    assert load(str(path), {"separate": True, "mode": None}) == Options(mode="doutrina", separate=True)
    with pytest.warns(UserWarning):
        assert load(str(tmp_path / "none.json")) == Options()
    with pytest.raises(ValueError):
        Options(mode="x")


def test_sinks():
    md = "---\na: 1\n---\n# T & x\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n\n- i\n\n**b** [l](u)\n\n---\n#### h4"
    html = sinks.to_html(md)
    for part in ("<title>T &amp; x</title>", "<th>a</th>", "<blockquote>", "<li>i</li>", "<strong>b</strong>", '<a href="u">l</a>', "<hr>", "<h4>h4</h4>"):
        assert part in html
    assert sinks.to_docx(md) == sinks.to_docx(md)


def test_semantic_format_reads_a_text_once(spark):
    docs = spark.createDataFrame([("o contrato e o Contrato, ad hoc no STF\n# posse STF\nmiguel reale, posse e Posse *data venia*",)], "text string")
    out = docs.select(enrich.semantic_format(F.col("text")).alias("text"))
    assert out.first()[0] == "o **contrato** e o Contrato, *ad hoc* no **STF**\n# posse STF\n**MIGUEL REALE**, **posse** e Posse *data venia*"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") + plan.count("regexp_extract_all(") + plan.count("RLIKE") == 1


def test_tags_shuffle_a_few_words_a_document(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, *(getattr(store, f"stageList$default${i}")() for i in (4, 5)))
    written = lambda: (lambda found: sum(found.apply(i).shuffleWriteRecords() for i in range(found.size())))(stages())
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    docs = spark.createDataFrame([(d, " ".join(word(d * 400 + i) for i in range(400))) for d in range(50)], "doc_id long, text string")
    before = written()
    assert enrich.tags(docs).count() == 250
    assert written() - before < 50 * 20
    twice = spark.createDataFrame([(1, "muro casa"), (1, "casa"), (None, "muro muro casa"), (None, "casa casa"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, enrich.tags(twice).collect()), key=str) == sorted([(1, 1, "casa", 2), (1, 2, "muro", 1), (None, 1, "casa", 3), (None, 2, "muro", 2)], key=str)


def test_a_carriage_return_costs_no_character(spark):
    assert apply(spark, paragraphs.rejoin_paragraphs, "uma linha\n\r1. A segue") == "uma linha\n\r1. A segue"
    assert apply(spark, blocks.separate_items, "uma\r1 linha") == "uma\r1 linha"


def test_lines_are_coded_once(spark):
    docs = spark.createDataFrame([("1. DOS\nFATOS",)], "text string")
    plan = lambda fn: docs.select(fn(F.col("text")).alias("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(lambda t: paragraphs.rebuild_headings(t, True)).count("PRELIMINAR|") == 1
    rejoined = plan(lambda t: paragraphs.rejoin_paragraphs(t, True))
    assert "regexp_replace(" not in rejoined and rejoined.count("RLIKE") <= 6
    assert plan(blocks.separate_items).count("RLIKE") == 0
