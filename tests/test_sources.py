import zipfile

import pytest
from pyspark.sql import functions as F

from lavra.plans.options import Options
from lavra.plans.pipeline import convert_folder
from lavra.sources import files, sinks
from lavra.streaming.ingest import ingest


def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.txt").write_bytes("ação um".encode())
    (at / "b.md").write_bytes("ação dois".encode("latin-1"))
    (at / "c.docx").write_bytes(sinks.to_docx("# Título\n\ntexto **forte**\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## Sub"))
    (at / "d.docx").write_bytes(b"broken")
    (at / "e.xyz").write_bytes(b"x")
    with zipfile.ZipFile(at / "f.zip", "w") as z:
        z.writestr("x/one.md", "um")
        z.writestr("two.bin", "dois")
    return str(at)


def test_no_option_that_nothing_reads(tmp_path):
    from dataclasses import fields
    from pathlib import Path

    from lavra.__main__ import parser
    from lavra.plans import options, pipeline

    code = Path(pipeline.__file__).read_text()
    assert [f.name for f in fields(Options) if f"o.{f.name}" not in code] == []
    with pytest.raises(SystemExit):
        parser().parse_args(["in", "out", "--ocr-lang", "por"])
    (tmp_path / "o.json").write_text('{"ocr_lang": "por", "separate": true}')
    with pytest.warns(UserWarning, match="ocr_lang"):
        assert options.load(str(tmp_path / "o.json")) == Options(separate=True)


def test_files(spark, tmp_path):
    read = files.read_files(spark, folder(tmp_path))
    got = {r["filename"]: r for r in files.extract(read).collect()}
    assert len({got[n]["seq"] for n in got}) == 6
    assert got["a.txt"]["text"] == "ação um" and got["b.md"]["text"] == "ação dois"
    docx = got["c.docx"]["text"]
    assert docx.startswith("# Título") and "| a | b |" in docx and "## Sub" in docx and docx.index("texto forte") < docx.index("| a") < docx.index("## Sub")
    assert got["d.docx"]["error"] and got["e.xyz"]["error"] == "unknown suffix: .xyz"
    assert [(r["member"], bytes(r["content"])) for r in files.zip_members(read).collect()] == [("x/one.md", b"um")]


def test_folder_and_sinks(spark, tmp_path):
    got = convert_folder(spark, folder(tmp_path), Options(), "*.*")
    rows = {r["filename"]: r for r in got.collect()}
    assert rows["a.txt"]["success"] and not rows["d.docx"]["success"] and rows["d.docx"]["error"]
    sinks.write_results(got, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
    assert sinks.bundle(got)[:2] == b"PK"


@pytest.mark.parametrize("fmt", ["md", "html", "docx"])
def test_each_document_becomes_a_file(spark, tmp_path, fmt):
    got = convert_folder(spark, folder(tmp_path), Options(output_format=fmt), "*.*").cache()
    good = {r["filename"]: r for r in got.filter("success").collect()}
    twice = got.unionByName(got.withColumn("filename", F.regexp_replace("filename", "[.]txt$", ".md")).withColumn("doc_id", F.col("doc_id") + 1))
    assert sinks.write_files(twice, f"file://{tmp_path}/files") == 2 * len(good)
    written = {p.name for p in (tmp_path / "files").iterdir()}
    assert len(written) == 2 * len(good) and all(n.endswith("." + fmt) for n in written)
    name = next(iter(good)).rsplit(".", 1)[0]
    row = good[next(iter(good))]
    want = bytes(row["docx"]) if fmt == "docx" else row["html" if fmt == "html" else "markdown"].encode()
    assert (tmp_path / "files" / f"{name}-{row['doc_id']}.{fmt}").read_bytes() == want
    got.unpersist()


def test_stream_is_the_batch(spark, tmp_path):
    at = folder(tmp_path)
    q = ingest(spark, at, f"{tmp_path}/results", f"{tmp_path}/state")
    q.awaitTermination(120)
    got = {r["filename"]: r["success"] for r in spark.read.parquet(f"{tmp_path}/results").collect()}
    assert got == {r["filename"]: r["success"] for r in convert_folder(spark, at).collect()}


def test_command_line(spark, tmp_path, capsys):
    from lavra.__main__ import main, parser

    assert main([folder(tmp_path), f"{tmp_path}/cli", "--glob", "*.txt", "--mode", "doutrina", "--no-strip-footnotes"]) == 0
    assert "1 documents: 1 converted, 0 failed" in capsys.readouterr().out
    assert parser().parse_args(["a", "b", "--separate"]).separate is True


class Page:
    """Stands in for a page of the PDF library."""

    def __init__(self, blocks, tables=()):
        self.blocks, self.rect = blocks, type("R", (), {"width": 612, "height": 842})
        self.tables = [type("T", (), {"bbox": box, "extract": lambda self, rows=rows: rows})() for box, rows in tables]

    def get_text(self, kind):
        return {"blocks": [{"type": 0, "bbox": box, "lines": [{"spans": [{"text": t}]}]} for box, t in self.blocks]}

    def find_tables(self):
        return type("F", (), {"tables": self.tables})


def test_pages_of_a_pdf(spark):
    foot = ((50, 800, 200, 815), "Rua das Flores, 1")
    pages = [Page([((50, 150 + 20 * i, 300, 165 + 20 * i), f"linha {i} de {n}") for i in range(3)] + [foot]) for n in range(4)]
    pages.append(Page([((50, 100, 250, 110), "e1"), ((50, 300, 250, 310), "e2"), ((350, 90, 550, 99), "d1"), ((350, 200, 550, 210), "d2"), ((320, 500, 550, 510), "d3")]))
    pages.append(Page([((50, 100, 300, 115), "antes"), ((100, 300, 200, 310), "na tabela")], [((90, 290, 400, 400), [["a", "b"], ["1", None]])]))
    rows = []
    for n, page in enumerate(pages):
        rows.append(("1", "page", n, 0, 0, 612.0, 842.0, 0.0, 0.0, 612.0, 842.0, ""))
        rows += [("1", "block", n, i, 0, 612.0, 842.0, *map(float, b["bbox"]), b["lines"][0]["spans"][0]["text"]) for i, b in enumerate(page.get_text("dict")["blocks"])]
        rows += [("1", "table", n, i, 0, 612.0, 842.0, *map(float, t.bbox), files.pipe_table([[c or "" for c in r] for r in t.extract()])) for i, t in enumerate(page.tables)]
    rows.append(("2", "error", 0, 0, 0, *[0.0] * 6, "broken"))
    parts = spark.createDataFrame(rows, files.PARTS)
    got = {r["path"]: r for r in files.pdf_texts(parts).collect()}
    body = [f"linha {i} de {n}" for n in range(4) for i in range(3)]
    assert got["1"]["text"].split("\n") == [*body, "e1", "e2", "d1", "d2", "d3", "antes", "| a | b |", "| --- | --- |", "| 1 |  |"]
    assert got["2"]["text"] is None and got["2"]["error"] == "broken"
    assert {r["path"]: r for r in files.pdf_texts(parts, "2, 9").collect()}["1"]["text"].split("\n") == body[3:6]


def test_a_pdf_is_read_page_by_page(monkeypatch):
    import sys
    import types

    class Doc(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    fitz = types.ModuleType("fitz")
    fitz.open = lambda stream, filetype: Doc([Page([((1, 2, 3, 4), "um")], [((5, 6, 7, 8), [["a"], [" b\nc"]])])])
    monkeypatch.setitem(sys.modules, "fitz", fitz)
    got = files.pdf_rows("a.pdf", b"")
    assert [r[1] for r in got] == ["page", "block", "table"] and got[1][7:] == (1.0, 2.0, 3.0, 4.0, "um") and got[2][-1] == "| a |\n| --- |\n| b c |"
    monkeypatch.setitem(sys.modules, "fitz", None)
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        files.pdf_rows("a.pdf", b"")


def test_encodings_are_found(spark):
    pt = "A decisão não é válida: São Paulo, ação e omissão. “Citação” – fim… Ébano, CORAÇÃO, até às três."
    plain = pt.translate(str.maketrans({"“": '"', "”": '"', "–": "-", "…": "."}))
    pl, ru = "Zażółć gęślą jaźń; łódź i źródło są tu, więc idź.", "Привет, мир! Это решение суда не является окончательным."
    cases = [(pt, e) for e in ("utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "cp1252", "mac-roman")]
    cases += [(plain, "iso8859-1"), (pl, "iso8859-2"), (ru, "cp1251"), (ru, "utf-8"), ("plain", "ascii"), ("", "utf-8"), ("café", "latin-1"), ("¿qué?", "cp1252"), ("«Élan»", "cp1252")]
    rows = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (t, e) in enumerate(cases)] + [(99, None)], "i int, b binary")
    got = {r["i"]: r["x"] for r in rows.select("i", files.decode(F.col("b")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for t, _ in cases] and got[99] is None
