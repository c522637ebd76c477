"""Files to documents: text, Markdown, DOCX, PDF (if its library is there), ZIP members.

``read_files`` gives one row a file with ``path, filename, ext, content, seq``; ``extract`` adds ``text`` and ``error``.
A file that cannot be read becomes an error in its row and stops no other.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.lines import let
from lavra.operators import layout

SUFFIXES = (".pdf", ".docx", ".txt", ".md")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The files of a folder, not of folders below it; ``seq`` is a number of the path, so no file's bytes are shuffled."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), "content", F.xxhash64("path").alias("seq"))


def _page(name: str) -> str:
    """The signs of the upper half of a one-byte encoding; a byte without a sign stays a control."""
    return "".join(bytes([i]).decode(name, "ignore") or chr(i) for i in range(0x80, 0x100))


#: One-byte encodings in the order in which they win ties.
PAGES = ["cp1252", "iso8859-2", "cp1251", "mac-roman"]
_LATIN_1 = "".join(map(chr, range(0x80, 0x100)))
#: What speaks for an encoding: accented small letters inside words of plain ones, words of Cyrillic letters, marks before words.
LIKELY = r"(?<=[a-z])[\p{Ll}&&[\u00df-\u024f]]|[\p{Ll}&&[\u00df-\u024f]](?=[a-z])|[\u0410-\u044f]{2,}|(?<!\p{L})[\u00bf\u00a1](?=\p{L})|[\u00ab\u00bb]"
#: What speaks against it: signs and controls inside words, accented capitals behind small letters, many accents in a row, two scripts in a word.
UNLIKELY = r"(?<=\p{L})[^\p{L}\p{M}\p{N}\s\p{Punct}\u2010-\u2026\u00ba\u00aa\u00b4](?=\p{L})|[\u0080-\u009f]|(?<=\p{Ll})[\u00c0-\u00de](?=\p{Ll})|[\u00c0-\u024f]{4,}|(?<=[A-Za-z])[\u0400-\u04ff]|[\u0400-\u04ff](?=[A-Za-z])"


def decode(content: Column) -> Column:
    """Bytes as text, by what they are: UTF-8 where valid, UTF-16 by its mark or by the zeros between letters, else the one-byte
    encoding whose words are the most likely ones.

    Marks at the front are dropped; what the first test settles is not looked at any further; null gives null.
    """
    starts = lambda mark: F.substring(content, 1, len(mark)) == F.lit(mark)
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    body = F.when(starts(b"\xef\xbb\xbf"), rest(3)).otherwise(content)
    latin = F.decode(content, "iso-8859-1")

    def one_byte(text: Column) -> Column:
        read = F.array(*(F.translate(text, _LATIN_1, _page(p)) for p in PAGES))
        score = lambda t: F.regexp_count(t, F.lit(LIKELY)) - 3 * F.regexp_count(t, F.lit(UNLIKELY))
        return let(read, lambda ts: let(F.transform(ts, score), lambda found: F.get(ts, (F.array_position(found, F.array_max(found)) - 1).cast("int"))))

    def zeros(text: Column) -> Column:
        """UTF-16 without a mark: letters of most scripts in texts have a zero byte, always before or always behind."""
        behind, before = (F.regexp_count(text, F.lit(p)) for p in (r"(?s)\G(?:..)*?[^\x00]\x00", r"(?s)\G(?:..)*?\x00[^\x00]"))
        wide = (F.octet_length(content) % 2 == 0) & (4 * F.char_length(F.regexp_replace(text, r"[^\x00]", "")) > F.octet_length(content))
        return F.when(~wide, one_byte(text)).when(behind >= before, F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "UTF-16BE"))

    return (
        F.when(starts(b"\xff\xfe"), F.decode(rest(2), "UTF-16LE")).when(starts(b"\xfe\xff"), F.decode(rest(2), "UTF-16BE"))
        .when(F.is_valid_utf8(body.cast("string")) & ~latin.contains("\0"), F.decode(body, "UTF-8")).otherwise(let(latin, zeros))
    )


def _marks(run: ElementTree.Element) -> tuple[bool, bool]:
    on = lambda name: (e := run.find(f"{W}rPr/{W}{name}")) is not None and e.get(f"{W}val") not in ("0", "false")
    return on("b"), on("i")


def _run_text(run: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag in (f"{W}br", f"{W}cr") else "" for e in run)


def _paragraph(p: ElementTree.Element, marks: bool) -> str:
    parts = []
    for run in p.iter(f"{W}r"):
        text = _run_text(run)
        bold, italic = _marks(run) if marks else (False, False)
        sign = "***" if bold and italic else "**" if bold else "*" if italic else ""
        parts.append(f"{sign}{text}{sign}" if text.strip() else text)
    out = "".join(parts)
    for again in (r"\*{6}", r"(?<!\*)\*{4}(?!\*)"):
        out = re.sub(again, "", out)
    return re.sub(r"\*\*\s*\*\*", " ", out).strip()


def pipe_table(rows: list[list[str]]) -> str:
    """Rows of cells as a pipe table as wide as the first row."""
    if not rows:
        return ""
    n = len(rows[0])
    line = lambda r: "| " + " | ".join([*r, *[""] * n][:n]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * n), *map(line, rows[1:])])


def docx_text(content: bytes, marks: bool = True) -> str:
    """A DOCX body's paragraphs and tables in order; styles Title and Heading 1 to 4 as Markdown headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[str] = []
    for item in body if body is not None else ():
        if item.tag == f"{W}p":
            style = item.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val") or "").replace(" ", "").lower() if style is not None else ""
            level = 1 if name in ("title", "heading1", "ttulo1") else int(name[-1]) if re.fullmatch("(?:heading|ttulo)[2-4]", name) else 0
            text = _paragraph(item, marks and not level)
            out += [f"{'#' * level} {text}" if level else text, ""] if text else [""]
        elif item.tag == f"{W}tbl":
            rows = [[" ".join(t for p in cell.iter(f"{W}p") if (t := _paragraph(p, False))) for cell in row.findall(f"{W}tc")] for row in item.findall(f"{W}tr")]
            out += [pipe_table(rows), ""]
    return "\n".join(out)


#: Rows that ``pdf_parts`` makes of a PDF: its pages, their text blocks, their tables, or what went wrong.
PARTS = "path string, kind string, page_idx int, idx int, type int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string"


def pdf_rows(path: str, content: bytes) -> list[tuple]:
    """The rows of one PDF."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF needs the library PyMuPDF") from e
    out: list[tuple] = []
    with fitz.open(stream=content, filetype="pdf") as doc:
        for n, page in enumerate(doc):
            width, height = float(page.rect.width), float(page.rect.height)
            out.append((path, "page", n, 0, 0, width, height, 0.0, 0.0, width, height, ""))
            for i, b in enumerate(page.get_text("dict")["blocks"]):
                text = "\n".join("".join(span["text"] for span in line["spans"]) for line in b.get("lines", ()))
                out.append((path, "block", n, i, int(b.get("type", 0)), width, height, *map(float, b["bbox"]), text))
            found = page.find_tables() if hasattr(page, "find_tables") else None
            for i, t in enumerate(found.tables if found is not None else ()):
                rows = [[" ".join((c or "").split()) for c in r] for r in t.extract()]
                out.append((path, "table", n, i, 0, width, height, *map(float, t.bbox), pipe_table(rows)))
    return out


def pdf_parts(files: DataFrame) -> DataFrame:
    """``PARTS`` of PDF files (``path, content``); a file that cannot be read is one row of the kind ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = pdf_rows(path, content)
                except Exception as e:  # noqa: BLE001  a file's failure is its row's error
                    rows = [(path, "error", 0, 0, 0, *[0.0] * 6, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, PARTS)


def pdf_texts(parts: DataFrame, page_range: str = "", columns: bool = True) -> DataFrame:
    """``path, text, error`` of PDF files: pages without headers and footers, in reading order, with their tables as Markdown.

    Only the pages of ``page_range`` (as in ``page_list``) are kept; headers and footers are sought on all.
    """
    of = lambda kind: parts.filter(F.col("kind") == kind).withColumnRenamed("path", "doc_id")
    pages = of("page").select("doc_id", "page_idx", "width", "height")
    blocks = of("block").select("doc_id", "page_idx", F.col("idx").alias("blk_idx"), "type", "x0", "y0", "x1", "y1", "text")
    tables = of("table")
    texts = layout.page_texts(blocks, pages, tables.select("doc_id", "page_idx", "x0", "y0", "x1", "y1"), tables.select("doc_id", "page_idx", F.col("idx").alias("tbl_idx"), F.col("text").alias("markdown")), columns)
    if page_range.strip():
        total = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("total"))
        texts = texts.join(total, "doc_id").filter(F.array_contains(layout.page_list(F.lit(page_range), F.col("total")), F.col("page_idx")))
    whole = texts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_idx", "text"))).alias("r"))
    made = whole.select(F.col("doc_id").alias("path"), F.array_join("r.text", "\n").alias("text"), F.lit(None).cast("string").alias("error"))
    return made.unionByName(of("error").select(F.col("doc_id").alias("path"), F.lit(None).cast("string").alias("text"), F.col("text").alias("error")))


def extract(files: DataFrame, marks: bool = True, page_range: str = "", columns: bool = True) -> DataFrame:
    """Adds ``text`` and ``error`` by suffix.  Text files decode natively; only DOCX and PDF bytes reach Python.

    A PDF's parts are kept on disk while its pages are put together; parts lost with an executor are read again.
    """
    plain = F.col("ext").isin(".txt", ".md")

    def binary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text, error = [], []
            for content in part["content"]:
                try:
                    text.append(docx_text(content, marks))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  a file's failure is its row's error
                    text.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield part.assign(text=text, error=error)

    texts = files.filter(plain).select("*", decode(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    made = files.filter("ext = '.docx'").mapInPandas(binary, schema=f"{', '.join(f'`{n}` {t}' for n, t in files.dtypes)}, text string, error string")
    known = F.coalesce(F.col("ext").isin(*SUFFIXES), F.lit(False))
    others = files.filter(~known).select("*", F.lit(None).cast("string").alias("text"), F.concat(F.lit("unknown suffix: "), F.coalesce("ext", F.lit(""))).alias("error"))
    out = texts.unionByName(made).unionByName(others)
    pdf = files.filter("ext = '.pdf'")
    parts = pdf_parts(pdf).persist(StorageLevel.DISK_ONLY)
    return out.unionByName(pdf.join(pdf_texts(parts, page_range, columns), "path", "left").select(*files.columns, "text", "error"))


def zip_members(files: DataFrame, suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """``path, member, content`` of the text members of ZIP files; a broken ZIP has none."""

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = sorted(n for n in z.namelist() if n.lower().endswith(suffixes))
                        rows = [(path, n, z.read(n)) for n in names]
                except zipfile.BadZipFile:
                    rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "member", "content"])

    return files.filter("ext = '.zip'").select("path", "content").mapInPandas(members, "path string, member string, content binary")
