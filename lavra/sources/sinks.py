"""Markdown to HTML and DOCX, and writers of results."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLE = "body{max-width:50em;margin:2em auto;font-family:Georgia,serif;line-height:1.6}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em .6em}blockquote{border-left:4px solid #999;margin-left:0;padding-left:1em}"
_MARKS = ((r"\*\*\*(.+?)\*\*\*", "b i"), (r"\*\*(.+?)\*\*", "b"), (r"\*(.+?)\*", "i"))


def without_yaml(text: str) -> str:
    lines = text.split("\n")
    if lines[0].strip() == "---":
        for i, line in enumerate(lines[1:], 1):
            if line.strip() == "---":
                return "\n".join(lines[i + 1 :])
    return text


def blocks(text: str) -> Iterator[tuple[str, object]]:
    """Kinds of Markdown blocks with what they hold: ``h1``.. ``h6``, table, quote, list, rule, code, p."""
    lines = without_yaml(text).split("\n")
    i = 0

    def run(start: int, test) -> int:
        while start < len(lines) and test(lines[start].strip()):
            start += 1
        return start

    while i < len(lines):
        s = lines[i].strip()
        m = re.match(r"(#{1,6})\s+(.*)", s)
        if not s:
            i += 1
        elif s.startswith("```"):
            j = run(i + 1, lambda x: not x.startswith("```"))
            yield "code", "\n".join(lines[i + 1 : j])
            i = j + 1
        elif m:
            yield f"h{len(m[1])}", m[2]
            i += 1
        elif s.startswith("|"):
            j = run(i, lambda x: x.startswith("|"))
            rows = [[c.strip() for c in re.sub(r"^\||\|$", "", x.strip()).split("|")] for x in lines[i:j]]
            yield "table", [r for r in rows if not all(re.fullmatch("[-: ]*", c) for c in r) or not any(r)]
            i = j
        elif s.startswith(">"):
            j = run(i, lambda x: x.startswith(">"))
            yield "quote", [x.strip()[1:].strip() for x in lines[i:j]]
            i = j
        elif re.match(r"[-*] ", s):
            j = run(i, lambda x: bool(re.match(r"[-*] ", x)))
            yield "list", [x.strip()[2:] for x in lines[i:j]]
            i = j
        elif s in ("---", "***"):
            yield "rule", None
            i += 1
        else:
            j = run(i, lambda x: bool(x) and not re.match(r"#{1,6}\s|[|>]|[-*] |```|---$|\*\*\*$", x))
            yield "p", [x.strip() for x in lines[i : max(j, i + 1)]]
            i = max(j, i + 1)


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    out = re.sub(r"!\[(.*?)\]\((.+?)\)", r'<img alt="\1" src="\2">', out)
    out = re.sub(r"\[(.+?)\]\((.+?)\)", r'<a href="\2">\1</a>', out)
    for pattern, tags in _MARKS:
        names = {"b": "strong", "i": "em"}
        opened = "".join(f"<{names[t]}>" for t in tags.split())
        closed = "".join(f"</{names[t]}>" for t in reversed(tags.split()))
        out = re.sub(pattern, rf"{opened}\1{closed}", out)
    return out


def to_html(text: str, title: str = "") -> str:
    """A page of HTML; its title is ``title``, else that of the first first-level heading."""
    body, found = [], title
    for kind, held in blocks(text):
        if kind[0] == "h":
            found = found or (held if kind == "h1" else "")
            body.append(f"<{kind}>{_inline(held)}</{kind}>")
        elif kind == "table":
            rows = ["".join(f"<{t}>{_inline(c)}</{t}>" for c in r) for t, r in zip(["th", *["td"] * len(held)], held, strict=False)]
            body.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
        elif kind == "list":
            body.append("<ul>" + "".join(f"<li>{_inline(x)}</li>" for x in held) + "</ul>")
        elif kind == "quote":
            body.append("<blockquote><p>" + "<br>".join(map(_inline, held)) + "</p></blockquote>")
        elif kind == "code":
            body.append(f"<pre><code>{html.escape(held, quote=False)}</code></pre>")
        else:
            body.append("<hr>" if kind == "rule" else "<p>" + "\n".join(map(_inline, held)) + "</p>")
    head = f'<meta charset="utf-8"><title>{html.escape(found, quote=False)}</title><style>{STYLE}</style>'
    return f"<!DOCTYPE html>\n<html><head>{head}</head>\n<body>\n" + "\n".join(body) + "\n</body></html>\n"


def plain(text: str) -> str:
    """Without bold, italics and links."""
    for pattern, _ in (*_MARKS, (r"\[(.+?)\]\(.+?\)", "")):
        text = re.sub(pattern, r"\1", text)
    return text


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def to_docx(text: str) -> bytes:
    """A DOCX file: three levels of headings, tables, quotes indented in italics, bullets, rules, plain paragraphs."""

    def p(s: str, style: str = "", italic: bool = False, indent: int = 0) -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:ind w:left="{indent}"/>' if indent else "")
        run = "<w:rPr><w:i/></w:rPr>" if italic else ""
        return f'<w:p><w:pPr>{props}</w:pPr><w:r>{run}<w:t xml:space="preserve">{html.escape(s, quote=False)}</w:t></w:r></w:p>'

    body = []
    for kind, held in blocks(text):
        if kind in ("h1", "h2", "h3"):
            body.append(p(held, f"Heading{kind[1]}"))
        elif kind[0] == "h":
            body.append(p(plain(f"{'#' * int(kind[1])} {held}")))
        elif kind == "table" and held:
            n = max(map(len, held))
            cells = lambda r: "".join(f"<w:tc>{p(c)}</w:tc>" for c in [*r, *[""] * n][:n])  # noqa: B023, E731
            body.append("<w:tbl>" + "".join(f"<w:tr>{cells(r)}</w:tr>" for r in held) + "</w:tbl>")
        elif kind == "quote":
            body += [p(x, italic=True, indent=720) for x in held]
        elif kind == "list":
            body += [p(x, "ListBullet") for x in held]
        elif kind == "rule":
            body.append(p("─" * 50))
        elif kind == "code":
            body += [p(x) for x in held.split("\n")]
        elif kind == "p":
            body += [p(plain(x)) for x in held]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>')):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def _column(made, kind: str, text: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else made(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(text)


def html_column(text: Column) -> Column:
    return _column(to_html, "string", text)


def docx_column(text: Column) -> Column:
    return _column(to_docx, "binary", text)


#: The column that holds a document in each output format.
FORMATS = {"md": "markdown", "html": "html", "docx": "docx"}


def write_results(results: DataFrame, path: str) -> None:
    """One row a document as Parquet, with the column of its output format; any store, any number of executors."""
    results.select("doc_id", "filename", "output_format", *FORMATS.values(), "success", "error").write.mode("overwrite").partitionBy("output_format").parquet(path)


def _named(results: DataFrame) -> DataFrame:
    """``name, body`` of the successful documents; where files differ in the suffix only, ``doc_id`` tells them apart."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    body = F.when(F.col("output_format") == "docx", F.col("docx"))
    for fmt in ("md", "html"):
        body = F.when(F.col("output_format") == fmt, F.encode(FORMATS[fmt], "UTF-8")).otherwise(body)
    good = results.filter("success").select("doc_id", stem.alias("stem"), "output_format", body.alias("body"))
    twice = results.filter("success").select(stem.alias("stem")).groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1")
    name = F.concat("stem", F.when(F.col("n").isNotNull(), F.concat(F.lit("-"), F.col("doc_id").cast("string"))).otherwise(F.lit("")), F.lit("."), "output_format")
    return good.join(twice, "stem", "left").select(name.alias("name"), "body")


def write_files(results: DataFrame, uri: str) -> int:
    """Writes each successful document as a ``.md``, ``.html`` or ``.docx`` file below ``uri``; returns how many.

    Tasks write what they hold, to any store that pyarrow's file systems reach and all executors share; a task that runs
    again writes the same files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for b in batches:
            for name, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with store.open_output_stream(f"{base}/{name}") as f:
                    f.write(body.as_py())
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    return _named(results).mapInArrow(put, "name string").count()


def bundle(results: DataFrame, limit: int = 10_000) -> bytes:
    """A ZIP of the successful documents in their output format, on the driver: at most ``limit``, counted first."""
    rows = _named(results)
    if (n := rows.count()) > limit:
        raise ValueError(f"{n} documents are too many for one ZIP file; write_files and write_results take any number")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows.toLocalIterator():
            z.writestr(r["name"], bytes(r["body"]))
    return out.getvalue()
