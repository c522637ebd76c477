"""Headings from plain lines, contents, pieces: rules tried in order, the first match wins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import rx, scalars
from lavra.functions.lines import exploded, islands, join, let, map_lines, split, stepped, where
from lavra.operators import blocks
from lavra.operators.paragraphs import CAPITAL, SMALL, loud

# The titles that are headings, by level.
TITLE_CHARS = rf"{CAPITAL}\s,§°º().\-:/\d"
PIECES_H1 = [r"PETIÇÃO\s+INICIAL", "CONTESTAÇÃO", "SENTENÇA", "ACÓRDÃO", r"RECURSO\s+", r"AGRAVO\s+", "APELAÇÃO", r"MANDADO\s+DE\s+SEGURANÇA", r"HABEAS\s+CORPUS"]
ADDRESSES = [r"EXCELENTÍSSIM[OA]\s+SENHOR[A]?\s+", r"AO\s+JUÍZ[OA]?\s+", r"AO\s+DOUTOR\s+JUIZ", r"AO\s+MERITÍSSIMO\s+", r"AO\s+MM\.?\s+JUIZ"]
SECTIONS_H2 = [
    r"[IVXLC]+\s*[-–—.]\s*DOS?\s+FATOS?", r"[IVXLC]+\s*[-–—.]\s*DO\s+DIREITO", r"[IVXLC]+\s*[-–—.]\s*D[AO]S?\s+FUNDAMENT", r"[IVXLC]+\s*[-–—.]\s*D[AO]S?\s+PEDIDO",
    r"[IVXLC]+\s*[-–—.]\s*D[AO]\s+MÉRITO", r"[IVXLC]+\s*[-–—.]\s*PRELIMINAR",
    r"DOS?\s+FATOS?\s*$", r"DO\s+DIREITO\s*$", r"D[AO]S?\s+FUNDAMENT\w*\s*$", r"D[AO]S?\s+PEDIDOS?\s*$", r"DO\s+MÉRITO\s*$", r"PRELIMINAR\w*\s*$", r"FUNDAMENTAÇÃO\s*JURÍDICA?\s*$",
    r"FUNDAMENTAÇÃO\s*$", r"RELATÓRIO\s*$", r"DISPOSITIVO\s*$", r"EMENTA\s*$", r"VOTO\s*$", r"D[AO]S?\s+PROVAS?\s*$", r"D[AO]\s+TUTELA\s+", r"CLÁUSULA\s+\w+",
]
SUBSECTIONS_H3 = [rf"D[ao]s?\s+[{SMALL}]", rf"Doe?\s+[{CAPITAL}][{SMALL}]"]
ENUMERATIONS = [r"[a-z]\)\s+", r"[a-z]\.\s+", r"[ivxlc]+\)\s+", r"[IVXLC]+\)\s+", r"[IVXLC]+\s*[-–—]\s+", r"\d+\)\s+", r"\d+\.\d+\.?\s+"]
#: How lines begin that ``forensic_heading`` may mark: by three characters, as the rules have them; one beyond ASCII may be any letter.
LIKELY = rf"^(?:[IVXLC\d*]|[ivxlc][IVXLCivxlc\s.\-]{{0,2}}$|.{{0,2}}[^\x00-\x7e]|{'|'.join(map(rx.either, ['pet', 'con', 'sen', 'rec', 'agr', 'ape', 'man', 'hab', 'exc', 'ao', 'da', 'do', 'pre', 'fun', 'rel', 'dis', 'eme', 'vot']))})"
BOOK_H1 = [r"PARTE\s+[IVXLC]+", r"CAPÍTULO\s+[IVXLC\d]+", r"TÍTULO\s+[IVXLC\d]+", r"LIVRO\s+[IVXLC\d]+"]
BOOK_H2 = [r"SEÇÃO\s+[IVXLC\d]+", r"SUBSEÇÃO\s+[IVXLC\d]+", rf"\d+\.\s+[{CAPITAL}]"]
BODY_VERBS = ["é", "são", "foi", "está", "pode", "deve", "tem", "há", "não", "já", "se", "como", "quando", "que", "para", "sendo", "tendo", "será", "seria", "foram", "estava"]
BOLD_STARTS = [
    r"EXCELENTÍSSIM[OA]\s+.", r"AO\s+JUÍZ[OA]?\s+.", r"AO\s+DOUTOR\s+.", r"AO\s+MERITÍSSIMO\s+.", r"AO\s+MM\.?\s+.", r"Processo\s+(?:de\s+origem\s+)?n[º°.]?\s*.", r"Procedimento\s+.",
    r"Autora?:\s*.", r"Réu:\s*.", r"Requerente:\s*.", r"Requerido:\s*.", r"Paciente:\s*.", r"Impetrante:\s*.", r"Autoridade\s+coatora:\s*.",
]
PIECE_STARTS = [
    r"PETIÇÃO\s+INICIAL", "CONTESTAÇÃO", "RÉPLICA", "RECONVENÇÃO", "SENTENÇA", "ACÓRDÃO", "DESPACHO", r"DECISÃO\s+(INTERLOCUTÓRIA|MONOCRÁTICA)", r"RECURSO\s+(DE\s+)?(APELAÇÃO|ESPECIAL|EXTRAORDINÁRIO|ORDINÁRIO)",
    r"AGRAVO\s+(DE\s+INSTRUMENTO|INTERNO|REGIMENTAL)", "APELAÇÃO", r"EMBARGOS\s+(DE\s+DECLARAÇÃO|INFRINGENTES)", r"MANDADO\s+DE\s+SEGURANÇA", r"HABEAS\s+CORPUS", "PARECER", r"LAUDO\s+(PERICIAL|TÉCNICO)",
    "CERTIDÃO", r"ATA\s+DE\s+AUDIÊNCIA", r"TERMO\s+DE\s+AUDIÊNCIA", r"CONTRA[\s-]?RAZÕES", r"RAZÕES\s+DE\s+APELAÇÃO", r"RAZÕES\s+DE\s+RECURSO", "MEMORIAL", "IMPUGNAÇÃO", "MANIFESTAÇÃO", r"ALEGAÇÕES\s+FINAIS",
    r"EXCELENTÍSSIM[OA]\s+SENHOR[A]?", r"AO\s+JUÍZ[OA]?\s+DE\s+DIREITO",
]
MAIN_PIECE = "Documento Principal"
CLOSINGS = r"^(?:Nestes\s+termos|Termos\s+em\s+que|Nesses\s+termos|Pede\s+deferimento|Respeitosamente|Atenciosamente|Data\s+supra|P\.\s*deferimento)"
PLACE_DATE = rf"^[A-ZÀ-Ú][{SMALL}]+(?:/[A-Z]{{2}})?,?\s+\d{{1,2}}\s+de\s+\w+\s+de\s+\d{{4}}"
BAR_NUMBER = r"OAB/[A-Z]{2}\s*(?:n[º°.]*\s*)?\d+"
PIECE_TITLES = ["PETIÇÃO", "CONTESTAÇÃO", "SENTENÇA", "ACÓRDÃO", r"HABEAS\s+CORPUS", "MANDADO", "RECURSO", "AGRAVO", "APELAÇÃO", "MANIFESTAÇÃO", "IMPUGNAÇÃO", "RÉPLICA", "MINUTA", "EMBARGOS"]
BODY_STARTS = [
    r"[A-ZÀ-Ú][A-ZÀ-Ú\s]+,\s+(?:já\s+qualificad|brasileiro|brasileira|pessoa\s+jurídica)", r"(?:O|A)\s+(?:Autor|Réu|Requerente|Requerido|Impetrante|Paciente)\b", r"(?:Trata-se|Cuida-se|Versam?\s+os\s+autos)",
    r"(?:##?\s+)?\d+\.\s+", r"\*\*\d+\.",
]


def _start(patterns: list[str]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def bare(line: Column) -> Column:
    return rx.strip(F.regexp_replace(line, "[\\u200b\\u200c\\u200d\\ufeff\\u00a0]", ""))


def is_roman_heading(line: Column) -> Column:
    s = rx.strip(line)
    s = bare(F.when(s.startswith("**") & s.endswith("**") & (F.char_length(s) > 3), rx.strip(F.substring(s, 3, F.char_length(s) - 4))).otherwise(s))
    title = lambda t: let(F.regexp_extract(t, rx.rx(r"^[IVXLC]+ *[-–—.] *(.{2,})$", "s"), 1), lambda rest: (F.char_length(t) >= 4) & (rest != "") & (rx.upper_share(rest) >= 0.6))
    return F.coalesce(let(s, title), F.lit(False))


def is_numbered_heading(line: Column) -> Column:
    title = lambda t: let(F.regexp_extract(t, rx.rx(r"^\d+\. *(\p{Lu}.+)$", "s"), 1), lambda rest: (F.char_length(t) >= 5) & (rest != "") & (rx.upper_share(rest) >= 0.6))
    return F.coalesce(let(bare(line), title), F.lit(False))


def is_enumeration(line: Column) -> Column:
    """A list item, unless it is a numbered or Roman title in capitals."""
    s = rx.strip(line)
    title = rx.has(s, rf"^\d+\.\s+[{CAPITAL}][{TITLE_CHARS}]{{2,}}$") | (rx.has(s, rf"^[IVXLC]+\s*[-–—.]\s+[{CAPITAL}]") & loud(s))
    return rx.has(line, _start(ENUMERATIONS)) & ~title


def _depth(line: Column) -> Column:
    """Marks of a subsection numbered N.N...: one more than its numbers, six at most; null if it has no such number."""
    number = F.regexp_extract(rx.strip(line), rx.rx(r"^(\d+(?:\.\d+)+)\.?\s+"), 1)
    dots = F.char_length(F.regexp_replace(number, "[^.]", ""))
    return F.when(number != "", F.repeat(F.lit("#"), F.least(dots + 2, F.lit(6)).cast("int")))


def _marked(marks: str | Column, line: Column) -> Column:
    return F.concat(F.lit(marks) if isinstance(marks, str) else marks, F.lit(" "), line)


def forensic_heading(raw: Column) -> Column:
    """A line of a pleading, as a heading if it is one.  What several rules look at is computed once."""

    def judge(line: Column, upper: Column) -> Column:
        short = F.char_length(line) < 100
        roman_title = rx.has(line, rf"^[IVXLC]+\s*[-–—.]\s+[{CAPITAL}][{TITLE_CHARS}]{{2,}}$") & loud(line)
        unbold = F.when(line.startswith("**") & line.endswith("**") & (F.char_length(line) > 3), rx.strip(F.substring(line, 3, F.char_length(line) - 4))).otherwise(line)
        return (
            F.when(is_roman_heading(line), _marked("##", unbold))
            .when(is_numbered_heading(line), _marked("##", line))
            .when(rx.has(upper, _start(PIECES_H1), "i"), _marked("#", line))
            .when(rx.has(upper, _start(ADDRESSES), "i"), _marked("##", line))
            .when(rx.has(upper, _start(SECTIONS_H2), "i"), _marked("##", line))
            .when(roman_title, _marked("##", line))
            .when(short & rx.has(line, r"^[IVXLC]+\.\d+\s*[-–—.]\s+\S"), _marked("###", line))
            .when(is_enumeration(line), line)
            .when(rx.has(line, rf"^\d+\.\s+[{CAPITAL}][{TITLE_CHARS}]{{2,}}$"), _marked("##", line))
            .when(short & _depth(line).isNotNull(), _marked(_depth(line), line))
            .when(short & rx.has(line, _start(SUBSECTIONS_H3)), _marked("###", line))
            .otherwise(line)
        )

    judged = lambda line: let(rx.strip(F.upper(line)), lambda upper: judge(line, upper))
    # what has no invisible character has its blanks off already
    shown = let(rx.strip_line(raw), lambda s: F.when(rx.has(s, "[\\u200b\\u200c\\u200d\\ufeff\\u00a0]"), bare(s)).otherwise(s))
    return let(shown, lambda line: F.when(rx.has(F.substring(line, 1, 3), LIKELY), judged(line)).otherwise(line))


def book_heading(raw: Column) -> Column:
    """A line of a book, as a heading if it is one; long lines, and sentences in lower case, are text."""

    def judge(line: Column, upper: Column) -> Column:
        n = F.char_length(line)
        sentence = (F.coalesce(rx.upper_share(line), F.lit(1.0)) < 0.5) & rx.has(line, rf"\b(?:{'|'.join(BODY_VERBS)})\b", "i")
        return (
            F.when(rx.has(upper, _start(BOOK_H1), "i"), _marked("#", line))
            .when(rx.has(upper, _start(BOOK_H2), "i"), F.when((n > 120) | sentence, line).otherwise(_marked("##", line)))
            .when((n < 100) & _depth(line).isNotNull(), _marked(_depth(line), line))
            .when(rx.has(line, r"^\d+\.\d+\.?\s+") | rx.has(line, r"^\d+\.\d+\.\d+\.?\s+"), F.when(n > 200, line).otherwise(_marked("###", line)))
            .otherwise(line)
        )

    return let(raw, lambda line: let(rx.strip(F.upper(line)), lambda upper: judge(line, upper)))


def bold_heading(raw: Column) -> Column:
    """The same kinds of lines in bold instead of as headings."""

    def judge(line: Column, s: Column, upper: Column) -> Column:
        short = F.char_length(line) < 100
        title = (
            is_roman_heading(line) | rx.has(upper, _start(PIECES_H1), "i") | rx.has(s, _start(BOLD_STARTS), "i") | rx.has(upper, _start(SECTIONS_H2), "i")
            | (rx.has(s, rf"^[IVXLC]+\s*[-–—.]\s+[{CAPITAL}][{TITLE_CHARS}]{{2,}}$") & loud(s)) | rx.has(s, r"^\d+\.\s+[A-ZÀ-Ú]")
            | (short & (rx.has(s, r"^\d+\.\d+\.?\s+") | rx.has(s, r"^[IVXLC]+\.\d+\s*[-–—.]\s+\S") | rx.has(line, _start(SUBSECTIONS_H3))))
        )
        return F.when(title, F.concat(F.lit("**"), line, F.lit("**"))).otherwise(line)

    return let(raw, lambda line: let(rx.strip(line), lambda s: let(rx.strip(F.upper(line)), lambda upper: judge(line, s, upper))))


MODES = {"forense": forensic_heading, "doutrina": book_heading, "google": bold_heading}


def mark_headings(text: Column, mode: str = "forense") -> Column:
    """Every line by the mode's rules; headings stay, or become bold in the bold mode; blank lines become empty."""

    def body(line: Column, s: Column) -> Column:
        old = F.concat(F.lit("**"), rx.strip(F.regexp_replace(s, "^#+", "")), F.lit("**")) if mode == "google" else line
        return F.when(s == "", F.lit("")).when(s.startswith("#"), old).otherwise(MODES[mode](s))

    return map_lines(text, lambda line: let(rx.strip_line(line), lambda s: body(line, s)))


def italicize_summary(text: Column, reach: int = 20) -> Column:
    """Lines between a piece's title and the start of its body, which must come within ``reach`` lines, in italics."""
    title, begins = rf"^(?:#{{1,3}}\s+|\*\*)?(?:{'|'.join(PIECE_TITLES)})", _start(BODY_STARTS)

    def mark(all_: Column) -> Column:
        at = lambda lo, hi, p: F.get(F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i > lo) & (i < hi) & rx.has(rx.strip(F.get(all_, i)), p, "i")), 0)
        top = at(F.lit(-1), F.size(all_), title)

        def inner(t: Column) -> Column:
            end = at(t, t + reach, begins)
            return let(end, lambda e: F.when(t.isNull() | e.isNull(), join(all_)).otherwise(join(F.transform(all_, lambda x, i: F.when((i > t) & (i < e) & (rx.strip(x) != "") & ~rx.has(rx.strip(x), r"^[*>#]"), F.concat(F.lit("*"), rx.strip(x), F.lit("*"))).otherwise(x)))))

        return let(top, inner)

    named = r"^\s*(?:#{1,3}\s+|\*\*)?" + rx.any_start([t[:2] for t in PIECE_TITLES])  # else no line is a title
    return where(F.coalesce(text, F.lit("")), lambda t: rx.has(t, named, "m"), lambda t: let(split(t), mark))


def format_signature(text: Column, reach: int = 30) -> Column:
    """The closing formula among the last ``reach`` lines begins a block: a rule before it, names and numbers in bold."""

    def sign(all_: Column) -> Column:
        n = F.size(all_)
        start = F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i >= n - reach) & rx.has(rx.strip(F.get(all_, i)), CLOSINGS, "i")), 0)

        def line(x: Column) -> Column:
            s = rx.strip(x)
            spaced = rx.has(s, CLOSINGS, "i") | rx.has(s, PLACE_DATE, "i")
            bold = rx.has(s, BAR_NUMBER, "i") | (rx.all_upper(s) & F.char_length(s).between(6, 79))
            return F.when(s == "", F.array().cast("array<string>")).when(spaced, F.array(s, F.lit(""))).when(bold, F.array(F.concat(F.lit("**"), s, F.lit("**")))).otherwise(F.array(s))

        block = lambda i: F.concat(F.slice(all_, 1, i), F.array(F.lit(""), F.lit("---"), F.lit("")), F.flatten(F.transform(F.slice(all_, i + 1, n), line)))
        return let(start, lambda i: F.when(i.isNull(), join(all_)).otherwise(join(block(i))))

    return let(split(text), sign)


def heuristics(docs: DataFrame, column: str = "text", mode: str = "forense", citations: bool = True, items: bool = False, notes: bool = False, summary: bool = True, composed: bool = False) -> DataFrame:
    """``docs`` with all structure rules of a mode applied to ``column`` in their order; ``composed``: texts are in composed form."""
    book = mode == "doutrina"
    docs = docs if composed else docs.withColumn(column, scalars.nfc(F.col(column)))
    docs = stepped(docs, column, *[blocks.remove_contents] * book, partial(mark_headings, mode=mode))
    docs = stepped(docs, column, partial(blocks.detect_quotes, citations=citations and not book))
    more = [blocks.separate_items] * (items and mode == "forense") + [blocks.wrap_notes] * (notes and not book) + [italicize_summary] * (summary and not book) + [format_signature] * (not book)
    docs = stepped(docs, column, *more) if more else docs
    return stepped(docs, column, *[partial(blocks.fill_heading_gaps, composed=True)] * (mode != "google"), blocks.strip_front_matter)


def headings(text: Column, deepest: int = 3) -> Column:
    """``array<struct<level, title>>`` of a text's headings, contents titles left out."""
    found = F.transform(split(text), lambda x: F.struct(F.char_length(F.regexp_extract(rx.strip(x), rx.rx(rf"^(#{{1,{deepest}}})\s+(.+)$"), 1)).alias("level"), rx.strip(F.regexp_extract(rx.strip(x), rx.rx(rf"^(#{{1,{deepest}}})\s+(.+)$"), 2)).alias("title")))
    return F.filter(found, lambda h: (h["level"] > 0) & ~F.lower(h["title"]).isin("sumário", "índice"))


def contents(text: Column) -> Column:
    """A table of contents with links; empty if the text has one or fewer than two headings."""
    has_one = rx.has(text, r"^\s*#{1,3}\s+(?:Sumário|Índice|SUMÁRIO|ÍNDICE)\s*$", "m")
    entry = lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- ["), h["title"], F.lit("](#"), scalars.slug(h["title"]), F.lit(")"))
    return let(headings(text), lambda found: F.when(has_one | (F.size(found) < 2), F.lit("")).otherwise(F.concat(F.lit("## Sumário\n\n"), F.array_join(F.transform(found, entry), "\n"), F.lit("\n"))))


def is_piece_start(line: Column) -> Column:
    title = rx.sub(rx.strip(line), r"^#{1,6}\s+", "")
    return rx.has(F.upper(title), _start(PIECE_STARTS)) & (F.char_length(title) < 150)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece_no, title, content``: a document's lines in islands, each begun by a piece's title.

    A running sum numbers the islands; blank islands go and the rest are numbered from 0.
    """
    from pyspark.sql import Window

    lines = islands(exploded(docs, id_col, text_col), is_piece_start(F.col("line")))
    grouped = lines.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    title = F.when(F.col("island") == 0, F.lit(MAIN_PIECE)).otherwise(rx.sub(rx.strip(F.col("rows")[0]["line"]), r"^#{1,6}\s+", ""))
    filled = grouped.select("doc_id", "island", title.alias("title"), rx.strip(F.array_join(F.col("rows.line"), "\n")).alias("content")).filter("content <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("island")) - 1
    return filled.select("doc_id", number.alias("piece_no"), "title", "content")


def piece_array(text: Column) -> Column:
    """The same as ``array<struct<title, content>>`` within the row."""

    def cut(all_: Column) -> Column:
        n = F.size(all_)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & is_piece_start(F.get(all_, i)))

        def parts(s: Column) -> Column:
            bounds = F.concat(F.array(F.lit(0)), s, F.array(n))
            named = lambda x: F.when(is_piece_start(x), rx.sub(rx.strip(x), r"^#{1,6}\s+", "")).otherwise(F.lit(MAIN_PIECE))
            made = F.transform(F.slice(bounds, 1, F.size(bounds) - 1), lambda b, k: F.struct(named(F.get(all_, b)).alias("title"), rx.strip(join(F.slice(all_, b + 1, F.get(bounds, k + 1) - b))).alias("content")))
            return F.filter(made, lambda p: p["content"] != "")

        return let(starts, parts)

    return let(split(F.coalesce(text, F.lit(""))), cut)


def format_pieces(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p: F.concat(F.lit("# "), p["title"], F.lit("\n\n"), p["content"])), "\n\n---\n\n")


def missing_numbers(found: Column) -> Column:
    """Numbers between the first and the last of an array that it lacks, in order."""
    ends = (F.get(found, 0), F.try_element_at(found, F.lit(-1)))
    return F.when((F.size(found) > 1) & (ends[1] >= ends[0]), F.array_sort(F.array_except(F.sequence(*ends), found))).otherwise(F.array().cast("array<int>"))


def next_existing(numbers: DataFrame, group: str = "doc_id", number: str = "n") -> DataFrame:
    """``doc_id, missing, next``: numbers that a group lacks between its least and its greatest, each with the next that is there.

    Each number that is there knows the one after it, and the gap between the two is made from the pair: no range of all numbers, no
    join of all with all, and equal numbers meet in a partial aggregate first.
    """
    from pyspark.sql import Window

    after = F.lead(number).over(Window.partitionBy(group).orderBy(number))
    pairs = numbers.filter(F.col(number).isNotNull()).select(group, number).distinct().withColumn("next", after).filter(F.col("next") > F.col(number) + 1)
    return pairs.select(F.col(group).alias("doc_id"), F.explode(F.sequence(F.col(number) + 1, F.col("next") - 1)).alias("missing"), "next")


def long_runs(lines: DataFrame, least: int = 5, kind: str = "kind") -> DataFrame:
    """``doc_id, line_no, size``: the lines of each run of at least ``least`` lines in a row that are of a kind, with the run's size."""
    from pyspark.sql import Window

    runs_ = islands(lines, ~F.coalesce(F.col(kind), F.lit(False))).filter(kind)
    return runs_.withColumn("size", F.count("*").over(Window.partitionBy("doc_id", "island"))).filter(F.col("size") >= least).select("doc_id", "line_no", "size")
