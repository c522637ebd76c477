"""Cleaning of extracted text: functions from a text column to a text column, applied in a fixed order by ``clean``."""

from __future__ import annotations

import functools
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions import rx, scalars
from lavra.functions.lines import exploded, filter_lines, flat_map_lines, holding, join, let, none, one, split, stepped, where
from lavra.operators.paragraphs import rebuild_headings, rejoin_paragraphs, split_long_paragraphs

# Results depend on exactly these words and classes.
COMPOUND_PREFIXES = [
    "vice", "ex", "pré", "pós", "recém", "bem", "mal", "além", "aquém", "sem", "não", "sócio", "grão", "grã", "auto", "contra", "entre", "extra",
    "infra", "intra", "macro", "mega", "micro", "mini", "multi", "neo", "pan", "pluri", "proto", "pseudo", "semi", "sobre", "sub", "super", "supra", "ultra",
]
READER_WORDS = [
    "escolher fonte", "alterar layout", "luminosidade", "fazer buscas", "anotar trechos", "menu", "marca-texto", "marcador", "bookmark", "aumentar fonte", "diminuir fonte",
    "tamanho da fonte", "modo noturno", "modo de leitura", "configurações de leitura", "opções de visualização", "deslize para", "toque para", "toque na tela", "arraste",
    "pinça para zoom", "sumário interativo", "índice interativo", "navegação", "barra de progresso", "epub", "e-reader", "e-book", "ebook", "kindle", "kobo",
    "google play livros", "apple books", "this ebook", "digital rights", "drm", "choose font", "adjust layout", "brightness", "search text", "annotate", "highlight",
]
#: Each reader word holds one of these; they begin with rare letters, so a search for bytes seldom stops.
READER_SIGNS = [
    "fonte", "yout", "minosidade", "zer buscas", "chos", "menu", "-texto", "marcador", "book", "do noturno", "de leitura", "visualiza", "ze para", "toque", "rraste", "zoom", "terativo", "vegação",
    "barra de prog", "epub", "-reader", "kindle", "kobo", "google play", "gital rights", "drm", "hoose font", "brightness", "h text", "notate", "highlight",
]
KEPT_HEADINGS = [r"dos?\s+fatos", r"dos?\s+direito", r"dos?\s+pedidos", "fundamenta", "preliminar", r"do\s+mérito", "relatório", "dispositivo", "ementa", "voto", "capítulo", "seção", "cláusula", "título"]
CASE_SIGNS = ["HC", "RHC", "REsp", "AgRg", "ARE", "AREsp", "ADI", "ADPF", "RE", "RMS"]
LOWER, UPPER = "a-záéíóúàâêôãõç", "A-ZÁÉÍÓÚÀÂÊÔÃÕÇ"


def normalize_unicode(text: Column) -> Column:
    """Composed form, no zero-width characters, no-break spaces as spaces."""
    return plain_spaces(scalars.nfc(text))


def plain_spaces(text: Column) -> Column:
    return rx.swap(F.regexp_replace(text, "[\\u200b\\u200c\\u200d\\ufeff]", ""), {"\u00a0": " "})


def fix_hyphenation(text: Column) -> Column:
    """Joins words broken at a line end; the hyphen stays after a compound's prefix."""
    broken = rx.has(text, r"-\s*\n|-\s{2}")  # else no rule holds; this is far cheaper than they are
    whole, keep = text, rf"\b({'|'.join(COMPOUND_PREFIXES)})-"
    for gap in (r"\s*\n\s*", r"\s{2,}"):
        text = rx.sub(text, rf"{keep}{gap}(\w)", "$1-$2", "i")
        text = rx.sub(text, rf"(\w+)-{gap}(\w)", "$1$2")
    return F.when(broken, text).otherwise(whole)


def normalize_whitespace(text: Column) -> Column:
    """Tabs and runs of spaces as one space; no white space at the ends of lines."""
    text = holding(rx.swap(text, {"\t": " "}), "  ", change=lambda t: F.regexp_replace(t, " {2,}", " "))
    # newlines are looked for first: a search for blanks would stop at every space
    edge = lambda t: rx.has(F.concat(F.lit("\n"), t, F.lit("\n")), r"\n(?:(?<=[^\S\n]\n)|(?=[^\S\n]))")
    return where(text, edge, lambda t: rx.sub(t, r"^[^\S\n]+|[^\S\n]+$", "", "m"))


def normalize_bullets(text: Column) -> Column:
    return rx.sub(text, r"^[•◦▪►–]\s+", "- ", "m")


def remove_ocr_noise(text: Column) -> Column:
    """Runs of marks inside lines, lines of marks only, long runs of dots, underscores and hyphens."""
    # most characters are letters, so they are passed before \b, which is dear, is tried
    text = rx.sub(text, r"(?![a-z A-Z])\b[^a-zA-ZÀ-ÿ0-9\s]{3,}\b", "")
    text = rx.sub(text, r"^[^\w\s]+$", "", "m")
    for sign, pattern, to in (("....", r"\.{4,}", ""), ("___", "_{3,}", ""), ("-----", "-{5,}", "---")):
        text = holding(text, sign, change=lambda t, p=pattern, r=to: F.regexp_replace(t, p, r))
    return text


def remove_corrupted_glyphs(text: Column) -> Column:
    """Lines of which over three tenths of the letters lie beyond Latin go; in others just those letters go."""
    letters = lambda s: F.char_length(F.regexp_replace(s, r"[^\p{L}]", ""))
    beyond = lambda s: F.char_length(F.regexp_replace(s, r"[^\p{L}]|[\x{0}-\x{24F}]", ""))

    def body(line: Column, i: Column, all_: Column) -> Column:
        s = rx.strip(line)
        fixed = rx.strip(F.regexp_replace(F.regexp_replace(line, r"[\p{L}&&[^\x{0}-\x{24F}]]", ""), " {2,}", " "))
        return F.when((F.char_length(s) < 3) | (beyond(s) == 0), one(line)).when(beyond(s) / letters(s) > 0.3, none()).otherwise(one(fixed))

    return F.when(text.rlike(r"[\p{L}&&[^\x{0}-\x{24F}]]"), flat_map_lines(text, body)).otherwise(text)


def _has_reader_word(text: Column, words: list[str] = READER_WORDS) -> Column:
    return let(F.lower(text), lambda low: functools.reduce(lambda a, b: a | b, (low.contains(w) for w in words)))


def remove_reader_boilerplate(text: Column, scanned: int = 150) -> Column:
    """Cuts a reading device's instructions: from the first to the last line with such words, if three lines or more of
    the first ``scanned`` have them, and on over blank and short lines."""

    def cut(all_: Column) -> Column:
        n = F.size(all_)
        hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < scanned) & _has_reader_word(F.get(all_, i)))

        def at(found: Column) -> Column:
            end = F.try_element_at(found, F.lit(-1)) + 1
            rest = F.slice(all_, end + 1, n)
            stops = lambda s: (F.char_length(s) == 40) | ((F.char_length(s) > 40))
            skipped = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & ~stops(rx.strip(x)), 1).otherwise(0)).cast("int").alias("n"), (a["on"] & ~stops(rx.strip(x))).alias("on")))["n"]
            return F.when((n < 5) | (F.size(found) < 3), join(all_)).otherwise(join(F.concat(F.slice(all_, 1, F.try_element_at(found, F.lit(1))), F.slice(all_, end + skipped + 1, n))))

        return let(hits, at)

    return F.when(_has_reader_word(text, READER_SIGNS), let(split(text), cut)).otherwise(text)


def repeated_line_key(line: Column) -> Column:
    """What equal headers and footers share: lower case, digits as one sign."""
    return rx.sub(F.lower(rx.strip(line)), r"\d+", "#")


def remove_repeated_lines(docs: DataFrame, preserve_first: bool = True, least: int = 3, min_lines: int = 20) -> DataFrame:
    """Exploded lines ``doc_id, line_no, line`` without headers and footers that repeat on a document's pages.

    Only short lines count, and named sections never; a group count and a row number per document and line.
    """
    lines = exploded(docs).withColumn("key", repeated_line_key(F.col("line")))
    size = F.char_length(rx.strip(F.col("line")))
    by_key, whole = Window.partitionBy("doc_id", "key"), Window.partitionBy("doc_id")
    seen = F.count(F.when((size > 3) & (size < 60), 1)).over(by_key)
    kept_name = rx.has(F.col("key"), f"^(?:{'|'.join(KEPT_HEADINGS)})")
    marked = lines.withColumn("goes", (F.count("*").over(whole) >= min_lines) & (seen >= least) & ~kept_name)
    rank = F.row_number().over(by_key.orderBy("line_no"))
    return marked.withColumn("rank", rank).filter(~F.col("goes") | ((F.col("rank") == 1) if preserve_first else F.lit(False))).select("doc_id", "line_no", "line")


def remove_repeated(text: Column, least: int = 3, min_lines: int = 20) -> Column:
    """The same within a row, for the narrow pipeline."""

    def body(all_: Column) -> Column:
        keys = F.transform(all_, repeated_line_key)
        return F.when(F.size(all_) < min_lines, join(all_)).otherwise(let(keys, lambda k: pick(all_, k)))

    def pick(all_: Column, keys: Column) -> Column:
        short = F.filter(F.transform(all_, lambda x: F.when(F.char_length(rx.strip(x)).between(4, 59), repeated_line_key(x))), lambda x: x.isNotNull())
        thrice = let(F.array_sort(short), lambda o: F.array_distinct(F.filter(o, lambda x, i: (i >= least - 1) & (x == F.get(o, i - (least - 1))))))
        goes = F.filter(thrice, lambda x: ~rx.has(x, f"^(?:{'|'.join(KEPT_HEADINGS)})"))
        kept = lambda g: F.filter(all_, lambda x, i: ~F.array_contains(g, F.get(keys, i)) | (F.array_position(keys, F.get(keys, i)) == i + 1))
        return let(goes, lambda g: F.when(F.size(g) == 0, join(all_)).otherwise(join(kept(g))))

    return let(split(text), body)


def remove_residual_pagination(text: Column) -> Column:
    """Page marks anywhere; bare numbers among a text's first and last three lines."""
    mark = r"^P[áa]gina\s+\d+\s*$|^P[áa]g\.\s*\d+\s*$|^[-–—]\s*\d+\s*[-–—]\s*$"
    goes = lambda s, i, all_: rx.has(s, mark, "i") | (rx.has(s, r"^\d+$") & ((i < 3) | (i >= F.size(all_) - 3)))
    likely = lambda x: rx.has(x, r"^\s*[Pp\-–—\d]")
    return filter_lines(text, lambda x, i, all_: ~(likely(x) & let(rx.strip(x), lambda s: goes(s, i, all_))))


def reconnect_case_numbers(text: Column) -> Column:
    return rx.sub(text, rf"(?=[AHR])\b({'|'.join(CASE_SIGNS)})\s*\n\s*(\d{{7}}-\d{{2}}\.\d{{4}})", "$1 $2")


_FUSED = [(r"^(.*?)\s+(Cap[íi]tulo\s+\d+\s+.+)$", "i"), (r"^(.*?)\s+(Quadro\s+mnem[ôo]nico.*)$", "i"), (r"^(.*?)\s+(PARTE\s+[IVXLC]+\s+.+)$", ""), (r"^(.*?)\s+(Se[çc][ãa]o\s+[IVXLC\d]+\s+.+)$", "i")]


def split_fused_headings(text: Column) -> Column:
    """Two headings that share a line become two lines with a blank one between them."""

    def body(line: Column, i: Column, all_: Column) -> Column:
        s = rx.strip(line)
        mark = F.regexp_extract(s, rx.rx(r"^(#{1,6}\s+).+$"), 1)
        content = F.substring(s, F.char_length(mark) + 1, F.char_length(s))
        out = one(line)
        for pattern, flags in reversed(_FUSED):
            a, b = (rx.strip(F.regexp_extract(content, rx.rx(pattern, flags), k)) for k in (1, 2))
            out = F.when(rx.has(content, pattern, flags) & (F.char_length(a) > 5), F.array(F.concat(mark, a), F.lit(""), F.concat(mark, b))).otherwise(out)
        return out

    some = rx.has(text, r"(?-i:(?=[CcPpQqSsſ][AaEeUu]))(?:cap[íi]tulo\s+\d|quadro\s+mnem|parte\s+[ivxlc]|se[çc][ãa]o\s+[ivxlc\d])", "i")
    return F.when(some, flat_map_lines(text, body)).otherwise(text)


def fix_word_spacing(text: Column) -> Column:
    return rx.sub(text, rf"([{LOWER}])([{UPPER}][{LOWER}]{{2,}})", "$1 $2")


def fix_enum_spacing(text: Column) -> Column:
    """A space behind ``a)``, ``1)`` and ``ii)`` at the start of lines."""
    for mark in ("[a-z]", r"\d{1,2}", "[ivxlc]+"):
        text = rx.sub(text, rf"^({mark})\)(?=\S)", r"$1) ", "m")
    return text


def separate_enumerations(text: Column) -> Column:
    """A blank line before each enumerated item that follows text."""
    mark = r"^([a-z]\)|[IVXLC]+\s*[-–—]\s|[ivxlc]+\)\s|\d+\.\d+\.?\s)"
    return flat_map_lines(text, lambda x, i, all_: F.when((i > 0) & rx.has(rx.strip(x), mark) & ~rx.blank(F.get(all_, i - 1)), F.array(F.lit(""), x)).otherwise(one(x)))


def normalize_citations(text: Column) -> Column:
    """Articles, paragraphs and ordinals of statutes in one spelling."""
    text = rx.sub(text, r"(?=[Aa][Rr])\b[Aa][Rr][Tt](?:[Ii][Gg][Oo])?\s*\.?\s*(\d)", "Art. $1")
    text = rx.sub(text, r"(?=[Pp][Aa][Rr])\b[Pp][Aa][Rr](?:[ÁáAa][Gg][Rr][Aa][Ff][Oo])?\.?\s*(?=\d|[Úú]nico)", "§ ")
    for sign, pattern, to in (
        ("§", r"§\s*§", "§"), ("Art.", r"(Art\.)\s*(\d)", "$1 $2"), ("§", r"(§)\s*(\d)", "$1 $2"), ("Art.", r"(Art\.\s*\d+[º°]?)\s+,", "$1,"),
        ("Art.", r"(Art\.\s*\d+)\s*[oO](?=\s|,|$|\.)", "$1º"), ("linea", r"\b[Aa]linea\b", "alínea"),
    ):
        text = holding(text, sign, change=lambda t, p=pattern, r=to: rx.sub(t, p, r))
    return text


def normalize_paragraphs(text: Column) -> Column:
    return holding(text, "\n\n\n\n", change=lambda t: F.regexp_replace(t, "\n{4,}", "\n\n\n"))


def latin_share(text: Column) -> Column:
    """Share of characters that are no blanks and are Latin letters, digits, marks or signs; 1 for none at all."""
    seen = F.char_length(rx.sub(text, r"\s", ""))
    other = F.char_length(rx.sub(text, r"\s|[^\p{L}]|[\p{IsLatin}\x{0}-\x{24E}]", ""))
    return F.when(seen > 0, (seen - other) / seen).otherwise(1.0)


def clean(docs: DataFrame, column: str = "text", headers_footers: bool = True) -> DataFrame:
    """``docs`` with all steps in their order applied to ``column``; null and blank texts become empty."""

    marks = [fix_hyphenation, normalize_whitespace, normalize_bullets, remove_corrupted_glyphs, remove_ocr_noise, remove_reader_boilerplate]
    docs = docs.withColumn(column, scalars.nfc(F.coalesce(column, F.lit(""))))
    docs = stepped(docs, column, plain_spaces, *marks)
    docs = stepped(docs, column, *[remove_repeated] * headers_footers, remove_residual_pagination, reconnect_case_numbers)
    docs = stepped(docs, column, partial(rebuild_headings, composed=True), split_fused_headings)
    docs = stepped(docs, column, partial(rejoin_paragraphs, composed=True), fix_word_spacing, fix_enum_spacing, separate_enumerations, normalize_citations)
    return stepped(docs, column, split_long_paragraphs, normalize_paragraphs, rx.strip)
