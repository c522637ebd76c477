"""Removal of what a conversion leaves, and polishing of Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import filter_lines, holding, join, let, map_lines, split, where
from lavra.operators.cleaning import normalize_paragraphs
from lavra.operators.blocks import FIELDS

# What counts as left over.
SUMMARY = r"\*Resumo[:.]?\s.*?Palavras[-\s]chave[:.]?\s.*?\*"
COURSE_HEADER = r"^\s*\|?\s*CS\s*[–\-—]\s*[A-ZÀ-Ú][A-ZÀ-Ú\s]+\s+[IVX]+\s+\d{4}\.\d\s*\|?\s*\d*\s*\|?\s*$"
SHORT_HEADER = r"^\s*\|\s*[A-Z]{2,4}\s*[–\-—]\s*[A-ZÀ-Ú][A-ZÀ-Ú\s]+\d{4}\.\d\s*\|.*\|\s*$"
PAGE_MARK = r"^\s*P[áa]g(?:ina|\.)\s*\d+\s*$"
DASHED_NUMBER = r"^\s*[-–—]\s*\d+\s*[-–—]\s*$"
CATALOG = [
    (r"\bISBN[\s:]+[\d\-Xx]+", "i"), (r"\bCDD\b[\s:]*\d", "i"), (r"\bCDU\b[\s:]*\d", "i"), (r"\bCIP\b", "i"), (r"Dados\s+Internacionais\s+de\s+Cataloga", "i"),
    (r"Ficha\s+[Cc]atalogr[áa]fica", ""), (r"Catalogação\s+na\s+(?:fonte|publicação)", "i"), (r"C[âa]mara\s+Brasileira\s+do\s+Livro", "i"),
]
INLINE_REFERENCE = r"^[A-ZÀ-Ú]{2,}[A-ZÀ-Ú\s]*,\s+[A-ZÀ-Ú][^\n]*(?:Acesso\s+em[:.]|Dispon[íi]vel\s+em[:.])[^\n]*\.?"
UI_TEXTS = [r"Clique\s+aqui\s+e\s+acesse", r"Clique\s+aqui\s+para", r"Saiba\s+mais\s+em", r"Veja\s+também[:.]?", "Compartilhe", "Imprimir"]
ITALIC_ONLY = [
    "inaudita altera parte", "animus novandi", "in re ipsa", "ex lege", "ad hoc", "ab initio", "data venia", "in casu", "in fine", "in verbis", "mutatis mutandis", "periculum in mora", "fumus boni iuris",
    "prima facie", "erga omnes", "inter partes", "lato sensu", "stricto sensu", "ex officio", "ex tunc", "ex nunc", "habeas corpus", "mandamus", "certiorari", "stare decisis", "ratio decidendi",
    "obiter dictum", "per se", "sui generis", "ultra petita", "extra petita", "reformatio in pejus",
]
ORDINALS = ["primeir[ao]", "segund[ao]", "terceir[ao]", "quart[ao]", "quint[ao]", "sext[ao]", "sétim[ao]", "oitav[ao]", "non[ao]", "décim[ao]"]
MORE_FIELDS = ["area", "subarea", "tags", "ultima_revisao", "edicao", "fonte", "tipo", "ramo", "subramos", "jurisdicao", "atualizado_ate", "formato_origem"]
CITES = [
    r"Art\.?", r"art\.?", "Lei", "lei", "Decreto", "decreto", "Resolu[çc][ãa]o", "n[º°.]", "N[º°.]", r"p\.", r"P[áa]g\.?", "§", "S[úu]mula", "Enunciado", "[Ii]nciso",
]
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


#: Where a line may be a page mark, a header or a row.
LAYOUT = rf"^\s*(?:\d{{1,4}}\s*$|[-–—]+\s*[\dPp]|\||CS|[Pp][áÁaA][gG])"
#: Where a summary may begin.
SUMMARY_SIGN = r"\*" + rx.either("res")


def remove_summaries(text: Column) -> Column:
    """``*Resumo: ... Palavras-chave: ...*`` blocks, and lines that are a summary."""
    return where(text, lambda t: rx.has(t, SUMMARY_SIGN), lambda t: rx.sub(rx.sub(t, SUMMARY, "", "is"), r"^\s*\*Resumo[:.]?\s.*?\*\s*$", "", "im"))


def remove_layout(text: Column) -> Column:
    """Course headers and page marks; numbers alone between blank lines."""
    edge = lambda all_, i: F.coalesce(rx.blank(F.get(all_, i)), F.lit(True))

    def removed(t: Column) -> Column:
        for pattern, flags in ((COURSE_HEADER, "m"), (SHORT_HEADER, "m"), (PAGE_MARK, "im"), (DASHED_NUMBER, "m")):
            t = rx.sub(t, pattern, "", flags)
        return filter_lines(t, lambda x, i, all_: ~(rx.has(x, r"^\s*\d{1,4}\s*$") & ((i == 0) | edge(all_, i - 1)) & edge(all_, i + 1)))

    return where(F.coalesce(text, F.lit("")), lambda t: rx.has(t, LAYOUT, "m"), removed)


def strip_catalog(text: Column) -> Column:
    """A book's catalogue card: from three lines before the first sign to two behind the last, headings left out."""

    def cut(all_: Column) -> Column:
        sign = lambda x: F.array_contains(F.array(*(rx.has(x, p, f) for p, f in CATALOG)), True)
        at = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: sign(F.get(all_, i)))
        head = lambda i: rx.strip(F.get(all_, i)).startswith("#")

        def ends(s: Column) -> Column:
            lo, hi = F.get(s, 0), F.try_element_at(s, F.lit(-1))
            above = F.filter(F.sequence(F.greatest(lo - 3, F.lit(0)), lo), lambda i: (i < lo) & head(i))
            first = F.coalesce(F.array_max(above) + 1, F.greatest(lo - 3, F.lit(0)))
            below = F.filter(F.sequence(hi, F.least(hi + 2, F.size(all_) - 1)), lambda i: (i > hi) & head(i))
            last = F.coalesce(F.array_min(below), F.least(hi + 3, F.size(all_)))
            return F.when(F.size(s) < 2, join(all_)).otherwise(join(F.concat(F.slice(all_, 1, first), F.slice(all_, last + 1, F.size(all_)))))

        return let(at, ends)

    # else no line has a sign
    likely = rf"{rx.either('isbn')}|[Cc](?:[Dd][DdUu]|{rx.either('ip')}\b|[Aa][Tt][Aa][Ll]|[ÂâAa][Mm][Aa][Rr][Aa])|[Dd][Aa][Dd][Oo]{rx.either('s')}|Ficha"
    return where(F.coalesce(text, F.lit("")), lambda t: rx.has(t, likely), lambda t: let(split(t), cut))


def clean_artifacts(text: Column) -> Column:
    return normalize_paragraphs(strip_catalog(remove_layout(remove_summaries(text))))


FOOTNOTE = r"^\[\^(\d+)\]:\s*(.+)$"


def relocate_footnotes(text: Column) -> Column:
    """Definitions that the text before them does not refer to become callouts; the others stay at the end."""

    def split_at(at: Column) -> Column:
        body = rx.rstrip(F.substring(text, F.lit(1), at - 1))
        block = F.substring(text, at, F.char_length(text))
        numbers, notes = rx.all_of(block, FOOTNOTE, 1, "m"), rx.all_of(block, FOOTNOTE, 2, "m")
        both = F.arrays_zip(numbers.alias("n"), notes.alias("note"))
        used = rx.all_of(body, r"\[\^(\d+)\](?!:)", 1)

        def sort_out(found: Column) -> Column:
            orphans = F.transform(F.filter(found, lambda x: ~F.array_contains(used, x["n"])), lambda x: F.concat(F.lit("\n> [!NOTE]\n> **Nota:** "), rx.strip(x["note"]), F.lit("\n")))
            stays = F.transform(F.filter(found, lambda x: F.array_contains(used, x["n"])), lambda x: F.concat(F.lit("[^"), x["n"], F.lit("]: "), rx.strip(x["note"])))
            tail = F.when(F.size(stays) > 0, F.array(F.lit("\n\n---\n"), join(stays))).otherwise(F.array().cast("array<string>"))
            return F.concat(rx.rstrip(join(F.concat(F.array(body), orphans, tail))), F.lit("\n"))

        return let(both, sort_out)

    return F.when(rx.has(text, FOOTNOTE, "m"), let(F.regexp_instr(text, F.lit(rx.rx(FOOTNOTE, "m"))), split_at)).otherwise(text)


def orphan_footnotes(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """Definitions ``doc_id, num, content`` without a reference ``doc_id, num``: an anti-join on distinct references."""
    return definitions.join(references.select("doc_id", "num").distinct(), ["doc_id", "num"], "left_anti")


def remove_note_numbers(text: Column) -> Column:
    """Drops one or two digits stuck to words or standing between them, unless they cite, count or date.

    What cites or counts is said by looking around, so each rule is one replacement.  Front matter, fields, headings and rows stay.
    """
    small, cites = "a-záéíóúàâêôãõç", f"(?<!{'|'.join(CITES)})"
    # a cheap look ahead comes first: few places have a digit
    stuck = rf"(?=\d)(?<=[{small}.,:;!?)\]\"”]){cites}\d{{1,2}}(?=[\s.,;:!?)\]]|$)(?!(?i:\s+de\s+(?:{'|'.join(MONTHS)})))"
    alone = rf"(?=\s+\d)(?<=[{small}]){cites}\s+\d{{1,2}}\s+(?=[{small}])(?!(?:,|e|ou|a)\s*\d)"
    field = rf"^(?:{'|'.join(FIELDS + MORE_FIELDS)})\s*:"
    freed = lambda x: F.regexp_replace(rx.sub(rx.sub(x, stuck, ""), alone, " "), "  +", " ")
    fixed = lambda x: F.when(rx.has(x, r"\d|  "), let(rx.strip(x), lambda s: kept(x, s))).otherwise(x)
    kept = lambda x, s: F.when((s == "---") | rx.has(s, "^[#|]") | rx.has(s, field, "i"), x).otherwise(freed(x))
    rule = r"[^\S\n]*---[^\S\n]*(?=\n|\z)"
    front = rf"\A{rule}(?:\n(?!{rule})[^\n]*+)*+(?:\n{rule})?+"
    return let(F.regexp_extract(text, rx.rx(front), 0), lambda head: F.concat(head, map_lines(F.substring(text, F.char_length(head) + 1, F.char_length(text)), fixed)))


def strip_footnotes(text: Column) -> Column:
    """All footnotes: callouts, references, definitions, numbers stuck to words, the rule before them."""
    text = holding(text, "[!NOTE]", change=lambda t: rx.sub(t, r">\s*\[!NOTE\]\s*\n>\s*\*\*Nota:\*\*\s*.*", ""))
    text = holding(text, "[^", change=lambda t: rx.sub(rx.sub(t, r"\[\^\d+\](?!:)", ""), r"^\[\^\d+\]:\s*.*$", "", "m"))
    text = remove_note_numbers(text)
    text = rx.sub(text, r"\n---\s*\n*\z", "\n")
    return normalize_paragraphs(holding(text, "  ", change=lambda t: F.regexp_replace(t, "  +", " ")))


def strip_artifacts(text: Column) -> Column:
    """Page numbers, page marks, course headers, summaries, rows of broken tables."""
    steps = [
        (r"^\s*\d{1,4}\s*$", "m"), (r"^\s*[-–—]+\s*P[áa]gina\s*\d+\s*[-–—]+\s*$", "im"), (COURSE_HEADER, "m"), (SUMMARY, "is"),
        (r"^\s*\|[\s|]*\|\s*$", "m"), (r"^\s*\|[-\s:]+\|\s*$", "m"), (PAGE_MARK, "im"), (DASHED_NUMBER, "m"),
    ]

    def removed(t: Column) -> Column:
        for pattern, flags in steps:
            t = rx.sub(t, pattern, "", flags)
        return t

    return normalize_paragraphs(where(text, lambda t: rx.has(t, f"{LAYOUT}|{SUMMARY_SIGN}", "m"), removed))


def strip_inline_references(text: Column) -> Column:
    return where(text, lambda t: rx.has(t, r"[LlOo]\s+[Ee][Mm][:.]"), lambda t: rx.sub(t, INLINE_REFERENCE, "", "im"))


def fix_urls(text: Column) -> Column:
    def fixed(t: Column) -> Column:
        for end in (r"\.", "(?=[a-zA-Z])"):
            for scheme in ("https", "http"):
                t = rx.sub(t, rf"\b{scheme}www{end}", f"{scheme}://www.")
        return t

    return holding(text, "httpwww", "httpswww", change=fixed)


def strip_ui(text: Column) -> Column:
    def stripped(t: Column) -> Column:
        for start in UI_TEXTS:
            t = rx.sub(t, rf"^\s*{start}.*$", "", "im")
        return t

    return where(text, lambda t: rx.has(t, rf"^\s*{rx.any_start([s[:4] for s in UI_TEXTS])}", "m"), stripped)


def fix_bold_lists(text: Column) -> Column:
    """``**1. **item`` and the like become ``1. item``."""
    def fixed(t: Column) -> Column:
        for mark in (r"\*\*(\d{1,3})\.\s*\*\*", r"\*\*(\d{1,3})\.\*\*", r"\*\*(\d{1,3})\*\*\s*\."):
            t = rx.sub(t, rf"^{mark}\s*(.*\S)[^\S\n]*$", "$1. $2", "m")
        return t

    return holding(text, "**", change=fixed)


def fix_emphasis(text: Column) -> Column:
    """Latin phrases in bold italics become italics, ordinals become bold."""
    latin = lambda t: rx.sub(t, rf"\*\*\*({'|'.join(ITALIC_ONLY)})\*\*\*", "*$1*", "i")
    return holding(text, "***", change=lambda t: rx.sub(latin(t), rf"\*\*\*(A\s+(?:{'|'.join(ORDINALS)}))\*\*\*", "**$1**", "i"))


def fix_bold_joins(text: Column) -> Column:
    """A number and a word that stick together, in bold or (five digits or more) outside it, are set apart."""
    small = "a-záéíóúàâêôãõç"
    text = holding(text, "**", change=lambda t: rx.sub(t, rf"\*\*([^*]*\d)([{small}][{small}]+[^*]*)\*\*", "**$1** $2"))
    return rx.sub(text, rf"(\d{{5,}})([{small}]{{3,}})", "$1 $2")


def polish(text: Column) -> Column:
    return fix_emphasis(fix_bold_lists(fix_bold_joins(text)))


def strip_inline_marks(text: Column) -> Column:
    """Text without bold, italics and links."""
    for mark in (r"\*\*\*(.+?)\*\*\*", r"\*\*(.+?)\*\*", r"\*(.+?)\*", r"\[(.+?)\]\(.+?\)"):
        text = rx.sub(text, mark, "$1")
    return text


def strip_yaml(text: Column) -> Column:
    """Without a leading block between ``---`` lines; an open block stays."""
    return rx.sub(text, r"\A[^\S\n]*---[^\S\n]*\n(.*?\n)??[^\S\n]*---[^\S\n]*(\n|\z)", "", "s")
