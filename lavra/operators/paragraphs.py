"""Lines that a page layout broke: headings put together again, paragraphs rejoined, long ones split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import runs, rx, scalars
from lavra.functions.lines import flat_map_lines, let, one, split

# The letters and lines that the rules are about.
CAPITAL = "A-ZÁÉÍÓÚÀÂÊÔÃÕÇ"
SMALL = "a-záéíóúàâêôãõç"
WIDE = rf"[{CAPITAL}][{CAPITAL}{SMALL}\s,§°º().\-:/\d]"
NAMED = rf"^(D[AO]S?|PRELIMINAR|FUNDAMENTAÇÃO|RELATÓRIO|DISPOSITIVO|EMENTA|VOTO)\s+[{CAPITAL}]"
OPEN_END = r"\b(?:DE|DA|DO|DAS|DOS|NA|NO|NAS|NOS|EM|COM|E|OU|PARA|POR|AO|AOS|À|ÀS|ANTE|PERANTE|SOBRE|SOB|ENTRE|ESTE|ESTA|DESTE|DESTA)\s*$"
OPEN_WORD = r"\b(?:de|da|do|das|dos|na|no|nas|nos|em|com|que|e|ou|para|por|ao|à|aos|às)\s*$"
ITEM = r"^([a-z]\)|[a-z]\.|[ivxlc]+\)|[IVXLC]+\)|\d+\)|\d+\.|[IVXLC]+\s*[-–—]\s+|§\s*\d+)\s*"
#: Characters at a line's end in which a word that leaves it open is looked for; blanks behind it are off already.
TAIL = 32
INVISIBLE = "[\u200b\u200c\u200d\ufeff]"


def loud(s: Column) -> Column:
    """No letter of the line would change in upper case."""
    return F.upper(s) == s


def spaced(s: Column) -> Column:
    return F.array_join(s, " ")


def rebuild_headings(text: Column, composed: bool = False) -> Column:
    """Joins headings that page lines broke: a lone number with the title below, and titles with what continues them.

    ``composed``: the text is in Unicode's composed form already.
    """
    text = rx.swap(text if composed else scalars.nfc(text), {"\xa0": " ", "\u200b": ""})
    count = lambda s, kind: F.char_length(F.regexp_replace(s, rf"[^\p{{{kind}}}]", ""))

    def code(s: Column, i: Column, all_: Column) -> Column:
        n = F.char_length(s)
        open_ = lambda x: rx.has(F.right(x, F.lit(TAIL)), OPEN_END)

        def start(digit: Column, upper: Column) -> Column:
            return (
                F.when(digit & rx.has(s, r"^\d+\.$"), "n").when(n < 3, "-").when(digit & rx.has(s, rf"^\d+\.\s+{WIDE}+$"), "W")
                .when(upper & (n < 100) & rx.has(s, NAMED), "M").when(upper & (n < 100) & open_(s), "U").otherwise("-")
            )

        def whole(digit: Column, upper: Column, wide: Column) -> Column:
            fragment = (n <= 60) & ~digit & (upper | ((n < 40) & (count(s, "Lu") > count(s, "Ll")))) & ~rx.has(s, r"^\p{Ll}")
            after_open = (i > 0) & open_(rx.strip(F.get(all_, i - 1)))
            most = lambda longest, free: wide & (n < longest) & ((n < free) | after_open)
            return F.concat(start(digit, upper), runs.flags(("f", fragment), ("a", most(80, 40)), ("b", most(60, 30)), ("c", wide & (n < 80))))

        # each test once: a function's parameter is a value, an expression used twice is computed twice
        coded = let(rx.has(s, r"^\d+\."), lambda d: let(rx.all_upper(s), lambda u: let(rx.has(s, rf"^{WIDE}*$"), lambda w: whole(d, u, w))))
        return F.when(s == "", "-----").otherwise(coded)

    title = lambda lines: spaced(F.transform(lines, lambda x: runs.of(x, 5)))
    numbered = runs.line("n....") + runs.line(".f...") + "*+"
    found = runs.recode(runs.coded(text, code), runs.line("n...."), numbered, lambda r: (F.size(r) > 1) & (F.char_length(title(r)) > 10), lambda _: F.lit("N"))
    heads = "|".join(runs.line(a) + runs.line(b) + "*+" for a, b in (("N....", ".f..."), ("W....", "..a.."), ("M....", "...b."), ("U....", "....c")))
    # else no line can begin a heading: none is a number or numbered title, none has only capitals
    likely = rx.has(text, rf"^\s*\d+\.(?:\s*$|\s+[{CAPITAL}])|^[^\p{{Ll}}\n]*\p{{Lu}}[^\p{{Ll}}\n]*$", "m") & (F.size(split(text)) > 1)
    return F.when(likely, runs.plain(runs.rewrite(found, 5, heads, lambda r: F.array(title(r))), 5)).otherwise(text)


def is_boundary(s: Column) -> Column:
    """Whether a stripped line stands for itself: blank, heading, quote, rule, table, fence, numbered or loud title."""
    mark = rx.has(s, rf"^(?:[#|]|\* |> |```|(?:---|\*\*\*)\z|\d+\.\s+[{CAPITAL}])")
    roman = F.substring(s, 1, 1).isin(*"IVXLC") & rx.has(s, rf"^[IVXLC]+\s*[-–—.]\s+[{CAPITAL}]") & loud(s)
    return (s == "") | mark | roman | ((F.char_length(s) < 100) & rx.all_upper(s))


def starts_paragraph(before: Column, s: Column) -> Column:
    """Whether a line that is no boundary begins a paragraph behind the line ``before`` (null: behind a boundary)."""
    item, end = rx.has(s, ITEM), rx.rstrip(before)
    glued = rx.has(F.right(end, F.lit(TAIL)), OPEN_WORD, "i") | rx.has(s, r"^\p{Ll}")
    # the dear tests last
    return before.isNull() | (((end == "") | F.right(end, F.lit(1)).isin(*".!?;") | s.startswith("- ")) & ~glued) | item


def rejoin_paragraphs(text: Column, composed: bool = False) -> Column:
    """Runs of lines that a page layout broke become one line each; where one starts depends on two lines only."""

    def whole(lines: Column) -> Column:
        flow = F.transform(lines, lambda x: let(rx.strip_line(x), lambda s: F.when(~is_boundary(s), s)))  # null: a boundary
        begins = lambda own, s, i: starts_paragraph(F.when(i > 0, F.get(own, i - 1)), s)
        put = lambda own, s, x, i: F.when(s.isNull(), F.concat(F.lit("\n"), x)).otherwise(F.concat(F.when(begins(own, s, i), "\n").otherwise(" "), s))
        return let(flow, lambda own: F.concat_ws("", F.transform(lines, lambda x, i: let(F.get(own, i), lambda s: put(own, s, x, i)))))

    # the first line begins something, so a newline stands in front
    return F.substring(let(split(text if composed else scalars.nfc(text)), whole), 2, 1 << 30)


def split_long_paragraphs(text: Column, threshold: int = 400) -> Column:
    """Lines over ``threshold`` characters become paragraphs that close at a sentence end beyond half of it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def pack(acc: Column, sentence: Column) -> Column:
        held = F.when(acc["held"] == "", sentence).otherwise(F.concat(acc["held"], F.lit(" "), sentence))
        full = F.char_length(held) > threshold // 2
        return F.struct(F.when(full, F.concat(acc["done"], F.array(rx.strip(held)))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(held).alias("held"))

    def body(line: Column, i: Column, all_: Column) -> Column:
        # most characters are letters, so they are passed before what stands before them is looked at
        sentences = lambda s: F.split(s, rx.rx(r"(?![a-zA-Z])(?<=[.!?])\s+(?=[A-ZÀ-Ú])"), -1)
        packed = lambda a, last: F.concat(a["done"], F.array(rx.strip(F.concat_ws(" ", F.when(a["held"] != "", a["held"]), last))))
        parts = lambda all_: F.aggregate(F.slice(all_, 1, F.size(all_) - 1), start, pack, lambda a: packed(a, F.element_at(all_, -1)))
        joined = lambda p: F.when(F.size(p) > 1, F.array(F.array_join(p, "\n\n"))).otherwise(one(line))
        whole = lambda s: F.when((F.char_length(s) <= threshold) | rx.has(s, r"^(?:[#>|]|- |\* )"), one(line)).otherwise(let(let(sentences(s), parts), joined))
        # no line is longer without its blanks
        return F.when(F.char_length(line) <= threshold, one(line)).otherwise(let(rx.strip_line(line), whole))

    return flat_map_lines(text, body)
