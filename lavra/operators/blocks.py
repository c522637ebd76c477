"""Blocks of lines: contents, quotes, items, notes, what an earlier conversion left, references, gaps in numbering.

Each operator gives every line a code and says in a pattern over codes which lines belong together (``functions.runs``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import runs, rx, scalars
from lavra.functions.lines import flat_map_lines, let, map_lines, one, split, where
from lavra.operators.paragraphs import CAPITAL, loud

L = runs.line


def remove_contents(text: Column) -> Column:
    """Drops a table of contents: from its title on, dotted and short numbered lines, until two blanks or a long line."""

    def code(s: Column, i: Column, all_: Column) -> Column:
        n = F.char_length(s)
        entry = rx.has(s, r"\.{2,}\s*\d+\s*$") | ((n < 80) & rx.has(s, r"^\d+(\.\d+)*\.?\s+\S"))
        return F.when(rx.has(s, r"^(SUMÁRIO|ÍNDICE|CONTEÚDO)\s*$", "i"), "T").when(entry, "E").when(s == "", "B").when(n > 80, "L").otherwise("S")

    inner = f"{L('[TE]')}*+"
    table = f"{L('T')}(?:{L('[TES]')}|{L('B')}{inner}{L('S')})*+(?:{L('B')}{inner}{L('B')}?+)?+"
    return runs.plain(runs.drop(runs.coded(text, code), table), 1)


# Lines that begin quotes, and what names a court.
EMENTA = r"^(?:#{1,6}\s+)?EMENTA\s*(?:[:.]?\s*$|[-–—:.])"
COURT = r"\(\s*(?:STF|STJ|TST|TJ[A-Z]{2}|TRF|TRT|TSE)\b.*?\)|\(\s*(?:RE|REsp|HC|MS|ADI|ADPF|AgRg|AI|RMS)\s+[\d./-]+"
CASE = r"^No\s+(?:HC|RHC|AgRg\s+no\s+(?:RHC|AREsp|REsp)|REsp|ARE|AREsp|ADI|ADPF|RE|EREsp|PEDILEF|AgInt\s+no\s+(?:AREsp|REsp)|RMS|CC)\s+[\d./-]+"


def detect_quotes(text: Column, citations: bool = True) -> Column:
    """Block quotes: head notes, long quotations that name a court, and (``citations``) paragraphs on a case."""
    from lavra.operators.structure import is_numbered_heading, is_roman_heading

    def code(s: Column, i: Column, all_: Column) -> Column:
        long = rx.has(s, '^["“]') & (F.char_length(s) > 50)
        closed = s.contains("”") | (s.startswith('"') & (F.char_length(F.translate(s, '"', "")) < F.char_length(s) - 1))
        case = rx.has(s, CASE, "i")
        start = F.when(s == "", "B").when(rx.has(s, EMENTA, "i"), "E").when(long & closed, "Q").when(long, "q").when(case & F.lit(citations), "C").otherwise("-")
        section = s.startswith("#") | (rx.has(s, rf"^\d+\.\s+[{CAPITAL}]") & loud(s))
        stop = F.when(section, "s").when(case | is_numbered_heading(s) | is_roman_heading(s), "t").otherwise("-")
        return F.concat(start, stop, runs.flags(("z", s.contains("”") | s.endswith('"')), ("c", rx.has(s, COURT, "i"))))

    whole = F.coalesce(text, F.lit(""))
    own = lambda r: F.transform(r, lambda x: runs.of(x, 4))
    named = lambda r: rx.has(F.array_join(own(r), " "), COURT, "i")
    opened = f"{L('[^B].[^z].')}*+{L('[^B].z.')}?+"
    text = runs.recode(runs.coded(text, code), L("[Qq]..."), f"(?:{L('Q...')}|{L('q...')}{opened})", named, lambda q: F.when(q == "Q", "M").otherwise("m"))

    def body(r: Column) -> Column:
        first = F.substring(F.get(r, 0), 1, 1)
        quotation = F.array((F.lit("")))
        quoted = lambda lines: F.concat(F.transform(lines, lambda s: F.concat(F.lit("> "), s)), quotation)
        # a line that only names the court closes nothing
        inside = F.slice(r, 2, F.greatest(F.size(r) - F.when(first.isin("Q", "q") & named(r), 2).otherwise(1), F.lit(0)))
        closed = first.isin("Q", "M") | F.exists(inside, lambda x: F.substring(x, 3, 1) == "z")
        return (
            F.when(first == "E", quoted(F.filter(own(r), lambda s: s != ""))).when(first == "C", quoted(own(r)))
            .when(closed & named(r), quoted(own(r))).otherwise(own(r))
        )

    note = f"{L('E...')}(?:{L('[^B][^s]..')}|{L('B...')}{L('[^B][^s]..')})*+{L('B...')}?+"
    quote = f"{L('M...')}|{L('m...')}{opened}|(?:{L('Q...')}|{L('q...')}{opened}){L('...c')}?+"
    case = f"{L('C...')}{L('[^BC]-..')}*+"
    # else no line can begin a block
    return F.when(rx.has(whole, '^\\s*(?:["“]|#{0,6}\\s*EMENTA|No\\s)', "im"), runs.plain(runs.rewrite(text, 4, f"{note}|{quote}|{case}", body), 4)).otherwise(whole)


def separate_items(text: Column) -> Column:
    """Items that end in semicolons: a list below a line that ends in a colon, else blank lines between them."""

    def code(s: Column, i: Column, all_: Column) -> Column:
        n = F.char_length(s)
        kind = F.when(s == "", "B").when(F.substring(s, 1, 1).isin("#", ">"), "X").when(s.endswith(";"), "S").otherwise("O")
        head = s.endswith(":") & (n > 10) & ~s.startswith("#")
        after_item = rx.strip(F.get(all_, i + 1)).endswith(";")
        return F.concat(F.when(head, "H").otherwise("-"), kind, runs.flags(("g", s.endswith(";") & (n > 15) & F.coalesce(after_item, F.lit(False)))))

    item = lambda s: F.concat(F.lit("- "), rx.sub(rx.sub(s, r"^[a-z]\)\s*", ""), r"^[ivxlc]+\)\s*", "", "i"))

    def body(r: Column) -> Column:
        head = F.array(F.substring(F.get(r, 0), 4, 1 << 30))
        items = F.transform(F.slice(r, 2, F.size(r)), lambda x: runs.of(x, 3))
        blank = F.array(F.lit(""))
        parted = F.flatten(F.transform(r, lambda x: F.array(F.substring(x, 4, 1 << 30), F.lit(""))))
        return F.when(~F.get(r, 0).startswith("H"), parted).when(F.size(items) > 1, F.concat(head, blank, F.transform(items, item), blank)).otherwise(F.concat(head, items))

    listed = f"{L('H..')}{L('.S.')}*+{L('.O.')}?+"
    return runs.plain(runs.rewrite(runs.coded(text, code), 3, f"{listed}|{L('-.g')}", body), 3)


# Titles of notes, and the line above them.
NOTE = (
    r"^(?:#{1,6}\s+)?(?:Observa[çc][oõ]es?\s+finais?\s+de\s+uso|Nota\s+de\s+adequa[çc][aã]o|Instru[çc][oõ]es?\s+para\s+protocolo|Nota\s+interna"
    r"|Observa[çc][oõ]es?\s+ao\s+advogado|Instru[çc][oõ]es?\s+ao\s+cliente)"
)
NOTE_BANNER = "> **Nota interna** — nao integra a peca processual."


def wrap_notes(text: Column) -> Column:
    """Notes that are no part of the document become quotes under a banner, up to a heading or three blank lines."""
    code = lambda s, i, all_: F.when(rx.has(s, NOTE, "i"), "N").when(s.startswith("#"), "H").when(s == "", "B").otherwise("O")

    def body(r: Column) -> Column:
        lines = F.filter(F.transform(r, lambda x: runs.of(x, 1)), lambda s: s != "")
        return F.concat(F.array(F.lit(""), F.lit(NOTE_BANNER), F.lit(">")), F.transform(lines, lambda s: F.concat(F.lit("> "), s)), F.array(F.lit("")))

    note = f"{L('N')}(?:{L('[NO]')}|{L('B')}{L('B')}?+{L('[NO]')})*+(?:{L('B')}{L('B')}?+)?+"
    return runs.plain(runs.rewrite(runs.coded(text, code), 1, note, body), 1)


# Fields of front matter.
FIELDS = [
    "titulo", "data", "status", "convertido_em", "proad", "orgao_emissor", "tipo_peca", "paciente", "autor", "reu", "impetrante", "autoridade_coatora", "pedido_liminar", "processo_origem",
    "comarca", "acoes_cumuladas",
]


def strip_front_matter(text: Column, run: int = 5) -> Column:
    """Drops what an earlier conversion left: front matter, field lines, contents, and ``run`` or more headings in a row.

    Of such headings (only blanks between them) the last stays, or none at the end of the text.
    """

    def code(s: Column, i: Column, all_: Column) -> Column:
        field = rx.has(s, rf"^(?:{'|'.join(FIELDS)})\s*:", "i") | rx.has(s, r"^\w+:\s+[\"'].*[\"']\s*\w*:\s*[\"']")
        entry = F.when(s.contains("](#"), "k").otherwise("K")
        return (
            F.when(s == "---", "D").when(rx.has(s, r"^#{1,3}\s+(?:Sumário|Índice|SUMÁRIO|ÍNDICE)\s*$"), "C").when(field, "F")
            .when(s.startswith("- ["), entry).when(s == "", "B").when(rx.has(s, r"^#{1,6}\s"), "H").otherwise("O")
        )

    front = rf"\A{L('D')}{L('[^D]')}*+{L('D')}?+"
    left = f"{L('C')}{L('[Kk]')}*+{L('B')}?+|{L('F')}|{L('K')}{L('[Kk]')}{{2,}}+{L('B')}*+"

    def dropped(t: Column) -> Column:
        t = runs.drop(rx.sub(runs.coded(t, code), front, ""), left)
        t = runs.drop(t, rf"{L('H')}(?:{L('B')}*+{L('H')}){{{run - 1},}}+{L('B')}*+\z")
        return runs.plain(runs.drop(t, f"(?:{L('H')}{L('B')}*+(?={L('H')})){{{run - 1},}}+"), 1)

    # else no line is a rule, a heading, a link or a field
    return where(F.coalesce(text, F.lit("")), lambda t: rx.has(t, r"^\s*(?:---|#|- \[|\w+\s*:)", "m"), dropped)


# Titles of reference sections, and works of a closing list.
REFERENCES = (
    r"^(#{1,6})\s+(?:Refer[êe]ncias?\s*(?:Bibliogr[áa]ficas?|[Cc]itadas?)?|Bibliografia|Obras\s+Consultadas|Leitura\s+Complementar|Leituras?\s+Recomendadas?"
    r"|Notas?\s+(?:Bibliogr[áa]ficas?|de\s+Refer[êe]ncia)|Fontes?\s*(?:Consultadas|Bibliogr[áa]ficas?)?)\s*$"
)
WORK = r"^[A-ZÀ-Ú]{2,}[A-ZÀ-Úa-záéíóúàâêôãõç\s,]+\.\s+.*\d{4}"


def strip_references(text: Column) -> Column:
    """Drops sections of references up to a heading as high, and a closing list of three works or more."""

    def section(s: Column, i: Column, all_: Column) -> Column:
        raw = F.get(all_, i)
        level = F.char_length(F.regexp_extract(raw, rx.rx(r"^(#{1,6})\s"), 1))
        return F.concat(F.when(level > 0, level.cast("string")).otherwise("-"), runs.flags(("R", rx.has(raw, REFERENCES, "i"))))

    deeper = lambda n: "[^" + "".join(map(str, range(1, n + 1))) + "]."
    upto = lambda n: f"[1-{n}]."
    sections = "|".join(f"{L(f'{n}R')}{L(deeper(n))}*+{L(upto(n))}?+" for n in range(1, 7))

    def body(r: Column) -> Column:
        """The heading that ends a section stays, whatever it says."""
        last = F.element_at(r, -1)
        ends = (F.size(r) > 1) & rx.has(last, "^[1-6]") & (F.substring(last, 1, 1) <= F.substring(F.get(r, 0), 1, 1))
        return F.when(ends, F.array(F.substring(last, 3, 1 << 30))).otherwise(F.array().cast("array<string>"))

    titled = rf"^#{{1,6}}\s+{rx.any_start(['ref', 'bib', 'obr', 'lei', 'not', 'fon'])}"  # else no section begins
    kept = where(F.coalesce(text, F.lit("")), lambda t: rx.has(t, titled, "m"), lambda t: runs.plain(runs.rewrite(runs.coded(t, section), 2, sections, body), 2))
    work = lambda s, i, all_: F.when(rx.has(s, WORK), "W").when(s == "", "B").when(s.startswith("#"), "H").otherwise("O")
    closing = rf"{L('W')}(?:{L('B')}*+{L('W')}){{2}}{L('[WBO]')}*+\z"
    cut = let(kept, lambda t: F.when(rx.has(t, r"^\s*[A-ZÀ-Ú]{2}", "m") & (F.size(split(t)) > 5), runs.plain(runs.drop(runs.coded(t, work), closing), 1)).otherwise(t))
    return rx.sub(cut, "\n{4,}", "\n\n\n")


# --- gaps in the numbering of headings --------------------------------------------------------------------------------

# Numbered titles, and words at which a title goes on.
TITLE = rf"[{CAPITAL}][{CAPITAL}\s,§°º().\-:/\d]{{2,}}$"
CONNECTOR = r"\b(?:DE|DA|DO|DOS|DAS|E|OU|A|AO|AOS|À|ÀS|NA|NO|NAS|NOS|EM|COM|PARA|POR|ANTE|PERANTE|SOB|SOBRE|ENTRE)\s*$"
UNTITLED = "[SEÇÃO SEM TÍTULO DETECTADO]"
#: Numbers further apart than this are not one numbering.
FARTHEST = 1000


def promote_titles(text: Column) -> Column:
    """Bare numbered titles become headings; one that ends in a connector takes the title line below."""
    unquoted = lambda s: rx.strip(F.regexp_replace(s, "^>+", ""))
    numbered = lambda s: rx.has(s, rf"^\d+\.\s+{TITLE}") | (rx.has(s, rf"^\d+\.\s+[{CAPITAL}].{{2,}}$") & (F.coalesce(rx.upper_share(s), F.lit(0.0)) > 0.5))
    apart = flat_map_lines(text, lambda x, i, all_: F.when(F.char_length(x) > 80, F.split(rx.sub(x, rf"^(.*?\S)\s+(\d+\.\s+[{CAPITAL}][{CAPITAL}\s]{{3,}}.*)$", "$1\n$2"), "\n")).otherwise(one(x)))

    def code(s: Column, i: Column, all_: Column) -> Column:
        kind = F.when(s.startswith("#"), "-").when(s.startswith(">") & numbered(unquoted(s)), "q").when(~numbered(s), "-").when(rx.has(s, CONNECTOR), "c").otherwise("n")
        return F.concat(kind, runs.flags(("u", rx.has(s, f"^{TITLE}"))))

    title = lambda r: F.array(F.concat(F.lit("## "), F.array_join(F.transform(r, lambda x, i: F.when(i == 0, unquoted(runs.of(x, 2))).otherwise(runs.of(x, 2))), " ")))
    heads = runs.plain(runs.rewrite(runs.coded(apart, code), 2, f"{L('[qn].')}|{L('c.')}{L('.u')}?+", title), 2)
    roman = lambda x: let(unquoted(rx.strip(x)), lambda s: F.when(~rx.strip(x).startswith("#") & rx.has(s, rf"^[IVXLC]+\s*[-–—.]\s+{TITLE}") & loud(s), F.concat(F.lit("## "), s)).otherwise(x))
    return map_lines(heads, roman)


def _last_of(heads: Column, number: Column) -> Column:
    """The last line with a number; null if there is none."""
    return F.array_max(F.transform(F.filter(heads, lambda h: h["n"] == number), lambda h: h["i"]))


def _absent(heads: Column) -> Column:
    """Numbers missing between the first and the last heading."""
    lo, hi = F.get(heads, 0)["n"], F.element_at(heads, -1)["n"]
    return F.when((F.size(heads) > 1) & (hi > lo) & (hi - lo <= FARTHEST), F.array_except(F.sequence(lo, F.greatest(lo, F.least(hi, lo + FARTHEST))), F.transform(heads, lambda h: h["n"]))).otherwise(F.array().cast("array<int>"))


def _next_of(heads: Column, number: Column) -> Column:
    """The last line of the least number above one that is missing."""
    return _last_of(heads, F.array_min(F.filter(F.transform(heads, lambda h: h["n"]), lambda n: n > number)))


def _put_in(lines: Column, new: Column) -> Column:
    """``new`` (``place, heading``) between blank lines before the lines of their places."""
    blocks = lambda i: F.flatten(F.transform(F.sort_array(F.filter(new, lambda a: a["place"] == i)), lambda a: F.array(F.lit(""), a["heading"], F.lit(""))))
    return F.when(F.size(new) == 0, lines).otherwise(F.flatten(F.transform(lines, lambda x, i: F.concat(blocks(i), F.array(x)))))


def _numbers_filled(lines: Column) -> Column:
    stripped = F.transform(lines, rx.strip)
    where = lambda test: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), test)
    number = lambda x, p: F.regexp_extract(x, rx.rx(p), 1).try_cast("int")
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(number(x, r"^##\s+(\d+)\.").alias("n"), i.alias("i"))), lambda h: h["n"].isNotNull())
    subs = F.filter(F.transform(stripped, lambda s, i: F.struct(number(s, r"^(?:###?\s+)?(?:\*\*)?(\d+)\.\d+\.").alias("n"), number(s, r"^(?:###?\s+)?\*\*(\d+)\.\d+\*\*").alias("m"), i.alias("i"))), lambda h: h["n"].isNotNull() | h["m"].isNotNull())
    fitting = lambda s: (s != "") & ~s.startswith("#") & (F.char_length(s) < 100) & (F.char_length(F.regexp_replace(s, r"[^\p{L}]", "")) > 3) & (rx.upper_share(s) > 0.6)

    def put(heads: Column, subs: Column, blanks: Column, stripped: Column) -> Column:
        def place(n: Column) -> Column:
            end, start = _next_of(heads, n), F.coalesce(_last_of(heads, n - 1), F.lit(0))
            inner = lambda e: F.coalesce(F.array_max(F.transform(F.filter(subs, lambda h: ((h["n"] == n - 1) | (h["m"] == n - 1)) & (h["i"] >= start) & (h["i"] < e)), lambda h: h["i"] + 1)), e)
            return let(end, lambda e: let(inner(e), lambda p: F.least(e, F.coalesce(F.array_min(F.filter(blanks, lambda b: b >= p)), e))))

        first = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<place:int,heading:string>>").alias("new"))

        def name(acc: Column, gap: Column) -> Column:
            lo = F.greatest(gap["place"] - 10, F.lit(0))
            near = F.transform(F.slice(stripped, lo + 1, gap["place"] - lo), lambda s, k: F.struct(s.alias("s"), (lo + k).alias("i")))
            free = F.get(F.filter(near, lambda x: fitting(x["s"]) & ~F.array_contains(acc["used"], x["i"])), 0)
            add = lambda x: F.struct(F.when(x.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(x["i"]))).alias("used"), F.concat(acc["new"], F.array(F.struct(gap["place"].alias("place"), F.concat(F.lit("## "), gap["n"].cast("string"), F.lit(". "), F.coalesce(x["s"], F.lit(UNTITLED))).alias("heading")))).alias("new"))
            return let(free, add)

        gaps = F.transform(_absent(heads), lambda n: F.struct(n.alias("n"), place(n).alias("place")))
        filled = lambda a: _put_in(F.transform(lines, lambda x, i: F.when(F.array_contains(a["used"], i), "").otherwise(x)), a["new"])
        return let(F.aggregate(gaps, first, name), filled)

    blanks = lambda st: where(lambda i: F.get(st, i) == "")
    inner = let(subs, lambda sb: let(stripped, lambda st: let(blanks(st), lambda bl: let(heads, lambda hd: put(hd, sb, bl, st)))))
    return F.when(F.size(heads) > 1, inner).otherwise(lines)


def _romans_filled(lines: Column) -> Column:
    value = lambda x: scalars.roman_to_int(F.regexp_extract(x, rx.rx(r"^##\s+([IVXLC]+)\s*[-–—.]\s+.+$"), 1))
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(value(x).alias("n"), i.alias("i"))), lambda h: h["n"] != 0)
    full = F.filter(F.transform(lines, lambda x, i: F.when(~rx.blank(x), i)), lambda i: i.isNotNull())

    def put(heads: Column) -> Column:
        above = lambda end: F.coalesce(F.array_max(F.filter(full, lambda i: i < end)) + 1, F.lit(0))
        heading = lambda n: F.concat(F.lit("## "), scalars.int_to_roman(n), F.lit(f" – {UNTITLED}"))
        return _put_in(lines, F.transform(_absent(heads), lambda n: F.struct(let(_next_of(heads, n), above).alias("place"), heading(n).alias("heading"))))

    return let(heads, lambda h: F.when(F.size(h) > 1, put(h)).otherwise(lines))


def fill_heading_gaps(text: Column, composed: bool = False) -> Column:
    """Promotes bare numbered titles to headings and puts headings where a number is missing between two.

    A gap is filled behind the last subsection of the number before it, else before the number after it, and named by a title line
    that stands near.
    """
    text = rx.swap(text if composed else scalars.nfc(text), {"\xa0": " ", "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": ""})
    any_title = rf"(?![a-z])(?:\d+\.\s+[{CAPITAL}]|^##\s+\d+\.|^[\s>#]*[IVXLC]+\s*[-–—.]\s)"  # else there is nothing to promote or to fill
    filled = lambda t: F.concat_ws("\n", let(let(split(promote_titles(t)), _numbers_filled), _romans_filled))
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(rx.has(t, any_title, "m"), filled(t)).otherwise(t))
