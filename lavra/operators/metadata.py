"""Metadata of a document as typed columns, and as YAML in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import join, let, split

# What the fields are recognised by.
BOOK_TITLE = r"(?-i:(?=[CcLlMmTt][AaIiİıOoRrUu]))(?:Manual|Curso|Tratado|Compêndio|Lições)\s+de\s+[A-ZÀ-Ú][^\n]{3,80}"
BOOK_FILE = r"(?:^|[\s_\-])(?:Manual|Curso|Tratado|Compêndio|Lições)(?=$|[\s_\-])"
FIELD_KEYS = [
    "titulo", "data", "status", "convertido_em", "proad", "orgao_emissor", "tipo_peca", "paciente",
    "autor", "reu", "impetrante", "autoridade_coatora", "pedido_liminar", "processo_origem", "comarca", "acoes_cumuladas",
]
TITLE_WORDS = [
    "PETIÇÃO", "SENTENÇA", "ACÓRDÃO", "HABEAS", "RECURSO", "MANDADO", "CONTESTAÇÃO", "AGRAVO", "APELAÇÃO",
    "EMBARGOS", "FATOS", "DIREITO", "PEDIDOS", "MÉRITO", "RELATÓRIO", "FUNDAMENTAÇÃO", "DISPOSITIVO", "EMENTA", "VOTO",
]
LONG_DATE = r"(\d{1,2})\s+de\s+(janeiro|fevereiro|março|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+de\s+(\d{4})"
PIECE_KINDS = [
    (r"HABEAS\s+CORPUS", "Habeas Corpus"), (r"PETIÇÃO\s+INICIAL", "Petição Inicial"), ("CONTESTAÇÃO", "Contestação"), ("SENTENÇA", "Sentença"), ("ACÓRDÃO", "Acórdão"),
    (r"MANDADO\s+DE\s+SEGURANÇA", "Mandado de Segurança"), (r"RECURSO\s+(?:ESPECIAL|ORDINÁRIO|EXTRAORDINÁRIO)", "Recurso"), ("AGRAVO", "Agravo"), ("APELAÇÃO", "Apelação"),
]
PARTIES = {
    "processo_origem": r"Processo(?:\s+de\s+origem)?\s*n[.º°]*\s*(\d[\d./-]+)",
    "paciente": r"Paciente:\s*(.+?)(?:\n|$)",
    "impetrante": r"Impetrante:\s*(.+?)(?:\n|$)",
    "autor": r"(?:Autor|Requerente|Exequente):\s*(.+?)(?:\n|$)",
    "autoridade_coatora": r"Autoridade\s+coatora:\s*(.+?)(?:\n|$)",
    "reu": r"(?:Réu|Requerido|Impetrado|Executado):\s*(.+?)(?:\n|$)",
}
URGENT = r"(?:Contém\s+pedido\s+(?:liminar|urgência|tutela)|pedido\s+liminar|MEDIDA\s+LIMINAR)"
URGENT_ANY = r"(?:pedido\s+(?:de\s+)?(?:liminar|tutela\s+(?:de\s+)?urgência|tutela\s+antecipada)|MEDIDA\s+LIMINAR|Contém\s+pedido\s+(?:liminar|urgência|tutela)|inaudita\s+altera\s+parte)"
CPF = r"(\d{3}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?\d{2})"
CLAIMS = [
    (r"(?:ação\s+de\s+)?indeniza[çc]ão\s+por\s+danos?\s+morais?", "indenização por danos morais"), (r"(?:ação\s+de\s+)?indeniza[çc]ão\s+por\s+danos?\s+materiais?", "indenização por danos materiais"),
    (r"(?:ação\s+de\s+)?obriga[çc]ão\s+de\s+fazer", "obrigação de fazer"), (r"(?:ação\s+de\s+)?obriga[çc]ão\s+de\s+n[aã]o\s+fazer", "obrigação de não fazer"), (r"repara[çc]ão\s+de\s+danos", "reparação de danos"),
    (r"revis[aã]o\s+contratual", "revisão contratual"), (r"cobran[çc]a", "cobrança"), (r"reintegra[çc]ão\s+de\s+posse", "reintegração de posse"), (r"consigna[çc]ão\s+em\s+pagamento", "consignação em pagamento"),
    (r"(?:rescis[aã]o|resolu[çc]ão)\s+contratual", "rescisão contratual"), (r"repeti[çc]ão\s+de\s+ind[eé]bito", "repetição de indébito"), (r"declarat[oó]ria\s+de\s+(?:nulidade|inexist[eê]ncia)", "declaratória de nulidade"),
]
NO_TITLE = "Documento sem título"


def strip_bold(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\*{3}", ""), r"\*{2}", "")


def _head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def file_title(filename: Column) -> Column:
    """A file's name without suffix, marks and a copy's number."""
    base = F.regexp_replace(filename, r"\.[^.]*\z", "")
    return rx.strip(F.regexp_replace(rx.strip(F.translate(base, "_-", "  ")), r"\(\d+\)\z", ""))


def title(text: Column, filename: Column) -> Column:
    """A book's title in the text or the file's name, else the first line fit for one, else the file's name."""
    book = rx.first(_head(text, 3000), BOOK_TITLE, 0, "i")
    book = F.substring(rx.strip(F.regexp_replace(F.regexp_replace(rx.strip(book), r"(?s)[ \t\n]+\d+[ªº°]\s*(?:ed|edição).*", ""), "(?s)[.;].*", "")), 1, 120)
    by_file = F.when(rx.has(filename, BOOK_FILE, "i"), rx.strip(F.regexp_replace(file_title(filename), r"\s+\d{4}\z", "")))
    near_isbn = F.when(rx.has(_head(text, 5000), r"ISBN\s+[\d\-]+"), F.get(F.filter(F.transform(split(_head(text, 5000)), rx.strip), lambda s: rx.has(s, BOOK_TITLE, "i")), 0))

    def fit(s: Column) -> Column:
        cited = rx.has(s, r"^[A-ZÀ-Ú]{2,}[A-ZÀ-Ú\s]*,\s+[A-ZÀ-Ú]") & (s.contains(". In:") | s.contains("Acesso em") | s.contains("Disponível em"))
        name = rx.all_upper(s) & (rx.count(s, r"\S+") <= 4) & ~rx.has(s, rf"\b(?:{'|'.join(TITLE_WORDS)})\b")
        field = rx.has(s, rf"^(?:{'|'.join(FIELD_KEYS)})\s*:", "i") | rx.has(s, r"^\w+:\s+[\"']")
        return (F.char_length(s) > 5) & ~field & ~F.lower(s).isin("sumário", "índice", "sumario", "indice") & ~s.startswith("- [") & ~cited & ~name

    bare = lambda x: rx.strip(F.regexp_replace(rx.strip(x), "^#+", ""))
    early = F.get(F.filter(F.transform(F.slice(split(text), 1, 3), bare), fit), 0)  # most often that is it, and no other line is looked at
    first = F.coalesce(early, F.get(F.filter(F.transform(split(text), bare), fit), 0))
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(book), filled(by_file), F.substring(near_isbn, 1, 120), F.substring(first, 1, 120), filled(file_title(filename)), F.lit(NO_TITLE))


def document_date(text: Column) -> Column:
    """The first date in words whose day exists, else the first of the form dd/mm/yyyy."""
    long = F.filter(rx.all_of(text, LONG_DATE, 0, "i"), lambda m: F.regexp_extract(m, r"^(\d+)", 1).cast("int").between(1, 31))
    return F.coalesce(F.get(long, 0), rx.first(text, r"\d{2}/\d{2}/\d{4}", 0))


def issuer(text: Column) -> Column:
    """The authority that a line names, but not for books."""
    found = rx.first(text, r"((?:TRIBUNAL|CONSELHO|CORREGEDORIA|MINISTÉRIO|SECRETARIA)[\w\s]{3,60}?)(?=\n)", 1, "i")
    fit = lambda name: ~rx.has(_head(text, 3000), BOOK_TITLE, "i") & ~F.coalesce(name.contains("Conselho Fiscal"), F.lit(False))
    # else no line ends in words: a newline is looked for first
    likely = rx.has(text, r"\n(?<=[\w\s]{3}\n)")
    return F.when(likely, let(found, lambda name: F.when(name.isNotNull() & fit(name), F.substring(rx.strip(name), 1, 80))))


def piece_kind(text: Column) -> Column:
    head = F.upper(_head(text, 2000))
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(PIECE_KINDS):
        out = F.when(rx.has(head, pattern), kind).otherwise(out)
    return out


def basic(text: Column, filename: Column, today: Column, extended: bool = False) -> list[tuple[str, Column]]:
    """Names and values in the order of the YAML; ``today`` is a parameter, so results can be repeated."""
    out = [("titulo", title(text, filename)), ("proad", rx.strip(rx.first(text, r"(?-i:(?![a-oqrt-zA-OQRT-Z ])(?=[PpSsſ][EeRr]))(?:PROAD|SEI|Processo|Proc\.)\s*(?:n[º°.]?\s*)?(\d[\d./-]+)", 1, "i"))), ("data", document_date(text)), ("orgao_emissor", issuer(text))]
    if extended:
        area = _head(text, 3000)
        out.append(("tipo_peca", piece_kind(text)))
        out += [(name, F.substring(rx.strip(rx.first(area, p, 1, "i")), 1, 120)) for name, p in PARTIES.items()]
        out.append(("pedido_liminar", F.when(rx.has(area, URGENT, "i"), "true")))
    return [*out, ("status", F.lit("vigente")), ("convertido_em", F.date_format(today, "yyyy-MM-dd"))]


def procedural(text: Column) -> list[tuple[str, Column]]:
    """The parties, place, urgency and claims of a pleading."""
    area = _head(text, 5000)
    labelled = rf"(?:Autor|Requerente|Exequente|Impetrante)[,:]\s+([A-ZÀ-Ú][A-ZÀ-Ú ]{{3,}})(?:,?\s*(?:inscrit[oa]\s+no\s+CPF|CPF)\s*(?:n[º°.]?\s*)?{CPF})?"
    named = rf"\*{{0,2}}([A-ZÀ-Ú][A-ZÀ-Ú ]{{5,}})\*{{0,2}},\s*(?:brasileiro|brasileira|nacionalidade)(?:[^,]*inscrit[oa]\s+no\s+CPF[^\d]*{CPF})?"
    part = lambda k: F.coalesce(rx.first(area, labelled, k), rx.first(area, named, k))
    who, cpf = F.substring(rx.strip(strip_bold(part(1))), 1, 120), part(2)
    author = F.when(cpf != "", F.concat(who, F.lit(" (CPF: "), rx.strip(cpf), F.lit(")"))).otherwise(who)
    defendant = F.substring(rx.strip(rx.first(area, r"(?:Réu|Requerido|Executado|Impetrado|Autoridade\s+coatora)[:\s]+(.+?)(?:\n|,\s*(?:inscrit|qualificad|com\s+sede))", 1, "i")), 1, 120)
    place = rx.strip(strip_bold(rx.first(area, r"(?:Comarca|Foro|Vara)\s+(?:de\s+|da\s+|do\s+)?([A-ZÀ-Ú][^\n#]{2,60}?)(?:\s*[-–—]\s*[A-ZÀ-Ú]{2})?(?:\n|#|$)", 1, "i")))
    place = rx.strip(F.regexp_replace(rx.strip(F.regexp_replace(place, "(?s)[a-záéíóú]+-[a-záéíóú]+-.*", "")), r"[\[\]()]+\z", ""))
    low = F.lower(area)
    claims = F.array_join(F.array_compact(F.array(*(F.when(rx.has(low, p), name) for p, name in CLAIMS))), ", ")
    return [
        ("autor", author), ("reu", defendant), ("comarca", F.when(F.char_length(place) > 2, F.substring(place, 1, 80))),
        ("pedido_liminar", F.when(rx.has(area, URGENT_ANY, "i"), "true").otherwise("false")), ("acoes_cumuladas", F.when(claims != "", claims)),
    ]


def yaml_lines(fields: list[tuple[str, Column]]) -> Column:
    """``key: "value"`` of the fields that are not null."""
    value = lambda c: F.replace(strip_bold(c.cast("string")), F.lit('"'), F.lit('\\"'))
    return F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f'{name}: "'), value(c), F.lit('"'))) for name, c in fields)))


def front_matter(text: Column, filename: Column, today: Column, extended: bool = False, extra: bool = False) -> Column:
    """The YAML block; ``extra`` adds the procedural fields behind the others, whether or not they repeat one."""
    rows = yaml_lines(basic(text, filename, today, extended))
    rows = F.concat(rows, yaml_lines(procedural(text))) if extra else rows
    return join(F.concat(F.array(F.lit("---")), rows, F.array(F.lit("---"))))


def with_title(text: Column, titled: Column) -> Column:
    """A first-level heading of the title before a text that has none."""
    has_one = let(split(text), lambda all_: F.exists(all_, lambda x: rx.strip(x).startswith("# ")))
    return F.when(has_one, text).otherwise(F.concat(F.lit("# "), titled, F.lit("\n\n"), text))
