"""Queries of text operators over made-up texts, with SQL for DuckDB that states each rule by itself.

A fixture is a pool of lines that the rules are about; each order's text is some of them, in an order of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.lines import join
from lavra.operators import blocks, cleaning, enrich, headings, light, paragraphs, strip, structure
from lavra.plans.queries import LEGAL, MESS, query

STRIDES = (1, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)


def picked(pool: list[str], n: int, first: str = "", last: str = "fim do texto") -> str:
    """Texts of ``n`` lines from ``pool`` for each order; ``~`` stands for a word, ``^^`` for a number, ``¶`` for a line end."""
    line = lambda j: f"case (o_orderkey * {STRIDES[j % 12]} + {j * j}) % {len(pool)} " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(pool)) + " end"
    body = ", '¶', ".join(line(j) for j in range(n))
    whole = f"concat({f"'{first}', '¶', " if first else ''}{body}{f", '¶', '{last}'" if last else ''})"
    return f"select o_orderkey as doc_id, replace(replace(replace({whole}, '~', o_orderpriority), '^^', cast(o_custkey % 25 as string)), '¶', chr(10)) as text from {{orders}}"


#: ``e``: a row for each line, ``s`` without blanks at its ends, ``l`` all lines, numbered from 1.
LINES = ", e as (select doc_id, i, l[i] as line, trim(l[i]) as s, l, len(l) as n from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from src)))"
#: ``d``: a row for each text.
DOCS = ", d as (select doc_id, text, l, len(l) as n from (select doc_id, text, string_split(text, chr(10)) as l from src))"


def _lines(x: str) -> str:
    """Lines ``x`` (null: none) of ``z`` as texts."""
    return f" select doc_id, coalesce(string_agg({x}, chr(10) order by i), '') as text from z group by doc_id"


def sub(*steps: tuple[str, str], of: str = "text") -> str:
    """Patterns replaced one after the other."""
    for pattern, to in steps:
        of = f"regexp_replace({of}, '{pattern}', {to if to.startswith('chr') else f"'{to}'"}, 'g')"
    return of


def text_query(name: str, body: Callable[[Column], Column], sql: str, source: str) -> None:
    query(name, sql, source)(lambda docs: docs.select("doc_id", body(F.col("text")).alias("text")))


def plain(name: str, body: Callable[[Column], Column], expression: str, source: str) -> None:
    text_query(name, body, f"select doc_id, {expression} as text from src", source)


# --- cleaning --------------------------------------------------------------------------------------------------------

THREE = "chr(10) || chr(10) || chr(10)"
plain(
    "ocr_noise", cleaning.remove_ocr_noise,
    sub((r"\b[^a-zA-ZÀ-ÿ0-9\s]{3,}\b", ""), (r"(?m)^[^\p{L}\p{N}_\s]*$", ""), (r"\.{4,}", ""), ("_{3,}", ""), ("-{5,}", "---")),
    picked(["ab***cd ~", "x!!y", "***", "--- ---", "a.....b", "fim ____ e __ fim", "soma ------ fim ---- x", "% $ &", "texto comum ~", "", "(((a)))", "a#%&b#%&c", "•••", "v.... ^^"], 6),
)
text_query(
    "enumerations_apart", cleaning.separate_enumerations,
    DOCS + r""" select doc_id, array_to_string(list_transform(range(1, n + 1), lambda i: case when i > 1 and regexp_matches(trim(l[i]), '^([a-z]\)|[IVXLC]+\s*[-–—]\s|[ivxlc]+\)\s|\d+\.\d+\.?\s)') and trim(l[i - 1]) <> '' then chr(10) || l[i] else l[i] end), chr(10)) as text from d""",
    picked(["texto ~", "a) item", "", "IV - tema ~", "  ii) sub", "1.2 parte", "1.2. parte ^^", "B) nada", "XL– tema", "1) nada", "vi)sem"], 7),
)
_FUSE = [r"(?i)^(.*?)\s+(cap[íi]tulo\s+\d+\s+.+)$", r"(?i)^(.*?)\s+(quadro\s+mnem[ôo]nico.*)$", r"^(.*?)\s+(PARTE\s+[IVXLC]+\s+.+)$", r"(?i)^(.*?)\s+(se[çc][ãa]o\s+[IVXLC\d]+\s+.+)$"]
_FUSED_CASE = " ".join(f"when regexp_matches(c, '{p}') and length(trim(regexp_extract(c, '{p}', 1))) > 5 then m || trim(regexp_extract(c, '{p}', 1)) || chr(10) || chr(10) || m || trim(regexp_extract(c, '{p}', 2))" for p in _FUSE)
text_query(
    "fused_headings", cleaning.split_fused_headings,
    LINES + r", m as (select *, regexp_extract(s, '^(#{1,6}\s+).+$', 1) as m from e), z as (select *, substr(s, length(m) + 1) as c from m)" + _lines(f"case {_FUSED_CASE} else line end"),
    picked(["Livro geral Capítulo 3 Dos bens ~", "## Parte inicial PARTE II Das coisas", "Curto Capítulo 2 fica", "Livro primeiro Quadro mnemônico das penas", "### Livro Quadro mnemônico x", "Texto comum ~", "Teoria inicial Seção IV Dos atos", "Teoria geral quadro mnemonico", "", "# Todo o livro capitulo ^^ das coisas PARTE V fim", "parte inicial Parte II nada"], 5),
)
_READER = "escolher fonte|alterar layout|luminosidade|fazer buscas|anotar trechos|menu|marca-texto|marcador|bookmark|aumentar fonte|diminuir fonte|tamanho da fonte|modo noturno|modo de leitura|configurações de leitura|opções de visualização|deslize para|toque para|toque na tela|arraste|pinça para zoom|sumário interativo|índice interativo|navegação|barra de progresso|epub|e-reader|e-book|ebook|kindle|kobo|google play livros|apple books|this ebook|digital rights|drm|choose font|adjust layout|brightness|search text|annotate|highlight"
text_query(
    "reader_boilerplate", cleaning.remove_reader_boilerplate,
    DOCS + f""", h as (select *, list_filter(range(1, n + 1), lambda i: i <= 150 and regexp_matches(lower(l[i]), '{_READER}')) as h from d),
r as (select *, l[h[-1] + 1:] as rest from h), k as (select *, list_filter(range(1, len(rest) + 1), lambda i: length(trim(rest[i])) >= 40)[1] as stop from r)
select doc_id, case when n < 5 or len(h) < 3 then text else array_to_string(l[:h[1] - 1] || case when stop is null then [] else rest[stop:] end, chr(10)) end as text from k""",
    picked(["Obra de ~", "Use o Menu para sair", "O Kindle tem modo noturno", "aumentar fonte", "deslize para ver", "", "curta", "Este é um parágrafo longo do livro, que fica onde está ~", "texto de quarenta letras ou pouco mais que isso", "DRM e ePub"], 8),
)
_BEYOND = "length(regexp_replace(s, '[^\\p{L}]|[\\x{00}-\\x{24F}]', '', 'g'))"
text_query(
    "glyphs", cleaning.remove_corrupted_glyphs,
    LINES + f""", b as (select *, {_BEYOND} as beyond, length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) as letters from e),
z as (select *, case when length(s) < 3 or beyond = 0 then line when beyond / letters > 0.3 then null else trim(regexp_replace(regexp_replace(line, '[\\x{{250}}-\\x{{10FFFF}}]', '', 'g'), ' {{2,}}', ' ', 'g')) end as x from b)""" + _lines("x"),
    picked(["texto ж com um sinal ~", "жжж ab", "ж", "", "中文字 e mais nada de texto aqui", "ação é normal", "a ж b  c d e f g", "пример", "letras ӕӕ e mais letras latinas ^^"], 6),
)
_PREFIXES = "vice|ex|pré|pós|recém|bem|mal|além|aquém|sem|não|sócio|grão|grã|auto|contra|entre|extra|infra|intra|macro|mega|micro|mini|multi|neo|pan|pluri|proto|pseudo|semi|sobre|sub|super|supra|ultra"
_WORD = r"[\p{L}\p{N}_]"
_HYPHEN = [step for gap in (r"\s*\n\s*", r"\s{2,}") for step in ((rf"(?i)(^|[^\p{{L}}\p{{N}}_])({_PREFIXES})-{gap}({_WORD})", r"\1\2-\3"), (rf"({_WORD}+)-{gap}({_WORD})", r"\1\2"))]
plain(
    "hyphenation", cleaning.fix_hyphenation, sub(*_HYPHEN),
    picked([f"o {p}-¶ prefeito e a pala-¶vra ~" for p in _PREFIXES.split("|")] + ["um Auto-  móvel e re-  novado", "linha com traço - solto", "número 12-¶34 e fim-"], 4),
)
plain(
    "case_numbers", cleaning.reconnect_case_numbers, sub((r"\b(HC|RHC|REsp|AgRg|ARE|AREsp|ADI|ADPF|RE|RMS)\s*\n\s*(\d{7}-\d{2}\.\d{4})", r"\1 \2")),
    picked([f"no {c}¶ 1234567-8^^.2024" for c in ("HC", "RHC", "REsp", "AgRg", "ARE", "AREsp", "ADI", "ADPF", "RE", "RMS", "XHC")] + ["HC ¶1234567-89.2024.1", "HC¶¶1234567-89.2024"], 4).replace("8^^.", "89."),
)
_ART = r"\b[Aa][Rr][Tt](?:[Ii][Gg][Oo])?\s*\.?\s*(\d)"
_PAR = r"\b[Pp][Aa][Rr](?:[ÁáAa][Gg][Rr][Aa][Ff][Oo])?\.?\s*(\d|[Úú]nico)"
plain(
    "citations", cleaning.normalize_citations,
    sub((_ART, r"Art. \1"), (_PAR, r"§ \1"), (r"§\s*§", "§"), (r"(Art\.)\s*(\d)", r"\1 \2"), (r"(§)\s*(\d)", r"\1 \2"), (r"(Art\.\s*\d+[º°]?)\s+,", r"\1,"), (r"(Art\.\s*\d+)\s*[oO](\s|,|$|\.)", r"\1º\2"), (r"\b[Aa]linea\b", "alínea")),
    picked(["o artigo 5 , da lei", "art.7o, e ARTIGO 9 O do ~", "Par. 3 e parágrafo único", "§ § 4 e §5", "a Alinea b e alinea c", "Art. 12º , fim", "art 1O. E depois", "texto ~ sem nada", "PARÁGRAFO 2o", "partida 3"], 4),
)


# --- structure and headings ------------------------------------------------------------------------------------------

_TITLES = r"(?i)^(?:#{1,3}\s+|\*\*)?(?:PETIÇÃO|CONTESTAÇÃO|SENTENÇA|ACÓRDÃO|HABEAS\s+CORPUS|MANDADO|RECURSO|AGRAVO|APELAÇÃO|MANIFESTAÇÃO|IMPUGNAÇÃO|RÉPLICA|MINUTA|EMBARGOS)"
_BODIES = r"(?i)^(?:[A-ZÀ-Ú][A-ZÀ-Ú\s]+,\s+(?:já\s+qualificad|brasileiro|brasileira|pessoa\s+jurídica)|(?:O|A)\s+(?:Autor|Réu|Requerente|Requerido|Impetrante|Paciente)\b|(?:Trata-se|Cuida-se|Versam?\s+os\s+autos)|(?:##?\s+)?\d+\.\s+|\*\*\d+\.)"
text_query(
    "summary_italics", structure.italicize_summary,
    DOCS + f""", t as (select *, list_filter(range(1, n + 1), lambda i: regexp_matches(trim(l[i]), '{_TITLES}'))[1] as t from d),
b as (select *, list_filter(range(t + 1, least(t + 20, n + 1)), lambda i: regexp_matches(trim(l[i]), '{_BODIES}'))[1] as b from t)
select doc_id, case when t is null or b is null then text else array_to_string(list_transform(range(1, n + 1), lambda i: case when i > t and i < b and trim(l[i]) <> '' and not regexp_matches(trim(l[i]), '^[*>#]') then '*' || trim(l[i]) || '*' else l[i] end), chr(10)) end as text from b""",
    picked(["## Petição de ~", "SENTENÇA", "dano moral. prova.", "", "> citado", "**forte**", "JOÃO DA SILVA, brasileiro", "O Autor pede", "Trata-se de ação", "1. Dos fatos", "resumo ~ do caso", "HABEAS CORPUS", "nada a ver"], 9),
)
_CLOSES = r"(?i)^(?:Nestes\s+termos|Termos\s+em\s+que|Nesses\s+termos|Pede\s+deferimento|Respeitosamente|Atenciosamente|Data\s+supra|P\.\s*deferimento)"
_PLACE = r"(?i)^[A-ZÀ-Ú][a-záéíóúàâêôãõç]+(?:/[A-Z]{2})?,?\s+\d{1,2}\s+de\s+[\p{L}\p{N}_]+\s+de\s+\d{4}"
text_query(
    "signatures", structure.format_signature,
    LINES + f""", c as (select *, min(case when i > n - 30 and regexp_matches(s, '{_CLOSES}') then i end) over (partition by doc_id) as start from e),
z as (select *, case when start is null or i < start then line else case when i = start then chr(10) || '---' || chr(10) || chr(10) else '' end
  || case when regexp_matches(s, '{_CLOSES}') or regexp_matches(s, '{_PLACE}') then s || chr(10)
     when regexp_matches(s, '(?i)OAB/[A-Z]{{2}}\\s*(?:n[º°.]*\\s*)?\\d+') or (regexp_matches(s, '\\p{{Lu}}') and not regexp_matches(s, '\\p{{Ll}}') and length(s) between 6 and 79) then '**' || s || '**' else s end end as x from c where start is null or i < start or s <> '')""" + _lines("x"),
    picked(["Texto do pedido", "Nestes termos,", "Pede deferimento.", "", "Maceió, 3 de maio de 2024", "Maceió/AL 3 de maio de 2024", "MARIA DE SOUZA", "OAB/AL n. 1234", "Dr. João, OAB/SP 99", "ABC", "fim de ~", "P. deferimento"], 8),
)
_MD = [
    "# Livro ~", "## Parte ^^", "### Da parte", "#### Dos fins", "##### Fundo", "###### Mais", "texto ~", "", "#sem espaço", "  ## recuado", "mais texto", "## ", "# Fim  ", "> citado",
]
_HEAD = r"^(#{1,6})\s+(.+?)\s*$"
text_query(
    "level_jumps", headings.fix_level_jumps,
    LINES + f""", h as (select *, length(regexp_extract(line, '{_HEAD}', 1)) as level, sum(case when regexp_matches(line, '{_HEAD}') then 1 else 0 end) over (partition by doc_id order by i)::bigint as rank from e),
f as (select doc_id, list_reduce(list(level order by i), lambda a, x: x) as nothing, list(level order by i) as levels from h where level > 0 group by doc_id),
g as (select doc_id, list_reduce(list_transform(levels, lambda x: [x]), lambda a, x: list_concat(a, [least(x[1], a[-1] + 1)])) as fixed from f),
z as (select h.doc_id, i, case when level > 0 and fixed[rank] <> level then repeat('#', cast(fixed[rank] as integer)) || ' ' || regexp_extract(line, '{_HEAD}', 2) else line end as x from h left join g using (doc_id))""".replace("list_reduce(list(level order by i), lambda a, x: x) as nothing, ", "") + _lines("x"),
    picked(_MD, 9),
)
text_query(
    "heading_blank_lines", headings.ensure_blank_lines,
    LINES + f""", z as (select *, case when regexp_matches(line, '{_HEAD}') then
  case when i > 1 and trim(l[i - 1]) <> '' and not regexp_matches(l[i - 1], '{_HEAD}') then chr(10) else '' end || line || case when i < n and trim(l[i + 1]) <> '' then chr(10) else '' end else line end as x from e)""" + _lines("x"),
    picked(_MD, 9),
)
text_query(
    "contents_list", structure.contents,
    LINES + r""", h as (select *, length(regexp_extract(s, '^(#{1,3})\s+(.+)$', 1)) as level, trim(regexp_extract(s, '^(#{1,3})\s+(.+)$', 2)) as title from e),
k as (select doc_id, bool_or(regexp_matches(line, '^\s*#{1,3}\s+(Sumário|Índice|SUMÁRIO|ÍNDICE)\s*$')) as has_one, count(*) filter (where level > 0 and lower(title) not in ('sumário', 'índice')) as n,
  string_agg(case when level > 0 and lower(title) not in ('sumário', 'índice') then repeat('  ', level - 1) || '- [' || title || '](#' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\s-]', '', 'g'), '[\s-]+', '-', 'g') || ')' end, chr(10) order by i) as entries from h group by doc_id)
select doc_id, case when has_one or n < 2 then '' else '## Sumário' || chr(10) || chr(10) || entries || chr(10) end as text from k""",
    picked(["# Livro ~", "## Parte ^^: inicial", "texto", "### Da parte, segunda!", "#### fundo", "", "## Sumário", "sumário", "  # recuado um", "texto ~", "# Fim", "corpo", "mais", "e mais"], 6),
)
_STARTERS = "A O É Um Uma Esta Este Estes Estas Aquele Isto Isso No Na Os As Em Para Por De Do Da Nos Nas Sua Seu".split()
_VERBS = "é|são|foi|está|pode|deve|tem|há|não|será|consiste|define|trata|configura|constitui|representa|caracteriza|compreende|abrange|inclui|prevê|dispõe|estabelece|determina|aplica|regula|disciplina|prescreve|estipula|assegura|garante|veda|proíbe|autoriza|permite|exige|obriga|impõe|reconhece|admite"
text_query(
    "headings_truncated", headings.truncate_headings,
    LINES + f""", h as (select *, regexp_extract(line, '{_HEAD}', 1) as m, string_split_regex(regexp_extract(line, '{_HEAD}', 2), '\\s+') as w from e),
c as (select *, case when m <> '' and len(w) > 15 then coalesce(
  list_filter(range(5, least(len(w), 20) + 1), lambda k: list_contains({_STARTERS}, w[k]) and k < len(w))[1],
  list_filter(range(5, least(len(w), 20) + 1), lambda k: regexp_matches(w[k], '(?i)^({_VERBS})($|[^\\p{{L}}\\p{{N}}_])'))[1]) end as cut from h),
z as (select *, case when cut is not null then m || ' ' || array_to_string(w[:cut - 1], ' ') || chr(10) || chr(10) || array_to_string(w[cut:], ' ') else line end as x from c)""" + _lines("x"),
    picked(["## Dos bens A posse das coisas do mundo em geral e de tudo o mais que aqui se diz ~", "### Da coisa julgada material que define o fim do processo civil e penal em todos os casos aqui", "# Curto título", "texto de muitas palavras que não é título e por isso fica como está, sem corte algum aqui nem ali", "## um dois três quatro cinco seis sete oito nove dez onze doze treze quatorze quinze dezesseis", "## um dois três quatro cinco seis sete oito nove dez onze doze treze quatorze quinze É", "", "## a b c d Isto e g h i j k l m n o p É r s"], 5),
)


# --- enrichment ------------------------------------------------------------------------------------------------------

text_query(
    "callouts", enrich.insert_callouts,
    LINES + r""", z as (select *, case when s[1] in ('#', '>') then line
  when regexp_matches(s, '(?i)^(atenção|cuidado|importante|não\s+confundir|distinção|observação)') then '> [!IMPORTANT]' || chr(10) || '> ' || s
  when length(s) between 31 and 299 and regexp_matches(s, '(?i)^.+?\s+(é|são|consiste|define-se\s+como|entende-se\s+por|conceito\s+de)\s+') then '> [!NOTE] Definição' || chr(10) || '> ' || s else line end as x from e)""" + _lines("x"),
    picked(["ATENÇÃO: prazo de ^^ dias", "Cuidado com isso", "não  confundir com posse", "A posse é o exercício de fato de um poder ~", "Posse é poder", "# Posse é o exercício de fato de um poder", "> Importante", "Direitos reais são os que recaem sobre coisas", "Contrato define-se como acordo de vontades livres", "importante! leia", "texto comum ~ sem definição alguma por aqui", "", "  Observação - recuada"], 6),
)
_KINDS = r"""case when regexp_matches(k, '(?i)^art\. [0-9]+') then '> [!QUOTE] Legislação' when regexp_matches(k, '(?i)^súmula [0-9]+') then '> [!QUOTE] Súmula' when regexp_matches(k, '(?i)^enunciado [0-9]+') then '> [!QUOTE] Enunciado'
  when regexp_matches(k, '(?i)^atenção:') then '> [!WARNING] Atenção' when regexp_matches(k, '(?i)^importante!') then '> [!IMPORTANT]' when regexp_matches(k, '(?i)^obs\.:') then '> [!NOTE]' when regexp_matches(k, 'consiste em') and length(k) < 400 then '> [!INFO] Definição' end"""
text_query(
    "smart_callouts", enrich.smart_callouts,
    LINES + r""", p as (select *, s <> '' and not regexp_matches(s, '^(>|#|\||- |\* )') as plain from e),
r as (select *, case when plain and coalesce(not lag(plain) over w, true) or not plain then 1 else 0 end as starts from p window w as (partition by doc_id order by i)),
g as (select *, sum(starts) over (partition by doc_id order by i) as run from r),
b as (select doc_id, run, min(i) as i, bool_and(plain) as plain, string_agg(s, ' ' order by i) as k, string_agg(s, chr(10) || '> ' order by i) as quoted, string_agg(case when plain then s else line end, chr(10) order by i) as whole from g group by doc_id, run),
z as (select *, """ + f"case when plain and ({_KINDS}) is not null then ({_KINDS}) || chr(10) || '> ' || quoted else whole end as x from b)" + _lines("x"),
    picked(["Art. 5 da lei", "Súmula 7 do tribunal", "Enunciado 3 ~", "Atenção: prazo", "Importante! leia", "Obs.: nota", "a posse consiste em poder de fato", "", "", "# Título", "| a | b |", "- item", "prosa de ~", "> citado"], 8),
)
text_query(
    "footnotes_normalized", enrich.normalize_footnotes,
    LINES + r""", m as (select *, case when length(s) > 20 then regexp_extract(s, '^(\d{1,3})\s*[.)\-–—]\s*(.+)', 1) else '' end as num, trim(regexp_extract(s, '^(\d{1,3})\s*[.)\-–—]\s*(.+)', 2)) as note from e),
u as (select doc_id, num, arg_max(note, i) as note from m where num <> '' group by doc_id, num),
t as (select doc_id, string_agg('[^' || num || ']: ' || note, chr(10) order by cast(num as integer)) as notes from u group by doc_id),
b as (select doc_id, coalesce(string_agg(line, chr(10) order by i) filter (where num = ''), '') as body from m group by doc_id)
select doc_id, regexp_replace(body, '\((\d{1,3})\)', '[^\1]', 'g') || case when notes is null then '' else chr(10) || chr(10) || '---' || chr(10) || chr(10) || notes end as text from b left join t using (doc_id)""",
    picked(["1. Autor de uma obra longa, São Paulo", "2) Segunda nota de rodapé ~ aqui", "12 - Décima segunda nota deste livro", "texto (1) e (12) e (1234)", "3. curta", "1 – Outra nota com o número um, ao fim", "texto ~", "", "003. Nota com zeros na frente, longa"], 7),
)


# --- removal and polishing -------------------------------------------------------------------------------------------

_COURSE = r"^\s*\|?\s*CS\s*[–\-—]\s*[A-ZÀ-Ú][A-ZÀ-Ú\s]+\s+[IVX]+\s+\d{4}\.\d\s*\|?\s*\d*\s*\|?\s*$"
_SHORT = r"^\s*\|\s*[A-Z]{2,4}\s*[–\-—]\s*[A-ZÀ-Ú][A-ZÀ-Ú\s]+\d{4}\.\d\s*\|.*\|\s*$"
_SUMMARY = r"(?is)\*Resumo[:.]?\s.*?Palavras[-\s]chave[:.]?\s.*?\*"
_PAGE, _DASHED = r"^\s*P[áa]g(?:ina|\.)\s*\d+\s*$", r"^\s*[-–—]\s*\d+\s*[-–—]\s*$"
_LEFT = ["texto ~", "", "12", "Página 3", "pág. 4", "— 5 —", "| CS – DIREITO CIVIL II 2024.1 | 7 |", "| DPC - PENAL GERAL 2023.2 | x |", "*Resumo: um texto ~. Palavras-chave: a, b.*", "*Resumo. de uma linha*", "mais texto", "# Título", "12345", "|  |  |", "| --- | :-: |", "-- Página 9 --"]
_REMOVED = sub((_SUMMARY, ""), (r"(?im)^\s*\*Resumo[:.]?\s.*?\*\s*$", ""), ("(?m)" + _COURSE, ""), ("(?m)" + _SHORT, ""), ("(?im)" + _PAGE, ""), ("(?m)" + _DASHED, ""))
_SIGNS = r"(?i)\bISBN[\s:]+[\d\-Xx]+|\bCDD\b[\s:]*\d|\bCDU\b[\s:]*\d|\bCIP\b|Dados\s+Internacionais\s+de\s+Cataloga|Catalogação\s+na\s+(fonte|publicação)|C[âa]mara\s+Brasileira\s+do\s+Livro"
text_query(
    "artifacts", strip.clean_artifacts,
    f""", r as (select doc_id, string_split({_REMOVED}, chr(10)) as l from src),
k as (select doc_id, list_filter(l, lambda x, i: not (regexp_matches(x, '^\\s*\\d{{1,4}}\\s*$') and (i = 1 or trim(l[i - 1]) = '') and (i = len(l) or trim(l[i + 1]) = ''))) as l from r),
s as (select *, len(l) as n, list_filter(range(0, len(l)), lambda i: regexp_matches(l[i + 1], '{_SIGNS}') or regexp_matches(l[i + 1], 'Ficha\\s+[Cc]atalogr[áa]fica')) as s from k),
b as (select *, s[1] as lo, s[-1] as hi from s),
c as (select *, coalesce(list_max(list_filter(range(greatest(lo - 3, 0), lo), lambda i: trim(l[i + 1])[1] = '#')) + 1, greatest(lo - 3, 0)) as first, coalesce(list_min(list_filter(range(hi + 1, least(hi + 2, n - 1) + 1), lambda i: trim(l[i + 1])[1] = '#')), least(hi + 3, n)) as last from b)
select doc_id, regexp_replace(array_to_string(case when len(s) < 2 then l else l[:first] || l[last + 1:] end, chr(10)), '\\n{{4,}}', {THREE}, 'g') as text from c""",
    picked([*_LEFT, "ISBN 978-85-123", "CDD: 340", "Ficha catalográfica", "Câmara Brasileira do Livro"], 10),
)
plain(
    "conversion_artifacts", strip.strip_artifacts,
    sub((r"(?m)^\s*\d{1,4}\s*$", ""), (r"(?im)^\s*[-–—]+\s*P[áa]gina\s*\d+\s*[-–—]+\s*$", ""), ("(?m)" + _COURSE, ""), (_SUMMARY, ""), (r"(?m)^\s*\|[\s|]*\|\s*$", ""), (r"(?m)^\s*\|[-\s:]+\|\s*$", ""), ("(?im)" + _PAGE, ""), ("(?m)" + _DASHED, ""), (r"\n{4,}", THREE)),
    picked(_LEFT, 9),
)
_NOTES = ["texto [^1] com nota ~", "[^1]: primeira nota", "[^2]:  segunda nota ~ ", "nada [^3] aqui", "texto final", "", "[^3]: terceira"]
text_query(
    "footnotes_relocated", strip.relocate_footnotes,
    DOCS + r""", k as (select *, list_filter(range(1, n + 1), lambda i: regexp_matches(l[i], '^\[\^\d+\]:\s*.+$'))[1] as k from d),
b as (select *, regexp_replace(array_to_string(l[:k - 1], chr(10)), '\s+$', '') as body, list_filter(l[k:], lambda x: regexp_matches(x, '^\[\^\d+\]:\s*.+$')) as defs from k),
u as (select *, regexp_extract_all(body || ' ', '\[\^(\d+)\][^:]', 1) as used from b),
o as (select *, list_transform(list_filter(defs, lambda x: not list_contains(used, regexp_extract(x, '^\[\^(\d+)', 1))), lambda x: chr(10) || '> [!NOTE]' || chr(10) || '> **Nota:** ' || trim(regexp_extract(x, ':\s*(.+)$', 1)) || chr(10)) as orphans,
  list_transform(list_filter(defs, lambda x: list_contains(used, regexp_extract(x, '^\[\^(\d+)', 1))), lambda x: '[^' || regexp_extract(x, '^\[\^(\d+)', 1) || ']: ' || trim(regexp_extract(x, ':\s*(.+)$', 1))) as stays from u)
select doc_id, case when k is null then text else regexp_replace(array_to_string([body] || orphans || case when len(stays) > 0 then [chr(10) || chr(10) || '---' || chr(10), array_to_string(stays, chr(10))] else [] end, chr(10)), '\s+$', '') || chr(10) end as text from o""",
    picked(_NOTES, 7),
)
plain(
    "footnotes_stripped", strip.strip_footnotes,
    sub((r">\s*\[!NOTE\]\s*\n>\s*\*\*Nota:\*\*\s*.*", ""), (r"\[\^\d+\]([^:]|$)", r"\1"), (r"(?m)^\[\^\d+\]:\s*.*$", ""), (r"\n---\s*\n*$", "chr(10)"), ("  +", " "), (r"\n{4,}", THREE)),
    picked(["texto [^1] com nota ~", "[^1]: primeira nota", "> [!NOTE]¶> **Nota:** solta", "fim [^22], aqui", "", "texto  com   espaços", "> citado"], 6, last="---"),
)
plain(
    "inline_references", strip.strip_inline_references, sub((r"(?im)^[A-ZÀ-Ú]{2,}[A-ZÀ-Ú\s]*,\s+[A-ZÀ-Ú][^\n]*(?:Acesso\s+em[:.]|Dispon[íi]vel\s+em[:.])[^\n]*\.?", "")),
    picked(["SILVA, João. Obra ~. Disponível em: http", "DE SOUZA, Ana. Acesso em. 3 de maio", "Silva, João. Sem acesso", "texto com Acesso em: nada", "", "ÁVILA, Rui. disponivel em: lá", "X, Y. Acesso em: z"], 5),
)
plain(
    "ui_texts", strip.strip_ui, sub(*((rf"(?im)^\s*{p}.*$", "") for p in (r"Clique\s+aqui\s+e\s+acesse", r"Clique\s+aqui\s+para", r"Saiba\s+mais\s+em", r"Veja\s+também[:.]?", "Compartilhe", "Imprimir"))),
    picked(["Clique aqui e acesse ~", "  clique aqui para ler", "Saiba mais em http", "Veja também: outro", "Compartilhe", "imprimir página", "texto com Clique aqui para", "Clique ali", "texto ~"], 6),
)
_BOLD = [rf"(?m)^{mark}\s*(.*\S)[ \t]*$" for mark in (r"\*\*(\d{1,3})\.\s*\*\*", r"\*\*(\d{1,3})\.\*\*", r"\*\*(\d{1,3})\*\*\s*\.")]
plain(
    "bold_lists", strip.fix_bold_lists, sub(*((p, r"\1. \2") for p in _BOLD)),
    picked(["**1. **item ~", "**22.** outro  ", "**3** . terceiro", "**4.  ** quarto", "x **5.** meio", "**1234.** longo", "**6.**", "texto"], 6),
)
_LATIN = "inaudita altera parte|animus novandi|in re ipsa|ex lege|ad hoc|ab initio|data venia|in casu|in fine|in verbis|mutatis mutandis|periculum in mora|fumus boni iuris|prima facie|erga omnes|inter partes|lato sensu|stricto sensu|ex officio|ex tunc|ex nunc|habeas corpus|mandamus|certiorari|stare decisis|ratio decidendi|obiter dictum|per se|sui generis|ultra petita|extra petita|reformatio in pejus"
_ORDINALS = "primeir[ao]|segund[ao]|terceir[ao]|quart[ao]|quint[ao]|sext[ao]|sétim[ao]|oitav[ao]|non[ao]|décim[ao]"
plain(
    "emphasis", strip.fix_emphasis, sub((rf"(?i)\*\*\*({_LATIN})\*\*\*", r"*\1*"), (rf"(?i)\*\*\*(A\s+(?:{_ORDINALS}))\*\*\*", r"**\1**")),
    picked([f"o ***{x}*** e ***{x.title()}*** ~" for x in _LATIN.split("|")] + [f"***A {x[:-4]}a*** e ***a {x[:-4]}o***" for x in _ORDINALS.split("|")] + ["***outra coisa***", "**ad hoc**"], 4),
)
plain(
    "bold_joins", strip.fix_bold_joins, sub((r"\*\*([^*]*\d)([a-záéíóúàâêôãõç][a-záéíóúàâêôãõç]+[^*]*)\*\*", r"**\1** \2"), (r"(\d{5,})([a-záéíóúàâêôãõç]{3,})", r"\1 \2")),
    picked(["**Art. 5caput da lei**", "nº 123456palavra ~", "1234palavra", "12345ab", "**sem número**", "**7x**", "**12anos e 3meses**", "texto ~"], 5),
)


# --- the light pass --------------------------------------------------------------------------------------------------

_ENDS = r"\b(de|da|do|das|dos|para|com|sob|por|no|na|nos|nas|ao|à|aos|às|em|entre|sobre|a|o|as|os|e|ou|que)\s*$"
_ROMAN_TITLE = r"^#{1,6}\s+(.*?\b(I{1,3}|IV|V|VI{0,3}|IX|X{0,3}|XI{0,3}|XII{0,3})\b[.\s\-–—]+.+)$"
text_query(
    "light_postprocess", lambda t: light.light_postprocess(t, True, True, True, True, True),
    f""", a as (select doc_id, string_split({sub((r"(\\\\_){2,}".replace(chr(92) * 4, chr(92) * 2), ""), ("_{3,}", ""), ("(?m)^[ \\t]+", ""))}, chr(10)) as l from src),
b as (select doc_id, list_transform(l, lambda x: case when regexp_matches(trim(x), '{_ROMAN_TITLE}') then '## ' || regexp_extract(trim(x), '^#{{1,6}}\\s+(.*)$', 1) else x end) as l from a),
e as (select doc_id, l, unnest(range(1, len(l) + 1)) as i from b),
w as (select *, l[i] as line, i < len(l) and regexp_matches(l[i], '{_ENDS}') and trim(l[i + 1]) <> '' and not regexp_matches(l[i + 1], '^[#>|\\-*]') as wants from e),
g as (select *, i - sum(case when wants then 1 else 0 end) over (partition by doc_id order by i) as run from w),
t as (select *, wants and (row_number() over (partition by doc_id, run, wants order by i)) % 2 = 1 as takes from g),
z as (select *, case when coalesce(lag(takes) over (partition by doc_id order by i), false) then null when takes then rtrim(line) || ' ' || ltrim(l[i + 1]) else line end as x from t)
select doc_id, replace(regexp_replace(coalesce(string_agg(x, chr(10) order by i), ''), '\\n{{4,}}', {THREE}, 'g'), '"', '“') as text from z group by doc_id""",
    picked(["linha que termina de", "  recuada ~ e", "# Parte IV - Dos bens", "### Título II. Das coisas", "## Sem numeral", "campo ____ vazio", "um \"termo\" citado", "", "¶¶¶¶", "fim com", "> citado", "texto ~", "- item da"], 9),
)
query(
    "light_contents",
    LINES + r""", h as (select doc_id, i, length(regexp_extract(line, '^(#*)', 1)) as level, trim(regexp_replace(line, '^#+', '')) as title from e)
select doc_id, coalesce(string_agg(level || ' ' || title, chr(10) order by i) filter (where level between 1 and 4 and title <> ''), '') as text from h group by doc_id""",
    picked(_MD, 8),
)(lambda docs: docs.select("doc_id", join(F.transform(light.contents(F.col("text")), lambda h: F.concat_ws(" ", h["level"].cast("string"), h["title"]))).alias("text")))
query(
    "latin_share",
    r"""select doc_id, case when length(regexp_replace(text, '\s', '', 'g')) = 0 then 1.0::double else (length(regexp_replace(text, '\s', '', 'g')) - length(regexp_replace(text, '\s|[^\p{L}]|\p{Latin}', '', 'g'))) / length(regexp_replace(text, '\s', '', 'g')) end as share from src""",
    picked(["texto latino ~", "русский текст", "漢字 e kana かな", "123 + 45", "", "ação e reação", "ελληνικά"], 4, last=""),
)(lambda docs: docs.select("doc_id", cleaning.latin_share(F.col("text")).alias("share")))


# --- rules that depend on what came before: a walk from line to line ---------------------------------------------------


def _walk(first: str, step: str, lines: str = "e") -> str:
    """``st``: a state for each line of ``lines``, from the state of the line before (``p``)."""
    return f", st as (select doc_id, 0::bigint as i, {first} from (select distinct doc_id from {lines}) union all select e.doc_id, e.i, {step} from st p join {lines} e on e.doc_id = p.doc_id and e.i = p.i + 1)"


_ENTRY = r"(regexp_matches(e.s, '^.*\.{2,}\s*\d+\s*$') or (length(e.s) < 80 and regexp_matches(e.s, '^\d+(\.\d+)*\.?\s+\S+')))"
_CONTENTS = r"regexp_matches(e.s, '(?i)^(SUMÁRIO|ÍNDICE|CONTEÚDO)\s*$')"
text_query(
    "contents_removed", blocks.remove_contents,
    LINES + _walk(
        "false as inside, 0 as blanks, false as emit",
        f"""case when {_CONTENTS} then true when not p.inside then false when {_ENTRY} then true when e.s = '' then p.blanks + 1 < 2 else length(e.s) <= 80 end,
  case when {_CONTENTS} or not p.inside or {_ENTRY} then p.blanks when e.s = '' then (p.blanks + 1) % 2 else 0 end, not {_CONTENTS} and (not p.inside or (not {_ENTRY} and e.s <> '' and length(e.s) > 80))""",
    ) + ", z as (select e.doc_id, e.i, case when emit then e.line end as x from e join st using (doc_id, i))" + _lines("x"),
    picked(["SUMÁRIO", "Índice ", "1. Dos fatos ...... 3", "2.1 Do ~", "Capítulo longo .. 12", "", "", "texto curto", "Este é um parágrafo longo do livro, que tem mais de oitenta letras e por isso acaba com a lista ~", "conteúdo", "3 coisas", "fim ~"], 11),
)
_NOTE = r"regexp_matches(e.s, '(?i)^(#{1,6}\s+)?(Observa[çc][oõ]es?\s+finais?\s+de\s+uso|Nota\s+de\s+adequa[çc][aã]o|Instru[çc][oõ]es?\s+para\s+protocolo|Nota\s+interna|Observa[çc][oõ]es?\s+ao\s+advogado|Instru[çc][oõ]es?\s+ao\s+cliente)')"
_OUT = f"(p.inside and ((e.s[1] = '#' and not {_NOTE}) or (e.s = '' and p.blanks = 2)))"
text_query(
    "notes_wrapped", blocks.wrap_notes,
    LINES + _walk(
        "false as inside, 0 as blanks, '' as out_",
        f"""case when {_OUT} then false else p.inside or {_NOTE} end, case when p.inside and e.s = '' then p.blanks + 1 else 0 end,
  case when {_OUT} then chr(10) || e.line when p.inside and e.s = '' then null when p.inside then '> ' || e.s
    when {_NOTE} then chr(10) || '> **Nota interna** — nao integra a peca processual.' || chr(10) || '>' || chr(10) || '> ' || e.s else e.line end""",
    ) + ", z as (select e.doc_id, e.i, case when st.inside and e.i = e.n then coalesce(out_ || chr(10), '') else out_ end as x from e join st using (doc_id, i))" + _lines("x"),
    picked(["Nota interna: ~", "## Observações ao advogado", "instruções para protocolo", "corpo da nota", "", "", "", "# Título", "texto ~", "Nota de adequacao", "mais corpo ^^"], 11),
)
_LIST = r"(?i)^(#{1,6})\s+(?:Refer[êe]ncias?\s*(?:Bibliogr[áa]ficas?|citadas?)?|Bibliografia|Obras\s+Consultadas|Leitura\s+Complementar|Leituras?\s+Recomendadas?|Notas?\s+(?:Bibliogr[áa]ficas?|de\s+Refer[êe]ncia)|Fontes?\s*(?:Consultadas|Bibliogr[áa]ficas?)?)\s*$"
_LEVEL = r"length(regexp_extract(e.line, '^(#{1,6})\s+', 1))"
_WORKS = r"regexp_matches(e.s, '^[A-ZÀ-Ú]{2,}[A-ZÀ-Úa-záéíóúàâêôãõç\s,]+\.\s+.*\d{4}')"
text_query(
    "reference_blocks", blocks.strip_references,
    LINES + _walk(
        "0::bigint as level, false as emit",
        f"case when p.level > 0 and ({_LEVEL} = 0 or {_LEVEL} > p.level) then p.level when p.level > 0 then 0 else length(regexp_extract(e.line, '{_LIST}', 1)) end, case when p.level > 0 then {_LEVEL} between 1 and p.level else regexp_extract(e.line, '{_LIST}', 1) = '' end",
    ) + f""", o as (select e.doc_id, row_number() over (partition by e.doc_id order by e.i) as i, e.line, e.s, count(*) over (partition by e.doc_id) as n from e join st using (doc_id, i) where emit)"""
    + _walk("null::bigint as start, 0 as many", f"case when {_WORKS} then coalesce(p.start, e.i) when e.s <> '' and (e.s[1] = '#' or p.many < 3) then null else p.start end, case when {_WORKS} then p.many + 1 when e.s <> '' and (e.s[1] = '#' or p.many < 3) then 0 else p.many end", "o").replace(", st as", ", w as").replace("from st p", "from w p")
    + f""", last_ as (select w.doc_id, start, many from w join (select doc_id, max(i) as i from w group by doc_id) using (doc_id, i)),
z as (select o.doc_id, o.i, case when o.n > 5 and many >= 3 and o.i >= start then null else o.line end as x from o join last_ using (doc_id))
select d.doc_id, regexp_replace(coalesce(string_agg(x, chr(10) order by i), ''), '\\n{{4,}}', {THREE}, 'g') as text from (select distinct doc_id from e) d left join z using (doc_id) group by d.doc_id""",
    picked(["## Referências", "# Bibliografia", "### Fontes consultadas", "SILVA, João. Obra de ~. São Paulo, 2010", "DE SOUZA, Ana. Livro. 1999", "COSTA, Rui. Tese. Rio, 2005.", "texto ~", "", "# Título", "## Parte", "#### Fundo", "PINTO, Eva. Outra obra, 2001"], 11, last=""),
)


# --- paragraphs, items, emphasis ---------------------------------------------------------------------------------------


def _and(source: str, more: str) -> str:
    """Two sources of texts in one."""
    return f"{source} union all select doc_id + 1000000, text from ({more})"


_CAP = "A-ZÁÉÍÓÚÀÂÊÔÃÕÇ"
_ALONE = rf"""(s = '' or s in ('---', '***') or regexp_matches(s, '^([#|]|\* |> |```)') or regexp_matches(s, '^\d+\.\s+[{_CAP}]') or (regexp_matches(s, '^[IVXLC]+\s*[-–—.]\s+[{_CAP}]') and upper(s) = s)
  or (regexp_matches(s, '\p{{Lu}}') and not regexp_matches(s, '\p{{Ll}}') and length(s) < 100))"""
_ITEMS = r"regexp_matches(s, '^([a-z]\)|[a-z]\.|[ivxlc]+\)|[IVXLC]+\)|\d+\)|\d+\.|[IVXLC]+\s*[-–—]\s+|§\s*\d+)\s*')"
_GOES_ON = r"(regexp_matches(before, '(?i)(^|[^\p{L}\p{N}_])(de|da|do|das|dos|na|no|nas|nos|em|com|que|e|ou|para|por|ao|à|aos|às)\s*$') or regexp_matches(s, '^\p{Ll}'))"
text_query(
    "paragraphs_rejoined", paragraphs.rejoin_paragraphs,
    LINES + f""", b as (select *, {_ALONE} as alone from e), p as (select *, lag(case when not alone then s end) over (partition by doc_id order by i) as before from b),
f as (select *, alone or before is null or {_ITEMS} or (not {_GOES_ON} and (before = '' or regexp_matches(before, '[.!?;]$') or starts_with(s, '- '))) as begins from p),
g as (select *, sum(begins::int) over (partition by doc_id order by i) as run from f),
z as (select doc_id, run as i, string_agg(case when alone then line else s end, ' ' order by i) as x from g group by doc_id, run)""" + _lines("x"),
    _and(picked(["o texto que segue", "  com mais letras.", "Outra frase começa em", "a) item do ~", "- lista", "# título", "> citado", "", "DOS FATOS", "1. Texto ^^", "IV - TEMA", "§ 2 do", "frase que acaba em da  ", "  e continua?", "Não!", "12) doze"], 11), MESS),
)
_HELD, _DONE = "regexp_extract(a, '[^¶]*$')", "regexp_replace(a, '[^¶]*$', '')"
_NEXT = f"case when {_HELD} = '' then x else {_HELD} || ' ' || x end"
text_query(
    "paragraphs_split", paragraphs.split_long_paragraphs,
    LINES + f""", q as (select *, string_split(regexp_replace(s, '([.!?])\\s+([A-ZÀ-Ú])', '\\1¶\\2', 'g'), '¶') as w from e),
r as (select *, list_reduce([''] || w[:-2], lambda a, x: case when length({_NEXT}) > 200 then {_DONE} || {_NEXT} || '¶' else {_DONE} || {_NEXT} end) as a from q),
z as (select doc_id, i, case when length(s) <= 400 or regexp_matches(s, '^([#>|]|- |\\* )') or not contains({_DONE}, '¶') then line
  else replace({_DONE}, '¶', chr(10) || chr(10)) || trim({_HELD} || ' ' || w[-1]) end as x from r)""" + _lines("x"),
    "select doc_id, replace(text, chr(10), ' ') as text from {documents}",
)
_SEMI = r"regexp_matches({0}, ';\s*$')"
text_query(
    "items_separated", blocks.separate_items,
    LINES + _walk(
        "false as inside, 0::bigint as head",
        f"""case when p.inside and e.s <> '' and e.s[1] not in ('#', '>') then {_SEMI.format('e.s')} else e.s like '%:' and length(e.s) > 10 and e.s[1] <> '#' end,
  case when p.inside and e.s <> '' and e.s[1] not in ('#', '>') then p.head when e.s like '%:' and length(e.s) > 10 and e.s[1] <> '#' then e.i else -1 end""",
    ) + f""", h as (select e.*, st.head, st.head > 0 and st.head < e.i as item from e join st using (doc_id, i)),
k as (select *, count(*) filter (where item) over (partition by doc_id, head) as many, max(i) over (partition by doc_id, head) as upto, lead(s) over (partition by doc_id order by i) as after from h),
z as (select doc_id, i, case when item and many > 1 then case when i = head + 1 then chr(10) else '' end || '- ' || regexp_replace(regexp_replace(s, '^[a-z]\\)\\s*', ''), '(?i)^[ivxlc]+\\)\\s*', '') || case when i = upto then chr(10) else '' end
  when item then s when head <> i and {_SEMI.format('s')} and length(s) > 15 and coalesce({_SEMI.format('after')}, false) then line || chr(10) else line end as x from k)""" + _lines("x"),
    _and(picked(["são requisitos do ~:", "a) primeiro item;", "ii) segundo item longo;", "terceiro;", "fim da lista.", "", ":", "# título:", "> citado;", "texto ~", "item solto e bem longo;", "outro item solto e longo;  ", "outra lista segue aqui:"], 11), MESS),
)
_PHRASES = {
    "latin": [
        "vacatio legis", "norma agendi", "jus cogens", "habeas corpus", "habeas data", "ad hoc", "in dubio pro reo", "pacta sunt servanda", "erga omnes", "inter partes", "ex tunc", "ex nunc", "ab initio",
        "a priori", "a posteriori", "de facto", "de jure", "in limine", "fumus boni juris", "periculum in mora", "res judicata", "modus operandi", "stare decisis", "lex specialis", "lex posterior",
        "ultra petita", "extra petita", "citra petita", "animus necandi", "animus domini", "lato sensu", "stricto sensu", "ad quem", "a quo", "prima facie", "mutatis mutandis", "data venia",
        "sine qua non", "numerus clausus", "nulla poena sine lege", "nullum crimen sine lege",
    ],
    "concepts": [
        "pessoa jurídica", "pessoa natural", "capacidade civil", "prescrição", "decadência", "responsabilidade civil", "ato jurídico", "negócio jurídico", "fato jurídico", "obrigação", "contrato", "posse", "propriedade",
        "boa-fé", "função social", "dignidade da pessoa humana", "devido processo legal", "contraditório", "ampla defesa", "segurança jurídica", "coisa julgada", "ato administrativo", "poder de polícia",
        "serviço público", "licitação", "dano moral", "dano material", "nexo causal", "tutela antecipada", "tutela provisória",
    ],
}
_APART = "(?i)(^|[^\\p{{L}}\\p{{N}}_*])({0})($|[^\\p{{L}}\\p{{N}}_*])"
_COURTS = "STF|STJ|TST|TSE|STM|TRF[0-9]?|TJ[A-Z][A-Z]|TJSP|TJRJ|TJMG|TJRS|TJPR|TJSC|TJBA|TJPE|TJCE|TJGO|TJDF"
_plain = "s[1] <> '#'"
_first = "".join(
    f", c{k} as (select doc_id, i, s, case when {_plain} and regexp_matches(t, '{_APART.format(c)}') and i = min(case when {_plain} and regexp_matches(t, '{_APART.format(c)}') then i end) over (partition by doc_id)"
    f" then regexp_replace(t, '{_APART.format(c)}', '\\1**\\2**\\3') else t end as t from c{k - 1})"
    for k, c in enumerate(_PHRASES["concepts"], 1)
)
_NAMED = " ".join(f"when contains(lower(t), '{a.lower()}') then regexp_replace(t, '{_APART.format(a)}', '\\1**{a}**\\3', 'g')" for a in ("PONTES DE MIRANDA", "MIGUEL REALE", "ORLANDO GOMES"))
text_query(
    "semantic_format", enrich.semantic_format,
    LINES + f""", c0 as (select doc_id, i, s, case when {_plain} then regexp_replace(line, '{_APART.format('|'.join(_PHRASES['latin']))}', '\\1*\\2*\\3', 'g') else line end as t from e){_first},
u as (select doc_id, i, s, case when {_plain} then regexp_replace(t, '\\b({_COURTS})\\b', '**\\1**', 'g') else t end as t from c{len(_PHRASES['concepts'])}),
z as (select doc_id, i, case when not {_plain} then t {_NAMED} else t end as x from u)""" + _lines("x"),
    _and(picked(["o contrato e o Contrato de posse", "# contrato de posse STF", "decisão do STF, do TJSP e TRF3, ad hoc", "em pessoa jurídica e Pessoa Natural", "Pontes de Miranda disse", "diz miguel reale", "boa-fé e prescrição; nexo causal, habeas corpus", "o *contrato* data venia",
                 "  ## ad hoc", "Dano Moral, dano moral e obrigação", "texto ~", "licitação por ORLANDO GOMES.", "numerus clausus: propriedade"], 9), LEGAL),
)
