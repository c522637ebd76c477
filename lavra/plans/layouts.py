"""Queries of pages, tables, metadata and languages, with SQL for DuckDB."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lavra.operators import enrich, layout, metadata, structure, tables
from lavra.plans import pipeline
from lavra.plans.options import Options
from lavra.plans.queries import _DETECT, _PIECES, _STOP, LEGAL, QUERIES, SQL, duck, made, query
from lavra.plans.texts import LINES, picked, text_query
from lavra.sources import files as sources

# --- pages -----------------------------------------------------------------------------------------------------------

#: Ninety pages a document, so that not all are looked at; five kinds of footers; blanks; pictures.
LONG = """select cast(l_orderkey % 17 as bigint) as doc_id, cast(l_partkey % 90 as int) as page_idx, cast(row_number() over (partition by l_orderkey % 17, l_partkey % 90 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as blk_idx,
  case when l_suppkey % 13 = 0 then 1 else 0 end as type, cast(l_partkey % 400 as double) as x0, case when l_linenumber = 1 then 31.0 else cast((l_orderkey * 7 + l_suppkey * 3) % 800 as double) end as y0, cast(l_partkey % 400 as double) + 80 as x1,
  case when l_linenumber = 1 then 45.0 else cast((l_orderkey * 7 + l_suppkey * 3) % 800 as double) end + 12 as y1,
  case l_partkey % 11 when 0 then 'CEP 57020-000' when 1 then 'tel. (82) 3216-8100' when 2 then ' página 3 ' when 3 then 'Pág. 4' when 4 then 'a.b@tj.jus.br' when 5 then '  ' else concat('bloco ', cast(l_suppkey as string)) end as text from {lineitem}"""
LONG_PAGES = "select distinct cast(l_orderkey % 17 as bigint) as doc_id, cast(l_partkey % 90 as int) as page_idx, cast(612 as double) as width, cast(842 as double) as height from {lineitem}"
RECTS = "select distinct cast(l_orderkey % 17 as bigint) as doc_id, cast(l_partkey % 90 as int) as page_idx, cast(l_suppkey % 5 * 100 as double) as x0, cast(l_suppkey % 4 * 150 as double) as y0, cast(l_suppkey % 5 * 100 + case l_linenumber when 2 then 200 else l_linenumber * 9 end as double) as x1, cast(l_suppkey % 4 * 150 + 100 as double) as y1 from {lineitem}"
_FROM = f"with b as ({duck(LONG)}), p as ({duck(LONG_PAGES)}), r as ({duck(RECTS)})"
_LOOK = """, s as (select *, count(*) over (partition by doc_id) as total from p),
looks as (select *, total <= 50 or page_idx < 10 or page_idx >= total - 10 or list_contains(list_transform(range(1, 31), lambda i: cast(floor(10 + (total - 20) / 31.0 * i) as integer)), page_idx) as looked from s where total >= 3),
z as (select b.doc_id, b.page_idx, blk_idx, x0, y0, x1, y1, trim(text) as text, height, looked, round_even(y0 / 5, 0) * 5 as y_key, y0 < height * 0.12 or y1 > height * 0.88 as zone from b join looks using (doc_id, page_idx) where type = 0 and trim(text) <> ''),
many as (select doc_id, count(*) as n from looks where looked group by doc_id),
k as (select z.doc_id, y_key from z join many using (doc_id) where zone and looked group by z.doc_id, y_key, n having count(distinct page_idx) >= n * 0.5),
hf as (select doc_id, page_idx, blk_idx from z where zone and exists (select 1 from k where k.doc_id = z.doc_id and k.y_key = z.y_key)
  union select doc_id, page_idx, blk_idx from z where y1 > height * 0.85 and (looked or exists (select 1 from k where k.doc_id = z.doc_id))
    and regexp_matches(text, '(?i)CEP\\s*\\d{5}-?\\d{3}|\\(\\d{2}\\)\\s*\\d[\\s.\\-]*\\d{3,4}[\\s.\\-]*\\d{4}|P[áÁ]gina\\s*\\d+|P[áÁ]g\\.\\s*\\d+|[a-z0-9_.+-]+@[a-z0-9-]+\\.[a-z0-9-.]+'))""".replace("\\\\", "\\")


def header_footer_long(spark: SparkSession, sf_dir: str):
    return layout.header_footer_blocks(made(spark, sf_dir, LONG), made(spark, sf_dir, LONG_PAGES))


QUERIES["header_footer_long"] = header_footer_long
SQL["header_footer_long"] = _FROM + _LOOK + " select * from hf"


def blocks_outside_tables(spark: SparkSession, sf_dir: str):
    return layout.outside_tables(made(spark, sf_dir, LONG), made(spark, sf_dir, RECTS)).select("doc_id", "page_idx", "blk_idx")


QUERIES["blocks_outside_tables"] = blocks_outside_tables
_INSIDE = "exists (select 1 from r where r.doc_id = {0}.doc_id and r.page_idx = {0}.page_idx and {0}.x0 >= r.x0 - 2 and {0}.y0 >= r.y0 - 2 and {0}.x1 <= r.x1 + 2 and {0}.y1 <= r.y1 + 2)"
SQL["blocks_outside_tables"] = _FROM + f" select doc_id, page_idx, blk_idx from b where not {_INSIDE.format('b')}"


def page_texts(spark: SparkSession, sf_dir: str):
    return layout.page_texts(made(spark, sf_dir, LONG), made(spark, sf_dir, LONG_PAGES), made(spark, sf_dir, RECTS))


QUERIES["page_texts"] = page_texts
SQL["page_texts"] = (
    _FROM + _LOOK + f""", c as (select doc_id, page_idx, count(*) >= 4 and count(*) filter (where x0 < 612 * 0.40 and x1 > 612 * 0.60) <= count(*) * 0.3 and count(*) filter (where x1 <= 612 * 0.60 and x0 < 612 * 0.40) >= 2
  and count(*) filter (where x0 >= 612 * 0.40) >= 2 as two from b where type = 0 and trim(text) <> '' group by all),
o as (select b.*, two, case when two then row_number() over (partition by doc_id, page_idx order by case when x0 >= 306 then 1 else 0 end, y0, blk_idx) else blk_idx end as pos from b join c using (doc_id, page_idx) where type = 0 and trim(text) <> ''),
f as (select doc_id, page_idx, string_agg(trim(text), chr(10) order by pos) as text from o where two or not ({_INSIDE.format('o')} or exists (select 1 from hf where hf.doc_id = o.doc_id and hf.page_idx = o.page_idx and hf.blk_idx = o.blk_idx)) group by all)
select p.doc_id, p.page_idx, coalesce(f.text, '') as text from p left join f using (doc_id, page_idx)"""
)

PAGED = "select doc_id % 37 as doc_id, cast(row_number() over (partition by doc_id % 37 order by doc_id) - 1 as int) as page_idx, text from {documents}"
_CHOSEN = ", k as (select *, count(*) over (partition by doc_id) as n from src), chosen as (select doc_id, page_idx, text from k where n <= 10 or list_contains(list_transform(range(0, 10), lambda i: cast(floor(i * (n / 10)) as integer)), page_idx))"
query("sampled_pages", _CHOSEN + " select doc_id, page_idx from chosen", PAGED)(lambda pages: enrich.sampled_pages(pages).select("doc_id", "page_idx"))
query(
    "language_votes",
    f", pages as (select * from src){_CHOSEN.replace('from src', 'from pages')}, keyed as (select doc_id * 1000000 + page_idx as doc_id, text, '' as lang from chosen){_DETECT.replace('from src', 'from keyed')}"
    """, votes as (select doc_id // 1000000 as doc_id, language, count(*) as n, min(doc_id % 1000000) as at_ from detected join keyed using (doc_id) where length(regexp_replace(keyed.text, '^\\s+|\\s+$', '', 'g')) > 30 group by all)
select d.doc_id, coalesce(arg_max(language, n * 1000000 - at_), 'por') as language from (select distinct doc_id from src) d left join votes on d.doc_id = votes.doc_id group by d.doc_id""",
    PAGED,
)(enrich.vote_language)


def page_cache_state(spark: SparkSession, sf_dir: str):
    """The cache after two puts and an expiry, and its figures."""
    rows = made(spark, sf_dir, "select concat('p', cast(user_id % 40 as string)) as page_hash, event_type as lang, case when event_id % 5 = 0 then '  ' else concat('texto ', cast(event_id as string)) end as text, ts as created_at from {events}")
    newest = rows.agg(F.max("created_at")).first()[0]
    return layout.cache_stats(layout.cache_expire(layout.cache_put(rows.limit(0), rows), 3, F.lit(newest)))


QUERIES["page_cache_state"] = page_cache_state
SQL["page_cache_state"] = """with r as (select 'p' || (user_id % 40) as page_hash, event_type as lang, 'texto ' || event_id as text, ts, event_id % 5 as f from events),
k as (select page_hash, lang, arg_max(text, ts) as text, max(ts) as ts from r where f <> 0 group by all)
select count(*) as entries, cast(coalesce(sum(strlen(text)), 0) as bigint) as bytes, min(ts) as oldest, max(ts) as newest from k where ts >= (select max(ts) from r) - interval 3 days"""


# --- tables ----------------------------------------------------------------------------------------------------------

_POOL = ["| a | a | b |", "|---|---|---|", "| ~ | ~ |  |", "| 1 | 1 | 2 | 3 |", "| x → y | ← | z |", "texto ~", "", "| só uma |", "|:-:|", "| ⇒ |", "  | b |  | c |  ", "| k ||", "| único", "||"]
_RUNS = LINES + r""", p as (select *, regexp_matches(line, '^\s*\|.*\|\s*$') as tab from e),
q as (select *, case when i = 1 or tab <> lag(tab) over (partition by doc_id order by i) then 1 else 0 end as starts from p),
g as (select *, sum(starts) over (partition by doc_id order by i) as run from q),
rows_ as (select *, list_transform(string_split(regexp_replace(s, '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) as cells from g)"""
query(
    "table_rows",
    _RUNS + """, t as (select doc_id, run, list(cells order by i) as r from rows_ where tab group by all)
select doc_id, cast(row_number() over (partition by doc_id order by run) - 1 as integer) as tbl_idx, array_to_string(list_transform(r, lambda x: array_to_string(x, '|')), ';') as cells from t""",
    picked(_POOL, 9),
)(lambda docs: tables.tables(docs).select("doc_id", "tbl_idx", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells")))
_PAD = "list_transform({0}, lambda x: x || list_transform(range(list_max(list_transform({0}, lambda y: len(y))) - len(x)), lambda i: ''))"
text_query(
    "tables_normalized", tables.normalize_tables,
    _RUNS + f""", t as (select doc_id, run, min(i) as i, bool_and(tab) as tab, string_agg(line, chr(10) order by i) as old, list(cells order by i) as r from rows_ group by doc_id, run),
h as (select *, len(list_filter(r[2], lambda c: not (c = '' or regexp_matches(c, '^[-:]+$')))) = 0 and len(list_filter(r[1], lambda c: not (c = '' or regexp_matches(c, '^[-:]+$')))) > 0 and len(r) > 1 as headed from t),
b as (select *, case when headed then r[:1] || r[3:] else r end as body from h),
w as (select *, case when len(body[1]) < 2 then body else {_PAD.format('body')} end as wide from b),
x as (select *, case when len(body[1]) < 2 then range(1, len(body[1]) + 1) else list_filter(range(1, len(wide[1]) + 1), lambda k: k = 1 or len(list_filter(wide, lambda v: v[k] <> v[k - 1])) > 0) end as cols from w),
y as (select *, {_PAD.format('list_transform(wide, lambda v: case when len(body[1]) < 2 then v else list_transform(cols, lambda k: v[k]) end)')} as d from x),
z1 as (select *, list_filter(range(1, len(d[1]) + 1), lambda k: len(list_filter(d, lambda v: v[k] <> '')) > 0) as full_ from y),
c as (select *, list_transform(d, lambda v: list_transform(full_, lambda k: v[k])) as n_ from z1),
f as (select *, list_filter(flatten(n_), lambda v: v <> '') as cells, len(full_) as width, list_filter(n_, lambda v: v[1] <> '' and not regexp_matches(v[1], '^[-:]+$')) as single from c),
out as (select *, case
  when not tab or len(r) < 2 then old
  when len(cells) > 0 and len(list_filter(cells, lambda v: regexp_matches(v, '[→←↓↑⇒⇐↔➡⬇⬆]'))) / len(cells) > 0.3 then
    coalesce(array_to_string(list_transform(list_filter(list_transform(n_, lambda v: list_filter(v, lambda q: q <> '')), lambda v: len(v) > 0 and len(list_filter(v, lambda q: not regexp_matches(q, '^[-:]+$'))) > 0), lambda v: array_to_string(list_transform(range(1, len(v) + 1), lambda k: case when k = 1 then '- ' else '  - ' end || v[k]), chr(10))), chr(10)), '')
  when width = 1 and len(single) = 1 then '> ' || single[1][1]
  when width = 1 and len(single) > 1 then array_to_string(list_transform(single, lambda v: '- ' || v[1]), chr(10))
  when width = 0 then old
  else array_to_string(list_transform(n_[:1], lambda v: '| ' || array_to_string(v, ' | ') || ' |') || case when headed then ['| ' || array_to_string(list_transform(full_, lambda k: '---'), ' | ') || ' |'] else [] end || list_transform(n_[2:], lambda v: '| ' || array_to_string(v, ' | ') || ' |'), chr(10)) end as x from f)
select doc_id, string_agg(x, chr(10) order by i) as text from out group by doc_id""",
    picked(_POOL, 10),
)


# --- metadata and pieces ---------------------------------------------------------------------------------------------

_HEADS = [
    "PROAD nº 12345/2024", "SEI 00.123-4", "Proc. n. 77.8/9", "processo 5", "TRIBUNAL DE JUSTIÇA DE ALAGOAS", "Conselho Fiscal da empresa", "Corregedoria geral da ~", "Manual de Direito Civil", "texto ~",
    "SENTENÇA", "ACÓRDÃO", "MANDADO DE SEGURANÇA", "RECURSO ESPECIAL", "AGRAVO", "APELAÇÃO", "CONTESTAÇÃO", "HABEAS CORPUS", "Petição  inicial", "RECURSO comum", "",
]


def _basic(docs):
    fields = dict(metadata.basic(F.col("text"), F.lit(""), F.lit(datetime.date(2024, 1, 1)), True))
    return docs.select("doc_id", *(fields[n].alias(n) for n in ("proad", "orgao_emissor", "tipo_peca")))


query(
    "metadata_heads",
    r"""select doc_id, nullif(trim(regexp_extract(text, '(?i)(?:PROAD|SEI|Processo|Proc\.)\s*(?:n[º°.]?\s*)?(\d[\d./-]+)', 1)), '') as proad,
  case when not regexp_matches(left(text, 3000), '(?i)(?:Manual|Curso|Tratado|Compêndio|Lições)\s+de\s+[A-ZÀ-Ú][^\n]{3,80}') and not contains(regexp_extract(text, '(?i)((?:TRIBUNAL|CONSELHO|CORREGEDORIA|MINISTÉRIO|SECRETARIA)[\p{L}\p{N}_\s]{3,60}?)\n', 1), 'Conselho Fiscal')
    then nullif(left(regexp_replace(regexp_extract(text, '(?i)((?:TRIBUNAL|CONSELHO|CORREGEDORIA|MINISTÉRIO|SECRETARIA)[\p{L}\p{N}_\s]{3,60}?)\n', 1), '^\s+|\s+$', '', 'g'), 80), '') end as orgao_emissor,
  case when regexp_matches(u, 'HABEAS\s+CORPUS') then 'Habeas Corpus' when regexp_matches(u, 'PETIÇÃO\s+INICIAL') then 'Petição Inicial' when u like '%CONTESTAÇÃO%' then 'Contestação' when u like '%SENTENÇA%' then 'Sentença' when u like '%ACÓRDÃO%' then 'Acórdão'
    when regexp_matches(u, 'MANDADO\s+DE\s+SEGURANÇA') then 'Mandado de Segurança' when regexp_matches(u, 'RECURSO\s+(ESPECIAL|ORDINÁRIO|EXTRAORDINÁRIO)') then 'Recurso' when u like '%AGRAVO%' then 'Agravo' when u like '%APELAÇÃO%' then 'Apelação' end as tipo_peca
from (select *, upper(left(text, 2000)) as u from src)""",
    picked(_HEADS, 4),
)(_basic)
_CLAIMS = ["ação de indenização por danos morais", "indenizacão por dano material", "obrigação de fazer", "obrigacão de nao fazer", "reparação de danos", "revisão contratual", "cobrança", "reintegração de posse", "consignação em pagamento", "rescisão contratual", "repetição de indébito", "declaratória de nulidade", "com pedido de tutela de urgência", "MEDIDA LIMINAR", "Réu: Banco ~, inscrito no", "Requerido Loja ~", "nada ^^"]


def _procedural(docs):
    fields = dict(metadata.procedural(F.col("text")))
    return docs.select("doc_id", *(fields[n].alias(n) for n in ("pedido_liminar", "acoes_cumuladas", "reu")))


_NAMED = [
    (r"(?:ação\s+de\s+)?indeniza[çc]ão\s+por\s+danos?\s+morais?", "indenização por danos morais"), (r"indeniza[çc]ão\s+por\s+danos?\s+materiais?", "indenização por danos materiais"), (r"obriga[çc]ão\s+de\s+fazer", "obrigação de fazer"),
    (r"obriga[çc]ão\s+de\s+n[aã]o\s+fazer", "obrigação de não fazer"), (r"repara[çc]ão\s+de\s+danos", "reparação de danos"), (r"revis[aã]o\s+contratual", "revisão contratual"), ("cobran[çc]a", "cobrança"), (r"reintegra[çc]ão\s+de\s+posse", "reintegração de posse"),
    (r"consigna[çc]ão\s+em\s+pagamento", "consignação em pagamento"), (r"(rescis[aã]o|resolu[çc]ão)\s+contratual", "rescisão contratual"), (r"repeti[çc]ão\s+de\s+ind[eé]bito", "repetição de indébito"), (r"declarat[oó]ria\s+de\s+(nulidade|inexist[eê]ncia)", "declaratória de nulidade"),
]
query(
    "metadata_procedural",
    f"""select doc_id, case when regexp_matches(text, '(?i)pedido\\s+(de\\s+)?(liminar|tutela\\s+(de\\s+)?urgência|tutela\\s+antecipada)|MEDIDA\\s+LIMINAR|Contém\\s+pedido\\s+(liminar|urgência|tutela)|inaudita\\s+altera\\s+parte') then 'true' else 'false' end as pedido_liminar,
  nullif(array_to_string(list_filter([{', '.join(f"case when regexp_matches(lower(text), '{p}') then '{n}' end" for p, n in _NAMED)}], lambda x: x is not null), ', '), '') as acoes_cumuladas,
  nullif(left(trim(regexp_extract(text, '(?i)(?:Réu|Requerido|Executado|Impetrado|Autoridade\\s+coatora)[:\\s]+(.+?)(?:\\n|,\\s*(?:inscrit|qualificad|com\\s+sede))', 1)), 120), '') as reu from src""",
    picked(_CLAIMS, 4),
)(_procedural)
text_query(
    "pieces_formatted", lambda t: structure.format_pieces(structure.piece_array(t)),
    f""", l as (select doc_id, i, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from src))),
s as (select *, regexp_replace(trim(line), '^#{{1,6}}\\s+', '') as title from l),
n as (select *, sum(case when regexp_matches(upper(title), '{_PIECES}') and length(title) < 150 then 1 else 0 end) over (partition by doc_id order by i) as island from s),
g as (select doc_id, island, case when island = 0 then 'Documento Principal' else first(title order by i) end as title, regexp_replace(string_agg(line, chr(10) order by i), '^\\s+|\\s+$', '', 'g') as content from n group by doc_id, island)
select doc_id, string_agg('# ' || title || chr(10) || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by island) as text from g where content <> '' group by doc_id""",
    LEGAL,
)
query(
    "tag_lists",
    f""", w as (select doc_id, unnest(w) as tag, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(lower(text), '[a-záéíóúàâêôãõç]{{4,}}') as w from src)),
c as (select doc_id, tag, count(*) as n, min(pos) as pos from w where tag not in ({_STOP}) group by all),
k as (select *, row_number() over (partition by doc_id order by n desc, pos) as rank from c)
select src.doc_id, coalesce(string_agg(tag, ',' order by rank) filter (where rank <= 5), '') as tags from src left join k using (doc_id) group by src.doc_id""",
)(lambda docs: docs.select("doc_id", F.coalesce(F.array_join(enrich.tag_list(F.col("text")), ","), F.lit("")).alias("tags")))
text_query(
    "section_summaries", enrich.section_summaries,
    LINES + f""", h as (select *, sum(case when s[1:3] = '## ' then 1 else 0 end) over (partition by doc_id order by i) as sec, count(*) filter (where s[1:3] = '## ') over (partition by doc_id) as many from e),
body as (select *, row_number() over (partition by doc_id, sec order by i) as k from h where sec > 0 and many > 1 and s <> '' and s[1] not in ('#', '>') and s[1:3] <> '## '),
first_ as (select doc_id, sec, s from body where k = 1),
words as (select doc_id, sec, unnest(regexp_extract_all(lower(t), '[a-záéíóúàâêôãõç]{{5,}}')) as w, unnest(range(1000)) as pos from (select doc_id, sec, string_agg(s, ' ' order by k) as t from body where k <= 10 group by all)),
tops as (select doc_id, sec, w, row_number() over (partition by doc_id, sec order by count(*) desc, min(pos)) as r from words where w is not null group by doc_id, sec, w),
few as (select doc_id, sec, w, row_number() over (partition by doc_id, sec order by r) as r from tops where r <= 5 and w not in ({_STOP})),
keys as (select doc_id, sec, string_agg(w, ', ' order by r) as w from few where r <= 3 group by all),
notes as (select f.doc_id, f.sec, chr(10) || chr(10) || '*Resumo: ' || case when instr(f.s, '.') > 21 then left(f.s, instr(f.s, '.')) when instr(f.s, '.') > 0 and length(f.s) <= 120 then f.s when length(f.s) > 120 then left(f.s, 120) || '...' else f.s end || case when w is null then '' else ' Palavras-chave: ' || w || '.' end || '*' as note from first_ f left join keys using (doc_id, sec)),
parts as (select doc_id, sec, string_agg(line, chr(10) order by i) as t from h group by all)
select parts.doc_id, string_agg(t || coalesce(note, ''), chr(10) order by parts.sec) as text from parts left join notes using (doc_id, sec) group by parts.doc_id""",
    picked(["## Dos fatos", "## Do ~", "# Livro", "O contrato foi assinado pelas partes em maio. Depois disso veio a cobrança indevida.", "contrato contrato cobrança posse", "> citado", "", "curta. frase", "Uma frase sem ponto mas com muitas palavras que passam de cento e vinte letras para que o resumo tenha de ser cortado ali mesmo", "### Sub"], 9),
)


#: Texts, some of which a rewriter refuses; some are blank, some null.
POISONED = f"""select doc_id, cast(doc_id as string) as filename, text from ({LEGAL}) union all
  select c_custkey + 1000000 as doc_id, c_name as filename, case c_custkey % 3 when 0 then null when 1 then concat('  ', chr(10), ' ') else concat('cliente ', c_name) end as text from {{customer}}"""


def refuse(text: str) -> str:
    """A rewriter that fails on some texts, for the queries of the error channel."""
    if "crime de furto" in text:
        raise ValueError("crime de furto")
    return text if "tributo" not in text else text[1_000_000]


def _converted(spark: SparkSession, sf_dir: str):
    return pipeline.convert(made(spark, sf_dir, POISONED), Options(extract_metadata=False, rag_optimize=False), datetime.date(2024, 1, 1), [refuse])


def error_rows(spark: SparkSession, sf_dir: str):
    """What failed and why, and whether the others have a text: one bad document stops no other."""
    return _converted(spark, sf_dir).select("doc_id", "success", "error", F.col("markdown").isNotNull().alias("has_text"), F.col("stats").isNotNull().alias("has_stats"))


_FATE = f"""with recursive src as ({duck(POISONED)}), f as (select doc_id, case when text is null or regexp_matches(text, '^\\s*$') then 'the document has no text'
  when contains(text, 'crime de furto') then 'ValueError: crime de furto' when contains(text, 'tributo') then 'IndexError: string index out of range' end as error from src)"""
QUERIES["error_rows"] = error_rows
SQL["error_rows"] = _FATE + " select doc_id, error is null as success, error, error is null as has_text, error is null as has_stats from f"


def status_rollup(spark: SparkSession, sf_dir: str):
    """Documents in all, converted and failed, of the pipeline itself."""
    return pipeline.rollup(_converted(spark, sf_dir))


QUERIES["status_rollup"] = status_rollup
SQL["status_rollup"] = _FATE + " select count(*) as total, count(*) filter (where error is null) as converted, count(*) filter (where error is not null) as failed from f"


# --- encodings ---------------------------------------------------------------------------------------------------------


def charsets(spark: SparkSession, sf_dir: str):
    """Each document's text as bytes of one of five forms of Unicode, and the text that detection makes of them; one-byte encodings are a guess and tested on cases."""
    docs = made(spark, sf_dir, "select doc_id, coalesce(text, '') as text from {documents}")
    kind, text = F.col("doc_id") % 5, F.col("text")
    marked = F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))
    bytes_ = F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.encode(text, "UTF-16LE")).when(kind == 2, F.encode(text, "UTF-16")).when(kind == 3, F.encode(text, "UTF-16BE")).otherwise(marked)
    return docs.select("doc_id", F.sha2(sources.decode(bytes_), 256).alias("text_sha256"))


QUERIES["charsets"] = charsets
SQL["charsets"] = "select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents"


# --- relations behind rewriters ----------------------------------------------------------------------------------------


def next_numbers(spark: SparkSession, sf_dir: str):
    """For each number that a numbering lacks, the next one that is there."""
    heads = made(spark, sf_dir, "select l_orderkey as doc_id, cast(l_partkey % 40 as int) as n from {lineitem}")
    return structure.next_existing(heads)


QUERIES["next_existing"] = next_numbers
SQL["next_existing"] = """with h as (select distinct l_orderkey as doc_id, cast(l_partkey % 40 as integer) as n from lineitem),
r as (select doc_id, unnest(range(min(n), max(n) + 1)) as missing from h group by doc_id)
select r.doc_id, cast(missing as integer) as missing, min(n) as next from r join h on h.doc_id = r.doc_id and h.n > missing where not exists (select 1 from h g where g.doc_id = r.doc_id and g.n = missing) group by all"""


def long_runs(spark: SparkSession, sf_dir: str):
    """Lines that stand in runs of three or more returned ones."""
    lines = made(spark, sf_dir, "select l_suppkey as doc_id, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as bigint) as line_no, l_returnflag = 'N' as kind from {lineitem}")
    return structure.long_runs(lines, 3)


QUERIES["long_runs"] = long_runs
SQL["long_runs"] = """with l as (select l_suppkey as doc_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as line_no, l_returnflag = 'N' as kind from lineitem),
n as (select *, row_number() over (partition by doc_id order by line_no) - row_number() over (partition by doc_id, kind order by line_no) as run from l),
s as (select *, count(*) over (partition by doc_id, kind, run) as size from n)
select doc_id, line_no, size from s where kind and size >= 3"""
