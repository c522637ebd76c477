"""Registered queries of the library's own operators, with SQL for DuckDB where SQL can express them.

The tables hold few lines that the rules are about, so most queries read texts made of their rows by a SELECT that
both engines run (``{name}`` stands for a table).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import scalars
from lavra.operators import blocks, cleaning, enrich, headings, layout, light, metadata, paragraphs, strip, structure, tables
from lavra.plans import pipeline
from lavra.plans.options import Options

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents labels pages conversations".split()


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def query(name: str, sql: str | None = None, source: str = "select doc_id, text from {documents}") -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a function of a source's rows; ``src`` in ``sql`` is the same source."""

    def put(body: Callable[[DataFrame], DataFrame]) -> Query:
        QUERIES[name] = lambda spark, sf_dir: body(made(spark, sf_dir, source))
        if sql:
            SQL[name] = f"with recursive src as ({duck(source)})\n{sql}"
        return QUERIES[name]

    return put


LEGAL = """select s_suppkey as doc_id, concat(
  case when s_suppkey % 4 = 0 then 'PETIÇÃO INICIAL' when s_suppkey % 4 = 1 then '## SENTENÇA' when s_suppkey % 4 = 2 then 'HABEAS CORPUS' else 'Texto de abertura' end, chr(10),
  'Processo de origem nº ', cast(1000000 + s_suppkey as string), '-', cast(10 + s_nationkey as string), '.2024', chr(10),
  'Autor: ', s_name, chr(10), 'Réu: Banco ', cast(s_nationkey as string), chr(10), 'Paciente: Fulano ', cast(s_suppkey as string), chr(10),
  'São Paulo, ', cast(1 + s_suppkey % 40 as string), ' de março de 20', cast(10 + s_nationkey as string), chr(10),
  case when s_suppkey % 5 = 0 then 'o crime de furto e o crime de roubo' when s_suppkey % 5 = 1 then 'o imposto e a taxa do tributo' when s_suppkey % 5 = 2 then 'o contrato de compra e venda e a posse' when s_suppkey % 5 = 3 then 'o salário do empregado' else 'nada' end, chr(10),
  '02/03/20', cast(10 + s_nationkey as string), chr(10), '- [', s_name, '](http://x/', cast(s_suppkey as string), ') e **forte** texto', chr(10),
  case when s_suppkey % 3 = 0 then 'CONTESTAÇÃO' when s_suppkey % 3 = 1 then '# Título' else '### Da parte' end, chr(10), 'fim de ', s_name, chr(10), '> citado', chr(10), '| a | b |') as text
from {supplier}"""

LINES = """select p_partkey as doc_id, case p_partkey % 24
  when 0 then concat('I – ', upper(p_brand)) when 1 then concat(cast(1 + p_size % 9 as string), '. DOS FATOS') when 2 then concat('PETIÇÃO INICIAL ', p_brand)
  when 3 then 'EXCELENTÍSSIMO SENHOR DOUTOR JUIZ' when 4 then 'DOS FATOS' when 5 then 'FUNDAMENTAÇÃO JURÍDICA' when 6 then concat('II.', cast(p_size as string), ' – tema')
  when 7 then concat('a) ', p_name) when 8 then concat(cast(p_size as string), '.1. ', p_name) when 9 then concat('Da ', p_name) when 10 then concat('Do Réu ', p_brand)
  when 11 then concat('CAPÍTULO ', cast(p_size as string), ' - ', p_type) when 12 then concat('SEÇÃO II ', p_type) when 13 then concat(cast(p_size as string), '. Texto que pode ser ', p_name)
  when 14 then concat('Autor: ', p_name) when 15 then 'CLÁUSULA primeira do acordo' when 16 then concat(cast(p_size as string), ') ', p_name) when 17 then 'recurso especial foi provido'
  when 18 then '**IV – DO PEDIDO**' when 19 then concat('1.2.3.4.5.6.7 ', p_name) when 20 then 'D' when 21 then 'III – DO DIREITO E DA LEI' when 22 then 'ii) item' else p_type end as text
from {part}"""

MESS = """select o_orderkey as doc_id, concat(
  'pala-', chr(10), 'vra e vice-', chr(10), ' prefeito', chr(9), 'com  espaços   ', chr(10), '•  item ', cast(o_custkey as string), chr(10), 'Página ', cast(o_custkey % 90 as string), chr(10),
  case when o_orderkey % 3 = 0 then '12' else 'texto' end, chr(10), '— ', cast(o_orderkey % 9 as string), ' —', chr(10), 'HC', chr(10), '1234567-89.2024 no artigo ', cast(1 + o_custkey % 9 as string), 'o , da lei', chr(10),
  'a)um elemento', chr(10), '1)dois', chr(10), 'ii)tres', chr(10), 'direitoAlheio e httpswww.site', cast(o_custkey as string), '.com e httpwwwsite', chr(10), 'Clique aqui para ler ', o_orderpriority, chr(10),
  '**', cast(1 + o_custkey % 9 as string), '. **texto ', o_orderstatus, chr(10), '***ad hoc*** e ***A primeira*** e 12345', cast(o_custkey as string), 'palavra', chr(10), 'fim....... e ____ e ------ fim', chr(10), chr(10), chr(10), chr(10), chr(10),
  '[^1]: nota ', o_orderpriority, chr(10), 'texto [link](http://x) *it* **b** ', case when o_orderkey % 2 = 0 then 'ж' else 'abcdefgh ж' end, chr(10), '7') as text
from {orders} where true"""

_LANG = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(repr(v) for v in sorted(set(words)))})))" for words in enrich.LANGUAGES.values())
_DETECT = f"""
, w as (select *, regexp_extract_all(lower(text), '[a-záàâãéèêíïóôõúüçñ]+') as w from src),
c as (select *, [{_LANG}] as c from w),
o as (select *, list_reverse_sort(c) as o, list_sum(c) as total from c),
detected as (select doc_id, lang, case when length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 30 or len(w) < 20 or total < 5 or o[2] / o[1] > 0.8 then 'por'
  else {list(enrich.LANGUAGES)}[list_position(c, o[1])] end as language from o)"""
_DOCS = "select doc_id, text, lang from {documents}"


@query("lang_detect", _DETECT + " select doc_id, language from detected", _DOCS)
def lang_detect(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", enrich.detect_language(F.col("text")).alias("language"))


@query("lang_confusion", _DETECT + " select lang, language, count(*) as n from detected group by all", _DOCS)
def lang_confusion(docs: DataFrame) -> DataFrame:
    return docs.select("lang", enrich.detect_language(F.col("text")).alias("language")).groupBy("lang", "language").agg(F.count("*").alias("n"))


@query(
    "repeated_lines_removed",
    """, l as (select doc_id, i - 1 as line_no, lines[i] as line, len(lines) as n from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from src))),
k as (select *, regexp_replace(lower(trim(line)), '[0-9]+', '#', 'g') as key, length(trim(line)) as size from l),
m as (select *, count(*) filter (where size > 3 and size < 60) over (partition by doc_id, key) as seen, row_number() over (partition by doc_id, key order by line_no) as rank from k)
select doc_id, cast(line_no as integer) as line_no, line from m where not (n >= 20 and seen >= 3
  and not regexp_matches(key, '^(dos?\\s+fatos|dos?\\s+direito|dos?\\s+pedidos|fundamenta|preliminar|do\\s+mérito|relatório|dispositivo|ementa|voto|capítulo|seção|cláusula|título)')) or rank = 1""",
)
def repeated_lines_removed(docs: DataFrame) -> DataFrame:
    return cleaning.remove_repeated_lines(docs)


_STOP = ", ".join(map(repr, enrich.STOP_WORDS))


@query(
    "tags_topk",
    f""", w as (select doc_id, unnest(w) as tag, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(lower(text), '[a-záéíóúàâêôãõç]{{4,}}') as w from src)),
c as (select doc_id, tag, count(*) as n, min(pos) as pos from w where tag not in ({_STOP}) group by all)
select doc_id, cast(rank as integer) as rank, tag, n from (select *, row_number() over (partition by doc_id order by n desc, pos) as rank from c) where rank <= 5""",
)
def tags_topk(docs: DataFrame) -> DataFrame:
    return enrich.tags(docs)


def _spread(words: list[str]) -> str:
    """A pattern for RE2 whose words are set apart by any other sign; texts are searched with doubled blanks."""
    return "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(w.replace(".", "[.]").replace(" ", "\\s+") for w in words) + ")($|[^\\p{L}\\p{N}_])"


_COUNTS = "[" + ", ".join(f"len(regexp_extract_all(t, '{_spread(p)}'))" for p in enrich.AREAS.values()) + "]"
_SUBS = " ".join(
    f"when area = '{area}' then case when list_max(s{i}) > 0 then {list(kinds)}[list_position(s{i}, list_max(s{i}))] else 'Geral' end" for i, (area, kinds) in enumerate(enrich.SUBAREAS.items())
)
_SUBCOUNTS = ", ".join("[" + ", ".join(f"len(regexp_extract_all(t, '{_spread(p)}'))" for p in kinds.values()) + f"] as s{i}" for i, kinds in enumerate(enrich.SUBAREAS.values()))


@query(
    "legal_area",
    f""", d as (select doc_id, regexp_replace(left(text, 8000), '([ \\n])', '\\1\\1', 'g') as t from src),
c as (select doc_id, {_COUNTS} as c, {_SUBCOUNTS} from d),
a as (select *, case when list_max(c) > 0 then {list(enrich.AREAS)}[list_position(c, list_max(c))] end as area from c)
select doc_id, coalesce(area, 'Direito Civil') as area, case {_SUBS} else 'Geral' end as subarea from a""",
    LEGAL + " union all select doc_id + 1000000, text from {documents}",
)
def legal_area(docs: DataFrame) -> DataFrame:
    return docs.withColumn("a", enrich.legal_area(F.col("text"))).select("doc_id", "a.area", "a.subarea")


_PIECES = "^(" + "|".join(structure.PIECE_STARTS) + ")"


@query(
    "piece_islands",
    f""", l as (select doc_id, i, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from src))),
s as (select *, regexp_replace(trim(line), '^#{{1,6}}\\s+', '') as title from l),
b as (select *, case when regexp_matches(upper(title), '{_PIECES}') and length(title) < 150 then 1 else 0 end as starts from s),
n as (select *, sum(starts) over (partition by doc_id order by i) as island from b),
g as (select doc_id, island, case when island = 0 then 'Documento Principal' else first(title order by i) end as title, trim(string_agg(line, chr(10) order by i)) as content from n group by doc_id, island)
select doc_id, cast(row_number() over (partition by doc_id order by island) - 1 as integer) as piece_no, title, content from g where content <> ''""",
    LEGAL,
)
def piece_islands(docs: DataFrame) -> DataFrame:
    return structure.pieces(docs)


def _re2(p: str) -> str:
    return p.replace("\\w", "[\\p{L}\\p{N}_]").replace("'", "''")


def _starts(patterns: list[str]) -> str:
    return _re2("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


_UP = "(length(regexp_replace({0}, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')), 0))"
_C, _T = structure.CAPITAL, structure.TITLE_CHARS
_ROMAN = f"(length(u) >= 4 and regexp_matches(u, '^[IVXLC]+ *[-–—.] *.{{2,}}$') and coalesce({_UP.format(chr(114))} >= 0.6, false))"
_BASE = ", u as (select doc_id, text, upper(text) as up, case when text like '**%**' then trim(text[3:-3]) else text end as u from src), x as (select *, regexp_replace(u, '^[IVXLC]+ *[-–—.] *', '') as r, regexp_replace(text, '^\\d+\\. *', '') as nr, regexp_extract(text, '^(\\d+(?:\\.\\d+)+)\\.?\\s+', 1) as num from u)"
_DEPTH = "repeat('#', least(cast(length(regexp_replace(num, '[^.]', '', 'g')) + 2 as integer), 6))"
_UPPER_TITLE = f"(regexp_matches(text, '^[IVXLC]+\\s*[-–—.]\\s+[{_C}][{_T}]{{2,}}$') and upper(text) = text)"
_NUM_TITLE = f"regexp_matches(text, '^\\d+\\.\\s+[{_C}][{_T}]{{2,}}$')"


def _head(name: str, mode: str, sql: str) -> None:
    query(name, f"{_BASE} select doc_id, {sql} as heading from x", LINES)(lambda docs: docs.select("doc_id", structure.mark_headings(F.col("text"), mode).alias("heading")))


_head(
    "heading_class_forense", "forense",
    f"""case when {_ROMAN} then '## ' || u
  when length(text) >= 5 and regexp_matches(text, '^\\d+\\. *\\p{{Lu}}.+$') and coalesce({_UP.format('nr')} >= 0.6, false) then '## ' || text
  when regexp_matches(up, '(?i){_starts(structure.PIECES_H1)}') then '# ' || text
  when regexp_matches(up, '(?i){_starts(structure.ADDRESSES)}') or regexp_matches(up, '(?i){_starts(structure.SECTIONS_H2)}') or {_UPPER_TITLE} then '## ' || text
  when length(text) < 100 and regexp_matches(text, '^[IVXLC]+\\.\\d+\\s*[-–—.]\\s+\\S') then '### ' || text
  when regexp_matches(text, '{_starts(structure.ENUMERATIONS)}') and not ({_NUM_TITLE} or (regexp_matches(text, '^[IVXLC]+\\s*[-–—.]\\s+[{_C}]') and upper(text) = text)) then text
  when {_NUM_TITLE} then '## ' || text
  when length(text) < 100 and num <> '' then {_DEPTH} || ' ' || text
  when length(text) < 100 and regexp_matches(text, '{_starts(structure.SUBSECTIONS_H3)}') then '### ' || text else text end""",
)
_VERBS = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(structure.BODY_VERBS) + ")($|[^\\p{L}\\p{N}_])"
_head(
    "heading_class_doutrina", "doutrina",
    f"""case when regexp_matches(up, '(?i){_starts(structure.BOOK_H1)}') then '# ' || text
  when regexp_matches(up, '(?i){_starts(structure.BOOK_H2)}') then case when length(text) > 120 or (coalesce({_UP.format('text')}, 1) < 0.5 and regexp_matches(text, '{_VERBS}')) then text else '## ' || text end
  when length(text) < 100 and num <> '' then {_DEPTH} || ' ' || text
  when regexp_matches(text, '^\\d+\\.\\d+\\.?\\s+') then case when length(text) > 200 then text else '### ' || text end else text end""",
)
_head(
    "heading_class_google", "google",
    f"""case when {_ROMAN} or regexp_matches(up, '(?i){_starts(structure.PIECES_H1)}') or regexp_matches(text, '(?i){_starts(structure.BOLD_STARTS)}') or regexp_matches(up, '(?i){_starts(structure.SECTIONS_H2)}')
  or {_UPPER_TITLE} or regexp_matches(text, '^\\d+\\.\\s+[A-ZÀ-Ú]')
  or (length(text) < 100 and (regexp_matches(text, '^\\d+\\.\\d+\\.?\\s+') or regexp_matches(text, '^[IVXLC]+\\.\\d+\\s*[-–—.]\\s+\\S') or regexp_matches(text, '{_starts(structure.SUBSECTIONS_H3)}'))) then '**' || text || '**' else text end""",
)


@query("heading_level_fix", """, g as (select doc_id, list(level order by line_no, level) as levels from src group by doc_id)
select doc_id, unnest(range(len(levels))) as pos, unnest(list_reduce(list_transform(levels, lambda x: [x]), lambda a, x: list_concat(a, [least(x[1], a[-1] + 1)]))) as level from g""",
    "select l_orderkey as doc_id, l_linenumber as line_no, cast(1 + (l_partkey + l_linenumber * 5) % 6 as int) as level from {lineitem}")
def heading_level_fix(rows: DataFrame) -> DataFrame:
    levels = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "level"))), lambda r: r["level"])
    fixed = rows.groupBy("doc_id").agg(headings.fixed_levels(levels).alias("levels"))
    return fixed.select("doc_id", F.posexplode("levels").alias("pos", "level")).withColumn("pos", F.col("pos").cast("long"))


@query("heading_gaps", """, g as (select doc_id, min(n) as lo, max(n) as hi, list(distinct n) as found from src group by doc_id),
r as (select doc_id, found, unnest(range(lo, hi + 1)) as missing from g)
select doc_id, missing from r where not list_contains(found, missing)""",
    "select o_custkey as doc_id, cast(1 + o_orderkey % 23 as int) as n from {orders}")
def heading_gaps(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("n")).alias("found"))
    return found.select("doc_id", F.explode(structure.missing_numbers(F.col("found"))).alias("missing")).withColumn("missing", F.col("missing").cast("long"))


def orphan_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = made(spark, sf_dir, "select o_custkey as doc_id, cast(o_orderkey % 50 as int) as num, o_orderpriority as content from {orders}")
    references = made(spark, sf_dir, "select l_suppkey as doc_id, cast(l_partkey % 50 as int) as num from {lineitem}")
    return strip.orphan_footnotes(definitions, references)


QUERIES["orphan_footnotes"] = orphan_footnotes
SQL["orphan_footnotes"] = """select o_custkey as doc_id, cast(o_orderkey % 50 as integer) as num, o_orderpriority as content from orders
where not exists (select 1 from lineitem where l_suppkey = o_custkey and l_partkey % 50 = o_orderkey % 50)"""

_CELLS = """select p_partkey as doc_id, case when p_partkey % 3 = 0 then p_brand else p_type end as a, p_brand as b, case when p_partkey % 4 = 0 then '' else p_name end as c,
  case when p_partkey % 3 = 0 then p_brand when p_partkey % 3 = 1 then '' else p_name end as d from {part}"""


def _rows() -> Column:
    second = F.array(F.lit("x"), F.lit("x"), F.when(F.col("doc_id") % 4 == 0, "").otherwise("y"), F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "").otherwise("z"))
    return F.array(F.array("a", "b", "c", "d"), second)


_ROWS_SQL = """, r as (select doc_id, [[a, b, c, d], ['x', 'x', case when doc_id % 4 = 0 then '' else 'y' end, case when doc_id % 3 = 0 then 'x' when doc_id % 3 = 1 then '' else 'z' end]] as t from src)"""


def _shown(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";")


@query("table_dedupe_columns", _ROWS_SQL + """, k as (select doc_id, t, list_filter([1, 2, 3, 4], lambda i: i = 1 or t[1][i] <> t[1][i - 1] or t[2][i] <> t[2][i - 1]) as k from r)
select doc_id, array_to_string(list_transform(t, lambda x: array_to_string(list_transform(k, lambda i: x[i]), '|')), ';') as cells from k""", _CELLS)
def table_dedupe_columns(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", _shown(tables.dedupe_columns(_rows())).alias("cells"))


@query("table_drop_empty", _ROWS_SQL + """, k as (select doc_id, t, list_filter([1, 2, 3, 4], lambda i: t[1][i] <> '' or t[2][i] <> '') as k from r)
select doc_id, array_to_string(list_transform(t, lambda x: array_to_string(list_transform(k, lambda i: x[i]), '|')), ';') as cells from k""", _CELLS)
def table_drop_empty(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", _shown(tables.drop_empty_columns(_rows())).alias("cells"))


BLOCKS = """select cast(l_orderkey % 97 as bigint) as doc_id, cast(l_partkey % 7 as int) as page_idx, cast(row_number() over (partition by l_orderkey % 97, l_partkey % 7 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as blk_idx, 0 as type,
  cast(l_partkey % 500 as double) as x0, cast((l_suppkey * 7 + l_linenumber * 90) % 760 as double) as y0, cast(l_partkey % 500 as double) + 60 + l_suppkey % 3 * 100 as x1, cast((l_suppkey * 7 + l_linenumber * 90) % 760 as double) + 20 as y1,
  case when l_orderkey % 11 = 0 then 'Página 3' else concat('bloco ', cast(l_partkey as string)) end as text from {lineitem}"""
PAGES = "select distinct cast(l_orderkey % 97 as bigint) as doc_id, cast(l_partkey % 7 as int) as page_idx, 612.0D as width, 792.0D as height from {lineitem}"
_DUCK_PAGES = duck(PAGES).replace("612.0D", "612.0::double").replace("792.0D", "792.0::double")


def _blocks(name: str, sql: str, body: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: body(made(spark, sf_dir, BLOCKS), made(spark, sf_dir, PAGES))
    SQL[name] = f"with b as ({duck(BLOCKS)}), p as ({_DUCK_PAGES}) {sql}"


_blocks(
    "header_footer_blocks",
    """, s as (select *, count(*) over (partition by doc_id) as total from p), z as (select b.*, height, total from b join s using (doc_id, page_idx) where total >= 3),
q as (select *, round_even(y0 / 5, 0) * 5 as y_key, y0 < height * 0.12 or y1 > height * 0.88 as zone from z),
k as (select doc_id, y_key from q where zone group by doc_id, y_key, total having count(distinct page_idx) >= total * 0.5)
select doc_id, page_idx, blk_idx from q where zone and exists (select 1 from k where k.doc_id = q.doc_id and k.y_key = q.y_key)
union select doc_id, page_idx, blk_idx from q where y1 > height * 0.85 and text = 'Página 3'""",
    layout.header_footer_blocks,
)
_TWO = """, n as (select doc_id, page_idx, count(*) as n, count(*) filter (where x1 <= width * 0.60 and x0 < width * 0.40) as l, count(*) filter (where x0 >= width * 0.40) as r, count(*) filter (where x0 < width * 0.40 and x1 > width * 0.60) as c
  from b join p using (doc_id, page_idx) group by doc_id, page_idx), t as (select doc_id, page_idx, n >= 4 and c <= n * 0.3 and l >= 2 and r >= 2 as two_columns from n)"""
_blocks("two_columns", _TWO + " select * from t", layout.two_columns)
_blocks(
    "reading_order",
    _TWO + """ select doc_id, page_idx, blk_idx, cast(row_number() over (partition by doc_id, page_idx order by case when two_columns and x0 >= width / 2 then 1 else 0 end, y0, case when two_columns then 0 else x0 end, blk_idx) - 1 as integer) as pos
from b join p using (doc_id, page_idx) join t using (doc_id, page_idx)""",
    lambda b, p: layout.reading_order(b, p).select("doc_id", "page_idx", "blk_idx", "pos"),
)


@query("page_list", """, s as (select doc_id, total, a, b, c from src),
u as (select doc_id, total, a as lo, a as hi from s union all select doc_id, total, b, c from s), e as (select doc_id, total, unnest(range(lo, hi + 1)) as page from u)
select distinct doc_id, cast(page - 1 as integer) as page from e where page <= total""",
    "select c_custkey as doc_id, cast(1 + c_custkey % 30 as int) as total, cast(1 + c_custkey % 9 as int) as a, cast(1 + c_custkey % 13 as int) as b, cast(1 + c_custkey % 13 + c_nationkey as int) as c from {customer}")
def page_list(rows: DataFrame) -> DataFrame:
    spec = F.concat(F.col("a").cast("string"), F.lit(", "), F.col("b").cast("string"), F.lit("-"), F.col("c").cast("string"))
    return rows.select("doc_id", F.explode(layout.page_list(spec, F.col("total"))).alias("page"))


@query("metadata_fields", """select doc_id, regexp_extract(text, 'Processo de origem nº ([0-9./-]+)', 1) as processo_origem, regexp_extract(text, 'Autor: ([^\\n]+)', 1) as autor, regexp_extract(text, 'Réu: ([^\\n]+)', 1) as reu, regexp_extract(text, 'Paciente: ([^\\n]+)', 1) as paciente,
  case when regexp_matches(text, 'HABEAS CORPUS') then 'Habeas Corpus' when regexp_matches(text, 'PETIÇÃO INICIAL') then 'Petição Inicial' when regexp_matches(text, 'CONTESTAÇÃO') then 'Contestação' when regexp_matches(text, 'SENTENÇA') then 'Sentença' end as tipo_peca,
  case when cast(regexp_extract(text, '([0-9]+) de março', 1) as integer) between 1 and 31 then regexp_extract(text, '[0-9]{1,2} de março de [0-9]{4}') else regexp_extract(text, '[0-9]{2}/[0-9]{2}/[0-9]{4}') end as data from src""", LEGAL)
def metadata_fields(docs: DataFrame) -> DataFrame:
    fields = dict(metadata.basic(F.col("text"), F.lit(""), F.lit(datetime.date(2024, 1, 1)), True))
    return docs.select("doc_id", *(fields[n].alias(n) for n in ("processo_origem", "autor", "reu", "paciente", "tipo_peca", "data")))


_STATS = """select doc_id, len(string_split(text, chr(10))) as lines, length(text) as chars, len(regexp_extract_all(text, '[^\\s]+')) as words, len(list_filter(string_split(text, chr(10)), lambda x: x[1] = '>')) as quotes,
  len(list_filter(string_split(text, chr(10)), lambda x: x[1] = '|')) as table_lines, len(regexp_extract_all(text, '\\*\\*[^*]+\\*\\*')) as bold, len(regexp_extract_all(text, '\\[.+?\\]\\(.+?\\)')) as links, len(regexp_extract_all(text, '!\\[.*?\\]\\(.+?\\)')) as images from src"""


@query("markdown_stats", _STATS, LEGAL + " union all select doc_id + 1000000, text from {documents}")
def markdown_stats(docs: DataFrame) -> DataFrame:
    names = ("lines", "chars", "words", "quotes", "table_lines", "bold", "links", "images")
    return docs.withColumn("s", light.count_elements(F.col("text"))).select("doc_id", *(F.col(f"s.{n}").cast("long").alias(n) for n in names))


@query("heading_counts", """, l as (select doc_id, unnest(string_split(text, chr(10))) as line from src), v as (select doc_id, length(regexp_extract(line, '^(#+)', 1)) as level from l)
select doc_id, level, count(*) as n from v where level between 1 and 6 group by all""", LEGAL)
def heading_counts(docs: DataFrame) -> DataFrame:
    return light.count_headings(docs).withColumn("level", F.col("level").cast("long"))


def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = made(spark, sf_dir, "select concat('p', cast(user_id % 40 as string)) as page_hash, event_type as lang, concat('t', cast(event_id as string)) as text, ts as created_at from {events}")
    pages = made(spark, sf_dir, "select distinct concat('p', cast(user_id % 60 as string)) as page_hash, event_type as lang from {events}")
    known, missing = layout.cached_pages(pages, layout.cache_put(cache.limit(0), cache))
    return known.select("page_hash", "lang", F.lit(True).alias("hit")).unionByName(missing.select("page_hash", "lang", F.lit(False).alias("hit")))


QUERIES["page_cache"] = page_cache
SQL["page_cache"] = """with c as (select distinct 'p' || (user_id % 40) as page_hash, event_type as lang from events), p as (select distinct 'p' || (user_id % 60) as page_hash, event_type as lang from events)
select p.page_hash, p.lang, c.page_hash is not null as hit from p left join c on p.page_hash = c.page_hash and p.lang = c.lang"""


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    joined = docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.sum("n_chars").alias("chars"))


QUERIES["corpus_rollup"] = corpus_rollup
SQL["corpus_rollup"] = "select lang, count(*) as n, count(quality) as labelled, count(*) filter (where quality = 1) as good, cast(sum(n_chars) as bigint) as chars from documents left join labels using (doc_id) group by lang"


@query("block_kinds", """select doc_id, case when regexp_matches(text, '^Art\\. [0-9]+') then '> [!QUOTE] Legislação' when regexp_matches(text, '^Súmula [0-9]+') then '> [!QUOTE] Súmula' when regexp_matches(text, '^Enunciado [0-9]+') then '> [!QUOTE] Enunciado'
  when regexp_matches(text, '^STJ REsp') then '> [!QUOTE] Jurisprudência' when regexp_matches(text, '\\(FGV/') then '> [!TIP] Questão de concurso' when regexp_matches(text, '^Atenção:') then '> [!WARNING] Atenção' when regexp_matches(text, '^Importante!') then '> [!IMPORTANT]'
  when regexp_matches(text, '^Obs\\.:') then '> [!NOTE]' when regexp_matches(text, 'consiste em') and length(text) < 400 then '> [!INFO] Definição' end as kind from src""",
    """select c_custkey as doc_id, concat(case c_custkey % 10 when 0 then 'Art. 5 ' when 1 then 'Súmula 7 ' when 2 then 'Enunciado 3 ' when 3 then 'STJ REsp ' when 4 then 'prova (FGV/2020) ' when 5 then 'Atenção: ' when 6 then 'Importante! ' when 7 then 'Obs.: ' when 8 then 'isto consiste em ' else 'prosa ' end, c_name) as text from {customer}""")  # fmt: skip
def block_kinds(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", enrich.classify_block(F.col("text")).alias("kind"))


@query("roman_numerals", """, d as (select doc_id, n, n // 100 as h, n // 10 % 10 as t, n % 10 as o from src)
select doc_id, repeat('C', h) || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][t + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][o + 1] as numeral, n as value from d""",
    "select p_partkey as doc_id, cast(1 + p_partkey % 399 as int) as n from {part}")
def roman_numerals(rows: DataFrame) -> DataFrame:
    named = rows.select("doc_id", scalars.int_to_roman(F.col("n")).alias("numeral"))
    return named.withColumn("value", scalars.roman_to_int(F.col("numeral")).cast("int"))


def _step(name: str, body: Callable[[Column], Column], sql: str | None, source: str = MESS) -> None:
    """A text operator over messy texts; ``sql``: a DuckDB expression of ``text``."""
    query(name, f"select doc_id, {sql} as text from src" if sql else None, source)(lambda docs: docs.select("doc_id", body(F.col("text")).alias("text")))


_r = lambda p, to, inner="text", flags="g": f"regexp_replace({inner}, '{p}', '{to}', '{flags}')"
_w = lambda keep: f"array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: {keep}), chr(10))"
_step("whitespace", cleaning.normalize_whitespace, _r("(?m)^[ \\t]+|[ \\t]+$", "", _r(" {2,}", " ", "replace(text, chr(9), chr(32))")))
_step("bullets", cleaning.normalize_bullets, _r("(?m)^[•◦▪►–]\\s+", "- "))
_step("residual_pagination", cleaning.remove_residual_pagination, _w("not regexp_matches(trim(x), '(?i)^(P[áa]gina\\s+\\d+|P[áa]g\\.\\s*\\d+|[-–—]\\s*\\d+\\s*[-–—])\\s*$') and not (regexp_matches(trim(x), '^\\d+$') and (i <= 3 or i > len(string_split(text, chr(10))) - 3))"))
_step("word_spacing", cleaning.fix_word_spacing, _r("([a-záéíóúàâêôãõç])([A-ZÁÉÍÓÚÀÂÊÔÃÕÇ][a-záéíóúàâêôãõç]{2,})", "\\1 \\2"))
_step("enum_spacing", cleaning.fix_enum_spacing, _r("(?m)^([ivxlc]+)\\)([^\\s])", "\\1) \\2", _r("(?m)^(\\d{1,2})\\)([^\\s])", "\\1) \\2", _r("(?m)^([a-z])\\)([^\\s])", "\\1) \\2"))))
_step("paragraphs", cleaning.normalize_paragraphs, _r("\\n{4,}", "\\n\\n\\n").replace("'\\n\\n\\n'", "chr(10) || chr(10) || chr(10)"))
_step("urls", strip.fix_urls, _r("\\bhttpwww([a-zA-Z])", "http://www.\\1", _r("\\bhttpswww\\.", "https://www.")))
_step("inline_marks", strip.strip_inline_marks, _r("\\[(.+?)\\]\\(.+?\\)", "\\1", _r("\\*(.+?)\\*", "\\1", _r("\\*\\*(.+?)\\*\\*", "\\1", _r("\\*\\*\\*(.+?)\\*\\*\\*", "\\1")))))
_step("yaml_stripped", strip.strip_yaml, "regexp_extract(text, '(?s)^---\\n.*?\\n---\\n(.*)$', 1)", "select c_custkey as doc_id, concat('---', chr(10), 'titulo: ', c_name, chr(10), '---', chr(10), 'corpo ', c_mktsegment, chr(10), '---') as text from {customer}")
_step("duplicate_numbering", headings.remove_duplicate_numbering, "regexp_extract(text, '^(## \\d+\\. )## \\d+\\. ', 1) || regexp_extract(text, '^## \\d+\\. ## \\d+\\. (.*)$', 1)", "select c_custkey as doc_id, concat('## ', cast(c_custkey as string), '. ## ', cast(c_custkey as string), '. ', c_name) as text from {customer}")
_step("slugs", scalars.slug, _r("\\s+", "-", _r("[^a-z0-9_\\s-]", "", "lower(text)")), "select p_partkey as doc_id, concat(p_name, ': ', p_brand, '!') as text from {part}")
_step("headings_rebuilt", paragraphs.rebuild_headings, None)
_step("quotes_detected", blocks.detect_quotes, None, LEGAL)
_step("heading_gaps_filled", blocks.fill_heading_gaps, None, LEGAL)
_step("front_matter_stripped", blocks.strip_front_matter, None, LEGAL)
_step("front_matter", lambda t: metadata.front_matter(t, F.lit("arquivo_1.txt"), F.lit(datetime.date(2024, 1, 1)), True, True), None, LEGAL)


def document_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` through the whole pipeline."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")
    return pipeline.convert(pipeline.spread(docs), Options(), datetime.date(2024, 1, 1)).select("doc_id", "filename", "success", "error", "markdown")


QUERIES["document_pipeline"] = document_pipeline
