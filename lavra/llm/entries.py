"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import decontam, langid, line_dedup, merkle, minhash, negatives, packing, pieces, quality, ranked, tokenbin, tokencount, warc
from lavra.llm.common import table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85, 100, 5)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), bpe_path())


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe_path(), 2048)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), bpe_path(), 512)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_fingerprints(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), piece_path())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(shifted, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_warc_archive": op3_warc_archive,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_fingerprints": op10_fingerprints,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_line_dedup": r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines, text is null as none from documents),
l as (select doc_id * 1000000 + i as ord, doc_id, i, lines[i] as line from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from docs where not none)),
u as (select ord, doc_id, i, line from l where replace(line, ' ', '') <> '' qualify row_number() over (partition by line order by ord) = 1),
w as (select ord, md5(line) as v from u),
d as (select ord, pos, md5(left(line, pos) || substr(line, pos + 2)) as v from (select ord, line, unnest(range(0, length(line))) as pos from u)),
near as (
  select ord from (select ord, min(ord) over (partition by pos, v) as m from d) where m < ord
  union select d.ord from d join w on d.v = w.v where w.ord < d.ord
  union select w.ord from d join w on d.v = w.v where d.ord < w.ord),
kept as (select ord from u where ord not in (select ord from near)),
stays as (select doc_id, i, line from l where replace(line, ' ', '') = '' or ord in (select ord from kept)),
joined as (select doc_id, count(*) as n, string_agg(line, chr(10) order by i) as t from stays group by doc_id)
select docs.doc_id, cast(case when none then 0 else len(lines) end as bigint) as n_lines, coalesce(n, 0) as n_kept, sha256(coalesce(t, '')) as text_sha256
from docs left join joined using (doc_id)
""",
    "op3_warc_archive": r"""
with p as (select page_id, coalesce(url, '') as url, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
r as (
  select *, max(page_id) over (partition by body) as response, chr(13) || chr(10) as nl,
         array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31 as bigint), 1)), '') as payload_digest
  from p),
x as (
  select *, page_id <> response as again,
         'WARC/1.1' || nl || 'WARC-Type: ' || case when page_id <> response then 'revisit' else 'response' end || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
         || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Payload-Digest: sha1:' || payload_digest || nl
         || case when page_id <> response then 'WARC-Refers-To: <urn:page:' || response || '>' || nl || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || nl else '' end
         || 'Content-Type: text/html; charset=utf-8' || nl || 'Content-Length: ' || case when page_id <> response then 0 else strlen(body) end || nl || nl as head
  from r)
select page_id, cast(strlen(body) as bigint) as payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type,
       case when again then response end as refers_to, sha256(head || case when again then '' else body end || nl || nl) as record_sha256
from x
""",
    "op10_fingerprints": r"""
with o as (
  select doc_id, coalesce(text, '') as t,
         coalesce(lead(coalesce(text, '')) over (order by doc_id desc), first_value(coalesce(text, '')) over (order by doc_id desc)) as nt
  from documents),
e as (select *, left(t, length(t) - length(t) // 3) || left(nt, length(t) // 3) as ed from o),
xs as (select doc_id, 0 as kind, t as s from e union all select doc_id, 1, ed from e union all select doc_id, 2, nt from e),
l as (select doc_id, kind, list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?: *[^ ]+){1,6} *| +'), lambda g: md5(g))) as leaves from xs),
q as (
  select doc_id, kind, list_filter(string_split(array_to_string(list_transform(leaves, lambda p:
           md5(coalesce(array_to_string(p, ''), '')) || '=' || coalesce(array_to_string(list_transform(p, lambda g: substr(g, 1, 6)), ''), '')
           || case when substr(md5(coalesce(array_to_string(p, ''), '')), 1, 1) in ('0', '1') then ';' else ',' end), ''), ';'), lambda s: s <> '') as sections
  from l),
f as (
  select doc_id, kind, list_transform(sections, lambda s: substr(md5(regexp_replace(s, '=[0-9a-f]*', '', 'g')), 1, 8) || ':' || regexp_replace(s, '[0-9a-f]{32}=', '', 'g')) as secs,
         sha256(array_to_string(list_transform(sections, lambda s: md5(regexp_replace(s, '=[0-9a-f]*', '', 'g'))), '')) as root
  from q),
g as (
  select doc_id, kind, root, list_distinct(secs) as secs, root || '|' || array_to_string(secs, ';') as fp,
         string_split(replace(regexp_replace(regexp_replace(array_to_string(secs, ';'), '[0-9a-f]{8}:', '', 'g'), ',$', ''), ';', ','), ',') as paras
  from f),
p as (
  select a.doc_id, b.kind, a.root = b.root as same, list_filter(a.secs, lambda s: list_contains(b.secs, s)) as both_,
         list_filter(a.secs, lambda s: not list_contains(b.secs, s)) as ra, list_filter(b.secs, lambda s: not list_contains(a.secs, s)) as rb,
         list_filter(range(greatest(len(a.paras), len(b.paras))), lambda i: a.paras[i + 1] is distinct from b.paras[i + 1])[1] as spot
  from g a join g b on a.doc_id = b.doc_id and a.kind = 0 and b.kind > 0),
v as (
  select doc_id, kind, same, spot, len(regexp_extract_all(regexp_replace(array_to_string(both_, ''), '[0-9a-f]{8}:', '', 'g'), '[0-9a-f]{6}')) as n,
         list_distinct(regexp_extract_all(regexp_replace(array_to_string(ra, ''), '[0-9a-f]{8}:', '', 'g'), '[0-9a-f]{6}')) as la,
         list_distinct(regexp_extract_all(regexp_replace(array_to_string(rb, ''), '[0-9a-f]{8}:', '', 'g'), '[0-9a-f]{6}')) as lb
  from p),
z as (select doc_id, kind, case when same then 1.0::double else 2.0::double * (n + len(list_intersect(la, lb))) / greatest(2 * n + len(la) + len(lb), 1) end as near, case when not same then cast(spot as int) end as spot from v)
select e.doc_id, cast(length(t) as bigint) as n_chars, sha256(ed) as edited_sha256, a.fp as fingerprint, b.fp as edited_fingerprint, y.near as near_edited, x.near as near_next, y.spot as first_edit
from e join g a on a.doc_id = e.doc_id and a.kind = 0 join g b on b.doc_id = e.doc_id and b.kind = 1
join z y on y.doc_id = e.doc_id and y.kind = 1 join z x on x.doc_id = e.doc_id and x.kind = 2
""",
    "op4_minhash_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 85 * (a.n + b.n - k)),
b as (select x, y from e union all select y, x from e),
r(x, y) as (select doc_id, doc_id from documents union select r.x, b.y from r join b on r.y = b.x),
m as (select x, min(y) as component_id from r group by x)
select documents.doc_id, coalesce(n, 0) as n_shingles, component_id, documents.doc_id = component_id as kept
from documents join m on m.x = documents.doc_id left join n on n.doc_id = documents.doc_id
""",
    "op9_decontamination": r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w,
         row_number() over () as r
  from documents),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item, least(13, len(w)) as m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as p
  from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
sizes as (select distinct m from windows),
places as (
  select r, m, i, array_to_string(w[i : i + m - 1], ' ') as p
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from words, sizes where len(w) >= m)),
found as (select r, item, places.m, i from places join windows on places.m = windows.m and places.p = windows.p),
hit as (select r, count(distinct x) as n_hit from (select r, unnest(range(i, i + m)) as x from found) group by r),
own as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from found group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from words left join hit using (r) left join own using (r)
""",
    "op12_ranked_search": r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
items as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from benchmark),
d as (select r, doc_id, cast(len(w) as bigint) as n from docs where len(w) > 0),
c as (select cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_words from d),
m as (select r, doc_id, 75 + (25 * n * n_docs) // n_words as m from d, c),
q as (select q, item_id, term, count(*) as times from (select q, item_id, unnest(w) as term from items) group by all),
t as (select r, term, count(*) as tf from (select r, unnest(w) as term from docs) where term in (select term from q) group by all),
f as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from t group by term), c),
s as (
  select q, item_id, doc_id, r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from q join t using (term) join f using (term) join m using (r) group by all),
o as (select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from o where rank <= 20
""",
    "op13_hard_negatives": r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (
  select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
         row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
""",
}
