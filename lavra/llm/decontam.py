"""Benchmark contamination by Wu and Manber's search for many patterns, over words.

A pattern is a window of ``size`` benchmark words (a shorter item is one pattern).  Patterns of one length share a
shift table over blocks of two words: the search looks at the block that ends a window of the text and skips as far
as no pattern can hold that block there; only a shift of zero opens the bucket of patterns that end in the block, and
word by word comparison confirms.  Words are numbers of the benchmark's vocabulary, and patterns places in its text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.common import aside, kept, let_go, materialized, row_key

_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
#: Bytes of benchmark text whose tables a worker holds at once (and that are broadcast); a larger benchmark is searched in several passes.
BLOCK_BYTES = 4 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Searcher:
    """Tables for the patterns of some items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.text: list[int] = []
        ends: dict[int, list[tuple[int, str | None]]] = {}
        for item, words in items:
            first = len(self.text)
            self.text += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            m = min(size, len(words))
            if m:
                ends.setdefault(m, []).extend((e, item) for e in range(first + m, len(self.text) + 1))
        self.base = len(self.vocabulary) + 1
        self.tables = [(m, *self._table(m, e)) for m, e in sorted(ends.items())]

    def _key(self, words: list[int]) -> int:
        """One number of one or two words."""
        return words[0] if len(words) == 1 else words[0] * self.base + words[1]

    def _table(self, m: int, ends: list[tuple[int, str | None]]) -> tuple[int, dict[int, int], dict[int, list[tuple[int, tuple[str | None, ...]]]]]:
        text, block = self.text, min(2, m)
        shift: dict[int, int] = {}
        bucket: dict[int, list] = {}
        for e, item in ends:
            for back in range(m - block + 1):
                key = self._key(text[e - back - block : e - back])
                if back < shift.get(key, m):
                    shift[key] = back
            bucket.setdefault(self._key(text[e - block : e]), []).append((e, item))
        for key, found in bucket.items():  # equal patterns once, with all their items
            own: dict[tuple[int, ...], list] = {}
            for e, item in found:
                own.setdefault(tuple(text[e - m : e]), [e, set()])[1].add(item)
            bucket[key] = [(e, tuple(items)) for e, items in own.values()]
        return block, shift, bucket

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans ``[start, end)`` of words inside occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        n, base, text = len(words), self.base, self.text
        known = self.vocabulary.get
        ids = [known(w, -1) for w in words]
        for m, block, shift, bucket in self.tables:
            end, free = m, m - block + 1
            get = shift.get
            while end <= n:
                last = ids[end - 1]
                if last < 0:  # no pattern holds this word
                    end += m
                    continue
                if block == 2:
                    before = ids[end - 2]
                    key = before * base + last if before >= 0 else -1
                else:
                    key = last
                skip = get(key, free)
                if skip:
                    end += skip
                    continue
                for e, own in bucket[key]:
                    if text[e - m : e] == ids[end - m : end]:
                        spans.append((end - m, end))
                        items.update(own)
                end += 1
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_DDL = "array<struct<start:bigint,end:bigint>>"


def _pieces(benchmark: DataFrame, id_col: str, text_col: str, size: int, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark's items in lists of about ``limit`` bytes of words each.

    An item longer than that is cut into pieces that share ``size - 1`` words, so that each window is whole in one of them.
    The driver holds one list, and the item that it comes from, at a time.
    """
    slim = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    held: list[tuple[str | None, list[bytes]]] = []
    room = limit
    for r in slim.toLocalIterator():
        words = words_of(r["text"])
        at = 0
        while words and (at == 0 or at + size - 1 < len(words)):
            end = at
            while end < len(words) and (room > 0 or end - at < size):
                room -= len(words[end]) + 1
                end += 1
            held.append((r["item_id"], words[at:end]))
            at = end - size + 1 if end < len(words) else len(words)
            if room <= 0:
                yield held
                held, room = [], limit
    if held:
        yield held


_SEARCHERS: dict[str, Searcher] = kept()


def _searcher(key: str, shipped, size: int) -> Searcher:
    """This worker's tables for a broadcast list of items; tasks that follow use them again."""
    let_go(_SEARCHERS)
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(shipped.value, size)
    return _SEARCHERS[key]


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, limit: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``n_words``, ``spans`` (words inside occurrences) and ``items`` (their item ids as sorted strings).

    A benchmark of at most ``limit`` bytes takes one narrow pass over ``docs``.  For a larger one each list of items takes
    a pass that writes only the rows it hits, without their texts; these are united by id and text hash and joined to
    ``docs``.  Items without an id are searched too and only missing from ``items``; null texts hold no words, equal items
    all count.
    """
    spark = docs.sparkSession
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in carry)]
    bare = docs.select(*columns, F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(_SPANS_DDL).alias("spans"), F.lit(None).cast("array<string>").alias("items"))

    def searched(shipped, only_hits: bool):
        key = uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(key, shipped, size)
            for b in batches:
                n_words, spans, items, hit = [], [], [], []
                for text in b.column("text"):
                    words = words_of(text.as_py())
                    got, own = searcher.search(words)
                    n_words.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in got])
                    items.append(sorted(own - {None}))
                    hit.append(bool(got))
                new = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
                names = [c for c in b.schema.names if c != "text" or not only_hits]
                out = pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)
                yield out.filter(pa.array(hit, pa.bool_())) if only_hits else out

        return search

    lists = _pieces(benchmark, "item_id", "text", size, limit)
    first, second = next(lists, []), next(lists, None)
    if second is None:
        return bare.mapInArrow(searched(spark.sparkContext.broadcast(first), False), bare.schema)
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    slim = keyed.select("ord", "tie", "text", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(_SPANS_DDL).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    kind = slim.drop("text").schema
    found = None
    for part in _chain(first, second, lists):
        shipped = spark.sparkContext.broadcast(part)
        one = materialized(slim.mapInArrow(searched(shipped, True), kind), "hits").dropDuplicates(["ord", "tie"])
        shipped.unpersist()
        found = one if found is None else found.unionByName(one)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [merged([(x["start"], x["end"]) for part in row for x in part]) for row in b.column(2).to_pylist()]
            items = [sorted({x for part in row for x in part}) for row in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"start": s, "end": e} for s, e in row] for row in spans], _SPANS), pa.array(items, pa.list_(pa.string()))], ["_ord", "_tie", "spans", "items"])

    # at most one row a list for each key
    of_key = found.groupBy("ord", "tie").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    of_key = of_key.mapInArrow(united, f"_ord long, _tie struct<a:long,b:long>, spans {_SPANS_DDL}, items array<string>")
    counted = bare.drop("spans", "items").mapInArrow(_counted, bare.drop("spans", "items").schema)
    key = [c.alias(n) for c, n in zip(row_key("doc_id", "text"), ("_ord", "_tie"), strict=True)]
    joined = counted.select("*", *key).join(of_key, ["_ord", "_tie"], "left").drop("_ord", "_tie")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(kind[c].dataType)) for c in ("spans", "items")})


def _chain(first: list, second: list, rest: Iterator[list]) -> Iterator[list]:
    yield first
    yield second
    yield from rest


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pa.array([len(words_of(t.as_py())) for t in b.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([n if c == "n_words" else b.column(c) for c in b.schema.names], b.schema.names)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per row of ``docs``.

    ``contaminated``: some word is hit, and at least one in ``share`` words is.  Null and empty texts have no words and
    are clean; repeated rows are judged each; whole texts are searched, whatever their length; an empty benchmark hits
    nothing; an empty table gives no rows.  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    found = hits(docs, benchmark, size, limit)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (
        found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever these are named and however that is spelled.

    Rows without text or id are judged like all others, repeated rows each; an empty table stays empty.
    """
    apart, own = aside(docs)
    found = hits(apart, benchmark, size, limit, carry=tuple(c for c in apart.columns if c not in ("doc_id", "text")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    good = found.filter((n_hit == 0) | (share * n_hit < F.col("n_words")))
    return good.select(*own(good))


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
