"""Ranked lexical search by Fagin's threshold algorithm over an index that Spark writes.

One pass over the texts writes a forward index: each document's length and its counts of the terms that some query holds.
Statistics of the whole corpus (documents, terms, documents that hold a term) are aggregates over it.  A second job reads
the index segment by segment (some documents each): it sorts a segment's postings by impact, walks a query's lists in
turns to growing depths, looks every new document up in the forward index for its whole score, and stops as soon as the
threshold (what an unseen document could score at most) falls strictly below the k-th score.  A segment's k best meet
those of the others in one window.  No pair of query and document leaves a task but these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.common import materialized

#: What a term's characters become: blanks apart from digits, letters (in lower case) and all beyond ASCII.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of query text that one pass over the index serves, and that are broadcast.
BLOCK_BYTES = 16 << 20
#: Documents of a segment, postings of a segment (whichever is reached first), characters of a text tokenised at once.
SEGMENT, POSTINGS, WINDOW = 65_536, 8_000_000, 4_000_000
#: Postings of each list that the first turn reads; each turn reads twice as many.
FIRST_TURN = 32
#: Fixed values of the score.
SCALE, SATURATION, LENGTH_SHARE = 1_000_000_000, 12, 25


def terms_of(text: str | None, size: int = WINDOW) -> Iterator[list[bytes]]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z, as UTF-8, a bounded number at once."""
    rest = b""
    text = text or ""
    for at in range(0, len(text), size):
        part = rest + text[at : at + size].encode("utf-8", "replace").translate(_FOLD)
        found = part.split()
        # a term that goes on in the next window waits for it
        rest = found.pop() if at + size < len(text) and found and part[-1:] != b" " else b""
        yield found
    if rest:
        yield [rest]


def query_blocks(queries: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """Queries with the repeats of their terms, in lists of about ``limit`` bytes of text.  A query is never cut."""
    held, room = [], limit
    for item, text in queries.select(F.col(id_col), F.col(text_col)).filter(F.length(text_col) > 0).toLocalIterator(prefetchPartitions=True):
        own: dict[bytes, int] = {}
        for words in terms_of(text):
            for w in words:
                own[w] = own.get(w, 0) + 1
        if own:
            held.append((item, own))
        room -= len(text)
        if room <= 0:
            yield held
            held, room = [], limit
    if held:
        yield held


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` of each document with a term: its length in terms, and how often it holds each query term."""
    shipped, size = docs.sparkSession.sparkContext.broadcast(vocabulary), WINDOW

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value.get
        for b in batches:
            n, terms, tfs = [], [], []
            for text in b.column(1):
                total, numbers = 0, []
                for words in terms_of(text.as_py(), size):
                    total += len(words)
                    ids = np.fromiter(map(known, words, repeat(-1)), np.int32, len(words))
                    numbers.append(ids[ids >= 0])
                own, count = np.unique(np.concatenate(numbers) if numbers else np.zeros(0, np.int32), return_counts=True)
                n.append(total)
                terms.append(own)
                tfs.append(count.astype(np.int64))
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    return slim.mapInArrow(index, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


class Segment:
    """Some documents' postings: a forward index by document, and each term's list by falling impact."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int, n_docs: int, n_words: int) -> None:
        self.ends, self.terms = ends, terms
        share = (LENGTH_SHARE * n * n_docs) // n_words if LENGTH_SHARE * int(n.max(initial=0)) * n_docs < 1 << 63 else np.array([LENGTH_SHARE * int(x) * n_docs // n_words for x in n], np.int64)
        doc = np.repeat(np.arange(n.size), np.diff(ends))
        self.impact = (SCALE * tfs) // (1000 * tfs + SATURATION * (100 - LENGTH_SHARE + share)[doc])
        order = np.lexsort((-self.impact, terms))
        self.doc, self.falling = doc[order], self.impact[order]
        self.lists = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=n_terms))])

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by lookups in the forward index; ``weight`` has one number per term."""
        start, size = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        end = np.cumsum(size)
        at = np.arange(end[-1] if end.size else 0) + np.repeat(start - (end - size), size)
        upto = np.concatenate([[0], np.cumsum(weight[self.terms[at]] * self.impact[at])])
        return upto[end] - upto[end - size]

    def top(self, terms: np.ndarray, weights: np.ndarray, weight: np.ndarray, k: int, least: int, turn: int = FIRST_TURN) -> tuple[np.ndarray, np.ndarray, int]:
        """The documents that can be among the ``k`` best, their scores, and how many were looked up.

        ``least``: a k-th score reached elsewhere; what scores less is left out.
        """
        start, stop = self.lists[terms], self.lists[terms + 1]
        alive = (stop > start) & (weights > 0)
        start, stop, weights = start[alive], stop[alive], weights[alive]
        seen = np.zeros(self.ends.size - 1, bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = 0
        while start.size:
            spans = [self.doc[s + depth : min(s + depth + turn, e)] for s, e in zip(start.tolist(), stop.tolist(), strict=True) if s + depth < e]
            new = np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)
            new = new[~seen[new]]
            seen[new] = True
            got = self.scores(new, weight)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, got])
            if docs.size > 4 * k:  # ties at the k-th score stay
                stays = scores >= np.partition(scores, -k)[-k]
                docs, scores = docs[stays], scores[stays]
            depth, turn = depth + turn, 2 * turn
            unread = start + depth < stop
            if not unread.any():
                break
            threshold = int((weights[unread] * self.falling[(start + depth)[unread]]).sum())
            kth = max(least, int(np.partition(scores, -k)[-k])) if scores.size >= k else least
            if threshold < kth:
                break
        good = scores > 0
        return docs[good], scores[good], int(seen.sum())


def _best(k: int, ids: list, scores: list) -> tuple[list, list]:
    """The first ``k`` by falling score, then rising id; a missing id stands first."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i] is not None, ids[i] if ids[i] is not None else 0))[:k]
    return [ids[i] for i in order], [scores[i] for i in order]


def _searched(index: DataFrame, queries: list[dict[bytes, int]], vocabulary: dict[bytes, int], weight: np.ndarray, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``query, doc_id, score``: of each task's documents the ``k`` best of each query."""
    numbered = [(np.array([vocabulary[w] for w in own], np.int64), np.array(list(own.values()), np.int64)) for own in queries]
    shipped = index.sparkSession.sparkContext.broadcast((numbered, weight))
    most_docs, most_postings, turn = SEGMENT, POSTINGS, FIRST_TURN

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, weight = shipped.value
        kept: list[tuple[list, list]] = [([], []) for _ in numbered]
        held: list[pa.RecordBatch] = []
        dense = np.zeros(weight.size, np.int64)

        def walk() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = t.column("doc_id").to_pylist()
            terms, tfs = (t.column(c).combine_chunks() for c in ("terms", "tfs"))
            ends = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, tfs)]
            seg = Segment(t.column("n").to_numpy(), ends, *flat, weight.size, n_docs, n_words)
            for q, (own, times) in enumerate(numbered):
                dense[own] = weights = weight[own] * times
                best, points = kept[q]
                docs, scores, _ = seg.top(own, weights, dense, k, points[-1] if len(points) >= k else 0, turn)
                dense[own] = 0
                if docs.size > k:
                    stays = scores >= np.partition(scores, -k)[-k]
                    docs, scores = docs[stays], scores[stays]
                kept[q] = _best(k, best + [ids[i] for i in docs.tolist()], points + scores.tolist())

        size = docs = 0
        step = min(4096, most_docs)
        for b in batches:
            for at in range(0, b.num_rows, step):
                held.append(b.slice(at, step))
                docs += held[-1].num_rows
                size += len(held[-1].column("terms").flatten())
                if docs >= most_docs or size >= most_postings:
                    walk()
                    size = docs = 0
        if held:
            walk()
        q = np.repeat(np.arange(len(kept)), [len(ids) for ids, _ in kept])
        rows = [pa.array(q, pa.int32()), pa.array([i for ids, _ in kept for i in ids], id_type), pa.array([s for _, own in kept for s in own], pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["query", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(index.schema["doc_id"].dataType)
    return index.mapInArrow(search, f"query int, doc_id {index.schema['doc_id'].dataType.simpleString()}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", limit: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each query, equal scores by rising id.

    Queries of more than ``limit`` bytes take several passes.  Null and empty texts hold no terms; each row of
    ``queries`` is a query of its own, and one without terms, or whose terms no document holds, has no rows; repeated rows of
    ``docs`` each take a rank, a missing id before others; texts of any length are read whole, in windows; empty
    tables give no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    item, kind = queries.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {item}, rank int, doc_id {kind}, score long")
    for block in query_blocks(queries, item_col, text_col, limit):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, own in block for w in own))}
        index = materialized(forward_index(docs, vocabulary, id_col, text_col), "index")
        n_docs, n_words = index.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the vocabulary
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        rows = _searched(index, [own for _, own in block], vocabulary, weight, n_docs, n_words, k)
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        ranked = rows.withColumn("rank", best).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {item}")
        found = found.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return found
