"""Packing of documents into sequences of a fixed number of tokens.

Pieces matter only by their length, so the packing is decided on the histogram of lengths, which has at most as many
entries as a sequence has tokens, whatever the corpus.  Martello and Toth's dominance reduction fixes sequences that
some best packing must hold; best fit decreasing packs what is left.  The decided layouts are then dealt out to the
pieces by their rank within a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.bpe import encoder, read_spec
from lavra.llm.common import materialized

#: A length's pieces are ranked within shares of about so many, so that no length makes one large task.
SHARE = 100_000

Layout = tuple[tuple[int, ...], int]


def reduce_by_dominance(counts: dict[int, int], size: int) -> tuple[list[Layout], dict[int, int]]:
    """Sequences that dominate all others holding their largest piece, and the counts that are left.

    For the largest piece ``a`` let ``b`` be the largest piece that fits beside it.
    No ``b``: ``a`` alone.  ``a + b`` full, or no two pieces fit beside ``a``: ``{a, b}`` dominates, as all that can
    stand in ``b``'s place is one piece no larger than ``b`` (or, if full, any set no larger in sum).
    Equal pieces are fixed at once: taking pieces away only enlarges the smallest two that are left.  Where no rule
    applies, the piece is kept for best fit and the next smaller one is tried.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    lengths = sorted(left)
    fixed: list[Layout] = []
    for a in reversed(lengths):
        while left[a]:
            room = size - a
            others = lambda s, a=a: left[s] - (s == a)  # noqa: E731  of the pieces but one of length a
            b = next((s for s in reversed(lengths[: bisect_left(lengths, room + 1)]) if others(s)), None)
            if b is None:
                fixed.append(((a,), left[a]))
                left[a] = 0
                break
            low = next(s for s in lengths if others(s))
            second = low if others(low) > 1 else next((s for s in lengths if s > low and others(s)), size)
            if b != room and low + second <= room:
                break
            n = left[a] // 2 if a == b else min(left[a], left[b])
            fixed.append(((a, b), n))
            left[a] -= n
            left[b] -= n
    return fixed, {s: n for s, n in left.items() if n}


def best_fit(counts: dict[int, int], size: int) -> list[Layout]:
    """Best fit decreasing over a histogram: equal pieces go into equally filled sequences at once."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, layout: tuple[int, ...], n: int) -> None:
        if room not in open_bins:
            open_bins[room] = {}
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room][layout] = open_bins[room].get(layout, 0) + n

    for s in sorted(counts, reverse=True):
        todo = counts[s]
        while todo:
            i = bisect_left(rooms, s)
            room = rooms[i] if i < len(rooms) else size
            if i == len(rooms):
                layout, n = (), -(-todo // (size // s))
            else:
                layout, n = next(iter(open_bins[room].items()))
            each = room // s
            bins = min(n, todo // each)
            if bins:
                fill, used = each, bins
            else:
                fill, used = todo, 1
            if i < len(rooms):
                if n == used:
                    del open_bins[room][layout]
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.pop(i)
                else:
                    open_bins[room][layout] = n - used
            put(room - fill * s, layout + (s,) * fill, used)
            todo -= fill * used
    return [x for room in rooms for x in open_bins[room].items()]


def plan(counts: dict[int, int], size: int) -> list[Layout]:
    """Layouts and how many sequences have each, for all pieces of a histogram."""
    fixed, left = reduce_by_dominance(counts, size)
    return fixed + best_fit(left, size)


def slots(layouts: list[Layout]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, number, first sequence, offset)``: where the pieces of a length go, by rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for layout, n in layouts:
        at = 0
        for s in layout:
            out.append((s, rank.get(s, 0), n, sequence, at))
            rank[s] = rank.get(s, 0) + n
            at += s
        sequence += n
    return out


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: one, or full ones behind a first that may be shorter."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows ``row_no, doc_id, piece, start, length, ids_crc32`` (and ``ids``) of the documents' pieces."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_spec(path))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(shipped.value), np.array([end_id], np.uint32)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                rows = []
                for key, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    ids = np.concatenate([ids, tail])
                    raw = memoryview(ids.astype("<u4")).cast("B")
                    rows += [(key, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), *([ids[s : s + n].tolist()] if with_ids else [])) for k, (s, n) in enumerate(cut(ids.size, size))]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenized, schema)


def pack_pieces(found: DataFrame, size: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces; ``found`` must be a table, as it is read more than once.

    Full pieces fill a sequence alone and get numbers below zero from a row number that needs no order; shorter ones
    are ranked by length within shares of about ``SHARE`` pieces, copies apart.  To the driver go a count for each length
    and share.
    """
    spark = found.sparkSession
    full = found.filter(F.col("length") == size).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = found.filter(F.col("length") != size)
    counts: dict[int, int] = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    many = {s: -(-n // SHARE) for s, n in counts.items() if n > SHARE}
    shares = F.coalesce(F.create_map(*(F.lit(x).cast("long") for item in sorted(many.items()) for x in item))[F.col("length")], F.lit(1).cast("long")) if many else F.lit(1)
    # the row's place, fixed as the table is written, also spreads equal rows
    short = short.withColumn("place", F.monotonically_increasing_id()).withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "place"), shares).cast("int"))
    held = short.groupBy("length", "share").agg(F.count("*").alias("n")).collect()
    first_rank: list[tuple[int, int, int]] = []
    ranks: dict[int, int] = {}
    for r in sorted(held):
        first_rank.append((r["length"], r["share"], ranks.get(r["length"], 0)))
        ranks[r["length"]] = ranks.get(r["length"], 0) + r["n"]
    if not counts:
        return full
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *where in slots(plan(counts, size)):
        places.setdefault(length, []).append(tuple(where))
    base: dict[int, dict[int, int]] = {}
    for length, share, rank in first_rank:
        base.setdefault(length, {})[share] = rank
    shipped = spark.sparkContext.broadcast((base, {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in places.items()}))
    local = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "place")
    ranked = short.withColumn("rank", F.row_number().over(local).cast("long") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, share, rank):
        import pandas as pd

        base, where = shipped.value
        n, s, r = length.to_numpy(), share.to_numpy(), rank.to_numpy().copy()
        sequence, offset = np.zeros(n.size, np.int64), np.zeros(n.size, np.int64)
        order = np.argsort(n, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
            if some.size:
                own = base[int(n[some[0]])]
                rank_of = r[some] + np.array([own[x] for x in s[some].tolist()], np.int64)
                first, _, begin, at = where[int(n[some[0]])]
                k = np.searchsorted(first, rank_of, side="right") - 1
                sequence[some], offset[some] = begin[k] + rank_of - first[k], at[k]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", "share", "rank")).select(*found.columns, "at.sequence_id", "at.offset")
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all ``docs`` into sequences of at most ``size`` tokens, as few as the method finds.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.  Null text is empty (one id,
    the end); repeated rows and null ids are packed each; only documents of more than ``size`` tokens are cut, whatever
    their length; an empty table gives no rows; other columns are not read, so their names cannot clash.
    """
    return pack_pieces(materialized(pieces(docs, path, size, end_id, id_col, text_col, with_ids), "pieces"), size)
