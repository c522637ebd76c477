"""Token-id files in Simple-8b, a word-aligned code.

A file image holds whole documents: a header, the documents' ids and token counts, the blocks' word offsets, and the
words.  A word's highest four bits select how many ids of how many bits its other 60 bits hold; the selector ESCAPE
says that the next word is one id of more than 60 bits.  Blocks hold ``BLOCK`` ids, the last one fewer, and start at
known words, so blocks are decoded independently and all words of one selector at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.bpe import encoder, read_spec
from lavra.llm.common import new_folder

#: (ids, bits of each) by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 1024
MAGIC = b"LVS8"
#: Ids after which a file image is closed, at the end of a document.
SEGMENT = 2_000_000


def _wide(values: np.ndarray) -> np.ndarray:
    """How many of the selectors' widths are too small for each value."""
    out = np.zeros(values.size, np.uint8)
    for _, w in SELECTORS:
        out += values >> np.uint64(w) != 0
    return out


_SMALL = _wide(np.arange(1 << 16, dtype=np.uint64))


def _classes(values: np.ndarray) -> np.ndarray:
    return _SMALL[values] if int(values.max()) < _SMALL.size else _wide(values)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block starts."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-ids.size // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    wide = BLOCK + 60
    grid = np.zeros((blocks, wide), np.uint64)  # zeros behind each block fit any selector
    body = np.zeros(blocks * BLOCK, np.uint64)
    body[: ids.size] = ids
    grid[:, :BLOCK] = body.reshape(blocks, BLOCK)
    flat = grid.reshape(-1)
    bits = _classes(flat)
    sel = np.zeros(flat.size, np.uint8)
    longest: dict[int, np.ndarray] = {1: bits}

    def top(n: int) -> np.ndarray:
        """The greatest width class of each ``n`` ids that follow one another."""
        if n not in longest:
            half = n // 2
            a, b = top(n - half), top(half)
            out = a.copy()
            np.maximum(out[: -(n - half)], b[n - half :], out=out[: -(n - half)])
            longest[n] = out
        return longest[n]

    for k, (n, _) in enumerate(SELECTORS):  # what fits a selector fits all that follow it, so those that do not fit count up to the first that does
        sel += top(n) > k
    sel[sel == len(SELECTORS)] = ESCAPE
    step = np.array([n for n, _ in SELECTORS] + [1, 1], np.int64)
    cost = np.array([1] * ESCAPE + [2], np.int64)
    start = np.arange(blocks, dtype=np.int64) * wide
    end = start + np.minimum(BLOCK, ids.size - np.arange(blocks, dtype=np.int64) * BLOCK)
    at, live, n_words = start.copy(), np.arange(blocks), np.zeros(blocks, np.int64)
    found_at, found_block, found_word = [], [], []
    while live.size:
        here = at[live]
        found_at.append(here)
        found_block.append(live)
        found_word.append(n_words[live])
        kind = sel[here]
        n_words[live] += cost[kind]
        here = here + step[kind]
        at[live] = here
        live = live[here < end[live]]
    first = np.concatenate([[0], np.cumsum(n_words)])
    pos = np.concatenate(found_at)
    word = first[np.concatenate(found_block)] + np.concatenate(found_word)
    out = np.zeros(int(first[-1]), np.uint64)
    chosen = sel[pos]
    for k, (n, w) in enumerate(SELECTORS):
        m = np.flatnonzero(chosen == k)
        if m.size:
            p, value = pos[m], np.full(m.size, k << 60, np.uint64)
            for j in range(n):
                value |= flat[p + j] << np.uint64(j * w)
            out[word[m]] = value
    m = chosen == ESCAPE
    if m.any():
        out[word[m]] = np.uint64(ESCAPE << 60)
        out[word[m] + 1] = flat[pos[m]]
    return out, first.astype(np.uint32)


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` made words of."""
    if not n:
        return np.empty(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    esc = kind == ESCAPE
    raw = np.zeros(words.size, bool)
    if esc.any():  # a raw word may look like any selector; the chain of words tells which are raw
        i = 0
        for at in np.flatnonzero(esc):
            if at >= i:
                raw[at + 1] = True
                i = at + 2
    kind[raw] = ESCAPE - 1
    size = np.array([c for c, _ in SELECTORS] + [0, 1], np.int64)[kind]
    block = np.searchsorted(first[1:].astype(np.int64), np.arange(words.size), side="right")
    end = np.cumsum(size)
    before = end - size
    begin = before[first[:-1].astype(np.int64)]
    pos = before - begin[block]
    out = np.zeros((first.size - 1) * (BLOCK + 60), np.uint64)
    base = block * (BLOCK + 60) + pos
    for k, (c, w) in enumerate(SELECTORS):
        m = kind == k
        if m.any():
            v, b, mask = words[m], base[m], np.uint64((1 << w) - 1)
            for j in range(c):
                out[b + j] = (v >> np.uint64(j * w)) & mask
    m = np.flatnonzero(kind == ESCAPE)
    out[base[m]] = words[m + 1] if m.size else 0
    return out.reshape(-1, BLOCK + 60)[:, :BLOCK].reshape(-1)[:n]


def image(keys: list[int | None], arrays: list[np.ndarray]) -> bytes:
    """A file's bytes."""
    ids = np.concatenate(arrays) if arrays else np.empty(0, np.uint32)
    words, first = pack(ids)
    table = np.array([k if k is not None else 0 for k in keys], np.int64)
    null = np.array([k is None for k in keys], np.uint8)
    sizes = np.array([a.size for a in arrays], np.uint64)
    head = struct.pack("<4sIQQQ", MAGIC, BLOCK, len(keys), ids.size, words.size)
    return b"".join((head, table.tobytes(), null.tobytes(), sizes.tobytes(), first.tobytes(), words.tobytes()))


def open_image(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, token counts and all ids of a file's bytes."""
    magic, block, n, n_ids, n_words = struct.unpack_from("<4sIQQQ", data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token-id file of this format")
    at = struct.calcsize("<4sIQQQ")
    parts = []
    for kind, many in ((np.int64, n), (np.uint8, n), (np.uint64, n), (np.uint32, -(-n_ids // BLOCK) + 1), (np.uint64, n_words)):
        part = np.frombuffer(data, kind, many, at)
        at += part.nbytes
        parts.append(part)
    keys, null, sizes, first, words = parts
    return [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], sizes.astype(np.int64), unpack(words, first, n_ids).astype(np.uint32)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every text's ids and ``end_id`` to files in ascending order of ``id_col`` (nulls first).

    The only shuffle deals rows by ranges of the id and, among equal ids, of the row's place in the table, so neither
    a source nor an id is hot; a range's rows are sorted (Spark spills) and stream through the encoder.  The images are rows ``part, seg, n_docs, n_ids, image`` of a Parquet
    table, which any store takes.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg = TaskContext.get().partitionId(), 0
        enc = encoder(shipped.value)
        tail = np.array([end_id], np.uint32)
        keys: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            row = [[part], [seg], [len(keys)], [held], [image(keys, arrays)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seg", "n_docs", "n_ids", "image"])

        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                for key, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1)), strict=True):
                    keys.append(key)
                    arrays.append(np.concatenate([ids, tail]))
                    held += ids.size + 1
                    if held >= SEGMENT:
                        yield closed()
                        seg, held = seg + 1, 0
                        keys, arrays = [], []
        if keys:
            yield closed()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    files = slim.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text").mapInArrow(encode, "part int, seg int, n_docs long, n_ids long, image binary")
    files.write.option("compression", "zstd").parquet(folder)


def read_token_files(files: DataFrame) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` of the files, by their order.

    Images are decoded where they are read and never shuffled.  ``start`` adds up the files before: by part (a few
    thousand rows whatever the corpus) and within a part.
    """
    sizes = files.select("part", "seg", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seg")
    starts = sizes.select("part", "seg", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("seg_start")).join(before, "part")
    first = starts.select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("first"))
    out = "part int, seg int, doc_id long, start long, n_tokens long, ids_crc32 long"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seg, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                keys, sizes, ids = open_image(data.as_py())
                end = np.cumsum(sizes)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for e, s in zip(end.tolist(), sizes.tolist(), strict=True)]
                n = len(keys)
                columns = [pa.array([part] * n, pa.int32()), pa.array([seg] * n, pa.int32()), *(pa.array(x, pa.int64()) for x in (keys, end - sizes, sizes, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seg", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = files.select("part", "seg", "image").mapInArrow(decode, out).join(first, ["part", "seg"])
    return found.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes all ``docs`` to token files in the shared folder and returns what the files hold.

    Null text is empty (one id, the end), repeated rows are encoded each, an empty table gives no rows; null ids come
    first; ids that are equal stand in the order of the table; texts of any length are encoded whole.  Other columns of
    ``docs`` are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    write_token_files(docs, folder, path, end_id)
    return read_token_files(spark.read.schema("part int, seg int, n_docs long, n_ids long, image binary").parquet(folder))


