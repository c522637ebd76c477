"""Hard negatives by distributed radix selection.

Every anchor and positive has a window of scores; wanted are the window's first rows by falling score, then rising id.  A
pass over all rows counts, window by window, how many scores fall into each bucket of the highest digit below the window's
upper end; the bucket that holds the last wanted row is opened and the next digit counted, until the rows up to it are
few, or scores are single and rows of equal score are told apart by the digits of their ids.  Only then are rows gathered, and only
those that qualify.  Positives are found in the same way, in a window of all scores.

Anchors are met by all rows in blocks: a block's vectors are broadcast, and a task multiplies them with its own rows.
What tasks return is bounded: of each window the buckets up to the last wanted row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.common import drop_folder, materialized, new_folder, real_id

#: Anchors of a block, and so the bound of what is broadcast (its vectors) and collected (a few numbers per window).
BLOCK = 1024
#: Bits of a digit; scores of windows times rows that are held at once; rows beyond the wanted ones that need no further digit.
DIGIT, CELLS, SLACK = 10, 1 << 22, 30
FAR = (1 << 62) - 1


@dataclass
class Windows:
    """Windows of a block: whose scores, from where to where, and how far the search is.

    ``at``: lower end of the open bucket, as distance from the upper end; ``shift``: bits of that bucket; ``need``: wanted
    rows in it.  ``tie``: whether the bucket is one score and the digits are those of ids above ``tie_at``.
    """

    anchor: np.ndarray
    high: np.ndarray
    low: np.ndarray
    same: bool
    k: int
    least_id: int
    digit: int = DIGIT
    at: np.ndarray = field(init=False)
    shift: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)
    tie: np.ndarray = field(init=False)
    tie_at: np.ndarray = field(init=False)
    done: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = self.anchor.size
        self.at, self.tie_at = np.zeros(n, np.int64), np.full(n, self.least_id, np.int64)
        self.shift = np.array([int(h - lo).bit_length() if h >= lo else 0 for h, lo in zip(self.high.tolist(), self.low.tolist(), strict=True)], np.int64)
        self.need, self.tie, self.done = np.full(n, self.k, np.int64), np.zeros(n, bool), self.high < self.low

    def next_shift(self) -> np.ndarray:
        return np.maximum(self.shift - self.digit, 0)


def prepared(rows: DataFrame, anchors: Column, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``ord, label, v, anchor``: rows that take part, with whole numbers for components; a missing id becomes the least."""
    x = F.col(vector_col)
    fine = F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(scale * c.cast("double")).cast("long"))
    ord_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    return rows.filter(fine).select(ord_.alias("ord"), F.col(label_col).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))


class Block:
    """Vectors of some anchors, by length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]) -> None:
        self.ids, self.labels = ids, labels
        sizes = np.array([v.size for v in vectors], np.int64)
        self.parts = {int(d): (np.flatnonzero(sizes == d), np.stack([vectors[i] for i in np.flatnonzero(sizes == d)])) for d in np.unique(sizes)}

    def scores(self, batch: pa.RecordBatch, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``anchors, scores (anchors x rows), ids, labels`` for a batch's rows, some at a time; vectors of other lengths have no score."""
        v = batch.column("v")
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "label"))
        for d, (own, a) in self.parts.items():
            fits = np.flatnonzero(sizes == d)
            for at in range(0, fits.size, step):
                i = fits[at : at + step]
                x = flat[ends[i][:, None] + np.arange(d)]
                yield own, _product(a, x), ids[i], labels[i]


def _product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in 64-bit integers; by floating point where that is exact."""
    size = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if size < 2.0**52 else a @ x.T


def _meeting(block: Block, w: Windows, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``window, distance, id, score`` of a batch's rows that lie in windows, as flat arrays, a bounded number at once."""
    place = np.full(block.ids.size, -1, np.int64)
    step = max(CELLS // max(w.anchor.size, 1), 16)
    for own, s, ids, labels in block.scores(batch, step):
        place[:] = -1
        place[own] = np.arange(own.size)
        win = np.flatnonzero(place[w.anchor] >= 0)
        if not win.size:
            continue
        a = w.anchor[win]
        score = s[place[a]]
        same = block.labels[a][:, None] == labels[None, :]
        fits = (score <= w.high[win][:, None]) & (score >= w.low[win][:, None])
        fits &= same & (block.ids[a][:, None] != ids[None, :]) if w.same else ~same
        i, j = np.nonzero(fits)
        at = score[i, j]
        yield win[i], w.high[win[i]] - at, ids[j], at


def _digits(block: Block, w: Windows, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window, digit, n`` of a batch's rows in the open buckets."""
    counts = np.zeros(w.anchor.size << w.digit, np.int64)
    below = w.next_shift()
    for win, away, ids, _ in _meeting(block, w, batch):
        key = np.where(w.tie[win], ids - w.tie_at[win], away - w.at[win])
        open_ = ~w.done[win] & np.where(w.tie[win], away == w.at[win], True) & (key >= 0) & ((key >> w.shift[win]) == 0)
        counts += np.bincount((win[open_] << w.digit) + (key[open_] >> below[win[open_]]), minlength=counts.size)
    at = np.flatnonzero(counts)
    return at >> w.digit, at & ((1 << w.digit) - 1), counts[at]


def _first_buckets(win: np.ndarray, digit: np.ndarray, n: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Which of the sorted ``(window, digit, n)`` come before ``need`` rows of the window are reached: no later one can hold the last."""
    before = np.cumsum(n) - n
    first = np.searchsorted(win, win)
    return before - before[first] < need[win]


def _histogram(rows: DataFrame, shipped, w: Windows) -> list[tuple[int, int, int, int]]:
    """Of each open window ``window, digit, before, n``: the bucket with the last wanted row (or the last one), and rows before it."""
    state = rows.sparkSession.sparkContext.broadcast(w)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = shipped.value, state.value
        total = np.zeros(w.anchor.size << w.digit, np.int64)
        for b in batches:
            win, digit, n = _digits(block, w, b)
            total[(win << w.digit) + digit] += n
        at = np.flatnonzero(total)
        win, digit, n = at >> w.digit, at & ((1 << w.digit) - 1), total[at]
        stays = _first_buckets(win, digit, n, w.need) if at.size else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(x[stays]) for x in (win, digit, n)], ["window", "digit", "n"])

    sums = rows.mapInArrow(count, "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("window").orderBy("digit")
    need = rows.sparkSession.createDataFrame(list(enumerate(w.need.tolist())), "window long, need long")
    upto = sums.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(need), "window")
    last = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("digit")))
    found = upto.filter(F.col("upto") - F.col("n") < F.col("need")).withColumn("last", last).filter("last = 1")
    return [tuple(r) for r in found.select("window", "digit", F.col("upto") - F.col("n"), "n").collect()]  # one row a window


def _refine(rows: DataFrame, shipped, w: Windows, id_bits: int) -> None:
    """Digit by digit, until each window's bucket holds few rows beyond the wanted ones."""
    while not w.done.all():
        found = {r[0]: r[1:] for r in _histogram(rows, shipped, w)}
        below = w.next_shift()
        for i in np.flatnonzero(~w.done).tolist():
            if i not in found:  # no row in the window
                w.done[i], w.at[i], w.shift[i] = True, -1, 0
                continue
            digit, before, n = found[i]
            low = digit << int(below[i])
            if w.tie[i]:
                w.tie_at[i] += low
            else:
                w.at[i] += low
            w.shift[i], w.need[i] = below[i], w.need[i] - before
            if n <= w.need[i] + SLACK or (w.tie[i] and below[i] == 0):
                w.done[i] = True
            elif below[i] == 0:
                w.tie[i], w.shift[i] = True, id_bits


def _gather(rows: DataFrame, shipped, w: Windows) -> DataFrame:
    """``window, rank, ord, score``: each window's first ``k`` rows; tasks return those up to its last bucket, ``k`` at most."""
    state = rows.sparkSession.sparkContext.broadcast(w)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = shipped.value, state.value
        kept = [np.zeros(0, np.int64)] * 3
        end = np.where(w.tie, w.at, w.at + (np.int64(1) << w.shift) - 1)
        tie_end = np.where(w.tie, w.tie_at + ((np.int64(1) << w.shift) - 1), FAR)

        def first(win: np.ndarray, ids: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
            order = np.lexsort((ids, -score, win))
            win, ids, score = win[order], ids[order], score[order]
            stays = np.arange(win.size) - np.searchsorted(win, win) < w.k
            return [win[stays], ids[stays], score[stays]]

        for b in batches:
            for win, away, ids, score in _meeting(block, w, b):
                fits = (away < end[win]) | ((away == end[win]) & (~w.tie[win] | (ids <= tie_end[win])))
                kept = first(*(np.concatenate([x, y[fits]]) for x, y in zip(kept, (win, ids, score), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], ["window", "ord", "score"])

    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "ord"))
    return rows.mapInArrow(take, "window long, ord long, score long").withColumn("rank", rank).filter(F.col("rank") <= w.k).select("window", "rank", "ord", "score")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = BLOCK, **columns: str) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For each row that ``anchors`` selects and each of its first ``positives`` rows of the same label (another id; by falling
    inner product, then rising id), the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of
    the positive's.  Rows with a null label, a null vector, or a null or non-finite component take no part; equal rows are
    one anchor, but candidates each; a missing id is the least; vectors of other lengths than the anchor's have no score;
    arithmetic is in 64 bits; an empty table gives no rows.  Other columns are not read, so their names cannot clash.
    """
    spark = rows.sparkSession
    ready = prepared(rows, anchors, **columns)
    slim = ready.select("ord", "label", "v")
    folder = new_folder(spark, "anchors")
    own = ready.filter("anchor").groupBy("ord", "label", "v").agg(F.count("*").alias("times"))
    own = materialized(own, "anchors", f"{folder}/all")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    n, longest = own.agg(F.count("*"), F.max(norm)).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    widest, least, last = slim.agg(F.max(norm), F.min("ord"), F.max("ord")).first()
    reach = min(int(longest * widest) + 1, FAR // 2)
    least, id_bits = (least, (last - least).bit_length()) if last - least < 1 << 62 else (-(1 << 62), 63)
    blocks = -(-n // block)
    numbered = own.withColumn("part", F.pmod(F.xxhash64("ord", "label", "v"), F.lit(blocks)))
    numbered.write.partitionBy("part").parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    out = new_folder(spark, "negatives")
    for at in range(blocks):
        got = parts.filter(F.col("part") == at).select("ord", "label", "v").toArrow()
        if not got.num_rows:
            continue
        ids, labels = (got.column(c).to_numpy() for c in ("ord", "label"))
        shipped = spark.sparkContext.broadcast(Block(ids, labels, [np.array(v.as_py(), np.int64) for v in got.column("v")]))
        every = np.arange(ids.size)
        w = Windows(every, np.full(ids.size, reach), np.full(ids.size, -reach), True, positives, least, DIGIT)
        _refine(slim, shipped, w, id_bits)
        pairs = _gather(slim, shipped, w).toArrow()  # at most ``positives`` rows an anchor
        anchor, score = pairs.column("window").to_numpy(), pairs.column("score").to_numpy()
        if not anchor.size:
            continue
        w = Windows(anchor, (high * score) // 100, -((-low * score) // 100), False, negatives, least, DIGIT)
        _refine(slim, shipped, w, id_bits)
        names = [(i, int(ids[a]), p, s) for i, (a, p, s) in enumerate(zip(anchor.tolist(), pairs.column("ord").to_pylist(), score.tolist(), strict=True))]
        windows = spark.createDataFrame(names, "window long, anchor_id long, positive_id long, positive_score long")
        found = _gather(slim, shipped, w).join(F.broadcast(windows), "window")
        found.select("anchor_id", real_id(F.col("positive_id")).alias("positive_id"), "rank", real_id(F.col("ord")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        shipped.unpersist()
    drop_folder(spark, folder)
    return spark.read.schema(schema).parquet(out) if _exists(spark, out) else spark.createDataFrame([], schema)


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
