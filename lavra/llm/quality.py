"""Document quality by co-training.

One classifier sees only the text, the other only the page's metadata.  In each round either labels all unlabelled
documents of the table that it is sure of for the other, and both learn from all labelled and all so labelled rows by
gradients that are summed where the rows are.  Afterwards both are calibrated on labelled documents that neither was
trained on, and a logistic combination of the calibrated views scores every document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.common import materialized
from lavra.llm.minhash import word_hashes

#: About how many labelled documents come to the driver, to start from and to calibrate on; all are learned from.
LABELLED = 4_000
#: Rounds of exchange, and descents in each.
ROUNDS, STEPS = 4, 5
#: How sure a view must be to label a document for the other one, and what such a label weighs.
SURE, GIVEN = 0.97, 0.5
L2 = 1e-5
#: Buckets of n-grams of kinds of characters, of words, and of metadata values.
GRAMS, WORDS, META = 1 << 12, 1 << 12, 1 << 10
STYLE = 12
DIMS = (GRAMS + WORDS + STYLE, META)
#: Numbers that ``sums`` gives, and tasks whose sums (74 kB each) the driver adds up by itself.
SUMS, FEW = sum(DIMS) + 7, 64
WINDOW = 1 << 20
#: Rows whose features are laid out at once.
ROWS = 512


def _classes() -> np.ndarray:
    """Code points below 0x3000 by kind: letters by case, digits, white space, ASCII marks each by itself."""
    out = np.full(0x3000, 5, np.uint32)
    for i in range(0x3000):
        c = chr(i)
        out[i] = 0 if c.isspace() else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 10 + i if i < 128 else 5
    return out


_CLASS = _classes()
Row = tuple[np.ndarray, np.ndarray]


def _unit(counts: np.ndarray) -> Row:
    at = np.flatnonzero(counts)
    v = np.log1p(counts[at])
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


def text_features(text: str | None) -> Row:
    """Hashed words, bigrams and trigrams of kinds of characters, word lengths, repetition: of the whole text."""
    text = text or ""
    counts = np.zeros(GRAMS)
    kinds = np.zeros(4)
    for lo in range(0, len(text), WINDOW):
        before = min(2, lo)  # characters of the window before, so that no n-gram is lost
        code = np.frombuffer(text[lo - before : lo + WINDOW].encode("utf-32-le", "replace"), np.uint32)
        k = _CLASS[np.minimum(code, _CLASS.size - 1)]
        kinds += [np.count_nonzero(k[before:] == j) for j in range(4)]
        h = k[:-1] * np.uint32(0x9E3779B1) + k[1:] * np.uint32(0x85EBCA77)
        seen = [h[max(0, before - 1) :] >> np.uint32(20)]
        if k.size > 2:
            seen.append(((h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + k[2:] * np.uint32(0x27D4EB2F)) >> np.uint32(20))
        counts += np.bincount(np.concatenate(seen), minlength=GRAMS)
    words, n_lines = word_hashes(text), text.count("\n") + 1
    at, v = _unit(counts)
    word_at, word_v = _unit(np.bincount((words >> np.uint64(52)).astype(np.int64), minlength=WORDS))
    n = max(1, len(text))
    style = np.array([
        *(kinds / n),
        1 - kinds.sum() / n if text else 0.0,
        np.unique(words).size / max(1, words.size),
        len(set(text.split("\n"))) / n_lines,
        min(1.0, len(text) / max(1, words.size) / 20),
        np.log1p(words.size) / 12,
        np.log1p(len(text) / n_lines) / 12,
        float(not words.size),
        np.log1p(n_lines) / 12,
    ])
    return np.concatenate([at, GRAMS + word_at, np.arange(GRAMS + WORDS, DIMS[0])]), np.concatenate([v, word_v, style])


def meta_features(values: dict) -> Row:
    """Hashed ``column=value``; numbers by their power of two."""
    at = []
    for name, x in sorted(values.items()):
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            x = int(np.log2(abs(x) + 1) * 2)
        at.append(zlib.crc32(f"{name}={x}".encode()) % META)
    return np.array(at, np.int64), np.full(len(at), 1 / max(1.0, len(at)) ** 0.5)


def train(rows: list[Row], y: np.ndarray, weight: np.ndarray, dim: int, epochs: int = 12, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression, by AdaGrad in a fixed random order."""
    w, g2 = np.zeros(dim + 1), np.full(dim + 1, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            p = 1 / (1 + np.exp(-(v @ w[at] + w[dim])))
            e = weight[i] * (p - y[i])
            g = e * v + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            g2[dim] += e * e
            w[dim] -= rate * e / np.sqrt(g2[dim])
    return w


def logits(rows: list[Row], w: np.ndarray) -> np.ndarray:
    return np.array([v @ w[at] + w[-1] for at, v in rows])


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scales (none below zero) and a bias for columns of logits, by penalised Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


@dataclass
class Model:
    w: tuple[np.ndarray, np.ndarray]
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray

    def score(self, text: Flat, meta: Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zt, zm = (np.clip(x.logits(w) * scale[0] + scale[1], -30, 30) for x, w, scale in ((text, self.w[0], self.text_scale), (meta, self.w[1], self.meta_scale)))
        return _sigmoid(zt), _sigmoid(zm), _sigmoid(self.both[0] * zt + self.both[1] * zm + self.both[2])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Flat:
    """Rows of one view end to end."""

    def __init__(self, at: np.ndarray, v: np.ndarray, sizes: np.ndarray) -> None:
        self.at, self.v, self.n = at, v, sizes.size
        self.row = np.repeat(np.arange(sizes.size), sizes)

    @classmethod
    def of(cls, rows: list[Row]) -> Flat:
        none = np.empty(0)
        return cls(np.concatenate([none.astype(np.int64), *(at for at, _ in rows)]), np.concatenate([none, *(v for _, v in rows)]), np.array([at.size for at, _ in rows], np.int64))

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.v * w[self.at], self.n) + w[-1]

    def gradient(self, e: np.ndarray, dim: int) -> np.ndarray:
        return np.append(np.bincount(self.at, self.v * e[self.row], dim), e.sum())


def sums(views: tuple[Flat, Flat], y: np.ndarray, givers: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
    """Of some rows: both views' gradients at ``w``, then for either its loss and weight of rows, then how many labels are given.

    ``y`` is -1 for unlabelled rows, -2 for rows to leave out.  The label of an unlabelled row is what the other view, with the
    weights ``givers``, is sure of.
    """
    grads, more, given = [], [], 0
    for k in (0, 1):
        p = _sigmoid(views[1 - k].logits(givers[1 - k]))
        sure = (y == -1) & (np.maximum(p, 1 - p) >= SURE)
        label = np.where(y >= 0, y, p > 0.5).astype(float)
        weight = np.where(y >= 0, 1.0, np.where(sure, GIVEN, 0.0))
        z = views[k].logits(w[k])
        grads.append(views[k].gradient(weight * (_sigmoid(z) - label), DIMS[k]))
        more += [float(weight @ (np.logaddexp(0, z) - label * z)), float(weight.sum())]
        given += int(sure.sum())
    return np.concatenate([*grads, more, [given]])


def descend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Limited-memory BFGS; ``value`` gives the loss and its gradient, in one pass over all rows."""
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y, r in reversed(past):
            kept.append(r * (s @ d))
            d -= kept[-1] * y
        if past:
            s, y, r = past[-1]
            d *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d += (a - r * (y @ d)) * s
        for rate in (1.0, 0.25, 0.05):
            new = w - rate * d
            f_new, g_new = value(new)
            if f_new < f:
                break
        else:
            return w
        s, y = new - w, g_new - g
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        w, f, g = new, f_new, g_new
    return w


def exchange(total: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray], w: list[np.ndarray], rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Weights after ``rounds`` rounds from ``w``, and how many labels were given in the last; ``total``: ``sums`` over all rows."""
    cut, given = DIMS[0] + 1, 0
    for _ in range(rounds):
        givers = w
        count = [0]

        def value(x: np.ndarray, givers=givers, count=count) -> tuple[float, np.ndarray]:
            got = total(givers, [x[:cut], x[cut:]])
            loss_t, n_t, loss_m, n_m, count[0] = got[-5:]
            n_t, n_m = max(n_t, 1.0), max(n_m, 1.0)
            free = x.copy()
            free[[cut - 1, -1]] = 0  # the biases
            return float(loss_t / n_t + loss_m / n_m + L2 / 2 * (free @ free)), np.concatenate([got[:cut] / n_t, got[cut:-5] / n_m]) + L2 * free

        x = descend(value, np.concatenate(w))
        w, given = [x[:cut], x[cut:]], int(count[0])
        if not given:
            break
    return w, given


def start(text: list[Row], meta: list[Row], y: np.ndarray) -> list[np.ndarray]:
    return [train(rows, y.astype(float), np.ones(y.size), dim) for rows, dim in zip((text, meta), DIMS, strict=True)]


def cotrain(text: list[Row], meta: list[Row], y: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights of both views; ``y`` is -1 for unlabelled documents.  Also how many labels the last round exchanged.

    What ``fit`` does to a table, for rows in memory.
    """
    here = np.flatnonzero(y >= 0)
    views = (Flat.of(text), Flat.of(meta))
    w, given = exchange(lambda givers, w: sums(views, y, givers, w), start([text[i] for i in here], [meta[i] for i in here], y[here]), rounds)
    return w[0], w[1], given


def _meta_values(at: np.ndarray) -> np.ndarray:
    return np.full(at.size, 1 / max(1.0, at.size) ** 0.5)


def _flat(text_at: pa.Array, text_v: pa.Array, meta_at: pa.Array) -> tuple[Flat, Flat]:
    """Both views of rows of ``described``."""
    read = lambda col, kind: np.frombuffer(b"".join(col), kind)
    ta, tv, ma = text_at.to_pylist(), text_v.to_pylist(), meta_at.to_pylist()
    text = Flat(read(ta, "<u2").astype(np.int64), read(tv, "<f4").astype(np.float64), np.array([len(x) // 2 for x in ta], np.int64))
    sizes = np.array([len(x) // 2 for x in ma], np.int64)
    return text, Flat(read(ma, "<u2").astype(np.int64), np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes), sizes)


def described(docs: DataFrame, labels: DataFrame, meta_columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id, a, b, c, y`` for every row of ``docs``, a written table: features of both views (some hundred bytes; no texts
    are shuffled) and the label, null without one.  Of equal ids in ``labels`` the least label counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().filter("y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    n_meta = len(meta_columns)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = [b.column(2 + i).to_pylist() for i in range(n_meta)]
            out = []
            for k, t in enumerate(b.column(1)):
                at, v = text_features(t.as_py())
                mat, _ = meta_features({c: m[k] for c, m in zip(meta_columns, meta, strict=True)})
                out.append((at.astype("<u2").tobytes(), v.astype("<f4").tobytes(), mat.astype("<u2").tobytes()))
            cols = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.binary()) for c in cols)], ["id", "a", "b", "c"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"m_{i}") for i, c in enumerate(meta_columns)))
    rows = slim.mapInArrow(describe, f"id {docs.schema[id_col].dataType.simpleString()}, a binary, b binary, c binary")
    # always the same way, whatever the labels' size: features, no texts, are shuffled once
    return materialized(rows.join(known.hint("merge"), "id", "left"), "features")


def fit(rows: DataFrame, labelled: int = LABELLED) -> Model:
    """Learns from all rows of ``described``, labelled or not.

    The driver gets the features of about ``labelled`` labelled rows to start from, and the logits of as many, drawn
    evenly by a hash of id and features, copies once; else only sums, whose size does not depend on the input.
    """
    here = rows.filter("y is not null")
    n, good = here.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if good in (0, n):  # nothing to tell apart: everything scores the labels' mean
        p = float(np.clip(good / n, 0.02, 0.98)) if n else 0.5
        flat = np.array([0.0, np.log(p / (1 - p))])
        return Model(tuple(np.zeros(d + 1) for d in DIMS), flat, flat, np.array([0.5, 0.5, 0.0]))
    aside = F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(5)) == 0 if n >= 25 else F.lit(False)
    marked = rows.select("id", "a", "b", "c", F.when(F.col("y").isNull(), -1).when(aside, -2).otherwise(F.col("y")).alias("y"), F.col("y").alias("real"))
    slot = F.pmod(F.xxhash64("id", "a", "c"), F.lit(1 << 30)) / float(1 << 30)
    first = sorted(marked.filter((F.col("y") >= 0) & (slot < labelled / n)).dropDuplicates(["id", "a", "c"]).collect(), key=lambda r: (zlib.crc32(str(r["id"]).encode()), str(r["id"]), bytes(r["a"])))
    text = [(np.frombuffer(r["a"], "<u2").astype(np.int64), np.frombuffer(r["b"], "<f4").astype(np.float64)) for r in first]
    meta = [(m := np.frombuffer(r["c"], "<u2").astype(np.int64), _meta_values(m)) for r in first]
    learned = marked.select("a", "b", "c", "y")
    parts = learned.rdd.getNumPartitions()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum((np.frombuffer(x) for b in batches for x in b.column(0).to_pylist()), np.zeros(SUMS)).tobytes()])], ["x"])

    def total(givers: list[np.ndarray], w: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(SUMS)
            for b in batches:
                for lo in range(0, b.num_rows, ROWS):
                    part = b.slice(lo, ROWS)
                    out += sums(_flat(*part.columns[:3]), part.column(3).to_numpy(zero_copy_only=False), givers, w)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["x"])

        out = learned.mapInArrow(run, "x binary")  # a row a task
        if parts > FEW:
            out = out.repartition(math.isqrt(parts)).mapInArrow(add, "x binary")
        return sum((np.frombuffer(r["x"]) for r in out.collect()), np.zeros(SUMS))

    w, _ = exchange(total, start(text, meta, np.array([r["y"] for r in first], np.int64)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [x.logits(v) for x, v in zip(_flat(*b.columns[:3]), w, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(z[0]), pa.array(z[1]), b.column(3)], ["zt", "zm", "y"])

    def logits_of(which: DataFrame, many: int) -> np.ndarray:
        drawn = which.filter(slot < labelled / max(1, many)).dropDuplicates(["id", "a", "c"]).select("a", "b", "c", "real")
        return np.array(sorted(map(tuple, drawn.mapInArrow(judge, "zt double, zm double, y int").collect()))).reshape(-1, 3)

    cal = logits_of(marked.filter("y = -2"), n // 5)
    if len(set(cal[:, 2])) < 2:
        cal = logits_of(marked.filter("real is not null"), n)
    if len(set(cal[:, 2])) < 2:  # one kind is too rare for the draw: it is drawn by itself
        rare = int(2 * good < n)
        cal = np.concatenate([cal, logits_of(marked.filter(F.col("real") == rare), good if rare else n - good)])
    zt, zm, y = cal.T
    ts, ms = platt(zt[:, None], y), platt(zm[:, None], y)
    both = platt(np.column_stack([zt * ts[0] + ts[1], zm * ms[0] + ms[1]]), y)
    return Model((w[0], w[1]), ts, ms, both)


def scores(docs: DataFrame, labels: DataFrame, meta_columns: tuple[str, ...] = ("source", "lang"), labelled: int = LABELLED, least: float = 0.5) -> DataFrame:
    """``doc_id, text_score, meta_score, quality_score, keep`` for every row of ``docs``.

    The metadata columns must say nothing that the text says, for the views to be two; the length is the text view's.
    Null text is empty, null metadata is a value of its own, null ids have no label; repeated rows score alike; whole
    texts count, whatever their length; without labels of both kinds all documents score the labels' mean (one half if
    there are none); an empty table gives no rows.  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    rows = described(docs, labels, meta_columns)
    shipped = docs.sparkSession.sparkContext.broadcast(fit(rows, labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                got = model.score(*_flat(*b.columns[1:4]))
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, got), pa.array(got[2] >= least)], ["doc_id", "text_score", "meta_score", "quality_score", "keep"])

    return rows.select("id", "a", "b", "c").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_score double, meta_score double, quality_score double, keep boolean")
