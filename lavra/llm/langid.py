"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Weights come from follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties, so most are
exactly zero; a temperature fitted on documents that were not trained on calibrates the scores.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.llm.common import aside, let_go, materialized

#: Letters and n-grams are hashed into so many buckets.
DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Most labelled documents per language that the weights are fitted on.
SAMPLE = 600
UNKNOWN = "und"
#: Code points of text whose n-grams are counted at once; n-grams across two windows count like all others.
WINDOW = 1 << 20


@functools.cache
def _letters(block: int) -> np.ndarray:
    """For 4,096 code points: 0 for what is no letter, else the lower-case letter."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(block << 12, (block + 1) << 12)], np.uint32)


def letters(text: str) -> np.ndarray:
    """Lower-case letters of ``text``, zeros for all other code points."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not code.size:
        return code
    block = code >> np.uint32(12)
    top = int(block.max())
    if top == 0:
        return _letters(0)[code]
    out = np.zeros(code.size, np.uint32)
    for k in range(top + 1):
        here = block == k
        if here.any():
            out[here] = _letters(k)[code[here] & np.uint32(0xFFF)]
    return out


def count(text: str) -> np.ndarray | None:
    """Counts of the whole text's n-grams by bucket; None if it has no letter.

    N-grams are those of the text's lower-case letters, with each run of anything else, and either end, as one mark.
    """
    out, seen_letter = np.zeros(DIM, np.int64), False
    tail = np.zeros(1, np.uint32)  # what n-grams that end in the next window may begin with; the text begins with a mark
    for lo in range(0, len(text) or 1, WINDOW):
        low = letters(text[lo : lo + WINDOW])
        seen_letter = seen_letter or bool(low.any())
        if lo + WINDOW >= len(text):
            low = np.append(low, np.uint32(0))
        keep = low != 0
        keep[1:] |= low[:-1] != 0
        keep[0] |= tail[-1] != 0
        new = low[keep]
        a = np.concatenate([tail, new])
        h = a * np.uint32(0x9E3779B1)
        seen = [h[tail.size - (lo == 0) :] >> np.uint32(18)]
        for n in ORDERS[1:]:
            if h.size > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a[n - 1 :] * np.uint32(0xC2B2AE3D)
                fresh = h[max(0, tail.size - n + 1) :]  # those that end in this window
                seen.append((fresh ^ (fresh >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(18))
        out += np.bincount(np.concatenate(seen), minlength=DIM)
        tail = a[-(max(ORDERS) - 1) :]
    return out if seen_letter else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length TF-IDF weights (term frequency damped by a logarithm)."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        c = count(text) if text else None
        if c is None or not self.langs:
            return UNKNOWN, 0.0
        at, v = features(c, self.idf)
        p = softmax((v @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with an elastic net, one document at a time in a fixed random order."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            at, v = np.append(at, DIM), np.append(v, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = softmax(v @ w)
            g[y[i]] -= 1
            g = v[:, None] * g[None, :]
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
    w = weights(z, n)
    return w[:DIM], w[DIM]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(y.size), y] + 1e-12).mean()
    lo, hi, r = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column) -> Column:
    """Documents that must not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from texts and non-null labels of the documents that are not held out.

    One parallel pass over those documents' whole texts writes each task's document frequencies and the features of
    about ``sample`` documents of each language, drawn by a hash of id and text, to the shared folder; frequencies are
    summed by bucket in Spark.  Copies count in the frequencies and once in the sample.  Every fifth of the sample only
    sets the temperature.  To the driver come ``DIM`` sums, the languages and the sample's sparse features.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~held_out(F.col(id_col)) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    per_lang = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.ones(DIM), np.zeros((DIM, 0)), np.zeros(0), 1.0)
    number = {x: i for i, x in enumerate(langs)}
    share = {x: min(1.0, sample / n) for x, n in per_lang.items()}
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``kind`` is a language's number for a drawn document; -1: ``n`` documents have an n-gram of bucket ``key``; -2: ``n`` documents."""
        row = lambda *columns: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["kind", "key", "n", "a", "b"])
        let_go()
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for key, text, lang in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                c = count(text.as_py())
                if c is None:
                    continue
                df += c > 0
                n += 1
                if (key % (1 << 40)) / (1 << 40) < share[lang]:
                    at = np.flatnonzero(c)
                    yield row([number[lang]], [key], [1], [at.astype("<u2").tobytes()], [c[at].astype("<u4").tobytes()])
        if n:
            at = np.flatnonzero(df)
            none = [None] * (at.size + 1)
            yield row([-2] + [-1] * at.size, [0, *at.tolist()], [n, *df[at].tolist()], none, none)

    keyed = known.select(F.xxhash64("doc_id", "text").alias("key"), "text", "lang")
    found = materialized(keyed.mapInArrow(gather, "kind int, key long, n long, a binary, b binary"), "languages")
    df, total = np.zeros(DIM, np.int64), 0
    for r in found.filter("kind < 0").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():
        if r["kind"] == -1:
            df[r["key"]] = r["n"]
        else:
            total = r["n"]
    drawn = found.filter("kind >= 0").groupBy("kind", "key").agg(F.first("a").alias("a"), F.first("b").alias("b")).collect()
    taken = sorted(((r["key"], r["kind"], np.frombuffer(r["a"], "<u2"), np.frombuffer(r["b"], "<u4")) for r in drawn), key=lambda x: x[:2])
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = []
    for _, _, at, c in taken:
        v = (1 + np.log(c)) * idf[at]
        rows.append((at.astype(np.int64), v / np.sqrt(v @ v)))
    y = np.array([x[1] for x in taken], np.int64)
    aside = np.arange(len(rows)) % 5 == 4 if len(rows) >= 10 * len(langs) else np.zeros(len(rows), bool)
    w, bias = ftrl([r for r, s in zip(rows, aside, strict=True) if not s], y[~aside], len(langs))
    t = temperature(np.array([v @ w[at] + bias for (at, v), s in zip(rows, aside, strict=True) if s]), y[aside]) if aside.any() else 1.0
    return Model(langs, idf, w, bias, t)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to id, text and the carried columns; only the text decides.

    ``und`` with score 0 if the text is null or has no letter.  One narrow pass; the model is of fixed size, and a text
    of any length is counted in windows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col), F.col(text_col), *(F.col(c) for c in carry), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        model = shipped.value
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(1)]
            new = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *new], b.schema.names)

    return slim.mapInArrow(run, slim.schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Null ids count as not held out; repeated rows are predicted each; whole texts count, whatever their length; an
    empty table gives no rows; if nothing is labelled, every prediction is ``und``.  Ties go to the language that sorts
    first.  Columns of ``docs`` other than ``doc_id, text, lang`` are not read, so their names cannot clash.
    """
    model = fit(docs, sample)
    slim = predict(docs, model)
    return slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least the score ``least``, with all their columns.

    Rows without text or letters go; rows with null ids or labels are judged like all others; repeated rows are judged
    each; an empty table stays empty; other columns pass through unchanged, whatever they are named and however that is spelled.
    """
    apart, own = aside(docs)
    rest = tuple(c for c in apart.columns if c not in ("doc_id", "text"))
    found = predict(apart, fit(docs, sample), carry=rest).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*own(found))
