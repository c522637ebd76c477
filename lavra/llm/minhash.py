"""MinHash near-dedup with tensored tables, and exact verification.

Two collections of ``HALVES`` short signatures (``DEPTH`` minhashes each) are computed; a table's key joins one
signature of each collection, so ``2 * HALVES * DEPTH`` minhashes serve ``HALVES ** 2`` tables.  Candidates are verified
on full sets of shingles in two steps.  First each document is compared with the least of fitting size that it meets in
a table: one comparison a document, which settles groups of near copies of any size.  Where documents that meet, directly
or through others, are not all linked by that, every pair of them that may be similar is compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.common import drop_folder, let_go, materialized, new_folder, real_id, row_key

HALVES, DEPTH = 11, 3
#: Shingles that a block of a family holds about; a task compares two blocks at once.
BLOCK = 400_000
#: Bytes of a text whose words are hashed at once.
WINDOW = 1 << 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ODD = (np.random.default_rng(11).integers(1, 1 << 63, (2 * HALVES * DEPTH, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS = np.ones(64, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > _POWERS.size:
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64))])
    return _POWERS[:n]


_powers(1024)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    raw = (text or "").encode("utf-8", "replace").translate(_LOWER)
    out, at = [], 0
    while at < len(raw):
        end = at + WINDOW
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        a = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        at = end
        inside = np.concatenate([[False], ~_SPACE[a], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = turns[::2], turns[1::2] - turns[::2]
        if start.size:
            code = a[inside[1:-1]].astype(np.uint64) + np.uint64(1)
            first = np.cumsum(size) - size
            place = np.arange(code.size) - np.repeat(first, size)
            out.append(_mix(np.add.reduceat(code * _powers(int(size.max()))[place], first) + size.astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, without words none."""
    w = word_hashes(text)
    if not w.size:
        return w
    n = min(words, w.size)
    h = np.full(w.size - n + 1, n, np.uint64)
    for i, power in enumerate(_powers(n + 1)[1:]):
        h += w[i : w.size - n + 1 + i] * power
    h = _mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def signatures(own: np.ndarray) -> list[int]:
    """``2 * HALVES`` signatures: those of the first collection, then those of the second."""
    low = np.full((_ODD.size, 1), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, own.size, 4096):
        low = np.minimum(low, (own[None, i : i + 4096] * _ODD).min(1, keepdims=True))
    h = np.zeros(2 * HALVES, np.uint64)
    for part in low.reshape(2 * HALVES, DEPTH).T:
        h = _mix(h * _M1 + part)
    return h.view(np.int64).tolist()


def described(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ord, tie, n, digest, sigs`` per row: set size, 128 bits of hash of the set, signatures (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            n, digest, sigs = [], [], []
            for t in b.column(2):
                own = shingles(t.as_py(), words)
                n.append(own.size)
                digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if own.size else None)
                sigs.append(signatures(own) if own.size else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], ["ord", "tie", "n", "digest", "sigs"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, "ord long, tie struct<a:long,b:long>, n long, digest binary, sigs array<long>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: for each node of undirected ``a, b`` edges that is not its component's least, the least.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes.  A node with
    many neighbours meets its minimum by a partial aggregate and a join that Spark can split.
    """
    spark = edges.sparkSession
    at = new_folder(spark, "edges")
    cur = materialized(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "edges", at)
    state = None
    while True:
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
        both = cur.selectExpr("hi as u", "lo as v").union(cur.selectExpr("lo as u", "hi as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        top = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(top, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        before, at = at, new_folder(spark, "edges")
        cur = materialized(pairs.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "edges", at)
        drop_folder(spark, before)


def _similar(one: np.ndarray, two: np.ndarray, share: int, of: int) -> bool:
    """Whether ``of`` times the intersection is at least ``share`` times the union of two sorted sets."""
    least = min(one.size, two.size)
    if of * least < share * max(one.size, two.size):
        return False
    both = np.concatenate([one, two])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return of * common >= share * (one.size + two.size - common)


def verified(docs: DataFrame, stars: DataFrame, share: int, of: int, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those edges ``a, b`` of ``stars`` (``node, centre, ord, tie``, with each centre's own row, whose centre is null) that are links.

    Texts move, not sets: once to their keys, once more to the centres.  The join that brings members to a centre is one
    that Spark can split, however many members a centre has.
    """
    # merge joins: texts move alike whatever the size of the other side
    held = _keyed(docs, id_col, text_col).join(stars.hint("merge"), ["ord", "tie"]).dropDuplicates(["ord", "tie"]).select("node", "centre", "text")
    members = held.filter("centre is not null")
    centres = held.select(F.col("node").alias("centre"), F.col("text").alias("centre_text"))
    met = members.join(centres.join(stars.select("centre").distinct(), "centre", "left_semi").hint("merge"), "centre").select("node", "centre", "text", "centre_text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        last, own = None, np.empty(0, np.uint64)
        for b in batches:
            a, c, hit = b.column(0), b.column(1), []
            for centre, text, centre_text in zip(c.to_pylist(), b.column(2), b.column(3), strict=True):
                if centre != last:
                    last, own = centre, shingles(centre_text.as_py(), words)
                hit.append(_similar(own, shingles(text.as_py(), words), share, of))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), c.filter(keep)], ["a", "b"])

    return met.mapInArrow(judge, "a long, b long")


def _compare(one: list[np.ndarray], two: list[np.ndarray] | None, keys: list[int], share: int, of: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of sets (or within one), by counting shared shingles.

    Each shingle's holders stand together; counting, for one set, the holders of its shingles gives the sizes of all
    intersections with it.  Sets that are in one tree already are counted but add no edge.
    """
    sets = one + (two or [])
    size = np.array([s.size for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    firsts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    ends = np.append(firsts[1:], value.size)
    shared = ends - firsts > 1
    number = np.repeat(np.arange(firsts.size), ends - firsts)
    #: Per set the numbers of its shingles that another set has too.
    live = shared[number]
    by_set = np.argsort(owner[live], kind="stable")
    held, whose = number[live][by_set], owner[live][by_set]
    bound = np.searchsorted(whose, np.arange(len(sets) + 1))
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x in range(len(one) if two is not None else len(sets)):
        mine = held[bound[x] : bound[x + 1]]
        if share * size[x] > of * mine.size:  # too few of its shingles are anyone else's
            continue
        f, e = firsts[mine], ends[mine]
        n = e - f
        stop = np.cumsum(n)
        near = owner[np.arange(stop[-1] if n.size else 0) + np.repeat(f - (stop - n), n)]
        common = np.bincount(near, minlength=len(sets))
        hit = of * common >= share * (size + size[x] - common)
        hit[: len(one) if two is not None else x + 1] = False
        for y in np.flatnonzero(hit).tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                out.append((keys[x], keys[y]))
    return out


def links(docs: DataFrame, members: DataFrame, share: int, of: int, words: int = 5, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges ``a, b`` that span the similar members of each family; ``members``: ``node, ord, tie, family, n`` (a written table).

    Sizes of similar sets lie within ``share / of``; a family is cut by classes of size, so that only equal or
    neighbouring classes are compared, and a class into blocks by hash.  Each task holds two blocks, whatever the
    family's size; pairs are never rows.
    """
    step = math.log(of / share)
    classed = members.withColumn("class", F.floor(F.log("n") / step).cast("int"))
    blocks = classed.groupBy("family", "class").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    above = blocks.select("family", (F.col("class") - 1).alias("class"), F.col("blocks").alias("up"))
    below = blocks.select("family", (F.col("class") + 1).alias("class"), F.col("blocks").alias("down"))
    counts = blocks.join(above, ["family", "class"], "left").join(below, ["family", "class"], "left").fillna(0)
    placed = classed.join(counts, ["family", "class"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = lambda c, i, up, j, side: F.struct(c.cast("int").alias("class"), i.cast("int").alias("i"), F.lit(up).alias("up"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    row, mine = F.col("class"), F.col("mine")
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(every(F.col("blocks")), lambda j: F.when(j >= mine, meet(row, mine, False, j, 0)).otherwise(meet(row, j, False, mine, 1)))
    upward = F.transform(every(F.col("up")), lambda j: meet(row, mine, True, j, 0))
    downward = F.transform(every(F.col("down")), lambda j: meet(row - 1, j, True, mine, 1))
    tasks = placed.select("node", "ord", "tie", "family", F.concat(within, upward, downward).alias("tasks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            own = pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), own], ["node", "family", "tasks", "own"])

    kind = "node long, family long, tasks array<struct<class:int,i:int,up:boolean,j:int,side:int>>, own binary"
    held = _keyed(docs, id_col, text_col).join(tasks.hint("merge"), ["ord", "tie"]).dropDuplicates(["ord", "tie"]).select("node", "family", "tasks", "text").mapInArrow(sets, kind)
    dealt = held.select("node", "family", F.explode("tasks").alias("t"), "own").select("node", "family", "t.*", "own")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        read = lambda d: [np.frombuffer(x, np.uint64) for x in d["own"]]
        inner = not pdf["up"].iloc[0] and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if not inner and (first.empty or second.empty):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        got = _compare(read(first), None if inner else read(second), [*first["node"], *second["node"]], share, of)
        return pd.DataFrame({"a": [x[0] for x in got], "b": [x[1] for x in got]}, dtype="int64")

    return dealt.groupBy("family", "class", "i", "up", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, share: int = 85, of: int = 100, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Documents are linked if ``of`` times the intersection of their shingles is at least ``share`` times the union.
    Exact copies of a set are one document until the end, so groups of copies cost one aggregate.  Texts without words
    (null, empty) are linked with nothing; a component is named by its least id (none first).  Rows with equal ids and
    texts are one document; rows with equal ids, or without one, but other texts are documents of their own.  Whole
    texts count, whatever their length.  An empty table gives no rows; columns other than id and text are not read, so
    their names cannot clash.  No partner or candidate is dropped.
    """
    found = _judged(docs, share, of, words, id_col, text_col)
    return found.select(real_id(F.col("ord")).alias("doc_id"), F.col("n").alias("n_shingles"), real_id(F.col("component.ord")).alias("component_id"), "kept")


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct ``a, b``: each node of ``reps`` (``node, sigs``) with the least node of every table bucket it is in."""
    tables = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(HALVES - 1)), lambda i: F.transform(F.sequence(F.lit(HALVES), F.lit(2 * HALVES - 1)), lambda j: F.xxhash64(i, j, F.get("sigs", i), F.get("sigs", j)))))
    rows = reps.select("node", F.explode(tables).alias("key"))
    met = rows.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("key", "centre")
    return rows.join(met, "key").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def _judged(docs: DataFrame, share: int, of: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ord, tie, n, component, kept`` per row; ``component``: the least ``ord, tie`` of the row's component."""
    facts = materialized(described(docs, words, id_col, text_col), "signatures")
    own = F.struct("ord", "tie")
    reps = facts.filter("digest is not null").groupBy("digest").agg(F.min(own).alias("rep"), F.first("n").alias("n"), F.first("sigs").alias("sigs"))
    # numbers that hold once written: graphs of long nodes
    reps = materialized(reps.select(F.monotonically_increasing_id().alias("node"), "rep.ord", "rep.tie", "digest", "n", "sigs"), "representatives")
    pairs = materialized(candidates(reps), "candidates")
    sizes = reps.select("node", "n")
    fit = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").filter(of * F.least("n_a", "n_b") >= share * F.greatest("n_a", "n_b"))
    stars = materialized(fit.groupBy("a").agg(F.min("b").alias("centre")).withColumnRenamed("a", "node"), "stars")
    centres = stars.select(F.col("centre").alias("node")).distinct().join(stars.select("node"), "node", "left_anti")
    every = stars.unionByName(centres.withColumn("centre", F.lit(None).cast("long")))
    stars = materialized(every.join(reps.select("node", "ord", "tie"), "node"), "stars")
    near = components(verified(docs, stars, share, of, words, id_col, text_col))
    # components whose documents meet but are not linked so far
    at_root = lambda edges: _moved(_moved(edges, near, "a"), near, "b").filter("a <> b").distinct()
    families = _whole(components(at_root(pairs))).select(F.col("node").alias("root"), F.col("root").alias("family"))
    inside = near.join(families, "root").select("node", "family").union(families)
    members = materialized(inside.join(reps.select("node", "ord", "tie", "n"), "node"), "families")
    more = components(at_root(links(docs, members, share, of, words, id_col=id_col, text_col=text_col)))
    found = _whole(_moved(near, more, "root").union(more))
    named = found.join(reps.select("node", own.alias("rep")), "node")
    least = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select("node", "least")
    per_set = reps.join(least, "node", "left").select("digest", F.coalesce("least", own).alias("component"))
    joined = facts.select("ord", "tie", "n", "digest").join(per_set, "digest", "left").withColumn("component", F.coalesce("component", own))
    return joined.select("ord", "tie", "n", "component", (F.col("component") == own).alias("kept"))


def _moved(rows: DataFrame, found: DataFrame, col: str) -> DataFrame:
    """``rows`` with the nodes in ``col`` replaced by their roots in ``found``."""
    joined = rows.join(found.select(F.col("node").alias(col), F.col("root").alias("_root")), col, "left")
    return joined.withColumn(col, F.coalesce("_root", col)).select(*rows.columns)


def _whole(found: DataFrame) -> DataFrame:
    """``node, root`` of ``components`` with the roots themselves."""
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def deduplicated(docs: DataFrame, share: int = 4, of: int = 5, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one each, with all their columns, whatever these are named.

    Of a component the row of the least id stays (none first; among equal ids, a hash of the text decides).  Rows equal
    in id and text are copies, of which one stays; rows with equal ids, or none, but other texts are documents of their
    own.  Rows without words stay.  An empty table stays empty.
    """
    names = {c.lower() for c in docs.columns}
    key = []
    for name in ("_ord", "_tie"):
        while name in names:
            name += "_"
        key.append(name)
    kept = _judged(docs, share, of, words).filter("kept").select("ord", "tie").distinct().toDF(*key)
    return docs.withColumns(dict(zip(key, row_key("doc_id", "text"), strict=True))).join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
