"""SentencePiece, ranked search and hard negatives against the library and brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.llm import negatives, pieces, ranked
from lavra.llm.entries import SQL

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "a", "  a", " ", "   ", "a ", "a  b ", "▁▁x ▁", "<s> </s> <unk>", "日本語 12½ 🙂🙂", "tab\tand\nline\r\n", "x" * 3000 + " y", "word " * 3000, "the cat", "the cat", "\x00 nul", "Ｆｕｌｌ　ｗｉｄｔｈ"]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("x", i, t, 1) for i, t in enumerate(TEXTS)] + [("x", 3, "  a", 1), (None, None, "no id", None)]
    return spark.createDataFrame(rows, "ids string, doc_id long, text string, chunk int")


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abthe ▁\n\té漢<s>🙂　\xa0."), max_size=60), st.sampled_from([5, 17, 10**6]))
def test_chunks_give_the_library_s_ids_and_text(text, window):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    seg = pieces.Segmenter(pieces.read_model(PATH))
    before, pieces.WINDOW = pieces.WINDOW, window
    try:
        got = seg.encode(text)
        assert got.tolist() == sp.encode(text)
        assert seg.decode(got) == sp.decode(sp.encode(text))
    finally:
        pieces.WINDOW = before


@pytest.mark.parametrize("head", [pieces.HEAD, 3, 0])
def test_encode_and_decode(spark, docs, sp, head):
    got = pieces.encode(docs, PATH, head=head)
    want = [(r["doc_id"], sp.encode(r["text"] or "")) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["ids"]) for r in got.collect()), key=str) == sorted(want, key=str)
    back = sorted(((r["doc_id"], r["text"]) for r in pieces.decode(got, PATH).collect()), key=str)
    assert back == sorted(((i, sp.decode(ids)) for i, ids in want), key=str)
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_table_holds_the_repeated_chunks_once(spark, docs, sp):
    table = pieces.chunk_table(docs, pieces.read_model(PATH)).to_pylist()
    own = Counter(c for t in TEXTS + ["  a", "no id"] if t for c in pieces.chunks(t))
    assert {r["chunk"] for r in table} == {c for c, n in own.items() if n > 1 and len(c) <= pieces.LONGEST}
    assert all(r["ids"] == sp.encode("a" + r["chunk"])[len(sp.encode("a")) :] for r in table)
    assert len(table) == len({r["chunk"] for r in table})


def test_models_that_look_across_markers_are_told_apart(spark, docs, sp, monkeypatch):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(pieces.read_model(PATH))
    assert pieces.separable(m.SerializeToString())
    m.pieces[500].piece = "of▁the"
    assert not pieces.separable(m.SerializeToString())
    m.pieces[500].piece = "ofthe"
    m.normalizer_spec.remove_extra_whitespaces = True
    assert not pieces.separable(m.SerializeToString())
    monkeypatch.setattr(pieces, "separable", lambda model: False)
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs.filter("doc_id > 3"), PATH).collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(TEXTS) if i > 3}


# --- ranked search -----------------------------------------------------------------------------------------------------


def ranking(docs, items, k):
    """All scores by the definition, without an index."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is not None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Ab", "x"]
    weight = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(r.choices(words, weight, k=r.randint(0, 40)))) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[3][1]), (None, None), (n + 90, ""), (n + 91, "...")]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(12)] + [(20, None), (21, "never seen"), (22, rows[5][1]), (22, "w1 w1"), (None, "w2")]
    return rows, items


def asked(spark, rows, items, **options):
    docs = spark.createDataFrame([(1, "z", *r) for r in rows], "rank int, terms string, doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, query int")
    return sorted(map(tuple, ranked.search(docs, queries, **options).collect()), key=str)


@pytest.mark.parametrize("segment,turn,window,limit", [(65_536, 32, 10**6, 10**6), (16, 1, 7, 10**6), (50, 2, 10**6, 60)])
def test_ranked_search(spark, monkeypatch, segment, turn, window, limit):
    for name, value in (("SEGMENT", segment), ("FIRST_TURN", turn), ("WINDOW", window)):
        monkeypatch.setattr(ranked, name, value)
    rows, items = corpus(150)
    assert asked(spark, rows, items, k=5, limit=limit) == ranking(rows, items, 5)


def test_ranked_search_of_empty_tables(spark):
    rows, items = corpus(9)
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ranked.search(docs.limit(0), queries).count() == 0
    assert ranked.search(docs, queries.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_the_threshold_stops_before_all_documents_are_seen():
    r = np.random.default_rng(1)
    n, per = 5000, 8
    terms = np.concatenate([np.sort(r.choice(200, per, replace=False)) for _ in range(n)])
    tfs = r.geometric(0.3, n * per)
    seg = ranked.Segment(np.full(n, 50), np.arange(0, n * per + 1, per), terms, tfs, 200, n, 50 * n)
    weight = np.zeros(200, np.int64)
    own, weights = np.array([3, 77]), np.array([5000, 40])
    weight[own] = weights
    docs, scores, seen = seg.top(own, weights, weight, 10, 0)
    every = np.array([(weight[terms[i * per : i * per + per]] * seg.impact[i * per : i * per + per]).sum() for i in range(n)])
    assert sorted(scores.tolist())[-10:] == np.sort(every)[-10:].tolist() and 0 < seen < np.count_nonzero(every) / 2
    assert seg.top(own, weights, weight, 10, 1 << 60)[2] <= 2 * ranked.FIRST_TURN


# --- hard negatives ----------------------------------------------------------------------------------------------------


def mined(rows, positives=5, wanted=10, low=30, high=90):
    """By all scores."""
    fine = [(i, lab, [math.floor(256 * c) for c in v]) for i, v, lab in rows if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda i: -(1 << 63) if i is None else i
    out = set()
    for a, lab, v in {(i, lab, tuple(v)) for i, lab, v in fine if i is not None and i % 100 == 0}:
        score = [(-sum(x * y for x, y in zip(v, u, strict=True)), key(i), i, m) for i, m, u in fine if len(u) == len(v)]
        own = sorted(((s, k, i) for s, k, i, m in score if m == lab and i != a), key=lambda x: x[:2])[:positives]
        for s, _, p in own:
            fit = sorted((t, k, i) for t, k, i, m in score if m != lab and -low * s <= -100 * t <= -high * s)[:wanted] if s <= 0 else []
            out |= {(a, p, rank, i, -s, -t) for rank, (t, _, i) in enumerate(fit, 1)}
    return sorted(out, key=str)


def vectors(n=700, d=6, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(r.normal(0.3, 0.4, d))], int(r.integers(0, 3))) for i in range(n)]
    hot = rows[11][1]
    rows += [(n + i, hot, 1) for i in range(300)] + [(n + 400 + i, hot, 2) for i in range(200)]
    rows += [(9001, None, 1), (9002, [1.0, None], 1), (9003, [float("nan")] * d, 1), (9004, [float("inf")] * d, 2), (9005, hot, None), (9006, [1.0], 1), (None, hot, 1), (100, rows[100][1], rows[100][2])]
    return rows


def test_hard_negatives(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame([(5, *r) for r in rows], "rank int, vec_id long, embedding array<float>, label int").repartition(3)
    want = mined(rows)
    assert len(want) > 100
    for digit, slack, block in ((10, 30, 5), (6, 0, 1024)):
        monkeypatch.setattr(negatives, "DIGIT", digit)
        monkeypatch.setattr(negatives, "SLACK", slack)
        got = negatives.mine(df, F.col("vec_id") % 100 == 0, block=block)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(df.filter("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


def test_products_are_whole_numbers():
    a, x = np.array([[2**30, -3]]), np.array([[2**31, 5], [1, 1]])
    assert negatives._product(a, x).tolist() == [[2**61 - 15, 2**30 - 3]]


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_hard_negatives"])
def test_query_is_its_sql(spark, name):
    import duckdb

    from lavra.llm.entries import QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(SQL[name])
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted(tuple(r[i] for i in order) for r in rel.fetchall())
    assert want and sorted(map(tuple, df.collect())) == want
