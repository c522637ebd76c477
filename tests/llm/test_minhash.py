import random
import re

import numpy as np
import pytest

from lavra.llm import minhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, share, of, words=5):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(words, len(w))
        sets.setdefault(d, []).append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    ids = sorted(sets, key=lambda d: -1 if d is None else d)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(s and u and of * len(s & u) >= share * len(s | u) for s in sets[a] for u in sets[b]):
                x, y = sorted((find(a), find(b)), key=lambda d: -1 if d is None else d)
                root[y] = x
    return sorted(((d, len(s), find(d), find(d) == d) for d in ids for s in sets[d]), key=str)


def corpus(seed, groups=25, size=8):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeÀé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    rows, d = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice((1, 3, 6, 40, 120)))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                if len(w) > 2:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((d, rng.choice((" ", "\n", " \t")).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            d += 1
    return rows


EXTRA = [(1000, None), (1001, ""), (1002, "  \n"), (1003, None), (None, "a b c"), (None, "a b c"), (1004, "A B c"), (1005, "a b c d e"), (1005, "a b c d e"), (1006, "w " * 30_000), (1007, "w " * 20_000)]


@pytest.mark.parametrize(("share", "of", "block"), [(85, 100, minhash.BLOCK), (4, 5, 300)])
def test_components_are_brute_force(spark, monkeypatch, share, of, block):
    monkeypatch.setattr(minhash.links, "__defaults__", (5, block, "doc_id", "text"))
    rows = corpus(share) + EXTRA
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string")
    got = sorted(map(tuple, minhash.near_duplicates(docs, share, of).collect()), key=str)
    want = brute(rows, share, of)
    assert got == want


def test_empty_and_deduplicated(spark):
    docs = spark.createDataFrame([(*r, "s") for r in corpus(4) + EXTRA], "doc_id long, text string, _ord string")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r["_ord"] for r in rows} == {"s"}
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted({r[0] for r in brute(corpus(4) + EXTRA, 4, 5) if r[3]}, key=str)


def test_rows_without_an_id_are_apart(spark):
    long = [" ".join(f"{w}{i}" for i in range(60)) for w in "pqr"]
    near = long[1].replace("q30", "other")
    rows = [(None, long[0]), (None, long[1]), (None, long[1]), (1, near), (2, long[2]), (2, long[0] + " and more"), (2, "something else"), (3, long[2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in minhash.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, long[0]), (None, long[1]), (2, long[2]), (2, "something else"), (None, None)], key=str)
    got = minhash.near_duplicates(docs, 4, 5).filter("doc_id = 1").first()
    assert got["component_id"] is None and not got["kept"]


def test_tables_find_what_is_similar():
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(300):
        base = rng.integers(1, 1 << 62, 200, dtype=np.uint64)
        other = base.copy()
        other[:16] = rng.integers(1, 1 << 62, 16, dtype=np.uint64)  # similarity 184 / 216
        a, b = minhash.signatures(np.unique(base)), minhash.signatures(np.unique(other))
        hit = [x == y for x, y in zip(a, b, strict=True)]
        found += any(hit[: minhash.HALVES]) and any(hit[minhash.HALVES :])
    assert found == 300


def test_words_do_not_depend_on_the_window(monkeypatch):
    text = "Ab é  漢字\tx\x0b" * 50 + "y" * 300
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "WINDOW", 7)
    assert (minhash.word_hashes(text) == whole).all()


def test_a_worker_lets_go_of_other_operators_tables(spark, monkeypatch):
    import public_tokenizers

    from lavra.llm import bpe, decontam, langid

    spec = bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame([(1, "a b", "pt")], "doc_id long, text string, lang string")
    steps = []
    frame = type(docs)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: steps.append(f) or plain(self, f, *a, **k))
    minhash.described(docs)
    langid.predict(docs, langid.Model([], np.ones(langid.DIM), np.zeros((langid.DIM, 0)), np.zeros(0), 1.0))
    assert len(steps) == 2
    for step in steps:
        bpe.encoder(spec)
        decontam._SEARCHERS["x"] = None
        assert list(step(iter([]))) == [] and not bpe._ENCODERS and not decontam._SEARCHERS
    decontam._SEARCHERS["x"] = None
    one = bpe.encoder(spec)
    assert bpe.encoder(spec) is one and not decontam._SEARCHERS
