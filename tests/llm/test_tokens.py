import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lavra.llm import bpe, packing, tokenbin, tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "  a", " a\n", "a\n b", "a \n b", "a   b\n\n c\t\td ", "x<|endoftext|>y <|endoftext|>", "I'm it's", "日本語 12½ ٣٤", "a\x1cb !\x1c", "\n", "é" * 4000 + " a", ". a. b.. '.s", "a b c.", "word " * 3000, "a", "a"]
SCHEMA = "n_tokens string, doc_id long, text string, start int"


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("x", i, t, 1) for i, t in enumerate(TEXTS)] + [("x", 3, "  a", 1), (None, None, "no id", None)]
    return spark.createDataFrame(rows, SCHEMA)


def ids(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'st .,!\n\t\r  é1½漢\x1c　<|>"), max_size=40))
def test_chunks_give_the_ids_of_the_whole_text(text):
    tok = Tokenizer.from_file(PATH)
    enc = bpe.encoder(bpe.read_spec(PATH))
    assert enc.encode([text])[0].tolist() == ids(tok, text)


def test_windows_and_a_full_table_change_nothing(tok, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 31)
    enc = bpe.ChunkEncoder(bpe.read_spec(PATH), cap=20)
    assert [a.tolist() for a in enc.encode(TEXTS)] == [ids(tok, t) for t in TEXTS]


def test_counts(spark, docs, tok):
    got = tokencount.count_tokens(docs, PATH, 100).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(ids(tok, r["text"])), n > 100) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.count_tokens(docs.limit(0), PATH).count() == 0


def test_whole_tokens_are_proven(tok):
    whole = tokencount.whole_tokens(bpe.read_spec(PATH))
    assert len(whole) > 30_000 and all(len(ids(tok, w)) == 1 for w in whole[::97])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**62)), max_size=400), st.integers(1, 6))
def test_simple8b_round_trip(values, times):
    a = np.array(values * times, np.uint64)
    words, first = tokenbin.pack(a)
    assert (tokenbin.unpack(words, first, a.size) == a).all()


def test_token_files(spark, docs, tok, monkeypatch):
    rows = tokenbin.round_trip(docs, PATH).collect()
    got = sorted(map(tuple, rows), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    want = {}
    for r in docs.collect():
        own = np.array([*ids(tok, r["text"]), 0], "<u4")
        want[r["doc_id"]] = (own.size, zlib.crc32(own.tobytes()))
    start = 0
    for doc, at, n, crc in got:
        assert (at, (n, crc)) == (start, want[doc])
        start += n
    assert tokenbin.round_trip(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("share", [packing.SHARE, 2])
def test_packing(spark, docs, tok, monkeypatch, share):
    size = 64
    monkeypatch.setattr(packing, "SHARE", share)
    rows = packing.pack_documents(docs, PATH, size, with_ids=False).collect()
    want = {}
    for r in docs.collect():
        want[r["doc_id"]] = np.array([*ids(tok, r["text"]), 0], "<u4")
    seen, fill = {}, {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for doc, parts in seen.items():
        times = 2 if doc == 3 else 1
        assert sum(p["length"] for p in parts) == times * want[doc].size
        assert all(p["length"] == size for p in parts if p["piece"] > 0)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    assert packing.pack_documents(docs.limit(0), PATH, size).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 40), st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_plan_holds_every_piece_and_is_near_the_bound(size, items):
    from collections import Counter

    items = [min(i, size) for i in items]
    layouts = packing.plan(dict(Counter(items)), size)
    held = Counter()
    for layout, n in layouts:
        assert sum(layout) <= size and n > 0
        for s in layout:
            held[s] += n
    assert held == Counter(items)
    assert sum(n for _, n in layouts) <= -(-11 * -(-sum(items) // size) // 9) + 6


def test_dominance_keeps_the_optimum():
    import itertools
    from collections import Counter

    def best(items, size):
        bound = len(items)

        def go(i, bins):
            nonlocal bound
            if len(bins) >= bound:
                return
            if i == len(items):
                bound = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= size:
                    go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return bound

    rng = np.random.default_rng(3)
    for _ in itertools.repeat(None, 60):
        size = int(rng.integers(6, 20))
        items = sorted(rng.integers(1, size + 1, 8).tolist(), reverse=True)
        fixed, left = packing.reduce_by_dominance(dict(Counter(items)), size)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + (best(rest, size) if rest else 0) == best(items, size)


def test_other_tokenizer_files_encode_whole_texts(tok):
    import json

    spec = json.loads(bpe.read_spec(PATH))
    assert bpe.chunkable(json.dumps(spec))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = json.dumps(spec)
    assert not bpe.chunkable(other)
    want = Tokenizer.from_str(other)
    got = bpe.ChunkEncoder(other).encode(TEXTS)
    assert [a.tolist() for a in got] == [want.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    counter = tokencount.Counter(other, tokencount.whole_tokens(other))
    assert [counter.count(t) for t in TEXTS] == [len(a) for a in got]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'st .,!\n\t\r  é1½漢\x1c　<|>ƛ'"), max_size=40))
def test_pre_tokens_count_like_the_library(text):
    tok = Tokenizer.from_file(PATH)
    spec = bpe.read_spec(PATH)
    _COUNTER.setdefault(0, tokencount.Counter(spec, tokencount.whole_tokens(spec)))
    assert _COUNTER[0].count(text) == len(ids(tok, text))
    assert _COUNTER[0].count(text + "<|endoftext|>'ll" + text) == len(ids(tok, text + "<|endoftext|>'ll" + text))


_COUNTER = {}


def test_equal_ids_are_dealt_apart(spark):
    docs = spark.createDataFrame([(5, f"text {i % 7}") for i in range(400)] + [(None, "x")] * 300, "doc_id long, text string").repartition(6)
    got = sorted(tokenbin.round_trip(docs, PATH).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 300 + [5] * 400
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_chunks_of_many_texts_are_numbered_at_once(tok, monkeypatch):
    texts = [*TEXTS, "Wort*** noch%%% Wörter&&& x's 'll", "a×b÷c", "a\n\nb\n", "\nb", " b", "a\xa0 \tb", "“a” — b。　c"] * 3
    for group in (bpe.GROUP, 20):
        monkeypatch.setattr(bpe, "GROUP", group)
        enc = bpe.ChunkEncoder(bpe.read_spec(PATH))
        got = enc.encode(pa.array(["cut off", *texts]).slice(1))
        assert [a.tolist() for a in got] == [ids(tok, t) for t in texts]
    asked = []
    enc = bpe.ChunkEncoder(bpe.read_spec(PATH))
    monkeypatch.setattr(enc, "merge", lambda new, merge=enc.merge: asked.extend(new) or merge(new))
    enc.encode([f"{w}{m} {w}{m}" for w in ("aa", "bé", "cc") for m in ("", ".", "%%%", "&&&", "***", ",$$$")])
    assert len(asked) == 11  # three words, each with a space before it and without, and five runs of marks; 31 when runs of marks stay on their words
