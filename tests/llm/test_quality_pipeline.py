import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lavra.llm import langid, line_dedup, quality

from .test_decontam_langid import brute as brute_hits
from .test_lines_warc_merkle import brute_lines
from .test_minhash import brute as brute_near


def test_quality_of_documents_that_were_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    got = quality.scores(docs, half)
    assert got.count() == docs.count()
    rows = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_quality_of_odd_rows(spark):
    rows = [(1, None, None, None, 2), (1, None, None, None, 2), (None, "a b", "s", "en", None), (3, "x" * 2_000_000, "s", "", 7), (4, "", "s", "en", 0)]
    docs = spark.createDataFrame([(*r, "y", 0.5) for r in rows], "doc_id long, text string, source string, lang string, id long, y string, keep double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        got = quality.scores(docs, known).collect()
        assert len(got) == 5 and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.scores(docs.limit(0), labels).count() == 0


def test_views_exchange_labels():
    rng = random.Random(2)
    y, text, meta = [], [], []
    for i in range(600):
        good = rng.random() < 0.5
        y.append(int(good) if i < 40 else -1)
        text.append(quality.text_features("plain words here " * 5 if good else "LOUD!! NOISE!! " * 5))
        meta.append(quality.meta_features({"source": ("a" if good else "b") + str(rng.randrange(3))}))
    tw, mw, given = quality.cotrain(text, meta, np.array(y))
    assert given > 100
    assert quality.logits(text[:1], tw)[0] * (1 if y[0] else -1) > 0


def test_every_unlabelled_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 0)
    rng = random.Random(3)
    text = lambda good: " ".join(rng.choice(("plain", "words", "here", "now")) if good else rng.choice(("LOUD!!", "NOISE??", "$$$")) for _ in range(12))
    rows = [(i, text(i % 2), f"{'ab'[i % 2]}{i % 5}", "en", 60) for i in range(12_000)]
    rows += [(12_000 + i, text(i % 2), ("rare-bad", "rare-good")[i % 2], "en", 60) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = {(r["source"], r["meta_score"] > 0.5) for r in quality.scores(docs, labels).join(docs.filter("source like 'rare%'"), "doc_id").collect()}
    assert got == {("rare-bad", False), ("rare-good", True)}


VOCAB = [f"{a}{b}{c}" for a in ("the", "and", "with", "ing") for b in ("er", "on", "at", "es") for c in ("ly", "ed", "th", "")]


def corpus(seed=9):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n)) + "."
    shared = [line(12) for _ in range(4)]
    bench = [(i, line(15)) for i in range(3)]
    rows = []
    for d in range(60):
        lines = [line(rng.randint(4, 20)) for _ in range(rng.randint(1, 4))] + [rng.choice(shared)] * (d % 3 == 0)
        if d % 7 == 0:
            lines.append(bench[d % 3][1])
        rows.append([d, "\n".join(lines), "en"])
    for d in range(60, 72):  # near copies of one long line
        w = rows[d % 3][1].replace("\n", " ").split() * 3
        w[d % len(w)] = "changed"
        rows.append([d, " ".join(w), "en"])
    rows += [[72, "12 34 !!", "en"], [73, None, "en"], [74, "", None], [75, rows[5][1], "en"]]
    rows += [[100 + i, " ".join(rng.choice(("dieß", "unter", "schön", "wäre", "ißt")) for _ in range(30 + i)), "de"] for i in range(20)]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], bench


def test_stages_keep_odd_rows_apart(spark, tmp_path):
    """Rows without an id, or with one that others share, are documents of their own in every stage; an empty table passes."""
    line = lambda w, n: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)} and the" for i in range(n))
    rows = [(None, line("p", 40), "en", None, None), (None, line("q", 40), None, "s", 1), (7, line("r", 40), "en", "s", 1), (7, line("s", 40), "en", "s", 1), (8, line("r", 40), "en", "s", 1), (9, None, None, None, None), (10, "", "en", "s", 0)]
    spark.createDataFrame([(1, "z y x w v u t")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _tie int")
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {(d, t) for d, t, *_ in rows} - {(8, rows[4][1])}
    stay = corpus_pipeline.dedup_lines(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in stay.filter("doc_id is not null").collect()) == [(7, rows[2][1]), (7, rows[3][1])] and stay.count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_columns_that_clash_in_another_case_pass_through(spark, tmp_path):
    names = ["Score", "LANG_PRED", "Spans", "N_words", "N_Lines", "n_KEPT", "_own_4", "_Tie", "_ORD", "a.b"]
    text = " ".join(f"the word{i} and that" for i in range(30))
    rows = [(i, text + f" {i}\nline {i}", "en", "s", 5, *range(len(names))) for i in range(3)]
    docs = spark.createDataFrame(rows, ["Doc_Id", "text", "lang", "source", "n_chars", *names])
    spark.createDataFrame([(1, "z y x w v u t")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.dtypes == docs.dtypes, name
        found = got.collect()
        assert found and all(tuple(r)[5:] == tuple(range(len(names))) for r in found)
    assert line_dedup.dedup_lines(docs).columns[-2:] == ["n_lines", "n_kept"]


def test_pipeline_is_brute_force(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    kept = [(r["doc_id"], r["text"]) for r in langid.accepted(docs).select("doc_id", "text").collect()]
    assert {d for d, t, *_ in rows if t and any(c.isalpha() for c in t)} == {d for d, _ in kept}
    kept = [(d, t) for d, t in brute_lines(kept) if t.replace("\n", " ").strip(" ")]
    stay = {r[0] for r in brute_near(kept, 4, 5) if r[3]}
    kept = [(d, t) for d, t in kept if d in stay]
    bad = {r[0] for r in brute_hits(kept, bench, 13) if r[5]}
    assert bad
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in kept:
        if d not in bad:
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
            want[d] = (ids.size, zlib.crc32(ids.tobytes()))
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
