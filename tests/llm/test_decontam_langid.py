import re
import zlib

from lavra.llm import decontam, langid, quality

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for item, other in items:
            o = words(other)
            m = min(size, len(o))
            for i in range(len(o) - m + 1 if m else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == o[i : i + m]:
                        hit |= set(range(j, j + m))
                        own.add(str(item))
        out.append((doc, len(w), len(hit), len(own), decontam.items_digest(list(own)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = "w1 w2 w3 " * 40_000
DOCS = [(20, LONG + "b c d " + LONG), (None, "other b c d text without an id"), (6, "of id 6 b c d too"), (1, "A b c d e f g, H i"), (2, None), (3, ""), (4, "x " * 500 + "b c d"), (5, "Éa ÉA b É"), (6, "b c d b c d b c d"), (6, "b c d b c d b c d"), (None, "b C d"), (7, "z y"), (8, "solo a1 b2"), (9, "!! ,,")]
ITEMS = [(10, "b c d e"), (9, "B C D"), (9, "B C D"), (2, "Éa b"), (3, None), (4, " .. "), (5, "solo"), (11, "d b c d b")]


def test_contamination_is_brute_force(spark):
    docs = spark.createDataFrame([(*d, "s", 1, None) for d in DOCS], "doc_id long, text string, items string, n_words int, _ord int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (decontam.BLOCK_BYTES, 8):
        got = decontam.contamination(docs, bench, 3, 20, limit).collect()
        assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS, 3)
        kept = decontam.clean(docs, bench, 3, 20, limit).collect()
        assert sorted((tuple(r)[:2] for r in kept), key=str) == sorted((d for d in DOCS if not brute([d], ITEMS, 3)[0][5]), key=str)
        assert kept[0].asDict().keys() == set(docs.columns)
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "b c d e"), (2, "x y z"), (3, "p q r")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "b c d"), (7, "x y z"), (None, "x y z")], "item_id long, text string")
    for limit in (decontam.BLOCK_BYTES, 4):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(docs, bench, 3, 20, limit).collect()}
        assert got == {1: (3, 0, decontam.items_digest([]), True), 2: (3, 1, decontam.items_digest(["7"]), True), 3: (0, 0, decontam.items_digest([]), False)}
        assert [r["doc_id"] for r in decontam.clean(docs, bench, 3, 20, limit).collect()] == [3]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(None, "the cat", None, 1), (1, None, "en", 1), (2, "123 !!", "en", 1), (3, "the cat and the dog", "en", 1), (4, "el gato y el perro", "es", 1), (5, "漢字 " * 10, None, 1), (5, "漢字 " * 10, None, 1), (6, "a" * 3_000_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2)} == {"und"}
    assert langid.identify(docs.withColumn("lang", docs.lang.substr(100, 0)).filter("false")).count() == 0
    none = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(none).collect()} == {"und"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and not {1, 2} & {r["doc_id"] for r in kept.collect()}


def test_counts_do_not_depend_on_case_or_marks():
    assert (langid.count("Ab, cD!") == langid.count("aB  cd?")).all()
    assert langid.count(" 12 ") is None


def test_long_items_are_cut_between_windows():
    words = [f"w{i}" for i in range(50)]
    rows = type("Rows", (), {"select": lambda self, *_: self, "filter": lambda self, _: self, "toLocalIterator": lambda self: iter([{"item_id": "1", "text": " ".join(words)}, {"item_id": "2", "text": "a b"}, {"item_id": None, "text": "c"}])})()
    for limit in (1, 9, 30, 1000):
        lists = list(decontam._pieces(rows, "item_id", "text", 5, limit))
        seen = {tuple(x.decode() for x in w[i : i + 5]) for part in lists for item, w in part if item == "1" for i in range(len(w) - 4)}
        assert seen == {tuple(words[i : i + 5]) for i in range(46)}
        assert [w for part in lists for item, w in part if item is None] == [[b"c"]]
        assert sum(item == "2" for part in lists for item, _ in part) == 1


def test_windows_lose_no_ngram(monkeypatch):
    text = "Ab, é漢 1x " * 40
    whole = langid.count(text), quality.text_features(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(langid, "WINDOW", size)
        monkeypatch.setattr(quality, "WINDOW", size)
        assert (langid.count(text) == whole[0]).all()
        assert all((a == b).all() for a, b in zip(quality.text_features(text), whole[1], strict=True))


def test_copies_do_not_enlarge_the_sample(spark):
    docs = spark.createDataFrame([(7, "the cat and the dog", "en")] * 3000 + [(i, f"el gato y el perro {i}", "es") for i in range(50)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(docs, 5).collect()} <= {"en", "es", "und"}
