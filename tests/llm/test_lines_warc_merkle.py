import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lavra.llm import line_dedup, merkle, warc
from lavra.llm.common import new_folder


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


BASE = "the quick brown fox jumps over the lazy dog"
LINES = [
    (3, f"{BASE}\n\nshort\n{BASE}s\nüber den wölken muß die freiheit"),
    (1, f"{BASE[:5]}X{BASE[6:]}\nshort\nshoxt\n  \nuber den wölken muß die freiheit"),
    (2, f"{BASE[1:]}\n{BASE}\nüber den wölken muß die freihet\nthe quick brown fox jumps over the lazy cat"),
    (4, None), (5, ""), (6, "\n\n"), (None, f"{BASE} \nshort"), (7, "x" * 5000), (8, "x" * 5001 + "\n" + "x" * 2500 + "y" + "x" * 2500), (9, "a single line\twith a tab" * 3), (9, "a single line\twith a tab" * 3), (10, "y" * 3 + "x" * 4997),
    (11, "a\n1\nshor\n é\nb\n12\n1234"), (12, "\t\nxy\na\n\t\t\n13\n漢"), (9, "other lines\nof the same id"), (None, "other lines without\nan id"), (13, "漢字\nX"), (14, "shore\n  x  "),
]


def brute_lines(rows, least=0):
    seen, first = set(), {}
    order = sorted({(-1 if d is None else d, t) for d, t in rows if t is not None})
    for d, t in order:
        for i, line in enumerate(t.split("\n")):
            if line.replace(" ", "") and line not in seen:
                seen.add(line)
                first[line] = (d, i)
    texts = sorted(first, key=first.get)
    gone = {first[b] for k, b in enumerate(texts) for a in texts[:k] if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= 1 and (lev(a, b) == 1 if len(a) < 300 else close(a, b))}
    keep = set(first.values()) - gone
    return sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.replace(" ", "") or (-1 if d is None else d, i) in keep)) for d, t in rows), key=str)


def close(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def test_line_dedup_is_brute_force(spark):
    docs = spark.createDataFrame([(*r, 7, "s") for r in LINES], "doc_id long, text string, n_kept int, line string")
    got = line_dedup.dedup_lines(docs)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute_lines(LINES)
    assert set(docs.columns) <= set(got.columns)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    assert line_dedup.summary(docs.filter("text is null")).collect()[0]["n_lines"] == 0


def test_line_dedup_on_random_edits(spark):
    import random

    rng = random.Random(5)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randint(18, 60))) + "z" for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            x = rng.choice(pool)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(x) + 1)
                x = rng.choice([x[:i] + "q" + x[i:], x[:i] + x[i + 1 :], x[:i] + rng.choice("ab") + x[i + 1 :]])
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()), key=str) == brute_lines(rows)


PAGES = [(9, "http://long/" + "é%0D\r\n" * 40, "last"), (1, "http://a/\r\nX: y", "<p>é</p>"), (5, "http://b", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "u", None), (2, "v", ""), (None, "w", "only"), (6, "r", "twice"), (6, "r", "twice"), (7, "s", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (8, "l", "é" * 400_000)]


def test_archive(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages).collect()
    top = {}
    for i, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        best = top[h or ""]
        own = best == (-1 if i is None else i)
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if own else "revisit", None if own else best))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_records_and_damage(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_folder(spark, "test")
    warc.write_archive(pages, folder)
    assert sorted((r["page_id"], r["url"]) for r in warc.read_archive(spark, folder).filter("page_id > 0").collect()) == sorted((i, u or "") for i, u, _ in PAGES if i)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in PAGES})
    for r in warc.records(warc.read_archive(spark, folder)).collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert rest.endswith(b"\r\n\r\n") and len(rest) == int(fields["Content-Length"]) + 4
    bad = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "response", "first(body) over (order by response desc) as body")
    other = new_folder(spark, "test")
    bad.write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, other).collect()


TEXTS = [(1, "one two three\nfour five six seven eight nine ten\n\nend"), (2, None), (3, ""), (5, "one two three\nfour five six seven eight nine ten\n\nend"), (5, "one two three\nfour five six seven eight nine ten\n\nend"), (9, "x" * 50_000 + " é漢😀"), (None, "a"), (40, " lead\n  \n" + "w " * 3000), (41, "😀😀😀"), (42, "b\nc")]


def test_edited_texts(spark):
    docs = spark.createDataFrame([(*t, 1) for t in TEXTS], "doc_id long, text string, ord int")
    got = merkle.compare_fingerprints(docs).collect()
    rows = sorted(((-1 if d is None else d, t or "") for d, t in TEXTS), key=lambda r: -r[0])
    want = []
    for k, (d, t) in enumerate(rows):
        n, after = len(t), rows[(k + 1) % len(rows)][1]
        want.append((None if d < 0 else d, n, hashlib.sha256((t[: n - n // 3] + after[: n // 3]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert len({r["fingerprint"] for r in got}) == len({t or "" for _, t in TEXTS})
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all((r["first_edit"] is None) == (r["near_edited"] == 1.0) for r in got if r["fingerprint"][:64] == r["edited_fingerprint"][:64] or r["near_edited"] < 1)
    assert merkle.compare_fingerprints(docs.limit(0)).count() == 0
    assert merkle.compare_fingerprints(docs.limit(1)).count() == 1


def test_branches_locate_an_edit(spark):
    lines = [f"line {i} with some words of its own number {i * 7}" for i in range(60)]
    changed = [*lines[:30], "something new", *lines[31:]]
    row = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = row.select(merkle.edits(F.col("a"), F.col("b")).alias("ab"), merkle.edits(F.col("b"), F.col("a")).alias("ba"), merkle.edits(F.col("a"), F.col("a")).alias("aa"), merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.first_edit(F.col("a"), F.col("b")).alias("at")).first()
    assert r["ab"] == [30] and r["ba"] == [30] and r["aa"] == [] and r["at"] == 30 and 0.9 < r["near"] < 1


def test_far_and_equal_ids_are_neighbours(spark):
    rows = [((1 << 62) if i == 0 else i if i < 40 else None if i < 80 else 7, f"text {i} " * (i % 5 + 1)) for i in range(120)] + [(7, "copy of " * 9)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = merkle.following(docs.select(*merkle.row_key("doc_id", "text"), F.char_length("text").alias("n"))).collect()
    assert sum(r["times"] for r in got) == len(rows) and len(got) == len(set(rows))
    after = {(r["ord"], r["tie"]): (r["next_ord"], r["next_tie"]) for r in got}
    assert set(after) == set(after.values())  # one circle
    assert {b: a for a, b in after.items()} == {(r["ord"], r["tie"]): (r["prev_ord"], r["prev_tie"]) for r in got}
    assert sum(a < b for a, b in after.items()) == 1
    assert len(merkle.compare_fingerprints(docs).collect()) == len(rows)
