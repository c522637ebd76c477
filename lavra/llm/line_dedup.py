"""Line dedup over a corpus: equal lines, and lines one edit apart, keep the earliest.  DataFrame functions only.

Lines one edit apart share a line with one character deleted.  Emitting each line's deletions as hashed keys finds
them, and a filter that loses nothing keeps that affordable for lines of any length: two lines one edit apart agree
outside one of the stretches that a line of the shorter one's length is cut into.  Lines that agree with no other
line outside a half emit nothing; those that do agree are compared outside short stretches of the other half; only in
stretches where two lines agree outside are all deletions emitted, joined, and verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.common import aside, materialized, real_id, row_key


def _lines(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``ord, tie`` of each row, and its text; rows with equal ids stand by a hash of their texts."""
    return docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"), *more)


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _left(line: Column, n: Column) -> Column:
    return F.substring(line, F.lit(1), n)


def _right(line: Column, n: Column, length: Column) -> Column:
    return F.substring(line, length - n + 1, n)


def _half_keys(line: Column, length: Column) -> list[Column]:
    """Keys of both halves, as the shorter line of a pair (or one of equal length) and as the longer one."""
    out = []
    for base in (length, length - 1):
        half = F.floor(base / 2).cast("int")
        out += [F.xxhash64(F.lit(0), base, _left(line, half)), F.xxhash64(F.lit(1), base, _right(line, base - half, length))]
    return out


def first_lines(docs: DataFrame, min_chars: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct line that is not blank: where it stands first, and its halves' keys if long enough.

    Lines are told apart by 128 bits of hash.  Copies meet in a partial aggregate before the shuffle, so a line that
    a third of all rows hold moves once a task.
    """
    at = _lines(docs, id_col, text_col).select("ord", "tie", F.posexplode(_split(F.col("text"))).alias("line_no", "line"))
    length = F.char_length("line")
    keyed = at.filter(F.trim("line") != "").select(
        "ord", "tie", "line_no", F.xxhash64(F.lit(17), "line").alias("h1"), F.xxhash64(F.lit(91), "line").alias("h2"), F.when(length >= min_chars, F.array(*_half_keys(F.col("line"), length))).alias("halves")
    )
    return keyed.groupBy("h1", "h2").agg(F.min(F.struct("ord", "tie", "line_no")).alias("first"), F.first("halves").alias("halves")).select("first.ord", "first.tie", "first.line_no", "halves")


def near_lines(firsts: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ord, tie, line_no`` of distinct lines that have an earlier line one edit away.

    ``firsts`` must be a written table.  No pairs within a group are made: the lines that share a deletion at the same
    place are all one substitution apart, so each needs only the earliest; a line and the longer lines that become it
    by one deletion likewise.
    """
    keys = firsts.filter(F.col("halves").isNotNull()).select("ord", "tie", "line_no", F.posexplode("halves").alias("which", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    wanted = keys.join(shared, "key", "left_semi").groupBy("ord", "tie").agg(F.collect_set(F.struct("line_no", "which")).alias("wanted"))
    texts = _lines(docs, id_col, text_col)
    found = texts.join(wanted, ["ord", "tie"]).select("ord", "tie", F.split("text", "\n", -1).alias("lines"), F.explode("wanted").alias("w"))
    cut = found.select("ord", "tie", F.col("w.line_no").alias("line_no"), F.col("w.which").alias("which"), F.element_at("lines", F.col("w.line_no") + 1).alias("line"))
    length = F.char_length("line")
    cut = cut.withColumn("base", F.when(F.col("which") < 2, length).otherwise(length - 1)).withColumn("half", F.floor(F.col("base") / 2).cast("int"))
    # the half that the lines agree on is known; the edit is in the other one, cut into stretches of about its root
    cut = cut.withColumn("lo", F.when(F.col("which") % 2 == 0, F.col("half")).otherwise(0)).withColumn("hi", F.when(F.col("which") % 2 == 0, F.col("base")).otherwise(F.col("half")))
    cut = cut.withColumn("step", F.greatest(F.ceil(F.sqrt(F.col("hi") - F.col("lo"))).cast("int"), F.lit(8)))
    spans = cut.withColumn("a", F.explode(F.expr("sequence(lo, greatest(hi - 1, lo), step)"))).withColumn("b", F.least(F.col("a") + F.col("step"), F.col("hi")))
    line, base, a, b = F.col("line"), F.col("base"), F.col("a"), F.col("b")
    outside = [_left(line, a), _right(line, base - b, F.char_length("line"))]
    spans = spans.select(
        F.struct("ord", "tie", "line_no").alias("at"),
        (F.col("which") >= 2).alias("longer"),
        F.xxhash64(F.lit(3), base, a, *outside).alias("k1"),
        F.xxhash64(F.lit(4), base, a, *outside).alias("k2"),
        F.substring(line, a + 1, F.char_length("line") - a - (base - b)).alias("middle"),
    )
    spans = spans.dropDuplicates(["at", "longer", "k1", "k2"])
    agreed = spans.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2")
    live = spans.join(agreed, ["k1", "k2"], "left_semi")
    middle = F.col("middle")
    size = F.char_length("middle")
    deleted = lambda i: F.concat(F.substring(middle, F.lit(1), i), F.substring(middle, i + 2, size))
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    # role 0: the line itself; 1: one deletion of a line, at a place; 2: one deletion of a longer line, to be a whole one
    own = F.array(F.struct(F.lit(0).alias("role"), F.xxhash64("k1", "k2", F.lit(-1), "middle").alias("v")))
    swap = F.transform(places, lambda i: F.struct(F.lit(1).alias("role"), F.xxhash64("k1", "k2", i, deleted(i)).alias("v")))
    less = F.transform(places, lambda i: F.struct(F.lit(2).alias("role"), F.xxhash64("k1", "k2", F.lit(-1), deleted(i)).alias("v")))
    variants = live.select("at", "k1", "k2", "middle", F.explode(F.when(F.col("longer"), less).otherwise(F.concat(own, swap))).alias("x")).select("x.v", "x.role", F.struct("at", "k1", "k2", "middle").alias("me"))
    # 192 bits of hash tell variants apart, so a foreign line cannot stand in a partner's place
    by_key = Window.partitionBy("me.k1", "me.k2", "v")
    first_of = lambda test: F.min(F.when(test, F.col("me"))).over(by_key)
    met = variants.select("role", "me", first_of(F.col("role") < 2).alias("plain"), first_of(F.col("role") == 2).alias("long"))
    partner = F.when(F.col("role") == 0, F.col("long")).otherwise(F.col("plain"))
    pairs = met.select("me", partner.alias("other")).filter(F.col("other.at") < F.col("me.at"))
    verified = pairs.filter(F.levenshtein(F.col("me.middle"), F.col("other.middle"), 1) == 1)
    return verified.select("me.at.*").distinct()


def dedup_lines(docs: DataFrame, min_chars: int = 0, near: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` holding only each line's earliest copy, and ``n_lines, n_kept`` added.

    Earliest: least id (null first), then line number.  A line goes if an earlier line of the corpus is equal or, with
    ``near``, one edit (a character put in, left out or changed) away, whether or not that line itself stays.  This holds
    for lines of any length; a caller may except lines of fewer than ``min_chars`` characters.  Blank lines stay.  Null text stays null with no lines; equal rows count as
    one document, each returned; rows with equal ids but other texts stand by a hash; an empty table gives no rows.
    Columns of ``docs`` named ``n_lines`` or ``n_kept``, in any case, are replaced.
    """
    names = docs.columns
    docs, _ = aside(docs, id_col, text_col)
    firsts = materialized(first_lines(docs, min_chars, id_col, text_col), "lines")
    kept = firsts.select("ord", "tie", "line_no")
    if near:
        kept = kept.join(near_lines(firsts, docs, id_col, text_col), ["ord", "tie", "line_no"], "left_anti")
    per_doc = kept.groupBy("ord", "tie").agg(F.collect_list("line_no").alias("_kept"))
    # the same columns as near_lines reads, if docs has no others: Spark then shuffles the texts once for both joins
    own = {n: c for n, c in zip(docs.columns, names, strict=True) if c.lower() not in ("n_lines", "n_kept")}
    keyed = _lines(docs, id_col, text_col, *(F.col(n) for n in own if n not in (id_col, text_col)))
    joined = keyed.join(per_doc, ["ord", "tie"], "left")
    # each value is bound before a lambda uses it: a filter on the result that Spark pushes down must not compute it per line
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    flag = lambda kept: F.array_join(F.transform(kept, lambda k, i: F.concat(F.repeat(F.lit("0"), k - F.when(i > 0, F.get(kept, i - 1)).otherwise(-1) - 1), F.lit("1"))), "")
    flags = lambda kept, lines: F.split(F.rpad(flag(kept), F.size(lines), "0"), "", -1)
    staying = lambda lines, f: F.filter(lines, lambda x, i: (F.trim(x) == "") | (F.get(f, i) == "1"))
    kept_at = F.sort_array(F.coalesce(F.col("_kept"), F.array().cast("array<int>")))
    stays = F.when(F.col("text").isNotNull(), once(_split(F.col("text")), lambda lines: once(kept_at, lambda kept: once(flags(kept, lines), lambda f: staying(lines, f)))))
    out = joined.withColumn("_stays", stays)
    kind = docs.schema[id_col].dataType
    values = {text_col: F.array_join("_stays", "\n"), id_col: real_id(F.col("ord")).cast(kind)}
    return out.select(*(values.get(n, F.col(n)).alias(c) for n, c in own.items()), F.coalesce(F.size(_split(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_stays"), F.lit(0)).cast("long").alias("n_kept"))


def summary(docs: DataFrame) -> DataFrame:
    """Per document: lines, lines kept, and the digest of the text that stays."""
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.greatest("n_kept", F.lit(0)).alias("n_kept"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))
