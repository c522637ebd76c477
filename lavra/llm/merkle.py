"""Document fingerprints: Merkle trees over sections, paragraphs and groups of words.  DataFrame functions only.

A paragraph is a line; its leaves are groups of at most ``WORDS`` words, counted from the paragraph's start.  A
section ends behind a paragraph whose own hash says so (one in eight), so that an edit moves no far boundary.  Equal
roots mean equal texts; where roots differ, differing sections, paragraphs and leaves show where.

The string is ``root|section;section;...`` with ``root`` 64 hexadecimal digits, a section 8 digits, ``:`` and its
paragraphs, each the first six digits of its leaves' hashes and ``,``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.common import materialized, real_id, row_key

WORDS = 6
LEAF = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    groups = F.lit(f"(?: *[^ ]+){{1,{WORDS}}} *| +")
    leaves = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, groups, F.lit(0)), lambda g: F.md5(g.cast("binary"))))

    def paragraph(p: Column) -> Column:
        short = F.array_join(F.transform(p, lambda x: F.substring(x, 1, LEAF)), "")
        return let(F.md5(F.array_join(p, "").cast("binary")), lambda node: F.concat(node, F.lit("="), short, F.when(F.substring(node, 1, 1).isin("0", "1"), ";").otherwise(",")))

    sections = F.filter(F.split(F.array_join(F.transform(leaves, paragraph), ""), ";", -1), lambda s: s != "")

    def tree(found: Column) -> Column:
        nodes = F.transform(found, lambda s: F.md5(F.regexp_replace(s, "=[0-9a-f]*", "").cast("binary")))
        body = lambda n: F.array_join(F.zip_with(found, n, lambda s, x: F.concat(F.substring(x, 1, 8), F.lit(":"), F.regexp_replace(s, "[0-9a-f]{32}=", ""))), ";")
        return let(nodes, lambda n: F.concat(F.sha2(F.array_join(n, "").cast("binary"), 256), F.lit("|"), body(n)))

    return let(sections, tree)


def _sections(print_: Column) -> Column:
    return F.split(F.substring_index(print_, "|", -1), ";", -1)


def _leaves(sections: Column) -> Column:
    """All leaves of some sections."""
    return F.regexp_extract_all(F.regexp_replace(F.array_join(sections, ""), "[0-9a-f]{8}:", ""), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two fingerprints' leaves, branch by branch; 1 for equal roots.

    A section that both trees hold counts with all its leaves and is not opened; of the other sections the distinct leaves
    are compared.  Two empty texts have equal roots.
    """

    def dice(x: Column, y: Column) -> Column:
        same = F.size(_leaves(F.array_intersect(x, y)))
        mine = lambda p, q: F.array_distinct(_leaves(F.array_except(p, q)))
        opened = lambda p, q: 2.0 * (same + F.size(F.array_intersect(p, q))) / F.greatest(2 * same + F.size(p) + F.size(q), F.lit(1))
        return let(mine(x, y), lambda p: let(mine(y, x), lambda q: opened(p, q)))

    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(let(_sections(a), lambda x: let(_sections(b), lambda y: dice(x, y))))


def _paragraphs(print_: Column) -> Column:
    """The paragraphs' leaves, in order."""
    return F.split(F.regexp_replace(F.regexp_replace(F.substring_index(print_, "|", -1), "[0-9a-f]{8}:", ""), ",$", ""), "[,;]", -1)


def first_edit(a: Column, b: Column) -> Column:
    """Number (from 0) of the first paragraph whose branches differ; null for equal roots."""
    differing = lambda p, q: F.get(F.filter(F.transform(F.zip_with(p, q, lambda x, y: x.eqNullSafe(y)), lambda same, i: F.when(~same, i)), lambda i: i.isNotNull()), 0)
    return F.when(F.substring(a, 1, 64) != F.substring(b, 1, 64), differing(_paragraphs(a), _paragraphs(b)))


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` whose branch ``b`` does not hold anywhere."""
    foreign = lambda p, q: let(F.array_except(p, q), lambda lost: F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(lost, x), i)), lambda i: i.isNotNull()))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(foreign(_paragraphs(a), _paragraphs(b)))


def following(docs: DataFrame) -> DataFrame:
    """``ord, tie, n, times, next_ord, next_tie, prev_n`` for each distinct ``ord, tie`` of ``docs`` (with ``n``), in descending order.

    After the last comes the first; ``prev_n`` is the ``n`` of the row that this one follows.  Only keys move.  Spark deals
    them by measured ranges of the whole key, which is distinct, so no id is hot and a far id takes no room; each range
    is one window, and the ranges' ends, a few numbers each, are put in order by one more.
    """
    keys = docs.groupBy("ord", "tie").agg(F.min("n").alias("n"), F.count("*").alias("times"))
    key = [F.col("ord").desc(), F.col("tie").desc()]
    dealt = materialized(keys.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*key)
    me = F.struct("ord", "tie", "n")
    ends = dealt.groupBy("part").agg(F.max(me).alias("first"), F.min(me).alias("last"))
    across = Window.orderBy("part")  # a row for each range
    whole = Window.partitionBy()
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(across), F.max("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(across), F.min("last").over(whole)).alias("before"),
    )
    seen = dealt.withColumn("next", F.lead(me).over(inside)).withColumn("prev", F.lag(me).over(inside)).join(ends, "part")
    after, before = F.coalesce("next", "after"), F.coalesce("prev", "before")
    return seen.select("ord", "tie", "n", "times", after["ord"].alias("next_ord"), after["tie"].alias("next_tie"), before["ord"].alias("prev_ord"), before["tie"].alias("prev_tie"), before["n"].alias("prev_n"))


def compare_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how like they and the next document's are.

    The edited text has its last third of code points replaced by the first as many of the next document, by descending
    id (rows without an id last, rows with equal ids by a hash of their texts; after the last comes the first).
    ``first_edit`` is the first paragraph whose branches differ.  Null text is empty, whose likeness to another empty text
    is 1; a single row is its own next; repeated rows follow one another; texts of any length are one tree; an empty table
    gives no rows.  Columns other than id and text are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(*row_key(id_col, text_col), text.alias("text"))
    order = materialized(following(slim.select("ord", "tie", F.char_length("text").cast("long").alias("n"))), "neighbours")
    # one row for each distinct document: copies meet before the shuffle
    texts = slim.groupBy("ord", "tie").agg(F.first("text").alias("text"))
    third = lambda n: F.floor(n / 3).cast("int")
    # what a document gives to the one before it; Spark shuffles the texts once for both joins
    given = texts.join(order, ["ord", "tie"]).select(F.col("prev_ord").alias("ord"), F.col("prev_tie").alias("tie"), F.substring("text", F.lit(1), third(F.col("prev_n"))).alias("head"), fingerprint(F.col("text")).alias("next_fingerprint"))
    met = texts.join(order.select("ord", "tie", "n", "times"), ["ord", "tie"]).join(given, ["ord", "tie"]).withColumn("fingerprint", fingerprint(F.col("text")))
    # all copies of a document but one are followed by a copy
    copy = F.struct((F.col("times") - 1).alias("times"), F.substring("text", F.lit(1), third(F.col("n"))).alias("head"), F.col("fingerprint").alias("next_fingerprint"))
    last = F.struct(F.lit(1).cast("long").alias("times"), "head", "next_fingerprint")
    each = met.select("ord", "n", "text", "fingerprint", F.explode(F.filter(F.array(copy, last), lambda x: x["times"] > 0)).alias("x"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - third(F.col("n"))).cast("int")), F.col("x.head"))
    shown = each.select(real_id(F.col("ord")).alias("doc_id"), F.col("n").alias("n_chars"), edited.alias("edited"), "fingerprint", "x.next_fingerprint", "x.times")
    both = shown.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", "times")
    like = both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"), "times")
    return like.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")
