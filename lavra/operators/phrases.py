"""Phrases of a fixed list found in texts, all in one pass, within the row.

A text becomes an array of words and the signs between them.  Only where a word begins some phrase are the words from there on,
in every length that phrases have, looked up in the list (a hash set); no pattern is tried at other places.  No shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions import rx
from lavra.functions.lines import let

#: A word, one blank, or signs; white space is one blank already.
TOKEN = r"\w+| |[^\w ]+"
#: The list is part of each task's code, so it is bounded.
MOST = 10_000


def hits(text: Column, phrases: list[str]) -> Column:
    """``array<struct<at, until, phrase>>``: where phrases stand, by token, in order; each word beginning one gives its longest first.

    Letters match in any case, white space of any kind is one blank, and phrases begin and end at word boundaries.
    """
    listed = sorted({p.lower() for p in phrases})
    if len(listed) > MOST:
        raise ValueError(f"{len(listed)} phrases; a list may have {MOST}")
    parts = {p: re.findall(TOKEN, p) for p in listed}
    begins, sizes = sorted({t[0] for t in parts.values()}), sorted({len(t) for t in parts.values()}, reverse=True)

    def look(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(begins), i)), lambda i: i.isNotNull())
        at = lambda i: F.array(*(F.struct(i.alias("at"), (i + k).alias("until"), F.array_join(F.slice(tokens, i + 1, k), "").alias("phrase")) for k in sizes))
        return F.filter(F.flatten(F.transform(starts, at)), lambda h: (h["until"] <= n) & h["phrase"].isin(listed))

    plain = F.lower(rx.sub(F.coalesce(text, F.lit("")), r"\s+", " "))
    return let(rx.all_of(plain, TOKEN), look)


def counts(found: Column, kinds: list[list[str]]) -> Column:
    """How often each kind's phrases occur among hits: from left to right, none that begins inside the one before."""

    def count(phrases: list[str]) -> Column:
        own = [p.lower() for p in phrases]
        step = lambda acc, h: F.when(h["at"] >= acc["until"], F.struct((acc["n"] + 1).alias("n"), h["until"].alias("until"))).otherwise(acc)
        return F.aggregate(F.filter(found, lambda h: h["phrase"].isin(own)), F.struct(F.lit(0).alias("n"), F.lit(0).alias("until")), step)["n"]

    return F.array(*map(count, kinds))
