"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and repeated or missing ids,
and an empty table; all but the last return the columns they were given, whatever these are named and however that is spelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import decontam, langid, line_dedup, minhash, packing
from lavra.llm.common import aside, materialized, table
from lavra.llm.entries import bpe_path

#: Documents whose best language scores less are rejected.
LEAST_SCORE = 0.5
SEQUENCE = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts among them), and those of no sure language, go.

    Copies are judged alike; ids and labels of a document do not matter to its judgement; an empty table stays empty.
    """
    return langid.accepted(docs, least=LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line's earliest copy stays; documents of which no line stays go; ``n_chars`` follows the text.

    Null and blank texts have no line and go; equal rows are one document, of which every copy keeps the same lines; a
    missing id comes before all others; an empty table stays empty.
    """
    apart, own = aside(docs)
    found = line_dedup.dedup_lines(apart).filter(F.trim(F.translate("text", "\n", " ")) != "")
    size = F.char_length(found["text"])
    kept = zip(own(found), docs.schema, strict=True)
    return found.select(*(size.cast(f.dataType).alias(f.name) if f.name.lower() == "n_chars" else c for c, f in kept))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more) stays, that of the least id.

    Of rows equal in id and text one stays; rows that only share an id, or have none, are documents of their own; texts
    without words stay; an empty table stays empty.
    """
    return minhash.deduplicated(docs, 4, 5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark passages go.

    Null and empty texts have no words and stay; repeated rows are judged each; without a benchmark all rows stay.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, packed into sequences.

    A null text is empty (one token, the end); longer documents than a sequence are cut; repeated rows are packed each; an
    empty table gives no rows.
    """
    return packing.pack_documents(docs, bpe_path(), SEQUENCE)


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]

#: Language identification and packing cannot be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each stage's rows written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
