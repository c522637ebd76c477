"""What several operators share: the shared folder, written intermediate tables, bounded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine (tests, a laptop).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


#: Tables that this Python worker keeps for tasks that follow, by the operator that made them.
_KEPT: list[dict] = []


def kept() -> dict:
    """A place for an operator's tables that outlive a task; ``let_go`` empties it."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go(but: dict | None = None) -> None:
    """Frees the tables of all operators but one, so a worker that serves one operator after the other holds those of one.

    The memory goes back to the system, where the C library can do that; a worker would else keep it for its own.
    """
    others = [x for x in _KEPT if x and x is not but]
    if others:
        for x in others:
            x.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where all intermediate tables of this session lie."""
    return f"{shared_dir(spark)}/lavra-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the session's folder; nothing is created yet."""
    return f"{session_folder(spark)}/{what}-{uuid.uuid4().hex}"


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this session.

    Results are lazy and read them, so this is called when the results are written, not by the operators.
    """
    drop_folder(spark, session_folder(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialized(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``ord, tie``: a row's id (null below any other), and 128 bits of hash of its text.

    Rows with equal ids, or without one, are told apart by their texts; rows equal in both are copies of one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowest = F.lit(-(1 << 63)).cast("long")
    tie = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(91), text).alias("b"))
    # the type that a written table gives back: joins with one then need no cast, and no second shuffle for it
    return [F.coalesce(F.col(id_col).cast("long"), lowest).alias("ord"), tie.cast("struct<a:bigint,b:bigint>").alias("tie")]


def real_id(ord_: Column) -> Column:
    """The id that ``row_key`` made ``ord`` of."""
    return F.when(ord_ != -(1 << 63), ord_)


def aside(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Callable[[DataFrame], list[Column]]]:
    """``docs`` with all columns but id and text under names of no meaning, and what selects them again under their own.

    Spark tells names apart without regard to case, so that is how id and text are found here; whatever else a table
    holds, in whatever spelling, cannot then clash with what an operator adds.
    """
    known = {id_col.lower(): id_col, text_col.lower(): text_col}
    names = [known.get(c.lower(), f"_own_{i}") for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda found: [found[n].alias(c) for n, c in zip(names, docs.columns, strict=True)]
