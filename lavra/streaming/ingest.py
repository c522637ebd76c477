"""Files that arrive in a folder, converted by the same plan in micro-batches."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lavra.plans.options import Options
from lavra.plans.pipeline import convert
from lavra.sources.files import extract


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Starts a query that appends results of new files to the Parquet table ``out`` and stops when all are read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).load(path)

    def batch(rows, number: int) -> None:
        name = F.regexp_extract("path", "([^/]*)$", 1)
        files = rows.select(F.xxhash64("path").alias("doc_id"), "path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), "content")
        convert(extract(files), options).write.mode("append").parquet(out)

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
