"""Python functions over texts with an error channel: an exception fails its row and no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def derived(docs: DataFrame, source: str, target: str, kind: str, *makes: Callable, error: str = "error") -> DataFrame:
    """``docs`` with ``target`` (of type ``kind``) made of ``source`` by ``makes``, one after the other, in one Arrow pass.

    A row that has an ``error``, or a null source, gets null.  If a function raises, the row gets null and
    ``error`` says ``<type>: <message>``; all other rows go on.  ``error`` is added if it is missing; ``target`` may be
    ``source`` itself.
    """
    docs = docs if error in docs.columns else docs.withColumn(error, F.lit(None).cast("string"))
    docs = docs if target in docs.columns else docs.withColumn(target, F.lit(None).cast(kind))
    names = docs.columns
    at, to, err = names.index(source), names.index(target), names.index(error)
    type_ = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, said = [], b.column(err).to_pylist()
            for i, value in enumerate(b.column(at)):
                out = value.as_py() if said[i] is None else None
                try:
                    for make in makes:
                        out = None if out is None else make(out)
                    pa.scalar(out, type_)  # what does not fit the column fails here, with its row
                except Exception as e:
                    out, said[i] = None, f"{type(e).__name__}: {e}"
                made.append(out)
            columns = list(b.columns)
            columns[to], columns[err] = pa.array(made, type_), pa.array(said, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
