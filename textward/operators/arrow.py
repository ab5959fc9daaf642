"""The second engine: all spans of a catalog by Python's own patterns over Arrow batches, to check the native one against."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from textward.functions.spans import python

SCHEMA = "key long, type string, start int, end int, value string"


def spans_table(df: DataFrame, key: str, text: str, rows: list[tuple]) -> DataFrame:
    """A row for each match of each pattern."""
    listed = [(r[0], r[1]) for r in rows]

    def run(batches):
        compiled = [(i, re.compile(python(p))) for i, p in listed]
        for batch in batches:
            out = [(k, i, m.start(), m.end(), m.group()) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, p in compiled for m in p.finditer(t)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "type", "start", "end", "value"])

    return df.selectExpr(f"cast({key} as long) key", text).mapInArrow(run, SCHEMA)
