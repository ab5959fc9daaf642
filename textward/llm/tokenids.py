"""Token ids as binary files: patched frame-of-reference blocks, written in doc_id order and read back."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .encode import encoded
from .pfor import Reader, Writer

MANIFEST = "part long, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Bytes of the table, as the plan estimates them, for each file at most.
FILE = 256 << 20


def files_for(rows: DataFrame) -> int | None:
    """How many files a table needs beyond what the session's shuffles have; None if those do, or its size isn't known."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    need = -(-size // FILE)
    return need if size < 1 << 60 and need > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def write(docs: DataFrame, out_dir: str, vocabulary: str, end_id: int | None = 1, parts: int | None = None) -> DataFrame:
    """Encodes each whole ``text`` and writes one file for each range of ``doc_id``; returns the manifest of the files.

    Null and empty texts give no ids but ``end_id`` (null: none is appended). Rows are ordered by doc_id, nulls first,
    then by text; equal rows are kept, each as a document. An empty table gives no file. Other columns are ignored.
    Equal doc_ids spread over ranges by their text's hash, so a doc_id fills no task; only rows that are equal in both lie in
    one range. ``parts`` is how many files there are; if not told, as many as shuffles have, or one for each FILE bytes if
    those are more. A range's file is written under an attempt's own name and moved into place, so a task may run again.
    """
    rows = common.columns(docs, doc_id="long", text="string").withColumn("_h", F.xxhash64("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    parts = parts or files_for(docs)
    rows = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def save(batches):
        part, n_docs = TaskContext.get().partitionId(), 0
        path = f"{out_dir}/ids-{part:07d}.pfor"
        source = encoded(batches, vocabulary)
        if first := next(source, None):
            with common.replaced(path) as f:
                w = Writer(f)
                while first:
                    for doc_id, ids in zip(*first, strict=True):
                        w.add(doc_id, ids + end)
                        n_docs += 1
                    first = next(source, None)
                w.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [w.n]})

    return common.materialize(rows.sortWithinPartitions(*keys, "text").select("doc_id", "text").mapInArrow(save, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """For each document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # one row for each file, not for each document: the running sum over files is small
    files = manifest.withColumn("base", F.sum("n_ids").over(W.orderBy("part")) - F.col("n_ids")).select("path", "base", "part")

    def load(batches):
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                rows: list[tuple] = []
                with common.open_in(path) as f:
                    for doc_id, start, ids in Reader(f).docs():
                        rows.append((doc_id, base + start, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) == 10_000:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return files.repartition(n, "part").select("path", "base").mapInArrow(load, READ)
