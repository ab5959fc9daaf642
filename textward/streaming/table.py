"""A stream over a table's files, drained into another table: stream and batch give the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from textward.streaming.wiring import scan_stream


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one for a local master without one."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return f"{told or 'file://' + tempfile.mkdtemp(prefix='textward-')}/stream-{uuid.uuid4().hex}"


def drained(spark: SparkSession, path: str, text: str = "text", direction: str = "input") -> DataFrame:
    """Reads the files at ``path`` as a stream, scans each row, writes all to a table and returns it."""
    at = folder(spark)
    # a single file is a stream of its own name in its folder
    head, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isDirectory()
    stream = reader.parquet(path) if is_dir else reader.option("pathGlobFilter", name).parquet(head)
    query = scan_stream(stream, text, direction).writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(query_schema(spark, schema, text, direction)).parquet(f"{at}/rows")


def query_schema(spark: SparkSession, schema, text: str, direction: str):
    return scan_stream(spark.createDataFrame([], schema), text, direction).schema
