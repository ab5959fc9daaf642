"""A judge at scale: equal prompts are asked once, answers are stored as they come, calls a second are bounded, failures wait for the next run."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.columns import col, others, unused
from textward.operators.models import once

STORED = "prompt_key string, answer string, error string, asked_at double"


def key_of(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()


def put(store: str, rows: list[tuple]) -> None:
    """A file of answers, whole or not at all."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(store)
    where.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64()]
    table = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in STORED.split(", ")])
    with where.open_output_stream(f"{path}/_{name}.tmp") as f:
        pq.write_table(table, f)
    where.move(f"{path}/_{name}.tmp", f"{path}/{name}.parquet")


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_key, answer): what the store knows, one answer for each prompt."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(STORED).parquet(store) if there else spark.createDataFrame([], STORED)
    return rows.filter("answer is not null").groupBy("prompt_key").agg(F.min_by("answer", "asked_at").alias("answer"))


def ask_all(prompts: DataFrame, name: str, load: Callable[[], Callable[[str], str]], store: str, prompt: str = "prompt", per_second: float | None = None, tasks: int = 8, tries: int = 3, wait: float = 1.0, chunk: int = 20) -> dict[str, int]:
    """Asks what the store has no answer to; how many prompts were asked, and how many of them failed.

    Equal prompts are asked once, whatever the rows that have them; null ones never. Answers are written in files of
    ``chunk``, each whole or not at all, so a run that is lost, or a task that is tried again, asks at most so many again for
    each task, and two runs can share a store. A call that fails ``tries`` times is stored with its error and asked again by
    the next run. The tasks share ``per_second`` calls. No answer passes through the driver.
    """
    wanted = prompts.select(col(prompt).cast("string").alias("p")).filter("p is not null").distinct().withColumn("prompt_key", F.sha2("p", 256))
    todo = wanted.join(stored(prompts.sparkSession, store).select("prompt_key"), "prompt_key", "left_anti").repartition(tasks, "prompt_key")
    pause = tasks / per_second if per_second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, rows, asked, failed, free = once(name, load), [], 0, 0, 0.0
        try:
            for batch in batches:
                for p, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    answer = error = None
                    for k in range(tries):
                        now = time.monotonic()
                        time.sleep(max(0.0, free - now))
                        free = max(free, now) + pause
                        try:
                            answer, error = ask(p), None
                            break
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"
                            if k + 1 < tries:
                                time.sleep(min(10.0, wait * 2**k))
                    if answer is None and error is None:
                        error = "no answer"
                    rows.append((key, answer, error, time.time()))
                    asked, failed = asked + 1, failed + (answer is None)
                    if len(rows) >= chunk:
                        put(store, rows)
                        rows = []
        finally:  # what was answered is kept, also where the task ends here
            if rows:
                put(store, rows)
        yield pa.RecordBatch.from_pydict({"asked": [asked], "failed": [failed]})

    n = todo.select("p", "prompt_key").mapInArrow(run, "asked long, failed long").agg(F.coalesce(F.sum("asked"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()
    return {"asked": n[0], "failed": n[1]}


def with_answers(rows: DataFrame, store: str, prompt: str = "prompt", out: str = "judge") -> DataFrame:
    """Adds the stored answer to each row's prompt; null where there is none. A column named as ``out`` is replaced."""
    (key,) = unused(rows, "prompt_key")
    answers = stored(rows.sparkSession, store).select(F.col("prompt_key").alias(key), F.col("answer").alias(out))
    keep = others(rows, out)
    return rows.select(*keep, F.sha2(col(prompt).cast("string"), 256).alias(key)).join(answers, key, "left").drop(key)
