"""What the operators share: the folder all machines see, written tables, column checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The separators of the contracts' words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local master gets a temporary one, a cluster an error."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="textward-")
    return _local[sc.applicationId]


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/textward/{label}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends there and lost executors cost nothing."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def drop(*written: DataFrame) -> None:
    """Removes tables of :func:`materialize` that no later plan reads."""
    for df in written:
        delete(df.sparkSession, df.written)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written within go when it ends, but for those of ``keep``: ``keep(df, label)`` writes one, which may read the others, ``keep(written)`` spares one."""
    own: list[str] = []
    _scopes.append(own)

    def keep(df: DataFrame, label: str | None = None) -> DataFrame:
        out = materialize(df, label) if label else df
        own.remove(out.written)
        if len(_scopes) > 1:
            _scopes[-2].append(out.written)
        return out

    try:
        yield keep
    finally:
        _scopes.remove(own)
        for path in own:
            delete(spark, path)
        collect_garbage(spark)


def numbered(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """``df`` with a running number from 0 in the keys' order: range-partitioned, counted by partition, no window over all rows."""
    at, part = unused(df, "at", "part")
    rows = df.repartitionByRange(*map(quoted, keys)).sortWithinPartitions(*map(quoted, keys)).withColumn(at, F.monotonically_increasing_id())
    rows = materialize(rows.withColumn(part, F.shiftright(at, 33)), "numbered")
    # a row for each partition
    sizes = rows.groupBy(part).agg(F.count("*").alias(name))
    before = sizes.select(part, (F.sum(name).over(W.orderBy(part)) - F.col(name)).alias(name))
    return rows.join(F.broadcast(before), part).withColumn(name, F.col(name) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part)


def collect_garbage(spark: SparkSession) -> None:
    """Lets the driver forget what no plan holds any more: Spark then drops its broadcasts and shuffle files on all executors.

    Otherwise that waits until the driver's heap is full; an operator of many jobs would fill it with plans that are done.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    tidy()


def few(written: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written narrow table, to be broadcast if its rows are no more than this, else to be joined by a shuffle."""
    return F.broadcast(written) if written.count() <= rows else written


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of :func:`new_dir` that no later plan reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until ``df`` has no column of that name."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in there:
            name += "_"
        there.add(name)
        out.append(name)
    return out


def own(df: DataFrame) -> list:
    """All columns of ``df`` as they are, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast: extra columns, whatever their names, never reach an operator."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()))


def words(text):
    """The contracts' words of a text column; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files have fewer splits than there are: for work that costs CPU."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_held: dict[str, object] = {}


def only(name: str, make=lambda: True):
    """What ``make`` gives, kept by a Python worker from task to task until another name is asked for.

    Workers serve one stage after another; so what one has remembered doesn't stand in the next one's way.
    """
    if name not in _held:
        _held.clear()
        tidy()
        _held[name] = make()
    return _held[name]


def tidy() -> None:
    """Gives memory that isn't used back to the system: Arrow's, Python's and, where there is glibc, the C library's."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batches(spark: SparkSession, rows: int):
    """What is written within goes to Python in Arrow batches of so many rows at most: for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_in(uri: str):
    """A random-access file on any file system that pyarrow knows."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


class replaced:
    """``with replaced(uri) as f``: f is written under an attempt's own name and moved into place at the end.

    A task that runs twice leaves one whole file, whichever attempt ends last.
    """

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.own)
        return self.file

    def __exit__(self, kind, *_):
        self.file.close()
        if kind is None:
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)
