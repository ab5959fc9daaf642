"""Configurations as of a time: each row with the last version of its tenant's configuration before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.functions.columns import col, unused


def as_of(rows: DataFrame, versions: DataFrame, key: str, ts: str, value: str = "config", since: str = "since", span: int = 86_400, out: str | None = None) -> DataFrame:
    """``rows`` with the ``value`` of the last of ``versions`` (key, since, value) whose time isn't after ``ts``; null before the first.

    Rows and versions are sorted together, and the last version is carried on. A tenant is parted into spans of time,
    each sorted by itself (``span`` seconds); what a span begins with comes from the last versions of the spans before, a row for each. So a
    tenant with a third of all rows is many groups, and no row is matched with more than one version. Of versions of one
    time the largest value counts. Rows without a tenant or a time have a null, and stay. All columns of ``rows`` stay; one
    named as ``out`` is replaced.
    """
    out = out or value
    k, t, v, kind, part, start, whole = unused(rows, "k", "t", "v", "kind", "part", "start", "row")
    of = lambda name: F.floor(F.unix_seconds(col(name).cast("timestamp")) / F.lit(span))
    here = rows.select(F.struct(*[col(c) for c in rows.columns]).alias(whole), col(key).alias(k), col(ts).alias(t), of(ts).alias(part), F.lit(None).cast(versions.schema[value].dataType).alias(v), F.lit(1).alias(kind))
    known = versions.filter(col(key).isNotNull() & col(since).isNotNull()).groupBy(col(key).alias(k), col(since).alias(t)).agg(F.max(col(value)).alias(v))
    told = known.select(F.lit(None).cast(here.schema[whole].dataType).alias(whole), k, t, of(t).alias(part), v, F.lit(0).alias(kind))
    # a row for each span that has a version: what the spans after it begin with
    last = told.groupBy(k, part).agg(F.max_by(v, t).alias(start))
    both = here.unionByName(told)
    spans = both.select(k, part).distinct().join(last, [k, part], "left")
    begin = spans.withColumn(start, F.last(start, ignorenulls=True).over(W.partitionBy(k).orderBy(part).rowsBetween(W.unboundedPreceding, -1)))
    carried = F.last(v, ignorenulls=True).over(W.partitionBy(k, part).orderBy(t, kind).rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn(v, carried).filter(F.col(kind) == 1)
    joined = found.join(begin.filter(F.col(start).isNotNull()), [k, part], "left")
    names = [c for c in rows.columns if c.lower() != out.lower()]
    return joined.select(*(F.col(whole)[c].alias(c) for c in names), F.coalesce(v, start).alias(out))
