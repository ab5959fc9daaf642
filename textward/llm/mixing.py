"""Mixing sources along a curriculum: weights that change over training time are integrated, demand inverted into positions.

A source's schedule is a line of knots (at, weight), ``at`` from 0 to 1; between knots the weight is linear. Its integral
is the source's weight in all, which gives its target; its shape says when. A source's documents, in a fixed random order,
are a stream of words, gone through once more when it ends; a document's copy is trained on when the source's cumulative
demand reaches its place in the stream. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: All sources together take this share of all words ...
SHARE = 1.5
#: ... and none more than so many times its own.
MOST = 2
#: The contract's weights, and how far each weight falls over the training from above its mean to below it; both in turn.
WEIGHTS, TILTS = (3.0, 1.0, 2.0), (0.5, 0.0, -0.5)
KNOTS = "array<struct<at:double,weight:double>>"


def keyed(source: Column) -> Column:
    """A source as a key that is never null and sorts as the contract says: by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def measured(docs: DataFrame, seed: int = 1, keep: tuple[str, ...] | None = None) -> DataFrame:
    """doc (the columns to keep; all, if not told), key, size in words, and the place in the source's random order.

    The order is by a hash of seed, doc_id and text, so copies under many ids and texts under one id are spread alike.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    return docs.select(F.struct(*(common.own(docs) if keep is None else keep)).alias("doc"), keyed(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("id"), F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("place"))


def sources(rows: DataFrame) -> DataFrame:
    """(key, source_size), a row for each source."""
    return rows.groupBy("key").agg(F.sum("size").alias("source_size"))


def in_turn(found: DataFrame, weights: tuple[float, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """(key, source_size, knots): the weights in turn over the sources by code point, each on a line whose mean it is."""
    i = (F.col("k") % len(weights)).cast("int")
    w, a = F.get(F.array(*map(F.lit, weights)), i), F.get(F.array(*map(F.lit, tilts)), i)
    knots = F.array(F.struct(F.lit(0.0).alias("at"), (w * (1 + a)).alias("weight")), F.struct(F.lit(1.0).alias("at"), (w * (1 - a)).alias("weight")))
    return common.numbered(found, "key", name="k").select("key", "source_size", knots.cast(KNOTS).alias("knots"))


def segments(knots: Column) -> Column:
    """array<struct(at, span, w0, w1, before)>: the pieces of a schedule, with the integral before each; no knots give none."""
    both = F.arrays_zip(F.slice(knots, F.lit(1), F.greatest(F.size(knots) - 1, F.lit(0))).alias("a"), F.slice(knots, F.lit(2), F.greatest(F.size(knots) - 1, F.lit(0))).alias("b"))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<at:double,span:double,w0:double,w1:double,before:double>>").alias("out"))

    def add(s, x):
        a, b = x["a"], x["b"]
        piece = F.struct(a["at"].alias("at"), (b["at"] - a["at"]).alias("span"), a["weight"].alias("w0"), b["weight"].alias("w1"), s["sum"].alias("before"))
        return F.struct((s["sum"] + (a["weight"] + b["weight"]) / 2 * (b["at"] - a["at"])).alias("sum"), F.concat(s["out"], F.array(piece)).alias("out"))

    return F.aggregate(both, start, add)


def targets(found: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``found`` (key, source_size, knots) with area, pieces and target: words in proportion to the areas, none above its most.

    What a source can't take is shared by the others, again and again: each round asks the table for three numbers, and
    adds the sources that are full, until there are none. Sources without weight get nothing.
    """
    s = segments(F.coalesce("knots", F.array().cast(KNOTS)))
    found = common.materialize(found.withColumn("s", s).select("key", "source_size", F.col("s.sum").alias("area"), F.col("s.out").alias("pieces")), "sources")
    room, full, n = F.col("source_size") * F.lit(float(most)), F.lit(False), 0
    total = found.agg(F.sum("source_size")).first()[0] or 0
    while True:
        held, weight = found.agg(F.coalesce(F.sum(F.when(full, room)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("area"))), F.lit(0.0))).first()
        level = (share * total - held, weight or 1.0)
        over = full | (room < F.lit(level[0]) * F.col("area") / F.lit(level[1]))
        more = found.filter(over).count()
        if more == n:
            break
        n, full = more, over
    return found.withColumn("target", F.when(full, room).otherwise(F.lit(level[0]) * F.col("area") / F.lit(level[1])))


def when_reached(pieces: Column, need: Column) -> Column:
    """The time at which a schedule's integral reaches ``need``."""

    def inside(p):
        left = F.greatest(need - p["before"], F.lit(0.0))
        root = p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * left * (p["w1"] - p["w0"]) / p["span"], F.lit(0.0)))
        return F.least(p["at"] + F.when(root > 0, 2 * left / root).otherwise(0.0), p["at"] + p["span"])

    # the last piece that begins before it, and has a span
    return F.transform(F.slice(F.filter(pieces, lambda p: (p["before"] <= need) & (p["span"] > 0)), F.lit(-1), F.lit(1)), inside)[0]


def schedule(rows: DataFrame, found: DataFrame, most: float = MOST) -> DataFrame:
    """``rows`` of :func:`measured` with source_size, target, taken, and copies: array<struct(position, words)>.

    Running sums over a source go by ranges of the random order: about the square root of all rows in number, so neither
    the ranges of a source nor the rows of a range are many. The last copy a source's target reaches is taken in part: a
    source's taken words are its target, to half a word.
    """
    many = rows.count()
    bits = min(40, math.ceil(math.log2(max(many, 1)) / 2) + 1)
    rows = rows.withColumn("range", F.shiftright("place", 60 - bits))
    parts = rows.groupBy("key", "range").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("base", F.sum("words").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).drop("words")
    w = W.partitionBy("key", "range").orderBy("place", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(common.few(common.materialize(parts, "ranges")), ["key", "range"])
    rows = rows.withColumn("start", F.col("base") + F.sum("size").over(w) - F.col("size")).join(common.few(common.materialize(found, "targets")), "key")
    goal = F.floor(F.col("target") + 0.5)

    def copy(e):
        at = e * F.col("source_size") + F.col("start")
        need = F.least(at / F.col("target"), F.lit(1.0)) * F.col("area")
        words = F.greatest(F.least(F.col("size"), goal - at), F.lit(0)).cast("long")
        return F.struct(F.when(words > 0, when_reached(F.col("pieces"), need)).alias("position"), words.alias("words"))

    rows = rows.withColumn("copies", F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(most) - 1).cast("long")), copy), lambda c: c["words"] > 0))
    return rows.select("doc", "key", "id", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("taken"), "copies")


def in_order(rows: DataFrame, position: str, *more: str) -> DataFrame:
    """Range-partitioned and sorted by position: files written from it are read in the order of training."""
    keys = [F.col(common.quoted(c)).asc_nulls_last() for c in (position, *more)]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def planned(docs: DataFrame, curriculum: DataFrame | None = None, share: float = SHARE, most: float = MOST, seed: int = 1, keep: tuple[str, ...] | None = None) -> DataFrame:
    """As :func:`schedule`; doc holds the columns to keep. Reads the texts once, and writes what it needs of each row.

    ``curriculum``: (source, knots), a row for each source; sources that it lacks have no weight. Without one, the
    contract's weights in turn.
    """
    rows = common.materialize(measured(docs, seed, keep), "measured")
    found = common.materialize(sources(rows), "source-sizes")
    if curriculum is None:
        found = in_turn(found)
    else:
        found = found.join(curriculum.select(keyed(F.col("source")).alias("key"), F.col("knots").cast(KNOTS).alias("knots")).dropDuplicates(["key"]), "key", "left")
    return schedule(rows, targets(found, share, most), most)


def mix(docs: DataFrame, curriculum: DataFrame | None = None, share: float = SHARE, most: float = MOST, seed: int = 1) -> DataFrame:
    """The mixture: a row for each copy, in the order of training, with all columns of ``docs``, position and words.

    A copy of which only some words are taken has a text that ends after them. Null texts and texts without a word have
    no words and are never taken. A null source is a source like the others. Rows with one doc_id, or none, are documents
    each; rows equal in doc_id, text and source lie in one range, sorted and spilled there. Extra columns stay, whatever
    their names: position and words are made longer if they are there. An empty table gives no rows; where no source has weight none is taken.
    """
    position, words, text = common.unused(docs, "position", "words", "whole")
    whole = docs.withColumn(text, F.col("text").cast("string")) if dict(docs.dtypes).get("text") != "string" else docs
    rows = planned(whole, curriculum, share, most, seed).select("doc", "size", F.explode("copies").alias("c"))
    body = F.col("doc.text")
    head = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("c.words").cast("int")), "")
    rows = rows.withColumn("doc", F.col("doc").withField("text", F.when(F.col("c.words") < F.col("size"), head).otherwise(body)))
    rows = rows.select("doc.*", F.col("c.position").alias(position), F.col("c.words").alias(words))
    return in_order(rows.select(*common.own(docs), position, words), position, "doc_id")


def oracle() -> str:
    """The contract's query in SQL."""
    return r"""
with d as (select row_number() over () as row_id, doc_id, coalesce('s' || source, 't') as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5('1:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 15))::bigint as place from documents),
s as (select key, sum(size)::bigint as source_size, row_number() over (order by key) - 1 as k from d group by key),
w as (select *, [3.0, 1.0, 2.0][k % 3 + 1]::double as area, [0.5, 0.0, -0.5][k % 3 + 1]::double as tilt, 2.0::double * source_size as room, 1.5::double * sum(source_size) over () as goal from s),
l as (select *, sum(room) over (order by room / area, key rows between unbounded preceding and current row) - room as held, sum(area) over (order by room / area desc, key desc rows between unbounded preceding and current row) as rest from w),
f as (select *, room < (goal - held) * area / rest as is_full from l),
t as (select *, case when is_full then room else (goal - coalesce(sum(room) filter (where is_full) over (), 0.0)) * area / sum(area) filter (where not is_full) over () end as target from f),
p as (select d.*, source_size, target, area, tilt, floor(target + 0.5)::bigint as goal, sum(size) over (partition by key order by place, doc_id, size rows between unbounded preceding and current row) - size as start from d join t using (key)),
c as (select *, greatest(least(size, goal - start), 0)::bigint as once, greatest(least(size, goal - source_size - start), 0)::bigint as again, case when target > 0 then least(start / target, 1.0) * area end as need, area * (1 + tilt) as w0, area * (1 - tilt) as w1 from p)
select doc_id, size, source_size, target, (once + again)::bigint as taken, case when once > 0 then round(2 * need / (w0 + sqrt(greatest(w0 * w0 + 2 * need * (w1 - w0), 0.0))), 9) end as first_position from c
"""
