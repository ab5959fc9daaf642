"""Cross-site line removal: HyperLogLog sketches of the sites of each line, exact counts near the threshold. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A line on so many sites or more is boilerplate.
MIN_SITES = 10
LG_K = 10
#: Estimates within this share of the threshold are replaced by exact counts: over five standard errors of a sketch of 2**LG_K.
NEAR = 0.2


def line_hash(line):
    """Two independent 64-bit hashes are one key, so that lines of a whole corpus don't meet by chance."""
    return F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("y"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, own, site, x, y): a row for each different line that has a word, of each text; own is the text's hash."""
    # strings are told apart by a hash set, structs one by one
    lines = F.transform(F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(common.WORD))), line_hash)
    return docs.select("doc_id", F.xxhash64("text").alias("own"), "site", F.explode(lines).alias("h")).select("doc_id", "own", "site", "h.x", "h.y")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(x, y, first): the lines on at least ``min_sites`` sites, and the least doc_id of each.

    Sketches merge by aggregation, partly before the shuffle, so a line of a third of all documents is a row for each
    task. Lines whose estimate is near the threshold are counted exactly.
    """
    sketched = lines.groupBy("x", "y").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("first"))
    told = common.materialize(sketched.select("x", "y", "first", F.hll_sketch_estimate("sketch").alias("n")).filter(F.col("n") >= min_sites * (1 - NEAR)), "spread")
    sure = told.filter(F.col("n") > min_sites * (1 + NEAR)).select("x", "y", "first")
    near = told.filter(F.col("n") <= min_sites * (1 + NEAR)).select("x", "y", "first")
    if near.isEmpty():
        return common.materialize(sure, "boilerplate")
    # distinct sites first: what is counted is then a row for each line and site
    pairs = lines.join(common.few(common.materialize(near, "near")), ["x", "y"]).select("x", "y", "first", "site").distinct()
    exact = pairs.groupBy("x", "y", "first").agg(F.count("site").alias("n")).filter(F.col("n") >= min_sites).select("x", "y", "first")
    return common.materialize(sure.union(exact), "boilerplate")


def without(lines, gone):
    """The lines, in order, but for those whose first hash is in ``gone``; lines without a word stay.

    Lines and hashes are sorted together, so each run of equal hashes begins with one of ``gone`` if it is there: the time
    grows with the lines and hashes and the logarithm of their number, not with their product.
    """
    mine = F.transform(lines, lambda x, i: F.struct(F.when(x.rlike(common.WORD), F.xxhash64(x)).alias("h"), i.alias("i"), x.alias("line")))
    theirs = F.transform(gone, lambda h: F.struct(h.alias("h"), F.lit(-1).alias("i"), F.lit("").alias("line")))

    def build(all_):
        starts = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda k: (k == 0) | ~F.get(all_, k)["h"].eqNullSafe(F.get(all_, k - 1)["h"]))

        def runs(starts_):
            ends = F.concat(F.slice(starts_, F.lit(2), F.size(starts_)), F.array(F.size(all_)))
            kept = F.filter(F.arrays_zip(starts_.alias("a"), ends.alias("b")), lambda r: F.get(all_, r["a"])["i"] >= 0)
            # places, not slices: each slice would copy all
            at = F.flatten(F.transform(kept, lambda r: F.sequence(r["a"], r["b"] - 1)))
            rows = F.transform(at, lambda k: F.struct(F.get(all_, k)["i"].alias("i"), F.get(all_, k)["line"].alias("line")))
            return F.transform(F.sort_array(rows), lambda x: x["line"])

        return F.transform(F.array(starts), runs)[0]

    return F.transform(F.array(F.sort_array(F.concat(mine, theirs))), build)[0]


def remove(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows of ``docs`` (doc_id, source, text and any others) with ``text`` cleaned, and two columns of ``counts`` added.

    A line is what stands between two \\n, compared by 96 bits of hashes, and counts for sites if it has a word. If it is
    on ``min_sites`` different sources or more it is removed from every text, but for the rows of the least doc_id that
    has it (``keep_first``), so nothing is lost altogether. A null source is a site like the others; a null doc_id is
    never the first. Lines without a word are left. Null texts stay null, with no lines. Rows with one doc_id, or none,
    are cleaned each by itself. The counts are how many lines there were and how many went; columns of their names
    (n_lines, n_removed if not told) are replaced, all others stay. An empty table gives no rows.
    """
    docs = docs.drop(*counts)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("site"), F.col("text").cast("string").alias("text")).filter("text is not null")
    lines = lines_of(slim)
    bad = boilerplate(lines, min_sites)
    # the hashes to remove from each document: narrow rows; only documents that hold some
    hits = lines.select("doc_id", "own", "x", "y").join(common.few(bad, 200_000), ["x", "y"])
    if keep_first:
        hits = hits.filter("first is null or doc_id is null or doc_id != first")
    # within a document one of the two hashes tells lines apart
    hit, own, out, mine, rest = common.unused(docs, "hit", "own", "out", "mine", "rest")
    hits = hits.groupBy(F.col("doc_id").alias(hit), F.col("own").alias(own)).agg(F.collect_set("x").alias(out))
    # one plan at every size: what is removed grows with the documents, so it is never broadcast; rows without a doc_id,
    # or with one, are dealt out by their texts' hashes
    hits = common.materialize(hits, "removed").hint("merge")
    rows = docs.withColumn(mine, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(hits, (F.col(mine) == F.col(own)) & F.col("doc_id").cast("long").eqNullSafe(F.col(hit)), "left")
    parts = F.split("text", "\n", -1)
    kept = without(parts, F.col(out))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    rows = rows.withColumn(rest, F.when(F.col(out).isNull(), parts).otherwise(kept)).withColumn(counts[0], n)
    rows = rows.withColumn(counts[1], F.when(F.col("text").isNull() | F.col(out).isNull(), F.lit(0)).otherwise(F.col(counts[0]) - F.size(rest)).cast("long"))
    rows = rows.withColumn("text", F.when(F.col(counts[1]) > 0, F.array_join(rest, "\n")).otherwise(F.col("text")))
    return rows.drop(hit, own, out, mine, rest)


def oracle(min_sites: int = MIN_SITES) -> str:
    return rf"""
with d as (select row_number() over () as row_id, doc_id, coalesce(source, chr(1)) as site, text from documents),
l as (select row_id, doc_id, site, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from d where text is not null),
spread as (select line, min(doc_id) as first from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by line having count(distinct site) >= {min_sites}),
gone as (select l.*, spread.line is not null and (first is null or l.doc_id is null or l.doc_id <> first) as gone from l left join spread using (line)),
done as (select row_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_removed, coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '') as text from gone group by row_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, done.text as text from d left join done using (row_id)
"""
