"""How far the sources of a language lie apart, term by term and pair by pair, in exact integers.

Terms whose counts are the same in every source of a language are one column: a hash of the sparse vector of their counts
tells which. A pair of sources is evaluated once for each different vector in which both occur, times the terms that have
it; what a pair owes to terms that only one of them has, or none, follows from each source's own counts. So no term is
paired with a source that lacks it. Terms are ranked one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: A worker counts so many different terms of sources before it passes the counts on.
HELD = 250_000
#: Bytes of terms as they are, A to Z made small, all others spaces. A byte above 127 is part of a character that belongs to a term.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of Arrow batches of lang, source and text: occurrences of each term and texts that have it, added up within a task.

    An empty term with 0 stands for the group itself, also where it has no terms.
    """
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            names, both = pa.array(own.keys(), pa.binary()).cast(pa.string()), list(own.values())
            k = len(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array([0] * k, pa.int32())), pa.array([source], pa.string()).take(pa.array([0] * k, pa.int32())), names, pa.array([x >> 40 for x in both], pa.int64()), pa.array([x & (1 << 40) - 1 for x in both], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            own = held.get((lang, source))
            if own is None:
                own = held[lang, source] = {b"": 0}
                n += 1
            before, get = len(own), own.get
            for term, k in Counter((text.as_py() or b"").translate(TERM).split()).items():
                own[term] = get(term, 0) + (k << 40) + 1
            n += len(own) - before
            if n > HELD:
                yield from out()
                held, n = {}, 0
    yield from out()


def chance(n: str, size: str, kept: str, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / (size + kept)), in decimals, since the product needn't fit 64 bits."""
    return F.expr(f"1 + cast({scale} as decimal(18, 0)) * cast({n} + 1 as decimal(19, 0)) div cast(greatest({size} + {kept}, 1) as decimal(20, 0))")


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / q); fits 64 bits, as p and q are about SCALE at most."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def counted(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, and of the term in its language: lang_n, head (one row of the term), x and y (its vector's hashes).

    Kept terms alone, and a row of an empty term for each group.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sums = rows.mapInArrow(tally, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = W.partitionBy("lang", "term")
    told = {"df": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "head": F.col("source") == F.min("source").over(w), "x": F.expr("bit_xor(xxhash64(source, n))").over(w), "y": F.expr("bit_xor(xxhash64(n, source, 1))").over(w)}
    return sums.withColumns(told).filter((F.col("df") >= min_docs) | (F.col("term") == "")).drop("df", "docs")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """Two tables of (lang, source, item, value, rank): each other source of the language, and the terms a source has more of.

    Null texts, languages and sources are empty strings. Terms are runs of what isn't an ASCII character other than a
    letter; only A to Z are made small; a language keeps those in ``min_docs`` of its documents or more. p and q are whole
    numbers of ``scale`` parts (at most 10^9, so that sums fit 64 bits up to 10^9 terms). An item of the first table is compared over all kept terms; of the second
    the ``top`` terms stay, which is the report. A group without terms has all pairs, of value 0 if its language kept no
    term. Repeated rows count; columns besides are ignored; an empty table gives none. Vectors are told apart by 128 bits
    of hashes. The pairs are as many as the contract asks for: the square of a language's sources.
    """
    rows = common.materialize(counted(docs, min_docs), "terms")
    langs = rows.groupBy("lang").agg(F.count_if(F.col("head") & (F.col("term") != "")).alias("kept"), F.coalesce(F.sum(F.when(F.col("head"), F.col("lang_n"))), F.lit(0)).alias("lang_size"))
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("size")).join(common.few(common.materialize(langs, "languages")), "lang")
    groups = common.materialize(groups.withColumn("zero", chance("0", "size", "kept", scale)).withColumn("g", F.monotonically_increasing_id()), "groups")
    known = common.few(groups)
    terms = rows.filter("n > 0").join(known, ["lang", "source"])
    terms = terms.withColumn("p", chance("n", "size", "kept", scale))
    return pairs(terms, groups), best(terms, top, scale)


def best(terms: DataFrame, top: int, scale: int) -> DataFrame:
    rows = terms.withColumn("q", chance("lang_n", "lang_size", "kept", scale)).filter("p > q")
    rows = rows.select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """For two groups a and b, of counts i and j of a term, let F(i, j) be the value. The sum over all terms is that of
    F(0, 0), plus F(i, 0) - F(0, 0) over a's terms, F(0, j) - F(0, 0) over b's, and over the terms of both what is left."""
    entries = common.materialize(terms.groupBy("lang", "x", "y", "g", "p", "zero").agg(F.count("*").alias("m")), "vectors")
    zero = common.few(groups.select("lang", F.col("g").alias("h"), F.col("zero").alias("other"), "kept"))
    # each row tells of a pair in both directions: ab, the value of a as it sees b, and ba
    none = groups.select("lang", "g", "zero").join(zero, "lang").filter("g < h")
    none = none.select("lang", "g", "h", F.expr(f"kept * {apart('zero', 'other')}").alias("ab"), F.expr(f"kept * {apart('other', 'zero')}").alias("ba"))
    own = entries.groupBy("lang", "g", "p", "zero").agg(F.sum("m").alias("m"))
    one = own.join(zero, "lang").filter("g != h")
    one = one.select("lang", "g", "h", F.expr(f"m * ({apart('p', 'other')} - {apart('zero', 'other')})").alias("ab"), F.expr(f"m * ({apart('other', 'p')} - {apart('other', 'zero')})").alias("ba"))
    twin = entries.select("lang", "x", "y", F.col("g").alias("h"), F.col("p").alias("r"), F.col("zero").alias("other"))
    rest = lambda a, b, a0, b0: f"m * ({apart(a, b)} - {apart(a, b0)} - {apart(a0, b)} + {apart(a0, b0)})"
    two = entries.join(twin, ["lang", "x", "y"]).filter("g < h")
    two = two.select("lang", "g", "h", F.expr(rest("p", "r", "zero", "other")).alias("ab"), F.expr(rest("r", "p", "other", "zero")).alias("ba"))
    sums = [df.groupBy("lang", "g", "h").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba")) for df in (none, one, two)]
    both = sums[0].unionByName(sums[1]).unionByName(sums[2])
    each = both.select("lang", F.explode(F.array(F.struct("g", "h", F.col("ab").alias("v")), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("ba").alias("v")))).alias("e")).select("e.*")
    values = each.groupBy("g", "h").agg(F.sum("v").alias("value"))
    values = values.join(common.few(groups.select("lang", "source", "g")), "g").join(common.few(groups.select(F.col("source").alias("item"), F.col("g").alias("h"))), "h")
    return values.select("lang", "source", "item", "value", F.row_number().over(W.partitionBy("g").orderBy(F.desc("value"), "item")).alias("rank"))


def report(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Both tables of :func:`audit` as one, told apart by ``part``."""
    found = dict(zip(("pair", "term"), audit(docs, min_docs, top), strict=True))
    each = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, df in found.items()]
    return each[0].unionByName(each[1])


def oracle() -> str:
    """The contract's query in SQL: every pair over every kept term, in 128-bit integers."""
    p = lambda n, size: f"(1 + (1000000000::hugeint * ({n} + 1)) // ({size} + kept))"
    f = "((p - q) * (p - q)) // q"
    return rf"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, unnest(list_prepend('', regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))) as term from documents),
k as (select lang, term, count(*)::hugeint as lang_n from d where term <> '' group by all having count(distinct row_id) >= 3),
s as (select lang, count(*)::hugeint as kept, sum(lang_n)::hugeint as lang_size from k group by lang),
g as (select distinct lang, source from d),
n as (select lang, source, term, count(*)::hugeint as n from d join k using (lang, term) group by all),
z as (select lang, source, sum(n)::hugeint as size from n group by all),
c as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n, {p('coalesce(n.n, 0)', 'coalesce(size, 0)')} as p, {p('lang_n', 'lang_size')} as q from g join k using (lang) join s using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = k.term left join z on z.lang = g.lang and z.source = g.source),
v as (select a.lang, a.source, b.source as item, sum({f.replace('q', 'b.p').replace('(p ', '(a.p ')}) as value from c a join c b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join v on v.lang = a.lang and v.source = a.source and v.item = b.source
union all select lang, source, 'term', term, ({f})::bigint from c where n > 0 and p > q)
select lang, source, part, item, value, rank from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from r) where part = 'pair' or rank <= 200
"""
