"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bands of ROWS values each. At similarity 0.75 a pair misses every bucket with a chance of 2e-5.
BANDS, ROWS = 56, 6
BINS = BANDS * ROWS
#: The similarity above which documents are linked, as a percentage.
PERCENT = 75
WORDS = 5
#: Bytes of sets that a task holds of a star while others are held against them.
BLOCK = 256 << 10
#: What a set takes in a block besides its hashes.
SET = 512

FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def tables():
    """What separates words; a random number for each byte, A-Z as a-z; for each bin the others' ranks in its own random order."""
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    fold = np.arange(256, dtype=np.uint64)
    fold[65:91] += np.uint64(32)
    n = np.arange(BINS, dtype=np.uint64)
    rank = mix(mix(n[:, None] + np.uint64(77)) ^ (n[None, :] * np.uint64(0x9E3779B97F4A7C15)))
    return gap, mix(fold + np.uint64(1)), rank.argsort(1).argsort(1).astype(np.uint16)


BASE = 0x100000001B3
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64, for at least n values of i."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + n // 4, base, np.uint64))])
    return _powers[base]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 bytes, with A-Z folded, and where each word begins."""
    gap, of, _ = tables()
    full = ~gap[raw]
    edge = np.diff(full.view(np.int8), prepend=0, append=0)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(raw)
    total = np.concatenate([[np.uint64(0)], np.cumsum(of[raw] * powers(BASE, n + 1)[:n])])
    # the sum over the word of c * base**i, divided by base**start
    word = (total[hi] - total[lo]) * powers(pow(BASE, -1, 1 << 64), n + 1)[lo]
    return mix(word + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), lo


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one shingle; none gives none."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation hashing: the least value in each of BINS equal ranges; an empty bin takes that of a full one.

    Densification: each empty bin goes through all bins in a random order of its own, the same for all documents, and
    takes the first that is full, so what it takes doesn't depend on what its neighbours hold.
    """
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[first]
    out = np.empty(BINS, np.uint64)
    out[full] = s[first]
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = s[first][tables()[2][np.ix_(empty, full)].argmin(1)]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def documents_of(batches, span: int = 1 << 20):
    """(doc_ids, hashes of all words, ends of each document's words) for Arrow batches of doc_id and text, about ``span`` bytes at a time."""
    for batch in batches:
        text = batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        ids, lo = batch.column(0).to_pylist(), 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + span, "right")) - 1)
            # a separator after each document keeps its last word from the next one's first
            own = ends[lo : hi + 1] - ends[lo]
            raw = np.insert(data[ends[lo] : ends[hi]], own[1:], 32)
            words, at = word_hashes(raw)
            yield ids[lo:hi], words, np.searchsorted(at, own[1:] + np.arange(1, hi - lo + 1))
            lo = hi


def features(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_shingles, 128 bits that name its set of shingles, and its bands' keys (none for an empty set)."""

    def run(batches):
        common.only("shingles")
        for ids, words, ends in documents_of(batches):
            out, lo = [], 0
            for doc_id, hi in zip(ids, ends.tolist(), strict=True):
                s = shingles(words[lo:hi])
                lo = hi
                if len(s):
                    a, b = mix(s + np.uint64(1)).sum(), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
                    out.append((doc_id, len(s), a.astype(np.int64), b.astype(np.int64), band_keys(signature(s)).view(np.int64)))
                else:
                    out.append((doc_id, 0, 0, 0, s.view(np.int64)))
            cols = list(zip(*out, strict=True))
            offsets = np.cumsum([0, *map(len, cols[4])])
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cols[4]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array([None if x is None else int(x) for x in c], pa.int64()) for c in cols[:4]), bands], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])
        common.tidy()

    return docs.mapInArrow(run, FEATURES)


def sets_of(docs: DataFrame) -> DataFrame:
    """Each document's sorted distinct shingle hashes, as bytes."""

    def run(batches):
        common.only("shingles")
        for ids, words, ends in documents_of(batches):
            sets = [shingles(words[a:b]).tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "s"])
        common.tidy()

    return docs.mapInArrow(run, "doc_id long, s binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets are at least so similar."""

    def run(batches):
        common.only("shingles")
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_pydict({"a": pa.array([v for v, g in zip(a, good, strict=True) if g], pa.int64()), "b": pa.array([v for v, g in zip(b, good, strict=True) if g], pa.int64())})
        common.tidy()

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class Block:
    """Sets that others are held against: which of them has each hash, and which of them are already joined.

    Two sets are linked if ``unit`` times the hashes that both have is at least the sum of their weights.
    """

    def __init__(self, unit: int):
        self.unit, self.ids, self.names, self.weights, self.sets, self.up = unit, [], [], [], [], {}

    def add(self, doc_id: int, component: int, weight: int, s: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.names.append(component)
        self.weights.append(weight)
        self.sets.append(s)

    def close(self) -> None:
        """No more sets are added: the hashes are sorted, each with its owner."""
        sizes = np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets), dtype=np.int32), sizes)[order]
        self.weights, self.sets = np.array(self.weights, np.int64), []

    def root(self, c: int) -> int:
        while (up := self.up.get(c, c)) != c:
            self.up[c] = self.up.get(up, up)
            c = up
        return c

    def links(self, doc_id: int, component: int, weight: int, s: np.ndarray) -> list[tuple[int, int]]:
        """The set's links to the block, but only such as join what was apart: no more, in all, than there are components."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        n = hi - lo
        ends = np.cumsum(n)
        both = np.bincount(self.owner[np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(self.ids))
        out = []
        for k in np.flatnonzero(self.unit * both >= weight + self.weights).tolist():
            mine, other = self.root(component), self.root(self.names[k])
            if mine != other:
                self.up[max(mine, other)] = min(mine, other)
                out.append((doc_id, self.ids[k]))
        return out


def block_links(rows: DataFrame, unit: int) -> DataFrame:
    """Links (a, b) within blocks of (centre, piece, asks, doc_id, c, w, s): of the rows that ask with those that don't.

    Rows come sorted by centre, piece and asks, so a task holds the sets of one block, and those that ask pass by. Sets of
    one component c aren't held against each other. ``unit`` and the weights w are those of :class:`Block`.
    """

    def run(batches):
        common.only("shingles")
        key, block, open_ = None, None, False
        for batch in batches:
            found = []
            for centre, piece, asks, doc_id, c, w, s in zip(*(x.to_pylist() for x in batch.columns[:6]), batch.column(6), strict=True):
                if key != (centre, piece):
                    key, block, open_ = (centre, piece), Block(unit), True
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if not asks:
                    block.add(doc_id, c, w, s)
                    continue
                if open_:
                    block.close()
                    open_ = False
                found += block.links(doc_id, c, w, s)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        block = None
        common.tidy()

    with common.batches(rows.sparkSession, 1000):
        dealt = rows.select("centre", "piece", "asks", "doc_id", "c", "w", "s").repartition("centre", "piece").sortWithinPartitions("centre", "piece", "asks")
        return common.materialize(dealt.mapInArrow(run, "a long, b long"), "links")


def deltas(star: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(centre, doc_id, w, s): by which hashes each set of a star differs from what most of the star's sets have.

    Let D be a set's difference. Two sets x, y differ by ``|Dx| + |Dy| - 2 |Dx & Dy|`` hashes, and are linked if that is at
    most ``(100 - p) / (100 + p)`` of their sizes' sum; so, with the weights ``w = (100 + p) |D| - (100 - p) |x|``, if
    ``2 (100 + p) |Dx & Dy| >= wx + wy``. What most sets have is at most twice as large as they are on average.
    """

    def run(batches):
        common.only("shingles")
        for batch in batches:
            out, weights = [], []
            for s, base in zip(batch.column(2), batch.column(3), strict=True):
                s, base = np.frombuffer(s.as_buffer(), np.uint64), np.sort(base.values.to_numpy().view(np.uint64)) if base.is_valid else np.zeros(0, np.uint64)
                d = np.setxor1d(s, base, assume_unique=True)
                out.append(d.tobytes())
                weights.append((100 + percent) * len(d) - (100 - percent) * len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weights, pa.int64()), pa.array(out, pa.binary())], names=["centre", "doc_id", "w", "s"])
        common.tidy()

    with common.batches(star.sparkSession, 500):  # two sets in each row
        whole = star.select("centre", "doc_id").join(sets, "doc_id")
        often = hashes(whole).groupBy("centre", "h").agg(F.count("*").alias("often"))
        many = star.groupBy("centre").agg(F.count("*").alias("k"))
        base = common.materialize(often.join(many, "centre").filter("2 * often > k").groupBy("centre").agg(F.collect_list("h").alias("base")), "bases")
        return common.materialize(whole.join(base, "centre", "left").select("centre", "doc_id", "s", "base").mapInArrow(run, "centre long, doc_id long, w long, s binary"), "deltas")


def hashes(rows: DataFrame) -> DataFrame:
    """(centre, doc_id, size, h): a row for each hash of the sets s."""

    def run(batches):
        for batch in batches:
            for centre, doc_id, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.frombuffer(s.as_buffer(), np.int64)
                if len(h):
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(h), x), pa.int64()) for x in (centre, doc_id, len(h))), pa.array(h)], names=["centre", "doc_id", "size", "h"])

    return rows.select("centre", "doc_id", "s").mapInArrow(run, "centre long, doc_id long, size long, h long")


def lists(delta: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that follow from the weights alone, and lists (list, centre, doc_id, low) such that all other links meet in one.

    With m the set of the least weight in the star, x and m are linked if ``wx + wm <= 0``: those, the inner sets, are one
    component. Any other link has an outer set, so its two sets have at least ``need`` hashes of their differences in
    common, and one among the ``|D| - need + 1`` first of each, in any order that is the same for the whole star. The
    rarest go first; what only one set has makes no list, and no list has more than half of the star.

    ``need`` grows with both weights. So that few light sets don't make it small for all, weights fall into levels, each
    twice as wide as the one below; a link meets in the list of the lower level of its two sets, which are ``low`` there.
    """
    unit = 2 * (100 + percent)
    least = common.materialize(delta.groupBy("centre").agg(F.min(F.struct("w", "doc_id")).alias("m")).select("centre", F.col("m.w").alias("wm"), F.col("m.doc_id").alias("m")), "least")
    told = delta.drop("s").join(least, "centre")
    sure = told.filter("w + wm <= 0 and doc_id != m").select(F.col("doc_id").alias("a"), F.col("m").alias("b"))
    level = F.floor(F.log2((F.col("w") - F.col("wm")) / F.lit(unit) + 1)).cast("int")

    def need(i):
        partner = F.col("wm") + (F.pow(F.lit(2.0), i) - 1) * unit
        other = F.when(F.col("w") + F.col("wm") <= 0, F.greatest(partner, 1 - F.col("wm"))).otherwise(partner)
        return F.greatest(F.lit(1), F.ceil((F.col("w") + other) / F.lit(unit)))

    needs = common.materialize(told.select("centre", "doc_id", F.transform(F.sequence(F.lit(0), level), need).alias("needs")), "needs")
    each = common.materialize(hashes(delta), "differences")
    often = common.materialize(each.groupBy("centre", "h").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    # a hash that half of a star has is a hot key of two plain exchanges, which adaptive execution can split
    ranked = each.join(common.few(often), ["centre", "h"], "left").withColumn("pos", F.row_number().over(W.partitionBy("centre", "doc_id").orderBy(F.coalesce("often", F.lit(1)), "h")))
    first = ranked.filter("often is not null").join(common.few(needs, 100_000), ["centre", "doc_id"])
    first = first.select("centre", "doc_id", "h", "size", "pos", F.posexplode("needs").alias("level", "need"), (F.size("needs") - 1).alias("own")).filter("pos <= size - need + 1")
    made = common.materialize(first.select(F.xxhash64("centre", "h", "level").alias("list"), "centre", "doc_id", (F.col("own") == F.col("level")).alias("low")), "lists")
    real = made.groupBy("list").agg(F.count("*").alias("k"), F.max("low").alias("any")).filter("k > 1 and any").select("list")
    out = common.materialize(made.join(common.few(common.materialize(real, "real")), "list"), "lists")
    common.drop(each, often, made)
    return sure, out


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over the edges (a, b), for all ids in them.

    Alternating large and small stars until nothing changes. Every aggregate and every round's edges are written to the
    shared folder: nothing is gathered on the driver, no lineage grows, and a join on a star's centre has two plain
    exchanges, which adaptive execution can split.
    """

    def large(e):
        """Every larger neighbour of u, and u's least neighbour, are joined to the least of u and its neighbours."""
        n = e.union(e.select("b", "a")).toDF("u", "v")
        low = common.materialize(n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        return n.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e):
        """Every smaller neighbour of u, and u itself, are joined to the least of them."""
        n = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = common.materialize(n.groupBy("u").agg(F.min("v").alias("m")), "low")
        return n.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m").toDF("a", "b"))

    def clean(e):
        return common.materialize(e.filter("a != b").distinct(), "edges")

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    common.collect_garbage(edges.sparkSession)
    now = clean(edges.select("a", "b"))
    before = None
    while (after := state(now)) != before:
        before, last = after, now
        mid = clean(large(now))
        now = clean(small(mid))
        common.drop(last, mid)
    return now.toDF("id", "component").union(now.select("b", "b").distinct())


def linked(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component) for rows of (doc_id, text) whose doc_ids are all different and not null.

    component is the least doc_id reachable over links, itself included; empty sets are linked with nothing.
    """
    spark = docs.sparkSession
    with common.scratch(spark) as keep:
        with common.batches(spark, 2000):
            told = common.materialize(features(docs), "features")
        real = told.filter("n_shingles > 0")
        keys = ["set_a", "set_b", "n_shingles"]
        classes = common.materialize(real.groupBy(keys).agg(F.min("doc_id").alias("rep")), "classes")
        member = common.materialize(real.select("doc_id", *keys).join(classes, keys).select("doc_id", "rep", "n_shingles"), "members")
        reps = real.join(member.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
        banded = common.materialize(reps.select("doc_id", F.explode("bands").alias("band")).distinct(), "bands")
        bucket = common.materialize(banded.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).filter("n > 1").select("band", "centre"), "buckets")
        # the stars: a centre's buckets are one, and hold each of their documents once
        star = common.materialize(banded.join(bucket, "band").select("centre", "doc_id").distinct(), "stars")
        common.drop(classes, banded, bucket)
        wanted = common.materialize(star.select("doc_id").distinct(), "wanted")
        with common.batches(spark, 2000):
            sets = common.materialize(sets_of(docs.join(common.few(wanted), "doc_id", "left_semi")), "sets")
        pairs = common.materialize(star.filter("doc_id != centre").groupBy(F.col("doc_id").alias("b")).agg(F.min("centre").alias("a")).select("a", "b"), "pairs")
        with common.batches(spark, 500):  # two whole sets in each row
            comp = components(common.materialize(confirmed(pairs, sets), "links"))

        def parted(star):
            """The stars of several components: their members with the component c, and each star's largest one."""
            part = common.materialize(star.join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component"), "parts")
            size = part.groupBy("centre", "c").agg(F.count("*").alias("n"))
            apart = size.groupBy("centre").agg(F.max(F.struct("n", "c"))["c"].alias("largest"), F.count("*").alias("k")).filter("k > 1").select("centre", "largest")
            return common.materialize(part.join(common.materialize(apart, "apart"), "centre"), "members")

        # a star of two documents that were compared above is done
        two = star.groupBy("centre").agg(F.count("*").alias("k"), F.max("doc_id").alias("b")).filter("k = 2").join(pairs.withColumnRenamed("a", "centre"), ["centre", "b"]).select("centre")
        rest = parted(star.join(common.materialize(two, "compared"), "centre", "left_anti"))
        size = rest.join(member.select("doc_id", "n_shingles"), "doc_id").groupBy("centre").agg(F.ceil(F.sum(F.col("n_shingles") * 8 + SET) / block).cast("int").alias("pieces"))
        size = common.materialize(size, "sizes")
        rest = common.materialize(rest.join(size, "centre").withColumn("piece", F.pmod(F.xxhash64("doc_id"), "pieces").cast("int")), "members")

        def join(links):
            nonlocal comp
            if not links.isEmpty():
                comp = components(links.union(comp.toDF("a", "b")))

        # each block within itself: what is outside the star's largest component is held against all
        asks = F.explode(F.when(F.col("c") != F.col("largest"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
        join(block_links(rest.withColumn("asks", asks).join(sets.withColumn("w", PERCENT * (F.octet_length("s") / 8).cast("long")), "doc_id"), 100 + PERCENT))
        # what is still apart in stars of several blocks meets by the differences that it shares
        wide = rest.filter("pieces > 1").select("centre", "doc_id")
        if not wide.isEmpty():
            common.collect_garbage(spark)
            wide = parted(wide)
        if not wide.isEmpty():
            # stars that share a document are one group, so that each document is sent once, not once for each of its stars
            group = components(wide.filter("doc_id != centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")))
            wide = common.materialize(wide.select("doc_id").distinct().join(group, F.col("doc_id") == F.col("id")).select(F.col("component").alias("centre"), "doc_id"), "groups")
            delta = deltas(wide, sets)
            sure, met = lists(delta)
            join(common.materialize(sure, "links"))
            met = parted(met.select(F.col("list").alias("centre"), F.col("centre").alias("star"), "doc_id", "low"))
            # a link's one set is low, and its one set is outside the largest component: of these, the fewer ask
            facts = met.join(delta.select(F.col("centre").alias("star"), "doc_id", F.octet_length("s").alias("size")), ["star", "doc_id"]).groupBy("centre").agg(F.ceil(F.sum(F.col("size") + SET) / block).cast("int").alias("pieces"), (F.count_if("low") < F.count_if(F.col("c") != F.col("largest"))).alias("by_low"))
            met = met.join(common.few(common.materialize(facts, "sizes")), "centre").join(delta.select(F.col("centre").alias("star"), "doc_id", "w", "s"), ["star", "doc_id"])
            held = met.withColumn("piece", F.pmod(F.xxhash64("doc_id"), "pieces").cast("int")).withColumn("asks", F.lit(False))
            asking = met.filter(F.when(F.col("by_low"), F.col("low")).otherwise(F.col("c") != F.col("largest"))).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("asks", F.lit(True))
            join(block_links(held.unionByName(asking), 2 * (100 + PERCENT)))
        out = told.select("doc_id", "n_shingles").join(member.select("doc_id", "rep").join(comp, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("c")), "doc_id", "left")
        return keep(out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component")), "linked")


def plain(docs: DataFrame) -> bool:
    """Has each row a doc_id of its own?"""
    return docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked whose sets of 5-word shingles have a similarity of 0.75 or more (A-Z lower-cased; fewer words
    are one shingle). Null and empty texts, and texts without words, have an empty set and are linked with nothing. Rows
    with one doc_id are one document: whatever one of their texts is linked with, the others are too. Rows without a
    doc_id are linked with nothing and kept. Other columns are ignored; an empty table gives no rows.

    Equal sets are made one class first, by aggregation, so copies cost a row each. The classes' bands make buckets, and
    the buckets of one centre, their least member, a star. Each class is compared with its least centre, and the confirmed
    pairs make components. What a star then still holds apart is compared exactly, in blocks of about ``block`` bytes of
    sets (:func:`block_links`): what is outside the star's largest component is held against all of its own block. What is
    still apart in stars of several blocks, taken together where they share documents, meets in lists of differences from what most of the star has (:func:`lists`):
    only such as share a rare one are held against each other, by their differences alone. A block gives only links that
    join components, so every pair of a bucket was compared, can't be linked, or is in one component: no link within a
    bucket is lost. Sets that differ each in its own way share no list, so they send no more rows, however many they are;
    where many share the same differences, a list of several blocks goes block by block.
    """
    docs = common.columns(docs, doc_id="long", text="string")
    if plain(docs):
        out = linked(docs, block).withColumnRenamed("component", "component_id")
        return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    with common.scratch(docs.sparkSession) as keep:
        # different texts of one id are numbered, linked each on its own, and joined by their id
        rows = common.materialize(docs.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()), "numbered")
        told = linked(rows.select(F.col("uid").alias("doc_id"), "text"), block).toDF("uid", "n_shingles", "component")
        found = common.materialize(rows.drop("text").join(told, "uid"), "found")
        full = found.filter("n_shingles > 0")  # an empty text of an id joins nothing
        least = full.groupBy("doc_id").agg(F.min("component").alias("b"))
        comp = components(full.join(least, "doc_id").select(F.col("component").alias("a"), "b"))
        found = found.join(comp.select(F.col("id").alias("component"), F.col("component").alias("joined")), "component", "left").withColumn("g", F.coalesce("joined", "component"))
        found = common.materialize(found.select("doc_id", "copies", "n_shingles", "g"), "groups")
        ids = found.filter("n_shingles > 0").groupBy("g").agg(F.min("doc_id").alias("component_id"))
        whole = found.filter("n_shingles > 0").select("doc_id", "g").distinct().join(ids, "g").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        out = found.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_")).drop("_")
        with common.batches(docs.sparkSession, 2000):
            none = features(docs.filter("doc_id is null")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
        return keep(out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group of linked texts: that with the least doc_id.

    Each row is compared by its own text, also where doc_ids repeat or are null (a null goes after all others), so no text
    is lost but near copies of one that stays. Rows without a word are all kept, but for equal ones of one doc_id.
    """
    slim = common.columns(docs, doc_id="long", text="string")
    if plain(slim):
        told = linked(slim, block)
        (dropped,) = common.unused(docs, "dropped")
        out = common.materialize(told.filter("doc_id != component").select(F.col("doc_id").alias(dropped)), "dropped")
        return docs.join(common.few(out), F.col("doc_id").cast("long") == F.col(dropped), "left_anti")
    uid, number = common.unused(docs, "uid", "number")
    rows = common.materialize(docs.withColumn(uid, F.monotonically_increasing_id()), "numbered")
    told = linked(common.columns(rows, **{uid: "long", "text": "string"}).toDF("doc_id", "text"), block).toDF(uid, "n_shingles", "component")
    told = told.join(rows.select(uid, F.col("doc_id").cast("long"), F.xxhash64("text").alias("h")), uid)
    first = told.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", uid))[uid].alias(number))
    bare = told.filter("n_shingles = 0")
    bare = bare.filter("doc_id is null").select(F.col(uid).alias(number)).union(bare.filter("doc_id is not null").groupBy("doc_id", "h").agg(F.min(uid).alias(number)).select(number))
    kept = common.materialize(first.select(number).union(bare), "kept")
    return rows.join(kept, F.col(uid) == F.col(number), "left_semi").drop(uid)


def oracle(percent: int = PERCENT) -> str:
    """The same in DuckDB's SQL, by all pairs that share a shingle: for tables of a few thousand documents."""
    return rf"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {WORDS} then [w] else list_transform(range(1, len(w) - {WORDS - 2}), lambda i: w[i : i + {WORDS - 1}]) end) as x from t),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common_n from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common_n >= {percent} * (x.n + y.n - common_n)),
reach(id, c) as (select doc_id, doc_id from t union select id, b from reach join links on a = c)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(c) as component_id, min(c) = t.doc_id as kept from t join reach on id = t.doc_id left join n on n.doc_id = t.doc_id group by t.doc_id, n.n
"""
