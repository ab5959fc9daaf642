"""Catalogs as tables: which of thousands of patterns match which texts, without reading each text with each pattern.

Each pattern's required literals are read off its syntax (:mod:`textward.functions.prefilter`). One automaton of all literals
scans a text once; a pattern whose every clause was seen is a candidate, and only candidates are tested, by the JVM's own
matcher. So the work is one scan of the text, and one test for each candidate.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions.columns import col, quoted
from textward.functions.prefilter import DIGIT, ODD, members, parser, required, sre
from textward.functions.spans import flags, java

#: An automaton has so many patterns at most: beyond, texts are scanned once for each part of the table.
PART = 100_000
#: Patterns without a literal of SHORTEST characters are tested on every text: so many at most in one projection, and in all
#: unless the caller says otherwise.
BARE, SHORTEST = 100, 3
#: A run of characters and small classes stands for so many literals at most.
SPELT = 16
#: Patterns are broadcast to the tests of candidates up to so many, else joined by a shuffle.
FEW = 200_000
PLAIN = str.maketrans(dict(zip(ODD, "skii", strict=True)))


def small(text: str) -> str:
    """In small letters as far as literals are concerned: what equals an ASCII letter where case is ignored becomes it."""
    return (text if text.isascii() else text.translate(PLAIN)).lower()


def narrow(text: str) -> str:
    """The text with each run of white space as one space, and one at both ends."""
    return f" {' '.join(text.split())} "


def needle(literal: str) -> str:
    """A literal as :func:`narrow` leaves it in a text."""
    return re.sub(r"\s+", " ", literal)


def phrase(pattern: str) -> str:
    """The longest literal that a narrow text has for each match: characters, and repeated classes of white space as one space.

    ``(?i)of[ \\n]+the[ \\n]+sea`` needs "of the sea", not only its three words anywhere.
    """
    best, now = "", ""
    for op, arg in parser.parse(pattern):
        if op is sre.AT:
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] and len(arg[2]) == 1:
            op, arg = arg[2][0]
            now += " " if op is sre.IN and all(o is sre.LITERAL and a < 128 and chr(a).isspace() or (o, a) == (sre.CATEGORY, sre.CATEGORY_SPACE) for o, a in arg) else "\0"
        else:
            now += chr(arg).lower() if op is sre.LITERAL and 0 < arg < 128 else "\0"
    best = max(map(needle, now.split("\0")), key=len)
    return best if len(best.strip()) >= SHORTEST else ""


def runs(pattern: str) -> list[frozenset[str]]:
    """Clauses of what stands together in a pattern: its characters, and small classes, also the ends of repeated ones.

    ``(?i)ci[ \\n]+n`` has a literal of two characters and one of one, but a match holds one of "ci " and "ci\\n".
    """
    out: list[list[frozenset[str]]] = [[]]
    for op, arg in parser.parse(pattern):
        one = lambda op, arg: frozenset([chr(arg).lower()]) if op is sre.LITERAL and arg < 128 else members(arg) if op is sre.IN else None
        if op is sre.AT:
            continue
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] and len(arg[2]) == 1:
            chars = one(*arg[2][0])
            # its first character follows what is before, its last one precedes what is behind
            if chars and DIGIT not in chars:
                out[-1].append(chars)
                out.append([chars])
                continue
        chars = one(op, arg)
        if chars and DIGIT not in chars:
            out[-1].append(chars)
        else:
            out.append([])
    return [frozenset(map("".join, itertools.product(*r))) for r in out if len(r) >= SHORTEST and math.prod(map(len, r)) <= SPELT]


def parsed(patterns: DataFrame) -> DataFrame:
    """(pid, clauses): of each pattern (pid, pattern) that compiles the clauses of long literals; none where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for pid, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    clauses = [c for c in required(pattern) if DIGIT not in c and min(map(len, c)) >= SHORTEST] or runs(pattern)
                    if whole := phrase(pattern):
                        clauses = [c for c in clauses if not any(needle(x) in whole for x in c)] + [[whole]]
                except (re.error, TypeError):  # not a pattern, or null: skipped, as catalogs do
                    continue
                ids.append(pid)
                found.append([sorted(c) for c in clauses])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.string())))], names=["pid", "clauses"])

    return patterns.select("pid", "pattern").mapInArrow(run, "pid long, clauses array<array<string>>")


class Automaton:
    """``candidates(text)``: the patterns of which every clause has a literal in the text."""

    def __init__(self, rows: list[tuple[int, list[list[str]]]]):
        import ahocorasick

        self.need = {pid: len(clauses) for pid, clauses in rows}
        users: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for pid, clauses in rows:
            for k, clause in enumerate(clauses):
                for literal in clause:
                    users[needle(literal)].append((pid, k))
        self.users = list(users.values())
        self.automaton = ahocorasick.Automaton()
        for i, literal in enumerate(users):
            self.automaton.add_word(literal, i)
        if users:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        if not self.users:
            return []
        seen = {i for _, i in self.automaton.iter(narrow(small(text)))}
        if not seen:
            return []
        got: dict[int, set[int]] = defaultdict(set)
        for i in seen:
            for pid, k in self.users[i]:
                got[pid].add(k)
        return sorted(pid for pid, own in got.items() if len(own) == self.need[pid])


def candidates(texts: DataFrame, rows: list[tuple[int, list[list[str]]]]) -> DataFrame:
    """(key, text, pids) of those texts that have any."""
    sent = texts.sparkSession.sparkContext.broadcast(rows)
    kept: dict[str, Automaton] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept.get("a") or kept.setdefault("a", Automaton(sent.value))
        for batch in batches:
            found = [automaton.candidates(t.as_py() or "") for t in batch.column(1)]
            at = pa.array([i for i, x in enumerate(found) if x], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([x for x in found if x], pa.list_(pa.int64()))], names=["key", "text", "pids"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text").mapInArrow(run, f"key {kind}, text string, pids array<long>")


def matches(texts: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", limited: bool = True, unicode: bool = True) -> DataFrame:
    """(key, pattern_id, n): each pattern of ``patterns`` (pattern_id, pattern) that matches a text, and how often.

    Equal to testing every text with every pattern. Patterns that don't compile, and null ones, are skipped; null texts
    match nothing; rows with one key, or none, are texts each; rows with one pattern_id are patterns each. Patterns never
    match the empty string. The table of patterns comes to the driver in parts of PART at most, so neither it nor a worker
    holds more; patterns without a long literal are tested on all texts, BARE in one projection. More of them, which make
    as many more passes over the texts, are an error if ``limited``.
    Classes and word boundaries are Python's if ``unicode``, else SQL's (:func:`textward.functions.spans.java`).
    There is no cross join; texts are shuffled only where the patterns are more than FEW. Other columns are ignored.
    """
    spark = texts.sparkSession
    slim = texts.select(col(key).alias("key"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    # numbered by what they are, so that a task that runs again gives the same numbers
    listed = patterns.select(F.xxhash64("pattern_id", "pattern").alias("pid"), "pattern_id", "pattern").filter("pattern is not null")
    known = parsed(listed.select("pid", "pattern").distinct()).persist()
    try:
        few = known.filter("size(clauses) = 0").select("pid")
        bare = sorted(r[0] for r in (few.limit(BARE + 1) if limited else few).collect())
        if limited and len(bare) > BARE:
            raise ValueError(f"more than {BARE} patterns have no literal of {SHORTEST} characters")
        n = known.filter("size(clauses) > 0").count()
        parts = max(1, -(-n // PART))
        own = F.pmod(F.hash("pid"), F.lit(parts))
        sides = []
        for k in range(parts):
            rows = [(r.pid, r.clauses) for r in known.filter((F.size("clauses") > 0) & (own == k)).collect()]
            if rows:
                sides.append(candidates(slim, rows).select("key", "text", F.explode("pids").alias("pid")))
    finally:
        known.unpersist()
    compiled = F.udf(lambda p: java(p, unicode), "string")("pattern")
    table = listed.withColumn("p", compiled)
    table = F.broadcast(table) if n + len(bare) <= FEW else table
    out = []
    for lo in range(0, len(bare), BARE):
        own = [tuple(r) for r in listed.filter(F.col("pid").isin(bare[lo : lo + BARE])).select("pid", "pattern").distinct().collect()]
        told = flags(F.col("text"), [(f"b{i}", p, "", "") for i, (_, p) in enumerate(own)], unicode)
        hit = F.filter(F.array(*(F.when(F.col("f")[f"b{i}"], F.lit(pid)) for i, (pid, _) in enumerate(own))), lambda x: x.isNotNull())
        sides.append(slim.withColumn("f", told).select("key", "text", F.explode(hit).alias("pid")))
    for side in sides:
        each = side.join(table, "pid").withColumn("n", F.regexp_count("text", F.col("p")).cast("long"))
        out.append(each.filter("n > 0").select(F.col("key").alias(key), "pattern_id", "n"))
    if not out:
        return spark.createDataFrame([], f"{quoted(key)} {slim.schema['key'].dataType.simpleString()}, pattern_id {patterns.schema['pattern_id'].dataType.simpleString()}, n long")
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first
