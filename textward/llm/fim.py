"""Fill-in-the-middle: texts cut in three at ranks of units, found from sparse events of one Aho-Corasick scan.

A text falls, from left to right, into units ``[marks]{1,size}|[^marks]{1,size}``: ``marks`` are the ASCII characters at
which the class changes. One automaton finds them and the sentinels; what lies between two events is a run of one class,
whose units are counted by division. So a rank is looked up among the runs, and no table of all units is made.
With size 1 each code point is a unit, with no size each run is one: words and what parts them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SENTINELS = ("<P>", "<S>", "<M>")
MARKS = " \t\n\r\x0b\x0c"
OUT = "doc_id long, n_units long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"
#: Characters of text that a worker turns at once.
CHUNK = 4_000_000


@dataclass(frozen=True)
class Rule:
    """Units, sentinels (before prefix, suffix, middle), the seed of the draws, and shares in percent."""

    marks: str = MARKS
    size: int | None = 1
    sentinels: tuple[str, str, str] = SENTINELS
    seed: int = 1
    cut: int = 90
    suffix_first: int = 20

    def __post_init__(self):
        if not self.marks.isascii() or self.size is not None and self.size < 1:
            raise ValueError("marks are ASCII characters; size is at least 1, or None")
        if len(set(self.sentinels)) != 3:
            raise ValueError("three different sentinels")
        for a in self.sentinels:
            for b in self.sentinels:
                if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b) + (a != b))):
                    raise ValueError(f"sentinels {a!r} and {b!r} could overlap: a form could not be told apart again")


class Scanner:
    """``runs(text)``: bounds of the runs, the units before each and in all, and whether the text has a sentinel."""

    def __init__(self, rule: Rule):
        import ahocorasick

        self.size, self.automaton = rule.size, ahocorasick.Automaton()
        for c in rule.marks:
            self.automaton.add_word(c, False)
        for s in rule.sentinels:
            self.automaton.add_word(s, True)
        self.automaton.make_automaton()

    def runs(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        events, seen = array("q"), False
        put = events.append
        for end, sentinel in self.automaton.iter(text):
            if sentinel:
                seen = True
            else:
                put(end)
        at = np.frombuffer(events, np.int64) if events else np.zeros(0, np.int64)
        bounds = np.zeros(0, np.int64)
        if len(at):  # from the first to after the last of each run of marks
            gap = np.flatnonzero(np.diff(at) > 1)
            bounds = np.stack([at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + 1], 1).ravel()
        bounds = np.unique(np.concatenate([[0], bounds, [len(text)]]).astype(np.int64))
        own = np.diff(bounds)
        units = -(-own // self.size) if self.size else np.ones(len(own), np.int64)
        return bounds, np.concatenate([[0], np.cumsum(units)]).astype(np.int64), seen

    def place(self, bounds: np.ndarray, before: np.ndarray, rank: int) -> int:
        """The code point after ``rank`` units."""
        i = int(np.searchsorted(before, rank, "right")) - 1
        return int(bounds[i]) + (rank - int(before[i])) * (self.size or 0)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers that depend on the seed and the doc_id alone; null has no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def turned(scanner: Scanner, rule: Rule, doc_id: int | None, text: str) -> tuple:
    """A row of OUT."""
    bounds, before, seen = scanner.runs(text)
    n, (h1, h2, h3, h4) = int(before[-1]), draws(rule.seed, doc_id)
    if not text or seen or h3 % 100 >= rule.cut:
        return doc_id, n, "plain", None, None, None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = scanner.place(bounds, before, lo), scanner.place(bounds, before, hi)
    prefix, suffix, middle = rule.sentinels
    if h4 % 100 < rule.suffix_first:
        form, parts = "spm", (suffix, text[b:], prefix, text[:a], middle, text[a:b])
    else:
        form, parts = "psm", (prefix, text[:a], suffix, text[b:], middle, text[a:b])
    return doc_id, n, form, lo, hi - lo, a, b - a, "".join(parts)


def transform(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): its units, its form, the cuts in units and code points, and the output text.

    ``plain``: the text as it is; without a unit, with a sentinel in it, or by the third draw. Else the first two draws give
    the ends of prefix and middle, and the fourth says whether the suffix comes first (``spm``) or the prefix (``psm``).
    Null texts are empty; rows with one doc_id are cut at the same draws, each in its own text; a null doc_id has draws of its
    own. Other columns are ignored, whatever their names; an empty table gives no rows. There is no shuffle. A worker holds
    a text, its output and eight bytes for each mark in it.
    """
    rule = rule or Rule()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, rows, held = common.only(f"fim {rule}", lambda: Scanner(rule)), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(turned(scanner, rule, doc_id.as_py(), text.as_py() or ""))
                held += len(rows[-1][-1])
                if held > CHUNK:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])

    return common.columns(docs, doc_id="long", text="string").mapInArrow(turn, OUT)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that :func:`transform` was given, from its output and form alone."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1)))


def oracle() -> str:
    """The contract's query in SQL."""
    h = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))
    return f"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
c as (select doc_id, text, length(text)::bigint as n, {h} from d),
f as (select *, case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from c),
p as (select *, substr(text, 1, a) as prefix, substr(text, a + 1, b - a) as middle, substr(text, b + 1) as suffix from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p
"""
