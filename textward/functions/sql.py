"""The scanners for SQL users: scalar functions that stay in the JVM, and a table function of findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textward.functions.prefilter import DIGIT, prefilter
from textward.functions.spans import java, python
from textward.sources import catalogs as C

CATALOGS = {"pii": C.PII, "code": C.CODE, "secrets": C.SECRETS}
FINDINGS = "catalog string, type string, severity string, start int, end int, value string"


def literal(x: str) -> str:
    """A string literal, with what SQL reads as an escape escaped."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def score_expression(column: str, rows: list[tuple]) -> str:
    """As :func:`textward.functions.spans.top_score`, in SQL."""
    by: dict[float, list[str]] = {}
    for _, p, severity, *_ in rows:
        by.setdefault(C.SEVERITY.get(severity, 0.5), []).append(f"{column} RLIKE {literal(java(p))}")
    return "CASE " + " ".join(f"WHEN {' OR '.join(by[s])} THEN {s}D" for s in sorted(by, reverse=True)) + " ELSE 0.0D END"


class ScanFindings:
    """scan_findings(text): a row for each match of each catalog's patterns; null gives none."""

    def __init__(self):
        self.rows = [(k, i, s, re.compile(python(p))) for k, rows in CATALOGS.items() for i, p, s, *_ in rows]

    def eval(self, text: str):
        for k, i, s, p in self.rows:
            for m in p.finditer(text or ""):
                yield k, i, s, m.start(), m.end(), m.group()


TABLE = "key string, " + FINDINGS


class ScanTable:
    """scan_table(TABLE(SELECT key, text ...)): the same for whole Arrow batches of a table; patterns read only texts that hold their literals."""

    def __init__(self):
        self.catalogs = [(k, [(i, s, re.compile(python(p))) for i, p, s, *_ in rows], prefilter([r[1] for r in rows])) for k, rows in CATALOGS.items()]

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            low, odd = text.lower(), not text.isascii()
            digit = any(c.isdigit() for c in low)
            for name, rows, made in self.catalogs:
                has = {n for n in made.needles if (digit if n == DIGIT else n in low)}
                for (i, s, p), clauses, folds in zip(rows, made.clauses, made.odd, strict=True):
                    if odd and folds or all(c & has for c in clauses):
                        out += [(key, name, i, s, m.start(), m.end(), m.group()) for m in p.finditer(text)]
        kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
        yield pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=[c.split()[0] for c in TABLE.split(", ")])


def register(spark: SparkSession) -> None:
    """Makes pii_score(text), code_score(text), secrets_score(text) and the table functions scan_findings(text) and scan_table(TABLE(...)) known to the session.

    The scores are SQL functions, which the optimizer replaces by their expression. The table function runs in Python, for
    LATERAL joins; over whole corpora :func:`textward.plans.guard.findings_table` gives the same rows without it.
    """
    for name, rows in CATALOGS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_score(t STRING) RETURNS DOUBLE RETURN {score_expression('t', rows)}")
    spark.udtf.register("scan_findings", F.udtf(ScanFindings, returnType=FINDINGS))
    spark.udtf.register("scan_table", F.arrow_udtf(ScanTable, returnType=TABLE))
