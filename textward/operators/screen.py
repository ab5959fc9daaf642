"""The second screen: at most one threat for each of eight patterns, and optional model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.columns import col as col_of
from textward.functions.columns import others, unused
from textward.functions.prefilter import guarded
from textward.functions.spans import hit, java
from textward.sources.catalogs import SCREEN

THREAT = "struct<type:string,confidence:double,level:string,matched:string>"


def pattern(p: str, ignore_case: bool) -> str:
    return f"(?i){p}" if ignore_case else p


def threats(text: Column) -> Column:
    """The patterns' threats in order; what the first match shows is its first four characters."""

    def one(may, name, p, level):
        m = F.regexp_extract(text, java(p), 0)
        shown = F.when(F.length(m) > 4, F.concat(F.substring(m, 1, 4), F.lit("***"))).otherwise(F.lit("***"))
        return F.when(may & hit(text, p), F.struct(F.lit(f"pii_{name}").alias("type"), F.lit(1.0).alias("confidence"), F.lit(level).alias("level"), shown.alias("matched")))

    rows = [(n, pattern(p, i), lv) for n, p, i, lv in SCREEN]
    return guarded(text, [r[1] for r in rows], lambda may: F.filter(F.array(*(one(may(i), *r) for i, r in enumerate(rows))), lambda x: x.isNotNull()))


def model_threat(kind: str, score: Column, threshold: float) -> Column:
    """A model's threat above its threshold: critical above 0.9, high above 0.7."""
    level = F.when(score > 0.9, "critical").when(score > 0.7, "high").otherwise("medium")
    return F.when(score > threshold, F.struct(F.lit(kind).alias("type"), score.alias("confidence"), level.alias("level"), F.lit(None).cast("string").alias("matched")))


def screen(df: DataFrame, text: str = "text", injection: Column | None = None, harmful: Column | None = None, injection_threshold: float = 0.5, harmful_threshold: float = 0.5, block_threshold: float = 0.7, pii: bool = True, out: str = "screen") -> DataFrame:
    """Adds a struct: blocked, risk_score (the largest confidence), threats, scanners_used. Null texts are screened as empty.

    A column named as ``out`` is replaced, all others stay.
    """
    col = F.coalesce(F.col(text), F.lit(""))
    models = [(k, s, t) for k, s, t in (("prompt_injection", injection, injection_threshold), ("harmful_content", harmful, harmful_threshold)) if s is not None]
    found = F.filter(F.array(*(model_threat(*m) for m in models)), lambda x: x.isNotNull()) if models else F.array().cast(f"array<{THREAT}>")
    if pii:
        found = F.concat(found, threats(col))
    used = [k for k, _, _ in models] + ["pii_detection"] * pii
    name, given = unused(df, "_t")[0], others(df, out)
    df, t = df.withColumn(name, found), col_of(name)
    most = F.coalesce(F.array_max(F.transform(t, lambda x: x["confidence"])), F.lit(0.0))
    risk = F.greatest(most, *(F.coalesce(s, F.lit(0.0)) for _, s, _ in models)) if models else most
    blocked = (risk >= block_threshold) | F.exists(t, lambda x: x["level"].isin("high", "critical"))
    listed = F.array(*map(F.lit, used)) if used else F.array().cast("array<string>")
    return df.select(*given, F.struct(blocked.alias("blocked"), risk.alias("risk_score"), t.alias("threats"), listed.alias("scanners_used")).alias(out))
