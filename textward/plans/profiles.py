"""Profiles that add up: sketches of what scans found, stored by part, merged without reading a text again.

Where distinct keys must be counted exactly the rows that a profile sums up (:func:`findings`) are stored beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.functions.columns import col
from textward.functions.spans import counts
from textward.plans.guard import CATALOGS
from textward.sources import catalogs as C

#: Distinct keys are counted within 1.04 / sqrt(2**LG_K), 0.4 %; a few hundred are exact.
LG_K = 16
#: Ranks of quantiles are within 0.7 %.
KLL_K = 400


def findings(df: DataFrame, key: str, by: list[str], text: str = "text", kind: str = "pii") -> DataFrame:
    """What a profile sums up: for each row of ``df`` one of type null and one for each type found: ``by``, _key, all, type, top, n."""
    rows = CATALOGS[kind]
    heads = F.array(*(F.struct(F.lit(r[0]).alias("type"), F.lit(C.SEVERITY[r[2]]).alias("top")) for r in rows))
    found = F.filter(F.transform(counts(col(text), rows), lambda n, i: F.struct(F.get(heads, i)["type"].alias("type"), F.get(heads, i)["top"].alias("top"), n.alias("n"))), lambda x: x["n"] > 0)
    total = F.struct(F.lit(None).cast("string").alias("type"), F.coalesce(F.array_max(F.transform("found", lambda x: x["top"])), F.lit(0.0)).alias("top"), F.lit(1).cast("long").alias("n"))
    each = df.select(*map(col, by), col(key).alias("_key"), found.alias("found"))
    each = each.select(*map(col, by), "_key", F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("all"), F.explode(F.concat(F.array(total), F.col("found"))).alias("x"))
    return each.select(*map(col, by), "_key", "all", "x.*")


def summed(found: DataFrame, by: list[str]) -> DataFrame:
    """The profile of :func:`findings`."""
    amount = F.when(F.col("type").isNull(), F.col("all")).otherwise(F.col("n")).cast("double")
    return found.groupBy(*map(col, by), "type").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.hll_sketch_agg(F.xxhash64("_key"), LG_K).alias("keys"), F.kll_sketch_agg_double(amount, KLL_K).alias("amounts"))


def exact_keys(found: DataFrame, by: list[str]) -> DataFrame:
    """``by``, type and n_keys: how many different keys have findings of a type, exactly; null keys don't count."""
    return found.groupBy(*map(col, by), "type").agg(F.count_distinct("_key").alias("n_keys"))


def profile(df: DataFrame, key: str, by: list[str], text: str = "text", kind: str = "pii") -> DataFrame:
    """A row for each group of ``by`` and type found, and one of type null for the group itself: n, top, keys, amounts.

    ``n`` are findings (rows, for the group itself), ``top`` the largest severity's score, ``keys`` a sketch of the different keys
    that have some, ``amounts`` one of how many a key has. To be stored, for each day or batch, and merged. Null texts
    count as rows, with nothing in them.
    """
    return summed(findings(df, key, by, text, kind), by)


def merge(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Profiles of finer parts, or of other days, as profiles of ``by``: the same columns, to be merged again."""
    return profiles.groupBy(*map(col, by), "type").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("amounts", KLL_K).alias("amounts"))


def read(profiles: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """What profiles say: n, top, n_keys, and the quantiles of a key's findings."""
    at = [F.kll_sketch_get_quantile_double("amounts", F.lit(q)).alias(f"q{q:g}".replace(".", "_")) for q in quantiles]
    keep = [col(c) for c in profiles.columns if c not in ("keys", "amounts")]
    return profiles.select(*keep, F.hll_sketch_estimate("keys").alias("n_keys"), *at)


def joined(parts: list[DataFrame], by: list[str]) -> DataFrame:
    """Stored tables of profiles, as one profile."""
    return merge(reduce(DataFrame.unionByName, parts), by)
