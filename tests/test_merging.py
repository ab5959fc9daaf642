import random
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textward.functions import sql
from textward.functions.spans import unions
from textward.operators import scanners
from textward.plans import config, guard, observed, profiles
from textward.sources import catalogs as C
from textward.sources import fixtures
from textward.streaming.replay import Replay, drain


# ---- overlapping matches

def brute_unions(spans, rank):
    out = []
    for s, e, o in sorted(spans):
        if out and s < out[-1][1]:
            a, b, p = out[-1]
            out[-1] = (a, max(b, e), min(p, o, key=lambda x: (-rank[x], x)))
        else:
            out.append((s, e, o))
    return out


def test_unions_against_each_span(spark):
    rng, rank = random.Random(4), [0.3, 0.95, 0.5, 0.95, 0.3]
    rows = [[(s, s + rng.randint(1, 9), rng.randrange(5)) for s in (rng.randint(0, 40) for _ in range(rng.randint(0, 10)))] for _ in range(500)]
    df = spark.createDataFrame([(r,) for r in rows], "f array<struct<start:int,end:int,ord:int>>")
    got = [[tuple(x) for x in r[0]] for r in df.select(unions(F.col("f"), F.array(*map(F.lit, rank)))).collect()]
    assert got == [brute_unions(r, rank) for r in rows]


def test_nothing_of_a_match_stays_and_nothing_else_goes(spark):
    rng = random.Random(6)
    parts = ["4111111111111111", "123-45-6789", "212-555-0147", "90210", "a@b.co", "é 日", " word ", "-", "acct 12345678", "1" * 12, "🎉"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(600)] + ["", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    from textward.functions.spans import found

    rows = df.select("text", scanners.pii_covered(F.col("text")).alias("c"), found(F.col("text"), C.PII).alias("f")).collect()
    overlapping = 0
    for r in rows:
        if r.text is None:
            assert r.c is None
            continue
        spans = brute_unions([(x.start, x.end, x.ord) for x in r.f], [0] * len(C.PII))
        overlapping += len(spans) < len(r.f)
        want, at = "", 0
        for s, e, _ in spans:
            want, at = want + r.text[at:s] + "[REDACTED]", e
        assert r.c == want + r.text[at:]
    assert overlapping > 50


# ---- metrics

def test_metrics_are_those_of_the_rows(spark):
    df = spark.createDataFrame([(t,) for t in fixtures.PII + fixtures.CODE + fixtures.SECRETS + fixtures.PHRASES + [None]], "text string")
    seen = Observation()
    rows = observed.observed(df, seen, direction="output").collect()
    told, plan = seen.get, [i for i, _ in guard.planned(config.Config(), "output")]
    assert told["n_rows"] == len(rows) and told["n_blocked"] == sum(r.scan.blocked for r in rows)
    for i in plan:
        own = [r.scan.checks[i] for r in rows if i in r.scan.checks]
        assert [told[f"{i}_{f}"] for f in observed.FIELDS] == [len(own), len(rows) - len(own), sum(c.score > 0 for c in own), sum(not c.passed for c in own)]
    assert told["toxicity_spared"] > 0
    assert observed.timed(df.limit(0), lambda d: d.collect())["ms_per_row"] is None


def test_metrics_take_no_second_job(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("zip "), F.col("id") + 10000).alias("text"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "one job")
    told = observed.timed(df, lambda d: d.write.parquet(str(tmp_path / "out")))
    jobs = tracker.getJobIdsForGroup("observed")
    spark.sparkContext.setJobGroup("", "")
    assert told["pii_hits"] == 100 and told["ms_per_row"] > 0 and len(jobs) == 1


def test_metrics_of_a_stream(spark):
    rows = spark.createDataFrame([(i, "SSN 123-45-6789" if i % 4 == 0 else "hello") for i in range(40)], "id long, text string")
    replay, listener = Replay(spark, rows.schema, 1), observed.Durations("scan_metrics")
    for k in range(2):
        replay.arrive(rows.filter(F.col("id") % 2 == k).coalesce(1))
    spark.streams.addListener(listener)
    try:
        drain(spark, lambda: observed.observed(replay.stream(), "scan_metrics").select("id", "scan.blocked"))
        for _ in range(50):
            if sum(b["rows"] for b in listener.batches) == 40:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    full = [b for b in listener.batches if b["rows"]]
    assert [b["rows"] for b in full] == [20, 20] and all(b["ms"] > 0 for b in full)
    assert sum(b["metrics"]["n_blocked"] for b in full) == 10 and sum(b["metrics"]["injection_spared"] for b in full) == 10


# ---- profiles

def test_profiles_of_parts_are_the_whole_ones(spark):
    rng = random.Random(8)
    rows = [(i % 4000, f"d{i % 7}", rng.choice(["en", "de", None]), " ".join(["zip", *(str(rng.randint(10000, 99999)) for _ in range(rng.randint(0, 5)))]) if i % 50 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, day string, lang string, text string")
    days = [profiles.profile(df.filter(F.col("day") == f"d{k}"), "id", ["day", "lang"]) for k in range(7)]
    first, rest = profiles.joined(days[:3], ["lang"]), profiles.joined(days[3:], ["lang"])
    got = {(r.lang, r.type): r for r in profiles.read(profiles.joined([first, rest], ["lang"])).collect()}
    whole = {(r.lang, r.type): r for r in profiles.read(profiles.profile(df, "id", ["lang"])).collect()}
    assert got.keys() == whole.keys()
    for k, r in got.items():
        keys, amounts = set(), []
        for i, _, lang, text in rows:
            n = len((text or "").split()) - 1 if text else 0
            if lang == k[0] and (k[1] is None or n > 0):
                keys.add(i)
                amounts.append(n)
        amounts.sort()
        assert r.n == whole[k].n == (len(amounts) if k[1] is None else sum(amounts)) and r.top == whole[k].top
        assert abs(r.n_keys - len(keys)) <= max(1, 0.02 * len(keys))
        assert amounts[int((0.5 - 0.03) * len(amounts))] <= r.q0_5 <= amounts[int((0.5 + 0.03) * len(amounts))]


def test_distinct_keys_of_a_large_group_are_exact(spark, tmp_path):
    from textward import catalog

    n = 30_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('s', id % 7) as source", "if(id % 3 = 0, null, 'en') as lang", "if(id % 2 = 0, 'zip 90210', 'plain') as text")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["merged_profile"](spark, f"file://{tmp_path}").collect()), key=repr)
    assert got == sorted([("en", None, 20_000, 20_000), (None, None, 10_000, 10_000), ("en", "zip_code", 10_000, 10_000), (None, "zip_code", 5_000, 5_000)], key=repr)


# ---- the table functions

def test_table_function_gives_findings_faster(spark, sf):
    sql.register(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) as key", "text")
    seeds = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(fixtures.PII + fixtures.CODE + fixtures.SECRETS + [None, "ſelect pıd FROM x; paſſport: X1234567"])], "key string, text string")
    rows = docs.union(seeds).cache()
    cols = "key, catalog, type, severity, start, end, value"
    took = {}
    got = {}
    for name, source in (("lateral", "{rows}, LATERAL scan_findings(text)"), ("table", "scan_table(TABLE(SELECT key, text FROM {rows}))"), ("parted", "scan_table(TABLE(SELECT key, text FROM {rows}) PARTITION BY key)")):
        began = time.time()
        got[name] = sorted(map(tuple, spark.sql(f"SELECT {cols} FROM {source}", rows=rows).collect()))
        took[name] = time.time() - began
    assert got["lateral"] == got["table"] == got["parted"] and len(got["table"]) > 100
    want = guard.findings_table(rows, "key", style="full").groupBy("key", "type").count().collect()
    seen = {}
    for key, _, kind, *_ in got["table"]:
        seen[key, kind] = seen.get((key, kind), 0) + 1
    assert seen == {(r.key, r.type): r["count"] for r in want}


@pytest.mark.parametrize("text", ["", "no match", "123-45-6789"])
def test_covering_in_other_styles(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(*(scanners.pii_covered(F.col("text"), s).alias(s) for s in ("full", "partial", "hash"))).first()
    assert row.partial == text.replace("123-45-6789", "***-**-6789") and row.full == text.replace("123-45-6789", "[REDACTED]")
