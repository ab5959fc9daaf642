import json
import os
import random
from bisect import bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textward.operators import judging, thresholds
from textward.plans import asof


# ---- the judge's answers

def judge_in(path, dies_at=None, fails=()):
    """A judge that notes each call in a file; it ends its worker at a call, or fails for some prompts."""

    def load():
        def ask(prompt):
            with open(path, "a", encoding="utf-8") as f:
                f.write(json.dumps(prompt) + "\n")
            with open(path, encoding="utf-8") as f:
                n = len(f.readlines())
            if dies_at and n >= dies_at:
                raise SystemExit("lost")
            if prompt in fails:
                raise ValueError("no")
            return json.dumps({"faithful": len(prompt) % 2 == 0, "confidence": 0.5})

        return ask

    return load


def calls(path):
    return [json.loads(x) for x in open(path, encoding="utf-8")] if os.path.exists(path) else []


def test_each_prompt_is_asked_once_over_a_lost_run(spark, tmp_path):
    prompts = [f"question {i % 40}" for i in range(200)] + [None, ""]
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(prompts)], "id long, prompt string, prompt_key string")
    log, store = str(tmp_path / "calls"), f"file://{tmp_path}/answers"
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a lost worker
        judging.ask_all(df, "j1", judge_in(log, dies_at=17), store, tasks=1, chunk=1)
    first = calls(log)
    assert len(first) >= 17
    done = judging.ask_all(df, "j2", judge_in(log), store, tasks=4, chunk=1)
    told = calls(log)
    # the call at which the worker was lost, and no other, was made again
    assert set(told) == {p for p in prompts if p is not None} and len(told) - len(set(told)) <= len([p for p in first if first.count(p) > 1 or p in first[16:]]) and done["failed"] == 0
    assert judging.ask_all(df, "j3", judge_in(log), store) == {"asked": 0, "failed": 0}
    rows = judging.with_answers(df, store).collect()
    assert len(rows) == len(prompts) and all((json.loads(r.judge)["faithful"] == (len(r.prompt) % 2 == 0)) if r.prompt is not None else r.judge is None for r in rows)
    assert all(r.prompt_key == "x" for r in rows)


def test_failures_wait_for_the_next_run(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i}",) for i in range(10)], "prompt string")
    log, store = str(tmp_path / "calls"), f"file://{tmp_path}/answers"
    assert judging.ask_all(df, "f1", judge_in(log, fails=("q3", "q4")), store, tasks=2, tries=2, wait=0.0) == {"asked": 10, "failed": 2}
    assert {r.prompt for r in judging.with_answers(df, store).filter("judge is null").collect()} == {"q3", "q4"}
    assert {r.error for r in spark.read.schema(judging.STORED).parquet(store).filter("error is not null").collect()} == {"ValueError: no"}
    assert judging.ask_all(df, "f2", judge_in(log), store, tasks=2) == {"asked": 2, "failed": 0}
    assert sorted(calls(log)) == sorted([f"q{i}" for i in range(10)] + ["q3", "q3", "q4", "q4"])


def test_calls_a_second_are_bounded(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i}",) for i in range(12)], "prompt string")
    times = str(tmp_path / "times")

    def load():
        import time

        def ask(p):
            with open(times, "a") as f:
                f.write(f"{time.time()}\n")
            return "{}"

        return ask

    judging.ask_all(df, "t", load, f"file://{tmp_path}/answers", per_second=8, tasks=2)
    at = sorted(float(x) for x in open(times))
    assert at[-1] - at[0] >= (12 / 2 - 1) / 4 * 0.8


# ---- configurations as of a time

@pytest.mark.parametrize("span", [60, 3600, 10**9])
def test_as_of_against_search_in_each_tenant(spark, span):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    when = lambda: start + timedelta(seconds=rng.randint(0, 20_000) * 10)
    tenant = lambda: rng.choice(["hot", "hot", "a", "b", "never", None])
    rows = [(i, tenant(), when() if i % 17 else None, "k", "old") for i in range(1500)]
    versions = [(rng.choice(["hot", "a", "b", "other", None]), when() if i % 13 else None, f"v{i:03d}") for i in range(150)]
    versions += [("hot", versions[1][1], "v999"), ("hot", versions[1][1], "v998")]
    left = spark.createDataFrame(rows, "id long, tenant string, ts timestamp, k string, config string").repartition(5)
    right = spark.createDataFrame(versions, "tenant string, since timestamp, config string")
    got = asof.as_of(left, right, "tenant", "ts", span=span)
    known = {}
    for t, s, v in sorted(x for x in versions if None not in x):
        known.setdefault(t, {})[s] = v
    def want(t, ts):
        times = sorted(known.get(t, {}))
        k = bisect_right(times, ts) if ts else 0
        return known[t][times[k - 1]] if k else None
    assert got.columns == left.columns and sorted(map(tuple, got.collect())) == sorted(((i, t, ts, k, want(t, ts)) for i, t, ts, k, _ in rows), key=lambda r: r[0])
    assert asof.as_of(left.limit(0), right, "tenant", "ts").collect() == []
    assert {r.config for r in asof.as_of(left, right.limit(0), "tenant", "ts").collect()} == {None}


# ---- thresholds

def brute_sweep(rows):
    live = [(s, bool(y)) for s, y in rows if s is not None and y is not None]
    pos, neg = sum(y for _, y in live), sum(not y for _, y in live)
    out = []
    for t in sorted({s for s, _ in live}, reverse=True):
        tp, fp = sum(y for s, y in live if s >= t), sum(not y for s, y in live if s >= t)
        out.append((t, tp, fp, pos - tp, neg - fp))
    wins = sum((a > b) + 0.5 * (a == b) for a, y in live if y for b, z in live if not z)
    return out, wins / (pos * neg) if pos and neg else None


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_thresholds_against_each_by_itself(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([rng.random(), rng.randint(0, 9) / 10, 0.5]) if i % 19 else None, rng.randint(0, 1) if i % 23 else None) for i in range(700)]
    got = thresholds.sweep(spark.createDataFrame(rows, "score double, label int"), parts=parts).collect()
    want, auc = brute_sweep(rows)
    assert sorted(((r.threshold, r.tp, r.fp, r.fn, r.tn) for r in got), reverse=True) == want
    assert all(r.auc == pytest.approx(auc) for r in got)
    top = max(2 * tp / (2 * tp + fp + fn) for _, tp, fp, fn, _ in want)
    assert {r.threshold for r in got if r.best} == {t for t, tp, fp, fn, _ in want if 2 * tp / (2 * tp + fp + fn) == top}


def test_thresholds_of_odd_tables(spark):
    one = thresholds.sweep(spark.createDataFrame([(0.5, True), (0.7, True)], "score double, label boolean")).collect()
    assert [(r.tp, r.fp, r.auc, r.recall) for r in sorted(one)] == [(2, 0, None, 1.0), (1, 0, None, 0.5)]
    assert thresholds.sweep(spark.createDataFrame([], "score double, label boolean")).collect() == []
    assert thresholds.sweep(spark.createDataFrame([(0.5, False)], "score double, label boolean")).select(F.col("recall")).first()[0] is None
