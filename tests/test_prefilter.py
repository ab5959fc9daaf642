import random

import pytest
from pyspark.sql import functions as F

from textward.functions.prefilter import DIGIT, n_tests, prefilter, required
from textward.functions.spans import counts, flags, found, hit, score_of, spans, top_score
from textward.operators import screen
from textward.plans import guard
from textward.sources import catalogs as C
from textward.sources import fixtures

PARTS = [
    "select", "SELECT ", "ſelect", "unİon ", "from ", "drop table", "<ſcript>", "<script>", "javascript:", "javaſcript:", "onload", "on", "=", ";", "--", "|", "||", "&&", " rm", "\nrm ", "`x`", "$(", "123-45-6789", "4111111111111111", "٣٤٥-٦٧-٨٩٠١", "٣" * 9, "5",
    "a@b.co", "dob: 1/2/1990", "driver's licenſe AB12345", "DL 123456", "passport: X123456", "pasſport X123456", "acct 12345678", "aba 123456789", "12 Main St", "12 Main Ave", "AKIA" + "A" * 16, "sk-" + "a" * 24, "pwd=secretß", "pwd = 1234", "apı_key=" + "a" * 24, "api_Key=" + "a" * 24, "://", "redis://u:p@h", "ss", " ", "é", "日", "🎉",
]


def texts(n=3000):
    rng = random.Random(7)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    return made + fixtures.PII + fixtures.CODE + fixtures.SECRETS + [None, "", "x" * 50000 + " 123-45-6789"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id long, text string").repartition(4).cache()


@pytest.mark.parametrize("catalog", [C.PII, C.CODE, C.SECRETS, C.fallback_pii(), C.fallback_code(), [(n, screen.pattern(p, i), "high", "") for n, p, i, _ in C.SCREEN]])
def test_guarded_patterns_hit_what_plain_ones_hit(rows, catalog):
    t = F.col("text")
    plain = F.array(*(hit(t, r[1]) for r in catalog))
    guarded = F.array(*(F.col(f"f.{r[0]}") for r in catalog))
    both = rows.withColumn("f", flags(t, catalog)).select("text", plain.alias("a"), guarded.alias("b"), n_tests(t, [r[1] for r in catalog]).alias("n"), F.aggregate(plain, F.lit(0), lambda s, x: s + x.cast("int")).alias("hits"))
    assert both.filter("a != b").collect() == []
    told = both.agg(F.count_if(F.col("n") < F.col("hits")), F.avg("n"), F.avg("hits")).first()
    assert told[0] == 0 and told[2] > 0 and told[1] < 0.6 * len(catalog)


@pytest.mark.parametrize("catalog", [C.PII, C.CODE, C.SECRETS])
def test_one_reading_gives_spans_scores_and_counts(rows, catalog):
    t = F.col("text")
    plain = F.concat(*(F.transform(spans(t, r[1]), lambda x: F.struct(F.lit(i).alias("ord"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))) for i, r in enumerate(catalog)))
    told = rows.withColumn("x", found(t, catalog)).select(plain.alias("a"), "x", score_of(F.col("x"), catalog).alias("s"), top_score(t, catalog).alias("t"), counts(t, catalog).alias("n"))
    assert told.filter("a != x or s != t or aggregate(n, 0L, (s, y) -> s + y) != size(x)").collect() == []


@pytest.mark.parametrize(
    ("pattern", "clauses"),
    [
        (r"(?i)\bDROP\s+(TABLE|VIEW)\b", [{"drop"}, {"table", "view"}]), (r"a{2,}b+c*", [{"aa"}, {"b"}]), (r"x?y*", []), (r"foo(?:bar|baz)?qux", [{"foo"}, {"qux"}]), (r"\d{3}-", [{"-"}, {DIGIT}]), (r"(?:25[0-5]|[01]?\d)\.", [{"."}, {DIGIT}]),
        (r"[^a]b", [{"b"}]), (r"(?:|abc)", []), (r"(?!no)yes", [{"yes"}]), (r"d(?:river|l)", [{"dl", "driver"}, {"d"}]), (r"[ab]z", [{"z"}, {"a", "b"}]), (r"[٣]x", [{"x"}]), (r"(a|b)\1", [{"a", "b"}]),
    ],
)
def test_clauses(pattern, clauses):
    assert sorted(map(sorted, required(pattern))) == sorted(map(sorted, clauses))


def test_a_catalog_without_literals_is_only_read(spark):
    rows = [("any", r"[^x]", "low", ""), ("all", r".", "high", "")]
    assert prefilter([r[1] for r in rows]).needles == []
    got = spark.createDataFrame([("x",), ("",), (None,), ("ab",)], "text string").select(top_score(F.col("text"), rows)).collect()
    assert [r[0] for r in got] == [0.7, 0.0, 0.0, 0.7]


STRANGE = ["text", "a.b", "blocked", "Risk_Score", "checks_run", "_t", "_x", "_v_pii", "_v_stop_fast", "_scan_pii", "_scan_hits", "_scan_stop_fast", "scan", "screen", "score", "block_reason", "input_scan", "a`b", "x", "f"]


def test_columns_with_clashing_names_stay(spark):
    from textward.functions.columns import quoted

    values = ["SSN 123-45-6789", *range(len(STRANGE) - 1)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{quoted(c)} {'string' if c == 'text' else 'long'}" for c in STRANGE))
    made = {
        "verdict": (guard.verdict(df, direction="output"), {"blocked": True, "risk_score": 0.95, "checks_run": "code_injection,pii,secrets"}), "screen": (screen.screen(df), {"screen": None}), "scan": (guard.scan(df, direction="output"), {"scan": None}),
        "test": (guard.test_scanner(df, "pii"), {"scanner": "pii", "score": 0.95, "threshold": 0.6, "detected": True, "findings": None, "metadata": "{}"}), "pairs": (guard.scan_pairs(df, "text", "text"), {"input_scan": None, "output_scan": None, "blocked": True, "block_reason": None}),
    }
    for name, (out, new) in made.items():
        row = out.first()
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        gone = {c.lower() for c in new}
        assert {c: row[c] for c in out.columns if c.lower() not in gone} == {c: v for c, v in zip(STRANGE, values, strict=True) if c.lower() not in gone}, name
        assert all(row[c] == v for c, v in new.items() if v is not None), name
    assert made["scan"][0].first()["scan"].sanitized_text == "SSN [REDACTED]" and made["screen"][0].first()["screen"].blocked
