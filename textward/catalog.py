"""All registered queries of the guardrail engine, each with the same in DuckDB's SQL."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import functions as F

from textward.functions import sql as sql_functions
from textward.functions.prefilter import n_tests, prefilter
from textward.functions.spans import cut, field, flags, found, top_score
from textward.operators import judging, models, redactor, scanners, screen, thresholds, watchlist
from textward.plans import asof, guard, observed, profiles
from textward.plans import config as conf
from textward.sources import catalogs as C
from textward.sources import fixtures
from textward.streaming.conversations import running_risk_stream
from textward.streaming.pairs import scanned_pairs
from textward.streaming.replay import CLOSING, Replay, in_turn
from textward.streaming.table import folder
from textward.streaming.wiring import blocked_counts, quarantine, scan_stream

_queries: dict[str, Callable] = {}
_sql: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name, *cols):
    """The table; with ``cols``, only they, dealt out to all cores if its files have fewer splits: for scans that cost CPU."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not cols:
        return df
    df = df.select(*cols)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- SQL of what the columns do

def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def matches(col: str, p: str) -> str:
    return f"regexp_matches({col}, {q(p)})"


def score_sql(col: str, rows: list[tuple]) -> str:
    by: dict[float, list[str]] = {}
    for _, p, s, *_ in rows:
        by.setdefault(C.SEVERITY[s], []).append(matches(col, p))
    return "case " + " ".join(f"when {' or '.join(by[s])} then {s}::double" for s in sorted(by, reverse=True)) + " else 0.0::double end"


def values_sql(name: str, cols: list[str], rows: list[tuple]) -> str:
    lit = lambda x: "null" if x is None else q(x) if isinstance(x, str) else str(x).lower()
    return f"{name}({', '.join(cols)}) as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def spans_sql(source: str, key: str, col: str, rows: list[tuple]) -> str:
    """(key, type, ord, severity, category, start_, end_, value) of all matches."""
    one = lambda k, r: f"select {key}, {q(r[0])} as type, {k} as ord, {q(r[2])} as severity, {q(r[3])} as category, regexp_extract_all({col}, {q(r[1])}) as v, regexp_split_to_array({col}, {q(r[1])}) as g from {source} where {matches(col, r[1])}"
    each = " union all ".join(one(k, r) for k, r in enumerate(rows))
    at = "coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(v[1:k - 1], lambda x: length(x))), 0)"
    return f"select {key}, type, ord, severity, category, ({at})::int as start_, ({at} + length(v[k]))::int as end_, v[k] as value from (select *, unnest(range(1, len(v) + 1)) as k from ({each}))"


def masked_sql(style: str, value: str, rows: list[tuple]) -> str:
    if style == "full":
        return "'[REDACTED]'"
    if style == "hash":
        return f"'[PII:' || substr(sha256({value}), 1, 8) || ']'"
    case = []
    for i, _, _, t in rows:
        first = f"replace({q(t)}, '{{first}}', substr({value}, 1, 1))" if "{first}" in t else q(t)
        case.append(f"when {q(i)} then " + (f"case when length({value}) >= 4 then replace({q(t)}, '{{last4}}', right({value}, 4)) else {first} end" if "{last4}" in t else first))
    return f"case type {' '.join(case)} end"


def redact_sql(style: str) -> str:
    return f"""with s as ({spans_sql("documents", "doc_id", "text", C.PII)}),
l as (select doc_id, list(struct_pack(s := start_, e := end_, n := {masked_sql(style, "value", C.PII)}, t := '') order by start_ desc, ord, k) as found from (select *, row_number() over (partition by doc_id, ord order by start_) as k from s) group by doc_id)
select doc_id, case when found is null then text else list_reduce(found, lambda a, x: struct_pack(s := 0, e := 0, n := '', t := substr(a.t, 1, x.s) || x.n || substr(a.t, x.e + 1)), struct_pack(s := 0, e := 0, n := '', t := text)).t end as redacted from documents left join l using (doc_id)"""


def phrases_sql(col: str, listed: list[str]) -> str:
    return f"list_filter([{', '.join(map(q, listed))}], lambda p: contains(lower({col}), p))"


def phrase_score_sql(n: str, base: float, most: float) -> str:
    return f"case when {n} > 0 then least({most}::double, {base}::double + {n} * 0.15::double) else 0.0::double end"


def grade_sql(s: str) -> str:
    return f"case when {s} >= 0.9 then 'critical' when {s} >= 0.7 then 'high' when {s} >= 0.5 then 'medium' else 'low' end"


KIND = f"case when list_has_any(m, [{', '.join(map(q, C.JAILBREAK))}]) then 'jailbreak_attempt' when list_has_any(m, [{', '.join(map(q, C.EXTRACTION))}]) then 'prompt_extraction' when list_has_any(m, [{', '.join(map(q, C.OVERRIDE))}]) then 'instruction_override' else 'prompt_injection' end"
CODE_ROWS = [(f"code_{i:03d}", t) for i, t in enumerate(fixtures.CODE)]
PII_ROWS = [(f"pii_{i:03d}", t) for i, t in enumerate(fixtures.PII)]
SECRET_ROWS = [(f"secret_{i:03d}", t) for i, t in enumerate(fixtures.SECRETS)]
PHRASE_ROWS = [(f"phrase_{i:03d}", t) for i, t in enumerate(fixtures.PHRASES)]
ALL_ROWS = CODE_ROWS + PII_ROWS + SECRET_ROWS + PHRASE_ROWS
CASES = "case_id string, text string"

#: Where the rows beside the seed rows come from: the table, its key as case_id, its text.
BESIDE = {"documents": ("'doc_' || doc_id", "text"), "pages": ("'page_' || page_id", "html"), "conversations": ("'turn_' || conv_id || '_' || turn", "text")}


def seeded_sql(rows: list[tuple], name: str, cte: str = "c") -> str:
    """``cte``(case_id, text): the seed rows, which fire where the tables don't, and all rows of a table."""
    key, text = BESIDE[name]
    return values_sql(f"seed_{cte}", ["case_id", "text"], rows) + f", {cte} as (select case_id, text from seed_{cte} union all select {key} as case_id, coalesce({text}, '') as text from {name})"


def seeded(spark, sf_dir, rows: list[tuple], name: str):
    """The same as a DataFrame."""
    key, text = BESIDE[name]
    df = spark.createDataFrame(rows, CASES).unionByName(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.expr(key).alias("case_id"), F.coalesce(text, F.lit("")).alias("text")))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- personal data

def _tests_sql(rows: list[tuple]) -> str:
    made = prefilter([r[1] for r in rows])
    return " + ".join(f"({made.sql('text', i)})::int" for i in range(len(rows)))


@query("select doc_id, " + ", ".join(f"({_tests_sql(r)})::bigint as n_{k}" for k, r in (("pii", C.PII), ("code", C.CODE), ("secrets", C.SECRETS))) + " from (select doc_id, coalesce(text, '') as text from documents)")
def pattern_tests(spark, sf_dir):
    """How many patterns of each catalog read a document: those whose literals it holds."""
    each = {f"n_{k}": n_tests(F.col("text"), [r[1] for r in rows]) for k, rows in (("pii", C.PII), ("code", C.CODE), ("secrets", C.SECRETS))}
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", *(c.alias(n) for n, c in each.items()))


@query(f"select doc_id, score, score >= 0.6 as blocked from (select doc_id, {score_sql('text', C.PII)} as score from documents)")
def pii_score_block(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", top_score(F.col("text"), C.PII).alias("score")).withColumn("blocked", F.col("score") >= 0.6)


@query("select doc_id, " + ", ".join(f"{matches('text', p)} as {i}" for i, p, *_ in C.PII) + " from documents")
def pii_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", flags(F.col("text"), C.PII).alias("x")).select("doc_id", "x.*")


@query(f"select type, severity, count(*)::bigint as n, count(distinct doc_id)::bigint as n_docs from ({spans_sql('documents', 'doc_id', 'text', C.PII)}) group by all")
def pii_findings_by_type(spark, sf_dir):
    return guard.findings_by_type(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id").select("type", "severity", "n", "n_docs")


@query(f"select doc_id, type, start_, end_, {masked_sql('partial', 'value', C.PII)} as value from ({spans_sql('documents', 'doc_id', 'text', C.PII)})")
def pii_spans(spark, sf_dir):
    rows = guard.findings_table(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", kinds=("pii",), style="partial")
    return rows.select("doc_id", "type", F.col("start").alias("start_"), F.col("end").alias("end_"), "value")


def _redact(style):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", scanners.pii_redacted(F.col("text"), style).alias("redacted"))

    run.__name__ = f"pii_redact_{style}"
    return query(redact_sql(style))(run)


for _style in ("full", "partial", "hash"):
    _redact(_style)


_GRAVE = "case " + " ".join(f"when ord = {k} then {C.SEVERITY[r[2]]}" for k, r in enumerate(C.PII)) + " end"


@query("with " + seeded_sql(PII_ROWS, "documents") + f""", s as ({spans_sql("c", "case_id", "text", C.PII)}),
n as (select *, case when start_ < max(end_) over (partition by case_id order by start_, end_, ord rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from s),
g as (select *, sum(new) over (partition by case_id order by start_, end_, ord rows between unbounded preceding and current row) as u from n),
u as (select case_id, min(start_) as s, max(end_) as e, first(ord order by {_GRAVE} desc, ord) as ord from g group by case_id, u),
t as (select u.*, (select any_value(type) from s where s.ord = u.ord) as type, substr(text, s + 1, e - s) as value from u join c using (case_id)),
l as (select case_id, list(struct_pack(s := s, e := e, n := {masked_sql("hash", "value", C.PII)}, t := '') order by s desc) as found from t group by case_id)
select case_id, case when found is null then text else list_reduce(found, lambda a, x: struct_pack(s := 0, e := 0, n := '', t := substr(a.t, 1, x.s) || x.n || substr(a.t, x.e + 1)), struct_pack(s := 0, e := 0, n := '', t := text)).t end as covered from c left join l using (case_id)""")
def pii_covered(spark, sf_dir):
    """Texts in which matches that overlap are replaced as one."""
    return seeded(spark, sf_dir, PII_ROWS, "documents").select("case_id", scanners.pii_covered(F.col("text"), "hash").alias("covered"))


@query("with " + seeded_sql(PII_ROWS, "documents") + f" select case_id, type, start_, end_, {masked_sql('partial', 'value', C.PII)} as value from ({spans_sql('c', 'case_id', 'text', C.PII)})")
def pii_cases(spark, sf_dir):
    rows = guard.findings_table(seeded(spark, sf_dir, PII_ROWS, "documents"), "case_id", kinds=("pii",), style="partial")
    return rows.select("case_id", "type", F.col("start").alias("start_"), F.col("end").alias("end_"), "value")


@query("with " + seeded_sql(PII_ROWS, "documents") + f" select case_id, {score_sql('text', C.fallback_pii())} as score from c")
def pii_fallback_cases(spark, sf_dir):
    return seeded(spark, sf_dir, PII_ROWS, "documents").select("case_id", top_score(F.col("text"), C.fallback_pii()).alias("score"))


# ---- catalogs as tables

_CATALOGS = [(f"{k}_{r[0]}", r[1]) for k, rows in (("pii", C.PII), ("code", C.CODE), ("secrets", C.SECRETS)) for r in rows]


def watched(spark, sf_dir):
    """Every run of three words of the benchmark as a pattern, and all rows of the catalogs."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    rows = table(spark, sf_dir, "benchmark").withColumn("w", w).filter("size(w) > 2").select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("k"))
    rows = rows.select(F.concat_ws("_", F.lit("bench"), "item_id", "k").alias("pattern_id"), F.concat(F.lit("(?i)"), F.array_join(F.slice("w", F.col("k"), 3), "[ \n]+")).alias("pattern"))
    return rows.unionByName(spark.createDataFrame(_CATALOGS, "pattern_id string, pattern string"))


@query("with " + values_sql("own", ["pattern_id", "pattern"], _CATALOGS) + """, b as (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark),
k as (select item_id, w, unnest(range(1, len(w) - 1)) as k from b),
p as (select 'bench_' || item_id || '_' || k as pattern_id, '(?i)' || array_to_string(w[k : k + 2], '[ ' || chr(10) || ']+') as pattern from k union all select * from own)
select doc_id, pattern_id, len(regexp_extract_all(text, pattern))::bigint as n from documents join p on regexp_matches(text, pattern)""")
def watchlist_matches(spark, sf_dir):
    """Which of thousands of patterns, a table, match which documents."""
    return watchlist.matches(table(spark, sf_dir, "documents", "doc_id", "text"), watched(spark, sf_dir), limited=False, unicode=False)


# ---- code

@query(f"select page_id, score, score >= 0.7 as blocked from (select page_id, {score_sql('html', C.CODE)} as score from pages)")
def code_score_block(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", top_score(F.col("html"), C.CODE).alias("score")).withColumn("blocked", F.col("score") >= 0.7)


@query(f"select type, category, severity, count(*)::bigint as n from ({spans_sql('pages', 'page_id', 'html', C.CODE)}) group by all")
def code_findings_by_type(spark, sf_dir):
    return guard.findings_by_type(table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html", "code_injection").select("type", "category", "severity", "n")


@query("with " + seeded_sql(CODE_ROWS, "pages") + f" select case_id, type, category, start_, end_, case when length(value) > 100 then substr(value, 1, 100) || '...' else value end as value from ({spans_sql('c', 'case_id', 'text', C.CODE)})")
def code_cases(spark, sf_dir):
    rows = guard.findings_table(seeded(spark, sf_dir, CODE_ROWS, "pages"), "case_id", kinds=("code_injection",))
    return rows.select("case_id", "type", F.col("detail").alias("category"), F.col("start").alias("start_"), F.col("end").alias("end_"), "value")


def _categories_sql(col):
    by: dict[str, list[str]] = {}
    for _, p, _, c in C.CODE:
        by.setdefault(c, []).append(matches(col, p))
    return "array_to_string(list_filter([" + ", ".join(f"case when {' or '.join(by[c])} then {q(c)} end" for c in sorted(by)) + "], lambda x: x is not null), ',')"


@query("with " + seeded_sql(CODE_ROWS, "pages") + f" select case_id, {_categories_sql('text')} as categories, {score_sql('text', C.CODE)} as score, {score_sql('text', C.fallback_code())} as fallback_score from c")
def code_categories(spark, sf_dir):
    t = F.col("text")
    return seeded(spark, sf_dir, CODE_ROWS, "pages").select("case_id", F.array_join(scanners.categories(t), ",").alias("categories"), top_score(t, C.CODE).alias("score"), top_score(t, C.fallback_code()).alias("fallback_score"))


@query(f"select page_id, {_categories_sql('html')} as categories from pages")
def code_categories_of_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.array_join(scanners.categories(F.col("html")), ",").alias("categories"))


# ---- credentials (reconstructed)

@query("with " + seeded_sql(SECRET_ROWS, "documents") + f" select case_id, type, category, start_, end_, substr(value, 1, 4) || '***' as value from ({spans_sql('c', 'case_id', 'text', C.SECRETS)})")
def secrets_cases(spark, sf_dir):
    rows = guard.findings_table(seeded(spark, sf_dir, SECRET_ROWS, "documents"), "case_id", kinds=("secrets",))
    return rows.select("case_id", "type", F.col("detail").alias("category"), F.col("start").alias("start_"), F.col("end").alias("end_"), "value")


@query(f"select doc_id, score, score >= 0.7 as blocked from (select doc_id, {score_sql('text', C.SECRETS)} as score from documents)")
def secrets_score_block(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", top_score(F.col("text"), C.SECRETS).alias("score")).withColumn("blocked", F.col("score") >= 0.7)


# ---- phrases

def _phrase_query(name, source, key, col, fill, build):
    listed, base, most = (C.INJECTION, 0.4, 0.95) if name.startswith("injection") else (C.TOXIC, 0.3, 0.9)
    kind = KIND if name.startswith("injection") else "'toxic'"
    sql = f"select {', '.join(key)}, s as score, array_to_string(m, '|') as matched, case when s > 0.3 then {kind} end as type, case when s > 0.3 then {grade_sql('s')} end as severity from (select *, {phrase_score_sql('len(m)', base, most)} as s from (select {', '.join(key)}, {phrases_sql(col, listed)} as m from {source[0]}))"

    def run(spark, sf_dir):
        df = source[1](spark, sf_dir)
        x = build(F.coalesce(F.col(col), F.lit("")))
        first = F.get(F.col("x.findings"), 0)
        return df.withColumn("x", x).select(*key, F.col("x.score").alias("score"), F.array_join("x.matched", "|").alias("matched"), first["type"].alias("type"), first["severity"].alias("severity"))

    run.__name__ = name
    return query(fill + sql)(run)


_turns, _docs = ("with " + seeded_sql(PHRASE_ROWS, name) + " " for name in ("conversations", "documents"))
_phrase_query("injection_heuristic", ("conversations", lambda s, d: table(s, d, "conversations", "conv_id", "turn", "text")), ["conv_id", "turn"], "text", "", scanners.injection)
_phrase_query("toxicity_heuristic", ("documents", lambda s, d: table(s, d, "documents", "doc_id", "text")), ["doc_id"], "text", "", scanners.toxicity)
_phrase_query("injection_cases", ("c", lambda s, d: seeded(s, d, PHRASE_ROWS, "conversations")), ["case_id"], "text", _turns, scanners.injection)
_phrase_query("toxicity_cases", ("c", lambda s, d: seeded(s, d, PHRASE_ROWS, "documents")), ["case_id"], "text", _docs, scanners.toxicity)


@query(f"select toxic, detected, count(*)::bigint as n from (select toxic, {phrase_score_sql('len(m)', 0.3, 0.9)} > 0.5 as detected from (select l.toxic, {phrases_sql('text', C.TOXIC)} as m from documents d join labels l using (doc_id))) group by all")
def toxicity_vs_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", (scanners.toxicity(F.col("text"))["score"] > 0.5).alias("detected"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "detected").agg(F.count("*").alias("n"))


# ---- claims without support

PAIRS = "select conv_id, turn, text as input_text, lead(role) over w as r, lead(text) over w as output_text, role from conversations window w as (partition by conv_id order by turn)"


def _simple_sql(source: str, key: str, text: str, context: str) -> str:
    words = lambda x: f"list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
    gap = []
    for p in C.FABRICATION:
        at = f"strpos(lower({text}), {q(p)})"
        start = f"greatest(0, {at} - 51)"
        claim = words(f"lower(substr({text}, {start} + 1, {at} - 1 + {len(p) + 100} - {start}))")
        gap.append(f"case when contains(lower({text}), {q(p)}) and coalesce({context} <> '', false) and len({claim}) > 0 and len(list_intersect({claim}, {words(f'lower({context})')}))::double / len({claim}) < 0.3 then 1 else 0 end")
    cited = " + ".join(f"len(regexp_extract_all({text}, {q('(?i)' + p)}))" for p in C.CITATIONS)
    return f"""select {key}, least(0.9::double, s) as score, array_to_string(m, '|') as indicators, c::bigint as citations, g > 0 as mismatch, case when len(m) > 0 or (c > 0 and not h) then case when s < 0.5 then 'medium' else 'high' end end as severity
from (select *, least(0.5::double, 0.1::double * len(m)) + least(0.3::double, 0.1::double * c) + 0.2::double * g as s from (select {key}, {phrases_sql(text, C.FABRICATION)} as m, {cited} as c, {' + '.join(gap)} as g, coalesce({context} <> '', false) as h from {source}))"""


def _simple(df, key):
    x = scanners.hallucination_simple(F.col("output_text"), F.col("input_text"))
    return df.withColumn("x", x).select(*key, F.round("x.score", 9).alias("score"), F.array_join("x.indicators", "|").alias("indicators"), F.col("x.citations").alias("citations"), F.col("x.mismatch").alias("mismatch"), F.get(F.col("x.findings"), 0)["severity"].alias("severity"))


@query("select * replace (round(score, 9) as score) from (" + _simple_sql(f"(select * from ({PAIRS}) where role = 'user' and r = 'assistant')", "conv_id, turn", "output_text", "input_text") + ")")
def hallucination_simple(spark, sf_dir):
    return _simple(guard.pairs(table(spark, sf_dir, "conversations")), ["conv_id", "turn"])


CLAIM_ROWS = [(f"claim_{i:03d}", c, t) for i, (c, t) in enumerate(fixtures.CLAIMS)]
_claims = "with " + values_sql("seed_c", ["case_id", "input_text", "output_text"], CLAIM_ROWS) + f", c as (select * from seed_c union all select 'turn_' || conv_id || '_' || turn, input_text, output_text from ({PAIRS}) where role = 'user' and r = 'assistant')"


def claims(spark, sf_dir):
    """Seed claims, and all pairs of the conversations."""
    pairs = guard.pairs(table(spark, sf_dir, "conversations")).select(F.expr("'turn_' || conv_id || '_' || turn").alias("case_id"), "input_text", "output_text")
    return spark.createDataFrame(CLAIM_ROWS, "case_id string, input_text string, output_text string").unionByName(pairs)


@query(_claims + " select * replace (round(score, 9) as score) from (" + _simple_sql("c", "case_id", "output_text", "input_text") + ")")
def hallucination_cases(spark, sf_dir):
    return _simple(claims(spark, sf_dir), ["case_id"])


JUDGE_ROWS = [(f"judge_{i:03d}", p) for i, p in enumerate(fixtures.JUDGE)]


#: What a judge might say of each document: two thirds have claims, some out of range, some without a field.
ANSWER = """'{"faithful": ' || case when doc_id % 3 = 0 then 'true' else 'false' end || case when doc_id % 5 = 4 then '' else ', "confidence": ' || cast(doc_id % 13 as string) || 'e-1' end || ', "hallucinations": [' || case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then '{"claim": "' || lang || '", "issue": "' || source || '", "severity": "High"}' else '{"claim": "' || source || '"}, {"issue": "' || lang || '", "severity": "none"}' end || ']}'"""


@query("with " + values_sql("s", ["case_id", "payload"], JUDGE_ROWS) + f", c as (select * from s union all select 'doc_' || doc_id, {ANSWER} from documents)" + """, j as (select case_id, case when json_valid(payload) then payload else '{}' end as p from c),
v as (select case_id, coalesce((p->>'$.faithful')::boolean, true) as f, coalesce((p->>'$.confidence')::double, 0.5) as s, list_transform(coalesce((p->'$.hallucinations')::json[], []), lambda x: struct_pack(claim := coalesce(x->>'$.claim', 'Unknown claim'), issue := coalesce(x->>'$.issue', 'Unknown issue'), severity := case when lower(x->>'$.severity') in ('low', 'medium', 'high', 'critical') then lower(x->>'$.severity') else 'medium' end)) as h from j)
select case_id, round(case when not s between 0 and 1 then 0.0 when f then 1.0 - s else s end, 9)::double as score, case when s between 0 and 1 then len(h) else 0 end::bigint as n_findings, case when s between 0 and 1 then array_to_string(list_transform(h, lambda x: x.severity || ': ' || x.claim || ' (' || x.issue || ')'), '; ') else '' end as findings from v""")
def judge_parse(spark, sf_dir):
    """Scores and findings of judges' answers: the seed ones, and one for each document."""
    df = spark.createDataFrame(JUDGE_ROWS, "case_id string, payload string").unionByName(table(spark, sf_dir, "documents", "doc_id", "lang", "source").select(F.expr("'doc_' || doc_id").alias("case_id"), F.expr(ANSWER).alias("payload")))
    x = scanners.judged(F.lit("source"), F.col("payload"))
    shown = F.array_join(F.transform("x.findings", lambda f: F.concat(f["severity"], F.lit(": "), f["value"], F.lit(" ("), f["detail"], F.lit(")"))), "; ")
    return df.withColumn("x", x).select("case_id", F.round("x.score", 9).alias("score"), F.size("x.findings").cast("long").alias("n_findings"), shown.alias("findings"))


def brief(prompt: str) -> str:
    """A judge that knows nothing but how long the question is."""
    n = len(prompt)
    return f'{{"faithful": {"true" if n % 2 else "false"}, "confidence": {n % 10 / 10}, "hallucinations": [{", ".join(["{}"] * (n % 3))}]}}'


@query(_claims + f""", p as (select case_id, coalesce(input_text, '') as context, length({q(scanners.ASK)} || substr(coalesce(input_text, ''), 1, 4000) || {q(scanners.ANSWER)} || substr(output_text, 1, 4000)) as n from c)
select case_id, round(case when context = '' then 0.0 when n % 2 = 1 then 1 - (n % 10) / 10 else (n % 10) / 10 end, 9)::double as score, case when context = '' then 0 else n % 3 end::bigint as n_findings, case when context = '' then 'no context' end as error from p""")
def judge_scores(spark, sf_dir):
    """A judge's scores of all pairs, by the store of answers: equal questions are asked once."""
    store = folder(spark) + "/answers"
    rows = claims(spark, sf_dir).withColumn("prompt", F.when(F.coalesce("input_text", F.lit("")) != "", scanners.judge_prompt(F.col("input_text"), F.col("output_text"))))
    judging.ask_all(rows, "brief", lambda: brief, store)
    x = scanners.judged(F.col("input_text"), F.col("judge"))
    return judging.with_answers(rows, store).withColumn("x", x).select("case_id", F.round("x.score", 9).alias("score"), F.size("x.findings").cast("long").alias("n_findings"), "x.error")


# ---- the same for SQL users

@query("select doc_id, " + ", ".join(f"{score_sql('text', r)} as {k}" for k, r in (("pii", C.PII), ("code", C.CODE), ("secrets", C.SECRETS))) + " from (select doc_id, coalesce(text, '') as text from documents)")
def sql_scores(spark, sf_dir):
    """The scores by the session's SQL functions."""
    sql_functions.register(spark)
    return spark.sql("SELECT doc_id, pii_score(text) AS pii, code_score(text) AS code, secrets_score(text) AS secrets FROM {docs}", docs=table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


_found = " union all ".join(f"select case_id, '{k}' as catalog, type, severity, start_, end_, value from ({spans_sql('c', 'case_id', 'text', r)})" for k, r in sql_functions.CATALOGS.items())


@query("with " + seeded_sql(ALL_ROWS, "documents") + f" {_found}")
def sql_lateral_findings(spark, sf_dir):
    """The findings by the table function in a LATERAL join."""
    sql_functions.register(spark)
    return spark.sql("SELECT case_id, catalog, type, severity, start AS start_, end AS end_, value FROM {cases}, LATERAL scan_findings(text)", cases=seeded(spark, sf_dir, ALL_ROWS, "documents"))


_found_docs = " union all ".join(f"select doc_id::varchar as key, '{k}' as catalog, type, severity, start_, end_, value from ({spans_sql('documents', 'doc_id', 'text', r)})" for k, r in sql_functions.CATALOGS.items())


@query(_found_docs)
def sql_table_findings(spark, sf_dir):
    """The findings of all documents by the Arrow table function over a table."""
    sql_functions.register(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text").selectExpr("cast(doc_id as string) as key", "text")
    return spark.sql("SELECT key, catalog, type, severity, start AS start_, end AS end_, value FROM scan_table(TABLE(SELECT key, text FROM {docs}))", docs=docs)


# ---- verdicts

def _verdict_sql(source: str, key: str, col: str, direction: str, config: conf.Config) -> str:
    rows = {"pii": C.PII, "code_injection": C.CODE, "secrets": C.SECRETS}
    phr = {"injection": (C.INJECTION, 0.4, 0.95), "toxicity": (C.TOXIC, 0.3, 0.9)}
    score = {i: score_sql(col, r) for i, r in rows.items()} | {i: phrase_score_sql(f"len({phrases_sql(col, p)})", b, m) for i, (p, b, m) in phr.items()}
    plan = guard.planned(config, direction)
    fast, slow = ([i for i, t in plan if t == tier] for tier in ("fast", "slow"))
    stop = " or ".join(f"{i} >= 0.9" for i in fast) if config.early_exit else "false"
    kept = [f"case when stop then null else {i} end as {i}" for i in slow]
    ids = fast + slow
    block = " or ".join(f"coalesce({i} >= {config.threshold(i)}, false)" for i in ids)
    names = ", ".join(f"case when {i} is not null then {q(i)} end" for i in sorted(ids))
    return f"""with raw as (select {key}, {', '.join(f'{score[i]} as {i}' for i in ids)} from {source}), st as (select *, {stop} as stop from raw), v as (select {key}, {', '.join(fast + kept)} from st)
select {key}, {block} as blocked, greatest({', '.join(ids)}, 0.0) as risk_score, array_to_string(list_filter([{names}], lambda x: x is not null), ',') as checks_run from v"""


@query(_verdict_sql("(select conv_id, turn, coalesce(text, '') as text from conversations where role = 'user')", "conv_id, turn", "text", "input", conf.Config()))
def guard_input_verdict(spark, sf_dir):
    df = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    return guard.verdict(df, direction="input").select("conv_id", "turn", "blocked", "risk_score", "checks_run")


@query(_verdict_sql("(select doc_id, coalesce(text, '') as text from documents)", "doc_id", "text", "output", conf.Config()))
def guard_output_verdict(spark, sf_dir):
    return guard.verdict(table(spark, sf_dir, "documents", "doc_id", "text"), direction="output").select("doc_id", "blocked", "risk_score", "checks_run")


@query("with " + seeded_sql(ALL_ROWS, "documents", "cases") + " select * from (" + _verdict_sql("cases", "case_id", "text", "input", conf.Config()) + ")")
def early_exit_checks_run(spark, sf_dir):
    return guard.verdict(seeded(spark, sf_dir, ALL_ROWS, "documents"), direction="input").select("case_id", "blocked", "risk_score", "checks_run")


@query("with " + seeded_sql(ALL_ROWS, "documents", "cases") + " select * from (" + _verdict_sql("cases", "case_id", "text", "output", conf.Config(early_exit=False, sensitivity="strict")) + ")")
def strict_verdict_without_exit(spark, sf_dir):
    df = seeded(spark, sf_dir, ALL_ROWS, "documents")
    return guard.verdict(df, direction="output", config=conf.Config(early_exit=False, sensitivity="strict")).select("case_id", "blocked", "risk_score", "checks_run")


@query("with " + seeded_sql(ALL_ROWS, "documents", "cases") + " select case_id, blocked, risk_score, checks_run from (" + _verdict_sql("cases", "case_id", "text", "output", conf.Config()) + ")")
def guard_scan_cases(spark, sf_dir):
    df = guard.scan(seeded(spark, sf_dir, ALL_ROWS, "documents"), direction="output")
    return df.select("case_id", F.col("scan.blocked").alias("blocked"), F.col("scan.risk_score").alias("risk_score"), F.array_join(F.array_sort(F.map_keys("scan.checks")), ",").alias("checks_run"))


def _found_sql(source: str) -> str:
    """(case_id, chk, chk_ord, ord, start_, type, severity, confidence, shown): an answer's findings in the order in which checks run."""
    one = lambda chk, k, rows, conf_, shown: f"select case_id, '{chk}' as chk, {k} as chk_ord, ord, start_, type, severity, {conf_}::double as confidence, {shown} as shown from ({spans_sql(source, 'case_id', 'text', rows)})"
    toxic = f"select case_id, 'toxicity', 3, 0, 0, 'toxic', {grade_sql('s')}, s, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end from (select *, {phrase_score_sql('len(m)', 0.3, 0.9)} as s from (select case_id, text, {phrases_sql('text', C.TOXIC)} as m from {source})) where s > 0.3"
    return " union all ".join([one("secrets", 0, C.SECRETS, 0.9, "substr(value, 1, 4) || '***'"), one("pii", 1, C.PII, 0.9, "'[REDACTED]'"), one("code_injection", 2, C.CODE, 0.85, "case when length(value) > 100 then substr(value, 1, 100) || '...' else value end"), toxic])


_ANSWERS = "with " + seeded_sql(ALL_ROWS, "documents") + f", sc as (select case_id, {score_sql('text', C.SECRETS)} as secrets, {score_sql('text', C.PII)} as pii, {score_sql('text', C.CODE)} as code_injection, {phrase_score_sql('len(' + phrases_sql('text', C.TOXIC) + ')', 0.3, 0.9)} as toxicity from c), f as (select f.*, greatest(secrets, pii, code_injection) >= 0.9 as stop, case chk when 'secrets' then secrets >= 0.7 when 'pii' then pii >= 0.6 when 'code_injection' then code_injection >= 0.7 else toxicity >= 0.5 end as fails from ({_found_sql('c')}) f join sc using (case_id)), g as (select *, row_number() over (partition by case_id order by chk_ord, ord, start_) as k from f where not (stop and chk = 'toxicity'))"


@query(_ANSWERS + " select case_id, (k - 1)::int as pos, type, severity, round(confidence, 9) as confidence, shown as value from g")
def findings_in_order(spark, sf_dir):
    """All findings of an answer's scan: in the order in which checks run, with their confidence."""
    df = guard.scan(seeded(spark, sf_dir, ALL_ROWS, "documents"), direction="output").select("case_id", F.posexplode("scan.findings").alias("pos", "f"))
    return df.select("case_id", "pos", F.col("f.type").alias("type"), F.col("f.severity").alias("severity"), F.round("f.confidence", 9).alias("confidence"), F.col("f.value").alias("value"))


@query(_ANSWERS + f""", one as (select case_id, k, chk || ': ' || type || ' (' || severity || ') - ' || case when length(shown) > 50 then substr(shown, 1, 50) || '...' else shown end as r from g where fails),
r as (select case_id, string_agg(r, '; ' order by k) as reasons, string_agg('output: ' || r, '; ' order by k) as block_reason from one group by case_id),
s as ({spans_sql("c", "case_id", "text", C.PII)}),
l as (select case_id, list(struct_pack(s := start_, e := end_, t := '') order by start_ desc, ord, k) as found from (select *, row_number() over (partition by case_id, ord order by start_) as k from s) group by case_id),
clean as (select case_id, case when found is null then text else list_reduce(found, lambda a, x: struct_pack(s := 0, e := 0, t := substr(a.t, 1, x.s) || '[REDACTED]' || substr(a.t, x.e + 1)), struct_pack(s := 0, e := 0, t := text)).t end as sanitized from c left join l using (case_id))
select case_id, coalesce(reasons, '') as reasons, reasons is not null as blocked, block_reason, sanitized, exists(from g where g.case_id = clean.case_id and severity = 'critical') as has_critical from clean left join r using (case_id)""")
def reasons_and_sanitized(spark, sf_dir):
    """Why answers are blocked, alone and as the answer of a pair; their redacted texts."""
    df = guard.scan_pairs(seeded(spark, sf_dir, ALL_ROWS, "documents").withColumn("asked", F.lit("")), "asked", "text")
    o = F.col("output_scan")
    return df.select("case_id", F.array_join(o["reasons"], "; ").alias("reasons"), "blocked", "block_reason", o["sanitized_text"].alias("sanitized"), o["has_critical"].alias("has_critical"))


LOGIT_ROWS = [(f"logit_{i:03d}", t, None if a is None else " ".join(map(str, a)), None if b is None else " ".join(map(str, b))) for i, (t, a, b) in enumerate(fixtures.LOGITS)]
#: Logits of each document, by its number; half of the documents have none for toxicity.
INJ = "cast(doc_id % 7 - 3 as string) || ' ' || cast(doc_id % 5 - 2 as string)"
TOX = "case when doc_id % 2 = 0 then " + " || ' ' || ".join(f"cast(doc_id * {k} % 11 - {k} as string)" for k in (3, 5, 7, 6, 4, 8)) + " end"
_LABELS = "[" + ", ".join(map(q, C.TOXIC_LABELS)) + "]"


@query("with " + values_sql("seed_c", ["case_id", "text", "inj", "tox"], LOGIT_ROWS) + f""", c as (select * from seed_c union all select 'doc_' || doc_id, coalesce(text, ''), {INJ}, {TOX} from documents), l as (select *, list_transform(string_split(inj, ' '), lambda x: x::double) as a, list_transform(string_split(tox, ' '), lambda x: 1 / (1 + exp(-(x::double)))) as p from c),
m as (select *, exp(a[least(2, len(a))]) / list_sum(list_transform(a, lambda x: exp(x))) as mi, list_max(p) as mt, {phrase_score_sql(f"len({phrases_sql('text', C.INJECTION)})", 0.4, 0.95)} as pi, {phrase_score_sql(f"len({phrases_sql('text', C.TOXIC)})", 0.3, 0.9)} as pt from l),
s as (select *, case when coalesce(mi, 0) > 0 then greatest(mi, pi * 0.8::double) else pi end as si, case when coalesce(mt, 0) > 0 then greatest(mt, pt * 0.7::double) else pt end as st, case when mt is null then 'toxic' else {_LABELS}[list_position(p, mt)] end as prime, list_filter({_LABELS}, lambda x, i: p[i] > 0.5) as high, list_filter({_LABELS}, lambda x, i: p[i] > 0.7) as extra from m)
select case_id, round(si, 9) as injection, round(st, 9) as toxicity, case when st > 0.3 then {grade_sql('st')} end as severity, case when st > 0.3 then prime end as primary_type,
case when st > 0.3 then array_to_string(case when len(coalesce(high, [])) > 0 then high else [prime] end, '|') end as toxicity_types, case when st > 0.3 then 1 + len(list_filter(coalesce(extra, []), lambda x: x <> prime)) else 0 end::int as n_findings from s""")
def model_scores(spark, sf_dir):
    """Models' logits beside phrases: softmax and sigmoid, the combined scores, the types above 0.5, the extra findings."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.expr("'doc_' || doc_id").alias("case_id"), F.coalesce("text", F.lit("")).alias("text"), F.expr(INJ).alias("inj"), F.expr(TOX).alias("tox"))
    df = spark.createDataFrame(LOGIT_ROWS, "case_id string, text string, inj string, tox string").unionByName(docs)
    inj, tox = (F.split(c, " ").cast("array<double>") for c in ("inj", "tox"))
    df = df.withColumn("i", scanners.injection(F.col("text"), models.softmax_of(inj))).withColumn("t", scanners.toxicity(F.col("text"), models.sigmoid_of(tox)))
    hit_ = F.size("t.findings") > 0
    return df.select("case_id", F.round("i.score", 9).alias("injection"), F.round("t.score", 9).alias("toxicity"), F.get(F.col("t.findings"), 0)["severity"].alias("severity"), F.when(hit_, F.col("t.primary")).alias("primary_type"), F.array_join("t.types", "|").alias("toxicity_types"), F.size("t.findings").alias("n_findings"))


SWITCHES = [
    ("as it comes", {}, []), ("no personal data", {"scanners": {"pii": {"enabled": False}}}, []), ("judged", {"mode": "full", "llm": {"api_key": "k"}}, []), ("nobody to judge", {"mode": "full"}, []), ("a judge in local mode", {"has_judge": True}, []), ("two checks", {}, ["pii", "toxicity"]), ("one that is off", {"scanners": {"secrets": False}}, ["secrets"]),
]


@query("with " + values_sql("s", ["scanner", "tier", "direction", "judge"], [tuple(x) for x in C.SCANNERS]) + ", " + values_sql("c", ["config", "off", "checks", "judged"], [(n, "pii" if "personal" in n else "secrets" if "off" in n else "", ",".join(k), n == "judged") for n, _, k in SWITCHES]) + """,
d as (select case role when 'user' then 'input' else 'output' end as direction, count(*)::bigint as n_rows from conversations group by 1)
select config, d.direction, scanner, tier, n_rows from s, c, d
where scanner <> off and (s.direction = 'both' or s.direction = d.direction) and (checks = '' or list_contains(string_split(checks, ','), scanner)) and (not judge or judged)""")
def planned_checks(spark, sf_dir):
    """Which checks run under which configuration, and on how many turns: switches, directions, requested checks, the judge's conditions."""
    rows = [(n, d, i, t) for n, data, checks in SWITCHES for d in ("input", "output") for i, t in guard.planned(conf.from_dict(data), d, checks)]
    turns = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "input").otherwise("output").alias("direction")).groupBy("direction").agg(F.count("*").alias("n_rows"))
    return turns.join(F.broadcast(spark.createDataFrame(rows, "config string, direction string, scanner string, tier string")), "direction").select("config", "direction", "scanner", "tier", "n_rows")


@query(_claims + f" select case_id, {q(scanners.ASK)} || substr(coalesce(input_text, ''), 1, 4000) || {q(scanners.ANSWER)} || substr(output_text, 1, 4000) as prompt from c")
def judge_prompts(spark, sf_dir):
    return claims(spark, sf_dir).select("case_id", scanners.judge_prompt(F.col("input_text"), F.col("output_text")).alias("prompt"))


@query(f"""with p as (select conv_id, turn, input_text, output_text from ({PAIRS}) where role = 'user' and r = 'assistant'),
i as (select conv_id, turn, blocked from ({_verdict_sql('(select conv_id, turn, input_text as text from p)', 'conv_id, turn', 'text', 'input', conf.Config())})),
o as (select conv_id, turn, blocked from ({_verdict_sql('(select conv_id, turn, output_text as text from p)', 'conv_id, turn', 'text', 'output', conf.Config())}))
select conv_id, turn, i.blocked as input_blocked, o.blocked as output_blocked, i.blocked or o.blocked as blocked from i join o using (conv_id, turn)""")
def full_scan_pairs(spark, sf_dir):
    df = guard.scan_pairs(guard.pairs(table(spark, sf_dir, "conversations")))
    return df.select("conv_id", "turn", F.col("input_scan.blocked").alias("input_blocked"), F.col("output_scan.blocked").alias("output_blocked"), "blocked")


@query("with t(sensitivity, threshold) as (values " + ", ".join(f"({q(s)}, {own['pii']}::double)" for s, own in C.THRESHOLDS.items()) + f") select sensitivity, lang, count(*)::bigint as n, count(*) filter (where score >= threshold)::bigint as n_blocked from (select lang, {score_sql('text', C.PII)} as score from documents), t group by all")
def sensitivity_matrix(spark, sf_dir):
    """Each text is scored once; the presets are counts of one aggregate, then rows of its few results."""
    docs = table(spark, sf_dir, "documents", "lang", "text").select("lang", top_score(F.col("text"), C.PII).alias("score"))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(F.col("score") >= own["pii"]).alias(s) for s, own in C.THRESHOLDS.items()))
    presets = F.array(*(F.struct(F.lit(s).alias("sensitivity"), F.col(s).alias("n_blocked")) for s in C.THRESHOLDS))
    return counts.select("lang", "n", F.explode(presets).alias("p")).select("p.sensitivity", "lang", "n", "p.n_blocked")


TENANTS = [
    ("org0", '{"sensitivity":"strict"}'), ("org1", '{"sensitivity":"low"}'), ("org2", '{"thresholds":{"pii":0.3}}'), ("org3", "{}"), ("org4", '{"scanners":{"pii":{"enabled":false}}}'), ("org5", '{"scanners":{"pii":false},"sensitivity":"strict"}'),
    ("org6", '{"scanners":{"pii":{"enabled":true,"threshold":0.95},"toxicity":true},"mode":"local"}'), ("org7", '{"scanners":{"pii":{"threshold":0.9}},"thresholds":{"pii":0.4},"pii":{"redaction_style":"hash"},"llm":{"model":"m"}}'),
]


@query("with " + values_sql("t", ["org_id", "config"], TENANTS) + f""", d as (select doc_id, 'org' || (doc_id % 9)::varchar as org_id, {score_sql('text', C.PII)} as score from documents),
own as (select org_id, coalesce((config->>'$.thresholds.pii')::double, (config->>'$.scanners.pii.threshold')::double, case coalesce(config->>'$.sensitivity', 'balanced') when 'strict' then 0.4 when 'low' then 0.8 else 0.6 end) as threshold,
  coalesce(case json_type(config, '$.scanners.pii') when 'BOOLEAN' then (config->>'$.scanners.pii')::boolean else (config->>'$.scanners.pii.enabled')::boolean end, true) as enabled from t)
select doc_id, org_id, score, coalesce(enabled, true) and score >= coalesce(threshold, 0.6) as blocked from d left join own using (org_id)""")
def tenant_config(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.concat(F.lit("org"), (F.col("doc_id") % 9).cast("string")).alias("org_id"), top_score(F.col("text"), C.PII).alias("score"))
    rows = conf.with_tenant(docs, F.broadcast(spark.createDataFrame(TENANTS, "org_id string, config string")))
    c = F.col("tenant_config")
    return rows.select("doc_id", "org_id", "score", (conf.tenant_enabled(c, "pii") & (F.col("score") >= F.coalesce(conf.tenant_threshold(c, "pii"), F.lit(0.6)))).alias("blocked"))


@query("""with v as (select user_id, ts as since, max(value) as config from events where event_type = 'signup' group by all)
select event_id, e.user_id, v.config, coalesce(e.value >= v.config, false) as blocked from (select * from events where event_type <> 'signup') e asof left join v on e.user_id = v.user_id and e.ts >= v.since""")
def config_as_of(spark, sf_dir):
    """Each event under its user's last configuration before it: a limit, set anew by each signup."""
    events = table(spark, sf_dir, "events")
    versions = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("value").alias("config"))
    rows = asof.as_of(events.filter("event_type != 'signup'").select("event_id", "user_id", "ts", "value"), versions, "user_id", "ts")
    return rows.select("event_id", "user_id", "config", F.coalesce(F.col("value") >= F.col("config"), F.lit(False)).alias("blocked"))


_SCORED = f"select toxic, {phrase_score_sql('len(m)', 0.3, 0.9)} + len(m) / (1 + length(text)) as score from (select l.toxic, text, {phrases_sql('text', C.TOXIC)} as m from documents d join labels l using (doc_id) where text is not null)"


@query(f"""with s as (select score as threshold, count(*) filter (where toxic <> 0) as p, count(*) filter (where toxic = 0) as n from ({_SCORED}) group by 1),
c as (select *, (sum(p) over w)::bigint as tp, (sum(n) over w)::bigint as fp, (sum(p) over ())::bigint as pos, (sum(n) over ())::bigint as neg from s window w as (order by threshold desc)),
f as (select *, 2 * tp / (tp + fp + pos) as f1, sum(n * (2 * tp - p)) over () / (2.0::double * pos * neg) as auc from c)
select round(threshold, 12) as threshold, tp, fp, pos - tp as fn, neg - fp as tn, tp / (tp + fp) as precision, tp / pos as recall, f1, f1 = max(f1) over () as best, auc from f""")
def threshold_sweep(spark, sf_dir):
    """Every threshold of a toxicity score against the labels, and the area under its curve. Longer texts with as many phrases score a little less."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").withColumn("x", scanners.toxicity(F.col("text")))
    docs = docs.select("doc_id", (F.col("x.score") + F.size("x.matched") / (1 + F.length("text"))).alias("score"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return thresholds.sweep(rows, "score", "toxic").withColumn("threshold", F.round("threshold", 12))


# ---- the second screen, the general redactor

def _screen_sql(source: str, key: str, col: str) -> str:
    hits = [(n, matches(col, screen.pattern(p, i)), lv, f"regexp_extract({col}, {q(screen.pattern(p, i))})") for n, p, i, lv in C.SCREEN]
    shown = ", ".join(f"case when {m} then 'pii_{n}:{lv}:' || case when length({x}) > 4 then substr({x}, 1, 4) || '***' else '***' end end" for n, m, lv, x in hits)
    return f"select {key}, len(t) > 0 as blocked, case when len(t) > 0 then 1.0 else 0.0 end::double as risk_score, array_to_string(t, '|') as threats from (select {key}, list_filter([{shown}], lambda x: x is not null) as t from {source})"


def _screened(df, key):
    shown = F.transform("screen.threats", lambda t: F.concat(t["type"], F.lit(":"), t["level"], F.lit(":"), t["matched"]))
    return screen.screen(df).select(key, F.col("screen.blocked").alias("blocked"), F.col("screen.risk_score").alias("risk_score"), F.array_join(shown, "|").alias("threats"))


@query(_screen_sql("documents", "doc_id", "text"))
def screen_verdict(spark, sf_dir):
    return _screened(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")


@query("with " + seeded_sql(PII_ROWS + SECRET_ROWS, "documents") + " select * from (" + _screen_sql("c", "case_id", "text") + ")")
def screen_cases(spark, sf_dir):
    return _screened(seeded(spark, sf_dir, PII_ROWS + SECRET_ROWS, "documents"), "case_id")


REDACT_ROWS = [(f"value_{i:03d}", k, v) for i, (k, v) in enumerate(fixtures.VALUES)]
_values = "with " + values_sql("seed_c", ["case_id", "kind", "value"], REDACT_ROWS) + f", c as (select * from seed_c union all select 'doc_' || doc_id || '_' || ord || '_' || start_, type, value from ({spans_sql('documents', 'doc_id', 'text', C.PII)}))"


def values(spark, sf_dir):
    """Seed values, and all personal data in the documents, with their types."""
    x = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(found(F.col("text"), C.PII)).alias("x"))
    own = x.select(F.concat_ws("_", F.lit("doc"), "doc_id", "x.ord", "x.start").alias("case_id"), field(C.PII, 0, F.col("x.ord")).alias("kind"), F.col("x.value").alias("value"))
    return spark.createDataFrame(REDACT_ROWS, "case_id string, kind string, value string").unionByName(own)


@query(_values + """ select case_id, '[' || upper(kind) || ':' || substr(sha256(value), 1, 8) || ']' as hashed, case
when length(value) <= 4 then repeat('*', length(value)) when kind = 'ssn' then '***-**-' || right(value, 4) when starts_with(kind, 'credit_card') then '****-****-****-' || right(value, 4)
when starts_with(kind, 'phone') then '(***) ***-' || right(value, 4) when kind = 'email' then substr(value, 1, 1) || case when strpos(value, '@') > 1 then '***@***.***' else '***' end
when length(value) > 6 then substr(value, 1, 2) || repeat('*', length(value) - 4) || right(value, 2) else repeat('*', length(value) - 2) || right(value, 2) end as partial from c""")
def redactor_defaults(spark, sf_dir):
    df = values(spark, sf_dir)
    v, k = F.col("value"), F.col("kind")
    return df.select("case_id", redactor.redact_value(v, k, "hash").alias("hashed"), redactor.redact_value(v, k, "partial").alias("partial"))


@query("select doc_id, regexp_replace(text, 'src[0-9]+|[0-9]{3,}', '[REDACTED]', 'g') as redacted, len(regexp_extract_all(text, 'src[0-9]+|[0-9]{3,}'))::bigint as n from documents")
def redact_pattern(spark, sf_dir):
    x = redactor.redact_pattern(F.col("text"), "src[0-9]+|[0-9]{3,}")
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumn("x", x).select("doc_id", F.col("x.redacted_text").alias("redacted"), F.col("x.redaction_count").cast("long").alias("n"))


TEMPLATES = ["***-**-{last4}", "{first}***{last4}", "{first_char}.", "gone"]


@query(_values + ", " + values_sql("t", ["template"], [(t,) for t in TEMPLATES]) + " select case_id, template, replace(replace(case when length(value) >= 4 then replace(template, '{last4}', right(value, 4)) else template end, '{first}', substr(value, 1, 1)), '{first_char}', substr(value, 1, 1)) as redacted from c, t")
def redactor_templates(spark, sf_dir):
    df = values(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(t).alias("template"), redactor.redact_value(F.col("value"), F.col("kind"), "partial", t).alias("redacted")) for t in TEMPLATES))
    return df.select("case_id", F.explode(each).alias("x")).select("case_id", "x.*")


# ---- analytics

@query(f"""with s as (select doc_id, type, count(*) as n from ({spans_sql('documents', 'doc_id', 'text', C.PII)}) group by all)
select lang, type, sum(n)::bigint as n, count(distinct doc_id)::bigint as n_keys from s join documents using (doc_id) group by all union all select lang, null, count(*)::bigint, count(distinct doc_id)::bigint from documents group by lang""")
def merged_profile(spark, sf_dir):
    """Findings by language, merged from stored profiles of each source; distinct documents from the stored findings, exactly."""
    at = folder(spark)
    by = ["source", "lang"]
    profiles.findings(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"), "doc_id", by).write.parquet(f"{at}/findings")
    found = spark.read.parquet(f"{at}/findings")
    profiles.summed(found, by).write.parquet(f"{at}/profiles")
    merged = profiles.read(profiles.merge(spark.read.parquet(f"{at}/profiles"), ["lang"])).drop("n_keys").alias("m")
    keys = profiles.exact_keys(found, ["lang"]).alias("k")
    return merged.join(keys, F.col("m.lang").eqNullSafe(F.col("k.lang")) & F.col("m.type").eqNullSafe(F.col("k.type"))).select("m.lang", "m.type", "n", "n_keys")


def _observed_sql() -> str:
    score = {"secrets": score_sql("text", C.SECRETS), "pii": score_sql("text", C.PII), "code_injection": score_sql("text", C.CODE), "toxicity": phrase_score_sql(f"len({phrases_sql('text', C.TOXIC)})", 0.3, 0.9)}
    limit = {i: conf.Config().threshold(i) for i in score}
    rows = [f"select '{i}_{f}' as metric, count(*) filter (where {c})::bigint as value from v" for i in score for f, c in (("ran", f"{i} is not null"), ("spared", f"{i} is null"), ("hits", f"{i} > 0"), ("failed", f"{i} >= {limit[i]}"))]
    rows += ["select 'n_rows', count(*)::bigint from v", "select 'n_blocked', count(*) filter (where " + " or ".join(f"coalesce({i} >= {limit[i]}, false)" for i in score) + ")::bigint from v"]
    return f"with r as (select {', '.join(f'{c} as {i}' for i, c in score.items())} from (select coalesce(text, '') as text from documents)), v as (select * replace (case when greatest(secrets, pii, code_injection) >= 0.9 then null else toxicity end as toxicity) from r) " + " union all ".join(rows)


@query(_observed_sql())
def observed_metrics(spark, sf_dir):
    """What a scan tells of itself while it writes: rows run, spared by early exit, hit and failed for each check."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    told = observed.timed(docs, lambda df: df.select("doc_id", "scan.blocked").write.parquet(folder(spark) + "/verdicts"), direction="output")
    return spark.createDataFrame([(k, v) for k, v in told.items() if k not in ("seconds", "ms_per_row")], "metric string, value long")


@query(f"select lang, type, count(*)::bigint as n from (select d.lang, s.type from ({spans_sql('documents', 'doc_id', 'text', C.PII)}) s join documents d using (doc_id)) group by rollup (lang, type)")
def corpus_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "lang", "text").select("lang", F.explode(scanners.pii_findings(F.col("text"))).alias("f"))
    return docs.rollup("lang", F.col("f.type").alias("type")).agg(F.count("*").alias("n"))


@query(f"select source, n_blocked, n, rank from (select *, row_number() over (order by n_blocked desc, source) as rank from (select source, count(*) filter (where s >= 0.6)::bigint as n_blocked, count(*)::bigint as n from (select source, {score_sql('text', C.PII)} as s from documents) group by source)) where rank <= 10")
def worst_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "source", "text").select("source", top_score(F.col("text"), C.PII).alias("s"))
    top = docs.groupBy("source").agg(F.count_if(F.col("s") >= 0.6).alias("n_blocked"), F.count("*").alias("n")).orderBy(F.desc("n_blocked"), "source").limit(10)
    from pyspark.sql import Window as W

    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_blocked"), "source")).cast("long"))


LABELLED = [(t, s, d) for s, t, d in fixtures.LABELLED]


@query("with " + values_sql("seed_c", ["text", "scanner", "expected"], LABELLED) + f""", c as (select * from seed_c union all select text, 'toxicity', toxic = 1 from documents join labels using (doc_id)), s as (select scanner, expected, case scanner when 'pii' then {score_sql('text', C.PII)} when 'code_injection' then {score_sql('text', C.CODE)} when 'secrets' then {score_sql('text', C.SECRETS)}
when 'injection' then {phrase_score_sql(f'len({phrases_sql("text", C.INJECTION)})', 0.4, 0.95)} else {phrase_score_sql(f'len({phrases_sql("text", C.TOXIC)})', 0.3, 0.9)} end > 0.3 as detected from c)
select scanner, count(*)::bigint as n, count(*) filter (where detected = expected)::bigint as n_right from s group by all""")
def harness_accuracy(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents", "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.lit("toxicity").alias("scanner"), (F.col("toxic") == 1).alias("expected"))
    df = spark.createDataFrame(LABELLED, "text string, scanner string, expected boolean").unionByName(labelled)
    t = F.col("text")
    score = F.when(F.col("scanner") == "pii", top_score(t, C.PII)).when(F.col("scanner") == "code_injection", top_score(t, C.CODE)).when(F.col("scanner") == "secrets", top_score(t, C.SECRETS)).when(F.col("scanner") == "injection", scanners.injection(t)["score"]).otherwise(scanners.toxicity(t)["score"])
    return df.withColumn("detected", score > 0.3).groupBy("scanner").agg(F.count("*").alias("n"), F.count_if(F.col("detected") == F.col("expected")).alias("n_right"))


@query("with " + values_sql("c", ["scanner_id", "tier", "direction", "needs_judge", "threshold"], [(i, t, d, j, C.THRESHOLDS["balanced"][i]) for i, t, d, j in C.SCANNERS]) + " select scanner_id, tier, direction, needs_judge, threshold::double as threshold, (select count(*) from conversations where direction = 'both' or direction = case role when 'user' then 'input' else 'output' end)::bigint as n_rows from c")
def scanner_info(spark, sf_dir):
    """What there is to scan for, and how many turns each scanner would see."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.when(F.col("role") == "user", "input").otherwise("output").alias("side")).agg(F.count("*").alias("n"))
    each = C.scanners(spark).withColumn("side", F.explode(F.when(F.col("direction") == "both", F.array(F.lit("input"), F.lit("output"))).otherwise(F.array("direction"))))
    return each.join(turns, "side", "left").groupBy("scanner_id", "tier", "direction", "needs_judge", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


@query(f"select conv_id, turn, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as shown from conversations")
def truncated_projection(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut(F.col("text"), 100).alias("shown"))


@query(f"select role, blocked, count(*)::bigint as n from ({_verdict_sql('(select role, conv_id, turn, coalesce(text, chr(32)) as text from conversations)', 'role, conv_id, turn', 'text', 'input', conf.Config())}) group by all")
def stream_scan_counts(spark, sf_dir):
    """The verdicts of a stream over the table's files, stopped when all was read."""
    from textward.streaming.table import drained

    return drained(spark, f"{sf_dir}/conversations.parquet").groupBy("role", "blocked").agg(F.count("*").alias("n"))


#: The slices in which turns arrive.
SLICE = "cast(turn div 4 as int)"
#: The turns have no times: half an hour and more lies between every third turn and the next.
TS = "timestamp_seconds(1704067200 + turn * 600 + (turn div 3) * 3600 + conv_id % 300)"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("ts", F.expr(TS)).select("conv_id", "turn", "ts", "role", "text")


_RISK = _verdict_sql("(select conv_id, turn, coalesce(text, '') as text from conversations)", "conv_id, turn", "text", "input", conf.Config())


@query(f"""with v as (select conv_id, turn, risk_score as risk, 1704067200 + turn * 600 + (turn // 3) * 3600 + conv_id % 300 as ts from ({_RISK})),
g as (select *, case when ts - lag(ts) over (partition by conv_id order by ts, turn) > 1800 then 1 else 0 end as new from v),
s as (select *, sum(new) over (partition by conv_id order by ts, turn)::bigint as session from g),
e as (select *, coalesce(max(risk >= 0.9) over (partition by conv_id, session order by ts, turn rows between unbounded preceding and 1 preceding), false) as stopped from s),
r as (select *, case when not stopped then risk end as own from e)
select conv_id, turn, session, own as risk, max(own) over w as running_risk, (count(*) filter (where own >= 0.9) over w)::bigint as criticals, stopped from r window w as (partition by conv_id, session order by ts, turn)""")
def conversation_risk_stream(spark, sf_dir):
    """The risk of each conversation so far, by a stream with state: turns arrive in slices, neighbours in another order."""
    rows = turns(spark, sf_dir).drop("role")
    replay = Replay(spark, rows.schema, None)
    return in_turn(spark, [(replay, rows)], F.expr(SLICE), 3, "ts", ("conv_id",), lambda: running_risk_stream(replay.stream()))[0]


@query(f"""with t as (select * from conversations), p as (select p.conv_id, p.turn, coalesce(p.text, '') as input_text, coalesce(a.text, '') as output_text, a.conv_id is not null as answered from t p left join t a on a.conv_id = p.conv_id and a.turn = p.turn + 1 and a.role = 'assistant' where p.role = 'user'),
i as (select conv_id, turn, blocked from ({_verdict_sql('(select conv_id, turn, input_text as text from p)', 'conv_id, turn', 'text', 'input', conf.Config())})),
o as (select conv_id, turn, blocked from ({_verdict_sql('(select conv_id, turn, output_text as text from p)', 'conv_id, turn', 'text', 'output', conf.Config())}))
select conv_id, turn, answered, i.blocked as input_blocked, o.blocked as output_blocked, i.blocked or o.blocked as blocked from p join i using (conv_id, turn) join o using (conv_id, turn)""")
def pairs_on_streams(spark, sf_dir):
    """Prompts and answers as two streams; prompts without an answer come out by themselves."""
    rows = turns(spark, sf_dir)
    sides = []
    for role in ("user", "assistant"):
        own = rows.filter(F.col("role") == role).drop("role")
        sides.append((Replay(spark, own.schema, None), own))
    # an hour and a half lies between a third turn and the fourth
    out = in_turn(spark, sides, F.expr(SLICE), 3, "ts", ("conv_id", "turn"), lambda: scanned_pairs(*(s.stream() for s, _ in sides), within="3 hours"))[0]
    out = out.filter(F.col("conv_id") != CLOSING)
    return out.select("conv_id", "turn", "answered", F.col("input_scan.blocked").alias("input_blocked"), F.col("output_scan.blocked").alias("output_blocked"), "blocked")


@query(f"""with v as (select ts, blocked from ({_verdict_sql('(select conv_id, turn, coalesce(text, chr(32)) as text from conversations)', 'conv_id, turn', 'text', 'input', conf.Config())}) join (select conv_id, turn, 1704067200 + turn * 600 + (turn // 3) * 3600 + conv_id % 300 as ts from conversations) using (conv_id, turn))
select to_timestamp(ts // 300 * 300)::timestamp as begins, count(*)::bigint as n, count(*) filter (where blocked)::bigint as n_blocked from v group by 1""")
def blocked_counts_stream(spark, sf_dir):
    """Turns and blocked turns for each five minutes of event time, by a stream."""
    rows = turns(spark, sf_dir).drop("role")
    replay = Replay(spark, rows.schema, None)
    out = in_turn(spark, [(replay, rows)], F.expr(SLICE), 3, "ts", ("conv_id",), lambda: blocked_counts(scan_stream(replay.stream()), "ts"))[0]
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("begins"), "n", "n_blocked")


# ---- the rest of the surface, over the tables

@query(f"select doc_id, score, 0.6::double as threshold, score > 0.6 as detected, coalesce(n, 0)::bigint as n_findings from (select doc_id, {score_sql('text', C.PII)} as score from documents) left join (select doc_id, count(*) as n from ({spans_sql('documents', 'doc_id', 'text', C.PII)}) group by doc_id) using (doc_id)")
def single_scanner_test(spark, sf_dir):
    """One scanner alone, as a user tries it."""
    rows = guard.test_scanner(table(spark, sf_dir, "documents", "doc_id", "text"), "pii")
    return rows.select("doc_id", "score", "threshold", "detected", F.size("findings").cast("long").alias("n_findings"))


@query("select doc_id, false as blocked, 0.0::double as risk_score, '' as checks_run, text as sanitized from documents")
def empty_plan(spark, sf_dir):
    """With every scanner off nothing is blocked, scored or redacted."""
    off = conf.Config(scanners=dict.fromkeys(conf.IDS, False))
    rows = guard.scan(guard.verdict(table(spark, sf_dir, "documents", "doc_id", "text"), direction="output", config=off), direction="output", config=off)
    return rows.select("doc_id", "blocked", "risk_score", "checks_run", F.col("scan.sanitized_text").alias("sanitized"))


OWN_PATTERNS = [("word_the", r"(?i)[ \n]the[ \n]", "low", "words"), ("broken", "[", "critical", "words"), ("long_number", r"[0-9]{6}", "high", "numbers")]
_OWN = [r for r in OWN_PATTERNS if r[0] != "broken"]


@query(f"select doc_id, score >= 0.5 as blocked, score as risk_score, 'house_rules' as checks_run from (select doc_id, {score_sql('text', _OWN)} as score from (select doc_id, coalesce(text, '') as text from documents))")
def own_scanner(spark, sf_dir):
    """A registered scanner of patterns of one's own; what doesn't compile is left out."""
    scanners.register_patterns("house_rules", OWN_PATTERNS)
    try:
        return guard.verdict(table(spark, sf_dir, "documents", "doc_id", "text"), checks=["house_rules"]).select("doc_id", "blocked", "risk_score", "checks_run")
    finally:
        del scanners.registered["house_rules"]


@query(f"select doc_id, {score_sql('text', _OWN)} as score from documents where text is not null")
def catalog_from_json(spark, sf_dir):
    """A catalog read from a JSON file."""
    with tempfile.TemporaryDirectory() as d:  # read on the driver, before the query runs
        path = os.path.join(d, "catalog.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"patterns": [dict(zip(("id", "pattern", "severity", "category"), r, strict=True)) for r in OWN_PATTERNS]}, f)
        rows = C.from_json(path, "category")
    return table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", top_score(F.col("text"), rows).alias("score"))


def _configs() -> dict[str, conf.Config]:
    """Configurations that went through a file, an environment and a nested dict."""
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "config.json")
        conf.Config(sensitivity="strict", scanners={"pii": False}).save(path)
        saved = conf.from_file(path)
    env = conf.from_env("X_", {"X_SENSITIVITY": "low", "X_ENABLE_TOXICITY": "false"})
    return {"file": saved, "env": env, "dict": conf.from_dict({"scanners": {"pii": {"enabled": True, "threshold": 0.3}, "injection": False}, "early_exit": False})}


_TOLD = {"file": conf.Config(sensitivity="strict", scanners={"pii": False}), "env": conf.Config(sensitivity="low", scanners={"toxicity": False}), "dict": conf.Config(thresholds={"pii": 0.3}, scanners={"injection": False, "pii": True}, early_exit=False)}
_TURNS = "(select conv_id, turn, coalesce(text, '') as text from conversations)"


@query(" union all ".join(f"select '{n}' as source, checks_run, count(*)::bigint as n, count(*) filter (where blocked)::bigint as n_blocked from ({_verdict_sql(_TURNS, 'conv_id, turn', 'text', 'input', c)}) group by all" for n, c in _TOLD.items()))
def config_sources(spark, sf_dir):
    """Verdicts under configurations from a saved file, the environment and a dict."""
    docs, out = table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), None
    for name, c in _configs().items():
        own = guard.verdict(docs, config=c).groupBy("checks_run").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked")).select(F.lit(name).alias("source"), "checks_run", "n", "n_blocked")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"select conv_id, turn, blocked, risk_score, checks_run from ({_verdict_sql(_TURNS, 'conv_id, turn', 'text', 'input', conf.Config())})")
def scan_as_json(spark, sf_dir):
    """A scan's result as JSON for sinks of text, read again."""
    rows = guard.as_json(guard.scan(table(spark, sf_dir, "conversations", "conv_id", "turn", "text")))
    at = F.from_json("scan_json", "blocked boolean, risk_score double, checks map<string,struct<score:double>>")
    return rows.withColumn("j", at).select("conv_id", "turn", "j.blocked", "j.risk_score", F.array_join(F.array_sort(F.map_keys("j.checks")), ",").alias("checks_run"))


@query(f"select blocked, count(*)::bigint as n, count(distinct conv_id)::bigint as n_conversations from ({_verdict_sql(_TURNS, 'conv_id, turn', 'text', 'input', conf.Config())}) group by 1")
def quarantined(spark, sf_dir):
    """A stream that parts what passes from what is blocked, into two tables."""
    rows = turns(spark, sf_dir).drop("role")
    replay, at = Replay(spark, rows.schema), folder(spark)
    replay.slices(rows, F.expr("cast(turn div 4 as int)"), 3)
    quarantine(scan_stream(replay.stream()), f"{at}/passed", f"{at}/blocked", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/passed").unionByName(spark.read.parquet(f"{at}/blocked")).groupBy("blocked").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))


_level = lambda x: f"case when {x} > 0.9 then 'critical' when {x} > 0.7 then 'high' else 'medium' end"
_screened_pii = ", ".join(f"case when {matches('text', screen.pattern(p, i))} then 'pii_{n}:{lv}' end" for n, p, i, lv in C.SCREEN)


@query(f"""with m as (select doc_id, text, doc_id % 100 / 100.0::double as i, doc_id % 37 / 37.0::double as h from documents),
t as (select *, list_filter([case when i > 0.5 then 'prompt_injection:' || {_level('i')} end, case when h > 0.5 then 'harmful_content:' || {_level('h')} end, {_screened_pii}], lambda x: x is not null) as t, len(list_filter([{_screened_pii}], lambda x: x is not null)) > 0 as p from m)
select doc_id, p or greatest(i, h) >= 0.7 as blocked, round(case when p then 1.0 else greatest(i, h) end, 9)::double as risk_score, array_to_string(t, '|') as threats from t""")
def screen_models(spark, sf_dir):
    """The second screen with two models' scores beside its patterns."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = screen.screen(docs, injection=F.col("doc_id") % 100 / F.lit(100.0), harmful=F.col("doc_id") % 37 / F.lit(37.0))
    shown = F.array_join(F.transform("screen.threats", lambda t: F.concat(t["type"], F.lit(":"), t["level"])), "|")
    return rows.select("doc_id", "screen.blocked", F.round("screen.risk_score", 9).alias("risk_score"), shown.alias("threats"))


def broken_model():
    raise OSError("no such model")


@query(f"select conv_id, turn, {phrase_score_sql('len(m)', 0.4, 0.95)} as score from (select conv_id, turn, {phrases_sql('text', C.INJECTION)} as m from {_TURNS})")
def broken_model_lets_pass(spark, sf_dir):
    """A model that can't be loaded leaves the phrases' score: scans fail open."""
    rows = guard.scan(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), checks=["injection"], models={"injection": models.probability("broken", lambda: broken_model())})
    return rows.select("conv_id", "turn", F.col("scan.checks")["injection"]["score"].alias("score"))


def queries() -> dict[str, Callable]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
