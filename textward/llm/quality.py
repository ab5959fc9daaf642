"""Quality rules with risk-controlled cutoffs, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A document with fewer words, or a larger share of words in repeated windows (in percent), fails before any cutoff.
MIN_WORDS, MAX_REPEAT = 20, 30
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: The rules: a value of the document, and the cutoffs tried; a document is rejected if the value is above the cutoff.
RULES = {
    "symbols": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "dup_lines": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "word_chars": (5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 12.0),
}
#: At most this share of a stratum's good documents may be rejected wrongly by all rules together ...
RISK = 0.04
#: ... but for this chance that any bound of any stratum, rule and cutoff is wrong.
DELTA = 0.05
#: Among cutoffs that may be used, losing a good document weighs as much as catching so many bad ones.
PRICE = 5


def row_key():
    """What the verdict depends on, hashed, with the doc_id; of the columns as :func:`measures` casts them."""
    doc_id, lang, text = F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")
    return F.struct(F.xxhash64(doc_id, lang, text).alias("x"), F.hash(text, lang).alias("y"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (lang, null: "und"), row_key and the base numbers of each whole text; null is the empty text."""
    rows = common.columns(docs, doc_id="long", lang="string", text="string")
    rows = rows.select("doc_id", row_key().alias("row_key"), F.coalesce("lang", F.lit("und")).alias("stratum"), F.coalesce("text", F.lit("")).alias("text"))
    words = common.words(F.col("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(common.WORD))
    rows = rows.select(
        "doc_id", "row_key", "stratum",
        words.alias("w"),
        F.size(F.regexp_extract_all("text", F.lit(SYMBOLS), F.lit(0))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))[0].alias("lines"),
    )
    rows = rows.select("doc_id", "row_key", "stratum", "n_symbols", "lines", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    return rows.select("doc_id", "row_key", "stratum", "n_words", "word_chars", "n_symbols", F.col("lines.d").alias("n_dup_lines"), F.col("lines.n").alias("n_lines"), repeated(F.col("h")).alias("n_repeat_words"))


def repeated(hashes):
    """Of an array of word hashes, how many are in a window of WINDOW that occurs twice or more."""
    windows = F.when(F.size(hashes) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))))

    def count(all_):
        # sorted by window and place: one that equals a neighbour is repeated
        by = F.sort_array(F.transform(all_, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(own):
            before = F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.slice(own, F.lit(1), F.size(own) - 1))
            after = F.concat(F.slice(own, F.lit(2), F.size(own) - 1), F.array(F.lit(None).cast("struct<x:bigint,i:int>")))
            three = F.arrays_zip(own.alias("o"), before.alias("b"), after.alias("a"))
            kept = F.filter(three, lambda t: F.coalesce(t["o"]["x"] == t["b"]["x"], F.lit(False)) | F.coalesce(t["o"]["x"] == t["a"]["x"], F.lit(False)))
            return F.sort_array(F.transform(kept, lambda t: t["o"]["i"]))

        def covered(at):
            step = F.aggregate(at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")))
            return step["n"]

        return F.transform(F.transform(F.array(by), places), covered)[0]

    def split(all_):
        return F.when(F.size(F.array_distinct(all_)) == F.size(all_), F.lit(0)).otherwise(count(all_))

    return F.coalesce(F.transform(F.array(windows), lambda x: F.when(x.isNull(), F.lit(0)).otherwise(split(x)))[0], F.lit(0)).cast("long")


def values():
    """The rules' values, from the base numbers."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "word_chars": share("word_chars", "n_words")}


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def tail(k, n, p: float):
    """P(X <= k) for X of the binomial distribution (n, p), exactly: a sum of k + 1 terms, by their ratios, from logarithms."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("t"), F.exp(n * math.log(1 - p)).alias("s"))
    add = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + odds).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + odds)).alias("s"))
    return F.when(k == 0, F.exp(n * math.log(1 - p))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, add, lambda a: a["s"]))


def cutoffs(numbers: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): for each stratum and rule the cutoff to use; those without one aren't there.

    ``labels`` (doc_id, quality 0 or 1) are the holdout: the cutoffs tried are fixed beforehand, so every labelled
    document that passes the base rules counts. For a stratum, a rule and a cutoff, k of n good documents would be
    rejected. The cutoff may be used if P(Binomial(n, risk / rules) <= k) is at most delta divided by the number of all
    strata, rules and cutoffs (Bonferroni): then, with probability 1 - delta, no stratum loses more than ``risk`` of its
    good documents. Of the usable ones that is taken which rejects most bad documents, less PRICE times the good ones; the loosest
    on a tie, none if it isn't above 0. A stratum with too few labels gets no cutoff. Labels that are null, or both 0 and 1 for a
    document, don't count; a label without a document neither.
    """
    told = common.columns(labels, doc_id="long", quality="int").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2")
    rows = numbers.filter(~base_failed()).join(told.select("doc_id", "q"), "doc_id")
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), v.alias("value"), F.array(*map(F.lit, RULES[name])).alias("cuts")) for name, v in values().items()))
    long = rows.select("stratum", "q", F.explode(rules).alias("r")).select("stratum", "q", "r.rule", F.col("r.value").alias("value"), F.explode("r.cuts").alias("cutoff"))
    hit = F.col("value") > F.col("cutoff")
    seen = long.groupBy("stratum", "rule", "cutoff").agg(F.count_if(F.col("q") == 1).alias("n"), F.count_if((F.col("q") == 1) & hit).alias("k"), F.count_if((F.col("q") == 0) & hit).alias("bad"))
    seen = common.materialize(seen, "tests")  # a row for each stratum, rule and cutoff
    tests = max(1, seen.count())
    p = risk / len(RULES)
    usable = seen.withColumn("gain", F.col("bad") - PRICE * F.col("k")).filter("gain > 0").filter(F.col("k") <= F.col("n") * p).filter(tail(F.col("k"), F.col("n"), p) <= delta / tests)
    return usable.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff"))["cutoff"].alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The measures of each row with base_failed and kept."""
    numbers = common.materialize(measures(docs), "measures")
    # a row for each stratum: as many as there are languages
    cuts = common.materialize(cutoffs(numbers, labels, risk, delta).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).select("stratum", *(F.col(r).alias(f"cut_{r}") for r in RULES)), "cutoffs")
    over = F.lit(False)
    for name, v in values().items():
        over = over | F.coalesce(v > F.col(f"cut_{name}"), F.lit(False))
    failed = base_failed()
    return numbers.join(common.few(cuts, 100_000), "stratum", "left").withColumns({"base_failed": failed, "kept": ~failed & ~over})


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, the base numbers, base_failed, kept.

    Null and empty texts have no words and fail. A stratum without cutoffs keeps all that passes the base rules. Rows with
    one doc_id are judged each by its own text and count each on the holdout if labelled. Other columns are ignored; an
    empty table gives no rows, empty labels no cutoffs.
    """
    return verdicts(docs, labels, risk, delta).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that :func:`judge` keeps."""
    (key,) = common.unused(docs, "row_key")
    out = common.materialize(verdicts(docs, labels, risk, delta).filter("not kept").select(F.col("row_key").alias(key)).distinct(), "rejected")
    return docs.withColumn(key, row_key()).join(common.few(out), key, "left_anti").drop(key)


def oracle(risk: float = RISK, delta: float = DELTA) -> str:
    """The same in DuckDB's SQL."""
    p = risk / len(RULES)
    value = {"symbols": "n_symbols::double / greatest(word_chars, 1)", "dup_lines": "n_dup_lines::double / greatest(n_lines, 1)", "repeats": "n_repeat_words::double / greatest(n_words, 1)", "word_chars": "word_chars::double / greatest(n_words, 1)"}
    grid = ", ".join(f"('{r}', {c}::double)" for r, cs in RULES.items() for c in cs)
    case = " ".join(f"when '{r}' then {v}" for r, v in value.items())
    return rf"""
with d as (select row_number() over () as row_id, doc_id, coalesce(lang, 'und') as stratum, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select row_id, i, list_slice(w, i, i + {WINDOW - 1}) as win from (select row_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from w where len(w) > {WINDOW})),
twice as (select row_id, i from (select row_id, i, count(*) over (partition by row_id, win) as n from g) where n > 1),
rep as (select row_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW})))::bigint as n from (select row_id, i, lag(i) over (partition by row_id order by i) as before from twice) group by row_id),
m as (select row_id, doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  len(regexp_extract_all(text, '{SYMBOLS}'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines, coalesce(rep.n, 0) as n_repeat_words
  from w left join rep using (row_id)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed from m),
told as (select doc_id, min(quality) as q from labels where quality in (0, 1) group by doc_id having min(quality) = max(quality)),
grid(rule, cutoff) as (values {grid}),
v as (select b.*, rule, cutoff, case rule {case} end as value from b, grid where not base_failed),
seen as (select stratum, rule, cutoff, count(*) filter (where q = 1) as n, count(*) filter (where q = 1 and value > cutoff) as k, count(*) filter (where q = 0 and value > cutoff) as bad from v join told using (doc_id) group by all),
usable as (select * from seen where bad - {PRICE} * k > 0 and k <= n * {p}::double and
  list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}::double) + (n - i) * ln(1 - {p}::double)))) <= {delta}::double / (select count(*) from seen)),
cut as (select stratum, rule, arg_max(cutoff, (bad - {PRICE} * k) * 1000.0 + cutoff) as cutoff from usable group by all),
over_ as (select distinct row_id from v join cut using (stratum, rule) where value > cut.cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and row_id not in (select row_id from over_) as kept from b
"""
