import collections
import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textward.llm import common, divergence, fim, mixing, queries

DOCS = "doc_id long, text string, lang string, source string, doc string, key string, size long, place long, position string, words string, g string, part string"
MORE = ("d", "k", 1, 2, "p", "w", "g", "q")
ODD = [(1, "one two three", "en", "a", *MORE), (2, None, None, None, *MORE), (3, "", "en", "a", *MORE), (None, "no id é 日 🎉", "en", "b", *MORE), (4, " \n\t ", "en", "b", *MORE), (5, "x " * 60000, "de", None, *MORE), (5, "x " * 60000, "de", None, *MORE), (5, "other text", "de", "", *MORE), (6, "has <S> in it", "en", "a", *MORE)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- fill in the middle

def brute_units(text, rule):
    c, k = re.escape(rule.marks), "" if rule.size is None else rule.size
    each = f"[{c}]{{1,{k}}}|[^{c}]{{1,{k}}}" if rule.marks else f"(?s:.){{1,{k}}}"
    return [m.group() for m in re.finditer(each, text)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é日🎉\n\t.<>PSM"), max_size=60), st.sampled_from([fim.Rule(), fim.Rule(size=None), fim.Rule(size=3), fim.Rule(marks="", size=2), fim.Rule(marks=".<", size=None)]))
def test_ranks_are_places_of_units(text, rule):
    scanner, units = fim.Scanner(rule), brute_units(text, rule)
    bounds, before, seen = scanner.runs(text)
    assert before[-1] == len(units) and seen == any(s in text for s in rule.sentinels)
    assert [scanner.place(bounds, before, r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]


@settings(max_examples=200, deadline=None)
@given(st.integers(-5, 10**6), st.text(st.sampled_from("ab é日🎉\n<>PSM"), max_size=40))
def test_forms_against_the_contract(doc_id, text):
    got = fim.turned(fim.Scanner(fim.Rule()), fim.Rule(), doc_id, text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 90:
        assert got == (doc_id, n, "plain", None, None, None, None, text)
        return
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    assert got == (doc_id, n, form, a, b - a, a, b - a, out)


def test_overlapping_sentinels_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">x", "<M>"), ("ab", "abc", "d")):
        with pytest.raises(ValueError):
            fim.Rule(sentinels=bad)
    with pytest.raises(ValueError):
        fim.Rule(marks="é")


@pytest.mark.parametrize("rule", [fim.Rule(), fim.Rule(size=None, cut=100), fim.Rule(sentinels=("<fim prefix>", "<fim suffix>", "<fim middle>"), cut=100, suffix_first=50)])
def test_texts_come_back(spark, sf, odd, empty, rule):
    for df in (odd, common.table(spark, sf, "documents")):
        out = fim.transform(df, rule)
        back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"), rule.sentinels).alias("text")).collect()
        assert sorted(map(repr, back)) == sorted(map(repr, df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
        assert df is odd or {"psm", "spm"} <= {r.form for r in out.select("form").distinct().collect()}
    assert fim.transform(empty, rule).collect() == [] and fim.transform(empty, rule).columns == ["doc_id", "n_units", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"]


# ---- the curriculum

def brute_targets(sizes, weights, share, most):
    """By the contract's words: shares by weight, the excess shared again until none is above."""
    left, out, free = share * sum(sizes), {}, {i for i, w in enumerate(weights) if w}
    while free:
        total = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / total > most * sizes[i]}
        if not over:
            return [out.get(i, left * weights[i] / total if i in free else 0.0) for i in range(len(sizes))]
        out |= {i: float(most * sizes[i]) for i in over}
        left -= sum(out[i] for i in over)
        free -= over
    return [out.get(i, 0.0) for i in range(len(sizes))]


def test_targets_against_sharing_again_and_again(spark):
    rng = random.Random(5)
    for k in (1, 2, 7, 40):
        sizes, weights = [rng.choice([0, 1, 10, 1000, rng.randint(1, 10**6)]) for _ in range(k)], [rng.choice([0.0, 1.0, 3.0, 0.01, 7.5]) for _ in range(k)]
        rows = [(f"s{i:03d}", n, [(0.0, w), (0.25, w), (1.0, w)]) for i, (n, w) in enumerate(zip(sizes, weights, strict=True))]
        found = spark.createDataFrame(rows, f"key string, source_size long, knots {mixing.KNOTS}")
        got = [r.target for r in mixing.targets(found).orderBy("key").collect()]
        assert got == pytest.approx(brute_targets(sizes, weights, mixing.SHARE, mixing.MOST))


def test_positions_invert_the_integral(spark):
    knots = [(0.0, 2.0), (0.2, 0.0), (0.5, 0.0), (0.7, 4.0), (0.7, 1.0), (1.0, 3.0)]

    def integral(t):
        out = 0.0
        for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
            if t > a:
                s = min(t, b) - a
                out += s * u + (v - u) / (b - a) * s * s / 2 if b > a else 0.0
        return out

    df = spark.createDataFrame([(integral(1.0) * i / 400, knots) for i in range(401)], f"need double, knots {mixing.KNOTS}")
    times = [r[0] for r in df.select(mixing.when_reached(mixing.segments(F.col("knots"))["out"], F.col("need"))).collect()]
    assert times == sorted(times) and [integral(t) for t in times] == pytest.approx([integral(1.0) * i / 400 for i in range(401)])


def test_numbers_are_those_of_one_window(spark):
    rows = spark.createDataFrame([(f"k{i * 37 % 501:04d}", i) for i in range(501)], "key string, at long").repartition(7)
    assert sorted((r.key, r.k, r.at) for r in common.numbered(rows, "key", name="k").collect()) == sorted((f"k{i * 37 % 501:04d}", i * 37 % 501, i) for i in range(501))


def test_the_mix(spark, sf, odd, empty):
    docs = common.table(spark, sf, "documents")
    rows = queries.op12_curriculum_mix(spark, sf).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, queries.op12_curriculum_mix(spark, sf).collect()), key=repr)
    # the texts that are trained on are what the plan takes, in order
    mixed = mixing.mix(docs)
    got = mixed.collect()
    assert [r.position for r in got] == sorted(r.position for r in got) and mixed.columns == [*docs.columns, "position", "words"]
    words = collections.Counter()
    for r in got:
        assert len(re.findall(common.WORD, r.text)) == r.words
        words[r.doc_id] += r.words
    assert {k: v for k, v in words.items() if v} == {r.doc_id: r.taken for r in rows if r.taken}


def test_odd_rows_are_mixed(spark, odd, empty):
    out = mixing.mix(odd)
    assert out.columns == [*odd.columns, "position_", "words_"]
    rows = out.collect()
    assert all(r.position == "p" and r.words == "w" and 0 <= r.position_ <= 1 for r in rows)
    total = sum(len(re.findall(common.WORD, r[1] or "")) for r in ODD)
    assert sum(r.words_ for r in rows) == pytest.approx(1.5 * total, abs=2)
    assert {r.text for r in rows} <= {r[1] for r in ODD} | {"x " * k + "x" for k in range(60000)} | {re.match(r"\s*\S+(\s+\S+){%d}" % k, r[1] or "").group() for r in ODD for k in range(6) if re.match(r"\s*\S+(\s+\S+){%d}" % k, r[1] or "")}
    assert mixing.mix(empty).collect() == [] and mixing.planned(empty).collect() == []
    nothing = odd.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(nothing).collect() == [] and {r.taken for r in mixing.planned(nothing).collect()} == {0}


def test_a_curriculum_of_ones_own(spark, sf):
    docs = common.table(spark, sf, "documents")
    plan = spark.createDataFrame([("src1", [(0.0, 1.0), (0.5, 1.0), (0.5, 0.0), (1.0, 0.0)]), ("src2", [(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (1.0, 1.0)])], f"source string, knots {mixing.KNOTS}")
    rows = mixing.mix(docs, plan, share=0.01, seed=3).collect()
    assert {r.source for r in rows} == {"src1", "src2"}
    assert all((r.position <= 0.5) == (r.source == "src1") or math.isclose(r.position, 0.5) for r in rows)


# ---- divergence

def brute_audit(rows, min_docs=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {i: i + 32 for i in range(65, 91)}
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for lang, source, text in ((lang or "", s or "", t or "") for lang, s, t in rows):
        found = term.findall(text.translate(low))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, names in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        v = len(kept)

        def p(get):
            n = sum(get(t) for t in kept)
            return {t: 1 + 10**9 * (get(t) + 1) // (n + v) for t in kept}

        q = p(lambda t: sum(counts[lang, s][t] for s in names))
        own = {s: p(lambda t: counts[lang, s][t]) for s in names}
        for s in names:
            pair = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in names if o != s]
            terms = [(-((own[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, each in (("pair", pair), ("term", terms)):
                out += [(lang, s, part, o, -f, i) for i, (f, o) in enumerate(sorted(each, key=lambda x: (x[0], x[1].encode())), 1) if part == "pair" or i <= top]
    return sorted(out)


def audited(df, **kw):
    return sorted(map(tuple, divergence.report(df, **kw).collect()))


def test_divergence_against_every_pair_and_term(spark, odd, empty):
    rng = random.Random(1)
    names = [None, "", "a", "ä", "日", "src", "z"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(names), " ".join(rng.choice(["Ab", "aB", "É", "é", "日本", "x1y", "-", "🎉", f"w{chr(97 + rng.randint(0, 9))}"]) for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    rows += [("only", "one", "a a a"), ("rare", "p", "u"), ("rare", "q", None), ("rare", "q", "v u")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert audited(df) == brute_audit(rows)
    assert audited(df, min_docs=1, top=3) == brute_audit(rows, 1, 3)
    assert audited(odd, min_docs=2) == brute_audit([(r[2], r[3], r[1]) for r in ODD], 2)
    assert audited(empty) == [] and divergence.report(empty).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_are_passed_on_in_parts(spark, sf, monkeypatch):
    docs = common.table(spark, sf, "documents").select("lang", "source", "text")
    whole = audited(docs)
    monkeypatch.setattr(divergence, "HELD", 50)
    batches = [b for b in divergence.tally(iter(docs.limit(40).toArrow().to_batches()))]
    sums = collections.Counter()
    for b in batches:
        for lang, source, term, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sums[lang, source, term] += n
    assert len(batches) > 3 and max(b.num_rows for b in batches) < 20000
    want = collections.Counter(w for r in docs.limit(40).collect() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text.translate({i: i + 32 for i in range(65, 91)})))
    got = collections.Counter()
    for (_, _, term), n in sums.items():
        if term:
            got[term] += n
    assert got == want and whole
