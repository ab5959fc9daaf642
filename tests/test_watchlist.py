import random
import re

import pytest

from textward.operators import watchlist

PATTERNS = "pattern_id string, pattern string, text string, n long"


def brute(texts, patterns):
    out = []
    for key, text in texts:
        for pid, p in patterns:
            try:
                n = len(re.findall(p, text or "")) if p is not None else 0
            except re.error:
                n = 0
            if n:
                out.append((key, pid, n))
    return sorted(out, key=repr)


def run(spark, texts, patterns):
    left = spark.createDataFrame([(k, t, "x", 1) for k, t in texts], "doc_id long, text string, pattern_id string, n int")
    right = spark.createDataFrame([(i, p, "y", 2) for i, p in patterns], PATTERNS)
    return sorted(map(tuple, watchlist.matches(left, right).collect()), key=repr)


def made(seed, n_patterns, n_texts):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeik") for _ in range(rng.randint(3, 7))) for _ in range(400)] + ["ſtar", "Kelvin", "istanbul", "grüße"]
    shapes = [lambda a, b: rf"{a}\s+{b}", lambda a, b: rf"(?i)\b{a}\b", lambda a, b: rf"(?:{a}|{b})x?", lambda a, b: rf"(?i){a}.{{0,5}}{b}", lambda a, b: rf"{a}\d+", lambda a, b: rf"(?i){a}|q{b}"]
    patterns = [(f"p{i}", rng.choice(shapes)(rng.choice(words), rng.choice(words))) for i in range(n_patterns)]
    texts = [(i, " ".join(rng.choice([w, w.upper(), w + "7", "İ" + w[1:]]) for w in rng.choices(words, k=rng.randint(0, 30)))) for i in range(n_texts)]
    return texts, patterns


@pytest.mark.parametrize("part", [100_000, 700])
def test_thousands_of_patterns_against_each_by_each(spark, monkeypatch, part):
    monkeypatch.setattr(watchlist, "PART", part)
    texts, patterns = made(1, 5000 if part > 1000 else 1500, 120)
    # Java folds İ onto i where Python doesn't, so the odd letter is looked at in the next test
    texts = [(k, t.replace("İ", "i")) for k, t in texts]
    want = brute(texts, patterns)
    assert run(spark, texts, patterns) == want and len(want) > 500


def test_work_is_in_proportion_to_candidates():
    texts, patterns = made(2, 5000, 200)
    automaton = watchlist.Automaton([(i, [sorted(c) for c in watchlist.required(p) if min(map(len, c)) >= 3 and watchlist.DIGIT not in c]) for i, (_, p) in enumerate(patterns)])
    candidates = sum(len(automaton.candidates(t)) for _, t in texts)
    hits = len(brute(texts, patterns))
    assert hits <= candidates < 0.1 * len(texts) * len(patterns)


def test_odd_rows_and_patterns(spark):
    patterns = [("a", "(?i)license"), ("b", "["), ("c", None), ("d", r"\d{2}"), ("a", "(?i)license"), ("a", "other"), (None, "no id"), ("e", r"^x"), ("f", "(?i)ſafe")]
    texts = [(1, "driver lİcenſe"), (2, None), (3, ""), (None, "LICENSE 12 other"), (4, "no id, no id"), (4, "no id"), (5, "x SAFE"), (6, "license " * 20000)]
    assert run(spark, texts, patterns) == sorted([(1, "a", 1), (1, "a", 1), (None, "a", 1), (None, "a", 1), (None, "d", 1), (None, "a", 1), (4, None, 2), (4, None, 1), (5, "e", 1), (5, "f", 1), (6, "a", 20000), (6, "a", 20000)], key=repr)
    assert run(spark, texts, []) == [] and run(spark, [], patterns) == []


def test_too_many_patterns_without_literals_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(watchlist, "BARE", 2)
    with pytest.raises(ValueError, match="more than 2"):
        run(spark, [(1, "x")], [(str(i), f"[ab]{{{i + 1}}}") for i in range(3)])


def test_any_number_of_patterns_with_short_words_or_none(spark, monkeypatch):
    # several hundred runs of short words, which have no literal of 3 characters, aren't bare
    words = ["ci", "n", "de", "la", "os", "a"]
    short = [f"(?i){a}[ \n]+{b}[ \n]+{c}" for a in words for b in words for c in words]
    assert len(short) > 2 * watchlist.BARE and all(watchlist.runs(p) for p in short)
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice([w, w.upper(), " ", "\n", "  "]) for w in rng.choices(words, k=40))) for i in range(150)]
    patterns = [(f"s{i}", p) for i, p in enumerate(short)]
    want = brute(texts, patterns)
    assert run(spark, texts, patterns) == want and len(want) > 100
    # and those without any literal are tested in several passes where the caller wants it
    monkeypatch.setattr(watchlist, "BARE", 2)
    bare = [(f"b{i}", f"[ab]{{{i + 1}}}") for i in range(5)]
    left, right = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bare, "pattern_id string, pattern string")
    assert sorted(map(tuple, watchlist.matches(left, right, limited=False).collect()), key=repr) == brute(texts, bare)


@pytest.mark.parametrize(("pattern", "clauses"), [(r"(?i)ci[ \n]+n", [{"ci ", "ci\n"}]), (r"a[bc]?d", []), (r"^ab+c", []), (r"a{1,2}b[xy]", [{"abx", "aby"}]), (r"a\d+bc", []), (r"[^a]bcd", [{"bcd"}]), (r"xyz|abc", []), (r"a{0,3}bc", [])])
def test_runs(pattern, clauses):
    assert [c for c in map(set, watchlist.runs(pattern))] == clauses


def test_words_of_a_run_are_candidates_only_together():
    pattern = "(?i)of[ \\n]+the[ \\n]+sea"
    assert watchlist.phrase(pattern) == "of the sea" and watchlist.phrase(r"a\s+b[xy]c") == "a b" and watchlist.phrase(r"[ab]+") == ""
    automaton = watchlist.Automaton([(1, [[watchlist.phrase(pattern)]])])
    assert [automaton.candidates(t) for t in ("Of \n the\nSEA", "the sea of", "of the  seas")] == [[1], [], [1]]
