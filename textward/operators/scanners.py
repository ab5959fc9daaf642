"""The scanners: each turns text columns into one struct, score, findings and what it found on the way."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.prefilter import guarded
from textward.functions.spans import cut, field, found, hit, let, masked, score_of, splice, unions
from textward.sources import catalogs as C

FINDING = "struct<type:string,value:string,start:int,end:int,severity:string,confidence:double,detail:string>"


def finding(type_, value, start, end, severity, confidence, detail) -> Column:
    as_ = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(as_(type_, "string").alias("type"), as_(value, "string").alias("value"), as_(start, "int").alias("start"), as_(end, "int").alias("end"), as_(severity, "string").alias("severity"), as_(confidence, "double").alias("confidence"), as_(detail, "string").alias("detail"))


def none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def masked_value(value: Column, ord_: Column, style: str, rows: list[tuple]) -> Column:
    """A match's value under a style, by its pattern's template."""
    if style != "partial":
        return masked(value, style, "")
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        by.setdefault(r[3], []).append(i)
    case = None
    for t, own in by.items():
        case = (F if case is None else case).when(ord_.isin(own), masked(value, style, t))
    return case


def pii_of(hits: Column, style: str = "full", rows: list[tuple] = C.PII) -> Column:
    """The findings of matches; the value is redacted."""
    return F.transform(hits, lambda x: finding(field(rows, 0, x["ord"]), masked_value(x["value"], x["ord"], style, rows), x["start"], x["end"], field(rows, 2, x["ord"]), 0.9, field(rows, 0, x["ord"])))


def redacted_by(text: Column, hits: Column, style: str = "full", rows: list[tuple] = C.PII) -> Column:
    """The text with all matches replaced; as it is without any."""
    new = F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord"), masked_value(x["value"], x["ord"], style, rows).alias("new")))
    return F.when(F.size(hits) == 0, text).otherwise(splice(text, new))


def pii_findings(text: Column, style: str = "full", rows: list[tuple] = C.PII) -> Column:
    """All matches in catalog order; the value is redacted."""
    return let(found(text, rows), lambda hits: pii_of(hits, style, rows))


def pii_redacted(text: Column, style: str = "full", rows: list[tuple] = C.PII) -> Column:
    """The text with all matches replaced; as it is without any."""
    return let(found(text, rows), lambda hits: redacted_by(text, hits, style, rows))


def covered_by(text: Column, hits: Column, style: str = "full", rows: list[tuple] = C.PII) -> Column:
    """The text with each union of overlapping matches replaced once, by the gravest one's form; as it is without any.

    Nothing outside a match is lost, and of a match nothing stays but what its style shows. :func:`redacted_by` replaces
    overlapping matches one after another, at the places that they had before.
    """
    rank = F.array(*(F.lit(C.SEVERITY[r[2]]) for r in rows))

    def build(u):
        ends = F.concat(F.array(F.lit(0)), F.transform(u, lambda x: x["end"]))
        piece = lambda x, i: F.concat(F.substring(text, F.get(ends, i) + 1, x["start"] - F.get(ends, i)), masked_value(F.substring(text, x["start"] + 1, x["end"] - x["start"]), x["ord"], style, rows))
        rest = F.substring(text, F.element_at(ends, -1) + 1, F.lit(2**31 - 1))
        return F.when(F.size(u) == 0, text).otherwise(F.concat(F.array_join(F.transform(u, piece), ""), rest))

    return let(unions(hits, rank), build)


def pii_covered(text: Column, style: str = "full", rows: list[tuple] = C.PII) -> Column:
    """As :func:`covered_by`, of all personal data."""
    return let(found(text, rows), lambda hits: covered_by(text, hits, style, rows))


def matched_of(hits: Column, rows: list[tuple], confidence: float, mask: bool = False) -> Column:
    """The findings of matches of a catalog with categories; the value is cut to 100 characters, or masked."""
    show = (lambda v: F.concat(F.substring(v, 1, 4), F.lit("***"))) if mask else (lambda v: cut(v, 100))
    return F.transform(hits, lambda x: finding(field(rows, 0, x["ord"]), show(x["value"]), x["start"], x["end"], field(rows, 2, x["ord"]), confidence, field(rows, 3, x["ord"])))


def matched_findings(text: Column, rows: list[tuple], confidence: float, mask: bool = False) -> Column:
    """All matches of a catalog with categories, in its order."""
    return let(found(text, rows), lambda hits: matched_of(hits, rows, confidence, mask))


def code_findings(text: Column, rows: list[tuple] = C.CODE) -> Column:
    return matched_findings(text, rows, 0.85)


def secret_findings(text: Column, rows: list[tuple] = C.SECRETS) -> Column:
    return matched_findings(text, rows, 0.9, mask=True)


def categories(text: Column, rows: list[tuple] = C.CODE) -> Column:
    """The categories that match, sorted."""

    def build(may):
        by: dict[str, list[Column]] = {}
        for i, (_, p, _, c) in enumerate(rows):
            by.setdefault(c, []).append(may(i) & hit(text, p))
        return F.filter(F.array(*(F.when(reduce(lambda a, b: a | b, by[c]), F.lit(c)) for c in sorted(by))), lambda x: x.isNotNull())

    return guarded(text, [r[1] for r in rows], build)


def phrases(text: Column, listed: list[str]) -> Column:
    """The phrases that the lower-cased text holds, in the list's order."""
    return let(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, listed)), lambda p: F.contains(low, p)))


def phrase_score(n: Column, base: float, most: float) -> Column:
    return F.when(n > 0, F.least(F.lit(most), F.lit(base) + n * F.lit(0.15))).otherwise(F.lit(0.0))


def combined(model: Column | None, pattern: Column, weight: float) -> Column:
    """A model's score if there is one above 0, else the phrases'; with both, the phrases count less."""
    if model is None:
        return pattern
    return F.when(F.coalesce(model, F.lit(0.0)) > 0, F.greatest(model, pattern * F.lit(weight))).otherwise(pattern)


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "critical").when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low")


def any_of(matched: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(matched, F.array(*map(F.lit, listed)))


def injection(text: Column, model: Column | None = None) -> Column:
    """struct(score, findings, matched): phrases, and a model's probability if given."""

    def build(m):
        score = combined(model, phrase_score(F.size(m), 0.4, 0.95), 0.8)
        kind = F.when(any_of(m, C.JAILBREAK), "jailbreak_attempt").when(any_of(m, C.EXTRACTION), "prompt_extraction").when(any_of(m, C.OVERRIDE), "instruction_override").otherwise("prompt_injection")
        one = F.when(score > 0.3, F.array(finding(kind, cut(text, 100), 0, F.length(text), grade(score), score, F.array_join(m, "|")))).otherwise(none())
        return F.struct(score.alias("score"), one.alias("findings"), m.alias("matched"))

    return let(phrases(text, C.INJECTION), build)


def toxicity(text: Column, labels: Column | None = None) -> Column:
    """struct(score, findings, matched, primary, types): phrases, and a model's probabilities in the labels' order if given.

    types: the labels above 0.5, or the primary one; null if the score isn't above 0.3.
    """

    def build(m):
        model = F.array_max(labels) if labels is not None else None
        score = combined(model, phrase_score(F.size(m), 0.3, 0.9), 0.7)
        primary = F.lit("toxic")
        types = F.array(primary)
        extra = none()
        if labels is not None:
            named = F.array(*(F.struct(labels[i].alias("p"), F.lit(-i).alias("k"), F.lit(n).alias("label")) for i, n in enumerate(C.TOXIC_LABELS)))
            best = F.array_max(named)["label"]
            primary = F.when(F.coalesce(model, F.lit(0.0)) > 0, best).otherwise("toxic")
            over = F.transform(F.filter(named, lambda x: x["p"] > 0.5), lambda x: x["label"])
            types = F.when(F.size(over) > 0, over).otherwise(F.array(primary))
            more = F.filter(named, lambda x: (x["p"] > 0.7) & (x["label"] != best))
            extra = F.transform(more, lambda x: finding(x["label"], F.concat(F.lit("Detected "), F.replace(x["label"], F.lit("_"), F.lit(" "))), 0, F.length(text), F.when(x["p"] > 0.9, "critical").otherwise("high"), x["p"], x["label"]))
        one = F.array(finding(primary, cut(text, 100), 0, F.length(text), grade(score), score, F.array_join(m, "|")))
        listed = F.when(score > 0.3, F.concat(one, extra)).otherwise(none())
        return F.struct(score.alias("score"), listed.alias("findings"), m.alias("matched"), primary.alias("primary"), F.when(score > 0.3, types).alias("types"))

    return let(phrases(text, C.TOXIC), build)


JUDGE = "struct<faithful:boolean,confidence:double,hallucinations:array<struct<claim:string,issue:string,severity:string>>>"


def judged(context: Column, payload: Column) -> Column:
    """struct(score, findings, error, claims) of a judge's JSON. What can't be read counts as faithful with 0.5.

    Without a context, or an answer, nothing is claimed: score 0 and why in ``error``. ``claims`` are the findings' whole
    claims with their issues; a finding shows 200 characters.
    """
    j = F.from_json(payload, JUDGE)
    sure = F.coalesce(j["confidence"], F.lit(0.5))
    score = F.when(F.coalesce(j["faithful"], F.lit(True)), F.lit(1.0) - sure).otherwise(sure)
    level = lambda x: F.when(F.lower(x["severity"]).isin("low", "medium", "high", "critical"), F.lower(x["severity"])).otherwise("medium")
    listed = F.coalesce(j["hallucinations"], F.array().cast("array<struct<claim:string,issue:string,severity:string>>"))
    claim, issue = (lambda x: F.coalesce(x["claim"], F.lit("Unknown claim"))), (lambda x: F.coalesce(x["issue"], F.lit("Unknown issue")))
    claimed = F.transform(listed, lambda x: finding("hallucination", cut(claim(x), 200), 0, 0, level(x), sure, issue(x)))
    claims = F.transform(listed, lambda x: F.struct(claim(x).alias("claim"), issue(x).alias("issue")))
    # a judge whose numbers are out of range has failed: the check passes
    error = F.when(context.isNull() | (context == ""), "no context").when(payload.isNull(), "no answer of a judge").when(~sure.between(0.0, 1.0), "confidence out of range")
    bad = error.isNotNull()
    return F.struct(F.when(bad, 0.0).otherwise(score).alias("score"), F.when(bad, none()).otherwise(claimed).alias("findings"), error.alias("error"), F.when(~bad, claims).alias("claims"))


#: The question to a judge model, in our words, and what stands before the answer.
ASK = "Compare the answer with the source. Reply in JSON with faithful, confidence and hallucinations (claim, issue, severity).\n\nSource:\n"
ANSWER = "\n\nAnswer:\n"


def judge_prompt(context: Column, text: Column) -> Column:
    """The question to a judge model; both texts are cut to 4000 characters."""
    return F.concat(F.lit(ASK), F.substring(F.coalesce(context, F.lit("")), 1, 4000), F.lit(ANSWER), F.substring(text, 1, 4000))


def hallucination_simple(text: Column, context: Column) -> Column:
    """struct(score, findings, indicators, citations, mismatch) by phrases, citations and words that the context lacks."""

    def words(x):
        return F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))

    def build(m):
        low = F.lower(text)
        cited = [F.size(F.regexp_extract_all(text, F.lit(f"(?idU){p}"), F.lit(0))) for p in C.CITATIONS]
        n_cited = sum(cited[1:], cited[0])
        has_context = F.coalesce(context != "", F.lit(False))

        def missing(phrase):
            at = F.locate(phrase, low)  # of the first occurrence, from 1
            start = F.greatest(F.lit(0), at - 1 - 50)
            claim = words(F.lower(F.substring(text, start + 1, at - 1 + len(phrase) + 100 - start)))
            share = F.size(F.array_intersect(claim, words(F.lower(context)))) / F.size(claim)
            return F.when(F.contains(low, F.lit(phrase)) & has_context & (F.size(claim) > 0) & (share < 0.3), 1).otherwise(0)

        gaps = [missing(p) for p in C.FABRICATION]
        n_gaps = sum(gaps[1:], gaps[0])
        score = F.least(F.lit(0.5), F.lit(0.1) * F.size(m)) + F.least(F.lit(0.3), F.lit(0.1) * n_cited)
        # 0.2 for each, added one by one
        score = F.aggregate(F.when(n_gaps > 0, F.sequence(F.lit(1), n_gaps)).otherwise(F.array().cast("array<int>")), score, lambda s, _: s + F.lit(0.2))
        fires = (F.size(m) > 0) | ((n_cited > 0) & ~has_context)

        def end(s):
            text_of = F.concat(F.lit("Found "), F.size(m).cast("string"), F.lit(" fabrication indicators"))
            one = F.array(finding("potential_hallucination", text_of, 0, F.length(text), F.when(s < 0.5, "medium").otherwise("high"), F.least(F.lit(0.7), s), F.array_join(m, "|")))
            return F.struct(F.least(F.lit(0.9), s).alias("score"), F.when(fires, one).otherwise(none()).alias("findings"), m.alias("indicators"), n_cited.cast("long").alias("citations"), (n_gaps > 0).alias("mismatch"))

        return let(score, end)

    return let(phrases(text, C.FABRICATION), build)


#: Scanners of one's own: name -> (tier, direction, function of the text column to struct(score, findings)).
registered: dict[str, tuple[str, str, Callable[[Column], Column]]] = {}


def register_scanner(name: str, build: Callable[[Column], Column], tier: str = "slow", direction: str = "both") -> None:
    if tier not in ("fast", "slow", "cloud") or direction not in ("input", "output", "both"):
        raise ValueError("tier is fast, slow or cloud; direction input, output or both")
    registered[name] = (tier, direction, build)


def register_patterns(name: str, rows: list[tuple], tier: str = "fast", direction: str = "both", confidence: float = 0.9) -> None:
    """A scanner of a catalog of one's own: rows of (id, pattern, severity, category). Patterns that don't compile are left out."""
    good = C.valid(rows)
    register_scanner(name, lambda text: let(found(text, good), lambda hits: F.struct(score_of(hits, good).alias("score"), matched_of(hits, good, confidence).alias("findings"))), tier, direction)
