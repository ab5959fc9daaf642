"""Verdicts: scanners in tiers, early exit, blocking, redaction, pairs of prompts and answers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textward.functions.columns import col as column
from textward.functions.columns import others, unused
from textward.functions.spans import counts, found, let, score_of, top_score
from textward.operators import scanners as S
from textward.plans.config import Config
from textward.sources import catalogs as C

TIERS = ("fast", "slow", "cloud")
CHECK = "struct<passed:boolean,score:double,findings:array<" + S.FINDING + ">>"


def planned(config: Config, direction: str, checks: list[str] | None = None) -> list[tuple[str, str]]:
    """(scanner, tier) in running order: switched on, of this direction, asked for. No checks or an empty list ask for all."""
    out = [(i, t) for i, t, d, _ in C.SCANNERS if config.enabled(i) and d in ("both", direction) and (not checks or i in checks)]
    out += [(i, t) for i, (t, d, _) in S.registered.items() if d in ("both", direction) and (not checks or i in checks)]
    return sorted(out, key=lambda x: TIERS.index(x[1]))


CATALOGS = {"pii": C.PII, "code_injection": C.CODE, "secrets": C.SECRETS}


def findings_of(scanner: str, hits: Column, style: str) -> Column:
    """The findings of a catalog's matches."""
    if scanner == "pii":
        return S.pii_of(hits, style)
    return S.matched_of(hits, C.CODE, 0.85) if scanner == "code_injection" else S.matched_of(hits, C.SECRETS, 0.9, mask=True)


def scanned(scanner: str, text: Column, config: Config, context: Column | None = None, judge: Column | None = None, models: dict[str, Column] | None = None, hits: Column | None = None) -> Column:
    """struct(score, findings) of one scanner; ``hits`` are a catalog's matches, if they are at hand."""
    models = models or {}
    pair = lambda s, f: F.struct(s.alias("score"), f.alias("findings"))
    if scanner in CATALOGS:
        build = lambda h: pair(score_of(h, CATALOGS[scanner]), findings_of(scanner, h, config.style))
        return let(found(text, CATALOGS[scanner]), build) if hits is None else build(hits)
    if scanner == "injection":
        return let(S.injection(text, models.get(scanner)), lambda x: pair(x["score"], x["findings"]))
    if scanner == "toxicity":
        return let(S.toxicity(text, models.get(scanner)), lambda x: pair(x["score"], x["findings"]))
    if scanner == "hallucination":
        none = F.lit(None).cast("string")
        return let(S.judged(none if context is None else context, none if judge is None else judge), lambda x: pair(x["score"], x["findings"]))
    if scanner in S.registered:
        return S.registered[scanner][2](text)
    raise ValueError(f"unknown scanner {scanner!r}")


def critical(findings: Column) -> Column:
    return F.exists(findings, lambda x: x["severity"] == "critical")


def scan(df: DataFrame, text: str = "text", direction: str = "input", config: Config | None = None, context: str | None = None, judge: str | Callable | None = None, checks: list[str] | None = None, models: dict[str, Column | Callable] | None = None, out: str = "scan") -> DataFrame:
    """Adds a struct: blocked, risk_score, checks (a map, without those that weren't run), findings, reasons, sanitized_text, has_critical.

    A check passes if its score is below its threshold. With early exit a critical finding in a tier keeps later tiers
    from running. Null texts are scanned as empty. Only answers (direction output) are redacted.

    ``models``: for injection a probability, for toxicity the labels' probabilities, as columns, or as functions of a
    column of texts (:mod:`textward.operators.models`), which get null where early exit has stopped. ``judge``: a column
    of JSON answers, or a function of a column of prompts, which gets null there and where there is no context.

    A catalog's matches are found once; score, findings and redaction are made of them. A column named as ``out`` is
    replaced, all others stay.
    """
    config = config or Config()
    col = F.coalesce(F.col(text), F.lit(""))
    plan = planned(config, direction, checks)
    ctx = F.col(context) if context else None
    names, stopped, given, models, hits = [], F.lit(False), others(df, out), dict(models or {}), None
    added = lambda d, name: unused(d, f"_{out}_{name}")[0]
    redacts = direction == "output" and config.redaction
    for tier in TIERS:
        own = [i for i, t in plan if t == tier]
        for i in own:
            # a Python scorer's column is made before the expressions that read it, and not fed where it needn't run
            if i in models and not isinstance(models[i], Column):
                name = added(df, f"model_{i}")
                df = df.withColumn(name, models[i](F.when(~stopped, col)))
                models[i] = column(name)
            payload = F.col(judge) if isinstance(judge, str) else None
            if i == "hallucination" and callable(judge) and ctx is not None:
                name = added(df, "judge")
                df = df.withColumn(name, judge(F.when(~stopped & (ctx != ""), S.judge_prompt(ctx, col))))
                payload = column(name)
            if i == "pii" and redacts:
                hits = added(df, "hits")
                df = df.withColumn(hits, found(col, C.PII))
            x = scanned(i, col, config, ctx, payload, models, column(hits) if i == "pii" and hits else None)
            name = added(df, i)
            result = let(x, lambda r: F.struct((F.coalesce(r["score"], F.lit(0.0)) < config.threshold(i)).alias("passed"), F.coalesce(r["score"], F.lit(0.0)).alias("score"), r["findings"].alias("findings")))
            df = df.withColumn(name, F.when(~stopped, result).cast(CHECK) if config.early_exit else result.cast(CHECK))
            names.append((i, name))
        if own and config.early_exit:
            flag = added(df, f"stop_{tier}")
            df = df.withColumn(flag, reduce(lambda a, b: a | b, [F.coalesce(critical(column(n)["findings"]), F.lit(False)) for i, n in names if i in own], stopped))
            stopped = column(flag)
    cols = [(i, column(n)) for i, n in names]
    blocked = reduce(lambda a, b: a | b, [F.coalesce(~c["passed"], F.lit(False)) for _, c in cols], F.lit(False))
    risk = F.coalesce(F.greatest(*(c["score"] for _, c in cols), F.lit(0.0)), F.lit(0.0)) if cols else F.lit(0.0)
    entries = F.filter(F.array(*(F.struct(F.lit(i).alias("key"), c.alias("value")) for i, c in cols)), lambda e: e["value"].isNotNull()) if cols else F.array().cast(f"array<struct<key:string,value:{CHECK}>>")
    listed = F.concat(*(F.coalesce(c["findings"], S.none()) for _, c in cols)) if cols else S.none()
    reasons = F.flatten(F.transform(entries, lambda e: F.when(~e["value"]["passed"], F.transform(e["value"]["findings"], lambda f: F.concat(e["key"], F.lit(": "), f["type"], F.lit(" ("), f["severity"], F.lit(") - "), F.when(F.length(f["value"]) > 50, F.concat(F.substring(f["value"], 1, 50), F.lit("..."))).otherwise(f["value"])))).otherwise(F.array().cast("array<string>")))) if cols else F.array().cast("array<string>")
    clean = F.col(text)
    if hits:
        clean = F.when(F.size(column(hits)) > 0, S.redacted_by(col, column(hits), config.style)).otherwise(F.col(text))
    result = F.struct(blocked.alias("blocked"), risk.alias("risk_score"), F.map_from_entries(entries).alias("checks"), listed.alias("findings"), reasons.alias("reasons"), clean.alias("sanitized_text"), F.coalesce(critical(listed), F.lit(False)).alias("has_critical"))
    return df.select(*given, result.alias(out))


def verdict(df: DataFrame, text: str = "text", direction: str = "input", config: Config | None = None, checks: list[str] | None = None) -> DataFrame:
    """Adds blocked, risk_score and checks_run (names, sorted) without collecting findings: what a gate over a whole corpus needs.

    Patterns are only tested, never listed, so the plan is one projection. Columns of these names are replaced.
    """
    config = config or Config()
    col = F.coalesce(F.col(text), F.lit(""))
    plan, stopped, ran, grave, given = planned(config, direction, checks), F.lit(False), {}, {}, others(df, "blocked", "risk_score", "checks_run")
    for tier in TIERS:
        own = [i for i, t in plan if t == tier]
        for i in own:
            name, whole = unused(df, f"_v_{i}", f"_v_of_{i}")
            if i in S.registered:  # its findings say what is critical, not its score
                df = df.withColumn(whole, F.when(~stopped, scanned(i, col, config)))
                score, grave[i] = column(whole)["score"], critical(column(whole)["findings"])
            else:
                score = top_score(col, CATALOGS[i]) if i in CATALOGS else scanned(i, col, config)["score"]
                # a scanner of phrases has one finding, critical from 0.9 on; patterns' critical findings score 0.95
                grave[i] = column(name) >= 0.9
            df = df.withColumn(name, F.when(~stopped, score))
            ran[i] = column(name)
        if own and config.early_exit:
            name = unused(df, f"_v_stop_{tier}")[0]
            df = df.withColumn(name, reduce(lambda a, b: a | b, [F.coalesce(grave[i], F.lit(False)) for i in own], stopped))
            stopped = column(name)
    if not ran:
        return df.select(*given, F.lit(False).alias("blocked"), F.lit(0.0).alias("risk_score"), F.lit("").alias("checks_run"))
    blocked = reduce(lambda a, b: a | b, [F.coalesce(c >= config.threshold(i), F.lit(False)) for i, c in ran.items()])
    names = F.array_join(F.sort_array(F.filter(F.array(*(F.when(c.isNotNull(), F.lit(i)) for i, c in ran.items())), lambda x: x.isNotNull())), ",")
    return df.select(*given, blocked.alias("blocked"), F.greatest(*ran.values(), F.lit(0.0)).alias("risk_score"), names.alias("checks_run"))


def pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, input_text, output_text: each user turn with the assistant turn right after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("conv_id", "turn", "role", F.col("text").alias("input_text"), F.lead("role").over(w).alias("_role"), F.lead("text").over(w).alias("output_text"))
    return rows.filter("role = 'user' and _role = 'assistant'").select("conv_id", "turn", "input_text", "output_text")


def as_json(df: DataFrame, scan: str = "scan", out: str = "scan_json") -> DataFrame:
    """Adds a scan's struct as JSON, nulls included, for sinks of text."""
    return df.withColumn(out, F.to_json(F.col(scan), {"ignoreNullFields": "false"}))


def status(config: Config | None = None) -> list[dict]:
    """For each scanner, built in or registered: its tier, its direction, whether it is on, and its threshold."""
    config = config or Config()
    rows = [(i, t, d, config.enabled(i)) for i, t, d, _ in C.SCANNERS] + [(i, t, d, True) for i, (t, d, _) in S.registered.items()]
    return [{"scanner_id": i, "tier": t, "direction": d, "enabled": on, "threshold": config.threshold(i)} for i, t, d, on in rows]


def scan_pairs(df: DataFrame, input_text: str = "input_text", output_text: str = "output_text", config: Config | None = None) -> DataFrame:
    """Scans prompt and answer, the answer with the prompt as its context; adds both structs, blocked and block_reason."""
    df = scan(df, input_text, "input", config, out="input_scan")
    df = scan(df, output_text, "output", config, context=input_text, out="output_scan")
    blocked = F.col("input_scan.blocked") | F.col("output_scan.blocked")
    parts = F.concat(*(F.when(F.col(f"{s}_scan.blocked"), F.transform(F.col(f"{s}_scan.reasons"), lambda r: F.concat(F.lit(f"{s}: "), r))).otherwise(F.array().cast("array<string>")) for s in ("input", "output")))
    return df.select(*others(df, "blocked", "block_reason"), blocked.alias("blocked"), F.when(blocked, F.array_join(parts, "; ")).alias("block_reason"))


def test_scanner(df: DataFrame, scanner: str, text: str = "text", config: Config | None = None, context: str | None = None, judge: str | None = None, models: dict[str, Column] | None = None) -> DataFrame:
    """One scanner alone, whatever its direction: scanner, score, threshold, detected (above the threshold), findings, metadata.

    metadata is JSON of what else the scanner tells: matched phrases, toxicity's types, a judge's whole claims, or the error
    for which it couldn't run. ``hallucination`` takes ``context`` and a column of a judge's JSON. Columns of these names are
    replaced, all others stay.
    """
    config = config or Config()
    col, none = F.coalesce(F.col(text), F.lit("")), F.lit(None).cast("string")
    more = {
        "injection": lambda: S.injection(col, (models or {}).get(scanner)), "toxicity": lambda: S.toxicity(col, (models or {}).get(scanner)),
        "hallucination": lambda: S.judged(F.col(context) if context else none, F.col(judge) if judge else none),
    }
    x = more[scanner]() if scanner in more else scanned(scanner, col, config)
    name = unused(df, "_x")[0]
    given, df = others(df, "scanner", "score", "threshold", "detected", "findings", "metadata"), df.withColumn(name, x)
    r = column(name)
    told = [f for f in df.schema[name].dataType.names if f not in ("score", "findings")]
    metadata = F.to_json(F.struct(*(r[f].alias(f) for f in told))) if told else F.lit("{}")
    return df.select(*given, F.lit(scanner).alias("scanner"), r["score"].alias("score"), F.lit(config.threshold(scanner)).alias("threshold"), (r["score"] > config.threshold(scanner)).alias("detected"), r["findings"].alias("findings"), metadata.alias("metadata"))


def findings_table(df: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = ("pii", "code_injection", "secrets"), style: str = "full") -> DataFrame:
    """A row for each finding: key, scanner, and the finding's fields."""
    col = F.coalesce(F.col(text), F.lit(""))
    one = lambda k: let(found(col, CATALOGS[k]), lambda h: findings_of(k, h, style))
    rows = F.concat(*(F.transform(one(k), lambda f: F.struct(F.lit(k).alias("scanner"), f.alias("f"))) for k in kinds))
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.scanner", "x.f.*")


def findings_by_type(df: DataFrame, key: str, text: str = "text", kind: str = "pii") -> DataFrame:
    """type, severity, category, n, n_docs: how many findings of each type, and in how many rows, whose ``key`` is their own.

    Counts what :func:`findings_table` lists, with no spans made and one shuffle of a row for each type and task.
    """
    rows = CATALOGS[kind]
    heads = F.array(*(F.struct(F.lit(i).alias("type"), F.lit(s).alias("severity"), F.lit(i if kind == "pii" else c).alias("category")) for i, _, s, c in rows))
    n = F.filter(F.transform(counts(F.col(text), rows), lambda n, i: F.struct(F.get(heads, i).alias("h"), n.alias("n"))), lambda x: x["n"] > 0)
    return df.select(key, F.explode(n).alias("x")).groupBy("x.h.type", "x.h.severity", "x.h.category").agg(F.sum("x.n").alias("n"), F.count("*").alias("n_docs"))


def verdict_both(df: DataFrame, direction: str, text: str = "text", config: Config | None = None) -> DataFrame:
    """As :func:`verdict` for a table of inputs and outputs, told apart by a column that says input or output.

    Rows of another direction, or none, aren't scanned: they have nulls.
    """
    sides = [verdict(df.filter(F.col(direction) == d), text, d, config) for d in ("input", "output")]
    rest = df.filter(~F.coalesce(F.col(direction).isin("input", "output"), F.lit(False)))
    return sides[0].unionByName(sides[1]).unionByName(rest.withColumns({"blocked": F.lit(None).cast("boolean"), "risk_score": F.lit(None).cast("double"), "checks_run": F.lit(None).cast("string")}))
