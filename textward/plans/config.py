"""Configuration: from code, JSON, environment or a table of tenants; sensitivity presets and own thresholds."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.sources.catalogs import DEFAULT_THRESHOLD, SCANNERS, THRESHOLDS

IDS = [s[0] for s in SCANNERS]
#: A tenant's configuration; a scanner is true, false or an object with enabled and threshold, so its text is kept.
SCHEMA = "mode string, sensitivity string, scanners map<string,string>, thresholds map<string,double>, pii struct<redaction:boolean,style:string,redaction_style:string>, early_exit boolean"
KEYS = {
    "": {"mode", "sensitivity", "scanners", "thresholds", "pii", "early_exit", "parallel", "has_judge", "llm", "cache_dir"},
    "scanner": {"enabled", "threshold"},
    "pii": {"redaction", "style", "redaction_style"},
    "llm": {"provider", "model", "api_key", "base_url", "timeout"},
}
#: What holds where a judge's settings aren't told.
LLM = {"provider": "openai", "model": "gpt-4o-mini", "base_url": "https://api.openai.com/v1", "timeout": 30}


@dataclass(frozen=True)
class Config:
    mode: str = "local"
    sensitivity: str = "balanced"
    scanners: dict[str, bool] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    redaction: bool = True
    style: str = "full"
    early_exit: bool = True
    has_judge: bool = False
    #: For a judge's client: provider, model, base_url, timeout. A key is never kept, only that there is one (has_judge).
    llm: dict = field(default_factory=lambda: dict(LLM))
    #: Where model files are; null: as :func:`textward.operators.artifacts.cache_dir` says.
    cache_dir: str | None = None

    def __post_init__(self):
        if not 1 <= self.llm["timeout"] <= 120:
            raise ValueError("a judge's timeout is 1 to 120 seconds")
        for value, known in ((self.mode, ("local", "full")), (self.sensitivity, tuple(THRESHOLDS)), (self.style, ("full", "partial", "hash"))):
            if value not in known:
                raise ValueError(f"{value!r} is none of {known}")

    def enabled(self, scanner: str) -> bool:
        """Unknown scanners are off; the judge needs the full mode and somebody to ask."""
        if scanner == "hallucination" and not (self.mode == "full" and self.has_judge):
            return False
        return scanner in IDS and self.scanners.get(scanner, True)

    def threshold(self, scanner: str) -> float:
        own = self.thresholds.get(scanner)
        return THRESHOLDS[self.sensitivity].get(scanner, DEFAULT_THRESHOLD) if own is None else own

    def to_dict(self) -> dict:
        d = asdict(self)
        return d | {"pii": {"redaction": d.pop("redaction"), "style": d.pop("style")}}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json(), encoding="utf-8")


def default() -> dict:
    """What holds where nothing is set, with every scanner and threshold named."""
    c = Config()
    return replace(c, scanners=dict.fromkeys(IDS, True), thresholds={i: c.threshold(i) for i in IDS}).to_dict()


def save_template(path: str) -> None:
    """A configuration file to start from."""
    Path(path).write_text(json.dumps(default(), indent=2), encoding="utf-8")


def known(given: dict, what: str = "") -> dict:
    if not isinstance(given, dict):
        raise ValueError(f"{what or 'the configuration'} must be an object, not {given!r}")
    if odd := set(given) - KEYS[what]:
        raise ValueError(f"unknown in {what or 'the configuration'}: {sorted(odd)}")
    return given


def from_dict(data: dict, strict_compat: bool = False) -> Config:
    """A configuration of this shape or of the nested one: ``{"scanners": {"pii": {"enabled": false, "threshold": 0.3}}}``.

    A scanner is a boolean or an object of enabled and threshold; a threshold in ``thresholds`` goes before one there. pii
    has redaction and style (or redaction_style). ``parallel`` is taken and has no meaning here. Nulls are as if they
    weren't there. What isn't known is an error, so nothing is switched by a slip. ``strict_compat`` ignores thresholds in
    files and dicts, as an older implementation did.
    """
    data = {k: v for k, v in known(data).items() if v is not None}
    pii, llm = known(data.get("pii", {}), "pii"), known(data.get("llm", {}), "llm")
    on, limits = {}, {}
    if odd := {*data.get("scanners", {}), *data.get("thresholds", {})} - {*IDS}:
        raise ValueError(f"unknown scanners: {sorted(odd)}")
    for i, own in data.get("scanners", {}).items():
        if isinstance(own, dict):
            known(own, "scanner")
            if own.get("threshold") is not None:
                limits[i] = own["threshold"]
            own = own.get("enabled")
        if own is not None:
            if not isinstance(own, bool):
                raise ValueError(f"scanner {i} must be true, false or an object, not {own!r}")
            on[i] = own
    limits |= {k: v for k, v in data.get("thresholds", {}).items() if v is not None}
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1 for v in limits.values()):
        raise ValueError(f"thresholds are numbers from 0 to 1: {limits}")
    style = pii.get("style") or pii.get("redaction_style") or "full"
    redaction = True if pii.get("redaction") is None else pii["redaction"]
    for name, value in (("early_exit", data.get("early_exit", True)), ("redaction", redaction)):
        if not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false, not {value!r}")
    return Config(
        **{k: data[k] for k in ("mode", "sensitivity", "early_exit", "cache_dir") if k in data}, scanners=on, thresholds={} if strict_compat else limits, redaction=redaction, style=style,
        has_judge=bool(data.get("has_judge") or llm.get("api_key")), llm=LLM | {k: v for k, v in llm.items() if v is not None and k != "api_key"},
    )


def from_file(path: str, strict_compat: bool = False) -> Config:
    return from_dict(json.loads(Path(path).read_text(encoding="utf-8")), strict_compat)


def from_env(prefix: str = "TEXTWARD_", env: dict | None = None) -> Config:
    """<prefix>MODE, SENSITIVITY, ENABLE_<SCANNER>, PII_REDACTION, PII_REDACTION_STYLE, API_KEY. "true" in any case is true, all else false."""
    env = os.environ if env is None else env
    get = lambda k: env.get(prefix + k)
    true = lambda k: get(k).lower() == "true"
    return Config(
        mode=get("MODE") or "local", sensitivity=get("SENSITIVITY") or "balanced", scanners={i: true(f"ENABLE_{i.upper()}") for i in IDS if get(f"ENABLE_{i.upper()}") is not None},
        redaction=true("PII_REDACTION") if get("PII_REDACTION") is not None else True, style=get("PII_REDACTION_STYLE") or "full", has_judge=bool(get("API_KEY")),
    )


def tenant_problem(config: Column) -> Column:
    """What is wrong with a JSON configuration, as :func:`from_dict` would say; null if nothing. A null configuration is fine."""
    c = F.from_json(config, SCHEMA)
    keys, odd = F.json_object_keys(config), lambda x, there: F.size(F.array_except(x, F.array(*map(F.lit, sorted(there))))) > 0
    inner = F.map_values(F.coalesce(c["scanners"], F.create_map().cast("map<string,string>")))
    bad = F.exists(inner, lambda v: ~v.isin("true", "false") & (F.json_object_keys(v).isNull() | odd(F.json_object_keys(v), KEYS["scanner"])))
    ids = F.concat(*(F.map_keys(F.coalesce(c[k], F.create_map().cast(f"map<string,{t}>"))) for k, t in (("scanners", "string"), ("thresholds", "double"))))
    return (
        F.when(config.isNull(), None).when(keys.isNull(), "not a JSON object").when(odd(keys, KEYS[""]), "unknown keys").when(odd(ids, IDS), "unknown scanners").when(bad, "a scanner is neither a boolean nor an object of enabled and threshold")
        .when(odd(F.json_object_keys(F.get_json_object(config, "$.pii")), KEYS["pii"]), "unknown keys in pii")
        .when(~F.coalesce(c["sensitivity"], F.lit("balanced")).isin(*THRESHOLDS), "unknown sensitivity").when(~F.coalesce(c["mode"], F.lit("local")).isin("local", "full"), "unknown mode")
    )


def tenant_threshold(config: Column, scanner: str) -> Column:
    """The threshold in a column of JSON configurations: its own, the scanner's, or its sensitivity's."""
    c = F.from_json(config, SCHEMA)
    preset = F.when(F.lit(False), F.lit(0.0))
    for s, own in THRESHOLDS.items():
        preset = preset.when(F.coalesce(c["sensitivity"], F.lit("balanced")) == s, F.lit(own.get(scanner, DEFAULT_THRESHOLD)))
    return F.coalesce(c["thresholds"][scanner], F.get_json_object(c["scanners"][scanner], "$.threshold").cast("double"), preset)


def tenant_enabled(config: Column, scanner: str) -> Column:
    """Is the scanner on in a column of JSON configurations? Where nothing is told it is."""
    own = F.from_json(config, SCHEMA)["scanners"][scanner]
    return F.coalesce(F.when(own.isin("true", "false"), own).otherwise(F.get_json_object(own, "$.enabled")) != "false", F.lit(True))


def with_tenant(df: DataFrame, tenants: DataFrame, key: str = "org_id", strict: bool = True) -> DataFrame:
    """Rows with their tenant's configuration; those without one have null and get the defaults.

    ``strict``: a configuration that isn't understood ends the job, rather than leaving its tenant to the defaults; else it
    counts as none.
    """
    config, wrong = F.col("config"), tenant_problem(F.col("config"))
    told = F.when(wrong.isNull(), config)
    if strict:
        told = told.otherwise(F.raise_error(F.concat(F.lit("configuration of "), F.col(key).cast("string"), F.lit(": "), wrong)).cast("string"))
    return df.join(tenants.select(key, told.alias("tenant_config")), key, "left")
