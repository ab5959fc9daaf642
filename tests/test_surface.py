import io
import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward import log
from textward.functions import sql
from textward.operators import artifacts, scanners
from textward.plans import config, guard
from textward.sources import catalogs as C


def test_sql_scores_have_no_python(spark):
    sql.register(spark)
    plan = spark.sql("SELECT pii_score(string(id)) FROM range(3)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    got = spark.sql("SELECT pii_score('123-45-6789'), code_score('; rm x'), secrets_score('nothing'), pii_score(''), pii_score(NULL)").first()
    assert tuple(got) == (0.95, 0.95, 0.0, 0.0, 0.0)


def test_table_function_takes_null_and_empty(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a@b.org")], "id long, text string")
    got = spark.sql("SELECT id, type, start, end FROM {rows}, LATERAL scan_findings(text)", rows=rows).collect()
    assert [tuple(r) for r in got] == [(3, "email", 0, 7)]


def test_patterns_of_ones_own(spark):
    scanners.register_patterns("tickets", [("ticket", r"\bTICKET-\d+\b", "high", "ids"), ("broken", "(", "high", "ids")])
    try:
        rows = spark.createDataFrame([("see TICKET-17",), ("none",), (None,)], "text string")
        got = [r["scan"] for r in guard.as_json(guard.scan(rows)).collect()]
        assert [g.checks["tickets"].score for g in got] == [0.7, 0.0, 0.0]
        assert [(f.type, f.value, f.start, f.end) for f in got[0].checks["tickets"].findings] == [("ticket", "TICKET-17", 4, 13)]
        assert {"scanner_id": "tickets", "tier": "fast", "direction": "both", "enabled": True, "threshold": C.DEFAULT_THRESHOLD} in guard.status()
        back = json.loads(guard.as_json(guard.scan(rows)).first()["scan_json"])
        assert back["blocked"] is True and back["checks"]["tickets"]["passed"] is False and back["sanitized_text"] == "see TICKET-17"
    finally:
        scanners.registered.pop("tickets")


def test_template(tmp_path):
    config.save_template(str(tmp_path / "c.json"))
    c = config.from_file(str(tmp_path / "c.json"))
    assert all(c.threshold(i) == config.Config().threshold(i) and c.scanners[i] for i in config.IDS)


def test_artifacts(tmp_path, spark):
    calls = []

    def fetch(name, folder):
        calls.append(name)
        (folder / "w.bin").write_bytes(b"x" * 1000)

    artifacts.register("toy", ("w.bin",), fetch)
    artifacts.register("torn", ("a", "b"), lambda name, folder: (folder / "a").write_bytes(b""))
    try:
        with pytest.raises(FileNotFoundError):
            artifacts.available("toy", tmp_path, auto=False)
        at = artifacts.available("toy", tmp_path)
        assert artifacts.download("toy", tmp_path) == at and calls == ["toy"]
        artifacts.download("toy", tmp_path, force=True)
        assert calls == ["toy", "toy"] and artifacts.cached(tmp_path)["toy"]["mb"] == 0.001
        with pytest.raises(FileNotFoundError):
            artifacts.download("torn", tmp_path)
        assert sorted(p.name for p in tmp_path.iterdir()) == ["toy"]
        with pytest.raises(ValueError):
            artifacts.model_path("unknown", tmp_path)
        place = artifacts.ship(spark, "toy", tmp_path)
        size = F.udf(lambda _: len(open(place("w.bin"), "rb").read()), "int")
        assert spark.range(1).select(size("id")).first()[0] == 1000
        assert artifacts.clear(cache=tmp_path) == ["toy"] and not artifacts.cached(tmp_path)
    finally:
        artifacts.registry.clear()
    assert artifacts.cache_dir({"TEXTWARD_CACHE_DIR": "/x"}).as_posix() == "/x"


def test_onnx_feeds_only_what_the_model_names(monkeypatch, tmp_path):
    import onnxruntime
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "t.json"))

    class Named:
        def __init__(self, name):
            self.name = name

    class Session:
        def __init__(self, *a, **k):
            pass

        def get_inputs(self):
            return [Named("input_ids"), Named("attention_mask")]

        def get_outputs(self):
            return [Named("hidden"), Named("logits")]

        def run(self, outputs, feed):
            assert set(feed) == {"input_ids", "attention_mask"} and feed["input_ids"].shape[1] <= 3
            n = feed["attention_mask"].sum(1)
            return [None, np.stack([n, -n], 1)]

    monkeypatch.setattr(onnxruntime, "InferenceSession", Session)
    run = artifacts.onnx(lambda: "m", lambda: str(tmp_path / "t.json"), max_tokens=3)()
    assert run(["a b a b a", "a", ""])[:, 0].tolist() == [3, 1, 0]


def test_logging():
    made = log.configure("info")
    try:
        assert log.configure(env={"TEXTWARD_LOG_LEVEL": "error"}) is made and len(made.handlers) == 1 and made.level == logging.ERROR
        out = io.StringIO()
        made.handlers[0].setStream(out)
        log.logger("x").error("odd", extra={"fields": {"rows": 3}})
        line = json.loads(out.getvalue())
        assert (line["logger"], line["level"], line["message"], line["rows"]) == ("textward.x", "error", "odd", 3)
        with pytest.raises(ValueError):
            log.configure("loud")
    finally:
        made.handlers.clear()
        made.propagate = True
