"""Model and judge scorers that a caller brings: loaded once in each worker, fed Arrow batches, failing open."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def softmax_of(logits, index: int = 1):
    """A column of one class's probability from a column of logits, in the JVM. One logit alone has probability 1."""
    most = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - most))
    return F.get(e, F.when(F.size(logits) > index, F.lit(index)).otherwise(F.lit(0))) / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)


def sigmoid_of(logits):
    """A column of the labels' probabilities from a column of logits, in the JVM."""
    return F.transform(logits, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def once(name: str, load: Callable[[], object]):
    """What ``load`` gives, kept by the worker."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def logits_of(outputs: dict) -> np.ndarray:
    """The logits among a session's outputs: by name, else the first."""
    for name in ("logits", "output", "outputs"):
        if name in outputs:
            return np.asarray(outputs[name])
    return np.asarray(next(iter(outputs.values())))


def probability(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], index: int = 1):
    """A column function: the probability of one class by a model of texts to logits. Null texts and failures give null.

    Give it null where it needn't run: a CASE doesn't keep Python from being called.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype="float64")
            live = texts.notna()
            if live.any():
                try:
                    p = softmax(np.asarray(once(name, load)(texts[live].tolist()), dtype="float64"))
                    out[live.to_numpy()] = p[:, index if p.shape[1] > 1 else 0]
                except Exception:  # a scorer that fails lets the text pass
                    pass
            yield out

    return run


def label_probabilities(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A column function: the labels' probabilities by a model of texts to logits."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype="object")
            live = texts.notna()
            if live.any():
                try:
                    p = sigmoid(np.asarray(once(name, load)(texts[live].tolist()), dtype="float64"))
                    for i, row in zip(np.flatnonzero(live.to_numpy()), p, strict=True):
                        out[int(i)] = row.tolist()
                except Exception:
                    pass
            yield out

    return run


def judge(name: str, load: Callable[[], Callable[[str], str]], tries: int = 3, wait: float = 1.0):
    """A column function: a judge's JSON for a prompt, asked again with growing pauses; null when it fails for good."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import time

        ask = once(name, load)
        for prompts in batches:
            out = []
            for p in prompts:
                got = None
                for k in range(tries if p is not None else 0):
                    try:
                        got = ask(p)
                        break
                    except Exception:
                        if k + 1 < tries:
                            time.sleep(min(10.0, wait * 2**k))
                out.append(got)
            yield pd.Series(out, dtype="object")

    return run
