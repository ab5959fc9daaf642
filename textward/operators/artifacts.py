"""Model files: a registry, a cache folder, and their way to the executors. Fetching is the caller's: nothing here opens a connection."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Tokens of a text that a classifier reads.
MAX_TOKENS = 512


@dataclass(frozen=True)
class Artifact:
    """``fetch(name, folder)`` puts the files into a folder."""

    files: tuple[str, ...]
    fetch: Callable[[str, Path], None]


registry: dict[str, Artifact] = {}


def register(name: str, files: tuple[str, ...], fetch: Callable[[str, Path], None]) -> None:
    registry[name] = Artifact(tuple(files), fetch)


def cache_dir(env: dict | None = None) -> Path:
    """TEXTWARD_CACHE_DIR, else a folder of the user's."""
    told = (os.environ if env is None else env).get("TEXTWARD_CACHE_DIR")
    return Path(told) if told else Path.home() / ".cache" / "textward"


def known(name: str) -> Artifact:
    if name not in registry:
        raise ValueError(f"unknown model {name!r}; known are {sorted(registry)}")
    return registry[name]


def model_path(name: str, cache: Path | None = None) -> Path | None:
    """The model's folder if all its files are there."""
    at = (cache or cache_dir()) / name
    return at if all((at / f).is_file() for f in known(name).files) else None


def download(name: str, cache: Path | None = None, force: bool = False) -> Path:
    """Fetches a model unless it is there. It is moved into place whole, so a broken attempt leaves nothing that looks complete."""
    have = model_path(name, cache)
    if have and not force:
        return have
    at = (cache or cache_dir()) / name
    part = at.with_name(f"{name}.part-{os.getpid()}")
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir(parents=True)
    try:
        known(name).fetch(name, part)
        missing = [f for f in known(name).files if not (part / f).is_file()]
        if missing:
            raise FileNotFoundError(f"{name}: {missing} were not fetched")
        shutil.rmtree(at, ignore_errors=True)
        part.rename(at)
    finally:
        shutil.rmtree(part, ignore_errors=True)
    return at


def available(name: str, cache: Path | None = None, auto: bool = True) -> Path:
    """The model's folder, fetched if need be and ``auto`` allows."""
    have = model_path(name, cache)
    if have:
        return have
    if not auto:
        raise FileNotFoundError(f"model {name!r} is not in {cache or cache_dir()}")
    return download(name, cache)


def cached(cache: Path | None = None) -> dict[str, dict]:
    """What is complete in the cache: folder and MB."""
    found = {n: model_path(n, cache) for n in sorted(registry)}
    return {n: {"path": str(p), "mb": sum(f.stat().st_size for f in p.rglob("*") if f.is_file()) / 1e6} for n, p in found.items() if p}


def clear(name: str | None = None, cache: Path | None = None) -> list[str]:
    """Removes one registered model, or all, from the cache; returns their names. Other files are left alone."""
    gone = [n for n in ([name] if name else sorted(registry)) if known(n) and ((cache or cache_dir()) / n).is_dir()]
    for n in gone:
        shutil.rmtree((cache or cache_dir()) / n)
    return gone


def ship(spark: SparkSession, name: str, cache: Path | None = None) -> Callable[[str], str]:
    """Sends the model's files to the executors; returns what gives a file's place there, to be called in a worker."""
    at = available(name, cache)
    spark.sparkContext.addFile(str(at), recursive=True)
    return lambda file: SparkFiles.get(f"{name}/{file}")


def onnx(model: Callable[[], str], tokenizer: Callable[[], str], gpu: bool = False, max_tokens: int = MAX_TOKENS):
    """A loader for :mod:`textward.operators.models`: an ONNX text classifier of a tokenizers file, as texts to logits.

    Texts are cut to ``max_tokens`` and padded to the longest of their batch; only the inputs that the model names are fed.
    """

    def load():
        import onnxruntime
        from tokenizers import Tokenizer

        from textward.operators.models import logits_of

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # a task has one core
        session = onnxruntime.InferenceSession(model(), options, providers=["CUDAExecutionProvider"] * gpu + ["CPUExecutionProvider"])
        tok = Tokenizer.from_file(tokenizer())
        tok.enable_truncation(max_tokens)
        tok.enable_padding()
        wanted, outputs = [i.name for i in session.get_inputs()], [o.name for o in session.get_outputs()]

        def run(texts: list[str]) -> np.ndarray:
            got = tok.encode_batch(texts)
            every = {"input_ids": [e.ids for e in got], "attention_mask": [e.attention_mask for e in got], "token_type_ids": [e.type_ids for e in got]}
            return logits_of(dict(zip(outputs, session.run(outputs, {k: np.array(v, np.int64) for k, v in every.items() if k in wanted}), strict=True)))

        return run

    return load
