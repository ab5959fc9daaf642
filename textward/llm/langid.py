"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of an n-gram, and the values they are hashed to.
SIZES = (1, 2, 3)
DIM = 1 << 15
#: The fit takes so many labelled documents at most for each language, chosen by hash, with their whole texts; and of all
#: languages together.
SAMPLE, TOTAL = 1500, 100_000
#: Texts of more code points reach the driver as counts of their n-grams, which DIM bounds.
LONG = 20_000
UND = "und"
#: So many languages are learned at most: the weights are two numbers for each n-gram and language.
LANGS = 100


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams of lower-cased code points."""
    c = codes.astype(np.uint32)
    out = []
    for n in SIZES:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(DIM - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def folded(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different hashed n-grams of a text, and how often each occurs."""
    n = np.bincount(grams(folded(text)), minlength=DIM)
    at = np.flatnonzero(n)
    return at, n[at]


def weights(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / (np.sqrt((x * x).sum()) or 1)


def learnable(docs: DataFrame) -> DataFrame:
    """text, lang: of documents that may be learned from."""
    return docs.filter("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the documents each hashed n-gram occurs, over all of them; a row for each task comes back."""

    def count(batches):
        common.only("languages")
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[counts(text)[0]] += 1
                n += 1
        yield pa.RecordBatch.from_pydict({"k": pa.array([*range(DIM), DIM], pa.int32()), "n": pa.array([*total.tolist(), n], pa.int64())})

    rows = docs.select("text").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for k, n in rows:
        out[k] = n
    return out[:DIM], int(out[DIM])


class Model:
    """Classes, a weight for each n-gram and class, and the temperature."""

    def __init__(self, classes, idf, w, temperature):
        self.classes, self.idf, self.w, self.temperature = classes, idf, w, temperature

    def scores(self, text: str) -> np.ndarray:
        at, n = counts(text)
        return weights(at, n, self.idf) @ self.w[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not any(map(str.isalpha, text)):
            return UND, 0.0
        z = self.scores(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.classes[k], float(p[k] / p.sum())


def fit(rows: list[tuple[tuple[np.ndarray, np.ndarray], str]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, epochs: int = 3, seed: int = 1) -> Model:
    """FTRL-proximal with an elastic net on (:func:`counts`, language); a fifth of the rows sets the temperature."""
    classes = sorted({lang for _, lang in rows})
    if not classes:
        return Model([], idf, np.zeros((DIM, 0)), 1.0)
    y = np.array([classes.index(lang) for _, lang in rows])
    x = lambda i: (rows[i][0][0], weights(*rows[i][0], idf))  # noqa: E731 - made anew, since all weights together are large
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    hold, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    k = len(classes)
    z, q = np.zeros((DIM, k)), np.zeros((DIM, k))

    def current(at):
        zz = z[at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - l1, 0) / ((beta + np.sqrt(q[at])) / alpha + l2)

    for _ in range(epochs):
        for i in rng.permutation(train):
            at, v = x(i)
            w = current(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p[None, :]
            qq = q[at]
            sigma = (np.sqrt(qq + g * g) - np.sqrt(qq)) / alpha
            z[at] += g - sigma * w
            q[at] = qq + g * g
    w = current(np.arange(DIM))
    # the temperature that makes the held rows likeliest
    s, best = np.array([v @ w[at] for at, v in map(x, hold)]).reshape(len(hold), k), (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.02), np.log(5), 60)) if len(hold) else []:
        u = s / t
        u = u - u.max(1, keepdims=True)
        loss = (np.log(np.exp(u).sum(1)) - u[np.arange(len(hold)), y[hold]]).mean()
        best = min(best, (loss, float(t)))
    return Model(classes, idf, w, best[1])


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, held_out: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id is never held out."""
    rows = common.columns(docs, doc_id="long", text="string", lang="string")
    return rows.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on learnable documents: document frequencies over all, weights on ``sample`` of each language at most.

    The LANGS most frequent languages are learned, ties by name; texts in others are predicted as what they are likest to.
    """
    known = learnable(docs)
    df, n = document_frequencies(known)
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)
    # how many there are of each language gives a share by hash, so that what reaches the driver is bounded
    sizes = common.materialize(known.groupBy("lang").agg(F.count("*").alias("m")).orderBy(F.desc("m"), "lang").limit(LANGS), "languages")
    share = F.least(F.lit(1.0), F.lit(float(min(sample, TOTAL // max(1, sizes.count())))) / F.col("m"))
    sizes = sizes.select("lang", (F.floor(share * (1 << 20)) + 1).alias("below"))
    taken = known.join(common.few(sizes, 100_000), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("below"))

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = counts(text) if len(text) > LONG else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text if at is None else None], pa.string()), pa.array([None if at is None else at.astype("<i4").tobytes()], pa.binary()), pa.array([None if at is None else n.astype("<i8").tobytes()], pa.binary())], names=["lang", "text", "at", "n"])

    rows = []
    told = taken.select("lang", "text").mapInArrow(count, "lang string, text string, at binary, n binary").collect()
    while told:
        r = told.pop()
        at, n = counts(r["text"]) if r["at"] is None else (np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i8"))
        rows.append(((r["lang"], len(at), int(n.sum())), (at.astype("<u2"), n.astype("<u4"))))
    rows.sort(key=lambda x: x[0])
    # a fixed order: rows alike in these by their n-grams, too
    ordered = [x for _, own in itertools.groupby(rows, key=lambda x: x[0]) for x in sorted(own, key=lambda x: (x[1][0].tobytes(), x[1][1].tobytes()))]
    rows.clear()
    model = fit([(got, key[0]) for key, got in ordered], idf)
    ordered.clear()
    common.tidy()
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and non-null lang of documents that aren't held out; a prediction is made from the whole text alone.
    Texts that are null or without a letter are "und" with score 0, as are all if nothing can be learned. Rows with one
    doc_id are each predicted from their own text. Other columns are ignored; an empty table gives no rows.
    """
    rows = split(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(rows))

    def run(batches):
        common.only("languages")
        m = shared.value
        for batch in batches:
            out = [m.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, min_score: float = 0.35, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known: not "und", and as likely as ``min_score`` at least.

    If nothing can be learned from ``docs`` every text with a letter is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(split(docs)))
    at = [c.lower() for c in docs.columns].index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with a dot don't pass

    def run(batches):
        common.only("languages")
        m = shared.value
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                if m.classes:
                    lang, score = m.predict(text)
                    good.append(lang != UND and score >= min_score)
                else:
                    good.append(text is not None and any(map(str.isalpha, text)))
            yield batch.filter(pa.array(good, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
