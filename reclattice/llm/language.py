"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become hashed counts of 1- to 3-grams over letters, weighted by inverse document
frequencies that Spark counts over all learning documents. Weights are learnt one document at a
time by follow-the-regularised-leader with an elastic net, then one temperature is fitted on
documents that the weights have not seen.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import add_columns
from reclattice.session import ship_package

UNKNOWN = "und"
ORDERS = (1, 2, 3)
PIECE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the documents that the fit reads (in expectation, drawn evenly over the
    languages by a hash of the id); the other values are those of the learner."""

    rows: int = 4_000
    buckets: int = 1 << 16
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    passes: int = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str, buckets: int) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, piece by piece to bound memory. Anything but
    letters reads as a space; grams of spaces alone are not counted."""
    total = np.zeros(buckets, np.float64)
    table = _letters()
    longest = max(ORDERS)
    padded = f" {text} "
    for start in range(0, len(padded), PIECE):
        # A piece repeats the last characters of the one before, so no gram is lost or doubled.
        chunk = padded[max(0, start - longest + 1):start + PIECE]
        letters = table[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        skip = start - max(0, start - longest + 1)
        for n in ORDERS:
            if len(letters) < n:
                continue
            key = np.full(len(letters) - n + 1, n, np.uint64)
            some = np.zeros(len(key), bool)
            for k in range(n):
                part = letters[k:len(letters) - n + 1 + k]
                key = key * np.uint64(0x9E3779B97F4A7C15) + part
                some |= part != 32
            key ^= key >> np.uint64(29)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            key >>= np.uint64(40)
            new = max(0, skip - n + 1)
            total += np.bincount((key[new:] % np.uint64(buckets)).astype(np.int64)[some[new:]], minlength=buckets)
    return total


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets + 1 (bias) x languages
    temperature: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """Per language; None without a letter or without anything learnt."""
        if not text or not self.languages:
            return None
        index, values = vector(grams(text, len(self.idf)), self.idf)
        if not len(index):
            return None
        return softmax((values @ self.weights[index] + self.weights[-1]) / self.temperature)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length TF-IDF vector as indexes and values; tf is 1 + log of the count."""
    index = np.flatnonzero(counts)
    values = (1 + np.log(counts[index])) * idf[index]
    norm = np.sqrt(values @ values)
    return index, values / norm if norm else values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(learn: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``learn`` (doc_id, text, lang). Null texts, languages or ids are left out; with
    one language it always wins, with none every answer is ``und``."""
    spark = learn.sparkSession
    learn = learn.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    buckets = settings.buckets
    if not languages:
        return Model([], np.zeros(buckets), np.zeros((buckets + 1, 0)), 1.0)

    def frequencies(batches):
        # One row per task and bucket at most: added up before the shuffle.
        seen, total = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += grams(text, buckets) > 0
                total += 1
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[index, -1].astype(np.int64)), pa.array(np.r_[seen[index], total].astype(np.int64))], names=["f", "n"]
        )

    ship_package(learn.sparkSession)
    add = learn.select("text").mapInArrow(frequencies, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    counted = add.toPandas()
    total = int(counted.n[counted.f == -1].sum())
    real = counted[counted.f >= 0]
    idf = np.zeros(buckets)
    idf[real.f.to_numpy()] = np.log((1 + total) / (1 + real.n.to_numpy())) + 1

    share = settings.rows / len(languages)
    limits = F.create_map(*[v for k in languages for v in (F.lit(k), F.lit(int(1_000_003 * min(1.0, share / sizes[k])) + 1))])
    order = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_003))
    sample = learn.withColumn("order", order).filter(F.col("order") < F.try_element_at(limits, F.col("lang")))
    sent = spark.sparkContext.broadcast(idf)

    def vectors():
        weights = sent.value

        def step(texts):
            found = [vector(grams(t, buckets), weights) for t in texts.to_pylist()]
            return [
                pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())),
                pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
            ]

        return step

    data = (
        add_columns(sample, ["text"], "at array<int>, tfidf array<float>", vectors)
        .select("doc_id", "lang", "order", "at", "tfidf").toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    )
    target = np.array([languages.index(x) for x in data["lang"].to_pylist()], int)
    rows = [
        (i.values.to_numpy(), v.values.to_numpy().astype(float))
        for i, v in zip(data["at"], data["tfidf"], strict=True)
    ]
    rows = [(np.append(i, buckets), np.append(v, 1.0)) for i, v in rows]
    held = np.arange(len(rows)) % 5 == 0
    weights = _follow(
        [r for r, h in zip(rows, held, strict=True) if not h], target[~held], len(languages), settings
    )
    temperature = _temperature([v @ weights[i] for (i, v), h in zip(rows, held, strict=True) if h], target[held])
    return Model(languages, idf, weights, temperature)


def _follow(rows, target, classes: int, settings: Settings) -> np.ndarray:
    """Per-coordinate follow-the-regularised-leader; l1 sets small weights to exactly 0."""
    z = np.zeros((settings.buckets + 1, classes))
    n = np.zeros_like(z)

    def current(index):
        near = z[index]
        held = np.sign(near) * settings.l1 - near
        held /= (settings.beta + np.sqrt(n[index])) / settings.alpha + settings.l2
        return np.where(np.abs(near) <= settings.l1, 0.0, held)

    for _ in range(settings.passes):
        for (index, values), label in zip(rows, target, strict=True):
            w = current(index)
            error = softmax(values @ w)
            error[label] -= 1
            g = values[:, None] * error
            grown = n[index] + g * g
            z[index] += g - (np.sqrt(grown) - np.sqrt(n[index])) / settings.alpha * w
            n[index] = grown
    return current(np.arange(settings.buckets + 1))


def _temperature(logits: list[np.ndarray], target: np.ndarray) -> float:
    """The temperature of least log loss, between 1/20 and 20."""
    if not logits:
        return 1.0

    def loss(t: float) -> float:
        return sum(-np.log(softmax(z / t)[y] + 1e-300) for z, y in zip(logits, target, strict=True))

    grid = np.geomspace(0.05, 20, 49)
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the calibrated probability of that language.

    Texts that are null or hold no letter get ``und`` and 0. Ties go to the first language in
    alphabetical order. No shuffle; rows are independent.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def step(texts):
            names, scores = [], []
            for t in texts.to_pylist():
                p = own.probabilities(t)
                best = None if p is None else int(np.argmax(p))
                names.append(UNKNOWN if best is None else own.languages[best])
                scores.append(0.0 if best is None else float(p[best]))
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return step

    return add_columns(df, [text], "lang_pred string, score double", make)
