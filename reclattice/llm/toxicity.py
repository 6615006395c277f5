"""Toxicity classifier regularised by counterfactuals.

A logistic regression over words and word beginnings. Labelled texts that name a group are also
read with each other name of the same kind in its place; the fit penalises the squared change of
the score, so that naming a group in itself moves nothing. Corpus-wide work (features, counts,
scores) runs in Spark; the fit sees the selected features of a bounded sample.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclattice.llm.common import TEXTS, add_columns, written

# Names of groups, by kind. A name is swapped with the others of its line.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("mother", "father"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender"),
    ("disabled", "blind", "deaf", "autistic"),
    ("immigrant", "refugee", "foreigner", "migrant"), ("immigrants", "refugees", "foreigners", "migrants"),
    ("frau", "mann"), ("frauen", "männer"), ("christen", "muslime", "juden"),
    ("femme", "homme"), ("femmes", "hommes"), ("chrétiens", "musulmans", "juifs"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("cristianos", "musulmanes", "judíos"),
)
NAMES = frozenset(name for kind in IDENTITY for name in kind)
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
MEMO_ENTRIES = 100_000


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the sample that the fit reads (in expectation, drawn by a hash of the id),
    ``features`` the selected features, ``evidence`` their least G statistic; ``ridge`` and
    ``swap`` weigh the two penalties, ``threshold`` is where a score becomes a label."""

    rows: int = 16_000
    features: int = 20_000
    evidence: float = 20.0
    ridge: float = 5e-6
    swap: float = 1.0
    steps: int = 1000
    threshold: float = 0.3


def number(feature: str) -> int:
    return zlib.crc32(feature.encode())


def features_of(word: str) -> tuple[int, ...]:
    """The word and, unless it names a group, its beginnings."""
    if word in NAMES:
        return (number(word),)
    return (number(word), *(number(word[:n] + "*") for n in BEGINNINGS if len(word) > n))


@dataclass
class Model:
    weights: dict[int, float]
    bias: float
    settings: Settings
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def logit(self, text: str | None) -> float:
        """Bias plus the weight of every distinct feature of the text."""
        memo, weights = self.memo, self.weights
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        found: set[int] = set()
        for word in set(WORD.findall((text or "").lower())):
            known = memo.get(word)
            if known is None:
                known = tuple(f for f in features_of(word) if f in weights)
                if len(word) <= 64:
                    memo[word] = known
            if known:
                found.update(known)
        return self.bias + math.fsum(weights[f] for f in found)

    def score(self, text: str | None) -> float:
        z = self.logit(text)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _sample(learn: DataFrame, rows: int) -> DataFrame:
    """All rows, or about ``rows`` of them chosen by a hash of the id."""
    total = learn.count()
    if total <= rows:
        return learn
    return learn.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * rows / total))


def _text_features():
    memo: dict[str, np.ndarray] = {}

    def one(text: str) -> np.ndarray:
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        parts = []
        for word in set(WORD.findall(text.lower())):
            known = memo.get(word)
            if known is None:
                known = memo[word] = np.array(features_of(word), np.int64)
            parts.append(known)
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

    def step(texts):
        values = texts.to_pylist()
        return [
            pa.array([one(t or "") for t in values], pa.list_(pa.int64())),
            pa.array([sorted(NAMES.intersection(WORD.findall((t or "").lower()))) for t in values], pa.list_(pa.string())),
        ]

    return step


def fit(texts: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``texts`` (doc_id, text, toxic). Rows with a null label or id are left out; null
    texts count as empty. Without rows of both classes every score is the share of label 1."""
    spark = texts.sparkSession
    learn = texts.filter("toxic is not null and doc_id is not null").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    seen = written(
        add_columns(_sample(learn, settings.rows), ["text"], "features array<bigint>, names array<string>", _text_features)
        .select("toxic", "features", "names"),
        "toxicity-sample",
    )
    total, positive = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if positive in (0, total):
        share = positive / total if total else 0.0
        return Model({}, 20.0 * (2 * share - 1) if total else -20.0, settings)
    counts = (
        seen.select("toxic", F.explode("features").alias("f"))
        .groupBy("f")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
        .filter("n >= 3")
    )
    share = positive / total

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    evidence = 2 * (
        part(k, n * share) + part(n - k, n * (1 - share))
        + part(positive - k, (total - n) * share) + part((total - n) - (positive - k), (total - n) * (1 - share))
    )
    chosen = counts.select("f", evidence.alias("g")).filter(F.col("g") >= settings.evidence)
    names = {number(name) for name in NAMES}
    top = {r["f"] for r in chosen.orderBy(F.desc("g"), "f").limit(settings.features).collect()}
    index = {f: i for i, f in enumerate(sorted(top | names))}
    sent = spark.sparkContext.broadcast(index)

    def keep():
        known = sent.value

        def step(lists):
            return [pa.array([[known[f] for f in x if f in known] for x in lists.to_pylist()], pa.list_(pa.int32()))]

        return step

    # Bounded by rows x features selected, both parameters.
    data = add_columns(seen, ["features"], "columns array<int>", keep).select("toxic", "columns", "names").toArrow()
    columns = data["columns"].combine_chunks()
    lengths = columns.value_lengths().to_numpy(zero_copy_only=False)
    flat = columns.flatten().to_numpy(zero_copy_only=False)
    swaps = _swaps(data["names"].to_pylist(), index)
    weights, bias = _descend(flat, lengths, data["toxic"].to_numpy().astype(float), swaps, len(index), settings)
    return Model({f: float(weights[i]) for f, i in index.items() if weights[i]}, float(bias), settings)


def _swaps(names: list[list[str]], index: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column out, column in, how often) of every exchange of a name in the labelled texts."""
    often: dict[tuple[int, int], int] = {}
    kinds = {name: kind for kind in IDENTITY for name in kind}
    for row in names:
        for name in row:
            for other in kinds[name]:
                if other not in row:
                    pair = (index[number(name)], index[number(other)])
                    often[pair] = often.get(pair, 0) + 1
    pairs = np.array(sorted(often), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1], np.array([often[tuple(p)] for p in pairs], float)


def _descend(flat, lengths, y, swaps, width, settings: Settings):
    """Accelerated gradient descent on mean log loss + ridge + mean squared score change."""
    rows = np.repeat(np.arange(len(y)), lengths)
    out, into, often = swaps
    weights, bias = np.zeros(width), math.log(y.mean() / (1 - y.mean()))
    # Per-column step sizes from the curvature bound of the log loss.
    uses = np.bincount(flat, minlength=width) / len(y)
    scale = 1.0 / (0.25 * np.maximum(uses, 1 / len(y)) * 8 + settings.ridge)
    if len(often):
        touch = np.bincount(np.r_[out, into], np.r_[often, often], minlength=width) / len(y)
        scale = 1.0 / (1.0 / scale + 4 * settings.swap * touch)
    ahead, previous, momentum = weights.copy(), weights.copy(), 1.0
    for _ in range(settings.steps):
        z = bias + np.bincount(rows, ahead[flat], minlength=len(y))
        error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        gradient = np.bincount(flat, error[rows], minlength=width) / len(y) + settings.ridge * ahead
        if len(often):
            change = settings.swap * 2 * often * (ahead[into] - ahead[out]) / len(y)
            gradient += np.bincount(into, change, minlength=width) - np.bincount(out, change, minlength=width)
        weights = ahead - scale * gradient
        bias -= error.mean()
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        if gradient @ (weights - previous) > 0:
            after = momentum = 1.0
        ahead = weights + (momentum - 1) / after * (weights - previous)
        previous, momentum = weights, after
    return weights, bias


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (score >= threshold) of every whole text.

    Null and empty texts get the score of the bias alone. No shuffle; rows are independent.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = replace(sent.value, memo={})  # goes with the task

        def step(texts):
            scores = [own.score(t) for t in texts.to_pylist()]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= own.settings.threshold) for s in scores], pa.int32())]

        return step

    return add_columns(df, [text], "score double, predicted int", make, TEXTS)


def labelled(documents: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """(doc_id, text, toxic) of the documents that ``learn`` admits; a repeated label counts once,
    1 winning over 0."""
    once = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return documents.select("doc_id", "text").filter(learn).join(once, "doc_id")


def reject(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without the rows whose text the model labels toxic; columns are untouched."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = replace(sent.value, memo={})  # goes with the task
        return lambda texts: [pa.array([own.score(t) >= own.settings.threshold for t in texts.to_pylist()], pa.bool_())]

    return add_columns(df, [text], "__toxic boolean", make, TEXTS).filter("not __toxic").drop("__toxic")
