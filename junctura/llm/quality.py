"""Quality by Bradley-Terry ranking.

Each text gets a score w.x of features x of its whole text: shares of its bytes and a few measures of
repetition and form. Preference pairs are a labelled-good and a labelled-bad text; the chance that the
good one is preferred is the logistic function of the score difference, and w minimises the logistic
loss on the pairs' feature differences (Newton steps, with a ridge). The cut is the quantile of the
training scores that leaves below it the share of texts labelled bad; the score given out is the logistic
function of the distance to the cut, so 0.5 is the cut.

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled rows with the least hash of their
id, of which features (not texts) reach the driver, and ``PAIRS`` pairs for each text labelled bad.

Defined cases: a null text is an empty one, and is scored as every text; equal texts have equal scores;
ids labelled more than once count by their first label in order; null ids or labels aren't learned from;
without both kinds of label every score is 0.5; an empty table gives an empty one; of further columns
none is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
PAIRS = 40
RIDGE = 1e-3
STEPS = 12
_KEPT_BYTES = np.array([0x0A, *range(0x20, 0x7F)])


def features(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(len(raw), 1)
    count = np.bincount(raw, minlength=256)
    words = text.split()
    n_words = max(len(words), 1)
    kinds = len(set(words))
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words, words[1:]))
    capitals = sum(map(str.isupper, words))
    marks = count[[ord(x) for x in "#$%&*|!<>{}[]=_^~@\\/+"]].sum()
    own = [
        np.log1p(len(words)),
        kinds / n_words,
        np.log(kinds + 1) / np.log(n_words + 1.0001),
        same / n_words,
        capitals / n_words,
        len(raw) / n_words / 10,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        np.log1p(n_words / max(len(lines), 1)),
        marks / n,
        float(np.sqrt(marks / n)),
        count[65:91].sum() / n,
        count[128:].sum() / n,
        1.0 if not words else 0.0,
    ]
    return np.concatenate([np.sqrt(count[_KEPT_BYTES] / n), own])


N_FEATURES = len(_KEPT_BYTES) + 13


class Ranking:
    """Weights, centre, scale and cut; a text's score is weights . (x - centre) / scale - cut."""

    def __init__(self, x: np.ndarray, good: np.ndarray) -> None:
        self.centre, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        self.weights, self.cut = np.zeros(N_FEATURES), 0.0
        if not good.any() or good.all():
            return
        z = (x - self.centre) / self.scale
        better, worse = np.flatnonzero(good), np.flatnonzero(~good)
        draw = np.random.default_rng(7)
        per_worse = max(1, min(PAIRS, 200_000 // len(worse)))
        diff = z[draw.choice(better, (len(worse), per_worse))] - z[worse][:, None, :]
        diff = diff.reshape(-1, N_FEATURES)
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(diff @ self.weights, -30, 30)))
            slope = diff.T @ (p - 1) / len(diff) + RIDGE * self.weights
            bend = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + RIDGE * np.eye(N_FEATURES)
            self.weights = self.weights - np.linalg.solve(bend, slope)
        ranked = np.sort(z @ self.weights)
        at = int(round((~good).mean() * len(ranked)))
        self.cut = float((ranked[max(at - 1, 0)] + ranked[min(at, len(ranked) - 1)]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.centre) / self.scale @ self.weights - self.cut, -30, 30)))


def training_set(df: DataFrame, labels: DataFrame, may_learn, doc_id: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).dropna().filter(may_learn(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE)
    rows = df.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(known), "label_id")  # SAMPLE rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or "").astype("<f4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["i", "x", "y"])

    kind = df.schema[doc_id].dataType.simpleString()
    found = rows.select("label_id", "text", "label").mapInArrow(run, f"i {kind}, x binary, y int")
    found = found.groupBy("i").agg(F.min(F.struct("x", "y")).alias("v")).select("i", "v.x", "v.y").toPandas().sort_values("i")
    x = np.array([np.frombuffer(b, "<f4") for b in found["x"]], float).reshape(-1, N_FEATURES)
    return x, found["y"].to_numpy() == 1


def fit(df: DataFrame, labels: DataFrame, may_learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    return Ranking(*training_set(df, labels, may_learn, doc_id, text, label))


def scorer(ranking: Ranking):
    """A Column function: the score of a text column."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = []
            for at in range(0, len(texts), 512):
                some = texts.iloc[at : at + 512]
                parts.append(ranking.score(np.array([features(t or "") for t in some])))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run


def judge(df: DataFrame, labels: DataFrame, may_learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5, else 0)."""
    score = scorer(fit(df, labels, may_learn, doc_id, text, label))
    out = df.select(F.col(doc_id).alias("doc_id"), score(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(df: DataFrame, labels: DataFrame, may_learn, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``df`` whose text reaches the cut, all columns as they were."""
    names = df.columns
    score = scorer(fit(df, labels, may_learn, doc_id, text, label))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), score(F.col(text)).alias("score"))
    return out.filter("score >= 0.5").select(*[F.col("row").getField(c).alias(c) for c in names])
