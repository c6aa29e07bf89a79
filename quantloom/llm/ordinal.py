"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(threshold_j - w . x): all grades share the weights w of the hashed text and
differ in ordered thresholds only. The fit is full-batch gradient descent (Adam) on the penalised
likelihood of a bounded sample (``SAMPLE_ROWS``); scoring gives the expected grade and the tail
probability P(grade >= SELECT_GRADE), by which documents are selected.

Grades come from the labels: 0 for low quality, 1 for good but toxic, 2 for good and not toxic.

Edge cases: null and empty texts have one feature of their own; null labels are left out; of several
labels of a document the best grade counts; with no labels every grade is as likely; other columns are
not looked at; repeated documents are each scored; texts of any length are scored whole; empty tables
give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import hashed_text as ht
from quantloom.session import ship_package

GRADES = 3
#: The grade that a selected document reaches with at least this probability.
SELECT_GRADE, SELECT_PROBABILITY = 1, 0.5
STEPS, RATE, RIDGE = 150, 0.25, 2e-6


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. GRADES - 1, a row per score."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def grade(quality: Column, toxic: Column) -> Column:
    return F.when(quality == 0, F.lit(0)).when(quality >= 1, F.when(toxic == 1, F.lit(1)).otherwise(F.lit(2)))


def fit_rows(starts, index, value, y, grades: int = GRADES, steps: int = STEPS) -> OrdinalModel:
    """Weights and thresholds of greatest penalised likelihood."""
    share = np.array([(y > j).sum() + 1.0 for j in range(grades - 1)]) / (len(y) + 2.0)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    params = [np.zeros(ht.SIZE), np.concatenate([first[:1], gaps])]
    if not len(y):
        return OrdinalModel(params[0], np.concatenate([first[:1], first[:1] + np.cumsum(np.exp(gaps))]))
    first_moment, second_moment = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, t = params
        theta = np.concatenate([[-np.inf], t[:1], t[:1] + np.cumsum(np.exp(t[1:])), [np.inf]])
        score = ht.dots(starts, index, value, w)
        upper, lower = _sigmoid(theta[y + 1] - score), _sigmoid(theta[y] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p / len(y), lower * (1 - lower) / p / len(y)
        g_theta = np.array([dl[y == j].sum() - du[y == j - 1].sum() for j in range(1, grades)])
        g_t = np.concatenate([[g_theta.sum()], [np.exp(t[j]) * g_theta[j:].sum() for j in range(1, grades - 1)]])
        grads = [ht.back(starts, index, value, du - dl) + RIDGE * w, g_t]
        for k, g in enumerate(grads):
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
            second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
            params[k] = params[k] - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-8)
    w, t = params
    return OrdinalModel(w, np.concatenate([t[:1], t[:1] + np.cumsum(np.exp(t[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ht.SAMPLE_ROWS) -> OrdinalModel:
    sampled = ht.sample(docs, labels, rows, grade(F.col("quality"), F.col("toxic")))
    buckets = ht.Remembered(ht.quality_buckets)
    return fit_rows(*ht.collected(sampled, lambda text: ht.quality_features(text, buckets), 2 * rows))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, expected_grade, p_at_least_1, p_at_least_2 and selected."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(OrdinalModel(model.weights.astype("f4"), model.thresholds))
    buckets = ht.Remembered(ht.quality_buckets)

    def run(texts: pd.Series) -> pd.DataFrame:
        m, scores = shared.value, []
        for text in texts:
            index, value = ht.quality_features(text, buckets)
            scores.append(float((m.weights[index] * value).sum(dtype="f8")))
        tails = m.tails(np.array(scores))
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), **{f"p_at_least_{j + 1}": tails[:, j] for j in range(tails.shape[1])}})

    fields = ", ".join(["expected_grade double", *(f"p_at_least_{j} double" for j in range(1, GRADES))])
    made = F.pandas_udf(run, fields).asNondeterministic()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), made(F.col("text").cast("string")).alias("made")).select("doc_id", "made.*")
    return out.withColumn("selected", F.col(f"p_at_least_{SELECT_GRADE}") >= SELECT_PROBABILITY)
