"""Toxicity: a counterfactual-regularised classifier.

A logistic model over the set of words of a text (and their beginnings), with an L1 penalty that leaves
weights on telling words only, so long texts do not add up noise. For every training text that names an
identity group a counterfactual is made by putting another term for the first; the squared change of the
score is penalised, and so is that between all pairs of terms in a neutral sentence, so no term moves a
score by itself. The fit is proximal gradient descent with momentum (FISTA) on a bounded sample.

Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1; the others are held out.

Edge cases: null and empty texts score by the intercept; null labels are left out; of several labels of
a document the highest counts; without labels all score 0; other columns are never looked at; repeated
documents are each scored; texts of any length are scored whole; empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import hashed_text as ht
from quantloom.session import ship_package, written

#: Fixed word list: terms for groups of people, swapped within each row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
PREDICT_AT = 0.7
STEPS, L1, COUNTERFACTUAL = 250, 4e-4, 1.0
#: Training texts in which a feature must occur to have a weight.
LEAST_TEXTS = 5


@dataclass
class ToxicityModel:
    intercept: float
    weights: dict[int, float] = field(default_factory=dict)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(text: str | None, buckets: ht.Remembered) -> tuple[np.ndarray, np.ndarray]:
    """The set of buckets, each with value 1."""
    found = sorted({i for word in set(ht.letter_words(text)) for i in buckets[word]})
    return np.array(found, "i4"), np.ones(len(found), "f4")


def word_buckets(word: str) -> tuple[int, ...]:
    return tuple(ht.bucket(f) for f in ht.prefixes(word))


def swapped(words: set[str]) -> list[tuple[set[int], set[int]]]:
    """Buckets lost and gained by putting the next term of its row for each identity term in a text."""
    out = []
    for row in IDENTITY_TERMS:
        for k, term in enumerate(row):
            if term in words:
                other = row[(k + 1) % len(row)]
                rest = {i for w in words - {term} for i in word_buckets(w)}
                out.append((set(word_buckets(term)) - rest, set(word_buckets(other)) - rest))
    return out


def neutral_swaps() -> list[tuple[set[int], set[int]]]:
    """All neighbouring pairs of terms in a neutral sentence."""
    return [change for row in IDENTITY_TERMS for term in row for change in swapped({"they", "are", term})]


def swap_matrix(changes: list[tuple[set[int], set[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of score changes: gained minus lost buckets."""
    rows = [[*((i, 1.0) for i in gained - lost), *((i, -1.0) for i in lost - gained)] for lost, gained in changes]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype("i8")
    flat = [x for r in rows for x in r]
    return starts, np.array([i for i, _ in flat], "i4"), np.array([v for _, v in flat], "f4")


def fit_rows(starts, index, value, y, changes, steps: int = STEPS, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    if not len(y) or y.min() == y.max():
        return ToxicityModel(-30.0 if not len(y) or y.max() == 0 else 30.0)
    often = np.bincount(index, minlength=ht.SIZE) >= LEAST_TEXTS
    mask = often[index]
    starts = np.concatenate([[0], np.cumsum(mask)])[starts]
    index, value = index[mask], value[mask]
    weight = np.where(y == 1, len(y) / (2.0 * max(1, (y == 1).sum())), len(y) / (2.0 * (y == 0).sum()))
    weight /= weight.sum()
    d = swap_matrix(changes)
    n_changes = max(1, len(d[0]) - 1)
    # Curvature bound for the step: the average squared row length, and power steps for the swaps.
    v = np.random.default_rng(5).normal(size=ht.SIZE)
    for _ in range(15):
        v = ht.back(starts, index, value, weight * ht.dots(starts, index, value, v))
        v /= max(np.linalg.norm(v), 1e-12)
    top = 0.25 * float((weight * ht.dots(starts, index, value, v) ** 2).sum()) + 0.25
    top += counterfactual * 2 * float(np.max(np.diff(d[0]), initial=0)) * float(np.bincount(d[1], minlength=1).max(initial=0)) / n_changes
    w, b = np.zeros(ht.SIZE), float(np.log((y == 1).mean() / (y == 0).mean()))
    w_prev, b_prev, momentum = w, b, 1.0
    for _ in range(steps):
        following = 0.5 * (1 + (1 + 4 * momentum**2) ** 0.5)
        k = (momentum - 1) / following
        wz, bz, momentum = w + k * (w - w_prev), b + k * (b - b_prev), following
        g = weight * (0.5 * (1 + np.tanh(0.5 * (ht.dots(starts, index, value, wz) + bz))) - y)
        grad = ht.back(starts, index, value, g) + ht.back(*d, 2 * counterfactual / n_changes * ht.dots(*d, wz))
        w_prev, b_prev = w, b
        w = wz - grad / top
        w = np.sign(w) * np.maximum(np.abs(w) - L1 / top, 0)
        b = bz - float(g.sum()) / top
    kept = np.flatnonzero(w)
    return ToxicityModel(b, dict(zip(kept.tolist(), w[kept].tolist())))


def swaps(sampled: DataFrame, rows: int) -> list[tuple[set[int], set[int]]]:
    """The changes of the sample's texts that name a group. They are made where the texts are: what comes
    to the driver is bucket numbers, at most eight a term and one term list a text of a bounded sample."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[[sorted(lost), sorted(gained)] for lost, gained in swapped(set(ht.letter_words(t)))] for t in texts])

    made = F.pandas_udf(run, "array<array<array<int>>>").asNondeterministic()
    got = sampled.select("doc_id", made("text").alias("changes")).where(F.size("changes") > 0).orderBy("doc_id", "changes").limit(2 * rows).collect()
    return [(set(lost), set(gained)) for r in got for lost, gained in r.changes]


def fit(docs: DataFrame, labels: DataFrame, rows: int = ht.SAMPLE_ROWS, counterfactual: float = COUNTERFACTUAL) -> ToxicityModel:
    sampled = written(ht.sample(docs, labels, rows, F.col("toxic").cast("int"), ~held_out(F.col("doc_id"))), "sample")
    buckets = ht.Remembered(word_buckets)
    data = ht.collected(sampled, lambda text: features(text, buckets), 2 * rows)
    return fit_rows(*data, swaps(sampled, rows) + neutral_swaps(), counterfactual=counterfactual)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    telling = ht.Remembered(lambda word: tuple(i for i in word_buckets(word) if i in shared.value.weights))

    def run(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for text in texts:
            found = {i for word in set(ht.letter_words(text)) for i in telling[word]}
            out.append(m.intercept + sum(m.weights[i] for i in sorted(found)))
        return pd.Series(0.5 * (1 + np.tanh(0.5 * np.array(out, "f8"))))

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.pandas_udf(run, "double").asNondeterministic()(F.col("text").cast("string")).alias("score"))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).alias("predicted"))
