"""Hashed text features for the linear models, and the bounded sample they are fitted on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.session import ship_package

BITS = 18
SIZE = 1 << BITS
#: Labelled documents that a model is fitted on at most: those with the smallest hashes of doc_id.
SAMPLE_ROWS = 8_000
#: Words whose features a worker remembers.
CACHE_WORDS = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) & (SIZE - 1)


class Remembered(dict):
    """word -> what ``make`` gives for it; emptied when full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        made = self.make(word)
        if len(word) <= 64:
            self[word] = made
        return made


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs collapsed; other characters as they are."""
    kinds = ["0" if c.isdigit() else ("A" if c.isupper() else "a") if c.isalpha() else c for c in word[:40]]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1] or k not in "aA0")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def prefixes(word: str) -> tuple[str, ...]:
    """A word and its beginnings of four to six letters, which catch stems with changing endings."""
    return (f"w:{word}", *(f"p:{word[:k]}" for k in (4, 5, 6) if len(word) > k))


def quality_features(text: str | None, buckets: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Words and their shapes by weight, and how far words and lines repeat. Sum over each kind is 1."""
    counts = Counter(text.split()) if text else Counter()
    total = sum(counts.values())
    if not total:
        return np.array([bucket("empty")], "i4"), np.ones(1, "f4")
    index, value = [], []
    for word, n in counts.items():
        for i in buckets[word]:
            index.append(i)
            value.append(n / total)
    lines = [x for x in text.split("\n") if x.strip()]
    for name, part in (("unique", len(counts) / total), ("lines", len(set(lines)) / max(1, len(lines))), ("longest", max(counts.values()) / total)):
        index.append(bucket(f"{name}:{int(10 * part)}"))
        value.append(0.3)
    index.append(bucket(f"length:{total.bit_length()}"))
    value.append(0.3)
    return np.array(index, "i4"), np.array(value, "f4")


def quality_buckets(word: str) -> tuple[int, ...]:
    return bucket(f"w:{word.lower()}"), bucket(f"s:{shape(word)}")


def sample(docs: DataFrame, labels: DataFrame, rows: int, label: Column, where: Column | None = None) -> DataFrame:
    """text and y of at most ``rows`` labelled documents, the smallest by hash of doc_id."""
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y")).where("y is not null")
    if where is not None:
        ids = ids.where(where)
    few = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(rows)  # at most `rows` pairs of numbers
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")


def collected(sampled: DataFrame, features: Callable[[str | None], tuple[np.ndarray, np.ndarray]], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a bounded sample on the driver: row starts, indices, values, y; ordered by doc_id.

    A row has at most ``SIZE`` different buckets per kind of feature, 8 bytes each; web pages have some
    hundreds, so 8,000 of them take about 20 MB."""
    ship_package(sampled.sparkSession)

    def run(texts: pd.Series) -> pd.DataFrame:
        made = [features(t) for t in texts]
        return pd.DataFrame({"i": [i.astype("i4").tobytes() for i, _ in made], "v": [v.astype("f4").tobytes() for _, v in made]})

    made = F.pandas_udf(run, "i binary, v binary").asNondeterministic()
    got = sampled.select("doc_id", "y", made("text").alias("x")).limit(limit).collect()
    got.sort(key=lambda r: (r.doc_id, r.x.i))
    index = [np.frombuffer(r.x.i, "i4") for r in got]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype("i8")
    empty = np.zeros(0)
    return (
        starts,
        np.concatenate(index) if index else empty.astype("i4"),
        np.concatenate([np.frombuffer(r.x.v, "f4") for r in got]) if got else empty.astype("f4"),
        np.array([r.y for r in got], "i8"),
    )


def dots(starts: np.ndarray, index: np.ndarray, value: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows times w."""
    if len(starts) < 2:
        return np.zeros(0)
    sums = np.concatenate([[0.0], np.cumsum(w[index] * value, dtype="f8")])
    return sums[starts[1:]] - sums[starts[:-1]]


def back(starts: np.ndarray, index: np.ndarray, value: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Sum of rows weighted by g."""
    return np.bincount(index, weights=value * np.repeat(g, np.diff(starts)), minlength=SIZE)
