"""Benchmark decontamination: one Aho-Corasick scan of every text over all benchmark windows.

Text and items are normalised alike (A-Z lower-cased, words of ASCII letters and digits and anything
outside ASCII). A window is ``window`` consecutive words of an item; a shorter item is one window. The
automaton holds the windows as byte strings framed by spaces, so that a match is a match of words, and
the places of the spaces map it back to words and to offsets in the original text.

The windows are collected and broadcast in shards of at most ``SHARD_CHARS`` of item text. One shard
is the rule; with more, every row is scanned by each of them, one shard after the other, and what they
find is merged by row number, which a row has once in each shard.

Edge cases: null and empty text have no words; texts of any length are scanned whole; items without words
have no window; equal windows of several items count for each; repeated documents are each judged; other
columns are not looked at; an empty benchmark finds nothing; empty tables give empty tables.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.session import by_slices, ship_package, written

WINDOW = 10
#: Characters of item text whose windows one automaton holds (about 60 times as many bytes).
SHARD_CHARS = 4_000_000

#: Upper case to lower case, other ASCII but letters and digits to space; bytes above 127 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "n_words long, n_hit long, items array<string>, ranges array<struct<first:int,last:int>>, spans array<struct<start:int,stop:int>>"

_automata: dict[str, ahocorasick.Automaton] = {}


class Shard(NamedTuple):
    """A broadcast list of (item_id, text), and a name that no other shard has."""

    name: str
    rows: Broadcast


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    n = min(window, len(words))
    return {b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)}


def automaton_of(shard: Shard, window: int) -> ahocorasick.Automaton:
    """The automaton of a shard, built once in a worker."""
    key = f"{shard.name}/{window}"
    if key not in _automata:
        items = defaultdict(set)
        for item_id, text in shard.rows.value:
            for w in windows_of(words_of(text), window):
                items[w].add(item_id)
        built = ahocorasick.Automaton()
        for w, ids in items.items():
            built.add_word(w.decode("latin-1"), (len(w), tuple(sorted(ids))))
        built.make_automaton()
        _automata.clear()
        _automata[key] = built
    return _automata[key]


def scan(automaton: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit word ranges (first, last; merged), items with occurring windows."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    found = list(automaton.iter(line.decode("latin-1")))
    if not found:
        return len(words), [], set()
    gaps = np.flatnonzero(np.frombuffer(line, "u1") == 32)
    ends = np.array([e for e, _ in found])
    firsts = np.searchsorted(gaps, ends - np.array([v[0] for _, v in found]) + 1)
    lasts = np.searchsorted(gaps, ends) - 1
    return len(words), merged(sorted(zip(firsts.tolist(), lasts.tolist()))), {i for _, v in found for i in v[1]}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in ranges:
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b][1]) for a, b in ranges]


def _hits_udf(shard: Shard, window: int):
    def run(texts: pd.Series) -> pd.DataFrame:
        automaton, rows = automaton_of(shard, window), []
        for text in texts:
            n, ranges, items = scan(automaton, text)
            rows.append((n, sum(b - a + 1 for a, b in ranges), sorted(items), ranges, offsets(text, ranges)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "ranges", "spans"])

    return F.pandas_udf(run, HITS).asNondeterministic()


def _touched_udf(shard: Shard, window: int):
    def run(texts: list[str | None]) -> pa.Array:
        automaton = automaton_of(shard, window)
        return pa.array([bool(scan(automaton, t)[1]) for t in texts], pa.bool_())

    return F.arrow_udf(by_slices(run), "boolean").asNondeterministic()


def benchmark_shards(benchmark: DataFrame, item: str = "item_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> list[Shard]:
    """Broadcast lists of (item_id, text); each is collected by itself, its size checked before."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null and item is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // shard_chars) or 1
    shard = lambda k: items if n == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
    return [Shard(uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in shard(k).collect()])) for k in range(n)]


def _union(ranges: Column) -> Column:
    """An array of ranges of words, merged where they overlap or touch."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def add(done: Column, x: Column) -> Column:
        end = F.element_at(done, -1)
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))
        return F.when((F.size(done) > 0) & (x["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, items, ranges (of words) and spans (of characters) for every document.

    The spans of several shards are not merged: they are all spans that one of them found."""
    ship_package(docs.sparkSession)
    shards = benchmark_shards(benchmark, shard_chars=shard_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(shards) == 1:
        return rows.select("doc_id", _hits_udf(shards[0], window)("text").alias("hit")).select("doc_id", "hit.*")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    every = None
    for shard in shards:
        found = rows.select("row", "doc_id", _hits_udf(shard, window)("text").alias("hit")).select("row", "doc_id", "hit.*")
        # the first shard names every row, the others only those they hit; a table each, so that one
        # automaton at a time is in a worker
        found = written(found if every is None else found.where("n_hit > 0"), "hits")
        every = found if every is None else every.unionByName(found)
    joined = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("ranges")).alias("all_ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    merged_rows = joined.withColumn("ranges", _union(F.col("all_ranges")))
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return merged_rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "ranges", "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    ship_package(docs.sparkSession)
    shards = benchmark_shards(benchmark, shard_chars=shard_chars)
    clean = docs
    for shard in shards[:-1]:
        clean = written(clean.where(~_touched_udf(shard, window)(F.col("text").cast("string"))), "clean")
    return clean.where(~_touched_udf(shards[-1], window)(F.col("text").cast("string")))


def item_digest(items) -> Column:
    """Lower-case hex SHA-256 of the sorted, comma-joined item ids."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)

