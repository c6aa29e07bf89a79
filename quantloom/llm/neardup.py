"""Near-duplicate documents: DartMinHash signatures, banded joining, exact checks and classes.

Two documents are linked if the weighted Jaccard similarity of their five-word shingles (lower case,
words between white space, counted) is at least 0.8; classes are the connected documents.

1. One pass over the texts numbers the rows and makes the signature's band keys, a 16-bit print of each
   of its coordinates, and a digest of the words. Rows of one digest are one text, named by its smallest
   row number. Row numbers, not doc_ids, are the keys of all later steps, so that different texts under
   one doc_id stay apart.
2. Texts that share a band key meet in a bucket. First every text is checked with one of its buckets'
   smallest members only, which already joins large groups of near copies at a pair a member.
3. Where a bucket still holds several classes, its members are checked with its smallest one, and in
   small buckets with each other, unless they are in one class by now.
4. Members of larger buckets that still hold several classes are joined by a prefix filter: with cells in
   one order, rare ones first, linked texts of n and m cells have a common cell before place n - c and
   m - c, where c is the least number of common cells that the threshold allows. Before that, texts are
   checked with one text of a cell's commonest class, the one with the fewest rare cells, as most of those
   that are linked with any of the class are linked with it, and need not be joined with all of them.

So each pair of a bucket is checked, ruled out by an exact filter, or known to be in one class, however
large the bucket is. Checks are exact; before them go pairs whose prints agree ``deviations`` standard
deviations less often than those of linked texts (``deviations=None`` checks every pair).

The class of a text is found by contraction: texts point to their smallest neighbour, pointers are
followed to their ends, and links between ends are what the next turn works on.

Edge cases: documents without words (null, empty, white space) are never linked; fewer than five words
are one shingle; texts of any length are taken whole; repeated rows share a class and one of them stays;
different texts under one doc_id are judged apart, and where a class has several of its smallest doc_id, the
one with the smallest hash stays, whatever the order of the rows; a null doc_id comes after all others, and a class of
null ids only has a null class_id; other columns are not looked at; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import dartminhash as dart
from quantloom.session import by_slices, ship_package, written

THRESHOLD = 0.8
#: Standard deviations that the agreement of prints may lie below the threshold.
DEVIATIONS = 4.0
#: Buckets up to this size compare all pairs of different classes; larger ones take the prefix filter.
SMALL = 8
#: Turns of checks with middle texts before the full join of prefixes (they save time only).
MIDDLE_TURNS = 2
#: Slots of the table of cell counts, which orders cells by rarity (collisions cost time only).
COUNT_SLOTS = 1 << 20
#: A null doc_id in the order of ids.
LAST = (1 << 63) - 1


def signatures(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """row, doc_id, tie (a hash of the text), doc (a struct of ``columns``; the text alone by default), digest, n_cells, keys (one
    per band) and prints (16 bits per coordinate, packed). Write it before using row numbers twice."""
    ship_package(docs.sparkSession)

    def run(texts: list[str | None]) -> pa.Array:
        rows = []
        for t in texts:
            words = dart.normalised(t)
            if not words:
                rows.append((None, 0, None, None))
                continue
            element, count = dart.shingles(words)
            ids = dart.signature(element, count)
            rows.append((hashlib.md5(words).digest(), int(count.sum()), dart.band_keys(ids), (ids >> np.uint64(48)).astype("<u2").tobytes()))
        types = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["digest", "n_cells", "keys", "prints"])

    made = F.arrow_udf(by_slices(run), "digest binary, n_cells int, keys array<long>, prints binary").asNondeterministic()
    kept, whole = F.struct(*[F.col(f"`{c}`") for c in columns or [text]]), F.col("doc").getField(text).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), kept.alias("doc"))
    return rows.select("row", "doc_id", F.xxhash64(whole).alias("tie"), "doc", made(whole).alias("made")).select("row", "doc_id", "tie", "doc", "made.*")


def _same_texts(signed: DataFrame) -> DataFrame:
    """(row, id) of all rows whose text occurs more than once; id is its smallest row.

    A text can hold any share of the rows, so its rows are dealt over salts before they are looked up."""
    salts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.where("digest is not null").select("row", "digest", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    parts = written(dealt.groupBy("digest", "salt").agg(F.min("row").alias("low"), F.count("*").alias("n")), "parts")
    several = written(parts.groupBy("digest").agg(F.min("low").alias("id"), F.sum("n").alias("n")).where("n > 1").select("digest", "id"), "several")
    spread = written(parts.select("digest", "salt").join(several, "digest"), "spread")
    return dealt.join(spread, ["digest", "salt"]).select("row", "id")


def _alike(n_a: Column, n_b: Column, threshold: float) -> Column:
    """Sizes that a similarity of the threshold allows."""
    return F.least(n_a, n_b) >= F.greatest(n_a, n_b) * F.lit(threshold - 1e-9)


def checked(pairs: DataFrame, prints: DataFrame, cut: DataFrame, threshold: float, deviations: float | None) -> DataFrame:
    """The pairs (a, b, ...) whose similarity reaches the threshold, with it. ``prints`` has (id, n,
    prints), ``cut`` (id, cells)."""

    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.mean(np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2"))) for x, y in zip(a, b)], dtype="float64")

    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dart.similarity(np.asarray(x, "i8"), np.asarray(y, "i8")) for x, y in zip(a, b)], dtype="float64")

    def both(some: DataFrame, values: DataFrame) -> DataFrame:
        side = lambda end: values.select(*[F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in values.columns])
        return some.join(side("a"), "a").join(side("b"), "b")

    likely = both(pairs, prints).where(_alike(F.col("n_a"), F.col("n_b"), threshold))
    if deviations is not None:
        least = threshold - deviations * (threshold * (1 - threshold) / dart.COORDINATES) ** 0.5
        likely = likely.where(F.pandas_udf(agreement, "double").asNondeterministic()("prints_a", "prints_b") >= least)
    likely = written(likely.select(*pairs.columns), "likely")
    measured = both(likely, cut).select(*pairs.columns, F.pandas_udf(similarity, "double").asNondeterministic()("cells_a", "cells_b").alias("similarity"))
    return written(measured.where(F.col("similarity") >= threshold), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b): the smallest id that is connected with it.

    A turn leaves one node of each neighbourhood's minimum, at most half of those with an edge."""
    labels = None
    while True:
        low = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("low"))
        parents = written(low.select(F.col("a").alias("id"), F.least("a", "low").alias("to")), "parents")
        while True:
            up = parents.select(F.col("id").alias("to"), F.col("to").alias("further"))
            jumped = written(parents.join(up, "to").select("id", F.col("further").alias("to"), (F.col("to") != F.col("further")).alias("moved")), "parents")
            parents = jumped.select("id", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = parents.withColumnRenamed("to", "label") if labels is None else relabelled(labels, parents.withColumnRenamed("to", "label"))
        end = lambda c: parents.select(F.col("id").alias(c), F.col("to").alias(f"root_{c}"))
        edges = written(edges.join(end("a"), "a").join(end("b"), "b").where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (id, label) after the labels themselves, and ids without one, got new ones in ``more``."""
    moved = labels.join(more.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return written(moved.union(more.join(labels.select("id"), "id", "left_anti").select("id", "label")), "labels")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with their label and that of the bucket's head."""
    labelled = written(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    found = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("id") == F.col("head"), F.col("label"))).alias("head_label"))
    return written(labelled.join(written(found.where("low <> high").select("key", "head_label"), "keys"), "key"), "mixed")


def _bucket_pairs(mixed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with labels of their own: of large buckets head and member, of small ones all."""
    heads = mixed.where((F.col("size") > SMALL) & (F.col("label") != F.col("head_label"))).select(F.col("head").alias("a"), F.col("id").alias("b"), F.col("head_label").alias("label_a"), F.col("label").alias("label_b"))
    few = mixed.where(F.col("size") <= SMALL)
    end = lambda c: few.select("key", F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("label").alias(f"label_{c}"))
    within = end("a").join(end("b"), "key").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _alike(F.col("n_a"), F.col("n_b"), threshold))
    return heads.union(within.select("a", "b", "label_a", "label_b")).distinct()


def _prefixes(cut: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(id, n, at, cell): the cells of these texts that can be the first common one of a linked pair."""
    spark = cut.sparkSession
    some = written(cut.join(ids, "id", "left_semi"), "some_cells")
    # at most COUNT_SLOTS numbers, whatever the input
    slots = some.select(F.explode("cells").alias("cell")).groupBy(F.col("cell").bitwiseAND(COUNT_SLOTS - 1).alias("slot")).count().toArrow()
    counts = np.zeros(COUNT_SLOTS, "i8")
    counts[slots["slot"].to_numpy()] = slots["count"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def prefix(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            c = np.asarray(v, "i8")
            order = np.lexsort((c, shared.value[c & (COUNT_SLOTS - 1)]))
            out.append(c[order[: len(c) - math.ceil(threshold * len(c) - 1e-6) + 1]])
        return pd.Series(out)

    made = some.select("id", F.size("cells").alias("n"), F.pandas_udf(prefix, "array<long>").asNondeterministic()("cells").alias("prefix"))
    return made.select("id", "n", F.posexplode("prefix").alias("at", "cell"))


def _shared_cells(prefixes: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` whose cell several classes have, with label, the label of the cell's
    commonest class (main) and its text with the fewest cells before this one (middle)."""
    rows = written(prefixes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "prefixes")
    per_label = rows.groupBy("cell", "label").agg(F.count("*").alias("count"), F.min_by("id", "at").alias("middle"))
    mains = per_label.groupBy("cell").agg(F.max_by(F.struct("label", "middle"), F.struct("count", "label")).alias("top"), F.count("*").alias("n_labels")).where("n_labels > 1")
    return written(rows.join(written(mains.select("cell", F.col("top.label").alias("main"), F.col("top.middle").alias("middle")), "mains"), "cell"), "shared_cells")


def _middle_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with their labels: each text with the middle one of the commonest class of its cells."""
    others = rows.where("label <> main").select("id", "middle", "label", "main").distinct()
    first = F.col("id") < F.col("middle")
    end = lambda yes, no: F.when(first, F.col(yes)).otherwise(F.col(no))
    return others.select(end("id", "middle").alias("a"), end("middle", "id").alias("b"), end("label", "main").alias("label_a"), end("main", "label").alias("label_b")).distinct()


def _rest_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different labels that may be linked: all that are, and few others."""
    common = lambda n: F.ceil(F.lit(threshold / (1 + threshold)) * n - 1e-6)
    # The shorter text needs a shorter prefix; rows of a cell's commonest label do not meet each other.
    short = rows.where(F.col("at") <= F.col("n") - common(F.col("n") * 2)).select("cell", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "at", "label", "main")])
    long = rows.select("cell", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "at", "label", "main")])

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        least = common(F.col("n_a") + F.col("n_b"))
        ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
        fits = (F.col("at_a") <= F.col("n_a") - least) & (F.col("at_b") <= F.col("n_b") - least)
        both = x.join(y, (x["cell"] == y["cell"]) & (F.col("label_a") != F.col("label_b")) & ordered & _alike(F.col("n_a"), F.col("n_b"), threshold) & fits)
        turned = F.col("id_a") > F.col("id_b")
        swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
        return both.select(swap("id_a", "id_b").alias("a"), swap("id_b", "id_a").alias("b"), swap("label_a", "label_b").alias("label_a"), swap("label_b", "label_a").alias("label_b"))

    return met(short.where("label_a <> main_a"), long).union(met(short.where("label_a = main_a"), long.where("label_b <> main_b"))).distinct()


def _classes(signed: DataFrame, threshold: float, text: str, deviations: float | None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, class_id, kept) of every row, and the verified pairs (a, b, similarity) of texts."""
    same = written(_same_texts(signed), "same")
    single = signed.where("digest is not null").join(same.where("row <> id").select("row"), "row", "left_anti")
    banded = single.select(F.col("row").alias("id"), F.col("n_cells").alias("n"), F.explode("keys").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1"), "buckets")
    members = written(banded.join(buckets, "key"), "members")
    nodes = written(members.select("id").distinct(), "nodes")

    def cells(texts: list[str | None]) -> pa.Array:
        return pa.array([dart.cells(dart.normalised(t)).view("i8") for t in texts], pa.list_(pa.int64()))

    # The number of texts with a partner has no bound, so they are never broadcast.
    partners = signed.select(F.col("row").alias("id"), F.col("doc").getField(text).cast("string").alias("text")).join(nodes.hint("merge"), "id", "left_semi")
    cut = written(partners.select("id", F.arrow_udf(by_slices(cells), "array<long>").asNondeterministic()("text").alias("cells")), "cells")
    prints = written(signed.select(F.col("row").alias("id"), F.col("n_cells").alias("n"), "prints").join(nodes.hint("merge"), "id", "left_semi"), "prints")

    tried = written(members.where("id <> head").groupBy(F.col("id").alias("b")).agg(F.min("head").alias("a")).select("a", "b"), "pairs")
    links = checked(tried, prints, cut, threshold, deviations)
    labels, found = components(links), [links]

    def search(pairs: DataFrame) -> None:
        nonlocal labels, tried
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        more = checked(pairs, prints, cut, threshold, deviations)
        labels, tried = relabelled(labels, components(more.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))), tried.union(pairs.select("a", "b"))
        found.append(more)

    mixed = _mixed(members, labels)
    search(_bucket_pairs(mixed, threshold))
    large = mixed.where(F.col("size") > SMALL).select("key", "id", "n", "size", "head")
    if not large.isEmpty():
        rest = written(_mixed(large, labels).select("id", "label").distinct(), "rest")
        if not rest.isEmpty():
            prefixes = written(_prefixes(cut, rest.select("id"), threshold), "prefixes")
            for _ in range(MIDDLE_TURNS):
                search(_middle_pairs(_shared_cells(prefixes, labels)))
            search(_rest_pairs(_shared_cells(prefixes, labels), threshold))

    placed = signed.select("row", "doc_id", "tie").join(same, "row", "left").withColumn("id", F.coalesce("id", "row")).join(labels, "id", "left")
    placed = written(placed.select("row", "doc_id", "tie", F.coalesce("label", "id").alias("label")), "placed")
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)), "tie", "row")
    names = written(placed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("row", order).alias("stays")), "names")
    classes = placed.join(names, "label").select("row", "doc_id", "class_id", (F.col("row") == F.col("stays")).alias("kept"))
    spanning = found[0].select("a", "b", "similarity")
    for more in found[1:]:
        spanning = spanning.union(more.select("a", "b", "similarity"))
    return classes, spanning


def classes_and_links(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", deviations: float | None = DEVIATIONS) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`near_duplicates` and the verified pairs of texts (a, b: the doc_id of one row of
    each; similarity). The pairs span every class; they are not all the links within it."""
    signed = written(signatures(docs, text), "signed")
    classes, links = _classes(signed, threshold, text, deviations)
    end = lambda c: signed.select(F.col("row").alias(c), F.col("doc_id").alias(f"doc_{c}"))
    named = links.join(end("a"), "a").join(end("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"), "similarity")
    return classes.drop("row"), named


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", deviations: float | None = DEVIATIONS) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept (whether it is the row that stays), one row
    per input row."""
    return _classes(written(signatures(docs, text), "signed"), threshold, text, deviations)[0].drop("row")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", deviations: float | None = DEVIATIONS) -> DataFrame:
    """One row of each class (of its smallest doc_id), with all columns."""
    signed = written(signatures(docs, text, docs.columns), "signed")
    gone = written(_classes(signed, threshold, text, deviations)[0].where("not kept").select("row"), "gone")
    return signed.select("row", "doc").join(gone, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
