"""Token counts, exponion clustering and turn repair against brute-force versions, and on odd tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import bpe, exponion, token_counts, turn_repair

tokenizers = pytest.importorskip("tokenizers")

# Token counts


def count_texts():
    r = random.Random(7)
    some = ["".join(r.choice("aabbcde ERTin'01,.éß漢\n\t ") for _ in range(r.randrange(400))) for _ in range(200)]
    long = ["x" * 30_000, "ab" * 4_000, "".join(r.choice("acgt") for _ in range(9_000)), "".join(r.choice("abcdefghijklmnop") for _ in range(4_000)), "日本" * 900]
    return some + long + ["", "a", "aaa" * 7 + " bbbbb ", "hi<|endoftext|><|endoftext|> it's", " ".join(f"w{i % 977}" for i in range(20_000))]


@pytest.fixture(scope="module")
def expected_counts():
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    return [len(library.encode(t, add_special_tokens=False).ids) for t in count_texts()]


def test_counts_equal_library(expected_counts):
    assert token_counts.counter(bpe.default_vocabulary()).count(count_texts()).tolist() == expected_counts


def test_counts_with_small_cache_and_groups(expected_counts, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP_CHARS", 50)
    monkeypatch.setattr(token_counts, "GROUP_PIECES", 7)
    small = token_counts.TokenCounter(bpe.default_vocabulary(), cache_entries=3)
    assert small.count(count_texts()).tolist() == expected_counts


def test_counts_one_merge_at_a_time(expected_counts, monkeypatch):
    one = token_counts.TokenCounter(bpe.default_vocabulary())
    assert one.table.in_order
    one.table.in_order = False
    assert one.count(count_texts()).tolist() == expected_counts


def plain_merges(merges, piece):
    symbols, rank = [bytes([b]) for b in piece], {m: i for i, m in enumerate(merges)}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]
        if not found:
            return len(symbols)
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("late", [False, True])
def test_counts_of_random_vocabularies(late):
    """Also of vocabularies in which a symbol is made again by a later merge."""
    r = random.Random(11 + late)
    for _ in range(60):
        made, merges = [b"a", b"b", b"c"], []
        while len(merges) < 14:
            pair = (r.choice(made), r.choice(made))
            if pair not in merges and len(pair[0] + pair[1]) < 7 and (late or pair[0] + pair[1] not in made):
                merges.append(pair)
                made.append(pair[0] + pair[1])
        if late:
            r.shuffle(merges)
        table = token_counts.MergeTable({t: i for i, t in enumerate(made)}, merges)
        pieces = ["".join(r.choice("abc") for _ in range(r.randrange(1, 40))).encode() for _ in range(40)]
        expected = [plain_merges(merges, p) for p in pieces]
        assert token_counts.merged_counts(table, pieces).tolist() == expected
        assert [token_counts.merged_alone(table, p) for p in pieces] == expected


def test_counts_on_odd_rows(spark):
    schema = "n_tokens string, doc_id long, text string, over_limit int, `odd.name` string"
    rows = [("x", 1, None, 0, "y"), ("x", None, "", 0, "y"), (None, 3, "two words", 0, None), (None, 3, "two words", 0, None), ("x", 4, "é" * 700, 0, "y")]
    got = sorted(map(tuple, token_counts.count_tokens(spark.createDataFrame(rows, schema)).collect()), key=str)
    n = token_counts.counter(bpe.default_vocabulary()).count(["é" * 700])[0]
    assert got == sorted([(1, 0, 0, False), (None, 0, 0, False), (3, 9, 2, False), (3, 9, 2, False), (4, 1400, int(n), bool(n > 512))], key=str)
    assert token_counts.count_tokens(spark.createDataFrame([], schema)).collect() == []
    assert token_counts.count_tokens(spark.createDataFrame(rows[2:3], schema), limit=1).collect()[0].over_limit


# Exponion


def plain_clusters(vectors, k, rounds, seed):
    ordered = sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))
    centroids = [list(v) for _, v in ordered[:k]]

    def nearest():
        far = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in vectors]
        return [(min(range(len(d)), key=lambda j: (d[j], j)), min(d)) for d in far]

    for _ in range(rounds):
        to = nearest()
        for j in range(len(centroids)):
            members = [v for (_, v), (c, _) in zip(vectors, to) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    return nearest(), centroids


def spark_vectors(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, vec array<int>")


@pytest.mark.parametrize("k, spread, dims", [(7, 2, 2), (5, 40, 3), (16, 3, 4), (1, 5, 2), (40, 1, 2)])
def test_exponion_equals_brute_force(spark, k, spread, dims):
    """Small spreads give many ties, equal vectors and empty clusters."""
    r = random.Random(k * 31 + spread)
    vectors = [(i // 2 if k == 7 else i, [r.randint(-spread, spread) for _ in range(dims)]) for i in range(150)]
    made = exponion.cluster(spark_vectors(spark, vectors).repartition(3), k, 4, 9)
    expected, centroids = plain_clusters(vectors, k, 4, 9)
    assert made.centroids.tolist() == centroids
    assert sorted(map(tuple, made.assigned.collect())) == sorted((i, c, d) for (i, _), (c, d) in zip(vectors, expected))


def test_exponion_totals_and_few_vectors(spark):
    vectors = [(1, [0, 0]), (None, [3, 4]), (2, [-1, 5])]
    made = exponion.cluster(spark_vectors(spark, vectors), 16, 3, 1)
    got = exponion.with_totals(made).collect()
    assert len(got) == 3 and {r.inertia for r in got} == {0} and len({r.centroid_sha256 for r in got}) == 3
    assert hashlib.sha256(b"3,4").hexdigest() in {r.centroid_sha256 for r in got if r.vec_id is None}
    empty = exponion.with_totals(exponion.cluster(spark_vectors(spark, []), 16, 3, 1))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_exponion_keeps_usable_vectors_only(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01], "x"), (2, None, "x"), (3, [1.0], "x"), (4, [nan, 0.0], "x"), (5, [inf, 0.0], None), (6, [None, 0.0], "x"), (7, [1e30, -1e30], "x"), (None, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = {r.vec_id: r.vec for r in exponion.whole_vectors(df, 2, 64).collect()}
    assert got == {1: [32, -1], 7: [exponion.BOUND, -exponion.BOUND], None: [64, 128]}
    assert exponion.with_totals(exponion.cluster(exponion.whole_vectors(df, 2, 64), 2, 3, 1)).count() == 3


def test_exponion_scans_fewer_centroids():
    r = np.random.default_rng(3)
    centers = r.integers(-3000, 3000, (60, 2))
    vec = np.repeat(centers, 50, axis=0) + r.integers(-40, 40, (3000, 2))
    fellows, zero = exponion.Fellows(centers), np.zeros(3000)
    at_own = np.repeat(np.arange(60), 50)
    _, upper, lower, made = exponion.search(vec, at_own, zero + np.inf, zero, fellows)
    assert made < 3000 * 60 / 3
    _, _, _, again = exponion.search(vec, at_own, upper, lower, fellows)
    assert again < made / 5


# Turn repair


def plain_repair(turns):
    """All edit scripts of rows (initial, fault) with up to three insertions at a place, cheapest first."""
    best = None
    options = lambda fault: "D" if fault in (1, 2) else "DKR"
    for letters in itertools.product(*[options(f) for _, f in turns]):
        for inserts in itertools.product(range(3), repeat=len(turns) + 1):
            cost, out, audit, at = 0, "", "", 0
            for n, (edit, (initial, fault)) in zip(inserts, zip([*letters, ""], [*turns, ("", 0)])):
                for _ in range(n):
                    cost, audit = cost + 5, audit + "I"
                    out += "a" if out[-1:] == "u" else "u"
                if not edit:
                    continue
                audit += edit
                cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if fault == 3 and edit != "D" else 0)
                if edit == "K":
                    out += initial if initial and initial in "sua" else "?"
                elif edit == "R":
                    out += "a" if out[-1:] == "u" else "u"
            body = out.removeprefix("s")
            right = out == "" or (body != "" and body == "ua" * (len(body) // 2))
            if right and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def parsed(turns, freeze=None):
    chart = turn_repair.RepairChart()
    for initial, fault in turns:
        chart.scan(initial, fault)
    return chart.result()


def test_repair_equals_brute_force():
    r = random.Random(5)
    for n in range(6):
        for _ in range(60 if n else 1):
            turns = [(r.choice("sssuuuaat") if r.random() > 0.05 else "", r.choice((0, 0, 0, 1, 2, 3))) for _ in range(n)]
            assert parsed(turns) == plain_repair(turns), turns


def test_putting_audits_away_changes_nothing(monkeypatch):
    r = random.Random(6)
    for _ in range(60):
        turns = [(r.choice("suuuaaa"), r.choice((0, 0, 0, 0, 1, 3))) for _ in range(70)]
        monkeypatch.setattr(turn_repair, "FREEZE", 10**9)
        whole = parsed(turns)
        for freeze in (1, 3, 16):
            monkeypatch.setattr(turn_repair, "FREEZE", freeze)
            assert parsed(turns) == whole


def test_long_conversations_are_linear_and_small():
    for turns in ([("u", 0)] * 30_000, [("u", 0), ("a", 0)] * 15_000, [("s", 3)] * 30_000):
        cost, audit = parsed(turns)
        assert len(audit) >= 30_000 and cost >= 0


def plain_report(rows):
    """The contract's result from the original rows (conv_id, turn, role, text), turn numbers distinct."""
    out, damaged = {}, []
    for conv, turn, role, text in rows:
        out[conv] = []
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            damaged += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in out:
        mine = sorted((x for x in damaged if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        seen, turns, counts, white = set(), [], [0] * 4, " \t\n\x0b\x0c\r"
        for _, _, role, text in mine:
            full = text.strip(white)
            fault = 1 if not full else 2 if (role, text) in seen else 3 if full[-1] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            turns.append((role[:1], fault))
        numbers = {x[1] for x in mine if x[1] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = plain_repair(turns)
        said, at, last = [], 0, ""
        for edit in audit:
            due = "assistant" if last == "u" else "user"
            if edit == "I":
                said.append(f"{due}:")
                last = due[0]
                continue
            if edit != "D":
                role = mine[at][2] if edit == "K" else due
                said.append(f"{role}:{mine[at][3]}")
                last = role[:1]
            at += 1
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair_query_on_odd_rows(spark):
    r = random.Random(8)
    rows, texts = [], ["Well.", "No end", " \t\n", "", None, "Is it?", "Wow! ", "É日.", "Well."]
    for conv in [*range(60), None]:
        for turn in sorted(r.sample(range(9), r.randrange(1, 5))):
            rows.append((conv, turn if turn else None, r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice(texts)))
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, conv_key string, fault int").repartition(3)
    got = {x.conv_id: tuple(x)[1:] for x in turn_repair.report(turn_repair.damage(df), df).collect()}
    assert got == plain_report(rows)
    none = df.where("false")
    assert turn_repair.report(turn_repair.damage(none), none).collect() == [] and turn_repair.repair(none).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Go on."), (1, 3, "user", "And?"), (2, 0, "assistant", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(x) for x in turn_repair.repair(df).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "D", None, None), (1, 2, "D", None, None), (1, 3, "K", "user", "Go on."), (1, 4, "R", "assistant", "And?"), (2, 0, "D", None, None)]
    long = spark.range(3_000).select(F.lit(7).cast("long").alias("conv_id"), "id", F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("long "), 50), F.col("id").cast("string"), F.lit(".")).alias("text"))
    one = turn_repair.report(long, long).collect()
    digest = hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:{'long ' * 50}{i}." for i in range(3_000)).encode()).hexdigest()
    assert len(one) == 1 and one[0].audit == "K" * 3_000 and one[0].repaired_sha256 == digest and one[0].cost == 0
