"""Repair of conversation structure by error-correcting Earley parsing.

A weighted grammar says which sequences of roles are right: none, or pairs of a user's and an assistant's turn,
with a system turn before them or not. Its terminals have error productions: a turn may be kept, get another
role, be deleted, or be inserted. The parser scans a conversation's turns once. Items of its chart are dotted
productions, and each retains the minimum of (cost, audit), the audit being the initials of the edits so far
(Delete, Insert, Keep, Rerole); of equal costs the smaller text. The completed chart's item yields the repair.

The grammar is left-linear: a nonterminal stands only at the left end of a production, so every item has its
origin at the first turn, a set of the chart follows from the one before it, and the work is linear in the
turns. Audits would grow with the conversation, so every ``FREEZE`` turns what the items have read is put away
in a linked list and replaced by its rank among the live items: within one set all audits have one letter
other than I per turn read, so no audit is a proper beginning of another one with the same cost, and comparing
(cost, rank, rest) is comparing (cost, audit).

The parser sees no texts: faults are found by column functions, and it reads (turn, initial, fault, digest) in
order. A conversation's turns are parsed by one task that holds some hundred bytes a turn; its texts are joined
to the edits by digest afterwards, spread over all tasks.

Faults: the first of blank (no character but white space), duplicate (role and text of an earlier turn of the
conversation), truncated (the last character that is not white space is none of ``.!?``). Blank and duplicate
turns must be deleted.

Edge cases: null roles and texts are one space, in digests and in results; a null conv_id is one conversation;
turns without a number come first, and are ignored in gaps; turns of one number are ordered by role, then by a
digest of role and text, so that equal ones lie side by side; a role's initial is its first character, other
roles than those of the grammar (and none) can be reroled or deleted; texts of any length are taken whole; an
empty table gives empty tables; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantloom.session import ship_package, written

#: What edits cost, and an undeleted truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Roles that a turn can get or be inserted with, by initial.
ROLES = {"u": "user", "a": "assistant"}
#: Faults as the parser sees them.
NO_FAULT, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
LEGAL_NEIGHBOURS = {"su", "ua", "au"}
#: Turns after which audits are put away, and rows that are handed to Spark at a time.
FREEZE, BATCH = 64, 8_192

#: The grammar: head, and a body of at most one nonterminal followed by a terminal. "x" is a deleted turn.
PRODUCTIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("nothing", ()),
    ("nothing", ("nothing", "x")),
    ("opened", ("nothing", "s")),
    ("opened", ("opened", "x")),
    ("asked", ("nothing", "u")),
    ("asked", ("opened", "u")),
    ("asked", ("answered", "u")),
    ("asked", ("asked", "x")),
    ("answered", ("asked", "a")),
    ("answered", ("answered", "x")),
    ("conversation", ("nothing",)),
    ("conversation", ("answered",)),
)
GOAL = "conversation"

WHITE = r"\x20\x09-\x0D"
PARSED = "conv_key string, place long, edit string, role string, link binary, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

#: cost, rank of what is put away, the audit after it, the list of what is put away
Weight = tuple[int, int, str, tuple | None]


def edits_of(initial: str, fault: int) -> dict[str, tuple[str, int]]:
    """terminal -> (letter, cost) of the cheapest edit that makes it of a turn."""
    made = {"x": ("D", DELETE)}
    if fault in (IS_BLANK, IS_DUPLICATE):
        return made
    extra = TRUNCATED if fault == IS_TRUNCATED else 0
    made |= {t: ("R", REROLE + extra) for t in ROLES}
    if initial in ("s", *ROLES):
        made[initial] = ("K", extra)
    return made


class RepairChart:
    """The last set of an Earley chart: items (production, dot) after the nonterminal, and complete ones."""

    def __init__(self, productions: tuple[tuple[str, tuple[str, ...]], ...] = PRODUCTIONS):
        self.heads = [head for head, _ in productions]
        self.terminal = [body[1] if len(body) == 2 else None for _, body in productions]
        #: Predicted items, by the nonterminal that their dot stands before. They all start at the first turn.
        self.waiting: dict[str, list[int]] = {}
        for p, (_, body) in enumerate(productions):
            if body:
                self.waiting.setdefault(body[0], []).append(p)
        self.read = 0
        self.items: dict[int, Weight] = {}  # production -> weight, with the dot before its terminal
        self.complete: dict[str, Weight] = {}  # head -> weight
        self._close({head: (0, 0, "", None) for head, body in productions if not body})

    def _close(self, complete: dict[str, Weight]) -> None:
        """Completer and inserting productions: all items of the set, from the complete ones."""
        self.complete, self.items = complete, {}
        todo = list(complete)
        while todo:
            head = todo.pop()
            weight = complete[head]
            for p in self.waiting.get(head, ()):
                terminal, to = self.terminal[p], self.heads[p]
                if terminal is not None:
                    if p not in self.items or weight[:3] < self.items[p][:3]:
                        self.items[p] = weight
                    if terminal not in ROLES:
                        continue
                    made = (weight[0] + INSERT, weight[1], weight[2] + "I", weight[3])
                else:
                    made = weight
                if to not in complete or made[:3] < complete[to][:3]:
                    complete[to] = made
                    todo.append(to)

    def scan(self, initial: str, fault: int) -> None:
        """Read one turn."""
        edits, complete = edits_of(initial, fault), {}
        for p, (cost, rank, tail, put_away) in self.items.items():
            edit = edits.get(self.terminal[p])
            if edit is not None:
                made = (cost + edit[1], rank, tail + edit[0], put_away)
                head = self.heads[p]
                if head not in complete or made[:3] < complete[head][:3]:
                    complete[head] = made
        self.read += 1
        if self.read % FREEZE == 0:
            complete = self._frozen(complete)
        self._close(complete)

    @staticmethod
    def _frozen(complete: dict[str, Weight]) -> dict[str, Weight]:
        """The items with their audits put away; equal ones share their list."""
        order = sorted({(rank, tail) for _, rank, tail, _ in complete.values()})
        ranks, lists = {k: i for i, k in enumerate(order)}, {}
        for _, rank, tail, put_away in complete.values():
            lists.setdefault((rank, tail), (put_away, tail))
        return {head: (cost, ranks[rank, tail], "", lists[rank, tail]) for head, (cost, rank, tail, _) in complete.items()}

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair of the turns read."""
        cost, _, tail, put_away = self.complete[GOAL]
        parts = [tail]
        while put_away is not None:
            put_away, part = put_away
            parts.append(part)
        return cost, "".join(reversed(parts))


def repaired(audit: Iterable[str], initials: str) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, number of its turn or None, role that it gives or None) for each letter of an audit."""
    at, last = 0, ""
    for edit in audit:
        due = "a" if last == "u" else "u"
        if edit == "I":
            yield edit, None, ROLES[due]
            last = due
            continue
        yield edit, at, ROLES[due] if edit == "R" else None
        if edit != "D":
            last = initials[at] if edit == "K" else due
        at += 1


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_key, turn, role, text, link): the operator's columns, clean; link is a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    clean = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv_key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return clean.withColumn("link", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


def faults(turns: DataFrame) -> DataFrame:
    """(conv_key, turn, role, link, initial, fault) in the order of the parser, without texts."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("link")]
    blank, truncated = ~F.col("text").rlike(f"[^{WHITE}]"), F.col("text").rlike(rf"[^{WHITE}.!?][{WHITE}]*\z")
    light = turns.select("conv_key", "turn", "role", "link", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), truncated.alias("truncated"))
    again = F.row_number().over(Window.partitionBy("conv_key", "link").orderBy(*order[:1])) > 1
    fault = F.when(F.col("blank"), IS_BLANK).when(F.col("again"), IS_DUPLICATE).when(F.col("truncated"), IS_TRUNCATED).otherwise(NO_FAULT)
    placed = light.repartition("conv_key").withColumn("again", again)
    return placed.withColumn("fault", fault).select("conv_key", "turn", "role", "link", "initial", "fault").sortWithinPartitions("conv_key", *order)


def parse(turns: DataFrame) -> DataFrame:
    """The edits of all conversations, each in the order of its audit, and after them a row without an edit
    with the conversation's counts, cost and audit."""
    ship_package(turns.sparkSession)
    names = [f.split()[0] for f in PARSED.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for n, f in zip(names, PARSED.split(", "))])

    def of_one(key: str, rows: Iterable[tuple]) -> Iterator[tuple]:
        chart, initials, links = RepairChart(), [], []
        counts, illegal, distinct, first, last = [0] * 4, 0, 0, None, None
        for _, turn, link, initial, fault in rows:
            chart.scan(initial, fault)
            counts[fault] += 1
            illegal += bool(initials) and initials[-1] + initial not in LEGAL_NEIGHBOURS
            initials.append(initial)
            links.append(link)
            if turn is not None and turn != last:
                distinct, first, last = distinct + 1, turn if first is None else first, turn
        cost, audit = chart.result()
        for place, (edit, at, role) in enumerate(repaired(audit, initials)):
            yield key, place, edit, role, None if at is None else links[at], *[None] * 7
        gaps = 0 if first is None else last - first + 1 - distinct
        yield key, None, None, None, None, gaps, counts[IS_BLANK], counts[IS_DUPLICATE], counts[IS_TRUNCATED], illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for key, one in groupby(rows, lambda r: r[0]):
            for made in of_one(key, one):
                out.append(made)
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return faults(turns).select("conv_key", "turn", "link", "initial", "fault").mapInArrow(run, PARSED)


def with_texts(parsed: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_key, place, edit, role, text): every edit with the role and text that it leaves; null for deleted
    turns. A conversation keeps one turn at most of a digest, so copies are dropped before the join."""
    edits = parsed.where("edit is not null").select("conv_key", "place", "edit", F.col("role").alias("given"), F.when(F.col("edit").isin("K", "R"), F.col("link")).alias("link"))
    texts = turns.groupBy("conv_key", "link").agg(F.first("role").alias("had"), F.first("text").alias("text"))
    joined = edits.where("link is not null").join(texts, ["conv_key", "link"]).select("conv_key", "place", "edit", F.coalesce("given", "had").alias("role"), "text")
    others = edits.where("link is null").select("conv_key", "place", "edit", F.col("given").alias("role"), F.when(F.col("edit") == "I", F.lit("")).alias("text"))
    return joined.unionByName(others)


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired conversations, a row per edit: conv_id, place, edit, role and text."""
    turns = turns_of(conversations)
    return with_texts(written(parse(turns), "parsed"), turns).select(key_back("conv_key").alias("conv_id"), "place", "edit", "role", "text")


def key_back(key: str) -> Column:
    return F.when(F.col(key) != "", F.col(key)).cast("long")


def digests(texts: DataFrame) -> DataFrame:
    """(conv_key, repaired_sha256): of every conversation's ``role:text``, joined by line feeds, in order."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, first = None, None, True
        for batch in batches:
            out = []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "role", "text"))):
                if k != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest, first = k, hashlib.sha256(), True
                digest.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
                first = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["conv_key", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv_key", "repaired_sha256"])

    placed = texts.where("edit <> 'D'").repartition("conv_key").sortWithinPartitions("conv_key", "place")
    return placed.select("conv_key", "role", "text").mapInArrow(run, "conv_key string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its
    text, 2 takes its sentence ends away, 3 repeats it, 4 gives it the user's role. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    rows = conversations.select(*ids, said("role").alias("role"), said("text").alias("text"))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.withColumn("kind", kind).where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return made.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def report(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation of ``ids`` with its faults, the cost and audit of its repair, and the digest of what
    is left. Those without turns have zeros, an empty audit and the digest of an empty text."""
    turns = turns_of(conversations)
    parsed = written(parse(turns), "parsed")
    summary = parsed.where("edit is null").select("conv_key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    keys = ids.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv_key")).distinct()
    found = keys.join(summary, "conv_key", "left").join(digests(with_texts(parsed, turns)), "conv_key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(key_back("conv_key").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
