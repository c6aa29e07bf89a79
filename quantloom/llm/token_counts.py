"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

The pre-tokens of many texts that are not known yet are laid one after the other into one array of symbols,
with the number of the pre-token that each belongs to. In every round each pre-token finds the lowest rank
among its neighbouring pairs, and all its pairs of that rank are merged at once (of overlapping ones every
other, from the left); pre-tokens without a pair that merges drop out with the number of symbols they have
left. The counts of a text's pre-tokens add up to its tokens: no ids are made.

Merging a rank at once equals merging it one by one where no merge uses a symbol that a later merge makes.
Files of trained vocabularies have that order; where one has not, only the leftmost pair is merged.

Long pre-tokens, which would hold up the others for thousands of rounds, are merged alone: their pairs' ranks
are kept, and a round renews those beside its merges only.

Edge cases: null and empty text have no tokens and no bytes; special strings of the vocabulary inside a text
are one token each, as the library's default has it; repeated documents are each counted; texts of any length
are counted whole, some hundred thousand pre-tokens at a time; doc_id may be null or repeated; other columns
are not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.bpe import BpeCodec, byte_symbols, default_vocabulary
from quantloom.session import ship_package

#: Tokens above which a document is over the limit.
LIMIT = 512
#: Pre-tokens whose counts a worker remembers, the longest of them in characters, and bytes from which one
#: is merged alone.
CACHE_ENTRIES, CACHE_CHARS, ALONE = 600_000, 64, 512
#: Characters of text, and pre-tokens of a longer text, that are worked on at a time.
GROUP_CHARS, GROUP_PIECES = 1_000_000, 200_000

#: Rank of a pair that doesn't merge.
NEVER = np.iinfo(np.int32).max

_counters: dict[str, "TokenCounter"] = {}


class MergeTable:
    """The merges of a vocabulary file as arrays sorted by pair."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        ids = {t: i for i, t in enumerate(sorted({bytes([b]) for b in range(256)} | set(vocab)))}
        self.size = len(ids)
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], "i8")
        last_rank = {a + b: rank for rank, (a, b) in enumerate(merges)}
        #: Whether all pairs of one rank can be merged at once.
        self.in_order = all(last_rank.get(x, -1) < rank for rank, pair in enumerate(merges) for x in pair)
        pairs, made = np.array([ids[a] * self.size + ids[b] for a, b in merges], "i8"), np.array([ids[a + b] for a, b in merges], "i8")
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.made = pairs[order], order.astype("i4"), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; ``NEVER`` where they don't merge."""
        if not len(self.pairs):
            return np.full(len(left), NEVER, "i4")
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NEVER)


def _every_other(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of rising places of pairs those to merge: the first, third and so on of each run in which every pair
    shares a symbol with the next (``touches``)."""
    starts = np.concatenate([[True], ~touches])
    run = np.flatnonzero(starts)
    return at[(np.arange(len(at)) - run[np.cumsum(starts) - 1]) % 2 == 0]


def merged_counts(table: MergeTable, pieces: list[bytes]) -> np.ndarray:
    """Symbols that are left of each piece; pieces have a byte at least."""
    sizes = np.array([len(p) for p in pieces], "i8")
    counts = np.ones(len(pieces), "i8")
    active = np.flatnonzero(sizes > 1)
    if not len(active):
        return counts
    owner = np.repeat(active, sizes[active])
    symbol = table.byte_ids[np.frombuffer(b"".join([pieces[i] for i in active]), "u1")]
    while len(symbol):
        # Pairs reach from every symbol to the next of its piece; the last of a piece has none.
        ends = np.concatenate([owner[1:] != owner[:-1], [True]])
        rank = np.full(len(symbol), NEVER, "i4")
        inner = np.flatnonzero(~ends)
        rank[inner] = table.rank(symbol[inner], symbol[inner + 1])
        starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
        least, length = np.minimum.reduceat(rank, starts), np.diff(np.concatenate([starts, [len(symbol)]]))
        done = least == NEVER
        counts[owner[starts[done]]] = length[done]
        at = np.flatnonzero((rank == np.repeat(least, length)) & (rank != NEVER))
        if not len(at):
            break
        if table.in_order:
            at = _every_other(at, np.diff(at) == 1)
        else:
            _, leftmost = np.unique(owner[at], return_index=True)
            at = at[leftmost]
        symbol[at] = table.made[rank[at]]
        stays = np.repeat(~done, length)
        stays[at + 1] = False
        symbol, owner = symbol[stays], owner[stays]
    return counts


def merged_alone(table: MergeTable, piece: bytes) -> int:
    """The same for one long piece. Symbols that were merged away are skipped by links, and squeezed out
    when they are half of all."""
    symbol = table.byte_ids[np.frombuffer(piece, "u1")]
    while len(symbol) > 1:
        n = len(symbol)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.append(table.rank(symbol[:-1], symbol[1:]), NEVER).astype("i4")
        alive, left = np.ones(n, bool), n
        while 2 * left > n:
            least = rank.min()
            if least == NEVER:
                return left
            at = np.flatnonzero(rank == least)
            at = _every_other(at, following[at[:-1]] == at[1:]) if table.in_order else at[:1]
            gone = following[at]
            symbol[at] = table.made[least]
            alive[gone], rank[gone] = False, NEVER
            following[at] = following[gone]
            behind = following[at]
            before[behind[behind < n]] = at[behind < n]
            left -= len(at)
            renew = np.concatenate([at, before[at]])
            renew = np.unique(renew[renew >= 0])
            has = following[renew] < n
            rank[renew] = NEVER
            rank[renew[has]] = table.rank(symbol[renew[has]], symbol[following[renew[has]]])
        symbol = symbol[alive]
    return len(symbol)


class TokenCounter:
    """Pre-tokeniser, merges, and the counts of pre-tokens seen before, of one byte-level BPE file."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_symbols()
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = MergeTable({as_bytes(t): i for t, i in spec["model"]["vocab"].items()}, [(as_bytes(a), as_bytes(b)) for a, b in pairs])
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.any_piece, self.latin_piece = regex.compile(BpeCodec.PATTERN), re.compile(BpeCodec.LATIN_PATTERN)
        self.known: dict[str, int] = {}
        self.cache_entries = cache_entries

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without special strings, a bounded list at a time."""
        try:
            text.encode("latin-1")
            pattern = self.latin_piece
        except UnicodeEncodeError:
            pattern = self.any_piece
        if len(text) <= GROUP_CHARS:
            yield pattern.findall(text)
            return
        found = pattern.finditer(text)
        while some := [m.group() for m in islice(found, GROUP_PIECES)]:
            yield some

    def _add(self, group: list[tuple[int, list[str]]], counts: np.ndarray) -> None:
        """Add the tokens of lists of pre-tokens to the counts of their texts."""
        known = self.known
        if len(known) > self.cache_entries:
            known.clear()
        new = [p for p in set().union(*(pieces for _, pieces in group)) if p not in known]
        raw = [p.encode("utf-8") for p in new]
        together = [i for i, b in enumerate(raw) if len(b) <= ALONE]
        known.update(zip([new[i] for i in together], merged_counts(self.table, [raw[i] for i in together]).tolist()))
        known.update((new[i], merged_alone(self.table, b)) for i, b in enumerate(raw) if len(b) > ALONE)
        for i, pieces in group:
            counts[i] += sum(map(known.__getitem__, pieces))
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        counts, group, chars = np.zeros(len(texts), "i8"), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special is not None and any(s in text for s in self.specials):
                parts = self.special.split(text)
                counts[i] += len(parts) - 1
            for part in parts:
                for pieces in self._pieces(part):
                    group.append((i, pieces))
                    chars += min(len(part), GROUP_CHARS)
                    if chars >= GROUP_CHARS:
                        self._add(group, counts)
                        group, chars = [], 0
        if group:
            self._add(group, counts)
        return counts


def counter(path: str) -> TokenCounter:
    """The worker's counter for a vocabulary file, built once per process."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    ship_package(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path).count(texts.tolist()))

    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"), F.pandas_udf(run, "long").asNondeterministic()(whole).alias("n_tokens"))
    return made.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
