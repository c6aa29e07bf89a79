"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token the last token of its encoding is unique. The token is found among
the vocabulary entries that end at that position (all reported by one suffix automaton) as the one
that is compatible with the stored last token of the prefix before it. The pre-token's ids are the
back-pointers followed from its end.

Edge cases: null and empty text have no tokens; special token strings in a text become their id, as
the tokenizers library does; repeated documents are each encoded; texts of any length are encoded whole,
a text in one task; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import by_slices, ship_package

#: Entries of the pre-token cache in one Python worker; it is emptied when full, and dropped with a task.
CACHE_ENTRIES = 200_000

_codecs: dict[str, "BpeCodec"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    """Vocabulary, automaton and pair test of one byte-level BPE file."""

    #: Fixed pattern of the byte-level pre-tokenizer.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    #: The same for texts of code points below U+0100 alone, whose classes can be listed.
    LATIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\t-\r \x85\xa0]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        as_bytes = lambda token: bytes(symbol[c] for c in token)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *specials.values()]) + 1
        self.token_bytes = [b""] * n
        for t, i in vocab.items():
            self.token_bytes[i] = t
        for t, i in specials.items():
            self.token_bytes[i] = t.encode()
        self.specials = specials
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.any_pieces = regex.compile(self.PATTERN).findall
        self.latin_pieces = re.compile(self.LATIN_PATTERN).findall

        never = len(spec["model"]["merges"])
        self.merge_rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, merge if isinstance(merge, list) else merge.split(" "))
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[left, right] = rank
            parts.setdefault(whole, (left, right, rank))
        self.parts, self.never = parts, never
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}

        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.vocab = vocab
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries
        self.pack = [struct.Struct(f"<{k}I").pack for k in range(32)]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at the left (0) or right (1) edge of a token while it grew, each with the rank at
        which a merge inside the token consumed it."""
        found = self.spines.get((token, side))
        if found is None:
            found, t = [(token, self.never)], token
            while t in self.parts:
                rank = self.parts[t][2]
                t = self.parts[t][side]
                found.append((t, rank))
            self.spines[token, side] = found
        return found

    def stays_apart(self, first: int, second: int) -> bool:
        """Whether BPE of the two tokens' joint bytes is these two tokens.

        It is not when some merge joins an edge token of the first with an edge token of the second
        before either has been consumed inside its own token; at equal rank the left merge goes first.
        """
        rank_of, left_edges = self.merge_rank.get, self.spine(second, 0)
        for a, used_a in self.spine(first, 1):
            for b, used_b in left_edges:
                rank = rank_of((a, b))
                if rank is not None and rank < used_a and rank <= used_b:
                    return False
        return True

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token, from the last token of each of its prefixes."""
        n, known, n_tokens = len(raw), self.compatible, len(self.token_bytes)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(raw.decode("latin-1")):
            end += 1
            if size[end]:
                continue  # found already: it is unique
            start = end - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                apart = known.get(before * n_tokens + token)
                if apart is None:
                    if len(known) >= self.cache_entries:
                        known.clear()
                    apart = known[before * n_tokens + token] = self.stays_apart(before, token)
                if not apart:
                    continue
            last[end], size[end] = token, length
        ids, at = [], n
        while at > 0:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces(text)
        return self.latin_pieces(text)

    def encode_plain(self, text: str) -> bytes:
        cache, pieces = self.cache, self.pieces(text)
        packed = list(map(cache.get, pieces))
        if None in packed:
            for i, known in enumerate(packed):
                if known is None:
                    ids = self.encode_piece(pieces[i].encode())
                    packed[i] = self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, "<u4").tobytes()
                    if len(cache) >= self.cache_entries:
                        cache.clear()
                    if len(pieces[i]) <= 64:
                        cache[pieces[i]] = packed[i]
        return b"".join(packed)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special_split is None or not any(s in text for s in self.specials):
            return self.encode_plain(text)
        return b"".join(np.array([self.specials[x]], "<u4").tobytes() if x in self.specials else self.encode_plain(x) for x in self.special_split.split(text) if x)

    def decode(self, ids: bytes) -> str:
        token = self.token_bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec(path: str) -> BpeCodec:
    """The worker's codec for a vocabulary file, built once per task."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def forget(path: str) -> None:
    """Drop the worker's codec with its caches; to build it again takes a second."""
    _codecs.pop(path, None)


def _per_text(docs: DataFrame, text: str, vocabulary: str | None, run, schema: str, *types: pa.DataType) -> DataFrame:
    """doc_id and the fields of the schema, whose values ``run`` gives for a codec and some texts; ids never pass through Python."""
    ship_package(docs.sparkSession)
    path, names = vocabulary or default_vocabulary(), [x.split()[0] for x in schema.split(", ")]

    def structs(texts: list[str | None]) -> pa.Array:
        columns = run(codec(path), texts)
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    made = F.arrow_udf(by_slices(structs, lambda: forget(path)), schema).asNondeterministic()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), made(F.col(text).cast("string")).alias("made")).select("doc_id", "made.*")


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers."""

    def run(c: BpeCodec, texts: list[str | None]) -> tuple[list, ...]:
        ids = [c.encode(t) for t in texts]
        return [len(x) // 4 for x in ids], ids, [c.decode(x) for x in ids]

    return _per_text(docs, text, vocabulary, run, "n_tokens long, ids binary, decoded string", pa.int64(), pa.binary(), pa.string())


def encode_digests(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The same work as :func:`encode_documents`, with digests instead of ids and decoded text."""

    def run(c: BpeCodec, texts: list[str | None]) -> tuple[list, ...]:
        ids = [c.encode(t) for t in texts]
        return [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]

    return _per_text(docs, text, vocabulary, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", pa.int64(), pa.string(), pa.string())
