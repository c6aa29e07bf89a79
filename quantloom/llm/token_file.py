"""Token files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file is a sequence of zstandard frames, each holding whole documents; a skippable frame with the
document index; and the public zstd seekable-format table (compressed size, raw size, and the low 32
bits of XXH64 of the raw bytes, for every frame before it). Any zstd reader can read the whole file;
:func:`read_documents` reads the table and the index and decompresses only the frames it needs.

Documents are range-partitioned by doc_id, each partition writes one file, and the manifest (one row
per file) gives their order. A task names its file anew in every attempt and returns that name, so
what a lost or repeated attempt left behind is never read.

Edge cases: null and empty text have the end id alone; repeated doc_ids keep all their rows, ordered
by a hash of the text; a null doc_id comes first; texts of any length are taken whole; other columns are
not looked at; an empty table gives no file.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import new_path, ship_package, written

END_ID = 2
#: Raw bytes after which a frame is closed.
FRAME_BYTES = 256 * 1024
#: Entries of a worker's cache of encoded pieces; it is emptied when full.
CACHE_ENTRIES = 1_500_000

#: Fixed values of the zstd seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_FOOTER, CHECKSUM_FLAG = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("frame", "<u4"), ("at", "<u8"), ("n", "<u8")])
MANIFEST = "file_no int, path string, n_docs long, n_tokens long"

_encoders: dict[str, "PieceEncoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """The tokenizers library, asked once for every piece between spaces that it must see.

    The vocabulary's rules drop white space and never look across it, so the ids of a text are those
    of its pieces. Pieces of plain Latin letters, digits and punctuation are cut further, at the
    points where the rules cut them; all others go to the library as they are.
    """

    plain = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff0-9!-&(-/:-@\[-`{-~]+").fullmatch
    runs = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+").findall

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.item = "<u2" if self.library.get_vocab_size() <= 65536 else "<u4"
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            pieces = text.replace("\n", " ").split(" ") if text else []
            packed = list(map(self.cache.get, pieces))
            if None in packed:
                self.fill(pieces, packed)
            out.append(b"".join(packed))
        return out

    def fill(self, pieces: list[str], packed: list[bytes | None]) -> None:
        """Put the ids of the pieces that the cache did not have."""
        at = [i for i, ids in enumerate(packed) if ids is None]
        cut = {p: self.runs(p.lower()) if self.plain(p) and "<|" not in p else [p] for p in {pieces[i] for i in at}}
        known = {r: self.cache.get(r) for runs in cut.values() for r in runs}
        unknown = [r for r, ids in known.items() if ids is None]
        for r, e in zip(unknown, self.library.encode_batch_fast(unknown, add_special_tokens=False)):
            known[r] = np.array(e.ids, self.item).tobytes()
        whole = {p: b"".join([known[r] for r in runs]) for p, runs in cut.items()}
        for i in at:
            packed[i] = whole[pieces[i]]
        if len(self.cache) + len(unknown) + len(whole) > self.cache_entries:
            self.cache.clear()
        for new in ({r: known[r] for r in unknown}, whole):
            if len(self.cache) + len(new) <= self.cache_entries:
                self.cache.update((p, ids) for p, ids in new.items() if len(p) <= 64)


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class FrameWriter:
    """Writes one file; documents are given in order."""

    def __init__(self, sink, item: str, frame_bytes: int = FRAME_BYTES):
        self.sink, self.item, self.frame_bytes = sink, np.dtype(item), frame_bytes
        self.pending: list[bytes] = []
        self.pending_bytes = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.n_tokens = 0
        self.compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.item.itemsize
        self.index.append((doc_id or 0, doc_id is None, len(self.table), self.pending_bytes // self.item.itemsize, n))
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        self.n_tokens += n
        if self.pending_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            frame = self.compress(raw)
            self.sink.write(frame)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self.flush()
        payload = struct.pack("<B", self.item.itemsize) + self.compress(np.array(self.index, INDEX).tobytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(payload)) + payload)
        entries = [*self.table, (len(payload) + 8, 0, xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.sink.close()


class FrameReader:
    """Random access to one file: ``source`` needs ``seek``, ``read`` and ``size()``."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flag, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        body = self._at(end - 9 - 12 * n - 8, 12 * n + 8)
        if struct.unpack("<II", body[:8]) != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(body[8:], "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0].astype("int64"))])
        payload = self._at(int(self.starts[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        self._check(payload, n - 1)
        self.item = {2: "<u2", 4: "<u4"}[payload[0]]
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[1:]), INDEX)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _check(self, raw: bytes, frame: int) -> None:
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[frame, 2]:
            raise ValueError(f"checksum of frame {frame} does not match")

    def frame(self, k: int) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        self._check(raw, k)
        return np.frombuffer(raw, self.item)

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids), for all or the wanted documents, frame by frame."""
        at, ids = -1, None
        for doc_id, null_id, frame, start, n in self.index.tolist():
            if wanted is None or (not null_id and doc_id in wanted):
                if frame != at:
                    at, ids = frame, self.frame(frame)
                yield (None if null_id else doc_id), ids[start : start + n]


def open_file(path: str, mode: str = "r"):
    store, inner = pafs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if mode == "r" else store.open_output_stream(inner, compression=None)


def write_token_files(docs: DataFrame, folder: str | None = None, text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest (one row per file)."""
    spark = docs.sparkSession
    ship_package(spark)
    path, target = vocabulary or default_vocabulary(), folder or new_path(spark, "tokens")
    if "://" not in target:
        target = f"file://{target}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        no, writer, name, n_docs = TaskContext.get().partitionId(), None, "", 0
        for pdf in batches:
            if writer is None:
                enc = encoder(path)
                end = np.array([end_id], enc.item).tobytes()
                store, inner = pafs.FileSystem.from_uri(target)
                store.create_dir(inner, recursive=True)
                name = f"{target}/part-{no:06d}-{uuid.uuid4().hex[:8]}.tok.zst"
                writer = FrameWriter(open_file(name, "w"), enc.item, frame_bytes)
            for key, ids in zip(pdf["key"], enc.encode(pdf["text"].tolist())):
                writer.add(None if key is None else int(key), ids + end)
            n_docs += len(pdf)
        if writer:
            writer.close()
            yield pd.DataFrame({"file_no": [no], "path": [name], "n_docs": [n_docs], "n_tokens": [writer.n_tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return written(ordered.select(F.col("doc_id").cast("string").alias("key"), "text").mapInPandas(run, MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Digests of every document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    files = manifest.orderBy("file_no").collect()  # one row per file
    starts = np.concatenate([[0], np.cumsum([f.n_tokens for f in files])]).tolist()
    plan = spark.createDataFrame([(f.path, s) for f, s in zip(files, starts)], "path string, start long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, start in zip(pdf["path"], pdf["start"]):
                with open_file(path) as source:
                    rows, at = [], int(start)
                    for doc_id, ids in FrameReader(source).documents():
                        rows.append((None if doc_id is None else str(doc_id), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["key", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["key", "start", "n_tokens", "ids_crc32"])

    spread = plan.repartition(max(1, len(files)))
    return spread.mapInPandas(run, "key string, start long, n_tokens long, ids_crc32 long").select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")
