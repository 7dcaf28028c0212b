"""Token ids in sorted-string-table shards.

A shard holds documents in key order in compressed blocks.  Inside a block each
key names only what differs from the key before it.  After the blocks follow a
sparse index (first key, place and size of each block), a Bloom filter of all
keys and a footer, so that one document is found by a binary search in the
index and one block.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import FEW, cut, scratch_path

MAGIC = b"TMSST001"
#: Bytes of a block before compression, bits of the filter per key, hashes per key.
BLOCK, FILTER_BITS, FILTER_HASHES = 1 << 18, 10, 7
#: Ids and documents from which a shard ends; bytes of the input a task, about; rows that are given on at once.
SHARD_TOKENS, SHARD_DOCUMENTS, TASK_BYTES, PORTION = 1 << 27, 1 << 20, 1 << 27, 1 << 16
_FOOTER = struct.Struct("<QQQQQQ8s")
#: Marks that often follow a word.
MARKS = ".,;:!?"
#: Words whose ids a worker remembers.
REMEMBERED = 1_500_000


def key_bytes(key: int | None) -> bytes:
    """Keys as bytes in the order of the numbers, null first."""
    return b"\0" if key is None else b"\1" + struct.pack(">Q", (int(key) + (1 << 63)) & ((1 << 64) - 1))


def key_number(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at, n, shift = at + 1, n | (b & 127) << shift, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    one, two = h & ((1 << 64) - 1), h >> 64 | 1
    return [(one + i * two) % bits for i in range(FILTER_HASHES)]


class Writer:
    """Writes one shard to a binary file; keys must come in order, equal keys are allowed."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.at, self.block, self.first, self.last = out, 0, bytearray(), None, b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.last = key, b""
        elif key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) << 1 | wide) + key[shared:] + ids.astype("<u4" if wide else "<u2").tobytes()
        self.last, self.tokens = key, self.tokens + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        if self.first is not None:
            packed = self.pack(bytes(self.block))
            self.index.append((self.first, self.at, len(packed)))
            self.out.write(packed)
            self.at, self.block, self.first = self.at + len(packed), bytearray(), None

    def close(self) -> None:
        self._end_block()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index)
        bits = max(64, FILTER_BITS * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom) + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.tokens, MAGIC))


class Reader:
    """Reads a shard from a random-access file."""

    def __init__(self, file: BinaryIO, size: int) -> None:
        self.file = file
        index_at, index_size, bloom_at, bloom_size, self.count, self.tokens, magic = _FOOTER.unpack(self._bytes(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index, at, self.index = self._bytes(index_at, index_size), 0, []
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            place, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.index.append((key, place, length))
        self.firsts = [k for k, _, _ in self.index]
        self.bloom = self._bytes(bloom_at, bloom_size)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(size))

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, length = self.index[i]
        data, at, key = self.unpack(self._bytes(place, length)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + more], at + more
            kind = np.dtype("<u4" if n & 1 else "<u2")
            yield key, np.frombuffer(data, kind, n >> 1, at).astype("<u4")
            at += (n >> 1) * kind.itemsize

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom)))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The values of a key: none, one, or several where the key was repeated."""
        out: list[np.ndarray] = []
        if self.may_have(key):
            at = max(0, bisect_right(self.firsts, key) - 1)
            while at > 0 and self.firsts[at] == key:
                at -= 1
            for i in range(at, len(self.index)):
                if self.firsts[i] > key:
                    break
                out += [ids for k, ids in self._block(i) if k == key]
        return out

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)


class Encoder:
    """Ids of whole texts from a tokenizers file with a byte-level pre-tokenizer.

    Such a tokenizer never joins what stands on both sides of the start of a run
    of white space.  So texts are cut there, and the ids of each piece (white
    space and the word after it) are remembered.
    """

    #: White space as the tokenizer's own expression has it: not the separators 1C to 1F.
    PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by what follows one space, or by a line feed and what follows

    def _learn(self, into: dict[str, bytes], pieces: list[str], prefix: str) -> None:
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            whole = [p if p[0] == "\n" else prefix + p for p in part]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
                into[p] = array("I", e.ids).tobytes()

    @staticmethod
    def _regular(part: str) -> bool:
        """Whether the part of a text between spaces, or before a line feed, neither starts nor ends in more white space."""
        return part != "" and not part[-1].isspace() and (not part[0].isspace() or (part[0] == "\n" and not part[1].isspace()))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 256):  # what some texts lack is encoded at once
            if len(self.known) + len(self.spaced) > REMEMBERED:
                self.known.clear()
                self.spaced.clear()
            plans: list[tuple[list[str], list[str], list[bytes | None]]] = []
            spaced, known = set(), set()
            for text in texts[at : at + 256]:
                first, *rest = text.replace("\n", " \n").split(" ")
                ids = list(map(self.spaced.get, rest))
                lacking = [p for p, x in zip(rest, ids, strict=True) if x is None] if None in ids else []
                if first and not first[0].isspace() and not first[-1].isspace() and all(map(self._regular, lacking)):
                    plans.append(([first], rest, ids))
                    spaced.update(lacking)
                else:
                    plans.append((self.PIECE.findall(text), [], []))
                known.update(p for p in plans[-1][0] if p not in self.known)
            # letters and one mark after them are never joined: the letters alone often are known already
            marked = {p for p in spaced if p[-1] in MARKS and p[:-1].isalpha()}
            stems = {p[:-1] for p in marked}
            self._learn(self.spaced, [p for p in (spaced - marked) | stems if p not in self.spaced], " ")
            self._learn(self.known, [p for p in {*known, *(p[-1] for p in marked)} if p not in self.known], "")
            self.spaced.update((p, self.spaced[p[:-1]] + self.known[p[-1]]) for p in marked)
            for pieces, rest, ids in plans:
                if None in ids:
                    ids = [self.spaced[p] if x is None else x for p, x in zip(rest, ids, strict=True)]
                yield np.frombuffer(b"".join([*map(self.known.__getitem__, pieces), *ids]), "<u4")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def open_shard(uri: str) -> Reader:
    """A shard by its address: a path or a URI of a store that pyarrow reads."""
    store, path = fs.FileSystem.from_uri(uri)
    return Reader(store.open_input_file(path), store.get_file_info(path).size)


def _bytes_of(df: DataFrame) -> int:
    """The size of a table's files by Spark's own statistics; 0 where it knows none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents, in key order over the shards; (shard, path, documents, tokens, first, last) for each shard.

    ``folder`` must be shared by all executors.  A task takes about 128 MB of the
    input, and a shard ends at some 134 million ids or a million documents, so
    what a task holds (a block, and its shard's keys for the filter) has a bound,
    whatever the table.  It writes to a name of its own and then moves the file to
    the shard's name, so a task that is run again leaves whole files.  Null texts count as empty and get the end id alone;
    null keys come first; repeated keys stay, ordered by a hash of their text.
    """

    def shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, encoder, number = TaskContext.get(), _encoder(tokenizer), 0
        store, top = fs.FileSystem.from_uri(folder)
        out, first, last, file, name = None, None, None, None, ""

        def ended() -> pd.DataFrame:
            out.close()
            file.close()
            store.move(f"{top}/{name}.{task.taskAttemptId()}", f"{top}/{name}")
            return pd.DataFrame({"shard": [task.partitionId() << 20 | number], "path": [f"{folder}/{name}"], "documents": [len(out.keys)], "tokens": [out.tokens], "first": pd.array([first], "Int64"), "last": pd.array([last], "Int64")})

        for frame in frames:
            keys = [None if pd.isna(k) else int(k) for k in frame["k"]]
            for key, ids in zip(keys, encoder.encode(list(frame["t"])), strict=True):
                if out is not None and (out.tokens >= SHARD_TOKENS or len(out.keys) >= SHARD_DOCUMENTS):
                    yield ended()
                    out, number = None, number + 1
                if out is None:
                    store.create_dir(top, recursive=True)
                    name = f"shard-{task.partitionId():06d}-{number:06d}.sst"
                    file = store.open_output_stream(f"{top}/{name}.{task.taskAttemptId()}")
                    out, first = Writer(file), key
                out.add(key_bytes(key), np.append(ids, np.uint32(end_id)))
                last = key
        if out is not None:
            yield ended()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(text_col, F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    tasks = -(-_bytes_of(docs) // TASK_BYTES)  # more than the session's where the table is large
    order = (tasks, "k", "h") if tasks > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ("k", "h")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions("k", "h").select("k", "t")
    return cut(ranged.mapInPandas(shards, "shard long, path string, documents long, tokens long, first long, last long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"], strict=True):
                rows = []
                for key, ids in open_shard(path):
                    rows.append((key_number(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) >= PORTION:
                        yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

    before = F.sum("tokens").over(W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = shards.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    dealt = placed.repartition(max(1, shards.count()), "path")
    return dealt.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, ids) for the wanted keys that the shards hold: each shard is asked for the keys in its range.

    Which shards these are is found by binary search in the shards' ranges, which
    go to all tasks where they are few (400,000 shards hold some 5e13 ids);
    beyond that keys and ranges are joined.
    """
    spark = shards.sparkSession
    wanted = keys.select(F.col(key_col).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    held = shards.select("path", F.coalesce("first", F.lit(-(1 << 63))).alias("first"), F.coalesce("last", F.lit(-(1 << 63))).alias("last"))
    if shards.limit(FEW + 1).count() <= FEW:
        ranges = held.toPandas().sort_values(["first", "last"])
        shared = spark.sparkContext.broadcast((list(ranges["path"]), ranges["first"].to_numpy(np.int64), ranges["last"].to_numpy(np.int64)))

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            paths, first, last = shared.value
            for frame in frames:
                key = frame["key"].to_numpy(np.int64)
                low, high = np.searchsorted(last, key, "left"), np.searchsorted(first, key, "right")
                count = np.maximum(high - low, 0)
                at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield pd.DataFrame({"key": np.repeat(key, count), "path": [paths[i] for i in at.tolist()]})

        placed = wanted.mapInPandas(place, "key long, path string")
    else:
        placed = wanted.join(held, F.col("key").between(F.col("first"), F.col("last"))).select("key", "path")

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, asked in frame.groupby("path")["key"]:
                shard = open_shard(path)
                rows = [(k, ids.tolist()) for k in asked for ids in shard.get(key_bytes(k))]
                yield pd.DataFrame(rows, columns=["key", "ids"])

    return placed.repartition("path").mapInPandas(find, "key long, ids array<long>")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards of all documents and return the rows read back from them; see write_shards and read_shards.

    An empty table writes no shard and gives an empty result.
    """
    folder = folder or scratch_path(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, folder, tokenizer, end_id, id_col, text_col))
