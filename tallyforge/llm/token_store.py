"""Token ids in binary shards with a minimal perfect hash index from document keys to places in a shard.

Documents are range-partitioned by key, so that shards, and the documents in a shard, ascend. A shard file holds, one
after the other: the raw ids (little-endian unsigned, of 16 bits where the vocabulary allows it, else of 32), the keys,
the null flags, the offsets of the documents in ids, the index, a JSON footer, the footer's length and a magic number.
A new shard begins after ``SHARD_BYTES`` of ids, or ``SHARD_DOCS`` documents, since a shard's index is built in memory. The index is a hash-and-retry cascade of bit
vectors: a key's place is the rank of the first bit that is its alone. Each place stores a record number and a 32-bit
fingerprint of its key, by which keys that the shard does not hold are refused. A lookup takes constant time.

Files are written under a name of their own and then moved, so a task that is run again leaves the same file. They are
opened with ``pyarrow.fs`` by URI, in the folder that all executors share.

Reading goes through the index: the record of each key is the one that the index names, and a wrong one is an error.

Defined cases: null and empty texts have only the end id; rows with a null key come first and are in the files but not
in the index; repeated keys are ordered by a hash of their texts, the index of each shard has the first of its records,
and the others follow it directly. An empty table gives no shard. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, parts, shuffles_go
from .shingling import mix

MAGIC = b"TFTOKEN1"
GAMMA = 2.0
#: Bytes of ids and documents after which a new shard begins, and ids that are read at once.
SHARD_BYTES = 1 << 28
SHARD_DOCS = 1_000_000
BLOCK_IDS = 1 << 20
#: How byte-level vocabularies of this kind cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.bases = [0, *accumulate(sizes)]
        counts = np.array([int(w).bit_count() for w in bits.tolist()], np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes: list[int] = []
        levels: list[np.ndarray] = []
        left = keys.astype(np.uint64)
        while len(left):
            if len(sizes) > 200:
                raise ValueError("the keys are not distinct")
            size = max(64, int(np.ceil(GAMMA * len(left) / 64)) * 64)
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, np.uint64))

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """A number below the number of keys for each key; -1 where every level shows that it is none of them."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            bit = self.place(keys[todo], level, size) + self.bases[level]
            word, shift = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.bits[word] >> shift) & np.uint64(1) == 1
            word, shift = word[hit], shift[hit]
            below = self.bits[word] & ((np.uint64(1) << shift) - np.uint64(1))
            out[todo[hit]] = self.ranks[word].astype(np.int64) + np.array([x.bit_count() for x in below.tolist()], np.int64)
            todo = todo[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class Encoder:
    """Bytes of the ids of texts, as the tokenizers library encodes them.

    Texts that hold the name of a special token go through that library; all others through tiktoken with the same
    vocabulary, several times as fast. This needs ranks that ascend with the ids, which is checked.
    """

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        from .bpe import byte_alphabet

        self.spec = hash(spec)
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        rules = json.loads(spec)
        vocab, merges = rules["model"]["vocab"], rules["model"]["merges"]
        self.special = [t["content"] for t in rules.get("added_tokens", [])]
        self.kind = "<u2" if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if made != sorted(made) or rules["pre_tokenizer"]["type"] != "ByteLevel" or rules["pre_tokenizer"]["add_prefix_space"] or rules["normalizer"]:
            self.quick = None
        else:
            self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.quick is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return np.frombuffer(array("I", self.quick.encode_ordinary(text)), np.uint32).astype(self.kind).tobytes()


_encoders: dict[int, Encoder] = {}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _index(keys: np.ndarray, nulls: np.ndarray) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
    distinct, first = np.unique(keys[nulls == 0], return_index=True)
    records = np.flatnonzero(nulls == 0)[first]
    mph = PerfectHash.build(distinct)
    slot = mph.lookup(distinct)
    record, prints = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint32)
    record[slot], prints[slot] = records, fingerprints(distinct)
    return mph, record, prints


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes and writes all documents; returns the manifest, a row for each shard: part, no, path, n_docs, n_ids,
    first_key, last_key (null: no key), base (ids in the shards before it)."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary: a few MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _encoders.get(0)
        if encoder is None or encoder.spec != hash(shared.value):
            encoder = _encoders[0] = Encoder(shared.value)
        end = np.array([end_id], encoder.kind).tobytes()
        made: list[dict] = []
        shard = None
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard is None:
                    shard = ShardWriter(folder, part, len(made), encoder.kind)
                shard.add(k, encoder.encode(value.as_py() or "") + end)
                if shard.n_bytes >= shard_bytes or len(shard.keys) >= shard_docs:
                    made.append(shard.close())
                    shard = None
        if shard is not None:
            made.append(shard.close())
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("part", pa.int32()), ("no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]))

    # of equal keys those with different texts may go to different partitions, in a fixed order
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    dealt = rows.repartitionByRange(parts(spark), "k", "h").sortWithinPartitions("k", "h").select("k", "text")
    with shuffles_go(spark):
        made = sorted(dealt.mapInArrow(run, "part int, no int, path string, n_docs long, n_ids long, first_key long, last_key long").collect(), key=lambda r: (r["part"], r["no"]))  # a row for each shard
    bases = [0, *accumulate(r["n_ids"] for r in made)]
    return spark.createDataFrame([(*r, b) for r, b in zip(made, bases, strict=False)], "part int, no int, path string, n_docs long, n_ids long, first_key long, last_key long, base long")


class ShardWriter:
    """One shard file, written under a name of its own and then moved."""

    def __init__(self, folder: str, part: int, no: int, kind: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"shard-{part:06d}-{no:04d}.tok"
        self.final, self.temp, self.path = f"{base}/{name}", f"{base}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}"
        self.sink = self.fs.open_output_stream(self.temp)
        self.part, self.no, self.kind, self.n_bytes = part, no, kind, 0
        self.keys, self.nulls, self.ends = array("q"), bytearray(), array("Q", [0])

    def add(self, key: int | None, raw: bytes) -> None:
        self.sink.write(raw)
        self.n_bytes += len(raw)
        self.keys.append(0 if key is None else key)
        self.nulls.append(key is None)
        self.ends.append(self.n_bytes // np.dtype(self.kind).itemsize)

    def close(self) -> dict:
        keys, nulls, ends = np.array(self.keys, "<i8"), np.frombuffer(self.nulls, np.uint8), np.array(self.ends, "<u8")
        mph, record, prints = _index(keys.view(np.uint64), nulls)
        footer = {"docs": len(keys), "ids": int(ends[-1]), "keys": len(record), "levels": mph.sizes, "kind": self.kind}
        for block in (keys, nulls, ends, mph.bits.astype("<u8"), record.astype("<u8"), prints.astype("<u4")):
            self.sink.write(block.tobytes())
        tail = json.dumps(footer).encode()
        self.sink.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
        self.sink.close()
        self.fs.move(self.temp, self.final)
        real = keys[nulls == 0]
        return {"part": self.part, "no": self.no, "path": self.path, "n_docs": len(keys), "n_ids": int(ends[-1]), "first_key": int(real[0]) if len(real) else None, "last_key": int(real[-1]) if len(real) else None}


class Shard:
    """Keyed access to one shard file; only the index is held in memory."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        n = struct.unpack("<Q", tail[:8])[0]
        foot = json.loads(self.file.read_at(n, size - 16 - n))
        self.n_docs, self.n_ids, self.kind = foot["docs"], foot["ids"], np.dtype(foot["kind"])
        at = self.kind.itemsize * self.n_ids

        def block(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.file.read_at(np.dtype(kind).itemsize * count, at), kind)
            at += out.nbytes
            return out

        self.keys, self.nulls, self.offsets = block("<i8", self.n_docs), block("u1", self.n_docs), block("<u8", self.n_docs + 1).astype(np.int64)
        self.mph = PerfectHash(foot["levels"], block("<u8", sum(foot["levels"]) // 64))
        self.record, self.prints = block("<u8", foot["keys"]).astype(np.int64), block("<u4", foot["keys"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Record numbers of keys, -1 for those that the fingerprints refuse."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.mph.lookup(keys)
        out = np.full(len(keys), -1, np.int64)
        some = slot >= 0
        some[some] = self.prints[slot[some]] == fingerprints(keys[some])
        out[some] = self.record[slot[some]]
        return out

    def read(self, first: int, stop: int) -> np.ndarray:
        """The ids of the records from ``first`` to before ``stop``."""
        a, b = int(self.offsets[first]), int(self.offsets[stop])
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at(size * (b - a), size * a), self.kind)

    def get(self, key: int) -> np.ndarray | None:
        record = int(self.find(np.array([key]))[0])
        return None if record < 0 else self.read(record, record + 1)

    def records(self) -> np.ndarray:
        """The record of each stored document, named by the index: that of its key, plus its place among repeated keys.
        Documents without a key are the first of a shard. Fails where the index names another document's record."""
        out = np.arange(self.n_docs)
        some = np.flatnonzero(self.nulls == 0)
        keys = self.keys[some]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
        found = self.find(keys)
        out[some] = found + np.arange(len(keys)) - first
        if (found < 0).any() or (out[some] >= self.n_docs).any() or (self.keys[out[some]] != keys).any() or self.nulls[out[some]].any():
            raise ValueError("the index does not lead to the documents of its keys")
        return out


class TokenStore:
    """Keyed access over all shards of a manifest."""

    def __init__(self, manifest: DataFrame):
        self.rows = sorted((r for r in manifest.collect() if r["first_key"] is not None), key=lambda r: (r["part"], r["no"]))  # a row for each shard
        self.last_keys = [r["last_key"] for r in self.rows]
        self.open: dict[str, Shard] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key (of a repeated one, of its first document); None if the store does not have it."""
        at = bisect_left(self.last_keys, key)
        if at == len(self.rows) or self.rows[at]["first_key"] > key:
            return None
        path = self.rows[at]["path"]
        if path not in self.open:
            self.open[path] = Shard(path)
        return self.open[path].get(key)


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files, through the index: key, start, n_tokens, ids_crc32, in_index (it has a key)."""
    spark: SparkSession = manifest.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                record = shard.records()
                jumps = np.flatnonzero(np.diff(record) != 1) + 1  # records that follow each other are read at once
                for a, b in zip([0, *jumps.tolist()], [*jumps.tolist(), len(record)], strict=True):
                    while a < b:
                        lo = shard.offsets[record[a]]
                        n = int(np.searchsorted(shard.offsets[record[a] + 1 : record[b - 1] + 2], lo + BLOCK_IDS, side="right"))
                        n = min(max(n, 1), b - a)
                        some = record[a : a + n]
                        ids = shard.read(int(some[0]), int(some[-1]) + 1).astype("<u4", copy=False)
                        begin, stop = shard.offsets[some], shard.offsets[some + 1]
                        raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
                        crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((begin - lo).tolist(), (stop - lo).tolist(), strict=True)]
                        nulls = shard.nulls[some] == 1
                        yield pa.RecordBatch.from_arrays([pa.array(shard.keys[some], pa.int64(), mask=nulls), pa.array(begin + base, pa.int64()), pa.array(stop - begin, pa.int64()), pa.array(crc, pa.int64()), pa.array(~nulls)], names=["doc_id", "start", "n_tokens", "ids_crc32", "in_index"])
                        a += n

    n = max(1, manifest.count())
    dealt = manifest.repartitionByRange(min(n, 4 * parts(spark)), "part", "no").select("path", "base")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, in_index boolean")
