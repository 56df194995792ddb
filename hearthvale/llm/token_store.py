"""Token-ID files with a minimal perfect hash index.

``write_store`` range-partitions documents by key, so shard ``i`` holds the
``i``-th key range in ascending order, and every task writes one shard:

* ``*.bin``  raw ids, little-endian, two bytes each when the vocabulary fits;
* ``*.idx``  row offsets, and a minimal perfect hash over the shard's distinct
  keys whose slot holds a 32-bit fingerprint, the key's first row and its
  number of copies (copies lie side by side).

``manifest`` (Parquet, one file) names the files of the committed task attempts
only, with each shard's key range and totals; files of failed attempts are never
read. ``read_keys`` routes each asked key by the manifest to its shards (a key
with very many copies may span several) and reads its ids through the index.

Files go through ``pyarrow.fs`` by the URI of the shared folder.

Edge cases: a null text is empty (the end id alone); rows with a null key come
first and are read under the null key; equal keys are ordered by a hash of
their text, and all copies come back; an absent key gives no row (false hits
have probability 2^-32); an empty table gives an empty store.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, text_of
from hearthvale.llm.packing import OUT_BYTES
from hearthvale.llm.tokens import encoder, portions, widen

MAGIC = b"HVTOKEN1"
GAMMA = 2.0      # bits per remaining key at each level of the hash
HEAD = struct.Struct("<8sIIQQQI")   # magic, id width, levels, rows, keys, null rows, 0


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mixer (distinct keys never collide on all levels)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash: a key takes, at the first level where it falls on
    a position of its own, the rank of that position."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels                                     # packed bits, 64 positions a word
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct, as uint64."""
        levels: list[np.ndarray] = []
        while len(keys):
            words = max(1, int(np.ceil(GAMMA * len(keys) / 64)))
            pos = mix(keys, len(levels)) % np.uint64(64 * words)
            alone = np.bincount(pos.astype(np.int64), minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[pos.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that certainly is not in the set."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            pos = mix(keys[left], level) % np.uint64(64 * len(bits))
            word, bit = (pos >> np.uint64(6)).astype(np.int64), pos & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out


def pack_index(width: int, keys: np.ndarray, nulls: int, offsets: np.ndarray) -> bytes:
    """``keys``: the shard's non-null keys in ascending order, after ``nulls``
    null rows; ``offsets``: ids before each row, and the total."""
    distinct, first, copies = np.unique(keys, return_index=True, return_counts=True)
    u = distinct.astype(np.int64).view(np.uint64)
    ph = PerfectHash.build(u)
    slot = ph.slots(u)
    fp, row, n = np.zeros(len(u), "<u4"), np.zeros(len(u), "<u8"), np.zeros(len(u), "<u8")
    fp[slot], row[slot], n[slot] = fingerprints(u), first + nulls, copies
    head = HEAD.pack(MAGIC, width, len(ph.levels), len(offsets) - 1, len(u), nulls, 0)
    sizes = np.array([len(x) for x in ph.levels], "<u8").tobytes()
    return b"".join([head, sizes, *(x.tobytes() for x in ph.levels), fp.tobytes(), row.tobytes(), n.tobytes(),
                     offsets.astype("<u8").tobytes()])


class Shard:
    """One shard opened for keyed reads."""

    def __init__(self, files: fs.FileSystem, stem: str):
        with files.open_input_stream(f"{stem}.idx") as f:
            raw = f.read()
        magic, self.width, levels, rows, keys, self.nulls, _ = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError(f"{stem}.idx is no index of this format")
        at = HEAD.size

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(raw, kind, n, at)
            at += a.nbytes
            return a

        self.ph = PerfectHash([take(int(n), "<u8") for n in take(levels, "<u8")])
        self.fp, self.row, self.copies = take(keys, "<u4"), take(keys, "<u8"), take(keys, "<u8")
        self.offsets = take(rows + 1, "<u8").astype(np.int64)
        self.ids = files.open_input_file(f"{stem}.bin")

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of those keys that are here: place in ``keys``, first row, copies."""
        u = keys.astype(np.int64).view(np.uint64)
        slot = self.ph.slots(u)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.fp[slot[hit]] == fingerprints(u[hit])]
        return hit, self.row[slot[hit]].astype(np.int64), self.copies[slot[hit]].astype(np.int64)

    def read(self, row: int) -> bytes:
        a, b = int(self.offsets[row]) * self.width, int(self.offsets[row + 1]) * self.width
        self.ids.seek(a)
        return widen(self.ids.read(b - a), np.dtype(f"<u{self.width}"))

    def close(self) -> None:
        self.ids.close()


def write_store(docs: DataFrame, path: str, tokenizer: str, mode: str = "byte", end_id: int = 2,
                shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` into the token files under ``path`` (a shared folder)."""
    spark = docs.sparkSession
    ship(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc, files, at = encoder(tokenizer, mode, end_id), *fs.FileSystem.from_uri(path)
        name = f"shard-{task.partitionId():06d}-{uuid.uuid4().hex}"
        keys, sizes, nulls, out = [], [], 0, None
        for b in batches:
            if out is None:
                files.create_dir(at, recursive=True)
                out = files.open_output_stream(f"{at}/{name}.bin")
            k = b.column(0)
            nulls += k.null_count
            keys.append(k.drop_null().to_numpy(zero_copy_only=False))
            for p in portions(b.column(1)):
                ids = enc.encode(b.column(1)[p])
                n = pc.binary_length(ids).to_numpy()
                sizes.append(n // enc.dtype.itemsize)
                first = int(np.frombuffer(ids.buffers()[1], np.int64, 1, 8 * ids.offset)[0])
                out.write(memoryview(ids.buffers()[2])[first:first + int(n.sum())])
        if out is None:
            return
        out.close()
        key, size = np.concatenate(keys), np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(size)])
        with files.open_output_stream(f"{at}/{name}.idx") as f:
            f.write(pack_index(enc.dtype.itemsize, key, nulls, offsets))
        low, high = (int(key[0]), int(key[-1])) if len(key) else (None, None)
        row = [task.partitionId(), name, len(size), int(offsets[-1]), nulls, low, high]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)],
                                         names=["shard", "name", "rows", "tokens", "nulls", "low", "high"])

    pairs = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    (pairs.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .mapInArrow(write, "shard int, name string, rows long, tokens long, nulls long, low long, high long")
     .repartition(1)       # a row per shard; Spark starts processes (chmod) in the executor for each file that a task writes
     .write.mode("errorifexists").parquet(f"{path.rstrip('/')}/manifest"))


def read_keys(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` for each distinct key of ``keys``, one
    row per stored copy; ``start`` counts all ids before it in the store."""
    ship(spark)
    manifest = sorted(spark.read.parquet(f"{path.rstrip('/')}/manifest").collect())   # one row per shard
    names = [r["name"] for r in manifest]
    bases = list(accumulate((r["tokens"] for r in manifest), initial=0))
    with_nulls = [i for i, r in enumerate(manifest) if r["nulls"]]
    ranged = [i for i, r in enumerate(manifest) if r["low"] is not None]
    low = np.array([manifest[i]["low"] for i in ranged], np.int64)
    high = np.array([manifest[i]["high"] for i in ranged], np.int64)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(path)
        opened: dict[int, Shard] = {}

        def shard(i: int) -> Shard:
            if i not in opened:
                for old in opened.values():
                    old.close()
                opened.clear()
                opened[i] = Shard(files, f"{at}/{names[i]}")
            return opened[i]

        def found(b: pa.RecordBatch):
            k = b.column(0)
            if k.null_count:
                for i in with_nulls:
                    s = shard(i)
                    for row in range(s.nulls):
                        yield i, s, None, row
            key = np.sort(k.drop_null().to_numpy(zero_copy_only=False))
            for i in range(*_touched(low, high, key)):
                mine = key[np.searchsorted(key, low[i]):np.searchsorted(key, high[i], side="right")]
                if len(mine):
                    s = shard(ranged[i])
                    for p, row, copies in zip(*(x.tolist() for x in s.rows_of(mine))):
                        for c in range(copies):
                            yield ranged[i], s, int(mine[p]), row + c

        out, held = [], 0
        for b in batches:
            for i, s, key, row in found(b):
                ids = s.read(row)
                out.append((key, bases[i] + int(s.offsets[row]), len(ids) // 4, ids))
                held += len(ids)
                if held >= OUT_BYTES:
                    yield _batch(out, kinds)
                    out, held = [], 0
        if out:
            yield _batch(out, kinds)
        for s in opened.values():
            s.close()

    asked = keys.select(keys[key_col].cast("long").alias("doc_id")).distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (asked.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))


def _touched(low: np.ndarray, high: np.ndarray, key: np.ndarray) -> tuple[int, int]:
    """Shards (in key order) whose range can hold one of the sorted keys."""
    if not len(key) or not len(low):
        return 0, 0
    return int(np.searchsorted(high, key[0])), int(np.searchsorted(low, key[-1], side="right"))


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                      names=["doc_id", "start", "n_tokens", "ids"])
