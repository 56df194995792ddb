"""Packing: concatenate and cut.

Documents are joined end to end in the order of their input partitions and cut
into windows of ``seq_len`` ids, so only the last window can be short. Two
passes give the global offsets: the first encodes each text, writes its ids
with the running offset inside its partition, and totals each partition; the
prefix sums of those totals turn local offsets into global ones. The second
pass cuts every document at the window borders and emits one record per piece
(the boundary records). Nothing is shuffled.

Edge cases: a null text is empty and yields the end id alone; a null key is
kept as null; repeated rows are separate documents; an empty table gives no
pieces; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, small, staged, text_of
from hearthvale.llm.tokens import encoder, portions, widen

OUT_BYTES = 8 << 20  # ids sent on at a time


def encode_documents(docs: DataFrame, tokenizer: str, mode: str, end_id: int = 2,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass: ``doc_id, ids, width, n, part, local_start`` per row, written
    to the shared folder. ``ids`` are ``width``-byte little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer, mode, end_id), TaskContext.get().partitionId(), 0
        width = enc.dtype.itemsize
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for p in portions(texts):
                ids = enc.encode(texts[p])
                n = pc.binary_length(ids).to_numpy() // width
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [keys[p], ids.cast(pa.binary()), pa.array(np.full(len(ids), width, np.int32)), pa.array(n), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)],
                    names=["doc_id", "ids", "width", "n", "part", "local_start"])

    ship(docs.sparkSession)
    pairs = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return staged(pairs.mapInArrow(run, "doc_id long, ids binary, width int, n long, part int, local_start long"), "ids")


def partition_offsets(encoded: DataFrame) -> tuple[DataFrame, int]:
    """Global start of each input partition: one row per partition."""
    totals = sorted(encoded.groupBy("part").agg(F.sum("n").alias("n")).collect())   # one row per input partition
    bases = accumulate((r["n"] for r in totals), initial=0)
    rows = [(r["part"], base) for r, base in zip(totals, bases)]
    return encoded.sparkSession.createDataFrame(rows, "part int, base long"), len(rows)


def pack(docs: DataFrame, tokenizer: str, mode: str = "word", end_id: int = 2, seq_len: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit; ``start`` counts the document's
    ids before the piece, ``offset`` is its place in the sequence.
    """
    encoded = encode_documents(docs, tokenizer, mode, end_id, id_col, text_col)
    offsets, rows = partition_offsets(encoded)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        out, held = [], 0
        for b in batches:
            for key, ids, width, n, begin in zip(*(b.column(i).to_pylist() for i in range(5))):
                ids, at = widen(ids, np.dtype(f"<u{width}")), 0
                while at < n:
                    seq, off = divmod(begin + at, seq_len)
                    size = min(seq_len - off, n - at)
                    out.append((key, at, size, ids[4 * at:4 * (at + size)], n, seq, off))
                    at += size
                    held += 4 * size
                    if held >= OUT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    placed = encoded.join(small(offsets, rows), "part").select(
        "doc_id", "ids", "width", "n", (F.col("base") + F.col("local_start")).alias("begin"))
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, "
                                  "sequence_id long, offset long")
