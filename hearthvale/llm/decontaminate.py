"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

Every gram of a benchmark item is a seed, whatever its frequency. A copy whose
changed or dropped words leave it ``min_score`` holds a run of as many item
words as ``gram_size`` says (4 for items of 16 words or more, 2 to 4 for
shorter ones), and that is the item's gram length, so each such copy has a
seed; inserted words can break runs further. One pass over the documents keeps
the words around places whose gram passes a fixed-size Bloom filter of the
benchmark's grams; exact joins follow, and pairs of passage and item are made
distinct. A pair is aligned by Smith-Waterman over words (match 2, mismatch
and gap -1) unless the passage lacks too many of the item's words for any
alignment; the score is the share of the item's words matched in the best
alignment.

Edge cases: null or empty texts match nothing; equal items and repeated rows
are scored each; null keys are kept; an empty table gives no rows; other
columns are ignored by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, staged, text_of
from hearthvale.llm.wordhash import grams, word_hashes

GRAM, MIN_SCORE = 4, 0.8
BLOOM_BITS = 1 << 24      # 2 MB, whatever the size of the benchmark
_UNIT = 1 << 24           # alignment score in high digits, matched words in low ones


def gram_size(n: int, min_score: float = MIN_SCORE) -> int:
    """Words in a row that any copy of an ``n``-word item keeps when changed or
    dropped words leave it ``min_score``; ``GRAM`` at most."""
    changed = int((1 - min_score) * n + 1e-9)
    return max(1, min(GRAM, -(-(n - changed) // (changed + 1))))


def _places(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = g.view(np.uint64)
    return (u % np.uint64(BLOOM_BITS)).astype(np.int64), (u >> np.uint64(40)).astype(np.int64)


def item_words(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, item, n, words`` per row: ``item`` numbers the rows, ``words`` are hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, cut = word_hashes(b.column(1))
            words = [h[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(cut)), pa.array(words, pa.binary())],
                                             names=["item_id", "n", "words"])

    rows = bench.select(F.col(id_col).alias("item_id"), text_of(bench, text_col).alias("text"))
    kind = dict(rows.dtypes)["item_id"]
    return staged(rows.mapInArrow(run, f"item_id {kind}, n long, words binary")
                  .withColumn("item", F.monotonically_increasing_id()), "items")


def item_grams(items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``item, g`` of every distinct gram."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = np.frombuffer(words, np.uint64)
                g = np.unique(grams(w, gram_size(len(w), min_score)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), item, np.int64)), pa.array(g)], names=["item", "g"])

    return staged(items.select("item", "words").mapInArrow(run, "item long, g long"), "item-grams")


def bloom(g: DataFrame) -> np.ndarray:
    """The filter as packed bits, joined from one filter per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            for p in _places(b.column(0).to_numpy()):
                bits[p] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in g.select("g").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():      # 8 rows of 2 MB at most
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def passages(docs: DataFrame, id_cols: list[str], text: Column, bits: np.ndarray, lengths: list[int], reach: int) -> DataFrame:
    """``id_cols, passage, begin, words, g``: the words within ``reach`` of
    possible seeds, one row per stretch, with the seeds' grams."""
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(np.unpackbits(bits), bitorder="little"))
    rows = docs.select(*id_cols, text.alias("__text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            h, cut = word_hashes(b.column(len(id_cols)))
            found = []
            for k in lengths:
                g = grams(h, k)
                ok = np.ones(len(g), bool)
                for p in _places(g):
                    ok &= (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(ok)
                doc = np.searchsorted(cut, at, side="right") - 1
                inside = at + k <= cut[doc + 1]
                found.append((doc[inside], at[inside], g[at[inside]]))
            doc, at, g = (np.concatenate(x) for x in zip(*found))
            if not len(doc):
                continue
            order = np.argsort(at, kind="stable")
            doc, at, g = doc[order], at[order], g[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)])
            last = np.r_[new[1:], len(at)]
            begin = np.maximum(at[new] - reach, cut[doc[new]])
            end = np.minimum(at[last - 1] + reach + GRAM, cut[doc[new] + 1])
            ids = [b.column(i).take(pa.array(doc[new])) for i in range(len(id_cols))]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(begin - cut[doc[new]]), pa.array([h[i:j].tobytes() for i, j in zip(begin, end)], pa.binary()),
                 pa.array([g[i:j].tolist() for i, j in zip(new, last)], pa.list_(pa.int64()))],
                names=[*id_cols, "begin", "words", "g"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in id_cols), "begin long, words binary, g array<long>"])
    return staged(rows.mapInArrow(run, schema).withColumn("passage", F.monotonically_increasing_id()), "passages")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment: (matched words, end in ``text``). Cells hold the
    score and, below it, the matched words of the best path."""
    slope = np.arange(len(text) + 1, dtype=np.int64) * _UNIT
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        cell = np.maximum(row - _UNIT, 0)
        cell[1:] = np.maximum(cell[1:], row[:-1] + np.where(text == w, 2 * _UNIT + 1, -_UNIT))
        row = np.maximum.accumulate(cell + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best % _UNIT, end


def leaks(docs: DataFrame, bench: DataFrame, id_cols: list[str], text: Column, min_score: float = MIN_SCORE,
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_cols, item_id, score, begin, end_word``: every document passage that
    holds a benchmark item; words count from 0."""
    ship(docs.sparkSession)
    items = item_words(bench, item_id, item_text)
    seeds = item_grams(items, min_score)
    size = items.agg(F.max("n").alias("most")).first()["most"] or 0
    lengths = sorted({gram_size(r["n"], min_score) for r in items.filter("n > 0").select("n").distinct().collect()})
    places = passages(docs, id_cols, text, bloom(seeds), lengths or [GRAM], size + size // 4 + GRAM)

    hits = places.select("passage", *id_cols, F.explode(F.array_distinct("g")).alias("g"))
    pairs = hits.select("passage", "g").join(seeds, "g").select("passage", "item").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column("item_words").to_pylist(), b.column("words").to_pylist()):
                i, t = np.frombuffer(i, np.uint64), np.frombuffer(t, np.uint64)
                held = int(np.isin(i, t).sum())                      # no alignment matches more
                out.append(align(i, t) if held / max(len(i), 1) >= min_score else (0, 0))
            n = np.array([m for m, _ in out], np.float64) / np.maximum(b.column("n").to_numpy(), 1)
            keep = pa.array(n >= min_score)
            end = pa.array(np.array([e for _, e in out], np.int64) + b.column("begin").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in id_cols), b.column("item_id"), pa.array(n), b.column("begin"), end],
                names=[*id_cols, "item_id", "score", "begin", "end_word"]).filter(keep)

    work = (pairs.join(items.withColumnRenamed("words", "item_words"), "item").join(places.drop("g"), "passage")
            .select(*id_cols, "item_id", "n", "item_words", "begin", "words"))
    kinds = dict(work.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in id_cols),
                        f"item_id {kinds['item_id']}, score double, begin long, end_word long"])
    return work.mapInArrow(run, schema)


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item. The verdict is
    of the text, so texts are named by two 64-bit hashes."""
    text = text_of(docs, text_col)
    keyed = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(7), text)})
    bad = leaks(keyed, bench, ["__h1", "__h2"], text_of(keyed, text_col)).select("__h1", "__h2").distinct()
    return keyed.join(staged(bad, "contaminated"), ["__h1", "__h2"], "left_anti").select(*docs.columns)
