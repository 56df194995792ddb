"""Toxicity by nearest labelled examples.

At most ``SAMPLE`` labelled texts of either class (those of smallest key hash)
are the examples. Words and their first ``PREFIXES`` bytes (forms of one stem
share them) that are at least ``LIFT`` times as frequent in toxic texts become
terms, at most ``TERMS`` by chi-square. Document frequencies of the terms are counted over
all documents. Examples form an inverted index over exact TF-IDF cosine, in
blocks of ``BLOCK`` examples with the largest weight of each term per block: a
document's upper bound for a block is the sum over its terms, and blocks are
scored, best bound first, until the bound falls below the ``K``-th best
cosine. The ``K`` nearest vote with the square of their cosine; a logistic fit
of the examples' own votes (each left out of its own) turns votes into
probabilities, with the classes weighted as in all labels.

Edge cases: a null, empty or term-free text gets the share of toxic examples
among term-free ones; without labels of both classes every score is the share
of toxic labels (0 if there are none); null labels and keys are not learned
from; a key labelled twice counts as toxic if one label says so; an empty
table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import ship, small, staged, text_of
from hearthvale.llm.tokens import portions
from hearthvale.llm.wordhash import WORDS, mix, runs

SAMPLE, TERMS, BLOCK, K = 4000, 2048, 64, 15
AT_ONCE = 16         # blocks scored together
PREFIXES, LIFT, MIN_CHI2 = (4, 5), 8.0, 20.0
PORTION = 2 << 20    # bytes of text worked on at a time
_TABLE = 1 << 20     # direct look-up table before the exact look-up


def word_forms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of every word, then of the prefixes of longer words, for
    one portion of the texts after the other."""
    for p in portions(texts, PORTION):
        words, start, end, cut, data = runs(texts[p], WORDS)
        text = np.repeat(np.arange(p.start, p.stop), np.diff(cut))
        yield words, text
        for size in PREFIXES:
            at = np.flatnonzero(end - start > size)
            h, first = np.full(len(at), size, np.uint64), start[at]
            with np.errstate(over="ignore"):
                for j in range(size):
                    byte = data[first + j]
                    h = h * np.uint64(0x100000001B3) + np.where((byte >= 65) & (byte < 91), byte + 32, byte)
                yield mix(h), text[at]


class Terms:
    """Finds the terms of texts."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.table = np.zeros(_TABLE, bool)
        self.table[(self.hashes & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences), sorted by text and term."""
        size, keys = len(self.hashes), [np.empty(0, np.int64)]
        for words, text in word_forms(texts):
            at = np.flatnonzero(self.table[(words & np.uint64(_TABLE - 1)).astype(np.int64)])
            words, text = words[at], text[at]
            term = np.searchsorted(self.hashes, words)
            hit = term < size
            hit[hit] = self.hashes[term[hit]] == words[hit]
            keys.append(text[hit] * (size + 1) + term[hit])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // (size + 1), key % (size + 1), n


class BlockMaxIndex:
    """Examples as unit TF-IDF vectors, by term, in blocks of examples."""

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n_examples: int, n_terms: int):
        self.n, self.blocks = n_examples, -(-n_examples // BLOCK)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        key = term[order] * self.blocks + self.example // BLOCK
        # Where the postings of each (term, block) begin.
        self.begin = np.searchsorted(key, np.arange(n_terms * self.blocks + 1))
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, key, self.weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the ``k`` highest cosines above 0 (ties: smaller
        number), but for ``without``."""
        bound = weight @ self.most[term]
        order = np.argsort(-bound, kind="stable")
        best, score, floor, at = np.empty(0, np.int64), np.empty(0), 0.0, 0
        while at < len(order):
            blocks = order[at:at + AT_ONCE]
            blocks = blocks[(bound[blocks] > 0) & (bound[blocks] >= floor - 1e-12)]
            if not len(blocks):
                break                            # bounds fall from here on
            at += AT_ONCE
            cell = (term[:, None] * self.blocks + blocks).ravel()
            size = self.begin[cell + 1] - self.begin[cell]
            rows = np.repeat(self.begin[cell] - np.cumsum(size) + size, size) + np.arange(size.sum())
            sums = np.bincount(self.example[rows], np.repeat(np.repeat(weight, len(blocks)), size) * self.weight[rows], self.n)
            here = np.flatnonzero(sums > 0)
            here = here[here != without]
            best, score = np.concatenate([best, here]), np.concatenate([score, sums[here]])
            keep = np.lexsort((best, -np.round(score, 12)))[:k]
            best, score = best[keep], score[keep]
            if len(best) == k:
                floor = score[-1]
        return best, score


def unit(term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[term]
    return w / np.sqrt((w * w).sum())


class Model:
    """The fitted votes; a few hundred kilobytes, bounded by the parameters."""

    def __init__(self, hashes, idf, ids, toxic, example, term, count, share):
        self.terms, self.idf, self.ids, self.toxic = Terms(hashes), idf, ids, toxic.astype(float)
        self.seen: dict[bytes, tuple] = {}
        self.share = share                       # toxic share among all labels
        n = len(ids)
        by = np.searchsorted(example, np.arange(n + 1))
        weight = np.zeros(len(term))
        for i in range(n):
            s = slice(by[i], by[i + 1])
            if s.stop > s.start:
                weight[s] = unit(term[s], count[s], idf)
        self.index = BlockMaxIndex(example, term, weight, n, len(idf)) if n and len(idf) else None
        # Votes of the examples without themselves, weighted to the labels' shares.
        ones = max(self.toxic.sum(), 1e-9)
        self.worth = np.where(self.toxic > 0, share / ones, (1 - share) / max(n - self.toxic.sum(), 1e-9)) * n
        plain = np.flatnonzero(by[1:] == by[:-1])
        self.plain = float(((self.worth * self.toxic)[plain].sum() + share) / (self.worth[plain].sum() + 1))
        rest = np.flatnonzero(by[1:] > by[:-1])
        self.fit = np.zeros(3)
        if self.index is not None and len(rest):
            x = np.array([self.vote(*self.index.nearest(term[by[i]:by[i + 1]], weight[by[i]:by[i + 1]], K, i)) for i in rest])
            self.fit = logistic(x, self.toxic[rest], self.worth[rest])

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
        """Toxic share of the neighbours' votes, shrunk to the corpus share,
        and the best toxic cosine."""
        w = cosine ** 2 * self.worth[near]
        y = self.toxic[near]
        return float(((w * y).sum() + 0.05 * self.share) / (w.sum() + 0.05)), float((cosine * y).max(initial=0.0))

    def score(self, texts: pa.Array, explain: bool = True) -> tuple[np.ndarray, list[list]]:
        out, evidence = np.full(len(texts), self.plain), [[]] * len(texts)
        if self.index is None:
            return np.full(len(texts), self.share), evidence
        text, term, n = self.terms.find(texts)
        begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
        for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(text)]):
            key = term[b:e].tobytes() + n[b:e].tobytes()
            if key not in self.seen:
                if len(self.seen) > 2_000:
                    self.seen.clear()
                near, cosine = self.index.nearest(term[b:e], unit(term[b:e], n[b:e], self.idf), K)
                p = 1 / (1 + np.exp(-np.clip(self.fit @ np.r_[1.0, self.vote(near, cosine)], -30, 30)))
                self.seen[key] = float(p), [{"example": int(self.ids[i]), "cosine": float(c)}
                                            for i, c in zip(near, cosine)] if explain else []
            out[text[b]], evidence[text[b]] = self.seen[key]
        return out, evidence


def logistic(x: np.ndarray, y: np.ndarray, worth: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (worth * (p - y)) + ridge * b
        h = (x * (worth * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def examples(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str,
             sample: int) -> tuple[DataFrame, float]:
    """``doc_id, y, text`` of at most ``sample`` labelled texts of either class,
    and the share of label 1 among all labels that may be learned from."""
    known = (labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("y")))
    known = staged(known, "labels")
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    rows = texts.join(small(chosen, 2 * sample), "doc_id")
    return staged(rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "examples"), share


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """``learn``: which rows of ``labels`` may be learned from."""
    spark = docs.sparkSession
    ship(spark)
    rows, share = examples(docs, labels, learn, id_col, text_col, label_col, sample)

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in portions(b.column(1), PORTION):
                found = list(word_forms(b.column(1)[p]))
                words, text = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((words, text))
                words, text = words[order], text[order]
                new = np.r_[True, (words[1:] != words[:-1]) | (text[1:] != text[:-1])][:len(words)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[p].take(pa.array(text[new])), pa.array(words[new].view(np.int64))], names=["y", "h"])

    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    hashes = np.empty(0, np.uint64)
    if n1 and n0:
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        n = float(n1 + n0)
        chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / (F.lit(float(n1)) * n0 * (a + b) * (n - a - b + 1e-9))
        top = (rows.select("y", "text").mapInArrow(distinct_words, "y int, h long").groupBy("h")
               .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter(F.col("a") * n0 >= LIFT * n1 * F.col("b"))
               .withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "h").limit(TERMS))
        hashes = np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(np.uint64))
    terms = Terms(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(hashes), np.int64), 0
        for b in batches:
            n += len(b)
            if len(hashes):
                df += np.bincount(terms.find(b.column(0))[1], minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.flatnonzero(df), -1]), pa.array(np.r_[df[df > 0], n])], names=["t", "n"])

    counted = {r["t"]: r["n"] for r in docs.select(text_of(docs, text_col).alias("text")).mapInArrow(count, "t long, n long")
               .groupBy("t").agg(F.sum("n").alias("n")).collect()}                     # one row per term
    idf = np.log(1 + counted.get(-1, 0) / np.array([1 + counted.get(i, 0) for i in range(len(hashes))], float)) if len(hashes) else np.empty(0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, term, n = terms.find(b.column(2)) if len(hashes) else (np.empty(0, np.int64),) * 3
            cut = np.searchsorted(text, np.arange(len(b) + 1))
            lists = [pa.array([v[x:y].tolist() for x, y in zip(cut, cut[1:])], pa.list_(pa.int64())) for v in (term, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "y", "t", "n"])

    kind = dict(rows.dtypes)["doc_id"]
    got = rows.select("doc_id", "y", "text").mapInArrow(vectors, f"doc_id {kind}, y int, t array<long>, n array<long>")
    got = sorted(got.collect(), key=lambda r: r["doc_id"])              # at most 2 x SAMPLE rows of TERMS terms
    flat = lambda c: np.array([x for r in got for x in r[c]], np.int64)
    example = np.repeat(np.arange(len(got)), [len(r["t"]) for r in got])
    return Model(hashes, idf, [r["doc_id"] for r in got], np.array([r["y"] for r in got]), example, flat("t"), flat("n"), share)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score",
                evidence: str | None = None) -> DataFrame:
    """``docs`` with the probability, and if named, the neighbours behind it."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score: double, evidence: array<struct<example: long, cosine: double>>>")
    def with_evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p, near = held.value.score(pa.array(texts, pa.large_string(), from_pandas=True))
            yield pd.DataFrame({"score": p, "evidence": near})

    @F.arrow_udf("double")
    def alone(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score(texts, explain=False)[0])

    if not evidence:
        return docs.withColumn(score, alone(text_of(docs, text_col)))
    out = docs.withColumn("__toxic", with_evidence(text_of(docs, text_col)))
    return out.withColumns({score: F.col("__toxic.score"), evidence: F.col("__toxic.evidence")}).drop("__toxic")
