"""Licence scan with a positional index of rare words (DataFrame functions only).

``TEMPLATES`` are short licence notices, ``BASE`` phrases that must stand word
for word. Document frequencies of the notices' words are counted over the
whole corpus. A template's posting words are its words of highest IDF, as many
as carry more than the share of IDF that a match may lack, so every match
holds one of them; a base phrase's posting word is its rarest one. In each
file the positions of posting words are looked up, every posting gives a start
(position in the file less position in the template), and the alignment at
that start is weighed by the IDF of the words that agree. A template counts
when the weight reaches ``MIN_SCORE`` of the whole and its mandatory phrase
agrees in full. All of it happens within the row: no shuffle but the counts.

Edge cases: a null or empty text has no words, empty labels and score 0; null
keys and repeated rows are kept as they are; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.llm.common import text_of

# Phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# label, notice, mandatory phrase within it.
TEMPLATES = [
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("epl-2.0", "licensed under the eclipse public license version 2 0", "eclipse public license"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("public-domain", "this work has been released into the public domain", "into the public domain"),
]
MIN_SCORE = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words: digits, letters, and all that is not ASCII."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def vocabulary() -> list[str]:
    return sorted({w for p in BASE for w in p.split()} | {w for _, notice, _ in TEMPLATES for w in notice.split()})


def word_idf(words: DataFrame, n_docs: int) -> dict[str, float]:
    """IDF of the vocabulary over all rows of ``words`` (column ``words``)."""
    vocab = vocabulary()
    hit = F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in vocab])))
    df = {r["w"]: r["n"] for r in words.select(hit.alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: math.log(1 + (1 + n_docs) / (1 + df.get(w, 0))) for w in vocab}


def postings(idf: dict[str, float]) -> list[dict]:
    """One entry per posting word and place in its phrase or notice."""
    out = []
    for phrase, label in BASE.items():
        ws = phrase.split()
        at = max(range(len(ws)), key=lambda i: (idf[ws[i]], -i))
        out.append({"word": ws[at], "rel": at, "label": label, "base": True, "words": ws,
                    "share": [1.0 / len(ws)] * len(ws), "must": list(range(len(ws)))})
    for label, notice, key in TEMPLATES:
        ws, ks = notice.split(), key.split()
        total = sum(idf[w] for w in ws)
        begin = next(i for i in range(len(ws)) if ws[i:i + len(ks)] == ks)
        held = 0.0
        for at in sorted(range(len(ws)), key=lambda i: (-idf[ws[i]], i)):
            out.append({"word": ws[at], "rel": at, "label": label, "base": False, "words": ws,
                        "share": [idf[w] / total for w in ws], "must": list(range(begin, begin + len(ks)))})
            held += idf[ws[at]] / total
            if held > 1 - MIN_SCORE + 1e-9:
                break
    return out


def _posting_literal(p: dict) -> Column:
    return F.struct(F.lit(p["word"]).alias("word"), F.lit(p["rel"]).alias("rel"), F.lit(p["label"]).alias("label"),
                    F.lit(p["base"]).alias("base"), F.array(*[F.lit(w) for w in p["words"]]).alias("words"),
                    F.array(*[F.lit(s) for s in p["share"]]).alias("share"),
                    F.array(*[F.lit(i) for i in p["must"]]).alias("must"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, matches, n_base, first_word, last_word, base_labels,
    labels, score``; ``matches`` holds label, start word, kind and weight of
    every place found."""
    rows = docs.select(docs[id_col].alias("doc_id"), words_of(text_of(docs, text_col)).alias("words"))
    entries = postings(word_idf(rows, docs.count()))
    index = F.array(*[_posting_literal(p) for p in entries])
    rare = F.array(*[F.lit(w) for w in sorted({p["word"] for p in entries})])

    def agrees(start: Column, j: Column, ws: Column) -> Column:
        """Whether word ``j`` of a notice stands at its place in the file."""
        return F.coalesce(F.get("words", start + j) == F.get(ws, j), F.lit(False))

    def weigh(e: Column, start: Column) -> Column:
        weight = F.aggregate(F.sequence(F.lit(0), F.size(e["words"]) - 1), F.lit(0.0),
                             lambda s, j: s + F.when(agrees(start, j, e["words"]), F.get(e["share"], j)).otherwise(0.0))
        must = F.forall(e["must"], lambda j: agrees(start, j, e["words"]))
        return F.struct(e["label"].alias("label"), start.alias("start"), e["base"].alias("base"),
                        F.when(must, F.round(F.least(weight, F.lit(1.0)), 9)).otherwise(0.0).alias("weight"))

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(rare, F.get("words", i)))
    found = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(index, lambda e: e["word"] == F.get("words", i)), lambda e: weigh(e, i - e["rel"]))))
    found = F.array_distinct(F.filter(found, lambda m: m["weight"] >= F.lit(MIN_SCORE)))
    none = F.filter(F.transform(F.array(index[0]), lambda e: weigh(e, F.lit(0))), lambda m: F.lit(False))
    scanned = rows.select("doc_id", F.size("words").cast("long").alias("n_words"),
                          F.when(F.arrays_overlap("words", rare), found).otherwise(none).alias("matches"))
    base = F.filter("matches", lambda m: m["base"])

    def labels(ms: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")

    return scanned.select(
        "doc_id", "n_words", "matches", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["weight"])), F.lit(0.0)).alias("score"))
