"""Nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthvale.llm import decontaminate, licenses, line_dedup, packing, passages, quality, queries, simhash, topk, toxicity

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, fp string, score string, words string"


def odd_documents(spark):
    long = "word " * 60_000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "x"), (5, "x"), (None, "no key"), (6, "no\x00key"), (7, "a" * 300_000)]
    return spark.createDataFrame([(i, t, None, None if i == 5 else "s", None, "h", "f", "s", "w") for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(spark):
    bench = spark.createDataFrame([(1, "some words of a benchmark item"), (2, None), (None, "")], "item_id long, text string")
    learn = F.lit(True)
    lab = labels(spark, [(1, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (4, 0, 0)])
    tok = queries._tokenizer("word_bpe_49k.json")
    return {
        "packing": lambda d: packing.pack(d, tok),
        "passages": lambda d: passages.shared_passages(d),
        "licenses": lambda d: licenses.scan(d),
        "leaks": lambda d: decontaminate.leaks(d, bench, ["doc_id"], F.col("text")),
        "clean": lambda d: decontaminate.clean(d, bench),
        "simhash": lambda d: simhash.near_duplicates(d),
        "keep_one": lambda d: simhash.keep_one(d),
        "toxicity": lambda d: toxicity.with_scores(d, toxicity.fit(d, lab, learn), score="score"),
        "line_dedup": lambda d: line_dedup.drop_boilerplate(d, F.col("source"), F.col("text")),
        "quality": lambda d: quality.with_scores(d, quality.fit(d, lab, learn), score="score"),
    }


ONE_PER_ROW = {"licenses", "simhash", "toxicity", "line_dedup", "quality", "clean", "packing"}
NAMES = ["packing", "passages", "licenses", "leaks", "clean", "simhash", "keep_one", "toxicity", "line_dedup", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    docs = odd_documents(spark)
    got = operators(spark)[name](docs).collect()
    if name in ONE_PER_ROW - {"packing"}:
        assert len(got) == docs.count()
    if name == "packing":
        assert {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, None} and len(got) >= 9
    if name in ("toxicity", "quality"):
        assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_topk_of_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, id string, v string")
    assert topk.top_products(empty, F.col("id") % 50 == 0, 5).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, 1, 1), (4, 1, 1)]])
def test_labels_of_one_class_or_none(spark, rows):
    docs, lab = odd_documents(spark), labels(spark, rows)
    share = 1.0 if rows else 0.0
    for module in (toxicity, quality):
        got = module.with_scores(docs, module.fit(docs, lab, F.lit(True)), score="score").collect()
        assert {r.score for r in got} == {share}


def test_stages_on_odd_rows(spark):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd_documents(spark).select(*cols, F.lit("extra").alias("score"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.collect()
        if name != "packing":
            assert out.columns == docs.columns, name
