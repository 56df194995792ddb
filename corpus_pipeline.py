"""The corpus pipeline: each stage works on all that its predecessor kept.

``run`` applies the stages to ``documents``; every stage's result is written
as Parquet in the shared folder and read again as the next stage's documents.
All stages but the last return the columns of ``documents``:

1. toxicity: documents predicted toxic go;
2. line dedup: a source's boilerplate lines go, ``n_chars`` follows the text;
3. SimHash near-dedup: one document of each group stays;
4. decontamination: documents that hold a benchmark item go;
5. packing: what is left, as pieces of sequences of 4096 token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.llm import decontaminate, line_dedup, packing, queries, simhash, toxicity
from hearthvale.llm.common import staged, table

# Share of a source's documents from which a line is boilerplate, at every size.
# Measured: the line that stands in all sources 0.086 to 0.134 (sf0.1, check_s),
# the next ones and the lines of large groups of copies up to 0.063 (check_h).
LINE_RATIO = 0.075


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model, score="__score").filter("__score < 0.5").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(docs, F.col("source"), F.col("text"), LINE_RATIO)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries._tokenizer("word_bpe_49k.json"), "word", 2, 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Learned scores, fingerprints, alignment and token ids have no SQL form here;
# tests/llm compares every stage with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
