"""Every stage of the pipeline against a plain version over its own input."""

import numpy as np
import pytest

import corpus_pipeline
from hearthvale.llm import queries, simhash
from hearthvale.llm.common import staged

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SMALL), "test-stage")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_toxicity_stage_keeps_what_is_not_predicted_toxic(spark, steps):
    before, after = steps["toxicity"]
    scored = queries.op7_toxicity(spark, SMALL)
    assert ids(after) == {r.doc_id for r in scored.collect() if not r.predicted}


def test_line_stage_drops_frequent_lines_alone(steps):
    before, after = steps["line dedup"]
    rows, kept = before.collect(), {r.doc_id: r for r in after.collect()}
    pages, counts = {}, {}
    for r in rows:
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {x.strip(" ") for x in r.text.split("\n")} - {""}:
            counts[r.source, line] = counts.get((r.source, line), 0) + 1
    for r in rows:
        want = "\n".join(x for x in r.text.split("\n") if not (
            x.strip(" ") and counts[r.source, x.strip(" ")] >= 5 and counts[r.source, x.strip(" ")] > 0.2 * pages[r.source]))
        assert kept[r.doc_id].text == want and kept[r.doc_id].n_chars == len(want)


def test_line_stage_drops_the_common_line_and_leaves_clean_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, docs, d).collect()}
    pages, counts = {}, {}
    rows = docs.collect()
    for r in rows:
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {x.strip(" ") for x in r.text.split("\n")} - {""}:
            counts[r.source, line] = counts.get((r.source, line), 0) + 1
    bad = {k for k, n in counts.items() if n >= 5 and n > corpus_pipeline.LINE_RATIO * pages[k[0]]}
    changed = 0
    for r in rows:
        want = "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)
        assert kept[r.doc_id].text == want
        changed += want != r.text
    assert len(kept) == len(rows) and 100 <= changed <= 0.2 * len(rows)


def test_simhash_stage_keeps_the_smallest_of_each_group(steps):
    before, after = steps["simhash near-dedup"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    f = np.array([simhash.fingerprint(r.text) for r in rows], np.uint64)
    group = list(range(len(f)))
    changed = True
    while changed:
        changed = False
        for i in range(len(f)):
            low = min(group[j] for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3))
            if low < group[i]:
                group[i], changed = low, True
    assert ids(after) == {rows[g].doc_id for g in set(group)}


def test_decontamination_stage_drops_whole_items(spark, steps):
    before, after = steps["benchmark decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before.collect() if any(i in r.text for i in items)}
    assert leaked and not leaked & ids(after) and ids(after) == ids(before) - leaked


def test_packing_stage_holds_every_token(steps):
    before, after = steps["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == ids(before)
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


@pytest.mark.parametrize("name,least", [("op7_toxicity", 0.7), ("op10_quality", 0.9)])
def test_held_out_accuracy(spark, name, least):
    d = "/root/testdata/sf0.01"
    column = {"op7_toxicity": "toxic", "op10_quality": "quality"}[name]
    got = queries.QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got[column]).mean() >= least and got.score.between(0, 1).all()
