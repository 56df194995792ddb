"""Table maintenance: change feed, keyed tables, lasting ids, cascades,
header-checked scans, factorised products, audits taken while writing."""

from __future__ import annotations

import os
import random
from itertools import product as pairs

import pytest
from conftest import rows
from pyspark.sql import functions as F

from hearthvale.operators import audit, keyed_table
from hearthvale.operators.cascade import deleted_keys
from hearthvale.operators.changes import row_changes
from hearthvale.operators.factorised import Product
from hearthvale.operators.keys import register_ids
from hearthvale.operators.rank_cut import value_at_rank
from hearthvale.operators.topk import all_ties_max, extremes_per_group, rank1_per_group
from hearthvale.schemas import TABLES, Table
from hearthvale.sources.staging import STAGING_COLUMNS, scan_extract


# ---------------------------------------------------------------- change feed
def test_row_changes(spark):
    ddl = "k1 long, k2 string, a string, b long"
    old = spark.createDataFrame([(1, "x", "same", 1), (2, "x", None, 1), (3, "x", "v", 1), (4, None, "gone", None), (5, "x", None, None),
                                 (6, "x", "p", None), (None, None, "n", 1)], ddl)
    new = spark.createDataFrame([(1, "x", "same", 1), (2, "x", "v", 1), (3, "x", None, 1), (5, "x", None, None), (6, "x", None, 7),
                                 (7, "x", None, None), (None, None, "m", 1)], ddl)
    got = sorted(map(tuple, row_changes(old, new, ["k1", "k2"], ["a", "b"]).collect()), key=str)
    assert got == sorted([
        (2, "x", "update", None, 1, "v", 1), (3, "x", "update", "v", 1, None, 1), (4, None, "delete", "gone", None, None, None),
        (6, "x", "update", "p", None, None, 7), (7, "x", "insert", None, None, None, None), (None, None, "update", "n", 1, "m", 1)], key=str)
    assert row_changes(old, old, ["k1", "k2"], ["a", "b"]).count() == 0


# ---------------------------------------------------------------- keyed tables
def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_keyed_update_touches_its_buckets_alone(spark, tmpdir_run):
    path, n = os.path.join(tmpdir_run, "farm"), 16
    farm = spark.range(200).selectExpr("id AS id_farm", "if(id = 11, NULL, id * 2) AS id_player", "'kept' AS other")
    keyed_table.create(farm, path, ["id_farm"], n)
    before = _files(path)
    cand = spark.createDataFrame([(11, 70), (11, 60), (12, 1), (999, 5), (11, None)], "id_farm long, p long")
    touched = keyed_table.fill_missing(spark, path, ["id_farm"], n, "id_player", cand, "p")
    assert len(touched) == 1
    after = _files(path)
    assert len(before - after) == 1 and len(after - before) == 1 and len(before) > 5
    got = {r.id_farm: r.id_player for r in keyed_table.read(spark, path).collect()}
    assert got == {i: 60 if i == 11 else 2 * i for i in range(200)}
    assert keyed_table.fill_missing(spark, path, ["id_farm"], n, "id_player", cand, "p") == [] and _files(path) == after
    plan = keyed_table.rows_of(spark, path, touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_keyed_replace_rows(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "t")
    ddl = "a long, b string, v long"
    keyed_table.create(spark.createDataFrame([(1, "x", 1), (1, None, 2), (2, "y", 3)], ddl), path, ["a", "b"], 4)
    new = spark.createDataFrame([(1, "x", 10), (3, "z", 4)], ddl)
    for _ in range(2):
        keyed_table.replace_rows(spark, path, ["a", "b"], 4, new)
        assert sorted(map(tuple, keyed_table.read(spark, path).collect()), key=str) == [(1, "x", 10), (1, None, 2), (2, "y", 3), (3, "z", 4)]


# ---------------------------------------------------------------- lasting ids
def test_ids_last_over_runs(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "ids")
    one = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string")
    two = spark.createDataFrame([("0",), ("b",), ("z",), (None,)], "name string")
    assert rows(register_ids(one, ["name"], path, 1000).filter("name IS NOT NULL")) == [("a", 1001), ("b", 1002)]
    got = {r.name: r.id for r in register_ids(two, ["name"], path, 1000).collect()}
    assert got == {None: 1000, "b": 1002, "0": 1003, "z": 1004}
    again = {r.name: r.id for r in register_ids(one.unionByName(two), ["name"], path, 1000).collect()}
    assert again == got | {"a": 1001}


# ---------------------------------------------------------------- cascades
def test_cascade_over_diamonds_cycles_and_composite_keys(spark):
    def table(name, pk, fks=(), cascade=()):
        return Table(name, (), pk, fks=fks, cascade=cascade)

    spec = {
        "a": table("a", ("x",)),
        "b": table("b", ("y",), ((("ax",), "a", ("x",)),), ("a",)),
        "c": table("c", ("z",), ((("ax",), "a", ("x",)),), ("a",)),
        "d": table("d", ("y", "z"), ((("y",), "b", ("y",)), (("z",), "c", ("z",))), ("b", "c")),
        "e": table("e", ("i",), ((("y", "z"), "d", ("y", "z")), (("up",), "e", ("i",))), ("d", "e")),
    }
    frames = {
        "a": spark.createDataFrame([(1,), (2,)], "x long"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "y long, ax long"),
        "c": spark.createDataFrame([(20, 1), (21, 2)], "z long, ax long"),
        "d": spark.createDataFrame([(10, 20), (10, 21), (11, 20), (11, 21), (12, 21)], "y long, z long"),
        "e": spark.createDataFrame([(1, 10, 21, 3), (2, 12, 21, None), (3, 11, 21, 1), (4, None, 20, 2), (5, 11, 21, 3)], "i long, y long, z long, up long"),
    }
    gone = deleted_keys(frames, {"a": spark.createDataFrame([(1,), (99,)], "x long")}, spec)
    assert {n: rows(df) for n, df in gone.items()} == {
        "a": [(1,)], "b": [(10,)], "c": [(20,)], "d": [(10, 20), (10, 21), (11, 20)], "e": [(1,), (3,), (5,)]}


# ---------------------------------------------------------------- extracts
def _extract(folder, files):
    os.makedirs(folder)
    for name, lines in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    return folder


def test_columns_come_by_header_name(spark, tmpdir_run):
    folder = _extract(os.path.join(tmpdir_run, "e"), {
        "1.csv": ["DURATION,ID_ACTIVITY,SPECIAL_FACTOR,DESCRIPTION,ID_EVENT,REWARD_ITEM", "30,1,s,\"a, b\",5,9", "31,2,,\"\",5,9"],
        "2.csv": [" id_activity ,NOTE,special_factor,description,duration,id_event,reward_item", "3,n,s,d,32,6,8"]})
    good, bad = scan_extract(spark, "ACTIVITIES", folder)
    got = good.orderBy("ingest_seq").select("ID_ACTIVITY", "DURATION", "DESCRIPTION", "SPECIAL_FACTOR", "REWARD_ITEM").collect()
    assert [tuple(r) for r in got] == [("1", "30", "a, b", "s", "9"), ("2", "31", None, None, "9"), ("3", "32", "d", "s", "8")]
    assert bad.count() == 0
    assert good.columns == [*STAGING_COLUMNS["ACTIVITIES"], "ingest_seq"]


def test_rows_of_another_length_are_quarantined_with_their_place(spark, tmpdir_run):
    head = ",".join(STAGING_COLUMNS["ACTIVITIES"])
    folder = _extract(os.path.join(tmpdir_run, "e"), {"1.csv": [head, "1,s,d,30,5,9", "2,s,d", "3,s,d,30,5,9,more", "4,s,d,30,5,"]})
    good, bad = scan_extract(spark, "ACTIVITIES", folder)
    assert [r.ID_ACTIVITY for r in good.orderBy("ingest_seq").collect()] == ["1", "4"]
    assert good.select("ID_ACTIVITY").count() == 2                          # whatever columns a load reads
    held = bad.orderBy("ingest_seq").collect()
    assert [r.record for r in held] == ["2,s,d", "3,s,d,30,5,9,more"]
    assert all(r.ingest_seq.file.endswith("1.csv") and r.ingest_seq.start == 0 for r in held) and [r.ingest_seq.row for r in held] == [1, 2]


def test_a_missing_column_is_an_error_unless_optional(spark, tmpdir_run):
    folder = _extract(os.path.join(tmpdir_run, "e"), {"1.csv": ["ID_ACTIVITY,SPECIAL_FACTOR,DESCRIPTION,DURATION,ID_EVENT", "1,s,d,30,5"]})
    with pytest.raises(ValueError, match="REWARD_ITEM"):
        scan_extract(spark, "ACTIVITIES", folder)
    good, _ = scan_extract(spark, "ACTIVITIES", folder, optional=["REWARD_ITEM"])
    assert [(r.ID_ACTIVITY, r.REWARD_ITEM) for r in good.collect()] == [("1", None)]


# ---------------------------------------------------------------- products
def test_product_by_its_factors(spark):
    left = [(1, 5), (2, 5), (2, 5), (3, None), (4, 6)]
    right = [(7,), (8,), (8,), (None,)]
    p = Product(spark.createDataFrame(left, "a long, s long"), spark.createDataFrame(right, "q long"))
    every = [(a, s, q) for (a, s), (q,) in pairs(left, right)]
    one = p.one_row().select(p.rows().alias("n"), p.repeated_keys(("a", "q", "s")).alias("r"), p.repeated_keys(("a", "s")).alias("ls"),
                             p.orphans("q", spark.createDataFrame([(7,)], "x long"), "x").alias("o")).first()
    full = [e for e in every if None not in e]
    assert one.n == len(every) and one.r == sum(full.count(e) > 1 for e in set(full))
    firsts = [e[:2] for e in every if None not in e[:2]]
    assert one.ls == sum(firsts.count(e) > 1 for e in set(firsts)) and one.o == sum(e[2] == 8 for e in every)
    assert {r.a: r.n_rows for r in p.totals("a").collect()} == {1: 4, 2: 8, 3: 4, 4: 4}
    asked = spark.createDataFrame([(1, 5, 7), (1, 6, 7), (9, 5, 7), (4, 6, 8), (4, 6, 9)], "a long, s long, q long")
    assert rows(p.holds(asked).select("a", "s", "q")) == [(1, 5, 7), (4, 6, 8)]
    empty = Product(spark.createDataFrame([], "a long, s long"), spark.createDataFrame(right, "q long"))
    assert empty.one_row().select(empty.rows().alias("n"), empty.repeated_keys(("a", "q")).alias("r")).first() == (0, 0)
    assert empty.totals("q").count() == 0


# ---------------------------------------------------------------- ties, extremes, ranks
def test_ties_and_extremes_in_one_pass(spark):
    rnd = random.Random(2)
    data = [(rnd.choice("abc") if i % 3 else "hot", rnd.choice([None, 1, 2, 3, 4]) if i % 7 else rnd.randint(0, 5), i) for i in range(400)]
    data += [("one", 5, 1000), ("none", None, 1001)]
    df = spark.createDataFrame(data, "g string, v long, i long")
    groups = {g: [r for r in data if r[0] == g] for g in {r[0] for r in data}}
    def best(rs):
        nulls = [r for r in rs if r[1] is None]
        return nulls or [r for r in rs if r[1] == max(x[1] for x in rs)]
    assert rows(rank1_per_group(df, ["g"], "v").select("i")) == sorted((r[2],) for rs in groups.values() for r in best(rs))
    known = {g: [r for r in rs if r[1] is not None] for g, rs in groups.items()}
    want = sorted((r[2],) for rs in known.values() for r in rs if r[1] in (max(x[1] for x in rs), min(x[1] for x in rs)))
    assert rows(extremes_per_group(df, ["g"], "v").select("i")) == want
    top = max(r[1] for r in data if r[1] is not None)
    assert rows(all_ties_max(df, "v").select("i")) == sorted((r[2],) for r in data if r[1] == top)
    assert all_ties_max(df.filter("g = 'none'"), "v").count() == 0
    plan = rank1_per_group(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Exchange") == 1


def test_rank_cut_by_sketch_and_counts(spark):
    rnd = random.Random(8)
    cases = [[rnd.gauss(0, 1) for _ in range(3000)], [float(rnd.randint(0, 3)) for _ in range(3000)], [1.0] * 500 + [2.0] * 500,
             [float(i) for i in range(1000)] + [None] * 200, [None] * 10, [5.0]]
    for vals in cases:
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        ordered = sorted(v for v in vals if v is not None)
        for num in (1, 37, 50, 97, 100):
            at = -(-len(vals) * num // 100)
            want = ordered[at - 1] if at <= len(ordered) else None
            assert value_at_rank(df, "v", num, 100, accuracy=20, few=8).first().cut == want, (len(vals), num)


def test_rank_cut_shuffles_no_histogram(spark):
    df = spark.range(50_000).selectExpr("cast(hash(id) as decimal(18,2)) AS v")
    exact = df.selectExpr("percentile_disc(0.97) WITHIN GROUP (ORDER BY v) AS p").first().p
    cut = value_at_rank(df, "v", 97, 100)
    assert cut.first().cut == exact
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


# ---------------------------------------------------------------- audits
def test_audit_while_writing_equals_the_audit(spark, tmpdir_run):
    def made(name, data):
        return spark.createDataFrame(data, TABLES[name].struct().simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))

    tables = {
        "festivity": made("festivity", [(1, "a" * 120, "TRUE"), (2, "b", "no"), (2, "b", None), (None, "c", "FALSE")]),
        "activity": made("activity", [(1, "x", None, 5, 1), (2, None, None, 5, 7), (3, "y", None, None, None)]),
        "compose": made("compose", [(1, 1), (1, 1), (9, 2), (3, None)]),
        "character": made("character", [(1, "n", 3, "f", None), (2, "m", 4, "m", 8)]),
        "relationship": made("relationship", [(1, 1, 2, 5, "Friend"), (2, 1, 2, 6, "Friend"), (3, 2, 2, 1, "x" * 31), (4, 1, 5, 1, None)]),
        "buy_sell": made("buy_sell", []),
    }
    written, report = audit.audit_while_writing(tables, os.path.join(tmpdir_run, "w"))
    want = {(r.table_name, r.rule, r.kind): r.violations for r in audit.audit(tables).collect()}
    assert report == want and sum(want.values()) >= 12
    assert {n: df.count() for n, df in written.items()} == {n: df.count() for n, df in tables.items()}
    assert {tuple(r)[:3]: r.violations for r in audit.report_frame(spark, report).collect()} == want


def test_load_audit_covers_every_table_and_equals_the_audit(spark, tmpdir_run):
    from hearthvale.plans import loads
    from hearthvale.sources.staging_bridge import staging_from_tables
    from hearthvale.sources.testdata import TestTables

    out = os.path.join(tmpdir_run, "load")
    loads.run(spark, staging_from_tables(TestTables(spark, "/root/testdata/sf0.001")), out)
    got = {(r.table_name, r.rule, r.kind): r.violations for r in loads.audited(spark, out).collect()}
    tables = {n: loads._empty(spark, n) for n in TABLES} | loads.published(spark, out)
    assert {k[0] for k in got} == set(TABLES)
    assert got == {(r.table_name, r.rule, r.kind): r.violations for r in audit.audit(tables).collect()}
    assert F is not None
