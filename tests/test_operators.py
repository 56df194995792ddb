"""Operator-level fixtures: dedupe variants, canonical edges, null-safe
matches, surrogate keys, audit, pair search and rank cut equivalences."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from hearthvale.operators.audit import audit
from hearthvale.operators.dedupe import append_new, first_row_per_key
from hearthvale.operators.edges import canonical_edges
from hearthvale.operators.keys import assign_ids
from hearthvale.operators.pairs import closest_pair_sums
from hearthvale.operators.rank_cut import value_at_rank
from hearthvale.schemas import TABLES


def test_first_row_variants(spark):
    # key 1: first row lacks the required value; key 2: complete
    df = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (2, 3, "y"), (2, 4, "z")],
                               "k long, seq long, v string")
    before = rows(first_row_per_key(df, ["k"], "seq", ["v"], "before"))
    after = rows(first_row_per_key(df, ["k"], "seq", ["v"], "after"))
    none = rows(first_row_per_key(df, ["k"], "seq", ["v"], "none"))
    assert before == [(1, 2, "x"), (2, 3, "y")]
    assert after == [(2, 3, "y")]
    assert none == [(1, 1, None), (2, 3, "y")]


def test_append_new_is_idempotent(spark):
    tgt = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2")], "k long, v string")
    first = append_new(new, tgt, ["k"])
    assert rows(first) == [(2, "b"), (2, "b2")]          # duplicates inside `new` are kept
    after = tgt.unionByName(first)
    assert append_new(new, after, ["k"]).count() == 0     # reload adds nothing


def test_canonical_edges(spark):
    raw = spark.createDataFrame([(1, 2, 5), (2, 1, 9), (3, 3, 1), (1, 99, 4)], "a long, b long, w long")
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(canonical_edges(raw, "a", "b", "w", known)) == [(1, 2, 9)]


def test_assign_ids_contiguous_in_key_order(spark):
    names = spark.createDataFrame([(f"n{i:04d}",) for i in random.Random(1).sample(range(5000), 1200)], "name string")
    out = assign_ids(names, ["name"], "id", start=1000, num_partitions=7).collect()
    ids = sorted(r.id for r in out)
    assert ids == list(range(1000, 1000 + 1200))
    by_name = sorted(out, key=lambda r: r.name)
    assert [r.id for r in by_name] == ids


def test_ids_extend_without_collision(spark):
    from hearthvale.operators.keys import next_id
    first = assign_ids(spark.createDataFrame([(f"p{i}",) for i in range(1100)], "name string"), ["name"], "id", 1)
    more = spark.createDataFrame([(f"q{i}",) for i in range(10)], "name string")
    second = assign_ids(more, ["name"], "id", start=next_id(first, "id", 1000))
    allids = [r.id for r in first.unionByName(second).collect()]
    assert len(allids) == len(set(allids)) == 1110


def test_audit_reports_orphans_and_duplicates(spark):
    letter = spark.createDataFrame([(1, 5), (2, None)], "id_letter long, id_item long")
    item = spark.createDataFrame([(5, "x")], "id_item long, name string")
    receive = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 1, 3)], "id_inhabitant long, id_player long, id_letter long")
    rep = {(r.table_name, r.rule): r.violations
           for r in audit({"letter": letter, "item": item, "receive": receive}, TABLES).collect()}
    assert rep[("receive", "fk_id_letter_letter")] == 1       # letter 3 does not exist
    assert rep[("receive", "pk_receive")] == 1
    assert rep[("letter", "fk_id_item_item")] == 0            # NULL FK is not an orphan


def test_audit_check_unknown_passes(spark):
    pm = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, None)], "id_player long, id_mission long, is_completed int")
    rep = {r.rule: r.violations for r in audit({"player_mission": pm}, TABLES).collect()}
    assert rep["ck_pm_completed"] == 1


def test_pair_search_equals_naive(spark):
    rnd = random.Random(7)
    data = [(i, rnd.choice([None] + list(range(0, 80)))) for i in range(300)]
    df = spark.createDataFrame(data, "id long, v long")
    fast = [(r.id1, r.id2) for r in closest_pair_sums(df, "id", "v", 100.0, 25).collect()]
    a, b = df.alias("a"), df.alias("b")
    naive = (a.join(b, F.col("a.id") < F.col("b.id"))
             .filter(F.col("a.v").isNotNull() & F.col("b.v").isNotNull())
             .select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"),
                     F.abs(F.col("a.v") + F.col("b.v") - 100).alias("d"))
             .orderBy("d", "id1", "id2").limit(25))
    assert fast == [(r.id1, r.id2) for r in naive.collect()]


def test_pair_search_sparse_values(spark):
    df = spark.createDataFrame([(1, 0), (2, 1000), (3, 5000)], "id long, v long")
    out = [(r.id1, r.id2) for r in closest_pair_sums(df, "id", "v", 100.0, 20).collect()]
    assert out == [(1, 2), (1, 3), (2, 3)]   # distances 900, 4900, 5900


def test_rank_cut_equals_percentile_disc_without_nulls(spark):
    rnd = random.Random(3)
    vals = [(rnd.randint(0, 40),) for _ in range(503)]
    df = spark.createDataFrame(vals, "v long")
    cut = value_at_rank(df, "v", 97, 100).first().cut
    ref = df.selectExpr("percentile_disc(0.97) WITHIN GROUP (ORDER BY v) AS p").first().p
    assert cut == ref


def test_pair_search_continuous_values_equals_naive(spark):
    from decimal import Decimal
    rnd = random.Random(11)
    data = [(i, Decimal(rnd.randint(0, 100000)) / Decimal(1000)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, v decimal(10,3)")
    fast = [(r.id1, r.id2) for r in closest_pair_sums(df, "id", "v", 100.0, 15).collect()]
    a, b = df.alias("a"), df.alias("b")
    naive = (a.join(b, F.col("a.id") < F.col("b.id"))
             .select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"),
                     F.abs(F.col("a.v") + F.col("b.v") - 100).alias("d"))
             .orderBy("d", "id1", "id2").limit(15))
    assert fast == [(r.id1, r.id2) for r in naive.collect()]


def test_season_null_matches_null(spark):
    # NVL(a,' ') = NVL(b,' ') — a NULL season on both sides matches
    stg = spark.createDataFrame([(1, None, "08:00"), (2, "Spring", "08:00")], "rid long, season string, start string")
    sched = spark.createDataFrame([(10, None, "08:00"), (11, "Spring", "08:00")], "sid long, s_season string, s_start string")
    j = stg.join(sched, stg.season.eqNullSafe(sched.s_season) & (stg.start == sched.s_start))
    assert rows(j.select("rid", "sid")) == [(1, 10), (2, 11)]


def test_first_match_smallest_id_or_null(spark):
    from hearthvale.operators.lookup import first_match
    rows_ = spark.createDataFrame([(1, "Oak"), (2, "Pine"), (3, None)], "k long, village string")
    villages = spark.createDataFrame([(7, "Oak"), (5, "Oak"), (9, "Elm")], "id_village long, name string")
    out = first_match(rows_, "village", villages, "name", "id_village", "id_village")
    assert rows(out.select("k", "id_village")) == [(1, 5), (2, None), (3, None)]


def test_fill_missing_only_touches_null_targets(spark):
    from hearthvale.operators.lookup import first_match
    farm = spark.createDataFrame([(1, None), (2, 20), (3, None)], "id_farm long, id_player long")
    pd = spark.createDataFrame([(1, 40), (1, 30), (2, 99)], "fid long, pid long")
    f = first_match(farm, "id_farm", pd, "fid", "pid", "__fill")
    out = f.select("id_farm", F.coalesce("id_player", "__fill").alias("id_player"))
    assert rows(out) == [(1, 30), (2, 20), (3, None)]


def test_not_in_follows_sql_null_rules(spark):
    from hearthvale.operators.joins import not_in
    left = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    with_null = spark.createDataFrame([(1,), (None,)], "k long")
    plain = spark.createDataFrame([(1,)], "k long")
    empty = spark.createDataFrame([], "k long")
    assert not_in(left, "k", with_null, "k").count() == 0          # a NULL in the list: nothing qualifies
    assert rows(not_in(left, "k", plain, "k")) == [(2,)]             # NULL key: unknown -> out
    assert not_in(left, "k", empty, "k").count() == 3                # empty list: everything, NULL too


def test_rank_cut_empty_table_gives_null(spark):
    df = spark.createDataFrame([], "v long")
    assert value_at_rank(df, "v", 97, 100).first().cut is None


def test_pairs_far_target_and_clustered_decimals_stay_linear(spark):
    from hearthvale.operators.pairs import candidate_values

    far = spark.createDataFrame([(i, 1_000_000 + i) for i in range(1, 601)], "id long, v long")
    near = spark.createDataFrame([(i, 50.0 + i / 1e6) for i in range(500)] + [(999, 1e9)], "id long, v double")
    for df, k in ((far, 4), (near, 4)):
        data = [(r.id, r.v) for r in df.collect()]
        naive = sorted((abs(a[1] + b[1] - 100.0), min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(data) for b in data[i + 1:])[:k]
        got = [(r.dist, r.id1, r.id2) for r in closest_pair_sums(df, "id", "v", 100.0, k).collect()]
        assert [g[1:] for g in got] == [n[1:] for n in naive]
        assert candidate_values(df.select("v").distinct(), 100.0, k).count() <= 2 * (k + 1) * len(data)


def test_rank_cut_on_near_unique_values(spark):
    import math

    df = spark.range(0, 5003).selectExpr("if(id % 100 = 0, null, (id * 7919) % 5003) as v")
    vals = sorted(r.v for r in df.collect() if r.v is not None)
    for num in (1, 50, 97):
        assert value_at_rank(df, "v", num, 100).first().cut == vals[math.ceil(5003 * num / 100) - 1]
    assert value_at_rank(df, "v", 100, 100).first().cut is None


def test_arrival_order_of_uneven_files(spark, tmpdir_run):
    import os

    from hearthvale.sources.staging import STAGING_COLUMNS, read_staging

    cols, path = STAGING_COLUMNS["ITEMS_DATA"], os.path.join(tmpdir_run, "items")
    os.makedirs(path)
    row = lambda i: ",".join([str(i)] + ["x"] * (len(cols) - 1))
    for name, ids in (("part-0.csv", range(1)), ("part-1.csv", range(1, 400)), ("part-2.csv", range(400, 402))):
        with open(os.path.join(path, name), "w") as f:
            f.write("\n".join([",".join(cols), *map(row, ids)]) + "\n")
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = [int(r.ID) for r in read_staging(spark, "ITEMS_DATA", path).orderBy("ingest_seq").select("ID").collect()]
        assert got == list(range(402))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_cascade_delete_follows_the_declared_parents(spark):
    from hearthvale.operators.cascade import cascade_delete
    from hearthvale.schemas import Table

    def table(name, pk, fks=(), cascade=()):
        return Table(name, (), pk, fks=fks, cascade=cascade)

    spec = {
        "a": table("a", ("x",)),
        "b": table("b", ("y",), ((("ax",), "a", ("x",)),), ("a",)),
        "c": table("c", ("z",), ((("by",), "b", ("y",)),), ("b",)),
        "d": table("d", ("w",), ((("ax",), "a", ("x",)),)),          # keeps its rows: no cascade declared
    }
    frames = {
        "a": spark.createDataFrame([(1,), (2,)], "x long"),
        "b": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "y long, ax long"),
        "c": spark.createDataFrame([(100, 10), (101, 11), (102, None)], "z long, by long"),
        "d": spark.createDataFrame([(5, 1)], "w long, ax long"),
    }
    out = cascade_delete(frames, "a", spark.createDataFrame([(1,)], "x long"), spec)
    assert [sorted(r[0] for r in out[k].collect()) for k in "abcd"] == [[2], [11, 12], [101, 102], [5]]


def test_guards_against_empty_tables_cost_no_shuffle(spark):
    from hearthvale.plans import loads

    new = spark.range(1000).select(F.col("id").alias("id_shop"), F.lit(1).cast("bigint").alias("id_schedule"))
    rows = loads.append_new(new, loads._empty(spark, "follow"), ["id_shop", "id_schedule"])
    assert rows.count() == 1000
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan, plan


def test_staged_extracts_hold_the_columns_read(spark):
    from hearthvale.plans import loads
    from hearthvale.sources.staging import STAGING_COLUMNS

    df = spark.createDataFrame([("1", "a", 0), (None, "b", 1)], "ID string, NAME string, ingest_seq long")
    held = loads._Staged({"X": df}, {"X": ("ID",)})["X"]
    assert held.columns == ["ID"] and sorted(r.ID or "" for r in held.collect()) == ["", "1"]
    for group, read in loads._COLUMNS.items():
        for name, columns in read.items():
            assert set(columns) <= {*STAGING_COLUMNS[name], "ingest_seq"}, (group, name)
    assert set(loads._COLUMNS) == set(loads.GROUPS)
