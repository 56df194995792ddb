"""What a query must not do when its tables grow: collect a growing table on the
driver, call Python per key, carry columns that nobody reads through an aggregate."""

from __future__ import annotations

import os

from conftest import domain, rows

from hearthvale.operators import audit
from hearthvale.plans import events, loads
from hearthvale.schemas import Table
from hearthvale.streaming import jobs


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_single_events_are_not_broadcast(spark):
    d = domain(spark,
               event=([(1, "a", 8), (2, "b", 9), (3, "c", 9), (4, "d", None), (5, "e", 10), (5, "f", 10), (6, "g", 99)],
                      "id_event long, description string, id_place long"),
               place_e6=([(8, "p8"), (9, "p9"), (10, "p10"), (10, "p10b")], "id_place long, location_name string"))
    out = events.single_event_places(d)
    assert "Broadcast" not in _plan(out)
    got = rows(out)              # a repeated event is one event; its rows and the place's are kept
    assert got == [(1, "a", "p8"), (5, "e", "p10"), (5, "e", "p10b"), (5, "f", "p10"), (5, "f", "p10b")]
    assert "Broadcast" not in _plan(out)


def test_totals_are_a_streaming_aggregate_and_their_start_is_made_good(spark, tmpdir_run):
    folder, root = os.path.join(tmpdir_run, "new"), os.path.join(tmpdir_run, "root")
    start = spark.createDataFrame([(1, 9999, 3), (1, 5, None), (2, 9999, 1)], "id_player long, id_item long, quantity long")
    start.limit(1).write.parquet(f"{root}/initial")          # left by a call that broke off
    lots = [[(1, 1, 1, "new")], [(1, 1, 1, "NEW"), (3, 1, None, "new"), (4, 1, 7, "Used")]]      # item, museum, player, condition
    for lot in lots:
        spark.createDataFrame(lot, jobs.DONATIONS).coalesce(1).write.mode("append").parquet(folder)
        query = jobs.donation_reward(spark, folder, start, root)
        assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["stateStoreSave"]
    assert {tuple(r) for r in jobs.player_stock(spark, root).collect()} == {(1, 9999, 5), (1, 5, None), (2, 9999, 1), (None, 9999, 1)}
    changed = spark.read.parquet(f"{root}/changes").select("batch", "id_player", "amount")
    assert sorted(map(tuple, changed.collect()), key=str) == [(0, 1, 4), (1, 1, 5), (1, None, 1)]


def test_keys_are_counted_as_numbers_and_every_key_kind_is_audited(spark):
    spec = {t.name: t for t in [
        Table("p", (("id", "long", True, None), ("name", "string", False, None)), ("id",), unique=(("name",),)),
        Table("q", (("name", "string", True, None),), ("name",)),
        Table("c", (("id", "int", False, None), ("name", "string", False, None), ("n", "long", False, None)), ("id", "n"),
              ((("id",), "p", ("id",)), (("name",), "q", ("name",)), (("name",), "p", ("name",)), (("id", "n"), "d", ("a", "b")))),
        Table("d", (("a", "long", True, None), ("b", "long", True, None)), ("a", "b"))]}
    tables = {"p": spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (None, None), (None, None)], "id long, name string"),
              "q": spark.createDataFrame([("x",), ("z",)], "name string"),
              "c": spark.createDataFrame([(1, "x", 1), (1, "x", 1), (3, "y", None), (3, None, None), (None, "z", 2)], "id int, name string, n long"),
              "d": spark.createDataFrame([(1, 2), (1, 2)], "a long, b long")}
    assert tables["c"].select(audit._key(tables["c"], ("id",))).dtypes[0][1] == "bigint"
    want = {("p", "pk_p", "pk"): 1, ("p", "uk_name", "unique"): 1, ("q", "pk_q", "pk"): 0, ("c", "pk_c", "pk"): 1, ("d", "pk_d", "pk"): 1,
            ("c", "fk_id_p", "fk"): 2, ("c", "fk_name_q", "fk"): 1, ("c", "fk_name_p", "fk"): 1, ("c", "fk_id_n_d", "fk"): 2}
    assert audit.key_report(tables, spec) == want
    assert audit.key_report({"d": tables["d"].limit(0), "q": tables["q"]}, spec) == {("d", "pk_d", "pk"): 0, ("q", "pk_q", "pk"): 0}


def test_foreign_keys_are_shuffled_with_a_number_for_their_rule():
    sql = audit.audit_sql({"player": "v1", "character": "v2"}, {"player": ["id_player"], "character": ["id_character"]})
    assert sql.count("fk_id_player_character") == 2          # in the report's name column alone


def test_first_rows_carry_the_columns_that_are_read(spark):
    stg = spark.createDataFrame([("1", "a", "b", "wide", 2), ("1", None, "c", "wide", 1), (None, "a", "a", "wide", 0)],
                                "ID string, A string, B string, REST string, ingest_seq long")
    first = loads._first(stg, ["ID"], ["A"], also=["B"])
    assert "REST" not in _plan(first).split("LocalTableScan")[0].split("Scan ExistingRDD")[0]
    assert rows(first) == [("1", "a", "b")]
    assert rows(loads._first(stg, ["ID"], variant="none", also=["B"])) == [("1", "c")]
