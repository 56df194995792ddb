"""T1–T4 folds on hand fixtures, fold laws, and the streaming jobs on keyed
state: any split into batches, restarts, replays."""

from __future__ import annotations

import os
import random

import pytest
from conftest import rows

from hearthvale.streaming import jobs, keyed_state
from hearthvale.streaming.triggers import (
    admission_decisions,
    apply_affection_boost,
    apply_barn_admission,
    apply_donation_reward,
    apply_purchase_stock,
)

BATCH = "id_shop long, id_player long, id_item long, action string, amount long"
S = "id_shop long, id_item long, quantity long"
P = "id_player long, id_item long, quantity long"


def test_stock_missing_and_null(spark):
    s0 = spark.createDataFrame([(1, 10, 5), (1, 11, 5)], S)
    p0 = spark.createDataFrame([(7, 10, 1)], P)
    batch = spark.createDataFrame([
        (2, 7, 10, "BUY", 3),      # shop 2 has no stock row: shop side unchanged
        (1, 7, 10, "BUY", 2),      # existing shop row -2, player row +2
        (1, 8, 11, "BUY", None),   # NULL amount: shop quantity becomes NULL; new player row NULL
        (1, 7, 10, "SELL", 100),   # SELL ignored
    ], BATCH)
    s1, p1 = apply_purchase_stock(batch, s0, p0)
    assert rows(s1) == [(1, 10, 3), (1, 11, None)]
    assert sorted(rows(p1), key=str) == sorted([(7, 10, 6), (8, 11, None)], key=str)


def test_stock_fold_independent_of_batch_split(spark):
    s0 = spark.createDataFrame([(1, 10, 50)], S)
    p0 = spark.createDataFrame([], P)
    evs = [(1, 7, 10, "BUY", i % 4 + 1) for i in range(12)]
    whole = apply_purchase_stock(spark.createDataFrame(evs, BATCH), s0, p0)
    s, p = s0, p0
    for part in (evs[:5], evs[5:9], evs[9:]):
        s, p = apply_purchase_stock(spark.createDataFrame(part, BATCH), s, p)
    assert rows(s) == rows(whole[0]) and rows(p) == rows(whole[1])


BARN = "id_barn long, max_capacity long, occupied_spots long"
ARR = "id_animal long, id_barn long, arrival_seq long"


def test_barn_full_and_null_capacity(spark):
    barn = spark.createDataFrame([(1, 2, 1), (2, None, 4)], BARN)
    arr = spark.createDataFrame([(100, 1, 1), (101, 1, 2), (102, 2, 3), (103, 2, 4), (104, 9, 5)], ARR)
    dec, new_barn = apply_barn_admission(arr, barn)
    assert {r.id_animal: r.admitted for r in dec.collect()} == {100: True, 101: False, 102: True, 103: True,
                                                              104: False}
    assert rows(new_barn) == [(1, 2, 2), (2, None, 6)]
    aon = admission_decisions(arr, barn, "all_or_nothing")
    assert not any(r.admitted for r in aon.collect())


def test_barn_order_sensitivity(spark):
    barn = spark.createDataFrame([(1, 1, 0)], BARN)
    a = spark.createDataFrame([(100, 1, 2), (101, 1, 1)], ARR)
    assert {r.id_animal: r.admitted for r in admission_decisions(a, barn).collect()} == {100: False, 101: True}


REL = "id_character1 long, id_character2 long, affection_level long"
CHG = "id_inhabitant long, old_personality string, new_personality string"


def test_affection_both_ends_and_unchanged(spark):
    rel = spark.createDataFrame([(1, 2, 10), (2, 3, 10), (3, 4, 10)], REL)
    chg = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "x", "x"), (4, None, "y")], CHG)
    assert rows(apply_affection_boost(chg, rel)) == [(1, 2, 12), (2, 3, 11), (3, 4, 10)]


def test_donation_reward_case_insensitive(spark):
    p0 = spark.createDataFrame([(1, 9999, 3), (1, 5, 1)], P)
    don = spark.createDataFrame([(1, "new"), (1, "NEW"), (1, "Used"), (2, "New")],
                                "id_player long, condition_object string")
    assert rows(apply_donation_reward(don, p0)) == [(1, 5, 1), (1, 9999, 5), (2, 9999, 1)]


def test_repeated_animal_ids_stay_single_rows(spark):
    barn = spark.createDataFrame([(1, 2, 0)], BARN)
    arr = spark.createDataFrame([(100, 1, 1), (100, 1, 2), (100, 1, 3), (None, 1, 4)], ARR)
    got = sorted((r.arrival_seq, r.admitted) for r in admission_decisions(arr, barn).collect())
    assert got == [(1, True), (2, True), (3, False), (4, False)]


# ---------------------------------------------------------------- jobs on keyed state
def land(spark, folder, data, schema):
    """One file, so one micro-batch where batches take one file each."""
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)


def trade(shop, player, item, amount, action="BUY"):
    return (shop, player, item, None, action, None, amount)


@pytest.mark.parametrize("lots,files", [(1, None), (3, None), (2, 1)])
def test_stock_job_equals_the_fold_for_any_split(spark, tmpdir_run, lots, files):
    rnd = random.Random(lots)
    s0 = spark.createDataFrame([(i % 4, i, 100) for i in range(8)] + [(9, 1, None)], S)
    p0 = spark.createDataFrame([(7, 1, 5), (7, 2, None)], P)
    events = [trade(rnd.choice([0, 1, 2, 3, 9]), rnd.choice([7, 8]), rnd.randint(0, 8), rnd.choice([1, 2, 3, 4]),
                    rnd.choice(["BUY", "BUY", "SELL"])) for _ in range(200)]
    events += [trade(1, 8, 1, None), trade(None, None, 1, 2), trade(0, 7, 0, 3)]
    folder, root = os.path.join(tmpdir_run, "new"), os.path.join(tmpdir_run, "root")
    for i in range(lots):                                    # every call starts a new query from the checkpoint
        for part in (events[i::lots][:30], events[i::lots][30:]):
            if part:
                land(spark, folder, part, jobs.TRADES)
        jobs.purchase_stock(spark, folder, s0, p0, root, files)
    s1, p1 = apply_purchase_stock(spark.createDataFrame(events, jobs.TRADES), s0, p0)
    want = {("S_STORED", *r) for r in s1.collect()} | {("P_STORED", *r) for r in p1.collect()}
    assert {tuple(r) for r in jobs.stock(spark, root).collect()} == want
    jobs.purchase_stock(spark, folder, s0, p0, root, files)   # nothing has arrived: nothing changes
    assert {tuple(r) for r in jobs.stock(spark, root).collect()} == want
    changed = spark.read.parquet(f"{root}/changes")
    assert changed.filter("tbl = 'S_STORED' AND id_owner = 3 AND id_item = 7").count() <= 6       # only what batches touched


def test_stock_job_goes_on_after_a_failed_batch(spark, tmpdir_run):
    folder, root = os.path.join(tmpdir_run, "new"), os.path.join(tmpdir_run, "root")
    s0, p0 = spark.createDataFrame([(1, 1, 10)], S), spark.createDataFrame([], P)
    land(spark, folder, [trade(1, 7, 1, 2)], jobs.TRADES)
    jobs.purchase_stock(spark, folder, s0, p0, root, 1)
    land(spark, folder, [trade(1, 7, 1, 3)], jobs.TRADES)
    bad = os.path.join(folder, "zz-not-parquet.parquet")
    with open(bad, "wb") as f:
        f.write(b"no parquet")
    with pytest.raises(Exception):
        jobs.purchase_stock(spark, folder, s0, p0, root)
    os.remove(bad)
    land(spark, folder, [trade(1, 8, 1, 4)], jobs.TRADES)
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        jobs.purchase_stock(spark, folder, s0, p0, root)
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    assert rows(jobs.stock(spark, root)) == [("P_STORED", 7, 1, 5), ("P_STORED", 8, 1, 4), ("S_STORED", 1, 1, 1)]


def test_barn_job_equals_the_fold_over_batches_and_restarts(spark, tmpdir_run):
    barn = spark.createDataFrame([(1, 6, 1), (2, None, 4), (3, 2, 2), (4, 3, None), (5, 1, 3)], BARN)
    rnd = random.Random(4)
    arr = [(i, rnd.choice([1, 1, 1, 2, 3, 4, 5, 77, None]), i) for i in range(60)]
    folder, root = os.path.join(tmpdir_run, "new"), os.path.join(tmpdir_run, "root")
    for lot in (arr[:2], arr[2:20], arr[20:]):
        shuffled = list(lot)
        rnd.shuffle(shuffled)
        land(spark, folder, shuffled, jobs.ARRIVALS)
        jobs.barn_admission(spark, folder, barn, root)
    want, after = apply_barn_admission(spark.createDataFrame(arr, jobs.ARRIVALS), barn)
    key = lambda r: (r.id_animal, r.id_barn, r.arrival_seq, r.admitted)
    assert sorted(map(key, keyed_state.decisions(spark, root).collect()), key=str) == sorted(map(key, want.collect()), key=str)
    refused = {r.id_animal for r in keyed_state.decisions(spark, root, admitted=False).collect()}
    assert refused == {r.id_animal for r in want.filter("NOT admitted").collect()}
    assert rows(keyed_state.barns(spark, root).select("id_barn", "max_capacity", "occupied_spots")) == rows(after)


def test_barn_job_holds_no_more_than_the_free_places(spark, tmpdir_run):
    barn = spark.createDataFrame([(1, 3, 0)], BARN)
    folder, root = os.path.join(tmpdir_run, "new"), os.path.join(tmpdir_run, "root")
    spark.range(20_000).selectExpr("id AS id_animal", "1L AS id_barn", "20000 - id AS arrival_seq").write.parquet(folder)
    jobs.barn_admission(spark, folder, barn, root)
    assert rows(keyed_state.decisions(spark, root, admitted=True).select("id_animal")) == [(19997,), (19998,), (19999,)]
    assert keyed_state.decisions(spark, root).count() == 20_000


def test_affection_and_reward_jobs(spark, tmpdir_run):
    rel = spark.createDataFrame([(1, 2, 10), (2, 3, 10), (3, 4, None)], REL)
    feed, root = os.path.join(tmpdir_run, "feed"), os.path.join(tmpdir_run, "root")
    changes = [(1, "a", "b"), (2, "a", "c"), (2, "c", "d"), (3, "x", "x"), (4, None, "y"), (4, "y", "z")]
    for lot in (changes[:3], changes[3:]):
        land(spark, feed, lot, jobs.FEED)
        jobs.affection_boost(spark, feed, rel, root)
    assert sorted(map(tuple, jobs.affection(spark, root).collect()), key=str) == sorted(
        map(tuple, apply_affection_boost(spark.createDataFrame(changes, jobs.FEED), rel).collect()), key=str)
    gifts, root = os.path.join(tmpdir_run, "gifts"), os.path.join(tmpdir_run, "root2")
    p0 = spark.createDataFrame([(1, 9999, 3), (1, 5, 1)], P)
    land(spark, gifts, [(1, 1, 1, "new"), (1, 1, 1, "NEW"), (1, 1, 1, "Used"), (1, 1, 2, "New")], jobs.DONATIONS)
    jobs.donation_reward(spark, gifts, p0, root)
    assert rows(jobs.player_stock(spark, root)) == [(1, 5, 1), (1, 9999, 5), (2, 9999, 1)]
