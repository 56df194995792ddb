"""Entries for the event-driven operators T1–T4 over the supplied tables.

Each derives a starting snapshot and a batch of events from the test tables.
The plain entries run the ``apply_*`` fold over the whole batch. The entries
``*_state`` run the streaming job: the events arrive in ``SLICES`` lots, and the
job is started anew from its checkpoint for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.session import fresh_folder, staged
from hearthvale.streaming import jobs, keyed_state

from hearthvale.streaming.triggers import (
    apply_affection_boost,
    apply_barn_admission,
    apply_donation_reward,
    apply_purchase_stock,
)

# Fixed values of the derivations (mirrored in the oracle SQL).
NULL_AMOUNT_EVERY = 101   # odd orders whose amounts arrive NULL (key % 101 == 1)
UNKNOWN_BARN_EVERY = 97   # arrivals addressed to a barn that does not exist

SLICES = 2                # lots in which the events reach a streaming job


def purchase_inputs(d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Even orders make the starting stock; odd orders' lines are the new
    BUY/SELL rows (some with a NULL amount)."""
    li = d.t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    o = d.t.orders.select("o_orderkey", "o_custkey")
    lo = li.join(o, li.l_orderkey == o.o_orderkey)
    even = lo.filter(F.col("l_orderkey") % 2 == 0)
    q = F.col("l_quantity").cast("bigint")
    s0 = (even.groupBy(F.col("l_suppkey").alias("id_shop"), F.col("l_partkey").alias("id_item"))
          .agg(F.sum(q).alias("quantity")))
    p0 = (even.groupBy(F.col("o_custkey").alias("id_player"), F.col("l_partkey").alias("id_item"))
          .agg(F.sum(q).alias("quantity")))
    batch = lo.filter(F.col("l_orderkey") % 2 == 1).select(
        F.col("l_suppkey").alias("id_shop"), F.col("o_custkey").alias("id_player"),
        F.col("l_partkey").alias("id_item"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("action"),
        F.when(F.col("l_orderkey") % NULL_AMOUNT_EVERY == 1, F.lit(None).cast("bigint")).otherwise(q).alias("amount"))
    return batch, s0, p0


def stream_purchase_stock(d) -> DataFrame:
    """T1 + M9: both stock snapshots after the batch, tagged by table."""
    batch, s0, p0 = purchase_inputs(d)
    s1, p1 = apply_purchase_stock(batch, s0, p0)
    return (s1.select(F.lit("S_STORED").alias("tbl"), F.col("id_shop").alias("id_owner"), "id_item", "quantity")
            .unionByName(p1.select(F.lit("P_STORED").alias("tbl"), F.col("id_player").alias("id_owner"),
                                   "id_item", "quantity")))


def arrival_inputs(d) -> DataFrame:
    o = d.t.orders
    return o.select(F.col("o_orderkey").alias("id_animal"),
                    F.when(F.col("o_orderkey") % UNKNOWN_BARN_EVERY == 0, F.lit(-1).cast("bigint"))
                     .otherwise(F.col("o_custkey")).alias("id_barn"),
                    F.col("o_orderkey").alias("arrival_seq"))


def stream_barn_admission(d, mode: str = "per_row") -> DataFrame:
    """Admission decision per arriving animal."""
    dec, _ = apply_barn_admission(arrival_inputs(d), d.barn, mode)
    return dec.select("id_animal", "id_barn", "admitted")


def stream_barn_rejects(d) -> DataFrame:
    """Arrivals that go to quarantine, in arrival order per barn."""
    dec, _ = apply_barn_admission(arrival_inputs(d), d.barn, "per_row")
    return dec.filter("NOT admitted").select("id_animal", "id_barn", "arrival_seq")


def stream_barn_occupancy(d) -> DataFrame:
    """Barn snapshot after the arrivals."""
    _, barn = apply_barn_admission(arrival_inputs(d), d.barn, "per_row")
    return barn


def personality_changes(d) -> DataFrame:
    c = d.t.customer
    k = F.col("c_custkey")
    old = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    new = (F.when(k % 4 == 0, F.lower("c_mktsegment")).when(k % 4 == 1, F.col("c_mktsegment"))
           .when(k % 4 == 2, F.lit(None).cast("string")).otherwise(F.lit("NOMAD")))
    return c.select(k.alias("id_inhabitant"), old.alias("old_personality"), new.alias("new_personality"))


def stream_affection_boost(d) -> DataFrame:
    """Relationships after a batch of personality changes."""
    rel = d.relationship.select("id_character1", "id_character2", "affection_level")
    return apply_affection_boost(personality_changes(d), rel)


def stream_donation_reward(d) -> DataFrame:
    """T4: player stock after a batch of donations (new ones earn item 9999)."""
    return apply_donation_reward(d.donation, d.p_stored)


# ---------------------------------------------------------------- the same on keyed state
def _in_lots(events: DataFrame, lot: F.Column, folder: str, drain: Callable[[], object]) -> None:
    """Events of lot 0, 1, .. land in ``folder``, each drained by a fresh start."""
    events = staged(events.withColumn("__lot", lot), "stream-events")
    for i in range(SLICES):
        events.filter(F.col("__lot") == i).drop("__lot").write.mode("append").parquet(folder)
        drain()


def _any_lot(*cols: str) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SLICES))


def stream_purchase_stock_state(d) -> DataFrame:
    """T1 + M9 by a streaming job with a total per (table, owner, item)."""
    spark, root = d.spark, fresh_folder(d.spark, "stream-stock")
    batch, s0, p0 = purchase_inputs(d)
    events = batch.select("id_shop", "id_player", "id_item", F.lit(None).cast("timestamp_ntz").alias("action_time"), "action",
                          F.lit(None).cast("decimal(18,2)").alias("money_fluctuation"), "amount")
    s0, p0 = staged(s0, "stream-start"), staged(p0, "stream-start")
    _in_lots(events, _any_lot("id_shop", "id_item", "id_player"), f"{root}/new",
             lambda: jobs.purchase_stock(spark, f"{root}/new", s0, p0, root))
    return jobs.stock(spark, root)


def stream_donation_reward_state(d) -> DataFrame:
    """T4 by a streaming job with a total per (player, item)."""
    spark, root = d.spark, fresh_folder(d.spark, "stream-reward")
    start = staged(d.p_stored, "stream-start")
    _in_lots(d.donation.select("id_donatable", "id_museum", "id_player", "condition_object"), _any_lot("id_player", "id_donatable"),
             f"{root}/new", lambda: jobs.donation_reward(spark, f"{root}/new", start, root))
    return jobs.player_stock(spark, root)


def stream_affection_boost_state(d) -> DataFrame:
    """T3 by a streaming job with a total per relationship."""
    spark, root = d.spark, fresh_folder(d.spark, "stream-affection")
    edges = staged(d.relationship.select("id_character1", "id_character2", "affection_level"), "stream-start")
    _in_lots(personality_changes(d), _any_lot("id_inhabitant"), f"{root}/new",
             lambda: jobs.affection_boost(spark, f"{root}/new", edges, root))
    return jobs.affection(spark, root)


def _barn_run(d) -> str:
    spark, root = d.spark, fresh_folder(d.spark, "stream-barn")
    arrivals, start = arrival_inputs(d), staged(d.barn.select("id_barn", "max_capacity", "occupied_spots"), "stream-start")
    bounds = arrivals.agg(F.min("arrival_seq"), F.max("arrival_seq")).first()
    low, high = (bounds[0] or 0, bounds[1] or 0)
    lot = F.least(F.lit(SLICES - 1), F.floor((F.col("arrival_seq") - low) * SLICES / F.lit(high - low + 1))).cast("int")
    _in_lots(arrivals, lot, f"{root}/new", lambda: jobs.barn_admission(spark, f"{root}/new", start, root))
    return root


def stream_barn_admission_state(d) -> DataFrame:
    """T2 by a streaming job with a state per barn: every decision."""
    return keyed_state.decisions(d.spark, _barn_run(d)).select("id_animal", "id_barn", "admitted")


def stream_barn_rejects_state(d) -> DataFrame:
    """T2 by a streaming job: what it turned away, its second output."""
    return keyed_state.decisions(d.spark, _barn_run(d), admitted=False).select("id_animal", "id_barn", "arrival_seq")


def stream_barn_occupancy_state(d) -> DataFrame:
    """T2 by a streaming job: the barns in its state."""
    return keyed_state.barns(d.spark, _barn_run(d)).select("id_barn", "max_capacity", "occupied_spots")
