"""ETL operator entries
run over staging extracts derived from the supplied tables.

Each function builds a staging DataFrame shaped like one of the reference's
wide extracts (all values as they would arrive), then applies the load's
operator. Outputs are the rows the load would write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.operators.dedupe import append_new, complete, first_row_per_key
from hearthvale.operators.joins import not_in
from hearthvale.operators.keys import assign_ids
from hearthvale.operators.lookup import first_match, first_value
from hearthvale.sources.staging import cast_with_quarantine

# Fixed values of the staging derivations (mirrored in the oracle SQL).
BAD_NUMBER_EVERY = 97      # customer keys whose gold arrives as 'n/a'
MISSING_VILLAGE_EVERY = 89  # customer keys whose village arrives empty
NULL_AMOUNT_EVERY = 53     # order keys whose purchase amount arrives empty
UNFILLED_FARM_EVERY = 7    # farms loaded without an owner


def ingest_cast_quarantine(d) -> DataFrame:
    """Customer extract as text; count good rows and rows
    quarantined per failing rule (bad number, missing required value)."""
    c = d.t.customer
    stg = c.select(
        F.col("c_custkey").cast("string").alias("ID"),
        F.when(F.col("c_custkey") % BAD_NUMBER_EVERY == 0, F.lit("n/a"))
         .otherwise(F.col("c_acctbal").cast("string")).alias("GOLD"),
        F.when(F.col("c_custkey") % MISSING_VILLAGE_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_nationkey").cast("string")).alias("VILLAGE"),
    )
    good, bad = cast_with_quarantine(stg, {"ID": "bigint", "GOLD": "decimal(18,2)", "VILLAGE": "int"},
                                     required=["ID", "VILLAGE"])
    g = good.groupBy(F.lit("ok").alias("rule")).agg(F.count(F.lit(1)).alias("n"))
    b = bad.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return g.unionByName(b)


def etl_idempotent_append(d) -> DataFrame:
    """Re-running a load appends only keys not yet in the target
    (here: orders with even keys are already loaded)."""
    o = d.t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    target = o.filter(F.col("o_orderkey") % 2 == 0)
    return append_new(o, target, ["o_orderkey"])


def _schedules_staging(d) -> DataFrame:
    e = d.t.events
    end = F.timestamp_add("MINUTE", F.floor(F.col("value") * 10).cast("int"), F.col("ts"))
    return e.select(
        F.col("user_id").alias("id_resident"),
        F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Season"), (F.col("user_id") % 4).cast("string"))).alias("season_name"),
        F.date_format("ts", "HH:mm").alias("start_time"),
        F.date_format(end, "HH:mm").alias("end_time"),
        F.col("event_type").alias("day_of_week"),
    )


def etl_schedule_match(d) -> DataFrame:
    """J3/J14 (+M6): distinct slots numbered from 1000 in natural-key order,
    then each staging row matched to its slot on four columns, the season
    compared NULL-safely (``NVL(a,' ') = NVL(b,' ')``)."""
    stg = _schedules_staging(d)
    slot_cols = ["season_name", "start_time", "end_time", "day_of_week"]
    slots = stg.select(*slot_cols).distinct()
    sched = assign_ids(slots, [F.col(c).asc_nulls_first() for c in slot_cols], "id_schedule", start=1000)
    s = sched.select(*[F.col(c).alias(f"s_{c}") for c in slot_cols], "id_schedule")
    cond = (F.col("season_name").eqNullSafe(F.col("s_season_name"))
            & (F.col("start_time") == F.col("s_start_time")) & (F.col("end_time") == F.col("s_end_time"))
            & (F.col("day_of_week") == F.col("s_day_of_week")))
    return stg.join(s, cond).select(F.col("id_resident").alias("id_inhabitant"), "id_schedule")


def etl_fill_missing(d) -> DataFrame:
    """``UPDATE farm SET id_player = (first matching player) WHERE
    id_player IS NULL AND EXISTS (match)`` as a left join to a deduped
    lookup and a ``coalesce``; the first match is pinned to the smallest id."""
    s = d.t.supplier
    farm = s.select(F.col("s_suppkey").alias("id_farm"),
                    F.when(F.col("s_suppkey") % UNFILLED_FARM_EVERY == 0, F.lit(None).cast("bigint"))
                     .otherwise(F.col("s_suppkey")).alias("id_player"))
    li = d.t.lineitem.select("l_orderkey", "l_suppkey")
    o = d.t.orders.select("o_orderkey", "o_custkey")
    stg = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_suppkey").alias("ID_FARM"),
                                                          F.col("o_custkey").alias("ID"))
    players = d.t.customer.filter(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("ID"))
    cand = stg.join(players, "ID", "left_semi")
    filled = first_match(farm, "id_farm", cand, "ID_FARM", "ID", "__fill")
    return filled.select("id_farm", F.coalesce("id_player", "__fill").alias("id_player"))


def _transactions_staging(d) -> DataFrame:
    li = d.t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag")
    o = d.t.orders.select("o_orderkey", "o_custkey")
    sell = F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast("bigint")
    amt_buy = F.when(F.col("l_orderkey") % NULL_AMOUNT_EVERY == 0, F.lit(None).cast("bigint")).otherwise(qty)
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").alias("ID_SHOP"),
        F.when(~sell, F.col("l_partkey")).alias("BUY_ITEM"),
        F.when(~sell, F.col("o_custkey")).alias("CLIENT"),
        F.when(~sell, F.col("l_shipdate")).alias("DATE_OF_PURCHASE"),
        F.when(~sell, amt_buy).alias("AMOUNT_TO_BUY"),
        F.when(sell, F.col("l_partkey")).alias("SELLS_ITEM"),
        F.when(sell, F.col("o_custkey")).alias("CLIENT2"),
        F.when(sell, F.col("l_shipdate")).alias("DATE_OF_SALE"),
        F.when(sell, qty).alias("AMOUNT_TO_SELL"),
    )


def trade_facts(stg: DataFrame, item: DataFrame, shop: DataFrame, player: DataFrame) -> DataFrame:
    """Loads 16–17 — one BUY_SELL fact per (shop, item, client).

    Lines are aggregated per group *before* any join (the item price is a
    function of the group key, so ``MAX(price)`` is the item's price); shop
    and player existence are semi-joins on the aggregated keys.
    """
    def side(item_c, client_c, date_c, amount_c, action, price_c, sign):
        req = ["ID_SHOP", item_c, client_c, amount_c, date_c]
        g = (stg.filter(complete(req))
             .groupBy(F.col("ID_SHOP").alias("id_shop"), F.col(item_c).alias("id_item"),
                      F.col(client_c).alias("id_player"))
             .agg(F.max(date_c).alias("action_time"), F.sum(amount_c).alias("amount")))
        g = (g.join(shop.select("id_shop"), "id_shop", "left_semi")
              .join(player.select("id_player"), "id_player", "left_semi")
              .join(item.select("id_item", price_c), "id_item"))
        money = (F.lit(sign) * F.col(price_c) * F.col("amount")).cast("decimal(18,2)")
        return g.select("id_shop", "id_item", "id_player", "action_time", F.lit(action).alias("action"),
                        money.alias("money_fluctuation"), "amount")

    buy = side("BUY_ITEM", "CLIENT", "DATE_OF_PURCHASE", "AMOUNT_TO_BUY", "BUY", "price_to_buy", -1)
    sell = side("SELLS_ITEM", "CLIENT2", "DATE_OF_SALE", "AMOUNT_TO_SELL", "SELL", "price_to_sell", 1)
    return buy.unionByName(sell)


def etl_trade_facts(d) -> DataFrame:
    return trade_facts(_transactions_staging(d), d.item, d.shop, d.player)


def etl_first_match_lookup(d) -> DataFrame:
    """Resolve each line's part *name* to the first part id of that
    name, and stamp every row with one default player (uncorrelated)."""
    li = d.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    names = d.t.part.select("p_partkey", "p_name")
    rows = li.join(names, li.l_partkey == names.p_partkey).drop("p_partkey")
    res = first_match(rows, "p_name", names, "p_name", "p_partkey", "first_partkey")
    return res.select("l_orderkey", "l_linenumber", "l_partkey", "first_partkey",
                      first_value(d.t.customer, "c_custkey").alias("default_player"))


def etl_first_row_per_key(d) -> DataFrame:
    """The first event per user in arrival (event id) order, under the
    three completeness variants; error events lack the required value."""
    e = d.t.events.select("user_id", "event_id",
                          F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
                           .otherwise(F.col("value")).alias("val"))
    parts = [first_row_per_key(e, ["user_id"], "event_id", ["val"], v).withColumn("variant", F.lit(v))
             for v in ("before", "after", "none")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("variant", "user_id", "event_id", "val")


def etl_dimension_ids(d) -> DataFrame:
    """A dimension merged from two sources (distinct union),
    numbered from 1000 in name order, contiguously."""
    p = d.t.part
    names = p.select(F.col("p_brand").alias("name")).unionByName(p.select(F.col("p_type").alias("name"))) \
        .filter(F.col("name").isNotNull()).distinct()
    return assign_ids(names, ["name"], "id", start=1000).select("id", "name")


def items_staging(d) -> DataFrame:
    """ITEMS_DATA-shaped extract: one wide row per part, subtype columns set
    only for some parts."""
    p = d.t.part
    sz = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("ID"), F.col("p_name").alias("NAME"), F.col("p_type").alias("TYPE"),
        F.when(sz % 3 == 0, F.col("p_type")).alias("INGREDIENTS"),
        F.when(sz % 3 == 0, sz.cast("bigint")).alias("ENERGY"),
        F.when(sz % 3 == 0, sz.cast("bigint")).alias("HEALTH"),
        F.when(sz % 4 == 0, F.col("p_brand")).alias("NAME_CROP"),
        F.when(sz % 5 == 0, sz).alias("NUTRITIONAL_VALUE"),
        F.when(sz % 5 == 0, F.col("p_brand")).alias("QUALITY"),
    )


def subtype_split(stg: DataFrame) -> dict[str, DataFrame]:
    """M4: one wide staging row fans out to the supertype and each subtype
    whose columns are present (loads 1–4). Each output is a filtered
    projection; Catalyst prunes each scan to the columns it needs."""
    return {
        "ITEM": stg.select(F.col("ID").alias("id_item"), F.col("NAME").alias("name")),
        "FOOD": stg.filter(complete(["INGREDIENTS", "ENERGY", "HEALTH"]))
                   .select(F.col("ID").alias("id_food"), F.col("INGREDIENTS").alias("ingredients"),
                           F.col("ENERGY").alias("energy_regain"), F.col("HEALTH").alias("health_regain"))
                   .distinct(),
        "SEED": stg.filter(F.col("NAME_CROP").isNotNull())
                   .select(F.col("ID").alias("id_seed"), F.col("TYPE").alias("seed_type"),
                           F.col("NAME_CROP").alias("name_crop")),
        "SUPPLY": stg.filter(complete(["NUTRITIONAL_VALUE", "QUALITY"]))
                     .select(F.col("ID").alias("id_supply"), F.col("NUTRITIONAL_VALUE").alias("nutritional_value"),
                             F.col("QUALITY").alias("nutritional_qualities")),
    }


def etl_subtype_split(d) -> DataFrame:
    parts = subtype_split(items_staging(d))
    out = None
    for name, df in parts.items():
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("subtype"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def etl_canonical_edges(d) -> DataFrame:
    """M5: the RELATIONSHIP load — canonical, deduped, known endpoints."""
    return d.relationship.select("id_character1", "id_character2", "affection_level")


def etl_cascade_delete(d) -> DataFrame:
    """Deleting parents (orders of status P) removes their children."""
    gone = d.t.orders.filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    li = d.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.join(gone, "l_orderkey", "left_anti")


def etl_default_parents(d) -> DataFrame:
    """M12 (+J8): farms named by the farm extract but missing from the
    player extract are created with default attributes."""
    c = d.t.customer
    finished = d.t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    loaded = (c.join(finished, "c_custkey", "left_semi")
              .select(F.col("c_custkey").alias("id_farm"), F.col("c_acctbal").cast("decimal(10,2)").alias("hectares"),
                      F.col("c_mktsegment").alias("specialization"), F.col("c_custkey").alias("id_player")))
    farms_stg = d.t.orders.select(F.col("o_custkey").alias("id_farm")).distinct()
    missing = not_in(farms_stg, "id_farm", loaded, "id_farm")
    defaults = missing.select("id_farm", F.lit(1.0).cast("decimal(10,2)").alias("hectares"),
                              F.lit("General").alias("specialization"), F.lit(None).cast("bigint").alias("id_player"))
    return loaded.unionByName(defaults)
