"""Item queries I1–I6: pure functions of domain DataFrames with parameters.

Defaults are the reference's parameter values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.functions.scalar import round2, safe_div, trunc_day
from hearthvale.operators.pairs import closest_pair_sums
from hearthvale.operators.topk import extremes_per_group, rank1_per_group, top1_by


def _pct_difference() -> F.Column:
    buy, sell = F.col("price_to_buy"), F.col("price_to_sell")
    return round2(safe_div((sell - buy) * 100, buy))


def loss_making_crops(d, quality: str = "COOPER") -> DataFrame:
    """Seeds of crops of one quality that sell below their buy price."""
    crop = d.crop.filter(F.upper("quality") == quality).select("name_crop")
    seed = d.seed.select("id_seed", "seed_type", "name_crop")
    item = d.item.filter(F.col("price_to_buy").isNotNull() & F.col("price_to_sell").isNotNull()
                         & (F.col("price_to_sell") < F.col("price_to_buy")))
    j = crop.join(seed, "name_crop").join(item, F.col("id_item") == F.col("id_seed"))
    return (j.select(F.col("name_crop").alias("crop_name"), F.col("seed_type").alias("type"),
                     F.col("price_to_buy").alias("price_to_buy_normal"),
                     F.col("price_to_sell"), _pct_difference().alias("price_difference"))
            .orderBy(F.col("price_difference").asc_nulls_last()))


def loss_making_crops_outer(d, quality: str = "COOPER") -> DataFrame:
    """The same question through left joins; the WHERE on the outer
    side makes them inner (Catalyst rewrites them), so I1b == I1."""
    i, s, c = d.item.alias("i"), d.seed.alias("s"), d.crop.alias("c")
    j = (i.join(s, F.col("s.id_seed") == F.col("i.id_item"), "left")
          .join(c, F.col("c.name_crop") == F.col("s.name_crop"), "left")
          .filter((F.upper("c.quality") == quality) & F.col("i.price_to_buy").isNotNull()
                  & F.col("i.price_to_sell").isNotNull()
                  & (F.col("i.price_to_sell") < F.col("i.price_to_buy"))))
    return (j.select(F.col("c.name_crop").alias("crop_name"), F.col("s.seed_type").alias("type"),
                     F.col("i.price_to_buy").alias("price_to_buy_normal"),
                     F.col("i.price_to_sell").alias("price_to_sell"),
                     _pct_difference().alias("price_difference"))
            .orderBy(F.col("price_difference").asc_nulls_last()))


def best_item_by_shop(d, action: str = "BUY") -> DataFrame:
    """The most-bought item overall, then its purchases per shop name.

    The top item is one row (``TakeOrderedAndProject``; ties -> lowest id,
    an all-NULL total sorts first as in a DESC Oracle sort); that single row
    is the only thing broadcast.
    """
    bs = d.buy_sell.filter(F.col("action") == action).select("id_shop", "id_item", "amount")
    # the ledger is aggregated once per (item, shop); both the item totals and
    # the per-shop rows come from that (much smaller) aggregate
    pairs = bs.groupBy("id_item", "id_shop").agg(F.sum("amount").alias("amt"))
    totals = pairs.groupBy("id_item").agg(F.sum("amt").alias("total"))
    best = top1_by(totals, [F.col("total").desc_nulls_first(), F.col("id_item").asc()]).select("id_item")
    rows = pairs.join(F.broadcast(best), "id_item")
    j = (rows.join(d.shop.select("id_shop", "name_shop", "specialization"), "id_shop")
             .join(d.item.select("id_item", "name"), "id_item"))
    return (j.groupBy("name_shop", "specialization", "name")
             .agg(F.sum("amt").alias("num_purchases"))
             .select(F.col("name_shop").alias("store_name"), "specialization",
                     F.col("name").alias("item_name"), "num_purchases")
             .orderBy(F.col("num_purchases").desc_nulls_first(), F.col("store_name").asc_nulls_last()))


def last_purchase_of_day(d, month: int = 12, ledger: DataFrame | None = None) -> DataFrame:
    """BUY rows of one month made at the last BUY time of their day.

    Correlated ``MAX`` per day becomes rank 1 within the day, cut down before
    the shuffle to the rows tied for a task's last time of each day; the ledger
    is read once.
    """
    ledger = d.buy_sell if ledger is None else ledger
    buys = (ledger.filter((F.col("action") == "BUY") & (F.month("action_time") == month))
            .withColumn("day", trunc_day(F.col("action_time"))))
    sel = rank1_per_group(buys, ["day"], "action_time")
    j = (sel.join(d.shop.select("id_shop", "name_shop", "specialization"), "id_shop")
            .join(d.player.select("id_player", "nickname"), "id_player")
            .join(d.item.select("id_item", "name"), "id_item"))
    return (j.select(F.col("name_shop").alias("shop_name"), "specialization",
                     F.col("nickname").alias("player_name"), F.col("name").alias("item_name"),
                     "amount", F.abs("money_fluctuation").alias("gold_expended"),
                     F.col("day").alias("date_of_purchase"))
            .orderBy("date_of_purchase"))


def closest_pairs(d, target: int = 100, k: int = 20) -> DataFrame:
    """I4: the k food pairs whose health sum is closest to ``target``
    (ties broken by the two ids, ascending)."""
    top = closest_pair_sums(d.food, "id_food", "health_regain", float(target), k)
    names = d.item.select("id_item", "name")
    n1 = names.select(F.col("id_item").alias("id1"), F.col("name").alias("item1"))
    n2 = names.select(F.col("id_item").alias("id2"), F.col("name").alias("item2"))
    return (top.join(n1, "id1").join(n2, "id2")
               .select("item1", "item2", (F.col("v1") + F.col("v2")).cast("bigint").alias("total_health"),
                       "dist", "id1", "id2")
               .orderBy("dist", "id1", "id2")
               .select("item1", "item2", "total_health"))


def busy_locations(d, threshold: float = 200) -> DataFrame:
    """Transactions moving more than ``threshold`` gold, per location."""
    # counted per shop first: the joins see one row per shop, not per transaction
    per_shop = (d.buy_sell.filter(F.abs("money_fluctuation") > threshold)
                .groupBy("id_shop").agg(F.count(F.lit(1)).alias("n")))
    j = per_shop.join(d.shop.select("id_shop", "id_place"), "id_shop").join(
        d.place.select("id_place", "location_name"), "id_place")
    return (j.groupBy("location_name").agg(F.sum("n").alias("transaction_count"))
             .orderBy(F.col("transaction_count").desc_nulls_first()))


def sale_price_extremes(d) -> DataFrame:
    """SELL rows whose unit price is the item's highest or lowest.

    Both correlated scalars come from one reading of the ledger, per (item,
    salt) first; a row matching both appears once.
    """
    sells = (d.buy_sell.filter((F.col("action") == "SELL") & (F.col("amount") > 0))
             .withColumn("unit", F.abs("money_fluctuation") / F.col("amount")))
    sel = extremes_per_group(sells, ["id_item"], "unit")
    j = (sel.join(d.item.select("id_item", "name", "price_to_sell"), "id_item")
            .join(d.shop.select("id_shop", "name_shop"), "id_shop")
            .join(d.player.select("id_player", "nickname"), "id_player"))
    return (j.select(F.col("name").alias("item_name"), F.col("name_shop").alias("shop"),
                     F.col("nickname").alias("player_name"),
                     F.round(F.col("unit") - F.col("price_to_sell"), 2).cast("decimal(18,2)")
                     .alias("money_earned_over_base"))
            .orderBy(F.col("item_name").asc_nulls_last(), F.col("money_earned_over_base").desc_nulls_first()))
