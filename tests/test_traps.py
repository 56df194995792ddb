"""Hand-made trap fixtures (NULL order, ties, NULL amounts, full barns, ...)
for the analytic queries; expected values worked out by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import domain, rows

from hearthvale.plans import events, farm, items, village

ITEM = "id_item long, name string, description string, price_to_buy decimal(18,2), price_to_sell decimal(18,2)"
SHOP = "id_shop long, name_shop string, id_place long, specialization string, description string"
PLAYER = "id_player long, nickname string, gold decimal(18,2), experience long"
BS = ("id_shop long, id_player long, id_item long, action_time timestamp_ntz, action string, "
      "money_fluctuation decimal(18,2), amount long")
CHAR = "id_character long, name string, age long, gender string, id_village long"


def test_null_price_wins_best_discount(spark):
    # E5: DESC NULLS FIRST -> the NULL-priced item is the shop's "best"
    d = domain(spark,
               shop=([(1, "A", 1, "S1", None)], SHOP),
               sell=([(1, 1, D("10.00"))], "id_festivity long, id_shop long, discount decimal(5,2)"),
               s_stored=([(1, 10, 5), (1, 11, 5), (1, 12, 5)], "id_shop long, id_item long, quantity long"),
               item=([(10, "ten", None, D("10.00"), None), (11, "null", None, None, None),
                      (12, "seven", None, D("7.00"), None)], ITEM))
    out = events.best_discount_per_shop(d).collect()
    assert [(r.id_shop, r.id_item, r.item_discount) for r in out] == [(1, 11, None)]


def test_null_amount_item_is_top_and_ties_take_lowest_id(spark):
    # An item whose amounts are all NULL sorts first under DESC (Oracle)
    t = dt.datetime(2024, 1, 1)
    base = dict(shop=([(1, "A", 1, "S1", None), (2, "B", 1, "S2", None)], SHOP),
                item=([(5, "five", None, None, None), (6, "six", None, None, None),
                       (7, "seven", None, None, None)], ITEM))
    d = domain(spark, buy_sell=([(1, 1, 5, t, "BUY", D("-1"), 5), (2, 1, 6, t, "BUY", D("-1"), None)], BS), **base)
    assert [(r.store_name, r.item_name) for r in items.best_item_by_shop(d).collect()] == [("B", "six")]
    d = domain(spark, buy_sell=([(1, 1, 7, t, "BUY", D("-1"), 4), (2, 1, 5, t, "BUY", D("-1"), 4)], BS), **base)
    assert [r.item_name for r in items.best_item_by_shop(d).collect()] == ["five"]


def test_pair_ties_by_ids(spark):
    # I4: health 50 x3, 40, 60 -> four pairs at distance 0, ordered by ids
    food = [(1, "x", 50, 50), (2, "x", 50, 50), (3, "x", 50, 50), (4, "x", 40, 40), (5, "x", 60, 60)]
    d = domain(spark,
               food=(food, "id_food long, ingredients string, energy_regain long, health_regain long"),
               item=([(i, f"i{i}", None, None, None) for i in range(1, 6)], ITEM))
    out = items.closest_pairs(d, target=100, k=4).collect()
    assert [(r.item1, r.item2, r.total_health) for r in out] == [
        ("i1", "i2", 100), ("i1", "i3", 100), ("i2", "i3", 100), ("i4", "i5", 100)]


def test_day_ties_keep_both_ignore_sell(spark):
    # Two BUY rows at the same last second, one SELL later that day
    t1, t2, t3 = (dt.datetime(2024, 12, 3, 9), dt.datetime(2024, 12, 3, 18), dt.datetime(2024, 12, 3, 23))
    d = domain(spark,
               buy_sell=([(1, 1, 1, t1, "BUY", D("-1"), 1), (1, 1, 1, t2, "BUY", D("-2"), 2),
                          (1, 2, 1, t2, "BUY", D("-3"), 3), (1, 1, 1, t3, "SELL", D("4"), 4)], BS),
               shop=([(1, "A", 1, "S1", None)], SHOP),
               player=([(1, "p1", D("1"), 1), (2, "p2", D("1"), 1)], PLAYER),
               item=([(1, "it", None, None, None)], ITEM))
    out = items.last_purchase_of_day(d, month=12).collect()
    assert sorted(r.amount for r in out) == [2, 3]
    assert all(r.date_of_purchase == dt.date(2024, 12, 3) for r in out)


def test_extremes_single_row_once(spark):
    # One SELL row is both max and min -> appears once
    t = dt.datetime(2024, 1, 1)
    d = domain(spark,
               buy_sell=([(1, 1, 1, t, "SELL", D("30.00"), 3)], BS),
               shop=([(1, "A", 1, "S1", None)], SHOP),
               player=([(1, "p1", D("1"), 1)], PLAYER),
               item=([(1, "it", None, D("1.00"), D("8.00"))], ITEM))
    out = items.sale_price_extremes(d).collect()
    assert [(r.item_name, r.money_earned_over_base) for r in out] == [("it", D("2.00"))]


def test_zero_price_is_guarded(spark):
    # PRICE_TO_BUY = 0 and PRICE_TO_SELL = -1 -> NULL percentage, no failure
    d = domain(spark,
               crop=([(1, "Brand#1", None, None, "Cooper")],
                     "id_crop long, name_crop string, growing_season string, growth_duration long, quality string"),
               seed=([(1, "T", "Brand#1")], "id_seed long, seed_type string, name_crop string"),
               item=([(1, "it", None, D("0.00"), D("-1.00"))], ITEM))
    out = items.loss_making_crops(d).collect()
    assert [(r.crop_name, r.price_difference) for r in out] == [("Brand#1", None)]


ANIMAL = ("id_animal long, name_animal string, age long, id_animal_specie long, health string, "
          "id_barn long, quantity long")


def test_barn_mean_counts_sick_animals_and_null_barn_never_matches(spark):
    # barn 1 healthy 3 products, sick 1, healthy 1 -> mean 5/3 -> only the first
    produce = [(1, p) for p in range(3)] + [(2, 0)] + [(3, 0)] + [(4, p) for p in range(9)]
    d = domain(spark,
               animal=([(1, "a", 1, 1, "Healthy", 1, 1), (2, "b", 1, 1, "Sick", 1, 1),
                        (3, "c", 1, 1, "Healthy", 1, 1), (4, "d", 1, 1, "Healthy", None, 1)], ANIMAL),
               produce=(produce, "id_animal long, id_product long"))
    assert [r.id_animal for r in farm.productive_animals(d).collect()] == [1]


def test_rank_cut_counts_nulls(spark):
    # experiences 1..99 and one NULL: N = 100, cut = 97th value = 97
    pl = [(i, f"p{i}", D("100.00") if i > 90 else D("1.00"), i) for i in range(1, 100)]
    pl.append((100, "pnull", D("100.00"), None))
    d = domain(spark, player=(pl, PLAYER))
    out = farm.rich_experts(d).collect()
    assert sorted(r.experience for r in out) == [98, 99]


def test_rank_cut_in_nulls_gives_nothing(spark):
    pl = [(1, "a", D("5.00"), 1)] + [(i, f"n{i}", D("9.00"), None) for i in range(2, 12)]
    d = domain(spark, player=(pl, PLAYER))
    assert farm.rich_experts(d).count() == 0


REL = "id_relationship long, id_character1 long, id_character2 long, affection_level long, type_relation string"


def test_null_age_never_qualifies(spark):
    # V2: affection 1, ages NULL and 60 -> not returned
    d = domain(spark,
               relationship=([(1, 1, 2, 1, "F"), (2, 3, 4, 1, "F")], REL),
               character=([(1, "a", None, None, None), (2, "b", 60, None, None),
                           (3, "c", 10, None, None), (4, "d", 60, None, None)], CHAR))
    out = village.cold_age_gap_pairs(d).collect()
    assert [(r.resident1, r.resident2) for r in out] == [("c", "d")]


def test_overnight_slots(spark):
    # V4: 05:00-01:00, 23:00-01:00, 00:00-09:00; mean start 09:20 -> only the first
    d = domain(spark,
               schedule=([(1, None, "05:00", "01:00", "Mon"), (2, None, "23:00", "01:00", "Mon"),
                          (3, None, "00:00", "09:00", "Mon")],
                         "id_schedule long, season string, start_time string, end_time string, day_of_week string"),
               has=([(7, 1, 1), (7, 1, 2), (7, 1, 3)], "id_inhabitant long, id_place long, id_schedule long"))
    assert rows(village.overnight_slots(d)) == [(7, 1)]


def test_both_roles_are_summed(spark):
    # Id 7 as resident x2 and player x1 -> one row with 3
    d = domain(spark,
               residentevent=([(1, 7, 9), (2, 7, 9), (3, 8, 7), (4, 8, 9)],
                              "id_residentevent long, id_resident long, id_player long"),
               inhabitant=([(7, None, None), (8, None, None)],
                           "id_inhabitant long, personality string, birthday timestamp_ntz"),
               player=([(7, "p7", D("1"), 0), (9, "p9", D("1"), 0)], PLAYER),
               character=([(7, "seven", 1, None, None), (8, "eight", 1, None, None), (9, "nine", 1, None, None)],
                          CHAR))
    got = {r.id_person: r.event_count for r in events.active_people(d).collect()}
    # counts per id over roles: res {7:2, 8:2}, ply {9:3, 7:1} -> mean 2; 7 has 3, 9 has 3
    assert got == {7: 3, 9: 3}


def test_spend_tie_keeps_both(spark):
    # Two persons with equal top spend at one event
    d = domain(spark,
               events_stg=([(1, "fest")], "id long, description string"),
               festivity_persons=([(1, 10, D("5.00")), (1, 11, D("5.00")), (1, 12, D("1.00"))],
                                  "id long, id_person long, gold_expended decimal(18,2)"),
               character=([(10, "a", 1, None, None), (11, "b", 1, None, None), (12, "c", 1, None, None)], CHAR))
    assert sorted(r.name for r in events.top_spender_per_event(d).collect()) == ["a", "b"]


def test_i1_equals_i1b(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    a = rows(E.queries()["loss_making_crops"](spark, sf))
    b = rows(E.queries()["loss_making_crops_outer"](spark, sf))
    assert a == b


def test_best_discount_equals_row_number_over_all_festivals(spark):
    # E5 pre-aggregates festivals per shop; compare with ROW_NUMBER over the
    # full shop x festival x stock join, with NULL discounts, NULL and
    # negative prices and ties
    import random
    rnd = random.Random(5)
    shops = [(s, f"S{s}", 1, "SP", None) for s in range(12)]
    sell = [(f, s, None if rnd.random() < 0.1 else D(rnd.choice([5, 10, 10, 20])))
            for s in range(12) for f in range(rnd.randint(1, 3))]
    items = [(i, f"i{i}", None, None if rnd.random() < 0.1 else D(rnd.choice([-3, 0, 7, 7, 12])), None)
             for i in range(30)]
    stock = [(s, i, 1) for s in range(12) for i in rnd.sample(range(30), 6)]
    d = domain(spark, shop=(shops, SHOP),
               sell=(sell, "id_festivity long, id_shop long, discount decimal(5,2)"),
               s_stored=(stock, "id_shop long, id_item long, quantity long"), item=(items, ITEM))
    got = rows(events.best_discount_per_shop(d).select("id_shop", "id_item", "discount_pct"))
    for name in ("shop", "sell", "s_stored", "item"):
        getattr(d, name).createOrReplaceTempView(f"e5_{name}")
    want = rows(spark.sql("""
        SELECT id_shop, id_item, discount AS discount_pct FROM (
          SELECT s.id_shop, it.id_item, se.discount,
                 row_number() OVER (PARTITION BY s.id_shop ORDER BY it.price_to_buy * se.discount DESC NULLS FIRST,
                                    it.id_item, se.discount DESC NULLS LAST) AS rn
          FROM e5_shop s JOIN e5_sell se ON se.id_shop = s.id_shop
          JOIN e5_s_stored ss ON ss.id_shop = s.id_shop JOIN e5_item it ON it.id_item = ss.id_item)
        WHERE rn = 1"""))
    assert got == want
