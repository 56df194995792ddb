"""Bridge: the supplied TPC-H-like tables projected onto the village data
model (48-table schema, of which the queries read about thirty).

Each property is a lazy DataFrame built only from projections, filters,
aggregates and equi-joins of the supplied tables, so its work grows with
them and Catalyst prunes every column a query does not use. The same
projections are spelled as SQL CTEs in ``hearthvale.oracle.bridge`` for
the DuckDB oracle.

Where one domain table needs two differently shaped worlds (the trade farms
of F2/F4 versus the player farms of F5, the event purchases of I3 versus
the trade ledger), both are offered under distinct names.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.sources.testdata import TestTables

# Fixed values of the bridge (chosen by us, mirrored in the oracle CTEs).
NULL_PRICE_EVERY = 17          # items whose key is a multiple have no buy price
CROP_QUALITY = ("Cooper", "Gold", "Silver")   # brand number mod 3
BOOK_TYPES = ("PROMO", "STANDARD")
MINERAL_TYPES = ("SMALL", "LARGE")
FIELD_TYPE = "SMALL"           # farm buildings of this part type are fields
KEY_STRIDE = 10_000_000_000    # composite (supplier, part) -> one long key
CENT = Decimal("0.01")


def _lit_ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


class Domain:
    """Lazy domain tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = TestTables(spark, sf_dir)

    # ------------------------------------------------------------ items
    @cached_property
    def item(self) -> DataFrame:
        p = self.t.part
        buy = F.col("p_retailprice").cast("decimal(18,2)")
        return p.select(
            F.col("p_partkey").alias("id_item"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("description"),
            F.when(F.col("p_partkey") % NULL_PRICE_EVERY == 0, F.lit(None).cast("decimal(18,2)"))
             .otherwise(buy).alias("price_to_buy"),
            (buy * (F.lit(50) + F.lit(2) * F.col("p_size")) * F.lit(CENT))
            .cast("decimal(18,2)").alias("price_to_sell"),
        )

    @cached_property
    def seed(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("id_seed"),
            F.col("p_type").alias("seed_type"),
            F.col("p_brand").alias("name_crop"),
        )

    @cached_property
    def food(self) -> DataFrame:
        return self.t.part.select(
            F.col("p_partkey").alias("id_food"),
            F.col("p_type").alias("ingredients"),
            F.col("p_size").cast("bigint").alias("energy_regain"),
            F.col("p_size").cast("bigint").alias("health_regain"),
        )

    @cached_property
    def crop(self) -> DataFrame:
        n = F.substring("p_brand", 7, 10).cast("bigint")
        q = (F.when(n % 3 == 0, CROP_QUALITY[0]).when(n % 3 == 1, CROP_QUALITY[1])
             .otherwise(CROP_QUALITY[2]))
        return (self.t.part.select("p_brand").distinct()
                .select(n.alias("id_crop"), F.col("p_brand").alias("name_crop"),
                        F.lit(None).cast("string").alias("growing_season"),
                        F.lit(None).cast("bigint").alias("growth_duration"),
                        q.alias("quality")))

    # ------------------------------------------------------------ people
    @cached_property
    def character(self) -> DataFrame:
        return self.t.customer.select(
            F.col("c_custkey").alias("id_character"),
            F.col("c_name").alias("name"),
            (F.lit(1) + F.col("c_custkey") % 80).cast("bigint").alias("age"),
            F.col("c_mktsegment").alias("gender"),
            F.col("c_nationkey").cast("bigint").alias("id_village"),
        )

    @cached_property
    def inhabitant(self) -> DataFrame:
        days = (F.col("c_custkey") * 13 % 1000).cast("int")
        return self.t.customer.select(
            F.col("c_custkey").alias("id_inhabitant"),
            F.col("c_mktsegment").alias("personality"),
            F.date_add(F.lit("1998-01-01").cast("date"), days).cast("timestamp_ntz").alias("birthday"),
        )

    @cached_property
    def player(self) -> DataFrame:
        n_orders = self.t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
        c = self.t.customer
        return (c.join(n_orders, c.c_custkey == n_orders.o_custkey, "left")
                .select(F.col("c_custkey").alias("id_player"),
                        F.col("c_name").alias("nickname"),
                        F.col("c_acctbal").cast("decimal(18,2)").alias("gold"),
                        F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("experience")))

    # ------------------------------------------------------------ trade
    @cached_property
    def shop(self) -> DataFrame:
        return self.t.supplier.select(
            F.col("s_suppkey").alias("id_shop"),
            F.col("s_name").alias("name_shop"),
            F.col("s_nationkey").cast("bigint").alias("id_place"),
            F.concat(F.lit("S"), (F.col("s_suppkey") % 5).cast("string")).alias("specialization"),
            F.lit(None).cast("string").alias("description"),
        )

    @cached_property
    def place(self) -> DataFrame:
        return self.t.nation.select(
            F.col("n_nationkey").cast("bigint").alias("id_place"),
            F.col("n_name").alias("location_name"),
            F.col("n_regionkey").cast("string").alias("coordinates"),
        )

    @cached_property
    def buy_sell(self) -> DataFrame:
        """Trade ledger: one row per line item; returned lines are sales."""
        li = self.t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_shipdate",
                                    "l_returnflag", "l_extendedprice", "l_quantity")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        sell = F.col("l_returnflag") == "R"
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .select(F.col("l_suppkey").alias("id_shop"),
                        F.col("o_custkey").alias("id_player"),
                        F.col("l_partkey").alias("id_item"),
                        F.col("l_shipdate").alias("action_time"),
                        F.when(sell, "SELL").otherwise("BUY").alias("action"),
                        F.when(sell, price).otherwise(-price).alias("money_fluctuation"),
                        F.col("l_quantity").cast("bigint").alias("amount")))

    @cached_property
    def buy_sell_events(self) -> DataFrame:
        """Ledger with a time of day: purchase events are BUY, the rest SELL."""
        e = self.t.events
        buy = F.col("event_type") == "purchase"
        v = F.col("value").cast("decimal(18,2)")
        return e.select(
            (F.col("user_id") % 10).alias("id_shop"),
            F.col("user_id").alias("id_player"),
            F.col("user_id").alias("id_item"),
            F.col("ts").alias("action_time"),
            F.when(buy, "BUY").otherwise("SELL").alias("action"),
            F.when(buy, -v).otherwise(v).alias("money_fluctuation"),
            F.ceil("value").cast("bigint").alias("amount"),
        )

    @cached_property
    def s_stored(self) -> DataFrame:
        return (self.t.lineitem.groupBy("l_suppkey", "l_partkey")
                .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
                .select(F.col("l_suppkey").alias("id_shop"), F.col("l_partkey").alias("id_item"),
                        "quantity"))

    @cached_property
    def p_stored(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .groupBy("o_custkey", "l_partkey")
                .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
                .select(F.col("o_custkey").alias("id_player"), F.col("l_partkey").alias("id_item"),
                        "quantity"))

    @cached_property
    def sell(self) -> DataFrame:
        """Two festivities per shop, each with its own discount."""
        s = self.t.supplier
        f1 = s.select(F.lit(1).cast("bigint").alias("id_festivity"), F.col("s_suppkey").alias("id_shop"),
                      (F.lit(5) + F.col("s_suppkey") % 20).cast("decimal(5,2)").alias("discount"))
        f2 = s.select(F.lit(2).cast("bigint").alias("id_festivity"), F.col("s_suppkey").alias("id_shop"),
                      (F.lit(10) + F.col("s_suppkey") % 7).cast("decimal(5,2)").alias("discount"))
        return f1.unionByName(f2)

    # ------------------------------------------------------------ missions
    @cached_property
    def player_mission(self) -> DataFrame:
        last = self.t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_date"))
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        done = (F.col("o_orderstatus") == "F") & (F.col("end_date") > F.col("o_orderdate"))
        return (o.join(last, o.o_orderkey == last.l_orderkey)
                .select(F.col("o_custkey").alias("id_player"),
                        F.col("o_orderkey").alias("id_mission"),
                        F.col("o_orderdate").alias("start_date"),
                        F.col("end_date"),
                        F.when(done, 1).otherwise(0).cast("int").alias("is_completed")))

    # ------------------------------------------------------------ farms
    @cached_property
    def farm(self) -> DataFrame:
        """Trade farms (F2/F4): one per supplier."""
        return self.t.supplier.select(
            F.col("s_suppkey").alias("id_farm"),
            (F.col("s_acctbal").cast("decimal(18,2)") * 4).cast("decimal(10,2)").alias("hectares"),
            F.concat(F.lit("S"), (F.col("s_suppkey") % 5).cast("string")).alias("specialization"),
            F.col("s_suppkey").alias("id_player"),
        )

    @cached_property
    def _supplied_parts(self) -> DataFrame:
        sp = self.t.lineitem.select("l_suppkey", "l_partkey").distinct()
        p = self.t.part.select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
        return sp.join(p, sp.l_partkey == p.p_partkey)

    @cached_property
    def farmbuilding(self) -> DataFrame:
        return self._supplied_parts.select(
            (F.col("l_suppkey") * KEY_STRIDE + F.col("l_partkey")).alias("id_farm_building"),
            F.col("p_name").alias("name_building"),
            F.col("p_type").alias("description"),
            F.col("p_size").cast("decimal(10,2)").alias("building_size"),
            F.col("l_suppkey").alias("id_farm"),
        )

    @cached_property
    def cultivationfield(self) -> DataFrame:
        return (self._supplied_parts.filter(F.col("p_type") == FIELD_TYPE)
                .select((F.col("l_suppkey") * KEY_STRIDE + F.col("l_partkey")).alias("id_field"),
                        F.col("p_size").cast("decimal(10,2)").alias("cost"),
                        F.lit("Planted").alias("state")))

    @cached_property
    def grow(self) -> DataFrame:
        return (self._supplied_parts.filter(F.col("p_type") == FIELD_TYPE)
                .select((F.col("l_suppkey") * KEY_STRIDE + F.col("l_partkey")).alias("id_field"),
                        F.substring("p_brand", 7, 10).cast("bigint").alias("id_crop")))

    @cached_property
    def animal(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").alias("id_animal"),
            F.concat(F.lit("Animal#"), F.col("o_orderkey").cast("string")).alias("name_animal"),
            (F.col("o_orderkey") % 15).alias("age"),
            F.substring("o_orderpriority", 1, 1).cast("bigint").alias("id_animal_specie"),
            F.when(F.col("o_orderstatus") == "F", "Healthy").otherwise("Sick").alias("health"),
            F.col("o_custkey").alias("id_barn"),
            F.lit(1).cast("bigint").alias("quantity"),
        )

    @cached_property
    def produce(self) -> DataFrame:
        return (self.t.lineitem.select(F.col("l_orderkey").alias("id_animal"),
                                       F.col("l_partkey").alias("id_product"))
                .distinct())

    @cached_property
    def farm_p(self) -> DataFrame:
        """Player farms (F5): each customer owns one farm holding one barn."""
        return self.t.customer.select(F.col("c_custkey").alias("id_farm"),
                                      F.col("c_custkey").alias("id_player"))

    @cached_property
    def farmbuilding_p(self) -> DataFrame:
        return self.t.customer.select(F.col("c_custkey").alias("id_farm_building"),
                                      F.col("c_custkey").alias("id_farm"))

    @cached_property
    def barn(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.t.customer.select(
            k.alias("id_barn"),
            F.when(k % 23 == 0, F.lit(None)).otherwise(F.lit(5) + k % 10).cast("bigint").alias("max_capacity"),
            (k % 7).cast("bigint").alias("occupied_spots"),
        )

    # ------------------------------------------------------------ village
    @cached_property
    def relationship(self) -> DataFrame:
        from hearthvale.operators.edges import canonical_edges
        li = self.t.lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        # Every line links its supplier to the head of the customer's household
        # (the even key of a pair); other members have no links of their own.
        raw = (li.join(o, li.l_orderkey == o.o_orderkey)
               .select((F.col("o_custkey") + F.col("o_custkey") % 2).alias("a"), F.col("l_suppkey").alias("b"),
                       F.col("l_quantity").cast("bigint").alias("w")))
        known = self.character.select(F.col("id_character").alias("id"))
        e = canonical_edges(raw, "a", "b", "w", known)
        return e.select(
            (F.col("src") * KEY_STRIDE + F.col("dst")).alias("id_relationship"),
            F.col("src").alias("id_character1"),
            F.col("dst").alias("id_character2"),
            F.col("w").alias("affection_level"),
            F.lit("Friend").alias("type_relation"),
        )

    @cached_property
    def letter(self) -> DataFrame:
        o = self.t.orders
        return o.select(
            F.col("o_orderkey").alias("id_letter"),
            F.col("o_orderpriority").alias("content"),
            F.lit(None).cast("string").alias("font"),
            F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_custkey") % 200)
             .cast("bigint").alias("id_item"),
            F.lit(None).cast("bigint").alias("id_mission"),
        )

    @cached_property
    def receive(self) -> DataFrame:
        return (self.t.lineitem.select(F.col("l_partkey").alias("id_inhabitant"),
                                       F.col("l_suppkey").alias("id_player"),
                                       F.col("l_orderkey").alias("id_letter"))
                .distinct()
                .withColumn("emotion", F.lit(None).cast("string")))

    @cached_property
    def schedule(self) -> DataFrame:
        e = self.t.events
        mins = F.floor(F.col("value") * 10).cast("int")
        end = F.timestamp_add("MINUTE", mins, F.col("ts"))
        return e.select(
            F.col("event_id").alias("id_schedule"),
            F.lit(None).cast("string").alias("season"),
            F.date_format("ts", "HH:mm").alias("start_time"),
            F.date_format(end, "HH:mm").alias("end_time"),
            F.col("event_type").alias("day_of_week"),
        )

    @cached_property
    def has(self) -> DataFrame:
        return self.t.events.select(
            F.col("user_id").alias("id_inhabitant"),
            (F.col("user_id") % 25).alias("id_place"),
            F.col("event_id").alias("id_schedule"),
        )

    # ------------------------------------------------------------ events
    @cached_property
    def residentevent(self) -> DataFrame:
        return self.t.events.select(
            F.col("event_id").alias("id_residentevent"),
            F.col("user_id").alias("id_resident"),
            (F.col("user_id") % 50).alias("id_player"),
        )

    @cached_property
    def events_stg(self) -> DataFrame:
        """Staging EVENTS for E2: one festival per region."""
        return self.t.region.select(F.col("r_regionkey").cast("bigint").alias("id"),
                                    F.col("r_name").alias("description"))

    @cached_property
    def festivity_persons(self) -> DataFrame:
        """Staging FESTIVITY_PERSONS: each order is a spend at its region's festival."""
        o = self.t.orders.select("o_custkey", "o_totalprice")
        c = self.t.customer.select("c_custkey", "c_nationkey")
        n = self.t.nation.select("n_nationkey", "n_regionkey")
        return (o.join(c, o.o_custkey == c.c_custkey)
                .join(n, c.c_nationkey == n.n_nationkey)   # nation: 25 rows, fixed
                .select(F.col("n_regionkey").cast("bigint").alias("id"),
                        F.col("o_custkey").alias("id_person"),
                        F.col("o_totalprice").cast("decimal(18,2)").alias("gold_expended")))

    @cached_property
    def museum_registry(self) -> DataFrame:
        """Staging MUSEUM_REGISTRY: a nation's museum lists the parts its suppliers ship."""
        li = self.t.lineitem.select("l_suppkey", "l_partkey")
        s = self.t.supplier.select("s_suppkey", "s_nationkey")
        return (li.join(s, li.l_suppkey == s.s_suppkey)
                .select(F.col("s_nationkey").cast("bigint").alias("id_museum"),
                        F.lit(50).cast("decimal(5,2)").alias("percentage_remaining"),
                        F.col("l_partkey").alias("donable_item")))

    @cached_property
    def donatable(self) -> DataFrame:
        return self.t.part.select(F.col("p_partkey").alias("id"))

    @cached_property
    def book(self) -> DataFrame:
        return (self.t.part.filter(F.col("p_type").isin(*BOOK_TYPES))
                .select(F.col("p_partkey").alias("id_book"), F.col("p_name").alias("title"),
                        F.col("p_size").cast("bigint").alias("num_pages")))

    @cached_property
    def mineral(self) -> DataFrame:
        return (self.t.part.filter(F.col("p_type").isin(*MINERAL_TYPES))
                .select(F.col("p_partkey").alias("id_mineral"), F.col("p_brand").alias("quality"),
                        F.col("p_size").cast("string").alias("rarity")))

    @cached_property
    def donation(self) -> DataFrame:
        li = self.t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
        o = self.t.orders.select("o_orderkey", "o_custkey")
        g = (li.join(o, li.l_orderkey == o.o_orderkey)
             .groupBy(F.col("o_custkey").alias("id_player"), F.col("l_partkey").alias("id_donatable"),
                      (F.col("l_suppkey") % 10).alias("id_museum"))
             .agg(F.min("l_returnflag").alias("flag")))
        cond = F.when(F.col("flag") == "A", "New").when(F.col("flag") == "N", "new").otherwise("Used")
        return g.select("id_donatable", "id_museum", "id_player", cond.alias("condition_object"))

    @cached_property
    def event(self) -> DataFrame:
        """EVENT for E6: every order is an event at one of its customer's eight places."""
        return self.t.orders.select(F.col("o_orderkey").alias("id_event"),
                        F.lit(None).cast("string").alias("start_time"),
                        F.lit(None).cast("string").alias("end_time"),
                        F.col("o_orderpriority").alias("description"),
                        (F.col("o_custkey") * 8 + F.col("o_orderkey") % 8).alias("id_place"))

    @cached_property
    def place_e6(self) -> DataFrame:
        c = self.t.customer.select("c_custkey", "c_name", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("spot"))
        return c.select((F.col("c_custkey") * 8 + F.col("spot")).alias("id_place"),
                        F.concat("c_name", F.lit("/"), F.col("spot").cast("string")).alias("location_name"))
