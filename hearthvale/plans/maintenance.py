"""Entries for table maintenance: change feed, keyed update, lasting ids,
cascade over a graph, header-checked scan, factorised product, audit on writing.

They write tables in the shared folder while they run, as the loads do, and
return what those tables hold.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthvale.operators import audit, keyed_table
from hearthvale.operators.cascade import deleted_keys
from hearthvale.operators.changes import row_changes
from hearthvale.operators.factorised import Product
from hearthvale.operators.keys import register_ids
from hearthvale.plans.audit import audited_tables
from hearthvale.plans.etl import UNFILLED_FARM_EVERY
from hearthvale.plans.loads import audited, participate, run
from hearthvale.plans.streams import personality_changes
from hearthvale.schemas import TABLES
from hearthvale.session import fresh_folder
from hearthvale.sources.staging import scan_extract
from hearthvale.sources.staging_bridge import staging_from_tables

# Fixed values of the derivations (mirrored in the oracle SQL).
LATER_EVERY, LEFT_EVERY = 13, 17        # residents of the new version alone, of the old one alone
SHORT_EVERY, LONG_EVERY = 41, 43        # extract lines with too few, too many fields
BUCKETS = 32


def etl_personality_feed(d) -> DataFrame:
    """T3's input: what an update of INHABITANT changed, from its two versions
    (inserted, deleted and changed residents; null to value and back)."""
    both = personality_changes(d)
    old = both.filter(F.col("id_inhabitant") % LATER_EVERY != 0).select("id_inhabitant", F.col("old_personality").alias("personality"))
    new = both.filter(F.col("id_inhabitant") % LEFT_EVERY != 0).select("id_inhabitant", F.col("new_personality").alias("personality"))
    return row_changes(old, new, ["id_inhabitant"], ["personality"])


def etl_fill_missing_keyed(d) -> DataFrame:
    """S3/M8: the update of FARM on a keyed table, twice (the second changes
    nothing); only the buckets of farms it fills are read and written."""
    s, spark = d.t.supplier, d.spark
    path = fresh_folder(spark, "farm-keyed")
    k = F.col("s_suppkey")
    farm = s.select(k.alias("id_farm"), F.when(k % UNFILLED_FARM_EVERY != 0, k).alias("id_player"))
    li, o = d.t.lineitem.select("l_orderkey", "l_suppkey"), d.t.orders.select("o_orderkey", "o_custkey")
    players = d.t.customer.filter(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    named = (li.join(o, li.l_orderkey == o.o_orderkey).join(players, "o_custkey", "left_semi")
             .select(F.col("l_suppkey").alias("id_farm"), "o_custkey"))
    keyed_table.create(farm, path, ["id_farm"], BUCKETS)
    for _ in range(2):
        keyed_table.fill_missing(spark, path, ["id_farm"], BUCKETS, "id_player", named, "o_custkey")
    return keyed_table.read(spark, path)


def etl_lasting_ids(d) -> DataFrame:
    """M6: a dimension numbered by two runs over overlapping sources: the second
    gives known names their old ids and numbers new ones on."""
    path, p = fresh_folder(d.spark, "name-ids"), d.t.part
    brands = p.select(F.col("p_brand").alias("name"))
    first = p.filter(F.col("p_partkey") % 2 == 0).select(F.col("p_brand").alias("name"))
    second = brands.unionByName(p.select(F.col("p_type").alias("name")))
    one = register_ids(first, ["name"], path, 1000).select(F.lit(1).alias("run"), "name", "id")
    one = one.checkpoint()          # the map as of the first run
    two = register_ids(second, ["name"], path, 1000).select(F.lit(2).alias("run"), "name", "id")
    return one.unionByName(two)


# Deletions that the declared schema passes on (FOLLOW), and two more levels.
CASCADES = TABLES | {"shop": replace(TABLES["shop"], cascade=("place",)), "s_stored": replace(TABLES["s_stored"], cascade=("shop",))}


def etl_cascade_graph(d) -> DataFrame:
    """Places and schedules go, with them the places' shops, and with those
    their stock and their FOLLOW rows (composite keys, reached on two ways)."""
    slots = d.t.lineitem.select(F.col("l_suppkey").alias("id_shop"),
                                (F.month("l_shipdate") * 10 + F.col("l_linenumber") % 3).cast("bigint").alias("id_schedule")).distinct()
    tables = {"place": d.place, "shop": d.shop, "s_stored": d.s_stored, "follow": slots, "schedule": slots.select("id_schedule").distinct()}
    gone = deleted_keys(tables, {"place": d.place.filter(F.col("id_place") % 5 == 0),
                                 "schedule": tables["schedule"].filter(F.col("id_schedule") % 7 == 3)}, CASCADES)
    out = None
    for name, keys in sorted(gone.items()):
        first, *rest = TABLES[name].pk
        second = F.col(rest[0]) if rest else F.lit(None).cast("bigint")
        part = keys.select(F.lit(name).alias("table_name"), F.col(first).alias("key1"), second.alias("key2"))
        out = part if out is None else out.unionByName(part)
    return out


def _line(fields: list[Column]) -> Column:
    k, whole = F.col("o_orderkey"), F.concat_ws(",", *fields)
    return (F.when(k % SHORT_EVERY == 0, F.concat_ws(",", *fields[:3]))
            .when(k % LONG_EVERY == 0, F.concat_ws(",", whole, F.lit("more"))).otherwise(whole))


def ingest_extract(d) -> DataFrame:
    """An extract in two files of different column order, with columns nobody
    reads and lines of another length: rows by header name, lines quarantined."""
    folder, o = fresh_folder(d.spark, "extract"), d.t.orders
    col = {"ID_ACTIVITY": F.col("o_orderkey").cast("string"), "SPECIAL_FACTOR": F.col("o_orderpriority"),
           "DESCRIPTION": F.concat(F.lit("Activity "), F.col("o_orderpriority")), "DURATION": (F.col("o_orderkey") % 5 + 1).cast("string"),
           "ID_EVENT": F.when(F.col("o_custkey") % 3 == 0, "").otherwise((F.col("o_custkey") % 5).cast("string")),
           "REWARD_ITEM": (F.col("o_custkey") % 200).cast("string"), "NOTE": F.lit("x")}
    layouts = (["DURATION", "ID_ACTIVITY", "DESCRIPTION", "NOTE", "SPECIAL_FACTOR", "REWARD_ITEM", "ID_EVENT"],
               ["ID_EVENT", "NOTE", "REWARD_ITEM", "ID_ACTIVITY", "SPECIAL_FACTOR", "DURATION", "DESCRIPTION"])
    for i, names in enumerate(layouts):
        header = ",".join(n.lower() if i else n for n in names)
        mine = o.filter(F.col("o_orderkey") % 2 == i).select(_line([col[n] for n in names]).alias(header))
        mine.write.mode("append").option("header", True).option("sep", "\x01").option("quote", "").csv(folder)
    rows, bad = scan_extract(d.spark, "ACTIVITIES", folder)
    names = ["ID_ACTIVITY", "SPECIAL_FACTOR", "DESCRIPTION", "DURATION", "ID_EVENT", "REWARD_ITEM"]
    none = [F.lit(None).cast("string").alias(n.lower()) for n in names]
    return (rows.select(F.lit("row").alias("kind"), *[F.col(n).alias(n.lower()) for n in names], F.lit(None).cast("string").alias("record"))
            .unionByName(bad.select(F.lit("quarantined").alias("kind"), *none, "record")))


def etl_participate_factors(d) -> DataFrame:
    """J15 / load 45 as factors: rows, repeated keys, orphans, rows per activity
    and per player, and how many orders' (activity, player, reward) are in it."""
    product: Product = participate(staging_from_tables(d.t))
    o = d.t.orders
    asked = o.select(F.substring("o_orderpriority", 1, 1).cast("bigint").alias("id_activity"), F.col("o_custkey").alias("id_player"),
                     (F.col("o_custkey") % 200).alias("id_specialitem"))
    none = F.lit(None).cast("bigint")
    numbers = {"rows": product.rows(), "repeated_keys": product.repeated_keys(TABLES["participate"].pk),
               "orphan_players": product.orphans("id_player", d.t.customer.filter(F.col("c_custkey") % 10 != 0), "c_custkey")}
    parts = [product.one_row().select(F.lit(name).alias("measure"), none.alias("id"), n.cast("bigint").alias("n")) for name, n in numbers.items()]
    parts.append(product.holds(asked).agg(F.count(F.lit(1)).alias("n")).select(F.lit("held").alias("measure"), none.alias("id"), "n"))
    for key in ("id_activity", "id_player"):
        parts.append(product.totals(key).select(F.lit(key).alias("measure"), F.col(key).alias("id"), F.col("n_rows").cast("bigint").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_on_write(d) -> DataFrame:
    """M10 while tables are written: the report of ``audit_constraints`` from
    metrics of the writes and one scan of each written table's keys."""
    _, report = audit.audit_while_writing(audited_tables(d))
    return audit.report_frame(d.spark, report)


def etl_load_audit(d) -> DataFrame:
    """M10 over all tables of the model: the full load with its audit."""
    out_dir = fresh_folder(d.spark, "loads")
    run(d.spark, staging_from_tables(d.t), out_dir)
    return audited(d.spark, out_dir)
