"""Farm queries F1–F6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.functions.scalar import safe_div, seconds_between
from hearthvale.operators.joins import not_in
from hearthvale.operators.rank_cut import value_at_rank
from hearthvale.operators.topk import all_ties_max


def fast_players(d, k: int = 10) -> DataFrame:
    """players whose mean completed-mission time is below the global
    mean; the ``k`` fastest (ties by player id). Times are in seconds."""
    pm = (d.player_mission
          .filter((F.col("is_completed") == 1) & (F.col("end_date") > F.col("start_date")))
          .select("id_player", seconds_between(F.col("start_date"), F.col("end_date")).alias("secs")))
    # one aggregate per player; the global mean comes from the per-player
    # partial sums, so the mission chain is not evaluated a second time
    per = (pm.groupBy("id_player").agg(F.sum("secs").alias("s"), F.count(F.lit(1)).alias("n"))
           .withColumn("avg_timespan", F.col("s").cast("double") / F.col("n")))
    overall = per.agg(F.sum("s").cast("double") / F.sum("n")).scalar()
    j = per.filter(F.col("avg_timespan") < overall).join(d.player.select("id_player", "nickname"), "id_player")
    return (j.select("id_player", F.col("nickname").alias("name"), "avg_timespan")
             .orderBy(F.col("avg_timespan").asc_nulls_last(), "id_player").limit(k))


def max_gold_farms(d, quality: str = "Gold") -> DataFrame:
    """farms growing the most crops of one quality (ties kept).

    The reference evaluates the five-table chain twice; here once, and the
    farms of the highest count are those of rank 1.
    """
    crop = d.crop.filter(F.col("quality") == quality).select("id_crop")
    # counted per field first, so the field and building joins see one row
    # per field; summing per farm gives the same COUNT(*) as the full chain
    per_field = d.grow.join(crop, "id_crop").groupBy("id_field").agg(F.count(F.lit(1)).alias("n"))
    fields = (per_field.join(d.cultivationfield.select("id_field"), "id_field")
              .join(d.farmbuilding.select(F.col("id_farm_building").alias("id_field"), "id_farm"), "id_field"))
    per_farm = fields.groupBy("id_farm").agg(F.sum("n").alias("num_crops"))
    counts = per_farm.join(d.farm.select("id_farm", "specialization"), "id_farm")
    return all_ties_max(counts, "num_crops").select("id_farm", "specialization", "num_crops").orderBy("id_farm")


def productive_animals(d, health: str = "Healthy") -> DataFrame:
    """healthy animals with more products than their barn's mean.

    The barn mean covers every animal of the barn that has a product
    (whatever its health). Correlated subquery -> per-animal counts, one
    aggregate per barn, equi-join back; animals without a barn never match.
    """
    n = d.produce.groupBy("id_animal").agg(F.count("id_product").alias("num_products"))
    a = d.animal.select("id_animal", "id_barn", "name_animal", "age", "health")
    counts = a.join(n, "id_animal")
    barn_mean = (counts.filter(F.col("id_barn").isNotNull())
                 .groupBy("id_barn").agg(F.avg("num_products").alias("barn_mean")))
    res = (counts.filter(F.col("health") == health).join(barn_mean, "id_barn")
           .filter(F.col("num_products") > F.col("barn_mean")))
    return (res.select("id_barn", "id_animal", F.col("name_animal").alias("animal_name"), "age",
                       F.col("health").alias("health_status"), "num_products")
               .orderBy("id_barn", "id_animal"))


def farm_free_space(d, max_hectares: float = 600000) -> DataFrame:
    """space left per farm and how many smallest buildings still fit.

    Buildings are aggregated per farm before the join (one row per farm
    reaches the join instead of one per building).
    """
    fb = (d.farmbuilding.groupBy("id_farm")
          .agg(F.sum("building_size").alias("occ"), F.count(F.lit(1)).alias("num_buildings"),
               F.min("building_size").alias("smallest")))
    f = d.farm.filter(F.col("hectares") < max_hectares).select("id_farm", "hectares")
    j = f.join(fb, "id_farm").withColumn("left", F.col("hectares") - F.col("occ")).filter(F.col("left") > 0)
    return (j.select("id_farm", "hectares",
                     F.col("occ").cast("decimal(18,2)").alias("occupied_space"),
                     F.col("left").cast("decimal(18,2)").alias("space_left"),
                     "num_buildings",
                     F.floor(safe_div(F.col("left"), F.col("smallest"))).cast("bigint").alias("num_new_buildings"))
             .orderBy("id_farm"))


def mixed_barns_no_missions(d) -> DataFrame:
    """barns holding more than one species, of players who completed no mission."""
    done = d.player_mission.filter(F.col("is_completed") == 1).select("id_player")
    players = not_in(d.player.select("id_player", "nickname"), "id_player", done, "id_player")
    # distinct species are counted per barn first (a COUNT DISTINCT does not
    # change under the chain's joins), so the chain joins one row per barn
    mixed = (d.animal.groupBy("id_barn").agg(F.countDistinct("id_animal_specie").alias("species_count"))
             .filter(F.col("species_count") > 1))
    g = (players.join(d.farm_p, "id_player")
         .join(d.farmbuilding_p, "id_farm")
         .join(d.barn.select(F.col("id_barn").alias("id_farm_building"), F.col("id_barn")), "id_farm_building")
         .join(mixed, "id_barn")
         .select("id_player", "nickname", "id_barn", "species_count").distinct())
    return (g.select("id_player", F.col("nickname").alias("name"), F.col("id_barn").alias("id_barn_building"),
                     "species_count").orderBy("id_barn_building"))


def rich_experts(d, num: int = 97, den: int = 100) -> DataFrame:
    """players above the ``num/den`` experience rank and above mean gold."""
    p = d.player
    cut = value_at_rank(p, "experience", num, den).scalar()
    mean_gold = p.agg(F.avg("gold")).scalar()
    return (p.filter((F.col("experience") > cut) & (F.col("gold") > mean_gold))
             .select("id_player", F.col("nickname").alias("name"), "gold", "experience")
             .orderBy(F.col("gold").desc_nulls_first()))
