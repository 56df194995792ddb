"""Village queries V1–V6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthvale.functions.scalar import hhmm_minutes, round2
from hearthvale.operators.joins import not_referenced
from hearthvale.operators.topk import all_ties_max


def relationship_ends(rel: DataFrame) -> DataFrame:
    """Each edge once per endpoint (``id``, ``affection_level``), one scan."""
    return rel.select(F.explode(F.array("id_character1", "id_character2")).alias("id"), "affection_level")


def most_connected(d) -> DataFrame:
    """V1: characters of highest relationship degree, with mean affection.

    Degrees are one aggregate over the unpivoted endpoints; the maximum is
    taken over all endpoint ids (as the reference does) via a one-row
    scalar subquery; ties are kept.
    """
    deg = (relationship_ends(d.relationship).groupBy("id")
           .agg(F.count(F.lit(1)).alias("total_relationships"), F.avg("affection_level").alias("mean")))
    top = all_ties_max(deg, "total_relationships")
    j = top.join(d.character.select(F.col("id_character").alias("id"), "name"), "id")
    return (j.select("name", round2(F.col("mean")).alias("avg_points"), "total_relationships")
             .orderBy(F.col("total_relationships").desc_nulls_first(), F.col("name").asc_nulls_last()))


def cold_age_gap_pairs(d, max_points: int = 10, ratio: int = 3) -> DataFrame:
    """V2: relationships below ``max_points`` whose ages differ by a factor
    of at least ``ratio`` (an unknown age never qualifies)."""
    c = d.character.select("id_character", "name", "age")
    c1 = c.select(F.col("id_character").alias("id_character1"), F.col("name").alias("resident1"),
                  F.col("age").alias("age_resident_1"))
    c2 = c.select(F.col("id_character").alias("id_character2"), F.col("name").alias("resident2"),
                  F.col("age").alias("age_resident_2"))
    r = d.relationship.filter(F.col("affection_level") < max_points)
    j = r.join(c1, "id_character1").join(c2, "id_character2").filter(
        (F.col("age_resident_1") >= ratio * F.col("age_resident_2"))
        | (F.col("age_resident_2") >= ratio * F.col("age_resident_1")))
    return (j.select("resident1", "age_resident_1", "resident2", "age_resident_2",
                     F.col("affection_level").alias("relation_points"))
             .orderBy(F.col("relation_points").asc_nulls_last(), F.col("resident1").asc_nulls_last(),
                      F.col("resident2").asc_nulls_last()))


def most_sent_items(d) -> DataFrame:
    """V3: deliveries carrying the most-delivered item(s)."""
    rl = (d.receive.select("id_inhabitant", "id_player", "id_letter")
          .join(d.letter.select("id_letter", "id_item").filter(F.col("id_item").isNotNull()), "id_letter"))
    per_item = rl.groupBy("id_item").agg(F.count(F.lit(1)).alias("cnt"))
    top = all_ties_max(per_item, "cnt").select("id_item")
    return (rl.join(top, "id_item", "left_semi")
              .select(F.col("id_inhabitant").alias("id_resident"), "id_player", "id_item")
              .orderBy("id_resident", "id_player"))


def overnight_slots(d) -> DataFrame:
    """V4: per resident, slots starting after midnight, before the mean start
    of all slots, and ending earlier in the day than they start."""
    s = d.schedule.select("id_schedule", hhmm_minutes(F.col("start_time")).alias("start_min"),
                          hhmm_minutes(F.col("end_time")).alias("end_min"))
    mean_start = s.agg(F.avg("start_min")).scalar()
    t = d.has.select("id_inhabitant", "id_schedule").join(s, "id_schedule")
    late = t.filter((F.col("start_min") > 0) & (F.col("start_min") < mean_start)
                    & (F.col("start_min") > F.col("end_min")))
    return (late.groupBy(F.col("id_inhabitant").alias("id_resident"))
                .agg(F.count(F.lit(1)).alias("late_activities"))
                .orderBy(F.col("late_activities").desc_nulls_first(), "id_resident"))


def july_births_or_rich(d, year: int = 1999, month: int = 7, factor: int = 2) -> DataFrame:
    """V5: names of residents born in ``year-month`` or of players holding at
    least ``factor`` times the mean gold (set union, distinct)."""
    names = d.character.select("id_character", "name")
    born = (d.inhabitant.filter((F.month("birthday") == month) & (F.year("birthday") == year))
            .select(F.col("id_inhabitant").alias("id_character")).join(names, "id_character").select("name"))
    mean_gold = d.player.agg(F.avg("gold")).scalar()
    rich = (d.player.filter(F.col("gold") >= factor * mean_gold)
            .select(F.col("id_player").alias("id_character")).join(names, "id_character").select("name"))
    return born.unionByName(rich).distinct().orderBy(F.col("name").asc_nulls_last())


def isolated_residents(d) -> DataFrame:
    """V6: residents that appear in no relationship (two anti joins)."""
    res = (d.inhabitant.select(F.col("id_inhabitant").alias("id"))
           .join(d.character.select(F.col("id_character").alias("id"), "name"), "id"))
    r = d.relationship
    alone = not_referenced(res, "id", [(r, "id_character1"), (r, "id_character2")])
    return alone.select("name").orderBy(F.col("name").asc_nulls_last())
