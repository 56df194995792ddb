"""The reference's row triggers as batch folds.

Each ``apply_*`` is a pure DataFrame function ``(batch, snapshots) -> new
snapshots``. It is what every micro-batch runs (see ``runner``), and it is
also callable on a whole table, which is how it is checked against SQL.

Row-trigger semantics kept:

* T1 — a BUY row lowers shop stock *only if* that (shop, item) row exists,
  and raises player stock (insert if missing); SELL rows are ignored; a NULL
  amount makes the quantity NULL for good.
* T2 — an arriving animal is admitted while its barn has room; each
  admission takes one spot whatever the animal's quantity; unknown barns
  reject; a NULL capacity or occupancy never rejects (the comparison is
  unknown) and stays NULL.
* T3 — every personality change (old and new both known and different) adds
  one affection point to every relationship of that resident; both ends
  changed -> +2; two changes of one resident -> +2.
* T4 — every donation in condition 'new' (any case) adds one reward item to
  the donor's stock (insert if missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthvale.operators.upsert import merge_add, update_add

REWARD_ITEM = 9999  # fixed value: the item every new donation earns


# ---------------------------------------------------------------- T1
def apply_purchase_stock(batch: DataFrame, s_stored: DataFrame, p_stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return ``(new S_STORED, new P_STORED)`` after the batch's BUY rows."""
    buys = batch.filter(F.col("action") == "BUY").select("id_shop", "id_player", "id_item", "amount")
    new_s = update_add(s_stored, buys.select("id_shop", "id_item", "amount"),
                       ["id_shop", "id_item"], "quantity", "amount", sign=-1)
    new_p = merge_add(p_stored, buys.select("id_player", "id_item", "amount"),
                      ["id_player", "id_item"], "quantity", "amount")
    return new_s, new_p


# ---------------------------------------------------------------- T2
def admission_decisions(arrivals: DataFrame, barn: DataFrame, mode: str = "per_row") -> DataFrame:
    """``arrivals(id_animal, id_barn, arrival_seq, ...)`` with the flag ``admitted``.

    Admitted <=> the barn is known and (capacity or occupancy is NULL, or the
    animal is among the first ``max - occupied`` arrivals of its barn, by
    arrival and id; arrivals equal in both share one decision).

    Scale: each barn's last admitted arrival is found from its first ``K + 1``
    arrivals, where ``K`` is the largest free space of any barn:
    ``row_number() <= K + 1`` is a partial ``WindowGroupLimit`` before the
    shuffle, so a barn receiving a third of all arrivals ships few rows per
    map task. The flag then comes from a join on the barn alone (one row per
    barn), so repeated animal ids cannot multiply rows.
    """
    if mode not in ("per_row", "all_or_nothing"):
        raise ValueError(mode)
    b = barn.select("id_barn", (F.col("max_capacity") - F.col("occupied_spots")).alias("__free"), F.lit(True).alias("__known"))
    k_row = b.agg(F.max("__free")).first()      # from the (small) barn snapshot, not from the arrivals
    k = max(0, int(k_row[0])) if k_row and k_row[0] is not None else 0
    turn = Window.partitionBy("id_barn").orderBy("arrival_seq", "id_animal")
    firsts = (arrivals.select("id_animal", "id_barn", "arrival_seq").join(b.filter("__free > 0"), "id_barn")
              .withColumn("__rn", F.row_number().over(turn)).filter(F.col("__rn") <= k + 1))
    so_far = F.count(F.lit(1)).over(turn)       # default frame: equal arrivals count together
    cut = (firsts.withColumn("__n", so_far).filter("__n <= __free")
           .groupBy("id_barn").agg(F.max(F.struct("arrival_seq", "id_animal")).alias("__cut")))
    placed = arrivals.join(b.join(cut, "id_barn", "left"), "id_barn", "left")
    fits = F.col("__free").isNull() | (F.struct("arrival_seq", "id_animal") <= F.col("__cut"))
    out = placed.withColumn("admitted", F.coalesce(F.col("__known") & F.coalesce(fits, F.lit(False)), F.lit(False)))
    out = out.select(*arrivals.columns, "admitted")
    if mode == "all_or_nothing":
        any_reject = out.filter(~F.col("admitted")).agg(F.count(F.lit(1))).scalar()
        out = out.withColumn("admitted", F.col("admitted") & (any_reject == 0))
    return out


def apply_barn_admission(arrivals: DataFrame, barn: DataFrame, mode: str = "per_row") -> tuple[DataFrame, DataFrame]:
    """Return ``(decisions, new BARN)``: occupancy += admitted arrivals."""
    dec = admission_decisions(arrivals, barn, mode)
    taken = dec.filter("admitted").groupBy("id_barn").agg(F.count(F.lit(1)).alias("taken"))
    new_barn = (barn.join(taken, "id_barn", "left")
                .select("id_barn", "max_capacity",
                        (F.col("occupied_spots") + F.coalesce(F.col("taken"), F.lit(0))).cast("bigint")
                        .alias("occupied_spots")))
    return dec, new_barn


# ---------------------------------------------------------------- T3
def apply_affection_boost(changes: DataFrame, relationship: DataFrame) -> DataFrame:
    """``changes(id_inhabitant, old_personality, new_personality)`` -> new RELATIONSHIP."""
    hits = (changes.filter(F.col("old_personality").isNotNull() & F.col("new_personality").isNotNull()
                           & (F.col("old_personality") != F.col("new_personality")))
            .groupBy("id_inhabitant").agg(F.count(F.lit(1)).alias("n")))
    h1 = hits.select(F.col("id_inhabitant").alias("id_character1"), F.col("n").alias("__n1"))
    h2 = hits.select(F.col("id_inhabitant").alias("id_character2"), F.col("n").alias("__n2"))
    r = relationship.join(h1, "id_character1", "left").join(h2, "id_character2", "left")
    boost = F.coalesce(F.col("__n1"), F.lit(0)) + F.coalesce(F.col("__n2"), F.lit(0))
    cols = [c for c in relationship.columns]
    return r.select(*[(F.col(c) + boost).cast("bigint").alias(c) if c == "affection_level" else F.col(c)
                      for c in cols])


# ---------------------------------------------------------------- T4
def apply_donation_reward(donations: DataFrame, p_stored: DataFrame, reward_item: int = REWARD_ITEM) -> DataFrame:
    """New donations in condition 'new' -> +1 reward item per donation."""
    new = (donations.filter(F.upper("condition_object") == "NEW")
           .select("id_player", F.lit(reward_item).cast("bigint").alias("id_item"),
                   F.lit(1).cast("bigint").alias("amount")))
    return merge_add(p_stored, new, ["id_player", "id_item"], "quantity", "amount")
