"""The four triggers as Structured Streaming jobs over a folder of new rows.

Each call drains the files that have arrived since the last one with the same
``root`` (``availableNow``, at most ``files_per_batch`` files a micro-batch) and
returns; called on a schedule, or after a crash, it goes on from the checkpoint
under ``root``. The starting tables are read by the first batch alone.

    purchase_stock(spark, "/landing/buy_sell", s_stored, p_stored, "/state/stock")
    stock(spark, "/state/stock")                 # both tables as of the last batch
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.streaming import keyed_state
from hearthvale.streaming.triggers import REWARD_ITEM

# Columns of the rows that arrive.
TRADES = ("id_shop bigint, id_player bigint, id_item bigint, action_time timestamp_ntz, action string, "
          "money_fluctuation decimal(18,2), amount bigint")
ARRIVALS = "id_animal bigint, id_barn bigint, arrival_seq bigint"
FEED = "id_inhabitant bigint, old_personality string, new_personality string"
DONATIONS = "id_donatable bigint, id_museum bigint, id_player bigint, condition_object string"

STOCK = ["tbl", "id_owner", "id_item"]
EDGE = ["id_character1", "id_character2"]


def _arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def _stock_of(table: str, df: DataFrame, owner: str) -> DataFrame:
    return df.select(F.lit(table).alias("tbl"), F.col(owner).alias("id_owner"), "id_item", F.col("quantity").alias("amount"))


def purchase_stock(spark: SparkSession, folder: str, s_stored: DataFrame, p_stored: DataFrame, root: str,
                   files_per_batch: int | None = None):
    """The stock of shops and players after the trades in ``folder``."""
    start = _stock_of("S_STORED", s_stored, "id_shop").unionByName(_stock_of("P_STORED", p_stored, "id_player"))
    changes = keyed_state.purchase_changes(_arriving(spark, folder, TRADES, files_per_batch))
    return keyed_state.keep_totals(changes, STOCK, start, root)


def stock(spark: SparkSession, root: str) -> DataFrame:
    return keyed_state.totals(spark, root).select(*STOCK, F.col("amount").alias("quantity"))


def donation_reward(spark: SparkSession, folder: str, p_stored: DataFrame, root: str, files_per_batch: int | None = None,
                    item: int = REWARD_ITEM):
    """T4: the players' stock after the donations in ``folder``."""
    changes = keyed_state.reward_changes(_arriving(spark, folder, DONATIONS, files_per_batch), item)
    return keyed_state.keep_totals(changes, ["id_player", "id_item"], p_stored.withColumnRenamed("quantity", "amount"), root)


def player_stock(spark: SparkSession, root: str) -> DataFrame:
    return keyed_state.totals(spark, root).withColumnRenamed("amount", "quantity")


def affection_boost(spark: SparkSession, folder: str, relationship: DataFrame, root: str, files_per_batch: int | None = None):
    """Affection levels after the personality changes in ``folder``."""
    changes = keyed_state.affection_changes(_arriving(spark, folder, FEED, files_per_batch), relationship.select(*EDGE))
    return keyed_state.keep_totals(changes, EDGE, relationship.select(*EDGE, F.col("affection_level").alias("amount")), root)


def affection(spark: SparkSession, root: str) -> DataFrame:
    return keyed_state.totals(spark, root).withColumnRenamed("amount", "affection_level")


def barn_admission(spark: SparkSession, folder: str, barn: DataFrame, root: str, files_per_batch: int | None = None):
    """Decisions on the animals that arrive in ``folder``."""
    return keyed_state.admit(_arriving(spark, folder, ARRIVALS, files_per_batch), barn, root)
