"""T1-T4 on Spark's own keyed state (RocksDB).

Two stateful operators carry the four triggers:

* ``keep_totals`` holds one amount per key, as a streaming aggregate. A
  micro-batch's changes are added up on the map side first (a key that a third
  of all events hit is one row per map task), then meet the key's state; no key
  costs a call of Python. Shop and player stock (T1), reward items (T4) and
  affection points of edges (T3) are such totals.
* ``admit`` holds a barn's capacity, occupied places and last arrival (T2) and
  lets arrivals in by their order (``transformWithState``); what it turns away
  is a second output.

State, its recovery and exactly-once output are Spark's: the checkpoint holds
offsets and state versions, and a batch's files are committed once (a repeated
batch of totals writes its folder anew). The tables as of the last batch are read
back from the state with the ``statestore`` source, so nothing is rewritten per
batch. Starting tables go in with the first batch: as its initial state, or, for
totals, as rows of a second source that gets no more of them.

Nulls: an amount that is null makes its total null for good; keys may be null. A
total that starts under a null key is met by no change, as in the SQL.
A change with ``insert`` false counts only where its key has a state. Changes of
one key must agree on ``insert``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hearthvale.session import ship_package

# The provider that ``transformWithState`` needs, and no count of a store's keys,
# for which every update would read its key once more.
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store's settings, while a query starts."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep_totals(changes: DataFrame, keys: list[str], initial: DataFrame, root: str):
    """Start a stream that adds ``changes`` (streaming: ``keys``, ``amount``,
    ``insert``) to the totals ``initial`` (``keys``, ``amount``), drains what has
    arrived and stops. Every total that a batch changed goes to ``root/changes``;
    ``totals`` reads all of them. Called again with the same ``root`` it goes on
    where it stopped, and ``initial`` is not read."""
    spark = changes.sparkSession
    rows = changes.select(*keys, F.col("amount").cast("long").alias("amount"),
                          F.coalesce(F.col("insert").cast("boolean"), F.lit(False)).cast("int").alias("present"), F.lit(0).alias("initial"),
                          F.lit(False).alias("__apart"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    begun = _written_once(initial.select(*keys, F.col("amount").cast("long").alias("amount"), F.lit(1).alias("present"),
                                         F.lit(1).alias("initial"), null.alias("__apart")), root, "initial")
    every = rows.unionByName(spark.readStream.schema(begun.schema).parquet(f"{root}/initial"))
    # one kind of aggregate each, as the state names its columns by it; none that
    # Spark drops where a source gives a literal, as all batches share one state
    total = every.groupBy(*keys, "__apart").agg(F.sum(F.coalesce("amount", F.lit(0))).alias("sum"),
                                     F.bit_or(F.col("amount").isNull().cast("int")).alias("bit_or"),
                                     F.max("present").alias("max"), F.min("initial").alias("min"))

    def write(batch: DataFrame, number: int) -> None:       # a batch that is repeated writes its folder anew
        (batch.filter("max = 1 AND min = 0").select(*keys, _amount("sum", "bit_or").alias("amount"))
         .write.mode("overwrite").parquet(f"{root}/changes/batch={number}"))

    with _rocksdb(spark):
        query = (total.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").outputMode("update")
                 .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def _amount(total: str, nulls: str) -> Column:
    return F.when(F.col(nulls) == 0, F.col(total))


def _written_once(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` as files under ``root``, written by the first call alone. A call that
    broke off before all of them stood there left no mark and is made good."""
    spark, path, mark = df.sparkSession, f"{root}/{name}", f"{root}/{name}-whole"
    try:
        spark.read.schema("id bigint").parquet(mark)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("overwrite").parquet(path)
        spark.range(1).write.mode("overwrite").parquet(mark)
    return spark.read.schema(df.schema).parquet(path)


def totals(spark: SparkSession, root: str) -> DataFrame:
    """All totals (keys, ``amount``) as of the last batch."""
    state = spark.read.format("statestore").load(f"{root}/checkpoint")
    return state.filter("value.max = 1").select("key.*", _amount("value.sum", "value.bit_or").alias("amount")).drop("__apart")


_DECISION = Row("id_animal", "id_barn", "arrival_seq", "admitted")


class _Admission(StatefulProcessor):
    """Places of one barn, given to arrivals in their order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.barn = handle.getValueState("barn", "max_capacity bigint, occupied_spots bigint, last_arrival bigint")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.barn.update((initialState.max_capacity, initialState.occupied_spots, None))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        decision = _DECISION

        def decided(animal: int, seq: int, yes: bool) -> Row:
            return decision(animal, key[0], seq, yes)

        known = self.barn.get()                                    # one call to the store; None without a state
        if known is None:                                          # no such barn
            for r in rows:
                yield decided(r.id_animal, r.arrival_seq, False)
            return
        room, taken, last = known
        if room is None or taken is None:                          # the comparison is unknown: nobody is turned away
            n = 0
            for r in rows:
                n, last = n + 1, r.arrival_seq if last is None else max(last, r.arrival_seq)
                yield decided(r.id_animal, r.arrival_seq, True)
            self.barn.update((room, None if taken is None else taken + n, last))
            return
        # the first ones by arrival, as many as there are places: at most that many are held
        free, first, turned = max(0, room - taken), [], None
        for r in rows:
            mine = (-r.arrival_seq, -r.id_animal)
            last = r.arrival_seq if last is None else max(last, r.arrival_seq)
            out = mine if not free else heapq.heappushpop(first, mine) if len(first) == free else heapq.heappush(first, mine)
            if out is not None:
                turned = out if turned is None else max(turned, out)
                yield decided(-out[1], -out[0], False)
        admitted = 0
        for mine in first:
            yes = mine != turned                                   # equal arrivals share one decision
            admitted += yes
            yield decided(-mine[1], -mine[0], yes)
        self.barn.update((room, taken + admitted, last))

    def close(self) -> None:
        pass


def admit(arrivals: DataFrame, barn: DataFrame, root: str):
    """Start a stream that decides on ``arrivals`` (streaming: ``id_animal,
    id_barn, arrival_seq``; a batch's in ``arrival_seq`` order, later batches
    after earlier ones), drains it and stops. ``decisions`` and ``barns`` read
    the outcome. ``barn`` is the starting table."""
    ship_package(arrivals.sparkSession)
    rows = arrivals.select("id_animal", "id_barn", "arrival_seq")
    held = barn.select("id_barn", "max_capacity", "occupied_spots").groupBy("id_barn")
    out = rows.groupBy("id_barn").transformWithState(
        statefulProcessor=_Admission(), outputStructType="id_animal bigint, id_barn bigint, arrival_seq bigint, admitted boolean",
        outputMode="Append", timeMode="None", initialState=held)
    return _drained(out, root, "decisions", "admitted")


def decisions(spark: SparkSession, root: str, admitted: bool | None = None) -> DataFrame:
    """All decisions so far, or one side of them (a folder of its own)."""
    out = spark.read.schema("id_animal bigint, id_barn bigint, arrival_seq bigint, admitted boolean").parquet(f"{root}/decisions")
    return out if admitted is None else out.filter(F.col("admitted") == admitted)


def barns(spark: SparkSession, root: str) -> DataFrame:
    """The barns as of the last batch."""
    state = spark.read.format("statestore").option("stateVarName", "barn").load(f"{root}/checkpoint")
    return state.select("key.id_barn", "value.max_capacity", "value.occupied_spots", "value.last_arrival")


def _drained(out: DataFrame, root: str, name: str, *by: str):
    with _rocksdb(out.sparkSession):
        writer = out.writeStream.format("parquet").option("path", f"{root}/{name}").option("checkpointLocation", f"{root}/checkpoint")
        query = (writer.partitionBy(*by) if by else writer).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# ---------------------------------------------------------------- changes of the four triggers
def purchase_changes(trades: DataFrame) -> DataFrame:
    """A purchase takes from the shop's stock, if it has the item, and adds
    to the player's; sales count nowhere."""
    sides = F.array(
        F.struct(F.lit("S_STORED").alias("tbl"), F.col("id_shop").alias("id_owner"), (-F.col("amount")).alias("amount"), F.lit(False).alias("insert")),
        F.struct(F.lit("P_STORED").alias("tbl"), F.col("id_player").alias("id_owner"), F.col("amount").alias("amount"), F.lit(True).alias("insert")))
    return (trades.filter(F.col("action") == "BUY").select("id_item", F.explode(sides).alias("s"))
            .select("s.tbl", "s.id_owner", "id_item", "s.amount", "s.insert"))


def reward_changes(donations: DataFrame, item: int) -> DataFrame:
    """T4: one reward item for every donation in condition 'new'."""
    new = donations.filter(F.upper("condition_object") == "NEW")
    return new.select("id_player", F.lit(item).cast("long").alias("id_item"), F.lit(1).cast("long").alias("amount"), F.lit(True).alias("insert"))


def affection_changes(feed: DataFrame, edges: DataFrame) -> DataFrame:
    """A changed personality (both known) gives a point to every edge of the
    resident. ``edges`` (static) has the ends ``id_character1, id_character2``."""
    changed = feed.filter("old_personality <> new_personality").select("id_inhabitant")
    ends = edges.select("id_character1", "id_character2", F.explode(F.array("id_character1", "id_character2")).alias("id_inhabitant"))
    return changed.join(ends, "id_inhabitant").select("id_character1", "id_character2", F.lit(1).cast("long").alias("amount"),
                                                      F.lit(False).alias("insert"))
