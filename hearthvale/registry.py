"""Registry of every query/operator entry: Spark callable + DuckDB oracle SQL.

Each Spark callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the whole supplied tables (no sampling, no id subsets). Oracle SQL is
``None`` where the operator is not expressible in SQL; the driver then does
a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthvale.oracle import audit as oa
from hearthvale.oracle import etl as ot
from hearthvale.oracle import events as oe
from hearthvale.oracle import farm as of
from hearthvale.oracle import items as oi
from hearthvale.oracle import loads as ol
from hearthvale.oracle import maintenance as om
from hearthvale.oracle import streams as os_
from hearthvale.oracle import village as ov
from hearthvale.oracle.bridge import with_bridge
from hearthvale.oracle.load_groups import LOAD_GROUPS, full_load_sql, group_sql
from hearthvale.plans import audit, etl, events, farm, items, loads, maintenance, streams, village
from hearthvale.sources.bridge import Domain

Entry = tuple[Callable[[SparkSession, str], DataFrame], "str | None"]


_DOMAINS: dict[str, Domain] = {}


def domain_for(spark: SparkSession, sf_dir: str) -> Domain:
    """One lazy Domain per directory, of the latest session: entries share the bridged
    DataFrame *definitions* (plan objects only — no data is cached)."""
    key = sf_dir.rstrip("/")
    d = _DOMAINS.get(key)
    if d is None or d.spark is not spark:
        d = _DOMAINS[key] = Domain(spark, sf_dir)
    return d


def _q(fn, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(domain_for(spark, sf_dir), **params)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _events_ledger(fn, **params):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = domain_for(spark, sf_dir)
        return fn(d, ledger=d.buy_sell_events, **params)
    run.__name__ = fn.__name__
    return run


def entries() -> dict[str, Entry]:
    reg: dict[str, Entry] = {
        # ---- items
        "loss_making_crops": (_q(items.loss_making_crops), with_bridge(oi.I1)),
        "loss_making_crops_outer": (_q(items.loss_making_crops_outer), with_bridge(oi.I1B)),
        "best_item_by_shop": (_q(items.best_item_by_shop), with_bridge(oi.I2)),
        "last_purchase_of_day": (_events_ledger(items.last_purchase_of_day, month=1),
                                 with_bridge(oi.I3_EVENTS)),
        "last_purchase_of_day_trade": (_q(items.last_purchase_of_day, month=12), with_bridge(oi.I3_TRADE)),
        "closest_pairs": (_q(items.closest_pairs), with_bridge(oi.I4)),
        "busy_locations": (_q(items.busy_locations, threshold=50000),
                           with_bridge(oi.I5.format(threshold=50000))),
        "sale_price_extremes": (_q(items.sale_price_extremes), with_bridge(oi.I6)),
        # ---- farm
        "fast_players": (_q(farm.fast_players), with_bridge(of.F1)),
        "max_gold_farms": (_q(farm.max_gold_farms), with_bridge(of.F2)),
        "productive_animals": (_q(farm.productive_animals), with_bridge(of.F3)),
        "farm_free_space": (_q(farm.farm_free_space), with_bridge(of.F4)),
        "mixed_barns_no_missions": (_q(farm.mixed_barns_no_missions), with_bridge(of.F5)),
        "rich_experts": (_q(farm.rich_experts), with_bridge(of.F6)),
        # ---- village
        "most_connected": (_q(village.most_connected), with_bridge(ov.V1)),
        "cold_age_gap_pairs": (_q(village.cold_age_gap_pairs, max_points=48),
                               with_bridge(ov.V2.format(max_points=48))),
        "most_sent_items": (_q(village.most_sent_items), with_bridge(ov.V3)),
        "overnight_slots": (_q(village.overnight_slots), with_bridge(ov.V4)),
        "july_births_or_rich": (_q(village.july_births_or_rich), with_bridge(ov.V5)),
        "isolated_residents": (_q(village.isolated_residents), with_bridge(ov.V6)),
        # ---- events
        "active_people": (_q(events.active_people), with_bridge(oe.E1)),
        "top_spender_per_event": (_q(events.top_spender_per_event), with_bridge(oe.E2)),
        "top_spender_per_event_person": (_q(events.top_spender_per_event, by_person=True), with_bridge(oe.E2_PERSON)),
        "museum_completion_gap": (_q(events.museum_completion_gap), with_bridge(oe.E3)),
        "donation_mix": (_q(events.donation_mix), with_bridge(oe.E4)),
        "best_discount_per_shop": (_q(events.best_discount_per_shop), with_bridge(oe.E5)),
        "single_event_places": (_q(events.single_event_places), with_bridge(oe.E6)),
        # ---- ETL operators
        "ingest_cast_quarantine": (_q(etl.ingest_cast_quarantine), with_bridge(ot.QUARANTINE)),
        "etl_idempotent_append": (_q(etl.etl_idempotent_append), with_bridge(ot.IDEMPOTENT_APPEND)),
        "etl_schedule_match": (_q(etl.etl_schedule_match), with_bridge(ot.SCHEDULE_MATCH)),
        "etl_fill_missing": (_q(etl.etl_fill_missing), with_bridge(ot.FILL_MISSING)),
        "etl_trade_facts": (_q(etl.etl_trade_facts), with_bridge(ot.TRADE_FACTS)),
        "etl_first_match_lookup": (_q(etl.etl_first_match_lookup), with_bridge(ot.FIRST_MATCH_LOOKUP)),
        "etl_first_row_per_key": (_q(etl.etl_first_row_per_key), with_bridge(ot.FIRST_ROW_PER_KEY)),
        "etl_dimension_ids": (_q(etl.etl_dimension_ids), with_bridge(ot.DIMENSION_IDS)),
        "etl_subtype_split": (_q(etl.etl_subtype_split), with_bridge(ot.SUBTYPE_SPLIT)),
        "etl_canonical_edges": (_q(etl.etl_canonical_edges), with_bridge(ot.CANONICAL_EDGES)),
        "etl_cascade_delete": (_q(etl.etl_cascade_delete), with_bridge(ot.CASCADE_DELETE)),
        "etl_default_parents": (_q(etl.etl_default_parents), with_bridge(ot.DEFAULT_PARENTS)),
        # ---- event-driven (trigger) folds
        "stream_purchase_stock": (_q(streams.stream_purchase_stock), with_bridge(os_.PURCHASE_STOCK)),
        "stream_barn_admission": (_q(streams.stream_barn_admission), with_bridge(os_.BARN_ADMISSION)),
        "stream_barn_rejects": (_q(streams.stream_barn_rejects), with_bridge(os_.BARN_REJECTS)),
        "stream_barn_occupancy": (_q(streams.stream_barn_occupancy), with_bridge(os_.BARN_OCCUPANCY)),
        "stream_affection_boost": (_q(streams.stream_affection_boost), with_bridge(os_.AFFECTION_BOOST)),
        "stream_donation_reward": (_q(streams.stream_donation_reward), with_bridge(os_.DONATION_REWARD)),
        # ---- the same events through streaming jobs on keyed state
        "stream_purchase_stock_state": (_q(streams.stream_purchase_stock_state), with_bridge(os_.PURCHASE_STOCK)),
        "stream_barn_admission_state": (_q(streams.stream_barn_admission_state), with_bridge(os_.BARN_ADMISSION)),
        "stream_barn_rejects_state": (_q(streams.stream_barn_rejects_state), with_bridge(os_.BARN_REJECTS)),
        "stream_barn_occupancy_state": (_q(streams.stream_barn_occupancy_state), with_bridge(os_.BARN_OCCUPANCY)),
        "stream_affection_boost_state": (_q(streams.stream_affection_boost_state), with_bridge(os_.AFFECTION_BOOST)),
        "stream_donation_reward_state": (_q(streams.stream_donation_reward_state), with_bridge(os_.DONATION_REWARD)),
        # ---- constraint audit
        "audit_constraints": (_q(audit.audit_constraints), with_bridge(oa.audit_sql())),
        # ---- table maintenance: these write tables while they run
        "ingest_extract": (_q(maintenance.ingest_extract), om.INGEST_EXTRACT),
        "etl_personality_feed": (_q(maintenance.etl_personality_feed), om.PERSONALITY_FEED),
        "etl_fill_missing_keyed": (_q(maintenance.etl_fill_missing_keyed), with_bridge(ot.FILL_MISSING)),
        "etl_lasting_ids": (_q(maintenance.etl_lasting_ids), om.LASTING_IDS),
        "etl_cascade_graph": (_q(maintenance.etl_cascade_graph), with_bridge(om.CASCADE_GRAPH)),
        "etl_participate_factors": (_q(maintenance.etl_participate_factors), om.PARTICIPATE),
        "audit_on_write": (_q(maintenance.audit_on_write), with_bridge(oa.audit_sql())),
        "etl_load_audit": (_q(maintenance.etl_load_audit), oa.load_audit_sql([ol.ITEMS, ol.PEOPLE, ol.FARMS, *map(group_sql, LOAD_GROUPS)])),
        # ---- the whole normalising load (54 loads + 1 update): its rows by groups, and their number per table
        "etl_load_items": (_q(loads.load_group, group="items"), ol.ITEMS),
        "etl_load_people": (_q(loads.load_group, group="people"), ol.PEOPLE),
        "etl_load_farms": (_q(loads.load_group, group="farms"), ol.FARMS),
        **{f"etl_load_{g}": (_q(loads.load_group, group=g), group_sql(g))
           for g in LOAD_GROUPS},
        "etl_full_load": (_q(loads.full_load_counts), full_load_sql([ol.ITEMS, ol.PEOPLE, ol.FARMS])),
    }
    return reg
