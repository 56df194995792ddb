"""The bridge (test tables -> village tables) spelled as DuckDB SQL CTEs.

``with_bridge(sql)`` prefixes a query with the CTEs it names (and their
dependencies), in dependency order. Mirrors ``hearthvale.sources.bridge``.
"""

from __future__ import annotations

import re

# name -> body; order is dependency order.
CTES: dict[str, str] = {
    "item": """
SELECT p_partkey AS id_item, p_name AS name, p_type AS description,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS price_to_buy,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) * (50 + 2 * p_size) * 0.01 AS DECIMAL(18,2)) AS price_to_sell
FROM part""",
    "seed": "SELECT p_partkey AS id_seed, p_type AS seed_type, p_brand AS name_crop FROM part",
    "food": """
SELECT p_partkey AS id_food, p_type AS ingredients, CAST(p_size AS BIGINT) AS energy_regain,
       CAST(p_size AS BIGINT) AS health_regain FROM part""",
    "crop": """
SELECT CAST(substr(p_brand, 7) AS BIGINT) AS id_crop, p_brand AS name_crop,
       CASE CAST(substr(p_brand, 7) AS BIGINT) % 3 WHEN 0 THEN 'Cooper' WHEN 1 THEN 'Gold' ELSE 'Silver' END AS quality
FROM (SELECT DISTINCT p_brand FROM part)""",
    "character": """
SELECT c_custkey AS id_character, c_name AS name, CAST(1 + c_custkey % 80 AS BIGINT) AS age,
       c_mktsegment AS gender, CAST(c_nationkey AS BIGINT) AS id_village FROM customer""",
    "inhabitant": """
SELECT c_custkey AS id_inhabitant, c_mktsegment AS personality,
       CAST(DATE '1998-01-01' + CAST(c_custkey * 13 % 1000 AS INTEGER) AS TIMESTAMP) AS birthday
FROM customer""",
    "player": """
SELECT c_custkey AS id_player, c_name AS nickname, CAST(c_acctbal AS DECIMAL(18,2)) AS gold,
       CAST((SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS BIGINT) AS experience
FROM customer c""",
    "shop": """
SELECT s_suppkey AS id_shop, s_name AS name_shop, CAST(s_nationkey AS BIGINT) AS id_place,
       'S' || CAST(s_suppkey % 5 AS VARCHAR) AS specialization FROM supplier""",
    "place": """
SELECT CAST(n_nationkey AS BIGINT) AS id_place, n_name AS location_name,
       CAST(n_regionkey AS VARCHAR) AS coordinates FROM nation""",
    "buy_sell": """
SELECT l.l_suppkey AS id_shop, o.o_custkey AS id_player, l.l_partkey AS id_item,
       l.l_shipdate AS action_time,
       CASE WHEN l.l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS action,
       CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_extendedprice AS DECIMAL(18,2))
            ELSE -CAST(l.l_extendedprice AS DECIMAL(18,2)) END AS money_fluctuation,
       CAST(l.l_quantity AS BIGINT) AS amount
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""",
    "buy_sell_events": """
SELECT user_id % 10 AS id_shop, user_id AS id_player, user_id AS id_item, ts AS action_time,
       CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS action,
       CASE WHEN event_type = 'purchase' THEN -CAST(value AS DECIMAL(18,2))
            ELSE CAST(value AS DECIMAL(18,2)) END AS money_fluctuation,
       CAST(ceil(value) AS BIGINT) AS amount
FROM events""",
    "s_stored": """
SELECT l_suppkey AS id_shop, l_partkey AS id_item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem GROUP BY l_suppkey, l_partkey""",
    "p_stored": """
SELECT o.o_custkey AS id_player, l.l_partkey AS id_item,
       CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey, l.l_partkey""",
    "sell": """
SELECT CAST(1 AS BIGINT) AS id_festivity, s_suppkey AS id_shop, CAST(5 + s_suppkey % 20 AS DECIMAL(5,2)) AS discount FROM supplier
UNION ALL
SELECT CAST(2 AS BIGINT), s_suppkey, CAST(10 + s_suppkey % 7 AS DECIMAL(5,2)) FROM supplier""",
    "player_mission": """
SELECT o.o_custkey AS id_player, o.o_orderkey AS id_mission, o.o_orderdate AS start_date,
       m.end_date,
       CAST(CASE WHEN o.o_orderstatus = 'F' AND m.end_date > o.o_orderdate THEN 1 ELSE 0 END AS INTEGER) AS is_completed
FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS end_date FROM lineitem GROUP BY l_orderkey) m
  ON m.l_orderkey = o.o_orderkey""",
    "farm": """
SELECT s_suppkey AS id_farm, CAST(CAST(s_acctbal AS DECIMAL(18,2)) * 4 AS DECIMAL(10,2)) AS hectares,
       'S' || CAST(s_suppkey % 5 AS VARCHAR) AS specialization, s_suppkey AS id_player FROM supplier""",
    "supplied_parts": """
SELECT sp.l_suppkey, sp.l_partkey, p.p_name, p.p_type, p.p_size, p.p_brand
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) sp JOIN part p ON p.p_partkey = sp.l_partkey""",
    "farmbuilding": """
SELECT l_suppkey * 10000000000 + l_partkey AS id_farm_building, p_name AS name_building,
       CAST(p_size AS DECIMAL(10,2)) AS building_size, l_suppkey AS id_farm FROM supplied_parts""",
    "cultivationfield": """
SELECT l_suppkey * 10000000000 + l_partkey AS id_field FROM supplied_parts WHERE p_type = 'SMALL'""",
    "grow": """
SELECT l_suppkey * 10000000000 + l_partkey AS id_field, CAST(substr(p_brand, 7) AS BIGINT) AS id_crop
FROM supplied_parts WHERE p_type = 'SMALL'""",
    "animal": """
SELECT o_orderkey AS id_animal, 'Animal#' || CAST(o_orderkey AS VARCHAR) AS name_animal,
       o_orderkey % 15 AS age, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_animal_specie,
       CASE WHEN o_orderstatus = 'F' THEN 'Healthy' ELSE 'Sick' END AS health, o_custkey AS id_barn
FROM orders""",
    "produce": "SELECT DISTINCT l_orderkey AS id_animal, l_partkey AS id_product FROM lineitem",
    "farm_p": "SELECT c_custkey AS id_farm, c_custkey AS id_player FROM customer",
    "farmbuilding_p": "SELECT c_custkey AS id_farm_building, c_custkey AS id_farm FROM customer",
    "barn": """
SELECT c_custkey AS id_barn, CAST(CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 5 + c_custkey % 10 END AS BIGINT) AS max_capacity,
       CAST(c_custkey % 7 AS BIGINT) AS occupied_spots FROM customer""",
    "relationship": """
SELECT d.c1 AS id_character1, d.c2 AS id_character2, d.w AS affection_level
FROM (SELECT least(head, l.l_suppkey) AS c1, greatest(head, l.l_suppkey) AS c2,
             max(CAST(l.l_quantity AS BIGINT)) AS w
      FROM lineitem l JOIN (SELECT o_orderkey, o_custkey + o_custkey % 2 AS head FROM orders) o
        ON o.o_orderkey = l.l_orderkey
      WHERE head <> l.l_suppkey
      GROUP BY 1, 2) d
WHERE d.c1 IN (SELECT c_custkey FROM customer) AND d.c2 IN (SELECT c_custkey FROM customer)""",
    "letter": """
SELECT o_orderkey AS id_letter,
       CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 200 END AS BIGINT) AS id_item
FROM orders""",
    "receive": """
SELECT DISTINCT l_partkey AS id_inhabitant, l_suppkey AS id_player, l_orderkey AS id_letter FROM lineitem""",
    "schedule": """
SELECT event_id AS id_schedule, strftime(ts, '%H:%M') AS start_time,
       strftime(ts + to_minutes(CAST(floor(value * 10) AS BIGINT)), '%H:%M') AS end_time
FROM events""",
    "has": "SELECT user_id AS id_inhabitant, user_id % 25 AS id_place, event_id AS id_schedule FROM events",
    "residentevent": """
SELECT event_id AS id_residentevent, user_id AS id_resident, user_id % 50 AS id_player FROM events""",
    "events_stg": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS description FROM region",
    "festivity_persons": """
SELECT CAST(n.n_regionkey AS BIGINT) AS id, o.o_custkey AS id_person,
       CAST(o.o_totalprice AS DECIMAL(18,2)) AS gold_expended
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "museum_registry": """
SELECT CAST(s.s_nationkey AS BIGINT) AS id_museum, CAST(50 AS DECIMAL(5,2)) AS percentage_remaining,
       l.l_partkey AS donable_item
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "donatable": "SELECT p_partkey AS id FROM part",
    "book": "SELECT p_partkey AS id_book FROM part WHERE p_type IN ('PROMO', 'STANDARD')",
    "mineral": "SELECT p_partkey AS id_mineral FROM part WHERE p_type IN ('SMALL', 'LARGE')",
    "donation": """
SELECT l.l_partkey AS id_donatable, l.l_suppkey % 10 AS id_museum, o.o_custkey AS id_player,
       CASE min(l.l_returnflag) WHEN 'A' THEN 'New' WHEN 'N' THEN 'new' ELSE 'Used' END AS condition_object
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
GROUP BY l.l_partkey, l.l_suppkey % 10, o.o_custkey""",
    "event": """
SELECT o_orderkey AS id_event, o_orderpriority AS description, o_custkey * 8 + o_orderkey % 8 AS id_place
FROM orders""",
    "place_e6": """
SELECT c_custkey * 8 + spot AS id_place, c_name || '/' || CAST(spot AS VARCHAR) AS location_name
FROM customer, range(8) AS spots(spot)""",
}

_WORD = re.compile(r"\b([a-z_][a-z0-9_]*)\b")


def _needed(sql: str) -> set[str]:
    out: set[str] = set()
    todo = [sql]
    while todo:
        s = todo.pop()
        for w in set(_WORD.findall(s.lower())):
            if w in CTES and w not in out:
                out.add(w)
                todo.append(CTES[w])
    return out


def with_bridge(sql: str) -> str:
    """Prefix ``sql`` (a plain SELECT) with the bridge CTEs it references."""
    body = sql.strip()
    need = _needed(body)
    parts = [f"{name} AS ({cte.strip()})" for name, cte in CTES.items() if name in need]
    if not parts:
        return body
    if body[:4].upper() == "WITH":
        # the query has CTEs of its own: one WITH clause, bridge first
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
