"""Oracle SQL (DuckDB) for T1–T4: the folded effect of the row triggers."""

_PURCHASE_INPUTS = """
lo AS (SELECT l.l_orderkey, l.l_suppkey, l.l_partkey, CAST(l.l_quantity AS BIGINT) AS q, l.l_returnflag, o.o_custkey
       FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
s0 AS (SELECT l_suppkey AS id_shop, l_partkey AS id_item, sum(q) AS quantity FROM lo WHERE l_orderkey % 2 = 0
       GROUP BY 1, 2),
p0 AS (SELECT o_custkey AS id_player, l_partkey AS id_item, sum(q) AS quantity FROM lo WHERE l_orderkey % 2 = 0
       GROUP BY 1, 2),
buys AS (SELECT l_suppkey AS id_shop, o_custkey AS id_player, l_partkey AS id_item,
                CASE WHEN l_orderkey % 101 = 1 THEN NULL ELSE q END AS amount
         FROM lo WHERE l_orderkey % 2 = 1 AND l_returnflag <> 'R')
"""

PURCHASE_STOCK = "WITH " + _PURCHASE_INPUTS + """
SELECT 'S_STORED' AS tbl, s.id_shop AS id_owner, s.id_item,
       CAST(CASE WHEN d.n IS NULL THEN s.quantity
                 WHEN d.n_amount < d.n THEN NULL
                 ELSE s.quantity - d.total END AS BIGINT) AS quantity
FROM s0 s LEFT JOIN (SELECT id_shop, id_item, count(*) AS n, count(amount) AS n_amount, sum(amount) AS total
                     FROM buys GROUP BY 1, 2) d
  ON d.id_shop = s.id_shop AND d.id_item = s.id_item
UNION ALL
SELECT 'P_STORED', coalesce(p.id_player, d.id_player), coalesce(p.id_item, d.id_item),
       CAST(CASE WHEN d.n IS NULL THEN p.quantity
                 WHEN d.n_amount < d.n THEN NULL
                 WHEN p.id_player IS NULL THEN d.total
                 ELSE p.quantity + d.total END AS BIGINT)
FROM p0 p FULL OUTER JOIN (SELECT id_player, id_item, count(*) AS n, count(amount) AS n_amount, sum(amount) AS total
                           FROM buys GROUP BY 1, 2) d
  ON d.id_player = p.id_player AND d.id_item = p.id_item
"""

_ARRIVALS = """
arr AS (SELECT o_orderkey AS id_animal, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey END AS id_barn,
               o_orderkey AS arrival_seq FROM orders),
ranked AS (SELECT a.*, b.max_capacity, b.occupied_spots, b.id_barn AS known_barn,
                  row_number() OVER (PARTITION BY a.id_barn ORDER BY a.arrival_seq, a.id_animal) AS rn
           FROM arr a LEFT JOIN barn b ON b.id_barn = a.id_barn),
dec AS (SELECT id_animal, id_barn,
               coalesce(known_barn IS NOT NULL
                        AND (max_capacity IS NULL OR occupied_spots IS NULL
                             OR rn <= max_capacity - occupied_spots), FALSE) AS admitted
        FROM ranked)
"""

BARN_ADMISSION = "WITH " + _ARRIVALS + "SELECT id_animal, id_barn, admitted FROM dec"

BARN_REJECTS = "WITH " + _ARRIVALS + """
SELECT id_animal, id_barn, id_animal AS arrival_seq FROM dec WHERE NOT admitted
"""

BARN_OCCUPANCY = "WITH " + _ARRIVALS + """
SELECT b.id_barn, b.max_capacity,
       CAST(b.occupied_spots + coalesce((SELECT count(*) FROM dec WHERE dec.admitted AND dec.id_barn = b.id_barn), 0)
            AS BIGINT) AS occupied_spots
FROM barn b
"""

AFFECTION_BOOST = """
WITH chg AS (
  SELECT c_custkey AS id_inhabitant,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS old_personality,
         CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment
                            WHEN 2 THEN NULL ELSE 'NOMAD' END AS new_personality
  FROM customer),
fired AS (SELECT id_inhabitant FROM chg WHERE old_personality <> new_personality)
SELECT r.id_character1, r.id_character2,
       CAST(r.affection_level
            + (SELECT count(*) FROM fired f WHERE f.id_inhabitant = r.id_character1)
            + (SELECT count(*) FROM fired f WHERE f.id_inhabitant = r.id_character2) AS BIGINT) AS affection_level
FROM relationship r
"""

DONATION_REWARD = """
WITH rewards AS (SELECT id_player, count(*) AS n FROM donation WHERE upper(condition_object) = 'NEW'
                 GROUP BY id_player)
SELECT coalesce(p.id_player, r.id_player) AS id_player, coalesce(p.id_item, 9999) AS id_item,
       CAST(CASE WHEN r.id_player IS NULL THEN p.quantity
                 WHEN p.id_player IS NULL THEN r.n
                 ELSE p.quantity + r.n END AS BIGINT) AS quantity
FROM p_stored p FULL OUTER JOIN rewards r ON r.id_player = p.id_player AND p.id_item = 9999
"""
