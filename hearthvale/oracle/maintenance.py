"""Oracle SQL (DuckDB) for the maintenance entries, over the supplied tables."""

PERSONALITY_FEED = """
WITH was AS (SELECT c_custkey AS id, if(c_custkey % 11 = 0, NULL, c_mktsegment) AS p FROM customer WHERE c_custkey % 13 <> 0),
now AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment WHEN 3 THEN 'NOMAD' END AS p
        FROM customer WHERE c_custkey % 17 <> 0)
SELECT id AS id_inhabitant, ['update', 'insert', 'delete'][1 + (was.p_known IS NULL)::INT + 2 * (now.p_known IS NULL)::INT] AS kind,
       was.p AS old_personality, now.p AS new_personality
FROM (SELECT *, true AS p_known FROM was) was FULL JOIN (SELECT *, true AS p_known FROM now) now USING (id)
WHERE was.p_known IS NULL OR now.p_known IS NULL OR was.p IS DISTINCT FROM now.p
"""

LASTING_IDS = """
WITH early AS (SELECT name, 999 + row_number() OVER (ORDER BY name) AS id
               FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_partkey % 2 = 0)),
every AS (SELECT p_brand AS name FROM part UNION SELECT p_type FROM part),
late AS (SELECT name, 999 + (SELECT count(*) FROM early) + row_number() OVER (ORDER BY name) AS id
         FROM every ANTI JOIN early USING (name))
SELECT 1 AS run, name, CAST(id AS BIGINT) AS id FROM early
UNION ALL SELECT 2, name, CAST(id AS BIGINT) FROM (FROM early SEMI JOIN every USING (name) UNION ALL FROM late)
"""

CASCADE_GRAPH = """
WITH slot AS (SELECT DISTINCT l_suppkey AS id_shop, CAST(month(l_shipdate) * 10 + l_linenumber % 3 AS BIGINT) AS id_schedule FROM lineitem),
closed AS (SELECT id_shop FROM shop SEMI JOIN (SELECT id_place FROM place WHERE id_place % 5 = 0) USING (id_place))
SELECT 'place' AS table_name, id_place AS key1, CAST(NULL AS BIGINT) AS key2 FROM place WHERE id_place % 5 = 0
UNION ALL SELECT DISTINCT 'schedule', id_schedule, NULL FROM slot WHERE id_schedule % 7 = 3
UNION ALL SELECT 'shop', id_shop, NULL FROM closed
UNION ALL SELECT 's_stored', id_shop, id_item FROM s_stored WHERE id_shop IN (FROM closed)
UNION ALL SELECT 'follow', id_shop, id_schedule FROM slot WHERE id_schedule % 7 = 3 OR id_shop IN (FROM closed)
"""

INGEST_EXTRACT = """
WITH f AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id_activity, o_orderpriority AS special_factor,
         'Activity ' || o_orderpriority AS description, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS duration,
         if(o_custkey % 3 = 0, '', CAST(o_custkey % 5 AS VARCHAR)) AS id_event, CAST(o_custkey % 200 AS VARCHAR) AS reward_item
  FROM orders),
line AS (
  SELECT *, if(k % 2 = 0, [duration, id_activity, description, 'x', special_factor, reward_item, id_event],
               [id_event, 'x', reward_item, id_activity, special_factor, duration, description]) AS parts FROM f)
SELECT 'row' AS kind, id_activity, special_factor, description, duration, nullif(id_event, '') AS id_event, reward_item,
       CAST(NULL AS VARCHAR) AS record
FROM line WHERE k % 41 <> 0 AND k % 43 <> 0
UNION ALL
SELECT 'quarantined', NULL, NULL, NULL, NULL, NULL, NULL,
       array_to_string(if(k % 41 = 0, parts[:3], parts || ['more']), ',') FROM line WHERE k % 41 = 0 OR k % 43 = 0
"""

PARTICIPATE = """
WITH a AS (SELECT CAST(o_orderpriority[1] AS BIGINT) AS id_activity, arg_min(o_custkey % 200, o_orderkey) AS id_specialitem
           FROM orders GROUP BY 1),
p AS (SELECT DISTINCT c_custkey AS id_player FROM customer),
every AS (SELECT * FROM a CROSS JOIN p)
SELECT 'rows' AS measure, CAST(NULL AS BIGINT) AS id, count(*) AS n FROM every
UNION ALL SELECT 'repeated_keys', NULL, count(*) FROM (SELECT 1 FROM every GROUP BY id_activity, id_player, id_specialitem HAVING count(*) > 1)
UNION ALL SELECT 'orphan_players', NULL, count(*) FROM every WHERE id_player % 10 = 0
UNION ALL SELECT 'held', NULL, count(*) FROM orders SEMI JOIN every
          ON CAST(o_orderpriority[1] AS BIGINT) = id_activity AND o_custkey = id_player AND o_custkey % 200 = id_specialitem
UNION ALL SELECT 'id_activity', id_activity, count(*) FROM every GROUP BY id_activity
UNION ALL SELECT 'id_player', id_player, count(*) FROM every GROUP BY id_player
"""
