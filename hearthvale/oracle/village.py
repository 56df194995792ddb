"""Oracle SQL (DuckDB) for V1-V6, written from what each query returns."""

# Degree and mean affection per endpoint; the largest degree by a window.
V1 = """
WITH ends AS (
  SELECT unnest([id_character1, id_character2]) AS id, affection_level AS points FROM relationship),
degree AS (SELECT id, count(*) AS n, avg(points) AS mean FROM ends GROUP BY id),
ranked AS (SELECT *, max(n) OVER () AS most FROM degree)
SELECT (SELECT any_value(name) FROM character WHERE id_character = ranked.id) AS name,
       CAST(round(CAST(mean AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) AS avg_points, n AS total_relationships
FROM ranked SEMI JOIN character ON id_character = ranked.id
WHERE n = most
"""

# One row per edge with both people as structs; the age factor as a quotient test.
V2 = """
WITH people AS (SELECT id_character AS id, {{'name': name, 'age': age}} AS who FROM character),
cold AS (
  SELECT id_character1 AS a, id_character2 AS b, affection_level AS points FROM relationship
  EXCEPT ALL
  SELECT id_character1, id_character2, affection_level FROM relationship
  WHERE affection_level >= {max_points} OR affection_level IS NULL),
both_known AS (
  SELECT x.who AS one, y.who AS two, points FROM cold, people x, people y WHERE x.id = a AND y.id = b)
SELECT one.name AS resident1, one.age AS age_resident_1, two.name AS resident2, two.age AS age_resident_2,
       points AS relation_points
FROM both_known
WHERE greatest(one.age, two.age) >= 3 * least(one.age, two.age)
  AND one.age IS NOT NULL AND two.age IS NOT NULL
"""

# Deliveries numbered by how often their item is delivered.
V3 = """
WITH sent AS (
  SELECT id_inhabitant, id_player, id_item, count(*) OVER (PARTITION BY id_item) AS times
  FROM receive NATURAL JOIN (SELECT id_letter, id_item FROM letter WHERE id_item IS NOT NULL))
SELECT id_inhabitant AS id_resident, id_player, id_item FROM sent
QUALIFY rank() OVER (ORDER BY times DESC) = 1
"""

# Minutes of the day first, the mean over all slots beside them.
V4 = """
WITH slots AS (
  SELECT id_schedule, date_part('hour', CAST(start_time AS TIME)) * 60 + date_part('minute', CAST(start_time AS TIME)) AS begins,
         date_part('hour', CAST(end_time AS TIME)) * 60 + date_part('minute', CAST(end_time AS TIME)) AS ends
  FROM schedule),
late AS (SELECT *, avg(begins) OVER () AS usual FROM slots)
SELECT id_inhabitant AS id_resident, count(*) AS late_activities
FROM late JOIN has USING (id_schedule)
WHERE begins BETWEEN 1 AND 24 * 60 AND begins < usual AND ends < begins
GROUP BY ALL
"""

# Ids first, names once at the end.
V5 = """
WITH wealth AS (SELECT id_player, gold, avg(gold) OVER () AS mean FROM player),
chosen AS (
  SELECT id_inhabitant AS id FROM inhabitant
  WHERE date_trunc('month', birthday) = TIMESTAMP '1999-07-01 00:00:00'
  UNION ALL
  SELECT id_player FROM wealth WHERE gold / 2 >= mean)
SELECT DISTINCT name FROM character SEMI JOIN chosen ON chosen.id = character.id_character
"""

# Everybody less those at either end of an edge.
V6 = """
SELECT name FROM character
WHERE id_character IN (SELECT id_inhabitant FROM inhabitant)
  AND NOT EXISTS (SELECT 1 FROM relationship
                  WHERE list_contains([id_character1, id_character2], character.id_character))
"""
