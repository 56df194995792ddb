"""Oracle SQL (DuckDB) for E1-E6, written from what each query returns."""

# Entries counted per id and role, names joined to the counts. Equal people
# in both roles (same id and name) are added up.
E1 = """
WITH entry AS (
  SELECT 'r' AS role, id_resident AS id, count(*) AS n FROM residentevent GROUP BY ALL
  UNION ALL SELECT 'p', id_player, count(*) FROM residentevent GROUP BY ALL),
known AS (
  SELECT id, n FROM entry WHERE role = 'r' AND id IN (SELECT id_inhabitant FROM inhabitant)
  UNION ALL SELECT id, n FROM entry WHERE role = 'p' AND id IN (SELECT id_player FROM player)),
person AS (SELECT id, CAST(sum(n) AS BIGINT) AS event_count FROM known GROUP BY id)
SELECT id AS id_person, name AS first_name, CAST(NULL AS VARCHAR) AS last_name, event_count
FROM person JOIN character ON id_character = id
WHERE event_count > (SELECT avg(n) FROM entry)
"""

# The festival's id stands for the person, as the query defines it.
E2 = """
WITH spent AS (
  SELECT f.id, name, sum(gold_expended) AS total
  FROM festivity_persons f JOIN character ON id_character = id_person GROUP BY f.id, name),
most AS (SELECT id, name, total FROM spent QUALIFY total IS NOT DISTINCT FROM first_value(total) OVER (
           PARTITION BY id ORDER BY total DESC NULLS FIRST))
SELECT id, description, id AS id_person, name, CAST(total AS DECIMAL(18,2)) AS max_spent
FROM most JOIN events_stg USING (id)
"""

# The same with people told apart by their own id.
E2_PERSON = """
WITH spent AS (
  SELECT id, id_person, sum(gold_expended) AS total FROM festivity_persons GROUP BY id, id_person),
known AS (SELECT spent.*, name FROM spent JOIN character ON id_character = id_person JOIN events_stg USING (id))
SELECT id, description, id_person, name, CAST(total AS DECIMAL(18,2)) AS max_spent
FROM known JOIN events_stg USING (id)
QUALIFY rank() OVER (PARTITION BY id ORDER BY total DESC NULLS FIRST) = 1
"""

# Both sides of the gap per museum, then the gap.
E3 = """
WITH goal AS (SELECT count(*) AS n FROM donatable),
held AS (
  SELECT id_museum, 100 - percentage_remaining AS stored, CAST(100 * count(DISTINCT donable_item) / any_value(n) AS DECIMAL(38,10)) AS reached
  FROM museum_registry, goal GROUP BY id_museum, percentage_remaining)
SELECT id_museum, CAST(stored AS DECIMAL(18,2)) AS stored_completion,
       CAST(round(reached, 2) AS DECIMAL(18,2)) AS expected_completion,
       CAST(round(reached - stored, 2) AS DECIMAL(18,2)) AS missing_percentage
FROM held WHERE round(reached, 2) > stored
"""

# Kinds by membership, counted with filters.
E4 = """
WITH kinds AS (
  SELECT id_player, id_donatable IN (SELECT id_book FROM book) AS is_book,
         id_donatable IN (SELECT id_mineral FROM mineral) AS is_mineral FROM donation),
mix AS (
  SELECT id_player, count(*) AS n, count(*) FILTER (is_book) AS books, count(*) FILTER (is_mineral) AS minerals
  FROM kinds GROUP BY id_player)
SELECT id_player, name, CAST(round(CAST(100.0 * books / n AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) AS book_percentage,
       CAST(round(CAST(100.0 * minerals / n AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) AS mineral_percentage,
       n AS total_donations
FROM mix JOIN character ON id_character = id_player WHERE n > 50
"""

# The best offer of a shop as one struct: a missing price tops, then the
# larger saving, the smaller item, the larger discount.
E5 = """
WITH offers AS (
  SELECT id_shop, id_item, name, price_to_buy, discount,
         row(price_to_buy * discount IS NULL, coalesce(price_to_buy * discount, 0), -id_item, discount IS NULL, discount) AS worth
  FROM sell JOIN s_stored USING (id_shop) JOIN item USING (id_item))
SELECT id_shop, specialization, o.id_item, o.name AS item_name, o.price_to_buy AS original_price,
       o.discount AS discount_pct, CAST(o.price_to_buy * o.discount * 0.01 AS DECIMAL(18,6)) AS item_discount
FROM (SELECT id_shop, arg_max(offers, worth) AS o FROM offers GROUP BY id_shop) JOIN shop USING (id_shop)
"""

# Places whose first and last event are the same one.
E6 = """
WITH span AS (SELECT *, min(id_event) OVER w AS first, max(id_event) OVER w AS last FROM event WINDOW w AS (PARTITION BY id_place))
SELECT id_event, description, location_name FROM span JOIN place_e6 USING (id_place) WHERE first = last
"""
