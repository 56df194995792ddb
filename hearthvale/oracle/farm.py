"""Oracle SQL (DuckDB) for F1-F6, written from what each query returns."""

# Seconds per finished mission, their mean per player beside the mean of all.
F1 = """
WITH span AS (
  SELECT id_player, epoch(end_date) - epoch(start_date) AS seconds FROM player_mission
  WHERE is_completed = 1 AND start_date < end_date),
mean AS (SELECT id_player, avg(seconds) AS own, (SELECT avg(seconds) FROM span) AS everyone FROM span GROUP BY id_player)
SELECT id_player, nickname AS name, own AS avg_timespan
FROM mean JOIN player USING (id_player) WHERE own < everyone
QUALIFY row_number() OVER (ORDER BY own, id_player) <= 10
"""

# Golden crops per field, then per farm; rank 1 keeps ties.
F2 = """
WITH per_field AS (
  SELECT id_field, count(*) AS n FROM grow SEMI JOIN (SELECT id_crop FROM crop WHERE quality = 'Gold') USING (id_crop)
  GROUP BY id_field),
per_farm AS (
  SELECT id_farm, CAST(sum(n) AS BIGINT) AS num_crops
  FROM per_field SEMI JOIN cultivationfield USING (id_field)
  JOIN farmbuilding ON id_farm_building = id_field GROUP BY id_farm)
SELECT id_farm, specialization, num_crops FROM farm JOIN per_farm USING (id_farm)
QUALIFY rank() OVER (ORDER BY num_crops DESC) = 1
"""

# Products per animal, against the mean of its barn's animals, healthy or not.
F3 = """
WITH made AS (SELECT id_animal, count(id_product) AS n FROM produce GROUP BY id_animal),
barns AS (
  SELECT animal.*, n, avg(n) OVER (PARTITION BY id_barn) AS usual FROM animal JOIN made USING (id_animal)
  WHERE id_barn IS NOT NULL)
SELECT id_barn, id_animal, name_animal AS animal_name, age, health AS health_status, n AS num_products
FROM barns WHERE health = 'Healthy' AND n > usual
"""

# Buildings are added up before they meet their farm.
F4 = """
WITH built AS (
  SELECT id_farm, sum(building_size) AS taken, min(building_size) AS least, count(*) AS n
  FROM farmbuilding GROUP BY id_farm),
room AS (SELECT *, hectares - taken AS free FROM farm JOIN built USING (id_farm) WHERE hectares < 600000)
SELECT id_farm, hectares, CAST(taken AS DECIMAL(18,2)) AS occupied_space, CAST(free AS DECIMAL(18,2)) AS space_left,
       n AS num_buildings,
       CASE WHEN least <> 0 THEN CAST(floor(free / least) AS BIGINT) END AS num_new_buildings
FROM room WHERE free > 0
"""

# A barn is mixed when its smallest and largest species differ. A finished
# mission without a player rules out everybody (NOT IN).
F5 = """
WITH mixed AS (
  SELECT id_barn, count(DISTINCT id_animal_specie) AS species_count FROM animal
  GROUP BY id_barn HAVING min(id_animal_specie) < max(id_animal_specie)),
busy AS (SELECT id_player FROM player_mission WHERE is_completed = 1),
idle AS (
  SELECT id_player, nickname FROM player ANTI JOIN busy USING (id_player)
  WHERE (SELECT count(*) = count(id_player) FROM busy) AND (id_player IS NOT NULL OR (SELECT count(*) = 0 FROM busy)))
SELECT id_player, nickname AS name, id_barn AS id_barn_building, species_count
FROM idle JOIN farm_p USING (id_player) JOIN farmbuilding_p USING (id_farm)
JOIN mixed ON id_barn = id_farm_building SEMI JOIN barn USING (id_barn)
"""

# The value at place ceil(0.97 n) is read off a sorted list.
F6 = """
WITH sorted AS (SELECT list(experience ORDER BY experience ASC NULLS LAST) AS xs, avg(gold) AS mean FROM player)
SELECT id_player, nickname AS name, gold, experience
FROM player, sorted
WHERE gold > mean AND experience > xs[CAST(ceil(len(xs) * 0.97) AS BIGINT)]
"""
