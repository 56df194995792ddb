"""Oracle SQL (DuckDB) for I1-I6, written from what each query returns.

Division is avoided where DuckDB would answer in DOUBLE and a rounding tie
could land differently: exact integer arithmetic is spelled out instead.
"""

# Items sold below cost, with the loss as a share of the cost.
_LOSS = """
WITH loss AS (
  SELECT id_item, price_to_buy AS cost, price_to_sell AS yield,
         CASE WHEN price_to_buy <> 0 THEN CAST(round(CAST((price_to_sell - price_to_buy) * 100 / price_to_buy
              AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) END AS share
  FROM item WHERE price_to_sell - price_to_buy < 0),
grown AS (SELECT id_seed, seed_type, name_crop, crop.quality FROM seed {join} crop USING (name_crop))
SELECT grown.name_crop AS crop_name, seed_type AS type, cost AS price_to_buy_normal, yield AS price_to_sell,
       share AS price_difference
FROM grown {join} loss ON loss.id_item = id_seed
WHERE lower(quality) = 'cooper' AND loss.id_item IS NOT NULL
"""
I1 = _LOSS.format(join="JOIN")
I1B = _LOSS.format(join="LEFT JOIN")

# Purchases per item and shop once; the best item is the first by its total.
I2 = """
WITH bought AS (
  SELECT id_item, id_shop, sum(amount) AS n, bool_or(amount IS NOT NULL) AS any_amount
  FROM buy_sell WHERE action = 'BUY' GROUP BY ALL),
totals AS (SELECT id_item, sum(n) AS total FROM bought GROUP BY id_item),
best AS (SELECT id_item FROM totals QUALIFY row_number() OVER (ORDER BY total DESC NULLS FIRST, id_item) = 1)
SELECT name_shop AS store_name, specialization, (SELECT name FROM item WHERE item.id_item = any_value(bought.id_item)) AS item_name,
       CAST(sum(n) AS BIGINT) AS num_purchases
FROM bought SEMI JOIN best USING (id_item) JOIN shop USING (id_shop)
GROUP BY name_shop, specialization
"""

# Ties for the last purchase of a day stay: rank 1 within the day.
_I3 = """
WITH last AS (
  SELECT *, CAST(action_time AS DATE) AS day FROM {ledger} WHERE action = 'BUY'
  QUALIFY rank() OVER (PARTITION BY CAST(action_time AS DATE) ORDER BY action_time DESC) = 1)
SELECT name_shop AS shop_name, shop.specialization, nickname AS player_name, item.name AS item_name, amount,
       greatest(money_fluctuation, -money_fluctuation) AS gold_expended, day AS date_of_purchase
FROM last JOIN item USING (id_item) JOIN player USING (id_player) JOIN shop USING (id_shop)
WHERE month(day) = {month}
"""
I3_EVENTS = _I3.format(ledger="buy_sell_events", month=1)
I3_TRADE = _I3.format(ledger="buy_sell", month=12)

# The k closest pairs lie among the k + 1 smallest ids of every value.
I4 = """
WITH few AS (
  SELECT id_food AS id, health_regain AS v FROM food WHERE health_regain IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY health_regain ORDER BY id_food) <= 21),
named AS (SELECT few.*, name FROM few JOIN item ON item.id_item = id)
SELECT a.name AS item1, b.name AS item2, a.v + b.v AS total_health
FROM named a JOIN named b ON b.id > a.id
QUALIFY row_number() OVER (ORDER BY greatest(a.v + b.v - 100, 100 - a.v - b.v), a.id, b.id) <= 20
"""

# Large movements per shop first, then per place.
I5 = """
WITH per_shop AS (
  SELECT id_shop, count(*) AS n FROM buy_sell
  WHERE NOT (money_fluctuation BETWEEN -{threshold} AND {threshold}) GROUP BY id_shop)
SELECT location_name, CAST(sum(n) AS BIGINT) AS transaction_count
FROM per_shop JOIN shop USING (id_shop) JOIN place USING (id_place)
GROUP BY location_name
"""

# Unit prices as fractions m / amount, ranked per item from either end.
# Rounded half away from zero in integer cents:
# n = |money| * 100 - sell * 100 * amount, in units of 1 / (100 * amount).
I6 = """
WITH sold AS (
  SELECT id_item, id_shop, id_player, amount, abs(money_fluctuation) AS m FROM buy_sell
  WHERE action = 'SELL' AND amount > 0),
ends AS (
  SELECT *, max(m / amount) OVER w AS high, min(m / amount) OVER w AS low FROM sold
  WINDOW w AS (PARTITION BY id_item)),
priced AS (
  SELECT ends.*, item.name, CAST(m * 100 AS BIGINT) - CAST(price_to_sell * 100 AS BIGINT) * amount AS n
  FROM ends JOIN item USING (id_item) WHERE m / amount IN (high, low))
SELECT priced.name AS item_name, name_shop AS shop, nickname AS player_name,
       CAST(CAST(sign(n) * ((2 * abs(n) + amount) // (2 * amount)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))
         AS money_earned_over_base
FROM priced JOIN shop USING (id_shop) JOIN player USING (id_player)
"""
