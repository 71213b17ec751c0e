"""Named SQL building blocks of the oracle queries. Each lists the blocks it reads."""

from __future__ import annotations

from statistics import NormalDist

from shelfcast.schemas import HOLIDAY_RAMP, SERVICE_LEVELS
from shelfcast.sources.fixtures import HOLIDAYS

SER = "store_id, sku_id"
W = "PARTITION BY store_id, sku_id ORDER BY date"
ARRIVAL_SQL = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, "
               "l_linestatus")
HOLIDAY_ROWS = ", ".join(f"(DATE '{d}', {m})" for d, m in sorted(HOLIDAYS.items()))
RAMP_ROWS = ", ".join(f"({n}, {w})" for n, w in HOLIDAY_RAMP)
POLICY_ROWS = ", ".join(["('current_state', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE))"] + [
    f"('forecast_driven', CAST({s} AS DOUBLE), CAST({NormalDist().inv_cdf(s)!r} AS DOUBLE))" for s in SERVICE_LEVELS])
ELASTICITY_ROWS = "('sized', -2.0, 1.6, 0.02), ('tiered', -0.8, 1.3, 0.01)"

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: str, sql: str) -> None:
    BLOCKS[name] = (needs.split(), sql)


def query(needs: str, select: str) -> str:
    """A full statement: the needed blocks, in dependency order, and the final select."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in BLOCKS[name][0]:
            add(dep)
        order.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({BLOCKS[n][1].strip()})" for n in order]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + select


def cols(plain: str, rounded: str = "", digits: int = 6) -> str:
    """Select list: plain columns, then rounded ones (adding 0.0 drops a negative zero)."""
    out = [c.strip() for c in plain.split(",") if c.strip()]
    out += [f"round({c.strip()}, {digits}) + 0.0 AS {c.strip()}" for c in rounded.split(",") if c.strip()]
    return ", ".join(out)


# ------------------------------------------------------------------ daily half
block("bronze", "", f"""
SELECT n_name AS store_id, p_type AS sku_id, CAST(l_shipdate AS DATE) AS date,
       CASE WHEN l_returnflag = 'R' AND l_tax < 0.005 THEN -q ELSE demand END AS units_sold,
       demand AS true_demand,
       CASE WHEN q = 50 AND l_tax > 0.075 THEN p_retailprice * (1 - discount_pct) * 100
            ELSE p_retailprice * (1 - discount_pct) END AS selling_price,
       p_retailprice AS regular_price, CAST(discount_pct > 0 AS INTEGER) AS on_promo, discount_pct,
       CASE WHEN l_tax > 0.075 AND l_linestatus = 'O' AND q <> 50 THEN 1 ELSE 0 END AS stockout_flag,
       {ARRIVAL_SQL}
FROM (SELECT *, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN q
                     WHEN p_type = 'STANDARD' THEN CAST(floor(q * q / 50.0) AS INTEGER)
                     WHEN p_type = 'LARGE' THEN CAST(floor(greatest(q - 25, 0) * greatest(q - 25, 0) / 25.0) AS INTEGER)
                     ELSE greatest(q - 25, 0) END AS demand
      FROM (SELECT *, CAST(l_quantity AS INTEGER) AS q,
                   CAST(CASE WHEN l_discount > 0.095 THEN 0.20 WHEN l_discount > 0.085 THEN 0.15
                             WHEN l_discount > 0.075 THEN 0.10 ELSE 0 END AS DOUBLE) AS discount_pct
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
                 JOIN part ON l_partkey = p_partkey))""")
block("products", "", """
SELECT sku_id, CASE WHEN sku_id IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'sized' ELSE 'tiered' END AS category,
       base_price, round(base_price * (0.5 + 0.01 * length(sku_id)), 2) AS unit_cost
FROM (SELECT p_type AS sku_id, min(p_retailprice) AS base_price FROM part GROUP BY p_type)""")
block("stores", "", """
SELECT n_name AS store_id, r_name AS region, coalesce(n, 0) / 10.0 AS store_size
FROM nation JOIN region ON n_regionkey = r_regionkey
     LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey""")
block("r1", "bronze", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku_id, date ORDER BY {ARRIVAL_SQL}) AS rn
               FROM bronze) WHERE rn = 1""")
block("r2", "r1", """
SELECT * REPLACE (CASE WHEN units_sold >= 0 THEN units_sold END AS units_sold), units_sold < 0 AS is_negative FROM r1""")
block("r3", "r2", """
SELECT * REPLACE (CASE WHEN selling_price > 3 * typical OR selling_price < 0.3 * typical
                       THEN regular_price * (1 - discount_pct) ELSE selling_price END AS selling_price),
       selling_price > 3 * typical OR selling_price < 0.3 * typical AS is_price_outlier
FROM (SELECT *, median(regular_price) OVER (PARTITION BY store_id, sku_id) AS typical FROM r2)""")
block("days", "bronze", """
SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT min(date) AS lo, max(date) AS hi FROM bronze)""")
block("r4", "r3 days", """
SELECT s.store_id, s.sku_id, d.date, units_sold, true_demand, selling_price, regular_price, on_promo, discount_pct,
       stockout_flag, is_negative, is_price_outlier, r.date IS NULL AS is_filled
FROM (SELECT DISTINCT store_id, sku_id FROM r1) s CROSS JOIN days d
     LEFT JOIN r3 r ON r.store_id = s.store_id AND r.sku_id = s.sku_id AND r.date = d.date""")
block("carried", "r4", f"""
SELECT * REPLACE (
  coalesce(last_value(regular_price IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
           first_value(regular_price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS regular_price,
  coalesce(last_value(selling_price IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
           first_value(selling_price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS selling_price,
  coalesce(on_promo, 0) AS on_promo, coalesce(discount_pct, 0.0) AS discount_pct,
  coalesce(stockout_flag, 0) AS stockout_flag)
FROM r4""")
block("marked", "carried", """
SELECT *, coalesce(demand_target, median(demand_target) OVER (
            PARTITION BY store_id, sku_id, isodow(date) ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0.0)
          AS demand_filled
FROM (SELECT *, CASE WHEN stockout_flag = 0 THEN CAST(units_sold AS DOUBLE) END AS demand_target FROM carried)""")
block("silver", "marked products", """
SELECT m.*, CASE WHEN is_filled THEN 0 ELSE CAST(sum(on_promo) OVER (PARTITION BY store_id, category, date) - on_promo AS INTEGER) END AS n_sibling_promo
FROM marked m JOIN products USING (sku_id)""")
block("cutoffs", "days", """
SELECT CAST(5 - k AS INTEGER) AS fold, CAST(last_day - CAST(28 * k AS INTEGER) AS DATE) AS cutoff
FROM (SELECT max(date) AS last_day FROM days), (SELECT unnest([1, 2, 3, 4]) AS k)""")
block("segments", "marked cutoffs", """
SELECT *, CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic'
               WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS segment
FROM (SELECT store_id, sku_id, count(demand_target) / greatest(count(*) FILTER (demand_target > 0), 1) AS adi,
             CASE WHEN count(*) FILTER (demand_target > 0) > 1
                  THEN pow(stddev_samp(demand_target) FILTER (demand_target > 0)
                           / avg(demand_target) FILTER (demand_target > 0), 2) ELSE 0.0 END AS cv2,
             avg(demand_target) AS mean_demand, avg(CAST(demand_target = 0 AS DOUBLE)) AS zero_share
      FROM marked WHERE date <= (SELECT min(cutoff) FROM cutoffs) GROUP BY store_id, sku_id)""")
block("panel", "silver products stores segments", """
SELECT s.*, p.category, p.unit_cost, t.region, t.store_size, g.segment
FROM silver s JOIN products p USING (sku_id) JOIN stores t USING (store_id) JOIN segments g USING (store_id, sku_id)""")
block("calendar", "", f"""
SELECT * FROM (VALUES {HOLIDAY_ROWS}) v(holiday, multiplier)""")
block("dated", "panel calendar", """
SELECT p.*, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(day(date) AS INTEGER) AS dom,
       CAST(month(date) AS INTEGER) AS month, CAST(week(date) AS INTEGER) AS weekofyear,
       CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
       CAST(day(date) IN (25, 26, 27, 28, 29, 30, 31, 1) AS INTEGER) AS is_payday_window,
       coalesce(least(n.ahead, 60), 60) AS days_to_holiday
FROM panel p JOIN (SELECT d.date AS on_day, CAST(min(holiday) - d.date AS INTEGER) AS ahead
                   FROM (SELECT DISTINCT date FROM panel) d LEFT JOIN calendar ON holiday >= d.date GROUP BY d.date) n
     ON n.on_day = p.date""")
block("gold0", "dated", f"""
SELECT *, selling_price / regular_price AS price_ratio,
       selling_price / avg(regular_price) OVER ({W} ROWS UNBOUNDED PRECEDING) AS rel_price, ln(selling_price) AS log_price,
       lag(demand_filled, 28) OVER ({W}) AS lag_28, lag(demand_filled, 35) OVER ({W}) AS lag_35,
       lag(demand_filled, 42) OVER ({W}) AS lag_42, lag(demand_filled, 49) OVER ({W}) AS lag_49,
       lag(demand_filled, 364) OVER ({W}) AS lag_364
FROM dated""")
block("gold1", "gold0", f"""
SELECT *, avg(lag_28) OVER ({W} ROWS 6 PRECEDING) AS rmean_7, avg(lag_28) OVER ({W} ROWS 27 PRECEDING) AS rmean_28,
       avg(lag_28) OVER ({W} ROWS 90 PRECEDING) AS rmean_91, stddev_samp(lag_28) OVER ({W} ROWS 27 PRECEDING) AS rstd_28,
       avg(CASE WHEN lag_28 = 0 THEN 1.0 ELSE 0.0 END) OVER ({W} ROWS 27 PRECEDING) AS rzero_28
FROM gold0""")
block("gold", "gold1", """
SELECT *, (coalesce(lag_28, 0) + coalesce(lag_35, 0) + coalesce(lag_42, 0) + coalesce(lag_49, 0))
          / nullif(CAST(lag_28 IS NOT NULL AS INTEGER) + CAST(lag_35 IS NOT NULL AS INTEGER)
                   + CAST(lag_42 IS NOT NULL AS INTEGER) + CAST(lag_49 IS NOT NULL AS INTEGER), 0) AS dow_mean_4w,
       rmean_28 / (rmean_91 + 0.1) AS trend_ratio
FROM gold1""")
block("promo_plan", "bronze", """
SELECT store_id, sku_id, CAST(date + 28 AS DATE) AS date, max(discount_pct) AS discount_pct
FROM bronze WHERE on_promo = 1 GROUP BY ALL""")
block("future", "silver products promo_plan days", """
SELECT *, CAST(sum(on_promo) OVER (PARTITION BY store_id, category, date) - on_promo AS INTEGER) AS n_sibling_promo
FROM (SELECT f.store_id, f.sku_id, f.date, f.regular_price, coalesce(p.discount_pct, 0.0) AS discount_pct,
             CAST(coalesce(p.discount_pct, 0.0) > 0 AS INTEGER) AS on_promo,
             f.regular_price * (1 - coalesce(p.discount_pct, 0.0)) AS selling_price
      FROM (SELECT store_id, sku_id, regular_price, CAST(e.last_day + CAST(k AS INTEGER) AS DATE) AS date
            FROM (SELECT store_id, sku_id, max_by(regular_price, date) AS regular_price FROM silver GROUP BY ALL),
                 (SELECT max(date) AS last_day FROM days) e, (SELECT unnest(range(1, 29)) AS k)) f
           LEFT JOIN promo_plan p ON p.store_id = f.store_id AND p.sku_id = f.sku_id AND p.date = f.date)
     JOIN products USING (sku_id)""")

# ------------------------------------------------------------------ forecasts
block("recent", "marked cutoffs", """
SELECT store_id, sku_id, fold, cutoff, (6 - CAST(cutoff - date AS INTEGER) % 7) AS slot, CAST(cutoff - date AS INTEGER) AS age,
       demand_filled
FROM marked CROSS JOIN cutoffs WHERE date <= cutoff AND date > cutoff - 28""")
block("slots", "recent", """
SELECT store_id, sku_id, fold, cutoff, slot, max(demand_filled) FILTER (age < 7) AS seasonal_naive,
       CASE WHEN count(demand_filled) = 4 THEN avg(demand_filled) END AS naive_dow_avg
FROM recent GROUP BY ALL""")
block("native", "slots", """
SELECT store_id, sku_id, CAST(cutoff + CAST(k AS INTEGER) AS DATE) AS date, fold, model, forecast
FROM (SELECT *, 'seasonal_naive' AS model, seasonal_naive AS forecast FROM slots
      UNION ALL SELECT *, 'naive_dow_avg' AS model, naive_dow_avg AS forecast FROM slots),
     (SELECT unnest(range(1, 29)) AS k)
WHERE (k - 1) % 7 = slot""")
block("history", "marked cutoffs", """
SELECT store_id, sku_id, fold, cutoff, date, demand_filled AS y,
       row_number() OVER (PARTITION BY store_id, sku_id, fold ORDER BY date) AS pos
FROM marked CROSS JOIN cutoffs WHERE date <= cutoff""")
block("croston", "history", """
SELECT h.store_id, h.sku_id, h.fold, h.cutoff, coalesce(0.95 * z / p, 0.0) AS croston_sba
FROM (SELECT DISTINCT store_id, sku_id, fold, cutoff FROM history) h LEFT JOIN (
  SELECT store_id, sku_id, fold, sum(w * y) AS z, sum(w * gap) AS p
  FROM (SELECT *, pow(0.9, n - k) * CASE WHEN k = 1 THEN 1.0 ELSE 0.1 END AS w
        FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku_id, fold ORDER BY pos) AS k,
                     pos - lag(pos, 1, 0) OVER (PARTITION BY store_id, sku_id, fold ORDER BY pos) AS gap,
                     count(*) OVER (PARTITION BY store_id, sku_id, fold) AS n
              FROM history WHERE y > 0))
  GROUP BY ALL) c ON c.store_id = h.store_id AND c.sku_id = h.sku_id AND c.fold = h.fold""")
ETS_GIVEN = (0.2, 0.01, 0.1, 0.98)  # level, trend, season, damping
_A, _B, _G, _PHI = (f"CAST({v} AS DOUBLE)" for v in ETS_GIVEN)
block("ets_rows", "marked cutoffs segments", """
SELECT store_id, sku_id, fold, cutoff, demand_filled + 1 AS y, CAST(row_number() OVER s - 1 AS INTEGER) AS t
FROM marked JOIN segments USING (store_id, sku_id) CROSS JOIN cutoffs
WHERE segment IN ('smooth', 'erratic') AND date <= cutoff AND date > cutoff - 365
WINDOW s AS (PARTITION BY store_id, sku_id, fold ORDER BY date)""")
# season[1] belongs to the coming day; a step puts its new value behind the others
block("ets_state", "ets_rows", f"""
SELECT store_id, sku_id, fold, cutoff, last, CAST(-1 AS INTEGER) AS t, first AS level, (second - first) / 7 AS trend, list_transform(week, lambda v: v / first) AS season
FROM (SELECT store_id, sku_id, fold, cutoff, max(t) AS last, avg(y) FILTER (t < 7) AS first, avg(y) FILTER (t >= 7 AND t < 14) AS second,
             list(y ORDER BY t) FILTER (t < 7) AS week FROM ets_rows GROUP BY ALL)
UNION ALL
SELECT store_id, sku_id, fold, cutoff, last, t, next_level, {_B} * (next_level - level) + (1 - {_B}) * {_PHI} * trend,
       list_append(season[2:7], {_G} * y / base + (1 - {_G}) * season[1])
FROM (SELECT r.* EXCLUDE (t), n.t, y, level + {_PHI} * trend AS base, {_A} * y / season[1] + (1 - {_A}) * (level + {_PHI} * trend) AS next_level
      FROM ets_state r JOIN ets_rows n ON n.store_id = r.store_id AND n.sku_id = r.sku_id AND n.fold = r.fold AND n.t = r.t + 1)""")
block("ets_given", "ets_state croston segments", f"""
SELECT store_id, sku_id, CAST(cutoff + CAST(k AS INTEGER) AS DATE) AS date, fold, 'ets' AS model,
       greatest((level + {_PHI} * (1 - pow({_PHI}, k)) / (1 - {_PHI}) * trend) * season[CAST((k - 1) % 7 + 1 AS INTEGER)] - 1, 0) AS forecast
FROM ets_state, (SELECT unnest(range(1, 29)) AS k) WHERE t = last
UNION ALL
SELECT store_id, sku_id, CAST(cutoff + CAST(k AS INTEGER) AS DATE), fold, 'ets', croston_sba
FROM croston JOIN segments USING (store_id, sku_id), (SELECT unnest(range(1, 29)) AS k) WHERE segment NOT IN ('smooth', 'erratic')""")
block("mixed", "native", """
SELECT store_id, sku_id, date, fold, 'ensemble_70_30' AS model,
       0.7 * max(forecast) FILTER (model = 'naive_dow_avg') + 0.3 * max(forecast) FILTER (model = 'seasonal_naive') AS forecast
FROM native GROUP BY store_id, sku_id, date, fold""")
block("fc", "native mixed panel", """
SELECT f.*, p.demand_target AS actual, p.true_demand, p.segment, p.category, p.on_promo, p.selling_price, p.unit_cost
FROM (SELECT * FROM native UNION ALL SELECT store_id, sku_id, date, fold, model, forecast FROM mixed) f
     LEFT JOIN panel p ON p.store_id = f.store_id AND p.sku_id = f.sku_id AND p.date = f.date""")
block("sc", "fc", "SELECT * FROM fc WHERE actual IS NOT NULL")

METRIC_SQL = """
  sum(abs(f - y)) FILTER (y IS NOT NULL AND f IS NOT NULL) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-9) AS wape,
  avg(abs(f - y) / y) FILTER (y > 0 AND f IS NOT NULL) AS mape,
  avg(2 * abs(f - y) / (abs(y) + abs(f))) FILTER (abs(y) + abs(f) > 0) AS smape,
  sum(f - y) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-9) AS bias,
  sum(abs(f - y)) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-9)
    + abs(sum(f - y) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-9)) AS vn1,
  count(*) FILTER (y IS NOT NULL AND f IS NOT NULL) AS n"""
METRIC_COLS = "wape, mape, smape, bias, vn1"
HOURLY_SQL = """
  sum(abs(f - y)) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-12) AS wape,
  sum(f - y) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-12) AS wpe_bias,
  sum(abs(f - y)) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-12)
    + abs(sum(f - y) / greatest(sum(y) FILTER (f IS NOT NULL), 1e-12)) AS vn1,
  count(*) FILTER (y IS NOT NULL AND f IS NOT NULL) AS n"""


def metrics_by(keys: str, source: str, actual: str = "actual", forecast: str = "forecast") -> str:
    return (f"SELECT {keys}, {METRIC_SQL} FROM (SELECT *, {actual} AS y, {forecast} AS f FROM {source}) "
            f"GROUP BY {keys}")


def level_sums(keys: str) -> str:
    return (f"(SELECT model, {keys}, CAST(date_trunc('week', date) AS DATE) AS period, sum(actual) AS actual, "
            f"sum(forecast) AS forecast FROM sc GROUP BY ALL)")


block("board", "sc", f"""
SELECT *, 'daily_store_sku' AS grain FROM ({metrics_by('model', 'sc')})
UNION ALL SELECT *, 'weekly_store_sku' AS grain FROM ({metrics_by('model', level_sums('store_id, sku_id'))})
UNION ALL SELECT *, 'weekly_category' AS grain FROM ({metrics_by('model', level_sums('category'))})""")

# ------------------------------------------------------------------ inventory
block("sigma1", "sc", """
SELECT store_id, sku_id, stddev_samp(forecast - actual) AS sigma FROM sc
WHERE model = 'naive_dow_avg' AND fold = 1 GROUP BY ALL""")
block("sigma_all", "sc", """
SELECT store_id, sku_id, stddev_samp(forecast - actual) AS sigma FROM sc WHERE model = 'naive_dow_avg' GROUP BY ALL""")
block("sim", "fc", """
SELECT store_id, sku_id, date, coalesce(CAST(true_demand AS DOUBLE), 0.0) AS demand, coalesce(forecast, 0.0) AS forecast,
       unit_cost, selling_price
FROM fc WHERE model = 'naive_dow_avg' AND fold > 1""")
block("hist_avg", "marked sim", """
SELECT store_id, sku_id, avg(demand_filled) AS hist_avg
FROM marked, (SELECT min(date) AS f FROM sim) WHERE date < f AND date >= f - 28 GROUP BY ALL""")
block("cost_price", "sim", """
SELECT store_id, sku_id, median(unit_cost) AS unit_cost, median(selling_price) AS price FROM sim GROUP BY ALL""")
block("ahead", "sim", f"""
SELECT *, sum(forecast) OVER ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)
          + last_value(forecast) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
            * (10 - count(*) OVER ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS ahead
FROM sim""")
block("policies", "", f"SELECT * FROM (VALUES {POLICY_ROWS}) v(policy, target_service, z)")
block("levels", "ahead hist_avg sigma1 policies", """
SELECT a.store_id, a.sku_id, a.date, demand, policy, target_service,
       CASE WHEN z IS NULL THEN coalesce(hist_avg, 0) * 14 ELSE ahead + z * coalesce(sigma, 0) * sqrt(10) END AS order_up_to,
       coalesce(hist_avg, 0) * 10 AS start_stock
FROM ahead a LEFT JOIN hist_avg USING (store_id, sku_id) LEFT JOIN sigma1 USING (store_id, sku_id) CROSS JOIN policies""")
block("numbered", "levels", """
SELECT *, CAST(row_number() OVER (PARTITION BY store_id, sku_id, policy, target_service ORDER BY date) - 1 AS INTEGER) AS t,
       coalesce(target_service, 0) AS service_key
FROM levels""")
# state after day t: stock, and what arrives 1, 2 and 3 days later; the review happens every 7 days
_ORDER = "CASE WHEN {t} % 7 = 0 THEN greatest(0, ceil({s} - ({oh} + {rest}))) ELSE 0 END"
_O0 = _ORDER.format(t="t", s="order_up_to", oh="start_stock", rest="0")
_O1 = _ORDER.format(t="n.t", s="n.order_up_to", oh="(r.on_hand + r.p1)", rest="(r.p2 + r.p3)")
block("replay", "numbered", f"""
SELECT store_id, sku_id, policy, target_service, service_key, date, t, demand, start_stock - least(start_stock, demand) AS on_hand,
       least(start_stock, demand) AS sold, CAST(0 AS DOUBLE) AS p1, CAST(0 AS DOUBLE) AS p2, CAST({_O0} AS DOUBLE) AS p3
FROM numbered WHERE t = 0
UNION ALL
SELECT n.store_id, n.sku_id, n.policy, n.target_service, n.service_key, n.date, n.t, n.demand,
       (r.on_hand + r.p1) - least(r.on_hand + r.p1, n.demand), least(r.on_hand + r.p1, n.demand),
       r.p2, r.p3, CAST({_O1} AS DOUBLE)
FROM replay r JOIN numbered n ON n.store_id = r.store_id AND n.sku_id = r.sku_id AND n.policy = r.policy
     AND n.service_key = r.service_key AND n.t = r.t + 1""")
block("costs_daily", "replay cost_price", """
SELECT policy, target_service, date, sum(on_hand) AS units, sum(on_hand * unit_cost) AS value, sum(sold) AS sold,
       sum(demand) AS demand, sum((demand - sold) * (price - unit_cost)) AS lost_margin,
       count(*) FILTER (demand - sold > 0) AS short, count(*) AS cells
FROM replay JOIN cost_price USING (store_id, sku_id) GROUP BY ALL""")
block("costs", "costs_daily", """
SELECT policy, target_service, sum(sold) / greatest(sum(demand), 1e-9) AS fill_rate, avg(units) AS avg_inventory_units,
       avg(value) AS avg_inventory_value, sum(value) * 0.25 / 365 AS holding_cost, sum(lost_margin) AS lost_margin,
       sum(value) * 0.25 / 365 + sum(lost_margin) AS total_cost, sum(short) / sum(cells) AS stockout_days_pct,
       count(*) AS sim_days
FROM costs_daily GROUP BY ALL""")
block("story", "costs", """
SELECT metric, before, after, after / before - 1 AS change
FROM (SELECT c.fill_rate AS b1, f.fill_rate AS a1, c.avg_inventory_value AS b2, f.avg_inventory_value AS a2,
             c.lost_margin * 365 / c.sim_days AS b3, f.lost_margin * 365 / f.sim_days AS a3,
             c.holding_cost * 365 / c.sim_days AS b4, f.holding_cost * 365 / f.sim_days AS a4,
             c.stockout_days_pct AS b5, f.stockout_days_pct AS a5
      FROM costs c, costs f WHERE c.policy = 'current_state' AND f.target_service = 0.95),
     LATERAL (VALUES ('Fill rate', b1, a1), ('Avg inventory value ($)', b2, a2), ('Lost margin, annualised ($)', b3, a3),
                     ('Holding cost, annualised ($)', b4, a4), ('Stock-out store-SKU-days (%)', b5, a5)) v(metric, before, after)""")
block("next28", "marked days", """
SELECT store_id, sku_id, CAST(cutoff + CAST(k AS INTEGER) AS DATE) AS date, p50 FROM (
  SELECT store_id, sku_id, cutoff, (6 - CAST(cutoff - date AS INTEGER) % 7) AS slot,
         CASE WHEN count(demand_filled) = 4 THEN avg(demand_filled) END AS p50
  FROM marked, (SELECT max(date) AS cutoff FROM days) WHERE date > cutoff - 28 GROUP BY ALL),
  (SELECT unnest(range(1, 29)) AS k)
WHERE (k - 1) % 7 = slot""")
block("intervals", "next28 sigma_all", """
SELECT store_id, sku_id, date, p50, sigma, greatest(p50 - 1.2816 * sigma, 0) AS p10, p50 + 1.2816 * sigma AS p90
FROM next28 LEFT JOIN sigma_all USING (store_id, sku_id)""")
block("replenish", "intervals", f"""
SELECT *, ceil(demand_l_plus_r + safety_stock) AS order_up_to
FROM (SELECT store_id, sku_id, sum(p50) AS demand_l_plus_r, min(sigma) AS sigma,
             {NormalDist().inv_cdf(0.95)!r} * coalesce(min(sigma), 0) * sqrt(10) AS safety_stock
      FROM intervals WHERE date < (SELECT min(date) FROM intervals) + 10 GROUP BY store_id, sku_id)""")

# ------------------------------------------------------------------ pricing and monitoring
block("last90", "panel", "SELECT * FROM panel WHERE date > (SELECT max(date) FROM panel) - 90")
block("skus", "last90", """
SELECT sku_id, min(category) AS category, median(regular_price) AS regular_price, min(unit_cost) AS unit_cost,
       sum(demand_filled) / (SELECT count(DISTINCT date) FROM last90) AS daily_units
FROM last90 WHERE on_promo = 0 GROUP BY sku_id""")
block("elasticity", "", f"""
SELECT category, CAST(elasticity AS DOUBLE) AS elasticity, CAST(promo_uplift AS DOUBLE) AS promo_uplift,
       CAST(cannibalisation_per_sibling AS DOUBLE) AS cannibalisation_per_sibling
FROM (VALUES {ELASTICITY_ROWS}) v(category, elasticity, promo_uplift, cannibalisation_per_sibling)""")
block("recs", "skus elasticity", """
SELECT *, (margin_new - margin_now) * 365 AS annual_margin_gain
FROM (SELECT *, rec_price / regular_price - 1 AS price_change_pct,
             daily_units * pow(rec_price / regular_price, elasticity) AS new_daily_units,
             (regular_price - unit_cost) * daily_units AS margin_now,
             (rec_price - unit_cost) * daily_units * pow(rec_price / regular_price, elasticity) AS margin_new
      FROM (SELECT s.*, e.elasticity, least(greatest(CASE WHEN elasticity < -1 THEN unit_cost * elasticity / (1 + elasticity)
                     ELSE regular_price * 1.1 END, regular_price * 0.9), regular_price * 1.1) AS rec_price
            FROM skus s JOIN elasticity e USING (category)))""")
block("promo", "skus elasticity panel", """
SELECT category, depth, units / base_units AS units_lift_x,
       (price * (1 - depth) - cost) * units - (price - cost) * base_units - cannibal_loss AS incremental_margin,
       cannibal_loss, (price * (1 - depth) - cost) / (price * (1 - depth)) AS promo_margin_pct
FROM (SELECT *, base_units * promo_uplift * pow(1 - depth, elasticity) AS units,
             cannibalisation_per_sibling * sibling_margin * n_siblings AS cannibal_loss
      FROM (SELECT category, avg(regular_price) AS price, avg(unit_cost) AS cost, avg(daily_units / ns) AS base_units,
                   avg((regular_price - unit_cost) * daily_units / ns) AS sibling_margin
            FROM skus, (SELECT count(DISTINCT store_id) AS ns FROM panel) GROUP BY category)
           JOIN elasticity USING (category)
           JOIN (SELECT category, count(DISTINCT sku_id) - 1 AS n_siblings FROM panel GROUP BY category) USING (category),
           (SELECT CAST(unnest([0.1, 0.15, 0.2, 0.25, 0.3]) AS DOUBLE) AS depth))""")
_REGRESSORS = ([(f"dow_{k}", f"CAST(dow = {k} AS INTEGER)") for k in range(1, 7)] + [(f"month_{k}", f"CAST(month = {k} AS INTEGER)") for k in range(2, 13)]
               + [(c, c) for c in ("log_price_dm", "on_promo", "n_sibling_promo", "holiday")])
block("design", "dated", """
SELECT category, sku_id, demand_target AS y, dow, month, on_promo, n_sibling_promo, CAST(days_to_holiday <= 3 AS INTEGER) AS holiday,
       ln(selling_price) - avg(ln(selling_price)) OVER (PARTITION BY store_id, sku_id) AS log_price_dm,
       (date - min(date) OVER (PARTITION BY category)) / 365.0 AS t
FROM dated WHERE demand_target IS NOT NULL""")
block("balance", "design", f"""
SELECT category, CAST(NULL AS VARCHAR) AS sku_id, regressor, total
FROM (SELECT category, {', '.join(f'CAST(sum({x} * y) AS DOUBLE) AS {name}' for name, x in _REGRESSORS)} FROM design GROUP BY category)
     UNPIVOT (total FOR regressor IN ({', '.join(name for name, _ in _REGRESSORS)}))
UNION ALL
SELECT category, sku_id, regressor, total
FROM (SELECT category, sku_id, CAST(sum(t * y) AS DOUBLE) AS trend, CAST(sum(y) AS DOUBLE) AS units FROM design GROUP BY category, sku_id)
     UNPIVOT (total FOR regressor IN (trend, units))""")
block("health", "sc board", f"""
SELECT *, CASE WHEN alert_accuracy AND alert_bias THEN 'RED' WHEN alert_accuracy THEN 'AMBER-accuracy'
               WHEN alert_bias THEN 'AMBER-bias' ELSE 'GREEN' END AS status
FROM (SELECT week, category, wape, bias, units,
             wape > 1.2 * (SELECT wape FROM board WHERE grain = 'daily_store_sku' AND model = 'naive_dow_avg') AS alert_accuracy,
             abs(bias) > 0.1 AS alert_bias
      FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS week, category,
                   sum(abs(forecast - actual)) / greatest(sum(actual), 1e-9) AS wape,
                   sum(forecast - actual) / greatest(sum(actual), 1e-9) AS bias, sum(actual) AS units
            FROM sc WHERE model = 'naive_dow_avg' GROUP BY 1, 2))""")
# rel_price divides by a running mean, whose last digits depend on the engine's order of summation; nine
# decimals on both sides keep a price equal to its mean on the same side of an edge at 1.
DRIFT = ["rmean_28", "selling_price", "rel_price", "discount_pct", "price_ratio", "n_sibling_promo"]
block("drift_ref", "gold cutoffs", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(CAST({f} AS DOUBLE), 9) AS value FROM gold "
    f"WHERE date <= (SELECT min(cutoff) FROM cutoffs) AND {f} IS NOT NULL" for f in DRIFT))
block("drift_cur", "gold cutoffs", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(CAST({f} AS DOUBLE), 9) AS value FROM gold "
    f"WHERE date > (SELECT max(cutoff) FROM cutoffs) AND {f} IS NOT NULL" for f in DRIFT))
block("drift_edges", "drift_ref", """
SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges
FROM drift_ref GROUP BY feature""")
block("drift_bins", "drift_ref drift_cur drift_edges", """
SELECT feature, bin, sum(is_ref) AS n_ref, sum(1 - is_ref) AS n_cur
FROM (SELECT v.feature, is_ref, len(list_filter(edges[2:-2], lambda e: e <= v.value)) AS bin
      FROM (SELECT *, 1 AS is_ref FROM drift_ref UNION ALL SELECT *, 0 FROM drift_cur) v JOIN drift_edges USING (feature))
GROUP BY ALL""")
block("drift", "drift_bins drift_edges", """
SELECT feature, CASE WHEN n_edges < 3 THEN 0.0 ELSE psi END AS psi
FROM (SELECT g.feature, g.n_edges, sum((a - e) * ln(a / e)) AS psi
      FROM (SELECT g.feature, g.n_edges, greatest(coalesce(n_ref, 0) / all_ref, 1e-6) AS e,
                   greatest(coalesce(n_cur, 0) / all_cur, 1e-6) AS a
            FROM (SELECT feature, len(edges) AS n_edges, unnest(range(0, greatest(len(edges) - 1, 1))) AS bin FROM drift_edges) g
                 LEFT JOIN drift_bins b ON b.feature = g.feature AND b.bin = g.bin
                 JOIN (SELECT feature, sum(n_ref) AS all_ref, sum(n_cur) AS all_cur FROM drift_bins GROUP BY feature) t
                      ON t.feature = g.feature) g
      GROUP BY ALL)""")

# ------------------------------------------------------------------ hourly half
block("hours", "", """
SELECT user_id AS store_id, CAST(ts AS DATE) AS dt, hour(ts) AS h, max(CAST(event_type = 'error' AS INTEGER)) AS oos,
       sum(value) FILTER (event_type <> 'error') AS sold
FROM events GROUP BY ALL""")
_HOURS = ", ".join(
    f"coalesce(max(CASE WHEN h = {h} AND oos = 0 THEN sold END), 0.0) AS s{h}, "
    f"coalesce(max(CASE WHEN h = {h} THEN oos END), 0) AS o{h}" for h in range(24))
S_LIST = "[" + ", ".join(f"s{h}" for h in range(24)) + "]"
O_LIST = "[" + ", ".join(f"o{h}" for h in range(24)) + "]"
block("days_events", "", """
SELECT user_id AS store_id, CAST(ts AS DATE) AS dt, max(CAST(event_type = 'signup' AS INTEGER)) AS activity_flag,
       avg(CAST(event_type = 'click' AS DOUBLE)) AS precpt, count(*) AS n_events
FROM events GROUP BY ALL""")
block("wide_hours", "hours", f"SELECT store_id, dt, {_HOURS} FROM hours GROUP BY store_id, dt")
block("hpanel", "wide_hours days_events", f"""
SELECT store_id, CAST(0 AS BIGINT) AS product_id, dt, {S_LIST} AS sales, {O_LIST} AS oos, store_id % 2 AS city_id,
       store_id % 7 AS management_group_id, store_id % 3 AS first_category_id, store_id % 4 AS second_category_id,
       store_id % 5 AS third_category_id, activity_flag, precpt,
       CASE WHEN activity_flag = 1 THEN 0.9 ELSE 1.0 END AS discount, CAST(isodow(dt) >= 6 AS INTEGER) AS holiday_flag,
       20.0 + day(dt) / 10.0 AS avg_temperature, 50.0 + n_events AS avg_humidity, 1.0 AS avg_wind_level,
       CAST(dt - (SELECT min(dt) FROM wide_hours) AS INTEGER) AS day,
       CASE WHEN dt <= (SELECT max(dt) FROM wide_hours) - 7 THEN 'train' ELSE 'eval' END AS split,
       list_sum({S_LIST}) AS observed, CAST(list_sum({O_LIST}[7:22]) AS INTEGER) AS empty
FROM wide_hours JOIN days_events USING (store_id, dt)""")
block("cut", "hpanel", "SELECT max(day) FILTER (split = 'train') AS cutoff FROM hpanel")
_SUMS = ", ".join(f"sum(sales[{h + 1}]) AS h{h}" for h in range(24))
_H_LIST = "[" + ", ".join(f"h{h}" for h in range(24)) + "]"
block("fit_rows", "hpanel cut", "SELECT * FROM hpanel, cut WHERE empty = 0 AND day <= cutoff")
_HELD = "CAST('0x' || substr(md5(store_id || ':' || product_id || ':7'), 1, 15) AS BIGINT) % 10000 < 2000"
block("unheld_rows", "fit_rows", f"SELECT * FROM fit_rows WHERE NOT {_HELD}")
for _of, _rows in (("prof", "fit_rows"), ("vprof", "unheld_rows")):  # vprof: without the series held out of the validation
    for _i, _level in enumerate(["store_id, product_id", "store_id, third_category_id", "third_category_id"]):
        block(f"{_of}{_i}", _rows, f"""
SELECT {_level}, list_transform({_H_LIST}, lambda x: x / list_sum({_H_LIST})) AS p{_i}
FROM (SELECT {_level}, count(*) AS n, {_SUMS} FROM {_rows} GROUP BY {_level})
WHERE n >= MIN_DAYS AND list_sum({_H_LIST}) > 0""")
    block(f"{_of}_all", _rows, f"""
SELECT list_transform({_H_LIST}, lambda x: x / list_sum({_H_LIST})) AS pa, mean_all
FROM (SELECT {_SUMS}, avg(observed) AS mean_all FROM {_rows})""")
block("series_stats", "fit_rows", """
SELECT store_id, product_id, sum(observed) AS s, count(*) AS c FROM fit_rows GROUP BY ALL""")
block("profiled", "hpanel cut prof0 prof1 prof2 prof_all series_stats", """
SELECT h.*, cutoff, coalesce(p0, p1, p2, pa) AS profile,
       CASE WHEN p0 IS NOT NULL THEN 1 WHEN p1 IS NOT NULL THEN 2 WHEN p2 IS NOT NULL THEN 3 ELSE 4 END AS profile_level,
       CASE WHEN coalesce(c, 0) - CAST(empty = 0 AND day <= cutoff AS INTEGER) > 0
            THEN (s - CASE WHEN empty = 0 AND day <= cutoff THEN observed ELSE 0 END)
                 / (c - CAST(empty = 0 AND day <= cutoff AS INTEGER)) ELSE mean_all END AS level
FROM hpanel h CROSS JOIN cut LEFT JOIN prof0 USING (store_id, product_id)
     LEFT JOIN prof1 USING (store_id, third_category_id) LEFT JOIN prof2 USING (third_category_id)
     LEFT JOIN series_stats USING (store_id, product_id) CROSS JOIN prof_all""")
block("shared", "profiled", """
SELECT *, list_sum(list_transform(range(1, 25), lambda i: profile[i] * (1 - oos[i]))) AS share_in,
       CASE WHEN list_position(oos[7:22], 1) IS NULL THEN -1 ELSE CAST(list_position(oos[7:22], 1) AS INTEGER) + 5 END AS first_oos_hour,
       CASE WHEN list_position(oos[7:22], 1) IS NULL THEN -1
            ELSE 23 - CAST(list_position(list_reverse(oos[7:22]), 1) AS INTEGER) END AS last_oos_hour
FROM profiled""")
block("recovered", "shared", """
SELECT *, greatest(observed, CASE WHEN empty = 0 THEN observed WHEN share_in >= 0.15 THEN observed / share_in ELSE level END)
          AS rec_profile
FROM shared""")
block("rtable", "recovered", """
SELECT store_id, product_id, dt, day, first_category_id, third_category_id, empty AS oos_hours, first_oos_hour, observed,
       rec_profile
FROM recovered WHERE day <= cutoff""")
block("series_means", "recovered", """
SELECT store_id, product_id, CAST(sum(CAST(observed AS DECIMAL(28, 9))) FILTER (day <= cutoff) AS DOUBLE)
       / nullif(count(*) FILTER (day <= cutoff), 0) AS series_mean
FROM recovered GROUP BY ALL""")
block("grouped", "recovered series_means", """
SELECT r.*, series_mean, CASE WHEN series_mean >= middle THEN 'high-sale' ELSE 'low-sale' END AS sale_group
FROM recovered r JOIN series_means USING (store_id, product_id)
     CROSS JOIN (SELECT median(series_mean) AS middle FROM recovered JOIN series_means USING (store_id, product_id))""")
block("store_sample", "hpanel", """
SELECT k.store_id, k.product_id FROM (SELECT DISTINCT store_id, product_id FROM hpanel) k JOIN (
  SELECT store_id, coalesce(sum(n) OVER (ORDER BY h, store_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT store_id, count(*) AS n, CAST('0x' || substr(md5(store_id || ':42'), 1, 15) AS BIGINT) AS h
        FROM (SELECT DISTINCT store_id, product_id FROM hpanel) GROUP BY store_id)) s ON s.store_id = k.store_id
WHERE before < 40""")
block("vmasked", "hpanel cut fit_rows prof_all vprof0 vprof1 vprof2 vprof_all series_stats", f"""
SELECT observed AS truth, list_sum(list_transform(range(1, 25), lambda i: sales[i] * (1 - mask[i]))) AS visible,
       list_sum(list_transform(range(1, 25), lambda i: profile[i] * (1 - mask[i]))) AS share_in, level
FROM (SELECT t.*, d.mask, coalesce(p0, p1, p2, vprof_all.pa) AS profile,
             CASE WHEN c > 1 THEN (s - observed) / (c - 1) ELSE prof_all.mean_all END AS level
      FROM (SELECT *, CAST('0x' || substr(md5(store_id || ':' || product_id || ':' || dt || ':9'), 1, 15) AS BIGINT)
                      % (SELECT count(*) FROM hpanel, cut WHERE empty > 0 AND day <= cutoff) AS slot
            FROM fit_rows WHERE {_HELD}) t
           JOIN (SELECT oos AS mask, row_number() OVER (ORDER BY CAST('0x' || substr(md5(store_id || ':' || product_id || ':' || dt || ':8'), 1, 15) AS BIGINT)) - 1 AS slot
                 FROM hpanel, cut WHERE empty > 0 AND day <= cutoff) d USING (slot)
           LEFT JOIN vprof0 USING (store_id, product_id) LEFT JOIN vprof1 USING (store_id, third_category_id)
           LEFT JOIN vprof2 USING (third_category_id) LEFT JOIN series_stats USING (store_id, product_id) CROSS JOIN prof_all CROSS JOIN vprof_all)""")
block("vmethods", "vmasked", """
SELECT truth AS y, visible, 'observed (no recovery)' AS method, visible AS f FROM vmasked
UNION ALL SELECT truth, visible, 'profile scaling', greatest(visible, CASE WHEN share_in >= 0.15 THEN visible / share_in ELSE level END) FROM vmasked""")
_HW = "PARTITION BY store_id, product_id ORDER BY day"
block("hframe", "grouped", f"""
SELECT *, lag_7 AS pred, avg(lag_7) OVER ({_HW} ROWS 6 PRECEDING) AS rmean_7, avg(lag_7) OVER ({_HW} ROWS 13 PRECEDING) AS rmean_14,
       avg(lag_7) OVER ({_HW} ROWS 27 PRECEDING) AS rmean_28, stddev_samp(lag_7) OVER ({_HW} ROWS 13 PRECEDING) AS rstd_14,
       avg(oos_lag) OVER ({_HW} ROWS 13 PRECEDING) / 16 AS oos_rate_14,
       CASE WHEN lag_7 IS NULL AND lag_14 IS NULL THEN NULL ELSE
         (coalesce(lag_7, 0) + coalesce(lag_14, 0)) / (CAST(lag_7 IS NOT NULL AS INTEGER) + CAST(lag_14 IS NOT NULL AS INTEGER)) END AS dow_mean
FROM (SELECT *, lag(y, 7) OVER ({_HW}) AS lag_7, lag(y, 14) OVER ({_HW}) AS lag_14, lag(empty, 7) OVER ({_HW}) AS oos_lag
      FROM (SELECT *, CASE WHEN day > cutoff THEN observed ELSE rec_profile END AS y FROM grouped))""")
block("hpred", "hframe", """
SELECT t.target, t.training_target, h.*, greatest(observed, CASE WHEN empty = 0 THEN observed ELSE level END) AS level_truth, CASE WHEN t.target = 'observed' THEN rmean_7 ELSE dow_mean END AS p,
       CASE WHEN t.target = 'observed' THEN observed ELSE rec_profile END AS own_truth
FROM hframe h CROSS JOIN (VALUES ('observed', 'sold'), ('rec_profile', 'by_profile'))
     t(target, training_target)
WHERE day > cutoff AND day <= cutoff + 7""")
block("hpred_before", "hframe", """
SELECT t.target, CASE WHEN t.target = 'observed' THEN rmean_7 ELSE dow_mean END AS p,
       CASE WHEN t.target = 'observed' THEN observed ELSE rec_profile END AS own_truth
FROM hframe h CROSS JOIN (VALUES ('observed'), ('rec_profile')) t(target) WHERE day > cutoff - 7 AND day <= cutoff""")
block("hratio", "hpred_before", """
SELECT target, sum(own_truth) / greatest(sum(p), 1e-9) AS multiplier FROM hpred_before GROUP BY target""")
block("hvariants", "hpred hratio", """
SELECT * FROM (SELECT * REPLACE (p AS p) FROM hpred
UNION ALL SELECT h.* REPLACE (h.p * r.multiplier AS p, h.training_target || ' x ratio' AS training_target)
FROM hpred h JOIN hratio r USING (target))""")
block("hviews", "hvariants", """
SELECT training_target, v.eval_view, v.truth AS y, p AS f FROM hvariants, LATERAL (VALUES
  (CASE WHEN empty = 0 THEN 'A.in_stock' END, observed),
  ('B.sold', observed),
  ('C.recovered', level_truth),
  ('C2.profile', rec_profile),
  (CASE WHEN empty = 0 THEN 'A, ' || sale_group || ' series' END, observed),
  ('C, ' || sale_group || ' series', level_truth)) v(eval_view, truth)
WHERE v.eval_view IS NOT NULL""")
for _n in ("prof0", "prof1", "prof2", "vprof0", "vprof1", "vprof2"):
    BLOCKS[_n] = (BLOCKS[_n][0], BLOCKS[_n][1].replace("MIN_DAYS", "20"))
