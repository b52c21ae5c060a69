"""DuckDB SQL for each registered key: the same answer computed straight from
the driver tables (views ``events``, ``orders``, ``lineitem`` ...). The
derivation rules of :mod:`pricelab.plans.fixtures` are restated here in SQL.
"""

from __future__ import annotations

# Fixed values shared with fixtures.py (restated in SQL below):
# gaps value%17, event_type%13, user_id%31; spoiled times o_orderkey%19;
# no rain %3, no temperature %29, no generation %7, empty carbon %5,
# short start list %9, empty load document %10; predictors 1500 / 1400.

EVENTS_GAPS = """
  SELECT event_id, ts,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
         props
  FROM events"""

ORDERS_CLEAN = """
  WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
  SELECT o.* FROM orders o, b
  WHERE o.o_totalprice >= b.q1 - 1.5 * (b.q3 - b.q1) AND o.o_totalprice <= b.q3 + 1.5 * (b.q3 - b.q1)"""

EVENTS_SPLIT = """
  SELECT *, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split,
         CASE WHEN pos < floor(n * 0.8) THEN pos ELSE pos - CAST(floor(n * 0.8) AS BIGINT) END AS split_pos,
         CAST(CASE WHEN pos < floor(n * 0.8) THEN floor(n * 0.8) ELSE n - floor(n * 0.8) END AS BIGINT) AS split_n
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events)"""

PRED_LONG = """
  WITH p AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS pos,
                    count(*) OVER () AS n FROM lineitem),
  s AS (SELECT *, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split,
               CASE WHEN pos < floor(n * 0.8) THEN pos ELSE pos - CAST(floor(n * 0.8) AS BIGINT) END AS split_pos FROM p)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate AS ts, split, split_pos,
         l_extendedprice AS actual, 'tree' AS model, l_quantity * 1500.0 AS predicted FROM s
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate AS ts, split, split_pos,
         l_extendedprice AS actual, 'sequence' AS model, l_quantity * 1400.0 AS predicted FROM s
  WHERE split_pos >= 24"""

METRICS = f"""
  SELECT model, split, count(*) AS n,
         sqrt(sum((actual - predicted) ^ 2) / count(*)) AS rmse,
         avg(abs(actual - predicted)) AS mae,
         sum((actual - predicted) ^ 2) / count(*) AS mse,
         CASE WHEN var_pop(actual) * count(*) > 0 THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*))
              WHEN sum((actual - predicted) ^ 2) = 0 THEN 1.0 ELSE 0.0 END AS r2
  FROM ({PRED_LONG}) GROUP BY model, split"""

METRIC_LONG = f"""
  SELECT CASE WHEN split = 'train' THEN 'Training ' ELSE 'Testing ' END ||
         CASE m WHEN 'rmse' THEN 'RMSE' WHEN 'mae' THEN 'MAE' ELSE 'R²' END AS metric,
         model, round(v, 4) AS value
  FROM (SELECT model, split, 'rmse' AS m, rmse AS v FROM ({METRICS})
        UNION ALL SELECT model, split, 'mae', mae FROM ({METRICS})
        UNION ALL SELECT model, split, 'r2', r2 FROM ({METRICS}))"""

WEATHER = """
  SELECT event_id AS doc_id, ts AS observed_at,
         CASE WHEN event_id % 29 <> 0 THEN value / 4 - 5 END AS temperature,
         value / 10 AS wind_speed,
         CAST((event_id * 7) % 101 AS DOUBLE) AS cloud_cover,
         CAST(user_id % 100 AS DOUBLE) AS humidity,
         CASE WHEN event_id % 3 <> 0 THEN value / 100 ELSE 0.0 END AS precipitation,
         1000.0 * (1 - CAST((event_id * 7) % 101 AS DOUBLE) / 100.0) * 100.0 * 0.2 / 1000.0 AS solar_estimate_kw
  FROM events"""

SOLAR_TOTAL = """
  SELECT CAST(ts AS DATE) AS settlement_date,
         CAST(trunc(coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(value AS DECIMAL(38, 6)) END),
                             CAST(0 AS DECIMAL(38, 6)))) AS BIGINT) AS solar_generation
  FROM events
  WHERE hour(ts) * 2 + CAST(floor(minute(ts) / 30) AS INTEGER) + 1 BETWEEN 3 AND 47
  GROUP BY 1"""

LOAD_ROWS = """
  SELECT event_id AS doc_id, CAST(i AS BIGINT) AS pos,
         CASE WHEN event_id % 9 = 0 AND i = event_id % 4 THEN NULL
              ELSE date_trunc('second', ts) + to_minutes(CAST(i * 15 AS BIGINT)) END AS load_ts,
         round(value + i, 6) AS grid_demand_mw
  FROM (SELECT *, unnest(range(0, 1 + event_id % 4)) AS i FROM events)
  WHERE event_id % 10 <> 0"""

BAD_LIST = "(event_id % 11 = 0 OR event_id % 23 = 0 OR event_id % 37 = 0)"

ORACLE_SQL: dict[str, str] = {
    "gbt_forecast": f"""
      SELECT event_id, split, value AS actual, TRUE AS scored, TRUE AS fits_train FROM ({EVENTS_SPLIT})""",
    "sequence_forecast": f"""
      SELECT event_id, split, value AS actual, TRUE AS scored, TRUE AS fits_train FROM ({EVENTS_SPLIT}) WHERE split_pos >= 24""",
    "training_curve": "SELECT CAST(unnest(range(1, 101)) AS INTEGER) AS iteration, TRUE AS has_loss",
    "feature_importance": """
      SELECT feature, TRUE AS not_negative, TRUE AS shares_sum_to_one FROM (
        SELECT unnest(['user_id', 'hour_of_day', 'day_of_week', 'month', 'is_weekend', 'value_lag1', 'value_lag2', 'value_lag3']) AS feature
        UNION ALL SELECT DISTINCT 'event_type_' || event_type FROM events WHERE event_type IS NOT NULL)""",
    "score_features": f"""
      SELECT event_id, CASE WHEN {BAD_LIST} THEN 'rejected' ELSE 'scored' END AS status, NOT {BAD_LIST} AS has_prediction
      FROM events""",
    "model_roundtrip": f"""
      WITH s AS (SELECT event_id, split, split_pos, {BAD_LIST} AS bad FROM ({EVENTS_SPLIT})),
      w AS (SELECT *, count(*) FILTER (WHERE bad) OVER (PARTITION BY split ORDER BY split_pos
                   ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n_bad FROM s)
      SELECT event_id, 'tree' AS model, CASE WHEN bad THEN 'rejected' ELSE 'scored' END AS status,
             CASE WHEN NOT bad THEN TRUE END AS as_fitted FROM s
      UNION ALL SELECT event_id, 'sequence', CASE WHEN n_bad > 0 THEN 'rejected' ELSE 'scored' END,
             CASE WHEN n_bad = 0 THEN TRUE END FROM w WHERE split_pos >= 24""",
    "forecast_run": f"""
      SELECT s || ' ' || m AS metric, model, TRUE AS has_value,
             (SELECT count(*) FROM ({EVENTS_SPLIT}) WHERE split = 'test') AS aligned_rows, TRUE AS models_load
      FROM (SELECT unnest(['Training', 'Testing']) AS s), (SELECT unnest(['RMSE', 'MAE', 'R²']) AS m),
           (SELECT unnest(['tree', 'sequence']) AS model)""",
    "latest_file_scan": f"SELECT * FROM ({PRED_LONG}) WHERE model = 'tree'",
    "stream_weather": f"""
      SELECT observed_at AS timestamp, w.doc_id, w.temperature, w.wind_speed, w.humidity, w.cloud_cover AS cloud_coverage,
             coalesce(s.solar_generation, 0) AS solar_generation
      FROM ({WEATHER}) w LEFT JOIN ({SOLAR_TOTAL}) s ON CAST(w.observed_at AS DATE) = s.settlement_date
      WHERE w.temperature IS NOT NULL""",
    "stream_prices": "SELECT ts AS timestamp, value AS price, value / 100 AS volatility FROM events",
    "monthly_profile": f"""
      SELECT CAST(month(o_orderdate) AS INTEGER) AS month, round(sum(o_totalprice), 2) / count(o_totalprice) AS avg_price,
             count(o_totalprice) AS n
      FROM ({ORDERS_CLEAN}) GROUP BY 1""",
    "scan_prices": "SELECT * FROM orders",
    "union_prices": "SELECT * FROM orders",
    "clean_names": """
      SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS o_total_price, o_orderdate, o_orderpriority
      FROM orders""",
    "parse_times": """
      SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders""",
    "calendar_features": """
      WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS ts FROM orders)
      SELECT o_orderkey, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
             CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour_of_day,
             CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend
      FROM t""",
    "clean_run": f"""
      WITH g AS (
        SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) ELSE ts END AS seen_at,
               user_id, event_type,
               CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 41 = 0 THEN value * 100 ELSE value END AS value
        FROM ({EVENTS_GAPS})),
      m AS (SELECT median(user_id) AS mu, median(value) AS mv FROM g),
      mo AS (SELECT event_type AS me FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1),
      x AS (SELECT event_id, seen_at, coalesce(CAST(user_id AS DOUBLE), mu) AS user_id, coalesce(event_type, me) AS event_type,
                   coalesce(value, mv) AS value FROM g, m, mo),
      b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM x)
      SELECT event_id, seen_at, user_id, event_type, round(value, 6) AS value, CAST(isodow(seen_at) - 1 AS INTEGER) AS day_of_week,
             CAST(month(seen_at) AS INTEGER) AS month, CAST(hour(seen_at) AS INTEGER) AS hour_of_day,
             (SELECT count(*) FROM events WHERE event_id % 19 = 0) AS unparsed_times
      FROM x, b WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""",
    "clean_store": f"""
      SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
      FROM ({ORDERS_CLEAN})""",
    "clean_published": f"""
      SELECT version, o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
      FROM ({ORDERS_CLEAN}), (SELECT unnest([1, 2])::INTEGER AS version) WHERE version = 2 OR o_orderkey % 2 = 0""",
    "metric_store": f"""
      SELECT run_id, metric, model, value FROM ({METRIC_LONG}), (SELECT unnest(['first', 'second']) AS run_id)""",
    "null_profile": f"""
      WITH g AS ({EVENTS_GAPS})
      SELECT * FROM (
        SELECT 'event_id' AS column_name, 'bigint' AS dtype, count(*) - count(event_id) AS null_count, count(*) AS n_rows FROM g
        UNION ALL SELECT 'ts', 'timestamp_ntz', count(*) - count(ts), count(*) FROM g
        UNION ALL SELECT 'user_id', 'bigint', count(*) - count(user_id), count(*) FROM g
        UNION ALL SELECT 'event_type', 'string', count(*) - count(event_type), count(*) FROM g
        UNION ALL SELECT 'value', 'double', count(*) FILTER (WHERE value IS NULL OR isnan(value)), count(*) FROM g
        UNION ALL SELECT 'props', 'string', count(*) - count(props), count(*) FROM g)
      WHERE null_count > 0""",
    "impute_median": f"""
      WITH g AS ({EVENTS_GAPS}), m AS (SELECT median(user_id) AS mu, median(value) AS mv FROM g)
      SELECT event_id, coalesce(CAST(user_id AS DOUBLE), mu) AS user_id, round(coalesce(value, mv), 6) AS value
      FROM g, m""",
    "impute_mode": f"""
      WITH g AS ({EVENTS_GAPS}),
      c AS (SELECT event_type, count(*) AS n FROM g WHERE event_type IS NOT NULL GROUP BY 1),
      m AS (SELECT event_type AS mode FROM c ORDER BY n DESC, event_type ASC LIMIT 1)
      SELECT event_id, coalesce(g.event_type, (SELECT mode FROM m), 'unknown') AS event_type FROM g""",
    "iqr_bounds": """
      WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
      SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
             round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM b""",
    "iqr_filter": """
      WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
      SELECT e.* FROM events e, b
      WHERE e.value >= b.q1 - 1.5 * (b.q3 - b.q1) AND e.value <= b.q3 + 1.5 * (b.q3 - b.q1)""",
    "outlier_report": """
      WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
      c AS (SELECT count(*) AS before,
                   count(*) FILTER (WHERE e.value >= b.q1 - 1.5 * (b.q3 - b.q1) AND e.value <= b.q3 + 1.5 * (b.q3 - b.q1)) AS after
            FROM events e, b)
      SELECT before, after, before - after AS removed, round((before - after) / before, 6) AS removed_share FROM c""",
    "one_hot": f"""
      WITH g AS ({EVENTS_GAPS})
      SELECT event_id,
             CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS event_type_click,
             CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_error,
             CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase,
             CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS event_type_signup,
             CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view
      FROM g""",
    "price_histogram": """
      WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi,
                        quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
      w AS (SELECT *, 2.0 * (q3 - q1) * pow(CAST(n AS DOUBLE), -1.0 / 3.0) AS fd,
                   (hi - lo) / (log2(CAST(n AS DOUBLE)) + 1.0) AS sturges FROM s),
      k AS (SELECT lo, hi, CASE WHEN hi - lo > 0 THEN CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END) AS BIGINT)
                                ELSE 1 END AS nb FROM w),
      x AS (SELECT lo, nb, (hi - lo) / nb AS bw FROM k),
      b AS (SELECT least(CAST(CASE WHEN bw > 0 THEN floor((value - lo) / bw) ELSE 0 END AS BIGINT), nb - 1) AS bin, lo, bw
            FROM events, x WHERE value IS NOT NULL)
      SELECT bin, round(lo + bin * bw, 6) AS bin_start, round(lo + (bin + 1) * bw, 6) AS bin_end, count(*) AS count
      FROM b GROUP BY bin, lo, bw""",
    "weekday_profile": f"""
      SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
             ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(o_orderdate)] AS day_name,
             round(sum(o_totalprice), 2) / count(o_totalprice) AS avg_price, count(o_totalprice) AS n
      FROM ({ORDERS_CLEAN}) GROUP BY 1, 2""",
    "price_series": f"""
      SELECT date_trunc('month', o_orderdate) AS bucket_start, count(o_totalprice) AS n,
             round(sum(o_totalprice), 2) / count(o_totalprice) AS avg_price, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price
      FROM ({ORDERS_CLEAN}) WHERE o_orderdate IS NOT NULL GROUP BY 1""",
    "row_position": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events",
    "chronological_split": f"SELECT event_id, pos, split FROM ({EVENTS_SPLIT})",
    "split_labels": f"SELECT event_id, split, split_pos >= 24 AS preceded FROM ({EVENTS_SPLIT})",
    "one_hot_wide": """
      WITH c AS (SELECT customer, CAST(row_number() OVER (ORDER BY customer) - 1 AS INTEGER) AS slot, count(*) OVER () AS n
                 FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS customer FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey IS NOT NULL))
      SELECT o_orderkey, CAST(coalesce(slot, (SELECT count(*) FROM c)) AS INTEGER) AS slot, CAST(1 AS DOUBLE) AS value
      FROM orders LEFT JOIN c ON c.customer = CAST(o_custkey AS VARCHAR)""",
    "gain_importance": """
      SELECT unnest(['user_id', 'hour_of_day', 'day_of_week', 'month', 'is_weekend', 'value_lag1', 'value_lag2', 'value_lag3']
                    || (SELECT list('event_type_' || t) FROM (SELECT DISTINCT coalesce(event_type, 'unknown') AS t FROM events))) AS feature,
             TRUE AS consistent, TRUE AS falling""",
    "score_raw": """
      WITH r AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE ts END AS ts FROM events),
      p AS (SELECT event_id, CASE WHEN ts IS NOT NULL THEN row_number() OVER (PARTITION BY ts IS NULL ORDER BY ts, event_id) END AS pos FROM r)
      SELECT event_id, CASE WHEN pos IS NULL THEN 'rejected' ELSE 'scored' END AS tree_status,
             CASE WHEN pos IS NULL THEN 'rejected' WHEN pos > 24 THEN 'scored' ELSE 'short' END AS sequence_status,
             pos IS NOT NULL AS has_tree, coalesce(pos > 24, FALSE) AS has_sequence, TRUE AS as_fitted FROM p""",
    "stream_scores": """
      WITH r AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE ts END AS ts,
                        CASE WHEN event_id % 7 = 0 THEN 'not seen' WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS kind FROM events),
      p AS (SELECT event_id, CASE WHEN ts IS NOT NULL THEN row_number() OVER (PARTITION BY ts IS NULL, kind ORDER BY ts, event_id) END AS pos FROM r)
      SELECT event_id, CASE WHEN pos IS NULL THEN 'rejected' ELSE 'scored' END AS tree_status,
             CASE WHEN pos IS NULL THEN 'rejected' WHEN pos > 24 THEN 'scored' ELSE 'short' END AS sequence_status,
             pos IS NOT NULL AS has_tree, coalesce(pos > 24, FALSE) AS has_sequence, TRUE AS as_batch FROM p""",
    "hash_split": """
      SELECT event_id, CASE WHEN ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT < round(0.8 * 4294967296)
                            THEN 'train' ELSE 'test' END AS split FROM events""",
    "validation_split": f"""
      SELECT event_id, CASE WHEN split = 'test' THEN 'test'
                            WHEN split_pos < floor(split_n * 0.8) THEN 'fit' ELSE 'validation' END AS split
      FROM ({EVENTS_SPLIT})""",
    "sequence_windows": f"""
      WITH w AS (
        SELECT event_id, split, value AS target,
               count(*) OVER win AS seq_len, first(value) OVER win AS first_value,
               last(value) OVER win AS last_value, sum(value) OVER win AS sum_value,
               sum(CAST(user_id AS DOUBLE)) OVER win AS sum_user
        FROM ({EVENTS_SPLIT})
        WINDOW win AS (PARTITION BY split ORDER BY split_pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
      SELECT event_id, split, target, CAST(seq_len AS INTEGER) AS seq_len, first_value, last_value,
             round(sum_value, 6) AS sum_value, round(sum_user, 6) AS sum_user
      FROM w WHERE seq_len = 24""",
    "lag_features": """
      SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
             lag(value, 3) OVER w AS value_lag3
      FROM events WINDOW w AS (ORDER BY ts, event_id)""",
    "standard_scale": f"""
      WITH s AS ({EVENTS_SPLIT}),
      f AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(CAST(user_id AS DOUBLE)) AS mu,
                   stddev_pop(CAST(user_id AS DOUBLE)) AS su FROM s WHERE split = 'train')
      SELECT event_id, split,
             round((value - mv) / CASE WHEN sv = 0 THEN 1.0 ELSE sv END, 6) AS value_scaled,
             round((user_id - mu) / CASE WHEN su = 0 THEN 1.0 ELSE su END, 6) AS user_id_scaled
      FROM s, f""",
    "tumbling_15m": """
      SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start,
             time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end,
             count(value) AS n, round(avg(value), 6) AS avg_value
      FROM events GROUP BY 1""",
    "prediction_errors": f"""
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, model, round(actual - predicted, 4) AS error
      FROM ({PRED_LONG})""",
    "stored_predictions": f"""
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, model, round(actual - predicted, 4) AS error
      FROM ({PRED_LONG})""",
    "union_chunks": """
      SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "regression_metrics": f"""
      SELECT model, split, n, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mse, 0) AS mse, round(r2, 6) AS r2
      FROM ({METRICS})""",
    "metric_table": f"""
      SELECT metric, max(CASE WHEN model = 'tree' THEN value END) AS tree,
             max(CASE WHEN model = 'sequence' THEN value END) AS sequence
      FROM ({METRIC_LONG}) GROUP BY metric""",
    "metric_long": f"SELECT metric, model, value FROM ({METRIC_LONG})",
    "model_winner": f"""
      WITH t AS (SELECT max(CASE WHEN model = 'tree' THEN rmse END) AS a,
                        max(CASE WHEN model = 'sequence' THEN rmse END) AS b
                 FROM ({METRICS}) WHERE split = 'test')
      SELECT CASE WHEN a < b THEN 'tree' WHEN b < a THEN 'sequence' ELSE 'similar' END AS winner,
             round(a, 4) AS tree_test_rmse, round(b, 4) AS sequence_test_rmse FROM t""",
    "prediction_series": f"""
      WITH p AS ({PRED_LONG}),
      u AS (SELECT ts, 'actual' AS series, actual AS value FROM p WHERE model = 'tree'
            UNION ALL SELECT ts, model, predicted FROM p)
      SELECT date_trunc('month', ts) AS bucket_start, series, round(sum(value), 2) / count(*) AS avg_value, count(*) AS n
      FROM u GROUP BY 1, 2""",
    "error_density": f"""
      WITH e AS (SELECT model, actual - predicted AS x FROM ({PRED_LONG})),
      st AS (SELECT model, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd FROM e GROUP BY model),
      st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, sd * pow(CAST(n AS DOUBLE), -0.2) / 16.0 AS bin_w FROM st),
      b AS (SELECT e.model, CAST(CASE WHEN bin_w > 0 THEN floor((x - lo) / bin_w) ELSE 0 END AS BIGINT) AS b,
                   count(*) AS w FROM e JOIN st2 USING (model) GROUP BY 1, 2),
      c AS (SELECT b.model, w, n, bw, lo, hi, lo + (b + 0.5) * bin_w AS c FROM b JOIN st2 USING (model)),
      g AS (SELECT c.*, gi AS grid_i, (lo - 3.0 * bw) + gi * ((hi - lo + 6.0 * bw) / 199.0) AS gx
            FROM c, range(0, 200) r(gi))
      SELECT model, grid_i, round(any_value(gx), 6) AS x,
             round(sum(w * exp(-0.5 * ((gx - c) / bw) * ((gx - c) / bw))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 12) AS density
      FROM g GROUP BY model, grid_i""",
    "residual_bins": f"""
      WITH r AS (SELECT model, predicted AS p, actual - predicted AS e FROM ({PRED_LONG})),
      st AS (SELECT model, min(p) AS p_lo, max(p) AS p_hi, min(e) AS e_lo, max(e) AS e_hi FROM r GROUP BY model),
      j AS (SELECT r.*, (p_hi - p_lo) / 50.0 AS pw, (e_hi - e_lo) / 50.0 AS ew, p_lo, e_lo FROM r JOIN st USING (model)),
      b AS (SELECT model, pw, ew, p_lo, e_lo,
                   least(CAST(CASE WHEN pw > 0 THEN floor((p - p_lo) / pw) ELSE 0 END AS BIGINT), 49) AS pred_bin,
                   least(CAST(CASE WHEN ew > 0 THEN floor((e - e_lo) / ew) ELSE 0 END AS BIGINT), 49) AS resid_bin
            FROM j)
      SELECT model, pred_bin, resid_bin, count(*) AS n,
             round(p_lo + (pred_bin + 0.5) * pw, 4) AS pred_centre, round(e_lo + (resid_bin + 0.5) * ew, 4) AS resid_centre
      FROM b GROUP BY model, pred_bin, resid_bin, pw, ew, p_lo, e_lo""",
    "recent_predictions": f"""
      SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ts, actual, predicted
      FROM ({PRED_LONG}) WHERE model = 'tree'
      ORDER BY ts DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC LIMIT 20""",
    "aligned_predictions": f"""
      WITH p AS ({PRED_LONG}),
      a AS (SELECT * FROM p WHERE model = 'tree' AND split = 'test'),
      s AS (SELECT * FROM p WHERE model = 'sequence' AND split = 'test')
      SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.ts, a.actual,
             a.predicted AS tree_predicted, s.predicted AS sequence_predicted,
             round(a.actual - a.predicted, 4) AS tree_error, round(a.actual - s.predicted, 4) AS sequence_error
      FROM a LEFT JOIN s USING (l_orderkey, l_partkey, l_suppkey, l_linenumber)""",
    "weather_flatten": f"""
      SELECT doc_id, round(temperature, 6) AS temperature, round(wind_speed, 6) AS wind_speed,
             round(cloud_cover, 6) AS cloud_cover, round(humidity, 6) AS humidity,
             round(precipitation, 6) AS precipitation, round(solar_estimate_kw, 6) AS solar_estimate_kw
      FROM ({WEATHER})""",
    "solar_estimate": f"SELECT doc_id, cloud_cover, round(solar_estimate_kw, 6) AS solar_kw FROM ({WEATHER})",
    "solar_total": SOLAR_TOTAL,
    "weather_guard": f"""
      SELECT doc_id, CASE WHEN temperature IS NULL THEN 'rejected' ELSE 'accepted' END AS status,
             round(temperature, 6) AS temperature FROM ({WEATHER})""",
    "solar_total_table": SOLAR_TOTAL,
    "stream_dead_letters": f"""
      SELECT doc_id, CASE WHEN doc_id % 37 = 0 THEN 'malformed' WHEN temperature IS NULL THEN 'rejected' ELSE 'record' END AS status,
             TRUE AS failures_logged FROM ({WEATHER})""",
    "tumbling_stream": """
      WITH e AS (SELECT *, max(ts) OVER () - INTERVAL '1 hour' AS closed FROM events)
      SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start,
             time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end,
             count(value) AS n, round(avg(value), 6) AS avg_value
      FROM e GROUP BY 1, closed HAVING time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' <= closed""",
    "weather_record": f"""
      SELECT w.observed_at AS timestamp, w.doc_id, round(w.temperature, 6) AS temperature,
             round(w.wind_speed, 6) AS wind_speed, w.humidity, w.cloud_cover AS cloud_coverage, s.solar_generation
      FROM ({WEATHER}) w LEFT JOIN ({SOLAR_TOTAL}) s ON CAST(w.observed_at AS DATE) = s.settlement_date
      WHERE w.temperature IS NOT NULL""",
    "carbon_intensity": """
      SELECT event_id AS doc_id,
             CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS DOUBLE) END AS carbon_intensity,
             CASE WHEN event_id % 5 <> 0 THEN CAST(user_id + event_id % 10 AS DOUBLE) END AS forecast,
             CASE WHEN event_id % 5 <> 0 THEN
                  CASE WHEN value < 30 THEN 'low' WHEN value < 70 THEN 'moderate' ELSE 'high' END END AS status
      FROM events""",
    "grid_load_xml": LOAD_ROWS,
    "grid_load_latest": f"""
      SELECT doc_id, load_ts, grid_demand_mw FROM ({LOAD_ROWS}) WHERE pos = doc_id % 4""",
}
