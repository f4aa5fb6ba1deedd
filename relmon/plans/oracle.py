"""DuckDB SQL twins of the registered queries (same names, same columns).

These are written independently of the Spark code, relationally, over the
same parquet tables (views: orders, events, ...).  Every computed column is
cast to the type the Spark side produces so that value hashes agree.
"""

from __future__ import annotations

# z in double, 0 when sd is 0; used by several twins
_Z = "CASE WHEN CAST({sd} AS DOUBLE) = 0 THEN 0.0 ELSE ({v} - CAST({m} AS DOUBLE)) / CAST({sd} AS DOUBLE) END"
_BAND = ("CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) < 2.0 THEN 'normal' WHEN abs({z}) < 3.0 THEN 'moderate' "
         "ELSE 'critical' END")
_ORDERS_30D = ("o_orderdate >= TIMESTAMP '2001-07-03 00:00:00' AND o_orderdate < TIMESTAMP '2001-08-02 00:00:00'")
_EVENTS_24H = "ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'"

SQL: dict[str, str] = {}

SQL["daily_row_counts"] = f"""
SELECT 'daily_row_count' AS metric_name, CAST(o_orderdate AS DATE) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value
FROM orders WHERE {_ORDERS_30D} GROUP BY 2
"""

SQL["hourly_ingestion"] = f"""
SELECT 'hourly_ingestion_rate' AS metric_name, date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value
FROM events WHERE {_EVENTS_24H} GROUP BY 2
"""

SQL["daily_business_metrics"] = f"""
SELECT CAST(o_orderdate AS DATE) AS order_date, COUNT(*) AS daily_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS daily_revenue,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS avg_order_value
FROM orders WHERE {_ORDERS_30D} GROUP BY 1
"""

_BASELINES = f"""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM orders
           WHERE {_ORDERS_30D} GROUP BY 1),
     h AS (SELECT date_trunc('hour', ts) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM events
           WHERE {_EVENTS_24H} GROUP BY 1)
SELECT 'daily_row_count' AS metric_name, 'batch_analytics_db' AS source_database, 'orders' AS table_name,
       CAST(AVG(v) AS DECIMAL(15,4)) AS mean_value, CAST(COALESCE(STDDEV_SAMP(v), 0.0) AS DECIMAL(15,4)) AS std_deviation,
       CAST(COUNT(*) AS INTEGER) AS sample_size, TIMESTAMP '2001-08-02 00:00:00' AS calculation_timestamp FROM d
UNION ALL
SELECT 'hourly_ingestion_rate', 'cdc_history_db', 'events',
       CAST(AVG(v) AS DECIMAL(15,4)), CAST(COALESCE(STDDEV_SAMP(v), 0.0) AS DECIMAL(15,4)),
       CAST(COUNT(*) AS INTEGER), TIMESTAMP '2024-01-31 00:00:00' FROM h
"""
SQL["baselines"] = _BASELINES

SQL["bucket_anomalies"] = f"""
WITH s AS (SELECT event_type, 'hourly_ingestion_rate' AS metric_name, date_trunc('hour', ts) AS bucket,
                  CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY event_type, date_trunc('hour', ts)),
     b AS (SELECT event_type, CAST(AVG(value) AS DECIMAL(15,4)) AS mean_value,
                  CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS std_deviation,
                  CAST(COUNT(*) AS INTEGER) AS sample_size FROM s GROUP BY 1),
     z AS (SELECT s.*, b.mean_value, b.std_deviation, b.sample_size,
                  {_Z.format(v='s.value', m='b.mean_value', sd='b.std_deviation')} AS z
           FROM s JOIN b USING (event_type))
SELECT event_type, metric_name, bucket, value, mean_value, std_deviation, sample_size,
       CAST(z AS DECIMAL(10,4)) AS signed_z, CAST(abs(z) AS DECIMAL(10,4)) AS z_score, abs(z) > 3.0 AS is_anomaly,
       {_BAND.format(z='z')} AS severity_band
FROM z
"""

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
_HOURLY_BY_TYPE = ("SELECT event_type, 'hourly_ingestion_rate' AS metric_name, date_trunc('hour', ts) AS bucket, "
                   "CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY event_type, date_trunc('hour', ts)")

_VOLUME_CTE = f"""
vcur AS (SELECT COUNT(*) AS current_count, MAX(ts) AS latest_timestamp FROM events
         WHERE ts >= TIMESTAMP '2024-01-30 23:00:00' AND ts <= {_AS_OF}),
vh AS (SELECT date_trunc('hour', ts) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM events WHERE {_EVENTS_24H} GROUP BY 1),
vbase AS (SELECT CAST(AVG(v) AS DECIMAL(15,4)) AS baseline_mean,
                 CAST(COALESCE(STDDEV_SAMP(v), 0.0) AS DECIMAL(15,4)) AS baseline_std,
                 CAST(COUNT(*) AS INTEGER) AS sample_size FROM vh HAVING COUNT(*) > 0),
vj AS (SELECT vcur.*, vbase.*, {_Z.format(v='vcur.current_count', m='vbase.baseline_mean', sd='vbase.baseline_std')} AS z,
              vbase.baseline_mean IS NOT NULL AND vcur.current_count > 0 AS evaluated
       FROM vcur LEFT JOIN vbase ON TRUE),
vol AS (SELECT 'events' AS source_table, 'hourly_ingestion_rate' AS metric_name, current_count, latest_timestamp,
        baseline_mean, baseline_std, sample_size,
        CASE WHEN evaluated THEN CAST(abs(z) AS DECIMAL(10,4)) END AS z_score,
        CASE WHEN evaluated THEN CAST(z AS DECIMAL(10,4)) END AS signed_z,
        CAST(CAST(baseline_mean AS DOUBLE) + 3.0 * CAST(baseline_std AS DOUBLE) AS DECIMAL(15,4)) AS threshold_value,
        CAST(CAST(baseline_mean AS DOUBLE) - 3.0 * CAST(baseline_std AS DOUBLE) AS DECIMAL(15,4)) AS expected_low,
        CAST(CAST(baseline_mean AS DOUBLE) + 3.0 * CAST(baseline_std AS DOUBLE) AS DECIMAL(15,4)) AS expected_high,
        CASE WHEN evaluated THEN CAST(CASE WHEN CAST(baseline_mean AS DOUBLE) = 0 THEN NULL
             ELSE (1.0 - CAST(current_count AS DOUBLE) / CAST(baseline_mean AS DOUBLE)) * 100.0 END AS DECIMAL(15,4)) END
             AS drop_pct,
        evaluated AND COALESCE(abs(z) > 3.0, false) AS is_anomaly,
        CASE WHEN evaluated THEN {_BAND.format(z='z')} END AS severity_band,
        CASE WHEN baseline_mean IS NULL THEN 'skipped_no_baseline' WHEN NOT evaluated THEN 'skipped_no_data'
             ELSE 'evaluated' END AS status
        FROM vj)
"""

_FRESH_CTE = f"""
fl AS (SELECT event_type, MAX(ts) AS latest_timestamp FROM events GROUP BY 1),
fm AS (SELECT *, CAST(date_diff('microsecond', latest_timestamp, {_AS_OF}) AS DOUBLE) / 6.0e7 AS mins FROM fl),
fresh AS (SELECT event_type, 'events' AS source_table, latest_timestamp, {_AS_OF} AS as_of,
          CAST(mins AS DECIMAL(15,4)) AS minutes_since_last, CAST(30.0 AS DECIMAL(15,4)) AS threshold_minutes,
          COALESCE(mins > 30.0, false) AS is_stale, CAST(mins / 30.0 AS DECIMAL(15,4)) AS staleness_factor,
          CASE WHEN mins IS NULL THEN NULL WHEN mins / 30.0 >= 3.0 THEN 'CRITICAL' WHEN mins / 30.0 >= 1.5 THEN 'HIGH'
               WHEN mins / 30.0 > 1.0 THEN 'MEDIUM' ELSE 'NONE' END AS impact_level,
          CASE WHEN latest_timestamp IS NULL THEN 'skipped_no_data' ELSE 'evaluated' END AS status,
          CASE WHEN latest_timestamp IS NOT NULL THEN 'Data flow stale: '
               || CAST(CAST(ROUND(CAST(mins AS DECIMAL(15,4)), 1) AS DECIMAL(28,1)) AS VARCHAR)
               || ' minutes since last record' END AS description
          FROM fm)
"""

SQL["volume_check"] = f"""
WITH {_VOLUME_CTE}
SELECT *, CASE WHEN status = 'evaluated' THEN 'Volume anomaly detected: ' || CAST(current_count AS VARCHAR)
       || ' records (Z-Score: ' || CAST(CAST(ROUND(z_score, 2) AS DECIMAL(28,2)) AS VARCHAR) || ')' END AS description
FROM vol
"""

SQL["freshness_check"] = f"WITH {_FRESH_CTE} SELECT * FROM fresh"

_CHECKS = f"""
WITH {_VOLUME_CTE}, {_FRESH_CTE},
checks AS (
  SELECT 'volume' AS check_type, source_table, metric_name AS check_key, CAST(current_count AS DOUBLE) AS metric_value,
         CAST(threshold_value AS DOUBLE) AS threshold_value, CAST(z_score AS DOUBLE) AS z_score, is_anomaly, status
  FROM vol
  UNION ALL
  SELECT 'freshness', source_table, CAST(event_type AS VARCHAR), CAST(minutes_since_last AS DOUBLE),
         CAST(threshold_minutes AS DOUBLE), CAST(NULL AS DOUBLE), is_stale, status
  FROM fresh)
"""

SQL["detection_checks"] = _CHECKS + " SELECT * FROM checks"

SQL["detection_summary"] = _CHECKS + """
SELECT CAST(SUM(CASE WHEN check_type = 'volume' AND is_anomaly THEN 1 ELSE 0 END) AS INTEGER) AS volume_anomalies,
       CAST(SUM(CASE WHEN check_type = 'freshness' AND is_anomaly THEN 1 ELSE 0 END) AS INTEGER) AS freshness_anomalies,
       CAST(SUM(CAST(is_anomaly AS INTEGER)) AS INTEGER) AS total_anomalies,
       CAST(SUM(CASE WHEN status = 'evaluated' THEN 1 ELSE 0 END) AS INTEGER) AS checks_evaluated,
       CAST(SUM(CASE WHEN status <> 'evaluated' THEN 1 ELSE 0 END) AS INTEGER) AS checks_skipped
FROM checks
"""

SQL["deviation_table"] = f"""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS bucket, CAST(COUNT(*) AS DOUBLE) AS daily_orders,
                  CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS daily_revenue,
                  CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS avg_order_value
           FROM orders WHERE {_ORDERS_30D} GROUP BY 1),
s AS (UNPIVOT d ON daily_orders, daily_revenue, avg_order_value INTO NAME metric_name VALUE value),
a AS (SELECT metric_name, DATE '2001-08-01' AS current_bucket,
             MAX(CASE WHEN bucket = DATE '2001-08-01' THEN value END) AS cv,
             CAST(AVG(CASE WHEN bucket < DATE '2001-08-01' THEN value END) AS DECIMAL(15,4)) AS mean_value,
             CAST(COALESCE(STDDEV_SAMP(CASE WHEN bucket < DATE '2001-08-01' THEN value END),
                           CASE WHEN COUNT(CASE WHEN bucket < DATE '2001-08-01' THEN value END) > 0 THEN 0.0 END)
                  AS DECIMAL(15,4)) AS std_deviation,
             CAST(COUNT(CASE WHEN bucket < DATE '2001-08-01' THEN value END) AS INTEGER) AS sample_size
      FROM s WHERE bucket <= DATE '2001-08-01' GROUP BY 1),
z AS (SELECT *, {_Z.format(v='cv', m='mean_value', sd='std_deviation')} AS z FROM a)
SELECT metric_name, current_bucket, CAST(cv AS DECIMAL(15,4)) AS current_value, mean_value, std_deviation, sample_size,
       CAST(CAST(mean_value AS DOUBLE) - 3.0 * CAST(std_deviation AS DOUBLE) AS DECIMAL(15,4)) AS expected_low,
       CAST(CAST(mean_value AS DOUBLE) + 3.0 * CAST(std_deviation AS DOUBLE) AS DECIMAL(15,4)) AS expected_high,
       CAST(z AS DECIMAL(10,4)) AS signed_z, COALESCE(abs(z) > 3.0, false) AS is_anomaly,
       {_BAND.format(z='z')} AS severity_band,
       CASE WHEN cv IS NULL THEN 'skipped_no_data' WHEN sample_size = 0 THEN 'skipped_no_baseline'
            ELSE 'evaluated' END AS status
FROM z
"""

SQL["seasonal_baseline"] = """
WITH s AS (SELECT date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1)
SELECT 'hourly_ingestion_rate' AS metric_name,
       CASE WHEN dayofweek(bucket) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_class,
       CAST(hour(bucket) AS INTEGER) AS hour_of_day,
       CAST(AVG(value) AS DECIMAL(15,4)) AS mean_value,
       CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS std_deviation,
       CAST(COUNT(*) AS INTEGER) AS sample_size
FROM s GROUP BY 2, 3
"""

SQL["rolling_baseline"] = f"""
WITH s AS ({_HOURLY_BY_TYPE}),
w AS (SELECT *, COUNT(value) OVER win AS n, AVG(value) OVER win AS m, STDDEV_SAMP(value) OVER win AS sd FROM s
      WINDOW win AS (PARTITION BY event_type, metric_name ORDER BY bucket
                     RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 HOUR PRECEDING)),
x AS (SELECT *, CAST(m AS DECIMAL(15,4)) AS trailing_mean,
             CAST(COALESCE(sd, CASE WHEN n > 0 THEN 0.0 END) AS DECIMAL(15,4)) AS trailing_std FROM w),
y AS (SELECT *, {_Z.format(v='value', m='trailing_mean', sd='trailing_std')} AS z FROM x)
SELECT event_type, metric_name, bucket, value, CAST(n AS INTEGER) AS trailing_n, trailing_mean, trailing_std,
       CAST(z AS DECIMAL(10,4)) AS z_score, COALESCE(abs(z) > 3.0, false) AS is_anomaly
FROM y
"""

SQL["outlier_rejected_baseline"] = f"""
WITH s AS ({_HOURLY_BY_TYPE}),
b AS (SELECT *, CAST(AVG(value) OVER (PARTITION BY event_type, metric_name) AS DECIMAL(15,4)) AS m1,
             CAST(COALESCE(STDDEV_SAMP(value) OVER (PARTITION BY event_type, metric_name), 0.0) AS DECIMAL(15,4)) AS s1
      FROM s),
z AS (SELECT *, abs({_Z.format(v='value', m='m1', sd='s1')}) AS az FROM b)
SELECT event_type, metric_name, CAST(COUNT(*) AS INTEGER) AS raw_sample_size,
       CAST(SUM(CASE WHEN az > 3.0 THEN 1 ELSE 0 END) AS INTEGER) AS rejected,
       CAST(AVG(CASE WHEN az <= 3.0 THEN value END) AS DECIMAL(15,4)) AS mean_value,
       CAST(COALESCE(STDDEV_SAMP(CASE WHEN az <= 3.0 THEN value END), 0.0) AS DECIMAL(15,4)) AS std_deviation,
       CAST(COUNT(CASE WHEN az <= 3.0 THEN 1 END) AS INTEGER) AS sample_size,
       CASE WHEN COUNT(CASE WHEN az <= 3.0 THEN 1 END) < 10 THEN 'insufficient' ELSE 'ok' END AS baseline_status
FROM z GROUP BY 1, 2
"""

SQL["smoothed_baseline"] = f"""
WITH s AS ({_HOURLY_BY_TYPE}),
o AS (SELECT event_type, metric_name, CAST(AVG(value) AS DECIMAL(15,4)) AS old_mean,
             CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS old_std
      FROM s WHERE bucket < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2),
n AS (SELECT event_type, metric_name, CAST(AVG(value) AS DECIMAL(15,4)) AS new_mean,
             CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS new_std, CAST(COUNT(*) AS INTEGER) AS sample_size
      FROM s WHERE bucket >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2)
SELECT n.event_type, n.metric_name, new_mean, new_std, sample_size, old_mean, old_std,
       CAST(CASE WHEN old_mean IS NULL THEN CAST(new_mean AS DOUBLE)
                 ELSE 0.1 * CAST(new_mean AS DOUBLE) + 0.9 * CAST(old_mean AS DOUBLE) END AS DECIMAL(15,4)) AS smoothed_mean
FROM n LEFT JOIN o USING (event_type, metric_name)
"""

SQL["interarrival_freshness"] = f"""
WITH g AS (SELECT event_type, ts, LAG(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev_ts FROM events),
gg AS (SELECT event_type, CAST(date_diff('microsecond', prev_ts, ts) AS DOUBLE) / 6.0e7 AS gap
       FROM g WHERE prev_ts IS NOT NULL),
st AS (SELECT event_type, COUNT(*) AS n_gaps, CAST(AVG(gap) AS DECIMAL(15,4)) AS mean_gap_minutes,
              CAST(COALESCE(STDDEV_SAMP(gap), 0.0) AS DECIMAL(15,4)) AS std_gap_minutes,
              CAST(MAX(gap) AS DECIMAL(15,4)) AS max_gap_minutes FROM gg GROUP BY 1),
l AS (SELECT event_type, MAX(ts) AS latest_timestamp FROM events GROUP BY 1),
j AS (SELECT l.event_type, l.latest_timestamp, COALESCE(st.n_gaps, 0) AS n_gaps, st.mean_gap_minutes,
             st.std_gap_minutes, st.max_gap_minutes,
             CAST(date_diff('microsecond', l.latest_timestamp, {_AS_OF}) AS DOUBLE) / 6.0e7 AS cur
      FROM l LEFT JOIN st USING (event_type)),
z AS (SELECT *, {_Z.format(v='cur', m='mean_gap_minutes', sd='std_gap_minutes')} AS z FROM j)
SELECT event_type, latest_timestamp, n_gaps, mean_gap_minutes, std_gap_minutes, max_gap_minutes,
       CAST(cur AS DECIMAL(15,4)) AS current_gap_minutes, CAST(z AS DECIMAL(10,4)) AS z_score,
       COALESCE(abs(z) > 3.0, false) AS is_anomaly
FROM z
"""

SQL["z_trajectory"] = f"""
WITH s AS (SELECT event_type, 'daily_row_count' AS metric_name, CAST(ts AS DATE) AS bucket,
                  CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY event_type, CAST(ts AS DATE)),
b AS (SELECT *,
        CAST(AVG(CASE WHEN bucket >= DATE '2024-01-01' AND bucket < DATE '2024-01-08' THEN value END)
             OVER (PARTITION BY event_type, metric_name) AS DECIMAL(15,4)) AS mean_value,
        CAST(COALESCE(STDDEV_SAMP(CASE WHEN bucket >= DATE '2024-01-01' AND bucket < DATE '2024-01-08' THEN value END)
             OVER (PARTITION BY event_type, metric_name), 0.0) AS DECIMAL(15,4)) AS std_deviation
      FROM s),
z AS (SELECT *, {_Z.format(v='value', m='mean_value', sd='std_deviation')} AS z FROM b)
SELECT event_type, metric_name, bucket, value, mean_value, std_deviation, CAST(z AS DECIMAL(10,4)) AS signed_z,
       COALESCE(abs(z) > 3.0, false) AS is_anomaly, {_BAND.format(z='z')} AS severity_band
FROM z
"""

SQL["latest_baseline"] = """
WITH g1d AS (SELECT CAST(o_orderdate AS DATE) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM orders
             WHERE o_orderdate >= TIMESTAMP '2001-06-26 00:00:00' AND o_orderdate < TIMESTAMP '2001-07-26 00:00:00'
             GROUP BY 1),
g1h AS (SELECT date_trunc('hour', ts) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM events
        WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' AND ts < TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1),
g2h AS (SELECT date_trunc('hour', ts) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM events
        WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
store AS (
  SELECT 'daily_row_count' AS metric_name, 'batch_analytics_db' AS source_database, 'orders' AS table_name,
         CAST(AVG(v) AS DECIMAL(15,4)) AS mean_value, CAST(COALESCE(STDDEV_SAMP(v), 0.0) AS DECIMAL(15,4)) AS std_deviation,
         CAST(COUNT(*) AS INTEGER) AS sample_size, TIMESTAMP '2001-07-26 00:00:00' AS calculation_timestamp FROM g1d
  UNION ALL
  SELECT 'hourly_ingestion_rate', 'cdc_history_db', 'events', CAST(AVG(v) AS DECIMAL(15,4)),
         CAST(COALESCE(STDDEV_SAMP(v), 0.0) AS DECIMAL(15,4)), CAST(COUNT(*) AS INTEGER),
         TIMESTAMP '2024-01-24 00:00:00' FROM g1h
  UNION ALL
  SELECT 'hourly_ingestion_rate', 'cdc_history_db', 'events', CAST(AVG(v) AS DECIMAL(15,4)),
         CAST(COALESCE(STDDEV_SAMP(v), 0.0) AS DECIMAL(15,4)), CAST(COUNT(*) AS INTEGER),
         TIMESTAMP '2024-01-31 00:00:00' FROM g2h)
SELECT metric_name, source_database, table_name, mean_value, std_deviation, sample_size, calculation_timestamp
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric_name, source_database, table_name
                                   ORDER BY calculation_timestamp DESC) AS rn FROM store)
WHERE rn = 1
"""

_ALLOWED_STATUS = "['pending', 'completed', 'shipped', 'cancelled', 'refunded']".replace("'", "''")
_PAT = "^[A-Za-z0-9-_]+$"

# Expected violations of the planted CDC payloads, derived relationally from
# the same key arithmetic (no JSON involved).
_CDC_VIOL = f"""
o AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus,
             (CAST(round(o_totalprice * 100) AS BIGINT) * 10) // 7 AS milli FROM orders),
cand AS (
  SELECT k AS record_id, 0 AS ord, 'order_key' AS field_name, 'MISSING_REQUIRED_FIELD' AS violation_type,
         'missing' AS constraint_kind, 'missing' AS error_kinds, CAST(NULL AS VARCHAR) AS expected_type,
         CAST(NULL AS VARCHAR) AS actual_type, 'Required field ''order_key'' is missing' AS error_text
  FROM o WHERE k % 79 = 0
  UNION ALL
  SELECT k, 1, 'order_key', 'TYPE_MISMATCH', 'pattern', 'pattern', 'string', 'str',
         'Field ''order_key'' value ''ORD ' || CAST(k AS VARCHAR) || ''' does not match pattern ''{_PAT}'''
  FROM o WHERE k % 79 <> 0 AND k % 71 = 0
  UNION ALL
  SELECT k, 1, 'order_key', 'CONSTRAINT_VIOLATION', 'min_length', 'min_length,pattern', 'string', 'str',
         'Field ''order_key'' length 0 below minimum 1 | Field ''order_key'' value '''' does not match pattern ''{_PAT}'''
  FROM o WHERE k % 79 <> 0 AND k % 71 <> 0 AND k % 67 = 0
  UNION ALL
  SELECT k, 2, 'total_amount', 'TYPE_MISMATCH', 'type', 'type', 'float', 'str',
         'Field ''total_amount'' type mismatch: expected float, got str'
  FROM o WHERE k % 97 = 0
  UNION ALL
  SELECT k, 2, 'total_amount', 'NULLABILITY_VIOLATION', 'nullability', 'nullability', 'float', 'NoneType',
         'Field ''total_amount'' is not nullable but value is null'
  FROM o WHERE k % 97 <> 0 AND k % 89 = 0
  UNION ALL
  SELECT k, 3, 'customer_id', 'TYPE_MISMATCH', 'type', 'type', 'integer', 'str',
         'Field ''customer_id'' type mismatch: expected integer, got str'
  FROM o WHERE k % 73 = 0
  UNION ALL
  SELECT k, 4, 'quantity', 'TYPE_MISMATCH', 'min_value', 'min_value', 'integer', 'int',
         'Field ''quantity'' value 0 below minimum 1'
  FROM o WHERE k % 7 = 0
  UNION ALL
  SELECT k, 5, 'unit_price', 'TYPE_MISMATCH', 'precision', 'precision', 'float', 'float',
         'Field ''unit_price'' precision 3 exceeds maximum 2'
  FROM o WHERE milli % 10 <> 0
  UNION ALL
  SELECT k, 6, 'order_status', 'TYPE_MISMATCH', 'allowed_values', 'allowed_values', 'string', 'str',
         'Field ''order_status'' value ''processing'' not in allowed values: {_ALLOWED_STATUS}'
  FROM o WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL
  SELECT k, 10, 'legacy_flag', 'UNEXPECTED_FIELD', 'unexpected', 'unexpected', NULL, NULL,
         'Unexpected field ''legacy_flag'' not defined in contract'
  FROM o WHERE k % 83 = 0),
viol AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY record_id ORDER BY ord) - 1 AS INTEGER) AS violation_pos
         FROM cand)
"""

SQL["contract_violations_json"] = f"""
WITH {_CDC_VIOL}
SELECT record_id, violation_pos, field_name, violation_type, constraint_kind, error_kinds, expected_type,
       actual_type, error_text FROM viol
"""

SQL["contract_summary"] = f"""
WITH {_CDC_VIOL},
per AS (SELECT record_id, COUNT(*) AS n,
               SUM(CASE WHEN violation_type IN ('TYPE_MISMATCH', 'MISSING_REQUIRED_FIELD') THEN 1 ELSE 0 END) AS c
        FROM viol GROUP BY 1)
SELECT COUNT(*) AS total_records,
       CAST(SUM(CASE WHEN per.record_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS valid_records,
       CAST(SUM(CASE WHEN per.record_id IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS invalid_records,
       CAST(COALESCE(SUM(per.n), 0) AS BIGINT) AS total_violations,
       CAST(COALESCE(SUM(per.c), 0) AS BIGINT) AS critical_violations
FROM o LEFT JOIN per ON o.k = per.record_id
"""

SQL["contract_violations_by_type"] = f"""
WITH {_CDC_VIOL}
SELECT violation_type, COUNT(*) AS violation_count FROM viol GROUP BY 1
"""

SQL["contract_valid_records"] = f"""
WITH {_CDC_VIOL}
SELECT k AS record_id FROM o WHERE k NOT IN (SELECT record_id FROM viol)
"""

SQL["contract_quarantine"] = f"""
WITH {_CDC_VIOL}
SELECT record_id, CAST(COUNT(*) AS INTEGER) AS violation_count,
       arg_min(violation_type, violation_pos) AS first_violation_type
FROM viol GROUP BY 1
"""

SQL["contract_critical_sample"] = f"""
WITH {_CDC_VIOL}
SELECT record_id, violation_pos, field_name, violation_type FROM viol
WHERE violation_type IN ('TYPE_MISMATCH', 'MISSING_REQUIRED_FIELD')
ORDER BY record_id, violation_pos LIMIT 5
"""

SQL["contract_typed_table"] = """
WITH cand AS (
  SELECT o_orderkey AS record_id, 1 AS ord, 'o_orderstatus' AS field_name, 'TYPE_MISMATCH' AS violation_type,
         'allowed_values' AS constraint_kind, 'allowed_values' AS error_kinds, 'string' AS expected_type,
         'str' AS actual_type,
         'Field ''o_orderstatus'' value ''' || o_orderstatus || ''' not in allowed values: [''F'', ''O'']' AS error_text
  FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL
  SELECT o_orderkey, 2, 'o_orderpriority',
         CASE WHEN length(o_orderpriority) > 8 THEN 'CONSTRAINT_VIOLATION' ELSE 'TYPE_MISMATCH' END,
         CASE WHEN length(o_orderpriority) > 8 THEN 'max_length' ELSE 'pattern' END,
         concat_ws(',', CASE WHEN length(o_orderpriority) > 8 THEN 'max_length' END,
                   CASE WHEN NOT regexp_matches(o_orderpriority, '^(?:^[1-5]-[A-Z]+$)') THEN 'pattern' END),
         'string', 'str',
         concat_ws(' | ',
           CASE WHEN length(o_orderpriority) > 8 THEN 'Field ''o_orderpriority'' length '
                || CAST(length(o_orderpriority) AS VARCHAR) || ' above maximum 8' END,
           CASE WHEN NOT regexp_matches(o_orderpriority, '^(?:^[1-5]-[A-Z]+$)') THEN 'Field ''o_orderpriority'' value '''
                || o_orderpriority || ''' does not match pattern ''^[1-5]-[A-Z]+$''' END)
  FROM orders WHERE length(o_orderpriority) > 8 OR NOT regexp_matches(o_orderpriority, '^(?:^[1-5]-[A-Z]+$)')
  UNION ALL
  SELECT o_orderkey, 3, 'o_totalprice', 'TYPE_MISMATCH',
         CASE WHEN o_totalprice < 1000.0 THEN 'min_value' ELSE 'max_value' END,
         CASE WHEN o_totalprice < 1000.0 THEN 'min_value' ELSE 'max_value' END, 'float', 'float',
         'Field ''o_totalprice'' value ' || CAST(o_totalprice AS VARCHAR)
         || CASE WHEN o_totalprice < 1000.0 THEN ' below minimum 1000.0' ELSE ' above maximum 450000.0' END
  FROM orders WHERE o_totalprice < 1000.0 OR o_totalprice > 450000.0
  UNION ALL
  SELECT o_orderkey, 4, 'o_custkey', 'TYPE_MISMATCH', 'min_value', 'min_value', 'integer', 'int',
         'Field ''o_custkey'' value ' || CAST(o_custkey AS VARCHAR) || ' below minimum 1'
  FROM orders WHERE o_custkey < 1)
SELECT record_id, CAST(ROW_NUMBER() OVER (PARTITION BY record_id ORDER BY ord) - 1 AS INTEGER) AS violation_pos,
       field_name, violation_type, constraint_kind, error_kinds, expected_type, actual_type, error_text
FROM cand
"""

SQL["schema_drift"] = """
SELECT 'order_key' AS field_name, 'TYPE_MISMATCH' AS violation_type, 'string' AS expected_type, 'int' AS actual_type,
       COUNT(o_orderkey) AS affected_rows FROM orders
UNION ALL
SELECT 'total_amount', 'TYPE_MISMATCH', 'float', 'Decimal', COUNT(o_totalprice) FROM orders
UNION ALL
SELECT 'order_priority', 'UNEXPECTED_FIELD', NULL, 'str', COUNT(*) FROM orders
"""

SQL["newest_sample"] = """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100
"""

SQL["union_sources"] = f"""
WITH {_CDC_VIOL},
per AS (SELECT record_id, COUNT(*) AS n FROM viol GROUP BY 1)
SELECT 'database' AS record_source, COUNT(*) AS total_records, CAST(0 AS BIGINT) AS valid_records,
       COUNT(*) AS total_violations FROM events
UNION ALL
SELECT 'json_logs', COUNT(*), CAST(SUM(CASE WHEN per.record_id IS NULL THEN 1 ELSE 0 END) AS BIGINT),
       CAST(COALESCE(SUM(per.n), 0) AS BIGINT)
FROM o LEFT JOIN per ON o.k = per.record_id
"""

_AL = """
al AS (SELECT event_id,
              CASE event_type WHEN 'error' THEN 'VOLUME_ANOMALY' WHEN 'view' THEN 'STALE_DATA_FLOW'
                              WHEN 'click' THEN 'CONTRACT_VIOLATION' ELSE 'OTHER' END AS alert_type,
              CASE WHEN value > 300 THEN 'CRITICAL' ELSE 'WARNING' END AS alert_severity,
              'events' AS source_table, ts AS alert_timestamp, CAST(value AS DECIMAL(15,4)) AS metric_value,
              CAST(NULL AS VARCHAR) AS contract_name, CAST(NULL AS VARCHAR) AS field_name
       FROM events WHERE value > 200)
"""
_RECENT = ("r AS (SELECT * FROM al WHERE alert_timestamp >= TIMESTAMP '2024-01-30 00:00:00' "
           "AND alert_timestamp <= TIMESTAMP '2024-01-31 00:00:00')")
_COUNTS = """COUNT(*) AS alerts_24h,
       CAST(COALESCE(SUM(CASE WHEN alert_severity = 'CRITICAL' THEN 1 ELSE 0 END), 0) AS BIGINT) AS critical_24h,
       CAST(COALESCE(SUM(CASE WHEN alert_type = 'VOLUME_ANOMALY' THEN 1 ELSE 0 END), 0) AS BIGINT) AS volume_anomalies,
       CAST(COALESCE(SUM(CASE WHEN alert_type = 'STALE_DATA_FLOW' THEN 1 ELSE 0 END), 0) AS BIGINT) AS stale_alerts,
       CAST(COALESCE(SUM(CASE WHEN alert_type = 'CONTRACT_VIOLATION' THEN 1 ELSE 0 END), 0) AS BIGINT)
         AS contract_violations"""


def _scores_sql(src: str) -> str:
    """Score CTEs over ``src`` (alerts_24h, critical_24h, volume_anomalies,
    stale_alerts, contract_violations, total_baselines)."""
    return f"""
s1 AS (SELECT *, CASE WHEN total_baselines > 0
                      THEN greatest(0.0, 100.0 - CAST(critical_24h AS DOUBLE) / greatest(total_baselines, 1) * 50.0)
                      ELSE 50.0 END AS base FROM {src}),
s2 AS (SELECT *,
         round_even(CASE WHEN alerts_24h > 10 THEN greatest(0.0, base - least(20.0, CAST(alerts_24h - 10 AS DOUBLE) * 2.0))
                    ELSE base END, 1) AS platform_score,
         round_even(CASE WHEN volume_anomalies = 0 THEN 100.0 WHEN volume_anomalies <= 2 THEN 75.0
                    ELSE greatest(0.0, CAST(100 - volume_anomalies * 20 AS DOUBLE)) END, 1) AS batch_score,
         CASE WHEN volume_anomalies = 0 THEN 'Healthy' WHEN volume_anomalies <= 2 THEN 'Minor Anomaly'
              ELSE 'Anomaly' END AS batch_status,
         round_even(CASE WHEN stale_alerts = 0 THEN 100.0 WHEN stale_alerts <= 1 THEN 80.0
                    ELSE greatest(0.0, CAST(100 - stale_alerts * 25 AS DOUBLE)) END, 1) AS cdc_score,
         CASE WHEN stale_alerts = 0 THEN 'Healthy' WHEN stale_alerts <= 1 THEN 'Minor Staleness'
              ELSE 'Stale' END AS cdc_status,
         round_even(CASE WHEN contract_violations = 0 THEN 100.0 WHEN contract_violations <= 3 THEN 85.0
                    ELSE greatest(0.0, CAST(100 - contract_violations * 15 AS DOUBLE)) END, 1) AS contract_score,
         CASE WHEN contract_violations = 0 THEN 'Compliant' WHEN contract_violations <= 3 THEN 'Minor Violation'
              ELSE 'Violated' END AS contract_status
       FROM s1),
s3 AS (SELECT *,
         CASE WHEN platform_score >= 90 THEN 'Excellent' WHEN platform_score >= 75 THEN 'Good'
              WHEN platform_score >= 60 THEN 'Fair' ELSE 'Poor' END AS platform_status,
         CASE WHEN batch_score >= 90 THEN 'Healthy' WHEN batch_score >= 70 THEN 'Minor Anomaly' ELSE 'Anomaly' END
           AS batch_band,
         CASE WHEN cdc_score >= 90 THEN 'Healthy' WHEN cdc_score >= 75 THEN 'Minor Staleness' ELSE 'Stale' END
           AS cdc_band,
         CASE WHEN contract_score >= 90 THEN 'Compliant' WHEN contract_score >= 80 THEN 'Minor Violation'
              ELSE 'Violated' END AS contract_band,
         CASE WHEN least(platform_score, batch_score, cdc_score, contract_score) < 60 THEN 'CRITICAL'
              WHEN least(platform_score, batch_score, cdc_score, contract_score) < 75 THEN 'ATTENTION'
              ELSE 'HEALTHY' END AS overall_status,
         concat_ws('; ',
           CASE WHEN platform_score < 75 THEN 'High Priority: Address critical platform reliability issues' END,
           CASE WHEN batch_score < 75 THEN 'Investigate: Review batch processing volume anomalies' END,
           CASE WHEN cdc_score < 75 THEN 'Optimize: Investigate CDC data flow staleness' END,
           CASE WHEN contract_score < 75 THEN 'Enforce: Review and update data contracts' END) AS recs,
         platform_score >= 75 AS gate_passed
       FROM s2)
"""


SQL["alerts_dedup"] = f"""
WITH {_AL},
k AS (SELECT *, lower(alert_type) || '_' || source_table || '_' || CAST(CAST(alert_timestamp AS DATE) AS VARCHAR)
                AS dedup_key, CAST(alert_timestamp AS DATE) AS alert_day FROM al),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY dedup_key ORDER BY alert_timestamp, event_id) AS rn,
             COUNT(*) OVER (PARTITION BY dedup_key) AS duplicates FROM k)
SELECT dedup_key, alert_type, source_table, alert_day, alert_timestamp, alert_severity, event_id, duplicates
FROM r WHERE rn = 1
"""

SQL["alert_cooldown"] = f"""
WITH {_AL},
g AS (SELECT *, LAG(alert_timestamp) OVER (PARTITION BY alert_type, source_table
                                           ORDER BY alert_timestamp, event_id) AS prev_ts FROM al),
m AS (SELECT *, CAST(date_diff('microsecond', prev_ts, alert_timestamp) AS DOUBLE) / 6.0e7 AS gap FROM g)
SELECT event_id, alert_type, alert_timestamp, prev_ts, CAST(gap AS DECIMAL(15,4)) AS gap_minutes
FROM m WHERE prev_ts IS NULL OR gap >= 60.0
"""

SQL["alert_stats"] = f"""
WITH {_AL}, {_RECENT},
g AS (SELECT alert_type, alert_severity, COUNT(*) AS alert_count, MAX(alert_timestamp) AS latest_alert
      FROM r GROUP BY 1, 2)
SELECT *, CAST(SUM(alert_count) OVER (PARTITION BY alert_type) AS BIGINT) AS type_total FROM g
"""

SQL["alert_totals"] = f"""
WITH {_AL}
SELECT COUNT(*) AS total_alerts, MIN(alert_timestamp) AS earliest_alert, MAX(alert_timestamp) AS latest_alert FROM al
"""

SQL["severity_distribution"] = f"""
WITH {_AL}
SELECT alert_severity, COUNT(*) AS alert_count,
       CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share
FROM al GROUP BY 1
"""

SQL["detection_status"] = f"""
WITH {_AL}, {_RECENT}
SELECT alert_type, COUNT(*) AS alert_count, MAX(alert_timestamp) AS latest_alert FROM r GROUP BY 1
"""

SQL["profiling_status"] = f"""
WITH bl AS ({_BASELINES})
SELECT metric_name, COUNT(*) AS baseline_count, MAX(calculation_timestamp) AS last_calculated FROM bl GROUP BY 1
"""

SQL["retention"] = f"""
WITH {_AL}
SELECT event_id, alert_type, alert_timestamp FROM al WHERE alert_timestamp >= TIMESTAMP '2024-01-17 00:00:00'
"""

SQL["new_alerts"] = f"""
WITH {_AL},
b AS (SELECT * FROM al WHERE alert_timestamp >= TIMESTAMP '2024-01-27 00:00:00'),
s AS (SELECT * FROM al WHERE alert_timestamp < TIMESTAMP '2024-01-29 00:00:00')
SELECT alert_type, source_table, alert_timestamp, alert_severity, metric_value FROM b
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.alert_type IS NOT DISTINCT FROM b.alert_type
                  AND s.source_table IS NOT DISTINCT FROM b.source_table
                  AND s.contract_name IS NOT DISTINCT FROM b.contract_name
                  AND s.field_name IS NOT DISTINCT FROM b.field_name
                  AND s.alert_timestamp IS NOT DISTINCT FROM b.alert_timestamp)
"""

SQL["scorecard"] = f"""
WITH {_AL}, {_RECENT}, bl AS ({_BASELINES}),
a AS (SELECT {_COUNTS} FROM r),
t AS (SELECT COUNT(*) AS total_alerts, MAX(alert_timestamp) AS latest_alert FROM al),
b AS (SELECT COUNT(*) AS total_baselines, MAX(calculation_timestamp) AS last_updated FROM bl),
j AS (SELECT * FROM a CROSS JOIN t CROSS JOIN b),
{_scores_sql('j')}
SELECT TIMESTAMP '2024-01-31 00:00:00' AS generated_at, total_baselines, total_alerts, alerts_24h, critical_24h,
       volume_anomalies, stale_alerts, contract_violations, platform_score, platform_status, batch_score,
       batch_status, batch_band, cdc_score, cdc_status, cdc_band, contract_score, contract_status, contract_band,
       overall_status,
       CASE WHEN recs = '' THEN 'Maintain: Continue current monitoring practices' ELSE recs END AS recommendations,
       gate_passed, latest_alert, last_updated
FROM s3
"""

_HISTORY = f"""
WITH {_AL}, bl AS ({_BASELINES}),
a AS (SELECT CAST(alert_timestamp AS DATE) AS score_date, {_COUNTS} FROM al GROUP BY 1),
b AS (SELECT COUNT(*) AS total_baselines FROM bl),
j AS (SELECT * FROM a CROSS JOIN b),
{_scores_sql('j')}
"""

SQL["scorecard_history"] = _HISTORY + """
SELECT score_date, alerts_24h, critical_24h, volume_anomalies, stale_alerts, contract_violations, platform_score,
       batch_score, cdc_score, contract_score, overall_status FROM s3
"""

SQL["health_trend"] = _HISTORY + """,
t AS (SELECT score_date, platform_score,
             CAST(AVG(platform_score) OVER (ORDER BY score_date
                  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS DECIMAL(15,4)) AS prior_mean
      FROM s3)
SELECT score_date, platform_score, prior_mean,
       CASE WHEN prior_mean IS NULL THEN NULL WHEN platform_score - prior_mean > 1.0 THEN 'improving'
            WHEN platform_score - prior_mean < -1.0 THEN 'declining' ELSE 'stable' END AS trend
FROM t
"""

SQL["stream_hourly_ingestion"] = """
SELECT date_trunc('hour', ts) AS bucket, date_trunc('hour', ts) + INTERVAL 1 HOUR AS bucket_end, COUNT(*) AS row_count
FROM events GROUP BY 1
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR
"""

SQL["stream_contract_quarantine"] = SQL["contract_quarantine"]

SQL["stream_alert_dedup"] = f"""
WITH {_AL}
SELECT DISTINCT lower(alert_type) || '_' || source_table || '_' || CAST(CAST(alert_timestamp AS DATE) AS VARCHAR)
       AS dedup_key, alert_type, source_table, CAST(alert_timestamp AS DATE) AS alert_day
FROM al
"""

SQL["stream_freshness"] = SQL["freshness_check"]


def _dev_sql(series: str, thresholds: dict[str, float], table: str, at: str) -> str:
    """Deviation checks (bucket ``at`` vs the earlier ones) over a long series CTE."""
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in thresholds.items())
    return f"""
SELECT 'volume' AS check_type, '{table}' AS source_table, metric_name AS check_key,
       CAST(CAST(cv AS DECIMAL(15,4)) AS DOUBLE) AS metric_value,
       CAST(mean_value AS DOUBLE) + thr * CAST(std_deviation AS DOUBLE) AS threshold_value,
       abs(CAST(CAST(z AS DECIMAL(10,4)) AS DOUBLE)) AS z_score,
       COALESCE(abs(z) > thr, false) AS is_anomaly,
       CASE WHEN cv IS NULL THEN 'skipped_no_data' WHEN sample_size > 0 THEN 'evaluated'
            ELSE 'skipped_no_baseline' END AS status
FROM (SELECT *, {_Z.format(v='cv', m='mean_value', sd='std_deviation')} AS z,
             CASE metric_name {case} ELSE 3.0 END AS thr
      FROM (SELECT metric_name, MAX(CASE WHEN bucket = {at} THEN value END) AS cv,
                   CAST(AVG(CASE WHEN bucket < {at} THEN value END) AS DECIMAL(15,4)) AS mean_value,
                   CAST(COALESCE(STDDEV_SAMP(CASE WHEN bucket < {at} THEN value END),
                        CASE WHEN COUNT(CASE WHEN bucket < {at} THEN value END) > 0 THEN 0.0 END)
                        AS DECIMAL(15,4)) AS std_deviation,
                   COUNT(CASE WHEN bucket < {at} THEN value END) AS sample_size
            FROM {series} WHERE bucket <= {at} GROUP BY 1))
"""


def _fresh_sql(table: str, ts: str, as_of: str) -> str:
    return f"""
SELECT 'freshness' AS check_type, '{table}' AS source_table, 'table' AS check_key,
       CAST(CAST(m AS DECIMAL(15,4)) AS DOUBLE) AS metric_value, 30.0 AS threshold_value,
       CAST(NULL AS DOUBLE) AS z_score, COALESCE(m > 30.0, false) AS is_anomaly,
       CASE WHEN m IS NULL THEN 'skipped_no_data' ELSE 'evaluated' END AS status
FROM (SELECT CAST(date_diff('microsecond', MAX({ts}), TIMESTAMP '{as_of}') AS DOUBLE) / 6.0e7 AS m FROM {table})
"""


SQL["monitor_checks"] = f"""
WITH od AS (SELECT CAST(o_orderdate AS DATE) AS bucket, CAST(COUNT(*) AS DOUBLE) AS daily_row_count,
                   CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS daily_revenue
            FROM orders WHERE {_ORDERS_30D} GROUP BY 1),
os AS (UNPIVOT od ON daily_row_count, daily_revenue INTO NAME metric_name VALUE value),
es AS (SELECT 'hourly_ingestion_rate' AS metric_name, date_trunc('hour', ts) AS bucket,
              CAST(COUNT(*) AS DOUBLE) AS value FROM events WHERE {_EVENTS_24H} GROUP BY 2)
{_dev_sql('os', {'daily_row_count': 3.0, 'daily_revenue': 2.5}, 'orders', "DATE '2001-08-01'")}
UNION ALL
{_fresh_sql('orders', 'o_orderdate', '2001-08-02 00:00:00')}
UNION ALL
{_dev_sql('es', {'hourly_ingestion_rate': 3.0}, 'events', "TIMESTAMP '2024-01-30 23:00:00'")}
UNION ALL
{_fresh_sql('events', 'ts', '2024-01-31 00:00:00')}
"""

SQL["monitor_scorecard"] = f"""
WITH chk AS ({SQL["monitor_checks"]}),
al AS (SELECT CASE check_type WHEN 'volume' THEN 'VOLUME_ANOMALY' ELSE 'STALE_DATA_FLOW' END AS alert_type,
              'CRITICAL' AS alert_severity,
              TIMESTAMP '2024-01-31 00:00:00' AS alert_timestamp
       FROM chk WHERE is_anomaly),
{_RECENT},
a AS (SELECT {_COUNTS} FROM r),
t AS (SELECT COUNT(*) AS total_alerts, MAX(alert_timestamp) AS latest_alert FROM al),
b AS (SELECT COUNT(*) AS total_baselines,
             MAX(CASE source_table WHEN 'orders' THEN TIMESTAMP '2001-08-02 00:00:00'
                 ELSE TIMESTAMP '2024-01-31 00:00:00' END) AS last_updated
      FROM chk WHERE check_type = 'volume'),
j AS (SELECT * FROM a CROSS JOIN t CROSS JOIN b),
{_scores_sql('j')}
SELECT TIMESTAMP '2024-01-31 00:00:00' AS generated_at, total_baselines, total_alerts, alerts_24h, critical_24h,
       volume_anomalies, stale_alerts, contract_violations, platform_score, platform_status, batch_score,
       batch_status, batch_band, cdc_score, cdc_status, cdc_band, contract_score, contract_status, contract_band,
       overall_status,
       CASE WHEN recs = '' THEN 'Maintain: Continue current monitoring practices' ELSE recs END AS recommendations,
       gate_passed, latest_alert, last_updated
FROM s3
"""

SQL["metric_breaches"] = f"""
WITH s AS (SELECT event_type, date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS row_count,
                  CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS value_sum,
                  CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS active_users
           FROM events GROUP BY event_type, date_trunc('hour', ts)),
u AS (UNPIVOT s ON row_count, value_sum, active_users INTO NAME metric_name VALUE value),
b AS (SELECT event_type, metric_name, CAST(AVG(value) AS DECIMAL(15,4)) AS m,
             CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS sd FROM u GROUP BY 1, 2),
z AS (SELECT u.metric_name, abs({_Z.format(v='u.value', m='b.m', sd='b.sd')}) > 3.0 AS is_anomaly
      FROM u JOIN b USING (event_type, metric_name))
SELECT metric_name, COUNT(*) AS buckets, CAST(SUM(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS breaches
FROM z GROUP BY 1
"""

SQL["json_log_contract_summary"] = SQL["contract_summary"]

# ---------------------------------------------------------------- stores, generations, outages, lenient mode

SQL["volume_check_generations"] = SQL["volume_check"]

SQL["outage_check"] = f"""
WITH s AS (SELECT event_type, date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value
           FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00'
             AND NOT (event_type = 'click' AND ts >= TIMESTAMP '2024-01-30 20:00:00') GROUP BY 1, 2)
SELECT event_type, MAX(CASE WHEN bucket = TIMESTAMP '2024-01-30 23:00:00' THEN CAST(value AS DECIMAL(15,4)) END) AS current_value,
       CAST(COUNT(CASE WHEN bucket < TIMESTAMP '2024-01-30 23:00:00' THEN 1 END) AS INTEGER) AS sample_size,
       CASE WHEN MAX(CASE WHEN bucket = TIMESTAMP '2024-01-30 23:00:00' THEN 1 END) IS NULL THEN 'skipped_no_data'
            ELSE 'evaluated' END AS status
FROM s GROUP BY 1
"""

SQL["contract_lenient_types"] = """
SELECT 'customer_id' AS field_name, COUNT(*) AS violation_count FROM orders WHERE o_orderkey % 73 = 0 HAVING COUNT(*) > 0
"""

SQL["contract_sample"] = """
SELECT o_orderkey AS record_id FROM orders ORDER BY o_orderkey LIMIT 100
"""

SQL["baseline_store"] = SQL["latest_baseline"]

SQL["alert_store_replay"] = f"""
WITH {_AL}
SELECT CAST(alert_timestamp AS DATE) AS alert_day, COUNT(DISTINCT (alert_type, source_table, alert_timestamp)) AS alerts
FROM al GROUP BY 1
"""

SQL["metric_csv_series"] = """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS bucket, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS r
           FROM orders GROUP BY 1)
SELECT 'daily_orders' AS metric_name, bucket, CAST(n AS DOUBLE) AS value FROM d
UNION ALL SELECT 'daily_revenue', bucket, CAST(r AS DOUBLE) FROM d
UNION ALL SELECT 'avg_order_value', bucket, ((2 * CAST(r * 100 AS BIGINT) + n) // (2 * n)) / 100.0 FROM d
"""

SQL["open_alerts"] = f"""
WITH {_AL} SELECT alert_type, COUNT(*) AS alerts FROM al GROUP BY 1
"""

SQL["monitor_contract_alerts"] = f"""
WITH v AS ({SQL["contract_violations_json"]})
SELECT field_name, COUNT(DISTINCT 1) AS alerts, TIMESTAMP '2024-01-31 00:00:00' AS alert_timestamp FROM v GROUP BY 1
"""

SQL["json_log_documents"] = SQL["contract_summary"]

SQL["scorecard_details"] = f"""
WITH {_AL},
r0 AS (SELECT * FROM al WHERE alert_timestamp >= TIMESTAMP '2024-01-30 00:00:00'
       AND alert_timestamp <= TIMESTAMP '2024-01-31 00:00:00'),
n AS (SELECT alert_type, COUNT(*) AS n FROM r0 GROUP BY 1)
SELECT MAX(CASE WHEN alert_type = 'VOLUME_ANOMALY' THEN alert_timestamp END) AS latest_volume_alert,
       MAX(CASE WHEN alert_type = 'STALE_DATA_FLOW' THEN alert_timestamp END) AS latest_stale_alert,
       MAX(CASE WHEN alert_type = 'CONTRACT_VIOLATION' THEN alert_timestamp END) AS latest_contract_alert,
       (SELECT coalesce(string_agg(alert_type || '=' || n, ', ' ORDER BY alert_type), '') FROM n) AS alert_types,
       COUNT(CASE WHEN alert_type IN ('VOLUME_ANOMALY', 'STALE_DATA_FLOW', 'CONTRACT_VIOLATION') THEN 1 END) = 0
       AS anomaly_gate_passed
FROM r0
"""

SQL["seasonal_scores"] = f"""
WITH b AS ({SQL["seasonal_baseline"]}),
s AS (SELECT date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1),
k AS (SELECT *, CASE WHEN dayofweek(bucket) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS day_class,
             CAST(hour(bucket) AS INTEGER) AS hour_of_day FROM s),
z AS (SELECT k.*, sample_size, {_Z.format(v='value', m='mean_value', sd='std_deviation')} AS z
      FROM k JOIN b USING (day_class, hour_of_day))
SELECT bucket, day_class, hour_of_day, value, CASE WHEN sample_size >= 10 THEN CAST(abs(z) AS DECIMAL(10,4)) END AS z_score,
       sample_size >= 10 AND abs(z) > 3.0 AS is_anomaly,
       CASE WHEN sample_size < 10 THEN 'skipped_few_samples' ELSE 'evaluated' END AS status
FROM z
"""

SQL["asof_event_scores"] = f"""
WITH b AS (SELECT event_type, CAST(ts AS DATE)::TIMESTAMP + INTERVAL 1 DAY AS calculation_timestamp,
                  CAST(AVG(value) AS DECIMAL(15,4)) AS baseline_mean,
                  CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS baseline_std,
                  CAST(COUNT(value) AS INTEGER) AS sample_size
           FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5 GROUP BY 1, 2),
j AS (SELECT e.event_id, e.event_type, e.value, b.calculation_timestamp, b.baseline_mean, b.baseline_std, b.sample_size
      FROM events e ASOF LEFT JOIN b ON e.event_type = b.event_type AND e.ts >= b.calculation_timestamp),
z AS (SELECT *, {_Z.format(v='value', m='baseline_mean', sd='baseline_std')} AS z FROM j)
SELECT event_id, event_type, calculation_timestamp, baseline_mean, baseline_std, sample_size,
       CASE WHEN baseline_mean IS NOT NULL THEN CAST(z AS DECIMAL(10,4)) END AS signed_z,
       COALESCE(baseline_mean IS NOT NULL AND abs(z) > 3.0, FALSE) AS is_anomaly,
       CASE WHEN baseline_mean IS NULL THEN 'skipped_no_baseline' ELSE 'evaluated' END AS status
FROM z
"""

SQL["smoothed_series"] = """
WITH RECURSIVE s AS (SELECT event_type, date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS i FROM s),
r AS (SELECT event_type, bucket, value, i, value AS sm FROM n WHERE i = 1
      UNION ALL
      SELECT n.event_type, n.bucket, n.value, n.i, 0.1 * n.value + 0.9 * r.sm FROM r JOIN n ON n.event_type = r.event_type AND n.i = r.i + 1)
SELECT event_type, 'hourly_ingestion_rate' AS metric_name, bucket, value, CAST(sm AS DECIMAL(15,4)) AS smoothed_value FROM r
"""

SQL["incremental_baseline"] = """
WITH s AS (SELECT event_type, date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value FROM events
           WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2)
SELECT event_type, 'hourly_ingestion_rate' AS metric_name, CAST(AVG(value) AS DECIMAL(15,4)) AS mean_value,
       CAST(COALESCE(STDDEV_SAMP(value), 0.0) AS DECIMAL(15,4)) AS std_deviation, CAST(COUNT(*) AS INTEGER) AS sample_size,
       CAST(COUNT(DISTINCT CAST(bucket AS DATE)) AS INTEGER) AS days, TIMESTAMP '2024-01-31 00:00:00' AS calculation_timestamp
FROM s GROUP BY event_type
"""

SQL["alert_backoff"] = f"""
WITH RECURSIVE {_AL},
p AS (SELECT alert_type, source_table, alert_timestamp AS t, MIN(event_id) AS event_id FROM al GROUP BY 1, 2, 3),
c AS (SELECT alert_type, source_table, MIN(t) AS t, 0 AS level FROM p GROUP BY 1, 2
      UNION ALL
      SELECT alert_type, source_table, nt, CASE WHEN nt >= t + INTERVAL 720 MINUTE THEN 0 ELSE least(level + 1, 4) END
      FROM (SELECT c.alert_type, c.source_table, c.t, c.level, MIN(p.t) AS nt
            FROM c JOIN p ON p.alert_type = c.alert_type AND p.source_table = c.source_table
                         AND p.t >= c.t + to_minutes(CAST(30 * pow(2, c.level) AS BIGINT)) GROUP BY 1, 2, 3, 4))
SELECT p.event_id, alert_type, source_table, t AS alert_timestamp, CAST(level AS INTEGER) AS backoff_level, 30.0 * pow(2, level) AS wait_minutes
FROM c JOIN p USING (alert_type, source_table, t)
"""

SQL["retention_store"] = f"""
WITH {_AL}
SELECT CAST(alert_timestamp AS DATE) AS alert_date, alert_type, COUNT(DISTINCT alert_timestamp) AS alerts,
       MIN(alert_timestamp) AS first_alert, MAX(alert_timestamp) AS last_alert
FROM al WHERE alert_timestamp >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1, 2
"""

_GAPS = """g AS (SELECT event_type, ts, LEAD(ts) OVER (PARTITION BY event_type ORDER BY ts) AS next_ts FROM events)"""

SQL["stream_silent_sources"] = f"""
WITH {_GAPS},
w AS (SELECT epoch_ms(MAX(ts)) - 600000 AS w FROM events),
r AS (SELECT event_type, ts, next_ts, k, ts + to_minutes(CAST(15 * pow(2, k) AS BIGINT)) AS due
      FROM g, (SELECT unnest([0, 1, 2]) AS k))
SELECT event_type, ts AS silent_since, due AS alert_timestamp, CAST(k AS INTEGER) AS reminder
FROM r, w WHERE (next_ts IS NULL OR next_ts > due) AND epoch_ms(due) + 1 <= w
"""

SQL["stream_outages"] = f"""
WITH b AS (SELECT event_type, ts, LAG(ts) OVER (PARTITION BY event_type ORDER BY ts) AS prev_ts FROM events),
s AS (SELECT *, SUM(CASE WHEN prev_ts IS NULL OR ts >= prev_ts + INTERVAL 15 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM b)
SELECT event_type, MIN(ts) AS first_event, MAX(ts) AS last_event, COUNT(*) AS row_count FROM s GROUP BY event_type, sid
HAVING MAX(ts) + INTERVAL 15 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 60 MINUTE
"""

SQL["stream_volume_scores"] = f"""
WITH w AS (SELECT event_type, date_trunc('hour', ts) - to_hours(k) AS window_start, COUNT(*) AS row_count
           FROM events, (SELECT unnest(range(0, 6)) AS k) GROUP BY 1, 2),
e AS (SELECT *, window_start + INTERVAL 6 HOUR AS window_end FROM w),
c AS (SELECT *, CASE WHEN window_end <= (SELECT MAX(ts) FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00') - INTERVAL 1 HOUR
                     THEN TIMESTAMP '2024-01-08 00:00:00' ELSE TIMESTAMP '2024-01-16 00:00:00' END AS calculation_timestamp
      FROM e WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR),
t AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS b, ts FROM events),
v AS (SELECT event_type, u.u AS calculation_timestamp, CAST(AVG(n) AS DECIMAL(15,4)) AS mean_value,
             CAST(COALESCE(STDDEV_SAMP(n), 0.0) AS DECIMAL(15,4)) AS std_deviation
      FROM (SELECT event_type, u.u, b, CAST(COUNT(*) AS DOUBLE) AS n
            FROM t, (SELECT unnest([TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-16 00:00:00']) AS u) u
            WHERE ts < u.u GROUP BY 1, 2, 3) u GROUP BY 1, 2),
z AS (SELECT c.*, v.mean_value, v.std_deviation, {_Z.format(v='row_count', m='v.mean_value', sd='v.std_deviation')} AS z
      FROM c LEFT JOIN v USING (event_type, calculation_timestamp))
SELECT event_type, window_start, window_end, row_count, mean_value, std_deviation, calculation_timestamp,
       CAST(z AS DECIMAL(10,4)) AS signed_z, COALESCE(abs(z) > 3.0, FALSE) AS is_anomaly
FROM z
"""

SQL["stream_store_replay"] = f"""
WITH {_AL},
l AS (SELECT event_type, date_trunc('hour', ts) AS b FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00')
SELECT CAST(alert_timestamp AS DATE) AS alert_date, alert_type, COUNT(DISTINCT alert_timestamp) AS alerts FROM al GROUP BY 1, 2
UNION ALL
SELECT CAST(MAX(b) AS DATE), 'baseline hourly:' || event_type, COUNT(DISTINCT b) FROM l GROUP BY event_type
"""

SQL["stream_json_contract"] = SQL["contract_quarantine"]

SQL["robust_baseline"] = """
WITH s AS (SELECT event_type, date_trunc('hour', ts) AS bucket, CAST(COUNT(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)
SELECT event_type, 'hourly_ingestion_rate' AS metric_name, CAST(median(value) AS DECIMAL(15,4)) AS median_value,
       CAST(mad(value) AS DECIMAL(15,4)) AS mad_value, CAST(mad(value) * 1.4826 AS DECIMAL(15,4)) AS robust_std,
       CAST(COUNT(*) AS INTEGER) AS sample_size
FROM s GROUP BY event_type
"""

SQL["clipped_baseline"] = """
WITH RECURSIVE s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS bucket, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value
                     FROM orders GROUP BY 1, 2),
r AS (SELECT o_orderpriority, 0 AS round, AVG(value) AS m, COALESCE(STDDEV_SAMP(value), 0.0) AS sd, COUNT(*) AS n, COUNT(*) AS raw, CAST(-1 AS BIGINT) AS was,
             CAST('-inf' AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi FROM s GROUP BY 1
      UNION ALL
      SELECT o_orderpriority, round + 1, AVG(value), COALESCE(STDDEV_SAMP(value), 0.0), COUNT(*), raw, n,
             lo2, hi2
      FROM (SELECT r.o_orderpriority, r.round, r.raw, r.n, s.value, greatest(r.lo, r.m - 2.0 * r.sd) AS lo2, least(r.hi, r.m + 2.0 * r.sd) AS hi2
            FROM r JOIN s USING (o_orderpriority) WHERE r.n <> r.was AND r.round < 100)
      WHERE value BETWEEN lo2 AND hi2 GROUP BY o_orderpriority, round, raw, n, lo2, hi2),
l AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round DESC) AS k FROM r)
SELECT o_orderpriority, CAST(m AS DECIMAL(15,4)) AS mean_value, CAST(sd AS DECIMAL(15,4)) AS std_deviation, CAST(n AS INTEGER) AS sample_size,
       CAST(raw - n AS INTEGER) AS rejected, CAST(round - 1 AS INTEGER) AS rounds
FROM l WHERE k = 1
"""

SQL["value_quantiles"] = """
SELECT event_type, p AS probability, COUNT(value) AS n, TRUE AS within_error
FROM events, (SELECT unnest([CAST(0.05 AS DOUBLE), 0.25, 0.5, 0.75, 0.95]) AS p)
WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' AND value IS NOT NULL GROUP BY 1, 2
"""

_PATHS = """
e AS (SELECT event_id, ts >= TIMESTAMP '2024-01-16 00:00:00' AS late, value, props FROM events),
p AS (SELECT late, unnest(list_concat(
        ['$:OBJECT', '$.user:OBJECT', '$.user.id:BIGINT', '$.user.type:STRING', '$.props:OBJECT', '$.props.k:BIGINT',
         CASE WHEN value IS NULL THEN '$.cents:VOID' WHEN late THEN '$.cents:STRING' ELSE '$.cents:BIGINT' END],
        CASE WHEN late THEN ['$.tags:ARRAY', '$.tags[*]:OBJECT', '$.tags[*].k:BIGINT', '$.tags[*]:VOID'] ELSE ['$.trace:BOOLEAN'] END)) AS pt FROM e),
c AS (SELECT late, string_split(pt, ':')[1] AS path, string_split(pt, ':')[2] AS type, COUNT(*) AS n FROM p GROUP BY 1, 2, 3)"""

SQL["json_path_types"] = f"""
WITH {_PATHS}
SELECT path, type, CAST(SUM(n) AS BIGINT) AS occurrences, CAST(SUM(n) AS BIGINT) AS records FROM c GROUP BY 1, 2
"""

SQL["json_type_drift"] = f"""
WITH {_PATHS},
t AS (SELECT late, COUNT(*) AS n FROM e GROUP BY 1),
s AS (SELECT path, type, COALESCE(SUM(c.n / t.n) FILTER (NOT late), 0.0) AS o, COALESCE(SUM(c.n / t.n) FILTER (late), 0.0) AS w
      FROM c JOIN t USING (late) GROUP BY 1, 2),
x AS (SELECT *, SUM(o) OVER (PARTITION BY path) AS po, SUM(w) OVER (PARTITION BY path) AS pw FROM s)
SELECT path, type, round(o, 9) AS old_share, round(w, 9) AS new_share,
       CASE WHEN po = 0 THEN 'NEW_FIELD' WHEN pw = 0 THEN 'LOST_FIELD' WHEN o = 0 THEN 'NEW_TYPE' WHEN w = 0 THEN 'LOST_TYPE' ELSE 'SHARE' END AS change
FROM x WHERE abs(o - w) > 1e-9
"""

SQL["registry_alerts"] = """
WITH o AS (SELECT CAST(o_orderdate AS DATE) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM orders
           WHERE o_orderdate >= TIMESTAMP '2001-07-03 00:00:00' AND o_orderdate < TIMESTAMP '2001-08-02 00:00:00' GROUP BY 1),
p AS (SELECT CAST(o_orderdate AS DATE) AS b, AVG(o_totalprice) AS v FROM orders
      WHERE o_orderdate >= TIMESTAMP '2001-07-19 00:00:00' AND o_orderdate < TIMESTAMP '2001-08-02 00:00:00' GROUP BY 1),
e AS (SELECT date_trunc('hour', ts) AS b, CAST(COUNT(*) AS DOUBLE) AS v FROM events
      WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
s AS (SELECT 'orders' AS t, 'daily_row_count' AS m, 'WARNING' AS sev, b = DATE '2001-08-01' AS cur, CAST(b AS TIMESTAMP) AS b, v FROM o
      UNION ALL SELECT 'orders', 'avg_order_value', 'CRITICAL', b = DATE '2001-08-01', CAST(b AS TIMESTAMP), v FROM p
      UNION ALL SELECT 'events', 'hourly_ingestion_rate', 'CRITICAL', b = TIMESTAMP '2024-01-30 23:00:00', b, v FROM e),
g AS (SELECT t, m, sev, CAST(MAX(v) FILTER (cur) AS DECIMAL(15,4)) AS cv, MAX(v) FILTER (cur) AS raw, MAX(b) FILTER (cur) AS b,
             CAST(AVG(v) FILTER (NOT cur) AS DECIMAL(15,4)) AS mean, CAST(COALESCE(STDDEV_SAMP(v) FILTER (NOT cur), 0.0) AS DECIMAL(15,4)) AS sd,
             CAST(COUNT(*) FILTER (NOT cur) AS INTEGER) AS n FROM s GROUP BY 1, 2, 3),
f AS (SELECT MAX(ts) AS ts, CAST(date_diff('microsecond', MAX(ts), TIMESTAMP '2024-01-31 00:00:00') AS DOUBLE) / 6.0e7 AS mins FROM events)
SELECT 'VOLUME_ANOMALY' AS alert_type, t AS source_table, m AS field_name, sev AS alert_severity, TIMESTAMP '2024-01-31 00:00:00' AS alert_timestamp,
       CAST(cv AS DOUBLE) AS metric_value, CAST(cv AS DOUBLE) AS details_current_value, CAST(mean AS DOUBLE) AS details_baseline_mean,
       n AS details_sample_size, strftime(b, '%Y-%m-%d %H:%M:%S') AS details_bucket, NULL AS details_latest_timestamp
FROM g WHERE raw IS NOT NULL AND n > 0 AND sd > 0 AND abs((raw - CAST(mean AS DOUBLE)) / CAST(sd AS DOUBLE)) > 0.25
UNION ALL
SELECT 'STALE_DATA_FLOW', 'events', NULL, 'CRITICAL', TIMESTAMP '2024-01-31 00:00:00', CAST(CAST(mins AS DECIMAL(15,4)) AS DOUBLE), NULL, NULL, NULL, NULL,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') FROM f WHERE mins > 1.0
"""

SQL["registry_contract_summary"] = """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS st FROM orders),
c AS (SELECT k,
        CASE WHEN k % 79 = 0 THEN 1 ELSE 0 END AS missing,
        CASE WHEN k % 79 <> 0 AND CASE WHEN k % 71 = 0 THEN length('ORD ' || k) WHEN k % 67 = 0 THEN 0 ELSE length('ORD-' || k) END > 10 THEN 1 ELSE 0 END AS long_key,
        CASE WHEN k % 7 = 0 OR k % 7 > 5 THEN 1 ELSE 0 END AS quantity,
        CASE WHEN st NOT IN ('F', 'O') THEN 1 ELSE 0 END AS status FROM r)
SELECT COUNT(*) AS total_records, CAST(SUM(CASE WHEN missing + long_key + quantity + status = 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid_records,
       CAST(SUM(CASE WHEN missing + long_key + quantity + status > 0 THEN 1 ELSE 0 END) AS BIGINT) AS invalid_records,
       CAST(SUM(missing + long_key + quantity + status) AS BIGINT) AS total_violations,
       CAST(SUM(missing + quantity + status) AS BIGINT) AS critical_violations
FROM c
"""

SQL["source_ranges"] = """
SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS part, TRUE AS even, TRUE AS read, (SELECT COUNT(*) FROM orders) AS all_rows
"""

SQL["json_large_lists"] = SQL["contract_summary"]
