"""How the driver's test tables stand in for the monitored sources.

* ``orders`` plays the batch fact table: ``o_orderdate`` is the order
  timestamp, ``o_totalprice`` the order amount.
* ``events`` plays the CDC history table: ``ts`` is both ``created_at`` and
  ``cdc_timestamp``; ``event_type`` is the source / operation key.

Fixed values: the as-of instants used by the registered queries (one after the
last row of each table, the same at every scale factor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relmon.specs import SourceSpec

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

BATCH_DB = "batch_analytics_db"
CDC_DB = "cdc_history_db"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def events_spec(sf_dir: str) -> SourceSpec:
    return SourceSpec(name="events", path=table_path(sf_dir, "events"), time_column="ts", database=CDC_DB)


def orders_spec(sf_dir: str) -> SourceSpec:
    return SourceSpec(name="orders", path=table_path(sf_dir, "orders"), time_column="o_orderdate",
                      database=BATCH_DB)


def cdc_payloads(orders: DataFrame, partitions: int | None = None) -> DataFrame:
    """CDC JSON payloads derived from every order, with faults planted by key
    arithmetic so that each violation kind occurs at every scale:

    * key % 79 == 0: ``order_key`` absent            -> MISSING_REQUIRED_FIELD
    * key % 71 == 0: ``order_key`` with a blank       -> pattern
    * key % 67 == 0: ``order_key`` empty              -> length + pattern
    * key % 97 == 0: ``total_amount`` as text         -> TYPE_MISMATCH
    * key % 89 == 0: ``total_amount`` null            -> NULLABILITY_VIOLATION
    * key % 73 == 0: ``customer_id`` as "CUST-n"      -> TYPE_MISMATCH
    * ``quantity`` = key % 7 (0 is below minimum 1)
    * ``unit_price`` = price / 7 cut to 3 decimals    -> precision
    * status P -> "processing" (not an allowed value)
    * key % 83 == 0: extra ``legacy_flag``            -> UNEXPECTED_FIELD

    Output: record_id (the order key), raw JSON text, parsed record, keys in
    source order.  Every order yields exactly one record.
    """
    from pyspark.sql import functions as F

    from relmon.session import spread
    orders = spread(orders, partitions)
    k = F.col("o_orderkey")

    def s(x):
        return F.concat(F.lit('"'), x, F.lit('"'))

    def kv(name, val):
        return F.concat(F.lit(f'"{name}":'), val)

    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    order_key = (F.when(k % 79 == 0, F.lit(None))
                  .when(k % 71 == 0, kv("order_key", s(F.concat(F.lit("ORD "), k.cast("string")))))
                  .when(k % 67 == 0, kv("order_key", F.lit('""')))
                  .otherwise(kv("order_key", s(F.concat(F.lit("ORD-"), k.cast("string"))))))
    total = (F.when(k % 97 == 0, kv("total_amount", s(price)))
              .when(k % 89 == 0, kv("total_amount", F.lit("null")))
              .otherwise(kv("total_amount", price)))
    cust = (F.when(k % 73 == 0, kv("customer_id", s(F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")))))
             .otherwise(kv("customer_id", F.col("o_custkey").cast("string"))))
    qty = kv("quantity", (k % 7).cast("string"))
    # price / 7 cut to 3 decimals, in integer arithmetic (exact in any engine)
    milli = F.expr("cast(round(o_totalprice * 100) as bigint) * 10 div 7")
    unit = kv("unit_price", (milli.cast("decimal(18,0)") / F.lit(1000)).cast("decimal(18,3)").cast("string"))
    status = kv("order_status", s(F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
                                  .when(F.col("o_orderstatus") == "O", F.lit("pending"))
                                  .otherwise(F.lit("processing"))))
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    odate = kv("order_date", s(iso))
    op = kv("cdc_operation", F.lit('"INSERT"'))
    cts = kv("cdc_timestamp", s(iso))
    extra = F.when(k % 83 == 0, kv("legacy_flag", F.lit("true")))
    raw = F.concat(F.lit("{"), F.concat_ws(",", order_key, total, cust, qty, unit, status, odate, op, cts, extra),
                   F.lit("}"))
    return orders.select(k.alias("record_id"), raw.alias("raw")).select(
        "record_id", "raw", F.parse_json("raw").alias("record"), F.json_object_keys("raw").alias("record_keys"))


def alert_store(events: DataFrame) -> DataFrame:
    """An alert history derived from events: every event whose value exceeds
    200 is an alert; its type follows the event type (error -> volume,
    view -> staleness, click -> contract, others -> OTHER) and it is
    CRITICAL above 300, else WARNING.  Keeps ``event_id`` as a tie-break."""
    from pyspark.sql import functions as F

    from relmon.operators.alerts import ALERT_COLUMNS, _alert_row
    e = events.filter(F.col("value") > 200)
    et = F.col("event_type")
    atype = (F.when(et == "error", "VOLUME_ANOMALY").when(et == "view", "STALE_DATA_FLOW")
              .when(et == "click", "CONTRACT_VIOLATION").otherwise("OTHER"))
    sev = F.when(F.col("value") > 300, "CRITICAL").otherwise("WARNING")
    rows = _alert_row(atype, sev, F.concat(F.lit("event "), F.col("event_id").cast("string")), "events",
                      F.col("ts"), metric_value=F.col("value"))
    return e.select(*rows, "event_id").select(*ALERT_COLUMNS, "event_id")


def nested_records(events: DataFrame) -> DataFrame:
    """Event records as nested JSON, one per event, whose types change in time:
    ``value`` is a text and ``trace`` is missing from 2024-01-16 on, ``tags`` (an array
    of objects) is new then.  Output: event_id, ts, record."""
    from pyspark.sql import functions as F
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    user = F.concat(F.lit('{"id":'), F.col("user_id").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    value = F.when(late, F.concat(F.lit('"'), cents, F.lit('"'))).otherwise(cents)
    tags = F.concat(F.lit('[{"k":'), F.col("event_id").cast("string"), F.lit("},null]"))
    raw = F.concat(F.lit('{"user":'), user, F.lit(',"cents":'), F.coalesce(value, F.lit("null")), F.lit(',"props":'), F.coalesce("props", F.lit("null")),
                   F.when(late, F.concat(F.lit(',"tags":'), tags)).otherwise(F.lit(',"trace":true')), F.lit("}"))
    return events.select("event_id", "ts", F.try_parse_json(raw).alias("record"))
