import json
import os

import pytest
from pyspark.sql import functions as F

from relmon.operators import contract as C
from relmon.plans.contracts import cdc_contract
from relmon.sources.logs import load_json_logs, table_records
from relmon.specs import contract_from_dict


def _records(spark, objs):
    raws = [(i, json.dumps(o)) for i, o in enumerate(objs)]
    df = spark.createDataFrame(raws, "record_id long, raw string")
    return df.select("record_id", F.parse_json("raw").alias("record"), F.json_object_keys("raw").alias("record_keys"))


def _validate(spark, objs, contract=None):
    v = C.validate_variant(_records(spark, objs), contract or cdc_contract(), keys_col="record_keys")
    rows = C.violation_rows(v, ["record_id"]).orderBy("record_id", "violation_pos").collect()
    return v, rows


BASE = {"order_key": "ORDER-003", "customer_id": 1, "product_id": 2, "quantity": 3, "unit_price": 15.99,
        "total_amount": 47.97, "order_status": "completed", "order_date": "2024-01-15T10:00:00",
        "cdc_operation": "INSERT", "cdc_timestamp": "2024-01-15T10:00:00"}


def test_chaos_records(spark):
    # fixed values: records whose verdicts must be the same
    recs = [dict(BASE, order_key="ORDER-001", total_amount="ONE HUNDRED"),
            dict(BASE, order_key=12345, total_amount="NINETY-NINE"),
            dict(BASE)]
    v, rows = _validate(spark, recs)
    s = C.summary(v).first()
    assert (s.total_records, s.valid_records, s.invalid_records, s.total_violations) == (3, 1, 2, 3)
    assert s.critical_violations == 3
    assert [r.violation_type for r in rows] == ["TYPE_MISMATCH"] * 3
    assert rows[0].errors == ["Field 'total_amount' type mismatch: expected float, got str"]
    assert (rows[1].field_name, rows[1].actual_type) == ("order_key", "int")


def test_sample_log_shape(spark):
    recs = [dict(BASE, customer_id=f"CUST-{i}", product_id=f"PROD-{i}") for i in range(5)]
    recs[4]["order_status"] = "processing"
    v, rows = _validate(spark, recs)
    s = C.summary(v).first()
    assert (s.valid_records, s.invalid_records, s.total_violations) == (0, 5, 11)
    st = [r for r in rows if r.field_name == "order_status"][0]
    assert st.violation_type == "TYPE_MISMATCH" and st.constraint_kind == "allowed_values"
    assert st.errors == ["Field 'order_status' value 'processing' not in allowed values: "
                         "['pending', 'completed', 'shipped', 'cancelled', 'refunded']"]


@pytest.mark.parametrize("patch,expect", [
    ({"total_amount": 100}, [("total_amount", "TYPE_MISMATCH", "type")]),
    ({"total_amount": 100.0}, []),
    ({"total_amount": 1.234}, [("total_amount", "TYPE_MISMATCH", "precision")]),
    ({"quantity": True}, []),
    ({"order_key": None}, [("order_key", "NULLABILITY_VIOLATION", "nullability")]),
    ({"foo": 1}, [("foo", "UNEXPECTED_FIELD", "unexpected")]),
    ({"order_key": ""}, [("order_key", "CONSTRAINT_VIOLATION", "min_length")]),
    ({"quantity": 0}, [("quantity", "TYPE_MISMATCH", "min_value")]),
    ({"total_amount": 1e7}, [("total_amount", "TYPE_MISMATCH", "max_value")]),
])
def test_edge_rows(spark, patch, expect):
    _, rows = _validate(spark, [dict(BASE, **patch)])
    assert [(r.field_name, r.violation_type, r.constraint_kind) for r in rows] == expect


def test_missing_and_order(spark):
    rec = {k: v for k, v in BASE.items() if k != "order_key"}
    rec = {"zz_new": 1, **rec}
    _, rows = _validate(spark, [rec])
    assert [(r.violation_pos, r.field_name, r.violation_type) for r in rows] == [
        (0, "order_key", "MISSING_REQUIRED_FIELD"), (1, "zz_new", "UNEXPECTED_FIELD")]
    assert rows[0].errors == ["Required field 'order_key' is missing"]


def test_empty_key_has_two_errors(spark):
    _, rows = _validate(spark, [dict(BASE, order_key="")])
    assert rows[0].error_kinds == "min_length,pattern" and len(rows[0].errors) == 2


def test_flat_dialect(spark):
    c = contract_from_dict({"fields": {
        "order_key": {"type": "String", "required": True, "max_length": 50},
        "total_amount": {"type": "Float", "required": True, "min_value": 0.0},
        "quantity": {"type": "Integer", "required": True, "min_value": 1}}})
    # fixed values: records of the flat dialect
    recs = [{"order_key": "ORD-123", "total_amount": 99.99, "quantity": 2},
            {"order_key": "X" * 69, "total_amount": 99.99, "quantity": 2},
            {"order_key": "ORD-123", "total_amount": -10.0, "quantity": 2},
            {"order_key": "ORD-123", "total_amount": 99.99, "quantity": 0}]
    v, rows = _validate(spark, recs, c)
    per = {}
    for r in rows:
        per.setdefault(r.record_id, []).append(r.violation_type)
    assert per == {1: ["CONSTRAINT_VIOLATION"], 2: ["TYPE_MISMATCH"], 3: ["TYPE_MISMATCH"]}


def test_json_log_directory(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "a.json"), "w") as fh:
        json.dump([dict(BASE), dict(BASE, total_amount="x")], fh)
    with open(os.path.join(tmpdir_path, "b.json"), "w") as fh:
        json.dump(dict(BASE), fh)
    with open(os.path.join(tmpdir_path, "c.json"), "w") as fh:
        fh.write("{not json")
    logs = load_json_logs(spark, tmpdir_path)
    assert logs.count() == 4
    assert logs.filter("parse_error").count() == 1
    ok = logs.filter(~F.col("parse_error"))
    v = C.validate_variant(ok, cdc_contract(), keys_col="record_keys")
    assert v.filter(~F.col("is_valid")).count() == 1
    assert load_json_logs(spark, tmpdir_path, first_files=1).count() == 2
    assert load_json_logs(spark, os.path.join(tmpdir_path, "missing")).count() == 0


def test_typed_table_and_drift(spark):
    df = spark.createDataFrame([(1, 10.5, "completed"), (2, 20.0, "lost")],
                               "order_key long, total_amount double, order_status string")
    drift = {r.field_name: r for r in C.schema_drift(df, cdc_contract()).collect()}
    assert drift["order_key"].violation_type == "TYPE_MISMATCH" and drift["order_key"].actual_type == "int"
    assert drift["order_key"].affected_rows == 2
    v = C.validate_typed(df, cdc_contract())
    bad = v.filter(~F.col("is_valid")).select("order_key").collect()
    assert [r.order_key for r in bad] == [2]
    rec = table_records(df, ["order_key", "total_amount", "order_status"], ["order_key"])
    v2 = C.validate_variant(rec.withColumnRenamed("order_key", "rid"), cdc_contract(), keys_col="record_keys")
    assert v2.filter(~F.col("is_valid")).count() == 2   # integer key vs string contract, every row


def test_no_python_udf_in_plan(spark):
    v = C.validate_variant(_records(spark, [BASE]), cdc_contract(), keys_col="record_keys")
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_lenient_coercion(spark):
    import dataclasses
    lenient = dataclasses.replace(cdc_contract(), coerce_types=True)
    _, strict_rows = _validate(spark, [dict(BASE, customer_id="12", total_amount="47.5")])
    _, lenient_rows = _validate(spark, [dict(BASE, customer_id="12", total_amount="47.5")], lenient)
    assert len(strict_rows) == 2 and lenient_rows == []


def test_metric_csv_and_specs(spark, tmpdir_path):
    from relmon.operators import profile as P
    from relmon.sources.logs import load_metric_csv
    from relmon.specs import metrics_from_dict
    path = os.path.join(tmpdir_path, "m.csv")
    with open(path, "w") as fh:
        fh.write("order_date,daily_orders,daily_revenue,avg_order_value\n")
        for d, n in zip(range(1, 11), [100, 102, 98, 101, 99, 100, 103, 97, 100, 10]):
            fh.write(f"2024-01-{d:02d},{n},{n * 10}.50,10.05\n")
    s = load_metric_csv(spark, path)
    assert s.count() == 30
    b = {r.metric_name: r for r in P.baselines(s).collect()}
    assert b["daily_orders"].sample_size == 10
    specs = metrics_from_dict({"db": {"tables": [{"name": "fact_orders", "metrics": [
        {"name": "daily_order_count", "type": "volume", "threshold": 3.0, "window_days": 30},
        {"name": "daily_revenue", "type": "volume", "threshold": 2.5, "window_days": 30}]}]}})
    assert [m.threshold for m in specs["fact_orders"]] == [3.0, 2.5]


def test_sampling_methods(spark):
    import datetime as dt

    from relmon.sources.logs import newest, sample_records
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, base + dt.timedelta(minutes=i % 50)) for i in range(200)],
                               "k long, ts timestamp_ntz")
    top = newest(df, "ts", 5, ["k"]).collect()
    assert [r.k for r in top] == [199, 149, 99, 49, 198]
    assert sample_records(df, "sequential", 3, order_cols=["k"]).count() == 3
    r1 = sorted(r.k for r in sample_records(df, "random", 10, order_cols=["k"]).collect())
    r2 = sorted(r.k for r in sample_records(df, "random", 10, order_cols=["k"]).collect())
    assert r1 == r2 and len(r1) == 10
    assert sample_records(df, "latest", None, "ts").count() == 200


def _plan(spark, df):
    key = "spark.sql.debug.maxToStringFields"
    was = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(key, was)


@pytest.mark.parametrize("layout", ["document", "lines"])
def test_logs_are_parsed_once(spark, tmpdir_path, layout):
    spark.createDataFrame([('{"order_key": "a"}',), ("nope",)], "value string").coalesce(1).write.text(f"{tmpdir_path}/logs")
    logs = load_json_logs(spark, f"{tmpdir_path}/logs", layout=layout, pattern="part-*").filter(~F.col("parse_error"))
    plan = _plan(spark, logs)
    assert plan.count("parseJson(") == 1 and "schemaOfVariant" not in plan


def test_only_objects_are_records(spark):
    from relmon.sources.logs import _finish
    raws = ['{"a": 1}', ' \t\r\n{"a": [1, {"b": null}]} ', "{}", "[]", '[{"a": 1}]', "1", "-2.5", "true", "null", '"{x}"', "", " ", "{", '{"a": 1',
            '{"a": 1} x', "\ufeff{}", "\x0b{}", "\u00a0{}", "/* c */ {}", "{'a': 1}", "nope", None, '{"a": 1, "a": 2}']
    d = spark.createDataFrame([("f", i, r) for i, r in enumerate(raws)], "source_file string, record_index long, raw string")
    p = F.try_parse_json("raw")
    plain = d.select(F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False)).alias("ok"), "record_index", F.to_json(p).alias("text"))
    want = {r.record_index: (not r.ok, r.text if r.ok else None) for r in plain.collect()}
    got = _finish(d).select("record_index", "parse_error", F.to_json("record").alias("text"), "record_keys").collect()
    assert {r.record_index: (r.parse_error, r.text) for r in got} == want and len(got) == len(raws)
    assert all((r.record_keys is None) == r.parse_error for r in got)


def test_contract_stages_stay_within_the_jit_limit(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(key)
    try:
        for limit, kept in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(key, limit)
            C.validate_variant(_records(spark, [BASE]), cdc_contract(), keys_col="record_keys")
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, was)


def test_type_name_and_json_text_are_made_once(spark):
    plan = _plan(spark, C.validate_variant(_records(spark, [BASE]), cdc_contract(), keys_col="record_keys"))
    assert plan.count("^DECIMAL") == len(cdc_contract().fields)


def test_union_sources_spreads_few_splits(spark, tmpdir_path):
    from relmon.plans.queries import QUERIES
    spark.sql("SELECT 1L o_orderkey, 2L o_custkey, 'F' o_orderstatus, 9.5D o_totalprice, TIMESTAMP_NTZ'2000-01-01 00:00:00' o_orderdate, '1-URGENT' o_orderpriority").write.parquet(f"{tmpdir_path}/orders.parquet")
    spark.sql("SELECT 1L event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' ts, 3L user_id, 'view' event_type, 1.5D value, '{}' props").write.parquet(f"{tmpdir_path}/events.parquet")
    df = QUERIES["union_sources"](spark, tmpdir_path)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2
    assert {r.record_source: r.total_records for r in df.collect()} == {"database": 1, "json_logs": 1}
