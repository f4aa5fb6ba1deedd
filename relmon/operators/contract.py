"""Data contracts compiled into Column expressions.

A contract (see :mod:`relmon.specs`) is turned, on the driver, into one
projection per record: no Python UDF, no shuffle, no per-record Python.  The
same field rules serve two input shapes:

* **variant records** (JSON logs, CDC payloads): one ``VARIANT`` column per
  record, because the type of a field can differ row by row.  Types are read
  from the variant itself (``schema_of_variant``), so a JSON ``100`` is an
  integer and ``100.0`` a float, and a JSON null is told apart from an absent
  key (``is_variant_null`` vs SQL NULL).
* **typed tables**: ordinary columns.  The runtime type of a column is the
  same for every row, so a column whose type contradicts the contract is a
  *table-level* finding (:func:`schema_drift`, one row per field with the
  number of affected rows) rather than one violation per row.

Output of :func:`validate`: the input columns plus ``violations`` (ARRAY of
STRUCT) and ``is_valid``.  Violations of one record keep the source order:
missing required fields first, then the record's own fields in key order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relmon.session import ensure_jit, spread
from relmon.sources.logs import iso_text
from relmon.specs import Contract, FieldRule

# Violation labels.
MISSING = "MISSING_REQUIRED_FIELD"
TYPE_MISMATCH = "TYPE_MISMATCH"
NULLABILITY = "NULLABILITY_VIOLATION"
CONSTRAINT = "CONSTRAINT_VIOLATION"
UNEXPECTED = "UNEXPECTED_FIELD"
CRITICAL_TYPES = (TYPE_MISMATCH, MISSING)

# Validation messages (their text decides the violation label,
# so it must read exactly like this).  {name}, {expected}, {limit},
# {pattern} and {allowed} come from the contract; {actual}, {length},
# {value} and {digits} from the record.
MSG_NOT_NULLABLE = "Field '{name}' is not nullable but value is null"
MSG_TYPE_MISMATCH = "Field '{name}' type mismatch: expected {expected}, got {actual}"
MSG_MIN_LENGTH = "Field '{name}' length {length} below minimum {limit}"
MSG_MAX_LENGTH = "Field '{name}' length {length} above maximum {limit}"
MSG_PATTERN = "Field '{name}' value '{value}' does not match pattern '{pattern}'"
MSG_ALLOWED = "Field '{name}' value '{value}' not in allowed values: {allowed}"
MSG_MIN_VALUE = "Field '{name}' value {value} below minimum {limit}"
MSG_MAX_VALUE = "Field '{name}' value {value} above maximum {limit}"
MSG_PRECISION = "Field '{name}' precision {digits} exceeds maximum {limit}"
MSG_MISSING = "Required field '{name}' is missing"
MSG_UNEXPECTED = "Unexpected field '{name}' not defined in contract"

VIOLATION_TYPE = T.StructType([
    T.StructField("key_position", T.IntegerType()),   # sort key: order inside the record
    T.StructField("field_name", T.StringType()),
    T.StructField("violation_type", T.StringType()),
    T.StructField("constraint_kind", T.StringType()),
    T.StructField("error_kinds", T.StringType()),
    T.StructField("expected_type", T.StringType()),
    T.StructField("actual_type", T.StringType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
])

# Python runtime type names that satisfy each contract type ("bool" is an
# int subclass, so booleans pass an integer field).
_ACCEPTS = {
    "str": ("str",),
    "int": ("int", "bool"),
    "float": ("float",),
    "bool": ("bool",),
    "list": ("list",),
    "dict": ("dict",),
}


@dataclass
class FieldView:
    """Per-record view of one field, independent of the input shape."""
    present: Column      # key exists in the record
    is_null: Column      # present with a null value
    pytype: Column       # runtime type name (str/int/float/bool/list/dict/...)
    text: Column         # string value (string fields)
    number: Column       # numeric value as double (numeric fields)
    repr: Column         # the value as Python prints it in a message


def _q(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _path(name: str) -> str:
    return "$['" + _q(name) + "']"


def _lit(s: str) -> Column:
    return F.lit(s)


def _render(template: str, **parts) -> Column:
    """A message template as one ``concat``: driver-side parts become
    literals, per-record parts stay Columns."""
    cols = []
    for piece in re.split(r"(\{\w+\})", template):
        m = re.fullmatch(r"\{(\w+)\}", piece)
        if m:
            v = parts[m.group(1)]
            cols.append(v if isinstance(v, Column) else F.lit(str(v)))
        elif piece:
            cols.append(F.lit(piece))
    return F.concat(*cols)


# ------------------------------------------------------------------ field views

def _variant_pytype(kind: Column) -> Column:
    return (F.when(kind.isNull(), F.lit(None))
            .when(kind == "STRING", F.lit("str"))
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
            .when(kind == "BOOLEAN", F.lit("bool"))
            # a JSON integer of more than 18 digits is parsed to a DECIMAL without scale
            .when(kind.endswith(",0)") & kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)$"), F.lit("int"))
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.lit("float"))
            .when(kind.startswith("ARRAY"), F.lit("list"))
            .when(kind.startswith("OBJECT"), F.lit("dict"))
            .when(kind == "VOID", F.lit("NoneType"))
            .when(kind.startswith("TIMESTAMP"), F.lit("datetime"))
            .when(kind == "DATE", F.lit("date"))
            .when(kind == "BINARY", F.lit("bytes"))
            .otherwise(F.lower(kind)))


def _float_repr(plain: Column) -> Column:
    """Python prints an integral float with a trailing '.0'."""
    return F.when(plain.contains(".") | plain.contains("E") | plain.contains("e"), plain).otherwise(
        F.concat(plain, F.lit(".0")))


def variant_field(v: Column, pytype: Column, js: Column) -> FieldView:
    """The view of a value, its type's name and its JSON text.  Typed extractions are guarded by the runtime type already read from
    the variant: a cast is only attempted where it succeeds (a failing
    ``try_variant_get`` goes through exception handling and is ~10x slower)."""
    num = pytype.isin("int", "float", "bool")
    repr_ = (F.when(pytype == "bool", F.when(F.variant_get(v, "$", "boolean"), F.lit("True"))
                    .otherwise(F.lit("False")))
             .when(pytype == "float", _float_repr(js))
             .when(pytype == "str", F.variant_get(v, "$", "string"))
             .otherwise(js))
    return FieldView(present=v.isNotNull(), is_null=F.is_variant_null(v), pytype=pytype,
                     text=F.when(pytype == "str", F.variant_get(v, "$", "string"))
                     .when(num, js),
                     number=F.when(num, F.try_variant_get(v, "$", "double")), repr=repr_)


def _static_pytype(dt: T.DataType) -> str:
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "str"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(dt, T.DecimalType):
        return "Decimal"
    # the DB loader turns timestamps and dates into ISO strings
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "str"
    if isinstance(dt, T.ArrayType):
        return "list"
    if isinstance(dt, (T.StructType, T.MapType)):
        return "dict"
    if isinstance(dt, T.BinaryType):
        return "bytes"
    return dt.simpleString()


def _plain_double(c: Column) -> Column:
    """A double printed like Python's repr for ordinary magnitudes: shortest
    round-trip digits, no exponent, at least one decimal place."""
    s = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"0+$", "")
    s = F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)
    return F.coalesce(s, c.cast("string"))


def typed_field(df: DataFrame, name: str) -> tuple[FieldView, str]:
    dt = df.schema[name].dataType
    c = F.col(f"`{name}`")
    pt = _static_pytype(dt)
    if pt == "float":
        repr_ = _plain_double(c)
    elif pt == "bool":
        repr_ = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        repr_ = iso_text(c)
    else:
        repr_ = c.cast("string")
    text = repr_ if isinstance(dt, (T.TimestampType, T.TimestampNTZType)) else c.cast("string")
    number = c.cast("double") if pt in ("int", "float", "bool", "Decimal") else F.lit(None).cast("double")
    return FieldView(present=F.lit(True), is_null=c.isNull(), pytype=F.lit(pt), text=text, number=number,
                     repr=repr_), pt


# ------------------------------------------------------------------ rules

def _num_text(x) -> str:
    return str(x)


def _empty_s() -> Column:
    return F.array().cast("array<string>")


def _one(cond: Column, val: Column) -> Column:
    """[val] when cond holds, else [] (plain CASE + array: no lambda)."""
    return F.when(cond, F.array(val)).otherwise(_empty_s())


def _errors_for(rule: FieldRule, fv: FieldView, contract: Contract) -> tuple[Column, Column, Column]:
    """(fails, messages, kinds) of one present field, in the order the rules are
    checked; both empty when the field is fine.  Built from ``concat`` of
    conditional one-element arrays so the whole rule set stays in generated
    code (no higher-order function)."""
    n = rule.name
    exp = rule.type
    t = rule.type_lower
    accepts = _ACCEPTS.get(rule.python_type, (rule.python_type,))
    type_ok = fv.pytype.isin(*accepts)
    if contract.coerce_types:
        # lenient mode: a value that converts to the declared type passes
        if rule.python_type in ("int", "float"):
            type_ok = type_ok | fv.number.isNotNull() | fv.text.try_cast("double").isNotNull()
        elif rule.python_type == "str":
            type_ok = type_ok | fv.pytype.isin("int", "float", "bool")
        elif rule.python_type == "bool":
            type_ok = type_ok | F.lower(fv.text).isin("true", "false")

    if not rule.nullable and contract.check_null_constraints:
        null_m = F.array(_render(MSG_NOT_NULLABLE, name=n))
        null_k = F.array(F.lit("nullability"))
    else:
        null_m = null_k = _empty_s()
    type_m = F.array(_render(MSG_TYPE_MISMATCH, name=n, expected=exp, actual=fv.pytype))
    type_k = F.array(F.lit("type"))

    cons = rule.constraints or {}
    checks: list[tuple[Column, str, Column]] = []
    if t == "string":
        ln = F.length(fv.text)
        if "min_length" in cons and contract.check_value_constraints:
            m = cons["min_length"]
            checks.append((ln < F.lit(m), "min_length",
                           _render(MSG_MIN_LENGTH, name=n, length=ln.cast("string"), limit=_num_text(m))))
        if "max_length" in cons and contract.check_value_constraints:
            m = cons["max_length"]
            checks.append((ln > F.lit(m), "max_length",
                           _render(MSG_MAX_LENGTH, name=n, length=ln.cast("string"), limit=_num_text(m))))
        if "pattern" in cons and contract.check_pattern_constraints:
            p = str(cons["pattern"])
            checks.append((~fv.text.rlike("^(?:" + p + ")"), "pattern",
                           _render(MSG_PATTERN, name=n, value=fv.text, pattern=p)))
        if "allowed_values" in cons and contract.check_value_constraints:
            allowed = list(cons["allowed_values"] or [])
            strs = [a for a in allowed if isinstance(a, str)]
            ok = fv.text.isin(*strs) if strs else F.lit(False)
            checks.append((~ok, "allowed_values",
                           _render(MSG_ALLOWED, name=n, value=fv.text, allowed=repr(allowed))))
    elif t in ("integer", "float") and contract.check_value_constraints:
        if "min_value" in cons:
            m = cons["min_value"]
            checks.append((fv.number < F.lit(float(m)), "min_value",
                           _render(MSG_MIN_VALUE, name=n, value=fv.repr, limit=_num_text(m))))
        if "max_value" in cons:
            m = cons["max_value"]
            # Spark orders NaN above every number; it is neither too large nor too small
            checks.append(((fv.number > F.lit(float(m))) & ~F.isnan(fv.number), "max_value",
                           _render(MSG_MAX_VALUE, name=n, value=fv.repr, limit=_num_text(m))))
        if "precision" in cons and t == "float":
            p = int(cons["precision"])
            digits = F.length(F.substring_index(fv.repr, ".", -1))
            checks.append((digits > F.lit(p), "precision",
                           _render(MSG_PRECISION, name=n, digits=digits.cast("string"), limit=p)))
    cons_m = F.concat(*[_one(c, m) for c, _, m in checks]) if checks else _empty_s()
    cons_k = F.concat(*[_one(c, F.lit(k)) for c, k, _ in checks]) if checks else _empty_s()
    # one boolean first; messages are built for failing fields only
    broken = F.lit(False)
    for c, _, _ in checks:
        broken = broken | F.coalesce(c, F.lit(False))
    null_bad = F.lit(not rule.nullable and contract.check_null_constraints)
    bad = fv.present & F.when(fv.is_null, null_bad).when(~type_ok, F.lit(True)).otherwise(broken)
    msgs = F.when(fv.is_null, null_m).when(~type_ok, type_m).otherwise(cons_m)
    kinds = F.when(fv.is_null, null_k).when(~type_ok, type_k).otherwise(cons_k)
    return bad, msgs, kinds


def _empty_v() -> Column:
    return F.array().cast(T.ArrayType(VIOLATION_TYPE))


def _violation(rule: FieldRule, msgs: Column, kinds: Column, fv: FieldView, pos: Column) -> Column:
    """[violation] of one field (or []) from its materialised messages/kinds.
    The label follows the message text: "type mismatch", else "not
    nullable", else "length", else TYPE_MISMATCH."""
    joined = F.lower(F.array_join(msgs, "\n"))
    vtype = (F.when(joined.contains("type mismatch"), F.lit(TYPE_MISMATCH))
             .when(joined.contains("not nullable"), F.lit(NULLABILITY))
             .when(joined.contains("length"), F.lit(CONSTRAINT))
             .otherwise(F.lit(TYPE_MISMATCH)))
    v = F.struct(
        pos.cast("int").alias("key_position"),
        F.lit(rule.name).alias("field_name"),
        vtype.alias("violation_type"),
        F.element_at(kinds, 1).alias("constraint_kind"),
        F.array_join(kinds, ",").alias("error_kinds"),
        F.lit(rule.type).alias("expected_type"),
        fv.pytype.alias("actual_type"),
        msgs.alias("errors"))
    # NULL where the field is fine
    return F.when(msgs.isNotNull(), F.array(v))


def _missing(rule: FieldRule, fv: FieldView, idx: int) -> Column:
    msg = MSG_MISSING.format(name=rule.name)
    v = F.struct(F.lit(-100000 + idx).alias("key_position"),
                 F.lit(rule.name).alias("field_name"), F.lit(MISSING).alias("violation_type"),
                 F.lit("missing").alias("constraint_kind"), F.lit("missing").alias("error_kinds"),
                 F.lit(None).cast("string").alias("expected_type"), F.lit(None).cast("string").alias("actual_type"),
                 F.array(F.lit(msg)).alias("errors"))
    return F.when(~fv.present, F.array(v)).otherwise(_empty_v())


def _unexpected(name: Column, pos: Column) -> Column:
    msg = _render(MSG_UNEXPECTED, name=name)
    return F.struct(pos.cast("int").alias("key_position"), name.alias("field_name"),
                    F.lit(UNEXPECTED).alias("violation_type"),
                    F.lit("unexpected").alias("constraint_kind"), F.lit("unexpected").alias("error_kinds"),
                    F.lit(None).cast("string").alias("expected_type"), F.lit(None).cast("string").alias("actual_type"),
                    F.array(msg).alias("errors"))


# ------------------------------------------------------------------ validation
#
# Each step below is its own projection over columns produced by the step
# before, so every per-field expression (variant extraction, runtime type,
# error array, violation struct) is evaluated once per row.  Catalyst keeps
# the projections apart because collapsing them would duplicate non-trivial
# expressions; all of them still run in one stage with no shuffle.

def _own(df: DataFrame, tag: str) -> list[Column]:
    """The record's own columns, without the work columns of earlier steps:
    each step carries on only what a later one reads, as rows are copied."""
    return [F.col(f"`{c}`") for c in df.columns if not c.startswith(f"_{tag}")]


def _materialize_views(df: DataFrame, views: dict[str, FieldView], tag: str) -> tuple[DataFrame, dict]:
    cols, out = [], {}
    for i, (n, fv) in enumerate(views.items()):
        parts = {"pr": fv.present, "nl": fv.is_null, "pt": fv.pytype, "tx": fv.text, "nu": fv.number, "rp": fv.repr}
        cols += [c.alias(f"_{tag}{k}{i}") for k, c in parts.items()]
        out[n] = FieldView(present=F.col(f"_{tag}pr{i}"), is_null=F.col(f"_{tag}nl{i}"),
                           pytype=F.col(f"_{tag}pt{i}"), text=F.col(f"_{tag}tx{i}"), number=F.col(f"_{tag}nu{i}"),
                           repr=F.col(f"_{tag}rp{i}"))
    return df.select(*_own(df, tag), *cols), out


def _violation_columns(df: DataFrame, contract: Contract, views: dict[str, FieldView], tag: str,
                       keys: Column | None):
    """Adds a [violation]-or-NULL column and a boolean for each field."""
    fields = list(contract.fields)
    rules = [_errors_for(f, views[f.name], contract) for f in fields]
    df = df.select("*", *[bad.alias(f"_{tag}b{i}") for i, (bad, _, _) in enumerate(rules)])
    carried = [F.col(f"_{tag}{k}{i}") for i in range(len(fields)) for k in ("pr", "pt", "b")]
    errs = []
    for i, (_, m, k) in enumerate(rules):
        errs += [F.when(F.col(f"_{tag}b{i}"), m).alias(f"_{tag}m{i}"), F.when(F.col(f"_{tag}b{i}"), k).alias(f"_{tag}g{i}")]
    df = df.select(*_own(df, tag), *carried, *errs)
    viols = []
    for i, f in enumerate(fields):
        pos = F.array_position(keys, F.lit(f.name)) if keys is not None else F.lit(i + 1)
        viols.append(_violation(f, F.col(f"_{tag}m{i}"), F.col(f"_{tag}g{i}"), views[f.name], pos).alias(f"_{tag}v{i}"))
    df = df.select(*_own(df, tag), *[F.col(f"_{tag}{k}{i}") for i in range(len(fields)) for k in ("pr", "b")], *viols)
    return df, {f.name: F.col(f"_{tag}v{i}") for i, f in enumerate(fields)}


def _assemble(df: DataFrame, contract: Contract, views: dict[str, FieldView], viol: dict[str, Column],
              keys: Column | None, tag: str) -> DataFrame:
    """violations = missing required fields first (contract order), then the
    record's own fields in key order: every piece carries its position and
    one ``sort_array`` puts them in order."""
    parts = [_missing(f, views[f.name], i) for i, f in enumerate(contract.fields) if f.required]
    parts += [F.coalesce(viol[f.name], _empty_v()) for f in contract.fields]
    if keys is not None and contract.detect_new_fields:
        declared = F.array(*[F.lit(n) for n in contract.field_names]) if contract.fields else _empty_s()
        extra = F.array_except(keys, declared)
        # a lambda, but over the undeclared keys only (normally none)
        parts.append(F.when(F.size(extra) > 0, F.transform(
            extra, lambda k: _unexpected(k, F.array_position(keys, k)))).otherwise(_empty_v()))
    # most records are fine: one boolean, and nothing is put together for them
    wrong = F.lit(False)
    for i, f in enumerate(contract.fields):
        wrong = wrong | F.col(f"_{tag}b{i}") | (~views[f.name].present if f.required else F.lit(False))
    if keys is not None and contract.detect_new_fields:
        wrong = wrong | (F.size(extra) > 0)
    allv = F.when(wrong, F.sort_array(F.concat(*parts))).otherwise(_empty_v()) if parts else _empty_v()
    return df.withColumn("violations", allv)


def _drop_work(df: DataFrame, tag: str) -> DataFrame:
    """Drop the work columns and add the verdict behind a predicate barrier.

    A later filter on the verdict (``is_valid``, or the ``size > 0`` that
    Spark infers for an ``explode`` of the violations) would otherwise be
    pushed through every projection above and re-inline the whole compiled
    contract into the filter.  Filters cannot move below a generator on the
    columns it produces, so the result passes through a one-row
    ``inline(array(struct(violations, is_valid)))``; the record's own columns
    stay outside of it, so filters on them still reach the scan.
    """
    keep = [c for c in df.columns if not c.startswith(f"_{tag}") and c != "violations"]
    verdict = F.struct(F.col("violations"), (F.size("violations") == 0).alias("is_valid"))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(verdict)))


def _trim_view(rule: FieldRule, fv: FieldView, coerce: bool = False) -> FieldView:
    """Only extract the value renderings a field's rules actually use."""
    cons = rule.constraints or {}
    t = rule.type_lower
    text = (t == "string" and bool(cons)) or coerce
    num = (t in ("integer", "float") and any(k in cons for k in ("min_value", "max_value", "precision"))) \
        or (coerce and t in ("integer", "float"))
    return FieldView(present=fv.present, is_null=fv.is_null, pytype=fv.pytype,
                     text=fv.text if text else F.lit(None).cast("string"),
                     number=fv.number if num else F.lit(None).cast("double"),
                     repr=fv.repr if num else F.lit(None).cast("string"))


def validate_variant(df: DataFrame, contract: Contract, record_col: str = "record",
                     keys_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Validate one VARIANT record per row (round-robin over ``partitions``
    tasks first, if given).

    ``keys_col`` may name an ARRAY<STRING> of the record's keys in source
    order (e.g. ``json_object_keys(raw_text)``); without it the keys are
    taken from the variant (sorted order).
    """
    tag = "cv"
    stage, views, keys, made = _variant_views(spread(df, partitions), contract, record_col, keys_col, tag)
    stage, viol = _violation_columns(stage, contract, views, tag, keys)
    out = _drop_work(_assemble(stage, contract, views, viol, keys, tag), tag)
    return out.drop(made) if made else out


def _variant_views(df: DataFrame, contract: Contract, record_col: str, keys_col: str | None, tag: str):
    """The fields of a variant record as columns: (DataFrame, views, keys, name of a keys column made for it)."""
    ensure_jit(df.sparkSession)
    rec = F.col(record_col)
    fields = contract.fields
    stage = df.select("*", *[F.variant_get(rec, _path(f.name), "variant").alias(f"_{tag}x{i}")
                             for i, f in enumerate(fields)])
    stage = stage.select("*", *[F.schema_of_variant(F.col(f"_{tag}x{i}")).alias(f"_{tag}k{i}")
                                for i in range(len(fields))])
    # the type's name and the JSON text (of other than strings, which no rule reads) are made once and read by the views
    stage = stage.select(*_own(stage, tag), *[F.col(f"_{tag}x{i}") for i in range(len(fields))],
                         *[_variant_pytype(F.col(f"_{tag}k{i}")).alias(f"_{tag}y{i}") for i in range(len(fields))])
    stage = stage.select("*", *[F.when(F.col(f"_{tag}y{i}") != "str", F.to_json(f"_{tag}x{i}")).alias(f"_{tag}j{i}")
                                for i in range(len(fields))])
    raw_views = {f.name: _trim_view(f, variant_field(*[F.col(f"_{tag}{k}{i}") for k in "xyj"]),
                                    contract.coerce_types)
                 for i, f in enumerate(fields)}
    stage, views = _materialize_views(stage, raw_views, tag)
    made = None if keys_col else "__record_keys"
    if made:
        stage = stage.withColumn(made, F.json_object_keys(F.to_json(rec)))
    return stage, views, F.col(keys_col or made), made


def verdict_variant(df: DataFrame, contract: Contract, record_col: str = "record", keys_col: str | None = None) -> DataFrame:
    """The records with ``is_valid`` only, as :func:`validate_variant` gives it: no
    messages, kinds, positions or violation structs are compiled or carried."""
    tag = "cv"
    stage, views, keys, made = _variant_views(df, contract, record_col, keys_col, tag)
    bad = [_errors_for(f, views[f.name], contract)[0].alias(f"_{tag}b{i}") for i, f in enumerate(contract.fields)]
    stage = stage.select(*_own(stage, tag), *[F.col(f"_{tag}pr{i}") for i in range(len(contract.fields))], *bad)
    wrong = F.lit(False)
    for i, f in enumerate(contract.fields):
        wrong = wrong | F.col(f"_{tag}b{i}") | (~views[f.name].present if f.required else F.lit(False))
    if contract.detect_new_fields:
        declared = F.array(*[F.lit(n) for n in contract.field_names]) if contract.fields else _empty_s()
        wrong = wrong | (F.size(F.array_except(keys, declared)) > 0)
    keep = [F.col(f"`{c}`") for c in df.columns]
    # behind a generator, for the reason given at _drop_work
    return stage.select(*keep, F.inline(F.array(F.struct((~F.coalesce(wrong, F.lit(False))).alias("is_valid")))))


def validate_typed(df: DataFrame, contract: Contract, static_mismatch: str = "table",
                   partitions: int | None = None) -> DataFrame:
    """Validate a typed table row by row.

    Fields whose *column type* already contradicts the contract (and
    required fields absent from the schema, and undeclared columns) are the
    same for every row; with ``static_mismatch="table"`` they are left to
    :func:`schema_drift` and the per-row pass checks only the compatible
    fields.  ``"row"`` reproduces one violation per row for them as well.
    """
    tag = "ct"
    ensure_jit(df.sparkSession)
    df = spread(df, partitions)
    views: dict[str, FieldView] = {}
    rules = []
    for f in contract.fields:
        if f.name in df.columns:
            fv, pt = typed_field(df, f.name)
            ok = pt in _ACCEPTS.get(f.python_type, (f.python_type,))
            if ok or static_mismatch == "row":
                views[f.name] = fv
                rules.append(f)
        elif static_mismatch == "row" and f.required:
            views[f.name] = FieldView(present=F.lit(False), is_null=F.lit(False), pytype=F.lit(None).cast("string"),
                                      text=F.lit(None).cast("string"), number=F.lit(None).cast("double"),
                                      repr=F.lit(None).cast("string"))
            rules.append(f)
    sub = Contract(name=contract.name, fields=tuple(rules), detect_new_fields=False,
                   check_null_constraints=contract.check_null_constraints,
                   check_value_constraints=contract.check_value_constraints,
                   check_pattern_constraints=contract.check_pattern_constraints)
    stage, mviews = _materialize_views(df, views, tag)
    stage, viol = _violation_columns(stage, sub, mviews, tag, None)
    out = _assemble(stage, sub, mviews, viol, None, tag)
    if static_mismatch == "row" and contract.detect_new_fields:
        extra = [c for c in df.columns if contract.get(c) is None]
        if extra:
            out = out.withColumn("violations", F.concat(
                "violations", F.array(*[_unexpected(F.lit(c), F.lit(len(sub.fields) + 1 + j))
                                        for j, c in enumerate(extra)]).cast(T.ArrayType(VIOLATION_TYPE))))
    return _drop_work(out, tag)


def schema_drift(df: DataFrame, contract: Contract) -> DataFrame:
    """Table-level drift of a typed table against a contract: one row per
    field whose column type contradicts the declared type, per required field
    absent from the schema and (if enabled) per undeclared column, with the
    number of rows it affects.  The type comparison is driver metadata; the
    row counts come from ONE aggregate over the table."""
    findings = []  # (field, kind, expected, actual, count Column)
    for f in contract.fields:
        if f.name in df.columns:
            pt = _static_pytype(df.schema[f.name].dataType)
            if pt not in _ACCEPTS.get(f.python_type, (f.python_type,)):
                findings.append((f.name, TYPE_MISMATCH, f.type, pt, F.count(F.col(f"`{f.name}`"))))
        elif f.required:
            findings.append((f.name, MISSING, f.type, None, F.count(F.lit(1))))
    if contract.detect_new_fields:
        for c in df.columns:
            if contract.get(c) is None:
                findings.append((c, UNEXPECTED, None, _static_pytype(df.schema[c].dataType), F.count(F.lit(1))))
    schema = "field_name string, violation_type string, expected_type string, actual_type string, affected_rows long"
    if not findings:
        return df.sparkSession.createDataFrame([], schema)
    counts = df.agg(*[c.alias(f"_n{i}") for i, (_, _, _, _, c) in enumerate(findings)])
    rows = [F.struct(F.lit(n).alias("field_name"), F.lit(k).alias("violation_type"),
                     F.lit(e).cast("string").alias("expected_type"), F.lit(a).cast("string").alias("actual_type"),
                     F.col(f"_n{i}").cast("long").alias("affected_rows"))
            for i, (n, k, e, a, _) in enumerate(findings)]
    return counts.select(F.inline(F.array(*rows)))


# ------------------------------------------------------------------ results

def violation_rows(validated: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """One row per violation (``inline``, row-local: no shuffle), with the
    position of the violation inside its record."""
    fields = [f.name for f in VIOLATION_TYPE.fields if f.name != "key_position"]
    return validated.select(*id_cols, F.posexplode("violations").alias("violation_pos", "v")).select(
        *id_cols, "violation_pos", *[F.col("v." + f).alias(f) for f in fields])


def summary(validated: DataFrame) -> DataFrame:
    """Totals of a validation run in one aggregate (one row)."""
    n = F.size("violations")
    crit = F.size(F.filter("violations", lambda v: v["violation_type"].isin(*CRITICAL_TYPES)))
    return validated.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum(F.col("is_valid").cast("long")).cast("long").alias("valid_records"),
        F.sum((~F.col("is_valid")).cast("long")).cast("long").alias("invalid_records"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_violations"),
        F.coalesce(F.sum(crit), F.lit(0)).cast("long").alias("critical_violations"))


def summary_of_broken(broken: DataFrame, records: DataFrame) -> DataFrame:
    """:func:`summary` from the invalid records alone (with their violations) and
    the table they come from, of which only the rows are counted: no record is
    validated a second time."""
    n = F.size("violations")
    crit = F.size(F.filter("violations", lambda v: v["violation_type"].isin(*CRITICAL_TYPES)))
    total = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = broken.agg(F.count(F.lit(1)).alias("invalid_records"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_violations"),
                   F.coalesce(F.sum(crit), F.lit(0)).cast("long").alias("critical_violations")).withColumn("total_records", total)
    # sums over no record at all are null, as in summary()
    some = F.col("total_records") > 0
    return g.select("total_records", F.when(some, F.col("total_records") - F.col("invalid_records")).alias("valid_records"),
                    F.when(some, F.col("invalid_records")).alias("invalid_records"), "total_violations", "critical_violations")


def counts_by_type(validated: DataFrame) -> DataFrame:
    """Violations per type.  Each record is reduced map-side first, so a
    record-heavy partition ships one small row per type, not its records."""
    per = validated.select(F.explode("violations").alias("v")).select(F.col("v.violation_type").alias("violation_type"))
    return per.groupBy("violation_type").agg(F.count(F.lit(1)).alias("violation_count"))


def critical_violations(rows: DataFrame, id_cols: Sequence[str], n: int | None = 5) -> DataFrame:
    """Critical violations (TYPE_MISMATCH / MISSING_REQUIRED_FIELD), first
    ``n`` by record and position (top-k, not a full sort)."""
    c = rows.filter(F.col("violation_type").isin(*CRITICAL_TYPES))
    c = c.orderBy(*id_cols, "violation_pos")
    return c.limit(n) if n else c


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine: (valid records, invalid records)."""
    return validated.filter(F.col("is_valid")), validated.filter(~F.col("is_valid"))
