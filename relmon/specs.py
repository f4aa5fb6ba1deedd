"""Declarative specs: sources, metrics and data contracts.

Specs are small driver-side objects (a handful of entries each); they are
compiled into Column expressions, never shipped as data.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# The contract type names and the Python runtime type each one
# accepts.  Unknown type names fall back to "str".
CONTRACT_TYPES = {
    "string": "str",
    "integer": "int",
    "float": "float",
    "boolean": "bool",
    "datetime": "str",
    "array": "list",
    "object": "dict",
}

# Default thresholds (abs z above 3.0; staleness above 30 minutes).
DEFAULT_Z_THRESHOLD = 3.0
DEFAULT_STALENESS_MINUTES = 30.0
DEFAULT_SAMPLE_SIZE = 100
DEFAULT_MIN_SAMPLES = 10
DEFAULT_RETENTION_DAYS = 90


@dataclass(frozen=True)
class SourceSpec:
    """Where a monitored table lives and which column carries its time."""
    name: str                       # logical table name (alert source_table)
    path: str | None = None         # file path for parquet/json/csv
    fmt: str = "parquet"
    options: dict = field(default_factory=dict)
    time_column: str = "created_at"
    database: str = "default"       # source_database in the baselines key

    def read(self, spark):
        reader = spark.read.format(self.fmt).options(**self.options)
        return reader.load(self.path) if self.path else reader.load()


@dataclass(frozen=True)
class MetricSpec:
    """One monitored metric of a table (volume or freshness)."""
    name: str
    kind: str = "volume"            # volume | freshness | sum | avg
    grain: str = "hour"             # hour | day
    threshold: float = DEFAULT_Z_THRESHOLD
    window_days: int | None = None
    window_hours: int | None = None
    value_column: str | None = None  # for sum / avg metrics
    severity: str = "CRITICAL"

    def __post_init__(self):
        if self.threshold <= 0:
            raise ValueError(f"threshold of {self.name} must be > 0")
        if self.kind not in ("volume", "freshness", "sum", "avg"):
            raise ValueError(f"unknown metric kind {self.kind}")
        if self.grain not in ("hour", "day"):
            raise ValueError(f"unknown grain {self.grain}")


@dataclass(frozen=True)
class FieldRule:
    name: str
    type: str = "string"
    required: bool = False
    nullable: bool = True
    constraints: dict = field(default_factory=dict)

    @property
    def type_lower(self) -> str:
        return (self.type or "string").lower()

    @property
    def python_type(self) -> str:
        return CONTRACT_TYPES.get(self.type_lower, "str")


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[FieldRule, ...]
    target_table: str | None = None
    detect_new_fields: bool = True
    severity: str = "CRITICAL"
    sample_size: int | None = DEFAULT_SAMPLE_SIZE
    sampling_method: str = "latest"
    # rule groups that may be switched off (lenient mode)
    check_null_constraints: bool = True
    check_value_constraints: bool = True
    check_pattern_constraints: bool = True
    coerce_types: bool = False
    # set to sample in a monitoring run; None validates every record there
    sample_size_for_run: int | None = None

    @property
    def required(self) -> tuple[FieldRule, ...]:
        return tuple(f for f in self.fields if f.required)

    @property
    def field_names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    def get(self, name: str) -> FieldRule | None:
        for f in self.fields:
            if f.name == name:
                return f
        return None


_CONSTRAINT_KEYS = ("min_length", "max_length", "pattern", "allowed_values",
                    "min_value", "max_value", "precision")


def contract_from_dict(d: dict[str, Any], name: str | None = None) -> Contract:
    """Accept both YAML dialects.

    * sectioned: ``required_fields`` / ``optional_fields`` each mapping a field
      to ``{type, nullable, constraints: {...}}``; an optional definition of
      the same name wins over the required one.
    * flat: ``fields`` mapping a field to ``{type, required, max_length, ...}``
      with constraints inline.
    """
    merged: dict[str, FieldRule] = {}
    if "required_fields" in d or "optional_fields" in d:
        for section, req in (("required_fields", True), ("optional_fields", False)):
            for fname, cfg in (d.get(section) or {}).items():
                cfg = cfg or {}
                merged[fname] = FieldRule(
                    name=fname, type=str(cfg.get("type", "string")), required=req,
                    nullable=bool(cfg.get("nullable", True)),
                    constraints=dict(cfg.get("constraints") or {}))
        # a field listed as required stays required for the missing check even
        # when an optional entry overrides its rules
        req_names = set((d.get("required_fields") or {}).keys())
        merged = {k: FieldRule(v.name, v.type, v.required or k in req_names, v.nullable, v.constraints)
                  for k, v in merged.items()}
    for fname, cfg in (d.get("fields") or {}).items():
        cfg = cfg or {}
        cons = dict(cfg.get("constraints") or {})
        cons.update({k: cfg[k] for k in _CONSTRAINT_KEYS if k in cfg})
        merged[fname] = FieldRule(
            name=fname, type=str(cfg.get("type", "string")), required=bool(cfg.get("required", False)),
            nullable=bool(cfg.get("nullable", True)), constraints=cons)
    rules = d.get("validation_rules") or {}
    drift = rules.get("schema_drift") or {}
    quality = rules.get("data_quality") or {}
    typing = rules.get("type_validation") or {}
    alerting = d.get("alerting") or {}
    sampling = d.get("sampling") or {}
    sample_size = sampling.get("sample_size", DEFAULT_SAMPLE_SIZE) if sampling.get("enabled", True) else None
    return Contract(
        name=name or d.get("contract_name") or "contract",
        fields=tuple(merged.values()),
        target_table=d.get("target_table"),
        detect_new_fields=bool(drift.get("detect_new_fields", True)),
        severity=str(alerting.get("contract_violation_severity", "CRITICAL")),
        sample_size=sample_size,
        sampling_method=str(sampling.get("sampling_method", "latest")),
        check_null_constraints=bool(quality.get("check_null_constraints", True)),
        check_value_constraints=bool(quality.get("check_value_constraints", True)),
        check_pattern_constraints=bool(quality.get("check_pattern_constraints", True)),
        coerce_types=bool(typing.get("coerce_types", False)),
    )


def load_contract(path: str) -> Contract:
    import yaml
    with open(path) as fh:
        return contract_from_dict(yaml.safe_load(fh) or {})


def metrics_from_dict(d: dict[str, Any]) -> dict[str, list[MetricSpec]]:
    """``{db: {tables: [{name, metrics: [{name, type, threshold, window_days}]}]}}``
    -> ``{table_name: [MetricSpec, ...]}``."""
    out: dict[str, list[MetricSpec]] = {}
    for _db, cfg in (d or {}).items():
        if not isinstance(cfg, dict):
            continue
        for t in cfg.get("tables") or []:
            if not isinstance(t, dict):
                continue
            out[t["name"]] = [_metric(m) for m in t.get("metrics") or []]
    return out


def _metric(m: dict[str, Any]) -> MetricSpec:
    """A metric entry.  ``value_column`` (or ``column``) with ``aggregate`` sum
    or avg makes it a business metric; ``grain`` follows the window unless
    given; a freshness threshold is in minutes."""
    kind = m.get("type", "volume")
    value = m.get("value_column") or m.get("column")
    if value is not None and kind not in ("freshness", "sum", "avg"):
        kind = m.get("aggregate", "sum")
    days, hours = m.get("window_days"), m.get("window_hours")
    default = DEFAULT_STALENESS_MINUTES if kind == "freshness" else DEFAULT_Z_THRESHOLD
    return MetricSpec(name=m["name"], kind=kind, grain=m.get("grain") or ("day" if days else "hour"),
                      threshold=float(m.get("threshold", default)), window_days=days, window_hours=hours,
                      value_column=value, severity=str(m.get("severity", "CRITICAL")))


def sources_from_dict(d: dict[str, Any], base_path: str = "") -> dict[str, SourceSpec]:
    """Registry entries ``{db: {path | options, format, tables: [{name, path,
    time_column}]}}`` -> ``{table: SourceSpec}``.  A table without a path is
    read from ``<base path>/<name>.parquet``; a format of ``jdbc`` takes the
    entry's options and the table as ``dbtable``."""
    out: dict[str, SourceSpec] = {}
    for db, cfg in (d or {}).items():
        if not isinstance(cfg, dict):
            continue
        fmt = str(cfg.get("format", "parquet"))
        root = str(cfg.get("path") or base_path).rstrip("/")
        for t in cfg.get("tables") or []:
            t = t if isinstance(t, dict) else {"name": t}
            options = {str(k): str(v) for k, v in (cfg.get("options") or {}).items()}
            if fmt == "jdbc":
                options.setdefault("dbtable", t["name"])
            path = None if fmt == "jdbc" else t.get("path") or f"{root}/{t['name']}.{fmt}"
            out[t["name"]] = SourceSpec(name=t["name"], path=path, fmt=fmt, options=options,
                                        time_column=t.get("time_column", "created_at"), database=str(db))
    return out


def load_registry(path: str, base_path: str = "") -> tuple[dict[str, SourceSpec], dict[str, list[MetricSpec]]]:
    """Sources and metrics of a YAML registry file."""
    import yaml
    with open(path) as fh:
        d = yaml.safe_load(fh) or {}
    d = d.get("databases", d)
    return sources_from_dict(d, base_path), metrics_from_dict(d)
