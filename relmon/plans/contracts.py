"""Contracts used by the registered queries."""

from __future__ import annotations

from relmon.specs import contract_from_dict

# The CDC order contract (field names, types, nullability and
# constraints must equal the monitored contract for identical verdicts).
CDC_ORDER_CONTRACT = {
    "contract_name": "cdc_order_contract",
    "target_table": "dim_orders_history",
    "required_fields": {
        "order_key": {"type": "string", "nullable": False,
                      "constraints": {"min_length": 1, "max_length": 100, "pattern": "^[A-Za-z0-9-_]+$"}},
        "total_amount": {"type": "float", "nullable": False,
                         "constraints": {"min_value": 0.0, "max_value": 999999.99, "precision": 2}},
    },
    "optional_fields": {
        "customer_id": {"type": "integer", "nullable": True},
        "product_id": {"type": "integer", "nullable": True},
        "quantity": {"type": "integer", "nullable": True, "constraints": {"min_value": 1}},
        "unit_price": {"type": "float", "nullable": True, "constraints": {"min_value": 0.0, "precision": 2}},
        "order_status": {"type": "string", "nullable": True,
                         "constraints": {"allowed_values": ["pending", "completed", "shipped", "cancelled",
                                                            "refunded"]}},
        "order_date": {"type": "datetime", "nullable": True},
        "cdc_operation": {"type": "string", "nullable": True,
                          "constraints": {"allowed_values": ["INSERT", "UPDATE", "DELETE"]}},
        "cdc_timestamp": {"type": "datetime", "nullable": True},
    },
    "validation_rules": {"schema_drift": {"detect_new_fields": True}},
    "alerting": {"contract_violation_severity": "CRITICAL"},
    "sampling": {"enabled": True, "sample_size": 100, "sampling_method": "random"},
}

# A contract for the orders table itself (typed-table mode): allowed status
# codes, a priority code pattern with a length cap, a price range.
ORDERS_TABLE_CONTRACT = {
    "contract_name": "orders_table_contract",
    "target_table": "orders",
    "required_fields": {
        "o_orderkey": {"type": "integer", "nullable": False, "constraints": {"min_value": 0}},
        "o_orderstatus": {"type": "string", "nullable": False, "constraints": {"allowed_values": ["F", "O"]}},
        "o_orderpriority": {"type": "string", "nullable": False,
                            "constraints": {"max_length": 8, "pattern": "^[1-5]-[A-Z]+$"}},
        "o_totalprice": {"type": "float", "nullable": False,
                         "constraints": {"min_value": 1000.0, "max_value": 450000.0, "precision": 2}},
    },
    "optional_fields": {
        "o_custkey": {"type": "integer", "nullable": True, "constraints": {"min_value": 1}},
        "o_orderdate": {"type": "datetime", "nullable": True},
    },
}


def cdc_contract():
    return contract_from_dict(CDC_ORDER_CONTRACT)


def orders_contract():
    return contract_from_dict(ORDERS_TABLE_CONTRACT)
