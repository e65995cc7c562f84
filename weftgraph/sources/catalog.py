"""The graph over the driver's tables."""

from __future__ import annotations

from typing import Any


def _endpoint(label: str, field: str) -> dict[str, Any]:
    return {"ref": True, "label": label, "id": f"@{field}"}


def _vertex(label: str, table: str, key: str, properties: dict[str, Any], *edges: dict[str, Any]) -> dict[str, Any]:
    return {"table": table, "label": label, "id": f"@{key}", "properties": properties, "edges": list(edges)}


def _inner(label: str, id_: str, direction: str, far: dict[str, Any]) -> dict[str, Any]:
    return {"label": label, "id": f"@{id_}", "direction": direction, "vertex": far}


def _contains(label: str, far: dict[str, Any], properties: dict[str, Any]) -> dict[str, Any]:
    # (l_orderkey, l_linenumber) is not unique in these tables, all four numbers are
    line = {"fields": ["@l_orderkey", "@l_partkey", "@l_suppkey", "@l_linenumber"], "delimiter": "_"}
    return {"table": "lineitem", "label": label, "id": line, "outVertex": _endpoint("order", "l_orderkey"), "inVertex": far, "properties": properties}


LINE = {k: f"@l_{k}" for k in ("quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")}
ORDER = {k: f"@o_{c}" for k, c in (("status", "orderstatus"), ("totalprice", "totalprice"), ("orderdate", "orderdate"), ("priority", "orderpriority"))} | {
    "status_priority": {"fields": ["@o_orderstatus", "@o_orderpriority"], "delimiter": "_"},
    "status_name": {"field": "o_orderstatus", "alias": {"F": "final", "O": "open", "P": "pending"}},
    "orderday": {"field": "o_orderdate", "displayFormats": ["yyyy-MM-dd"]},
}

CATALOG: dict[str, Any] = {
    "vertices": [
        _vertex("region", "region", "r_regionkey", {"name": "@r_name"}),
        _vertex("nation", "nation", "n_nationkey", {"name": "@n_name", "regionkey": "@n_regionkey"}, _inner("in_region", "n_nationkey", "OUT", _endpoint("region", "n_regionkey"))),
        _vertex("customer", "customer", "c_custkey", {"name": "@c_name", "acctbal": "@c_acctbal", "segment": "@c_mktsegment"}, _inner("in_nation", "c_custkey", "OUT", _endpoint("nation", "c_nationkey"))),
        _vertex("supplier", "supplier", "s_suppkey", {"name": "@s_name", "acctbal": "@s_acctbal"}, _inner("in_nation", "s_suppkey", "OUT", _endpoint("nation", "s_nationkey"))),
        _vertex("part", "part", "p_partkey", {"name": "@p_name", "brand": "@p_brand", "type": "@p_type", "size": "@p_size", "retailprice": "@p_retailprice"}),
        _vertex("order", "orders", "o_orderkey", ORDER, _inner("placed", "o_orderkey", "IN", _endpoint("customer", "o_custkey"))),
        _vertex("event", "events", "event_id", {"ts": "@ts", "type": "@event_type", "value": "@value", "props": {"field": "props", "type": "jsonb"}}, _inner("performed", "event_id", "IN", _endpoint("user", "user_id"))),
        {"table": "events", "virtual": True, "label": "user", "id": "@user_id"},
        _vertex("document", "documents", "doc_id", {"text": "@text", "lang": "@lang", "source": "@source", "n_chars": "@n_chars"}),
    ],
    "edges": [_contains("contains", _endpoint("part", "l_partkey"), LINE), _contains("supplied_by", _endpoint("supplier", "l_suppkey"), {"quantity": "@l_quantity"})],
}

#: Orders of the highest priority only; kept apart, as its rows are orders as well.
URGENT: dict[str, Any] = {"vertices": [{"table": "orders", "id": "@o_orderkey", "label": "urgent_order", "properties": {"priority": {"field": "o_orderpriority", "include": ["1-URGENT"]}}}]}
