"""A virtual property graph over DataFrames, queried by traversals that become plain Spark plans."""

from weftgraph.functions.predicates import Date, P, Text, TextP, between, eq, exists, gt, gte, inside, lt, lte, neq, not_, outside, type_of, within, without
from weftgraph.graph import Graph
from weftgraph.plans.traversal import Order, T, Traversal, __, asc, desc, keys, local, shuffle, values

__all__ = ["Date", "Graph", "Order", "P", "T", "Text", "TextP", "Traversal", "__", "asc", "between", "desc", "eq", "exists", "gt", "gte", "inside", "keys", "local", "lt", "lte", "neq", "not_", "outside", "shuffle", "type_of", "values", "within", "without"]
