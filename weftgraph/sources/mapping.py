"""Mapping configuration: which rows are vertices and which are edges.

A provider names tables; each entry of ``vertices`` and ``edges`` says how rows of one become elements. An inner edge is a vertex row
that also is an edge; with a ``path`` it is one edge for each item of an array. Endpoints are references (label and id), or vertices
with properties of their own, which then also appear as vertices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache, cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import INTEGRAL, P, all_of
from weftgraph.sources.properties import Field, Property, Static, build, quoted

ID, LABEL = "~id", "~label"


def key_type(kind: T.DataType) -> str:
    """Keys are compared as long or as string: all whole-number types are one."""
    return "long" if isinstance(kind, INTEGRAL) else "string"


@dataclass
class Endpoint:
    id: Property
    label: Property
    ref: bool = True
    properties: dict[str, Property] = field(default_factory=dict)


#: A table, or how to get it: a mapping that no traversal touches never opens its table.
Source = DataFrame | Callable[[], DataFrame]


class Mapping:
    """What vertex and edge mappings share: a table, id and label, and properties."""

    def __init__(self, name: str, df: Source, id_: Property, label: Property, properties: dict[str, Property], dynamic: bool, excluded: Iterable[str] = ()) -> None:
        self.name, self._df, self.id, self.label, self.dynamic = name, df, id_, label, dynamic
        self.properties = dict(properties)
        #: Rows by id that a mutation added and that nothing has changed since.
        self.overlay: dict[str, dict[str, Any]] | None = None
        if dynamic:
            used = {f.split(".")[0].lower() for p in (id_, label, *properties.values()) for f in p.fields} | {e.lower() for e in excluded} | {k.lower() for k in properties}
            self.properties |= {c: Field(c) for c in self.df.columns if c.lower() not in used}

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    @df.setter
    def df(self, df: Source) -> None:
        self._df = df

    @property
    def labels(self) -> frozenset[str] | None:
        """The labels that its elements can have, if these are known."""
        return self.label.known

    @cached_property
    def kinds(self) -> dict[str, T.DataType]:
        """Types of id, label and all properties."""
        named = {ID: self.id, LABEL: self.label, **self.properties}
        found = self.df.select(*[p.expr().alias(f"c{i}") for i, p in enumerate(named.values())]).schema
        return {k: f.dataType for k, f in zip(named, found, strict=True)}

    @property
    def key(self) -> str:
        return key_type(self.kinds[ID])

    def property(self, key: str) -> Property | None:
        """The schema of a key, which may be a path below a property that has such."""
        if key in self.properties:
            return self.properties[key]
        head, _, path = key.partition(".")
        below = self.properties.get(head)
        return below.at_path(path) if path and below is not None else None

    def kind(self, key: str) -> T.DataType | None:
        return self.kinds.get(key, T.StringType())

    def condition(self, key: str, p: P) -> Column | None:
        """The rows whose ``key`` meets ``p``; None if the mapping has no such rows."""
        if key == ID:
            kind = self.kinds[ID]
            return self.id.predicate(p, kind)
        if key == LABEL:
            return self.label.predicate(p, self.kinds[LABEL])
        schema = self.property(key)
        return None if schema is None else schema.predicate(p, self.kind(key))

    def validity(self) -> list[Column]:
        parts = [self.id.expr().isNotNull()]
        return parts + [k for p in (self.id, self.label, *self.properties.values()) if (k := p.keep()) is not None]

    def rows(self, predicates: Iterable[tuple[str, P]]) -> DataFrame | None:
        """The table's rows that are elements and meet all ``predicates``; None if none can."""
        conditions = self.validity()
        for key, p in predicates:
            c = self.condition(key, p)
            if c is None:
                return None
            conditions.append(c)
        return self.df.filter(all_of(conditions))


class VertexMapping(Mapping):
    def __init__(self, *args: Any, **kwargs: Any) -> None:
        super().__init__(*args, **kwargs)
        self.inner: list[EdgeMapping] = []


class EdgeMapping(Mapping):
    def __init__(self, name: str, df: Source, id_: Property, label: Property, properties: dict[str, Property], dynamic: bool, excluded: Iterable[str], out: Endpoint, in_: Endpoint, owner: VertexMapping | None = None, owner_side: str | None = None) -> None:
        ends = [f for e in (out, in_) for p in (e.id, e.label, *e.properties.values()) for f in p.fields]
        super().__init__(name, df, id_, label, properties, dynamic, [*excluded, *(ends if dynamic else [])])
        self.out, self.in_ = out, in_
        #: The vertex mapping whose rows these edges are, and which endpoint a row is.
        self.owner, self.owner_side = owner, owner_side

    @cached_property
    def end_kinds(self) -> dict[str, str]:
        found = self.df.select(self.out.id.expr().alias("o"), self.in_.id.expr().alias("i")).schema
        return {"out": key_type(found[0].dataType), "in": key_type(found[1].dataType)}

    def end(self, side: str) -> Endpoint:
        return self.out if side == "out" else self.in_

    def validity(self) -> list[Column]:
        parts = super().validity()
        for e in (self.out, self.in_):
            parts.append(e.id.expr().isNotNull())
            parts += [k for p in (e.id, e.label) if (k := p.keep()) is not None]
        return parts


def _properties(config: dict[str, Any]) -> dict[str, Property]:
    out: dict[str, Property] = {}
    for key, value in (config.get("properties") or {}).items():
        out[key] = build(value, out)
    return out


def _dynamic(config: dict[str, Any]) -> tuple[bool, list[str], list[str]]:
    dynamic = config.get("dynamicProperties", False)
    if isinstance(dynamic, dict):
        return True, list(dynamic.get("excludeFields", [])), list(dynamic.get("excludeProperties", []))
    return bool(dynamic), [], []


def _endpoint(config: dict[str, Any]) -> Endpoint:
    return Endpoint(build(config["id"]), build(config["label"]), bool(config.get("ref", False)), _properties(config))


def _source(config: dict[str, Any]) -> str:
    for key in ("table", "resource", "index"):
        if isinstance(config.get(key), str):
            return config[key]
        if isinstance(config.get(key), dict):
            return config[key].get("default") or config[key]["schema"]
    raise ValueError(f"no table, resource or index in {sorted(config)}")


def _denormalised(name: str, df: Callable[[], DataFrame], e: Endpoint) -> VertexMapping:
    """Vertices that are given in full within edge rows: one of each id and label."""

    def rows() -> DataFrame:
        named = {ID: e.id.expr(), LABEL: e.label.expr(), **{k: p.expr() for k, p in e.properties.items()}}
        return df().filter(e.id.expr().isNotNull()).select(*[c.alias(k) for k, c in named.items()]).dropDuplicates([ID, LABEL])

    label: Property = e.label if isinstance(e.label, Static) else Field(LABEL)
    return VertexMapping(f"{name} endpoint", rows, Field(ID), label, {k: Field(k) for k in e.properties}, False)


def _virtual(config: dict[str, Any], df: Callable[[], DataFrame]) -> VertexMapping:
    """Vertices without a table: the distinct ids in a column of another."""
    id_ = build(config["id"])
    ids = lambda: df().select(id_.expr().alias(ID)).filter(F.col(ID).isNotNull()).distinct()
    return VertexMapping(f"virtual {config['label']}", ids, Field(ID), build(config["label"]), {}, False)


def _items(own: VertexMapping, path: str) -> DataFrame:
    """The items at a path of each vertex row (an array's, or the one object), with the vertex's own id and label beside them."""
    found = quoted(path)
    item = F.explode(found) if isinstance(own.df.select(found).schema[0].dataType, T.ArrayType) else found
    rows = own.df.filter(own.id.expr().isNotNull()).select(own.id.expr().alias("~owner"), own.label.expr().alias("~owner_label"), item.alias("~item"))
    return rows.select("~owner", "~owner_label", "~item.*")


def parse(config: dict[str, Any], table: Callable[[str], DataFrame]) -> tuple[list[VertexMapping], list[EdgeMapping]]:
    """The vertex and edge mappings of one provider. ``table`` gives the DataFrame of a source name, and is asked once a name."""
    vertices: list[VertexMapping] = []
    edges: list[EdgeMapping] = []
    table = cache(table)
    source = lambda name: lambda: table(name)
    for v in config.get("vertices", []):
        df = source(_source(v))
        if v.get("virtual"):
            vertices.append(_virtual(v, df))
            continue
        dynamic, fields, names = _dynamic(v)
        paths = [e["path"] for e in v.get("edges", []) if "path" in e]
        own = VertexMapping(_source(v), df, build(v["id"]), build(v["label"]), _properties(v), dynamic, [*fields, *names, *paths])
        vertices.append(own)
        for e in v.get("edges", []):
            rows, near = df, Endpoint(own.id, own.label)
            if "path" in e:
                rows = cache(lambda own=own, path=e["path"]: _items(own, path))
                near = Endpoint(Field("~owner"), own.label if isinstance(own.label, Static) else Field("~owner_label"))
            far = _endpoint(e["vertex"])
            outward = e.get("direction", "OUT").upper() == "OUT"
            ends = {"out": near if outward else far, "in_": far if outward else near}
            dynamic, fields, names = _dynamic(e)
            edge = EdgeMapping(f"{own.name}.{e.get('label')}", rows, build(e["id"]), build(e["label"]), _properties(e), dynamic, [*fields, *names, "~owner", "~owner_label"], **ends, owner=None if "path" in e else own, owner_side="out" if outward else "in")
            edges.append(edge)
            if "path" not in e:
                own.inner.append(edge)
            if not far.ref:
                vertices.append(_denormalised(edge.name, rows, far))
    for e in config.get("edges", []):
        df = source(_source(e))
        dynamic, fields, names = _dynamic(e)
        out, in_ = _endpoint(e["outVertex"]), _endpoint(e["inVertex"])
        edges.append(EdgeMapping(_source(e), df, build(e["id"]), build(e["label"]), _properties(e), dynamic, [*fields, *names], out, in_))
        vertices += [_denormalised(edges[-1].name, df, x) for x in (out, in_) if not x.ref and x.properties]
    return vertices, edges
