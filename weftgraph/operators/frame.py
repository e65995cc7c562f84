"""Traversers as rows: a DataFrame, and what its columns mean.

A *shape* says what the current object of each row is. A vertex is a key and a label; its properties are joined in only when a step
reads one (``Base.hydrate``), so a hop that ends in a count never touches the vertex table. Columns have unique names, and what no
later step reads is pruned by Catalyst.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import count
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import NUMERIC, P, all_of, within
from weftgraph.sources.mapping import ID, LABEL, EdgeMapping, Mapping, VertexMapping

if TYPE_CHECKING:
    from weftgraph.graph import Graph

_numbers = count()


def fresh(tag: str = "x") -> str:
    return f"{tag}{next(_numbers)}"


@dataclass(frozen=True)
class Foreign:
    """An inner edge within a vertex row: where its columns are."""

    mapping: EdgeMapping
    columns: dict[str, str]  # ok, id, label, far_key, far_label, and p:<property>


@dataclass(frozen=True)
class Vertex:
    key: str
    label: str
    key_type: str
    labels: frozenset[str] | None
    props: dict[str, str] | None = None
    kinds: dict[str, T.DataType] = field(default_factory=dict)
    foreign: tuple[Foreign, ...] = ()
    mapping: VertexMapping | None = None

    def identity(self) -> list[str]:
        return [self.label, self.key]

    def columns(self) -> list[str]:
        return [*self.identity(), *(self.props or {}).values(), *[c for f in self.foreign for c in f.columns.values()]]

    def bare(self) -> Vertex:
        return Vertex(self.key, self.label, self.key_type, self.labels)


@dataclass(frozen=True)
class Edge:
    id: str
    label: str
    labels: frozenset[str] | None
    ends: dict[str, Vertex]
    props: dict[str, str]
    kinds: dict[str, T.DataType]
    far: str | Vertex | None = None  # which end the hop led to, or that vertex itself

    def identity(self) -> list[str]:
        return [self.label, self.id]

    def columns(self) -> list[str]:
        more = self.far.identity() if isinstance(self.far, Vertex) else []
        return [*self.identity(), *[c for v in self.ends.values() for c in v.identity()], *self.props.values(), *more]


@dataclass(frozen=True)
class Value:
    column: str
    kind: T.DataType

    def identity(self) -> list[str]:
        return [self.column]

    columns = identity


@dataclass(frozen=True)
class Fields:
    """A map with known keys: one shape for each."""

    items: dict[str, Any]

    def identity(self) -> list[str]:
        return [c for s in self.items.values() for c in s.identity()]

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.items.values() for c in s.columns()))


@dataclass(frozen=True)
class Pairs:
    """A map as rows, one an entry."""

    key: Any
    value: Any

    def identity(self) -> list[str]:
        return [*self.key.identity(), *self.value.identity()]

    def columns(self) -> list[str]:
        return [*self.key.columns(), *self.value.columns()]


Shape = Vertex | Edge | Value | Fields | Pairs


@dataclass(frozen=True)
class Product:
    """What a hop joined where both sides may have many rows a key: a count of the pairs needs the sides only."""

    df: DataFrame  # the rows it stands for
    left: DataFrame
    right: DataFrame
    keys: tuple[tuple[Column, Column], ...]  # columns of both sides that are equal
    apart: tuple[tuple[Column, Column], ...] = ()  # the identities of two elements that are not the same

    def side(self, shape: Shape) -> str | None:
        """The side that has all columns of ``shape``."""
        return next((s for s in ("left", "right") if set(shape.columns()) <= set(getattr(self, s).columns)), None)


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    cur: Shape
    tags: dict[str, Shape] = field(default_factory=dict)
    scope: tuple[str, ...] = ()  # columns of the traverser that a nested traversal works for
    extra: tuple[str, ...] = ()  # further columns that have to stay
    path: str | None = None  # array of what each step showed
    trail: str | None = None  # array of identities
    order: tuple[tuple[str, str], ...] = ()  # column and direction
    loops: int = 0
    sack: str | None = None
    empty: bool = False
    bags: dict[str, Frame] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)  # of named loops
    once: str | None = None  # the key of a vertex that no two rows share
    product: Product | None = None

    def live(self) -> list[str]:
        """The columns that later steps may read."""
        some = [*self.cur.columns(), *[c for s in self.tags.values() for c in s.columns()], *self.scope, *self.extra, *[c for c, _ in self.order]]
        some += [c for c in (self.path, self.trail, self.sack) if c]
        return list(dict.fromkeys(some))

    def narrow(self) -> Frame:
        return replace(self, df=self.df.select(*self.live()))

    def filter(self, condition: Column, of: Shape | None = None) -> Frame:
        """The rows that meet ``condition``; one that reads no columns but those ``of`` a shape leaves a product one."""
        out, product = replace(self, df=self.df.filter(condition)), self.factors()
        side = None if product is None or of is None else product.side(of)
        return out if side is None else replace(out, product=replace(product, df=out.df, **{side: getattr(product, side).filter(condition)}))

    def nothing(self) -> Frame:
        return replace(self, df=self.df.limit(0), empty=True)

    def factors(self) -> Product | None:
        """The two sides of these rows, if no step has changed the rows since."""
        return self.product if self.product is not None and self.product.df is self.df else None


def common(kinds: Iterable[T.DataType]) -> T.DataType:
    """One type for all: the same, a double for different numbers, else text."""
    kinds = [k for k in kinds if not isinstance(k, T.NullType)]
    if not kinds:
        return T.StringType()
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, NUMERIC) for k in kinds):
        return T.LongType() if all(isinstance(k, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for k in kinds) else T.DoubleType()
    return T.StringType()


def as_kind(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(have, (T.ArrayType, T.MapType, T.StructType)) and isinstance(want, T.StringType):
        return F.to_json(c)
    return c.cast(want)


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; a column that a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def join_labels(sets: Iterable[frozenset[str] | None]) -> frozenset[str] | None:
    sets = list(sets)
    return None if any(s is None for s in sets) else frozenset().union(*sets)


class Base:
    """Relations of a graph's elements, hydration and unions; the operator families build on it."""

    graph: Graph
    source: Any

    # relations

    def implied(self, kind: str) -> list[tuple[str, P]]:
        """Predicates that the source puts on all vertices or edges."""
        options = self.source.options if self.source is not None else {}
        out: list[tuple[str, P]] = []
        if "partition" in options:
            key, read, _ = options["partition"]
            out.append((key, within(*read)))
        if "subgraph" in options:
            t = options["subgraph"][0 if kind == "vertex" else 1]
            if t is not None:
                out += [x for s in t.steps for x in self.folded(s)]
        return out

    def folded(self, step: Any) -> list[tuple[str, P]]:
        raise NotImplementedError

    def allowed(self, mapping: Mapping, predicates: list[tuple[str, P]]) -> bool:
        return self.graph.traversal_filter is None or self.graph.traversal_filter(mapping, predicates)

    def candidates(self, labels: frozenset[str] | None) -> list[VertexMapping]:
        return [m for m in self.graph.vertices if labels is None or m.labels is None or m.labels & labels]

    def vertex_relation(self, mappings: list[VertexMapping], predicates: list[tuple[str, P]], foreign: bool = True) -> tuple[DataFrame, Vertex] | None:
        """All vertices of ``mappings`` that meet ``predicates``, with all properties; None if there can be none."""
        predicates = [*predicates, *self.implied("vertex")]
        found = [(m, rows) for m in mappings if self.allowed(m, predicates) and (rows := m.rows(predicates)) is not None]
        if not found:
            return None
        key_type = "long" if all(m.key == "long" for m, _ in found) else "string"
        names = list(dict.fromkeys(k for m, _ in found for k in m.properties))
        kinds = {k: common(m.kinds[k] for m, _ in found if k in m.properties) for k in names}
        key, label, columns = fresh("key"), fresh("label"), {k: fresh("p") for k in names}
        single = found[0][0] if len(found) == 1 else None
        own: list[Foreign] = []
        if single is not None and foreign:
            for e in (e for e in single.inner if e.df is single.df):  # mutations part an edge's rows from its vertex's
                own.append(Foreign(e, {x: fresh("f") for x in ("ok", "id", "label", "far_key", "far_label", *[f"p:{k}" for k in e.properties])}))
        parts = []
        for m, rows in found:
            cols = [m.id.expr().cast(key_type).alias(key), m.label.expr().cast("string").alias(label)]
            cols += [as_kind(p.expr(), m.kinds[k], kinds[k]).alias(columns[k]) for k, p in m.properties.items()]
            for f in own:
                cols += self._foreign_columns(f)
            parts.append(rows.select(*cols))
        labels = join_labels(m.labels for m, _ in found)
        return united(parts), Vertex(key, label, key_type, labels, columns, kinds, tuple(own), single)

    def _foreign_columns(self, f: Foreign) -> list[Column]:
        e, c = f.mapping, f.columns
        far_side = "in" if e.owner_side == "out" else "out"
        far = e.end(far_side)
        implied = [e.condition(k, p) for k, p in self.implied("edge")]
        conditions = [*e.validity(), *[F.lit(False) if x is None else x for x in implied]]
        return [
            F.coalesce(all_of(conditions), F.lit(False)).alias(c["ok"]),
            e.id.expr().cast("string").alias(c["id"]),
            e.label.expr().cast("string").alias(c["label"]),
            far.id.expr().cast(e.end_kinds[far_side]).alias(c["far_key"]),
            far.label.expr().cast("string").alias(c["far_label"]),
            *[p.expr().alias(c[f"p:{k}"]) for k, p in e.properties.items()],
        ]

    def edge_relation(self, pieces: list[tuple[EdgeMapping, str]], predicates: list[tuple[str, P]], props: bool) -> tuple[DataFrame, Edge, Vertex] | None:
        """Edges by the end they are met from: each piece is a mapping and its near side. Also gives the near vertex."""
        predicates = [*predicates, *self.implied("edge")]
        found = [(e, near, rows) for e, near in pieces if self.allowed(e, predicates) and (rows := e.rows(predicates)) is not None]
        if not found:
            return None
        other = {"out": "in", "in": "out"}
        near_type = "long" if all(e.end_kinds[n] == "long" for e, n, _ in found) else "string"
        far_type = "long" if all(e.end_kinds[other[n]] == "long" for e, n, _ in found) else "string"
        names = list(dict.fromkeys(k for e, *_ in found for k in e.properties)) if props else []
        kinds = {k: common(e.kinds[k] for e, *_ in found if k in e.properties) for k in names}
        columns = {k: fresh("p") for k in names}
        id_, label, nk, nl, fk, fl, turned = (fresh(x) for x in ("id", "label", "key", "label", "key", "label", "side"))
        parts = []
        for e, near, rows in found:
            n, f = e.end(near), e.end(other[near])
            cols = [e.id.expr().cast("string").alias(id_), e.label.expr().cast("string").alias(label), n.id.expr().cast(near_type).alias(nk), n.label.expr().cast("string").alias(nl), f.id.expr().cast(far_type).alias(fk), f.label.expr().cast("string").alias(fl), F.lit(near == "out").alias(turned)]
            cols += [as_kind(e.properties[k].expr(), e.kinds[k], kinds[k]).alias(columns[k]) for k in names if k in e.properties]
            parts.append(rows.select(*cols))
        df = united(parts)
        near_v = Vertex(nk, nl, near_type, join_labels(e.end(n).label.known for e, n, _ in found))
        far_v = Vertex(fk, fl, far_type, join_labels(e.end(other[n]).label.known for e, n, _ in found))
        sides = {n for _, n, _ in found}
        if sides == {"out"}:
            ends = {"out": near_v, "in": far_v}
        elif sides == {"in"}:
            ends = {"out": far_v, "in": near_v}
        else:
            key_type = "long" if near_type == far_type == "long" else "string"
            cols = {x: fresh("end") for x in ("ok", "ol", "ik", "il")}
            t = F.col(turned)
            df = df.select(
                "*",
                F.when(t, F.col(nk).cast(key_type)).otherwise(F.col(fk).cast(key_type)).alias(cols["ok"]),
                F.when(t, F.col(nl)).otherwise(F.col(fl)).alias(cols["ol"]),
                F.when(t, F.col(fk).cast(key_type)).otherwise(F.col(nk).cast(key_type)).alias(cols["ik"]),
                F.when(t, F.col(fl)).otherwise(F.col(nl)).alias(cols["il"]),
            )
            labels = join_labels([near_v.labels, far_v.labels])
            ends = {"out": Vertex(cols["ok"], cols["ol"], key_type, labels), "in": Vertex(cols["ik"], cols["il"], key_type, labels)}
        edge = Edge(id_, label, join_labels(e.labels for e, *_ in found), ends, columns, kinds, far_v)
        return df, edge, near_v

    def row_relation(self, e: EdgeMapping, edge_predicates: list[tuple[str, P]], predicates: list[tuple[str, P]]) -> tuple[DataFrame, Vertex, Vertex] | None:
        """An inner edge met from its far end: the near vertex, and the row's own vertex with its properties, from one scan."""
        m = e.owner
        conditions = [e.condition(k, p) for k, p in [*edge_predicates, *self.implied("edge")]]
        found = None if any(c is None for c in conditions) else self.vertex_relation([m], predicates)
        if found is None or not self.allowed(e, edge_predicates):
            return None
        _, own = found
        near_side = "in" if e.owner_side == "out" else "out"
        near, nk, nl = e.end(near_side), fresh("key"), fresh("label")
        rows = m.rows([*predicates, *self.implied("vertex")]).filter(all_of([*e.validity(), *conditions]))
        cols = [near.id.expr().cast(e.end_kinds[near_side]).alias(nk), near.label.expr().cast("string").alias(nl), m.id.expr().cast(own.key_type).alias(own.key), m.label.expr().cast("string").alias(own.label)]
        cols += [as_kind(m.properties[k].expr(), m.kinds[k], own.kinds[k]).alias(c) for k, c in own.props.items()]
        for f in own.foreign:
            cols += self._foreign_columns(f)
        return rows.select(*cols), own, Vertex(nk, nl, e.end_kinds[near_side], near.label.known)

    # joins

    def same_vertex(self, a: Vertex, b: Vertex) -> Column:
        """Equality of two vertices."""
        return all_of(x == y for x, y in self.same_columns(a, b))

    def same_columns(self, a: Vertex, b: Vertex) -> tuple[tuple[Column, Column], ...]:
        """The columns that are equal for one vertex: keys and labels; a label that both can only have is not compared."""
        kind = "long" if a.key_type == b.key_type == "long" else "string"
        cast = lambda v: F.col(v.key) if v.key_type == kind else F.col(v.key).cast(kind)
        keys = (cast(a), cast(b))
        if a.labels is not None and a.labels == b.labels and len(a.labels) == 1:
            return (keys,)
        return keys, (F.col(a.label), F.col(b.label))

    def hydrate(self, frame: Frame, v: Vertex, predicates: list[tuple[str, P]] | None = None) -> tuple[Frame, Vertex]:
        """Join a vertex's properties in. Traversers whose vertex is in no table, or fails ``predicates``, go."""
        if v.props is not None and not predicates:
            return frame, v
        found = self.vertex_relation(self.candidates(v.labels), predicates or [])
        if found is None:
            if predicates:
                return frame.nothing(), replace(v, props=v.props or {})
            return frame.nothing(), replace(v, props={})
        df, own = found
        joined = frame.df.join(df, self.same_vertex(v, own))
        labels = own.labels if v.labels is None or own.labels is None else v.labels & own.labels
        return replace(frame, df=joined), replace(own, key=v.key, key_type=v.key_type, label=v.label, labels=labels)

    def hydrated(self, frame: Frame) -> Frame:
        """``frame`` with the current vertex's properties."""
        if not isinstance(frame.cur, Vertex) or frame.cur.props is not None:
            return frame
        frame, v = self.hydrate(frame, frame.cur)
        return replace(frame, cur=v)

    # unions

    def align(self, shapes: list[Shape]) -> tuple[Shape, list[list[Column]]]:
        """One shape for all, and for each the columns that make it."""
        first = shapes[0]
        if all(isinstance(s, Vertex) for s in shapes):
            kind = "long" if all(s.key_type == "long" for s in shapes) else "string"
            out = Vertex(fresh("key"), fresh("label"), kind, join_labels(s.labels for s in shapes))
            return out, [[F.col(s.key).cast(kind).alias(out.key), F.col(s.label).alias(out.label)] for s in shapes]
        if all(isinstance(s, Edge) for s in shapes):
            names = list(dict.fromkeys(k for s in shapes for k in s.props))
            kinds = {k: common(s.kinds[k] for s in shapes if k in s.props) for k in names}
            ends, columns = {}, [[] for _ in shapes]
            for side in ("out", "in"):
                ends[side], own = self.align([s.ends[side] for s in shapes])
                columns = [a + b for a, b in zip(columns, own, strict=True)]
            far = None
            if all(isinstance(s.far, Vertex) for s in shapes):
                far, own = self.align([s.far for s in shapes])
                columns = [a + b for a, b in zip(columns, own, strict=True)]
            out = Edge(fresh("id"), fresh("label"), join_labels(s.labels for s in shapes), ends, {k: fresh("p") for k in names}, kinds, far)
            for s, c in zip(shapes, columns, strict=True):
                c += [F.col(s.id).alias(out.id), F.col(s.label).alias(out.label)]
                c += [(as_kind(F.col(s.props[k]), s.kinds[k], kinds[k]) if k in s.props else F.lit(None).cast(kinds[k])).alias(out.props[k]) for k in names]
            return out, columns
        if all(isinstance(s, Fields) and s.items.keys() == first.items.keys() for s in shapes):
            items, columns = {}, [[] for _ in shapes]
            for k in first.items:
                items[k], own = self.align([s.items[k] for s in shapes])
                columns = [a + b for a, b in zip(columns, own, strict=True)]
            return Fields(items), columns
        if all(isinstance(s, Pairs) for s in shapes):
            key, a = self.align([s.key for s in shapes])
            value, b = self.align([s.value for s in shapes])
            return Pairs(key, value), [x + y for x, y in zip(a, b, strict=True)]
        kinds = [s.kind if isinstance(s, Value) else T.StringType() for s in shapes]
        out = Value(fresh("v"), common(kinds))
        return out, [[as_kind(self.shown(s), k, out.kind).alias(out.column)] for s, k in zip(shapes, kinds, strict=True)]

    def shown(self, shape: Shape) -> Column:
        """A shape as one column: values as they are, elements by their id, maps as structs."""
        if isinstance(shape, Value):
            return F.col(shape.column)
        if isinstance(shape, Vertex):
            return F.col(shape.key).cast("string")
        if isinstance(shape, Edge):
            return F.col(shape.id)
        if isinstance(shape, Fields):
            return F.struct(*[self.shown(s).alias(k) for k, s in shape.items.items()])
        return F.struct(self.shown(shape.key).alias("k"), self.shown(shape.value).alias("v"))

    def union(self, frames: list[Frame], fallback: Frame) -> Frame:
        """All rows of all frames (of ``fallback``, emptied, if there are none). Tags that all have stay."""
        frames = [f for f in frames if not f.empty]
        if not frames:
            return fallback.nothing()
        if len(frames) == 1:
            return frames[0]
        cur, columns = self.align([f.cur for f in frames])
        tags = {}
        for name in frames[0].tags:
            if all(name in f.tags for f in frames):
                tags[name], own = self.align([f.tags[name] for f in frames])
                columns = [a + b for a, b in zip(columns, own, strict=True)]
        first = frames[0]
        plain = [c for c in (*first.scope, *first.extra)]
        columns = [c + [F.col(x) for x in plain] for c in columns]
        kept = {}
        for x in ("path", "trail", "sack"):
            if all(getattr(f, x) for f in frames):
                kept[x] = fresh(x)
                columns = [c + [F.col(getattr(f, x)).alias(kept[x])] for f, c in zip(frames, columns, strict=True)]
        df = reduce(DataFrame.unionByName, [f.df.select(*c) for f, c in zip(frames, columns, strict=True)])
        bags = {k: v for f in frames for k, v in f.bags.items()}
        return Frame(df, cur, tags, first.scope, first.extra, kept.get("path"), kept.get("trail"), (), max(f.loops for f in frames), kept.get("sack"), False, bags, first.counters)


__all__ = ["ID", "LABEL", "Base", "Edge", "Fields", "Foreign", "Frame", "Pairs", "Shape", "Value", "Vertex", "as_kind", "common", "fresh"]
