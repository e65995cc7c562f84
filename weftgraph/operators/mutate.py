"""Mutations: tables stay as they are, and the graph's mappings get new DataFrames over them.

Added elements lie in one table a label, removed ones are anti-joins, changed properties joins with the matched keys. Everything read
later sees them; ``Graph.commit`` writes them out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import functions as F

from weftgraph.functions.predicates import within
from weftgraph.operators.frame import Edge, Vertex
from weftgraph.plans.planner import Planner
from weftgraph.plans.storage import cut
from weftgraph.plans.traversal import Step, Traversal
from weftgraph.sources.mapping import ID, LABEL, EdgeMapping, Endpoint, Mapping, VertexMapping
from weftgraph.sources.properties import Field, Static


def mutate(t: Traversal) -> None:
    """Apply a traversal that ends in mutations to its graph."""
    graph, options = t.graph, t.source.options if t.source is not None else {}
    if options.get("read_only"):
        raise PermissionError("this source is read-only")
    steps = list(t.steps)
    cut = next(i for i, s in enumerate(steps) if s.name in ("addV", "addE", "mergeV", "mergeE", "drop", "property"))
    before, rest = steps[:cut], steps[cut:]
    while rest:
        step = rest.pop(0)
        if step.name == "addV":
            values = _values(rest)
            before = [Step("V", (str(values.setdefault("id", values.pop(ID, None) or str(uuid.uuid4()))),)), Step("hasLabel", (step.args[0] if step.args else "vertex",))]
            if "partition" in options and options["partition"][2] is not None:
                values.setdefault(options["partition"][0], options["partition"][2])
            add_vertex(graph, step.args[0] if step.args else "vertex", values)
        elif step.name == "addE":
            ends = {n: args[0] for n, args, _ in step.mods if n in ("from", "to")}
            if before:
                add_edges(graph, step.args[0], Planner(graph, t.source).run(tuple(before)), ends, _values(rest))
            else:
                add_edge(graph, step.args[0], _one(graph, ends["from"]), _one(graph, ends["to"]), _values(rest))
        elif step.name == "mergeV":
            merge_vertex(graph, dict(step.args[0]), step)
        elif step.name == "mergeE":
            merge_edge(graph, dict(step.args[0]), step)
        elif step.name == "drop" and before and before[-1].name == "properties":
            frame = Planner(graph, t.source).run(tuple(before[:-1]))
            keys = before[-1].args or sorted({k for m in (graph.edges if isinstance(frame.cur, Edge) else graph.vertices) if _relevant(m, frame.cur.labels) for k, p in m.properties.items() if isinstance(p, Field)})
            set_properties(graph, frame, dict.fromkeys(keys))
        elif step.name == "drop":
            drop(graph, Planner(graph, t.source).run(tuple(before)))
        elif step.name == "property":
            values = {step.args[-2]: step.args[-1], **_values(rest)}
            set_properties(graph, Planner(graph, t.source).run(tuple(before)), values)


def _values(rest: list[Step]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    while rest and rest[0].name == "property":
        *_, key, value = rest.pop(0).args
        out[key] = value
    return out


def _one(graph: Any, end: Any) -> tuple[str, str]:
    """(label, id) of an endpoint given so, or as a traversal to one vertex."""
    if isinstance(end, Traversal):
        row = Traversal(graph, end.steps).df().select("label", "id").first()
        if row is None:
            raise LookupError("an edge's endpoint does not exist")
        return row["label"], row["id"]
    return end


def _table(graph: Any, rows: list[dict[str, Any]]) -> Any:
    """A DataFrame of rows with any keys. A column of whole and other numbers is double, one of different types text."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    columns = []
    for name in names:
        found = {type(r[name]) for r in rows if r.get(name) is not None}
        to = next(iter(found)) if len(found) == 1 else float if found <= {int, float} else str
        columns.append([None if r.get(name) is None else r[name] if len(found) == 1 else to(r[name]) for r in rows])
    return graph.spark.createDataFrame(list(zip(*columns, strict=True)), names)


def _overlay(graph: Any, kind: str, label: tuple, row: dict[str, Any], make: Callable[[Callable[[], Any]], Mapping], known: Callable[[], Any | None]) -> None:
    """Add a row to the one table of added elements of a label; elements that are there already are left out when it is read.

    ``known`` gives the (id) of elements of that label in other tables, None if no table can have any.
    """
    overlays = graph.__dict__.setdefault("overlays", {})
    mapping = overlays.get((kind, *label))
    fresh_ = mapping is None or mapping.overlay is None
    rows = {} if fresh_ else mapping.overlay
    rows.setdefault(row["id"], row)  # a second one of the same id changes nothing

    def read() -> Any:
        df, there = _table(graph, list(rows.values())), known()
        return df if there is None else df.join(there.withColumnRenamed("id", "~there"), F.col("id") == F.col("~there"), "left_anti")

    if fresh_:
        mapping = overlays[(kind, *label)] = make(read)
        (graph.vertices if kind == "vertex" else graph.edges).append(mapping)
    mapping.df = read
    mapping.overlay = rows
    mapping.properties |= {k: Field(k) for k in row if k not in ("id", "~out", "~in")}
    for x in ("kinds", "end_kinds"):
        mapping.__dict__.pop(x, None)
    graph.__dict__.pop("labels", None)


def _ids(graph: Any, mappings: list[Mapping], label: str) -> Callable[[], Any | None]:
    """The ids, as text, of elements of a label in the given mappings as they are now."""
    relevant = [(m, m.df) for m in mappings if _relevant(m, frozenset([label])) and not getattr(m, "overlay", None)]

    def known() -> Any | None:
        found = [df.filter(m.label.expr().cast("string") == label).select(m.id.expr().cast("string").alias("id")) for m, df in relevant]
        return reduce(lambda a, b: a.union(b), found) if found else None

    return known


def add_vertex(graph: Any, label: str, values: dict[str, Any]) -> None:
    """Add a vertex; if one of its label and id is there, nothing happens. No job runs until something is read."""
    own = {ID: values.pop(ID, None), "id": values.pop("id", None)}
    id_ = next((str(v) for v in own.values() if v is not None), None)
    row = {"id": id_ or str(uuid.uuid4()), **{k: v for k, v in values.items() if v is not None}}
    known = _ids(graph, graph.vertices, label) if id_ is not None else lambda: None
    _overlay(graph, "vertex", (label,), row, lambda read: VertexMapping(f"added {label}", read, Field("id"), Static(label), {}, False), known)


def add_edge(graph: Any, label: str, out: tuple[str, str], in_: tuple[str, str], values: dict[str, Any]) -> None:
    """Add an edge between two vertices, given as (label, id); if one of its label and id is there, nothing happens."""
    own = {ID: values.pop(ID, None), "id": values.pop("id", None)}
    id_ = next((str(v) for v in own.values() if v is not None), None)
    row = {"id": id_ or str(uuid.uuid4()), "~out": str(out[1]), "~in": str(in_[1]), **{k: v for k, v in values.items() if v is not None}}
    ends = Endpoint(Field("~out"), Static(out[0])), Endpoint(Field("~in"), Static(in_[0]))
    known = _ids(graph, graph.edges, label) if id_ is not None else lambda: None
    _overlay(graph, "edge", (label, out[0], in_[0]), row, lambda read: EdgeMapping(f"added {label}", read, Field("id"), Static(label), {}, False, [], *ends), known)


def add_edges(graph: Any, label: str, frame: Any, ends: dict[str, Any], values: dict[str, Any]) -> None:
    """An edge for each traverser: from and to what a step label names, a literal or a traversal gives, or the current vertex."""

    def end(name: str) -> tuple[Any, Any]:
        what = ends.get(name)
        shape = frame.cur if what is None else frame.tags[what] if isinstance(what, str) else None
        if shape is None:
            vertex_label, id_ = _one(graph, what)
            return F.lit(vertex_label), F.lit(str(id_))
        return F.col(shape.label), F.col(shape.key).cast("string")

    if frame.empty:
        return
    out, in_ = end("from"), end("to")
    id_ = next((values.pop(k) for k in (ID, "id") if k in values), None)
    values = {k: v for k, v in values.items() if v is not None}
    given = [F.lit(v).alias(k) for k, v in values.items()]
    # ids are drawn once, and what the traversal gave is what it was before this change
    df = cut(frame.df.select((F.uuid() if id_ is None else F.lit(str(id_))).alias("id"), out[0].alias("~out_label"), out[1].alias("~out"), in_[0].alias("~in_label"), in_[1].alias("~in"), *given))
    if id_ is not None:
        df = df.dropDuplicates(["id"])
        if (there := _ids(graph, graph.edges, label)()) is not None:
            df = df.join(there.withColumnRenamed("id", "~there"), F.col("id") == F.col("~there"), "left_anti")
    points = Endpoint(Field("~out"), Field("~out_label")), Endpoint(Field("~in"), Field("~in_label"))
    graph.edges.append(EdgeMapping(f"added {label}", df, Field("id"), Static(label), {k: Field(k) for k in values}, False, [], *points))


def merge_vertex(graph: Any, wanted: dict[str, Any], step: Step) -> None:
    """Change the vertices that match, or add one that does."""
    label = wanted.get(LABEL, wanted.get("label", "vertex"))
    keys = [(ID if k in ("id", ID) else k, within(v)) for k, v in wanted.items() if k not in (LABEL, "label")]
    found = Planner(graph).scan_vertices((), [(LABEL, within(label)), *keys])
    if found.empty or found.df.isEmpty():
        created = step.mod("onCreate")
        add_vertex(graph, label, {k: v for k, v in wanted.items() if k not in (LABEL, "label")} | (dict(created[0][0]) if created else {}))
    elif matched := step.mod("onMatch"):
        set_properties(graph, found, dict(matched[0][0]))


def merge_edge(graph: Any, wanted: dict[str, Any], step: Step) -> None:
    """``wanted`` names label, ``out`` and ``in`` as (label, id), and properties."""
    out, in_, label = wanted.pop("out"), wanted.pop("in"), wanted.pop(LABEL, wanted.pop("label", "edge"))
    p = Planner(graph)
    found = p.scan_edges((), [(LABEL, within(label)), *[(k, within(v)) for k, v in wanted.items()]])
    if not found.empty:
        e = found.cur
        found = found.filter((F.col(e.ends["out"].key).cast("string") == str(out[1])) & (F.col(e.ends["out"].label) == out[0]) & (F.col(e.ends["in"].key).cast("string") == str(in_[1])) & (F.col(e.ends["in"].label) == in_[0]))
    if found.empty or found.df.isEmpty():
        created = step.mod("onCreate")
        add_edge(graph, label, out, in_, wanted | (dict(created[0][0]) if created else {}))
    elif matched := step.mod("onMatch"):
        set_properties(graph, found, dict(matched[0][0]))


def _touched(frame: Any) -> Any:
    """(label, id) of the current elements as text, each once."""
    cur = frame.cur
    key = cur.key if isinstance(cur, Vertex) else cur.id
    return frame.df.select(F.col(cur.label).alias("~l"), F.col(key).cast("string").alias("~i")).distinct()


def _relevant(mapping: Mapping, labels: frozenset[str] | None) -> bool:
    return labels is None or mapping.labels is None or bool(labels & mapping.labels)


def _without(mapping: Mapping, gone: Any, id_: Any, label: Any) -> None:
    """Take rows out of a mapping's table whose (label, id), as the given properties read them, are in ``gone``."""
    same = (label.expr().cast("string") == F.col("~l")) & (id_.expr().cast("string") == F.col("~i"))
    mapping.df = mapping.df.join(gone, same, "left_anti")
    mapping.overlay = None
    mapping.__dict__.pop("kinds", None)


def drop(graph: Any, frame: Any) -> None:
    """Remove elements; of vertices, their edges with them."""
    if frame.empty:
        return
    gone, labels = _touched(frame), frame.cur.labels
    if isinstance(frame.cur, Edge):
        for e in graph.edges:
            if _relevant(e, labels):
                _without(e, gone, e.id, e.label)
        return
    for e in graph.edges:
        for end in (e.out, e.in_):
            if labels is None or end.label.known is None or labels & end.label.known:
                _without(e, gone, end.id, end.label)
    for m in graph.vertices:
        if _relevant(m, labels):
            _without(m, gone, m.id, m.label)


def set_properties(graph: Any, frame: Any, values: dict[str, Any]) -> None:
    """Set properties of the current elements; null removes. Keys must be plain columns of their mapping, or new ones."""
    if frame.empty:
        return
    touched, labels = _touched(frame), frame.cur.labels
    for m in graph.edges if isinstance(frame.cur, Edge) else graph.vertices:
        if not _relevant(m, labels):
            continue
        same = (m.label.expr().cast("string") == F.col("~l")) & (m.id.expr().cast("string") == F.col("~i"))
        df = m.df.join(touched.withColumn("~hit", F.lit(True)), same, "left")
        for key, value in values.items():
            schema = m.properties.get(key)
            if schema is None:
                name = key
                df = df.withColumn(name, F.when(F.col("~hit"), F.lit(value)))
                m.properties[key] = Field(name)
            elif isinstance(schema, Field):
                kind = m.df.schema[schema.name].dataType if schema.name in m.df.columns else None
                new = F.lit(value) if kind is None else F.lit(value).cast(kind)
                df = df.withColumn(schema.name, F.when(F.col("~hit"), new).otherwise(F.col(f"`{schema.name}`")))
            else:
                raise ValueError(f"{key} is made of other fields and cannot be set")
        m.df = df.drop("~l", "~i", "~hit")
        m.overlay = None
        m.__dict__.pop("kinds", None)
