"""Values of the current object: properties, maps, labelled objects, paths, arithmetic and scalar functions."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import NUMERIC
from weftgraph.functions.scalars import SCALARS, math_column, math_names
from weftgraph.operators.frame import Base, Edge, Fields, Frame, Pairs, Shape, Value, Vertex, as_kind, common, fresh
from weftgraph.sources.mapping import ID, LABEL

STRING = T.StringType()
#: Steps that are one Column of the current object, so that a nested traversal of them needs no join.
PLAIN = frozenset(["values", "id", "label", "constant", "select", "math", "identity", "key", "value", "sack", "loops", *SCALARS])


class Project(Base):
    # single values

    def property_of(self, frame: Frame, shape: Shape, key: str) -> tuple[Frame, Shape, Column | None, T.DataType]:
        """The column of a property, with the frame and shape that have it; None if no element has such a property."""
        if key == ID:
            return frame, shape, F.col(shape.key if isinstance(shape, Vertex) else shape.id).cast("string"), STRING
        if key == LABEL:
            return frame, shape, F.col(shape.label), STRING
        if isinstance(shape, Fields):
            inner = shape.items.get(key)
            return (frame, shape, None, STRING) if inner is None else (frame, shape, self.shown(inner), self.kind_of(frame, inner))
        if isinstance(shape, Value):
            if isinstance(shape.kind, T.MapType):
                return frame, shape, F.try_element_at(F.col(shape.column), F.lit(key)), shape.kind.valueType
            if isinstance(shape.kind, T.StructType) and key in shape.kind.names:
                return frame, shape, F.col(shape.column)[key], shape.kind[key].dataType
            return frame, shape, None, STRING
        if isinstance(shape, Vertex) and shape.props is None:
            before = shape
            frame, shape = self.hydrate(frame, shape)
            frame = replace(frame, cur=shape if frame.cur is before else frame.cur, tags={k: shape if s is before else s for k, s in frame.tags.items()})
        if key in shape.props:
            return frame, shape, F.col(shape.props[key]), shape.kinds[key]
        head, _, path = key.partition(".")
        if path and head in shape.props and isinstance(shape.kinds[head], T.StringType):
            return frame, shape, F.get_json_object(F.col(shape.props[head]), "$." + path), STRING
        return frame, shape, None, STRING

    def kind_of(self, frame: Frame, shape: Shape) -> T.DataType:
        return shape.kind if isinstance(shape, Value) else STRING if isinstance(shape, (Vertex, Edge)) else frame.df.select(self.shown(shape).alias("x")).schema[0].dataType

    def put(self, frame: Frame, column: Column, kind: T.DataType | None = None, **changes: Any) -> Frame:
        """``frame`` with a new current value."""
        name = fresh("v")
        df = frame.df.withColumn(name, column)
        return replace(frame, df=df, cur=Value(name, kind or df.schema[name].dataType), **changes)

    def values(self, frame: Frame, keys: tuple) -> Frame:
        """The values of ``keys`` (of all, if none are named) that are there; values of a list property each by themselves."""
        if isinstance(frame.cur, (Vertex, Edge)) and not keys:
            frame = self.hydrated(frame)
            keys = tuple(frame.cur.props)
        found = []
        for key in keys:
            frame, shape, column, kind = self.property_of(frame, frame.cur, key)
            frame = replace(frame, cur=shape)
            if column is not None:
                found.append((column, kind))
        if not found:
            return self.put(frame, F.lit(None).cast("string")).nothing()
        if len(found) == 1:
            column, kind = found[0]
            if isinstance(kind, T.ArrayType):
                return self.put(frame, F.explode(column), kind.elementType)
            return self.drop_null(self.put(frame, column, kind))
        kind = common(k for _, k in found)
        return self.put(frame, F.explode(F.array_compact(F.array(*[as_kind(c, k, kind) for c, k in found]))), kind)

    def drop_null(self, frame: Frame) -> Frame:
        return frame.filter(F.col(frame.cur.column).isNotNull())

    def properties(self, frame: Frame, keys: tuple) -> Frame:
        """(key, value) of each property that is there; values as text if they differ in type."""
        frame = self.hydrated(frame)
        props = {k: c for k, c in frame.cur.props.items() if not keys or k in keys}
        if not props:
            return self.put(frame, F.lit(None).cast("string")).nothing()
        kind = common(frame.cur.kinds[k] for k in props)
        items = F.array(*[F.struct(F.lit(k).alias("key"), as_kind(F.col(c), frame.cur.kinds[k], kind).alias("value")) for k, c in props.items()])
        name = fresh("pv")
        df = frame.df.withColumn(name, F.explode(F.filter(items, lambda x: x["value"].isNotNull())))
        key, value = fresh("k"), fresh("v")
        df = df.withColumns({key: F.col(name)["key"], value: F.col(name)["value"]})
        return replace(frame, df=df, cur=Fields({"key": Value(key, STRING), "value": Value(value, kind)}))

    def map_of(self, frame: Frame, keys: tuple, tokens: bool, lists: bool) -> Frame:
        """``valueMap`` (values in lists) and ``elementMap`` (with id and label): a map of the entries that are there. Values keep their
        type where all have one (or are numbers, which have one in common); a map of different types, or with id and label, has text."""
        frame = self.hydrated(frame)
        cur = frame.cur
        entries = [(k, F.col(c), cur.kinds[k]) for k, c in cur.props.items() if not keys or k in keys]
        if tokens:
            entries = [("id", F.col(cur.key if isinstance(cur, Vertex) else cur.id), None), ("label", F.col(cur.label), STRING), *entries]

        want = STRING if tokens else common(k for _, _, k in entries)

        def text(c: Column, k: T.DataType | None) -> Column:
            return as_kind(c, k, want) if k is not None and (want != STRING or isinstance(k, (T.ArrayType, T.MapType, T.StructType))) else c.cast(want)

        made = F.array(*[F.struct(F.lit(n), (F.array(text(c, k)) if lists else text(c, k)).alias("v")) for n, c, k in entries])
        keep = (lambda x: x["v"][0].isNotNull()) if lists else (lambda x: x["v"].isNotNull())
        return self.put(frame, F.map_from_entries(F.filter(made, keep)))

    def scalar(self, frame: Frame, name: str, args: tuple) -> Frame:
        """A scalar step; rows without a result go."""
        column = self.shown(frame.cur)
        if name == "asNumber" and isinstance(self.kind_of(frame, frame.cur), NUMERIC):
            return frame  # whole numbers stay whole
        given = []
        for a in args:
            if hasattr(a, "steps"):
                frame, c, _ = self.by_column(frame, frame.cur, (a,))
                given.append(c)
            else:
                given.append(a)
        return self.drop_null(self.put(frame, SCALARS[name](column, *given), order=frame.order))

    # by()

    def by_column(self, frame: Frame, shape: Shape, by: tuple) -> tuple[Frame, Column, T.DataType]:
        """What a ``by`` gives of ``shape``: a property, a token, or a nested traversal's first result; null if it gives none."""
        what = next((b for b in by if not (isinstance(b, str) and b in ("asc", "desc", "shuffle"))), None)
        if what is None:
            return frame, self.shown(shape), self.kind_of(frame, shape)
        if isinstance(what, str):
            if isinstance(shape, Pairs):
                inner = shape.key if what == "~keys" else shape.value
                return frame, self.shown(inner), self.kind_of(frame, inner)
            if what in ("~key", "~value") and isinstance(shape, Fields):
                what = what[1:]
            frame, _, column, kind = self.property_of(frame, shape, what)
            return frame, F.lit(None).cast("string") if column is None else column, kind
        steps = what.steps
        if all(s.name in PLAIN and (s.name != "values" or len(s.args) == 1) and not s.labels for s in steps):
            return self._plain(frame, shape, steps)
        return self.nested_value(frame, shape, steps)

    def _plain(self, frame: Frame, shape: Shape, steps: tuple) -> tuple[Frame, Column, T.DataType]:
        column: Column | None = None
        kind: T.DataType = STRING
        for s in steps:
            if s.name == "identity":
                continue
            if s.name == "values":
                frame, _, column, kind = self.property_of(frame, shape, s.args[0])
                column = F.lit(None).cast("string") if column is None else column
            elif s.name == "id":
                frame, _, column, kind = self.property_of(frame, shape, ID)
            elif s.name == "label":
                frame, _, column, kind = self.property_of(frame, shape, LABEL)
            elif s.name == "constant":
                column, kind = F.lit(s.args[0]), None
            elif s.name == "sack":
                column, kind = F.col(frame.sack), None
            elif s.name == "loops":
                column, kind = F.lit(self.loops_of(frame, s.args)), T.IntegerType()
            elif s.name in ("key", "value"):
                frame, _, column, kind = self.property_of(frame, shape, s.args[0] if s.args else s.name)
            elif s.name == "select" and len(s.args) == 1:
                shape = frame.tags[s.args[0]] if s.args[0] in frame.tags else shape.items[s.args[0]] if isinstance(shape, Fields) else shape
                if s.bys:
                    frame, column, kind = self.by_column(frame, shape, s.bys[0])
                else:
                    column = None
            elif s.name == "math":
                frame, column = self.math_of(frame, shape, s)
                kind = T.DoubleType()
            elif s.name == "asNumber" and isinstance(kind if column is not None else self.kind_of(frame, shape), NUMERIC):
                column = self.shown(shape) if column is None else column
            else:
                column, kind = SCALARS[s.name](self.shown(shape) if column is None else column, *s.args), None
        if column is None:
            return frame, self.shown(shape), self.kind_of(frame, shape)
        if kind is None:
            kind = frame.df.select(column.alias("x")).schema[0].dataType
        return frame, column, kind

    def math_of(self, frame: Frame, shape: Shape, step: Any) -> tuple[Frame, Column]:
        """Arithmetic over labelled objects, ``_`` for the current one, or properties where there is no such label."""
        variables = {}
        for i, name in enumerate(math_names(step.args[0])):
            by = step.bys[i % len(step.bys)] if step.bys else ()
            if name == "_" or name in frame.tags:
                frame, variables[name], _ = self.by_column(frame, shape if name == "_" else frame.tags[name], by)
            elif isinstance(shape, Fields) and name in shape.items:
                variables[name] = self.shown(shape.items[name])
            else:
                frame, shape, column, _ = self.property_of(frame, shape, name)
                if column is None:
                    raise ValueError(f"math: there is no {name!r}")
                variables[name] = column
        return frame, math_column(step.args[0], variables)

    # maps and labels

    def project(self, frame: Frame, step: Any) -> Frame:
        items = {}
        cur = frame.cur
        for i, name in enumerate(step.args):
            by = step.bys[i % len(step.bys)] if step.bys else ()
            if not by and isinstance(cur, (Vertex, Edge)):
                items[name] = cur
                continue
            frame, column, kind = self.by_column(frame, cur, by)
            cur = frame.cur if isinstance(cur, Vertex) and isinstance(frame.cur, Vertex) and frame.cur.key == cur.key else cur
            col = fresh("v")
            frame = replace(frame, df=frame.df.withColumn(col, column), extra=(*frame.extra, col))
            items[name] = Value(col, kind)
        return replace(frame, cur=Fields(items), extra=tuple(x for x in frame.extra if all(not isinstance(v, Value) or v.column != x for v in items.values())))

    def select(self, frame: Frame, step: Any) -> Frame:
        names = step.args
        if names in (("~keys",), ("~values",)):
            cur = frame.cur
            if isinstance(cur, Pairs):
                return replace(frame, cur=cur.key if names[0] == "~keys" else cur.value)
            if isinstance(cur, Fields):
                names_ = [F.lit(k) for k in cur.items] if names[0] == "~keys" else [self.shown(s).cast("string") for s in cur.items.values()]
                return self.put(frame, F.array(*names_))
            return self.put(frame, (F.map_keys if names[0] == "~keys" else F.map_values)(F.col(cur.column)))
        found = {}
        for n in names:
            if n in frame.tags:
                found[n] = frame.tags[n]
            elif isinstance(frame.cur, Fields) and n in frame.cur.items:
                found[n] = frame.cur.items[n]
            elif isinstance(frame.cur, Value) and isinstance(frame.cur.kind, (T.MapType, T.StructType)):
                frame, _, column, kind = self.property_of(frame, frame.cur, n)
                col = fresh("v")
                frame = replace(frame, df=frame.df.withColumn(col, column))
                found[n] = Value(col, kind)
            else:
                return frame.nothing()
        if not step.bys:
            if len(found) == 1:
                only = next(iter(found.values()))
                out = replace(frame, cur=only)
                return out.filter(F.col(only.column).isNotNull()) if isinstance(only, Value) else out
            return replace(frame, cur=Fields(found))
        items = {}
        for i, (n, shape) in enumerate(found.items()):
            frame, column, kind = self.by_column(frame, shape, step.bys[i % len(step.bys)])
            col = fresh("v")
            frame = replace(frame, df=frame.df.withColumn(col, column), extra=(*frame.extra, col))
            items[n] = Value(col, kind)
        own = {v.column for v in items.values()}
        frame = replace(frame, extra=tuple(x for x in frame.extra if x not in own))
        for v in items.values():  # a by() without a result drops the traverser
            frame = frame.filter(F.col(v.column).isNotNull())
        return replace(frame, cur=next(iter(items.values())) if len(items) == 1 else Fields(items))

    # paths

    def remember(self, frame: Frame, bys: tuple) -> Frame:
        """Append the current object to the path, as the ``by`` whose turn it is shows it, and to the trail of identities."""
        cur = frame.cur
        if isinstance(cur, (Fields, Pairs)):
            shown, same = F.to_json(self.shown(cur)), F.to_json(self.shown(cur))
        elif isinstance(cur, Value):
            shown = same = as_kind(F.col(cur.column), cur.kind, STRING)
        else:
            shown, same = self.shown(cur), F.concat_ws("\x1f", F.lit("v" if isinstance(cur, Vertex) else "e"), *[F.col(c).cast("string") for c in cur.identity()])
        if bys and not isinstance(cur, Value):
            options = []
            for by in bys:
                frame, column, kind = self.by_column(frame, frame.cur, by)
                options.append(as_kind(column, kind, STRING))
            turn = F.size(frame.path) % len(bys) + 1 if frame.path else F.lit(1)
            shown = options[0] if len(options) == 1 else F.element_at(F.array(*options), turn)
        path, trail = fresh("path"), fresh("trail")
        empty = F.array().cast("array<string>")
        before = {"path": F.col(frame.path) if frame.path else empty, "trail": F.col(frame.trail) if frame.trail else empty}
        df = frame.df.withColumns({path: F.concat(before["path"], F.array(shown)), trail: F.concat(before["trail"], F.array(same))})
        return replace(frame, df=df, path=path, trail=trail)

    def path_step(self, frame: Frame, bys: tuple) -> Frame:
        """The path as a list of texts. A ``by`` that gives nothing for a step drops the traverser."""
        whole = F.col(frame.path)
        if bys:
            frame = frame.filter(F.forall(whole, lambda x: x.isNotNull()))
        return self.put(frame, whole)

    def simple(self, frame: Frame, simple: bool) -> Frame:
        trail = F.col(frame.trail)
        same = F.size(F.array_distinct(trail)) == F.size(trail)
        return frame.filter(same if simple else ~same)

    def nested_value(self, frame: Frame, shape: Shape, steps: tuple) -> tuple[Frame, Column, T.DataType]:
        raise NotImplementedError
