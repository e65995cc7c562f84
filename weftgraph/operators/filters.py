"""Filters: predicates on the current object, semi- and anti-joins for nested traversals, duplicates and windows of rows."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import P, all_of, eq, predicate, within
from weftgraph.operators.frame import Base, Edge, Frame, Product, Shape, Vertex, fresh
from weftgraph.sources.mapping import ID, LABEL

HAS = frozenset("has hasLabel hasId".split())


class Filters(Base):
    def folded(self, step: Any) -> list[tuple[str, P]]:
        """The predicates of a ``has`` step."""
        a = step.args
        if step.name == "hasLabel":
            return [(LABEL, a[0] if isinstance(a[0], P) else within(*a))]
        if step.name == "hasId":
            return [(ID, a[0] if isinstance(a[0], P) else within(*a))]
        if step.name != "has" or len(a) == 1:
            return []
        if len(a) == 3:
            return [(LABEL, predicate(a[0])), (a[1], predicate(a[2]))]
        return [(a[0], eq(None) if a[1] is None else predicate(a[1]))] if not hasattr(a[1], "steps") else []

    def has(self, frame: Frame, step: Any) -> Frame:
        pairs = self.folded(step)
        for key, p in pairs:
            if frame.empty:
                return frame
            if key == LABEL and isinstance(frame.cur, (Vertex, Edge)):
                frame = self.filter_label(frame, p)
                continue
            if key == ID and isinstance(frame.cur, Vertex):
                kind = T.LongType() if frame.cur.key_type == "long" else T.StringType()
                frame = frame.filter(p.column(F.col(frame.cur.key), kind), frame.cur)
                continue
            frame, shape, column, kind = self.property_of(frame, frame.cur, key)
            frame = frame.nothing() if column is None else frame.filter(p.column(column, kind), shape)
        if not pairs:  # has(key), has(key, traversal)
            frame, _, column, _ = self.property_of(frame, frame.cur, step.args[0])
            if column is None:
                return frame.nothing()
            frame = frame.filter(column.isNotNull())
            if len(step.args) == 2:
                frame = self.where(frame, replace_values(step))
        return frame

    def has_not(self, frame: Frame, key: str) -> Frame:
        frame, _, column, _ = self.property_of(frame, frame.cur, key)
        return frame if column is None else frame.filter(column.isNull())

    def is_(self, frame: Frame, p: P) -> Frame:
        column = self.shown(frame.cur)
        return frame.filter(p.column(column, self.kind_of(frame, frame.cur)))

    # nested traversals

    def needs(self, steps: tuple) -> set[str]:
        """The labels that nested steps may look up."""
        out: set[str] = set()
        for s in steps:
            if s.name == "select":
                out |= {a for a in s.args if isinstance(a, str)}
            if s.name == "where" and s.args:
                out |= {v for a in s.args for v in ([a] if isinstance(a, str) else a.values if isinstance(a, P) else [])}
            if s.name == "math":
                out |= set(s.args[0].replace("(", " ").replace(")", " ").split())
            out |= set(s.labels)
            for a in (*s.args, *[x for b in s.bys for x in b], *[x for _, m, _ in s.mods for x in m]):
                if hasattr(a, "steps"):
                    out |= self.needs(a.steps)
        return out

    def origin(self, frame: Frame, shape: Shape, steps: tuple, distinct: bool) -> tuple[Frame, list[tuple[str, str]]]:
        """Where a nested traversal starts: each different current object (with the labels that it reads) once.

        Also gives the pairs of columns, of ``frame`` and of the nested result, that tell whose result is whose.
        """
        tags = {k: s for k, s in frame.tags.items() if k in self.needs(steps)}
        named = list(dict.fromkeys([*shape.identity(), *[c for s in tags.values() for c in s.identity()]]))
        own = {c: fresh("o") for c in named}
        df = frame.df.select(*named)
        df = (df.distinct() if distinct else df).withColumns({o: F.col(c) for c, o in own.items()})
        bare = lambda s: s.bare() if isinstance(s, Vertex) else s
        if isinstance(shape, Edge):
            shape, df, own = self._whole_edge(frame, shape, df, own, distinct)
        child = Frame(df, bare(shape), {k: bare(s) for k, s in tags.items()}, scope=tuple(own.values()), sack=None, empty=frame.empty, bags=frame.bags, loops=frame.loops, counters=frame.counters)
        return child, list(own.items())

    def _whole_edge(self, frame: Frame, e: Edge, df: Any, own: dict[str, str], distinct: bool) -> tuple:
        columns = e.columns()
        df = frame.df.select(*dict.fromkeys([*columns, *own]))
        df = (df.dropDuplicates(list(own)) if distinct else df).withColumns({o: F.col(c) for c, o in own.items()})
        return e, df, own

    def matches(self, pairs: list[tuple[str, str]]) -> Column:
        return all_of(F.col(a) == F.col(b) for a, b in pairs)

    def exists(self, frame: Frame, steps: tuple) -> tuple[Frame, list[tuple[str, str]]] | None:
        """The traversers for whom nested ``steps`` give anything, as (their columns, the pairs to match); None if for none."""
        first = steps[0] if steps else None
        cur = frame.cur
        if isinstance(cur, Vertex) and first is not None and first.name in ("out", "in", "both", "outE", "inE", "bothE") and not (self.needs(steps) & set(frame.tags)) and not any(s.name in ("path", "simplePath", "cyclicPath") for s in steps):
            child = self.edge_start(cur, first, steps)
            if child is None:
                return None
            child, near, rest = child
            out = self.run_steps(replace(child, scope=tuple(near.identity()), loops=frame.loops, counters=frame.counters), rest)
            if out.empty:
                return None
            both_long = cur.key_type == near.key_type
            if both_long:
                pairs = [(cur.key, near.key)]
                if not (cur.labels is not None and cur.labels == near.labels and len(cur.labels) == 1):
                    pairs.append((cur.label, near.label))
                return out, pairs
        child, pairs = self.origin(frame, frame.cur, steps, distinct=False)
        out = self.run_steps(child, steps)
        return None if out.empty else (out, pairs)

    def edge_start(self, v: Vertex, first: Any, steps: tuple) -> tuple[Frame, Vertex, tuple] | None:
        """The edges that a nested hop would meet from any vertex like ``v``: a semi-join needs no more."""
        to_edge = first.name.endswith("E")
        direction = first.name.removesuffix("E")
        wanted = self.flat_labels(first.args)
        taken, folded = self.fold_ahead(steps, 0)
        predicates = [(LABEL, within(*sorted(wanted)))] if wanted is not None else []
        found = self.edge_relation(self.pieces(v, direction, wanted), predicates + (folded if to_edge else []), props=to_edge)
        if found is None:
            return None
        df, edge, near = found
        child = Frame(df, edge if to_edge else edge.far, scope=tuple(near.identity()))
        if first.labels:
            child = replace(child, tags={x: child.cur for x in first.labels})
        if not to_edge:
            child = self.narrow_vertices(child, folded)
        return child, near, steps[1 + taken :]

    def where(self, frame: Frame, step: Any) -> Frame:
        a = step.args
        if hasattr(a[0], "steps"):
            return self.semi(frame, a[0].steps, "left_semi")
        if len(a) == 1:  # where(neq('b')): the current object against a labelled one
            left, p = frame.cur, a[0]
        else:
            left, p = frame.tags[a[0]], a[1]
        return self.compare_shapes(frame, left, p, step.bys)

    def compare_shapes(self, frame: Frame, left: Shape, p: P, bys: tuple) -> Frame:
        """A predicate whose operands are labels."""
        if p.op in ("and", "or", "not"):
            parts = []
            for v in p.values:
                frame, c = self._shape_condition(frame, left, v, bys)
                parts.append(c)
            return frame.filter(~parts[0] if p.op == "not" else parts[0] & parts[1] if p.op == "and" else parts[0] | parts[1])
        frame, condition = self._shape_condition(frame, left, p, bys)
        product = None if bys else frame.factors()
        return frame.filter(condition) if product is None else self.filter_product(frame, product, condition, left, p)

    def filter_product(self, frame: Frame, product: Product, condition: Column, left: Shape, p: P) -> Frame:
        """``frame`` where two elements are (not) the same, as a product where one can say so."""
        out, right = frame.filter(condition), frame.tags[p.values[0]]
        if p.op not in ("eq", "neq") or type(left) is not type(right) or not isinstance(left, (Vertex, Edge)):
            return out
        a, b = product.side(left), product.side(right)
        if a is None or b is None:
            return out
        if a == b:
            return replace(out, product=replace(product, df=out.df, **{a: getattr(product, a).filter(condition)}))
        pairs = self.same_columns(left, right) if isinstance(left, Vertex) else ((F.col(left.id), F.col(right.id)), (F.col(left.label), F.col(right.label)))
        pairs = pairs if a == "left" else tuple((y, x) for x, y in pairs)
        if p.op == "eq":
            return replace(out, product=replace(product, df=out.df, keys=(*product.keys, *pairs)))
        return out if product.apart else replace(out, product=replace(product, df=out.df, apart=pairs))

    def _shape_condition(self, frame: Frame, left: Shape, p: P, bys: tuple) -> tuple[Frame, Column]:
        right = frame.tags[p.values[0]]
        if not bys and isinstance(left, (Vertex, Edge)) and isinstance(right, (Vertex, Edge)) and p.op in ("eq", "neq"):
            if type(left) is not type(right):
                return frame, F.lit(p.op == "neq")
            same = self.same_vertex(left, right) if isinstance(left, Vertex) else (F.col(left.id) == F.col(right.id)) & (F.col(left.label) == F.col(right.label))
            return frame, same if p.op == "eq" else ~same
        frame, a, ka = self.by_column(frame, left, bys[0] if bys else ())
        frame, b, kb = self.by_column(frame, right, bys[-1] if bys else ())
        ops = {"eq": lambda: a == b, "neq": lambda: a != b, "gt": lambda: a > b, "gte": lambda: a >= b, "lt": lambda: a < b, "lte": lambda: a <= b}
        if ka != kb:
            a, b = a.cast("string"), b.cast("string")
        return frame, ops[p.op]()

    def as_condition(self, frame: Frame, steps: tuple) -> Column | None:
        """Nested steps that only test the current object, as one condition; None if they do more."""
        parts = []
        value: tuple[Column, T.DataType] | None = None  # what a step before gave in place of the current object
        for s in steps:
            if s.labels or s.name not in (*HAS, "hasNot", "is", "and", "or", "not", "identity", "loops") or value is not None and s.name != "is":
                return None
            if s.name == "loops":
                value = F.lit(self.loops_of(frame, s.args)), T.IntegerType()
                continue
            if s.name in ("and", "or", "not"):
                own = [self.as_condition(frame, t.steps) if hasattr(t, "steps") else None for t in s.args]
                if any(c is None for c in own):
                    return None
                parts.append(~F.coalesce(own[0], F.lit(False)) if s.name == "not" else all_of(own) if s.name == "and" else own[0] if len(own) == 1 else own[0] | own[1] if len(own) == 2 else F.greatest(*[F.coalesce(c, F.lit(False)) for c in own]))
                continue
            cur = frame.cur
            if s.name == "is":
                parts.append(predicate(s.args[0]).column(*(value or (self.shown(cur), self.kind_of(frame, cur)))))
                continue
            if not isinstance(cur, (Vertex, Edge)) or isinstance(cur, Vertex) and cur.props is None and any(k not in (ID, LABEL) for k, _ in self.folded(s) or [("?", None)]):
                return None
            if s.name == "hasNot" or s.name == "has" and len(s.args) == 1:
                _, _, column, _ = self.property_of(frame, cur, s.args[0])
                parts.append(F.lit(s.name == "hasNot") if column is None else column.isNull() if s.name == "hasNot" else column.isNotNull())
                continue
            if s.name == "has" and hasattr(s.args[-1], "steps"):
                return None
            for key, p in self.folded(s):
                _, _, column, kind = self.property_of(frame, cur, key)
                if key == ID and isinstance(cur, Vertex) and cur.key_type == "long":
                    column, kind = F.col(cur.key), T.LongType()
                parts.append(F.lit(False) if column is None else p.column(column, kind))
        return all_of(parts) if parts else F.lit(True)

    def semi(self, frame: Frame, steps: tuple, how: str) -> Frame:
        """The traversers for whom nested ``steps`` give something (``left_semi``) or nothing (``left_anti``)."""
        if frame.empty:
            return frame
        if steps and steps[0].name == "identity" and steps[0].labels:
            return self.from_label(frame, steps, how)
        if isinstance(frame.cur, Vertex) and frame.cur.props is None and all(s.name in (*HAS, "hasNot", "and", "or", "not") for s in steps):
            frame = self.hydrated(frame)
        condition = self.as_condition(frame, steps)
        if condition is not None:
            condition = F.coalesce(condition, F.lit(False))
            return frame.filter(condition if how == "left_semi" else ~condition)
        if len(steps) == 1 and steps[0].name in ("and", "or", "not"):
            return self.connective(frame, steps[0], how)
        found = self.exists(frame, steps)
        if found is None:
            return frame.nothing() if how == "left_semi" else frame
        child, pairs = found
        right = child.df.select(*[o for _, o in pairs])
        return replace(frame, df=frame.df.join(right, self.matches(pairs), how))

    def connective(self, frame: Frame, step: Any, how: str) -> Frame:
        if step.name == "not":
            return self.semi(frame, step.args[0].steps, "left_anti" if how == "left_semi" else "left_semi")
        keep_all = (step.name == "and") == (how == "left_semi")
        if keep_all:
            for t in step.args:
                frame = self.semi(frame, t.steps, how)
            return frame
        frames, rest = [], frame
        for t in step.args:  # each traverser by the first branch that decides for it
            frames.append(self.semi(rest, t.steps, how))
            rest = self.semi(rest, t.steps, "left_anti" if how == "left_semi" else "left_semi")
        some = [f for f in frames if not f.empty]
        if not some:
            return frame.nothing()
        df = some[0].df
        for f in some[1:]:
            df = df.unionByName(f.df, allowMissingColumns=True)
        return replace(frame, df=df)

    def from_label(self, frame: Frame, steps: tuple, how: str) -> Frame:
        """``where(as('a')...as('b'))``: a nested traversal from one labelled object, which may end at another."""
        start, *rest = steps
        name = start.labels[0]
        moved = replace(frame, cur=frame.tags[name])
        end = rest[-1].labels[0] if rest and rest[-1].labels and rest[-1].labels[0] in frame.tags else None
        if end is None:
            return replace(self.semi(moved, tuple(rest), how), cur=frame.cur)
        rest[-1] = replace(rest[-1], labels=())
        child, pairs = self.origin(moved, moved.cur, tuple(rest), distinct=False)
        out = self.run_steps(child, tuple(rest))
        target = frame.tags[end]
        right = out.df.select(*out.cur.identity(), *[o for _, o in pairs])
        same = self.same_vertex(target, out.cur) if isinstance(target, Vertex) else all_of(F.col(a) == F.col(b) for a, b in zip(target.identity(), out.cur.identity(), strict=True))
        return replace(frame, df=frame.df.join(right, self.matches(pairs) & same, how))

    # duplicates and windows

    def dedup(self, frame: Frame, names: tuple, bys: tuple) -> Frame:
        """One row for each different object, labelled objects or ``by`` values (within each outer traverser): after ``order`` the first."""
        shapes = [frame.tags[n] for n in names] or [frame.cur]
        columns = list(frame.scope)
        for i, shape in enumerate(shapes):
            if bys:
                frame, column, _ = self.by_column(frame, shape, bys[i % len(bys)])
                name = fresh("d")
                frame = replace(frame, df=frame.df.withColumn(name, column)).filter(F.col(name).isNotNull())
                columns.append(name)
            else:
                columns += shape.identity()
        if frame.order:  # ranks are taken within each task first, so a frequent value is no large group
            n = fresh("n")
            first = F.row_number().over(Window.partitionBy(*columns).orderBy(*self.sorting(frame)))
            return replace(frame, df=frame.df.withColumn(n, first).filter(F.col(n) <= 1).drop(n))
        return replace(frame, df=frame.df.dropDuplicates(columns))

    def loops_of(self, frame: Frame, args: tuple) -> int:
        """How often the loop around has run, or the one of a name."""
        return frame.counters.get(args[0], 0) if args else frame.loops

    def order(self, frame: Frame, bys: tuple) -> Frame:
        order = []
        for by in bys or ((),):
            direction = next((b for b in by if isinstance(b, str) and b in ("asc", "desc", "shuffle")), "asc")
            name = fresh("ord")
            if direction == "shuffle":
                frame = replace(frame, df=frame.df.withColumn(name, F.rand()))
                direction = "asc"
            else:
                frame, column, _ = self.by_column(frame, frame.cur, by)
                frame = replace(frame, df=frame.df.withColumn(name, column))
            order.append((name, direction))
        return replace(frame, order=tuple(order))

    def sorting(self, frame: Frame, backward: bool = False) -> list[Column]:
        return [F.col(c).desc() if (d == "desc") != backward else F.col(c).asc() for c, d in frame.order]

    def range(self, frame: Frame, low: int, high: int) -> Frame:
        """Rows ``low`` to below ``high`` (-1: all) in the order so far; of each outer traverser within a nested traversal."""
        if frame.scope:
            n = fresh("n")
            w = Window.partitionBy(*frame.scope).orderBy(*(self.sorting(frame) or [F.lit(0)]))
            df = frame.df.withColumn(n, F.row_number().over(w))
            condition = F.col(n) > low
            if high >= 0:
                condition = condition & (F.col(n) <= high)
            return replace(frame, df=df.filter(condition).drop(n))
        df = frame.df.orderBy(*self.sorting(frame)) if frame.order else frame.df
        if low:
            df = df.offset(low)
        return replace(frame, df=df.limit(max(0, high - low)) if high >= 0 else df)

    def tail(self, frame: Frame, n: int) -> Frame:
        """The last ``n`` in the order so far. Without ``order`` rows have none, and any ``n`` are given."""
        back = replace(frame, order=tuple((c, "asc" if d == "desc" else "desc") for c, d in frame.order))
        return replace(self.range(back, 0, n), order=frame.order)

    def sample(self, frame: Frame, n: int) -> Frame:
        mixed = self.order(frame, (("shuffle",),))
        return replace(self.range(mixed, 0, n), order=())

    def coin(self, frame: Frame, chance: float) -> Frame:
        return frame.filter(F.rand() < chance)


def replace_values(step: Any) -> Any:
    """``has(key, traversal)`` as ``where`` on the key's value."""
    from weftgraph.plans.traversal import Step, Traversal

    return replace(step, name="where", args=(Traversal(steps=(Step("values", (step.args[0],)), *step.args[1].steps)),))
