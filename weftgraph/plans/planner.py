"""From steps to one DataFrame plan. Predicates that follow a scan or hop are folded into it; the rest is up to Catalyst."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import P, predicate
from weftgraph.functions.scalars import SCALARS
from weftgraph.operators.branch import Branch
from weftgraph.operators.filters import HAS, Filters
from weftgraph.operators.frame import Edge, Fields, Frame, Pairs, Value, Vertex
from weftgraph.operators.navigate import Navigate
from weftgraph.operators.project import Project
from weftgraph.operators.reduce import Reduce

if TYPE_CHECKING:
    from weftgraph.graph import Graph

LOCAL = "~local"
HOPS = frozenset("out in both outE inE bothE".split())
ENDS = frozenset("outV inV bothV otherV".split())


def _mentions(steps: tuple, names: frozenset[str]) -> bool:
    return any(s.name in names or any(hasattr(a, "steps") and _mentions(a.steps, names) for a in (*s.args, *[x for b in s.bys for x in b], *[x for _, m, _ in s.mods for x in m])) for s in steps)


class Planner(Branch, Reduce, Filters, Project, Navigate):
    def __init__(self, graph: Graph, source: Any = None) -> None:
        self.graph, self.source = graph, source
        self.path_bys: tuple = ()
        self.keeps_path = False

    def run(self, steps: tuple) -> Frame:
        self.keeps_path = _mentions(steps, frozenset("path simplePath cyclicPath tree".split()))
        self.path_bys = next((s.bys for s in self._all(steps) if s.name in ("path", "tree") and s.bys), ())
        return self.run_steps(None, steps)

    def _all(self, steps: tuple) -> list:
        return [x for s in steps for x in (s, *[y for a in s.args if hasattr(a, "steps") for y in self._all(a.steps)])]

    def fold_ahead(self, steps: tuple, at: int) -> tuple[int, list[tuple[str, P]]]:
        """How many ``has`` steps after step ``at`` can be part of it, and their predicates; a labelled step is the last."""
        taken, out = 0, []
        if steps[at].labels:
            return 0, []
        while at + 1 + taken < len(steps) and steps[at + 1 + taken].name in HAS and (own := self.folded(steps[at + 1 + taken])):
            out += own
            taken += 1
            if steps[at + taken].labels:
                break
        return taken, out

    def run_steps(self, frame: Frame | None, steps: tuple) -> Frame:
        at = 0
        while at < len(steps):
            step = steps[at]
            taken = 0
            if step.name in HOPS or step.name in ENDS or step.name in ("V", "E"):
                taken, folded = self.fold_ahead(steps, at)
                frame = self.move(frame, step, folded)
            else:
                frame = self.step(frame, step)
            if named := steps[at + taken].labels:
                frame = replace(frame, tags={**frame.tags, **{x: frame.cur for x in named}})
            if self.keeps_path and not frame.scope and step.name not in ("path", "simplePath", "cyclicPath", "as", "identity", "tree", "limit", "range", "skip", "order", "dedup", "where", "filter", "not", "and", "or", "is", *HAS, "hasNot", "repeat", "union", "choose", "coalesce", "optional", "local", "barrier", "aggregate", "store", "sample", "coin", "tail") and not frame.empty:
                frame = self.remember(frame, self.path_bys)
            at += 1 + taken
        return frame

    def move(self, frame: Frame | None, step: Any, folded: list[tuple[str, P]]) -> Frame:
        if step.name in ("V", "E"):
            scanned = self.scan_vertices(step.args, folded) if step.name == "V" else self.scan_edges(step.args, folded)
            if frame is not None:
                return self.mid_scan(frame, scanned)
            return self.start(scanned)
        if step.name in ENDS:
            return self.edge_vertex(frame, step.name[:-1], folded)
        return self.hop(frame, step.name.removesuffix("E"), step.args, step.name.endswith("E"), folded)

    def start(self, frame: Frame) -> Frame:
        options = self.source.options if self.source is not None else {}
        if "sack" in options:
            frame = replace(frame, df=frame.df.withColumn("~sack", F.lit(options["sack"])), sack="~sack")
        return frame

    def step(self, frame: Frame | None, step: Any) -> Frame:
        name, args = step.name, step.args
        local = LOCAL in args
        if name == "inject":
            new = self.inject(args)
            return self.start(new) if frame is None else self.union([frame, new], frame)
        if name == "union":
            if frame is None:
                return self.union([self.run_steps(None, t.steps) for t in args], self.starter())
            return self.union_step(frame, args)
        if frame is None:
            raise ValueError(f"a traversal cannot start with {name}")
        if local and name in ("count", "sum", "min", "max", "mean", "order", "range", "limit", "tail", "dedup", "sample"):
            return self.of_collection(frame, step)
        match name:
            case "has" | "hasLabel" | "hasId":
                return self.has(frame, step)
            case "hasNot":
                return self.has_not(frame, args[0])
            case "hasKey" | "hasValue":
                inner = frame.cur.items["key" if name == "hasKey" else "value"]
                return frame.filter(predicate(args[0] if len(args) == 1 else list(args)).column(F.col(inner.column), inner.kind))
            case "where":
                return self.where(frame, step)
            case "filter":
                if hasattr(args[0], "steps"):
                    return self.semi(frame, args[0].steps, "left_semi")
                return frame.filter(args[0](self.shown(frame.cur)))
            case "not":
                return self.semi(frame, args[0].steps, "left_anti")
            case "and" | "or":
                return self.connective_step(frame, step)
            case "is":
                return self.is_(frame, predicate(args[0]))
            case "match":
                return self.match(frame, args)
            case "dedup":
                return self.dedup(frame, args, step.bys)
            case "order":
                return self.order(frame, step.bys)
            case "limit":
                return self.range(frame, 0, args[-1])
            case "range":
                return self.range(frame, args[-2], args[-1])
            case "skip":
                return self.range(frame, args[-1], -1)
            case "tail":
                return self.tail(frame, args[-1] if args else 1)
            case "sample":
                return self.sample(frame, args[0])
            case "coin":
                return self.coin(frame, args[0])
            case "simplePath" | "cyclicPath":
                return self.simple(frame, name == "simplePath")
            case "identity" | "barrier":
                return frame
            case "none" | "discard":
                return frame.nothing()
            case "count":
                return self.count(frame)
            case "sum" | "min" | "max" | "mean":
                return self.number(frame, name)
            case "fold":
                return self.fold(frame, args)
            case "unfold":
                return self.unfold(frame)
            case "group":
                return self.kept(frame, args, self.group(frame, step.bys))
            case "groupCount":
                return self.kept(frame, args, self.group_count(frame, step.bys))
            case "aggregate" | "store":
                return self.aggregate(frame, [a for a in args if a != LOCAL][-1], step.bys)
            case "subgraph":
                return self.subgraph(frame, args[0])
            case "cap":
                return self.cap(frame, args)
            case "tree":
                out = self.path_step(frame, step.bys)
                return replace(out, df=out.df.dropDuplicates([out.cur.column]))
            case "coalesce":
                return self.coalesce(frame, args)
            case "optional":
                from weftgraph.plans.traversal import Step, Traversal

                return self.coalesce(frame, (args[0], Traversal(steps=(Step("identity"),))))
            case "choose":
                return self.choose(frame, step)
            case "branch":
                return self.branch(frame, step)
            case "local" | "flatMap":
                return self.local(frame, args[0].steps)
            case "map":
                if hasattr(args[0], "steps"):
                    return self.local(frame, args[0].steps, first_only=True)
                return self.drop_null(self.put(frame, args[0](self.shown(frame.cur)), order=frame.order))
            case "sideEffect":
                done = self.run_steps(frame, args[0].steps)
                return replace(frame, bags={**frame.bags, **done.bags})
            case "repeat":
                return self.repeat(frame, step)
            case "loops":
                return self.put(frame, F.lit(self.loops_of(frame, args)))
            case "values":
                return self.values(frame, args)
            case "properties":
                return self.properties(frame, args)
            case "valueMap" | "propertyMap":
                keys = tuple(a for a in args if isinstance(a, str) and not a.startswith("~"))
                return self.map_of(frame, keys, True in args, True)
            case "elementMap":
                return self.map_of(frame, args, True, False)
            case "id":
                return self.put(frame, F.col(frame.cur.key if isinstance(frame.cur, Vertex) else frame.cur.id).cast("string"))
            case "label":
                return self.put(frame, F.col(frame.cur.label))
            case "key" | "value":
                return replace(frame, cur=frame.cur.items[name])
            case "select":
                return self.select(frame, step)
            case "project":
                return self.project(frame, step)
            case "path":
                return self.path_step(frame, step.bys)
            case "math":
                frame, column = self.math_of(frame, frame.cur, step)
                return self.drop_null(self.put(frame, column, order=frame.order))
            case "constant":
                return self.put(frame, F.lit(args[0]))
            case "index":
                return self.put(frame, F.transform(self.shown(frame.cur), lambda x, i: F.struct(x.alias("value"), i.alias("index"))))
            case "sack":
                return self.sack_step(frame, step)
            case "property" | "drop" | "addV" | "addE" | "mergeV" | "mergeE":
                raise ValueError(f"{name} changes the graph; end the traversal with iterate()")
        if name in SCALARS or name == "none":
            return self.scalar(frame, name, args)
        raise NotImplementedError(name)

    def kept(self, frame: Frame, args: tuple, made: Frame) -> Frame:
        """``group('x')`` remembers the map and lets traversers pass."""
        return made if not args else replace(frame, bags={**frame.bags, args[0]: made})

    def connective_step(self, frame: Frame, step: Any) -> Frame:
        return self.connective(frame, step, "left_semi") if self.as_condition(frame, (step,)) is None else self.semi(frame, (step,), "left_semi")

    def of_collection(self, frame: Frame, step: Any) -> Frame:
        """The forms of steps that work within each list, or on the entries of a map."""
        rest = [a for a in step.args if a != LOCAL]
        cur = frame.cur
        if isinstance(cur, Pairs):
            if step.name == "count":
                return self.count(frame)
            if step.name == "order":
                return self.order(frame, step.bys or (("~keys",),))
            if step.name in ("limit", "range", "tail"):
                return self.range(frame, 0, rest[0]) if step.name == "limit" else self.range(frame, *rest) if step.name == "range" else self.tail(frame, rest[0])
            return self.number(replace(frame, cur=cur.value), step.name)
        if step.name == "order" and any("desc" in by for by in step.bys):
            rest = [True]
        return self.scalar(frame, f"{step.name}Local", tuple(rest))

    def sack_step(self, frame: Frame, step: Any) -> Frame:
        """``sack()`` reads; ``sack(op).by(x)`` changes it: sum, mult, minus, div, min, max or assign."""
        if not step.args:
            return self.put(frame, F.col(frame.sack))
        frame, column, _ = self.by_column(frame, frame.cur, step.bys[0] if step.bys else ())
        old = F.col(frame.sack)
        made = {"sum": lambda: old + column, "mult": lambda: old * column, "minus": lambda: old - column, "div": lambda: old / column, "min": lambda: F.least(old, column), "max": lambda: F.greatest(old, column), "assign": lambda: column}[step.args[0]]()
        return replace(frame, df=frame.df.withColumn(f"{frame.sack}_", made), sack=f"{frame.sack}_")

    # results

    def result(self, frame: Frame) -> DataFrame:
        if frame.order:
            frame = replace(frame, df=frame.df.orderBy(*self.sorting(frame)))
        cur = frame.cur
        if isinstance(cur, Vertex):
            frame = self.hydrated(frame) if cur.props is not None else frame
            cur = frame.cur
            return frame.df.select(F.col(cur.key).cast("string").alias("id"), F.col(cur.label).alias("label"), *[F.col(c).alias(k) for k, c in (cur.props or {}).items()])
        if isinstance(cur, Edge):
            ends = [x for s in ("out", "in") for x in (F.col(cur.ends[s].key).cast("string").alias(f"{s}_id"), F.col(cur.ends[s].label).alias(f"{s}_label"))]
            return frame.df.select(F.col(cur.id).alias("id"), F.col(cur.label).alias("label"), *ends, *[F.col(c).alias(k) for k, c in cur.props.items()])
        if isinstance(cur, Fields):
            return frame.df.select(*[self.shown(s).alias(k) for k, s in cur.items.items()])
        if isinstance(cur, Pairs):
            return frame.df.select(self.shown(cur.key).alias("k"), self.shown(cur.value).alias("v"))
        return frame.df.select(F.col(cur.column).alias("value"))

    def profile(self, steps: tuple) -> DataFrame:
        """(source, rows): how many rows of each source the first scan gives, with the predicates that are folded into it."""
        first = steps[0]
        _, folded = self.fold_ahead(steps, 0)
        spark = self.graph.spark
        out = None
        for m in self.graph.vertices if first.name == "V" else self.graph.edges:
            rows = m.rows([*folded, *self.implied("vertex" if first.name == "V" else "edge")])
            if rows is None:
                continue
            one = rows.agg(F.lit(m.name).alias("source"), F.count(F.lit(1)).alias("rows"))
            out = one if out is None else out.union(one)
        return spark.createDataFrame([], "source string, rows long") if out is None else out


__all__ = ["Planner", "Value"]
