"""The fluent traversal: an immutable list of steps. Nothing runs until a terminal method asks for rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from weftgraph.graph import Graph


class T:
    """Tokens for an element's id, label, key and value."""

    id, label, key, value = "~id", "~label", "~key", "~value"


class Order:
    asc, desc, shuffle = "asc", "desc", "shuffle"


asc, desc, shuffle = Order.asc, Order.desc, Order.shuffle
#: Scope of steps that work on one collection.
local = "~local"
#: Columns of map entries, for ``select``.
keys, values = "~keys", "~values"

STEPS = frozenset(
    "V E inject union addV addE mergeV mergeE has hasLabel hasId hasNot hasKey hasValue where and or not filter is dedup limit range skip tail sample coin simplePath cyclicPath identity barrier none discard match "
    "out in both outE inE bothE outV inV bothV otherV count sum min max mean group groupCount fold unfold aggregate store cap tree subgraph order coalesce choose optional local repeat loops branch flatMap map sideEffect "
    "values properties valueMap elementMap propertyMap id label key value select project path math constant sack index drop property "
    "toUpper toLower length trim lTrim rTrim substring replace split concat reverse asString format asNumber asLong asBool abs asDate dateAdd dateDiff conjoin all any noneOf intersect difference disjunct merge combine product".split()
)
#: Calls that change the step before them (or, for a loop, the one after).
MODULATORS = frozenset("by as times until emit option from to with onCreate onMatch".split())
LOOP = frozenset("times until emit".split())


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()
    bys: tuple[tuple, ...] = ()
    labels: tuple[str, ...] = ()
    mods: tuple[tuple[str, tuple, bool], ...] = ()  # name, arguments, whether it stood before the step

    def mod(self, name: str) -> tuple[tuple, bool] | None:
        return next(((args, before) for n, args, before in self.mods if n == name), None)


class Traversal:
    """Steps so far. Any step is a method; names that Python reserves take a trailing underscore (``in_``, ``as_``, ``is_``)."""

    def __init__(self, graph: Graph | None = None, steps: tuple[Step, ...] = (), pending: tuple = (), source: Any = None) -> None:
        self.graph, self.steps, self.pending, self.source = graph, steps, pending, source

    def __getattr__(self, name: str) -> Any:
        plain = name.rstrip("_")
        if plain in STEPS or plain in MODULATORS:
            return lambda *args: self._add(plain, args)
        raise AttributeError(name)

    def _with(self, steps: tuple[Step, ...], pending: tuple = ()) -> Traversal:
        return Traversal(self.graph, steps, pending, self.source)

    def _add(self, name: str, args: tuple) -> Traversal:
        if name in STEPS:
            mods = self.pending if name == "repeat" else ()
            return self._with((*self.steps, Step(name, args, mods=mods)), () if name == "repeat" else self.pending)
        last = self.steps[-1] if self.steps else None
        if name in LOOP and (last is None or last.name != "repeat"):
            return self._with(self.steps, (*self.pending, (name, args, True)))
        if name == "as" and last is None:
            return self._with((Step("identity", labels=args),))
        if last is None:
            raise ValueError(f"{name} needs a step before it")
        if name == "by":
            last = replace(last, bys=(*last.bys, args))
        elif name == "as":
            last = replace(last, labels=(*last.labels, *args))
        else:
            last = replace(last, mods=(*last.mods, (name, args, False)))
        return self._with((*self.steps[:-1], last))

    # terminals

    def frame(self) -> Any:
        from weftgraph.plans.planner import Planner

        return Planner(self.graph, self.source).run(self.steps)

    def df(self) -> DataFrame:
        """The result as a DataFrame: ``value``; or id, label and properties; or a column for each name of a map."""
        from weftgraph.plans.planner import Planner

        planner = Planner(self.graph, self.source)
        return planner.result(planner.run(self.steps))

    def toDF(self, *names: str) -> DataFrame:
        return self.df().toDF(*names)

    def toList(self) -> list:
        rows = self.df().collect()
        return [r[0] for r in rows] if rows and len(rows[0]) == 1 else rows

    def next(self) -> Any:
        row = self.df().first()
        return None if row is None else row[0] if len(row) == 1 else row

    def hasNext(self) -> bool:
        return not self.df().isEmpty()

    def iterate(self) -> None:
        """Run for its effect: mutations change the graph, other traversals are executed without returning rows."""
        if self.steps and any(s.name in ("addV", "addE", "mergeV", "mergeE", "drop", "property") for s in self.steps):
            from weftgraph.operators.mutate import mutate

            mutate(self)
        else:
            self.df().foreach(lambda _: None)

    def explain(self, mode: str = "formatted") -> None:
        self.df().explain(mode)

    def profile(self) -> DataFrame:
        """A row a source that the plan reads, with the number of rows that its part of the first scan gives."""
        from weftgraph.plans.planner import Planner

        return Planner(self.graph, self.source).profile(self.steps)


class _Anonymous:
    """``__``: traversals that start from the current traverser."""

    def __getattr__(self, name: str) -> Any:
        return getattr(Traversal(), name)


__ = _Anonymous()


class GraphTraversalSource:
    """``g``: where traversals start, with what holds for all of them."""

    def __init__(self, graph: Graph, options: dict[str, Any] | None = None) -> None:
        self.graph, self.options = graph, options or {}

    def _start(self, name: str, args: tuple) -> Traversal:
        return Traversal(self.graph, source=self)._add(name, args)

    def __getattr__(self, name: str) -> Any:
        plain = name.rstrip("_")
        if plain in ("V", "E", "inject", "union", "addV", "addE", "mergeV", "mergeE"):
            return lambda *args: self._start(plain, args)
        raise AttributeError(name)

    def _option(self, **more: Any) -> GraphTraversalSource:
        return GraphTraversalSource(self.graph, self.options | more)

    def withPartition(self, key: str, *read: str, write: str | None = None) -> GraphTraversalSource:
        """Only elements whose ``key`` is one of ``read``; new ones get ``write``."""
        return self._option(partition=(key, tuple(read), write))

    def withSubgraph(self, vertices: Traversal | None = None, edges: Traversal | None = None) -> GraphTraversalSource:
        """Only vertices and edges that meet these traversals' ``has`` steps."""
        return self._option(subgraph=(vertices, edges))

    def withReadOnly(self) -> GraphTraversalSource:
        return self._option(read_only=True)

    def withSack(self, value: Any) -> GraphTraversalSource:
        return self._option(sack=value)

    def withSideEffect(self, name: str, value: Any) -> GraphTraversalSource:
        return self._option(side_effects={**self.options.get("side_effects", {}), name: value})
