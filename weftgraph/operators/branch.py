"""Branches and loops: nested traversals run over all different outer objects at once, and their results are joined back."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import P, all_of, eq, predicate
from weftgraph.operators.frame import Base, Frame, Shape, Value, fresh
from weftgraph.plans.storage import cut

#: Levels after which a loop without ``times`` is taken to be endless.
DEEPEST = 64


class Branch(Base):
    def nested(self, frame: Frame, shape: Shape, steps: tuple) -> tuple[Frame, list[tuple[str, str]]]:
        """Results of ``steps`` for each different object, and the columns that match them to traversers."""
        child, pairs = self.origin(frame, shape, steps, distinct=True)
        return self.run_steps(child, steps), pairs

    def rejoin(self, frame: Frame, child: Frame, pairs: list[tuple[str, str]], how: str = "inner") -> Frame:
        """Traversers with the results of the nested traversal for their object as the new current object."""
        right = child.df.select(*dict.fromkeys([*[o for _, o in pairs], *child.cur.columns(), *[c for s in child.tags.values() for c in s.columns() if c not in frame.df.columns]]))
        names = [c for c in right.columns if c in frame.df.columns and c not in [o for _, o in pairs]]
        if names:  # a nested traversal that keeps the object itself
            return replace(frame, df=frame.df.join(right.select(*[o for _, o in pairs]), self.matches(pairs), how))
        df = frame.df.join(right, self.matches(pairs), how)
        tags = {k: s for k, s in child.tags.items() if k not in frame.tags}
        return replace(frame, df=df, cur=child.cur, tags={**frame.tags, **tags}, order=())

    def local(self, frame: Frame, steps: tuple, first_only: bool = False) -> Frame:
        """``local``, ``flatMap`` and ``map`` (the first result only)."""
        child, pairs = self.nested(frame, frame.cur, steps)
        if first_only and not child.empty:
            child = self.range(child, 0, 1)
        if child.empty and not self.fills(steps):
            return replace(frame, cur=child.cur).nothing()
        if self.fills(steps):
            out = self.rejoin(frame, child, pairs, "left")
            name = out.cur.column
            return replace(out, df=out.df.withColumn(name, F.coalesce(F.col(name), self.zero(steps, out.cur))))
        return self.rejoin(frame, child, pairs)

    @staticmethod
    def fills(steps: tuple) -> bool:
        """Whether nested steps give a result of nothing, too."""
        return bool(steps) and steps[-1].name in ("count", "fold") and not steps[-1].args

    @staticmethod
    def zero(steps: tuple, value: Value) -> Column:
        return F.lit(0) if steps[-1].name == "count" else F.array().cast(value.kind)

    def nested_value(self, frame: Frame, shape: Shape, steps: tuple) -> tuple[Frame, Column, T.DataType]:
        """A nested traversal's first result as a column; null for traversers for whom it gives none."""
        child, pairs = self.nested(frame, shape, steps)
        name = fresh("v")
        if child.empty and not self.fills(steps):
            return frame, F.lit(None).cast("string"), T.StringType()
        kind = self.kind_of(child, child.cur)
        if child.order or not (steps and steps[-1].name in ("count", "sum", "min", "max", "mean", "fold")):
            child = self.range(child, 0, 1)
        right = child.df.select(*[o for _, o in pairs], self.shown(child.cur).alias(name))
        df = frame.df.join(right, self.matches(pairs), "left").drop(*[o for _, o in pairs])
        frame = replace(frame, df=df, extra=(*frame.extra, name))
        column = F.col(name)
        if self.fills(steps):
            column = F.coalesce(column, self.zero(steps, Value(name, kind)))
        return frame, column, kind

    # branches

    def union_step(self, frame: Frame, branches: tuple) -> Frame:
        """Every branch over all traversers; what a branch does globally, it does over all of them."""
        return self.union([self.run_steps(frame, t.steps) for t in branches], frame)

    def coalesce(self, frame: Frame, branches: tuple) -> Frame:
        """Of each traverser the results of the first branch that gives any."""
        found, rest = [], frame
        for i, t in enumerate(branches):
            if rest.empty:
                break
            if all(s.name in ("constant", "identity") and not s.labels for s in t.steps):
                found.append(self.run_steps(rest, t.steps))
                break
            child, pairs = self.nested(rest, rest.cur, t.steps)
            if child.empty and not self.fills(t.steps):
                continue
            found.append(self.rejoin(rest, child, pairs, "left" if self.fills(t.steps) else "inner") if not self.fills(t.steps) else self.local(rest, t.steps))
            if self.fills(t.steps) or i == len(branches) - 1:
                break
            right = child.df.select(*[o for _, o in pairs])
            rest = replace(rest, df=rest.df.join(right, self.matches(pairs), "left_anti"))
        return self.union([f.narrow() for f in found], frame)

    def choose(self, frame: Frame, step: Any) -> Frame:
        """If and else by a nested traversal or predicate, or branches by a value (``option``)."""
        what, *branches = step.args
        options = [args for n, args, _ in step.mods if n == "option"]
        if branches:
            yes, no = self.split(frame, what)
            taken = [self.run_steps(yes, branches[0].steps)]
            taken.append(self.run_steps(no, branches[1].steps) if len(branches) > 1 else no)
            return self.union([f.narrow() for f in taken], frame)
        frame, column, kind = self.by_column(frame, frame.cur, (what,))
        name = fresh("choice")
        frame = replace(frame, df=frame.df.withColumn(name, column), extra=(*frame.extra, name))
        taken, used = [], F.lit(False)
        for value, t in [o for o in options if len(o) == 2 and o[0] != "none"]:
            mine = F.coalesce(predicate(value).column(F.col(name), kind), F.lit(False))
            taken.append(self.run_steps(frame.filter(mine & ~used), t.steps))
            used = used | mine
        rest = next((o[-1] for o in options if len(o) == 1 or o[0] == "none"), None)
        others = frame.filter(~used)
        taken.append(others if rest is None else self.run_steps(others, rest.steps))
        return self.union([f.narrow() for f in taken], frame)

    def split(self, frame: Frame, what: Any) -> tuple[Frame, Frame]:
        if isinstance(what, P) or not hasattr(what, "steps"):
            p = what if isinstance(what, P) else eq(what)
            condition = F.coalesce(p.column(self.shown(frame.cur), self.kind_of(frame, frame.cur)), F.lit(False))
            return frame.filter(condition), frame.filter(~condition)
        return self.semi(frame, what.steps, "left_semi"), self.semi(frame, what.steps, "left_anti")

    def match(self, frame: Frame, patterns: tuple) -> Frame:
        """Conjunctive patterns ``as(a)...as(b)`` as joins over variables; each next pattern starts from one that is bound."""
        left = [list(t.steps) for t in patterns]
        bound = set(frame.tags)
        first = left[0][0].labels[0]
        if first not in bound:
            frame = replace(frame, tags={**frame.tags, first: frame.cur})
            bound.add(first)
        names = [first]
        while left:
            ready = next((p for p in left if p[0].labels and p[0].labels[0] in bound), None)
            if ready is None:
                raise ValueError("match: a pattern starts from a variable that nothing binds")
            left.remove(ready)
            start, *rest = ready
            end = rest[-1].labels[0] if rest and rest[-1].labels else None
            moved = replace(frame, cur=frame.tags[start.labels[0]], order=())
            if rest and rest[0].name in ("where", "not", "and", "or") or end is None:
                frame = replace(self.semi(moved, tuple(rest), "left_semi"), cur=frame.cur)
                continue
            rest[-1] = replace(rest[-1], labels=())
            out = self.run_steps(moved, tuple(rest))
            if end in bound:
                a, b = frame.tags[end], out.cur
                same = self.same_vertex(a, b) if hasattr(a, "key") else all_of(F.col(x) == F.col(y) for x, y in zip(a.identity(), b.identity(), strict=True))
                frame = out.filter(same)
            else:
                frame = replace(out, tags={**out.tags, end: out.cur})
                bound.add(end)
                names.append(end)
        from weftgraph.operators.frame import Fields

        return replace(frame, cur=Fields({n: frame.tags[n] for n in frame.tags if n in bound}))

    # loops

    def repeat(self, frame: Frame, step: Any) -> Frame:
        """``repeat`` with ``times``, ``until`` and ``emit``, each before it (while) or after it (do-while).

        ``times`` unrolls. With ``until`` the driver goes level by level, cuts the plan every few levels, and stops when no traverser
        is left; where labels alone decide, no job is needed for that.
        """
        body, name = step.args[-1].steps, step.args[0] if isinstance(step.args[0], str) else None

        def at(f: Frame, n: int) -> Frame:
            return replace(f, loops=n, counters={**frame.counters, name: n} if name else frame.counters)

        times, until, emit = step.mod("times"), step.mod("until"), step.mod("emit")
        out: list[Frame] = []
        cur = at(frame, 0)
        limit = times[0][0] if times else self.graph.max_depth or DEEPEST
        level = 0

        def emitted(f: Frame) -> Frame:
            return self.semi(f, emit[0][0].steps, "left_semi") if emit[0] and hasattr(emit[0][0], "steps") else f

        while not cur.empty:
            if emit and emit[1]:
                out.append(emitted(cur))
            if until and until[1]:
                done, cur = self.split(cur, until[0][0])
                out.append(done)
                if self.exhausted(cur, level):
                    break
            if level == limit:
                if times and not (emit and emit[1]):
                    out.append(cur)
                elif not times:
                    raise RecursionError(f"the loop goes on after {limit} levels; set max_depth or times")
                break
            cur = at(self.run_steps(cur, body), level + 1)
            level += 1
            if cur.empty:
                break
            if until and not until[1]:
                done, cur = self.split(cur, until[0][0])
                out.append(done)
            if emit and not emit[1] and not (times and level == limit):
                out.append(emitted(cur))
            if until or not times:
                if self.exhausted(cur, level):
                    break
                if level % 4 == 0:
                    cur = replace(cur.narrow(), df=cut(cur.narrow().df))
        return replace(self.union([f.narrow() for f in out], cur), loops=frame.loops, counters=frame.counters)

    def branch(self, frame: Frame, step: Any) -> Frame:
        """``branch(t).option(value, ..)``: each traverser goes down every option that its value meets, and down those for ``any``; those
        that meet none go down ``none``, or end here."""
        frame, column, kind = self.by_column(frame, frame.cur, (step.args[0],))
        name = fresh("choice")
        frame = replace(frame, df=frame.df.withColumn(name, column), extra=(*frame.extra, name))
        taken, met = [], F.lit(False)
        options = [args if len(args) == 2 else ("none", args[0]) for n, args, _ in step.mods if n == "option"]
        for value, t in options:
            if value in ("none", "any"):
                continue
            mine = F.coalesce(predicate(value).column(F.col(name), kind), F.lit(False))
            taken.append(self.run_steps(frame.filter(mine), t.steps))
            met = met | mine
        taken += [self.run_steps(frame if value == "any" else frame.filter(~met), t.steps) for value, t in options if value in ("none", "any")]
        return self.union([f.narrow() for f in taken], frame)

    def exhausted(self, frame: Frame, level: int) -> bool:
        return frame.empty or level > 0 and frame.df.isEmpty()
