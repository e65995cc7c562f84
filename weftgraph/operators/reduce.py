"""Reductions: counts, sums, groups and folds; within a nested traversal, of each outer traverser."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import all_of
from weftgraph.operators.frame import Base, Edge, Fields, Frame, Pairs, Product, Value, fresh

LONG = T.LongType()
REDUCERS = frozenset("count sum min max mean fold group groupCount".split())


class Reduce(Base):
    def aggregated(self, frame: Frame, column: Column, kind: T.DataType | None = None) -> Frame:
        name = fresh("v")
        df = frame.df.groupBy(*frame.scope).agg(column.alias(name)) if frame.scope else frame.df.agg(column.alias(name))
        return Frame(df, Value(name, kind or df.schema[name].dataType), scope=frame.scope, bags=frame.bags)

    def count(self, frame: Frame) -> Frame:
        """How many traversers; 0 of none. Of a nested traversal the zeros are filled in where its results are joined back."""
        product = frame.factors()
        if product is not None and not frame.scope:
            return self.count_product(frame, product)
        return replace(self.aggregated(frame, F.count(F.lit(1)), LONG), empty=False)

    def count_product(self, frame: Frame, p: Product) -> Frame:
        """How many pairs two sides make, from the number of rows that each has of a key; what has to differ is all less what is the same.

        Each side is read once and no pair is made, so the work grows as the sides do. Of an identity only the label may be null, and
        elements of one id of which a label is not known do not count as different, as in the join.
        """
        keys, same = [fresh("k") for _ in p.keys], [fresh("s") for _ in p.apart]
        left, right, alike, value = (fresh(x) for x in ("l", "r", "n", "v"))
        sides = []
        for side, df in enumerate((p.left, p.right)):
            named = df.select(*[pair[side].alias(n) for n, pair in zip([*keys, *same], [*p.keys, *p.apart], strict=True)])
            known = named.filter(all_of(F.col(k).isNotNull() for k in keys))
            sides.append(known.withColumns({left: F.lit(1 - side).cast(LONG), right: F.lit(side).cast(LONG)}))
        df = sides[0].unionByName(sides[1]).groupBy(*keys, *same).agg(F.sum(left).alias(left), F.sum(right).alias(right))
        pairs = F.col(left) * F.col(right)
        if len(same) > 1:
            sure = lambda c: F.sum(F.when(F.col(same[1]).isNotNull(), c).otherwise(0))
            unsure = F.sum(left) * F.sum(right) - sure(F.col(left)) * sure(F.col(right))
            df = df.groupBy(*keys, same[0]).agg(F.sum(left).alias(left), F.sum(right).alias(right), (unsure + sure(pairs)).alias(alike))
        else:
            df = df.withColumn(alike, pairs if same else F.lit(0))
        df = df.groupBy(*keys).agg((F.sum(left) * F.sum(right) - F.sum(alike)).alias(value))
        return Frame(df.agg(F.coalesce(F.sum(value), F.lit(0)).cast(LONG).alias(value)), Value(value, LONG), bags=frame.bags)

    def number(self, frame: Frame, name: str) -> Frame:
        """sum, min, max, mean; nothing of none. Sums of whole numbers stay whole."""
        column = self.shown(frame.cur)
        made = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[name](column)
        out = self.aggregated(frame, made)
        return out.filter(F.col(out.cur.column).isNotNull())

    def fold(self, frame: Frame, args: tuple) -> Frame:
        """All as one list; with a seed and a function of two Columns, as one value."""
        column = self.shown(frame.cur)
        if frame.order:
            # in the order so far: sort by the position that the order gives
            keys = [F.col(c) if d == "asc" else None for c, d in frame.order]
            if all(k is not None for k in keys):
                items = F.transform(F.array_sort(F.collect_list(F.struct(*keys, column.alias("~v")))), lambda x: x["~v"])
                out = self.aggregated(frame, items)
            else:
                ranked = self.ranked(frame)
                out = self.aggregated(ranked, F.transform(F.array_sort(F.collect_list(F.struct(F.col(ranked.extra[-1]), column.alias("~v")))), lambda x: x["~v"]))
        else:
            out = self.aggregated(frame, F.collect_list(column))
        if args:
            seed, f = args
            out = self.put(out, F.aggregate(F.col(out.cur.column), F.lit(seed), f))
        return replace(out, empty=False)

    def ranked(self, frame: Frame) -> Frame:
        from pyspark.sql import Window

        name = fresh("rank")
        w = Window.partitionBy(*frame.scope).orderBy(*self.sorting(frame))
        return replace(frame, df=frame.df.withColumn(name, F.row_number().over(w)), extra=(*frame.extra, name))

    def unfold(self, frame: Frame) -> Frame:
        cur = frame.cur
        if isinstance(cur, Pairs):
            return replace(frame, cur=Fields({"key": cur.key, "value": cur.value}))
        if isinstance(cur, Value) and isinstance(cur.kind, T.ArrayType):
            return self.put(frame, F.explode(F.col(cur.column)), cur.kind.elementType)
        if isinstance(cur, Value) and isinstance(cur.kind, T.MapType):
            key, value = fresh("k"), fresh("v")
            df = frame.df.select("*", F.explode(F.col(cur.column)).alias(key, value))
            return replace(frame, df=df, cur=Fields({"key": Value(key, cur.kind.keyType), "value": Value(value, cur.kind.valueType)}))
        return frame

    def keyed(self, frame: Frame, by: tuple) -> tuple[Frame, Value]:
        frame, column, kind = self.by_column(frame, frame.cur, by)
        name = fresh("k")
        frame = replace(frame, df=frame.df.withColumn(name, column), extra=(*frame.extra, name))
        return frame.filter(F.col(name).isNotNull()), Value(name, kind)

    def group_count(self, frame: Frame, bys: tuple) -> Frame:
        frame, key = self.keyed(frame, bys[0] if bys else ())
        name = fresh("v")
        df = frame.df.groupBy(*frame.scope, key.column).agg(F.count(F.lit(1)).alias(name))
        return Frame(df, Pairs(key, Value(name, LONG)), scope=frame.scope, bags=frame.bags)

    def group(self, frame: Frame, bys: tuple) -> Frame:
        """A row a key: the list of its objects or ``by`` values, or what a nested traversal that ends in a reduction makes of them."""
        frame, key = self.keyed(frame, bys[0] if bys else ())
        by = bys[1] if len(bys) > 1 else ()
        what = by[0] if by else None
        if hasattr(what, "steps") and what.steps and what.steps[-1].name in REDUCERS and not (what.steps[-1].args and what.steps[-1].args[0] == "~local"):
            *before, last = what.steps
            outer = frame.scope
            inner = replace(frame, scope=(*outer, key.column), extra=tuple(x for x in frame.extra if x != key.column))
            keys = inner
            out = self.run_steps(inner, tuple(before))
            out = self.run_steps(out, (last,))
            if last.name == "count" and before:
                all_keys = keys.df.select(*keys.scope).distinct()
                df = all_keys.join(out.df, list(keys.scope), "left").withColumn(out.cur.column, F.coalesce(F.col(out.cur.column), F.lit(0)))
                out = replace(out, df=df)
            return replace(out, cur=Pairs(key, out.cur), scope=outer)
        frame, column, kind = self.by_column(frame, frame.cur, by)
        name = fresh("v")
        df = frame.df.groupBy(*frame.scope, key.column).agg(F.collect_list(column).alias(name))
        return Frame(df, Pairs(key, Value(name, T.ArrayType(kind))), scope=frame.scope, bags=frame.bags)

    # side effects

    def aggregate(self, frame: Frame, name: str, bys: tuple) -> Frame:
        """Remember the objects (or their ``by`` values) so far under a name."""
        kept = frame
        if bys:
            kept, column, kind = self.by_column(frame, frame.cur, bys[0])
            kept = self.drop_null(self.put(kept, column, kind))
        before = frame.bags.get(name)
        bag = kept if before is None else self.union([before, kept], kept)
        return replace(frame, bags={**frame.bags, name: replace(bag, bags={})})

    def subgraph(self, frame: Frame, name: str) -> Frame:
        """Remember the current edges, each once."""
        if not isinstance(frame.cur, Edge):
            raise TypeError("subgraph is made of edges")
        kept = Frame(frame.df.dropDuplicates(frame.cur.identity()), replace(frame.cur, far=None))
        return replace(frame, bags={**frame.bags, name: kept})

    def cap(self, frame: Frame, names: tuple) -> Frame:
        """What was remembered under a name: objects as a list, a subgraph as its edges."""
        found = []
        for n in names:
            if n not in frame.bags:
                value = (self.source.options if self.source is not None else {}).get("side_effects", {}).get(n)
                found.append(self.inject((value,)))
            elif isinstance(frame.bags[n].cur, Edge):
                found.append(frame.bags[n])
            else:
                found.append(self.fold(replace(frame.bags[n], scope=(), order=()), ()))
        if len(found) == 1:
            return replace(found[0], bags=frame.bags)
        df, items = found[0].df, {}
        for n, f in zip(names, found, strict=True):
            df = df if f is found[0] else df.crossJoin(f.df)
            items[n] = f.cur
        return Frame(df, Fields(items), bags=frame.bags)

    def subgraph_vertices(self, frame: Frame) -> Frame:
        """The vertices of a frame of edges, each once."""
        ends = [replace(frame, cur=e).narrow() for e in frame.cur.ends.values()]
        out = self.union(ends, frame)
        return self.hydrated(replace(out, df=out.df.dropDuplicates(out.cur.identity())))
