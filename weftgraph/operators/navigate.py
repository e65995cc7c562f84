"""Scans and hops: a hop is an equi-join of traversers with edges, or no join at all where the vertex's own row holds the edge."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import P, within
from weftgraph.operators.frame import Base, Edge, Frame, Product, Shape, Value, Vertex, fresh
from weftgraph.sources.mapping import ID, LABEL, EdgeMapping

OTHER = {"out": "in", "in": "out"}


def label_limits(predicates: list[tuple[str, P]]) -> frozenset[str] | None:
    """The labels that ``predicates`` leave, if they name any."""
    out: frozenset[str] | None = None
    for key, p in predicates:
        if key == LABEL and p.op in ("eq", "within"):
            own = frozenset(map(str, p.values))
            out = own if out is None else out & own
    return out


class Navigate(Base):
    def flat_labels(self, labels: tuple) -> frozenset[str] | None:
        names = [x for one in labels for x in (one if isinstance(one, (list, tuple, set)) else [one])]
        return frozenset(names) or None

    # scans

    def scan_vertices(self, args: tuple, predicates: list[tuple[str, P]]) -> Frame:
        if args and isinstance(args[0], str) and len(args) > 1 and args[0] in self.graph.labels:  # V('customer', 1, 2)
            predicates = [(LABEL, within(args[0])), (ID, within(*args[1:])), *predicates]
        elif args:
            ids = [getattr(a, "id", a) for one in args for a in (one if isinstance(one, (list, tuple, set)) else [one])]
            predicates = [(ID, within(*ids)), *predicates]
        found = self.vertex_relation(self.candidates(label_limits(predicates)), predicates)
        if found is None:
            key, label = fresh("key"), fresh("label")
            return Frame(self.graph.spark.createDataFrame([], f"{key} string, {label} string"), Vertex(key, label, "string", frozenset(), {}), empty=True)
        return Frame(*found, once=found[1].key)

    def scan_edges(self, args: tuple, predicates: list[tuple[str, P]]) -> Frame:
        if args:
            predicates = [(ID, within(*[x for one in args for x in (one if isinstance(one, (list, tuple, set)) else [one])])), *predicates]
        limits = label_limits(predicates)
        pieces = [(e, "out") for e in self.graph.edges if limits is None or e.labels is None or e.labels & limits]
        found = self.edge_relation(pieces, predicates, props=True)
        if found is None:
            names = [fresh("c") for _ in range(6)]
            df = self.graph.spark.createDataFrame([], ", ".join(f"{n} string" for n in names))
            ends = {"out": Vertex(names[2], names[3], "string", frozenset()), "in": Vertex(names[4], names[5], "string", frozenset())}
            return Frame(df, Edge(names[0], names[1], frozenset(), ends, {}, {}), empty=True)
        df, edge, _ = found
        return Frame(df, replace(edge, far=None))

    def mid_scan(self, frame: Frame, scanned: Frame) -> Frame:
        """``V()`` within a traversal: every traverser with every vertex that the scan leaves."""
        if frame.empty or scanned.empty:
            return replace(frame, df=frame.df.crossJoin(scanned.df.limit(0)), cur=scanned.cur, empty=True)
        return replace(frame.narrow(), df=frame.narrow().df.crossJoin(scanned.df), cur=scanned.cur, order=())

    # hops

    def pieces(self, v: Vertex, direction: str, labels: frozenset[str] | None) -> list[tuple[EdgeMapping, str]]:
        """The edge mappings that a hop can meet, each with its near end."""
        out = []
        for near in ("out", "in") if direction == "both" else (direction,):
            for e in self.graph.edges:
                own = e.end(near).label.known
                if labels is not None and e.labels is not None and not e.labels & labels:
                    continue
                if v.labels is not None and own is not None and not v.labels & own:
                    continue
                out.append((e, near))
        return out

    def hop(self, frame: Frame, direction: str, labels: tuple, to_edge: bool, predicates: list[tuple[str, P]]) -> Frame:
        """``out``, ``in``, ``both`` and their edge forms. ``predicates`` hold for what the hop leads to."""
        v = frame.cur
        if not isinstance(v, Vertex):
            raise TypeError("a hop starts at vertices")
        wanted = self.flat_labels(labels)
        edge_predicates = [(LABEL, within(*sorted(wanted)))] if wanted is not None else []
        if to_edge:
            edge_predicates += predicates
        pieces = self.pieces(v, direction, wanted)
        limits = None if to_edge else label_limits(predicates)
        if limits is not None:
            pieces = [(e, n) for e, n in pieces if (k := e.end(OTHER[n]).label.known) is None or k & limits]
        held = {id(f.mapping): f for f in v.foreign}
        # an inner edge of the current row itself needs no join
        rows = [(held[id(e)], n) for e, n in pieces if id(e) in held and e.owner_side == n and not to_edge]
        joined = [(e, n) for e, n in pieces if not (id(e) in held and e.owner_side == n and not to_edge)]
        frames = [self._row_hop(frame, f, wanted) for f, _ in rows]
        if not to_edge and not rows and len(joined) == 1 and self.own_rows(*joined[0]):
            # the far vertex is the edge's own row: its properties come along, and its predicates reach the one scan
            found = self.row_relation(joined[0][0], edge_predicates, predicates)
            if found is None:
                return replace(frame, cur=v.bare()).nothing()
            df, far, near = found
            out = self.joined(frame, v, df, near, far)
            return replace(out, order=(), once=far.key if frame.once == v.key else None)
        if joined and (found := self.edge_relation(joined, edge_predicates, props=to_edge)) is not None:
            df, edge, near = found
            frames.append(self.joined(frame, v, df, near, edge if to_edge else edge.far))
        out = self.union(frames, replace(frame, cur=v.bare()))
        out = replace(out, order=())
        return out if to_edge or out.empty else self.narrow_vertices(out, predicates)

    def joined(self, frame: Frame, v: Vertex, df: DataFrame, near: Vertex, cur: Shape) -> Frame:
        """Traversers at ``v`` with the rows of ``df`` whose near vertex it is. Both sides are kept if many traversers may be at one vertex."""
        left = replace(frame, cur=v.bare()).narrow()
        rows = left.df.join(df, self.same_vertex(v, near))
        product = None if frame.once == v.key or rows.isStreaming else Product(rows, left.df, df, self.same_columns(v, near))
        return replace(left, df=rows, cur=cur, once=None, product=product)

    def own_rows(self, e: EdgeMapping, near: str) -> bool:
        """Whether the far end of an edge is the row that holds it, and no other table has vertices like it."""
        m = e.owner
        return m is not None and e.owner_side == OTHER[near] and e.df is m.df and m.labels is not None and self.candidates(m.labels) == [m]

    def _row_hop(self, frame: Frame, f: Any, wanted: frozenset[str] | None) -> Frame:
        c, far_side = f.columns, OTHER[f.mapping.owner_side]
        condition = F.col(c["ok"])
        if wanted is not None and (f.mapping.labels is None or not f.mapping.labels <= wanted):
            condition = condition & F.col(c["label"]).isin(sorted(wanted))
        key, label = fresh("key"), fresh("label")
        far = Vertex(key, label, f.mapping.end_kinds[far_side], f.mapping.end(far_side).label.known)
        left = replace(frame, cur=far)
        keep = [x for x in left.live() if x not in (key, label)]
        return replace(left, df=frame.df.filter(condition).select(*keep, F.col(c["far_key"]).alias(key), F.col(c["far_label"]).alias(label)))

    def narrow_vertices(self, frame: Frame, predicates: list[tuple[str, P]]) -> Frame:
        """``frame`` with only those current vertices that meet ``predicates``; labels and ids are decided without their tables."""
        rest: list[tuple[str, P]] = []
        for key, p in predicates:
            if key == LABEL:
                frame = self.filter_label(frame, p)
            else:
                rest.append((key, p))
            if frame.empty:
                return frame
        if rest or self.implied("vertex"):
            frame, v = self.hydrate(frame, frame.cur, rest)
            return replace(frame, cur=v)
        return frame

    def filter_label(self, frame: Frame, p: P) -> Frame:
        cur = frame.cur
        labels = getattr(cur, "labels", None)
        if labels is not None and p.op in ("eq", "within"):
            wanted = frozenset(map(str, p.values))
            if not labels & wanted:
                return frame.nothing()
            frame = replace(frame, cur=replace(cur, labels=labels & wanted))
            if labels <= wanted:
                return frame
        return frame.filter(p.column(F.col(cur.label)), cur)

    # from edges to vertices

    def edge_vertex(self, frame: Frame, which: str, predicates: list[tuple[str, P]]) -> Frame:
        e = frame.cur
        if not isinstance(e, Edge):
            raise TypeError(f"{which}V starts at edges")
        if which == "other":
            if not isinstance(e.far, Vertex):
                return replace(frame, cur=e.ends["in"]).nothing()
            frames = [replace(frame, cur=e.far)]
        else:
            frames = [replace(frame, cur=e.ends[s]) for s in (("out", "in") if which == "both" else (which,))]
        out = self.union([f.narrow() for f in frames], frame)
        return self.narrow_vertices(replace(out, order=()), predicates)

    # literal starts

    def inject(self, values: tuple) -> Frame:
        name = fresh("v")
        rows = [(v,) for v in values]
        df = self.graph.spark.createDataFrame(rows, [name]) if rows else self.graph.spark.createDataFrame([], f"{name} string")
        return Frame(df, Value(name, df.schema[0].dataType), empty=not rows)

    def starter(self) -> Frame:
        """One traverser that stands for nothing; what starts from it leaves it out."""
        return self.inject((0,))
