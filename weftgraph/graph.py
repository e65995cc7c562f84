"""A graph: the mappings of all providers over one session."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftgraph.functions.predicates import P
from weftgraph.plans.traversal import GraphTraversalSource, Traversal
from weftgraph.sources.catalog import CATALOG, URGENT
from weftgraph.sources.mapping import EdgeMapping, Mapping, VertexMapping, parse
from weftgraph.sources.providers import given, load, tables_of


class Graph:
    """Vertices and edges of one or more providers.

    ``traversal_filter`` may veto a mapping for given predicates. ``max_depth`` bounds loops without ``times``.
    """

    def __init__(self, spark: SparkSession, vertices: list[VertexMapping], edges: list[EdgeMapping], traversal_filter: Callable[[Mapping, list[tuple[str, P]]], bool] | None = None, max_depth: int | None = None) -> None:
        self.spark, self.vertices, self.edges = spark, vertices, edges
        self.traversal_filter, self.max_depth = traversal_filter, max_depth
        self.path: str | None = None

    @classmethod
    def of(cls, spark: SparkSession, config: dict[str, Any] | list[dict[str, Any]], tables: dict[str, DataFrame] | None = None, **options: Any) -> Graph:
        """A graph of one configuration or several; ``tables`` stand in for what their providers would read."""
        vertices: list[VertexMapping] = []
        edges: list[EdgeMapping] = []
        for one in config if isinstance(config, list) else [config]:
            v, e = parse(one, given(tables) if tables is not None else tables_of(spark, one))
            vertices += v
            edges += e
        return cls(spark, vertices, edges, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> Graph:
        """The graph of a configuration file, or of all those in a folder, as one federated graph."""
        graph = cls.of(spark, load(path), **options)
        graph.path = path
        return graph

    def structure(self, kind: str, *ids: Any) -> DataFrame:
        """The vertices (``V``) or edges (``E``) with these ids, all if none are given."""
        return getattr(self.traversal(), kind)(*ids).df()

    def reload(self) -> Graph:
        """Read the configuration again."""
        if self.path is None:
            raise ValueError("this graph was not opened from a path")
        fresh = Graph.open(self.spark, self.path, traversal_filter=self.traversal_filter, max_depth=self.max_depth)
        self.vertices, self.edges = fresh.vertices, fresh.edges
        self.__dict__.pop("labels", None)
        return self

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, urgent: bool = False) -> Graph:
        """The graph over the driver's tables in a folder."""
        reader = {"class": "parquet", "path": f"{sf_dir}/{{table}}.parquet"}
        return cls.of(spark, [CATALOG | reader, *([URGENT | reader] if urgent else [])])

    @cached_property
    def labels(self) -> frozenset[str]:
        """All vertex labels that are known without reading data."""
        return frozenset().union(*[m.labels or frozenset() for m in self.vertices])

    def traversal(self) -> GraphTraversalSource:
        return GraphTraversalSource(self)

    def commit(self, folder: str) -> None:
        """Write every table as it is after mutations, a Parquet folder each."""
        for i, m in enumerate([*self.vertices, *self.edges]):
            m.df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{i:03d}-{''.join(c if c.isalnum() else '_' for c in m.name)}")


__all__ = ["Graph", "Traversal"]
