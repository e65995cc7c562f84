"""Stateless traversals over a stream of edges: a graph whose edge table is a streaming DataFrame, joined with static vertices.

Scans, ``has``, hops, ``values`` and projections of a stream are stream-static joins and need no state. Counts in event-time windows
are the one stateful form here, with a watermark that bounds what is kept.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph


def stream_graph(spark: SparkSession, config: dict[str, Any], static: dict[str, DataFrame], streams: dict[str, DataFrame]) -> Graph:
    """A graph over static tables and streams, by table name. Start traversals at the streamed edges: ``g.E().hasLabel(..)``."""
    return Graph.of(spark, config, {**static, **streams})


def windowed_counts(edges: DataFrame, time: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts by ``keys`` in tumbling windows of event time; rows more than ``late`` behind are dropped."""
    return edges.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("start"), *keys, "cnt")
