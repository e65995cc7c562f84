"""Connected components by alternating large-star and small-star steps, all of them joins and minima.

Before each step every task connects the links it holds by itself, in blocks of a bounded number, so that a step has to join only
what lies in several blocks, and links that fit one block take no step at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import discard, map_arrow, materialize

#: Links that a task connects at once: 16 bytes each, and some five times that while it works.
BLOCK = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (u, v) but the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    least = np.arange(len(nodes))
    while True:
        both = np.minimum(least[u], least[v])
        after = least.copy()
        np.minimum.at(after, least[u], both)
        np.minimum.at(after, least[v], both)
        after = after[after]
        if (after == least).all():
            break
        least = after
    others = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[others], nodes[least[others]]


def _connector(block: int) -> Callable:
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            ends = [np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*ends)], names=["u", "v"])

        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, block - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == block:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    return connect


def connected_components(links: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """(node, component) for every node of ``links`` (longs) that is not the smallest of its component.

    Links are undirected; repeated links, links to oneself and links with a null end count for nothing. Each step writes its edges
    to the shared folder, and the steps end when every edge leads to a smallest node; their number grows with the logarithm of the
    nodes. A task holds ``block`` links at most at once.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))), "edges")
    while True:
        n = edges.count()
        old, edges = edges, materialize(map_arrow(edges.coalesce(max(1, -(-n // block))), _connector(block), "u long, v long"), "edges")
        discard(old)
        down, up = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
        ends = down.union(up).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if n <= block or ends.filter("down + up > 1 and down > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("v"), "m")
        large = materialize(edges.join(least, "v").select("u", F.col("m").alias("v")).filter("u > v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialize(small.union(least.toDF("u", "v")).distinct(), "edges")
        discard(old, large)
