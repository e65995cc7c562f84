"""Exact top-k search of 64-bit codes by incremental multi-index hashing.

A code is cut into segments, and each segment is an index from its value to the codes that have it. If two codes differ in at most
m r + a bits over m segments, then one of the first a + 1 segments differs in at most r bits, or one of the others in at most r - 1.
So the search looks up, for each query, all segment values within these radii, and has then seen every code up to that distance.
Queries whose kth distance is covered are done; the others go on with larger radii. A segment has fewer values than there are codes
to a bucket's hundred, so even the widest radius looks up no more than that. Of what a round finds only the nearest of each query are
kept, before anything is written or shuffled, so that a dense cluster costs no more than a sparse one.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._shared import materialize

BITS = 64
SALT = 64
#: Looked-up values that go to every task at most; more are shuffled to their buckets.
BROADCAST = 100_000


def segments_for(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment: as many segments as give buckets of about 128 of ``n`` codes, at least 8 bits wide."""
    width = max(8.0, math.log2(max(n, 2)) - 7)
    m = max(1, round(BITS / width))
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def _part(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _flips(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within_radii(queries: DataFrame, index: DataFrame, segments: list[tuple[int, int]], radii: list[int], most: int, keep: int) -> DataFrame:
    """(q, c, dist, n, first): pairs of a query and an indexed code that differ in at most ``most`` bits and in at most its radius in
    some segment; each pair once, from the first such segment. Of each query the ``keep`` nearest, by distance and ``first``.

    Spark takes the looked-up values for no more than their queries, and would send any number of them through the driver: so they are
    counted here, and more than ``BROADCAST`` are shuffled."""
    probes, each = [], 0
    for s, (at, width) in enumerate(segments):
        if radii[s] >= 0:
            values = _flips(width, radii[s])
            each += len(values)
            flips = F.split(F.lit(",".join(map(str, map(_signed, values)))), ",").cast("array<bigint>")
            probes.append(queries.select("q", F.lit(s).alias("seg"), F.explode(flips).alias("flip"), _part(F.col("q"), at, width).alias("own")))
    probe = reduce(DataFrame.union, probes).select("q", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    first = F.lit(True)
    for s in range(len(segments)):
        earlier = [_distance(_part(F.col("q"), *segments[e]), _part(F.col("c"), *segments[e])) > radii[e] for e in range(s)]
        first = first & ((F.col("seg") != s) | reduce(lambda a, b: a & b, earlier, F.lit(True)))
    few = queries.count() * each <= BROADCAST
    probe, index = probe.hint("broadcast" if few else "merge").alias("p"), index.alias("i")
    near = probe.join(index, (F.col("p.seg") == F.col("i.iseg")) & (F.col("p.value") == F.col("i.ivalue")) & (_distance(F.col("q"), F.col("c")) <= most) & first)
    near = near.select("q", "c", _distance(F.col("q"), F.col("c")).alias("dist"), "n", "first")
    # Spark ranks within each task first, and shuffles only what can be among the nearest
    place = F.row_number().over(Window.partitionBy("q").orderBy("dist", "first"))
    return near.withColumn("place", place).filter(F.col("place") <= keep).drop("place")


def top_k(df: DataFrame, code_col: str, id_col: str, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` rows of ``df`` nearest to each query row by Hamming distance, itself not counted: query_id, rank, neighbor_id, distance.

    Exact; of equal distances the smaller id comes first. ``is_query`` is a condition on the columns of ``df``. Rows with a null id
    or code are neither found nor asked. Equal codes are one vertex of the search, with the ``k`` + 1 smallest of its ids, found by
    salt before they meet; rounds compare codes by distance and smallest id. Repeated rows with one id are found repeatedly, but a query never finds its own id, and repeated query rows
    ask once. Fewer rows than ``k`` give shorter lists; an empty table gives none.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("long").alias("code"), is_query.alias("asks")).filter("id is not null and code is not null")
    # Equal rows are one with a count, so that no copies, the query's own neither, push others out; ``k`` of them fill a list.
    rows = materialize(rows.groupBy("id", "code").agg(F.max("asks").alias("asks"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times")), "codes")
    # The query's own id is left out later: so many codes at most have it.
    owned = rows.filter("asks").select("id").distinct()
    own = rows.join(owned, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    salted = Window.partitionBy("code", "salt").orderBy("id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT))).withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= k + 1)
    members = materialize(some.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("nth") <= k + 1).select("code", "id", "times"), "members")
    codes = materialize(members.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")), "distinct")
    n_codes = codes.count()
    segments = segments_for(n_codes)
    m = len(segments)
    index = materialize(reduce(DataFrame.union, [codes.select(F.col("code").alias("c"), "n", "first", F.lit(s).alias("iseg"), _part(F.col("code"), first, width).alias("ivalue")) for s, (first, width) in enumerate(segments)]), "index")
    active = materialize(rows.filter("asks").select(F.col("code").alias("q")).distinct(), "queries")
    results: list[DataFrame] = []
    covered = 2 * m - 1
    while True:
        radius, extra = divmod(covered, m)
        radii = [min(width, radius if s <= extra else radius - 1) for s, (_, width) in enumerate(segments)]
        last = covered >= BITS
        # k + own codes hold as many ids at least, each the nearest of its code, so that no other code can be among the k
        pairs = materialize(within_radii(active, index, segments, radii, covered, k + own), "pairs")
        done = active.select("q") if last else pairs.groupBy("q").agg(F.sum("n").alias("n")).filter(F.col("n") >= k + own).select("q")
        results.append(pairs.join(done, "q", "left_semi"))
        if last:
            break
        active = materialize(active.join(done, "q", "left_anti"), "queries")
        if active.isEmpty():
            break
        covered += max(1, m // 2) if len(results) < 3 else m  # few queries are left by then
    found = reduce(DataFrame.union, results)
    ranked = found.join(members, F.col("c") == F.col("code")).select("q", "dist", "id", "times")
    lists = ranked.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("dist", "id"))).filter(F.col("place") <= k + own)
    asked = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("code"))
    others = asked.join(lists, F.col("code") == F.col("q")).filter("id <> query_id")
    others = others.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dist", "id", "times"))).alias("each"))
    others = others.select("query_id", F.slice(F.flatten(F.transform("each", lambda f: F.array_repeat(f, f["times"]))), 1, k).alias("found"))
    out = others.select("query_id", F.posexplode("found").alias("place", "f"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("f.id").alias("neighbor_id"), F.col("f.dist").alias("distance"))


def sign_code(vector: str = "embedding") -> Column:
    """The signs of the first 64 components as a long: bit i is set if component i is positive; null for a null vector.

    That is the feature: further components do not count. Project longer vectors to 64 components first if they should."""
    return F.expr(f"aggregate(transform(slice({vector}, 1, 64), (x, i) -> if(coalesce(x, 0) > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
