"""Embedding near-duplicates by E8 lattice hashing.

In each of a few tables, unit vectors are projected on 8 random directions and decoded to the nearest point of the E8 lattice, whose
cells hash them. A vector is in the bucket of its own cell and in those of the nearest neighbouring cells; two vectors meet where at
least one of them is at home. The cosine of all that meet is computed in double precision. Only cells and ids are shuffled to find
out where vectors meet; a vector itself goes to those buckets only in which it meets another.

Buckets give, for each vector, the number of its links and one link towards the bucket's smallest member, never a row a pair. A pair
may meet in several buckets; it counts in the first of them only, which both vectors' cells tell without looking elsewhere. A bucket
too large for a task is dealt out to a grid of block pairs, so every pair in it is still compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import map_arrow, materialize
from weftgraph.llm.components import connected_components

TABLES, PROBES, SCALE, SEED = 3, 3, 0.16, 7
#: Rows of a bucket that a task compares at once, and of larger ones about as many on each side of the grid.
MOST = 4096

#: The 240 shortest vectors of E8, doubled.
SHORTEST = np.array(
    [[2 * s if k == i else 2 * t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    + [list(s) for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
)

HASHED = "rep long, grp long, copies long, cells binary, vec binary, keys array<long>"
#: ``at`` is the place of the bucket among the cells of its vector: by table, and the vector's own cell first.
ROW = "key long, grp long, rep long, copies long, at int, cells binary, vec binary"
FOUND = "a long, b long, n long, " + ROW


def decode_d8(y: np.ndarray) -> np.ndarray:
    """The nearest points of D8: whole coordinates with an even sum."""
    near = np.rint(y)
    off = y - near
    worst = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1).astype(np.int64) % 2)
    near[rows, worst[rows]] += np.where(off[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half in each coordinate."""
    whole, half = decode_d8(y), decode_d8(y - 0.5) + 0.5
    nearer = ((y - half) ** 2).sum(axis=1) < ((y - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def directions(dim: int, tables: int = TABLES, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table 8 orthonormal directions (as far as ``dim`` allows) and a shift of the lattice."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(tables):
        m = rng.standard_normal((max(dim, 8), 8))
        out.append((np.linalg.qr(m)[0][:dim] * np.sqrt(max(dim, 8) / 64), rng.random(8)))
    return out


def cells_of(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, 1 + probes): hashed cells, each vector's own first."""
    mix = np.random.default_rng(seed).integers(1, 1 << 62, 8) * 2 + 1
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t, (turn, shift) in enumerate(directions(unit.shape[1], tables, seed)):
        y = unit @ turn / scale + shift
        point = decode_e8(y)
        doubled = np.rint(2 * point).astype(np.int64)
        towards = (y - point) @ SHORTEST.T
        nearest = np.argpartition(-towards, probes - 1, axis=1)[:, :probes]
        with np.errstate(over="ignore"):
            out[:, t, 0] = doubled @ mix
            out[:, t, 1:] = (doubled[:, None] + SHORTEST[nearest]) @ mix
    return out


def _hasher(tables: int, probes: int, scale: float, seed: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                grp, rep, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                vectors = batch.column(3).to_pylist()
                dims = np.array([len(v) for v in vectors])
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    x = np.array([vectors[i] for i in own], np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    cells = cells_of(unit, tables, probes, scale, seed)
                    tab = np.repeat(np.arange(tables), 1 + probes)
                    with np.errstate(over="ignore"):
                        keys = (cells.reshape(len(own), -1) * 31 + tab) * 1_000_003 + grp[own][:, None] * 65_599
                    each = pa.array(np.arange(len(own) + 1, dtype=np.int32) * keys.shape[1])
                    blobs = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (cells, unit)]
                    cols = [pa.array(rep[own]), pa.array(grp[own]), pa.array(copies[own]), *blobs, pa.ListArray.from_arrays(each, pa.array(keys.ravel()))]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in HASHED.split(", ")])

    return emit


def _met_first(cells: np.ndarray, a: np.ndarray, b: np.ndarray, tab: int, cell: int) -> np.ndarray:
    """For pairs a, b: whether the bucket of ``cell`` in table ``tab`` is the first in which they meet."""
    own_a, own_b = cells[a, :, :1], cells[b, :, :1]
    in_b, in_a = (cells[b] == own_a).any(axis=2), (cells[a] == own_b).any(axis=2)
    met = in_a | in_b
    first = met.argmax(axis=1)
    ca, cb = own_a[:, tab, 0], own_b[:, tab, 0]
    at = np.where(in_b[:, tab] & in_a[:, tab], np.minimum(ca, cb), np.where(in_b[:, tab], ca, cb))
    return (first == tab) & met.any(axis=1) & (at == cell)


def _compare(cols: dict[str, np.ndarray], threshold: float, shape: tuple[int, int], sides: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rep, smallest connected rep and number of links, for the linked members of one bucket. ``sides``: compare 0 with 1 only."""
    n = len(cols["rep"])
    if n < 2:
        return None
    home, copies, rep, grp = cols["at"] % shape[1] == 0, cols["copies"], cols["rep"], cols["grp"]
    sizes = {len(v) for v in cols["vec"]}
    if len(sizes) > 1 or len(set(grp.tolist())) > 1:  # two keys that hash alike
        parts = [_compare({k: v[own] for k, v in cols.items()}, threshold, shape, None if sides is None else sides[own]) for g in {*zip(grp.tolist(), map(len, cols["vec"]), strict=True)} if len(own := np.array([i for i in range(n) if (grp[i], len(cols["vec"][i])) == g]))]
        parts = [p for p in parts if p]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else None
    x = np.frombuffer(b"".join(cols["vec"]), np.float64).reshape(n, -1)
    cells = np.frombuffer(b"".join(cols["cells"]), np.int64).reshape(n, *shape)
    tab, nth = divmod(int(cols["at"][0]), shape[1])
    cell = int(cells[0, tab, nth])
    left, right = [], []
    for k in range(0, n, 512):
        cos = x[k : k + 512] @ x.T
        i, j = np.nonzero(cos >= threshold)
        i += k
        ok = (i < j) & (home[i] | home[j]) & (rep[i] != rep[j])
        if sides is not None:
            ok &= sides[i] != sides[j]
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            once = _met_first(cells, a, b, tab, cell)
            left.append(a[once])
            right.append(b[once])
    a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
    if not len(a):
        return None
    links = np.zeros(n, np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    least = rep.copy()
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (least == before).all():
            break
    own = links > 0
    return rep[own], least[own], links[own]


def _bucketer(threshold: float, shape: tuple[int, int], most: int | None) -> Callable:
    """Compare each bucket of rows sorted by key. Buckets of over ``most`` rows are passed on as they are."""
    names = [x.split()[0] for x in ROW.split(", ")]
    full = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.binary()]

    def found(r: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        n = len(r[0])
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in r), *(pa.nulls(n, t) for t in kinds[3:])], names=full)

    def passed(batch: pa.RecordBatch | pa.Table) -> Iterator[pa.RecordBatch]:
        for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(part.num_rows, t) for t in kinds[:3]), *(part.column(x) for x in names)], names=full)

    def bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {x: table.column(x).to_numpy() for x in names if x not in ("cells", "vec")} | {x: np.array(table.column(x).to_pylist(), object) for x in ("cells", "vec")}
        sides = table.column("side").to_numpy() if "side" in table.column_names else None
        if sides is not None and sides.min() == sides.max():
            sides = None if sides[0] == 2 else sides
        if r := _compare(cols, threshold, shape, sides):
            yield found(r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last, large = 0, None, None

        def close() -> Iterator[pa.RecordBatch]:
            if rows > 1:
                yield from bucket(pa.Table.from_batches(held))

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for s, e in zip(cuts, cuts[1:], strict=False):
                if keys[s] != last:
                    yield from close()
                    held, rows, last, large = [], 0, keys[s], None
                part = batch.slice(s, e - s)
                if large is None:
                    held.append(part)
                    rows += e - s
                    if most is not None and rows > most:
                        large = True
                        for x in held:
                            yield from passed(x)
                        held, rows = [], 0
                else:
                    yield from passed(part)
        yield from close()

    return run


def vector_links(vectors: DataFrame, threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED, most: int = MOST) -> DataFrame:
    """(a, b, n): for distinct vectors (grp, rep, copies, vec), links of ``a`` counted in copies, and a vector ``b`` <= a connected to it.

    A vector may have several rows; their ``n`` add up.
    """
    hashed = materialize(map_arrow(vectors.select("grp", "rep", "copies", "vec"), _hasher(tables, probes, scale, seed), HASHED), "lattice-cells")
    shape = (tables, 1 + probes)
    slim = hashed.select("rep", F.posexplode("keys").alias("at", "key"))
    home = F.max(F.when(F.col("at") % (1 + probes) == 0, 1).otherwise(0))
    several = slim.groupBy("key").agg(F.count(F.lit(1)).alias("n"), home.alias("home")).filter("n > 1 and home = 1").select("key")
    met = slim.join(several, "key")
    rows = met.join(hashed.drop("keys"), "rep").select(*[x.split()[0] for x in ROW.split(", ")])
    found = materialize(map_arrow(rows.repartition("key").sortWithinPartitions("key"), _bucketer(threshold, shape, most), FOUND), "lattice")
    links, large = found.filter("a is not null").select("a", "b", "n"), found.filter("a is null").drop("a", "b", "n")
    if large.isEmpty():
        return links
    sizes = large.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    dealt = large.join(sizes, "key").withColumn("blocks", F.ceil(F.col("rows") / (most / 2)).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    grid = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # a block pair's own key; the bucket's table and cell stay as they are
    pairs = grid.select(cell.alias("key"), *[c for c in large.columns if c != "key"], side.alias("side"))
    more = map_arrow(pairs.repartition("key").sortWithinPartitions("key"), _bucketer(threshold, shape, None), FOUND)
    return links.union(materialize(more.select("a", "b", "n"), "lattice"))


def embedding_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, most: int = MOST) -> DataFrame:
    """Near-duplicate groups among the vectors of each label: id, ``n_links``, ``component_id``, ``kept``, a row a row.

    Linked are vectors of equal, non-null label and equal length with a cosine of ``threshold`` or more, as far as the tables find
    them; equal vectors always. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id or
    label, link with nothing: 0 links and their own id. Repeated rows are vectors of their own. Other columns are not read.
    """
    vec = F.col("vec")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.select("id", "vec", F.xxhash64("label", F.size("vec")).alias("grp"), F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit("second"), "vec", "label").alias("h2"))
    keyed = rows.select("id", "sound", "h1", "h2")
    distinct = rows.filter("sound").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("grp").alias("grp"), F.first("vec").alias("vec"))
    distinct = materialize(distinct, "vectors")
    links = vector_links(distinct, threshold, tables, probes, scale, most=most)
    groups = connected_components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    by_vector = distinct.select("h1", "h2", "rep", "copies").join(counts, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    by_vector = by_vector.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), F.lit(True).alias("sound"))
    out = keyed.join(by_vector, ["h1", "h2", "sound"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
