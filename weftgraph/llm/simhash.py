"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits its ball: all values within half the radius, 2,081 for 64 bits and radius 4. Two fingerprints within
the radius have a value in common, and two that have one are within the radius of each other. So the values are shuffled, and a
value that several fingerprints emit links all of them to the smallest; the distance is verified all the same.

Most values are emitted once, so what is shuffled first is only a hash of each, cut to the bits that keep chance collisions few,
and packed as sorted numbers: some 2 bytes a value. Each bucket answers which places of a chunk met another value, and only those
values travel whole, with their fingerprints. Costs follow the number of fingerprints; no key gets more than its ball's size.

``drop_similar`` asks for a similarity instead of a radius. A ball wide enough for it is too large to emit, so what shares a band of
minimum hashes is looked at too. Pairs come from prefixes: of two sets similar enough, each has a shingle of the other among its
rarest fifth, at a place that leaves room for enough common ones. Exact Jaccard similarity decides on every pair. Most pairs of a
large group are never formed: rounds of comparisons with one central member each connect it first, and only what is still apart
goes through the prefixes.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._shared import Ranges, discard, hot_join, map_arrow, materialize, plain, ship, slices, trim
from weftgraph.llm.components import connected_components
from weftgraph.llm.ngrams import ASKED, TOLD, counts_answer, counts_asker, told_counts

#: Fingerprints that a chunk holds, and values that a bucket holds, about.
CHUNK, BUCKET = 2048, 4_000_000
SEED = 42
#: The least similarity that links, as a fraction; and bands of minimum hashes: a pair at 0.8 shares none of them once in 300,000 times.
SIMILAR = (4, 5)
BANDS, BAND_ROWS = 24, 4
#: Rounds in which each bucket is compared with one member; what they leave apart is compared pair by pair.
ROUNDS = 4
#: Shingles of a chunk, and of a bucket of the table that counts them.
SET_CHUNK, SET_BUCKET = 1_000_000, 2_000_000


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words; of the whole sequence if there are fewer."""
    tokens = text.lower().split()  # on bytes: A-Z, and space and 09 to 0D, only
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    return [h(joined[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)]


def _fingerprints(hashes: list[list[int]]) -> np.ndarray:
    """A fingerprint for each list: the bits set in over half of its hashes. An empty list gives zero."""
    sizes = np.array([len(x) for x in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = sizes > 0
    if not some.any():
        return out
    flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(int(some.sum())), sizes[some])
    counts = np.zeros((int(some.sum()), 64), np.int64)
    for k in range(0, len(flat), 1 << 16):  # bits take 64 bytes a hash
        bits = np.unpackbits(flat[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = of[k : k + (1 << 16)]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        counts[part[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    out[some] = np.packbits(counts * 2 > sizes[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _signer(words: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                prints = _fingerprints([shingle_hashes(t, words) for t in texts])
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(prints.view(np.int64))], names=[*kept, "fp"])

    return sign


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each whole text, as a signed long. Null texts count as empty, with fingerprint zero."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, _signer(words), "id long, fp long")


def masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``radius`` of them set."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], np.uint64)


def _chunker(size: int) -> Callable:
    """Rows of up to ``size`` fingerprints with their ``rep``, as bytes."""

    def row(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        fps, reps = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (fps, reps)], names=["fps", "reps"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held.append(batch.slice(at, size - n))
                at, n = at + held[-1].num_rows, n + held[-1].num_rows
                if n == size:
                    yield row(held)
                    held, n = [], 0
        if n:
            yield row(held)

    return chunk


def ball_hashes(fps: np.ndarray, flips: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of each fingerprint's ball, one fingerprint after the other, and their hashes of ``bits`` bits."""
    values = (fps[:, None] ^ flips).ravel()
    x = values ^ (values >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(64 - bits)
    return values, x


def _emitter(flips: np.ndarray, ranges: Ranges) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, fps in zip(batch.column("chunk").to_pylist(), batch.column("fps").to_pylist(), strict=True):
                hashes = ball_hashes(np.frombuffer(fps, np.uint64), flips, ranges.bits)[1]
                hashes.sort()
                buckets, cuts = ranges.cuts(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.full(len(buckets), chunk, np.int64)), ranges.split(hashes, buckets, cuts)], names=["bucket", "chunk", "hashes"])

    return emit


def _meeter(ranges: Ranges) -> Callable:
    def meet(table: pa.Table) -> pa.Table:
        """Of one bucket: at which places of each chunk's hashes lies one that occurs again."""
        hashes, sizes = ranges.merge(table.column("hashes").to_pylist())
        ordered = np.sort(hashes)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del ordered
        if len(again):
            place = np.searchsorted(again, hashes)
            place[place == len(again)] = 0
            met = np.flatnonzero(again[place] == hashes)
        else:
            met = np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(met, np.concatenate([[0], ends]))
        rows = np.flatnonzero(np.diff(cuts))
        places = [(met[cuts[r] : cuts[r + 1]] - (ends[r] - sizes[r])).astype("<u4").tobytes() for r in rows]
        trim()
        return pa.table([table.column("chunk").take(pa.array(rows)), table.column("bucket").take(pa.array(rows)), pa.array(places, pa.binary())], names=["chunk", "bucket", "places"])

    return meet


def _returner(flips: np.ndarray, ranges: Ranges) -> Callable:
    kinds = ("key", "fp", "rep")

    def give(chunk: pa.Table, told: pa.Table) -> pa.Table:
        """The values of one chunk whose hashes met others."""
        if not told.num_rows or not chunk.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=list(kinds))
        fps, reps = (np.frombuffer(chunk.column(k)[0].as_py(), t) for k, t in (("fps", np.uint64), ("reps", np.int64)))
        values, hashes = ball_hashes(fps, flips, ranges.bits)
        ordered = np.sort(hashes)
        buckets, cuts = ranges.cuts(ordered)
        start = dict(zip(buckets.tolist(), cuts.tolist(), strict=False))
        found = [ordered[start[b] + np.frombuffer(p, "<u4").astype(np.int64)] for b, p in zip(told.column("bucket").to_pylist(), told.column("places").to_pylist(), strict=True)]
        met = np.unique(np.concatenate(found))
        del ordered
        place = np.searchsorted(met, hashes)
        place[place == len(met)] = 0
        at = np.flatnonzero(met[place] == hashes)
        of = at // len(flips)
        trim()
        return pa.table([pa.array(values[at].view(np.int64)), pa.array(fps[of].view(np.int64)), pa.array(reps[of])], names=list(kinds))

    return give


def fingerprint_links(reps: DataFrame, radius: int = 4, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between ``rep`` values that connect all rows of ``reps`` (fp, rep) within ``radius`` differing bits, and no others.

    ``fp`` must be distinct, ``rep`` a long. ``radius`` must be even. Of the pairs that meet in a value, those with its smallest are given.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    spark = reps.sparkSession
    ship(spark)
    flips = masks(64, radius // 2)
    chunks = map_arrow(reps.select("fp", "rep"), _chunker(chunk), "fps binary, reps binary").withColumn("chunk", F.monotonically_increasing_id())
    chunks = materialize(chunks, "balls")
    counted = chunks.agg(F.count(F.lit(1)), F.sum(F.length("fps"))).first()
    n = max(1, (counted[1] or 0) // 8)
    # as many bits as leave some four chance collisions a fingerprint
    bits = min(63, max(8, (len(flips) ** 2 * n // 8).bit_length()))
    buckets = max(1, -(-len(flips) * n // bucket))
    ranges = Ranges(bits, buckets, len(flips) * n / max(1, counted[0]) / buckets)
    tasks = max(1, -(-counted[0] // 4))
    dealt = chunks.repartition(tasks, "chunk")
    asked = map_arrow(dealt.select("chunk", "fps"), _emitter(flips, ranges), "bucket long, chunk long, hashes binary")
    told = asked.groupBy("bucket").applyInArrow(_meeter(ranges), "chunk long, bucket long, places binary")
    told = materialize(told, "balls-met")
    met = dealt.groupBy("chunk").cogroup(told.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(_returner(flips, ranges), "key long, fp long, rep long")
    # no value has more fingerprints than a ball has values, so a key's rows are few
    first = F.min(F.struct("rep", "fp")).over(Window.partitionBy("key"))
    pairs = met.withColumn("first", first).filter((F.col("rep") > F.col("first.rep")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("first.fp"))) <= radius))
    links = materialize(pairs.select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct(), "simhash-links")
    discard(chunks, told)
    return links


def _groups(signed: DataFrame, radius: int) -> DataFrame:
    """(fp, group, n) of the fingerprints in ``signed`` (fp, ..): the smallest fingerprint linked with each, and how many rows each has.

    The graph is one of fingerprints, not of ids, so that an id of two texts joins nothing."""
    prints = materialize(signed.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "simhash-distinct")
    groups = connected_components(fingerprint_links(prints.select("fp", F.col("fp").alias("rep")), radius))
    return prints.join(groups, prints["fp"] == groups["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"), "n")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """The near-duplicate group of every row: id, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable).

    Equal fingerprints are one vertex, whose id is the smallest of its rows, so copies cost nothing after that. Null and empty
    texts have fingerprint zero and link like any other. Repeated rows each get a row. A row with a null id gets the component of
    the others of its fingerprint, or null if there are none. An empty table gives no rows; other columns are not read.
    """
    signed = materialize(fingerprints(df, id_col, text_col, words), "simhash")
    groups = materialize(_groups(signed, radius), "simhash-groups")
    # by fingerprint first: a group may hold a third of all rows
    least = signed.groupBy("fp").agg(F.min("id").alias("id")).join(groups, "fp").groupBy("group").agg(F.min("id").alias("component_id"))
    by_print = materialize(groups.join(least, "group").select("fp", "component_id"), "simhash-prints")
    out = hot_join(signed, by_print, "fp", groups.select("fp", "n"))
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _only(df: DataFrame, id_col: str, text_col: str, chosen: DataFrame) -> DataFrame:
    """One row of ``df`` for each (id, hash) of ``chosen``, and all rows with a null id. Of rows that agree in both, and so in id and
    text, the one whose other columns have the smallest hash."""
    maps = [f.name for f in df.schema if "map<" in f.dataType.simpleString()]
    order = [F.xxhash64(F.lit(0), *[F.col(plain(c)) for c in df.columns if c not in (*maps, text_col)]), *[F.to_json(F.struct(F.col(plain(c)))) for c in maps]]
    row = F.struct(*[F.col(plain(c)) for c in df.columns])
    named = df.select(F.col(plain(id_col)).cast("long").alias("__weft_id"), _text_hash(plain(text_col)).alias("__weft_hash"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__weft_order"), row.alias("__weft_row")).filter("__weft_id is not null")
    kept = named.join(chosen.toDF("__weft_id", "__weft_hash"), ["__weft_id", "__weft_hash"], "left_semi")
    once = kept.groupBy("__weft_id", "__weft_hash").agg(F.min_by("__weft_row", "__weft_order").alias("__weft_row"))
    return once.select("__weft_row.*").unionByName(df.filter(F.col(plain(id_col)).isNull()))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with one row of each near-duplicate group: that with the smallest id.

    Where the id repeats, each of its rows is in the group of its own text; if several in one group have the smallest id, the one
    whose text has the smallest hash stays. Rows with a null id are kept, as nothing tells them apart. Columns stay.
    """
    rows = df.filter(F.col(plain(id_col)).isNotNull()).select(F.col(plain(id_col)).cast("long").alias("id"), _text_hash(plain(text_col)).alias("hash"), F.coalesce(F.col(plain(text_col)), F.lit("")).alias("text"))
    signed = materialize(map_arrow(rows, _signer(words), "id long, hash long, fp long"), "simhash")
    groups = _groups(signed, radius)
    firsts = signed.groupBy("fp").agg(F.min(F.struct("id", "hash")).alias("row"))
    chosen = firsts.join(groups, "fp").groupBy("group").agg(F.min("row").alias("row"))
    return _only(df, id_col, text_col, chosen.select("row.id", "row.hash"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _node(grams: np.ndarray) -> int:
    """A signed 64-bit hash of a shingle set: texts of equal sets are one vertex."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).astype(np.int64))


def minimum_bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys for each set, each a hash of BAND_ROWS of its minimum hashes and the band's number; an empty set counts as {0}."""
    sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    rng = np.random.default_rng(SEED)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for _ in range(BAND_ROWS):
            times, plus = rng.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
            mixed = (flat ^ plus) * times
            mixed ^= mixed >> np.uint64(32)
            least = np.minimum.reduceat(mixed * times, starts)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def _set_signer(words: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes = [shingle_hashes(t, words) for t in part.column("text").cast(pa.binary()).to_pylist()]
                sets = [np.unique(np.array(x, np.uint64)) for x in hashes]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(minimum_bands(sets).ravel()))
                cols = [part.column("id"), part.column("hash"), pa.array([_node(x) for x in sets], pa.int64()), pa.array(_fingerprints(hashes).view(np.int64)), bands]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "hash", "node", "fp", "bands"])

    return sign


def _set_maker(words: int) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [shingle_set(t, words).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "grams"])

    return make


def _verifier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    top, bottom = SIMILAR
    for batch in batches:
        for part in slices(batch, "ga", 1 << 22):
            good = []
            for x, y in zip(part.column("ga"), part.column("gb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(a) > len(b):
                    a, b = b, a
                if len(a) * bottom < len(b) * top or not len(a):
                    good.append(len(a) == len(b))
                    continue
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                good.append(both * bottom >= (len(a) + len(b) - both) * top)
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of vertices those whose shingle sets are similar."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    held = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b").select("a", "b", "ga", "gb")
    return materialize(map_arrow(held, _verifier, "a long, b long"), "similar-links")


def _set_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about SET_CHUNK shingles: vertices, sizes of their sets, and all sets."""

    def row(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (np.array(nodes, np.int64).tobytes(), sizes.tobytes(), b"".join(sets))] + [pa.array([int(sizes.sum())])], names=["nodes", "sizes", "grams", "n"])

    nodes, sets, n = [], [], 0
    for batch in batches:
        for node, grams in zip(batch.column("node").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            nodes.append(node)
            sets.append(grams)
            n += len(grams) // 8
            if n >= SET_CHUNK:
                yield row(nodes, sets)
                nodes, sets, n = [], [], 0
    if nodes:
        yield row(nodes, sets)


def _short(grams: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(grams, np.uint64) >> np.uint64(64 - bits)


def prefixes(grams: np.ndarray, counts: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which shingles are in a prefix of their set and occur in other sets, their places (from 1) in the order of rarity, and how many
    of each set occur in no other. ``of`` says which set a shingle is of, in order."""
    top, bottom = SIMILAR
    order = np.lexsort((grams, counts, of))
    place = np.empty(len(grams), np.int64)
    place[order] = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    length = sizes - -(-sizes * top // bottom) + 1
    at = np.flatnonzero((place <= length[of]) & (counts > 1))
    return at, place[at], np.bincount(of, counts == 1, len(sizes)).astype(np.int64)


def _indexer(ranges: Ranges, count_bytes: int) -> Callable:
    names = ["node", "size", "lone", "grams", "places"]

    def index(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))], names=names)
        nodes, sizes = (np.frombuffer(chunk.column(k)[0].as_py(), np.int64) for k in ("nodes", "sizes"))
        data = chunk.column("grams")[0].as_py()
        grams, of = np.frombuffer(data, np.uint64), np.repeat(np.arange(len(sizes)), sizes)
        counts = told_counts(told.sort_by("bucket"), 0, _short(data, ranges.bits), ranges, count_bytes)
        at, places, lone = prefixes(grams, counts, of, sizes)
        cuts = pa.array(np.searchsorted(of[at], np.arange(len(sizes) + 1)).astype(np.int32))
        trim()
        cols = [pa.array(nodes), pa.array(sizes), pa.array(lone / np.maximum(sizes, 1)), pa.ListArray.from_arrays(cuts, pa.array(grams[at].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(places.astype(np.int32)))]
        return pa.table(cols, names=names)

    return index


def indexed_prefixes(sets: DataFrame) -> DataFrame:
    """(node, size, lone, grams, places) of the sets (node, grams): the part of each prefix that other sets share, its places in the
    set's order of rarity, and which share of the set no other set has. Shingles are counted over all sets by hash, in buckets."""
    ship(sets.sparkSession)
    chunks = materialize(map_arrow(sets, _set_chunks, "nodes binary, sizes binary, grams binary, n long").withColumn("chunk", F.monotonically_increasing_id()), "similar-chunks")
    n_chunks, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(63, 24 + max(8, total.bit_length()))
    buckets = max(1, -(-total // SET_BUCKET))
    ranges, count_bytes = Ranges(bits, buckets, total / max(1, n_chunks) / buckets), max(1, total.bit_length() + 7 >> 3)
    asked = map_arrow(chunks.select("chunk", "grams"), counts_asker(lambda row: [_short(row["grams"], bits)], ("grams",), ranges, count_bytes), ASKED)
    told = materialize(asked.groupBy("bucket").applyInArrow(counts_answer(1, ranges, count_bytes), TOLD), "similar-counts")
    tasks = max(1, n_chunks)
    both = chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(told.repartition(tasks, "chunk").groupBy("chunk"))
    out = materialize(both.applyInArrow(_indexer(ranges, count_bytes), "node long, size long, lone double, grams array<long>, places array<int>"), "similar-index")
    discard(chunks, told)
    return out


def _apart(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of ``rows`` (key, node, ..) those of keys whose vertices are in several components, with ``component`` and the key's largest as ``top``."""
    known = rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    several = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return known.join(several.select("key", F.col("top.component").alias("top")), "key")


def similar_components(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], radius: int = 4) -> DataFrame:
    """(node, component) of the vertices of ``nodes`` (node, fp, bands) that are linked and not their component's smallest.

    Looked at are vertices that a ball links or that share a band with another. ``sets_of`` gives (node, grams) for a table of nodes.
    """
    prints = materialize(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "similar-prints")
    by_balls = fingerprint_links(prints, radius).unionByName(nodes.join(prints, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    by_balls = materialize(by_balls, "similar-balls")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    members = materialize(keys.join(shared, "key").select("key", "node"), "similar-bands")
    asked = members.select("node").union(by_balls.select("a")).union(by_balls.select("b")).distinct()
    sets = materialize(sets_of(asked), "similar-sets")
    index = indexed_prefixes(sets)
    members = members.join(index.select("node", "lone"), "node")

    groups = connected_components(_similar(by_balls, sets))
    for round_ in range(ROUNDS):
        # the most central member, which shares most of its shingles, against the others; later on among those outside the largest part
        apart = materialize(_apart(members, groups), "similar-apart")
        pool = apart.filter("component <> top") if round_ else apart
        leader = pool.groupBy("key").agg(F.min(F.struct("lone", "node", "component")).alias("first"))
        pairs = pool.join(leader, "key").filter("component <> first.component").select(F.col("first.node").alias("a"), F.col("node").alias("b"))
        more = _similar(pairs, sets)
        discard(apart)
        if more.isEmpty():
            break
        # a component's nodes all lead to its smallest, which says as much as the links that made it
        groups = connected_components(groups.toDF("a", "b").union(more))
    # what is still apart: pairs that share a shingle of both prefixes with room for enough common ones after it
    rows = index.select("node", "size", F.explode(F.arrays_zip("grams", "places")).alias("g")).select(F.col("g.grams").alias("key"), "node", "size", F.col("g.places").alias("place"))
    apart = materialize(_apart(rows, groups), "similar-apart")
    one, two = apart.filter("component <> top").alias("x"), apart.alias("y")
    room = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1
    top, bottom = SIMILAR
    enough = room * (top + bottom) >= (F.col("x.size") + F.col("y.size")) * top
    # two outside the largest part are paired once, and one outside with one inside
    once = (F.col("y.component") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
    pairs = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & enough & once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = _similar(pairs, sets)
    discard(sets, index, apart)
    return groups if more.isEmpty() else connected_components(groups.toDF("a", "b").union(more))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4) -> DataFrame:
    """``df`` with one row of each group of texts that shingles of ``words`` words link: Jaccard similarity of at least 0.8, exact.

    Of each group the row with the smallest id stays, once. Texts of fewer words are one shingle, and texts without a word equal
    each other. Rows with a null id are kept, as nothing tells them apart. Columns stay.
    """
    rows = df.filter(F.col(plain(id_col)).isNotNull()).select(F.col(plain(id_col)).cast("long").alias("id"), _text_hash(plain(text_col)).alias("hash"), F.coalesce(F.col(plain(text_col)), F.lit("")).alias("text"))
    signed = materialize(map_arrow(rows, _set_signer(words), "id long, hash long, node long, fp long, bands array<long>"), "similar")
    nodes = materialize(signed.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "similar-nodes")
    discard(signed)

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = nodes.join(asked, "node", "left_semi").select("node", F.col("row.id").alias("id"), F.col("row.hash").alias("hash"))
        texts = rows.join(wanted, ["id", "hash"]).select("node", "text").dropDuplicates(["node"])
        return map_arrow(texts, _set_maker(words), "node long, grams binary")

    groups = similar_components(nodes.select("node", "fp", "bands"), sets_of, radius)
    first = nodes.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("row").alias("row"))
    first = materialize(first.select(F.col("row.id").alias("id"), F.col("row.hash").alias("hash")), "similar-kept")
    discard(nodes)
    return _only(df, id_col, text_col, first)
