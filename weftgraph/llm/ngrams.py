"""Stupid-backoff language-model scores, computed relationally over the whole corpus.

1. Texts are split into words, and chunks of documents are written as word numbers.
2. Each chunk explodes into its n-grams; the distinct ones with their counts go to buckets by hash. A bucket adds up the counts of
   all chunks, which makes it one partition of the n-gram count tables.
3. The bucket joins its table back to each chunk's n-grams and sends the counts home; a chunk scores each word and sums per document.

Rows between the steps carry sorted arrays, not single n-grams: the join is a merge of sorted hashes. What a chunk sends costs as
its n-grams do, however many buckets there are. An n-gram is known by a hash that is 24 bits wider than the number of words needs,
so that one in 2**24 shares its count with another.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import Ranges, map_arrow, materialize, pack, ship, slices, trim, unpack

ORDER = 3
#: The factor of each step back, and how often an n-gram must occur to be used (one that occurs once is only the text's own).
BACKOFF, MIN_COUNT = 0.4, 2
CHUNK_BYTES = 6 << 20
#: N-grams of all orders that a bucket holds, about.
BUCKET = 1_000_000

CHUNK = "docs array<long>, sizes array<int>, words binary, heads binary, n long"
SCORES = "id long, n_words long, log_score double, n_by_order array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def number_words(texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Words of each text, word numbers of all texts one after the other, and the word hashes that they count through."""
    known = _Numbers()
    get = known.__getitem__
    sizes, flat = [], []
    for text in texts:
        words = text.lower().split()
        sizes.append(len(words))
        flat.append(np.fromiter(map(get, words), np.int64, len(words)))
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known], np.uint64)
    numbers = np.concatenate(flat) if flat else np.empty(0, np.int64)
    by_count = np.argsort(-np.bincount(numbers, minlength=len(hashes)), kind="stable")  # frequent words get short numbers
    rank = np.empty(len(hashes), np.int64)
    rank[by_count] = np.arange(len(hashes))
    return sizes, rank[numbers], hashes[by_count]


def grams_of(numbers: np.ndarray, heads: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1: hashes of the n-grams that end at a word, and at which words one ends; none spans two texts."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(numbers)) - np.repeat(starts, sizes)
    words = heads[numbers] if len(numbers) else np.empty(0, np.uint64)
    full, out = words, []
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            if n > 1:
                full = np.concatenate([full[:1], _mix(full[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(n))])
            at = np.flatnonzero(place >= n - 1)
            out.append((_mix(full[at] + np.uint64(n)) >> np.uint64(64 - bits), at))
    return out


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            sizes, numbers, heads = number_words(part.column("text").to_pylist())
            cols = [pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(numbers)], pa.binary()), pa.array([pack(heads)], pa.binary()), pa.array([len(numbers)])]
            yield pa.RecordBatch.from_arrays(cols, names=["docs", "sizes", "words", "heads", "n"])


def _chunk_grams(row: dict, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return grams_of(unpack(row["words"]).astype(np.int64), unpack(row["heads"]), np.array(row["sizes"], np.int64), order, bits)


def counts_asker(grams_of_row: Callable[[dict], list[np.ndarray]], columns: tuple[str, ...], ranges: Ranges, count_bytes: int) -> Callable:
    """Each chunk's distinct grams with their counts, in rows by bucket. ``grams_of_row`` gives the hashes of a chunk from its ``columns``."""
    kinds = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])

    def lists(parts: list[pa.Array], n: int) -> pa.Array:
        """A list a row, with one item of each part."""
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(parts))
        turns = np.arange(n)[:, None] + np.arange(len(parts)) * n
        return pa.ListArray.from_arrays(offsets, pa.concat_arrays(parts).take(pa.array(turns.ravel())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                counted = [np.unique(h, return_counts=True) for h in grams_of_row({x: batch.column(x)[k].as_py() for x in columns})]
                own = [ranges.cuts(u) for u, _ in counted]
                buckets = np.unique(np.concatenate([b for b, _ in own]))
                grams, counts = [], []
                for (u, n), (b, c) in zip(counted, own, strict=True):
                    cuts = np.append(c[np.searchsorted(b, buckets)], len(u))
                    grams.append(ranges.split(u, buckets, cuts))
                    counts.append(ranges.split_counts(n, cuts, count_bytes))
                cols = [pa.array(buckets), pa.array(np.full(len(buckets), batch.column("chunk")[k].as_py(), np.int64)), lists(grams, len(buckets)), lists(counts, len(buckets))]
                whole = pa.RecordBatch.from_arrays(cols, schema=kinds)
                for at in range(0, len(buckets), 10_000):
                    yield whole.slice(at, 10_000)

    return ask


#: What ``counts_asker`` gives, and ``counts_answer``.
ASKED, TOLD = "bucket long, chunk long, grams array<binary>, counts array<binary>", "chunk long, bucket long, told array<binary>"


def counts_answer(order: int, ranges: Ranges, count_bytes: int) -> Callable:
    def answer(table: pa.Table) -> pa.Table:
        """One bucket's count tables, joined back to the n-grams of each chunk."""
        grams, counts = table.column("grams").to_pylist(), table.column("counts").to_pylist()
        out = []
        for n in range(order):
            asked, sizes = ranges.merge([g[n] for g in grams])
            _, place = np.unique(asked, return_inverse=True)
            total = np.bincount(place, ranges.merge_counts([c[n] for c in counts], count_bytes).astype(np.float64)) if len(place) else np.empty(0)
            told = total[place].astype(np.uint64) if len(place) else np.empty(0, np.uint64)
            out.append(ranges.split_counts(told, np.concatenate([[0], np.cumsum(sizes)]), count_bytes).to_pylist())
        trim()
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(list(map(list, zip(*out, strict=True))), pa.list_(pa.binary()))], names=["chunk", "bucket", "told"])

    return answer


def told_counts(told: pa.Table, n: int, hashes: np.ndarray, ranges: Ranges, count_bytes: int) -> np.ndarray:
    """The corpus count of each of a chunk's ``hashes``, from the answers to its list ``n``."""
    known = ranges.merge_counts([a[n] for a in told.column("told").to_pylist()], count_bytes)
    _, place = np.unique(hashes, return_inverse=True)
    return known[place].astype(np.float64) if len(place) else np.empty(0)


def score_words(grams: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], words: int, total: int, backoff: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """The log score of each word and the order that gave it. ``counts``: of the n-grams that end at the words of ``grams``."""
    full = [np.zeros(words) for _ in grams]
    for (_, at), c, out in zip(grams, counts, full, strict=True):
        out[at] = c
    score, used = np.zeros(words), np.zeros(words, np.int64)
    open_ = np.ones(words, bool)
    steps = np.zeros(words)
    for n in range(len(grams), 0, -1):
        at = grams[n - 1][1]
        at = at[open_[at]]
        take = at[full[n - 1][at] >= min_count] if n > 1 else at
        under = full[n - 2][take - 1] if n > 1 else float(total)
        score[take] = np.log(full[n - 1][take] / under) + steps[take] * math.log(backoff)
        used[take] = n
        open_[take] = False
        steps[at] += 1
    return score, used


def _scorer(order: int, ranges: Ranges, bits: int, total: int, count_bytes: int, backoff: float, min_count: int) -> Callable:
    def score(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = {x: chunk.column(x)[0].as_py() for x in ("docs", "words", "heads", "sizes")}
        grams = _chunk_grams(row, order, bits)
        told = told.sort_by("bucket")
        counts = [told_counts(told, n, hashes, ranges, count_bytes) for n, (hashes, _) in enumerate(grams)]
        sizes = np.array(row["sizes"], np.int64)
        each, used = score_words(grams, counts, int(sizes.sum()), total, backoff, min_count)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(doc, each, len(sizes)).astype(np.float64)
        trim()
        by_order = np.stack([np.bincount(doc, used == n, len(sizes)) for n in range(1, order + 1)], axis=1).astype(np.int64)
        return pa.table([pa.array(row["docs"], pa.int64()), pa.array(sizes), pa.array(sums), pa.array(by_order.tolist(), pa.list_(pa.int64()))], names=["id", "n_words", "log_score", "n_by_order"])

    return score


def backoff_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """The language-model score of every document under the counts of the whole table.

    Words are what white space separates, lower-cased. A word's score is c(n-gram) / c(its first n-1 words) for the longest n-gram up
    to ``order`` that ends at it and occurs ``min_count`` times or more, times ``backoff`` for each step from the longest that fits
    into the text; a single word's is c / all words. Returns id, ``n_words``, ``log_score`` (the sum of natural logarithms),
    ``mean_log_score`` (null without words) and ``n_by_order``: how many words 1-grams, 2-grams and so on gave.

    Null and empty texts have no words and score 0. Repeated rows count and score each for themselves; null ids are kept. An empty
    table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = materialize(map_arrow(rows, _chunker, CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = min(63, 24 + max(8, math.ceil(math.log2(max(2, order * total)))))
    buckets = max(1, -(-order * total // BUCKET))
    ranges = Ranges(bits, buckets, order * total / max(1, chunks.count()) / buckets)
    count_bytes = max(1, total.bit_length() + 7 >> 3)
    asker = counts_asker(lambda row: [h for h, _ in _chunk_grams(row, order, bits)], ("words", "heads", "sizes"), ranges, count_bytes)
    asked = map_arrow(chunks.select("chunk", "words", "heads", "sizes"), asker, ASKED)
    told = materialize(asked.groupBy("bucket").applyInArrow(counts_answer(order, ranges, count_bytes), TOLD), "counts")
    pairs = chunks.select("chunk", "docs", "words", "heads", "sizes").groupBy("chunk").cogroup(told.groupBy("chunk"))
    scored = pairs.applyInArrow(_scorer(order, ranges, bits, total, count_bytes, backoff, min_count), SCORES)
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"), "n_by_order")
