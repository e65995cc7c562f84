"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so a histogram holds all that packing needs, and its size does not grow with the
corpus. On the driver the histogram is first reduced: a small set of lengths that fills a sequence at least as well as any other set
with its longest member is fixed for good. What remains is packed best-fit, longest first, for all documents of a length at once.
The plan says which ranks of a length go where; the documents get their ranks in salted groups, with no group of all of a length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._shared import map_arrow, materialize, slices

CAPACITY = 4096
#: Groups into which the pieces of one length are salted.
SALT = 1024
#: Items of a length beyond which no test in ``_dominating`` can tell how many there are.
SPARE = 4
#: Words whose ids a worker remembers, in each of two generations; a longer text may exceed it while it is encoded.
REMEMBERED = 120_000
# How a tokenizer file has to normalise and split for words to be remembered here, and characters for which that is the same.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
OTHER = re.compile("[^\t\n\r -~\xa1-ɏ‐-‧‰-⁞]")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: the printable ones stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class _Remembered(dict):
    """Ids of a split word, or of what stands between white space, encoded by the tokenizer's model when first asked for.

    Two generations: when the younger is full it becomes the older, from which what is asked for again comes back.
    """

    def __init__(self, model) -> None:
        self.model, self.letters, self.older = model, _byte_letters(), {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            parts = [chunk] if chunk.isalpha() else SPLIT.findall(chunk)
            if len(parts) == 1:
                mapped = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            else:
                ids = b"".join([self[w] for w in parts])
        self[chunk] = ids
        return ids

    def age(self) -> None:
        self.older = dict(self)
        self.clear()


def splits_as_here(config: dict) -> bool:
    """Whether a tokenizer file normalises and splits as ``Encoder`` does for itself; any other goes through the tokenizer."""
    return (
        config.get("normalizer") == NORMALIZER
        and config.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [SPLITTER, BYTES]}
        and config.get("model", {}).get("type") == "BPE"
        and not config["model"].get("dropout")
        and not (config.get("truncation") or config.get("padding"))
        and not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in config.get("added_tokens", []))
    )


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes: those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    If the tokenizer's file says that it encodes each split word by itself, and that words do not span white space, both are
    remembered, up to a bound. A text that holds an added token, or characters whose normalisation could differ here, goes through
    the tokenizer as a whole, and so does every text under another kind of file.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.plain = splits_as_here(config)
        self.added = [t["content"].lower() for t in config.get("added_tokens", [])]
        self.known = _Remembered(self.tokenizer.model)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            lower = text.lower()
            if not self.plain or OTHER.search(text) or any(t in lower for t in self.added):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(self.known.__getitem__, lower.split())))
            if len(self.known) > REMEMBERED:
                self.known.age()
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)


def _cutter(path: str, end_id: int, capacity: int) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, rows = part.column("id").to_pylist(), []
                for doc, data in zip(ids, own.encode(part.column("text").to_pylist()), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        own_ids = data[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(own_ids) // 4, zlib.crc32(own_ids)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut only where they exceed ``capacity``. Null is empty."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_arrow(rows, _cutter(tokenizer_path, end_id, capacity), "id long, piece int, start long, length long, ids_crc32 long")


def _highest(mask: int, most: int) -> int:
    """The highest set bit at or below ``most``, or 0."""
    return max(0, (mask & ((1 << most + 1) - 1)).bit_length() - 1) if most > 0 else 0


def _lowest(mask: int, least: int = 0) -> int:
    """The lowest set bit at or above ``least``, or 0."""
    mask = mask >> least << least
    return (mask & -mask).bit_length() - 1 if mask else 0


@dataclass
class Plan:
    """``runs``: of each length, (first rank, first sequence, items a sequence, offset)."""

    sequences: int = 0
    fixed: int = 0
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.runs.setdefault(length, []).append((rank, sequence, each, offset))
        self.used[length] = rank + n

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """Sequence and offset of the item of this rank; for tests and single look-ups."""
        runs = self.runs[length]
        first, sequence, each, offset = runs[bisect_right(runs, rank, key=lambda r: r[0]) - 1]
        return sequence + (rank - first) // each, offset + (rank - first) % each * length


def _dominating(counts: list[int], mask: int, size: int, capacity: int) -> tuple[int, ...] | None:
    """Companions of an item of ``size`` that dominate every other set with it; () if none fits; None if that isn't known.

    Two companions are tried only where no set of three could fit beside the item.
    """
    room = capacity - size

    def without(m: int, *gone: int) -> int:
        for g in set(gone):
            if counts[g] <= gone.count(g):
                m &= ~(1 << g)
        return m

    rest = without(mask, size)
    best = _highest(rest, room)
    if not best:
        return ()
    least = _lowest(rest)
    second = _lowest(without(mask, size, least))
    if best == room or not second or least + second > room:
        return (best,)
    third = _lowest(without(mask, size, least, second))
    if third and least + second + third <= room:
        return None
    other = _highest(without(mask, size, best), room - best)
    if not other:
        return None
    above = without(mask, size) >> other + 1 << other + 1
    x = _lowest(above)
    if x:
        twice = counts[x] - (x == size) > 1
        y = x if twice else _lowest(above, x + 1)
        if y and x + y <= room:
            return None
    return (best, other)


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``histogram`` (length -> how many) into sequences of ``capacity``."""
    counts = [0] * (capacity + 2)
    mask = 0
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        counts[length] = n
        mask |= (n > 0) << length
    plan = Plan()
    changed = True
    while changed:
        changed = False
        size = _highest(mask, capacity)
        while size:
            while counts[size]:
                found = _dominating(counts, mask, size, capacity)
                if found is None:
                    break
                group = (size, *found)
                kinds = {g: group.count(g) for g in group}
                n = min(counts[g] // k for g, k in kinds.items())
                if len(group) == 3:
                    # what dominates turns on whether a length has up to three items besides; as long as its own have more, it stays
                    n = max(1, min((counts[g] - SPARE) // k for g, k in kinds.items()))
                offset = 0
                for g in sorted(kinds, reverse=True):
                    plan.put(g, n * kinds[g], plan.sequences, kinds[g], offset)
                    offset += g * kinds[g]
                    counts[g] -= n * kinds[g]
                    if not counts[g]:
                        mask &= ~(1 << g)
                plan.sequences += n
                changed = True
            size = _highest(mask, size - 1)
    plan.fixed = plan.sequences
    open_, rooms = {}, 0  # room left -> [(first sequence, how many)], and the rooms that are there

    def leave(room: int, first: int, n: int) -> None:
        nonlocal rooms
        if room and n:
            open_.setdefault(room, []).append((first, n))
            rooms |= 1 << room

    size = _highest(mask, capacity)
    while size:
        left = counts[size]
        while left:
            room = _lowest(rooms, size)
            if room:
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms &= ~(1 << room)
            else:
                room, first, n = capacity, plan.sequences, -(-left // (capacity // size))
                plan.sequences += n
            each = room // size
            full = min(n, left // each)
            if full:
                plan.put(size, full * each, first, each, capacity - room)
                leave(room - each * size, first, full)
                left -= full * each
            if full < n and 0 < left < each:
                plan.put(size, left, first + full, left, capacity - room)
                leave(room - left * size, first + full, 1)
                left, full = 0, full + 1
            leave(room, first + full, n - full)
        size = _highest(mask, size - 1)
    return plan


def _placer(plan: Plan) -> Callable:
    runs = sorted((length, *run) for length, many in plan.runs.items() for run in many)
    keys = np.array([(length << 44) + rank for length, rank, *_ in runs], np.int64)
    table = np.array(runs, np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            run = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1].reshape(-1, 5)
            nth = rank - run[:, 1]
            kept = [batch.column(k) for k in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(run[:, 2] + nth // run[:, 3]), pa.array(run[:, 4] + nth % run[:, 3] * length)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack all rows of ``df``: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, a row a piece.

    Null and empty texts are documents of one id, ``end_id``. Repeated rows are documents of their own, and a null id is kept. Which
    of the pieces of one length gets which place is free. An empty table gives no rows; other columns are not read. The driver gets
    the histogram of lengths only, of at most ``capacity`` rows.
    """
    pieces = cut_documents(df, tokenizer_path, id_col, text_col, end_id, capacity)
    pieces = materialize(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(SALT)).cast("int")), "pieces")
    groups = materialize(pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = make_plan({r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece"))
    ranked = pieces.withColumn("nth", nth).join(first, ["length", "salt"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))
    placed = map_arrow(ranked, _placer(plan), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
