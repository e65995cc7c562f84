"""What the operators share: the cluster's shared folder, tables written there, joins with hot keys, and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs in this process (tests on one machine), a temporary folder is set as the
    checkpoint folder; on a cluster that would be a folder of one machine, so it is an error there.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; it goes when the Python process ends."""
    path = f"{shared_dir(spark)}/weftgraph/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialize`` gave and that nothing will read again; others stay as they are."""
    for df in tables:
        path = getattr(df, "weft_path", None)
        if path is not None and path in _written:
            _written.remove(path)
            drop_path(path, df.sparkSession)


@contextlib.contextmanager
def only_result(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Everything written within goes at the end, but for the tables in the list given, to be filled with what ``materialize`` gave."""
    before, kept = set(_written), []
    yield kept
    stay = {getattr(df, "weft_path", None) for df in kept}
    for path in [p for p in _written if p not in before and p not in stay]:
        _written.remove(path)
        drop_path(path, spark)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or a plain path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def drop_path(uri: str, spark: SparkSession | None = None) -> None:
    """Remove a folder, if it is there; through Spark's file systems while there is a session."""
    with contextlib.suppress(Exception):
        if spark is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            return
        where, path = filesystem(uri)
        where.delete_dir(path)


@atexit.register
def _drop_all() -> None:
    for path in _written:
        drop_path(path)


def ship(spark: SparkSession) -> None:
    """See to it, once a context, that executors can import this package."""
    context = spark.sparkContext
    if getattr(ship, "sent_to", None) != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        ship.sent_to = context.applicationId


def trim() -> None:
    """Give freed memory back to the system: Arrow's pool, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with this package at hand on executors; a task gives freed memory back each second, and when it ends."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        try:
            for out in f(batches):
                yield out
                if time.monotonic() - last > 1:
                    trim()
                    last = time.monotonic()
        finally:
            trim()

    return df.mapInArrow(run, schema)


def plain(name: str) -> str:
    """A column's name as a reference that takes it as it is, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most_bytes`` of one string column, at least a row each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most_bytes:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def hot_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, at_least: int = 100_000, share: int = 4096) -> DataFrame:
    """``left`` joined with ``right``, which has one row a ``key``, where one key may hold a third of ``left``.

    ``sizes`` (key, n) says how many rows of ``left`` a key has. Keys of over ``at_least`` rows and over a ``share``-th of all are
    fewer than ``share``, whatever the input: their rows of ``right`` are broadcast, and the others are shuffled.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bound = max(at_least, total // share)
    hot = sizes.filter(F.col("n") > bound).select(key) if total > at_least else None
    if hot is None or hot.isEmpty():
        return left.join(right, key)
    hot = F.broadcast(hot)
    some = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(some, key).unionByName(left.join(hot, key, "left_anti").join(right, key))


# numbers as bytes


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, compressed; planes that are zero throughout cost next to nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def fixed(values: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """Rows of numbers of ``width`` bytes each: row i holds those from ``cuts[i]`` to below ``cuts[i + 1]``. No work a row."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    offsets = (cuts.astype(np.int64) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unfixed(rows: list[bytes], width: int) -> np.ndarray:
    """All numbers of all rows, one after the other."""
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, width)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :width] = data
    return out.view("<u8").ravel().astype(np.uint64)


class Ranges:
    """Numbers of ``bits`` bits in ``buckets`` ranges of equal width, and how a chunk's sorted numbers go to them.

    ``few`` says that a chunk has few numbers for a bucket: then rows are cut from one array, at a cost that follows the numbers and
    not the buckets; else each row is compressed by itself. A bucket without numbers gets no row.
    """

    FEW = 512

    def __init__(self, bits: int, buckets: int, each: float) -> None:
        if bits > 63:
            raise ValueError("numbers have 63 bits at most")
        self.bits, self.width = bits, -(-(1 << bits) // buckets)
        self.few = each < self.FEW
        self.bytes = max(1, (self.width - 1).bit_length() + 7 >> 3)

    def cuts(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of sorted numbers, and where each one's begin, with the end of all."""
        own = values // np.uint64(self.width)
        starts = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1))) if len(own) else np.empty(0, np.int64)
        return own[starts].astype(np.int64), np.concatenate([starts, [len(values)]])

    def split(self, values: np.ndarray, buckets: np.ndarray, cuts: np.ndarray) -> pa.Array:
        if self.few:
            return fixed(values % np.uint64(self.width), cuts, self.bytes)
        return pa.array([pack_sorted(values[s:e] - np.uint64(int(b) * self.width)) for b, s, e in zip(buckets, cuts, cuts[1:], strict=False)], pa.binary())

    def merge(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers (less the bucket's first) of a bucket's rows, one row after the other, and how many each row has."""
        if self.few:
            return unfixed(rows, self.bytes), np.array([len(r) // self.bytes for r in rows], np.int64)
        parts = [unpack_sorted(r) for r in rows]
        return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array([len(p) for p in parts], np.int64)

    def split_counts(self, values: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
        """Rows of other numbers, of at most ``width`` bytes, cut alike."""
        if self.few:
            return fixed(values, cuts, width)
        return pa.array([pack(values[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)], pa.binary())

    def merge_counts(self, rows: list[bytes], width: int) -> np.ndarray:
        if self.few:
            return unfixed(rows, width)
        return np.concatenate([unpack(r) for r in rows]) if rows else np.empty(0, np.uint64)
