"""WARC archives: write, normalise and read.

``write_archives`` writes each partition as one gzip stream over many records (a monolithic archive). ``normalise_archives``
inflates each such stream once, writes every record again as a gzip member of its own, turns later copies of a payload into revisit
records, and puts a sidecar index of member offsets beside it. ``read_archives`` reads members through that index.
All files lie in the shared folder; a task writes under a name of its own and only files named in a written manifest count, so a
repeated attempt leaves at most a file that nothing reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._shared import filesystem, map_arrow, materialize, new_path

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
BLOCK = 1 << 20

RECORD = "archive string, ordinal long, page_id long, payload_bytes long, payload_digest string"
INDEX = "archive string, offset long, length long, page_id long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> bytes:
    """A URN that holds the page's id, or that there is none."""
    return b"<urn:uuid:" + str(uuid.UUID(int=0 if page_id is None else 1 << 64 | page_id & (1 << 64) - 1)).encode() + b">"


def page_of(urn: bytes) -> int | None:
    n = uuid.UUID(urn[10:-1].decode()).int
    if not n >> 64:
        return None
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def build_record(kind: bytes, page_id: int | None, url: bytes, digest: str, size: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record; a revisit has no payload but names its full size."""
    head = [VERSION, b"WARC-Type: " + kind, b"WARC-Record-ID: " + record_id(page_id), b"WARC-Date: " + DATE, b"WARC-Target-URI: " + url.replace(b"\r", b"%0D").replace(b"\n", b"%0A"), b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % size]
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + record_id(refers_to)]
    head += [b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[bytes, bytes]:
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.lower(): v for k, _, v in (x.partition(b": ") for x in lines)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream, once through, whether it is one member or many; a cut-off stream is an error."""
    z = zlib.decompressobj(31)
    fresh = True
    for data in chunks:
        while data:
            if z.eof:
                z, fresh = zlib.decompressobj(31), True
            out = z.decompress(data, BLOCK)
            fresh = False
            if out:
                yield out
            data = z.unused_data if z.eof else z.unconsumed_tail
            if not data and not z.eof:
                while len(out) == BLOCK:
                    if out := z.decompress(b"", BLOCK):
                        yield out
    if not fresh and not z.eof:
        raise EOFError("the gzip stream ends early")


def split_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and payload of each record of a stream; holds one record at a time."""
    held = bytearray()

    def more() -> bool:
        for c in chunks:
            held.extend(c)
            return True
        return False

    while True:
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(held) - 3)
            if not more():
                if bytes(held).strip():
                    raise EOFError("a record's header ends early")
                return
        head = parse_head(bytes(held[:end]))
        size = int(head[b"content-length"])
        while len(held) < end + 4 + size + 4:
            if not more():
                raise EOFError("a record ends early")
        body = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        yield head, body


def _chunks(stream) -> Iterator[bytes]:
    while data := stream.read(BLOCK):
        yield data


def _archiver(folder: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        stream = z = None
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        ordinal = 0
        for batch in batches:
            rows: list[tuple] = []
            pages, urls, htmls = (batch.column(k).to_pylist() for k in range(3))
            for page, url, payload in zip(pages, urls, htmls, strict=True):
                if stream is None:
                    stream, z = where.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                digest = digest_of(payload)
                stream.write(z.compress(build_record(b"response", page, url, digest, len(payload), payload)))
                rows.append((name, ordinal, page, len(payload), digest))
                ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"]) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("archive", pa.string()), ("ordinal", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))
        if stream is not None:
            stream.write(z.flush())
            stream.close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write each partition of ``pages`` as one monolithic archive; returns what was written, a row a record (RECORD).

    Null html is an empty payload, a null url an empty one.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc-whole")
    where, root = filesystem(folder)
    where.create_dir(root, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).cast("binary").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    return materialize(map_arrow(rows, _archiver(folder), RECORD), "warc-records")


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of ``records``, those that repeat a payload: archive, ordinal, refers_to.

    Of equal payloads of at least ``min_bytes`` the smallest page id is the response (of repeated rows with that id, all are). Rows
    with a null id are responses, and no other row revisits them. Only digests and ids are shuffled, and minima combine before the shuffle.
    """
    large = records.filter(F.col("payload_bytes") >= min_bytes)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    return large.join(first, "payload_digest").filter("page_id <> refers_to").select("archive", "ordinal", "refers_to")


def _normaliser(folder: str) -> Callable:
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = filesystem(folder)
        for batch in batches:
            for archive, ordinals, targets in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                refers = dict(zip(ordinals, targets, strict=True))
                name = f"{uuid.uuid4().hex}.warc.gz"
                offsets: list[tuple] = []
                at = 0
                source, path = filesystem(archive)
                with source.open_input_stream(path, compression=None) as stream, where.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for ordinal, (head, body) in enumerate(split_records(inflate(_chunks(stream)))):
                        page, target = page_of(head[b"warc-record-id"]), refers.get(ordinal)
                        digest, url = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), head[b"warc-target-uri"]
                        record = build_record(b"response", page, url, digest, len(body), body) if target is None else build_record(b"revisit", page, url, digest, len(body), b"", target)
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(record) + z.flush()
                        out.write(member)
                        offsets.append((f"{folder}/{name}", at, len(member), page))
                        at += len(member)
                with where.open_output_stream(f"{root}/{name}.idx", compression=None) as side:
                    for _, offset, length, page in offsets:
                        side.write(json.dumps({"offset": offset, "length": length, "page_id": page}).encode() + b"\n")
                for k in range(0, len(offsets), 10_000):
                    part = list(zip(*offsets[k : k + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), *(pa.array(c, pa.int64()) for c in part[1:])], names=["archive", "offset", "length", "page_id"])

    return rewrite


def normalise_archives(spark: SparkSession, records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rewrite the archives named in ``records`` (as ``write_archives`` returned them) record by record; returns the index (INDEX).

    A task takes whole archives and inflates each once, holding one record at a time and the numbers of that archive's revisits.
    The index rows are those of the ``.idx`` sidecars.
    """
    folder = new_path(spark, "warc")
    where, root = filesystem(folder)
    where.create_dir(root, recursive=True)
    names = records.select("archive").distinct()
    again = revisits(records, min_bytes).groupBy("archive").agg(F.collect_list(F.struct("ordinal", "refers_to")).alias("r"))
    plan = names.join(again, "archive", "left").select("archive", F.coalesce("r.ordinal", F.array().cast("array<long>")).alias("ordinals"), F.coalesce("r.refers_to", F.array().cast("array<long>")).alias("targets"))
    n = max(1, names.count())
    return materialize(map_arrow(plan.repartition(n, "archive"), _normaliser(folder), INDEX), "warc-index")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    opened = name = None
    for batch in batches:
        rows, held = [], 0
        for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if archive != name:
                if opened is not None:
                    opened.close()
                where, path = filesystem(archive)
                name, opened = archive, where.open_input_file(path)
            z = zlib.decompressobj(31)
            record = z.decompress(opened.read_at(length, offset))
            if not z.eof or z.unused_data:
                raise ValueError(f"{archive} at {offset}: not exactly one member")
            ((head, body),) = split_records(iter([record]))
            digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
            kind, target = head[b"warc-type"].decode(), head.get(b"warc-refers-to")
            if kind == "response" and digest_of(body) != digest:
                raise ValueError(f"{archive} at {offset}: the payload differs from its digest")
            rows.append((page_of(head[b"warc-record-id"]), int(head[b"x-payload-length"]), digest, kind, page_of(target) if target else None, head[b"warc-target-uri"].decode(), body if kind == "response" else None))
            held += len(body)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if opened is not None:
        opened.close()


def read_archives(index: DataFrame) -> DataFrame:
    """Every record that ``index`` names, by its offset; a response's payload is held against its digest (READ)."""
    return map_arrow(index.select("archive", "offset", "length"), _reader, READ)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back ``pages``: a row a record, as READ.

    An empty table gives no records. Repeated rows each get a record; those with the smallest id of their payload are responses, and
    so are rows with a null id, which keep it.
    Empty payloads are payloads like any other. Other columns are not read.
    """
    records = write_archives(pages, id_col, url_col, html_col)
    return read_archives(normalise_archives(pages.sparkSession, records, min_bytes))
