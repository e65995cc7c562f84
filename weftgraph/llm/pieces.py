"""SentencePiece encoding to the n best segmentations, and decoding.

The pieces of a model and their scores make a lattice over a text; a segmentation's score is the sum of its pieces' scores. A forward
Viterbi pass gives the best score of each prefix. That is an exact heuristic for an A* search that walks backward from the end, so
the search takes complete segmentations off its queue in the order of their scores, best first.

Where no piece has a word mark after its first other character, spans letters and others, or holds a line break, the lattice falls
apart into units that start with their word marks; a model is checked for the finest cut that none of its pieces crosses, and one
that has none is searched over whole texts. Texts are normalised as the model's file says.
Units are remembered by worker. Of a whole text, the n best segmentations change only units among those n - 1 occurrences whose
second-best segmentation costs least; the A* search runs on these, and sums of their losses give the text's order.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import map_arrow, slices

MARK = "▁"
NONE = 1 << 60
#: Units that a worker remembers, in each of two generations; a longer text may exceed it while it is encoded.
REMEMBERED = 400_000
#: Where a text may be cut into units: before word marks, and between letters and others if no piece spans that.
COARSE = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
FINE = re.compile(f"\n|{MARK}*[A-Za-zÀ-ɏ]+|{MARK}*[^{MARK}\nA-Za-zÀ-ɏ]+|{MARK}+")
LINES = re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")
WHOLE = re.compile("(?s).+")


def plain_normaliser(proto: bytes) -> bool:
    """Whether a model's file asks for no more than a word mark first and word marks for spaces: the fields of its NormalizerSpec."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                byte = data[at]
                at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
                if byte < 128:
                    return out

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            elif key & 7 == 2:
                n = number()
                yield key >> 3, data[at : at + n]
                at += n
            else:
                n = 4 if key & 7 == 5 else 8
                yield key >> 3, data[at : at + n]
                at += n

    # NormalizerSpec is field 3; in it 2 is the character map, 3 to 5 are the prefix, extra spaces and escapes.
    spec = dict(fields(next((v for k, v in fields(proto) if k == 3), b"")))
    return not spec.get(2) and spec.get(3, 1) == 1 and spec.get(4, 1) == 0 and spec.get(5, 1) == 1


class PieceModel:
    """Pieces and scores of a model file. Pieces for bytes stand in for characters that no piece has, at less than the least score."""

    def __init__(self, path: str | None = None, pieces: dict[str, tuple[int, float]] | None = None, byte_ids: list[int] | None = None) -> None:
        self.normalise = None
        if pieces is None:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_byte(i) or model.is_unused(i) or model.is_unknown(i))]
            scores = [model.get_score(i) for i in plain]
            scores = list(map(int, scores)) if all(x.is_integer() for x in scores) else scores  # ranks stay whole numbers
            pieces = {model.id_to_piece(i): (i, x) for i, x in zip(plain, scores, strict=True)}
            if not plain_normaliser(model.serialized_model_proto()):
                self.normalise = model.normalize
            byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a word mark inside")
        self.pieces = pieces
        self.byte_ids = byte_ids
        self.byte_score = min((s for _, s in pieces.values()), default=0) - 10
        # (what follows, score, id) by letter; score and id are None where no piece ends
        self.trie: dict[str, list] = {}
        for piece, (i, score) in pieces.items():
            below = self.trie
            for c in piece:
                node = below.setdefault(c, [{}, None, None])
                below = node[0]
            node[1], node[2] = score, i
        self.n_best = functools.lru_cache(20_000)(self.search)
        # a piece, or None for what only starts one
        self.table = dict.fromkeys(p[:k] for p in pieces for k in range(1, len(p) + 1)) | pieces
        # whether two neighbouring characters are cut depends on them alone, so a piece that is whole by itself is so everywhere
        self.units = next(cut for cut in (FINE, COARSE, LINES, WHOLE) if all(cut.findall(p) == [p] for p in pieces))
        self.bytes_of = {i: p.replace(MARK, " ").encode() for p, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    def lattice(self, unit: str) -> list[tuple[int, int, float, int | tuple[int, ...]]]:
        """The pieces of the lattice, by start: (start, end, score, id), with all ids where bytes stand in for a character."""
        edges, get, n = [], self.table.get, len(unit)
        for i in range(n):
            first = len(edges)
            for j in range(i + 1, n + 1):
                found = get(unit[i:j], 0)
                if found:
                    edges.append((i, j, found[1], found[0]))
                elif found is not None:
                    break
            if first == len(edges) or edges[first][1] > i + 1:
                data = unit[i].encode()
                edges.append((i, i + 1, self.byte_score * len(data), tuple(self.byte_ids[b] for b in data)))
        return edges

    def forward(self, edges: list[tuple], n: int) -> tuple[list[int], list[tuple | None]]:
        """The best score of each prefix, and the piece that ends it; of equal ones the longest."""
        best, via = [0] + [-NONE] * n, [None] * (n + 1)
        for e in edges:
            i, j, s, _ = e
            s += best[i]
            if s > best[j]:
                best[j], via[j] = s, e
        return best, via

    def best(self, unit: str) -> tuple[int, int, list[int]]:
        """Score of the best segmentation, how much less the second-best scores (NONE if there is none), and the best's ids.

        The forward pass with the two best scores of each prefix; of equal ones the longest piece comes first."""
        n, root = len(unit), self.trie
        first, second = [0] + [-NONE] * n, [-NONE] * (n + 1)
        via: list[int] = [0] * (n + 1)
        ids: list = [None] * (n + 1)
        for i in range(n):
            one, two = first[i], second[i]
            below, j = root, i
            for c in unit[i:]:
                node = below.get(c)
                if node is None:
                    break
                below, s, x = node
                j += 1
                if s is not None:
                    v, top = one + s, first[j]
                    if v > top:
                        w = two + s
                        second[j] = w if w > top else top
                        first[j], via[j], ids[j] = v, i, x
                    elif v > second[j]:
                        second[j] = v
            if unit[i] not in self.pieces:  # bytes for a character
                data, j = unit[i].encode(), i + 1
                s = self.byte_score * len(data)
                v, top = one + s, first[j]
                if v > top:
                    second[j] = max(top, two + s)
                    first[j], via[j], ids[j] = v, i, tuple(self.byte_ids[b] for b in data)
                elif v > second[j]:
                    second[j] = v
        own, j = [], n
        while j:
            x = ids[j]
            own.extend(reversed(x)) if isinstance(x, tuple) else own.append(x)
            j = via[j]
        own.reverse()
        return first[n], (first[n] - second[n] if second[n] > -NONE // 2 else NONE), own

    def search(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """Up to ``n`` segmentations, best first: (score, ids). Backward A* search under the forward scores; of equal scores, which
        comes first follows from the order of the search, and is the same each time."""
        edges = self.lattice(unit)
        best, _ = self.forward(edges, len(unit))
        into: list[list[tuple]] = [[] for _ in range(len(unit) + 1)]
        for i, j, s, own_ids in edges:
            into[j].append((i, own_ids if isinstance(own_ids, tuple) else (own_ids,), s))
        heap: list[tuple[int, int, int, int, tuple]] = [(-best[-1], 0, len(unit), 0, ())]
        found, count = [], 0
        while heap and len(found) < n:
            f, _, at, score, ids = heapq.heappop(heap)
            if at == 0:
                own: list[int] = []
                while ids:
                    own.extend(ids[0])
                    ids = ids[1]
                found.append((-f, tuple(own)))
                continue
            for i, own_ids, s in into[at]:
                count += 1
                heapq.heappush(heap, (-(score + s + best[i]), count, i, score + s, (own_ids, ids)))
        return found

    def units_of(self, text: str) -> list[str]:
        """Units of a text, normalised: word marks for spaces, one more first."""
        if text and self.normalise is not None:
            return self.units.findall(self.normalise(text))
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the word mark that encoding puts first; ids without text give none."""
        try:
            data = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            data = b"".join([self.bytes_of.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace").removeprefix(" ")


class Encoder(dict):
    """(score, loss, ids) of units. Two generations: when the younger is full it becomes the older, from which units come back."""

    def __init__(self, model: PieceModel) -> None:
        self.model, self.older = model, {}

    def __missing__(self, unit: str) -> tuple[int, int, bytes]:
        found = self.older.get(unit)
        if found is None:
            score, loss, ids = self.model.best(unit)
            found = score, loss, array("I", ids).tobytes()
        self[unit] = found
        return found

    def n_best(self, text: str, n: int) -> list[tuple[int, bytes]]:
        """Up to ``n`` segmentations of a text, best first: (score, ids as little-endian unsigned 32-bit)."""
        units = self.model.units_of(text)
        if not units:
            return [(0, b"")]
        scores, losses, parts = zip(*map(self.__getitem__, units), strict=True)
        total = sum(scores)
        out = [(total, b"".join(parts))]
        if n > 1:
            few = self._least(np.array(losses, np.float64), n - 1) if len(losses) > n else np.argsort(losses, kind="stable")[: n - 1]
            lists = [(int(p), self.model.n_best(units[p], n)) for p in few if losses[p] < NONE]
            sums: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
            for at, found in lists:
                grown = [(loss + found[0][0] - s, (*chosen, (at, k)) if k else chosen) for loss, chosen in sums for k, (s, _) in enumerate(found)]
                sums = sorted(grown)[:n]
            by_place = dict(lists)
            for loss, chosen in sums[1:]:
                other = list(parts)
                for at, k in chosen:
                    other[at] = array("I", by_place[at][k][1]).tobytes()
                out.append((total - loss, b"".join(other)))
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        return out

    @staticmethod
    def _least(losses: np.ndarray, n: int) -> np.ndarray:
        """Places of the ``n`` least, of equal ones the first."""
        most = np.partition(losses, n - 1)[n - 1]
        under, same = np.flatnonzero(losses < most), np.flatnonzero(losses == most)
        return np.concatenate([under, same[: n - len(under)]])


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(PieceModel(path))


ENCODED = "id long, n_pieces long, scores array<double>, ids_crc32 array<long>, text_crc32 long, decoded_crc32 long"


def _encoder(path: str, n: int, keep_ids: bool) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    found = own.n_best(text, n)
                    ids = np.frombuffer(found[0][1], "<u4")
                    again = own.model.decode(ids.tolist())
                    row = (len(ids), [s for s, _ in found], [zlib.crc32(x) for _, x in found], zlib.crc32(text.encode()), zlib.crc32(again.encode()))
                    rows.append((*row, [np.frombuffer(x, "<u4").astype(np.int32).tolist() for _, x in found]) if keep_ids else row)
                kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.int64()] + [pa.list_(pa.list_(pa.int32()))] * keep_ids
                names = [x.split()[0] for x in ENCODED.split(", ")] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return encode


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", n: int = 4, keep_ids: bool = False) -> DataFrame:
    """The ``n`` best segmentations of every whole text, best first, and the best one decoded again.

    Returns id, ``n_pieces`` of the best, ``scores``, ``ids_crc32`` (of little-endian unsigned 32-bit ids), ``text_crc32`` and
    ``decoded_crc32`` (equal, unless the text holds the word mark itself, which decodes to a space, or the model normalises); with ``keep_ids`` also ``ids``,
    array<array<int>>. Texts with fewer segmentations give shorter lists. Null and empty texts have one, without pieces, of score 0.
    Repeated rows each get a row, null ids are kept, other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ENCODED + (", ids array<array<int>>" if keep_ids else "")
    return map_arrow(rows, _encoder(model_path, n, keep_ids), schema).withColumnRenamed("id", id_col)


def _decoder(path: str) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path).model
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return decode


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of lists of piece ids; null for a null list, nothing for control pieces and unknown ids."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_arrow(rows, _decoder(model_path), "id long, text string").withColumnRenamed("id", id_col)
