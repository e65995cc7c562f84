"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes is counted: which byte followed which 0 to 3 bytes. Escape probabilities follow method
C: a context seen n times with d different next bytes gives a byte seen c times c / (n + d), and d / (n + d) to all others, which
the next shorter context then codes; below the empty context all 257 symbols are alike. The statistics are frozen after training,
so a text's code length is a sum over its bytes, and the language of the shortest code wins.

The trees are compiled into one automaton: a state is the longest kept context, and a table holds the code length of each next byte
for each language. Scoring a text is then two table look-ups a byte, vectorised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm._shared import map_arrow, plain, slices

ORDER = 3
#: Symbols are bytes plus one; 0 stands before a text.
BASE = 257
#: Contexts that all languages together saw fewer times are left out, shorter ones code instead.
MIN_CONTEXT = 4
#: Bytes that the table of code lengths may take; with more languages or symbols only more frequent contexts are kept, so that it fits.
MODEL_BYTES = 256 << 20
UNDETERMINED = "und"


@dataclass
class PpmModel:
    langs: list[str]
    symbol: np.ndarray  # byte -> column
    width: int
    state: np.ndarray  # code of the last three columns -> state
    bits: np.ndarray  # (states * width, languages)


def _padded(batch_texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes plus one of all texts, each after ORDER zeros, and where each text's zeros start."""
    flat = batch_texts.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    out = np.zeros(int(starts[-1]), np.int32)
    if sizes.sum():
        data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        out[np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1) * ORDER, sizes)] = data
        keep = np.ones(len(out), bool)
        keep[(starts[:-1, None] + np.arange(ORDER)).ravel()] = False
        out[keep] += 1
    return out, starts


def _texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(batch.column(column), ""))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of ORDER + 1 symbols, combined within each batch."""
    for batch in batches:
        for part in slices(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                s, starts = _padded(_texts(part.filter(pa.array(langs == lang)), "text"))
                if len(s) <= ORDER:
                    continue
                s = s.astype(np.int64)
                gram = ((s[:-3] * BASE + s[1:-2]) * BASE + s[2:-1]) * BASE + s[3:]
                gram, n = np.unique(gram[s[3:] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])


def fit(rows: DataFrame, max_docs: int = 1000, max_chars: int = 4_000_000, least: int = 20) -> PpmModel:
    """Count the trees on ``rows`` (id, text, lang) and compile them.

    Of each language about ``max_docs`` documents are taken, fewer if they are long (about ``max_chars`` characters): those whose
    hashed id is smallest, up to a bound that the language's size gives. Where that would be fewer than ``least``, the ``least``
    documents of smallest hash are taken, each up to its share of the characters. That sample is the only bound here; it keeps the trees the
    same size at any input. What the driver gets are the distinct grams of that sample.
    """
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    stats = {r["lang"]: r for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    if not stats:
        return compile_model({})
    share, few = F.lit(0.0), []
    for lang, r in sorted(stats.items()):
        part = min(1.0, max_docs / r["n"], max_chars / max(1, r["chars"]))
        if part < 1 and part * r["n"] < least:
            few.append((lang, max_chars // min(least, r["n"])))
            continue
        share = F.when(F.col("lang") == lang, F.lit(part)).otherwise(share)
    chance = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    taken = known.filter(chance < share).select("lang", "text")
    for lang, most in few:
        taken = taken.union(known.filter(F.col("lang") == lang).orderBy(chance, "id").limit(least).select("lang", F.substring("text", 1, most)))
    grams = map_arrow(taken, _counter, "lang string, gram long, n long")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(table.column("lang").to_pylist(), object)
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    return compile_model({lang: (grams[langs == lang], n[langs == lang]) for lang in sorted(stats)})


def compile_model(counts: dict[str, tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT, model_bytes: int = MODEL_BYTES) -> PpmModel:
    """Code lengths in bits for every kept context and next byte, per language; contexts seen ``min_context`` times are kept, or twice,
    four times and so on as many if the table would take more than ``model_bytes``."""
    langs = sorted(counts)
    if not langs:
        return PpmModel([], np.zeros(256, np.int64), 1, np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    grams = np.concatenate([counts[x][0] for x in langs]).astype(np.int64)
    n = np.concatenate([counts[x][1] for x in langs]).astype(np.float64)
    of = np.repeat(np.arange(len(langs)), [len(counts[x][0]) for x in langs])
    seen = np.unique(np.concatenate([grams // BASE**k % BASE for k in range(ORDER + 1)] + [np.zeros(1, np.int64)]))
    width = len(seen) + 1  # the last column is for all bytes that training never saw
    column = np.full(BASE, width - 1, np.int64)
    column[seen] = np.arange(len(seen))
    cols = [column[grams // BASE**k % BASE] for k in range(ORDER, -1, -1)]
    nxt = cols[-1]
    seen_by_order = []
    for order in range(1, ORDER + 1):
        code = np.zeros(len(grams), np.int64)
        for c in cols[ORDER - order : ORDER]:
            code = code * width + c
        seen_by_order.append(np.bincount(np.unique(code, return_inverse=True)[1], n))
    while min_context < 1 << 40 and (1 + sum(int((x >= min_context).sum()) for x in seen_by_order)) * width * len(langs) * 4 > model_bytes:
        min_context *= 2
    bits = np.full((1, width, len(langs)), np.log2(BASE), np.float32)
    contexts = np.zeros(1, np.int64)
    tables = []
    for order in range(ORDER + 1):
        code = np.zeros(len(grams), np.int64)
        for c in cols[ORDER - order : ORDER]:
            code = code * width + c
        if order:
            values, place = np.unique(code, return_inverse=True)
            kept = np.bincount(place, n) >= min_context
            if order > 1:  # a context is kept only if the next shorter one is
                kept &= np.isin(values % width ** (order - 1), contexts)
            place, use = (np.cumsum(kept) - 1)[place], kept[place]
            parent = np.searchsorted(contexts, values[kept] % width ** (order - 1))
            contexts = values[kept]
            bits = bits[parent]
        else:
            place, use = np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
            bits = bits.copy()
        key, inv = np.unique((place[use] * width + nxt[use]) * len(langs) + of[use], return_inverse=True)
        count = np.bincount(inv, n[use])
        ctx, sym, lang = key // len(langs) // width, key // len(langs) % width, key % len(langs)
        total, kinds = np.zeros((len(bits), len(langs))), np.zeros((len(bits), len(langs)))
        np.add.at(total, (ctx, lang), count)
        np.add.at(kinds, (ctx, lang), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits += np.where(total > 0, np.log2((total + kinds) / kinds), 0)[:, None, :].astype(np.float32)
        bits[ctx, sym, lang] = np.log2((total[ctx, lang] + kinds[ctx, lang]) / count)
        tables.append((contexts, bits))
    state = np.zeros(width**ORDER, np.int32)
    codes = np.arange(width**ORDER)
    first, stacked = 0, []
    for order, (contexts, bits) in enumerate(tables):
        if order == 0:
            state[:] = 0
        elif len(contexts):
            suffix = codes % width**order
            lookup = np.full(width**order, -1, np.int32)
            lookup[contexts] = np.arange(len(contexts)) + first
            found = lookup[suffix]
            state = np.where(found >= 0, found, state).astype(np.int32)
        stacked.append(bits)
        first += len(bits)
    return PpmModel(langs, column[1:], width, state, np.concatenate(stacked).reshape(-1, len(langs)))


def code_lengths(model: PpmModel, texts: pa.Array) -> np.ndarray:
    """Bits of each text (lower-cased, not null) under each language, one row a text."""
    s, starts = _padded(texts)
    out = np.zeros((len(texts), len(model.langs)))
    if len(s) <= ORDER or not model.langs:
        return out
    w = model.width
    c = np.concatenate([[0], model.symbol]).astype(np.int32)[s]
    context = (c[:-3] * w + c[1:-2]) * w + c[2:-1]
    at = model.state[context].astype(np.int64) * w + c[3:]
    ends = starts[1:] - ORDER  # in the shifted coordinates a text's own bytes end here
    for first in range(0, len(texts), 512):
        lo, hi = int(starts[first]), int(ends[min(first + 512, len(texts)) - 1])
        for k in range(lo, hi, 1 << 18):  # long texts in pieces, so that the gathered rows stay few
            top = min(hi, k + (1 << 18))
            rows = model.bits[at[k:top]].astype(np.float64)
            rows[s[k + ORDER : top + ORDER] == 0] = 0
            doc = np.searchsorted(starts, np.arange(k, top), side="right") - 1
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            np.add.at(out, doc[cuts], np.add.reduceat(rows, cuts, axis=0))
    return out


def _predictor(shared: Broadcast[PpmModel], keep_text: bool) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = _texts(part, "text")
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if model.langs:
                    bits = code_lengths(model, texts)
                    best = bits.argmin(axis=1)
                    odds = np.exp2(np.minimum(0, bits[np.arange(len(bits)), best][:, None] - bits)).sum(axis=1)
                    lang = np.where(letters, np.array(model.langs, object)[best], UNDETERMINED)
                    score = np.where(letters, 1 / odds, 0.0)
                else:
                    lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
                names = [x for x in part.schema.names if keep_text or x != "text"]
                kept = [part.column(x) for x in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return predict


def predict(rows: DataFrame, model: PpmModel, keep_text: bool = False) -> DataFrame:
    """``rows`` with ``lang_pred`` and ``score``, the posterior of the best language from code lengths alone; ``text`` goes unless kept."""
    fields = [f for f in rows.schema if keep_text or f.name != "text"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # the model's size is bounded by MODEL_BYTES and the states of three symbols; each executor gets it once
    return map_arrow(rows, _predictor(rows.sparkSession.sparkContext.broadcast(model), keep_text), schema)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, max_docs: int = 1000, min_score: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text is in a language that ``df`` itself teaches: not ``und``, and with at least ``min_score``.

    Learns as ``identify_languages`` does. All columns stay as they are; null texts go, repeated rows stay.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))
    model = fit(df.filter(~held).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")), max_docs)
    packed = df.select(F.struct(*[F.col(plain(c)).alias(c) for c in df.columns if c != text_col]).alias("rest"), F.col(text_col).alias("text"))
    kept = predict(packed, model, keep_text=True).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns])


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, max_docs: int = 1000) -> DataFrame:
    """Predict the language of every whole text, having learnt from rows outside the held-out fold.

    Held out: crc32 of the id as text, modulo ``folds``, is 0; a null id counts as held out. Returns id, ``held_out``,
    ``lang_pred``, ``score``. Null texts and texts without a letter are ``und`` with score 0, and so is everything if no row can be
    learnt from. Of equal code lengths the language first in the alphabet wins. Repeated rows each get a row; other columns are
    not read. Texts are lower-cased before they are coded.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))
    rows = df.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.filter(~F.col("held_out")), max_docs)
    return predict(rows.select("id", "held_out", "text"), model).withColumnRenamed("id", id_col)
