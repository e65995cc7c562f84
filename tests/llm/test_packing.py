"""Best-fit packing: the reduction, the plan, and whole packings."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from weftgraph.llm import packing
from weftgraph.llm.packing import Encoder, make_plan, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def reference(path=PATH):
    """The tokenizer as its file has it, special tokens within texts included."""
    return Tokenizer.from_file(path)


def fewest(sizes, capacity):
    """The least number of bins, by search."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted({b for b in bins if b >= sizes[i]}):
            k = bins.index(room)
            go(i + 1, bins[:k] + [room - sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return best


def placed(plan, histogram):
    bins = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            s, at = plan.place(length, rank)
            bins[s].append((at, length))
    return bins


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_a_packing_and_fixed_sets_lose_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 16, 30])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
    histogram = {s: sizes.count(s) for s in set(sizes)}
    plan = make_plan(histogram, capacity)
    bins = placed(plan, histogram)
    assert len(bins) == plan.sequences == len(set(bins))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    if sizes:
        # the sets that are fixed leave an instance whose best packing completes one of the whole
        rest = [length for s, items in bins.items() if s >= plan.fixed for _, length in items]
        assert plan.fixed + fewest(rest, capacity) == fewest(sizes, capacity)


def test_plan_of_many_is_near_the_bound():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20_000):
        histogram[min(4096, int(rng.lognormvariate(6, 1)) + 1)] += 1
    plan = make_plan(histogram)
    assert plan.sequences <= -(-sum(s * n for s, n in histogram.items()) // 4096) + 1
    with pytest.raises(ValueError):
        make_plan({0: 1})
    assert make_plan({}).sequences == 0


def test_encoder_equals_tokenizer():
    rng = random.Random(2)
    pool = [*"abc's't'LL'd DEF12345 \t\n\r\x0b\x1c\x85\xa0éÉßİŁǄ!?\"''-—“”…ΣΑςσ日本한é​\xad٣½²ªº_·", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    t, e = reference(), Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_tokens_in_texts():
    texts = ["x <|endoftext|> y", "<|startoftext|>", "a<|ENDOFTEXT|>b", "<|endoftext|", "<|endoftext|><|endoftext|> é"]
    t, e = reference(), Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert np.frombuffer(e.encode(texts[:1])[0], "<u4").tolist() == [343, 49407, 344]


def test_other_tokenizer_files():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["The Quick  brown fox's 123", "", " \n x", "<|endoftext|> Ünï", "日本"]
    t, e = reference(path), Encoder(path)
    assert not e.plain and Encoder(PATH).plain
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_plan_does_not_grow_with_the_corpus():
    def runs(n, seed):
        rng = random.Random(seed)
        histogram = defaultdict(int)
        for _ in range(3000):
            histogram[rng.randint(1025, 4096)] += rng.randint(1, 2 * n // 3000)
        plan = make_plan(histogram)
        assert sum(plan.used.values()) == sum(histogram.values())
        return sum(map(len, plan.runs.values()))

    assert runs(10_000_000, 1) < 2 * runs(100_000, 1) < 40_000
    two = make_plan({1300: 60_000, 1400: 60_000})
    assert sum(map(len, two.runs.values())) < 50 and two.sequences == 45_000  # 30,000 of 1400 + 1300 + 1300, 15,000 of 1400 + 1400


def test_steps_of_many_at_once_equal_single_steps(monkeypatch):
    rng = random.Random(3)
    for _ in range(40):
        capacity = rng.choice([12, 20, 31])
        histogram = {s: rng.randint(1, 30) for s in rng.sample(range(1, capacity + 1), rng.randint(1, 6))}
        many = make_plan(histogram, capacity)
        monkeypatch.setattr(packing, "SPARE", 10**9)
        single = make_plan(histogram, capacity)
        monkeypatch.undo()
        assert (many.sequences, many.fixed) == (single.sequences, single.fixed)
        fill = lambda plan: sorted(tuple(sorted(length for _, length in items)) for items in placed(plan, histogram).values())
        assert fill(many) == fill(single)


def test_encoder_forgets_and_remembers(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    e = Encoder(PATH)
    texts = ["one two three four five", "one two six seven eight nine", "one one two"]
    assert e.encode(texts) == Encoder(PATH).encode(texts)


def test_documents(spark):
    long = "word " * 5000
    rows = [(1, "a small text", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, "a small text", "x"), (5, "a small text", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = pack_documents(df, PATH).collect()
    t = reference()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    ids = [*t.encode(long, add_special_tokens=False).ids, 1]
    pieces = sorted(by_doc[4], key=lambda r: r["piece"])
    assert [r["length"] for r in pieces] == [4096, len(ids) - 4096] and [r["start"] for r in pieces] == [0, 4096]
    assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(np.array(ids[:4096], "<u4").tobytes()), zlib.crc32(np.array(ids[4096:], "<u4").tobytes())]
    assert len(by_doc[5]) == 2 and len(by_doc[None]) == 1
    assert by_doc[2][0]["length"] == by_doc[3][0]["length"] == 1 and by_doc[2][0]["ids_crc32"] == zlib.crc32(b"\x01\0\0\0")
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(fill) == 2  # all fit beside the last piece
    assert pack_documents(df.limit(0), PATH).count() == 0
