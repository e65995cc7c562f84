"""The corpus pipeline and the registered queries, on a small corpus."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from weftgraph.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = {"en": "the river and the house of the old town with many people in it ", "fr": "la rivière et la maison de la vieille ville où été garçon être "}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        words = base[lang].split()
        rows.append((i, " ".join(words[(i * k) % len(words)] + ("" if k % 5 else str(i)) for k in range(1, 60)), lang, f"s{i % 6}"))
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[3][1].upper(), "en", "s2"), (102, "1234 !!", "en", "s1"), (103, None, None, None), (104, rows[5][1] + " token=q9w8e7r6t5y4 " + rows[7][1], "en", "s3")]
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), corpus_pipeline.materialize(stage(spark, docs, path), name)
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert ids == {r[0] for r in rows} - {102, 103}
        elif name == "simhash_near_dedup":
            assert not ids & {100, 101} and 3 in ids and len(ids) == docs.count()
        else:
            assert docs.count() == before
            found = docs.filter("doc_id = 104").first()
            assert "[SECRET]" in found["text"] and "q9w8" not in found["text"] and found["n_chars"] == len(found["text"])
    final = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in final.collect()} == {r["doc_id"] for r in docs.collect()}
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(final.columns)


def plain_pipeline(rows):
    """The kept documents with their masked texts, straight from each stage's definition. ``rows``: id, text, language, source."""
    from test_near_duplicates import plain_shingles, roots
    from test_texts import PATTERNS, plain_bits, plain_spans

    taught = defaultdict(list)
    for i, text, lang, _ in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            taught[lang].append(text)
    docs = []
    for i, text, _, source in rows:
        if text is not None and re.search(r"[^\W\d_]", text):
            bits = np.array(list(plain_bits(taught, text).values()))
            if 1 / np.exp2(bits.min() - bits).sum() >= 0.5:
                docs.append((i, text, source))
    docs.sort()
    sets = [plain_shingles(t.lower()) for _, t, _ in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = [docs[k] for k in sorted(set(roots(len(docs), links)))]
    holders = defaultdict(set)
    found = []
    for i, text, source in docs:
        spans = []
        for start, _, end, kind in plain_spans(text):
            value = PATTERNS["assign"].match(text, start)[2] if kind == "assign" else text[start:end]
            holders[value].add((source, i))
            spans.append((start, end, value))
        found.append(spans)
    out = {}
    for (i, text, _), spans in zip(docs, found, strict=True):
        own = lambda v: len({s for s, _ in holders[v]}) < 3 and len(holders[v]) < 25
        merged = []
        for start, end, value in sorted(spans):
            if merged and start < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]), merged[-1][2] or own(value))
            else:
                merged.append((start, end, own(value)))
        for start, end, mine in reversed(merged):
            text = text[:start] + ("[SECRET]" if mine else "[EXAMPLE]") + text[end:]
        out[i] = text
    return out


def test_whole_pipeline_equals_brute_force(spark, tmp_path_factory):
    import random

    rng = random.Random(21)
    words = {"en": "the river and house of old town with many people in it by that this from".split(), "fr": "la rivière maison vieille ville où été garçon être dans les des une pour sur avec".split()}
    rows = []
    for i in range(90):
        lang = "en" if i % 2 else "fr"
        text = [rng.choice(words[lang]) for _ in range(rng.choice([3, 40, 60]))]
        if i > 60 and i % 3:  # a copy of an earlier one with a few changes
            text = rows[i - 40][1].split()
            for at in rng.sample(range(len(text)), min(len(text), rng.randrange(3))):
                text[at] = f"w{i}"
        if i % 7 == 0:
            text.insert(1, rng.choice(["token=q9w8e7r6t5y4", f"password: Zx{i}9fK2mQ7", "api_key=examplevalue99"]))
        rows.append((i, " ".join(text), lang if i % 11 else None, f"s{i % 4}"))
    rows += [(200, None, "en", "s1"), (201, "12 34 !!", "en", None), (202, "", None, "s2"), (203, rows[5][1], "fr", "s9")]
    path = str(tmp_path_factory.mktemp("brute"))
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(3).write.parquet(f"{path}/documents.parquet")
    want = plain_pipeline(rows)
    got = corpus_pipeline.run(spark, path).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4") for i, text in want.items()}
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted((i, 0, 0, len(x), zlib.crc32(x.tobytes())) for i, x in ids.items())
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(fill) == -(-sum(map(len, ids.values())) // 4096)
    for items in fill.values():
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:k]) for k in range(len(items))]


def test_stages_keep_odd_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 as id", "2 as key", "3 as `a.b c`", "4 as rest", "5 as score", "6 as __spans", "cast(null as string) as fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, path), "odd")
        assert docs.columns == columns
    empty = docs.limit(0)
    assert [stage(spark, empty, path).count() for _, stage in corpus_pipeline.STAGES] == [0] * 4


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
