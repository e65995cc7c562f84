"""SimHash and lattice near-duplicates, and connected components, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from weftgraph.llm import lattice, simhash
from weftgraph.llm.components import connected_components
from weftgraph.llm.lattice import decode_e8, embedding_components
from weftgraph.llm.simhash import drop_near_duplicates, drop_similar, fingerprint_links, simhash_components


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    want = roots(600, links)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert all(got.get(i, i) == want[i] for i in range(600))
    for block in (1, 7, 50):  # links of several blocks are connected by steps
        assert {r["node"]: r["component"] for r in connected_components(df, block=block).collect()} == got
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "bucket"), [(2048, 4_000_000), (7, 5000), (1000, 100)])
def test_links_equal_brute_force(spark, chunk, bucket):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(15)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for c in centres for _ in range(30)}
    prints = sorted(prints | {0, (1 << 64) - 1, 1 << 63})
    arr = np.array(prints, np.uint64)
    want = roots(len(prints), [(i, int(j)) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4) if i < j])
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "fp long, rep long")
    links = [(r["a"], r["b"]) for r in fingerprint_links(df, 4, chunk, bucket).collect()]
    assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in links)
    assert len(links) == len(set(links))
    assert roots(len(prints), links) == want
    assert fingerprint_links(df.limit(0)).count() == 0


def test_every_pair_within_the_radius_meets():
    """Each value of the whole ball is emitted, and every pair within the radius has one in common."""
    rng = random.Random(7)
    flips = simhash.masks(64, 2)
    assert len(flips) == len(set(flips.tolist())) == 1 + 64 + 64 * 63 // 2
    for d in range(5):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), d))
        values, hashes = simhash.ball_hashes(np.array([a, b], np.uint64), flips, 37)
        assert set(values[: len(flips)].tolist()) & set(values[len(flips) :].tolist())
        assert {int(h) for h in hashes[: len(flips)]} & {int(h) for h in hashes[len(flips) :]} and int(hashes.max()) < 1 << 37


def test_rows_of_one_id_and_different_texts(spark):
    long = [" ".join(f"{k}w{i}" for i in range(50)) for k in "abc"]
    rows = [(1, long[0], "x"), (1, long[1], "x"), (1, long[0], "y"), (2, long[1] + " ", "x"), (3, long[2], "x"), (None, long[2], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    for drop in (drop_near_duplicates, drop_similar):
        kept = drop(df)
        assert kept.columns == df.columns
        got = sorted((str(r["doc_id"]), r["text"]) for r in kept.collect())
        assert got == sorted([("1", long[0]), ("1", long[1]), ("3", long[2]), ("None", long[2])]), drop


def test_documents(spark):
    text = "The quick  brown\tfox jumps over the lazy dog " * 20
    rows = [(1, text, "s"), (2, text.upper(), "s"), (3, text + "again", "s"), (4, None, "s"), (5, " \n ", "s"), (6, "one two", "s"), (7, "ONE two", "s"), (8, "Ünï çödé wörds hérê", "s"), (9, "x" * 300_000, "s"), (9, "x" * 300_000, "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_components(df).collect()]
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    assert {(i, f) for i, f, _ in got} == {(r[0], f"{p:016x}") for r, p in zip(rows, prints, strict=True)}
    ids = [r[0] for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    group = roots(len(rows), links)
    for i, (doc, *_rest) in enumerate(rows):
        want = min(ids[j] for j in range(len(rows)) if group[j] == group[i] and ids[j] is not None)
        assert want in {c for d, _, c in got if d == doc}
    assert simhash_components(df.limit(0)).count() == 0
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in got} | {None}, key=str)


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i}" for i in range(70_000))
    assert int(simhash._fingerprints([simhash.shingle_hashes(text.encode(), 4)])[0]) == plain_fingerprint(text)


def plain_shingles(text, k=5):
    words = (text or "").split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for g in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200]))]
        for _ in range(6):
            words = list(base)
            for at in rng.sample(range(len(words)), rng.randrange(len(words) // 20)):
                words[at] = f"x{g}{rng.randrange(9999)}"
            texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 4)] + ["one two", "one two", "three", None, " "]
    sets = [plain_shingles(t) for t in texts]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    prints = [plain_fingerprint(t) for t in texts]
    assert any(bin(prints[i] ^ prints[j]).count("1") > 4 for i, j in similar)
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (0, "another text of the same id"), (None, texts[0])], "doc_id long, text string")
    got = sorted((r["doc_id"] for r in drop_similar(df).collect()), key=str)
    assert got == sorted([*set(roots(len(texts), similar)), 0, None], key=str)
    assert drop_similar(df.limit(0)).count() == 0


def test_prefixes_lose_no_similar_pair():
    """Of two similar sets, some shingle is in both prefixes with room for enough common ones after it; brute force over random sets."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(30, 61)], rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(12)]
        sizes, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
        _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(sets)), sizes)
        at, places, lone = simhash.prefixes(flat, n[place].astype(float), of, sizes)
        assert lone.tolist() == [int((n[place][of == i] == 1).sum()) for i in range(len(sets))]
        rows = [(int(flat[i]), int(of[i]), int(p)) for i, p in zip(at, places, strict=True)]
        met = {(a, b) for g, a, p in rows for h, b, q in rows if g == h and a < b and 9 * (1 + min(sizes[a] - p, sizes[b] - q)) >= 4 * (sizes[a] + sizes[b])}
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert 5 * both < 4 * (sizes[a] + sizes[b] - both) or (a, b) in met


@pytest.mark.parametrize("rounds", [0, 4])
def test_large_groups_of_similar_texts(spark, monkeypatch, rounds):
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    rng = random.Random(rounds)
    texts = []
    for g in range(2):
        base = [f"b{g}w{i}" for i in range(120)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(120), rng.randrange(6)):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [plain_shingles(t) for t in texts]
    similar = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_similar(df).collect()) == sorted(set(roots(len(texts), similar)))


def test_e8_decoding():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(300, 8)) * 3
    point = decode_e8(y)
    doubled = np.rint(2 * point).astype(int)
    assert (np.abs(2 * point - doubled) < 1e-12).all()
    assert all(len({v % 2 for v in row}) == 1 and sum(row) % 4 == 0 for row in doubled.tolist())
    near = ((y - point) ** 2).sum(axis=1)
    for step in lattice.SHORTEST / 2:  # no neighbouring point is nearer
        assert (((y - point - step) ** 2).sum(axis=1) >= near - 1e-9).all()
    assert len({tuple(s) for s in lattice.SHORTEST.tolist()}) == 240


def plain_vectors(rows, threshold=0.98):
    ok = [i for i, (v, x, g) in enumerate(rows) if v is not None and g is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    links = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("most", [4096, 8])
def test_vectors_equal_brute_force(spark, most):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=64)
        rows += [(len(rows) + k, (centre + rng.normal(size=64) * 0.08).tolist(), c % 3) for k in range(9)]
    rows += [(len(rows) + k, rng.normal(size=64).tolist(), k % 3) for k in range(60)]
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(3)]
    links = plain_vectors(rows)
    group = roots(len(rows), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_components(df, most=most).collect()}
    found = wanted = 0
    for i, (v, *_rest) in enumerate(rows):
        n = sum(i in link for link in links)
        found, wanted = found + got[v]["n_links"], wanted + n
        assert got[v]["n_links"] <= n
    assert found >= 0.98 * wanted
    assert sum(got[v]["component_id"] == min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i, (v, *_rest) in enumerate(rows)) >= 0.98 * len(rows)


def test_odd_vectors(spark):
    a = [1.0] + [0.0] * 7
    rows = [(1, a, 1), (2, [2.0] + [0.0] * 7, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [float("nan")] + a[1:], 1), (8, [None] + a[1:], 1), (9, [float("inf")] + a[1:], 1), (10, [], 1), (11, [1.0, 0.0], 1), (12, [1e-200] + [0.0] * 7, 1), (13, [1e200] + [0.0] * 7, 1), (None, a, 1), (14, a, 1), (14, a, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(df).collect()), key=str)
    linked = {1, 2, 12, 13, 14}
    for v, n, c, kept in got:
        assert (n, c) == ((5, 1) if v in linked else (0, v)), (v, n, c)
        assert kept == (v == c if v is not None else None)
    assert len(got) == len(rows)
    assert embedding_components(df.limit(0)).count() == 0
    assert embedding_components(df.filter("vec_id = 5")).collect()[0]["n_links"] == 0
