"""Near duplicates, repeated passages and near vectors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pitwise.llm.embeddings import Plan, _directions, linked_pairs, near_vectors
from pitwise.llm.minhash import CHUNKS, MAX_DISTANCE, chunk_positions, drop_near_duplicates, index_keys, minhash_components, shingle_set, signature
from pitwise.llm.substrings import drop_repeated_passages


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)), key=lambda n: (n is None, n))
        up[b] = a
    return {n: root(n) for n in nodes}


def brute_sets(rows, k=5):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        out.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = roots(range(len(rows)), links)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[i]] = min(least.get(root[i], r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], len(sets[i]), least.get(root[i]), r["doc_id"] is not None and least.get(root[i]) == r["doc_id"])
            for i, r in enumerate(rows)]


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


@pytest.mark.parametrize("which", ["docs", "edge_docs", "no_docs"])
def test_minhash_components(which, request):
    df = request.getfixturevalue(which)
    got = minhash_components(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(df.collect()), key=key)


def test_family_of_edited_copies(spark):
    """Copies of copies whose similarities lie around the threshold: many components, found only by all pairs."""
    rng = random.Random(7)
    texts = []
    for family in range(4):
        base = [f"f{family}w{rng.randint(0, 10_000)}" for _ in range(120)]
        texts.append(base)
        for _ in range(30):
            parent = rng.choice(texts[-8:]) if rng.random() < 0.5 else base
            copy = list(parent)
            for _ in range(rng.randint(1, 5)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
            texts.append(copy)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = minhash_components(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    expected = brute_components(df.collect())
    assert len({e[2] for e in expected}) > 8
    wrong = set(map(tuple, got)) ^ set(expected)
    assert not wrong


def test_similar_pairs_beyond_the_guaranteed_distance(spark):
    rows, seed = [], 0
    while len(rows) < 6:  # 28 shingles each, 24 of them shared: exactly 0.75
        words = [f"v{seed}u{i}" for i in range(36)]
        a, b = " ".join(words[:32]), " ".join(words[4:])
        x, y = (signature(shingle_set(t.encode())) for t in (a, b))
        if (x != y).sum() > MAX_DISTANCE:
            rows += [(len(rows), a), (len(rows) + 1, b)]
        seed += 1
    got = minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(6)}


def test_one_row_of_each_component_stays(edge_docs, no_docs):
    kept = drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == Counter([1, 2, 3, 4, 6, 7, 7, 11, None])  # the rest are copies or near copies of 1 and 6
    assert drop_near_duplicates(no_docs).count() == 0


def test_index_keys_guarantee_the_distance():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (300, 64)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(64, MAX_DISTANCE, replace=False)] += 1
    assert (index_keys(a) == index_keys(b)).any(axis=1).all()
    assert MAX_DISTANCE // CHUNKS == 1 and sum(map(len, chunk_positions())) == 64


def brute_passages(rows, window=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, rows[i]["text"] or ""))
    seen, out = set(), []
    for i in order:
        words = (rows[i]["text"] or "").encode().split()
        gone = bytearray(len(words))
        for p in range(len(words) - window + 1):
            w = tuple(words[p:p + window])
            if w in seen:
                gone[p:p + window] = b"\1" * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((rows[i]["doc_id"], len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["docs", "edge_docs", "no_docs"])
def test_repeated_passages(which, request):
    df = request.getfixturevalue(which)
    got = drop_repeated_passages(df).drop("kept_text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_passages(df.collect()), key=key)


def test_passage_window_must_double():
    with pytest.raises(ValueError):
        drop_repeated_passages(None, window=21)


def planted_vectors(n=400, dim=32, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    near = base[:120] + 0.04 * rng.standard_normal((120, dim)) * np.linalg.norm(base[:120], axis=1, keepdims=True) / np.sqrt(dim) * 5
    return np.vstack([base, near, base[:5]])


def test_near_vectors_recall_and_exactness(spark):
    x = planted_vectors()
    df = spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)], "vec_id long, embedding array<double>, cell string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    mine = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (mine <= near.sum(1)).all() and near.sum() > 100
    assert mine.sum() >= 0.9 * near.sum()
    root = roots(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    same = sum(got[i]["component_id"] == root[i] for i in got)
    assert same >= 0.95 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_pairs_far_apart_on_one_projection():
    plan, rng, found = Plan(100), np.random.default_rng(3), 0
    first = _directions(32, plan.tables, plan.intervals)[2][:, 0]
    for _ in range(50):
        v = rng.standard_normal(32)
        v -= first * (v @ first) / (first @ first)
        v /= np.linalg.norm(v)
        unit = np.stack([v, 0.96 * v + 0.28 * first / np.linalg.norm(first)])
        points = plan.counting(unit)
        assert abs(points[0, 0] - points[1, 0]) > 1.5 * plan.window
        if (np.abs(points[0] - points[1]) <= plan.window).sum() >= plan.least_count:
            found += 1
            a, _ = linked_pairs(unit, np.zeros(2, int), 0, plan, np.zeros((2, plan.tables), np.uint64))
            assert len(a) == 1
    assert found >= 40


def test_near_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (10, [1e300, 2e300]), (11, [-1.0, -2.0])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["n_links"] for i in (1, 2, 10)] == [4, 4, 4] and by[None]["component_id"] == 1 and not by[None]["kept"]
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i for i in (3, 4, 5, 6, 7, 8, 9, 11))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_plan_follows_the_table():
    small, large = Plan(1_000), Plan(1_000_000)
    assert large.intervals > small.intervals and large.tables > small.tables and 8 <= small.least_count <= 16
