"""Mixing, decontamination and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pitwise.llm import decontamination, mixing
from pitwise.llm.common import staged


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = rest / sum(weight[s] for s in free) if free else 0
        target = {s: 3 * sizes[s] if s in capped else share * weight[s] for s in order}
        more = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        capped |= more


@pytest.mark.parametrize("which", ["docs", "edge_docs", "no_docs"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = df.collect()
    got = mixing.mix_sources(df, block=40).collect()
    again = mixing.mix_sources(df, block=40).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode().split())
    target = brute_targets(size)
    assert sorted(round(t, 3) for t in {(r["source_size"], r["target"]) for r in got} for t in t) == sorted(
        round(t, 3) for t in {(size[s], target[s]) for s in size} for t in t)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    if which == "docs":
        source, taken = {r["doc_id"]: r["source"] for r in rows}, Counter()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
        assert sum(abs(taken[s] - target[s]) for s in target) <= 0.1 * sum(target.values())


def test_targets_above_the_cap(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 2000), ("d", 0), (None, 500)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    expected = brute_targets({"a": 10, "b": 1000, "c": 2000, "d": 0, None: 500})
    assert got == pytest.approx(expected) and got["a"] == 30 and sum(got.values()) == pytest.approx(3510)


def test_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [float(rng.randint(1, 500)) for _ in range(300)]
    pi = mixing.flight([0.3] * 300, sizes, rng)
    assert sum(0 < p < 1 for p in pi) <= 2
    assert sum(pi) == pytest.approx(90) and sum(p * s for p, s in zip(pi, sizes)) == pytest.approx(0.3 * sum(sizes))
    landed = mixing.landing(pi, sizes)
    assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - 90) <= 1.5


def brute_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1)), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontamination.MATCH if a[i - 1] == b[j - 1] else decontamination.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 25)), rng.integers(0, 6, rng.integers(1, 40))
        assert decontamination.align(a, b)[0] == brute_alignment(a, b)


def test_leaks_exact_and_edited(spark, docs, small_dir, edge_docs, no_docs):
    benchmark = spark.read.parquet(f"{small_dir}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    rng = random.Random(4)
    planted = []
    for n, (i, text) in enumerate(sorted(items.items())[:20]):
        words = text.split()
        for at in rng.sample(range(len(words)), len(words) // 8):
            words[at] = f"changed{at}"
        planted.append((100_000 + n, f"before {' '.join(words[:len(words) // 2])} inserted {' '.join(words[len(words) // 2:])} after", i))
    extra = spark.createDataFrame([(a, b) for a, b, _ in planted] + [(None, items[0]), (None, None), (5, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.find_leaks(docs.select("doc_id", "text").unionByName(extra), benchmark).collect()}
    assert sum((a, i) in got for a, _, i in planted) >= 19 and got[None, 0] == 1.0
    expected = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items()
                if f" {' '.join(decontamination.words_of(t))} " in f" {' '.join(decontamination.words_of(r['text'] or ''))} "}
    assert expected <= set(got)
    assert all(a in {x[0] for x in expected} | {x[0] for x in planted} | {None} for a, _ in got)
    assert decontamination.find_leaks(edge_docs, benchmark).count() == 0
    assert decontamination.find_leaks(no_docs, benchmark).count() == 0 == decontamination.find_leaks(docs, benchmark.limit(0)).count()
    assert decontamination.drop_leaks(edge_docs, benchmark).columns == edge_docs.columns


def test_edited_copies_of_items_that_also_stand_verbatim(spark):
    rng = random.Random(8)
    items = {i: [f"w{i}x{k}" for k in range(rng.randint(15, 59))] for i in range(40)}
    texts = [(100 * i + n, " ".join(w)) for i, w in items.items() for n in range(3)]
    expected = {(a, a // 100) for a, _ in texts}
    for i, w in items.items():
        for n, share in enumerate((0.2, 0.25, 0.3)):
            at = set(rng.sample(range(len(w)), round(share * len(w))))
            copy = [f"changed{k}" if k in at else x for k, x in enumerate(w)]
            runs = [at.isdisjoint(range(k, k + decontamination.SEED)) for k in range(len(w) - decontamination.SEED + 1)]
            score = brute_alignment(w, copy) / (decontamination.MATCH * len(w))
            if any(runs) and score >= decontamination.THRESHOLD:
                expected.add((100 * i + 50 + n, i))
            texts.append((100 * i + 50 + n, " ".join(copy)))
    assert len(expected) > 200
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()
    assert len(got) == len(expected) and {(r["doc_id"], r["item_id"]) for r in got} == expected


def _staged_sides(spark, texts, items, monkeypatch, threshold=decontamination.THRESHOLD):
    """What find_leaks returns, and how many pairs it aligned."""
    pairs = []
    inner = decontamination.candidates

    def counted(*args):
        out = staged(inner(*args))
        pairs.append(out.count())
        return out

    monkeypatch.setattr(decontamination, "candidates", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return decontamination.find_leaks(docs, benchmark, threshold).collect(), pairs[0]


def test_a_common_opening_does_not_pair_all_texts_with_all_items(spark, monkeypatch):
    opening = "which of the following statements about the subject is true"
    rng = random.Random(5)
    items = [(i, f"{opening} " + " ".join(f"v{rng.randint(0, 20_000)}" for _ in range(rng.randint(14, 30)))) for i in range(2_000)]
    texts = [(n, f"text {n} asks {opening} " + " ".join(f"u{rng.randint(0, 20_000)}" for _ in range(30))) for n in range(4_000)]
    texts += [(10_000 + i, f"copy of {t}") for i, t in items[:50]]
    got, pairs = _staged_sides(spark, texts, items, monkeypatch)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10_000 + i, i) for i in range(50)}
    assert pairs < 5_000  # 8 million pairs share the opening


def test_common_seeds_lose_no_pair_that_shares_a_seed(spark, monkeypatch):
    """Items of several templates over a small vocabulary, texts that edit them: equal to aligning every pair that shares a seed."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    templates = [rng.choices(vocabulary, weights, k=9) for _ in range(3)]
    items = [(i, " ".join(templates[i % 3] + rng.choices(vocabulary, weights, k=rng.randint(3, 25)))) for i in range(90)]
    items += [(100 + i, " ".join(templates[0][:2])) for i in range(12)]  # shorter than a seed, and held by many
    texts = []
    for n in range(300):
        words = rng.choice(items)[1].split()
        share = rng.choice((0, 0.1, 0.2, 0.3, 0.4))
        words = [rng.choice(vocabulary) if rng.random() < share else w for w in words]
        texts.append((n, " ".join(rng.choices(vocabulary, weights, k=20) + words + rng.choices(vocabulary, weights, k=200))))
    for threshold in (0.5, 0.8):
        got, pairs = _staged_sides(spark, texts, items, monkeypatch, threshold)
        monkeypatch.undo()
        sides = [{i: decontamination.hashes_of(decontamination.words_of(t)) for i, t in x} for x in (texts, items)]
        expected, sharing = {}, 0
        for i, item in sides[1].items():
            k = min(decontamination.SEED, len(item))
            seeds = decontamination.gram_hashes(item, k)
            for d, text in sides[0].items():
                hits = np.concatenate([np.flatnonzero(np.isin(decontamination.gram_hashes(text, n), seeds)) for n in (2, 4)])
                sharing += len(hits) > 0
                score = decontamination.best_alignment(item, text, hits, threshold)[0] / (2 * len(item)) if len(hits) else 0
                if score >= threshold:
                    expected[d, i] = score
        assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == expected and len(expected) > 200
        assert pairs <= sharing


def test_recall_against_full_alignment(spark):
    """Copies with a quarter or 30 % of the words replaced, whether or not a seed survives: at least 0.97 of those that score are found."""
    rng = random.Random(9)
    items = {i: [f"w{rng.randint(0, 5_000)}" for _ in range(rng.randint(15, 59))] for i in range(400)}
    texts, expected = [], set()
    for i, w in items.items():
        for n, share in enumerate((0.25, 0.3)):
            at = set(rng.sample(range(len(w)), round(share * len(w))))
            copy = [f"changed{k}" if k in at else x for k, x in enumerate(w)]
            if brute_alignment(w, copy) / (decontamination.MATCH * len(w)) >= decontamination.THRESHOLD:
                expected.add((10 * i + n, i))
            texts.append((10 * i + n, " ".join(["before"] * 20 + copy)))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), benchmark).collect()}
    recall = len(got & expected) / len(expected)
    print(f"recall against full alignment: {recall:.4f} of {len(expected)}")
    assert got <= expected and recall >= 0.97


def test_items_with_repeated_and_null_ids(spark):
    passage = {k: " ".join(f"{k}{i}" for i in range(24)) for k in "abcdefg"}
    rows = [(1, passage[k]) for k in "abcd"] + [(2, passage["e"])] * 6 + [(None, passage["f"]), (None, passage["g"]), (None, None)]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    half = " ".join(w if i % 8 < 5 else f"changed{i}" for i, w in enumerate(passage["e"].split()))
    texts = [(n, passage["a"] + f" more{n}") for n in range(9)] + [(20 + i, f"before {passage[k]}") for i, k in enumerate("bcdefg")]
    texts += [(40, "start " + half), (41, passage["b"]), (41, passage["b"]), (None, passage["g"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, benchmark).collect())
    assert got == Counter([(n, 1) for n in range(9)] + [(20, 1), (21, 1), (22, 1), (23, 2), (24, None), (25, None), (40, 2),
                                                        (41, 1), (41, 1), (None, None)])
    assert decontamination.drop_leaks(docs, benchmark).count() == 0


def test_pipeline_stages(spark, docs, small_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    now, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        new = staged(stage(spark, now, small_dir))
        assert new.columns[: len(docs.columns)] == docs.columns
        if name != "mixing":
            assert new.columns == docs.columns and new.schema == docs.schema
        now = new
        seen.append(now.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] and 0 < seen[5]
    whole = corpus_pipeline.run(spark, small_dir)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, now.collect()))


def test_pipeline_stages_on_edges(spark, edge_docs, no_docs, small_dir):
    plain = edge_docs.drop("size", "rk")
    for df in (plain, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, small_dir)
            assert out.count() <= df.count()
