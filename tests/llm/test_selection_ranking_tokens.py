"""op11 to op13 against plain Python over the same rows, with the odd rows of conftest among them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from pitwise.llm import importance, ranking, tokens

ITEMS = [(1, "passage1 Passage2 passage3 x password"), (1, "word1 filler2"), (2, "Single other TEXT id"), (3, None), (4, ""),
         (None, "tail tail filler3"), (2, "Single other TEXT id"), (5, "nowhere to be found"), (6, "ümlaut 𝒳")]


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# ---- op11

def runs(text):
    w = plain(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target):
    have, want = (Counter(f for t in ts for f in runs(t)) for ts in ([t for _, t in docs], target))
    s, t = have.total(), want.total()
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((have[b] + 1) * (t + 10000)))) for b in range(10000)}
    rows = []
    for i, text in docs:
        f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain(text)) >= 20])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], n) for n, r in enumerate(order[:5 * len(order) // 100], 1)]
    return rows, drawn


def test_resample_matches_brute_force(spark, edge_docs, docs, items):
    both = docs.select("doc_id", "text").unionByName(edge_docs.selectExpr("doc_id + 1000000 as doc_id", "text"))
    want, drawn = resampled([tuple(r) for r in both.collect()], [t for _, t in ITEMS])
    got = importance.resample(both, items).collect()
    assert len(drawn) > 5
    assert sorted((tuple(r) for r in got if r["rank"]), key=lambda r: r[4]) == drawn
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(repr(tuple(r[:4])) for r in want)


@pytest.mark.parametrize("k", [1, 2, 777, 2500, 4999, 5000])
def test_cutoff_with_ties_and_repeats(spark, k):
    rng = np.random.default_rng(k)
    rows = sorted((int(a), int(b)) for a, b in zip(rng.integers(-9, 3, 3000), rng.integers(0, 40, 3000))) + [(1, 7)] * 2000
    rng.shuffle(rows)
    keys = spark.createDataFrame([(int(a), int(b)) for a, b in rows], "down long, id long").repartition(7)
    assert importance.cutoff(keys, k) == tuple(sorted(map(tuple, np.array(rows).tolist()))[k - 1])


def test_resample_of_equal_rows_and_nothing(spark, edge_docs, no_docs, items):
    text = " ".join(f"w{i}" for i in range(30))
    same = spark.createDataFrame([(5, text, "a", "b")] * 100, "doc_id long, text string, score string, rank string")
    got = importance.resample(same, items).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and len({r["score"] for r in got}) == 1
    assert importance.resample(no_docs, items).count() == 0
    few = importance.resample(edge_docs, items.limit(0)).collect()
    assert len(few) == edge_docs.count() and all(r["rank"] is None for r in few)  # 8 texts of 20 words: none is drawn
    assert {r["weight"] for r in few if r["n_features"] == 0} == {0}


# ---- op12

def ranked(docs, items, k=10):
    bags = [(i, Counter(plain(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for i, b in bags:
            m = 10 + 90 * b.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                        for t in set(plain(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, out))


def test_ranking_matches_brute_force(spark, edge_docs, docs, items, small_dir):
    both = docs.select("doc_id", "text").unionByName(edge_docs.select("doc_id", "text"))
    bench = items.unionByName(spark.read.parquet(f"{small_dir}/benchmark.parquet").selectExpr("item_id + 100 as item_id", "text"))
    got = ranking.rank_documents(both, bench)
    assert sorted(repr(tuple(r)) for r in got.collect()) == ranked([tuple(r) for r in both.collect()], [tuple(r) for r in bench.collect()])
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_ranking_in_blocks_of_items(spark, docs, items, small_dir, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_TERMS", 20)
    got = ranking.rank_documents(docs, items, k=3)
    assert sorted(repr(tuple(r)) for r in got.collect()) == ranked([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, 3)


def test_ranking_ties_hot_ids_and_nothing(spark, edge_docs, no_docs, items):
    same = spark.createDataFrame([(i % 50, "tail filler3 and more", "a") for i in range(3000)] + [(99, f"else {i}", "b") for i in range(3000)] + [(98, "tail", "c")],
                                 "doc_id long, text string, score string")
    got = ranking.rank_documents(same, items.where("item_id is null")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and {r["doc_id"] for r in got} == {0}
    assert sorted(repr(tuple(r)) for r in got) == ranked([(r["doc_id"], r["text"]) for r in same.collect()], [ITEMS[5]])
    assert ranking.rank_documents(no_docs, items).count() == 0
    assert ranking.rank_documents(edge_docs, items.limit(0)).count() == 0


def test_buckets_are_pruned(spark):
    """A short document can't reach the threshold of an item by Cauchy-Schwarz; one without its heavy term neither."""
    import pyarrow as pa
    rows = [(1, 10.0, [1, 2], [4, 5]), (2, 4.0, [2], [2]), (3, 0.5, [1], [1])]
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                                    pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["id", "length", "terms", "impacts"])
    block = ranking.make_block([{"at": 0, "terms": [1, 2], "weights": [3, 1]}], {})
    bucket = ranking.Bucket(b, block.vocabulary)
    assert [x.tolist() for x in ranking.search_bucket(bucket, block.items[0], 1)] == [[0, 1, 2], [17, 2, 3]]
    assert [x.tolist() for x in ranking.search_bucket(bucket, block.items[0], 12)] == [[0], [17]]
    assert ranking.search_bucket(bucket, block.items[0], 21)[0].size == 0


# ---- op13

ALPHABET = "abc theing  \n\t▁é漢字😀<s></s>0123½ \u0000‍안녕مر{}();"


@pytest.fixture(scope="session")
def odd_texts(docs):
    random.seed(3)
    texts = ["", "a", " ", "  ", "▁", "<s>", "<0x0A>", "\n", "x" * 5000, "ab " * 3000, "漢" * 300]
    return texts + ["".join(random.choices(ALPHABET, k=random.randint(1, 80))) for _ in range(3000)] + [r["text"] or "" for r in docs.select("text").collect()]


def test_model_counts_match_the_library(odd_texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    count, library = tokens.Counter(tokens.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    assert [count.tokens(t) for t in odd_texts] == [len(x) for x in library.encode(odd_texts, num_threads=1)]


def test_rank_file_counts_match_the_library(odd_texts):
    vocabulary = tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    count = tokens.Counter(vocabulary)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=count.rank, special_tokens={})
    assert [count.tokens(t) for t in odd_texts] == [len(library.encode_ordinary(t)) for t in odd_texts]


def test_memo_turns_over(odd_texts, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_UNITS", 7)
    path = public_tokenizers.path("piece_bpe_32k.model")
    small, library = tokens.Counter(tokens.load_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    assert [small.tokens(t) for t in odd_texts[:500]] == [len(library.encode(t)) for t in odd_texts[:500]]
    assert len(small) <= 7 and len(small.older) <= 7


def test_units_are_whole_where_pieces_reach_across_spaces():
    assert re.findall(tokens.unit_pattern(["ab", "▁a", "b▁"]), "▁ab▁a\nb") == ["▁ab▁a\nb"]
    assert re.findall(tokens.unit_pattern(["ab", "▁a", ".,"]), "▁▁ab.,,c▁") == ["▁▁ab", ".,,", "c", "▁"]


def test_count_tokens_of_odd_rows(spark, edge_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, library = tokens.load_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    clash = edge_docs.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "n_bytes")
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in clash.collect()]
    got = [tuple(r) for r in tokens.count_tokens(clash, vocabulary).collect()]
    assert sorted(map(repr, got)) == sorted(repr((*w, w[2] > 4096)) for w in want) and any(r[3] for r in got)
    assert tokens.count_tokens(no_docs, vocabulary).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        tokens.load_model(str(tmp_path / "m.model"))
