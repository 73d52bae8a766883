"""Centroid clustering and ranked lexical search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetledger.llm import centroids, lexical
from fleetledger.llm.common import Workspace
from tests.llm.util import AWKWARD, documents

# centroids

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, "a", "b", "c") for i, x in rows], VECTORS)


def plain_clusters(rows, k, rounds, dims, scale=1024):
    kept = [
        (i, tuple(math.floor(float(np.float32(c)) * scale) for c in x))
        for i, x in rows
        if x is not None and len(x) == dims and all(c is not None and math.isfinite(c) for c in x)
    ]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    now = [list(v) for _, _, v in sorted((digest(i), v, v) for i, v in kept)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for n in range(len(now)):
            mine = [v for (_, v), w in zip(kept, where, strict=True) if w == n]
            if mine:
                now[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    total = Counter()
    for _, n, d in found:
        total[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, n, d, total[n], sum(total.values()), sha[n]) for i, n, d in found), key=str)


def check_clusters(spark, rows, k=8, rounds=10, dims=64):
    found, _ = centroids.cluster(vectors(spark, rows), Workspace(spark), k, rounds, dims)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_clusters(rows, k, rounds, dims)


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(1)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    check_clusters(spark, [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(middles)]) for i in range(300)])


def test_ties_and_repeated_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(120)]
    check_clusters(spark, rows + rows[:40] + [(500 + i, [1.0, 1.0, 1.0]) for i in range(200)], k=5, dims=3)


def test_awkward_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]),
        (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [0.0, 2.0]), (None, [-3.5, 2.0]), (9, [-0.0001, 0.0]), (10, [1.0, 2.0, 3.0]),
    ]
    check_clusters(spark, rows, dims=2)
    check_clusters(spark, rows[6:8], dims=2)
    assert centroids.cluster(vectors(spark, rows[:6]), Workspace(spark), dims=2)[0].count() == 0
    assert centroids.cluster(vectors(spark, []), Workspace(spark))[0].count() == 0


def test_components_whose_distances_do_not_fit_stop_the_job(spark):
    with pytest.raises(Exception, match="exceeds"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0])]), Workspace(spark), dims=2)


def test_threshold_walk_stops_early_and_exactly():
    rng = np.random.default_rng(3)
    c = rng.integers(-4000, 4000, (200, 2))
    x = rng.integers(-5000, 5000, (500, 2))
    who, best, computed = centroids.Lists.build(c).nearest(x)
    exact = np.square(x[:, None] - c[None]).sum(2)
    assert (who == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert computed < len(x) * len(c) / 2


def test_extreme_components_keep_their_order():
    bound = centroids.component_bound(64)
    c = np.array([[-bound] * 64, [bound] * 64, [0] * 64])
    x = np.array([[bound] * 64, [-bound] * 64, [1] * 64])
    who, best, _ = centroids.Lists.build(c).nearest(x)
    assert who.tolist() == [1, 0, 2] and best.tolist() == [0, 0, 64]


# lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=10):
    found = [(i, Counter(plain_terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in found]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, tf), n in zip(found, lengths, strict=True):
            score = 0
            for t in plain_terms(text):
                if tf[t]:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, unnamed, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if unnamed else doc, -score))
    return sorted(out, key=str)


ITEMS = "item_id long, text string, rank string, query string, score string"


def check_search(spark, docs, items, k=10):
    asked = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in items], ITEMS)
    found = lexical.search(documents(spark, [(i, t, None) for i, t in docs]), asked, Workspace(spark), k)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_search(docs, items, k)


def random_docs(seed, n=400):
    rng = random.Random(seed)
    common = ["the", "of", "und", "é", "漢字", "42"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.7)) % 90}"
    text = lambda n: "".join(word() + rng.choice([" ", "\n", "-", "_", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 60, 300]))) for i in range(n)]
    docs += [(n + i, docs[i][1].upper()) for i in range(0, n, 9)] + docs[:5]
    items = [(i, text(rng.choice([1, 2, 8, 30]))) for i in range(25)]
    return docs, items


def test_search_equals_plain_scores(spark):
    docs, items = random_docs(4)
    check_search(spark, docs, items)
    check_search(spark, docs, items, k=3)


def test_long_queries_have_masks_of_several_words(spark):
    docs, _ = random_docs(5)
    check_search(spark, docs, [(1, " ".join(f"w{i}" for i in range(90))), (2, " ".join(f"w{i} the" for i in range(70)))])


def test_awkward_documents_and_queries(spark):
    docs = [(i, t) for i, t, _ in AWKWARD]
    items = [(1, None), (2, ""), (3, " -- \x00"), (4, "SAME row"), (4, "SAME row"), (None, "words"), (6, "nowhere"), (7, "x " * 5000)]
    check_search(spark, docs, items)
    check_search(spark, [], items)
    check_search(spark, docs, [])


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    docs, items = random_docs(6)
    assert len(list(lexical.blocks(items))) > 2
    check_search(spark, docs, items)


def test_groups_beyond_the_bound_are_not_evaluated():
    import pyarrow as pa

    rng = random.Random(7)
    rows = [sorted({*rng.sample(range(6), rng.randint(1, 3)), *([6, 7] if i < 30 else [])}) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(range(3000)), pa.array([20] * 3000), pa.array(rows, pa.list_(pa.int32())),
            pa.array([[1] * len(r) for r in rows], pa.list_(pa.int64())),
        ],
        names=["doc_id", "n", "terms", "times"],
    )
    best = lexical.Best(10)
    query = lexical.Query(np.arange(8), np.array([5, 5, 5, 5, 5, 5, 4000, 4000]))
    assert lexical.Slice(batch, 3000, 60000).rank(query, best) < 300
    assert len(best.score) == 10


def test_terms_of_equal_hash_are_told_apart():
    words = lexical.words_of(lexical.pa.array(["ab cd ab"]), between=lexical.MARKS)
    vocabulary = lexical.Vocabulary.build(["cd", "xy"])
    vocabulary.hashes = np.sort(np.unique(words.hashes()))
    vocabulary.number = np.array([0, 0])
    at, number = vocabulary.find(words)
    assert at.tolist() == [1] and number.tolist() == [0]


def test_length_factor_beyond_64_bits():
    n = np.array([10**12, 3])
    assert lexical.length_factor(n, 10**9, 10**14).tolist() == [25 + 75 * 10**21 // 10**14, 25 + 225 * 10**9 // 10**14]
