from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftql.llm import bag_minhash, multi_index
from siftql.llm._shared import read_table
from siftql.llm.components import components, forest


def classes(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def bag(text):
    w = (text or "").encode().split()
    return Counter([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute_near(rows):
    bags = [(i, b) for i, t in rows if (b := bag(t))]
    links = []
    for k, (i, x) in enumerate(bags):
        for j, y in bags[:k]:
            lo, hi = sorted((sum(x.values()), sum(y.values())))
            if lo >= 0.8 * hi and (both := sum((x & y).values())) and both / (lo + hi - both) >= 0.8:
                links.append((i, j))
    return classes([i for i, _ in rows], links)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [*zip(range(100, 400), range(101, 401)), *[(1, k) for k in range(500, 900)], *rng.integers(1000, 1400, (300, 2)).tolist(), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == classes(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert classes({1, 2, 3, 4}, forest([(1, 2), (2, 1), (3, 4), (4, 3)])) == {1: 1, 2: 1, 3: 3, 4: 3}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        base = rng.integers(0, 2**63, 300).astype(np.uint64)
        w = rng.integers(1, 12, 300)
        a = np.sort(np.repeat(base, w))
        w2 = np.where(rng.random(300) < share, w, np.maximum(1, w // 3))
        b = np.sort(np.repeat(base, w2))
        true = bag_minhash.overlap(a, b)
        assert true == pytest.approx(np.minimum(w, w2).sum() / np.maximum(w, w2).sum())
        m = 4096
        assert abs((bag_minhash.signature(a, m) == bag_minhash.signature(b, m)).mean() - true) < 0.04


def test_near_duplicates_match_brute_force(spark, odd, nothing, sf):
    docs = read_table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # Chains, and variants of one text that differ in a word each.
    base = [f"t{i}" for i in range(120)]
    more = [(10_000 + k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]])) for k in range(0, 120, 3)] + [(20_000 + k, " ".join(f"c{i}" for i in range(k * 8, k * 8 + 100))) for k in range(12)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = bag_minhash.near_duplicates(both).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_near(rows + more) and len(got) == len(rows) + len(more)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert len(bag_minhash.keep_one(docs).columns) == len(docs.columns)
    got = Counter((r.doc_id, r.class_id) for r in bag_minhash.near_duplicates(odd).collect())
    assert got[5, 5] == 2 and got[6, 5] == got[7, 5] == 1 and got[None, None] == 1 and sum(got.values()) == 13
    assert bag_minhash.near_duplicates(nothing).count() == 0 and bag_minhash.keep_one(nothing).count() == 0


def test_large_buckets_lose_no_link(spark):
    """Families that share a long passage: buckets of many documents in several components, and repeated identifiers."""
    common = [f"c{i}" for i in range(60)]
    rows = []
    for family in range(6):
        base = common + [f"f{family}w{i}" for i in range(50)]
        for k in range(15):
            words = list(base)
            for j in range(k % 5):
                words[60 + (7 * k + 11 * j) % 50] = f"new{family}-{k}-{j}"
            rows.append((1_000 * family + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bag_minhash.near_duplicates(docs).collect()} == brute_near(rows)
    again = bag_minhash.near_duplicates(docs.union(spark.createDataFrame([(0, "one two three four five six seven"), (0, rows[0][1])], docs.schema)).repartition(5)).collect()
    assert len(again) == len(rows) + 2 and {r.doc_id: r.class_id for r in again}.keys() == {i for i, _ in rows}


def brute_vectors(rows):
    ok = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(np.array(r[1], float))]
    links = defaultdict(set)
    for k, (i, x, a) in enumerate(ok):
        for j, y, b in ok[:k]:
            if a == b and len(x) == len(y):
                x_, y_ = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= 0.98:
                    links[i].add(j)
                    links[j].add(i)
    top = classes([r[0] for r in rows], [(i, j) for i in links for j in links[i]])
    return {r[0]: (len(links[r[0]]), top[r[0]]) for r in rows}


def test_vectors_match_brute_force(spark, sf):
    own = read_table(spark, sf, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in own.collect()]
    rng = np.random.default_rng(2)
    dim = len(rows[0][1])
    centre = rng.standard_normal(dim)
    odd = [(9000 + k, (centre + 0.08 * rng.standard_normal(dim)).tolist(), 1) for k in range(120)] + [(9500 + k, centre.tolist(), k % 2) for k in range(40)]
    odd += [(9901, None, 1), (9902, [0.0] * dim, 1), (9903, [float("nan")] + [1.0] * (dim - 1), 1), (9904, [None] + [1.0] * (dim - 1), 1), (9905, centre.tolist(), None), (9906, [], 1), (9907, [1.0, 2.0], 1), (9908, [2.0, 4.0], 1), (9909, [float("inf")] * dim, 1)]
    all_ = own.select("vec_id", "embedding", "label").union(spark.createDataFrame(odd, "vec_id long, embedding array<float>, label int")).withColumns({c: F.lit("clash") for c in ("id", "v", "n", "cell", "length")})
    got = multi_index.near_vectors(all_).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows + odd) and len(got) == len(rows) + len(odd)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert multi_index.near_vectors(own.limit(0)).count() == 0
    exact = multi_index.near_vectors(all_, target_recall=1.0).collect()
    assert sorted(exact, key=str) == sorted(got, key=str)


def test_multi_sequence_is_in_order_and_complete():
    rng = np.random.default_rng(3)
    a, b = rng.random(9), rng.random(7)
    got = list(multi_index.multi_sequence(a, b, 1.0))
    assert {*got} == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 1.0} and len(got) == len({*got})
    d = [a[i] + b[j] for i, j in got]
    assert d == sorted(d)
