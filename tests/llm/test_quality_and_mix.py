import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftql.llm import mixing, quality_classifier, quality_rules, queries
from siftql.llm._shared import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rules_match_brute_force(spark, odd, sf):
    for docs in (odd.select("doc_id", "text", "n_words"), read_table(spark, sf, "documents").select("doc_id", "text", "lang")):
        got = quality_rules.ledger(docs).collect()
        want = Counter((r.doc_id, *brute_rules(r.text)) for r in docs.collect())
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_rules_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.OP4_SQL).df().sort_values("doc_id")
    got = queries.op4_quality_rules(spark, sf).toPandas()[list(want.columns)].sort_values("doc_id")
    assert (got.to_numpy() == want.to_numpy()).all()


def test_rules_keep_columns_and_policies_agree(spark, odd, nothing, sf):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {5, 6, 7}
    assert quality_rules.keep_good(nothing).count() == 0 and quality_rules.ledger(nothing).count() == 0
    book = quality_rules.apply_policies(quality_rules.ledger(read_table(spark, sf, "documents"))).cache()
    assert book.where("kept_base").count() >= book.where("kept_v1").count() >= book.where("kept_v2").count() > 0
    rows = [r.failures for r in book.collect()]
    for r in quality_rules.ablations(book).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.fail, r.only_this_rule, r.kept_without) == (sum(bool(f & bit) for f in rows), sum(f == bit for f in rows), sum(f & ~bit == 0 for f in rows))
    with pytest.raises(ValueError):
        quality_rules.ledger(odd, carry=["doc_id", "n_words"])


def test_apportion_is_sainte_lague():
    rng = random.Random(4)
    for _ in range(60):
        k = rng.randint(1, 7)
        claims, seats, most = [float(rng.randint(0, 50)) for _ in range(k)], rng.randint(0, 60), [rng.randint(0, 40) for _ in range(k)]
        got = [0] * k
        for _ in range(seats):
            open_ = [(-claims[i] / (2 * got[i] + 1), i) for i in range(k) if claims[i] > 0 and got[i] < most[i]]
            if not open_ or not sum(claims):
                break
            got[min(open_)[1]] += 1
        assert mixing.apportion(claims, seats, most) == got


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 10, 10], [1, 2, 3]) == [60.0, 30.0, 30.0]
    assert mixing.targets([], []) == []


def brute_mix(docs):
    """Every block of every shard as a list of its words' documents, taken whole for each of its seats."""
    h = F.xxhash64("doc_id", "text", F.lit(17))
    rows = docs.select("doc_id", "text", "source", h.alias("h"), F.xxhash64(h).alias("hh")).collect()
    rows = [(r.h, -1 if r.doc_id is None else r.doc_id, len(WORD.findall(r.text or "")), k, r) for k, r in enumerate(rows)]
    names = sorted({r[4].source for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(r[2] for r in rows if r[4].source == s) for s in names]
    aim = mixing.targets(size, [(1, 2, 3)[k % 3] for k in range(len(names))])
    shard_words = max(mixing.SHARD_WORDS, -(-sum(size) // mixing.MAX_SHARDS))
    shards = {}
    for r in sorted(rows, key=lambda r: r[:4]):
        k = names.index(r[4].source)
        shards.setdefault((k, r[4].hh % max(1, size[k] // shard_words)), []).extend([r[3]] * r[2])
    own = {k: [shards[k][at : at + mixing.BLOCK_WORDS] for at in range(0, len(shards[k]), mixing.BLOCK_WORDS)] for k in sorted(shards)}
    dealt = mixing.apportion(aim, round(sum(size) / mixing.BLOCK_WORDS), [3 * sum(len(b) for k, b in own.items() if k[0] == i) for i in range(len(names))])
    draw, taken = random.Random(17), Counter()
    for i in range(len(names)):
        keys = [k for k in own if k[0] == i]
        for k, seats in zip(keys, mixing.apportion([float(len(shards[k])) for k in keys], dealt[i], [3 * len(own[k]) for k in keys])):
            n = max(1, len(own[k]))
            start = draw.randrange(n)
            for b, block in enumerate(own[k]):
                # Even spacing: block b is chosen if a multiple of n lies in its step of the running sum.
                times = seats // n + ((b + 1) * (seats % n) + start) // n - (b * (seats % n) + start) // n
                for doc in block:
                    taken[doc] += times
    return Counter((r[4].doc_id, r[2], taken[r[3]]) for r in rows)


def test_mix_meets_targets_and_reruns_agree(spark, odd, nothing, sf):
    for docs in (read_table(spark, sf, "documents"), odd):
        rows = docs.collect()
        a = sorted(mixing.mix(docs).collect(), key=str)
        assert a == sorted(mixing.mix(docs.repartition(5)).collect(), key=str) and len(a) == len(rows)
        assert Counter((r.doc_id, r.size) for r in a) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
        assert all(0 <= r.taken <= 3 * r.size for r in a)
        by = {}
        for r in mixing.mix(docs, carry=["source"]).collect():
            by.setdefault((r.carried.source, r.target), []).append(r.taken)
        for (_, target), taken in by.items():
            assert abs(sum(taken) - target) <= max(64, 0.02 * target)
        assert Counter((r.doc_id, r.size, r.taken) for r in a) == brute_mix(docs)
    assert mixing.mix(nothing).count() == 0
    again = mixing.mixed_documents(odd)
    assert again.columns == odd.columns and max(Counter(r.doc_id for r in again.collect() if r.doc_id == 8).values(), default=0) <= 3


def test_whole_copies_meet_what_the_mix_takes_of_each_source(spark, nothing):
    rows = [(k, " ".join([f"w{k}"] * n), s) for k, (s, n) in enumerate([("a", 200_000), *[("a", 300)] * 500, *[("b", 170)] * 2_000, *[(None, 90)] * 700])]
    rows += [rows[0], rows[-1]]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in ((1, 2, 3), (3, 1, 1), (1, 1, 5)):
        want, got = Counter(), Counter()
        source = {r[0]: r[2] for r in rows}
        for r in mixing.mix(docs, weights=weights).collect():
            want[source[r.doc_id]] += r.taken
        a = mixing.mixed_documents(docs, weights=weights).collect()
        assert sorted(a, key=str) == sorted(mixing.mixed_documents(docs.repartition(7), weights=weights).collect(), key=str)
        for r in a:
            got[r.source] += len(r.text.split(" "))
        for s in (None, "b"):
            assert abs(got[s] - want[s]) <= 170 / 2
        assert abs(got["a"] - want["a"]) <= 150 + 100_000 and (weights != (1, 2, 3) or abs(got["a"] - want["a"]) <= 150)
    assert mixing.mixed_documents(nothing).count() == 0
    assert mixing.round_long([(10, 4), (10, 4), (6, 1)]) == ([False, True, False], -1)


def test_classifier_learns_and_handles_odd_rows(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_quality_classifier(spark, sf).toPandas().merge(read_table(spark, sf, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() >= 0.9 and got.score.between(0, 1).all()
    labels = spark.createDataFrame([(5, 1), (4, 0), (9, 0), (6, 1), (None, 1), (99, 1), (2, None)], "doc_id long, quality int")
    rows = quality_classifier.classify(odd, labels).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6, 7)}) == 1
    none = labels.where("doc_id = -1")
    assert {r.score for r in quality_classifier.classify(odd, none).collect()} == {0.5}
    assert quality_classifier.classify(nothing, labels).count() == 0


def test_isotonic_is_monotone():
    y = quality_classifier.isotonic(np.array([0.0, 3.0, 1.0, 2.0, 5.0]), np.ones(5))
    assert y.tolist() == [0.0, 2.0, 2.0, 2.0, 5.0]


def test_classifier_matches_one_matrix_in_numpy(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in quality_classifier.classify(docs, labels).collect()}
    known = {r.doc_id: float(r.quality) for r in labels.collect()}
    rows = [(r.doc_id, quality_classifier.statistics(r.text or "")) for r in docs.collect()]
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    learned = [(i, x) for i, x in rows if i in known and fold[i] != 2]
    x, y = np.array([s for _, s in learned]), np.array([known[i] for i, _ in learned])
    calibrates = np.array([fold[i] == 3 for i, _ in learned])
    n, ones = len(y), y.sum()
    rng = np.random.default_rng(7)
    w, b = rng.standard_normal((x.shape[1], 128)) / 4.0, rng.uniform(0, 2 * np.pi, 128)
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)

    def features(s):
        return np.hstack([np.cos(np.clip((s - mean) / spread, -6, 6) @ w + b) * np.sqrt(2 / 128), np.ones((len(s), 1))])

    z = features(x[~calibrates])
    weight = np.where(y[~calibrates] > 0, 0.5 * n / ones, 0.5 * n / (n - ones))
    root = np.sqrt(weight)[:, None]
    # Ridge as least squares with rows that pull to zero.
    beta = np.linalg.lstsq(np.vstack([z * root, np.sqrt(1e-3 * n / 128) * np.eye(129)]), np.concatenate([y[~calibrates] * root[:, 0], np.zeros(129)]), rcond=None)[0]
    raw = features(x[calibrates]) @ beta
    bins = np.clip(((raw + 0.5) * 128).astype(int), 0, 255)
    steps = sorted(set(bins.tolist()))
    level = [y[calibrates][bins == k].mean() for k in steps]
    size = [(bins == k).sum() for k in steps]
    # The isotonic fit by its minimax formula.
    share = lambda a, c: np.average(level[a : c + 1], weights=size[a : c + 1])
    curve = [max(min(share(a, c) for c in range(k, len(steps))) for a in range(k + 1)) for k in range(len(steps))]
    knots = [raw[bins == k].mean() for k in steps]
    all_raw = features(np.array([s for _, s in rows])) @ beta
    want = np.clip(0.999 * np.interp(all_raw, knots, curve) + 0.001 * np.clip(all_raw, 0, 1), 0, 1)
    assert len(got) == len(rows)
    for (i, _), score in zip(rows, want):
        held, have, predicted = got[i]
        assert held == (fold[i] == 2) and have == pytest.approx(score, abs=1e-4) and predicted == (have >= 0.7)
