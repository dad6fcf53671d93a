import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from siftql.llm import lm_scoring, secret_scan
from siftql.llm._shared import read_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DICTIONARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_base(rows):
    docs = [(i, [*WORD.findall(low(t)), None], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    c = Counter(w for _, ws, h in docs if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return Counter((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws, h in docs)


def test_base_scores_match_brute_force(spark, odd, nothing, sf):
    for docs in (odd, read_table(spark, sf, "documents")):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = lm_scoring.score_texts(docs, RANKS).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == brute_base(rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score_texts(nothing, RANKS).count() == 0


def fitted(spark, docs):
    units = lm_scoring._units(docs.selectExpr("doc_id id", "doc_id % 5 = 0 held", "text"), RANKS).cache()
    counts = Counter()
    first = {}
    for r in units.collect():
        for h, n, f in zip(r.hashes, r.train, r.first):
            if n:
                counts[h] += n
                first[h] = f
    table = spark.createDataFrame([(n, first[h]) for h, n in counts.items()], "c long, first long")
    return units, counts, *lm_scoring.fit(units, table, RANKS)


def test_model_is_a_distribution_and_batches_agree(spark, sf):
    units, counts, vocab, model, end = fitted(spark, read_table(spark, sf, "documents"))
    within = np.bincount(vocab.token, np.exp(vocab.within), vocab.tokens)
    assert within == pytest.approx(np.ones(vocab.tokens), abs=1e-6) and vocab.cuts[-1] == vocab.tokens
    assert np.exp(vocab.after.astype(float)).sum(1) == pytest.approx(np.ones(vocab.subs), abs=1e-4)
    assert np.bincount(vocab.sub, np.exp(vocab.sub_share), vocab.subs) == pytest.approx(np.ones(vocab.subs), abs=1e-6)
    row = units.first().asDict()
    unit = lm_scoring.Unit(row)
    c = np.array([counts[h] for h in row["hashes"]])
    rest = vocab.rest(unit, c)
    # What is given out inside a first subword is at most 1, and near 1 where its words are all in the dictionary.
    share = np.bincount(unit.subs[unit.ends - unit.sub_n], np.exp(rest), len(vocab.token))
    assert share.max() <= 1 + 1e-6 and np.median(share[share > 0]) > 0.2
    got = lm_scoring.score_unit(model, unit, vocab, end, rest)
    tokens, last = unit.sides(vocab.token, vocab.token)
    at = 0
    for d in range(4):  # one token at a time, with its own window
        n = unit.n[d]
        own, total = tokens[at : at + n], 0.0
        given = np.stack([np.concatenate([[end], own[:-1]]), np.concatenate([[end], last[at : at + n - 1]])])
        for i in range(n):
            b = i // lm_scoring.BLOCK * lm_scoring.BLOCK
            s = slice(max(0, b - lm_scoring.BLOCK), i + 1)
            x = model["e1"][given[0, s]].astype(float) + model["e2"][given[1, s]]
            q, k, v = x[-1] @ model["q"], x @ model["k"], x @ model["v"]
            a = k @ q / 4 - float(model["slope"][0]) * np.arange(len(x) - 1, -1, -1)
            a = np.exp(a - a.max())
            h1 = x[-1] + (a / a.sum()) @ v @ model["o"]
            h2 = h1 + np.maximum(h1 @ model["w1"] + model["b1"], 0) @ model["w2"]
            g = vocab.group[own[i]]
            for z, y in ((h2 @ model["c"] + model["bc"], g), ((h2 @ model["c2"] + model["b2"])[vocab.cuts[g] : vocab.cuts[g + 1]], own[i] - vocab.cuts[g])):
                total += z[y] - z.max() - np.log(np.exp(z - z.max()).sum())
            total += rest[unit.words[at + i]]
        assert got[d] == pytest.approx(total / math.log(10), rel=1e-3)
        at += n


def test_gradients_are_slopes():
    rng, b = np.random.default_rng(0), lm_scoring.BLOCK
    cuts = np.array([0, 3, 4, 9, 12])
    vocab = type("V", (), {"cuts": cuts, "group": np.repeat(np.arange(4), np.diff(cuts))})
    w, h = lm_scoring.WIDTH, lm_scoring.HIDDEN
    shapes = {"e1": (12, w), "e2": (12, w), "q": (w, w), "k": (w, w), "v": (w, w), "o": (w, w), "w1": (w, h), "b1": (h,), "w2": (h, w), "c": (w, 4), "bc": (4,), "c2": (w, 12), "b2": (12,), "slope": (1,)}
    m = {k: 0.4 * rng.standard_normal(s) for k, s in shapes.items()}
    target = np.where(rng.random((5, b)) < 0.8, rng.integers(0, 12, (5, b)), -1)
    batch = (rng.integers(0, 12, (5, b)), rng.integers(0, 12, (5, b))), target, np.array([False, True, False, False, True])
    _, g = lm_scoring.gradients(m, vocab, *batch)
    assert g.keys() == m.keys()
    for k in m:
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in m[k].shape)
            up, down = ({**m, k: m[k].copy()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert (lm_scoring.gradients(up, vocab, *batch)[0] - lm_scoring.gradients(down, vocab, *batch)[0]) / 2e-5 == pytest.approx(g[k][i], rel=1e-3, abs=1e-6)


def test_every_window_of_every_training_text_is_trained_on(spark, monkeypatch):
    """A corpus of many blocks, and one of few."""
    for docs, blocks in ((400, 45), (3, 2)):
        text = [" ".join(f"w{(d * 7 + i) % 50}" for i in range(blocks * lm_scoring.BLOCK)) for d in range(docs)]
        units = lm_scoring._units(spark.createDataFrame([*((d, d % 5 == 0, t) for d, t in enumerate(text)), (-1, False, ""), (-2, False, "one")], "id long, held boolean, text string").coalesce(1), RANKS)
        row = units.first().asDict()
        lib, seen, want = lm_scoring.coder(RANKS)[0], Counter(), Counter()
        size = len(lm_scoring.coder(RANKS)[1])
        vocab = type("V", (), {"token": np.arange(size)})
        end = size - 1
        for d, t in [*enumerate(text), (-1, ""), (-2, "one")]:
            ids = [*[lib.encode_ordinary(" " + w)[0] for w in t.split()], end]
            if d < 0 or d % 5:
                want.update(tuple(ids[a : a + lm_scoring.BLOCK]) for a in range(0, len(ids), lm_scoring.BLOCK))
        monkeypatch.setattr(lm_scoring, "gradients", lambda m, vocab, given, target, first: (0.0, seen.update(tuple(t[t >= 0].tolist()) for t in target[1:]) or {}))
        n = sum(lm_scoring.train_on({}, iter([row]), vocab, end, k, 0.0) for k in range(lm_scoring.ROUNDS))
        assert seen == want and n == sum(want.values()) and (n > 14_000 or docs == 3)


def test_spelling_is_the_librarys():
    words = ["the", "naïve", "it's", "x" * 400, " a　", "12ab,", "漢字"]
    ids, n = lm_scoring.spell([w.encode() for w in words], RANKS)
    lib = lm_scoring.coder(RANKS)[0]
    assert ids.tolist() == [i for w in words for i in lib.encode_ordinary(" " + w)] and n.tolist() == [len(lib.encode_ordinary(" " + w)) for w in words]


def test_training_helps(spark):
    rows = lm_scoring.score_texts(read_table(spark, "/root/testdata/sf0.1", "documents"), RANKS).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > rows.b


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_fixed_patterns_match_brute_force(spark, odd, nothing, sf):
    extra = spark.createDataFrame([(70, "API_KEY: 'abcdef1' passwd=short1 tokEN = \"a.b/c+d\" é AKIA" + "Z" * 16 + " " + "f" * 23 + "g" + "0" * 30), (71, "secret secret=secret=abcdef")], "doc_id long, text string")
    for docs in (odd.select("doc_id", "text"), read_table(spark, sf, "documents").select("doc_id", "text"), extra):
        got = secret_scan.scan(docs).collect()
        want = Counter()
        for r in docs.collect():
            s = brute_spans(r.text or "")
            want[r.doc_id, *[sum(x[1] == k for x in s) for k in range(3)], secret_scan.written(s)] += 1
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_spans) for r in got) == want
        for r in got:
            assert {*r.base_spans.split(",")} <= {*r.spans.split(",")} | {""}
    assert secret_scan.scan(nothing).count() == 0
    assert secret_scan.sha256_of("") == hashlib.sha256(b"").hexdigest()


def brute_cost(value):
    """The cheapest of all segmentations, every span judged by itself."""
    rank, place = secret_scan.ranks(DICTIONARY), secret_scan._PLACE
    brute = lambda x: sum(map(secret_scan._brute, x))

    def span(x, at):
        low, n, out = x.lower(), len(x), [brute(x) + (0.301 if at else 0)]
        if n >= 3 or at == 0:
            leet = low.translate(secret_scan._LEET)
            out += [math.log10(rank[w] + 1) + secret_scan._case(x) + more for w, more in ((low, 0.0), (leet, 0.602)) if w in rank and (more == 0 or low not in rank)]
        if re.fullmatch(r"(19|20)\d\d", x):
            out.append(2.1)
        m = re.fullmatch(r"(\d{4})([-/._]?)(\d\d)\2(\d\d)|(\d\d)([-/._]?)(\d\d)\6(\d{4})", x)
        if m:
            y, mo, d = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
            if y[:2] in ("19", "20") and 1 <= int(mo) <= 12 and 1 <= int(d) <= 31:
                out.append(4.6)
        keys = low.translate(secret_scan._SHIFTED)
        if n >= 4 and all(a != b and secret_scan._near(a, b) for a, b in zip(keys, keys[1:])):
            out.append(math.log10(47 * n) + 0.7 * (1 + sum(place[a][0] != place[b][0] for a, b in zip(keys, keys[1:]))))
        steps = {ord(b) - ord(a) for a, b in zip(x, x[1:])}
        if n >= 3 and steps in ({1}, {-1}):
            out.append(1.5 + math.log10(n))
        out += [brute(x[:p]) + math.log10(n / p + 1) for p in range(1, 11) if n >= max(3, 2 * p) and all(x[i] == x[i - p] for i in range(p, n))]
        return min(out)

    best = [0.0]
    for end in range(1, len(value) + 1):
        best.append(min(best[a] + span(value[a:end], a) for a in range(end)))
    return best[-1]


def test_guess_costs_are_the_least():
    rng = random.Random(7)
    bits = ["password", "Pass", "qwer", "rewq", "asdf", "abc", "cba", "aaa", "xyxyxy", "1999", "2019-05-17", "17.05.2019", "zq", "7", "#", "p@ss", "w0rd", "the", "TION", "K", "123", "!!", "é"]
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))[:18]
        cost, parts = secret_scan.segment(value, DICTIONARY)
        assert cost == pytest.approx(brute_cost(value)), value
        cut = secret_scan.guess_cost(value, DICTIONARY, 6.0)
        assert cut == pytest.approx(cost) if cost < 6 else cut >= 6


def test_guess_costs():
    cost = lambda v: secret_scan.guess_cost(v, DICTIONARY)
    assert cost("password") < 1 and cost("qwertyuiop") < 3 and cost("aaaaaaaaaaaa") < 3 and cost("20190517") < 6 and cost("abcdefgh") < 4
    assert cost("passwordrewqasdf") < 5 and cost("international") < 5 and cost("administratorship") < 10 and cost("university") < 5
    assert cost("correcthorsebattery") < cost("xK7#pQz!vR2m") and cost("xK7#pQz!vR2m") > 14
    for v in ("Tr0ub4dor&3", "summer2019!!", "zxcvbnm,./", "x" * 3000, "é漢字7"):
        total, parts = secret_scan.segment(v, DICTIONARY)
        assert math.isfinite(total) and [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and parts[-1][2] == len(v)
    assert secret_scan.guess_cost("".join(random.Random(1).choices("abXY12#", k=200_000)), DICTIONARY, 10.0) >= 10


def test_guessed_values_and_redaction(spark, odd):
    text = "pwd: xK7#pQz!vR2m and pwd: password1 and password = 'zzTop99x' end"
    base, spans = secret_scan.scan_text(text, dictionary=DICTIONARY)
    assert [text[a:b] for a, k, b in spans if k == 3] == ["xK7#pQz!vR2m"] and len(base) == 1
    clean = secret_scan.redact(text, spans)
    assert "xK7" not in clean and "zzTop" not in clean and clean.endswith(" end")
    assert secret_scan.redact_table(odd.limit(0)).count() == 0
    out = secret_scan.redact_table(odd, dictionary=DICTIONARY)
    assert out.columns == odd.columns and out.count() == 13
    r = out.where("doc_id = 10").first()
    assert "AKIA" not in r.text and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('pwd = "xK7#,Qz!vR2mT9$w"', "xK7#,Qz!vR2mT9$w"), ("pwd: 'xK7;<Q\"z!vR2mT9'", "xK7;<Q\"z!vR2mT9"), ('pwd => "unclosedxK7#Qz!vR2', "unclosedxK7#Qz!vR2"),
        ("redis://:S3cr9xKqTz71@host", "S3cr9xKqTz71"), (f"ftp://{'u' * 70}:S3cr9xKqTz71@host", "S3cr9xKqTz71"), ("HTTPS://bob:S3cr9xKqTz71@h", "S3cr9xKqTz71"), (f"{'x' * 30}://bob:S3cr9xKqTz71@h", "S3cr9xKqTz71"),
    ],
)
def test_whole_values_in_contexts(text, value):
    spans = secret_scan.scan_text(text)[1]
    assert [text[a:b] for a, k, b in spans if k == 3] == [value]
    assert value not in secret_scan.redact(text, spans)
