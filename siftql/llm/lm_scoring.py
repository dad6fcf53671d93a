"""Language-model scores of whole texts by a causal self-attention model trained in numpy on subword ids.

Tokens are words and one end for each text; a word is spelled in subwords of a public byte-level vocabulary.  A place of
the model is a token, which enters by the ids of its first and last subword: one attention layer looks over the block of
``BLOCK`` tokens that is scored and the block before it, so windows of ``2 * BLOCK`` tokens overlap by half and every token
is scored once, in masked batches.  The attention state predicts the id of the next token's first subword, by a softmax
over groups of ids and one over the ids of the group (Goodman, 2001), which keeps both small.  What is left of a word,
given its first subword, is no matter of context here: counts of whole words, discounted, backed by counts of subword
pairs inside words (Kneser and Ney, 1995).

All training texts are counted.  Embeddings start as a factorisation of the corpus's counts of neighbouring first subwords,
whose bisection also gives the groups; then rounds of data-parallel training follow: every task goes through its share of
the windows with Adam, and the parameters are averaged.  A hash deals every training text to one of the rounds, so the
rounds together are one full pass over every window, at any size.

Texts are read once and packed in units: the words of up to ``UNIT_BYTES`` of text as numbers of the unit's own
dictionary.  Word counts of the corpus meet the dictionaries in one shuffled join, so neither side is ever broadcast.
"""

from __future__ import annotations

import base64
import copy
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import crc_of_id, materialize, text_or_empty

HELD_OUT, FOLDS = 2, 7
UNIT_BYTES = 16 << 20
#: Tokens that are laid out at once.
PART = 200_000
BLOCK = 16
WIDTH, HIDDEN = 16, 32
#: First subwords with embeddings of their own, and subwords with pair counts of their own; the rest share two places each, for ids with and without a space in front.
TOP = 2_048
#: Groups of first subwords are halved down to this size.
GROUP = 64
#: Blocks of a training step and of a scored batch.
ROUNDS, BATCH, RATE, SCORED = 3, 192, 4e-3, 512
#: Tasks of the scoring join below which units are spread thin.
FEW_TASKS = 200
#: Weight of a subword's share inside words against its counts after one neighbour.
KAPPA = 4.0
END_HASH = 2**64 - 1

_CODERS: dict[str, tuple] = {}


def coder(path: str) -> tuple[tiktoken.Encoding, np.ndarray, np.ndarray]:
    """The vocabulary of a ranks file: encoder, bytes of each id, and whether it begins with a space; the end is one id more."""
    if path not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        wide = max(ranks.values()) + 1
        size, opens = np.zeros(wide + 1, np.int64), np.zeros(wide + 1, bool)
        for b, i in ranks.items():
            size[i], opens[i] = len(b), b[:1] == b" "
        opens[wide] = True
        _CODERS[path] = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size, opens
    return _CODERS[path]


def spell(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of all words, each after a space, and how many each has."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lib, size, _ = coder(path)
    ids, n = [], []
    for at in range(0, len(words), 20_000):
        part = words[at : at + 20_000]
        got = np.array(lib.encode_ordinary(" " + b" ".join(part).decode()), np.int64)
        ends = np.cumsum([len(w) + 1 for w in part])
        upto = np.searchsorted(np.cumsum(size[got]), ends, side="left") + 1
        ids.append(got)
        n.append(np.diff(upto, prepend=0))
    return np.concatenate(ids), np.concatenate(n)


def _pressed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _unpressed(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _units(docs: DataFrame, path: str) -> DataFrame:
    """Units of ``id``, ``held``, ``text``; dictionary entry 0 is the end."""

    def pack(unit: int, ids: list, held: list, n: list, words: list, train: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
        subs, size = spell(names[1:], path)
        end = len(coder(path)[1]) - 1
        hashes = [END_HASH, *[xxhash.xxh3_64_intdigest(w) for w in names[1:]]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([unit], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())), pa.array([_pressed(np.concatenate(words), "<u4")], pa.binary()),
                pa.array([np.array(hashes, np.uint64).view(np.int64)], pa.list_(pa.int64())),
                pa.array([train.astype(np.int64)], pa.list_(pa.int64())), pa.array([np.concatenate([[end], subs[np.cumsum(size) - size]])], pa.list_(pa.int64())), pa.array([_pressed(np.concatenate([[1], size]), "<u4")], pa.binary()), pa.array([_pressed(np.concatenate([[end], subs]), "<u2")], pa.binary()),
            ],
            ["unit", "ids", "held", "n", "words", "hashes", "train", "first", "sub_n", "subs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId() << 24
        ids, held, n, words, size = [], [], [], [], 0
        local: defaultdict = defaultdict()
        local.default_factory = local.__len__
        local[b" "]  # the end; no word is a space

        def flush() -> pa.RecordBatch:
            learned = [w for w, h in zip(words, held) if not h]
            train = np.bincount(np.concatenate(learned), minlength=len(local)) if learned else np.zeros(len(local), np.int64)
            return pack(k, ids, held, n, words, train, list(local))

        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode().lower()
                got = np.array([*map(local.__getitem__, raw.split()), 0], np.uint32)
                ids.append(i)
                held.append(h)
                n.append(len(got))
                words.append(got)
                size += len(raw) + 1
                if size >= UNIT_BYTES:
                    yield flush()
                    k += 1
                    ids, held, n, words, size = [], [], [], [], 0
                    local.clear()
                    local[b" "]
        if ids:
            yield flush()

    kind = docs.schema["id"].dataType.simpleString()
    id_type = _arrow_type(docs, "id")
    return docs.select("id", "held", "text").mapInArrow(run, f"unit long, ids array<{kind}>, held array<boolean>, n array<long>, words binary, hashes array<long>, train array<long>, first array<long>, sub_n binary, subs binary")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


class Unit:
    """The tokens of a unit's texts, each text with its end, as numbers of the unit's dictionary."""

    def __init__(self, row: dict, take=None):
        """``take``: whether to take texts of given crc32 and fold; all by default."""
        self.held = np.array(row["held"], bool)
        self.n = np.array(row["n"], np.int64)
        self.words = _unpressed(row["words"], "<u4")
        self.sub_n = _unpressed(row["sub_n"], "<u4").astype(np.int64)
        self.subs = _unpressed(row["subs"], "<u2").astype(np.int64)
        self.ends = np.cumsum(self.sub_n)
        if take is not None:
            keep = take(np.array([zlib.crc32(str(i).encode()) for i in row["ids"]], np.int64), self.held)
            self.words = self.words[np.repeat(keep, self.n)]
            self.n, self.held = self.n[keep], self.held[keep]

    def parts(self, most: int = PART) -> Iterator[Unit]:
        """The unit in parts of whole texts with about ``most`` tokens, so that what is laid out of it is bounded."""
        if not len(self.n):
            return
        ends = np.cumsum(self.n)
        cuts = [*np.unique(np.searchsorted(ends, np.arange(most, ends[-1], most)) + 1), len(self.n)]
        for a, b in zip([0, *cuts], cuts):
            if a < b:
                part = copy.copy(self)
                part.words = self.words[ends[a - 1] if a else 0 : ends[b - 1]]
                part.n, part.held = self.n[a:b], self.held[a:b]
                yield part

    def per_doc(self, of_word: np.ndarray) -> np.ndarray:
        """Sums of a number of each dictionary entry over the tokens of each text."""
        return np.add.reduceat(of_word[self.words], np.cumsum(self.n) - self.n) if len(self.n) else np.empty(0)

    def sides(self, of_first: np.ndarray, of_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the first and of the last subword of each token."""
        return of_first[self.subs[self.ends - self.sub_n]][self.words], of_last[self.subs[self.ends - 1]][self.words]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows whose lists of numbers are arrays."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns):
                v = column[k]
                flat = pa.types.is_list(column.type) and v.is_valid and pa.types.is_int64(column.type.value_type) and not v.values.null_count
                row[name] = v.values.to_numpy() if flat else v.as_py()
            yield row


def _long_sums(units: DataFrame, columns: list[str], count, kind: str = "long") -> tuple[np.ndarray, np.ndarray]:
    """Sums by place of the sparse vectors ``count(rows) -> (places, values)`` of all tasks; partial before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, v = count(_rows(batches))
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 50_000], pa.int64()), pa.array(v[k : k + 50_000], pa.int64() if kind == "long" else pa.float64())], ["at", "v"])

    got = units.select(*columns).mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    return got["at"].to_numpy(np.int64), got["v"].to_numpy()


def _dense(got: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size)
    out[got[0]] = got[1]
    return out


SEQUENCE = ["ids", "held", "n", "words", "sub_n", "subs"]


def _shares(counts: np.ndarray, opens: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent ids; the place of every id; the log-share of an id in its place (0 but for the two shared ones)."""
    order = np.argsort(-counts, kind="stable")[: min(top, int((counts > 0).sum()))]
    place = np.where(opens, len(order), len(order) + 1)
    place[order] = np.arange(len(order))
    rest = place >= len(order)
    smooth = np.where(rest, counts + 1.0, 1.0)
    total = np.bincount(place[rest], smooth[rest], len(order) + 2)
    return order, place, np.where(rest, np.log(smooth) - np.log(np.maximum(total[place], 1.0)), 0.0)


class Vocabulary:
    """Places of first subwords in groups, and log-probabilities of what follows a first subword inside its word."""

    def __init__(self, firsts: np.ndarray, inner: np.ndarray, opens: np.ndarray):
        order, self.token, self.within = _shares(firsts, opens, TOP)
        self.firsts = firsts
        self.tokens = len(order) + 2
        most, self.sub, self.sub_share = _shares(inner, opens, TOP)
        self.subs = len(most) + 2

    def arrange(self, pairs: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
        """Number the places by groups, and give the parameters before training.

        ``pairs``: counts of (place, place of the next token).  Their log-ratios are factorised with frequent rows and
        columns weighing more; groups are halves of halves along the factors' widest directions.
        """
        rng = np.random.default_rng(seed)
        total = np.bincount(self.token, self.firsts, self.tokens) + 1
        p = total / total.sum()
        n = pairs.sum(1, keepdims=True)
        w, v = np.sqrt(n + 1.0), np.sqrt(p)
        x = np.log((pairs + 20 * p) / (n + 20) / p) * w * v
        # The largest factors by a randomised range finder.
        basis = rng.standard_normal((x.shape[1], min(WIDTH + 8, x.shape[1])))
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        left, size, right = np.linalg.svd(x @ basis, full_matrices=False)
        d = min(WIDTH, len(size))
        e, c = np.zeros((self.tokens, WIDTH)), np.zeros((WIDTH, self.tokens))
        e[:, :d], c[:d] = left[:, :d] * size[:d] / w, (right @ basis.T)[:d] / v
        scale = np.sqrt(np.maximum((e**2).mean(0), 1e-6))
        e, c = e / scale, c * scale[:, None]
        groups = [np.arange(self.tokens)]
        while max(map(len, groups)) > GROUP:
            halves = []
            for g in groups:
                if len(g) <= GROUP:
                    halves.append(g)
                    continue
                y = c[:, g] - c[:, g].mean(1, keepdims=True)
                along = np.argsort(np.linalg.svd(y, full_matrices=False)[0][:, 0] @ y, kind="stable")
                halves += [g[np.sort(along[: len(g) // 2])], g[np.sort(along[len(g) // 2 :])]]
            groups = halves
        by = np.concatenate(groups)
        new = np.empty(self.tokens, np.int64)
        new[by] = np.arange(self.tokens)
        self.token = new[self.token]
        self.cuts = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
        self.group = np.repeat(np.arange(len(groups)), np.diff(self.cuts))
        e, c, p = e[by], c[:, by], p[by]
        share = np.add.reduceat(p, self.cuts[:-1])
        mean = np.add.reduceat(c * p, self.cuts[:-1], axis=1) / share
        small = lambda *shape, to=0.25: rng.standard_normal(shape) * to
        model = {"e1": e, "e2": np.zeros((self.tokens, WIDTH)), "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, WIDTH), "o": small(WIDTH, WIDTH, to=0.02), "w1": small(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN), "w2": small(HIDDEN, WIDTH, to=0.02), "c": mean, "bc": np.log(share), "c2": c - mean[:, self.group], "b2": np.log(p / share[self.group]), "slope": np.array([0.05])}
        return {k: v.astype(np.float32) for k, v in model.items()}

    def count_inside(self, pairs: np.ndarray, firsts: tuple[np.ndarray, np.ndarray], discount: float) -> None:
        """``pairs``: counts of (place of a subword, place of the next one in the word, or one more for the word's end);
        ``firsts``: for each id how many training tokens and how many different words begin with it.
        """
        share = pairs.sum(0) + 1.0
        share /= share.sum()
        self.after = np.log((pairs + KAPPA * share) / (pairs.sum(1, keepdims=True) + KAPPA)).astype(np.float32)
        self.n_first, self.words_first, self.discount = *firsts, discount

    def rest(self, unit: Unit, c: np.ndarray) -> np.ndarray:
        """log-probability of each dictionary entry given its first subword; ``c``: counts in training."""
        first = unit.subs[unit.ends - unit.sub_n]
        last = np.zeros(len(unit.subs), bool)
        last[unit.ends - 1] = True
        here = self.sub[unit.subs]
        to = np.where(last, self.subs, np.roll(here, -1))
        step = self.after[here, to] + np.where(last, 0.0, np.roll(self.sub_share[unit.subs], -1))
        spelled = np.exp(np.add.reduceat(step, unit.ends - unit.sub_n))
        n, kinds = self.n_first[first], self.words_first[first]
        got = np.maximum(c - self.discount, 0) + np.where(n > 0, self.discount * kinds, 1.0) * spelled
        out = np.log(np.maximum(got, 1e-300)) - np.log(np.maximum(n, 1.0)) + self.within[first]
        out[0] = self.within[first[0]]  # nothing follows the end
        return out


def flatten(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.values()])


def unflatten(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


#: Distance of each of the window's places from each scored place; the later ones are masked.
_BACK = (np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None]).astype(np.float32)
_MASK = np.where(_BACK < 0, np.float32(-1e9), np.float32(0))


def _attend(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Hidden states of blocks ``x[1:]``, each after the block before it, which counts for nothing where ``first``."""
    flat = x.reshape(-1, WIDTH)
    q = (flat[BLOCK:] @ (m["q"] * np.float32(WIDTH**-0.5))).reshape(-1, BLOCK, WIDTH)
    k, v = ((flat @ m[name]).reshape(x.shape) for name in "kv")
    s = np.empty((len(q), BLOCK, 2 * BLOCK), x.dtype)
    np.matmul(q, k[:-1].transpose(0, 2, 1), out=s[:, :, :BLOCK])
    np.matmul(q, k[1:].transpose(0, 2, 1), out=s[:, :, BLOCK:])
    s += _MASK - m["slope"] * np.maximum(_BACK, 0)
    s[first, :, :BLOCK] = -1e9
    if s.max() > 60:
        s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s *= 1 / (s @ np.ones(2 * BLOCK, s.dtype))[:, :, None]
    o = s[:, :, :BLOCK] @ v[:-1]
    o += s[:, :, BLOCK:] @ v[1:]
    o = o.reshape(-1, WIDTH)
    h1 = flat[BLOCK:] + o @ m["o"]
    f = h1 @ m["w1"]
    f += m["b1"]
    np.maximum(f, 0, out=f)
    return {"q": q, "k": k, "v": v, "a": s, "o": o, "h1": h1, "f": f, "h2": h1 + f @ m["w2"]}


def _softmax(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Turn ``z`` into shares in place; returns the logs of those of ``y``."""
    if z.max(initial=0) > 60:
        z -= z.max(1, keepdims=True)
    at = np.arange(len(z))
    own = z[at, y]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z *= (1 / total)[:, None]
    return own - np.log(total)


def _predict(m: dict[str, np.ndarray], vocab: Vocabulary, h: np.ndarray, y: np.ndarray, learn: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Log-probabilities of the places ``y`` from states ``h``; with ``learn`` also gradients of minus their mean."""
    g = vocab.group[y]
    z = h @ m["c"]
    z += m["bc"]
    lp = _softmax(z, g)
    order = np.argsort(g, kind="stable")
    upto = np.searchsorted(g[order], np.arange(len(vocab.cuts)))
    hs, ys = h[order], y[order]
    own = np.empty(len(y), h.dtype)
    grads: dict[str, np.ndarray] = {}
    if learn:
        scale = np.float32(1 / max(len(y), 1)).astype(h.dtype)
        z[np.arange(len(z)), g] -= 1
        z *= scale
        grads = {"c": h.T @ z, "bc": z.sum(0), "c2": np.zeros_like(m["c2"]), "b2": np.zeros_like(m["b2"]), "h": z @ m["c"].T}
        back = np.empty_like(hs)
    for k in np.unique(g).tolist():
        a, b, p, q = upto[k], upto[k + 1], vocab.cuts[k], vocab.cuts[k + 1]
        z = hs[a:b] @ m["c2"][:, p:q]
        z += m["b2"][p:q]
        own[a:b] = _softmax(z, ys[a:b] - p)
        if learn:
            z[np.arange(b - a), ys[a:b] - p] -= 1
            z *= scale
            grads["c2"][:, p:q] = hs[a:b].T @ z
            grads["b2"][p:q] = z.sum(0)
            back[a:b] = z @ m["c2"][:, p:q].T
    lp[order] += own
    if learn:
        grads["h"][order] += back
    return lp, grads


def log_probabilities(m: dict[str, np.ndarray], vocab: Vocabulary, given: tuple[np.ndarray, np.ndarray], target: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-probabilities of the places ``target[1:]`` (-1: none, 0.0) of blocks; the first block is only looked back at."""
    h = _attend(m, m["e1"][given[0]] + m["e2"][given[1]], first[1:])["h2"]
    y = target[1:].ravel()
    real = np.flatnonzero(y >= 0)
    out = np.zeros(len(y))
    out[real] = _predict(m, vocab, h[real], y[real])[0]
    return out


def _sum_by(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``x`` by place."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((size, x.shape[1]), x.dtype)
    out[own[cuts]] = np.add.reduceat(x[order], cuts, axis=0)
    return out


def gradients(m: dict[str, np.ndarray], vocab: Vocabulary, given: tuple[np.ndarray, np.ndarray], target: np.ndarray, first: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the places ``target[1:]`` (-1: none) of blocks, and its gradients; the first block is only looked back at."""
    x = m["e1"][given[0]] + m["e2"][given[1]]
    t = _attend(m, x, first[1:])
    y = target[1:].ravel()
    real = np.flatnonzero(y >= 0)
    lp, g = _predict(m, vocab, t["h2"][real], y[real], learn=True)
    dh2 = np.zeros_like(t["h2"])
    dh2[real] = g.pop("h")
    flat = x.reshape(-1, WIDTH)
    g["w2"] = t["f"].T @ dh2
    df = dh2 @ m["w2"].T
    df *= t["f"] > 0
    g["w1"], g["b1"] = t["h1"].T @ df, df.sum(0)
    dh1 = dh2 + df @ m["w1"].T
    g["o"] = t["o"].T @ dh1
    do = (dh1 @ m["o"].T).reshape(-1, BLOCK, WIDTH)
    a, v, k = t["a"], t["v"], t["k"]
    ds = np.empty_like(a)
    np.matmul(do, v[:-1].transpose(0, 2, 1), out=ds[:, :, :BLOCK])
    np.matmul(do, v[1:].transpose(0, 2, 1), out=ds[:, :, BLOCK:])
    ds -= (do * t["o"].reshape(do.shape)).sum(2)[:, :, None]  # the sum of da * a
    ds *= a
    g["slope"] = np.array([-(ds.sum(0) * np.maximum(_BACK, 0)).sum()], x.dtype)
    dv, dk = np.zeros_like(v), np.zeros_like(k)
    dv[:-1] = a[:, :, :BLOCK].transpose(0, 2, 1) @ do
    dv[1:] += a[:, :, BLOCK:].transpose(0, 2, 1) @ do
    dk[:-1] = ds[:, :, :BLOCK].transpose(0, 2, 1) @ t["q"]
    dk[1:] += ds[:, :, BLOCK:].transpose(0, 2, 1) @ t["q"]
    dq = ds[:, :, :BLOCK] @ k[:-1]
    dq += ds[:, :, BLOCK:] @ k[1:]
    dq = dq.reshape(-1, WIDTH) * np.float32(WIDTH**-0.5).astype(x.dtype)
    dk, dv = dk.reshape(-1, WIDTH), dv.reshape(-1, WIDTH)
    g["q"], g["k"], g["v"] = flat[BLOCK:].T @ dq, flat.T @ dk, flat.T @ dv
    dx = dk @ m["k"].T + dv @ m["v"].T
    dx[BLOCK:] += dh1 + dq @ m["q"].T
    g["e1"], g["e2"] = (_sum_by(at.ravel(), dx, len(m["e1"])) for at in given)
    return -float(lp.sum()) / max(len(real), 1), g


class Adam:
    def __init__(self, model: dict[str, np.ndarray], rate: float):
        self.m, self.rate, self.t = model, rate, 0
        self.a, self.b = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, v in self.m.items():
            self.a[k] += np.float32(0.1) * (g[k] - self.a[k])
            self.b[k] += np.float32(0.01) * (g[k] ** 2 - self.b[k])
            v -= np.float32(rate) * self.a[k] / (np.sqrt(self.b[k]) + np.float32(1e-8))


def _blocks(sides: tuple[np.ndarray, np.ndarray], n: np.ndarray, end: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Padded blocks after an empty one: inputs, targets (-1: none), first blocks of their texts, text of each block."""
    nb = -(-n // BLOCK)
    start = (np.cumsum(nb) - nb + 1) * BLOCK
    tokens = len(sides[0])
    to = np.arange(tokens) + np.repeat(start - (np.cumsum(n) - n), n)
    total = int(nb.sum()) + 1
    given = []
    for own in sides:
        x = np.full(total * BLOCK, end, np.int64)
        x[to] = np.concatenate([[end], own[:-1]])  # every text ends with the end, which opens the next one
        given.append(x.reshape(-1, BLOCK))
    target = np.full(total * BLOCK, -1, np.int64)
    target[to] = sides[0]
    first = np.zeros(total, bool)
    first[start // BLOCK] = True
    return (given[0], given[1]), target.reshape(-1, BLOCK), first, np.concatenate([[0], np.repeat(np.arange(len(n)), nb)])


def round_of(crc: np.ndarray) -> np.ndarray:
    """The one round in which a text is trained on."""
    return (crc * 2_654_435_761 >> 7) % ROUNDS


def train_on(model: dict[str, np.ndarray], rows: Iterator[dict], vocab: Vocabulary, end: int, k: int, rate: float) -> int:
    """Train in place on all windows of the training texts of round ``k``, part by part; returns how many blocks there were."""
    opt, seen = Adam(model, rate), 0
    rng = np.random.default_rng(k)
    for row in rows:
        for unit in Unit(row, lambda crc, held: ~held & (round_of(crc) == k)).parts():
            given, target, first, _ = _blocks(unit.sides(vocab.token, vocab.token), unit.n, end)
            seen += len(first) - 1
            for at in rng.permutation(np.arange(0, len(first) - 1, BATCH)).tolist():
                b = slice(at, at + BATCH + 1)  # one block to look back at, and the blocks to learn from
                _, g = gradients(model, vocab, (given[0][b], given[1][b]), target[b], first[b])
                opt.step(g)
    return seen


def score_unit(model: dict[str, np.ndarray], unit: Unit, vocab: Vocabulary, end: int, rest: np.ndarray) -> np.ndarray:
    """log10 of the model's probability of each text; ``rest``: log-probability of each dictionary entry given its first subword."""
    given, target, first, doc = _blocks(unit.sides(vocab.token, vocab.token), unit.n, end)
    own = np.zeros(len(first))
    for at in range(0, len(first) - 1, SCORED):
        b = slice(at, at + SCORED + 1)
        own[at + 1 : at + SCORED + 1] = log_probabilities(model, vocab, (given[0][b], given[1][b]), target[b], first[b]).reshape(-1, BLOCK).sum(1)
    return (np.bincount(doc, own, len(unit.n)) + unit.per_doc(rest)) / np.log(10)


def fit(units: DataFrame, counts: DataFrame, path: str) -> tuple[Vocabulary, dict[str, np.ndarray], int]:
    """Vocabulary, model and the place of the end, learned from the units' training texts.

    ``counts``: ``c`` and ``first`` (id of the first subword) of each word of the training texts.
    """
    opens = coder(path)[2]
    wide = len(opens)
    begun = counts.groupBy("first").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once"), F.count(F.when(F.col("c") == 2, 1)).alias("twice")).toPandas()
    at = begun["first"].to_numpy(np.int64)
    n_first, words_first = _dense((at, begun["n"].to_numpy()), wide), _dense((at, begun["v"].to_numpy()), wide)
    once, twice = int(begun["once"].sum()), int(begun["twice"].sum())
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def inner(rows):
        out = np.zeros(wide)
        for r in rows:
            size, subs = _unpressed(r["sub_n"], "<u4").astype(np.int64), _unpressed(r["subs"], "<u2")
            out += np.bincount(subs, np.repeat(np.array(r["train"], float), size), wide)
        at = np.flatnonzero(out)
        return at, out[at].astype(np.int64)

    vocab = Vocabulary(n_first, _dense(_long_sums(units, ["train", "sub_n", "subs"], inner), wide), opens)

    def inside(rows):
        out = np.zeros(vocab.subs * (vocab.subs + 1))
        for r in rows:
            size, subs = _unpressed(r["sub_n"], "<u4").astype(np.int64), _unpressed(r["subs"], "<u2").astype(np.int64)
            here, to = vocab.sub[subs], np.roll(vocab.sub[subs], -1)
            to[np.cumsum(size) - 1] = vocab.subs
            out += np.bincount(here * (vocab.subs + 1) + to, np.repeat(np.minimum(np.array(r["train"], float), 1), size), len(out))
        at = np.flatnonzero(out)
        return at, out[at].astype(np.int64)

    pairs = _dense(_long_sums(units, ["train", "sub_n", "subs"], inside), vocab.subs * (vocab.subs + 1)).reshape(vocab.subs, -1)
    end = int(vocab.token[wide - 1])

    def neighbours(rows):
        out = np.zeros(vocab.tokens**2, np.int64)
        for r in rows:
            for unit in Unit(r, lambda crc, held: ~held).parts():
                t, _ = unit.sides(vocab.token, vocab.token)
                out += np.bincount(np.concatenate([[end], t[:-1]]) * vocab.tokens + t, minlength=len(out))
        at = np.flatnonzero(out)
        return at, out[at]

    model = vocab.arrange(_dense(_long_sums(units, SEQUENCE, neighbours), vocab.tokens**2).reshape(vocab.tokens, vocab.tokens))
    end = int(vocab.token[wide - 1])
    for k in range(ROUNDS):
        def trained(rows, model=model, k=k):
            own = {n: v.copy() for n, v in model.items()}
            seen = train_on(own, rows, vocab, end, k, RATE / (k + 1))
            flat = np.concatenate([flatten(own).astype(np.float64), [1.0]]) * seen
            return np.arange(len(flat)) if seen else [], flat if seen else []

        at, v = _long_sums(units, SEQUENCE, trained, "double")
        if not len(at):  # no text of this round, as in a corpus of very few
            continue
        flat = np.zeros(len(flatten(model)) + 1)
        flat[at] = v
        model = unflatten(flat[:-1] / flat[-1], model)
    vocab.count_inside(pairs, (n_first, words_first), discount)  # the largest table, which the rounds need not carry
    return vocab, model, end


def score_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by words and by the attention model.

    ``path``: a ranks file of a byte-level vocabulary.  A text is held out if the crc32 of its identifier as text is 2
    modulo 7; only the others are learned from.  Letters A to Z are lower-cased; tokens are words and one end.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens`` (long, all rows
    alike), ``base_score`` (add-one unigram, log10) and ``score`` (log10 of the model's probability of the text).

    Null texts count as empty and have their end only.  Rows are kept one to one, with null or repeated identifiers too
    (a null one is never held out); other columns are not read.  An empty table gives no rows; without training texts,
    scores are those of a uniform choice of subwords.  Words are counted by a 64-bit hash.  A text is never cut, so one
    very long text makes a unit of its own size.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(crc_of_id("id"), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).select("id", held.alias("held"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    units = materialize(_units(rows, path), "units")
    n_units = units.count()
    words = units.select("unit", F.posexplode(F.arrays_zip("hashes", "train", "first")).alias("at", "w")).select("unit", "at", F.col("w.hashes").alias("hash"), F.col("w.train").alias("n"), F.col("w.first").alias("first"))
    counts = materialize(words.where("n > 0").groupBy("hash").agg(F.sum("n").alias("c"), F.min("first").alias("first")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, n_words = int(totals.n), int(totals.v)
    vocab, model, end = fit(units, counts, path)
    # ``units`` and ``counts`` stay until the result has been read.
    # More tasks than units until those are many, then some units each: what a task holds stays the same at any size.
    tasks = max(1, n_units // 4, min(4 * n_units, FEW_TASKS))
    known = words.select("unit", "at", "hash").join(counts.select("hash", "c"), "hash").repartition(tasks, "unit").groupBy("unit").agg(F.collect_list("at").alias("at"), F.collect_list("c").alias("c"))
    joined = units.select("unit", *SEQUENCE).repartition(tasks, "unit").join(known, "unit", "left")
    id_type = _arrow_type(rows, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            unit = Unit(r)
            c = np.zeros(len(unit.sub_n), np.int64)
            if r["at"] is not None:
                c[np.asarray(r["at"], np.int64)] = r["c"]
            base = unit.per_doc(np.log10((c + 1) / (n_all + n_words + 1)))
            rest = vocab.rest(unit, c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], id_type), pa.array(unit.held), pa.array(unit.n), pa.array(unit.per_doc((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(unit.n), n_all)), pa.array(base, pa.float64()), pa.array(np.concatenate([score_unit(model, part, vocab, end, rest) for part in unit.parts()]), pa.float64())],
                [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return joined.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
