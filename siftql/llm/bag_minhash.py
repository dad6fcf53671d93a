"""Near-duplicate documents by BagMinHash over five-word shingles with their counts.

A shingle of count ``w`` owns the part of a Poisson process on time x level that lies below level ``w`` (Ertl, 2018).
Levels are discretised in dyadic blocks [0, 1), [1, 2), [2, 4), ...; within a block the process of the whole block is
generated in order of time, and the level of a point, drawn by repeated halving of the block, tells whether it lies
below ``w``.  Points go to one of ``M`` components; a component keeps its earliest point.  Two bags agree in a component
with probability equal to their weighted Jaccard similarity.  Generation stops as soon as a point comes later than every
component's earliest one.

Signatures are cut into bands; documents that share a band are candidates, and candidates are verified by the overlap
of their multisets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import materialize, release, text_or_empty
from siftql.llm.components import components

WORDS = 5
THRESHOLD = 0.8
#: 32 bands of 4: a pair of similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are not verified; of pairs of similarity 0.8, 8 in 100 million agree so little.
LEAST_AGREEMENT = 0.6
#: Buckets of up to so many documents send out their pairs, at most this number for each document; larger ones are compared inside.
SMALL_BUCKET = 8
#: Documents of each side that meet in one group; one of ``n`` shingles counts ``1 + n / CHUNK_SHINGLES``.
CHUNK, CHUNK_SHINGLES = 1024, 1024

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _step(k: int) -> np.uint64:
    return _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles, with repeats. One to four words are one shingle; no words, none."""
    parts = text.encode().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(p) for p in parts], np.uint64)
    n = max(1, len(h) - words + 1)
    if len(h) < words:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = _mix(out * _GOLD + x)
        return out
    out = np.full(n, words, np.uint64)
    for k in range(words):
        out = _mix(out * _GOLD + h[k : k + n])
    out.sort()
    return out


def signature(bag: np.ndarray, m: int = M) -> np.ndarray:
    """The BagMinHash signature of a sorted array of hashes with repeats: for each component a 64-bit name of its earliest point."""
    element, count = np.unique(bag, return_counts=True)
    if not len(element):
        return np.zeros(m, np.uint64)
    item, low, size, weight = [element], [np.zeros(len(element))], [np.ones(len(element))], [count]
    block = 1
    while (more := count > block).any():
        item.append(_mix(element[more] + _step(block)))
        low.append(np.full(more.sum(), float(block)))
        size.append(np.full(more.sum(), float(block)))
        weight.append(count[more])
        block *= 2
    item, low, size, weight = (np.concatenate(x) for x in (item, low, size, weight))
    earliest, name = np.full(m, np.inf), np.zeros(m, np.uint64)
    time, k = np.zeros(len(item)), 0
    while len(item):
        k += 1
        r = _mix(item + _step(k))
        u = ((r >> _U(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(u) / size
        s = _mix(r ^ _M1)
        inside = low + size * ((s >> _U(32)).astype(float) * 2.0**-32) < weight
        to = (s & _U(0xFFFFFFFF)).astype(np.int64) % m
        t, c, w = time[inside], to[inside], r[inside]
        order = np.argsort(-t, kind="stable")  # the earliest is written last
        t, c, w = t[order], c[order], w[order]
        best, who = np.full(m, np.inf), np.zeros(m, np.uint64)
        best[c], who[c] = t, w
        better = best < earliest
        earliest[better], name[better] = best[better], who[better]
        last = earliest.max()
        go = time < last
        if not go.all():
            item, low, size, weight, time = item[go], low[go], size[go], weight[go], time[go]
    return name


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays with repeats."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    u, inverse = np.unique(both, return_inverse=True)
    x = np.bincount(inverse[: len(a)], minlength=len(u))
    y = np.bincount(inverse[len(a) :], minlength=len(u))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def _print(bag: bytes) -> bytes:
    return hashlib.blake2b(bag, digest_size=16).digest()


def sketch(docs: DataFrame) -> DataFrame:
    """``id``, ``print`` (16 bytes, of the multiset), ``n`` (shingles), ``keys`` (band hashes), ``low`` (a byte of each component) from ``id``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(BANDS, dtype=np.uint64) + _U(1)) * _GOLD
        for batch in batches:
            prints, n, keys, low = [], [], [], []
            for text in batch.column(1).to_pylist():
                bag = shingles(text)
                sig = signature(bag)
                acc = salt.copy()
                for k in range(ROWS):
                    acc = _mix(acc * _GOLD + sig[k::ROWS])
                prints.append(_print(bag.tobytes()))
                n.append(len(bag))
                keys.append(acc.view(np.int64))
                low.append((sig & _U(0xFF)).astype(np.uint8).tobytes())
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(n, pa.int64()), lists, pa.array(low, pa.binary())], ["id", "print", "n", "keys", "low"])

    return docs.mapInArrow(run, "id long, print binary, n long, keys array<bigint>, low binary")


def _agree(pairs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree enough, from ``a``, ``b``, ``low_a``, ``low_b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, M)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, M)
            keep = pa.array((x == y).mean(1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of at least the threshold's overlap; ``bags`` has ``id``, ``bag``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= THRESHOLD for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _bags(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                bags = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_print(b) for b in bags], pa.binary()), pa.array(bags, pa.binary())], ["id", "print", "bag"])

    return docs.mapInArrow(run, "id long, print binary, bag binary")


def _numbered(bag: np.ndarray) -> np.ndarray:
    """A sorted array with repeats as a sorted one without: the second, third ... of equal hashes get hashes of their own."""
    new = np.r_[True, bag[1:] != bag[:-1]] if len(bag) else np.empty(0, bool)
    if new.all():
        return bag
    at = np.arange(len(bag))
    nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return np.sort(np.where(new, bag, _mix(bag + nth * _GOLD)))


def _links_within(table: pa.Table) -> pa.Table:
    """Links that join components, between the askers of a chunk of a bucket and a chunk of all its documents.

    Every pair is met in the first band that it shares.
    """
    own = {c: table.column(c) for c in table.column_names}
    ids, n, comp = (own[c].to_numpy() for c in ("id", "n", "comp"))
    band = own["band"][0].as_py()
    asks, rest = (own[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "rest"))
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    low = np.frombuffer(b"".join(own["low"].to_pylist()), np.uint8).reshape(-1, M)
    keys = own["keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    raw = own["bag"].to_pylist()
    bags: dict[int, np.ndarray] = {}
    top: dict[int, int] = {}

    def bag(k: int) -> np.ndarray:
        if k not in bags:
            bags[k] = _numbered(np.frombuffer(raw[k], np.uint64))
        return bags[k]

    def find(x: int) -> int:
        while (y := top.get(x, x)) != x:
            top[x] = top.get(y, y)
            x = y
        return x

    a, b = [], []
    for at in range(0, len(left), 32):
        some = left[at : at + 32]
        x, y = n[some][:, None], n[right][None]
        hit = (np.minimum(x, y) >= THRESHOLD * np.maximum(x, y)) & (comp[some][:, None] != comp[right][None])
        hit &= ~rest[right][None] | (ids[some][:, None] < ids[right][None])  # two askers meet once
        i, j = np.nonzero(hit)
        close = (low[some[i]] == low[right[j]]).mean(1) >= LEAST_AGREEMENT
        i, j = i[close], j[close]
        here = (keys[some[i]] == keys[right[j]]).argmax(1) == band
        i, j = i[here], right[j[here]]
        ends = np.searchsorted(i, np.arange(len(some) + 1))
        for k, p in enumerate(some.tolist()):
            # What an earlier link has joined needs no check; members of one component are checked until one links.
            others = [q for q in j[ends[k] : ends[k + 1]].tolist() if find(comp[q]) != find(comp[p])]
            if not others:
                continue
            sizes = np.array([n[q] for q in others])
            cat = np.concatenate([bag(q) for q in others])
            mine = bag(p)
            both = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, cat), len(mine) - 1)] == cat, np.cumsum(sizes) - sizes, dtype=np.int64)
            for q in np.array(others)[both / (len(mine) + sizes - both) >= THRESHOLD].tolist():
                c, d = find(comp[p]), find(comp[q])
                if c != d:
                    top[max(c, d)] = min(c, d)
                    a.append(ids[p])
                    b.append(ids[q])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links_of_large(now: DataFrame, bags: DataFrame) -> DataFrame:
    """Links that are left in large open buckets: ``key``, ``band``, ``id``, ``n``, ``comp`` of their documents.

    Most documents of such a bucket are in one component by now, and its inner pairs cannot change it.  Only the others
    ask, and each of them meets every document of the bucket; so a document is dealt once for each chunk of askers.
    """
    parts = materialize(now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(1 + F.col("n") / CHUNK_SHINGLES).alias("w")), "parts")
    chunks = lambda w: F.greatest(F.ceil(w / CHUNK), F.lit(1)).cast("int")
    total = parts.groupBy("key").agg(F.max(F.struct("c", "comp", "w")).alias("m"), F.sum("w").alias("w"))
    total = materialize(total.select("key", F.col("m.comp").alias("main"), chunks(F.col("w") - F.col("m.w")).alias("askers"), chunks(F.col("w")).alias("all")), "chunks")
    rows = now.join(total, "key").withColumn("rest", F.col("comp") != F.col("main"))
    h = F.xxhash64("id")
    i, j = F.pmod(h, "askers").cast("int"), F.pmod(h, "all").cast("int")
    to_all = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("asks")))
    asking = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("asks")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("rest"), F.concat(to_all, asking)).otherwise(to_all))).select("key", "band", "id", "n", "comp", "rest", "to.*")
    rows = rows.join(bags, "id")
    out = materialize(rows.groupBy("key", "i", "j").applyInArrow(_links_within, "a long, b long"), "links")
    release(parts)
    release(total)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of near-duplicate documents.

    Returns, for every row, ``doc_id``, ``copy_id`` (smallest identifier with the same multiset of shingles), ``class_id``
    (smallest identifier reachable by links of weighted Jaccard >= ``THRESHOLD``, its own included) and ``kept`` (it is that
    one).

    Documents with one to four words are one shingle, so they link to equal ones only; those without words, null texts
    included, link with nothing.  Identifiers are integers, or text that holds one, and are taken as unique: of different
    texts under one identifier, one is compared for all.  Rows with a null one stay alone, with a null class.  Whole texts
    are read, however long.  Extra columns are not read.  An empty table gives no rows.

    Documents with equal multisets are one class from the start.  Within a band, representatives first meet one pivot (a
    star, not all pairs), which gathers large groups of near copies.  Of buckets that still hold several components, small
    ones are compared by their pairs; in larger ones all documents outside the largest component meet the whole bucket,
    inside groups that give out links that join components rather than pairs.  Links inside a component cannot change it,
    so no class loses a link for which a band was found.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    some = rows.where("id is not null")
    sketches = materialize(sketch(some), "sketches")
    full = sketches.where("n > 0")
    copies = materialize(full.groupBy("print").agg(F.min("id").alias("rep")), "copies")
    # Representatives with the values of their own row; rows that share an identifier share the node, and one print speaks for it.
    reps = full.join(copies.groupBy(F.col("rep").alias("id")).agg(F.min("print").alias("print")), ["id", "print"], "left_semi").select("id", "print", "n", "keys", "low")
    reps = materialize(reps.dropDuplicates(["id"]), "reps")
    member = materialize(sketches.select("id", "print", "n").join(copies, "print", "left").select("id", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep")), "members")
    banded = reps.select("id", "n", F.posexplode("keys").alias("band", "key")).select("id", "n", "band", F.xxhash64("band", "key").alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n")).alias("p")).where("c > 1").select("key", F.col("p.id").alias("p"), F.col("p.n").alias("pn")), "shared")
    banded = materialize(banded.join(shared, "key"), "bands")
    bags = _bags(some.join(banded.select("id").distinct(), "id", "left_semi"))
    bags = materialize(bags.dropDuplicates(["id", "print"]).join(reps.select("id", "print", "low", "keys"), ["id", "print"]).drop("print"), "bags")
    low = reps.select("id", "low")

    def check(pairs: DataFrame) -> DataFrame:
        with_low = pairs.join(low.select(F.col("id").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("low_b")), "b")
        agreeing = materialize(_agree(with_low), "agreeing")
        out = materialize(_verify(agreeing, bags), "links")
        release(agreeing)
        return out

    of = lambda x, y: F.least(x, y) >= THRESHOLD * F.greatest(x, y)
    stars = check(banded.where((F.col("id") != F.col("p")) & of("n", "pn")).select(F.col("p").alias("a"), F.col("id").alias("b")).distinct())
    labels = components(stars)
    now = materialize(banded.drop("p", "pn").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "now")
    open_ = now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1").select("key", "size")
    open_ = materialize(open_, "open")
    few = now.join(open_.where(F.col("size") <= SMALL_BUCKET).select("key"), "key")
    other = few.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    pairs = few.join(other, "key").where((F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2")) & of("n", "n2")).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
    many = materialize(now.join(open_.where(F.col("size") > SMALL_BUCKET).select("key"), "key"), "many")
    small, large = check(pairs), _links_of_large(many, bags)
    release(labels)
    labels = components(stars.union(small).union(large))
    for old in (sketches, copies, reps, shared, banded, bags, stars, now, open_, many, small, large):
        release(old)
    out = member.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("id").alias("doc_id"), F.col("rep").alias("copy_id"), F.coalesce("component", "rep").alias("class_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    null = F.lit(None).cast("long")
    return out.union(rows.where("id is null").select(F.col("id"), null, null, F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps its smallest identifier; columns unchanged."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
