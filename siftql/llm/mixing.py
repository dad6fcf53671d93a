"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's words are laid out in shards (by a seeded hash of the document), each shard in blocks of ``BLOCK_WORDS``.
Seats are blocks: the highest quotients ``target / (2 * seats + 1)`` deal them to sources, and each source's seats to its
shards by the shards' words.  A shard with ``n`` blocks and ``q`` seats takes every block ``q // n`` times and then
``q % n`` blocks more, evenly spaced from a seeded start.  Since whole passes and the count of chosen blocks before a
position have closed forms, a document's words follow from its place in its shard; no block is ever a row.
"""

from __future__ import annotations

import heapq
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftql.llm._shared import BLANKS, materialize, text_or_empty

BLOCK_WORDS = 32
SHARD_WORDS = 16_384
#: Shards over all sources, besides one for each source; with it the plan that is broadcast has a known size.
MAX_SHARDS = 65_536
#: More distinct sources than this are refused, since their totals go through the driver.
MAX_SOURCES = 200_000
MAX_REPEATS = 3
#: Groups of documents by draw, over all sources, besides one for each source, that rounding to whole copies sums up.
DRAWS = 65_536


def word_count(text_col: str = "text") -> Column:
    return F.size(F.filter(F.split(text_or_empty(text_col), BLANKS), lambda x: x != "")).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``repeats`` times its size; the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes)], float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportion(claims: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague: each seat goes to the highest ``claim / (2 * got + 1)`` (the first on ties) that is below its maximum."""
    total, k = sum(claims), len(claims)
    got = [0] * k
    if total <= 0 or seats <= 0:
        return got
    # A divisor that deals at most all seats; the rest, fewer than the claims, by quotients.
    if seats > k / 2:
        unit = total / (seats - k / 2)
        got = [min(most[i], max(0, math.floor(claims[i] / unit + 0.5))) for i in range(k)]
    heap = [(-claims[i] / (2 * got[i] + 1), i) for i in range(k) if claims[i] > 0 and got[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i))
    return got


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, weights: tuple[float, ...] = (1, 2, 3), repeats: int = MAX_REPEATS, seed: int = 17, carry: list[str] | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    Sources in order of code points (null last) have the given weights in turn.  Returns ``id_col``, ``size`` (words),
    ``source_size``, ``target`` (double, of its source), ``taken`` (long, repeats counted), and the ``carry`` columns as
    ``carried`` (struct) if any are named.

    A null or empty text has size 0 and takes 0; rows with a null or repeated identifier count like any others, and rows
    equal in identifier and size are interchangeable.  An empty table gives no rows.  What is collected and broadcast is
    one number for each source and shard, at most ``MAX_SOURCES + MAX_SHARDS``.  Documents shuffle once, by shard, without
    their texts; a source with most of the rows has most of the shards.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))  # the text spreads rows that share an identifier
    more = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(text_col).alias("_size"), h.alias("_h"), *more)
    sums = rows.groupBy("_source").agg(F.sum("_size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = sorted(sums, key=lambda r: (r._source is None, r._source or ""))
    total = sum(r["size"] for r in sums)
    aim = targets([r["size"] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], repeats) if sums else []
    shard_words = max(SHARD_WORDS, -(-total // MAX_SHARDS))
    of_source = [(r._source, i, r["size"], aim[i], max(1, r["size"] // shard_words)) for i, r in enumerate(sums)]
    plan = F.broadcast(spark.createDataFrame(of_source, "_key string, _n int, source_size long, target double, _shards long"))
    rows = rows.join(plan, F.col("_source").eqNullSafe(F.col("_key"))).withColumn("_shard", F.pmod(F.xxhash64("_h"), F.col("_shards")))
    sizes = {(r._n, r._shard): r["size"] for r in rows.groupBy("_n", "_shard").agg(F.sum("_size").alias("size")).collect()}
    seats = round(total / BLOCK_WORDS)
    blocks = {k: -(-v // BLOCK_WORDS) for k, v in sizes.items()}
    by_source: dict[int, list] = {}
    for k in sorted(sizes):
        by_source.setdefault(k[0], []).append(k)
    dealt = apportion(aim, seats, [repeats * sum(blocks[k] for k in by_source.get(i, ())) for i in range(len(sums))])
    quotas, draw = [], random.Random(seed)
    for i, keys in sorted(by_source.items()):
        for k, q in zip(keys, apportion([float(sizes[k]) for k in keys], dealt[i], [repeats * blocks[k] for k in keys])):
            n = max(1, blocks[k])
            quotas.append((k[0], k[1], q // n, q % n, n, draw.randrange(n)))
    quota = F.broadcast(spark.createDataFrame(quotas, "_n int, _shard long, _passes long, _extra long, _blocks long, _start long"))
    w = Window.partitionBy("_n", "_shard").orderBy("_h", "_id", "_size")
    # Rows that are equal in the order still need places of their own.
    rows = rows.withColumn("_end", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(quota, ["_n", "_shard"])

    def chosen_before(x: Column) -> Column:
        """Words in chosen blocks before word ``x`` of the shard."""
        k = F.floor(x / F.lit(BLOCK_WORDS)).cast("long")
        count = lambda b: (b * F.col("_extra") + F.col("_start")).cast("long")
        whole = F.expr("1L") * F.floor(count(k).cast("decimal(38,0)") / F.col("_blocks")).cast("long")
        next_ = F.floor(count(k + 1).cast("decimal(38,0)") / F.col("_blocks")).cast("long")
        return whole * BLOCK_WORDS + (next_ - whole) * (x - k * BLOCK_WORDS)

    taken = F.col("_passes") * F.col("_size") + chosen_before(F.col("_end")) - chosen_before(F.col("_end") - F.col("_size"))
    return rows.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"), *(["carried"] if carry else []))


def round_long(rows: list[tuple[int, int]]) -> tuple[list[bool], int]:
    """Whether each of (size, words beyond whole copies) gets a copy more, keeping the running remainder least; and that remainder."""
    out, left = [], 0
    for size, extra in rows:
        left += extra
        out.append(2 * left >= size)
        left -= size * out[-1]
    return out, left


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 17, **options) -> DataFrame:
    """The mix as rows of ``docs``: each document in as many whole copies as it is taken, and one more for some of the rest.

    The words beyond whole copies are made up for by source.  Documents longer than a shard, at most ``MAX_SHARDS``, are
    rounded from the longest with a running remainder; what that leaves is added to what the others have to give, which
    get a copy more in the order of a seeded draw over their fraction, until the words are reached.  So a source's words
    are off from what :func:`mix` takes by at most half of one document that is no longer than a shard, unless all or none
    of these get a copy more; then by at most half the source's longest document more.  Columns are those of ``docs``, of which
    ``id_col`` and ``text_col`` may be named; documents without a word, null texts included, are never taken.  Rows that are
    repeated are rounded each by itself; an empty table gives no rows.
    """
    names = docs.columns
    got = mix(docs, id_col, source_col, text_col, seed=seed, carry=names, **options).where("size > 0")
    u = (F.pmod(F.xxhash64(F.col("carried")[id_col], F.col("carried")[text_col], F.lit(seed + 1)), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
    got = got.select(
        "carried", "size", F.expr("taken div size").alias("_whole"), F.pmod("taken", "size").alias("_extra"), u.alias("_u"),
        F.coalesce(F.concat(F.lit("s"), F.col("carried")[source_col].cast("string")), F.lit("")).alias("_s"),
    )
    draw = F.col("_u") * F.col("size") / F.greatest("_extra", F.lit(1))
    got = materialize(got.withColumn("_draw", draw), "mix-taken")
    sums = got.agg(F.sum("size").alias("n"), F.count_distinct("_s").alias("s")).first()
    most, groups = max(SHARD_WORDS, -(-int(sums.n or 0) // MAX_SHARDS)), 1 + DRAWS // max(1, sums.s)
    some = got.where("_extra > 0")
    order = Window.partitionBy("_s", "size", "_draw").orderBy("_extra")
    long = some.where(F.col("size") > most).withColumn("_k", F.row_number().over(order))
    group = F.floor(groups * F.col("_draw") / (1 + F.col("_draw"))).cast("int")
    short = some.where(F.col("size") <= most).withColumn("_group", group)
    by_source: dict[str, list] = {}
    for r in long.select("_s", "size", "_draw", "_k", "_extra").collect():
        by_source.setdefault(r._s, []).append(r)
    more, left = [], {}
    for key, rows in by_source.items():
        rows.sort(key=lambda r: (-r["size"], r._draw, r._k))
        chosen, left[key] = round_long([(r["size"], r._extra) for r in rows])
        more += [(key, r["size"], r._draw, r._k) for r, c in zip(rows, chosen) if c]
    of_group: dict[str, list] = {}
    for r in short.groupBy("_s", "_group").agg(F.sum("size").alias("n"), F.sum("_extra").alias("e")).collect():
        of_group.setdefault(r._s, []).append((r._group, r.n, r.e))
    cuts = []  # of each source: the group in which the words are reached, and how many of it are needed
    for key, rows in of_group.items():
        need = left.get(key, 0) + sum(e for _, _, e in rows)
        for g, n, _ in sorted(rows):
            if need <= n:
                break
            need -= n
        else:
            need += n  # more than all of them give
        cuts.append((key, g, need))
    spark = docs.sparkSession
    short = short.join(F.broadcast(spark.createDataFrame(cuts, "_s string, _cut int, _need long")), "_s")
    run = Window.partitionBy("_s").orderBy("_draw", "size", "_extra").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = short.where("_group = _cut").withColumn("_upto", F.sum("size").over(run)).where("2 * (_upto - size) + size <= 2 * _need")
    long = long.join(F.broadcast(spark.createDataFrame(more, "_s string, size long, _draw double, _k int")), ["_s", "size", "_draw", "_k"])
    copies = got.where("_whole > 0").select("carried", F.explode(F.sequence(F.lit(1), F.col("_whole").cast("int")))).select("carried")
    for part in (short.where("_group < _cut"), at_cut, long):
        copies = copies.union(part.select("carried"))
    return copies.select(*[F.col("carried")[c].alias(c) for c in names])
