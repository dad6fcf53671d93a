"""Quality rules as a ledger of failure bits and measurements; built-in functions only.

Every rule is evaluated once for every document.  The ledger keeps the measurements and one ``failures`` number whose
bit ``k`` says that rule ``k`` failed; a policy is a named version with a mask of rules, so verdicts under any policy are
``failures & mask``, without reading a text again.  Ablations (what a policy rejects, and rejects only because of one
rule) are bit operations over counts of equal ledgers, of which there are at most ``2 ** len(RULES)``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import BLANKS, text_or_empty


@dataclass(frozen=True)
class Rule:
    name: str
    #: Over the measurements; must be true or false, never null.
    fails: str


#: The order is the bit order and is never changed; new rules go to the end.
RULES = (
    Rule("too_short", "n_words < 50"),
    Rule("repeats_itself", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_short", "repeats_itself"))
POLICIES = (BASE, Policy("v1", (*BASE.rules, "symbols", "shouting")), Policy("v2", tuple(r.name for r in RULES)))
DEFAULT = POLICIES[-1]
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeats(words: str) -> Column:
    """Words of the array column that lie in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash of their words.  Sorting the hashes shows whether any recurs; only then are
    they sorted with their places, so the usual text costs one sort of numbers.
    """
    w = F.col(words)
    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.array().cast("array<bigint>")).otherwise(hashes)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements (all long) as columns, and nothing else changed.

    They come out of a generator, below which the optimizer pushes no predicate on them: written out into such a predicate,
    the sorted arrays would be computed again for each of their elements.
    """
    text = text_or_empty(text_col)
    has_word = r"[^\x20\x09-\x0D]"
    out = docs.withColumn("_w", F.filter(F.split(text, BLANKS), lambda x: x != ""))
    out = out.withColumn("_h", _repeats("_w")).withColumn("_s", F.sort_array("_h"))
    s = F.col("_s")
    out = out.withColumn("_any", F.size(F.filter(s, lambda x, i: x == F.get(s, i - 1))) > 0)
    out = out.withColumn("_p", F.when(F.col("_any"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    same = lambda x, j: x["h"] == F.get(p, j)["h"]
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter(p, lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False))), lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word)))
    m = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(m)))


def _safe(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """The carried columns under names of our own, so that no column of the input clashes with the working ones."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)], F.col(text_col).alias("_text"))


def ledger(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ledger: carried columns (``doc_id`` by default), the measurements and ``failures`` (long, bit ``k``: rule ``k``).

    One row for each row, in one pass without shuffle.  A null or empty text has no words: all measurements are 0, and it
    fails ``too_short``.  Lines are split at ``\\n``; lines without a word never count as repeated.  Columns of the input
    with the names of measurements are ignored unless carried, which is refused.
    """
    carry = ["doc_id"] if carry is None else carry
    if clash := {*carry} & {*MEASURES, "failures"}:
        raise ValueError(f"carried columns clash with the ledger's: {sorted(clash)}")
    out = measure(_safe(docs, text_col, carry), "_text").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], *MEASURES)
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("failures", total.cast("long"))


def rejected(policy: Policy = DEFAULT, failures: Column | None = None) -> Column:
    f = F.col("failures") if failures is None else failures
    return f.bitwiseAND(F.lit(policy.mask)) != 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a boolean ``kept_<version>`` for each policy."""
    return book.select("*", *[(~rejected(p)).alias(f"kept_{p.version}") for p in policies])


def ablations(book: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that it alone rejects, and that stay if it is left out.

    The ledger is first counted by equal failure bits (at most 64 rows), so what is exploded does not grow with it.
    """
    counts = book.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    each = counts.select("failures", "n", F.inline(rules))
    left = F.lit(policy.mask).cast("long").bitwiseXOR(F.col("bit"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("failures").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(n(hit).alias("fail"), n(hit & (F.col("failures").bitwiseAND(left) == 0)).alias("only_this_rule"), n(F.col("failures").bitwiseAND(left) == 0).alias("kept_without"))


def keep_good(docs: DataFrame, policy: Policy = DEFAULT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns unchanged."""
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(names)])
    out = measure(inner, f"_c{names.index(text_col)}")
    bad = F.lit(False)
    for r in RULES:
        if r.name in policy.rules:
            bad = bad | F.expr(r.fails)
    return out.where(~bad).select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(names)])
