"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a word ``w`` and a vocabulary of merges, let ``last(i)`` be the last token of the encoding of ``w[:i]``.  Then
``count(i) = count(i - |t|) + 1`` for the one token ``t`` that ends at ``i`` and may follow ``last(i - |t|)``: the table
of a word gives the exact count at all its prefixes in one pass.  A text's table is that of its words in sequence, as
differences between neighbouring code-point prefixes, so that a running sum answers every truncation or budget
question without encoding anything again.

A prefix may be split differently from the whole text at its very end.  Blanks before a word (``"a  b"``): all prefixes
that end in a run of blanks read off the table of the run as one word, so a long run costs no more than its length.  Cut
contractions (``"'r"`` of ``"'re"``): these few ends are split again from the word before.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import text_or_empty
from siftql.llm.bpe_automaton import WORD_LIMIT, BatchWalker, PieceCache, coder

PIECE_LIMIT = 300_000


def _blank(c: str) -> bool:
    """Whether the splitting pattern takes a character for a blank."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class PrefixCounter:
    def __init__(self, path: str):
        self.auto, self.split = coder(path)
        self.walker = BatchWalker(self.auto)
        self.cache = PieceCache(self.split, self._of_words, self._of_piece, WORD_LIMIT, PIECE_LIMIT)

    def _of_words(self, words: list[str]) -> list[list[int]]:
        """The counts at the code-point prefixes of each word, from 1 on."""
        raw = [w.encode() for w in words]
        out: list = [None] * len(words)
        short = [k for k, r in enumerate(raw) if len(r) <= self.walker.LONGEST]
        if short:
            for k, row in zip(short, self.walker.walk([raw[k] for k in short])[1].tolist()):
                out[k] = row
        for k, (w, r) in enumerate(zip(words, raw)):
            row = self.auto.walk(r)[1] if out[k] is None else out[k]
            if len(r) == len(w):
                out[k] = row[1 : len(r) + 1]
            else:
                ends, at = [], 0
                for c in w:
                    at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                    ends.append(row[at])
                out[k] = ends
        return out

    def _whole(self, text: str) -> int:
        words = self.split.words(text)
        known = self.cache.words.fetch(set(words), self._of_words)
        return sum([known[w][-1] for w in words])

    def _of_piece(self, text: str, words: list[str], tables: list[list[int]]) -> tuple[bytes, int]:
        """The counts of a piece as differences (two bytes each, little-endian), and their sum."""
        counts: list[int] = []
        total, begin, before, back = 0, 0, "", 0
        run, run_base = "", 0  # blanks just before, and the tokens before them
        for w, own in zip(words, tables):
            if run and _blank(w[0]):  # prefixes that end in these blanks have the whole run as one word
                lead = len(w) if all(map(_blank, w)) else 1
                longer = run + w[:lead]
                counts += [run_base + c for c in self.cache.words.fetch((longer,), self._of_words)[longer][len(run) :]]
                counts += [total + c for c in own[lead:]]
            elif w[0] == "'" and len(w) > 2:
                start, base = (begin - len(before), total - back) if before else (begin, total)
                counts += [base + self._whole(text[start : begin + k]) for k in range(1, len(w) + 1)]
            else:
                counts += [total + c for c in own] if total else own
            if (len(w) == 1 or run or not w[1].isalnum()) and all(map(_blank, w)):
                run, run_base = (run + w, run_base) if run else (w, total)
            else:
                run = ""
            begin += len(w)
            back = own[-1]  # of the word alone, as it counts in longer prefixes
            total += back
            before = w
        diffs = array("h", [b - a for a, b in zip([0, *counts], counts)])
        if sys.byteorder == "big":
            diffs.byteswap()
        return diffs.tobytes(), total

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, int]]:
        """For each text, the differences over its prefixes and its number of tokens."""
        plain = [not any(m in t for m in self.split.marks) for t in texts]
        whole = self.cache.batch([t for t, p in zip(texts, plain) if p])
        for text, p in zip(texts, plain):
            out: list[tuple[bytes, int]] = []
            if p:
                out = next(whole)
            else:
                for part, is_special in self.split.segments(text):
                    got = next(self.cache.batch([part]))
                    if is_special:  # its proper prefixes are ordinary text
                        diffs = np.frombuffer(b"".join([x[0] for x in got]), "<i2").copy()
                        diffs[-1] += 1 - sum([x[1] for x in got])
                        got = [(diffs.tobytes(), 1)]
                    out += got
            yield b"".join([x[0] for x in out]), sum([x[1] for x in out])

    def table(self, text: str) -> tuple[bytes, int]:
        return next(self.batch([text]))


def counts_of(table: bytes) -> np.ndarray:
    """The number of tokens of each prefix, from the empty one on."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, "<i2"), dtype=np.int64)])


def longest_within(table: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens (counts are not monotone: the last such prefix)."""
    return int(np.flatnonzero(counts_of(table) <= budget)[-1])


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, budgets: tuple[int, ...] = (), keep_table: bool = True) -> DataFrame:
    """Token counts of every whole text at every prefix.

    Returns ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` (both long), with ``keep_table`` the column ``prefix_table``
    (binary; see :func:`counts_of`), and for each budget ``b`` a column ``chars_within_<b>``: code points of the longest
    prefix of at most ``b`` tokens, read off the table.

    An empty table gives no rows; a text of any length is read whole, in time linear in its length.  Null texts count as
    empty (0 bytes, 0 tokens).  Special strings inside a text are one token each, as the library
    has it; inside such a string prefixes count as ordinary text.  Rows are kept one to one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = PrefixCounter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tables, totals = [], []
            within: list[list[int]] = [[] for _ in budgets]
            for text, (table, n) in zip(texts, counter.batch(texts)):
                totals.append(n)
                if keep_table:
                    tables.append(table)
                for k, b in enumerate(budgets):
                    within[k].append(longest_within(table, b) if n > b else len(text))
            cols = {id_col: batch.column(0), "n_bytes": batch.column(2), "n_tokens": pa.array(totals, pa.int64())}
            if keep_table:
                cols["prefix_table"] = pa.array(tables, pa.binary())
            cols |= {f"chars_within_{b}": pa.array(within[k], pa.int64()) for k, b in enumerate(budgets)}
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long" + (", prefix_table binary" if keep_table else "") + "".join(f", chars_within_{b} long" for b in budgets)
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, schema)


def over_budget(n_tokens: Column, budget: int) -> Column:
    return n_tokens > F.lit(budget)
