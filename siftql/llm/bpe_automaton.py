"""Byte-pair encoding and decoding by a tokenization automaton.

The merge list is compiled, rule by rule in order of rank, into a deterministic automaton over *tokens* whose paths
are exactly the token sequences that the merge procedure yields (Berglund, Martens and van der Merwe, 2024).

It starts with one state and a loop for every byte.  The gadget for a rule ``u + v -> uv`` works on each state that a
``u`` arc enters and that has a ``v`` arc: the state is split, ``u`` arcs are sent to the copy, the copy loses its ``v``
arc, and every state with a ``u`` arc gets a ``uv`` arc to where ``v`` led.  By induction all arcs with one label enter
one state, so a state is named by a label and is the chain of splits that its label has been through; a new label
``uv`` starts with the chain that ``v`` had at that moment, and has arcs only from states that still had ``u``.

Two consequences make the table small and the walk deterministic:

* ``delta(state(a), b)`` is missing iff some rule ``(s, t)`` has ``s`` on the right spine of ``a`` and ``t`` on the left
  spine of ``b``, and came before the rule that built the next larger element of either spine.  The transition table is
  lazy: rows are filled in when a pair is first seen, and kept.
* Every prefix of a word has exactly one path, so a walk needs one (token, state) per byte position.

Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import TwoGenerations, text_or_empty

#: Pairs in the transition table of one worker; beyond it the table is filled anew.
TABLE_LIMIT = 200_000
#: Distinct space-separated pieces that a worker remembers in each of two generations.
PIECE_LIMIT = 200_000
WORD_LIMIT = 100_000
_FAR = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TokenAutomaton:
    """The compiled merges of a byte-level vocabulary file."""

    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label: dict[int, bytes] = {}
        for text, i in model["vocab"].items():
            if text not in self.special:
                self.label[i] = bytes(letters[c] for c in text)
        self.arc_of = {b: i for i, b in self.label.items()}
        self.emit = self.label | {i: s.encode() for s, i in self.special.items()}
        self.rule: dict[tuple[int, int], int] = {}
        # For each label, its chain of splits: (label whose rules split it, rules that count are of a rank below this).
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        for b in range(256):
            if (i := self.arc_of.get(bytes([b]))) is not None:
                self.right[i] = self.left[i] = ((i, _FAR),)
        vocab = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            u_text, v_text = merge if isinstance(merge, (list, tuple)) else merge.split(" ")
            self._gadget(vocab[u_text], vocab[v_text], vocab[u_text + v_text], rank)
        self.longest = max(map(len, self.arc_of), default=1)
        self.table: dict[int, bool] = {}
        self.wide = max(self.label, default=0) + 1

    def _gadget(self, u: int, v: int, uv: int, rank: int) -> None:
        if (u, v) in self.rule:
            return
        self.rule[u, v] = rank
        if uv in self.right:  # built by an earlier rule already
            return
        self.right[uv] = ((uv, _FAR), *((s, min(t, rank)) for s, t in self.right[v]))
        # When u = v the copy has lost its u arc before uv arcs are dealt out, hence rank + 1.
        self.left[uv] = ((uv, _FAR), *((s, min(t, rank + (1 if u == v and s == u else 0))) for s, t in self.left[u]))

    def has_arc(self, a: int, b: int) -> bool:
        """Whether the state that ``a`` enters has an arc ``b``."""
        key = a * self.wide + b
        known = self.table.get(key)
        if known is None:
            known = self.find_arc(a, b)
            if len(self.table) >= TABLE_LIMIT:
                self.table.clear()
            self.table[key] = known
        return known

    def find_arc(self, a: int, b: int) -> bool:
        """``has_arc`` from the chains of splits."""
        rule = self.rule
        for s, before_s in self.right[a]:
            for t, before_t in self.left[b]:
                r = rule.get((s, t))
                if r is not None and r < before_s and r < before_t:
                    return False
        return True

    def walk(self, word: bytes) -> tuple[list[int], list[int]]:
        """For each prefix of ``word``, the last arc of its path and the length of the path (at 0: -1 and 0)."""
        n, arc_of, table, wide, longest = len(word), self.arc_of, self.table, self.wide, self.longest
        last, count, start = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for at in range(max(0, end - longest), end):
                b = arc_of.get(word[at:end])
                if b is None:
                    continue
                if at:
                    a = last[at]
                    ok = table.get(a * wide + b)
                    if ok is None:
                        ok = self.has_arc(a, b)
                    if not ok:
                        continue
                last[end], count[end], start[end] = b, count[at] + 1, at
                break
            else:
                raise ValueError(f"no path for {word[:end]!r}: a byte is missing from the vocabulary")
        self.start = start
        return last, count

    def encode_word(self, word: bytes) -> list[int]:
        last, _ = self.walk(word)
        start, out, at = self.start, [], len(word)
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return out

    def decode(self, ids) -> bytes:
        emit = self.emit
        return b"".join([emit[i] for i in ids])


class BatchWalker:
    """Walks of many words at once, with the arcs' labels in a trie and the transition table in arrays."""

    LONGEST = 40  # bytes; longer words are walked one by one
    SLOTS = 1 << 21

    def __init__(self, auto: TokenAutomaton):
        self.auto = auto
        nodes: dict[bytes, int] = {b"": 0}
        for label in auto.arc_of:
            for k in range(1, len(label) + 1):
                nodes.setdefault(label[:k], len(nodes))
        self.next = np.full((len(nodes), 256), -1, np.int32)
        for prefix, node in nodes.items():
            if prefix:
                self.next[nodes[prefix[:-1]], prefix[-1]] = node
        self.token = np.full(len(nodes), -1, np.int32)
        for label, i in auto.arc_of.items():
            self.token[nodes[label]] = i
        self.next = self.next.reshape(-1)
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.has = np.zeros(self.SLOTS, bool)

    def allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``has_arc`` of many pairs: a direct-mapped table, filled where a pair is missing."""
        key = a.astype(np.int64) * self.auto.wide + b
        slot = (key * 0x9E3779B1 >> 7) & (self.SLOTS - 1)
        out = self.has[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            wide, has_arc = self.auto.wide, self.auto.find_arc
            value = np.array([has_arc(k // wide, k % wide) for k in new.tolist()], bool)
            out[miss] = value[back]
            at = (new * 0x9E3779B1 >> 7) & (self.SLOTS - 1)
            self.keys[at], self.has[at] = new, value
            # Of several new pairs for one slot the last stays, in both arrays.
        return out

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``last``, ``count``, ``start`` of every prefix, a row for each word, words at most ``LONGEST`` bytes."""
        size = np.array([len(w) for w in words])
        m, n = len(words), int(size.max(initial=0))
        raw = np.zeros((m, n), np.uint8)
        raw[np.arange(n) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last, count, start = np.full((m, n + 1), -1, np.int32), np.zeros((m, n + 1), np.int16), np.zeros((m, n + 1), np.int8)
        for at in range(n):
            rows = np.flatnonzero(size > at)
            node = np.zeros(len(rows), np.int32)
            for end in range(at + 1, n + 1):
                node = self.next[(node << 8) + raw[rows, end - 1]]
                on = (node >= 0) & (size[rows] >= end)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                tok = self.token[node]
                some = np.flatnonzero(tok >= 0)
                if not len(some):
                    continue
                r, t = rows[some], tok[some]
                if at:
                    ok = self.allowed(last[r, at], t)
                    r, t = r[ok], t[ok]
                last[r, end], start[r, end], count[r, end] = t, at, count[r, at] + 1
        if (last[np.arange(m), size] < 0).any() and size.min(initial=1) > 0:
            raise ValueError("a byte is missing from the vocabulary")
        return last, count, start

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= self.LONGEST]
        if short:
            last, count, start = self.walk([words[k] for k in short])
            m = len(short)
            at = np.array([len(words[k]) for k in short])
            n = count[np.arange(m), at].astype(np.int64)
            ids = np.zeros((m, max(int(n.max()), 1)), np.int32)
            to, rows = n - 1, np.arange(m)
            while len(rows := rows[at[rows] > 0]):
                ids[rows, to[rows]] = last[rows, at[rows]]
                at[rows], to[rows] = start[rows, at[rows]], to[rows] - 1
            for k, row, c in zip(short, ids.tolist(), n.tolist()):
                out[k] = row[:c]
        for k, w in enumerate(words):
            if out[k] is None:
                out[k] = self.auto.encode_word(w)
        return out


class ByteLevelSplitter:
    """Pre-splitting of byte-level vocabularies, in pieces that can be cached.

    A single space between two non-blanks always opens a word of its own, so a text is the concatenation of its
    space-separated pieces; texts with other blanks around a space are split as a whole.
    """

    def __init__(self, pattern: str, special: dict[str, int]):
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}")).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.marks = list(special)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """(part, is a special string) in order."""
        if self.special is None or not any(m in text for m in self.marks):
            return [(text, False)] if text else []
        return [(p, i % 2 == 1) for i, p in enumerate(self.special.split(text)) if p]

    @staticmethod
    def keys(text: str) -> list:
        """The space-separated pieces of a text: the first as a tuple, those after a space as they are."""
        parts = text.split(" ")
        parts[0] = (parts[0],)
        return parts

    @staticmethod
    def spelled(key) -> str | None:
        """The characters that a key stands for; None if it begins or ends with a blank, so that its words depend on its neighbours."""
        text = key[0] if key.__class__ is tuple else key
        # isspace() is true of more characters than the pattern's blanks, which only costs time.
        if not text or text[0].isspace() or text[-1].isspace():
            return None
        return text if key.__class__ is tuple else " " + text


class PieceCache:
    """What a worker remembers of words and pieces; ``of_words(words)`` and ``of_piece(words, values)`` make it."""

    def __init__(self, splitter: ByteLevelSplitter, of_words, of_piece, words: int, pieces: int):
        self.split, self.of_words, self.of_piece = splitter, of_words, of_piece
        self.words, self.pieces = TwoGenerations(words), TwoGenerations(pieces)

    def value(self, text: str):
        """The value of a text that is split as a whole."""
        words = self.split.words(text)
        known = self.words.fetch(set(words), self.of_words)
        return self.of_piece(text, words, [known[w] for w in words])

    def _make(self, keys: list) -> list:
        texts = [self.split.spelled(k) for k in keys]
        words = [None if t is None else self.split.words(t) for t in texts]
        known = self.words.fetch({w for ws in words if ws for w in ws}, self.of_words)
        values = [None if ws is None else [known[w] for w in ws] for ws in words]
        return [None if ws is None else self.of_piece(t, ws, v) for t, ws, v in zip(texts, words, values)]

    def batch(self, texts: list[str], most: int = 150_000) -> Iterator[list]:
        """For each text, the values of its pieces in order."""
        at = 0
        while at < len(texts):  # some texts at a time: few calls, and a bounded set of keys
            keys, size = [], 0
            while at < len(texts) and size < most:
                keys.append(self.split.keys(texts[at]))
                size += len(keys[-1])
                at += 1
            known = self.pieces.fetch(set().union(*keys), self._make)
            for k, text in zip(keys, texts[at - len(keys) : at]):
                got = [known[p] for p in k]
                yield got if None not in got else [self.value(text)] if text else []


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_LOADED: dict[str, tuple] = {}


def coder(path: str):
    """The automaton and splitter for ``path``, compiled once in each worker."""
    if path not in _LOADED:
        spec = load_spec(path)
        _LOADED[path] = (TokenAutomaton(spec), ByteLevelSplitter(BYTE_LEVEL_PATTERN, {t["content"]: t["id"] for t in spec.get("added_tokens", [])}))
    return _LOADED[path]


#: What byte-level pre-tokenizers with ``use_regex`` split by.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Encoder:
    """Pieces to (ids as decimal text, number of ids, decoded bytes), remembered."""

    def __init__(self, path: str):
        self.auto, self.split = coder(path)
        self.walker = BatchWalker(self.auto)
        self.cache = PieceCache(self.split, lambda words: self.walker.encode([w.encode() for w in words]), self._piece, WORD_LIMIT, PIECE_LIMIT)

    def _piece(self, text: str, words: list[str], values: list[list[int]]):
        ids = [i for v in values for i in v]
        return ",".join(map(str, ids)), len(ids), self.auto.decode(ids)

    def encode_batch(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        plain = [not any(m in t for m in self.split.marks) for t in texts]
        whole = self.cache.batch([t for t, p in zip(texts, plain) if p])
        for text, p in zip(texts, plain):
            if p:
                yield next(whole)
            else:
                out: list = []
                for part, is_special in self.split.segments(text):
                    if is_special:
                        i = self.auto.special[part]
                        out.append((str(i), 1, self.auto.emit[i]))
                    else:
                        out += next(self.cache.batch([part]))
                yield out


_ENCODERS: dict[str, _Encoder] = {}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``id_col``, ``n_tokens`` (long), ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded text in UTF-8); with ``with_text`` also ``ids`` (array of int) and ``decoded``.

    ``path``: a byte-level BPE file.  Null texts count as empty: no ids, the digest of no bytes.  Rows are never
    dropped or merged; equal rows give equal results; columns other than the two named are not read.  Texts are read
    whole, however long, and an empty table gives no rows.  One pass, no shuffle; a worker holds the automaton and bounded caches, whatever the input size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = _Encoder(path)
        enc = _ENCODERS[path]
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, ids, back = [], [], [], [], []
            for parts in enc.encode_batch(batch.column(1).to_pylist()):
                joined = ",".join([p[0] for p in parts])
                decoded = b"".join([p[2] for p in parts])
                n.append(sum([p[1] for p in parts]))
                a.append(sha(joined.encode()).hexdigest())
                b.append(sha(decoded.decode("utf-8", "replace").encode()).hexdigest())
                if with_text:
                    ids.append([int(i) for i in joined.split(",")] if joined else [])
                    back.append(decoded.decode("utf-8", "replace"))
            cols = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if with_text:
                cols |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_text else ""
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
