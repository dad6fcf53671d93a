"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The fixed patterns find assignments, access keys and long hexadecimal runs.  Beyond them, every value in a credential
context (``pwd: ...``, ``Authorization: Bearer ...``, ``scheme://user:...@``) is judged by how many guesses an attacker
needs: dynamic programming finds the cheapest segmentation into dictionary words, dates, repeats, keyboard walks,
sequences and brute-force spans, and values that cost at least ``10 ** MIN_LOG10`` guesses are reported as well.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import text_or_empty

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 10.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_ASSIGN_MARKS = ("passw", "secret", "token", "api")

CONTEXTS = (
    re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth)["']?\x20*(?::|=|=>)\x20*(?:"((?:[^"\\\n]|\\.){6,})"|'((?:[^'\\\n]|\\.){6,})'|["']?([^\s"'<>,;]{6,}))""", re.I | re.A),
    re.compile(r"""\bbearer\x20+([A-Za-z0-9+/_.=~-]{6,})""", re.I | re.A),
    re.compile(r"""(?<=[A-Za-z0-9+.-])://[^\s:/@"'<>]*:([^\s/@"'<>]{6,})@""", re.A),
)
_CONTEXT_MARKS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "://")

#: Strings that are guessed before any dictionary word; the rank is the number of guesses.
COMMON = """123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey
letmein shadow master 696969 michael mustang 666666 qwertyuiop 123321 654321 superman 1qaz2wsx 7777777 121212 000000 qazwsx
123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer harley batman andrew tigger sunshine iloveyou 2000
charlie robert thomas hockey ranger daniel starwars 112233 george computer michelle jessica pepper 1111 zxcvbn 555555 131313
freedom 777777 pass maggie 159753 aaaaaa ginger princess joshua cheese amanda summer love ashley 6969 nicole chelsea matthew
access yankees 987654321 dallas austin thunder taylor matrix welcome admin login root user guest test example changeme default
secret token key api private public client server system service account database backup production development staging local
passw0rd placeholder redacted none null true false your here xxxx value string enter insert replace todo demo sample temp dummy
the and for that with this from have not are was were been will would there their what about which when make like time just know
take people into year good some could them see other than then now look only come over think also back after use two how our work
first well way even new want because any these give day most us house water green black white blue red orange summer winter spring
autumn monday tuesday wednesday thursday friday january february march april june july august september october november december
apple banana correct horse battery staple correcthorse coffee music happy money family friend world hello secure security""".split()
#: Shortest dictionary word, and the longest that is looked up.
SHORTEST, LONGEST = 3, 24
#: A run of repeats, steps or keys is taken from any of its first so many places, and repeats with periods up to this many characters:
#: longer periods cost more than ``MIN_LOG10`` by themselves.
RUN_STARTS, PERIODS = 64, 10
_RANKS: dict[str | None, dict[str, int]] = {}


def ranks(dictionary: str | None) -> dict[str, int]:
    """Guesses for each word: the common strings, then the words of a vocabulary file in its order, which is that of frequency.

    ``dictionary``: a tokenizer file in JSON whose tokens mark the ends of words; its tokens of letters that close a word
    count.  None: the common strings only.
    """
    if dictionary not in _RANKS:
        words = list(COMMON)
        if dictionary is not None:
            with open(dictionary, encoding="utf-8") as f:
                model = json.load(f)["model"]
            end = model["end_of_word_suffix"]
            words += [w for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1]) if t.endswith(end) and SHORTEST <= len(w := t[: -len(end)]) <= LONGEST and w.isalpha()]
        _RANKS[dictionary] = {w: k + 1 for k, w in enumerate(dict.fromkeys(words))}
    return _RANKS[dictionary]


_LEET = str.maketrans("04135$@!7", "oaiessait")

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_PLACE = {c: (r, i + (0, 1.5, 1.75, 2.25)[r]) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.3


def _brute(c: str) -> float:
    """log10 of the alphabet that a guesser must go through for one character."""
    if c.isdigit():
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return 1.415  # 26
    return 1.519 if c < "\x80" else 2.0


def _case(part: str) -> float:
    upper = sum(c.isupper() for c in part)
    if not upper:
        return 0.0
    if upper == len(part) or upper == 1 and part[0].isupper():
        return 0.301
    return math.log10(sum(math.comb(len(part), k) for k in range(1, min(upper, len(part) - upper) + 1)) or 2)


def _runs(value: str, keys: str) -> tuple[list[int], list[int], dict[int, list[int]], list[int]]:
    """For each end: where the walk, the steps and the repeats of each period that end there begin; and row changes so far."""
    n = len(value)
    walk, step, same, turns = [0] * (n + 1), [0] * (n + 1), {p: [0] * (n + 1) for p in range(1, PERIODS + 1)}, [0] * (n + 1)
    for i in range(1, n):
        p, q = _PLACE.get(keys[i - 1]), _PLACE.get(keys[i])
        turns[i + 1] = turns[i] + (p is not None and q is not None and p[0] != q[0])
        walk[i + 1] = walk[i] if _near(keys[i - 1], keys[i]) and keys[i - 1] != keys[i] else i
        d = ord(value[i]) - ord(value[i - 1])
        step[i + 1] = i if abs(d) != 1 else step[i] if i - step[i] < 2 or ord(value[i - 1]) - ord(value[i - 2]) == d else i - 1
        for period, run in same.items():
            if i >= period:
                run[i + 1] = run[i] if value[i] == value[i - period] else i + 1 - period
    return walk, step, same, turns


def segment(value: str, dictionary: str | None = None, enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for ``value`` and the cheapest segmentation as (kind, start, end).

    Each position looks back over dictionary words up to the longest one, dates up to ten characters, brute force, and the
    repeats, walks and steps that end there, from each of the run's first places.  Time is linear in the length of the
    value; where no segmentation can cost less than ``enough``, it stops with a cost of at least that and no segments.
    """
    n, rank_of = len(value), ranks(dictionary)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(_LEET)
    keys = low.translate(_SHIFTED)
    walk, step, same, turns = _runs(value, keys)
    best: list[float] = [0.0] * (n + 1)
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute = [0.0]
    for c in value:
        brute.append(brute[-1] + _brute(c))
    dates: dict[int, list[int]] = {}
    for i in range(n - 3):
        if value[i].isdigit():
            if m := _DATE.match(value, i):
                dates.setdefault(m.end(), []).append(i)
            if value[i : i + 2] in ("19", "20") and value[i + 2 : i + 4].isdigit():
                dates.setdefault(i + 4, []).append(i)
    free = 0.0  # cheapest start of a brute-force span, less what is brute before it
    free_at = 0
    reach = 0  # no run, word or date that begins below ``enough`` ends beyond
    for end in range(1, n + 1):
        cost, how = free + brute[end], ("brute", free_at)
        for size in range(1 if end == 1 else SHORTEST, min(end, LONGEST) + 1):
            at = end - size
            rank, extra = rank_of.get(low[at:end]), 0.0
            if rank is None:
                rank, extra = rank_of.get(plain[at:end]), 0.602
            if rank is not None and (c := best[at] + math.log10(rank + 1) + _case(value[at:end]) + extra) < cost:
                cost, how = c, ("word", at)
        for at in dates.get(end, ()):
            if (c := best[at] + (2.1 if end - at == 4 else 4.6)) < cost:
                cost, how = c, ("date", at)
        for at in range(walk[end], min(end - 4, walk[end] + RUN_STARTS - 1) + 1):
            if (c := best[at] + math.log10(47 * (end - at)) + 0.7 * (1 + turns[end] - turns[at + 1])) < cost:
                cost, how = c, ("walk", at)
        for at in range(step[end], min(end - 3, step[end] + RUN_STARTS - 1) + 1):
            if (c := best[at] + 1.5 + math.log10(end - at)) < cost:
                cost, how = c, ("sequence", at)
        for p, run in same.items():
            for at in range(run[end], min(end - max(3, 2 * p), run[end] + RUN_STARTS - 1) + 1):
                if (c := best[at] + brute[at + p] - brute[at] + math.log10((end - at) / p + 1)) < cost:
                    cost, how = c, ("repeat", at)
        best[end], back[end] = cost, how
        if cost + 0.301 - brute[end] < free:
            free, free_at = cost + 0.301 - brute[end], end
        if cost < enough:
            reach = end
        elif free + brute[end] >= enough and end - reach >= LONGEST and walk[end] > reach and step[end] > reach and all(run[end] > reach for run in same.values()):
            return cost, []
    parts, end = [], n
    while end:
        kind, at = back[end]
        parts.append((kind, at, end))
        end = at
    return best[n], parts[::-1]


@lru_cache(maxsize=20_000)
def guess_cost(value: str, dictionary: str | None = None, enough: float = math.inf) -> float:
    """log10 of the guesses needed for ``value``; exact below ``enough``."""
    return segment(value, dictionary, enough)[0]


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    low = text.lower() if low is None else low
    out = []
    if any(m in low for m in _ASSIGN_MARKS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"\1" * 24 in text.encode().translate(_HEX_BYTES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan_text(text: str, min_log10: float = MIN_LOG10, dictionary: str | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The spans of the fixed patterns, and all spans, as (start, kind, end) in order."""
    low = text.lower()
    base = base_spans(text, low)
    more = set()
    if any(m in low for m in _CONTEXT_MARKS):
        for context in CONTEXTS:
            for m in context.finditer(text):
                g = m.lastindex  # a quoted value runs to its closing quote
                if guess_cost(m[g], dictionary, min_log10) >= min_log10:
                    more.add((m.start(g), 3, m.end(g)))
    return base, sorted({*base, *more}) if more else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_log10: float = MIN_LOG10, dictionary: str | None = None, with_text: bool = False) -> DataFrame:
    """The spans of secrets in every whole text.

    Returns ``id_col``, ``n_assign``, ``n_access``, ``n_hex``, ``n_guess`` (long), ``base_spans`` and ``spans`` (``kind:start:end``
    by start, then kind, joined by commas; code points, end exclusive), with ``with_text`` also ``redacted``.

    ``dictionary``: see :func:`ranks`.  A null text counts as empty: no spans.  One row for each row, one pass, no shuffle;
    texts are read whole, however long; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            base_out, out, clean = [], [], []
            for text in batch.column(1).to_pylist():
                base, spans = scan_text(text, min_log10, dictionary)
                for k in range(4):
                    n[k].append(sum([s[1] == k for s in spans]) if spans else 0)
                base_out.append(written(base))
                out.append(written(spans))
                if with_text:
                    clean.append(redact(text, spans))
            cols = {id_col: batch.column(0)} | {f"n_{KINDS[k]}": pa.array(n[k], pa.int64()) for k in range(4)}
            cols |= {"base_spans": pa.array(base_out, pa.string()), "spans": pa.array(out, pa.string())}
            if with_text:
                cols["redacted"] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_spans string, spans string" + (", redacted string" if with_text else "")
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def redact_table(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", *, min_log10: float = MIN_LOG10, dictionary: str | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``, and ``length_col`` (if it is a column) set to the new length of changed texts.

    ``dictionary``: see :func:`ranks`.  Null and empty texts stay as they are; every row stays, repeated ones too; texts are
    read whole, however long; an empty table gives no rows.
    """
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            lengths = batch.column(length_at).to_pylist() if length_at is not None else None
            changed = False
            for k, text in enumerate(texts):
                if text and (spans := scan_text(text, min_log10, dictionary)[1]):
                    texts[k], changed = redact(text, spans), True
                    if lengths is not None:
                        lengths[k] = len(texts[k])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if lengths is not None:
                    batch = batch.set_column(length_at, batch.schema.field(length_at), pa.array(lengths, batch.schema.field(length_at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
