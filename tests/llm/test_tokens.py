import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftql.llm import bpe_automaton, prefix_counts, queries, sorted_tables
from siftql.llm._shared import new_path, read_table

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTES)


def test_automaton_and_prefix_counts_match_the_library(spark, odd, nothing, lib, sf):
    for docs in (odd, read_table(spark, sf, "documents")):
        want = {}
        for r in docs.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            joined = ",".join(map(str, ids)).encode()
            want.setdefault(r.doc_id, (len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), len((r.text or "").encode())))
        got = bpe_automaton.encode_decode(docs, BYTES, with_text=True).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id][:3] and len(r.ids) == r.n_tokens
        for r in prefix_counts.prefix_token_counts(docs, BYTES, budgets=(512,)).collect():
            assert (r.n_tokens, r.n_bytes) == (want[r.doc_id][0], want[r.doc_id][3])
    assert bpe_automaton.encode_decode(nothing, BYTES).count() == 0 and prefix_counts.prefix_token_counts(nothing, BYTES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab theing'sreéç 　\n\t 19,.<|endoftxt>漢😀", max_size=40))
def test_every_prefix_and_round_trip(text):
    lib = Tokenizer.from_file(BYTES) if not hasattr(test_every_prefix_and_round_trip, "lib") else test_every_prefix_and_round_trip.lib
    test_every_prefix_and_round_trip.lib = lib
    counter = prefix_counts.PrefixCounter(BYTES) if not hasattr(test_every_prefix_and_round_trip, "c") else test_every_prefix_and_round_trip.c
    test_every_prefix_and_round_trip.c = counter
    table, total = counter.table(text)
    counts = prefix_counts.counts_of(table)
    assert total == counts[-1] and counts.tolist() == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    auto, split = bpe_automaton.coder(BYTES)
    ids = [i for part, special in split.segments(text) for w in ([part] if special else split.words(part)) for i in ([auto.special[w]] if special else auto.encode_word(w.encode()))]
    assert ids == lib.encode(text, add_special_tokens=False).ids and auto.decode(ids).decode() == text


def test_batch_walk_equals_single_walk():
    auto, _ = bpe_automaton.coder(BYTES)
    walker, rng = bpe_automaton.BatchWalker(auto), random.Random(1)
    words = ["".join(rng.choice("abcdefgh théçing123") for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    assert walker.encode(words) == [auto.encode_word(w) for w in words]


def test_sorted_tables(spark, odd, nothing, sf):
    lib = Tokenizer.from_file(WORDS)
    for docs in (read_table(spark, sf, "documents"), odd):
        manifest = sorted_tables.write_token_tables(docs, WORDS, new_path(spark, "t"), end_id=1)
        got = sorted_tables.read_token_tables(spark, manifest, with_ids=True).collect()
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        start = 0
        for r, g in zip(rows, sorted(got, key=lambda g: g.start)):
            ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
            assert (g.doc_id, g.start, g.n_tokens, g.ids) == (r.doc_id, start, len(ids), ids)
            assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
        assert len(rows) == len(got)
        for r in rows[:: max(1, len(rows) // 10)]:
            found = sorted_tables.lookup(spark, manifest, r.doc_id)
            assert [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] in [f.tolist() for f in found]
        assert sorted_tables.lookup(spark, manifest, 10**15) == []
    assert sorted_tables.write_token_tables(nothing, WORDS) == [] and sorted_tables.read_token_tables(spark, []).count() == 0


def test_pieces_of_case_variants_and_marks_are_the_librarys(spark):
    texts = ["a <|ENDOFTEXT|> b", "<|endoftext|> x<|EndOfText|>y <|endoftext|>", "<|StartOfText|>", "J\u030c x", "go W\u030a\nend", "E\u0301T\u0308 \u00c9a", "\u03a3A\u03a3 \u0130x \u0130,", "Plain Text. <|startoftext|>, Done."]
    lib, enc = Tokenizer.from_file(WORDS), sorted_tables.PieceEncoder(WORDS)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # from the library, and from the cache
        assert [np.frombuffer(b, f"<u{enc.width}").tolist() for b in enc.encode_batch(texts, b"")] == want
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = sorted_tables.read_token_tables(spark, sorted_tables.write_token_tables(docs, WORDS), with_ids=True).collect()
    assert [r.ids for r in sorted(got, key=lambda r: r.start)] == want


def test_queries_have_their_columns(spark, sf):
    assert queries.op6_token_counts(spark, sf).columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert queries.op9_bpe_automaton(spark, sf).columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_long_runs_of_blanks_take_linear_time():
    counter = prefix_counts.PrefixCounter(BYTES)
    lib = Tokenizer.from_file(BYTES)
    for run in (" " * 300, " \n" * 150, "\t" * 70 + " ", " " * 40 + "\x1c" * 20, "\u3000" * 60):
        for text in (run, f"a{run}b", f"{run}, c{run}\n"):
            got = prefix_counts.counts_of(counter.table(text)[0])
            assert got.tolist() == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    start = time.perf_counter()
    text = "x" + " " * 100_000 + "y"
    assert counter.table(text)[1] == len(lib.encode(text, add_special_tokens=False).ids)
    assert time.perf_counter() - start < 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "Hello", "it's", "İx", "ΑΣ", "é", "é", "J̌", "क़", "ǅ", "ﬁn", "a1b", "漢字", "ßA", "ẞ", ".", ",", " ", "  ", "\n", " ", "\x1c", "a" * 70, "🙂", "ºx"]), max_size=12))
def test_pieces_are_the_librarys(parts):
    own = test_pieces_are_the_librarys
    if not hasattr(own, "lib"):
        own.lib, own.enc = Tokenizer.from_file(WORDS), sorted_tables.PieceEncoder(WORDS)
    text = "".join(parts)
    got = np.frombuffer(own.enc.encode_batch([text], b"")[0], "<u2").tolist()
    assert got == own.lib.encode(text, add_special_tokens=False).ids
