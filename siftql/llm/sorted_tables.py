"""Token ids in sorted-string-table shards.

A shard is one immutable file::

    data blocks | block index | Bloom filter | footer

Keys are document identifiers as 9 bytes whose byte order is their numeric order (a null sorts first).  A data block
holds up to ``BLOCK_BYTES`` of entries: shared prefix length with the key before (1 byte), rest of the key, number of
ids (4 bytes), ids (2 or 4 bytes each, little-endian, by the file's width); a crc32 of the block is in the index.  The
sparse index has the first key, offset, length, crc32, number of ids before the block.  The footer has the places of the
other parts and the totals.  A lookup asks the Bloom filter, then bisects the index, then scans one block.

Shards are written to a temporary name and renamed, so a repeated or speculative task leaves one whole file.
"""

from __future__ import annotations

import bisect
import posixpath
import string
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftql.llm._shared import TwoGenerations, new_path, text_or_empty

MAGIC = b"SSTIDS01"
BLOCK_BYTES = 64 * 1024
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, filter at, filter end, entries, ids, blocks, width, magic
INDEX = struct.Struct("<9sBHQIIQ")  # first key, -, entries, offset, length, crc32, ids before
BITS_PER_KEY, PROBES = 10, 7
PIECE_LIMIT = 300_000
WORD_LIMIT = 300_000
#: Words that the library encodes as one text.
TOGETHER = 2_000


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:") :])


def write_shard(uri: str, entries: Iterator[tuple[int | None, bytes, int]], width: int) -> dict | None:
    """Write (id, ids as little-endian numbers of ``width`` bytes, how many) in ascending order of key; None if there are none."""
    system, path = _file_system(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    index, keys, at, ids, first = [], [], 0, 0, None
    block, block_key, last, in_block, before = bytearray(), b"", b"", 0, 0
    with system.open_output_stream(temp) as out:

        def flush() -> None:
            nonlocal at, block, in_block, before
            out.write(bytes(block))
            index.append(INDEX.pack(block_key, 0, in_block, at, len(block), zlib.crc32(block), before))
            at, block, in_block, before = at + len(block), bytearray(), 0, ids

        for doc_id, payload, n in entries:
            key = key_of(doc_id)
            if first is None:
                first = key
            if key < last:
                raise ValueError("entries are not in order")
            if block and (len(block) >= BLOCK_BYTES or in_block >= 65_000):
                flush()
            if not block:
                block_key, last = key, b""
            shared = 0
            while shared < len(last) and last[shared] == key[shared]:
                shared += 1
            block += bytes([shared]) + key[shared:] + n.to_bytes(4, "little") + payload
            last, in_block, ids = key, in_block + 1, ids + n
            keys.append(key)
        if block:
            flush()
        bits = max(64, len(keys) * BITS_PER_KEY)
        bloom = np.zeros(bits, np.uint8)
        for k in keys:
            bloom[_probes(k, bits)] = 1
        index_at = at
        out.write(b"".join(index))
        filter_at = index_at + len(index) * INDEX.size
        out.write(packed := np.packbits(bloom).tobytes())
        out.write(FOOTER.pack(index_at, filter_at, bits, len(keys), ids, len(index), width, MAGIC))
    if first is None:
        system.delete_file(temp)
        return None
    system.move(temp, path)
    return {"path": uri, "first_key": first, "last_key": keys[-1], "entries": len(keys), "ids": ids, "bytes": filter_at + len(packed) + FOOTER.size}


class Shard:
    """A reader of one shard."""

    def __init__(self, uri: str):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.index_at, self.filter_at, self.bits, self.entries, self.ids, self.blocks, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw = self.file.read_at(self.blocks * INDEX.size, self.index_at)
        self.index = [INDEX.unpack_from(raw, k * INDEX.size) for k in range(self.blocks)]
        self.firsts = [x[0] for x in self.index]
        self.filter: np.ndarray | None = None

    def block(self, k: int) -> Iterator[tuple[bytes, bytes, int]]:
        _, _, entries, offset, length, crc, _ = self.index[k]
        raw = self.file.read_at(length, offset)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        for _ in range(entries):
            shared = raw[at]
            key = key[:shared] + raw[at + 1 : at + 10 - shared]
            at += 10 - shared
            n = int.from_bytes(raw[at : at + 4], "little")
            at += 4
            yield key, raw[at : at + n * self.width], n
            at += n * self.width

    def scan(self) -> Iterator[tuple[bytes, bytes, int]]:
        for k in range(self.blocks):
            yield from self.block(k)

    def may_have(self, doc_id: int | None) -> bool:
        if self.filter is None:
            self.filter = np.unpackbits(np.frombuffer(self.file.read_at((self.bits + 7) // 8, self.filter_at), np.uint8))
        return bool(self.filter[_probes(key_of(doc_id), self.bits)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier (several rows may have it)."""
        if not self.may_have(doc_id):
            return []
        key, found = key_of(doc_id), []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), self.blocks):
            if self.firsts[k] > key:
                break
            found += [np.frombuffer(p, f"<u{self.width}").astype("<u4") for got, p, _ in self.block(k) if got == key]
        return found


class PieceEncoder:
    """Ids of a text by the tokenizers library, remembered for space-separated pieces.

    It is exact for vocabularies that lower the case and drop white space before splitting, as the file of this operator does:
    no token then spans a space, or a letter and a mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        #: Marks that may close a piece, but for those that close an added token.
        self.marks = "".join(c for c in string.punctuation if all(c != t[-1:] for t in self.added))
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        closes = np.zeros(max(self.lib.get_vocab().values()) + 1, bool)
        closes[[i for t, i in self.lib.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        #: Ids that close a word; none where the vocabulary marks no ends.
        self.closes = closes if suffix else closes[:0]
        self.bare = self._bare(path) if suffix else self.lib
        self.pieces, self.words = TwoGenerations(PIECE_LIMIT), TwoGenerations(WORD_LIMIT)

    def _bare(self, path: str):
        """The library without normalizer and splitting pattern, for lower-case words of letters; with them if a probe differs."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        lib.normalizer = normalizers.Sequence([])
        lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the internationally naïve straße 漢字 кошка x thththth"
        return lib if lib.encode(probe, add_special_tokens=False).ids == self.lib.encode(probe, add_special_tokens=False).ids else self.lib

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Lower-case words of letters go to the library as one text, for each is one word of the vocabulary and has one token that closes it."""
        kind = f"<u{self.width}"
        letters = [w.isalpha() and w.lower() == w and (w.isascii() or unicodedata.is_normalized("NFC", w)) for w in words] if len(self.closes) else [False] * len(words)
        plain = [w for w, own in zip(words, letters) if own]
        known: list[bytes] = []
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, kind)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * self.width
            raw = ids.tobytes()
            if len(ends) == len(some) and ends[-1] == len(raw):
                ends = ends.tolist()
                known += [raw[a:b] for a, b in zip([0, *ends], ends)]
            else:
                known += [np.array(e.ids, kind).tobytes() for e in self.lib.encode_batch_fast(some, add_special_tokens=False)]
        other = [np.array(e.ids, kind).tobytes() for e in self.lib.encode_batch_fast([w for w, own in zip(words, letters) if not own], add_special_tokens=False)]
        one, two = iter(known), iter(other)
        return [next(one) if own else next(two) for own in letters]

    def _make(self, pieces: list[str]) -> list[bytes]:
        """Closing marks after a letter are a word of their own, so pieces that differ in them share an encoding."""
        cores = []
        for p in pieces:
            core = p.rstrip(self.marks)
            cores.append(core if core and core[-1].lower()[-1].isalpha() else p)  # a dotted capital I ends in a mark once lowered
        known = self.words.fetch(dict.fromkeys([*cores, *[p[len(c) :] for p, c in zip(pieces, cores) if len(c) < len(p)]]), self._of_words)
        return [known[c] if len(c) == len(p) else known[c] + known[p[len(c) :]] for p, c in zip(pieces, cores)]

    def _folded(self, text: str) -> str:
        """Lower case and plain spaces, which the vocabulary's normalizer makes anyway.

        Case is left where lowering it first would give other ids: a sigma is lowered by its place; letters and marks may
        compose in one case only, and the library composes before it lowers; added tokens are matched in the raw text.
        """
        low = text.lower()
        plain = text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
        return (low if plain and all(text.count(t) == low.count(t) for t in self.added) else text).replace("\n", " ")

    def encode_batch(self, texts: list[str], end: bytes) -> list[bytes]:
        split = [self._folded(t).split(" ") for t in texts]
        out, at = [], 0
        while at < len(split):  # some texts at a time, for few calls of the library and a bounded set of keys
            upto, size = at, 0
            while upto < len(split) and size < 200_000:
                size += len(split[upto])
                upto += 1
            known = self.pieces.fetch(set().union(*split[at:upto]), self._make)
            out += [b"".join([known[p] for p in s]) + end for s in split[at:upto]]
            at = upto
        return out


_ENCODERS: dict[str, PieceEncoder] = {}


def write_token_tables(docs: DataFrame, path: str, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = None) -> list[dict]:
    """Encode every whole text and write shards in ascending order of ``id_col``; returns the manifest, one entry a shard.

    One range shuffle of the texts.  The manifest (path, keys, counts; ``start`` = ids in all shards before) grows with the
    number of shards only.  Null texts count as empty; a null identifier sorts first; rows with one identifier stay together
    in one shard, ordered by text.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    out = out or new_path(spark, "token-tables")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceEncoder(path)
        enc = _ENCODERS[path]
        end = b"" if end_id is None else end_id.to_bytes(enc.width, "little")

        def entries():
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), enc.encode_batch(batch.column(1).to_pylist(), end)):
                    yield i, raw, len(raw) // enc.width

        if info := write_shard(f"{out}/shard-{TaskContext.get().partitionId():06d}.sst", entries(), enc.width):
            yield pa.RecordBatch.from_pylist([info], schema=pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    got = rows.mapInArrow(run, "path string, first_key binary, last_key binary, entries long, ids long, bytes long").collect()
    manifest, start = [], 0
    for r in sorted(got, key=lambda r: bytes(r.first_key)):
        manifest.append(r.asDict() | {"start": start})
        start += r.ids
    return manifest


def read_token_tables(spark, manifest: list[dict], *, with_ids: bool = False) -> DataFrame:
    """What the shards hold, a row for each document: doc_id, start, n_tokens, ids_crc32 (of unsigned 32-bit ids), with ``with_ids`` also ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows = Shard(uri), {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                kind = f"<u{shard.width}"

                def pack():
                    cols = {"doc_id": pa.array(rows["doc_id"], pa.int64()), "start": pa.array(rows["start"], pa.int64()), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "ids_crc32": pa.array(rows["ids_crc32"], pa.int64())}
                    if with_ids:
                        cols["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
                    for v in rows.values():
                        v.clear()
                    return pa.RecordBatch.from_pydict(cols)

                for key, raw, n in shard.scan():
                    ids = np.frombuffer(raw, kind).astype("<u4")
                    rows["doc_id"].append(id_of(key))
                    rows["start"].append(start)
                    rows["n_tokens"].append(n)
                    rows["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        rows["ids"].append(ids.tolist())
                    start += n
                    if len(rows["doc_id"]) >= 4096:
                        yield pack()
                if rows["doc_id"]:
                    yield pack()

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    shards = shards.repartition(max(1, len(manifest)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def lookup(spark, manifest: list[dict], doc_id: int) -> list[np.ndarray]:
    """The ids of one document, by binary search over shards, index and block."""
    key = key_of(doc_id)
    return [ids for m in manifest if bytes(m["first_key"]) <= key <= bytes(m["last_key"]) for ids in Shard(m["path"]).get(doc_id)]
