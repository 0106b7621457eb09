"""Token ids in sorted-string-table shards.

A shard holds records (key, value) in key order. A key is the document's
identifier as 8 big-endian bytes with the sign bit flipped (so bytes order as
numbers), empty for a null identifier; a value is the ids. File layout:

    blocks      each: zlib of the records, a record being
                varint shared, varint rest, varint value length, rest of key, value
                (shared: bytes of the key before that the key starts with)
    index       for each block: varint key length, first key, varint offset,
                varint size, varint records, varint ids before the block
    filter      Bloom filter of the keys
    footer      48 bytes: offsets and sizes of index and filter (4 x u64),
                records (u64), hash functions (u32), magic "MBS1"

A value begins with its width in bytes (2 or 4), then little-endian ids.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
import io
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import gathered, materialise, new_path, small_batches, table

MAGIC = b"MBS1"
FOOTER = struct.Struct("<5QI4s")
BLOCK = 64 << 10
BITS_PER_KEY, HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard to a binary file object; keys must not descend."""

    def __init__(self, out):
        self.out, self.at, self.index = out, 0, []
        self.keys: list[bytes] = []
        self.records = self.ids = 0
        self._open()

    def _open(self):
        self.block, self.size, self.last, self.first, self.count, self.before = [], 0, b"", None, 0, self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        width = 2 if not len(ids) or ids.max() < 65536 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        if self.first is None:
            self.first, shared = key, 0
        else:
            assert key >= self.last, "keys must ascend"
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        record = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(record)
        self.size += len(record)
        self.last, self.count = key, self.count + 1
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.records += 1
        self.ids += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _flush(self):
        if self.count:
            data = zlib.compress(b"".join(self.block), 1)
            self.out.write(data)
            self.index.append((self.first, self.at, len(data), self.count, self.before))
            self.at += len(data)
        self._open()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_places(k, bits)] = 1
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.records, HASHES, MAGIC))


class Reader:
    """Reads a shard from a seekable file object; blocks are read one at a time."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - FOOTER.size)
        at, size, bloom_at, bloom_size, self.records, hashes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC or hashes != HASHES:
            raise ValueError("not a shard")
        self.index = []
        file.seek(at)
        raw, i = file.read(size), 0
        while i < size:
            n, i = _read_varint(raw, i)
            key, i, rest = raw[i : i + n], i + n, []
            for _ in range(4):
                v, i = _read_varint(raw, i)
                rest.append(v)
            self.index.append((key, *rest))
        file.seek(bloom_at)
        self.bloom = np.frombuffer(file.read(bloom_size), np.uint8)
        self.first = [x[0] for x in self.index]

    def _block(self, i: int):
        _, at, size, count, before = self.index[i]
        self.file.seek(at)
        raw, p, key = zlib.decompress(self.file.read(size)), 0, b""
        for _ in range(count):
            shared, p = _read_varint(raw, p)
            rest, p = _read_varint(raw, p)
            length, p = _read_varint(raw, p)
            key = key[:shared] + raw[p : p + rest]
            p += rest
            ids = np.frombuffer(raw, f"<u{raw[p]}", (length - 1) // raw[p], p + 1).astype("<u4")
            p += length
            yield key, before, ids
            before += len(ids)

    def __iter__(self):
        """(key, ids of the shard before it, ids) in order."""
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all records of the identifier: filter, binary search of the index, scan of its blocks."""
        key = key_of(doc_id)
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits)):
            return []
        out = []
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            out += [ids for k, _, ids in self._block(i) if k == key]
        return out


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Pieces whose ids a worker keeps, by their hashes.
KEEP = 1_200_000

#: Kinds of bytes: 0 beyond ASCII, 1 white space, 2 letters, 3 digits, 4 apostrophe (it may belong to the letters after it), 5 other marks.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 5
_KIND[tb.SPACE] = 1
_KIND[65:91] = _KIND[97:123] = 2
_KIND[48:58], _KIND[39] = 3, 4
#: Whether a part begins between bytes of two kinds (8 * left + right).
_CUT = np.zeros(64, bool)
_CUT[[8 * a + b for a in (2, 3, 4, 5) for b in (2, 3, 4, 5) if 3 in (a, b) or (a == 2 and b != 2) or (a == 5 and b == 2)]] = True
#: Parts of a probe that a tokenizer must make for its texts to be cut within words.
PROBE, PARTS = "Ab,ab.(ab)12a3-", ["ab", ",", "ab", ".(", "ab", ")", "1", "2", "a", "3", "-"]


def cuts(buf: np.ndarray) -> np.ndarray:
    """Marks the ASCII bytes that begin a part whatever stands around: after a letter a mark, after a mark a letter, digits alone."""
    out, kind = np.zeros(len(buf), bool), _KIND[buf]
    out[1:] = _CUT[(kind[:-1] << 3) + kind[1:]]
    return out


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, each distinct piece once.

    A piece ends at white space and, where the vocabulary ignores case and parts
    letters, digits and marks (PROBE), at the places of cuts(). Texts with "<|", in
    which special tokens may stand, are cut at white space alone. Pieces of ASCII
    alone are lower-cased here; the others keep their case, as a capital may compose
    with a mark otherwise than its small letter does. The ids of a piece are found
    by a 64-bit hash; a second one, kept with them, must agree as well, or the piece
    goes to the library by itself.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.own = own = Tokenizer.from_str(data.decode())
        parts = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(PROBE)) if own.normalizer and own.pre_tokenizer else []
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        self.inner = [x for x, _ in parts] == PARTS and all(x.startswith("<|") for x in special)
        self.plain = re.compile("[a-z]+") if self.inner else re.compile("(?!)")
        self.keys, self.second, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, pieces: list[str]) -> list[list[int]]:
        """Pieces of a-z alone are the model's input as they are; the rest takes the whole way."""
        model, out, rest = self.own.model, [], []
        for i, p in enumerate(pieces):
            if self.plain.fullmatch(p):
                out.append([t.id for t in model.tokenize(p)])
            else:
                out.append([])
                rest.append(i)
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            for i, e in zip(part, self.own.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self, keys: np.ndarray, second: np.ndarray, pieces: list[str], keep: np.ndarray) -> None:
        """Adds pieces, whose keys ascend; of those known, only the ones marked in keep stay if they are too many."""
        collects = gc.isenabled()
        gc.disable()  # so many short lists, none of them in a cycle, would be looked through again and again
        try:
            ids = self._library(pieces)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        finally:
            if collects:
                gc.enable()
        if len(self.keys) + len(keys) > KEEP:
            self.flat = self.flat[_ranges(self.at[keep], self.size[keep])]
            self.keys, self.second, self.size = self.keys[keep], self.second[keep], self.size[keep]
            self.at = np.cumsum(self.size) - self.size
        into = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, into, len(self.flat) + np.cumsum(size) - size)
        self.size = np.insert(self.size, into, size)
        self.keys, self.second = np.insert(self.keys, into, keys), np.insert(self.second, into, second)
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the last ends)."""
        raw, where = tb.utf8(column)
        buf, cut = raw, None
        if self.inner:
            buf, cut = tb.LOWER[raw], cuts(raw)
            for i in np.unique(np.searchsorted(where, np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)), "right") - 1):
                buf[where[i] : where[i + 1]] = raw[where[i] : where[i + 1]]
                cut[where[i] : where[i + 1]] = False
            cut[where[:-1][where[:-1] < len(cut)]] = False  # these begin a piece unless they are white space
        word = ~tb.SPACE[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        texts = where[:-1][where[:-1] < len(raw)]
        first[texts] |= word[texts]
        if cut is not None:
            first |= cut
        starts = np.flatnonzero(first)
        if self.inner:
            own = np.unique(np.searchsorted(starts, np.flatnonzero(raw > 127), "right") - 1)
            own = _ranges(starts[own], np.append(starts[1:], len(raw))[own] - starts[own])
            buf[own] = raw[own]
        (hashes, second), begins, _ = tb.word_hashes(buf, where, tb.SPACE, cut=cut, seeds=(1, 2))
        assert len(starts) == len(hashes)
        ends = np.append(starts[1:], len(buf))
        piece = lambda i: buf[starts[i] : ends[i]].tobytes().rstrip(b" \t\n\v\f\r").decode()
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            used = np.zeros(len(self.keys), bool)
            used[place[known]] = True
            new = one[~known]
            self._learn(keys[~known], second[new], [piece(i) for i in new.tolist()], used)
            place = np.searchsorted(self.keys, keys)
        at, size, flat = self.at[place][which], self.size[place][which], self.flat
        if len(other := np.flatnonzero(self.second[place][which] != second)):
            ids = [np.array(x, np.uint32) for x in self._library([piece(i) for i in other.tolist()])]
            size[other] = [len(x) for x in ids]
            at[other] = len(flat) + np.cumsum(size[other]) - size[other]
            flat = np.concatenate([flat, *ids])
        total = np.concatenate([[0], np.cumsum(size)])
        return flat[_ranges(at, size)], total[begins]


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at[i], ..., at[i] + size[i] - 1 of all i in turn."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


@lru_cache(1)
def _piece_encoder(data: bytes) -> PieceEncoder:
    return PieceEncoder(data)


#: Bytes of text tokenized together.
TOGETHER_BYTES = 6 << 20


def tokenize(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) as doc_id and v: the ids and end_id as little-endian 16-bit (or, after a byte 4, 32-bit) integers.

    The tokenizer must part words at ASCII white space, as those that drop white space do.
    """
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = _piece_encoder(sent.value)
        for b in gathered(batches, TOGETHER_BYTES):
            out = []
            flat, at = own.encode(b.column("text"))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = np.append(flat[lo:hi], np.uint32(end_id))
                out.append(bytes([2]) + ids.astype("<u2").tobytes() if ids.max() < 65536 else bytes([4]) + ids.tobytes())
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "v"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, v binary")


def write(tokens: DataFrame, folder: str, shards: int | None = None) -> DataFrame:
    """Writes tokens(doc_id, v) as shards into folder and returns their manifest, in key order.

    Shards are ranges of doc_id whose bounds are quantiles of doc_id; nulls come
    first, rows of equal doc_id are ordered by their ids. A file is written under a
    name of its own and counts only once the manifest names it, so that tasks may
    be repeated.
    """
    spark = tokens.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = tokens.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    cuts = sorted({int(x) for x in bounds or []})
    shard = F.coalesce(F.expr("aggregate(array({}), 0, (a, x) -> a + case when doc_id > x then 1 else 0 end)".format(",".join(f"{c}L" for c in cuts))), F.lit(0)) if cuts else F.lit(0)
    ranged = tokens.withColumn("shard", shard).repartition(max(shards, 1), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "v")

    def run(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        current = writer = out = name = first = None

        def close():
            writer.close()
            out.close()
            return pa.record_batch([[current], [name], [writer.records], [writer.ids]], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("ids", pa.int64())]))

        for b in batches:
            for s, doc_id, v in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "v")), strict=True):
                if s != current:
                    if writer:
                        yield close()
                    current, name = s, f"{s:06d}-{uuid.uuid4().hex}.sst"
                    out = system.open_output_stream(f"{base}/{name}")
                    writer = Writer(out)
                writer.add(key_of(doc_id), np.frombuffer(v, f"<u{v[0]}", offset=1))
        if writer:
            yield close()

    manifest = materialise(ranged.select("shard", "doc_id", "v").mapInArrow(run, "shard int, file string, records long, ids long"), "manifest")
    # a row a shard: its window has no more rows than there are files
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the shards: doc_id, start (ids before it), v (little-endian 32-bit ids)."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        system, base = _file_system(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{name}") as f:
                    docs, starts, values = [], [], []
                    for key, before, ids in Reader(f):
                        docs.append(doc_of(key))
                        starts.append(start + before)
                        values.append(ids.tobytes())
                        if len(docs) == 256:
                            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "start", "v"])
                            docs, starts, values = [], [], []
                    if docs:
                        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "start", "v"])

    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, "doc_id long, start long, v binary")


def op2_token_shards(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Writes every document's ids, then reads the files back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    folder = new_path(spark, "shards")
    tokens = materialise(tokenize(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json")), "tokens")
    rows = read(write(tokens, folder), folder)
    return rows.select("doc_id", "start", (F.length("v") / 4).cast("long").alias("n_tokens"), F.crc32("v").alias("ids_crc32"))
