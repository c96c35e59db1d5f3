"""Token ids in sorted-string-table shards, keyed by document.

A shard holds documents in ascending key order:

    data block*   entries (shared prefix, suffix and value lengths as varints; key suffix;
                  value), every RESTART-th with its whole key, then the block's CRC-32
    index         for every data block its last key, offset and length
    Bloom filter  of all document ids
    footer        offsets and lengths of index and filter, counts, id width, magic

An id is found with the filter, a binary search of the sparse index, and one block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.plan import bucket_count, materialise, record, small_batches
from tessera.llm.text import column_bytes
from tessera.llm.whole_token import byte_alphabet
from tessera.session import new_folder

#: Bytes of a data block, and of a shard's data, before the next begins.
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 128 << 20
#: Entries from one whole key to the next, and filter bits and probes a document.
RESTART, BLOOM_BITS, BLOOM_PROBES = 16, 10, 7
MAGIC = b"TSSTAB01"
_FOOTER = struct.Struct("<QQQQQQQI8s")
#: Words that a task remembers the ids of, before it forgets all, and a word's longest length in bytes.
REMEMBERED, LONGEST = 500_000, 64


def key_bytes(doc_id: int | None, ordinal: int) -> bytes:
    """Keys sort as (null first, doc_id, ordinal among equal ids: the range that holds the document, then its place there)."""
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">Q", ordinal)


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _bloom_places(prefix: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(prefix)
    one, two = h & (1 << 64) - 1, h >> 64 | 1
    return [(one + i * two) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard; add() in ascending key order, then close()."""

    def __init__(self, width: int):
        self.width, self.out, self.block, self.index, self.ids = width, bytearray(), bytearray(), [], []
        self.in_block = self.documents = self.tokens = 0
        self.last = b""

    def add(self, key: bytes, value: bytes) -> None:
        """A document's key and its packed ids, width bytes each, little-endian."""
        if self.documents and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=False)) if a != b), len(key))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.documents += 1
        self.tokens += len(value) // self.width
        self.ids.append(key[:9])
        self.last = key
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append((self.last, len(self.out), len(self.block) + 4))
            self.out += self.block + struct.pack("<I", zlib.crc32(self.block))
            self.block, self.in_block = bytearray(), 0

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def close(self) -> bytes:
        self._end_block()
        index_at = len(self.out)
        for key, offset, length in self.index:
            self.out += _varint(len(key)) + key + _varint(offset) + _varint(length)
        bloom_at, bits = len(self.out), max(64, self.documents * BLOOM_BITS)
        bloom = np.zeros(bits, np.uint8)
        for prefix in set(self.ids):
            bloom[_bloom_places(prefix, bits)] = 1
        self.out += np.packbits(bloom).tobytes()
        self.out += _FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, self.documents, self.tokens, len(self.index), self.width, MAGIC)
        return bytes(self.out)


class Reader:
    """Reads a shard through read_at(offset, length), which fetches no more than is asked for."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        if size < _FOOTER.size:
            raise ValueError("not a shard: too short")
        index_at, index_len, bloom_at, self.bits, self.documents, self.tokens, blocks, self.width, magic = _FOOTER.unpack(read_at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic")
        # The filter follows the index: both come at once.
        raw = read_at(index_at, bloom_at - index_at + (self.bits + 7) // 8)
        self.bloom = np.frombuffer(raw, np.uint8, (self.bits + 7) // 8, bloom_at - index_at)
        at, self.index = 0, []
        for _ in range(blocks):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))

    @classmethod
    def of(cls, data: bytes) -> Reader:
        return cls(lambda offset, length: data[offset : offset + length], len(data))

    def _block(self, offset: int, length: int) -> Iterator[tuple[bytes, np.ndarray]]:
        block = self.read_at(offset, length)
        block, check = block[:-4], block[-4:]
        if zlib.crc32(block) != struct.unpack("<I", check)[0]:
            raise ValueError(f"block at {offset} is damaged")
        at, key = 0, b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, np.frombuffer(block, "<u2" if self.width == 2 else "<u4", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for _, offset, length in self.index:
            for key, ids in self._block(offset, length):
                yield key_id(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key_bytes(doc_id, 0)[:9], self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this identifier."""
        found: list[np.ndarray] = []
        if not self.may_hold(doc_id):
            return found
        low = key_bytes(doc_id, 0)
        for _, offset, length in self.index[bisect_left(self.index, low, key=lambda x: x[0]) :]:
            for key, ids in self._block(offset, length):
                if key[:9] == low[:9]:
                    found.append(ids)
                elif key > low:
                    return found
        return found


# Files ------------------------------------------------------------------------------


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_file(path: str, data: bytes, attempt: str) -> None:
    """Written aside and renamed, so that a file is whole if it is there; a retried task writes the same."""
    files, name = _place(path)
    files.create_dir(name.rpartition("/")[0], recursive=True)
    with files.open_output_stream(f"{name}.{attempt}") as out:
        out.write(data)
    files.move(f"{name}.{attempt}", name)


def open_file(path: str) -> pa.NativeFile:
    files, name = _place(path)
    return files.open_input_file(name)


@contextmanager
def open_shard(path: str) -> Iterator[Reader]:
    """A shard in a file, of which footer, index and filter are read now and blocks when they are asked for."""
    with open_file(path) as f:

        def read_at(offset: int, length: int) -> bytes:
            f.seek(offset)
            return f.read(length)

        yield Reader(read_at, f.size())


#: Fixed value: the split pattern of tokenizers with word ends, by which words are letters, single digits, or other signs.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")


class WordIds(dict):
    """Packed ids of words by a tokenizers file that drops white space, so that words can be encoded apart.

    Ids come from the library. A word of plain letters (already composed, with one lower
    case) goes straight to its model, a sign after such a word is encoded by itself, and any
    other word goes through the whole tokenizer. Recent words are remembered.
    """

    def __init__(self, path: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kind = Tokenizer.from_file(path), {2: "H", 4: "I"}[width]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        spec = json.load(open(path, encoding="utf-8"))
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": WORD_PATTERN} and [x["type"] for x in rest] == ["ByteLevel"]
        if not self.plain and not steps:
            raise ValueError(f"{path} is not a tokenizer of white-space separated words")
        self.letters = {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        found = _LETTERS.fullmatch(text) if self.plain else None
        if found is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif found[2]:
            return self._keep(word, self[found[1].encode()] + self.sign(found[2]))
        else:
            ids = [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]
        return self._keep(word, array(self.kind, ids).tobytes())

    def sign(self, text: str) -> bytes:
        found = self.get(text.encode())
        return self._keep(text.encode(), array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()) if found is None else found

    def _keep(self, word: bytes, value: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= LONGEST:
            self[word] = value
        return value

    def encode(self, text: bytes) -> bytes:
        # Case is dropped anyway; special strings, which it would make or break, hold <|.
        return b"".join(map(self.__getitem__, (text.lower() if self.plain and b"<|" not in text else text).split()))


_encoders: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, width: int) -> WordIds:
    """One encoder a Python worker: later tasks find the words of earlier ones."""
    if (path, width) not in _encoders:
        _encoders[path, width] = WordIds(path, width)
    return _encoders[path, width]


_MANIFEST_SCHEMA = pa.schema([("path", pa.string()), ("first_key", pa.binary()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_MANIFEST = "path string, first_key binary, n_docs long, n_tokens long, n_bytes long"


def _write_task(batches: Iterator[pa.RecordBatch], tokenizer: str, folder: str, end_id: int | None, width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    words, writer, rows = word_ids(tokenizer, width), Writer(width), []
    attempt = f"attempt{TaskContext.get().taskAttemptId()}"
    first, previous, ordinal = b"", object(), 0
    low = TaskContext.get().partitionId() << 32
    tail = b"" if end_id is None else end_id.to_bytes(width, "little")

    def close() -> None:
        nonlocal writer
        if writer.documents:
            path = f"{folder}/shard-{first.hex()}.sst"
            data = writer.close()
            write_file(path, data, attempt)
            rows.append((path, first, writer.documents, writer.tokens, len(data)))
        writer = Writer(width)

    for batch in batches:
        raw, at = column_bytes(batch.column(1))
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            ordinal = ordinal + 1 if doc_id == previous else low
            previous = doc_id
            if writer.size() >= SHARD_BYTES:
                close()
            key = key_bytes(doc_id, ordinal)
            first = first if writer.documents else key
            writer.add(key, words.encode(raw[at[i] : at[i + 1]].tobytes()) + tail)
    close()
    if rows:
        yield record(_MANIFEST_SCHEMA, list(zip(*rows, strict=True)))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, width: int = 2) -> DataFrame:
    """Encode whole texts and write them, in ascending doc_id order, as shards; the manifest.

    The manifest has a row a shard: path, first_key, n_docs, n_tokens, n_bytes; its order by
    first_key is the order of the documents. Null texts are empty and still have their end
    id; rows without doc_id come first; rows of one doc_id all stay, one after another in
    the order of their text; an empty table has no shard. width is the bytes an id takes, 2
    only if all ids are below 65536. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    folder = folder or new_folder(docs.sparkSession, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # An id that many rows share, or lack, goes to several ranges by the beginning of their texts.
    start = F.substring("text", 1, 64).asc_nulls_first()
    dealt = rows.repartitionByRange(bucket_count(docs), F.col("doc_id").asc_nulls_first(), start).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialise(dealt.mapInArrow(lambda it: _write_task(it, tokenizer, folder, end_id, width), _MANIFEST), "manifest")


_DOCUMENT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.string())])
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            with open_shard(path) as shard:
                for doc_id, ids in shard:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), path))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield record(_DOCUMENT_SCHEMA, list(zip(*rows, strict=True)))
                        rows = []
            if rows:
                yield record(_DOCUMENT_SCHEMA, list(zip(*rows, strict=True)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document in the shards of a manifest.

    start counts the ids of all documents before it; one task sums up the manifest, which has a
    row a shard. Documents come as often as they are in the shards; an empty manifest gives no rows.
    """
    before = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")).alias("start"))
    return shards.repartition(max(1, min(manifest.count(), 10_000)), "path").mapInArrow(_read_task, _DOCUMENTS)


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) for the wanted ids (doc_id long): every id goes to the shards whose range holds it.

    The driver and every routing task hold the shards' first keys and paths, a row a shard. A
    shard's footer, index and filter are read, and for an id that passes the filter the
    blocks whose keys may be its: one, or more if many documents have it. An id without
    documents gives no row, one of several documents a row each, a null id those without id;
    repeated ids are asked once; empty tables give no rows.
    """
    shards = sorted((bytes(k), p) for p, k in manifest.select("path", "first_key").toLocalIterator())  # a row a shard
    routed = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(lambda it: _route_task(it, shards), "path string, doc_id long")
    return routed.groupBy("path").applyInArrow(_lookup_shard, "doc_id long, tokens array<long>")


def _route_task(batches: Iterator[pa.RecordBatch], shards: list[tuple[bytes, str]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("doc_id", pa.int64())])
    for batch in batches:
        out = []
        for d in batch.column(0).to_pylist():
            low = max(bisect_left(shards, key_bytes(d, 0), key=lambda x: x[0]) - 1, 0)
            high = bisect_left(shards, key_bytes(d, (1 << 64) - 1), key=lambda x: x[0])
            out += [(shards[i][1], d) for i in range(low, max(high, low + 1)) if shards]
        yield record(schema, list(zip(*out, strict=True)) if out else [[], []])


def _lookup_shard(table: pa.Table) -> pa.Table:
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    with open_shard(table["path"][0].as_py()) as shard:
        found = [(d, ids.tolist()) for d in table["doc_id"].to_pylist() for ids in shard.get(d)]
    return pa.Table.from_batches([record(schema, list(zip(*found, strict=True)) if found else [[], []])])
