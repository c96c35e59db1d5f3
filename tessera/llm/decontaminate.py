"""Benchmark decontamination with an FM-index of every training shard.

A shard is a run of documents that one task holds. Its words become symbols (those that
the benchmark has too their number, a run of other words one symbol, a document's end
another), and an FM-index is built over them: suffix array, Burrows-Wheeler transform,
wavelet matrix for ranks, and every eighth suffix position. The benchmark's windows are
then searched backwards, a block at a time against the same index, their occurrences
located by walking to sampled positions, and the covered words merged into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.plan import KEY, KEY_TYPE, keyed, record, release, small_batches
from tessera.llm.text import ALNUM, Words, chunks, column_bytes

#: Words to a shard at most, but for a single longer document.
SHARD_WORDS = 500_000
#: Every so many positions of a shard keep their suffix position.
SAMPLE = 8
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark goes in blocks, of which a task holds one.
BLOCK_BYTES = 4 << 20
#: Symbols that are no benchmark word: end of shard, end of document, run of other words.
_END, _DOCUMENT, _OTHER, _FIRST = 0, 1, 2, 3


class BitRank:
    """A bit vector with ranks."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits before at."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector for each bit of the symbols."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in reversed(range(bits)):
            ones = (sequence >> level) & 1 == 1
            self.levels.append(BitRank(ones))
            self.zeros.append(int(len(sequence) - ones.sum()))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start = np.zeros_like(at)
        for level, (bit, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            start_ones, ones = bit.ones(start), bit.ones(at)
            start = np.where(one, zeros + start_ones, start - start_ones)
            at = np.where(one, zeros + ones, at - ones)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for bit, zeros in zip(self.levels, self.zeros, strict=True):
            one = bit.get(at)
            ones = bit.ones(at)
            symbol = (symbol << 1) | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol


def suffix_array(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The order of all suffixes of a sequence that ends in its only 0.

    Suffixes are sorted by as many symbols as fit 63 bits, then by doubling, in which only
    those that are still equal take part.
    """
    n, depth = len(symbols), max(1, 63 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate((symbols.astype(np.int64), np.zeros(depth, np.int64)))
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        after = np.where(who + depth < n, rank[np.minimum(who + depth, n - 1)], -1)
        mine = rank[who]
        turn = np.lexsort((after, mine))
        who, mine, after = who[turn], mine[turn], after[turn]
        order[at] = who
        split = np.ones(len(at), bool)
        split[1:] = (mine[1:] != mine[:-1]) | (after[1:] != after[:-1])
        fresh[at] |= split
        rank[who] = np.maximum.accumulate(np.where(split, at, 0))
        depth *= 2


class FMIndex:
    """Counts and locates phrases in a sequence of symbols that ends in its only 0."""

    def __init__(self, symbols: np.ndarray, bits: int, sample: int = SAMPLE):
        order = suffix_array(symbols, bits)
        last = symbols[order - 1]
        self.length, self.sample = len(symbols), sample
        self.matrix = WaveletMatrix(last, bits)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=1 << bits))))
        kept = order % sample == 0
        self.kept = BitRank(kept)
        self.positions = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases (one a row, padded at the end); empty where they don't occur."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.length)
        for step in range(phrases.shape[1]):
            alive = np.flatnonzero((lengths > step) & (low < high))
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - step]
            low[alive] = self.smaller[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.matrix.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of the suffixes in these rows."""
        at, out, steps = rows.copy(), np.empty(len(rows), np.int64), 0
        waiting = np.arange(len(rows))
        while len(waiting):
            kept = self.kept.get(at)
            out[waiting[kept]] = self.positions[self.kept.ones(at[kept])] + steps
            waiting, at = waiting[~kept], at[~kept]
            symbol = self.matrix.access(at)
            at = self.smaller[symbol] + self.matrix.rank(symbol, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """Distinct benchmark windows of a block: vocabulary (sorted word hashes), windows as places in it (from 1, padded
    with 0), and for each window the names (sorted, distinct) of its items."""

    vocabulary: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    item_first: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(items: list[tuple], window: int) -> Phrases:
    """Windows of (item_id, text): every so many consecutive words, or all of a shorter item. Items without an id have windows but no name."""
    names = sorted({str(i) for i, _ in items if i is not None})
    number_of = {name: i for i, name in enumerate(names)}
    words = Words(*column_bytes(pa.array([t for _, t in items], pa.string())), separators=ALNUM)
    vocabulary, place = np.unique(words.hashes, return_inverse=True)
    n = words.counts()
    length = np.minimum(n, window)
    number = np.where(n > 0, n - length + 1, 0)
    owner = np.repeat(np.arange(len(items)), number)
    start = np.repeat(words.first[:-1], number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    rows = np.zeros((len(start), window), np.int32)
    for j in range(window):
        inside = j < length[owner]
        rows[inside, j] = place[start[inside] + j] + 1
    distinct, back = np.unique(rows, axis=0, return_inverse=True)
    named = np.array([-1 if i is None else number_of[str(i)] for i, _ in items], np.int64)[owner]
    pair = np.unique(np.stack((back.ravel()[named >= 0], named[named >= 0]), 1), axis=0)
    return Phrases(vocabulary, distinct, (distinct > 0).sum(1), np.searchsorted(pair[:, 0], np.arange(len(distinct) + 1)), pair[:, 1], names)


def _within(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place in the sorted wanted, and whether it is there."""
    if not len(wanted):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return at, wanted[at] == values


@dataclass
class Shard:
    """Documents of one index, as they come in."""

    columns: list[list] = field(default_factory=lambda: [[] for _ in range(6)])  # key, doc_id, words, then hashes, byte starts and ends of words
    words: int = 0

    def add(self, part: pa.RecordBatch) -> None:
        words = Words(*column_bytes(part.column(2)), separators=ALNUM)
        n = words.counts()
        before = np.repeat(words.offsets[:-1], n)
        for column, values in zip(self.columns, (part.column(0), part.column(1), n, words.hashes, words.start - before, words.end - before), strict=True):
            column.append(values)
        self.words += len(words.hashes)

    def index(self, n: np.ndarray, hashes: np.ndarray, blocks: list[Broadcast]) -> tuple[FMIndex, np.ndarray, np.ndarray]:
        """The index over the shard's symbols, for each symbol the word that it (first) stands for, and the sorted hashes of the words with a symbol of their own."""
        shared = np.zeros(len(hashes), bool)
        for block in _each(blocks):
            shared |= _within(hashes, block.vocabulary)[1]
        alphabet = np.unique(hashes[shared])
        symbol = np.full(len(hashes), _OTHER)
        symbol[shared] = np.searchsorted(alphabet, hashes[shared]) + _FIRST
        first = np.concatenate(([0], np.cumsum(n)))
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (symbol[1:] != _OTHER) | (symbol[:-1] != _OTHER)
        fresh[first[:-1][n > 0]] = True
        # A document's end follows its last word, the shard's end all of them.
        place = np.concatenate((np.flatnonzero(fresh) * 2, first[1:] * 2 - 1))
        order = np.argsort(place, kind="stable")
        both = np.concatenate((symbol[fresh], np.full(len(n), _DOCUMENT)))[order]
        return FMIndex(np.append(both, _END), int(len(alphabet) + _FIRST).bit_length()), place[order] // 2, alphabet

    def found(self, blocks: list[Broadcast]) -> tuple[np.ndarray, list[list], list[list]]:
        """For each document its words, merged spans, and sorted item names."""
        n, hashes, start, end = (np.concatenate(c) for c in self.columns[2:])
        first = np.concatenate(([0], np.cumsum(n)))
        index, origin, alphabet = self.index(n, hashes, blocks)
        cover = np.zeros(self.words + 1, np.int64)
        items: dict[int, set] = {}
        for block in _each(blocks):
            at, there = _within(block.vocabulary, alphabet)
            symbol = np.concatenate(([0], np.where(there, at + _FIRST, 0)))
            windows = symbol[block.windows]
            whole = np.flatnonzero((windows > 0).sum(1) == block.lengths)
            low, high = index.search(windows[whole], block.lengths[whole])
            times = high - low
            which = np.repeat(np.arange(len(low)), times)
            rows = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + low[which]
            place = origin[index.locate(rows)] if len(rows) else rows
            which = whole[which]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + block.lengths[which], -1)
            owner = np.searchsorted(first, place, "right") - 1
            pair = np.unique(np.stack((owner, which), 1), axis=0)
            many = block.item_first[pair[:, 1] + 1] - block.item_first[pair[:, 1]]
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(block.item_first[pair[:, 1]], many)
            for doc, item in np.unique(np.stack((np.repeat(pair[:, 0], many), block.items[at]), 1), axis=0).tolist():
                items.setdefault(doc, set()).add(block.names[item])
        hit = np.cumsum(cover)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        spans: list[list] = [[] for _ in n]
        for d in np.flatnonzero(total[first[1:]] > total[first[:-1]]):
            own = hit[first[d] : first[d + 1]]
            for a, b in np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).reshape(-1, 2).tolist():
                spans[d].append({"first": a, "last": b, "start": int(start[first[d] + a]), "end": int(end[first[d] + b - 1])})
        return n, spans, [sorted(items.get(d, ())) for d in range(len(n))]

    def search(self, blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
        n, spans, names = self.found(blocks)
        yield record(_SCHEMA, [pa.concat_arrays(self.columns[0]), pa.concat_arrays(self.columns[1]), n.astype(np.int64), spans, names])


_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SCHEMA = pa.schema([("key", KEY_TYPE), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_FOUND = f"key {KEY}, doc_id long, n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"


def _each(blocks: list[Broadcast]) -> Iterator[Phrases]:
    """The blocks one after another; of several only the current one is held."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)  # it is read from its file again


def _search_task(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast]) -> Iterator[pa.RecordBatch]:
    shard = Shard()
    for batch in batches:
        for part in chunks(batch):
            shard.add(part)
            if shard.words >= SHARD_WORDS:
                yield from shard.search(blocks)
                shard = Shard()
    if shard.columns[0]:
        yield from shard.search(blocks)
    release()


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    """The benchmark's windows, in blocks of a fixed size of text, as they stream to the driver."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), "text").filter("text IS NOT NULL").toLocalIterator()
    for item, text in rows:
        held.append((item, text))
        size += len(text)
        if size > BLOCK_BYTES:
            yield phrases(held, window)
            held, size = [], 0
    if held:
        yield phrases(held, window)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(key, doc_id, n_words, spans, items) for every row of documents.

    Words are lower-cased runs of ASCII letters and digits and of any other character
    beyond ASCII. A window is so many consecutive words of a benchmark item, or all words
    of a shorter item with some. spans are the merged runs of document words inside
    occurrences: first and last word (exclusive), and byte offsets in the UTF-8 text; items
    are the sorted distinct item_ids, as strings, whose windows occur. Null and empty texts
    have no words and no hits; items without words, and an empty benchmark, hit nothing;
    an item without id hits but is not named; repeated rows are each answered, those of the
    benchmark count once; an empty table gives no rows. A benchmark of any size is one pass
    over documents: blocks of BLOCK_BYTES are searched in each shard's index in turn. Words
    are held as 64-bit hashes; only corpus words that meet one of the benchmark's count.
    Other columns are not read.
    """
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in _blocks(benchmark, window)]
    return keyed(docs).mapInArrow(lambda it: _search_task(it, shared), _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items of benchmark_hits()."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_spans(text: str, spans: list[dict]) -> str:
    """A text with byte spans cut out."""
    raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
    for s in spans:
        kept.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of documents with benchmark passages cut out of their texts; n_chars follows a changed text.

    The task that finds the spans in a shard cuts them, so no text travels. Null and empty
    texts, and all texts under an empty benchmark, stay as they are; repeated rows all stay;
    an empty table gives no rows; further columns, of any name, pass through.
    """
    blocks = [docs.sparkSession.sparkContext.broadcast(block) for block in _blocks(benchmark, window)]
    schema, names = to_arrow_schema(docs.schema), [c.lower() for c in docs.columns]
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cleaned(shard: Shard, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, spans, _ = shard.found(blocks)
        first = 0
        for part in parts:
            own, columns = spans[first : first + part.num_rows], list(part.columns)
            first += part.num_rows
            if any(own):
                texts = [without_spans(columns[at][i].as_py(), s) if s else None for i, s in enumerate(own)]
                changed = pa.array([bool(s) for s in own])
                columns[at] = pc.if_else(changed, pa.array(texts, columns[at].type), columns[at])
                if size is not None:
                    columns[size] = pc.if_else(changed, pa.array([len(t or "") for t in texts], columns[size].type), columns[size])
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = Shard(), []
        for batch in batches:
            for part in chunks(batch, batch.schema.names[at]):
                parts.append(part)
                nothing = pa.nulls(part.num_rows)
                shard.add(pa.RecordBatch.from_arrays([nothing, nothing, part.column(at)], names=["key", "doc_id", "text"]))
                if shard.words >= SHARD_WORDS:
                    yield from cleaned(shard, parts)
                    shard, parts = Shard(), []
        if parts:
            yield from cleaned(shard, parts)
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)
