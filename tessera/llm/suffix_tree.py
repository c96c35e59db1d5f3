"""Language-model scores from a probabilistic suffix tree over words.

Every word of the training corpus is a symbol and has its count. The tree's contexts are
runs of words. A context stays if it was seen more than once, at any size of the corpus, and
its next-word distribution diverges from that of the context without its first word by more
than chance: the log-likelihood that it gains is tested, its count times the Kullback-Leibler
divergence; next-word distributions are smoothed with those of the shorter context; a
word is scored in the state of the longest suffix of its past that the tree holds.

    log P(text) = sum over tokens of log P(word | state)

where the state without context has the add-one word probabilities P0. Nothing of this is held
in one place: word counts are kept in buckets of the word's hash, and the tree in buckets of
the hash of the word before, where all contexts that end in that word meet. Texts go there
token by token as numbers of the part's words, and come back as sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.filters import pack, unpack
from tessera.llm.plan import KEY, bucket_count, forget, key_arrays, key_column, materialise, record, release, row_key, small_batches
from tessera.llm.sst import open_file, write_file
from tessera.llm.text import Words, chunks, column_bytes, mix
from tessera.session import new_folder

#: The end of a text, as a token's hash; texts start after it.
END_HASH = np.uint64(0x1F83D9ABFB41BD6B)
#: Tokens of a part that goes to the buckets as one.
PART_TOKENS = 2_500_000
#: Tokens that a bucket's task holds unpacked at a time.
CHUNK_TOKENS = 1_000_000


@dataclass
class Settings:
    """least: times that a context was seen at least; depth: longest context; divergence: least count times
    Kullback-Leibler divergence (nats) from the shorter context; prior: weight of the shorter context in smoothing."""

    least: int = 2
    depth: int = 3
    divergence: float = 4.0
    prior: float = 20.0


_FIELDS = [("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int64()), ("words", pa.binary()), ("trained", pa.binary()), ("docs", pa.binary()), ("times", pa.binary()), ("each", pa.binary()), ("keys", pa.binary()), ("tokens", pa.binary())]
_MIXED = "kind int, bucket int, part long, words binary, trained binary, docs binary, times binary, each binary, keys binary, tokens binary"


def _mixed(k: int, **columns) -> pa.RecordBatch:
    return record(pa.schema(_FIELDS), [columns.get(name, pa.nulls(k, kind)) for name, kind in _FIELDS])


def _squeezed(values: np.ndarray) -> bytes:
    """Packed and compressed: the numbers of common words are small, which a shuffle's own codec makes little of."""
    raw = pack(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueezed(blob: bytes, kind: type) -> np.ndarray:
    return unpack(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), kind)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and n + 1 offsets."""
    words = Words(*column_bytes(part.column(1)))
    n = words.counts()
    first = words.first + np.arange(len(n) + 1)
    out = np.empty(len(words.hashes) + len(n), np.uint64)
    at = np.arange(len(words.hashes)) + np.repeat(np.arange(len(n)), n)
    out[at] = words.hashes
    out[first[1:] - 1] = END_HASH
    return out, first


def _write(path: str, own: pa.RecordBatch, attempt: str) -> None:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, own.schema) as stream:
        stream.write_batch(own)
    write_file(path, out.getvalue(), attempt)


def _count_task(batches: Iterator[pa.RecordBatch], buckets: int, folder: str) -> Iterator[pa.RecordBatch]:
    """By bucket: distinct words, their counts in training texts, and in which documents of the part they are how often (kind 1).
    For the part, in a file of its name: its tokens as numbers of its words, which count bucket by bucket, the end's number, and
    which documents are learned from. This is more than all else together, and no other task but the part's wants it."""
    from pyspark import TaskContext

    attempt = f"attempt{TaskContext.get().taskAttemptId()}"
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, ids, given = (np.concatenate([x[k] for x in held]) for k in (0, 4, 5))
        trained = np.concatenate([x[1] for x in held])
        n = np.concatenate([np.diff(x[3]) for x in held])
        hashes = np.concatenate([x[2] for x in held])
        held.clear()
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes, doc = hashes[order], doc[order]
        fresh = np.ones(len(hashes), bool)
        word = fresh.copy()
        word[1:] = hashes[1:] != hashes[:-1]
        fresh[1:] = word[1:] | (doc[1:] != doc[:-1])
        entry = np.flatnonzero(fresh)
        number_of = np.cumsum(word, dtype=np.int32) - 1
        times = np.diff(np.append(entry, len(hashes))).astype(np.uint32)
        hashes, doc, head = hashes[entry], doc[entry], np.flatnonzero(word[entry])
        each = np.diff(np.append(head, len(entry))).astype(np.uint32)
        bucket = hashes[head] % np.uint64(buckets)
        turn = np.argsort(bucket, kind="stable")
        # Rows of one key that are learned from differ from those that are not.
        name = int(np.bitwise_xor.reduce((key[:, 0].view(np.uint64) + trained) * np.arange(1, 2 * len(key), 2, dtype=np.uint64)).view(np.int64))
        place, number = np.empty(len(turn), np.uint32), np.empty(len(order), np.uint32)
        place[turn] = np.arange(len(turn))
        number[order] = place[number_of]
        end = np.int64(place[np.searchsorted(hashes[head], END_HASH)]).tobytes()
        own = _mixed(1, part=[name], keys=[key.tobytes()], each=[ids.tobytes()], words=[given.tobytes()], tokens=[n.astype(np.int64).tobytes()], times=[end], docs=[_squeezed(number)], trained=[_squeezed(trained.astype(np.uint8))])
        _write(f"{folder}/{name:x}", own, attempt)
        count = np.add.reduceat(np.where(trained[doc], times, 0), head).astype(np.uint32)
        cut = np.searchsorted(bucket[turn], np.arange(buckets + 1, dtype=np.uint64))
        # Entries in the order of their words' buckets.
        spread = np.repeat(head[turn] - np.concatenate(([0], np.cumsum(each[turn], dtype=np.int64)[:-1])), each[turn]) + np.arange(len(entry))
        doc, times, word_of = doc[spread].astype(np.uint32), times[spread], hashes[head][turn]
        ends = np.concatenate(([0], np.cumsum(each[turn], dtype=np.int64)))
        full = np.flatnonzero(np.diff(cut))
        piece = lambda values, b: pack(values[ends[cut[b]] : ends[cut[b + 1]]])
        yield _mixed(
            len(full), kind=[1] * len(full), bucket=full.tolist(), part=[name] * len(full), words=[word_of[cut[b] : cut[b + 1]].tobytes() for b in full], trained=[pack(count[turn][cut[b] : cut[b + 1]]) for b in full],
            each=[pack(each[turn][cut[b] : cut[b + 1]]) for b in full], docs=[piece(doc, b) for b in full], times=[piece(times, b) for b in full], tokens=[np.int64(len(key)).tobytes()] * len(full),
        )

    for batch in batches:
        for part in chunks(batch):
            hashes, first = _tokens(part)
            ids = part.column(3)
            held.append((np.stack(key_arrays(part.column(0)), 1), part.column(2).to_numpy(zero_copy_only=False), hashes, first, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)))
            size += len(hashes)
            if size > PART_TOKENS:
                yield from flush()
                size = 0
    if held:
        yield from flush()
    release()


def _bucket_task(table: pa.Table, buckets: int) -> pa.Table:
    """Sums of each part's documents over the words of this bucket, these words' counts and their ids in the
    corpus, lower for common ones (kind 2), and the bucket's totals (kind 3)."""
    asked, out = table, []
    if asked.num_rows:
        words = [np.frombuffer(x, np.uint64) for x in asked["words"].to_pylist()]
        counts = [unpack(x, np.uint32).astype(np.int64) for x in asked["trained"].to_pylist()]
        distinct, back = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(distinct)).astype(np.int64)
        log, known = np.log10(total + 1), total > 0
        bucket, name = table["bucket"][0].as_py(), np.empty(len(total), np.int64)
        name[np.argsort(-total, kind="stable")] = np.arange(len(total)) * buckets + bucket
        at, keys, tokens, trained, ids = 0, [], [], [], []
        for own, each, docs, times, n in zip(words, asked["each"].to_pylist(), asked["docs"].to_pylist(), asked["times"].to_pylist(), asked["tokens"].to_pylist(), strict=True):
            word = np.repeat(back[at : at + len(own)], unpack(each, np.uint32))
            trained.append(_squeezed(total[back[at : at + len(own)]]))
            ids.append(_squeezed(name[back[at : at + len(own)]]))
            at += len(own)
            docs, times, n = unpack(docs, np.uint32), unpack(times, np.uint32), int(np.frombuffer(n, np.int64)[0])
            keys.append(np.bincount(docs, log[word] * times, n).tobytes())
            tokens.append(pack(np.bincount(docs, known[word] * times, n).astype(np.uint32)))
        k = asked.num_rows
        out.append(pa.Table.from_batches([_mixed(k, kind=[2] * k, bucket=[bucket] * k, part=asked["part"].combine_chunks(), keys=keys, tokens=tokens, trained=trained, words=ids)]))
        out.append(pa.Table.from_batches([_mixed(1, kind=[3], bucket=[bucket], tokens=[np.array([total.sum(), known.sum()]).tobytes()])]))
    return pa.concat_tables(out)


def _totals_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and distinct words of the training texts, by bucket."""
    for batch in batches:
        both = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
        yield record(pa.schema([("n", pa.int64()), ("v", pa.int64())]), [[int(x[0]) for x in both], [int(x[1]) for x in both]])


def _part_task(table: pa.Table, settings: Settings, buckets: int, folder: str) -> pa.Table:
    """A part's documents with their sums over all buckets (kind 5), and its tokens by the bucket of the word before them
    (kind 4): the ids and counts of the words they name, and for each token its document, how often it is learned, and
    the words at and before it. No context can be a state that holds a word of fewer than least occurrences: 0 stands
    for such words in it, and tokens right after one, which the root scores, are left out."""
    sums, part = table, table["part"][0].as_py()
    with open_file(f"{folder}/{part:x}") as f:
        own = pa.ipc.open_stream(f.read()).read_all()
    # A part occurs twice if its documents do.
    copies = sums.num_rows // len(set(sums["bucket"].to_pylist()))
    n = np.frombuffer(own["tokens"][0].as_py(), np.int64)
    logs = sum((np.frombuffer(x, np.float64) for x in sums["keys"].to_pylist()), np.zeros(len(n))) / copies
    known = sum((unpack(x, np.uint32).astype(np.int64) for x in sums["tokens"].to_pylist()), np.zeros(len(n), np.int64)) // copies
    by_bucket = sorted(dict(zip(sums["bucket"].to_pylist(), zip(sums["words"].to_pylist(), sums["trained"].to_pylist()), strict=True)).items())
    words, count = (np.concatenate([_unsqueezed(x[i], np.int64) for _, x in by_bucket]) for i in (0, 1))
    turn = np.argsort(words)
    words, count, place = words[turn], count[turn], np.empty(len(turn), np.uint32)
    place[turn] = np.arange(1, len(turn) + 1)
    end = place[np.frombuffer(own["times"][0].as_py(), np.int64)[0]]
    number, learned = place[_unsqueezed(own["docs"][0].as_py(), np.uint32)], _unsqueezed(own["trained"][0].as_py(), np.uint8)
    doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
    place = np.arange(len(number), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
    past, rare = np.full((settings.depth + 1, len(number)), end, np.uint32), np.concatenate(([True], count < settings.least))
    for back in range(settings.depth + 1):
        inside = np.flatnonzero(place >= back)
        past[back, inside] = number[inside - back]
        if back:
            past[back, rare[past[back]]] = 0
    follows = past[1] > 0
    past, doc = past[:, follows], doc[follows]
    bucket = (mix(words.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)[past[1] - 1]
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    small, named = np.zeros(len(words) + 1, np.uint32), np.zeros(len(words) + 1, bool)
    columns = {name: [] for name in ("words", "trained", "docs", "times", "each")}
    for b in full:
        at = order[cut[b] : cut[b + 1]]
        mine = past[:, at]
        named[:] = False
        named[mine.ravel()] = True
        named[0] = False
        used = np.flatnonzero(named)
        small[used] = np.arange(1, len(used) + 1)
        used -= 1
        for name, value in zip(columns, (_squeezed(np.diff(words[used], prepend=0)), _squeezed(count[used]), _squeezed(np.diff(doc[at], prepend=np.uint32(0))), _squeezed(learned[doc[at]] * np.uint32(copies)), _squeezed(small[mine].ravel())), strict=True):
            columns[name].append(value)
    k = len(full)
    rows = _mixed(k, kind=[4] * k, bucket=full.tolist(), part=[part] * k, **columns)
    given = {name: [own[name][0].as_py()] for name in ("keys", "words", "trained")}
    sums = _mixed(1, kind=[5], bucket=[buckets + part % buckets], part=[part], docs=[np.int64(copies).tobytes() + own["each"][0].as_py()], tokens=[n.tobytes()], times=[known.tobytes()], each=[logs.tobytes()], **given)
    return pa.Table.from_batches([rows, sums])


# The tree ---------------------------------------------------------------------------


@dataclass
class Tree:
    """The part of the tree whose contexts end in some words. vocabulary: ids of words, symbol_of: their symbols,
    root: P0 by symbol, bits: of a symbol in a code. For each depth from 1: the retained contexts as codes, the
    weight of the shorter context in them, and their entries with their probabilities."""

    vocabulary: np.ndarray
    symbol_of: np.ndarray
    root: np.ndarray
    bits: int
    settings: Settings
    contexts: list[np.ndarray] = field(default_factory=list)
    mass: list[np.ndarray] = field(default_factory=list)  # weight of the shorter context in each state
    entries: list[np.ndarray] = field(default_factory=list)  # context code << bits | symbol
    shares: list[np.ndarray] = field(default_factory=list)  # probability without the shorter context's part

    def probabilities(self, symbols: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """P(symbol | state); codes: of depths 1, 2, ... Retained contexts are closed under suffixes,
        so each step either goes one symbol further back or stays in its state."""
        p = self.root[symbols]
        for depth, code in enumerate(codes[: len(self.contexts)]):
            context, entry = self.contexts[depth], self.entries[depth]
            if not len(context):
                break
            at = np.minimum(np.searchsorted(context, code), len(context) - 1)
            inside = context[at] == code
            wanted = (code << self.bits) | symbols
            found = np.minimum(np.searchsorted(entry, wanted), len(entry) - 1)
            share = np.where(entry[found] == wanted, self.shares[depth][found], 0.0)
            p = np.where(inside, share + self.mass[depth][at] * p, p)
        return p

    def grown(self, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, shorter: np.ndarray | list) -> tuple[np.ndarray, ...]:
        """Of contexts of one more symbol those that were seen often enough and diverge from their suffix, which is a state: the contexts, the
        weight of the suffix in each, their entries and these entries' shares.
        Sorted (context, symbol) with counts; shorter: the pairs' probabilities in the suffix (empty: in the root)."""
        settings = self.settings
        q = shorter if len(shorter) else self.root[symbol]
        head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        total = np.add.reduceat(count, head)
        owner = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(context))))
        share = count / total[owner]
        gap = np.add.reduceat(share * np.log(share / q), head)
        stays = (total >= settings.least) & (total * gap >= settings.divergence)
        kept = stays[owner]
        return context[head][stays], settings.prior / (total[stays] + settings.prior), ((context << self.bits) | symbol)[kept], (count / (total[owner] + settings.prior))[kept]

    def grow(self, *pairs) -> None:
        """Adds one more depth, as grown() gives it."""
        for column, values in zip((self.contexts, self.mass, self.entries, self.shares), self.grown(*pairs), strict=True):
            column.append(values)

    def learn(self, past: np.ndarray, times: np.ndarray, depth: int = 1, shorter: np.ndarray | None = None) -> np.ndarray:
        """P(symbol | state) of each token in the tree that these tokens grow from a depth on: past[0] are the symbols, past[d] those d tokens
        before, times how often each token is learned; a word below 0 is in no context. All tokens share a state of depth - 1 symbols, with
        the probabilities shorter by symbol (none: the root). A context's code is its number among those met."""
        p = (self.root if shorter is None else shorter)[past[0]]
        live, code, low = np.arange(past.shape[1], dtype=np.int32), np.zeros(past.shape[1], np.int64), (1 << self.bits) - 1
        for before in past[depth:]:
            there = before[live] >= 0
            live, code = live[there], code[there]
            _, code = np.unique((code << self.bits) | before[live], return_inverse=True)
            pair, first, back = np.unique((code << self.bits) | past[0][live], return_index=True, return_inverse=True)
            count = np.bincount(back, times[live]).astype(np.int64)
            seen = np.flatnonzero(count)
            if not len(seen):
                break
            context, weight, _, shares = self.grown(pair[seen] >> self.bits, pair[seen] & low, count[seen], p[live[first[seen]]])
            mass, share = np.zeros(int(code.max()) + 1), np.zeros(len(pair))
            mass[context] = weight
            share[seen[mass[pair[seen] >> self.bits] > 0]] = shares
            stays = mass[code] > 0
            live, code, back = live[stays], code[stays], back[stays]
            if not len(live):
                break
            p[live] = share[back] + mass[code] * p[live]
        return p


class Bucket:
    """The tokens of a bucket, which stay packed: they are unpacked part by part, and few are held at a time, however many follow one context."""

    def __init__(self, rows: pa.Table, settings: Settings, size: int):
        words = [np.cumsum(_unsqueezed(x.as_py(), np.int64)) for x in rows["words"]]
        counts = np.concatenate([_unsqueezed(x.as_py(), np.int64) for x in rows["trained"]])
        distinct, first, back = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        start = np.cumsum([0, *map(len, words)])
        names = [np.append(np.int32(-1), back[a:b].astype(np.int32)) for a, b in zip(start, start[1:], strict=False)]
        self.depth, self.root = settings.depth, (counts[first] + 1) / size
        self.tree = Tree(distinct, np.arange(len(distinct)), self.root, len(distinct).bit_length(), settings)
        self.packed = list(zip(names, rows["each"], rows["times"], rows["docs"], strict=True))
        self.docs = [np.unique(self._docs(doc)) for *_, doc in self.packed]
        self.gains = [np.zeros(len(d)) for d in self.docs]

    @staticmethod
    def _docs(packed: pa.Scalar) -> np.ndarray:
        return np.cumsum(_unsqueezed(packed.as_py(), np.uint32), dtype=np.uint32)

    def _tokens(self, context: tuple[int, ...], low: int = -1, high: int | None = None) -> Iterator[tuple]:
        """Part by part: tokens (symbol, then the words before it) after a context whose next word back is in a range, how often they are learned, and their places among the part's documents."""
        for (name, each, times, doc), docs in zip(self.packed, self.docs, strict=True):
            tokens = name[_unsqueezed(each.as_py(), np.uint32)].reshape(self.depth + 1, -1)
            mine = np.ones(tokens.shape[1], bool)
            for d, word in enumerate(context):
                mine &= tokens[d + 1] == word
            if high is not None:
                mine &= (tokens[len(context) + 1] >= low) & (tokens[len(context) + 1] < high)
            mine = np.flatnonzero(mine)
            yield tokens[:, mine], _unsqueezed(times.as_py(), np.uint32)[mine], np.searchsorted(docs, self._docs(doc)[mine])

    def _add(self, part: int, place: np.ndarray, p: np.ndarray, symbol: np.ndarray) -> None:
        self.gains[part] += np.bincount(place, np.log10(p / self.root[symbol]), len(self.docs[part]))

    def score(self, context: tuple[int, ...] = (), p: np.ndarray | None = None) -> None:
        """Adds the gains of all tokens after a context that is a state with these probabilities by symbol (none: the root)."""
        p, depth = self.root if p is None else p, len(context) + 1
        met = np.zeros(len(self.root) + 1, np.int64)
        for tokens, _, _ in self._tokens(context):
            met += np.bincount(tokens[depth] + 1, minlength=len(met))
        ends, low = np.concatenate(([0], np.cumsum(met))), 0
        while low < len(met):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + CHUNK_TOKENS, "right")) - 1)
            if ends[high] - ends[low] > CHUNK_TOKENS:
                self._crowd(context, low - 1, p)
            elif ends[high] > ends[low]:
                self._few(context, low - 1, high - 1, p, int(ends[high] - ends[low]))
            low = high

    def _few(self, context: tuple[int, ...], low: int, high: int, p: np.ndarray, total: int) -> None:
        """Tokens after a context by ranges of the word before it: contexts of all depths are grown at once."""
        past, times, places, at = np.empty((self.depth + 1, total), np.int32), np.empty(total, np.uint32), [], 0
        for tokens, own, place in self._tokens(context, low, high):
            past[:, at : at + len(place)], times[at : at + len(place)] = tokens, own
            places.append(place)
            at += len(place)
        found, at = self.tree.learn(past, times, len(context) + 1, p), 0
        for part, place in enumerate(places):
            self._add(part, place, found[at : at + len(place)], past[0, at : at + len(place)])
            at += len(place)

    def _crowd(self, context: tuple[int, ...], word: int, p: np.ndarray) -> None:
        """Tokens after one context with one more word that are too many to hold: its counts by symbol tell whether it is a state."""
        if word >= 0:
            count = np.zeros(len(self.root))
            for tokens, times, _ in self._tokens(context, word, word + 1):
                count += np.bincount(tokens[0], times, len(count))
            seen = np.flatnonzero(count)
            state, weight, _, shares = self.tree.grown(np.zeros(len(seen), np.int64), seen, count[seen].astype(np.int64), p[seen]) if len(seen) else ((), (), (), ())
            if len(state):
                p = weight[0] * p
                p[seen] += shares
                if len(context) + 1 < self.depth:
                    return self.score((*context, word), p)
        for part, (tokens, _, place) in enumerate(self._tokens(context, word, word + 1)):
            self._add(part, place, p[tokens[0]], tokens[0])


def _tree_task(table: pa.Table, settings: Settings, size: int) -> pa.Table:
    """What this bucket's contexts add to the score of each part's documents (kind 6): sum of log10 P(word | state) / P0(word);
    documents (kind 5) pass. size: tokens and distinct words of the training texts, and one."""
    kinds = table["kind"].to_numpy()
    out = [table.filter(pa.array(kinds == 5))]
    asked = table.filter(pa.array(kinds == 4)) if (kinds == 5).any() else table  # a filter copies
    if asked.num_rows:
        bucket = Bucket(asked, settings, size)
        bucket.score()
        k = asked.num_rows
        out.append(pa.Table.from_batches([_mixed(k, kind=[6] * k, bucket=asked["bucket"].combine_chunks(), part=asked["part"].combine_chunks(), docs=[_squeezed(d) for d in bucket.docs], keys=[x.tobytes() for x in bucket.gains])]))
        release()
    return pa.concat_tables(out)


def _sum_task(table: pa.Table) -> pa.Table:
    """Documents of a part with their sums over words and what the tree adds, as often as the part is there."""
    kinds = table["kind"].to_numpy()
    own, gains = table.filter(pa.array(kinds == 5)), table.filter(pa.array(kinds == 6))
    of = lambda name, kind: np.frombuffer(own[name][0].as_py(), kind)
    key, n, known, ids, logs = of("keys", np.int64).reshape(-1, 2), of("tokens", np.int64), of("times", np.int64), of("docs", np.int64), of("each", np.float64)
    trained, given = _unsqueezed(own["trained"][0].as_py(), np.uint8).astype(bool), of("words", bool)
    times, ids = int(ids[0]), ids[1:]
    gain = np.zeros(len(n))
    for doc, value in zip(gains["docs"].to_pylist(), gains["keys"].to_pylist(), strict=True):
        gain[_unsqueezed(doc, np.uint32)] += np.frombuffer(value, np.float64)
    whole = pa.table({"key": key_column(key[:, 0], key[:, 1]), "doc_id": pa.array(ids, pa.int64(), mask=~given), "trained": trained, "n_tokens": n, "n_known": known, "logs": logs, "gain": gain})
    return pa.concat_tables([whole] * times)


def suffix_tree_scores(docs: DataFrame, trained: str = "trained", settings: Settings | None = None) -> DataFrame:
    """(key, doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) for every row.

    docs has doc_id, text and the boolean column named by trained, which tells the rows to
    learn from (null: no). Texts are lower-cased in A-Z; tokens are words without ASCII white
    space and one end. base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score is
    the model's log10 probability. Null and empty texts consist of their end; repeated rows
    count and are scored each; with no training text every token is unseen; an empty table
    gives no rows. Words are held as 64-bit hashes. Other columns are not read.

    Words and contexts are as many as the corpus has: a context stays by a fixed count, and
    the tree is never in one place. All contexts that end in one word share a bucket, whose
    task holds its tokens packed and works on a bounded number of them at a time. Tasks
    write a file a part under the shared folder, which Arrow's file systems must open.
    """
    settings, spark = settings or Settings(), docs.sparkSession
    small_batches(spark)
    rows = docs.select(row_key("doc_id", "text").alias("key"), "text", F.coalesce(F.col(trained), F.lit(False)).alias("learn"), F.col("doc_id").cast("long").alias("doc_id"))
    buckets = bucket_count(docs)
    folder = new_folder(spark, "parts")
    mixed = rows.mapInArrow(lambda it: _count_task(it, buckets, folder), _MIXED)
    mixed = materialise(mixed.groupBy("bucket").applyInArrow(lambda t: _bucket_task(t, buckets), _MIXED), "words")
    total = mixed.filter("kind = 3").select("tokens").mapInArrow(_totals_task, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)
    forget(spark)

    parts = mixed.filter("kind = 2").groupBy("part").applyInArrow(lambda t: _part_task(t, settings, buckets, folder), _MIXED)
    gains = parts.groupBy("bucket").applyInArrow(lambda t: _tree_task(t, settings, n + v + 1), _MIXED)
    scored = gains.groupBy("part").applyInArrow(_sum_task, f"key {KEY}, doc_id long, trained boolean, n_tokens long, n_known long, logs double, gain double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.select("key", "doc_id", "trained", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
