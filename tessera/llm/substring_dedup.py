"""Removal of passages that occur more than once, by seed and extend.

Seeds are winnowed anchors: of every run of windows the least hash of a short gram is
picked, so equal windows pick the same gram at the same place. Anchors that occur once
in the corpus can't lie in a repeated window. Those that occur again are extended to
both sides: each window that picked such an anchor is compared as a whole with the
windows of the other occurrences, and the maximal runs of repeated windows are removed.

Neither step makes pairs. Occurrences meet in buckets of their hash; what a task has
seen twice itself sends one entry on, so a passage in a third of all documents costs an
entry a task. Anchors are told by 64 bits, as a false one only costs the extension;
windows, which decide, by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.filters import filter_bits, pack, partners, unpack
from tessera.llm.plan import KEY, KEY_TYPE, bucket_count, forget, key_arrays, key_column, keyed, materialise, record, release, text_bytes
from tessera.llm.text import Words, chunks, column_bytes, no_wider

#: Words of a gram. A window of 35 words then holds 20 grams and picks one of them.
GRAM = 16
#: Entries that a task gathers before it hands them to the buckets.
FLUSH = 1_500_000

_FIELDS = [("kind", pa.int32()), ("bucket", pa.int32()), ("key", KEY_TYPE), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("places", pa.binary()), ("hashes", pa.binary()), ("keys", pa.binary()), ("runs", pa.binary())]
_MIXED = f"kind int, bucket int, key {KEY}, doc_id long, n_words long, sha string, places binary, hashes binary, keys binary, runs binary"


def _mixed(k: int, **columns) -> pa.RecordBatch:
    return record(pa.schema(_FIELDS), [columns.get(name, pa.nulls(k, kind)) for name, kind in _FIELDS])


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window its first word, the first word of the gram it picks, and that gram's hash.

    Of equal least hashes the last is picked.
    """
    starts, hashes = words.windows(gram)
    n = words.counts()
    number = np.maximum(n - window + 1, 0)
    before = np.concatenate(([0], np.cumsum(np.maximum(n - gram + 1, 0))[:-1]))
    total = int(number.sum())
    place = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(number)[:-1])), number)
    at = np.repeat(before, number) + place
    width = window - gram + 1
    best, span = np.arange(len(hashes)), 1

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(hashes[right] <= hashes[left], right, left)

    while span * 2 <= width:
        best = np.concatenate((better(best[:-span], best[span:]), best[len(best) - span :])) if len(best) > span else best
        span *= 2
    pick = better(best[at], best[at + width - span]) if total else at
    return np.repeat(words.first[:-1], number) + place, starts[pick], hashes[pick]


@dataclass
class Entries:
    """Occurrences: hash (one or two words of 64 bits each), document (a row of keys) and place; keys are both halves of the documents' keys."""

    hash: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    keys: np.ndarray

    def taken(self, rows: np.ndarray) -> Entries:
        return Entries(self.hash[rows], self.doc[rows], self.place[rows], self.keys)


def _joined(parts: list[Entries]) -> Entries:
    before = np.cumsum([0, *(len(p.keys) for p in parts[:-1])])
    return Entries(np.concatenate([p.hash for p in parts]), np.concatenate([p.doc + n for p, n in zip(parts, before, strict=True)]), np.concatenate([p.place for p in parts]), np.concatenate([p.keys for p in parts]))


def _again(hash_: np.ndarray) -> np.ndarray:
    """Of sorted hashes those that equal the one before."""
    out = np.zeros(len(hash_), bool)
    out[1:] = (hash_[1:] == hash_[:-1]).all(1)
    return out


def _sorted(hash_: np.ndarray) -> np.ndarray:
    return np.argsort(hash_[:, 0], kind="stable") if hash_.shape[1] == 1 else np.lexsort((hash_[:, 1], hash_[:, 0]))


def _packed(entries: Entries, bucket: np.ndarray, buckets: int, kind: int, hashes: bool) -> pa.RecordBatch:
    """Entries as a row a bucket: keys of the documents, how many places follow each, the places, and their hashes."""
    order = np.lexsort((entries.place, entries.doc, bucket))
    entries, bucket = entries.taken(order), bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=bucket.dtype))
    full = np.flatnonzero(np.diff(cut))
    own = [slice(cut[b], cut[b + 1]) for b in full]
    keys, runs = [], []
    for c in own:
        edge, length = _runs(entries.doc[c])
        keys.append(entries.keys[entries.doc[c][edge]].tobytes())
        runs.append(pack(length.astype(np.uint32)))
    more = {"hashes": [entries.hash[c].tobytes() for c in own]} if hashes else {}
    return _mixed(len(full), kind=[kind] * len(full), bucket=full.tolist(), keys=keys, runs=runs, places=[pack(entries.place[c]) for c in own], **more)


def _entries(entries: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries by bucket. What occurs twice here is repeated: its places are known (kind 2), and one entry tells the bucket (kind 3)."""
    entries = entries.taken(_sorted(entries.hash))
    same = _again(entries.hash)
    head = ~same
    same[:-1] |= same[1:]
    yield from _places(entries.taken(same), buckets)
    lone, loud = entries.taken(~same), entries.hash[same & head]
    yield _packed(lone, lone.hash[:, 0] % np.uint64(buckets), buckets, 1, True)
    bucket = loud[:, 0] % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    loud, cut = loud[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cut))
    yield _mixed(len(full), kind=[3] * len(full), bucket=full.tolist(), hashes=[loud[cut[b] : cut[b + 1]].tobytes() for b in full])


def _runs(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal documents begins, and the runs' lengths."""
    edge = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(doc)))


def _places(entries: Entries, buckets: int) -> Iterator[pa.RecordBatch]:
    """Places of repeats (kind 2), by the bucket of their document."""
    if len(entries.doc):
        yield _packed(entries, (entries.keys[:, 0].view(np.uint64) % np.uint64(buckets))[entries.doc], buckets, 2, False)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of documents, and document and place of every packed entry."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64).reshape(-1, 2)
    doc = np.repeat(np.arange(len(keys)), np.concatenate([unpack(x, np.uint32) for x in table["runs"].to_pylist()]))
    return keys, doc, np.concatenate([unpack(x, np.uint32) for x in table["places"].to_pylist()])


def _by_document(table: pa.Table) -> pa.Table:
    """(key, places) of a bucket's documents."""
    keys, doc, place = _unpacked(table)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    keys, doc = keys[order[fresh]], number[doc]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    edge, length = _runs(doc)
    places = [pack(np.unique(place[a : a + n])) for a, n in zip(edge, length, strict=True)]
    return pa.table({"key": key_column(keys[doc[edge], 0], keys[doc[edge], 1]), "places": pa.array(places, pa.binary())})


def _gather(parts: Iterator[Entries | pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        if isinstance(part, pa.RecordBatch):
            yield part
            continue
        held.append(part)
        size += len(part.doc)
        if size > FLUSH:
            yield from _entries(_joined(held), buckets)
            held, size = [], 0
    if size:
        yield from _entries(_joined(held), buckets)
    release()


def _seed_task(batches: Iterator[pa.RecordBatch], window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for part in chunks(batch):
                raw, at = column_bytes(part.column(2))
                words = Words(raw, at, fold=False)
                key = np.stack(key_arrays(part.column(0)), 1)
                whole = raw.tobytes()
                sha = [hashlib.sha256(b" ".join(whole[a:b].split())).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield _mixed(len(key), kind=np.zeros(len(key), np.int32), bucket=(key[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int32), key=part.column(0), doc_id=part.column(1), n_words=words.counts().astype(np.int64), sha=sha)
                _, place, hash_ = anchors(words, window, gram)
                place, first = np.unique(place, return_index=True)
                owner = np.searchsorted(words.first, place, "right") - 1
                yield Entries(hash_[first][:, None], owner, (place - words.first[owner]).astype(np.uint32), key)

    return _gather(parts(), buckets)


def _extend_task(batches: Iterator[pa.RecordBatch], window: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Whole windows that picked a repeated anchor."""

    def parts():
        for batch in batches:
            for part in chunks(batch):
                words = Words(*column_bytes(part.column(2)), fold=False)
                key = np.stack(key_arrays(part.column(0)), 1)
                seeds = [unpack(x, np.uint32) for x in part.column(3).to_pylist()]
                seed = np.unique(np.concatenate([s + f for s, f in zip(seeds, words.first[:-1], strict=True)]))
                start, place, _ = anchors(words, window, gram)
                start = start[np.isin(place, seed)]
                owner = np.searchsorted(words.first, start, "right") - 1
                hash_ = np.stack((words.runs(start, window), words.runs(start, window, second=True)), 1)
                yield Entries(hash_, owner, (start - words.first[owner]).astype(np.uint32), key)

    return _gather(parts(), buckets)


def _repeats(table: pa.Table, buckets: int, halves: int) -> pa.Table:
    """Of a bucket's entries, whose hashes have so many halves, the places of those whose hash occurs again; other rows pass."""
    kinds = table["kind"].to_numpy()
    passed, asked, loud = (table.filter(pa.array(x)) for x in ((kinds == 0) | (kinds == 2), kinds == 1, kinds == 3))
    out = [passed]
    if asked.num_rows:
        lone, known = (np.frombuffer(b"".join(t["hashes"].to_pylist()), np.uint64).reshape(-1, halves) for t in (asked, loud))
        keys, doc, place = _unpacked(asked)
        both = np.concatenate((lone, known))
        order = _sorted(both)
        same = _again(both[order])
        same[:-1] |= same[1:]
        keep = np.zeros(len(both), bool)
        keep[order[same]] = True
        keep = keep[: len(lone)]
        entries = Entries(lone[keep], doc[keep], place[keep], keys)
        out += [pa.Table.from_batches([b]) for b in _places(entries, buckets)]
    return pa.concat_tables(out)


_REMOVED = f"key {KEY}, n_removed long, sha string, spans array<struct<first:int,last:int>>"


def _remove_task(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per document with repeats: words removed, digest of the rest, and the removed runs of words (last exclusive)."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    schema = pa.schema([("key", KEY_TYPE), ("n_removed", pa.int64()), ("sha", pa.string()), ("spans", span)])
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            starts = unpack(places, np.uint32).astype(np.int64)
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
            gone = np.cumsum(gone)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
            for column, value in zip(out, (int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"first": a, "last": b} for a, b in edge.reshape(-1, 2).tolist()]), strict=True):
                column.append(value)
        yield record(schema, [batch.column(0), *out])


def repeated_passages(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """(key, doc_id, n_words, n_removed, kept_sha256, spans) for every row of documents.

    Words are runs without ASCII white space, unchanged. A word is removed if a window of
    so many words of one document covers it whose word sequence starts anywhere else too,
    in this document or another; repeated rows are other documents. spans are the removed
    runs of words, last exclusive; kept_sha256 digests the kept words joined by a space.
    Null and empty texts have no words; texts shorter than a window lose none; a null
    doc_id is kept; an empty table gives no rows. Windows are held as 128-bit hashes.
    Other columns of docs are not read.
    """
    no_wider(window)
    rows, buckets, bits = keyed(docs), bucket_count(docs), filter_bits(text_bytes(docs))
    meet = lambda d, name, halves: materialise(d.groupBy("bucket").applyInArrow(lambda t: _repeats(t, buckets, halves), _MIXED), name)
    first = meet(rows.mapInArrow(lambda it: _seed_task(it, window, gram, buckets), _MIXED), "seeds", 1)
    gathered = lambda d: d.filter("kind = 2").select("bucket", "keys", "runs", "places").groupBy("bucket").applyInArrow(_by_document, f"key {KEY}, places binary")
    forget(docs.sparkSession)
    documents = first.filter("kind = 0").select("key", "doc_id", "n_words", "sha")
    seeds = gathered(first)
    second = meet(partners(rows, seeds, bits).mapInArrow(lambda it: _extend_task(it, window, gram, buckets), _MIXED), "windows", 2)
    forget(docs.sparkSession)
    repeats = gathered(second)
    removed = partners(rows, repeats, bits).mapInArrow(lambda it: _remove_task(it, window), _REMOVED).dropDuplicates(["key"])
    joined = documents.alias("d").join(removed.alias("r"), "key", "left")
    return joined.select("key", "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("r.sha", "d.sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"))


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", KEY_TYPE), ("kept", pa.string())])
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            at = 0
            rest: list[bytes] = []
            for s in spans:
                rest += words[at : s["first"]]
                at = s["last"]
            kept.append(b" ".join(rest + words[at:]).decode("utf-8"))
        yield record(schema, [batch.column(0), kept])


def kept_texts(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(key, kept): each document's text without the spans of repeated_passages(), words joined by a space.

    Null and empty texts are empty; repeated rows come as often as they are there; rows of docs
    that passages does not have are left out. Other columns are not read.
    """
    spans = passages.select("key", "spans").dropDuplicates(["key"])
    return keyed(docs).join(spans, "key").mapInArrow(_cut_task, f"key {KEY}, kept string")
