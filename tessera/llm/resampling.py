"""Importance resampling towards a target distribution, by a dictionary of distinct features.

A task packs documents into chunks: the distinct features of a chunk as strings, and for
each document how often it has which of them. The strings of all chunks are counted into a
dictionary, where each distinct string is hashed to its bucket once; buckets of corpus and
target give gains; gains go back to the chunks that hold a string, where they are summed
over each document's counts. A frequent feature thus has an entry a chunk, not a document.
Documents are then drawn by the order of their weight with Gumbel noise added, which is
sampling without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.places import numbered
from tessera.llm.plan import materialise, record, release, small_batches
from tessera.llm.text import ALNUM, Words, column_bytes

#: Words of the longest feature and hash buckets.
WIDTH, BUCKETS = 1, 10_000
#: Documents with fewer words are not drawn; of the others, this share in percent is.
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20

_CHUNK = "chunk long, ids array<long>, n_words array<long>, n_features array<long>, n_pairs array<long>, pairs binary, counts binary, features array<string>, times array<long>"
_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), ("ids", _LONGS), ("n_words", _LONGS), ("n_features", _LONGS), ("n_pairs", _LONGS), ("pairs", pa.binary()), ("counts", pa.binary()), ("features", _STRINGS), ("times", _LONGS)])
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _strings(words: Words, starts: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """The features that begin at words starts and have so many words, folded and joined by a space."""
    raw = words.raw.tobytes()
    out = []
    for at, width in zip(starts.tolist(), widths.tolist(), strict=True):
        out.append(b" ".join(raw[words.start[i] : words.end[i]] for i in range(at, at + width)).translate(_FOLD) if width > 1 else raw[words.start[at] : words.end[at]].translate(_FOLD))
    return out


def _chunk(number: int, ids: pa.Array, words: Words, width: int) -> pa.RecordBatch:
    """A chunk's row: distinct features, and (feature, count) of each document in turn; a feature is told from others by 128 bits."""
    counts = words.counts()
    starts = [words.windows(w)[0] for w in range(1, width + 1)]
    owner = np.concatenate([np.repeat(np.arange(len(counts)), np.maximum(counts - w + 1, 0)) for w in range(1, width + 1)])
    widths = np.repeat(np.arange(1, width + 1), [len(s) for s in starts])
    one = np.concatenate([words.runs(s, w) for w, s in enumerate(starts, 1)])
    two = np.concatenate([words.runs(s, w, second=True) for w, s in enumerate(starts, 1)])
    starts = np.concatenate(starts)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    feature = np.empty(len(order), np.int64)
    feature[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    n = len(first)
    pair, times = np.unique(owner * max(n, 1) + feature, return_counts=True)
    n_pairs = np.bincount(pair // max(n, 1), minlength=len(counts))[: len(counts)] if len(pair) else np.zeros(len(counts), np.int64)
    strings = [x.decode() for x in _strings(words, starts[first], widths[first])]
    n_features = np.bincount(owner, minlength=len(counts))
    values = [number, ids.to_pylist(), counts, n_features, n_pairs, (pair % max(n, 1)).astype(np.int32).tobytes(), times.astype(np.int32).tobytes(), strings, np.bincount(feature, minlength=n)]
    return record(_CHUNK_SCHEMA, [[x] for x in values])


def _chunk_task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Chunks of about CHUNK_BYTES of text, numbered within the task; a longer text is a chunk of its own."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def emit() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        text = rows["text"].cast(pa.large_string())
        return _chunk(number, rows["doc_id"], Words(*column_bytes(text), ALNUM), width)

    for batch in batches:
        _, at = column_bytes(batch.column(1))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK_BYTES - size, "right")) - 1)
            held.append(batch.slice(low, high - low))
            size += int(at[high] - at[low])
            low = high
            if size >= CHUNK_BYTES or low < batch.num_rows:
                yield emit()
                number, held, size = number + 1, [], 0
    if held:
        yield emit()
    release()


def chunked(texts: DataFrame, width: int, name: str) -> DataFrame:
    """Chunks of (doc_id, text), written down."""
    small_batches(texts.sparkSession)
    rows = texts.select("doc_id", F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(lambda it: _chunk_task(it, width), _CHUNK), name)


def dictionary(chunks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(feature, n, bucket): every distinct string once."""
    each = chunks.select(F.explode(F.arrays_zip("features", "times")).alias("f")).select(F.col("f.features").alias("feature"), F.col("f.times").alias("n"))
    return each.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that the corpus fills, from two dictionaries; there are at most as many rows as buckets."""
    sums = [d.groupBy("bucket").agg(F.sum("n").cast("double").alias(name)) for d, name in ((corpus, "s"), (target, "t"))]
    both = sums[0].join(sums[1], "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    total = lambda d, name: d.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    one = both.join(F.broadcast(total(corpus, "all_s"))).join(F.broadcast(total(target, "all_t")))  # one row each
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return one.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


_WEIGHT = "doc_id long, n_words long, n_features long, weight long"
_WEIGHT_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _WEIGHT.split(", ")])


def _weight_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            _, ids, n_words, n_features, n_pairs, pairs, counts, places, values = (c[row] for c in batch.columns)
            gain = np.zeros(len(places) if places.is_valid else 0, np.int64)
            if places.is_valid:
                gain[places.values.to_numpy()] = values.values.to_numpy()
            at = np.concatenate(([0], np.cumsum(n_pairs.values.to_numpy())))
            total = np.concatenate(([0], np.cumsum(gain[np.frombuffer(pairs.as_py(), np.int32)] * np.frombuffer(counts.as_py(), np.int32))))
            yield record(_WEIGHT_SCHEMA, [ids.values, n_words.values, n_features.values, total[at[1:]] - total[at[:-1]]])


def importance_weights(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the sum of its features' gains.

    Null and empty texts have no features and weight 0; an empty target has none either;
    repeated rows, and rows without doc_id, are each weighed; an empty table gives no rows;
    other columns are not read.
    """
    chunks = chunked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, "chunks")
    wanted = chunked(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), width, "target")
    known = materialise(dictionary(chunks, buckets), "dictionary")
    gains = bucket_gains(known, dictionary(wanted, buckets), buckets)
    valued = known.join(F.broadcast(gains), "bucket").select("feature", "gain")  # a row a bucket
    places = chunks.select("chunk", F.posexplode("features").alias("place", "feature"))
    back = places.join(valued, "feature").groupBy("chunk").agg(F.collect_list(F.struct("place", "gain")).alias("g"))  # no more than a chunk's features
    back = back.select("chunk", F.col("g.place").alias("places"), F.col("g.gain").alias("gains"))
    whole = chunks.select("chunk", "ids", "n_words", "n_features", "n_pairs", "pairs", "counts").join(back, "chunk", "left")
    return whole.mapInArrow(_weight_task, _WEIGHT)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from a hash of seed:doc_id; a null id is an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank, from 1, of the drawn ones: percent of those with at least so many words, rounded down.

    Higher scores come first, ties by the lower doc_id, null ids first; rows that agree in
    both stand in any order. Nulls, repeated rows and empty tables count as in
    importance_weights().
    """
    weights = importance_weights(docs, target, width, buckets).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialise(weights, "scored")
    placed = numbered(scored.filter(F.col("n_words") >= least), [F.desc("score"), F.asc("doc_id")], "place")
    drawn = placed.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.select(*columns, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank")))
