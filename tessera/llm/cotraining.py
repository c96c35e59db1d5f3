"""Quality classification by co-training two views of a document.

One classifier sees the text (hashed byte n-grams, and its shape: how much of it are
signs, capitals, digits, repeated words and lines), the other the metadata (source,
language, size). Each round every document of the corpus is read: the share of documents
that a view is surest are good, and the share that it is surest are bad, become labels for
the other view's next model. Such a label counts for both classes, by the view's calibrated
probabilities, so that a view which can't tell bad from good does not mislead the other.
Both models are multinomials with additive counts, so a round is one pass that sums tables
of fixed size. Each view is calibrated on held-out labels, and the calibrated log-odds are
combined into one probability for every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ngrams import BITS, slots, summed, text_means
from tessera.llm.plan import KEY, KEY_TYPE, record, release, row_key, small_batches
from tessera.llm.text import Words, chunks, column_bytes

#: Labelled rows at most, of each class, that models start from and calibration uses, by a hash of their id.
LABELLED_ROWS = 20_000
#: Bits of a hashed metadata value.
META_BITS = 12
#: Of the labelled rows of each class one in so many, by a hash of the id, is held out for calibration and cuts.
HELD_OUT = 4
#: Rounds of exchange, the share of each class that a view labels in one, and the parts that a label is dealt to the classes in.
ROUNDS, EXCHANGED, PARTS = 2, 0.2, 8
#: Documents whose combined probability of good quality is below this are rejected.
REJECT_BELOW = 0.5
#: Bytes of text that a task takes apart at a time: it holds some fifty times as many.
PART_BYTES = 1 << 20
#: Shapes of a text, the steps that each is cut into, and the bits of a size class that goes with them.
SHAPES, LEVELS = 7, 32
#: Signs that prose has few of.
SYMBOLS = b"#*$%&|<>!{}[]=_~^\\/@+"


def metadata_slots(part: pa.RecordBatch) -> np.ndarray:
    """Hashed metadata values of each row: source, language, size class, and pairs of them; nulls are values."""
    size = [None if n is None else int(np.log2(abs(n) + 1) * 2) for n in part.column(4).to_pylist()]
    rows = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), size, strict=True)
    known: dict = {}
    mask = (1 << META_BITS) - 1

    def slots_of(row: tuple) -> list[int]:
        if row not in known:
            source, lang, n = row
            known[row] = [xxhash.xxh3_64_intdigest(repr(x)) & mask for x in ((0, source), (1, lang), (2, n), (3, lang, n))]
        return known[row]

    return np.array([slots_of(r) for r in rows], np.int64).reshape(part.num_rows, 4)


_SIGNS = np.zeros(256, np.uint8)
_SIGNS[list(SYMBOLS)] = 1
_UPPER, _LETTER, _DIGIT = (np.zeros(256, np.uint8) for _ in range(3))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _DIGIT[48:58] = 1


def shape_slots(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SHAPES slots of each text: the level of a share, or of a mean on a logarithmic scale, with the text's size class.

    Shares of signs, capitals and digits; of words that equal the word before, or the one
    before that; of lines that equal an earlier one; and words a line.
    """
    words = Words(raw, offsets)
    n_bytes, n_words, first = np.diff(offsets), words.counts(), words.first[:-1]
    some, worded = n_bytes > 0, n_words > 0

    def added(values: np.ndarray, at: np.ndarray, where: np.ndarray) -> np.ndarray:
        out = np.zeros(len(where), np.int64)
        if where.any():
            out[where] = np.add.reduceat(values, at[where], dtype=np.int64)
        return out

    of_class = lambda table: added(table[raw], offsets[:-1], some)
    breaks = raw == 10
    n_lines = added(breaks.view(np.uint8), offsets[:-1], some) + 1
    like = [np.zeros(len(words.hashes), np.uint8) for _ in range(2)]
    for k, equal in enumerate(like, 1):
        equal[k:] = words.hashes[k:] == words.hashes[:-k]
        for j in range(k):  # a text's first words have none before them
            equal[first[worded & (n_words > j)] + j] = 0
    line_of = np.cumsum(breaks, dtype=np.int32)[words.start]
    new = np.ones(len(line_of), bool)
    new[1:] = line_of[1:] != line_of[:-1]
    new[first[worded]] = True  # texts are not parted by a line break
    begin = np.flatnonzero(new)
    owner = np.searchsorted(first[worded], begin, "right") - 1
    line = words.runs(begin, np.diff(np.append(begin, len(line_of)))) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((line, owner))
    again = np.zeros(len(begin), np.int64)
    again[1:] = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    repeats, full = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    repeats[worded], full[worded] = np.bincount(owner[order], weights=again, minlength=int(worded.sum())), np.bincount(owner, minlength=int(worded.sum()))
    share = lambda n, of: np.sqrt(n / np.maximum(of, 1))  # noqa: E731  finer near 0
    values = np.stack([
        share(of_class(_SIGNS), n_bytes), share(of_class(_UPPER), of_class(_LETTER)), share(of_class(_DIGIT), n_bytes), *(share(added(e, first, worded), n_words) for e in like),
        share(repeats, full), np.log2(1 + n_words / n_lines) / 12,
    ], 1)
    level = np.minimum((np.minimum(values, 1) * (LEVELS - 1) + 0.5).astype(np.int64), LEVELS - 1)
    size = np.minimum(np.log2(1 + n_words).astype(np.int64) // 2, 7)
    return (np.arange(SHAPES) * 8 + size[:, None]) * LEVELS + level


@dataclass
class Views:
    """Log ratios good / bad by slot of n-grams, shapes and metadata; for each view the calibration of its scores (a slope each, and
    an offset), and the log-odds below and above which it labels for the other view."""

    text: np.ndarray
    shape: np.ndarray
    meta: np.ndarray
    calibration: dict[str, np.ndarray] = field(default_factory=lambda: {"text": np.array([1.0, 0.0, 0.0]), "meta": np.array([1.0, 0.0])})
    cuts: dict[str, tuple[float, float]] = field(default_factory=lambda: {"text": (-np.inf, np.inf), "meta": (-np.inf, np.inf)})
    prior: float = 0.0

    @staticmethod
    def places(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text's slots and offsets, its shape slots and the metadata slots."""
        raw, offsets = column_bytes(part.column(1))
        return *slots(raw, offsets), shape_slots(raw, offsets), metadata_slots(part)

    def scores(self, slot: np.ndarray, offsets: np.ndarray, shape: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean ratio of the text's n-grams, and the sums of ratios of its shape and of its metadata."""
        return text_means(self.text[slot], offsets), self.shape[shape].sum(1), self.meta[meta].sum(1)

    def odds(self, text: np.ndarray, shape: np.ndarray, meta: np.ndarray) -> dict[str, np.ndarray]:
        """Log-odds of good quality of both views."""
        (a, b, c), (d, e) = self.calibration["text"], self.calibration["meta"]
        return {"text": a * text + b * shape + c, "meta": d * meta + e}

    def combined(self, odds: dict[str, np.ndarray]) -> np.ndarray:
        """Probability of good quality: both views' log-odds without counting the prior twice."""
        return probability(odds["text"] + odds["meta"] - self.prior)

    def sure(self, view: str, odds: np.ndarray) -> np.ndarray:
        """Rows that a view labels."""
        low, high = self.cuts[view]
        return (odds >= high) | (odds <= low)


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def surest(odds: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Log-odds up to which, and from which on, a view labels: as much of the weight as EXCHANGED of each class; equal ones stay together, and none if all are equal."""
    order = np.argsort(odds, kind="stable")
    odds, weight = odds[order], weight[order]
    if not len(odds) or odds[0] == odds[-1]:
        return -np.inf, np.inf
    share = float((weight * good[order]).sum() / weight.sum())
    up, down = np.cumsum(weight) / weight.sum(), np.cumsum(weight[::-1]) / weight.sum()
    low, high = odds[np.searchsorted(up, EXCHANGED * (1 - share))], odds[::-1][np.searchsorted(down, EXCHANGED * share)]
    return (float(low), float(high)) if low < high else (-np.inf, np.inf)


@dataclass
class Labels:
    """Bounded samples of labelled ids, sorted: those that models start from, those held out, and the share of good rows among all labels."""

    good: np.ndarray
    bad: np.ndarray
    held_good: np.ndarray
    held_bad: np.ndarray
    share: float

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        return np.isin(ids, self.good), np.isin(ids, self.bad)

    def held(self, part: pa.RecordBatch) -> np.ndarray:
        ids = part.column(0).to_numpy(zero_copy_only=False)
        return np.isin(ids, self.held_good) | np.isin(ids, self.held_bad)


def sample_labels(labels: DataFrame, most: int = LABELLED_ROWS) -> Labels:
    """At most so many ids of each class; an id with both labels is left out. Of two rows of a class or more, one at least is held out."""
    clear = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    sizes = {int(q): int(n) for q, n in clear.groupBy("low").count().collect()}

    def take(quality: int) -> tuple[np.ndarray, np.ndarray]:
        rows = clear.filter(F.col("low") == quality).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        ids, held = np.array([r[0] for r in rows], np.int64), np.arange(len(rows)) % HELD_OUT == 1
        return np.sort(ids[~held]), np.sort(ids[held])

    total = sum(sizes.values())
    (good, held_good), (bad, held_bad) = take(1), take(0)
    return Labels(good, bad, held_good, held_bad, sizes.get(1, 0) / total if total else 0.5)


#: Slots of n-grams, shapes and metadata, and where these lie in a table of counts, twice each: for good and bad.
_SIZES = (1 << BITS, SHAPES * 8 * LEVELS, 1 << META_BITS)
_TOTAL = 2 * sum(_SIZES)


def _tables(total: np.ndarray) -> list[np.ndarray]:
    at = np.cumsum((0, *(2 * n for n in _SIZES)))
    return [total[a:b].reshape(2, -1) for a, b in zip(at, at[1:], strict=False)]


def _count_task(batches: Iterator[pa.RecordBatch], labels: Broadcast, views: Broadcast | None) -> Iterator[np.ndarray]:
    """Counts by class for both views, in PARTS: labelled rows, and from the second round rows of which the other view is sure; held-out ones never count."""
    total = np.zeros(_TOTAL, np.int64)
    text, shapes, metas = _tables(total)
    for batch in batches:
        for part in chunks(batch, limit=PART_BYTES):
            good, bad = labels.value.of(part)
            weight = np.where(good, PARTS, 0)
            known = {"text": (good | bad, weight), "meta": (good | bad, weight)}
            if views is None:  # only labelled rows count
                part = part.filter(pa.array(good | bad))
                known = {v: (np.ones(part.num_rows, bool), weight[good | bad]) for v in known}
                slot, offsets, shape, meta = Views.places(part)
            else:
                slot, offsets, shape, meta = views.value.places(part)
                odds = views.value.odds(*views.value.scores(slot, offsets, shape, meta))
                open_ = ~(good | bad | labels.value.held(part))
                for view, other in (("text", "meta"), ("meta", "text")):
                    told = open_ & views.value.sure(other, odds[other])
                    known[view] = (good | bad | told, np.where(told, np.rint(probability(odds[other]) * PARTS).astype(np.int64), weight))
            for k in range(2):
                for_text, for_meta = (np.where(chosen, parts if k == 0 else PARTS - parts, 0) for chosen, parts in known.values())
                mine, n = for_text > 0, np.diff(offsets)
                if mine.any():
                    text[k] += np.bincount(slot[np.repeat(mine, n)], weights=np.repeat(for_text[mine], n[mine]), minlength=_SIZES[0]).astype(np.int64)
                    shapes[k] += np.bincount(shape[mine].ravel(), weights=np.repeat(for_text[mine], SHAPES), minlength=_SIZES[1]).astype(np.int64)
                mine = for_meta > 0
                metas[k] += np.bincount(meta[mine].ravel(), weights=np.repeat(for_meta[mine], meta.shape[1]), minlength=_SIZES[2]).astype(np.int64)
    if total.any():
        yield total
    release()


def _ratios(counts: np.ndarray) -> np.ndarray:
    """Log ratios good / bad of smoothed shares; all 0 unless there are counts of both classes."""
    if not counts.any(1).all():
        return np.zeros(counts.shape[1])
    share = np.log((counts / PARTS + 1) / (counts.sum(1, keepdims=True) / PARTS + counts.shape[1]))
    return share[0] - share[1]


_SCORES = "doc_id long, text long, key_a long, n_gram double, shape double, meta double"
_SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("key_a", pa.int64()), ("n_gram", pa.float64()), ("shape", pa.float64()), ("meta", pa.float64())])


def _held_task(batches: Iterator[pa.RecordBatch], labels: Broadcast, views: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mine = batch.filter(pa.array(labels.value.held(batch)))
        for part in chunks(mine, limit=PART_BYTES):
            size = np.diff(column_bytes(part.column(1))[1])
            yield record(_SCORE_SCHEMA, [part.column(0), size, part.column(5).field(0), *views.value.scores(*views.value.places(part))])
    release()


def platt(scores: np.ndarray, good: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes (a column of scores each) and offset of a weighted logistic fit by Newton steps, with a small ridge on the slopes."""
    scale = scores.std(0)
    scale[scale == 0] = 1.0
    x = np.column_stack((scores / scale, np.ones(len(scores))))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    ridge[-1] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (good - p)) - ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def _calibrate(views: Views, rows: DataFrame, labels: Labels, shared: Broadcast) -> Views:
    """Fits both calibrations and cuts on the held-out sample (at most 2 * LABELLED_ROWS / HELD_OUT ids), weighted to the classes' true shares.

    Of several rows of one id the one with the shortest text, then the least key, takes part. Without held-out
    rows of both classes nothing can be told apart, and every view says nothing.
    """
    current = rows.sparkSession.sparkContext.broadcast(views)
    held = rows.mapInArrow(lambda it: _held_task(it, shared, current), _SCORES)
    one = held.groupBy("doc_id").agg(F.min(F.struct("text", "key_a", "n_gram", "shape", "meta")).alias("r")).select("doc_id", "r.n_gram", "r.shape", "r.meta")
    found = np.array(sorted(tuple(r) for r in one.collect()), np.float64).reshape(-1, 4)
    good = np.isin(found[:, 0].astype(np.int64), labels.held_good).astype(float)
    if not 0 < good.sum() < len(good):
        return Views(np.zeros(_SIZES[0]), np.zeros(_SIZES[1]), np.zeros(_SIZES[2]))
    weight = np.where(good > 0, labels.share / good.mean(), (1 - labels.share) / (1 - good.mean()))
    for view, columns in (("text", [1, 2]), ("meta", [3])):
        views.calibration[view] = platt(found[:, columns], good, weight)
    for view, odds in views.odds(*found[:, 1:].T).items():
        views.cuts[view] = surest(odds, good, weight)
    views.prior = float(np.log(labels.share / (1 - labels.share)))
    return views


def fit(rows: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Views:
    """Both views after co-training; rows as in _inputs()."""
    context = rows.sparkSession.sparkContext
    sample = sample_labels(labels)
    shared = context.broadcast(sample)
    views: Views | None = None
    for _ in range(rounds + 1):
        current = None if views is None else context.broadcast(views)
        counts = summed(rows, lambda it, current=current: _count_task(it, shared, current), _TOTAL)
        views = _calibrate(Views(*map(_ratios, _tables(counts))), rows, sample, shared)
    return views


def _inputs(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    given = {c.lower() for c in docs.columns}
    column = lambda name, kind: F.col(name).cast(kind).alias(name) if name in given else F.lit(None).cast(kind).alias(name)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", column("source", "string"), column("lang", "string"), column("n_chars", "long"), row_key("doc_id", "text").alias("key"))


_VERDICT = f"key {KEY}, doc_id long, text_probability double, meta_probability double, probability double, kept boolean"
_VERDICT_SCHEMA = pa.schema([("key", KEY_TYPE), ("doc_id", pa.int64()), ("text_probability", pa.float64()), ("meta_probability", pa.float64()), ("probability", pa.float64()), ("kept", pa.bool_())])


def _verdict_task(batches: Iterator[pa.RecordBatch], views: Broadcast, least: float) -> Iterator[pa.RecordBatch]:
    model = views.value
    for batch in batches:
        for part in chunks(batch, limit=PART_BYTES):
            odds = model.odds(*model.scores(*model.places(part)))
            both = model.combined(odds)
            yield record(_VERDICT_SCHEMA, [part.column(5), part.column(0), probability(odds["text"]), probability(odds["meta"]), both, both >= least])
    release()


def quality_verdicts(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, reject_below: float = REJECT_BELOW) -> DataFrame:
    """(key, doc_id, text_probability, meta_probability, probability, kept) for every row.

    labels has doc_id and quality (1 good, 0 bad; others and nulls are ignored). kept is
    probability >= reject_below. A missing or null source, lang or n_chars is a value of its
    own; null and empty texts have no n-grams and stand at their view's offset; rows without
    doc_id are never labelled; unless both classes have rows to learn from and rows held out
    (two labelled rows of documents, in general), nothing is learned, all probabilities are a
    half and every row is kept; repeated rows are each scored; an empty table gives no rows. Other columns
    are not read. At most LABELLED_ROWS labelled rows of each class take part, one in HELD_OUT
    of them for calibration only; the exchange and the verdicts cover all rows.
    """
    rows = _inputs(docs)
    views = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, rounds))
    return rows.mapInArrow(lambda it: _verdict_task(it, views, reject_below), _VERDICT)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, in their columns, that the classifier keeps; texts don't travel.

    Nulls, repeated rows and missing labels count as in quality_verdicts(); an empty table
    gives no rows; further columns, of any name, pass through.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    views = docs.sparkSession.sparkContext.broadcast(fit(_inputs(docs), labels))
    schema, names = to_arrow_schema(docs.schema), [c.lower() for c in docs.columns]
    wanted = [names.index(c) if c in names else None for c in ("doc_id", "text", "source", "lang", "n_chars")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = [pa.nulls(batch.num_rows) if i is None else batch.column(i) for i in wanted]
            view = pa.RecordBatch.from_arrays(inputs, names=["doc_id", "text", "source", "lang", "n_chars"])
            model = views.value
            keep = [model.combined(model.odds(*model.scores(*model.places(part)))) >= REJECT_BELOW for part in chunks(view, limit=PART_BYTES)]
            kept = batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=schema)
        release()

    return docs.mapInArrow(task, docs.schema)
