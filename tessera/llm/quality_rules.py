"""Quality rules: surface statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted: one over trusted texts, one over the
whole corpus. A text's score is its log-likelihood ratio between them divided by its
number of n-grams; a text below the threshold is dropped, every time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.ngrams import BITS, counted, slots, summed, text_means
from tessera.llm.plan import record, small_batches
from tessera.llm.text import WHITE, Words, chunks, column_bytes

#: Trusted labelled rows at most that the target multinomial is fitted on, by the order of a hash of their id.
TRUSTED_ROWS = 20_000
#: Least score of a text that stays: mean log ratio an n-gram.
THRESHOLD = -0.6
#: Weight, in n-grams, of the uniform distribution in both multinomials.
SMOOTHING = 1.0

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def repeated_in_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of these values occur twice or more in their text."""
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(hashes), bool)
    again = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    same[order[1:][again]] = True
    same[order[:-1][again]] = True
    return same


def later_in_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of these values equal an earlier one of their text."""
    order = np.lexsort((np.arange(len(hashes)), hashes, owner))
    later = np.zeros(len(hashes), bool)
    later[order[1:][(hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])]] = True
    return later


_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def surface(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    words = Words(raw, offsets, fold=False)
    n = words.counts()
    starts, hashes = words.windows(3)
    owner = np.repeat(np.arange(len(n)), np.maximum(n - 2, 0))
    twice = starts[repeated_in_text(hashes, owner)]
    covered = np.zeros(len(words.hashes) + 3, bool)
    for j in range(3):
        covered[twice + j] = True
    repeats = np.concatenate(([0], np.cumsum(covered[: len(words.hashes)])))
    # A line is a run without \n; empty lines hold no word and are left out anyway.
    lines = Words(raw, offsets, separators=_NEWLINE, fold=False)
    filled = np.concatenate(([0], np.cumsum(~WHITE[raw])))
    wordy = filled[lines.end] > filled[lines.start]
    line_owner = lines.owner()[wordy]
    dup = np.bincount(line_owner[later_in_text(lines.hashes[wordy], line_owner)], minlength=len(n))
    return {"n_words": n, "word_chars": total(~WHITE[raw] & ((raw & 0xC0) != 0x80)), "n_symbols": total(_SYMBOLS[raw]), "n_dup_lines": dup, "n_repeat_words": repeats[words.first[1:]] - repeats[words.first[:-1]]}


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> list[int]:
    """At most so many doc_ids of labels with quality 1."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return [d for (d,) in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


def _fit_task(batches: Iterator[pa.RecordBatch], trusted: Broadcast) -> Iterator[np.ndarray]:
    total = np.zeros((2, 1 << BITS), np.int64)
    everything = lambda part: np.ones(part.num_rows, bool)
    target = lambda part: np.isin(part.column(0).to_numpy(zero_copy_only=False), trusted.value)
    for batch in batches:
        total += counted(batch, [target, everything])
    if total.any():
        yield total.reshape(-1)


def log_ratios(rows: DataFrame, trusted: list[int]) -> np.ndarray:
    """log P(n-gram | trusted) - log P(n-gram | corpus) by slot; rows has doc_id and text."""
    ids = rows.sparkSession.sparkContext.broadcast(np.array(sorted(trusted), np.int64))
    target, corpus = summed(rows, lambda it: _fit_task(it, ids), 2 << BITS).reshape(2, -1)
    if not target.any():  # nothing is trusted: no text is told from the corpus
        return np.zeros(1 << BITS)
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)))
    return share(target) - share(corpus)


_RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def _rules_task(batches: Iterator[pa.RecordBatch], ratios: Broadcast, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            raw, offsets = column_bytes(part.column(1))
            found = surface(raw, offsets)
            slot, at = slots(raw, offsets)
            score = text_means(ratios.value[slot], at)
            failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
            yield record(_SCHEMA, [part.column(0), *[v.astype(np.int64) for v in found.values()], failed, ~failed & (score >= threshold), score])


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) for every row.

    Words are runs without ASCII white space. word_chars counts code points in words,
    n_symbols the characters #*$%&|<>, n_dup_lines lines with a word that equal an earlier
    line, n_repeat_words words inside 3-word windows that the text holds twice or more.
    base_failed: fewer than 50 words, or more than half of them repeated. kept: not failed
    and score >= threshold. Null and empty texts have no words and fail; rows without doc_id
    are never trusted; without trusted rows every score is 0; repeated rows are each judged
    and each count in the corpus; an empty table gives no rows. Other columns are not read.
    The corpus multinomial covers all texts; the target one the texts of at most
    TRUSTED_ROWS labelled rows of quality 1.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(rows, trusted_ids(labels)))
    return rows.mapInArrow(lambda it: _rules_task(it, ratios, threshold), _RULES)
