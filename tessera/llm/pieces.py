"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a Viterbi pass.

The automaton over all pieces reads a text once. At each position its output links give
the pieces that end there, longest first, and each is relaxed against the best path to
where it starts. In a unigram model a path's score is the sum of its pieces' scores. In
a BPE model only neighbours that merging leaves apart may follow one another; exactly one
such path leads to each position, so the pass gives what merging gives.

No piece holds a space mark after another character, so texts are cut before their space
marks and the parts of recent texts are remembered.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.llm.plan import per_process, record, release, small_batches

#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
#: Parts of texts, and pairs of pieces, that a task remembers, and a part's longest length.
REMEMBERED, PAIRS, LONGEST = 250_000, 500_000, 64
_NONE, _UNKNOWN = -1, -2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer: varints and byte strings (fixed ones as bytes)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
            yield tag >> 3, value
        else:
            size, at = varint(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    """pieces and scores by id; kinds: normal, unknown, control, user or byte; merges: BPE, not unigram."""

    pieces: list[str]
    scores: list[float]
    kinds: list[str]
    merges: bool
    prefix: bool = True
    unknown: int = 0
    byte_ids: list[int] = field(default_factory=list)
    never: set[int] = field(default_factory=set)  # pieces that merging does not build from their letters


def load(path: str) -> Model:
    """A .model file whose texts are taken as they are (identity normalisation, every space kept)."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    spec: dict[int, bytes] = {k: v for k, v in _fields(open(path, "rb").read()) if k in (2, 3)}
    trainer, normaliser = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
    if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
        raise ValueError(f"{path} normalises its texts")
    ids = range(library.get_piece_size())
    kind = lambda i: "unknown" if library.is_unknown(i) else "control" if library.is_control(i) else "byte" if library.is_byte(i) else "unused" if library.is_unused(i) else "normal"
    kinds = [kind(i) for i in ids]
    pieces = [library.id_to_piece(i) for i in ids]
    if any(k == "unused" for k in kinds) or any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds, strict=True) if k == "normal"):
        raise ValueError(f"{path} has pieces that this encoder does not know")
    by_byte = {int(pieces[i][3:5], 16): i for i in ids if kinds[i] == "byte"}
    model = Model(pieces, [library.get_score(i) for i in ids], kinds, trainer.get(3, 1) == 2, bool(normaliser.get(3, 1)), library.unk_id(), [by_byte[b] for b in range(256)] if by_byte else [])
    if model.merges:
        encoder = Encoder(model)
        model.never = {i for p, i in encoder.ids.items() if encoder.merged(p) != [i]}
    return model


class _Known(dict):
    """Ids of recent parts; a missing one is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> list[int]:
        found = self.encode(part)
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = found
        return found


class Encoder:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == "normal"}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.known = _Known(self.encode_part)
        self.lengths = [len(p) for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if i not in model.never:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: Pieces of equal score are merged from the left, which neighbours alone don't show.
        scores: dict[float, int] = {}
        for i in self.ids.values():
            scores[model.scores[i]] = scores.get(model.scores[i], 0) + 1
        tied = {p for p, i in self.ids.items() if scores[model.scores[i]] > 1 and len(p) > 1}
        if model.merges and any(set(p) != {MARK} for p in tied):
            raise ValueError("pieces of equal score")
        self.part = self._parts()

    def _parts(self) -> re.Pattern:
        """Cuts texts where no piece can span: before space marks, around characters that no longer piece
        holds, and between a letter and a sign that follows a letter in no piece."""
        longer = [p for p in self.ids if len(p) > 1]
        joined = {c for p in longer for c in p}
        after_letter = {b for p in longer for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        alone = re.escape("".join(c for c in map(chr, range(128)) if c not in joined and c != " "))
        signs = re.escape("".join(c for c in map(chr, range(33, 127)) if c in joined and not c.isalnum() and c not in after_letter))
        # A run without signs goes on over a sign only if it does not end in a letter.
        sign, lone = f"[{signs}]" if signs else "(?!)", f"[{alone}]" if alone else "(?!)"
        plain, on = f"[^{MARK}{signs}{alone}]", f"(?:(?<![^\\W\\d_]){sign}[^{MARK}{alone}]*)?"
        return re.compile(f"{MARK}+{plain}*{on}|{plain}+{on}|(?:{lone})+|{sign}[^{MARK}{alone}]*")

    def merged(self, text: str) -> list[int]:
        """By the definition of BPE: the adjacent pair of the best score, the leftmost of equals, is merged until none is left."""
        symbols: list[str] = list(text)
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap: list = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else -1
            if right >= 0 and (i := self.ids.get(symbols[left] + symbols[right])) is not None:
                heapq.heappush(heap, (-self.model.scores[i], left, right, len(symbols[left]), len(symbols[right])))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, left, right, n, m = heapq.heappop(heap)
            if len(symbols[left]) != n or len(symbols[right]) != m or after[left] != right or not n or not m:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [i for s in symbols if s for i in ([self.ids[s]] if s in self.ids else self._fallback(s))]

    def _fallback(self, letter: str) -> list[int]:
        if not self.model.byte_ids:
            return [self.model.unknown]
        return [self.model.byte_ids[b] for b in letter.encode("utf-8", "surrogatepass")]

    def apart(self, one: int, two: int) -> bool:
        """Whether merging the letters of both pieces gives just these two."""
        pair = one << 32 | two
        found = self.pairs.get(pair)
        if found is None:
            found = self.merged(self.model.pieces[one] + self.model.pieces[two]) == [one, two]
            if len(self.pairs) < PAIRS:
                self.pairs[pair] = found
        return found

    def viterbi(self, part: str) -> list[int]:
        """The best path over a part without runs of marks."""
        n, letters, lengths = len(part), self.letters, self.lengths
        last = [_NONE] * (n + 1)
        last[0] = _UNKNOWN
        if not letters.issuperset(part):
            for i, c in enumerate(part):
                if c not in letters:
                    last[i + 1] = _UNKNOWN
        if self.model.merges:
            pairs, apart = self.pairs.get, self.apart
            for end, piece in self.automaton.iter(part):
                if last[end + 1] == _NONE:
                    before = last[end + 1 - lengths[piece]]
                    if before == _UNKNOWN:
                        last[end + 1] = piece
                    elif before != _NONE:
                        free = pairs(before << 32 | piece)
                        if free or free is None and apart(before, piece):
                            last[end + 1] = piece
        else:
            # An unknown letter scores ten below the worst piece, as the library has it.
            scores, low = self.model.scores, min(self.model.scores[i] for i in self.ids.values()) - 10
            best = [float("-inf")] * (n + 1)
            best[0], reached = 0.0, 0
            for end, piece in self.automaton.iter(part):
                while reached < end:
                    reached += 1
                    if last[reached] == _UNKNOWN:
                        best[reached] = best[reached - 1] + low
                score = best[end + 1 - lengths[piece]] + scores[piece]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1] = score, piece
        out: list[int] = []
        while n:
            piece = last[n]
            if piece == _UNKNOWN:
                out += reversed(self._fallback(part[n - 1]))
                n -= 1
            else:
                out.append(piece)
                n -= lengths[piece]
        out.reverse()
        return out

    def encode_part(self, part: str) -> list[int]:
        return self.merged(part) if self.model.merges and part.startswith(MARK * 2) else self.viterbi(part)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (MARK if self.model.prefix else "") + text.replace(" ", MARK)
        return list(chain.from_iterable(map(self.known.__getitem__, self.part.findall(text))))

    def decode(self, ids: list[int]) -> str:
        pieces, kinds = self.model.pieces, self.model.kinds
        if self.model.byte_ids and not self._special.isdisjoint(ids):
            out: list[str] = []
            raw = bytearray()
            for i in ids:
                if kinds[i] == "byte":
                    raw.append(int(pieces[i][3:5], 16))
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(" ⁇ " if kinds[i] == "unknown" else "" if kinds[i] == "control" else pieces[i])
            text = "".join([*out, raw.decode("utf-8", "replace")])
        else:
            text = "".join([pieces[i] for i in ids])
        if self.model.prefix and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")

    @property
    def _special(self) -> set[int]:
        made = self.__dict__.get("special")
        if made is None:
            made = self.__dict__["special"] = {i for i, k in enumerate(self.model.kinds) if k != "normal"}
        return made


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def _digest_task(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder = per_process("pieces", model, Encoder)
    low, high = (min(encoder.model.byte_ids), max(encoder.model.byte_ids)) if encoder.model.byte_ids else (0, -1)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encoder.encode(text or "")
            array = np.array(ids, "<u4")
            rows.append((doc_id, len(ids), int(((array >= low) & (array <= high)).sum()), zlib.crc32(array.tobytes()), encoder.decode(ids) == (text or "").replace(MARK, " ")))
        yield record(_SCHEMA, list(zip(*rows, strict=True)) if rows else [[]] * 5)
    release()


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_crc32, round_trip) for every row.

    Whole texts are encoded, without begin and end pieces, and decoded again; ids_crc32 is of
    the ids as little-endian 32-bit integers, and round_trip tells whether decoding gave the
    text back (a space mark in a text comes back as a space). Null and empty texts have no
    pieces; letters without a piece become byte pieces; repeated rows are each encoded; an
    empty table gives no rows. Other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _digest_task(it, model), "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")


def _encode_task(batches: Iterator[pa.RecordBatch], model: Broadcast, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, at = per_process("pieces", model, Encoder), None
    for batch in batches:
        at = [name.lower() for name in batch.schema.names].index("text") if at is None else at
        yield record(schema, [*batch.columns, [encoder.encode(t or "") for t in batch.column(at).to_pylist()]])
    release()


def encoded(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """docs with one more column: the piece ids of text, an empty list where it is null or empty.

    A column of docs that has the new one's name is replaced, further columns pass through;
    repeated rows are each encoded, whole; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))
    small_batches(docs.sparkSession)
    docs = docs.drop(column)
    out = StructType([*docs.schema.fields, StructField(column, ArrayType(IntegerType(), False))])
    return docs.mapInArrow(lambda it: _encode_task(it, model, to_arrow_schema(out)), out)


def _decode_task(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    encoder = per_process("pieces", model, Encoder)
    for batch in batches:
        yield record(pa.schema([("key", pa.int64()), ("text", pa.string())]), [batch.column(0), [encoder.decode(x or []) for x in batch.column(1).to_pylist()]])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(key, text) from rows (key long, ids array<int>).

    A null or empty list gives an empty text; repeated rows are each decoded; an empty table
    gives no rows; other columns are not read.
    """
    model = rows.sparkSession.sparkContext.broadcast(load(path))
    return rows.select("key", "ids").mapInArrow(lambda it: _decode_task(it, model), "key long, text string")
