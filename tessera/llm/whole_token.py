"""Token counts of byte-level BPE by a whole-token shortcut.

Most pre-tokens of a text are vocabulary strings. prove() finds, once and offline, the
vocabulary strings that are one pre-token by themselves and that the merges turn into
exactly one token; such a pre-token counts one without any merging. Only the rest goes
through the merges.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.plan import per_process, record, small_batches

#: Fixed value: the split pattern of byte-level BPE tokenizers with use_regex, by which texts become pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens beyond the proved ones whose counts a task remembers, and their longest length.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of a pre-token from which the merges go by a heap, in time n log n; the library's time is quadratic.
LONG_PIECE = 1024


@dataclass
class Proof:
    """whole: strings that alone are one token; special: strings that become one token wherever they occur;
    ranks: the merge rank of each byte string."""

    whole: list[str]
    special: list[str]
    ranks: dict[bytes, int]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def prove(path: str) -> Proof:
    """What a byte-level BPE .json file's vocabulary encodes alone as one token."""
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    kind = spec["pre_tokenizer"]
    if spec["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens that depend on what stands beside them")
    tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
    vocabulary, special = spec["model"]["vocab"], [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(alphabet[c] for c in s): i for s, i in vocabulary.items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    if len(ranks) != len(vocabulary) or made != sorted(made):
        raise ValueError(f"{path}: ranks of merges are not those of the tokens that they make")
    whole, pattern = [], regex.compile(PATTERN)
    candidates = [(b.decode("utf-8"), i) for b, i in ranks.items() if _is_utf8(b)]
    for (text, i), got in zip(candidates, tokenizer.encode_batch([t for t, _ in candidates], add_special_tokens=False), strict=True):
        if got.ids == [i] and pattern.fullmatch(text) and pattern.findall(text) == [text] and text not in special:
            whole.append(text)
    return Proof(whole, special, ranks)


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a byte string: the adjacent pair of least rank, the first of equals, is merged until none has one."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    tokens = n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:  # one of both has been merged since
            continue
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
        tokens -= 1
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(piece[left : end[right]])) is not None:
                heapq.heappush(heap, (r, left, end[right]))
    return tokens


class Pieces(dict):
    """Tokens of each pre-token: one for the proved ones, the merges' result for the others."""

    def __init__(self, proof: Proof):
        import tiktoken

        super().__init__(dict.fromkeys(proof.whole, 1))
        self.fixed, self.ranks = len(self), proof.ranks
        # By itself: the encoding would split the piece again, by recursion that very long white space exhausts.
        self.merge = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=proof.ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8", "surrogatepass")
        n = len(self.merge(raw)) if len(raw) < LONG_PIECE else merged_length(raw, self.ranks)
        if len(self) - self.fixed < REMEMBERED and len(piece) <= LONGEST:
            self[piece] = n
        return n


class TokenCounter:
    def __init__(self, proof: Proof):
        self.pieces, self.find = Pieces(proof), regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(proof.special, key=len, reverse=True)))) if proof.special else None

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.pieces.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.pieces.__getitem__, self.find(part))) for part in parts)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _count_task(batches: Iterator[pa.RecordBatch], proof: Broadcast, limit: int) -> Iterator[pa.RecordBatch]:
    count = per_process("tokens", proof, TokenCounter)
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [count(t) for t in texts]
        yield record(_SCHEMA, [batch.column(0), [len(t.encode("utf-8", "surrogatepass")) for t in texts], tokens, [n > limit for n in tokens]])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes, tokens, and n_tokens > limit.

    tokenizer is a byte-level BPE file of the tokenizers library, whose counts without begin
    and end tokens these are; special strings inside texts are one token each, as by its
    default. Null and empty texts have no tokens; long texts are counted whole; repeated
    rows are each counted; an empty table gives no rows. Other columns are not read. What is
    broadcast has the size of the vocabulary.
    """
    proof = docs.sparkSession.sparkContext.broadcast(prove(tokenizer))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _count_task(it, proof, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
