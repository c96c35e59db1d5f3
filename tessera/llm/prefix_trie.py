"""A prefix trie of conversations as intervals of a preorder.

Conversations are ranked lexicographically by their turns. A node, a distinct sequence of
first turns, is shared by conversations of consecutive ranks, so it stands in the preorder
at (rank of its first conversation, depth), and its subtree ends where the first later
conversation begins that does not share it. Places in the preorder and totals of leaves and
savings before each place are prefix sums over ranges of ranks; what a subtree holds is the
total at its end less the total at its start.

A conversation is one row of 24 bytes a turn (a 128-bit hash and the text's size), so two
turns are the same if their hashes are; texts do not travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import spread_join
from tessera.llm.places import numbered, totals_before
from tessera.llm.plan import materialise, record, row_key
from tessera.llm.text import mix

#: Turns that a conversation may take over from another one, and how far apart the ones it is taken over from are.
LONGEST_HEAD, HEAD_EVERY = 8, 5
#: Ranks whose nodes are sorted in one task, at least, and ids of one piece of a list of ids.
STEP, PIECE = 1 << 10, 1 << 12
#: Turns unpacked at a time.
_TURNS = 1 << 17

_TURN = "struct<a:bigint,b:bigint,n:bigint>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's turns in order, as hashes of role and text with the text's bytes.

    Null roles and texts count as empty. Turns come by their number, null first, and for
    one number by their hash; repeated rows are repeated turns; rows without conv_id belong
    to no conversation.
    """
    plain = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = plain.select("conv_id", F.struct("turn", row_key("role", "text").alias("key"), F.octet_length("text").cast("long").alias("n")).alias("t"))
    path = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"]["a"].alias("a"), t["key"]["b"].alias("b"), t["n"].alias("n")))
    return hashed.groupBy("conv_id").agg(path.alias("path"))


def rebuilt(paths: DataFrame, every: int = HEAD_EVERY) -> DataFrame:
    """(conv_id, path) with the first h turns of conversation c - c % every before c's own after its first h; h is crc32(c) % (LONGEST_HEAD + 1)."""
    heads = paths.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__from"), F.slice("path", 1, LONGEST_HEAD).alias("__head"))
    joined = paths.withColumn("__from", F.col("conv_id") - F.col("conv_id") % every).join(heads, "__from", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LONGEST_HEAD + 1)).cast("int")
    head = F.slice(F.coalesce("__head", F.array().cast(f"array<{_TURN}>")), F.lit(1), h)
    return joined.select("conv_id", F.concat(head, F.slice("path", h + 1, F.size("path"))).alias("path"))


_NODE = "depth long, a long, b long, up_a long, up_b long, n_bytes long, rank long, conv_id long, is_end boolean"
_NODE_SCHEMA = pa.schema([(name, pa.bool_() if name == "is_end" else pa.int64()) for name in (x.split()[0] for x in _NODE.split(", "))])
_SALTS = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


def _prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each prefix of each path, the empty one first; its key sums up (by exclusive or) hashes of its turns at their places."""
    paths = batch.column(2)
    turns, at = paths.flatten(), np.concatenate(([0], np.cumsum(paths.value_lengths().to_numpy())))
    size = np.diff(at) + 1
    root = np.cumsum(size) - size
    n = int(size.sum())
    owner = np.repeat(np.arange(len(size)), size)
    depth = np.arange(n) - root[owner]
    own = depth > 0
    columns = []
    for which, salt in enumerate(_SALTS):
        value = np.zeros(n, np.uint64)
        value[own] = mix(turns.field(which).to_numpy().view(np.uint64) ^ mix(depth[own].astype(np.uint64) * salt))
        total = np.bitwise_xor.accumulate(value)
        key = total ^ total[root][owner]
        columns.append((key, np.concatenate(([np.uint64(0)], key[:-1]))))
    n_bytes = np.zeros(n, np.int64)
    n_bytes[own] = turns.field(2).to_numpy()
    (a, up_a), (b, up_b) = columns
    end = np.zeros(n, bool)
    end[root + size - 1] = True
    rank, conv = (batch.column(k).to_numpy()[owner] for k in (1, 0))
    return record(_NODE_SCHEMA, [depth, a.view(np.int64), b.view(np.int64), up_a.view(np.int64), up_b.view(np.int64), n_bytes, rank, conv, end])


def _prefix_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy() + 1)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + _TURNS, "right")) - 1)
            yield _prefixes(batch.slice(low, high - low))
            low = high


_DIGEST = "depth long, a long, b long, ends_sha256 string"
_DIGEST_SCHEMA = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists whose pieces come behind one another; only the current list's digest is kept."""
    node, state = None, None
    done: list[tuple] = []
    for batch in batches:
        for depth, a, b, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if node == (depth, a, b):
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (depth, a, b), hashlib.sha256(ids.encode())
        if len(done) > 10_000:
            yield record(_DIGEST_SCHEMA, zip(*done))
            done = []
    if node is not None:
        done.append((*node, state.hexdigest()))
        yield record(_DIGEST_SCHEMA, zip(*done))


def end_digests(prefixes: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes where conversations end: the digest of their ids, ascending and joined by commas.

    Equal conversations are ranked by their ids, so pieces of a range of ranks are joined
    first; the task that digests a node reads these one after another.
    """
    node = ["depth", "a", "b"]
    pieces = prefixes.filter("is_end").withColumn("piece", F.expr(f"rank div {PIECE}")).groupBy(*node, "piece").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return pieces.repartition(*node).sortWithinPartitions(*node, "piece").mapInArrow(_digest_task, _DIGEST)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, path), conv_id being unique: start and end in the preorder, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ranked = numbered(paths.select("conv_id", "path"), [F.col("path"), F.col("conv_id")], "rank").select("conv_id", "rank", "path")
    prefixes = ranked.mapInArrow(_prefix_task, _NODE)
    node, up = ["depth", "a", "b"], ["up_depth", "up_a", "up_b"]
    least = prefixes.groupBy(*node).agg(F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.max("n_bytes").alias("n_bytes"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = materialise(least.withColumn("up_depth", F.col("depth") - 1), "nodes")
    children = nodes.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("up_depth").alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), "n_children")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    nodes = materialise(nodes.join(children, node, "left").join(end_digests(prefixes), node, "left").select(*node, *up, "rank", "n_convs", "conv_id", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), saved.alias("saved"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")), "nodes")
    parents = nodes.filter("n_children > 0").select(F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("times"))
    total, n_convs = nodes.agg(F.count(F.lit(1)), F.max("n_convs")).first()
    nodes = spread_join(nodes, parents, up, "times", total, "left")
    step = max(STEP, int((n_convs or 0) ** 0.5))
    nodes = nodes.withColumns({"one": F.lit(1).cast("long"), "leaf": (F.col("n_children") == 0).cast("long"), "step": F.expr(f"rank div {step}")})
    sums = {"start": "one", "leaves": "leaf", "savings": "saved"}
    placed = materialise(totals_before(nodes, [], "step", ["rank", "depth"], sums), "preorder")
    # The conversation after a subtree differs from the one before it, so a node begins there; behind the last one everything ends.
    begins = placed.groupBy(F.col("rank").alias("after")).agg(*[F.min(a).alias(f"{a}_end") for a in sums])
    everything = placed.agg(*[F.sum(c).alias(f"{a}_all") for a, c in sums.items()])  # one row
    ended = placed.withColumn("after", F.col("rank") + F.col("n_convs")).join(begins, "after", "left").join(F.broadcast(everything))
    inside = lambda a: F.coalesce(f"{a}_end", f"{a}_all") - F.col(a)
    return ended.select("start", F.coalesce("start_end", "start_all").alias("end"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", inside("leaves").alias("n_leaves"), inside("savings").alias("saved_tokens"), "ends_sha256")


def conversation_trie(turns: DataFrame, every: int = HEAD_EVERY) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; turns has conv_id, turn, role and text.

    What nulls, ties and repeated rows mean is said in conversations(); a conversation that
    is rebuilt without turns ends at the root; without conversations there are no nodes;
    other columns are not read.
    """
    return trie(rebuilt(materialise(conversations(turns), "conversations"), every))
