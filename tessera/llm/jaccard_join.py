"""N-gram Jaccard join by a grouped prefix join.

Each document is the set of its 5-word shingles. A global order puts rare shingles
first; documents with the same size and the same prefix in that order form a group.
Groups that share a prefix token and whose sizes allow the threshold are candidate
pairs; groups are then expanded to their members and members are verified on whole
sets. Only the classes of linked documents are asked for, so a pair that is already in
one class need not be tested: first every group meets one group of each of its token
lists, classes are formed, and only then do all pairs that still cross classes meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.filters import contains, filter_bits, member_filter, pack, unpack
from tessera.llm.graph import components, spread_join
from tessera.llm.plan import KEY, KEY_TYPE, bucket_count, forget, join_blobs, key_arrays, keyed, materialise, record, release, text_bytes
from tessera.llm.text import Words, chunks, column_bytes, mix, no_wider, shingles

#: Slots of the table that orders shingles by how common they are, and rows it travels in.
SLOT_BITS, SLOT_ROWS = 22, 64
#: Entries that a task gathers before it hands them to the buckets.
FLUSH = 1_000_000
#: Groups of a token's list that meet in one task; a longer list is joined in blocks.
LIST_BLOCK = 4_000
#: Counts of a slot, and how many times the mean one, from which its tokens' lists are dealt to several buckets.
HOT_SLOT, HOT_TIMES = 100_000, 8
#: Rounds in which every group meets one other of each list.
STAR_ROUNDS = 2
#: Lists up to this long drop members that no other member can match.
SHORT_LIST = 32

_SLOTS = "part int, counts binary"
_FIELDS = [
    ("kind", pa.int32()), ("bucket", pa.int32()), ("key", KEY_TYPE), ("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("cid2", pa.int64()), ("gkey", pa.int64()), ("vec", pa.binary()),
    ("token", pa.int64()), ("place", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("tokens", pa.binary()), ("gkeys", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("cuts", pa.binary()),
]
_MIXED = ", ".join(f"{name} {KEY if kind == KEY_TYPE else {pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'}[kind]}" for name, kind in _FIELDS)
_SALT = np.uint64(0x5851F42D4C957F2D)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _class_ids(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each set's 128-bit key: independent sums of mixed members, with the size."""
    n = np.diff(offsets).astype(np.uint64)
    one = _segment_sum(mix(hashes ^ _SALT), offsets)
    two = _segment_sum(mix(hashes + _SALT), offsets)
    return mix(one + n).view(np.int64), mix(two ^ n).view(np.int64)


def _count_task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    for batch in batches:
        for part in chunks(batch):
            np.add.at(counts, _slots(shingles(Words(*column_bytes(part.column(2))), width)[0]), 1)
    if counts.any():
        rows = _levels(counts).reshape(SLOT_ROWS, -1)
        yield record(pa.schema([("part", pa.int32()), ("counts", pa.binary())]), [list(range(SLOT_ROWS)), [x.tobytes() for x in rows]])
    release()


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as levels of a byte, 6 for each doubling: 0 for none, exact to some 6 percent."""
    return np.minimum(np.rint(np.log2(counts + 1.0) * 6), 255).astype(np.uint8)


def _counts(levels: np.ndarray) -> np.ndarray:
    return np.exp2(levels / 6.0) - 1


def _sum_slots(table: pa.Table) -> pa.Table:
    total = sum(_counts(np.frombuffer(x, np.uint8)) for x in table["counts"].to_pylist())
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "counts": pa.array([_levels(total).tobytes()], pa.binary())})


def slot_levels(rows: DataFrame, width: int) -> np.ndarray:
    """How common the shingles of each slot are, as levels 0..255, counted over all texts.

    The table has 2 ** SLOT_BITS bytes whatever the input, so it may be broadcast. Any
    levels give right results: they only decide how few candidates there are, and into how
    many blocks a long list is cut.
    """
    partial = rows.mapInArrow(lambda it: _count_task(it, width), _SLOTS)
    levels = np.zeros((SLOT_ROWS, (1 << SLOT_BITS) // SLOT_ROWS), np.uint8)
    for part, blob in partial.groupBy("part").applyInArrow(_sum_slots, _SLOTS).collect():
        levels[part] = np.frombuffer(blob, np.uint8)
    return levels.reshape(-1)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n members has with any set it is linked with."""
    return -(-n * percent // 100)


def _vectors(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set the counts of its members by their low bits: the minima of two such
    vectors, summed, bound the overlap from above. Empty if a count exceeds a byte."""
    n = np.diff(offsets)
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(n, 1) / 4)).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), n)
    base = np.concatenate(([0], np.cumsum(1 << bits)))
    cell = base[owner] + (hashes & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))[owner]).astype(np.int64)
    counts = np.bincount(cell, minlength=base[-1])
    return [b"" if len(x) and x.max() > 255 else x.astype(np.uint8).tobytes() for x in (counts[a:b] for a, b in zip(base[:-1], base[1:], strict=True))]


def overlap_bound(one: bytes, two: bytes) -> float:
    """An upper bound of the overlap of two sets from their vectors."""
    if not one or not two:
        return float("inf")
    a, b = np.frombuffer(one, np.uint8).astype(np.int64), np.frombuffer(two, np.uint8).astype(np.int64)
    if len(a) > len(b):
        a, b = b, a
    return float(np.minimum(a, b.reshape(-1, len(a)).sum(0)).sum())


def _mixed(k: int, **columns) -> pa.RecordBatch:
    return record(pa.schema(_FIELDS), [columns.get(name, pa.nulls(k, kind)) for name, kind in _FIELDS])


def hot_slot(levels: np.ndarray) -> float:
    """The count that a part of a hot list has at most, about."""
    return max(HOT_SLOT, HOT_TIMES * float(_counts(np.arange(256)) @ np.bincount(levels, minlength=256)) / len(levels))


def _part(gkey: np.ndarray, parts: np.ndarray, salt: np.uint64 = _SALT) -> np.ndarray:
    """Which of so many parts of a list each group is in."""
    return (mix(gkey ^ salt) % parts.astype(np.uint64)).astype(np.int64)


def _prefix_task(batches: Iterator[pa.RecordBatch], levels: Broadcast, width: int, percent: int, buckets: int, most: float) -> Iterator[pa.RecordBatch]:
    """Documents (kind 0) and, by bucket, the prefix tokens of their groups (kind 1). The parts of a hot list go to the buckets after its token's."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    level = levels.value
    cut_of = np.ceil(_counts(np.arange(256)) / most).clip(1).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        token, gkey, place, n = (np.concatenate(x) for x in zip(*held, strict=True))
        cuts = cut_of[level[_slots(token)]]
        bucket = ((token >> np.uint64(32)).astype(np.int64) + _part(gkey, cuts)) % buckets
        order = np.lexsort((place, n, gkey, token, bucket))
        bucket, token, gkey, place, n, cuts = (x[order] for x in (bucket, token, gkey, place, n, cuts))
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (gkey[1:] != gkey[:-1]) | (n[1:] != n[:-1])
        bucket, token, gkey, place, n, cuts = bucket[fresh], token[fresh].astype(np.uint32), gkey[fresh], place[fresh], n[fresh].astype(np.uint32), cuts[fresh].astype(np.uint32)
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(at))
        own = [slice(at[b], at[b + 1]) for b in full]
        yield _mixed(len(full), kind=[1] * len(full), bucket=full.tolist(), tokens=[token[c].tobytes() for c in own], gkeys=[gkey[c].tobytes() for c in own], places=[pack(place[c]) for c in own], sizes=[pack(n[c]) for c in own], cuts=[pack(cuts[c]) for c in own])

    for batch in batches:
        for part in chunks(batch):
            hashes, offsets = shingles(Words(*column_bytes(part.column(2))), width)
            n = np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.argsort(owner * 256 + level[_slots(hashes)], kind="stable")
            place = np.arange(len(hashes)) - offsets[owner]
            inside = place < (n - needed(n, percent) + 1)[owner]
            token, mine = hashes[order][inside], owner[inside]
            prefix = _segment_sum(mix(token ^ _SALT), np.searchsorted(mine, np.arange(len(n) + 1)))
            gkey = mix(mix(prefix) + n.astype(np.uint64))
            key, (cid, cid2) = part.column(0), _class_ids(hashes, offsets)
            yield _mixed(len(n), kind=[0] * len(n), bucket=(key_arrays(key)[0].view(np.uint64) % np.uint64(buckets)).astype(np.int32), key=key, doc_id=part.column(1), n=n.astype(np.int64), cid=cid, cid2=cid2, gkey=gkey.view(np.int64), vec=_vectors(hashes, offsets))
            held.append((token, gkey[mine], place[inside].astype(np.uint32), n[mine]))
            size += len(token)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()
    release()


def _fits(na: np.ndarray, nb: np.ndarray, pa_: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the places of a shared token allow the threshold. If it is the first one they
    share, nothing before it is shared, so the overlap is at most what is left of either; at a later
    one the bound is lower, and the pair has been let through at the first."""
    left = np.minimum(na - pa_, nb - pb)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * left >= percent * (na + nb))


def _bucket_task(table: pa.Table, percent: int, buckets: int, most: float, block_size: int) -> pa.Table:
    """Passes documents on; keeps the lists (kind 1) of tokens that two groups or more share, in blocks. A hot list's parts, of most groups
    each, lie in several buckets and stay whole."""
    kinds = table["kind"].to_numpy()
    docs = table.filter(pa.array(kinds == 0))
    lists = table.filter(pa.array(kinds == 1))
    if not lists.num_rows:
        return docs
    token = np.frombuffer(join_blobs(lists["tokens"]), np.uint32)
    gkey = np.frombuffer(join_blobs(lists["gkeys"]), np.uint64)
    place, n, cuts = (np.concatenate([unpack(x, np.uint32) for x in lists[c].to_pylist()]).astype(np.int64) for c in ("places", "sizes", "cuts"))
    bucket = table["bucket"][0].as_py()
    part = _part(gkey, cuts)
    token = ((bucket - part) % buckets << 32) | token.astype(np.int64)
    order = np.lexsort((place, n, gkey, token))
    token, gkey, place, n, part, cuts = (x[order] for x in (token, gkey, place, n, part, cuts))
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (gkey[1:] != gkey[:-1]) | (n[1:] != n[:-1])
    token, gkey, place, n, part, cuts = (x[fresh] for x in (token, gkey, place, n, part, cuts))
    edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    length = np.repeat(np.diff(np.append(edge, len(token))), np.diff(np.append(edge, len(token))))
    shared = (length > 1) | (cuts > 1)
    token, gkey, place, n, part, cuts, length = (x[shared] for x in (token, gkey, place, n, part, cuts, length))
    viable = (length > SHORT_LIST) | (cuts > 1)
    for step in range(1, min(SHORT_LIST, len(token))):
        ok = (token[step:] == token[:-step]) & _fits(n[step:], n[:-step], place[step:], place[:-step], percent)
        viable[step:] |= ok
        viable[:-step] |= ok
    token, gkey, place, n, part, cuts, length = (x[viable] for x in (token, gkey, place, n, part, cuts, length))
    # All parts of a list have as many blocks.
    own = np.ceil(np.where(cuts > 1, most, length) / block_size).astype(np.int64)
    block, cuts = part * own + _part(gkey, own, ~_SALT), cuts * own
    found = _mixed(len(token), kind=[1] * len(token), bucket=[bucket] * len(token), gkey=gkey.view(np.int64), token=token, place=place.astype(np.int32), n=n, block=block.astype(np.int32), blocks=cuts.astype(np.int32))
    return pa.concat_tables([docs, pa.Table.from_batches([found])])


def _bound_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb, veca, vecb, …) whose vectors allow the threshold, as (a, b, …)."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        least = -(-(na + nb) * percent // (100 + percent))
        keep = [overlap_bound(x, y) >= m for x, y, m in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), least, strict=True)]
        yield batch.select([c for i, c in enumerate(batch.schema.names) if i not in (2, 3, 4, 5)]).filter(pa.array(keep, pa.bool_()))


def _verify_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sa, sb) whose whole sets reach the threshold, as edges (u, v)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        keep = []
        for one, two in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield record(schema, [batch.column(0).filter(keep), batch.column(1).filter(keep)])


def _sets_task(batches: Iterator[pa.RecordBatch], wanted: Broadcast, width: int) -> Iterator[pa.RecordBatch]:
    """(cid, cid2, members) of the documents that may be candidates."""
    schema, seen = pa.schema([("cid", pa.int64()), ("cid2", pa.int64()), ("members", pa.binary())]), set()
    for batch in batches:
        for part in chunks(batch):
            hashes, offsets = shingles(Words(*column_bytes(part.column(2))), width)
            cid, cid2 = _class_ids(hashes, offsets)
            hit = np.flatnonzero(contains(wanted, cid) & (np.diff(offsets) > 0))
            hit = [i for i in hit if (cid[i], cid2[i]) not in seen and not seen.add((cid[i], cid2[i]))]
            yield record(schema, [cid[hit], cid2[hit], [hashes[offsets[i] : offsets[i + 1]].tobytes() for i in hit]])
    release()


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, first_key) for every row of documents.

    Texts are lower-cased in A-Z and split at ASCII white space; two documents are linked
    if 100 * |intersection| >= percent * |union| of their shingle sets, and component_id is
    the least doc_id that links reach (null where no document of the class has an id).
    first_key is the key of the class's document with the least doc_id. Documents without
    words (null and empty texts) have no shingles, are linked with nothing and are their
    own class. Repeated rows are documents of one class. An empty table gives no rows.
    Shingles are held as 64-bit hashes, equal sets are told by 128 bits. Other columns of
    docs are not read.
    """
    no_wider(width)
    spark = docs.sparkSession
    rows = keyed(docs)
    buckets = bucket_count(docs)
    counted = slot_levels(rows, width)
    levels, most, block_size = spark.sparkContext.broadcast(counted), hot_slot(counted), LIST_BLOCK
    mixed = rows.mapInArrow(lambda it: _prefix_task(it, levels, width, percent, buckets, most), _MIXED)
    mixed = materialise(mixed.groupBy("bucket").applyInArrow(lambda t: _bucket_task(t, percent, buckets, most, block_size), _MIXED), "prefixes")

    forget(spark)
    documents = mixed.filter("kind = 0").select("key", "doc_id", "n", "cid", "cid2", "gkey", "vec")
    lists = mixed.filter("kind = 1").select("token", "gkey", "place", "block", "blocks")
    # Classes are documents of one set; each gets a number.
    classes = documents.filter("n > 0").groupBy("cid", "cid2").agg(F.min("n").alias("n"), F.min("gkey").alias("gkey"), F.min("vec").alias("vec"), F.count(F.lit(1)).alias("times"))
    classes = materialise(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    n_classes, total = (int(x or 0) for x in classes.agg(F.count(F.lit(1)), F.sum("times")).first())
    members = classes.select("gkey", "c", "n")
    groups = members.groupBy("gkey").agg(F.min("c").alias("head"), F.count(F.lit(1)).alias("size"), F.min("n").alias("n"))
    crowded = groups.filter("size > 1").select("gkey")

    wanted = classes.join(lists.select("gkey").union(crowded).distinct(), "gkey", "left_semi").select("cid")
    bits = member_filter(wanted, filter_bits(text_bytes(docs)))
    sets = materialise(rows.mapInArrow(lambda it: _sets_task(it, bits, width), "cid long, cid2 long, members binary"), "sets").dropDuplicates(["cid", "cid2"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Edges among distinct pairs (a, b) of classes."""
        one, two = (classes.select(F.col("c").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("n", "vec", "cid", "cid2")]) for x in "ab")
        fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        near = pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b", "na", "nb", "veca", "vecb", "cida", "cid2a", "cidb", "cid2b")
        near = near.mapInArrow(lambda it: _bound_task(it, percent), "a long, b long, cida long, cid2a long, cidb long, cid2b long")
        for x in "ab":
            near = near.join(sets.select(F.col("cid").alias(f"cid{x}"), F.col("cid2").alias(f"cid2{x}"), F.col("members").alias(f"s{x}")), [f"cid{x}", f"cid2{x}"])
        return materialise(near.select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify_task(it, percent), "u long, v long"), "links")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()

    def rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return nodes.withColumn("root", F.col("c"))
        return nodes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    # Sizes and the places of a shared token bound the overlap.
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb) AND {100 + percent} * least(na - pa, nb - pb) >= {percent} * (na + nb)"
    side = lambda d, x, *more: d.select("token", *more, F.col("c").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"))

    # First every group meets one of each list: the one with the fewest rarer shingles of its own, then any.
    # That one goes to each block of the list.
    heads = lists.join(groups.select("gkey", "n", F.col("head").alias("c")), "gkey")
    edges, roots = None, None
    for turn in range(STAR_ROUNDS):
        current = rooted(heads, roots)
        rank = F.col("place").cast("long") if not turn else F.xxhash64("c")
        center = current.groupBy("token").agg(F.min(F.struct(rank.alias("rank"), "c", "root", "n", "place")).alias("x"), F.max("root").alias("high"), F.min("root").alias("low"), F.max("blocks").alias("blocks"))
        center = center.filter("low < high").select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "x.c", "x.root", "x.n", "x.place")
        pairs = side(current, "a", "block").join(side(center, "b", "block"), ["token", "block"]).filter(f"ra <> rb AND {fits}").select("a", "b")
        if not turn:
            pairs = pairs.union(spread_join(members, groups.filter("size > 1").select("gkey", "head", "size"), ["gkey"], "size", n_classes).select(F.col("c").alias("a"), F.col("head").alias("b")))
        found = verified(ordered(pairs))
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
        forget(spark)
    # Then whatever pairs still cross classes meet, in lists, block by block, and within groups.
    inner = spread_join(members, groups.filter("size > 1").select("gkey", "size", F.col("size").alias("times")), ["gkey"], "times", n_classes)
    cuts = F.ceil(F.col("size") / LIST_BLOCK).cast("int")
    inner = inner.select((-F.col("gkey") - 1).alias("token"), F.lit(0).alias("place"), F.pmod(F.xxhash64("c"), cuts).cast("int").alias("block"), cuts.alias("blocks"), "c", "n")
    current = rooted(lists.join(members, "gkey").select("token", "place", "block", "blocks", "c", "n").union(inner), roots)
    open_lists = current.groupBy("token").agg(F.max("root").alias("high"), F.min("root").alias("low"), F.max("blocks").alias("blocks")).filter("low < high")
    open_lists = open_lists.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    spread = lambda other: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other)
    rows_ = current.join(open_lists, ["token", "block"], "left_semi")
    left = side(rows_.select("*", spread("other")), "a", F.col("block").alias("x"), F.col("other").alias("y")).filter("x <= y")
    right = side(rows_.select("*", spread("other")), "b", F.col("other").alias("x"), F.col("block").alias("y")).filter("x <= y")
    cross = left.join(right, ["token", "x", "y"]).filter(f"(x < y OR a < b) AND ra <> rb AND {fits}").select("a", "b")
    roots = components(edges.union(verified(ordered(cross))))
    forget(spark)

    numbered = rooted(classes.select("cid", "cid2", "c", "times"), roots).select("cid", "cid2", "root", "times")
    placed = spread_join(documents.filter("n > 0").select("key", "doc_id", "n", "cid", "cid2"), numbered, ["cid", "cid2"], "times", total).select("key", "doc_id", "n", "root")
    first = placed.groupBy("root").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).getField("key").alias("first_key"), F.count(F.lit(1)).alias("times"))
    worded = spread_join(placed, first, ["root"], "times", total).select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), "first_key")
    return worded.union(documents.filter("n = 0").select("key", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("key").alias("first_key")))
