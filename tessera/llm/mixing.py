"""Mixing sources to target weights, in DataFrame operations alone.

A source's words, document after document in a hash order, are packed into blocks of fixed
length. Output shards have a fixed number of slots, each of which holds a block. How many
slots of a shard a source gets is drawn: a slot picks one of as many tickets as there are
slots, of which a source holds its share, so that a shard's counts are multinomial. What is
drawn beyond a source's quota goes to the sources that were drawn too seldom. The k-th slot
of a source holds the block to which a pseudorandom permutation of the source's blocks, one
for each time round, sends k; slots and blocks are joined by that index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.places import numbered, totals_before
from tessera.llm.plan import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, slots of a shard, and the weights of sources in order, repeating.
BLOCK, SHARD, WEIGHTS = 512, 4096, (1, 2, 3)
#: A source is taken at most so many times.
MOST = 3
#: Rounds of the index permutation.
ROUNDS = 32
#: Shards or sources whose totals are summed in one task.
STEP = 1024


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, *more) of documents."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), *more)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(source, source_id, source_size, n_docs, target): sources in code point order, null last.

    The targets are weight times a common level, or most times the source's size if that is
    less; the level rises until the targets add up to share of all sizes. Each step sums
    longs, so a rerun finds the same doubles, and only scalars come to the driver.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = numbered(sums, [F.asc_nulls_last("source")], "source_id")
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, settled = 0.0, -1
    while True:
        full = cap <= F.col("w") * F.lit(level)
        n, taken, rest = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w")))).first()
        if settled == n and level > 0:
            break
        settled, level = n, (wanted - (taken or 0)) / rest if rest else math.inf
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("w") * F.lit(level))).drop("w")


def placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """sizes with source_id and start, the words of its source before a document; (source_id, start) is a document with words.

    A source's documents come in the order of a hash of their id, in steps whose number
    follows the root of its documents.
    """
    known = sources.select("source", "source_id", F.ceil(F.sqrt("n_docs")).cast("long").alias("__steps"))
    rows = sizes.join(known, sizes["source"].eqNullSafe(known["source"])).drop("source")
    hashed = F.xxhash64(F.lit(seed), F.lit(0), "doc_id", "size")
    rows = rows.withColumn("__order", F.shiftrightunsigned(hashed, 1)).withColumn("__step", F.expr("shiftright(__order, 32) * __steps div 2147483648"))
    return totals_before(rows, ["source_id"], "__step", ["__order", "doc_id", "size"], {"start": "size"}).drop("__hash", "__order", "__step", "__steps")


def blocks(rows: DataFrame, block: int) -> DataFrame:
    """Pieces of blocks: (source_id, block, at, n, first_word) with the columns of rows; words at .. at + n of the block are the document's from first_word on."""
    number = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    cut = rows.filter("size > 0").withColumn("block", number)
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.withColumns({"at": low - F.col("block") * block, "n": high - low, "first_word": low - F.col("start")})


def permuted(x: Column, n: Column, keys: list[Column], seed: int, rounds: int = ROUNDS, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0 .. n - 1, one for each keys, sends x, or (back) what it sends to x.

    In each round a drawn reflection pairs up the indices and a bit drawn for each pair
    decides whether its two change places, so every round is its own inverse.
    """
    turns = F.sequence(F.lit(rounds - 1 if back else 0), F.lit(0 if back else rounds - 1))

    def turn(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), F.lit(1), *keys, i), n) - at, n)
        swaps = F.xxhash64(F.lit(seed), F.lit(2), *keys, i, F.greatest(at, other)).bitwiseAND(1) == 1
        return F.when(swaps, other).otherwise(at)

    return F.aggregate(turns, x.cast("long"), turn)


def quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Sources with words and a target, with the slots that they get.

    whole times each block is taken; rest words follow in a further round, whose slots end
    where these are used up. The last block has short words less than the others and comes
    at place short_at of that round.
    """
    # Sources without words pass through all expressions (as if of one word) until the last filter.
    size = F.greatest(F.col("source_size"), F.lit(1))
    found = sources.withColumns({"source_size": size, "taken": F.floor("target").cast("long")}).withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    found = found.withColumns({"whole": F.expr("taken div source_size"), "rest": F.col("taken") % F.col("source_size"), "short": F.col("n_blocks") * block - F.col("source_size")})
    found = found.withColumn("short_at", permuted(F.col("n_blocks") - 1, F.col("n_blocks"), [F.col("source_id"), F.col("whole")], seed, back=True))
    found = found.withColumn("reach", F.when(F.col("rest") > F.col("short_at") * block, F.col("rest") + F.col("short")).otherwise(F.col("rest")))
    return found.withColumn("slots", F.expr(f"whole * n_blocks + (reach + {block - 1}) div {block}")).drop("reach").filter("slots > 0")


def _stacked(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows with low and high: their sizes laid end to end in the order of key."""
    rows = totals_before(rows.withColumn("__step", F.expr(f"{key} div {STEP}")), [], "__step", [key], {"low": size})
    return rows.drop("__step").withColumn("high", F.col("low") + F.col(size))


def _cut(rows: DataFrame, width: int) -> DataFrame:
    """Intervals low .. high cut at multiples of width, whose number is in bin."""
    rows = rows.filter("high > low").withColumn("bin", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))))
    return rows.withColumns({"low": F.greatest("low", F.col("bin") * width), "high": F.least("high", (F.col("bin") + 1) * width)})


def shard_counts(spark, sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, source_id, n): how many slots of each shard a source gets; its counts add up to its slots."""
    total, number = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return sources.select(F.lit(0).cast("long").alias("shard"), "source_id", F.col("slots").alias("n"))
    width = max(1, total // number)
    tickets = _cut(_stacked(sources.select("source_id", "slots"), "source_id", "slots"), width).select("bin", "low", "high", "source_id")
    draws = spark.range(total).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit(3), "id"), F.lit(total)).alias("ticket"))
    draws = draws.withColumn("bin", F.expr(f"ticket div {width}"))
    drawn = draws.join(tickets, "bin").filter("ticket >= low AND ticket < high").groupBy("shard", "source_id").agg(F.count(F.lit(1)).alias("n"))
    drawn = materialise(drawn, "drawn").withColumn("__step", F.expr(f"shard div {STEP}"))
    # What a source draws beyond its slots is left over in its shard, for the sources that drew too few.
    ranked = totals_before(drawn, ["source_id"], "__step", ["shard"], {"before": "n"}).join(sources.select("source_id", "slots"), "source_id")
    ranked = ranked.withColumn("kept", F.greatest(F.lit(0), F.least("n", F.col("slots") - F.col("before"))))
    over = _stacked(ranked.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("over")), "shard", "over")
    got = drawn.groupBy("source_id").agg(F.sum("n").alias("got"))
    lack = sources.select("source_id", "slots").join(got, "source_id", "left").withColumn("lack", F.greatest(F.lit(0), F.col("slots") - F.coalesce("got", F.lit(0))))
    missing, shards = lack.agg(F.sum("lack")).first()[0], -(-total // shard)
    width = max(1, missing // (number + shards))
    one, two = _cut(over, width).select("bin", "shard", "low", "high"), _cut(_stacked(lack, "source_id", "lack"), width).select("bin", "source_id", F.col("low").alias("from"), F.col("high").alias("to"))
    filled = one.join(two, "bin").select("shard", "source_id", (F.least("high", "to") - F.greatest("low", "from")).alias("n")).filter("n > 0")
    kept = ranked.select("shard", "source_id", F.col("kept").alias("n")).filter("n > 0")
    return materialise(kept.unionByName(filled).groupBy("shard", "source_id").agg(F.sum("n").alias("n")), "counts")


def slots(counts: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(shard, source_id, turn, block, words): the block of each slot, its time round and how many of its words are taken."""
    ranked = totals_before(counts.withColumn("__step", F.expr(f"shard div {STEP}")), ["source_id"], "__step", ["shard"], {"first": "n"}).drop("__step")
    each = ranked.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    each = each.join(sources.select("source_id", "n_blocks", "whole", "rest", "short", "short_at"), "source_id")
    each = each.withColumns({"turn": F.expr("k div n_blocks"), "place": F.col("k") % F.col("n_blocks")})
    each = each.withColumn("block", permuted(F.col("place"), F.col("n_blocks"), [F.col("source_id"), F.col("turn")], seed))
    length = F.when(F.col("block") == F.col("n_blocks") - 1, block - F.col("short")).otherwise(F.lit(block))
    before = F.col("place") * block - F.when(F.col("place") > F.col("short_at"), F.col("short")).otherwise(F.lit(0))
    return each.select("shard", "source_id", "turn", "block", F.when(F.col("turn") < F.col("whole"), length).otherwise(F.least(length, F.col("rest") - before)).alias("words"))


class Mix:
    """A mix of documents: sources with targets, rows (documents in their source's order) and pieces, what the slots hold."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 2024, texts: bool = False):
        sizes = materialise(sized(docs, *(["text"] if texts else [])), "sizes")
        self.sources = materialise(targets(sizes, weights, share, most), "sources")
        self.rows = materialise(placed(sizes, self.sources, seed), "placed")
        taken = materialise(quotas(self.sources, block, seed), "quotas")
        counts = shard_counts(docs.sparkSession, taken, shard, seed)
        chosen = slots(counts, taken, block, seed).withColumnRenamed("words", "__most")
        pieces = blocks(self.rows, block).join(chosen, ["source_id", "block"])
        self.pieces = pieces.withColumn("n", F.least("n", F.col("__most") - F.col("at"))).filter("n > 0").drop("__most", "size")


def mixed_blocks(docs: DataFrame, **options) -> DataFrame:
    """(shard, source_id, turn, block, n_words, text): the blocks of every output shard, their words joined by a space.

    Options are those of Mix. Null and empty texts give no words; an empty table gives no
    blocks; repeated rows are each a document; other columns are not read.
    """
    pieces = Mix(docs, texts=True, **options).pieces
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("first_word") + 1).cast("int"), F.col("n").cast("int")), " ")
    parts = F.array_sort(F.collect_list(F.struct("at", words.alias("part"))))  # at most a block
    grouped = pieces.groupBy("shard", "source_id", "turn", "block").agg(F.sum("n").alias("n_words"), parts.alias("__parts"))
    return grouped.withColumn("text", F.array_join(F.transform("__parts", lambda p: p["part"]), " ")).drop("__parts")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: how many words of it the mix takes, repeats counted.

    Options are those of Mix. A source's taken words are its target, rounded down; no
    document is taken more than most times. Null texts and texts without words have size
    and taken 0; a null source is one of its own, the last; repeated rows, and rows without
    doc_id, are each a document; an empty table gives no rows; other columns are not read.
    Reruns agree: all draws are hashes of numbers, and documents stand in an order of their
    ids (rows that agree in id, source and size can't be told apart in the result either).
    """
    mix = Mix(docs, **options)
    taken = mix.pieces.groupBy("source_id", "start").agg(F.sum("n").alias("taken"))
    rows = mix.rows.withColumn("__start", F.when(F.col("size") > 0, F.col("start"))).drop("start").join(taken.withColumnRenamed("start", "__start"), ["source_id", "__start"], "left")
    rows = rows.join(mix.sources.select("source_id", "source_size", "target"), "source_id")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
