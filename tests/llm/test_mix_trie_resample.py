"""Mixing, the conversation trie and resampling against plain Python, with every edge."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import data  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import mixing, prefix_trie, resampling  # noqa: E402

DOCS = data.documents()


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(spark, request):
    return data.frame(spark, DOCS, request.param == "clashing").repartition(3)


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix_meets_its_targets(docs):
    got = values(mixing.taken_words(docs, block=64, shard=10))
    totals = Counter()
    for _, text, _, source, _ in DOCS:
        totals[source] += size(text)
    goal = brute.water_level(totals)
    assert sorted(((d, n) for d, n, *_ in got), key=repr) == sorted(((r[0], size(r[1])) for r in DOCS), key=repr)
    by_source = {(n, round(goal[s], 6)) for s, n in totals.items()}
    assert {(n, round(t, 6)) for _, _, n, t, _ in got} == by_source and len({n for n, _ in by_source}) == len(totals)
    for n, target in by_source:
        assert sum(taken for *_, m, _, taken in got if m == n) == int(target)
    assert all(0 <= taken <= 3 * n for _, n, _, _, taken in got)
    assert got == values(mixing.taken_words(docs.repartition(5), block=64, shard=10))


@pytest.mark.parametrize(("block", "shard"), [(1, 1000), (7, 3), (100_000, 4096)])
def test_mix_with_small_and_large_blocks(spark, block, shard):
    rng = random.Random(block)
    sizes = {"a": 3000, "b": 40, "c": 5, "d": 0, "e": 7, "f": 1, None: 12}  # b, c, e and f stop at three times their size
    rows = []
    for source, n in sizes.items():
        while n > 0 or not rows or rows[-1][2] != source:
            k = min(n, rng.randint(0, 200))
            rows.append((len(rows), "w " * k, source))
            n -= k
    got = values(mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=block, shard=shard))
    goal, source_of = brute.water_level(sizes), {r[0]: r[2] for r in rows}
    for source in sizes:
        mine = [r for r in got if source_of[r[0]] == source]
        assert sum(r[4] for r in mine) == int(goal[source]) and all(r[4] <= 3 * r[1] and abs(r[3] - goal[source]) < 1e-6 for r in mine)


def test_mixed_blocks_hold_the_words_taken(docs):
    found = mixing.mixed_blocks(docs, block=50, shard=7).collect()
    assert all(r["n_words"] == size(r["text"]) <= 50 for r in found)
    per_shard = Counter(r["shard"] for r in found)
    assert all(per_shard[s] == 7 for s in range(max(per_shard)))
    text_of = Counter()
    for d, text, *_ in DOCS:
        text_of.update(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert set(w for r in found for w in r["text"].split(" ")) <= set(text_of)
    assert sum(r["n_words"] for r in found) == sum(r[4] for r in values(mixing.taken_words(docs, block=50, shard=7)))


def test_index_permutations_are_permutations(spark):
    rows = spark.range(1, 90).withColumnRenamed("id", "n").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    there = mixing.permuted(F.col("x"), F.col("n"), [F.lit(5), F.lit(1)], 9)
    rows = rows.withColumn("y", there)
    found = rows.withColumn("back", mixing.permuted(F.col("y"), F.col("n"), [F.lit(5), F.lit(1)], 9, back=True)).collect()
    assert all(r["back"] == r["x"] for r in found)
    for n in range(1, 90):
        assert sorted(r["y"] for r in found if r["n"] == n) == list(range(n))
    moved = [r["y"] for r in found if r["n"] == 89]
    assert sum(a == i for i, a in enumerate(moved)) < 10


def test_shard_counts_are_drawn_and_add_up(spark):
    quota = {0: 5000, 1: 3000, 2: 1, 3: 1999}
    sources = spark.createDataFrame(list(quota.items()), "source_id long, slots long")
    counts = mixing.shard_counts(spark, sources, 100, 4).collect()
    assert Counter({s: sum(r["n"] for r in counts if r["source_id"] == s) for s in quota}) == Counter(quota)
    assert Counter({h: sum(r["n"] for r in counts if r["shard"] == h) for h in range(100)}) == Counter({h: 100 for h in range(100)})
    mine = [r["n"] for r in counts if r["source_id"] == 0]
    mean = sum(mine) / 100
    assert 12 < sum((x - mean) ** 2 for x in mine) / 100 < 45  # a binomial of 100 draws with share a half has 25


def test_mix_of_nothing(spark, docs):
    assert mixing.taken_words(data.frame(spark, [])).count() == 0 and mixing.mixed_blocks(data.frame(spark, [])).count() == 0
    blank = values(mixing.taken_words(docs.filter("text IS NULL OR text = ''")))
    assert blank and all(r[1:] == (0, 0, 0.0, 0) for r in blank)


TURNS = "conv_id long, turn long, role string, text string"


def conversation_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 10**12, 1000, 1004]:
        if c % 11 == 3:
            continue
        for t in range(rng.choice([1, 1, 2, 3, 6, 12])):
            rows.append((c, None if t == 0 and c % 4 == 0 else t, rng.choice(["user", "bot", None]), rng.choice(["", None, "hi", "hi", "ünï 漢", "x" * 50])))
    rows += [(5000 + c, t, "user", f"turn {t}") for c in range(200) for t in range(3)]  # copies
    rows += [(7001, t, "bot", str(t % 3)) for t in range(700)]  # long
    rows += [(7001, 5, "bot", "2"), (8000, 1, "r", "same"), (8000, 1, "r", "same"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("step", [1 << 10, 8])
def test_trie(spark, monkeypatch, step):
    monkeypatch.setattr(prefix_trie, "STEP", step)
    monkeypatch.setattr(prefix_trie, "PIECE", step)
    monkeypatch.setattr(prefix_trie, "_TURNS", step * 8)
    rows = conversation_rows(step)
    turns = spark.createDataFrame(rows, TURNS).withColumn("rank", F.lit(1)).withColumn("Path", F.lit("x")).repartition(5)
    found = prefix_trie.conversation_trie(turns)
    assert values(found.drop("start", "end")) == brute.trie(rows)
    spans = sorted((r["start"], r["end"]) for r in found.collect())
    assert [s for s, _ in spans] == list(range(len(spans))) and spans[0] == (0, len(spans))
    open_: list[int] = []
    for start, end in spans:  # intervals nest
        while open_ and open_[-1] <= start:
            open_.pop()
        assert not open_ or end <= open_[-1]
        open_.append(end)


def test_trie_of_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, TURNS)
    assert prefix_trie.conversation_trie(frame([])).count() == 0
    assert prefix_trie.conversation_trie(frame([(None, 1, "a", "b")])).count() == 0
    for rows in ([(3, 0, "a", "b")], [(0, None, None, None), (5, None, None, None)], [(2, 0, "u", "one"), (0, 7, "u", "two")]):
        assert values(prefix_trie.conversation_trie(frame(rows)).drop("start", "end")) == brute.trie(rows)


def test_trie_of_many_copies_and_a_common_turn(spark):
    """Nodes with thousands of members and of children."""
    rows = [(c, t, "user", x) for c in range(3000) for t, x in enumerate(("common", "copy" if c % 2 else f"own {c}"))]
    assert values(prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).drop("start", "end")) == brute.trie(rows)


@pytest.mark.parametrize(("width", "size"), [(1, 8 << 20), (3, 8 << 20), (2, 300)])
def test_resampling(spark, docs, monkeypatch, width, size):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", size)
    target = data.benchmark(DOCS)
    bench = spark.createDataFrame(target, "item_id long, text string")
    pairs = [(r[0], r[1]) for r in DOCS]
    for percent in (10, 50):
        got = resampling.resampled(docs, bench, width=width, percent=percent)
        assert values(got) == brute.resampled(pairs, [t for _, t in target], width, percent=percent)


def test_resampling_without_rows(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(data.frame(spark, []), bench).count() == 0
    assert values(resampling.resampled(docs, bench, percent=100)) == brute.resampled([(r[0], r[1]) for r in DOCS], [], percent=100)
    assert resampling.resampled(docs.filter("text IS NULL"), bench).filter("weight <> 0 OR rank IS NOT NULL").count() == 0
