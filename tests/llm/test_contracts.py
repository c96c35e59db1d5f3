"""The operators against plain Python on a table with every edge, with clashing columns, and empty."""

import math
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import data  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import cotraining, decontaminate, jaccard_join, pieces, pii, quality_rules, sst, stages, substring_dedup, suffix_tree, whole_token  # noqa: E402
from tessera.llm.queries import tokenizer_file  # noqa: E402

DOCS = data.documents()
PAIRS = [(r[0], r[1]) for r in DOCS]


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(spark, request):
    return data.frame(spark, DOCS, request.param == "clashing").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return data.frame(spark, [])


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_jaccard_join(docs, empty):
    got = jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
    assert values(got) == brute.jaccard(PAIRS)
    assert jaccard_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("limits", [{}, {"LIST_BLOCK": 7}, {"LIST_BLOCK": 5, "HOT_SLOT": 12, "HOT_TIMES": 0}])
def test_jaccard_join_chains_groups_and_thresholds(spark, monkeypatch, limits):
    """Copies with random edits: links, chains through a middle one, pairs just below the threshold, and prefixes in common; also with lists in blocks and in parts."""
    for name, value in limits.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(3)
    base = data.prose(rng, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(["p", "q", words[at]])]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, data.prose(rng, 20) + " " + " ".join(base[:30])) for i in range(40)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    assert values(got) == brute.jaccard(rows)


def test_repeated_passages(docs, empty):
    found = substring_dedup.repeated_passages(docs, window=35)
    assert values(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.passages(PAIRS)
    kept = substring_dedup.kept_texts(docs, found).join(found, "key").filter("sha2(kept, 256) <> kept_sha256")
    assert kept.count() == 0
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_repeated_passages_inside_a_text(spark):
    rng = random.Random(5)
    p, q = data.prose(rng, 40), data.prose(rng, 36)
    rows = [(1, f"{p} {data.prose(rng, 9)} {p} {q}"), (2, q), (3, " ".join(q.split()[:34])), (4, "w " * 80)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert values(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.passages(rows)


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_benchmark_hits(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # also one item a block
    items = data.benchmark(DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.benchmark_hits(docs, bench, window=10))
    assert values(got) == brute.leaks(PAIRS, items)
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_fm_index_counts_and_locates():
    import numpy as np

    rng = np.random.default_rng(2)
    text = np.concatenate((rng.integers(1, 4, 400), np.tile([1, 2, 3, 3], 50), [0]))
    index = decontaminate.FMIndex(text, 2, sample=4)
    phrases = [text[i : i + n].tolist() for i, n in ((0, 1), (5, 3), (390, 9), (410, 12), (37, 6))] + [[3, 3, 3, 3, 3, 3, 3, 3, 3, 3]]
    width = max(map(len, phrases))
    low, high = index.search(np.array([p + [0] * (width - len(p)) for p in phrases]), np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        places = [i for i in range(len(text) - len(p)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def test_personal_data(docs, empty):
    got = values(pii.personal_data(docs))
    assert [r[:6] for r in got] == sorted((brute.base_pii(*p) for p in PAIRS), key=repr)
    spans = [r[6] for r in got if r[0] == 22][0]
    assert "secret:" in spans and pii.personal_data(empty).count() == 0


@pytest.mark.parametrize("text", ["1" * 3000, "a@" * 800, "a" * 3000 + "@b.c", "+1" + "(" * 3000, "1.2.3." * 500, "12 34-" * 400, "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "0001.2.3.004"])
def test_base_patterns_match_the_contract_and_stay_linear(text):
    found = pii.base_spans(text)
    assert brute.base_pii(0, text)[1:5] == tuple(sum(s[0] == k for s in found) for k in pii.BASE)


def test_expectation_maximisation_recovers_reliabilities():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.6])
    votes = np.where(rng.random((4000, 3)) < right, truth[:, None], ~truth[:, None]) * 2
    posterior, share, rates = pii.expectation_maximisation(votes, np.ones(4000))
    assert abs(share - 0.4) < 0.05 and ((posterior > 0.5) == truth).mean() > 0.93
    assert rates[0, 1, 2] > rates[1, 1, 2] > rates[2, 1, 2]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in PAIRS]
    expected = sorted(((d, len((t or "").encode()), k, k > 512) for (d, t), k in zip(PAIRS, n)), key=repr)
    assert values(whole_token.token_counts(docs, path)) == expected
    assert whole_token.token_counts(empty, path).count() == 0


def test_token_counts_of_every_letter():
    """The split pattern's character classes are the library's, code point by code point."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library, count = Tokenizer.from_file(path), whole_token.TokenCounter(whole_token.prove(path))
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2  {c} {c}{c}x !{c}" for c in letters[:0x3000]] + ["".join(f"a{c}1{c} " for c in letters[i : i + 64]) for i in range(0x3000, len(letters), 64)]
    wrong = [t for t, got in zip(texts, library.encode_batch(texts, add_special_tokens=False)) if len(got.ids) != count(t)]
    assert not wrong, [hex(ord(c)) for t in wrong[:20] for c in t if ord(c) > 127][:40]


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame(data.labels(DOCS), "doc_id long, quality int, toxic int")
    got = values(quality_rules.quality_rules(docs, labels))
    assert [r[:7] for r in got] == sorted((brute.rules(*p) for p in PAIRS), key=repr)
    assert all(r[7] == (not r[6] and r[8] >= quality_rules.THRESHOLD) for r in got)
    assert {r[8] for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_piece_encoding(docs, empty):
    import struct
    import zlib

    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = []
    for d, t in PAIRS:
        ids = library.encode(t or "")
        expected.append((d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), True))
    assert values(pieces.encoding_digests(docs, path).select("doc_id", "n_tokens", "ids_crc32", "round_trip")) == sorted(expected, key=repr)
    assert pieces.encoding_digests(empty, path).count() == 0
    with_ids = pieces.encoded(docs, path).select(F.monotonically_increasing_id().alias("key"), "text", "ids")
    back = pieces.decoded(with_ids, path).withColumnRenamed("text", "back").join(with_ids, "key")
    assert back.filter("back <> coalesce(text, '')").count() == 0


def test_pieces_against_the_library_on_noise():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(pieces.load(path))
    rng = random.Random(4)
    for alphabet in ("abc ", "theinganreo ", " \n\t.,ab", "aé漢字🙂 ", "▁ a"):
        for _ in range(150):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
            assert encoder.encode(text) == library.encode(text), repr(text)
    text = "".join(rng.choice("theinganreo") for _ in range(20_000))
    assert encoder.encode(text) == library.encode(text)


def test_unigram_viterbi_against_brute_force():
    import itertools

    scored = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.2, "aba": -5.9, "▁": -1.0, "▁a": -2.6}
    model = pieces.Model(["<unk>", *scored], [0.0, *scored.values()], ["unknown", *["normal"] * len(scored)], merges=False)
    encoder = pieces.Encoder(model)
    for n in range(1, 7):
        for text in map("".join, itertools.product("ab", repeat=n)):
            best = {0: (0.0, [])}
            marked = "▁" + text
            for end in range(1, len(marked) + 1):
                best[end] = max(((best[s][0] + scored[marked[s:end]], [*best[s][1], marked[s:end]]) for s in range(end) if s in best and marked[s:end] in scored), default=(-1e9, []))
            ids = encoder.encode(text)
            assert math.isclose(sum(model.scores[i] for i in ids), best[len(marked)][0]) and encoder.decode(ids) == text


def test_shards(docs, empty):
    path = tokenizer_file("word_bpe_49k.json")
    manifest = sst.write_shards(docs, path, end_id=2)
    got = sorted((tuple(r) for r in sst.read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    expected = brute.shards(PAIRS, path)
    assert sorted(map(repr, (r[:1] + r[2:] for r in got))) == sorted(map(repr, (r[:1] + r[2:] for r in expected)))
    assert [r[0] for r in got] == [r[0] for r in expected] and [r[1] for r in got] == [r[1] for r in expected]
    ids = docs.sparkSession.createDataFrame([(5,), (8,), (12345,)], "doc_id long")
    found = values(sst.lookup(manifest, ids).select("doc_id", F.size("tokens")))
    assert found == sorted(((r[0], r[2]) for r in expected if r[0] in (5, 8)), key=repr)
    assert sst.read_shards(sst.write_shards(empty, path, end_id=2)).count() == 0


def test_shards_of_one_id(spark):
    """Rows that share an id, or have none, spread over several shards, stay in the order of their texts, and are all found."""
    rng = random.Random(20)
    rows = [(7 if i % 3 else None, f"{rng.randint(0, 99)} {data.prose(rng, 5)}") for i in range(300)] + [(8, "x"), (6, None), (None, None), (7, "same"), (7, "same")]
    path = tokenizer_file("word_bpe_49k.json")
    manifest = sst.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), path, end_id=2)
    assert manifest.filter("n_docs > 0").count() > 2
    got = [tuple(r) for r in sst.read_shards(manifest).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert got == brute.shards(rows, path)
    wanted = spark.createDataFrame([(7,), (8,), (None,), (9,)], "doc_id long")
    found = {r["doc_id"]: r["n"] for r in sst.lookup(manifest, wanted).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {7: 202, 8: 1, None: 101}


def test_shard_blocks_index_and_damage():
    writer = sst.Writer(2)
    for i in range(3000):
        writer.add(sst.key_bytes(i * 3, 0), bytes(2 * (i % 90)))
    raw = writer.close()
    reader = sst.Reader.of(raw)
    assert len(reader.index) > 3 and [d for d, _ in reader] == [i * 3 for i in range(3000)]
    assert len(reader.get(2997)[0]) == 999 % 90 and reader.get(2998) == []
    read: list[int] = []
    sparse = sst.Reader(lambda offset, length: read.append(length) or raw[offset : offset + length], len(raw))
    opened = sum(read)
    assert opened < len(raw) / 10 and len(sparse.get(2997)[0]) == 999 % 90 and len(read) == 3 and read[-1] < 2 * sst.BLOCK_BYTES
    assert sum(reader.may_hold(i * 3 + 1) for i in range(3000)) < 120
    with pytest.raises(ValueError):
        writer.add(sst.key_bytes(1, 0), b"")
    broken = bytearray(raw)
    broken[10] ^= 1
    with pytest.raises(ValueError):
        list(sst.Reader.of(bytes(broken)))


def test_suffix_tree_base_scores(docs, empty):
    from tessera.llm.queries import trained

    scored = suffix_tree.suffix_tree_scores(docs.withColumn("learn_from", trained()), "learn_from")
    got = sorted(((r["doc_id"], not r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in scored.collect()), key=lambda r: repr(r[:5]))
    expected = brute.unigrams(PAIRS)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, expected))
    assert suffix_tree.suffix_tree_scores(empty.withColumn("learn_from", F.lit(True)), "learn_from").count() == 0
    nothing = suffix_tree.suffix_tree_scores(docs.withColumn("learn_from", F.lit(False)), "learn_from")
    assert {r["train_tokens"] for r in nothing.collect()} == {0}


def test_suffix_tree_learns_contexts_and_is_a_distribution(spark):
    import numpy as np

    rng = random.Random(9)
    rows, word = [], "a"
    for i in range(60):
        words = []
        for _ in range(60):
            word = {"a": "b", "b": rng.choice("ca"), "c": "a"}[word] if rng.random() < 0.95 else rng.choice("abc")
            words.append(word)
        rows.append((i, " ".join(words), i % 4 != 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, trained boolean")
    held = [r for r in suffix_tree.suffix_tree_scores(df).collect() if not r["trained"]]
    assert sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)
    tree = suffix_tree.Tree(np.array([1, 2], np.uint64), np.array([2, 3]), np.array([0.1, 0.2, 0.3, 0.4]), 2, suffix_tree.Settings())
    tree.grow(np.array([2, 2, 3]), np.array([2, 3, 2]), np.array([90, 10, 50]), [])
    total = sum(tree.probabilities(np.array([s]), [np.array([2])])[0] for s in range(4))
    assert math.isclose(total, 1) and tree.probabilities(np.array([2]), [np.array([2])])[0] > 0.7


def test_cotraining(spark, docs, empty):
    labels = spark.createDataFrame(data.labels(DOCS), "doc_id long, quality int, toxic int")
    got = cotraining.quality_verdicts(docs, labels)
    assert got.count() == len(DOCS) and got.filter(f"kept <> (probability >= {cotraining.REJECT_BELOW}) OR probability IS NULL").count() == 0
    assert cotraining.quality_verdicts(docs, labels.limit(0)).filter("NOT kept").count() == 0
    assert cotraining.quality_verdicts(docs.select("doc_id", "text"), labels).count() == len(DOCS)
    assert cotraining.quality_verdicts(empty, labels).count() == 0
    assert cotraining.kept_documents(docs, labels).columns == docs.columns


def test_cotraining_held_out_accuracy(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = data.prose(rng, 80)
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", f"src{rng.randint(5, 9) if bad else rng.randint(0, 6)}", len(text)))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["probability"] > 0.5 for r in cotraining.quality_verdicts(data.frame(spark, rows), labels).collect()}
    assert sum(got[i] == (i % 4 != 0) for i in range(200, 400)) >= 196


def test_stages_keep_columns(docs):
    kept = stages.one_of_each_class(docs)
    assert kept.columns == docs.columns
    sets, roots = brute.jaccard_roots(PAIRS)
    classes: dict = {}
    for (d, _), own, r in zip(PAIRS, sets, roots):
        if own:
            classes.setdefault(r, []).append(d)
    least = sorted((min((d is None, d or 0) for d in ids) for ids in classes.values()), key=repr)
    worded = kept.filter(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in worded.collect()), key=repr) == least
    assert kept.count() - len(least) == sum(not own for own in sets)
    assert stages.one_of_each_class(kept).count() == kept.count()
    bench = docs.sparkSession.createDataFrame(data.benchmark(DOCS), "item_id long, text string")
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(DOCS)
    hits = {(r["doc_id"], r["n_words"]): r["spans"] for r in decontaminate.benchmark_hits(docs, bench).collect()}
    before, after = ({repr((r["doc_id"], r["text"])): r for r in d.collect()} for d in (docs, clean))
    for r in docs.select("doc_id", "text", "n_chars").distinct().collect():
        spans = hits[r["doc_id"], len(brute.ALNUM.findall(brute.fold(r["text"] or "")))]
        wanted = decontaminate.without_spans(r["text"], spans) if spans else r["text"]
        assert after[repr((r["doc_id"], wanted))]["n_chars"] == (len(wanted) if spans else r["n_chars"])
    assert len(before) == len(after) and any(hits.values())
    assert decontaminate.benchmark_hits(clean, bench.filter("item_id = 1")).filter(F.size("spans") > 0).count() == 0
    masked = pii.masked_documents(docs)
    assert masked.columns == docs.columns and masked.filter("text LIKE '%<EMAIL>%'").count() == 1


def test_suffix_tree_learns_rare_words_in_a_large_corpus(spark):
    """A word far below any fixed share of the tokens is still a symbol, and a context if it was seen often enough."""
    rng = random.Random(12)
    rows = [(i, data.prose(rng, 2000) + (" rareword partner rest" if i % 2 else " rest stranger word"), True) for i in range(40)]
    rows += [(100, "rareword partner", False), (101, "rareword stranger", False)]
    got = {r["doc_id"]: r for r in suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string, trained boolean")).collect()}
    assert got[100]["base_score"] == got[101]["base_score"] and got[100]["train_tokens"] > 80_000
    assert got[100]["score"] > got[101]["score"] + 1


def test_persons_are_candidates_whatever_their_name():
    import numpy as np

    for text, name in (("Dear Maria Lopez", "Maria Lopez"), ("then Mr. Rajesh Kumar came", "Rajesh Kumar"), ("signed Olga Petrova", "Olga Petrova")):
        start = text.index(name)
        assert ("person", start, start + len(name)) in pii.candidates(text, [])
        raw = text.encode()
        assert pii.suspects(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).all()
    assert pii.votes("person", "signed Olga Petrova", 7, 19)[2:4] == (pii.NO, pii.YES)


def thue_morse(bits: int) -> tuple[str, str]:
    """Two words that polynomial hashes modulo a power of two can't tell apart."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("fold", [True, False])
def test_words_hash_apart(fold):
    import numpy as np

    from tessera.llm.text import Words

    found = [w for bits in range(10, 14) for w in thue_morse(bits)] + ["a" * n for n in range(1, 400)] + ["b" + "a" * n for n in range(1, 400)]
    raw = " ".join(found).encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), fold=fold)
    assert len(np.unique(words.hashes)) == len(np.unique(words.second)) == len(found)
    again = " ".join(reversed(found)).encode()
    other = Words(np.frombuffer(again, np.uint8), np.array([0, len(again)]), fold=fold)
    assert (other.hashes[::-1] == words.hashes).all() and (other.second[::-1] == words.second).all()


def test_operators_tell_such_words_apart(spark):
    rng = random.Random(8)
    one, two = thue_morse(10)
    prose = data.prose(rng, 60).split()
    mixed = lambda w: " ".join([*prose[:30], w, *prose[30:]])
    rows = [(1, mixed(one)), (2, mixed(two)), (3, f"{one} {two}"), (4, f"{two} {one}"), (5, one), (6, two), (7, f"{one}\n{two}\n{one}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert values(jaccard_join.jaccard_components(df).select("doc_id", "n_shingles", "component_id")) == brute.jaccard(rows)
    assert values(substring_dedup.repeated_passages(df).select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.passages(rows)
    items = [(1, one), (2, f"{two} {one}")]
    assert values(decontaminate.digest(decontaminate.benchmark_hits(df, spark.createDataFrame(items, "item_id long, text string")))) == brute.leaks(rows, items)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r[:7] for r in values(quality_rules.quality_rules(df, labels))] == sorted((brute.rules(*r) for r in rows), key=repr)
    scored = suffix_tree.suffix_tree_scores(df.withColumn("trained", F.col("doc_id") == 5)).filter("doc_id IN (5, 6)").select("doc_id", "n_known")
    assert values(scored) == [(5, 2), (6, 1)]


def test_benchmark_rows_of_one_item_count_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:12])), (3, "nothing here")]
    items = [(7, " ".join(words[:10])), (7, " ".join(words[20:30])), (8, " ".join(words[2:12])), (None, " ".join(words[30:40])), (7, " ".join(words[:10]))]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 60, 1):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        assert values(decontaminate.digest(decontaminate.benchmark_hits(df, bench))) == brute.leaks(rows, items)


@pytest.mark.parametrize("text", [" " * 1_200_000, " " * 1_200_001 + "x", "\n" * 9000 + "a", "a" * 20_000, "=" * 40_000, "the" * 4000, "é" * 3000, "\t " * 3000])
def test_token_counts_of_very_long_runs(text):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    assert whole_token.TokenCounter(whole_token.prove(path))(text) == len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)


def test_long_merges_equal_the_library():
    counter = whole_token.TokenCounter(whole_token.prove(tokenizer_file("byte_bpe_50k.json")))
    rng = random.Random(6)
    for alphabet in ("ab", "the andig", " \n\t", "éa漢", " =-"):
        for _ in range(50):
            piece = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))).encode()
            assert whole_token.merged_length(piece, counter.pieces.ranks) == len(counter.pieces.merge(piece))


@pytest.mark.parametrize("settings", [suffix_tree.Settings(), suffix_tree.Settings(least=3, depth=2, divergence=1.0, prior=2.0)])
def test_suffix_tree_scores_against_brute_force(spark, settings):
    rng = random.Random(10)
    phrases = [data.prose(rng, 12) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*phrases, data.prose(rng, 5)]) for _ in range(rng.randint(0, 6))), i % 4 != 0) for i in range(60)]
    rows += [rows[1], rows[2], (100, None, True), (101, "", False)]
    got = suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string, trained boolean").repartition(3), settings=settings)
    found = sorted((r["doc_id"], round(r["score"], 7)) for r in got.collect())
    expected = brute.suffix_tree([r[1:] for r in rows], settings.least, settings.depth, settings.divergence, settings.prior)
    assert found == sorted((r[0], round(x, 7)) for r, x in zip(rows, expected))


def test_suffix_tree_in_chunks_of_any_size(monkeypatch):
    """A bucket's gains don't depend on how many tokens are held at a time, also where one context has more."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    parts = []
    for _ in range(3):
        n, words = 900, np.sort(rng.choice(200, 40, replace=False)).astype(np.int64)
        symbols = np.minimum(rng.zipf(1.4, n + 3), 40).astype(np.uint32)  # from 1
        past = np.stack([symbols[3 - d : n + 3 - d] for d in range(4)])
        past[2, rng.random(n) < 0.1] = 0
        docs = np.sort(rng.integers(0, 25, n)).astype(np.uint32)
        packed = suffix_tree._squeezed
        parts.append({"words": packed(np.diff(words, prepend=0)), "trained": packed(1 + words * 3), "docs": packed(np.diff(docs, prepend=np.uint32(0))), "times": packed((rng.random(n) < 0.8).astype(np.uint32)), "each": packed(past.ravel())})
    rows, gains = pa.Table.from_pylist(parts), []
    for size in (1_000_000, 400, 60, 7, 1):
        monkeypatch.setattr(suffix_tree, "CHUNK_TOKENS", size)
        bucket = suffix_tree.Bucket(rows, suffix_tree.Settings(), 30_000)
        bucket.score()
        gains.append(np.concatenate(bucket.gains))
    assert gains[0].sum() > 100 and all(np.allclose(gains[0], g, rtol=1e-12, atol=1e-12) for g in gains[1:])


def test_quality_scores_against_brute_force(spark):
    rows = [(i, t) for i, (_, t) in enumerate(PAIRS) if len(t or "") < 9000]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 30, 2)] + [(1, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    for (i, _), score in zip(rows, brute.log_ratio(rows, set(range(0, 30, 2)))):
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9, abs_tol=1e-9) and got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= quality_rules.THRESHOLD)


def test_persons_found_and_headings_left_alone(spark):
    """Names after a title or a greeting, listed or not, are found in a corpus of its own; capitalised phrases are not."""
    rng = random.Random(5)
    first, last = "Rajesh Olga Ingrid Kwame Yuki Fatima Lars Maria Anna Daniel Peter Laura".split(), "Kumar Petrova Larsen Mensah Tanaka Haddad Lopez Schmidt Smith Novak".split()
    rows, wanted = [], {}
    for i in range(300):
        before, name = data.prose(rng, 20) + rng.choice([" Mr. ", " Dr ", " signed ", " Dear ", " kind regards "]), f"{rng.choice(first)} {rng.choice(last)}"
        rows.append((i, f"{before}{name} {data.prose(rng, 9)}"))
        wanted[i] = f"person:{len(before)}:{len(before) + len(name)}"
        title = " ".join(rng.choice("The Report Annual Energy Market Review Global".split()) for _ in range(rng.randint(2, 4)))
        rows.append((1000 + i, f"{data.prose(rng, 15)} {title} {data.prose(rng, 9)}"))
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(wanted[i] in got[i].split(",") for i in wanted) >= 285
    assert sum("person" in got[1000 + i] for i in range(300)) <= 3


def test_added_kinds_found(spark):
    """One true and one false candidate of each further kind."""
    rng = random.Random(15)
    made = {
        "secret": lambda i: ("api_key = \"" + "".join(rng.choice("abcdefABCDEF0123456789xyzXYZ") for _ in range(36)) + "9aZ\"", "word " + "".join(rng.choice("abcdefghij") for _ in range(30))),
        "national_id": lambda i: (f"her SSN {rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} is", f"order part 000-00-{rng.randint(1000, 9999)} is"),
        "local_phone": lambda i: (f"call ({rng.randint(200, 900)}) {rng.randint(200, 900)}-{rng.randint(1000, 9999)} now", f"isbn part {rng.randint(100, 199)} {rng.randint(100, 199)} {rng.randint(1000, 9999)} x"),
    }
    rows = [(kind, side, f"{data.prose(rng, 8)} {text} {data.prose(rng, 8)}") for kind, make in made.items() for i in range(60) for side, text in enumerate(make(i))]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    for kind in made:
        found = [[kind in got[i] for i, (k, s, _) in enumerate(rows) if k == kind and s == side] for side in (0, 1)]
        assert sum(found[0]) >= 54 and sum(found[1]) <= 6, kind


def test_candidates_of_many_spans_take_linear_time():
    import time

    texts = ["10.0.0.1 mail a@b.cd Mr. Ab Cdef " * n for n in (3000, 12_000)]
    took = []
    for text in texts:
        base, began = pii.base_spans(text), time.time()
        pii.candidates(text, base)
        took.append(time.time() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_surest():
    import numpy as np

    odds, good, one = np.arange(200.0), (np.arange(200) >= 80).astype(float), np.ones(200)
    low, high = cotraining.surest(odds, good, one)
    assert 15 <= low <= 16 and 175 <= high <= 176  # a fifth of each class
    assert cotraining.surest(np.zeros(50), good[:50], one[:50]) == cotraining.surest(odds[:0], good[:0], one[:0]) == (-np.inf, np.inf)


@pytest.mark.parametrize("quality", [0, 1])
def test_one_class_of_labels_rejects_nothing(spark, quality):
    """Also with a single row of the other class, which leaves none to hold out."""
    rng = random.Random(8)
    rows = [(i, data.prose(rng, 40), "en", "src0" if i < 100 else "src1", 9) for i in range(150)]
    docs = data.frame(spark, rows)
    marked = [(i, quality, 0) for i in range(100)]
    for more in ([], [(120, 1 - quality, 0)]):
        labels = spark.createDataFrame(marked + more, "doc_id long, quality int, toxic int")
        assert {(r["kept"], r["probability"]) for r in cotraining.quality_verdicts(docs, labels).collect()} == {(True, 0.5)}
        assert cotraining.kept_documents(docs, labels).count() == len(rows)


def test_both_classes_are_held_out(spark):
    for n_bad in (2, 3, 7):
        labels = spark.createDataFrame([(i, int(i >= n_bad), 0) for i in range(25)], "doc_id long, quality int, toxic int")
        sample = cotraining.sample_labels(labels)
        assert len(sample.bad) and len(sample.held_bad) and len(sample.good) and len(sample.held_good)
        assert len(sample.bad) + len(sample.held_bad) == n_bad
        rng = random.Random(n_bad)
        docs = [(i, data.prose(rng, 60) if i >= n_bad and i < 90 else data.prose(rng, 60).upper().replace(" ", "## "), "en", "s", 9) for i in range(100)]
        kept = {r["doc_id"] for r in cotraining.kept_documents(data.frame(spark, docs), labels).collect()}
        assert set(range(n_bad, 90)) <= kept and not kept & set(range(90, 100))


def test_scores_of_a_text_do_not_depend_on_its_neighbours():
    import numpy as np

    from tessera.llm.ngrams import text_means

    rng = np.random.default_rng(1)
    parts = [rng.normal(size=n) for n in (5, 0, 1, 900, 33, 0)]
    offsets = np.cumsum([0, *map(len, parts)])
    assert text_means(np.concatenate(parts), offsets).tolist() == [text_means(p, np.array([0, len(p)]))[0] if len(p) else 0.0 for p in parts]


def test_stages_take_columns_in_any_case(spark):
    rows = [(i, data.DOCUMENT[i % 3], "en", "s", 3) for i in range(9)]
    lower = data.frame(spark, rows)
    upper = lower.toDF("DOC_ID", "TEXT", "Lang", "SOURCE", "N_chars").withColumn("last", F.lit("not this"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, data.DOCUMENT[1])], "item_id long, text string")
    path = tokenizer_file("piece_bpe_32k.model")
    for stage in (lambda d: cotraining.kept_documents(d, labels), stages.one_of_each_class, lambda d: decontaminate.clean_documents(d, bench), pii.masked_documents, lambda d: pieces.encoded(d, path)):
        one, two = stage(lower), stage(upper)
        assert values(one) == values(two.drop("last")) and two.columns[:6] == upper.columns


def test_stages_on_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = tokenizer_file("piece_bpe_32k.model")
    for out in (cotraining.kept_documents(empty, labels), stages.one_of_each_class(empty), decontaminate.clean_documents(empty, bench), pii.masked_documents(empty)):
        assert out.columns == empty.columns and out.count() == 0
    assert pieces.encoded(empty, path).columns == [*empty.columns, "ids"] and pieces.encoded(empty, path).count() == 0


def test_keys_are_128_bits_and_null_safe(spark):
    from tessera.llm.plan import row_key

    rows = [(None, None), (None, ""), (1, None), (1, ""), (1, "a"), (2, "a")]
    keys = {tuple(r["k"]) for r in spark.createDataFrame(rows, "doc_id long, text string").select(row_key("doc_id", "text").alias("k")).collect()}
    assert len(keys) == len(rows) and all(len(k) == 2 for k in keys)


def test_hot_keys_are_spread(spark, monkeypatch):
    from tessera.llm import graph

    monkeypatch.setattr(graph, "LEAST_HOT", 10)
    rows = spark.createDataFrame([(1 if i < 80 else i, i) for i in range(100)], "k long, v long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("times"), F.max("v").alias("top")).filter("k <> 90")
    for how, n in (("inner", 99), ("left", 100)):
        got = graph.spread_join(rows, table, ["k"], "times", 100, how)
        assert got.count() == n and values(got.filter("k = 1").select("top").distinct()) == [(79,)]
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(59, 100), (200, 201)], "u long, v long")
    assert {r["root"] for r in graph.components(edges).collect()} == {0, 200}


def test_buckets_grow_with_the_root_of_very_large_inputs(spark, monkeypatch):
    from tessera.llm import plan

    sizes = {1: 4, 1 << 30: 64, 160 << 30: 10_000, 100 << 40: 256_000}
    for size, least in sizes.items():
        monkeypatch.setattr(plan, "estimated_bytes", lambda df, size=size: size)
        assert least <= plan.bucket_count(spark.range(1)) <= least * 1.05


@pytest.mark.parametrize("rounds", [0, 2])
def test_cotraining_against_brute_force(spark, rounds):
    rng = random.Random(21)
    rows = []
    for i in range(260):
        bad = rng.random() < 0.35
        text = data.prose(rng, rng.randint(0, 25))
        rows.append((i, text.replace(" ", "!! ") if bad and rng.random() < 0.8 else text, rng.choice(["en", "de", None]), f"src{rng.randint(6, 9) if bad else rng.randint(0, 7)}", rng.choice([None, len(text)])))
    rows += [(900, None, None, None, None), (901, "", "en", "src1", 0)]
    marked = [(i, int(not (r[3] or "") > "src7" and "!!" not in (r[1] or "")), 0) for i, r in enumerate(rows[:180])]
    labels = spark.createDataFrame(marked, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.quality_verdicts(data.frame(spark, rows).repartition(3), labels, rounds).collect()}
    for row, expected in zip(rows, brute.cotraining(rows, cotraining.sample_labels(labels), rounds)):
        found = got[row[0]]
        for name, value in zip(("text_probability", "meta_probability", "probability"), expected):
            assert math.isclose(found[name], value, rel_tol=1e-6, abs_tol=1e-9), (row[0], name)
        assert found["kept"] == (found["probability"] >= cotraining.REJECT_BELOW)


def test_filters_grow_with_the_input_and_lose_nothing(spark, monkeypatch):
    import numpy as np

    from tessera.llm import filters

    assert [filters.filter_bits(n) for n in (0, 1 << 20, 1 << 30, 64 << 30, 100 << 40)] == [20, 20, 24, 30, 30]
    ids = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 40_000)
    others = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 20_000)
    df = spark.createDataFrame([(int(x),) for x in ids], "a long").repartition(3)
    for bits, most in ((20, 0.01), (22, 0.001)):
        wanted = filters.member_filter(df, bits)
        assert len(wanted.value) == 1 << bits - 3 and filters.contains(wanted, ids).all() and filters.contains(wanted, others).mean() < most
    assert not filters.contains(filters.member_filter(df.limit(0), 20), ids).any()


def test_wide_runs_are_refused(docs):
    with pytest.raises(ValueError):
        substring_dedup.repeated_passages(docs, window=257)
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(docs, width=300)


def plain_span_model(texts):
    """The whole weak-supervision model in plain Python: votes of all candidates one by one, EM in loops, logistic fit by gradient ascent."""
    from collections import Counter

    spans = [(kind, pii.votes(kind, t, a, b), pii.features(kind, t, a, b)) for t in texts if t for kind, a, b in pii.candidates(t, pii.base_spans(t))]
    usual, model = ((0.65, 0.25, 0.1), (0.1, 0.25, 0.65)), {}
    for kind in pii.ADDED:
        rows = list(Counter(s[1:] for s in spans if s[0] == kind).items())
        if not rows:
            continue
        total = sum(n for _, n in rows)
        prior = [[[p / sum(side) * max(2.0, total / 100) for p in side] for side in pii.PRIORS.get(kind, {}).get(k, usual)] for k in range(5)]
        rates = [[[p / sum(side) for p in side] for side in both] for both in prior]
        share, posterior = 0.3, {}
        for _ in range(100):
            for key, _n in rows:
                odds = math.log(share / (1 - share)) + sum(math.log(rates[k][1][v] / rates[k][0][v]) for k, v in enumerate(key[0]))
                posterior[key] = 1 / (1 + math.exp(-max(-30, min(30, odds)))) if pii.YES in key[0] else 0.0
            for k in range(5):
                for truth in (0, 1):
                    seen = [prior[k][truth][v] + sum(n * (posterior[key] if truth else 1 - posterior[key]) for key, n in rows if key[0][k] == v) for v in range(3)]
                    rates[k][truth] = [x / sum(seen) for x in seen]
            share = (sum(n * posterior[key] for key, n in rows) + 1) / (total + 2)
        row = lambda key: [float(key[0][k] == v) for k in range(5) for v in (pii.NO, pii.YES)] + [float(key[1] // 8 == s) for s in range(8)] + [float(key[1] >> b & 1) for b in range(3)] + [1.0]
        x, w = {key: row(key) for key, _ in rows}, [0.0] * 22
        rate = 1 / (pii.RIDGE + 0.25 * sum(n * sum(a * a for a in x[key]) for key, n in rows))
        speed, ahead = [0.0] * 22, w
        for step in range(6000):  # accelerated ascent
            slope = [-pii.RIDGE * a for a in ahead]
            for key, n in rows:
                p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x[key], ahead))))
                for i, a in enumerate(x[key]):
                    slope[i] += n * (posterior[key] - p) * a
            new = [a + rate * g for a, g in zip(ahead, slope)]
            speed, w = [b - a for a, b in zip(w, new)], new
            ahead = [a + step / (step + 3) * v for a, v in zip(w, speed)]
        model[kind] = lambda key, x=x, w=w: 1 / (1 + math.exp(-sum(a * b for a, b in zip(x[key], w)))) if pii.YES in key[0] else 0.0
    return model


def test_added_spans_against_a_plain_model(spark):
    rng = random.Random(12)
    texts = [data.prose(rng, 30) for _ in range(40)]
    for i in range(0, 40, 2):
        name = rng.choice(["Maria Lopez", "John Smith", "Anna Kramer", "Quentin Zabor"])
        texts[i] += rng.choice([f" Mr. {name} came", f" call (212) 555-{i:02d}34 now", " call 115 911-1234", f" ssn 123-45-67{i:02d}", " part 078-05-1120", ' token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"', " IBAN GB29 NWBK 6016 1331 9268 19", " serial XX12 3456 7890 1234", f" {name} went", " http://x/abcdefghijklmnopqrstuvwxyz0123"])
    model = plain_span_model(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    added = 0
    for i, text in rows:
        base = pii.base_spans(text)
        sure = [(k, a, b) for k, a, b in pii.candidates(text, base) if model[k]((pii.votes(k, text, a, b), pii.features(k, text, a, b))) > 0.5]
        wanted = sorted([*base, *sure], key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in wanted), text
        added += len(sure)
    assert added >= 10


def test_gazetteers_of_all_kinds():
    vote = lambda kind, text: pii.votes(kind, text, 0, len(text))[2]
    assert [vote("bank_account", x) for x in ("GB29 NWBK 6016 1331 9268 19", "GB29 NWBK 6016 1331 9268", "XX29 NWBK 6016 1331 9268 19")] == [pii.YES, pii.NO, pii.NO]
    assert [vote("national_id", x) for x in ("123-45-6789", "078-05-1120", "880-45-6789")] == [pii.YES, pii.NO, pii.ABSTAIN]
    assert [vote("local_phone", x) for x in ("(212) 555-1234", "800 555-1234", "211 555-1234", "295 555-1234")] == [pii.YES, pii.ABSTAIN, pii.NO, pii.NO]
    assert [vote("person", x) for x in ("Maria Lopez", "Quentin Zabor")] == [pii.YES, pii.NO] and vote("secret", "ghp_abcdefghij0123456789") == pii.YES
