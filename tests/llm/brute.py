"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall(fold(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def jaccard_roots(rows: list[tuple], percent: int = 80) -> tuple[list[frozenset], list[int]]:
    """The set of each row, and the first row of its class."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    where: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return sets, [top(i) for i in range(len(rows))]


def jaccard(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """Sorted (doc_id, n_shingles, component_id)."""
    sets, roots = jaccard_roots(rows, percent)
    low: dict = {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(s), low.get(r)) for (d, _), s, r in zip(rows, sets, roots)), key=repr)


def passages(rows: list[tuple], window: int = 35) -> list[tuple]:
    """Sorted (doc_id, n_words, n_removed, kept_sha256)."""
    texts = [WORD.findall(t or "") for _, t in rows]
    seen: Counter = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(rows: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """Sorted (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows: dict = {}
    for i, t in items:
        w = ALNUM.findall(fold(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).update([] if i is None else [str(i)])
    sizes = {len(w) for w in windows}
    out = []
    for d, t in rows:
        w = ALNUM.findall(fold(t or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k : k + n]))
                if names is not None:
                    found |= names
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


def unigrams(rows: list[tuple]) -> list[tuple]:
    """Sorted (doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tokens = [[*WORD.findall(fold(t or "")), None] for _, t in rows]
    c = Counter(x for h, t in zip(held, tokens) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return sorted(((d, h, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for (d, _), h, t in zip(rows, held, tokens)), key=lambda r: repr(r[:5]))


def shards(rows: list[tuple], path: str, end_id: int = 2) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) by the library over whole texts, in ascending doc_id order."""
    import struct

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def base_pii(doc_id: int | None, text: str | None) -> tuple:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256) by the contract's patterns as they stand."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s: str) -> bool:
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    found = [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (doc_id, *[sum(f[0] == k for f in found) for k in rules], hashlib.sha256(joined.encode()).hexdigest())


def rules(doc_id: int | None, text: str | None) -> tuple:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    hit = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
    lines, before, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in before
            before.add(line)
    return (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def suffix_tree(rows: list[tuple], least: int, depth: int, divergence: float, prior: float) -> list[float]:
    """log10 P of each text; rows (text, trained)."""
    texts = [([*WORD.findall(fold(t or "")), None], trained) for t, trained in rows]
    c = Counter(x for t, trained in texts if trained for x in t)
    n, v = sum(c.values()), len(c)
    context = lambda t, i, d: tuple(t[i - j] if i >= j else None for j in range(1, d + 1))
    states: dict = {}

    def probabilities(t: list, i: int) -> list[float]:
        p = [(c[t[i]] + 1) / (n + v + 1)]
        for d in range(1, depth + 1):
            state = states.get(context(t, i, d))
            if state is None:
                break
            total = sum(state.values())
            p.append(state[t[i]] / (total + prior) + prior / (total + prior) * p[-1])
        return p

    for d in range(1, depth + 1):
        seen: dict = {}
        q: dict = {}
        for t, trained in texts:
            for i in range(len(t) if trained else 0):
                k = context(t, i, d)
                if (d == 1 or k[:-1] in states) and all(c[x] >= least for x in k):
                    seen.setdefault(k, Counter())[t[i]] += 1
                    q[k, t[i]] = probabilities(t, i)[-1]
        for k, following in seen.items():
            total = sum(following.values())
            gain = sum(m * math.log(m / total / q[k, x]) for x, m in following.items())
            if total >= least and gain >= divergence:
                states[k] = following
    return [sum(math.log10(probabilities(t, i)[-1]) for i in range(len(t))) for t, _ in texts]


def log_ratio(rows: list[tuple], trusted: set, bits: int = 17) -> list[float]:
    """The mean log ratio of each text's hashed byte 4-grams between trusted texts and all."""
    slots = [[(int.from_bytes(r[i : i + 4], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits) for i in range(len(r) - 3)] for r in ((t or "").encode() for _, t in rows)]
    target, corpus = (Counter(x for (d, _), own in zip(rows, slots) if everything or d in trusted for x in own) for everything in (False, True))
    share = lambda counts, x: math.log((counts[x] + 1) / (sum(counts.values()) + (1 << bits)))
    known = {x: share(target, x) - share(corpus, x) for x in corpus}
    return [sum(known[x] for x in own) / max(len(own), 1) for own in slots]


def cotraining(rows: list[tuple], sample, rounds: int) -> list[tuple[float, float, float]]:
    """(text, metadata, combined) probability of each row (doc_id, text, lang, source, n_chars); sample: the ids to start from and the held-out ones.

    Counts, exchange and scores are plain Python; the logistic calibration and the cuts are the operator's own, which have tests of their own.
    """
    import numpy as np
    import xxhash

    from tessera.llm.cotraining import LEVELS, META_BITS, PARTS, SYMBOLS, platt, surest

    views = ("text", "shape", "meta")
    size = lambda n: None if n is None else int(math.log2(abs(n) + 1) * 2)
    meta = lambda s, g, n: [xxhash.xxh3_64_intdigest(repr(x)) & (1 << META_BITS) - 1 for x in ((0, s), (1, g), (2, n), (3, g, n))]

    def shape(text: str | None) -> list[int]:
        raw = (text or "").encode()
        words = WORD.findall(fold(text or ""))
        lines = [tuple(x) for x in (WORD.findall(fold(y)) for y in (text or "").split("\n")) if x]
        letters = [c for c in raw if chr(c).isascii() and chr(c).isalpha()]
        share = lambda n, of: math.sqrt(n / max(of, 1))
        values = [
            share(sum(c in SYMBOLS for c in raw), len(raw)), share(sum(chr(c).isupper() for c in letters), len(letters)), share(sum(48 <= c <= 57 for c in raw), len(raw)),
            share(sum(a == b for a, b in zip(words, words[1:])), len(words)), share(sum(a == b for a, b in zip(words, words[2:])), len(words)), share(len(lines) - len(set(lines)), len(lines)), math.log2(1 + len(words) / ((text or "").count("\n") + 1)) / 12,
        ]
        group = min(int(math.log2(1 + len(words))) // 2, 7)
        return [(k * 8 + group) * LEVELS + min(int(min(x, 1) * (LEVELS - 1) + 0.5), LEVELS - 1) for k, x in enumerate(values)]

    features = {
        "text": [[(int.from_bytes(r[i : i + 4], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 15 for i in range(len(r) - 3)] for r in ((t or "").encode() for _, t, *_ in rows)],
        "shape": [shape(t) for _, t, *_ in rows],
        "meta": [meta(s, g, size(n)) for _, _, g, s, n in rows],
    }
    slots = {"text": 1 << 17, "shape": 7 * 8 * LEVELS, "meta": 1 << META_BITS}
    good, bad, held = set(sample.good.tolist()), set(sample.bad.tolist()), set(sample.held_good.tolist()) | set(sample.held_bad.tolist())
    given = [1.0 if d in good else 0.0 if d in bad else None for d, *_ in rows]
    known = [d in good or d in bad or d in held for d, *_ in rows]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    marks = {v: given for v in views}
    for _ in range(rounds + 1):
        score, odds, sure = {}, {}, {}
        for v in views:
            counts = [Counter(), Counter()]
            for own, m in zip(features[v], marks[v]):
                for x in own if m is not None else ():
                    counts[0][x] += m
                    counts[1][x] += 1 - m
            totals = [sum(c.values()) + slots[v] for c in counts]
            ratio = lambda x, counts=counts, totals=totals: math.log((counts[0][x] + 1) / totals[0]) - math.log((counts[1][x] + 1) / totals[1])
            score[v] = [sum(map(ratio, own)) / (max(len(own), 1) if v == "text" else 1) for own in features[v]]
        at = [i for i, (d, *_) in enumerate(rows) if d in held]
        y = np.array([float(rows[i][0] in set(sample.held_good.tolist())) for i in at])
        weight = np.where(y > 0, sample.share / y.mean(), (1 - sample.share) / (1 - y.mean()))
        for v, parts in (("text", ("text", "shape")), ("meta", ("meta",))):
            w = platt(np.array([[score[p][i] for p in parts] for i in at]), y, weight)
            odds[v] = [sum(a * score[p][i] for a, p in zip(w, parts)) + w[-1] for i in range(len(rows))]
            low, high = surest(np.array([odds[v][i] for i in at]), y, weight)
            sure[v] = [round(sigmoid(x) * PARTS) / PARTS if x >= high or x <= low else None for x in odds[v]]
        marks = {v: [m if k else o for m, k, o in zip(given, known, sure["text" if v == "meta" else "meta"])] for v in views}
    prior = math.log(sample.share / (1 - sample.share))
    return [(sigmoid(a), sigmoid(b), sigmoid(a + b - prior)) for a, b in zip(odds["text"], odds["meta"])]


def water_level(sizes: dict, weights=(1, 2, 3), most: int = 3) -> dict:
    """The target of each source: shares by weight, stopped at most times its size, the excess shared anew until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not above:
            return target | {s: weight[s] * level for s in open_}
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= above
    return target


def trie(rows: list[tuple]) -> list[tuple]:
    """Sorted nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    convs: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *turns[h:])
    members: dict = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled(rows: list[tuple], target: list, width: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10) -> list[tuple]:
    """Sorted (doc_id, n_features, weight, score, rank)."""

    def features(text: str | None) -> tuple[int, list[str]]:
        w = ALNUM.findall(fold(text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, width + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    texts = [(d, *features(t)) for d, t in rows]
    s, t = Counter(bucket(f) for *_, fs in texts for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    out = []
    for d, n, fs in texts:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)
