"""Personal data by weak supervision.

Base kinds (email, ip, card, phone) are found by fixed patterns and always stay. For
further kinds loose patterns propose candidate spans, and labelers vote on each: regular
expressions and checksums, gazetteers, and the words before the span. Expectation
maximisation over the vote patterns of the whole corpus estimates how reliable every
labeler is and how likely each pattern is a true span; a logistic classifier is trained
on these soft labels over votes and span features, and decides which candidates are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.plan import record, release, small_batches
from tessera.llm.text import WHITE, Words, chunks, column_bytes

BASE = ("email", "ip", "card", "phone")
ADDED = ("bank_account", "local_phone", "national_id", "person", "secret")
KINDS = BASE + ADDED

# Base kinds. Possessive repeats and look-behinds only spare retries that can't succeed:
# a failing start in a run of digits fails at all later ones.
_EMAIL_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Matches of local@domain: only a run that ends at an @ can start one, so each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and not _NOT_LOCAL.match(text, low - 1):
            low -= 1
        found = low < at and _EMAIL_RIGHT.match(text, at + 1)
        if found:
            yield "email", low, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, by kind and start; failing ones are dropped."""
    out = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        # Parts may have many leading zeros; more than 4300 digits are beyond int().
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# Candidates and labelers -------------------------------------------------------------

_CANDIDATES = {
    "bank_account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "person": re.compile(r"(?:(?<=[\x20\x09-\x0D])|\A)(?=([A-Z][a-z]+\x20[A-Z][a-z]+)(?![A-Za-z]))"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"),
}
_CONTEXT = {
    "bank_account": re.compile(r"(?i)(?:iban|account|bank)"),
    "local_phone": re.compile(r"(?i)(?:phone|tel|call|mobile|fax|cell)"),
    "national_id": re.compile(r"(?i)(?:ssn|social|security|tax|national)"),
    "person": re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.?|\b(?i:name is|named|signed|regards|contact|dear|by)),?\s\Z"),
    "secret": re.compile(r"(?i)(?:token|secret|key|passw|pwd|auth|credential)"),
}
#: Words that show that a span of the kind is something else.
_AGAINST = {
    "bank_account": re.compile(r"(?i)(?:isbn|serial|model)"),
    "local_phone": re.compile(r"(?i)(?:isbn|order|part|version)"),
    "national_id": re.compile(r"(?i)(?:isbn|order|part|date)"),
    "person": re.compile(r"(?i)(?:street|saint|city|river|mount)"),
    "secret": re.compile(r"(?i)(?:http|www\.|/|sha|commit|checksum)"),
}
GIVEN_NAMES = frozenset(
    "Adam Alice Amelia Andrea Anna Antonio Barbara Benjamin Carlos Carmen Charles Charlotte Christian Claire Daniel David Diana Elena Elizabeth Emily Emma Eric "
    "Fernando Francisco Frank George Hannah Hans Heinrich Henry Isabel Jack Jacques James Jennifer Jessica Joseph Juan Julia Karen Karl Katharina Laura Lisa Louis "
    "Lucas Luis Manuel Maria Marie Mark Martin Mary Matthew Michael Miguel Nicole Olivia Patricia Paul Pedro Peter Philippe Pierre Rachel Richard Robert Sarah Sofia "
    "Sophie Stefan Stephen Susan Thomas William Wolfgang".split()
)
_CAPITALISED, _CAPITALISED_BEFORE = re.compile(r"\x20[A-Z]"), re.compile(r"(?:\A|[\x20\n])(?!(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra|Dear|By|Signed|Contact|Regards)\b)[A-Z][A-Za-z]*\.?\x20\Z")
#: Countries whose account numbers begin with their letters, with the length of these.
ACCOUNT_LENGTHS = dict(
    (x[:2], int(x[2:])) for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IS26 IT27 "
        "JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
    ).split()
)
#: The highest area of national ids that was issued by place, numbers printed as specimens, and codes of free calls.
LAST_AREA, SPECIMENS, FREE_CALLS = 772, ("078-05-1120", "219-09-9999", "457-55-5462"), ("800", "833", "844", "855", "866", "877", "888")
#: Beginnings of issued keys.
_KEY_STARTS = ("sk-", "pk_", "ghp_", "gho_", "AKIA", "ASIA", "xox", "eyJ", "AIza")
#: What is known of labelers beforehand, by kind, as P(vote | false) and P(vote | true): of persons, shape and sentence can only speak
#: against a span, a short list of names misses most, and a title or greeting before it is nearly sure.
PRIORS = {
    "person": {
        0: ((0.6, 0.37, 0.03), (0.1, 0.87, 0.03)), 1: ((0.1, 0.87, 0.03), (0.03, 0.94, 0.03)), 2: ((0.6, 0.35, 0.05), (0.4, 0.2, 0.4)),
        3: ((0.3, 0.68, 0.02), (0.05, 0.45, 0.5)), 4: ((0.05, 0.92, 0.03), (0.05, 0.92, 0.03)),
    }
}
#: Weight of the squared weights in the span classifier; small, as true spans may be few.
RIDGE = 0.05
LABELERS = ("shape", "checksum", "gazetteer", "context", "setting")
NO, ABSTAIN, YES = 0, 1, 2


def _mod97(text: str) -> bool:
    raw = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """What the labelers say of a candidate, in the order of LABELERS."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = sum(c.isdigit() for c in span)
    shape = checksum = gazetteer = ABSTAIN
    if kind == "secret":
        mixed = (any(c.islower() for c in span) or any(c.isupper() for c in span)) and digits > 0
        hexes = all(c in "0123456789abcdefABCDEF" for c in span)
        shape = YES if mixed and (len(span) in (32, 40, 64) if hexes else any(c.isupper() for c in span)) else NO if not mixed else ABSTAIN
        distinct = len(set(span))
        checksum = YES if distinct >= 11 and 0.1 <= digits / len(span) <= 0.9 else NO
        gazetteer = YES if span.startswith(_KEY_STARTS) else ABSTAIN
    elif kind == "person":
        one, two = span.split(" ")
        run = _CAPITALISED.match(text, end) or _CAPITALISED_BEFORE.search(before)  # a heading, or a word over and over
        shape = NO if one == two or run or len(one) < 3 or len(two) < 3 else ABSTAIN
        gazetteer = YES if one in GIVEN_NAMES else NO
        first = start == 0 or text[start - 2 : start] in (". ", ".\n", "? ", "! ")  # of a sentence, unless the full stop is a title's
        checksum = NO if first and not _CONTEXT[kind].search(before) else ABSTAIN
    elif kind == "bank_account":
        shape = YES if 15 <= len(span.replace(" ", "")) <= 34 else NO
        checksum = YES if _mod97(span) else NO
        gazetteer = YES if ACCOUNT_LENGTHS.get(span[:2]) == len(span.replace(" ", "")) else NO
    elif kind == "national_id":
        area, group, serial = span.split("-")
        shape = YES
        checksum = NO if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else YES
        gazetteer = NO if span in SPECIMENS else YES if int(area) <= LAST_AREA else ABSTAIN
    else:
        raw = re.sub("[^0-9]", "", span)
        shape = YES if "(" in span or span.count("-") == 2 else ABSTAIN
        checksum = NO if raw[0] in "01" or raw[3] in "01" else YES
        gazetteer = NO if raw[1] == "9" or raw[1:3] == "11" or raw[4:6] == "11" else ABSTAIN if raw[:3] in FREE_CALLS else YES
    context = YES if _CONTEXT[kind].search(before) else NO if _AGAINST[kind].search(before) else ABSTAIN
    last = before.rstrip(" ")[-1:]
    setting = YES if last in ('"', "'", "=", ":") else ABSTAIN if kind == "person" or not before else NO
    return shape, checksum, gazetteer, context, setting


def features(kind: str, text: str, start: int, end: int) -> int:
    """Length class and make-up of a span, as a number below 64."""
    span = text[start:end]
    size = min(7, int(np.log2(max(1, end - start))))
    return size * 8 + 4 * any(c.isdigit() for c in span) + 2 * any(c.isupper() for c in span) + (not span.isalnum())


def candidates(text: str, taken: list[Span]) -> list[Span]:
    """Spans of added kinds that meet no base span, leftmost first within a kind. Those of persons may overlap:
    of three capitalised words both pairs are candidates."""
    out = []
    busy = sorted((s, e) for _, s, e in taken)
    starts, reach = [s for s, _ in busy], list(accumulate((e for _, e in busy), max))
    for kind, pattern in _CANDIDATES.items():
        for m in pattern.finditer(text):
            start, end = m.span(pattern.groups)
            before = bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                out.append((kind, start, end))
    return out


_PATTERNS = 3 ** len(LABELERS)


def _code(kind: str, text: str, start: int, end: int) -> tuple[int, int, int]:
    pattern = 0
    for v in votes(kind, text, start, end):
        pattern = pattern * 3 + v
    return ADDED.index(kind), pattern, features(kind, text, start, end)


# Documents worth a closer look --------------------------------------------------------

def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts that can hold any span: with a digit, an @, a long word or a capital letter after a small one and a space."""
    signs = ((raw >= 48) & (raw <= 57)) | (raw == 64)
    signs[2:] |= (raw[2:] >= 65) & (raw[2:] <= 90) & (raw[1:-1] == 32) & (raw[:-2] >= 97) & (raw[:-2] <= 122)
    marked = np.concatenate(([0], np.cumsum(signs)))
    found = marked[offsets[1:]] > marked[offsets[:-1]]
    words = Words(raw, offsets, separators=WHITE, fold=False)
    owner = words.owner()
    found[owner[words.end - words.start >= 20]] = True
    return found


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch, with None for texts without any span."""
    for part in chunks(batch, batch.schema.names[column]):
        found = suspects(*column_bytes(part.column(column)))
        texts: list[str | None] = [None] * part.num_rows
        for i in np.flatnonzero(found):
            texts[i] = part.column(column)[int(i)].as_py()
        yield part, texts


_COUNTS = "kind int, pattern int, feature int, n long"


def _vote_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int, int], int] = {}
    for batch in batches:
        for _, texts in _texts(batch, 0):
            for text in filter(None, texts):
                for span in candidates(text, base_spans(text)):
                    code = _code(span[0], text, *span[1:])
                    counts[code] = counts.get(code, 0) + 1
    if counts:
        schema = pa.schema([("kind", pa.int32()), ("pattern", pa.int32()), ("feature", pa.int32()), ("n", pa.int64())])
        yield record(schema, [*zip(*counts, strict=True), list(counts.values())])


# Reliabilities and classifier ----------------------------------------------------------


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, priors: dict[int, tuple] | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Votes (n, labelers) with counts: the posterior of each row, the share of true spans, and the
    reliabilities P(vote | truth) as (labeler, truth, vote).

    It starts from labelers that are right more often than not, and keeps a prior of that view
    worth a hundredth of the spans (two at least), so that labelers who rarely speak don't
    turn round. A span that no labeler votes for is false. priors: P(vote | false), P(vote | true) of a labeler, by its place.
    """
    usual = ((0.65, 0.25, 0.1), (0.1, 0.25, 0.65))
    prior = np.array([(priors or {}).get(k, usual) for k in range(patterns.shape[1])]) * max(2.0, counts.sum() / 100)
    rates, share = prior / prior.sum(2, keepdims=True), 0.3
    posterior, backed = np.full(len(patterns), 0.5), (patterns == YES).any(1)
    for _ in range(rounds):
        log = np.zeros((len(patterns), 2))
        for k in range(patterns.shape[1]):
            log += np.log(rates[k][:, patterns[:, k]].T)
        odds = log[:, 1] - log[:, 0] + np.log(share / (1 - share))
        before, posterior = posterior, np.where(backed, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.0)
        for k in range(patterns.shape[1]):
            for truth, weight in ((1, posterior), (0, 1 - posterior)):
                seen = np.bincount(patterns[:, k], counts * weight, 3) + prior[k, truth]
                rates[k, truth] = seen / seen.sum()
        share = float(((counts * posterior).sum() + 1) / (counts.sum() + 2))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, share, rates


@dataclass
class SpanModel:
    """Weights of the logistic classifier for each added kind, and the labelers' reliabilities."""

    weights: np.ndarray
    reliabilities: dict[str, np.ndarray]
    known: dict[tuple[int, int, int], float] = field(default_factory=dict)  # probabilities by code, whose number is bounded

    def of(self, code: tuple[int, int, int]) -> float:
        if code not in self.known:
            pattern = np.array([code[1]])
            backed = (_unpacked(pattern) == YES).any()  # a span that no labeler votes for is never added
            self.known[code] = float(self.probability(code[0], pattern, np.array([code[2]]))[0]) if backed else 0.0
        return self.known[code]

    def probability(self, kind: int, patterns: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(patterns, feature) @ self.weights[kind], -30, 30)))


def _unpacked(pattern: np.ndarray) -> np.ndarray:
    return np.stack([(pattern // 3 ** (len(LABELERS) - 1 - k)) % 3 for k in range(len(LABELERS))], 1)


def _design(pattern: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """One-hot votes, length class, make-up bits and a constant."""
    given = _unpacked(pattern)
    hot = [(given[:, k] == v) for k in range(given.shape[1]) for v in (NO, YES)]
    size = [(feature // 8 == s) for s in range(8)]
    bits = [(feature >> b) & 1 for b in range(3)]
    return np.stack([*hot, *size, *bits, np.ones(len(pattern))], 1).astype(float)


def fit_spans(counts: list[tuple[int, int, int, int]]) -> SpanModel:
    """The classifier from the corpus' counts of (kind, vote pattern, feature); their number is bounded."""
    width = _design(np.zeros(1, int), np.zeros(1, int)).shape[1]
    weights, rates = np.zeros((len(ADDED), width)), {}
    for kind, name in enumerate(ADDED):
        own = np.array([c[1:] for c in sorted(counts) if c[0] == kind], np.int64).reshape(-1, 3)
        if not len(own):
            continue
        label, _, rates[name] = expectation_maximisation(_unpacked(own[:, 0]), own[:, 2].astype(float), priors=PRIORS.get(name))
        x, n, w = _design(own[:, 0], own[:, 1]), own[:, 2].astype(float), np.zeros(width)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (n * (label - p)) - RIDGE * w
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(width), gradient)
            w += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-8:
                break
        weights[kind] = w
    return SpanModel(weights, rates)


def find_spans(text: str, model: SpanModel, least: float = 0.5) -> list[Span]:
    """All spans of a text by kind as listed, then start: base ones and those the classifier adds, of overlapping
    ones of a kind the likeliest."""
    base = base_spans(text)
    out, added = list(base), []
    for span in candidates(text, base):
        p = model.of(_code(span[0], text, *span[1:]))
        if p > least:
            added.append((-p, span))
    taken: dict[str, list[tuple[int, int]]] = {k: [] for k in ADDED}
    for _, (kind, start, end) in sorted(added, key=lambda a: (a[0], a[1][1])):
        at = bisect_left(taken[kind], (start, end))
        if (at == 0 or taken[kind][at - 1][1] <= start) and (at == len(taken[kind]) or end <= taken[kind][at][0]):
            taken[kind].insert(at, (start, end))
            out.append((kind, start, end))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def span_model(docs: DataFrame) -> Broadcast:
    """Counts votes over all texts, fits the classifier, and shares it."""
    counts = docs.select("text").mapInArrow(_vote_task, _COUNTS).groupBy("kind", "pattern", "feature").agg(F.sum("n").alias("n"))
    return docs.sparkSession.sparkContext.broadcast(fit_spans([tuple(r) for r in counts.collect()]))


_FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in BASE], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
_NOTHING = hashlib.sha256(b"").hexdigest()


def _find_task(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _texts(batch, 1):
            rows = []
            for text in texts:
                spans = find_spans(text, model.value) if text else []
                base = [s for s in spans if s[0] in BASE]
                joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                rows.append((*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(joined.encode()).hexdigest() if base else _NOTHING, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), len(spans)))
            yield record(_FOUND_SCHEMA, [part.column(0), *zip(*rows, strict=True)])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for every row.

    spans lists kind:start:end (code points, end exclusive) of all spans, by kind as in KINDS
    and then start, n_spans counts them; base_sha256 digests those of base kinds. Null and empty texts have none;
    repeated rows are each answered and each vote; without candidates nothing is added; an
    empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = span_model(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _find_task(it, model), ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _FOUND_SCHEMA))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans as one, by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents, in their columns, with personal data masked; a changed text's n_chars follows it.

    Null and empty texts stay as they are; repeated rows are each masked; an empty table gives
    no rows; further columns, of any name, pass through.
    """
    model, schema = span_model(docs), to_arrow_schema(docs.schema)
    names = [c.lower() for c in docs.columns]
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, at):
                columns = list(part.columns)
                spans = [find_spans(t, model.value) if t else [] for t in texts]
                if any(spans):
                    values = [masked(t, s) if s else None for t, s in zip(texts, spans, strict=True)]
                    changed = pa.array([bool(s) for s in spans])
                    columns[at] = pc.if_else(changed, pa.array(values, columns[at].type), columns[at])
                    if size is not None:
                        columns[size] = pc.if_else(changed, pa.array([len(v or "") for v in values], columns[size].type), columns[size])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema)
