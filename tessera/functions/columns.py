"""Column builders: nulls, numbers, bins, information measures and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of a missing value, by the reader that treats them so. All are compared trimmed.
NULL_TOKENS = {
    "table": ("", "nan", "None", "NULL", "NA", "N/A"),
    "knowledge": ("", "nan", "none", "null", "na", "n/a"),  # compared in lower case
    "identifier": ("nan", "None", "<NA>"),
    "structure": ("", "nan", "n.a."),  # compared in lower case
}
_LOWERED = {"knowledge", "structure"}


def n_rows() -> Column:
    """The number of rows of a group."""
    return F.count(F.lit(1))


def null_normalised(c: Column, vocabulary: str = "table") -> Column:
    """The trimmed string, null if it spells a missing value in that vocabulary."""
    text = F.trim(c.cast("string"))
    seen = F.lower(text) if vocabulary in _LOWERED else text
    return F.when(~seen.isin(*NULL_TOKENS[vocabulary]), text)


def number(c: Column) -> Column:
    """A double, null where the text is none or not finite."""
    n = c.cast("string").try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def finite(c: Column) -> Column:
    """A number with NaN and infinities as null, so that aggregates skip them."""
    n = c.cast("double")
    return F.when(~(F.isnan(n) | (F.abs(n) == float("inf"))), n)


def right_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first bin whose upper edge is not below the value; the last is open."""
    out = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[-1])


def left_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first bin whose upper edge is above the value; the last is open."""
    out = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c < edge, label)
    return out.otherwise(labels[-1])


def support_category(c: Column) -> Column:
    return right_closed(c, [0, 3, 9, 19], ["NO_SUPPORT", "VERY_LOW_1_TO_3", "LOW_4_TO_9", "MODERATE_10_TO_19", "HIGH_GE_20"])


def similarity_band(c: Column) -> Column:
    return F.when(c >= 0.9, "HIGH").when(c >= 0.7, "MODERATE").otherwise("LOW")


def confidence_level(certainty: Column) -> Column:
    return left_closed(certainty, [0.4, 0.7], ["Low", "Medium", "High"])


def entropy(p: Column) -> Column:
    """Binary entropy in bits, 0 at 0 and 1."""
    q = F.lit(1.0) - p
    part = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return part(p) + part(q)


def effect_category(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def ratio(a: Column, b: Column) -> Column:
    """A quotient of doubles, null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def identifier_pattern(c: Column) -> Column:
    """The make-up of an identifier."""
    text = F.trim(c)
    return (
        F.when(text.isNull() | (text == ""), "EMPTY").when(text.rlike("^[0-9]+$"), "DIGITS").when(text.rlike("^[A-Za-z]+$"), "LETTERS")
        .when(text.rlike("^[A-Za-z]+[0-9]+$"), "LETTERS_DIGITS").when(text.rlike("^[A-Za-z0-9]+([#_:./ -][A-Za-z0-9]+)+$"), "WITH_SEPARATORS").otherwise("OTHER")
    )


def sorted_set(c: Column, separator: str = ";") -> Column:
    """An aggregate: the distinct values of a group, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c.cast("string"))), separator)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its norm, null if that is 0."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all set bits of two arrays of 64-bit words."""
    ones = lambda words: F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))
    both, either = F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
    return F.try_divide(ones(both).cast("double"), ones(either).cast("double"))


def common_bits(a: list[Column], b: list[Column]) -> Column:
    """Bits set in both of two rows of 64-bit words, which are columns; for joins that meet many pairs."""
    each = [F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b, strict=True)]
    return sum(each[1:], each[0])


def packed_bits(places: Column, bits: int) -> Column:
    """Places of set bits (from 0, below bits) as 64-bit words, the lowest first; places beyond are ignored."""
    one = F.lit(1).cast("long")

    def word(w: int) -> Column:
        own = F.array_distinct(F.filter(places, lambda p: (p >= 64 * w) & (p < 64 * w + 64)))
        return F.aggregate(own, F.lit(0).cast("long"), lambda s, p: s.bitwiseOR(F.call_function("shiftleft", one, (p - 64 * w).cast("int"))))

    return F.array(*[word(w) for w in range(-(-bits // 64))])


def unpacked_bits(words: Column) -> Column:
    """The places of set bits of packed_bits(), ascending."""
    each = F.transform(words, lambda w, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1).cast("long")) == 1, i * 64 + b)), lambda b: b.isNotNull()))
    return F.flatten(each)


def dimension(v: Column, name: str, base: int = 0) -> Column:
    """The element of a vector that a name like emb_17 stands for; base is the number of the first one."""
    return F.get(v, F.lit(int(name.rpartition("_")[2]) - base))
