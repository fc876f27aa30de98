"""Column expressions for word shingles inside a row, for operators that stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII bytes that separate words of letters and digits, and of letters.
NOT_ALNUM, NOT_ALPHA = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the filter that a row's shingles meet before any leaves the row: so many for each known shingle, in these bounds.
BITS_EACH, FILTER_BITS = 32, (1 << 16, 1 << 24)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(lowered: Column, separator: str) -> Column:
    """The words of a lower-cased text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), separator), "")


def shingle_hashes(column: str, size: int) -> Column:
    """A hash for each place of the word array `column` at which `size` words begin."""
    each = F.transform(column, lambda x, i: F.xxhash64(x, *(F.get(column, i + k) for k in range(1, size))))
    return F.slice(each, F.lit(1), F.greatest(F.size(column) - (size - 1), F.lit(0))) if size > 1 else each


def filter_words(hashes: DataFrame) -> Column:
    """A bit set of the distinct hashes in column `h` as a constant array; at most FILTER_BITS[1] / 64 rows reach the driver."""
    n, (low, high) = hashes.count() * BITS_EACH, FILTER_BITS
    size = min(max(1 << max(n - 1, 1).bit_length(), low), high)
    bit = F.col("h").bitwiseAND(F.lit(size - 1))
    rows = hashes.select(F.shiftright(bit, 6).cast("int").alias("i"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b")).groupBy("i").agg(F.expr("bit_or(shiftleft(1L, b))").alias("v"))
    values = [0] * (size // 64)
    for i, v in rows.collect():
        values[i] = v
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def passes(h: Column, bits: Column) -> Column:
    """Whether the hash `h` is in the bit set; also true for a share of other hashes that is that of the bits set."""
    place = F.shiftright(h, 6).bitwiseAND((F.size(bits) - 1).cast("long")).cast("int")
    return F.getbit(F.get(bits, place), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def hits(column: str, bits: Column) -> Column:
    """The places of the array `column` of hashes that pass the filter."""
    return F.array_compact(F.transform(column, lambda h, i: F.when(passes(h, bits), i)))
