"""Integer hashes that other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_modulo(column: str | Column, prime: int) -> Column:
    """The UTF-8 bytes of a string as one big integer, modulo ``prime`` (below 2^31).

    Folded byte by byte, so any length fits a bigint; the empty string is 0.
    """
    col = F.col(column) if isinstance(column, str) else column
    digits = F.hex(F.encode(col, "utf-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )

    def fold(acc: Column, at: Column) -> Column:
        byte = F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("bigint")
        return F.pmod(acc * 256 + byte, F.lit(prime))

    return F.when(col.isNotNull(), F.aggregate(places, F.lit(0).cast("bigint"), fold))


def linear_hash(number: Column, a: int, b: int, prime: int, slots: int) -> Column:
    """((a * number + b) mod prime) mod slots."""
    return F.pmod(F.pmod(number * (a % prime) + (b % prime), F.lit(prime)), F.lit(slots))


def coefficients(count: int, seed: int = 2024) -> list[tuple[int, int]]:
    """Pairs (a, b) below 2^31 from a linear congruential rule."""
    out, x = [], seed
    for _ in range(count):
        x = (x * 1_103_515_245 + 12_345) % 2**31
        a = max(1, x)
        x = (x * 1_103_515_245 + 12_345) % 2**31
        out.append((a, x))
    return out
