"""Stream sketches over batches, as relations: Bloom filter, Flajolet-Martin, reservoir.

A stream is a table ``(batch, seq, value)``: ``seq`` numbers all elements from 1. The
live forms in ``minegrove.streaming`` give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import bytes_modulo, coefficients, linear_hash

#: Fixed values of the hash families.
BLOOM = {"prime": 114_514, "slots": 69_997, "functions": 7}
DISTINCT = {"prime": 69_997, "slots": 1_919, "functions": 7}


def hashes(number: str, prime: int, slots: int, functions: int) -> list[Column]:
    """The hash functions over a column that holds a value's bytes modulo ``prime``."""
    return [linear_hash(F.col(number), a, b, prime, slots) for a, b in coefficients(functions)]


def with_bits(df: DataFrame, prime: int, slots: int, functions: int) -> DataFrame:
    """A row for each value and each of its bits; the bytes are folded once for all functions."""
    folded = df.withColumn("_x", bytes_modulo("value", prime))
    return folded.withColumn("bit", F.explode(F.array(*hashes("_x", prime, slots, functions)))).drop("_x")


def batched(df: DataFrame, value: str, order: str, size: int) -> DataFrame:
    """A stream from a table whose ``order`` is a dense number from 0: batch 1 has the first ``size`` elements."""
    seq = F.col(order).cast("bigint")
    return df.select((F.floor(seq / size) + 1).cast("bigint").alias("batch"), (seq + 1).alias("seq"), F.col(value).cast("string").alias("value"))


def bloom_rates(stream: DataFrame, *, prime: int = 114_514, slots: int = 69_997, functions: int = 7) -> DataFrame:
    """``(batch, fp, tn, fpr)``: false positives of a Bloom filter that holds all earlier batches.

    An element is called seen if all its bits were set in earlier batches, wrongly so
    if its value first comes in this batch; each occurrence counts. ``fpr`` is null where
    nothing is negative. No state is kept: a bit is set from the first batch with a
    value that maps to it, so two minima and one join say it all. Null values are left out.
    """
    values = stream.where(F.col("value").isNotNull()).groupBy("value", "batch").agg(F.count("*").alias("n"))
    first = values.groupBy("value").agg(F.min("batch").alias("first"))
    bits = with_bits(first, prime, slots, functions)
    set_at = bits.groupBy("bit").agg(F.min("first").alias("set_at"))
    ready = bits.join(set_at, "bit").groupBy("value").agg(F.max("set_at").alias("ready"), F.first("first").alias("first"))
    tested = values.join(ready, "value")
    seen = F.col("ready") < F.col("batch")
    new = F.col("first") == F.col("batch")
    return (
        tested.groupBy("batch")
        .agg(
            F.coalesce(F.sum(F.when(seen & new, F.col("n"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("tn"),
        )
        .withColumn("fpr", F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double")))
    )


def trailing_zeros(h: Column) -> Column:
    """Zeros at the end of the binary form; 3 for 0 itself, which has no one."""
    return F.when(h == 0, 3).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))


def distinct_estimates(stream: DataFrame, *, prime: int = 69_997, slots: int = 1_919, functions: int = 7) -> DataFrame:
    """``(batch, truth, estimate)``: distinct values of each batch and their Flajolet-Martin estimate.

    The mean over the functions of 2^R, R the most trailing zeros; halves round to even.
    """
    zeros = [F.max(trailing_zeros(h)).alias(f"_r{i}") for i, h in enumerate(hashes("_x", prime, slots, functions))]
    values = stream.where(F.col("value").isNotNull()).select("batch", "value").distinct()
    folded = values.withColumn("_x", bytes_modulo("value", prime))
    maxima = folded.groupBy("batch").agg(F.count("*").alias("truth"), *zeros)
    powers = sum((F.pow(F.lit(2.0), F.col(f"_r{i}")) for i in range(functions)), F.lit(0.0))
    return maxima.select("batch", "truth", F.bround(powers / functions).cast("bigint").alias("estimate"))


def draw(seq: Column, salt: int) -> Column:
    """A number in [0, 2^31) for each position, by two rounds of a linear congruential rule."""
    once = F.pmod(F.pmod(seq, F.lit(2**31)) * 1_103_515_245 + (12_345 + salt), F.lit(2**31))
    return F.pmod(F.call_function("div", once, F.lit(65_536)) * 22_695_477 + F.pmod(once, F.lit(65_536)) * 69_069 + 1, F.lit(2**31))


def reservoir(stream: DataFrame, size: int = 100) -> DataFrame:
    """``(batch, slot, value, n)``: the reservoir after each batch.

    The first ``size`` elements fill it; element n then enters with probability size / n,
    into any slot. Randomness is a hash of n, so each element's fate is known by itself:
    a slot holds the last element that entered it. n counts elements so far.
    """
    n = F.col("seq")
    filling = n <= size
    enters = filling | (F.pmod(draw(n, 1), n) < size)
    slot = F.when(filling, n - 1).otherwise(F.pmod(draw(n, 2), F.lit(size)))
    entered = stream.where(enters).select("batch", "seq", "value", slot.alias("slot"))
    last = entered.groupBy("batch", "slot").agg(F.max_by("value", "seq").alias("value"))
    totals = stream.groupBy("batch").agg(F.max("seq").alias("n"))
    # a slot's value holds until a later batch replaces it, else to the end
    since = last.withColumn("until", F.lead("batch").over(W.partitionBy("slot").orderBy("batch")))
    end = stream.agg(F.max("batch").alias("_end"))
    spans = since.crossJoin(F.broadcast(end))  # one row
    held = spans.select("slot", "value", F.explode(F.sequence("batch", F.coalesce(F.col("until") - 1, "_end"))).alias("batch"))
    return held.join(totals, "batch").select("batch", "slot", "value", "n")
