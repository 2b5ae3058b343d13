"""Hot keys: finding them, and joining without one task taking a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width


def hot_keys(df: DataFrame, key: str, share: float = 0.01, counts: DataFrame | None = None) -> DataFrame:
    """``(key, _parts)``: keys with more than ``share`` of the rows that have a key, and how many such shares they fill.

    At most ``1 / share`` rows whatever the input, so the result may be broadcast, and
    the parts of all of them are at most twice as many. Counts are combined before the
    shuffle; the total is one row. ``counts``: the rows of each key (``key``, ``_n``),
    where they are known already.
    """
    if counts is None:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).withColumn("_one", F.lit(1))
    unit = F.col("_total") * F.lit(share)
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .where(F.col("_n") > unit)
        .select(key, F.ceil(F.col("_n") / unit).cast("int").alias("_parts"))
    )


def _dealt(df: DataFrame, key: str, hot: DataFrame, own: str, spread: Column) -> DataFrame:
    """Rows with ``own``, the part of their key that they fall to; 0 where the key is not hot."""
    part = F.pmod(F.hash(spread), F.col("_parts"))
    return df.join(hot, key, "left").withColumn(own, F.coalesce(part, F.lit(0))).drop("_parts")


def _repeated(df: DataFrame, key: str, hot: DataFrame, other: str) -> DataFrame:
    """Rows once for each part that the other side's rows of their key are dealt to."""
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    return df.join(hot, key, "left").withColumn(other, F.explode(F.sequence(F.lit(0), last))).drop("_parts")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    how: str,
    spread: Column,
    condition: Column | None = None,
    share: float | None = None,
    counts: DataFrame | None = None,
    right_spread: Column | None = None,
    right_counts: DataFrame | None = None,
) -> DataFrame:
    """Join on ``key`` with the left rows of hot keys dealt to several tasks.

    ``left`` holds the skew; ``spread`` is an expression over it (a row id) that
    chooses the part, so a retried task chooses the same. A hot key has as many parts as
    it fills shares of the rows (``share``; a shuffle partition's, 1 % at most), and its
    right rows, and only those, are repeated once a part: copies follow the key's size,
    not the cluster's. ``condition`` may name columns of both sides, which must differ
    but for ``key``. ``how`` is one of inner, left, left_semi, left_anti. Null keys keep
    their meaning: they match nothing. ``counts``: as for ``hot_keys``.

    With ``right_spread`` (inner joins) the right rows of a hot key are dealt out too, and
    each pair of parts meets in one task, so neither side of a hot key is ever whole in one.
    """
    if right_spread is not None and how != "inner":
        raise ValueError("only an inner join can deal out both sides")
    share = share or min(0.01, 1 / max(2, shuffle_width(left.sparkSession)))
    hot = F.broadcast(hot_keys(left.select(key), key, share, counts))
    a = _dealt(left, key, hot, "_salt", spread)
    b = _repeated(right.where(F.col(key).isNotNull()), key, hot, "_rsalt")
    on = (F.col(key) == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt"))
    if right_spread is not None:
        far = F.broadcast(hot_keys(right.select(key), key, share, right_counts))
        a = _repeated(a, key, far, "_salt2")
        b = _dealt(b, key, far, "_rsalt2", right_spread)
        on = on & (F.col("_salt2") == F.col("_rsalt2"))
    if condition is not None:
        on = on & condition
    return a.join(b.withColumnRenamed(key, "_rkey"), on, how).drop("_rkey", "_rsalt", "_salt", "_rsalt2", "_salt2")
