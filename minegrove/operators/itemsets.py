"""Baskets and frequent itemsets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The scaled support that the first pass of SON leaves to a part, if the support allows.
LEAST_SCALED = 10


def baskets(df: DataFrame, basket: str, item: str, *, more_than: int = 0) -> DataFrame:
    """Distinct ``(basket, item)`` of baskets with more than ``more_than`` items; nulls are neither."""
    pairs = (
        df.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
        .where(F.col("basket").isNotNull() & F.col("item").isNotNull())
        .distinct()
    )
    if more_than <= 0:
        return pairs
    large = pairs.groupBy("basket").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than)
    return pairs.join(large.select("basket"), "basket", "left_semi")


def transactions(df: DataFrame, date: str, customer: str, item: str, *, more_than: int = 0) -> DataFrame:
    """Baskets keyed ``date-customer``."""
    keyed = df.select(F.concat_ws("-", F.col(date), F.col(customer)).alias("basket"), F.col(item).alias("item"))
    return baskets(keyed, "basket", "item", more_than=more_than)


def frequent_itemsets(pairs: DataFrame, support: int, *, max_size: int | None = None) -> DataFrame:
    """``(items, size, n)``: every itemset in at least ``support`` baskets, ``items`` sorted.

    ``pairs``: distinct ``(basket, item)``. Level-wise: frequent sets that agree but for
    their last item are joined into candidates, candidates with an infrequent subset
    are dropped, and the rest are counted where their parents occur. Occurrences of a
    level are materialised in the shared checkpoint folder for the next; the loop ends
    when a level is empty. No basket stands in one row, so none is too large.
    """
    single = pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    level = cut_lineage(single.select(F.array("item").alias("items"), "n"))
    found = level.withColumn("size", F.lit(1))
    kept = cut_lineage(pairs.join(single.select("item"), "item", "left_semi").select("basket", F.array("item").alias("items")))
    size = 1
    while (max_size is None or size < max_size) and level.take(1):
        head = F.slice("items", F.lit(1), F.lit(size - 1))
        stem = level.select(head.alias("stem"), F.element_at("items", -1).alias("last"))
        a, b = stem.withColumnRenamed("last", "x"), stem.withColumnRenamed("last", "y")
        joined = a.join(b, "stem").where(F.col("x") < F.col("y"))
        candidates = joined.select(F.concat("stem", F.array("x", "y")).alias("items"))
        if size > 1:
            # each subset that lacks one of the first items must be frequent too
            position = F.explode(F.sequence(F.lit(0), F.lit(size - 2)))
            subsets = candidates.select("items", position.alias("i")).select(
                F.col("items").alias("whole"), F.expr("filter(items, (x, j) -> j != i)").alias("items")
            )
            sound = subsets.join(level.select("items"), "items", "left_semi")
            candidates = (
                sound.groupBy("whole").agg(F.count("*").alias("_n")).where(F.col("_n") == size - 1).select(F.col("whole").alias("items"))
            )
        candidates = cut_lineage(candidates)
        if not candidates.take(1):
            break
        here = kept.select("basket", head.alias("stem"), F.element_at("items", -1).alias("last"))
        p, q = here.withColumnRenamed("last", "x"), here.withColumnRenamed("last", "y")
        together = p.join(q, ["basket", "stem"]).where(F.col("x") < F.col("y"))
        occurrences = together.select("basket", F.concat("stem", F.array("x", "y")).alias("items")).join(
            candidates, "items", "left_semi"
        )
        size += 1
        counted = occurrences.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)
        level = cut_lineage(counted.select("items", "n"))
        kept = cut_lineage(occurrences.join(level.select("items"), "items", "left_semi").select("basket", "items"))
        found = found.unionByName(level.withColumn("size", F.lit(size)))
    return found.select("items", "size", "n")


def basket_part(basket: str, parts: int) -> Column:
    """The part a basket belongs to, by the digits of its MD5, so that other engines deal them alike."""
    digits = F.conv(F.substring(F.md5(F.col(basket).cast("string").cast("binary")), 1, 12), 16, 10)
    return F.pmod(digits.cast("bigint"), F.lit(parts)).cast("int")


def son_parts(total: int, support: int, per_part: int) -> int:
    """About ``per_part`` baskets a part, but no more parts than leave a scaled support of ``LEAST_SCALED``."""
    return max(1, min(total // per_part, support // LEAST_SCALED))


def _as_bits(flags: np.ndarray) -> int:
    """A set, given as flags, as the bits of one number."""
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _local_itemsets(baskets_of: np.ndarray, items: np.ndarray, names: list, total: int, least: int, max_size: int | None) -> Iterator[tuple[int, list[tuple]]]:
    """Level by level the sets in at least ``least`` of ``total`` baskets, given as numbered distinct pairs."""
    level: dict[tuple, int] = {}
    for i in np.flatnonzero(np.bincount(items, minlength=len(names)) >= least).tolist():
        flags = np.zeros(total, bool)
        flags[baskets_of[items == i]] = True
        level[names[i],] = _as_bits(flags)
    size = 1
    while level:
        yield size, list(level)
        if size == max_size:
            return
        following: dict[tuple, int] = {}
        for _, group in groupby(sorted(level), key=lambda c: c[:-1]):
            for x, y in combinations(group, 2):
                own = level[x] & level[y]
                if own.bit_count() >= least:
                    following[x + y[-1:]] = own
        level, size = following, size + 1


def son_candidates(pairs: DataFrame, support: int, total: int, *, max_size: int | None = None, per_part: int = 50_000) -> DataFrame:
    """The first pass of SON: itemsets frequent within a part of the baskets, by scaled support. ``items`` and ``size``.

    A superset of the frequent itemsets; for exact results use ``frequent_itemsets``.
    Baskets are dealt by a hash to parts of about ``per_part``, so that the result does
    not depend on the cluster. A part is held in its worker's memory, a bit for each basket and
    frequent set; the loop ends when a level is empty. Where a part's scaled support is
    one, every subset of every basket is frequent: so there are no more parts than leave
    a scaled support of about ``LEAST_SCALED``.
    """

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        numbers, _ = pd.factorize(frame["basket"])
        items, names = pd.factorize(frame["item"], sort=True)
        count = int(numbers.max()) + 1
        least = max(1, ceil(support * count / total - 1e-9)) if total else 1
        found = [(list(c), size) for size, level in _local_itemsets(numbers, items, list(names), count, least, max_size) for c in level]
        return pd.DataFrame(found, columns=["items", "size"])

    kind = dict(pairs.dtypes)["item"]
    parts = son_parts(total, support, per_part)
    dealt = pairs.select(basket_part("basket", parts).alias("_part"), "basket", "item")
    return dealt.groupBy("_part").applyInPandas(local, f"items array<{kind}>, size int").distinct()
