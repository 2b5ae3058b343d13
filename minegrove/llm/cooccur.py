"""Items that appear together: pair counts over collapsed baskets."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut_lineage
from .setjoin import numbered

#: Counts multiply to more than a bigint holds.
WIDE = "decimal(38,0)"


def _fraction(value: Fraction | float | int | str) -> Fraction:
    return Fraction(str(value)) if isinstance(value, float) else Fraction(value)


def basket_items(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``(basket, item)``; rows in which either is null are no part of a basket."""
    return (
        df.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
        .where(F.col("basket").isNotNull() & F.col("item").isNotNull())
        .distinct()
    )


def collapse_baskets(pairs: DataFrame) -> DataFrame:
    """``(items, weight)``: each different set of items once, with the number of baskets that are it.

    ``pairs``: distinct ``(basket, item)``. The arrays are as long as a basket has
    items, so items that cannot matter, and giant baskets, should be left out before.
    """
    baskets = pairs.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return baskets.groupBy("items").agg(F.count("*").alias("weight"))


def _enumerate(collapsed: DataFrame, block: int) -> DataFrame:
    """``(item_1, item_2, weight)`` of every pair in every row, ``item_1 < item_2``.

    Rows with more than ``block`` items are first cut into pairs of blocks, which are
    dealt to all tasks, so that one huge basket isn't one task's work.
    """

    def within(rows: DataFrame) -> DataFrame:
        return (
            rows.select("weight", "items", F.posexplode("items").alias("_p", "item_1"))
            .select("weight", "item_1", F.explode(F.expr("slice(items, _p + 2, size(items))")).alias("item_2"))
            .select("item_1", "item_2", "weight")
        )

    short = within(collapsed.where((F.size("items") > 1) & (F.size("items") <= block)))
    blocks = collapsed.where(F.size("items") > block).withColumn(
        "_blocks",
        F.expr(f"transform(sequence(0, (size(items) - 1) div {block}), i -> slice(items, i * {block} + 1, {block}))"),
    )
    first = blocks.select("weight", "_blocks", F.posexplode("_blocks").alias("_i", "_a"))
    dealt = first.select(
        "weight", "_a", "_i", F.posexplode(F.expr("slice(_blocks, _i + 1, size(_blocks))")).alias("_d", "_b")
    ).repartition(F.col("_a"), F.col("_d"))
    across = dealt.where("_d > 0").select(F.explode("_a").alias("item_1"), "_b", "weight")
    across = across.select("item_1", F.explode("_b").alias("item_2"), "weight")
    same = within(dealt.where("_d = 0").select("weight", F.col("_a").alias("items")))
    return short.unionByName(across).unionByName(same)


def _of_giants(pairs: DataFrame, block: int) -> DataFrame:
    """``(item_1, item_2, weight)`` of baskets too large for an array, given as ``(basket, item, n)``.

    The items of a basket are dealt to blocks by hash, and every two blocks, and each with
    itself, meet in a task of their own, so a basket is a task's work nowhere.
    """
    dealt = pairs.withColumn("_blocks", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "_own", F.pmod(F.xxhash64("item"), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    keyed = dealt.withColumn("_other", other).select(
        "basket", "item", "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi")
    )
    a = keyed.withColumnsRenamed({"item": "item_1", "_own": "_own_1"})
    b = keyed.withColumnsRenamed({"item": "item_2", "_own": "_own_2"})
    met = a.join(b, ["basket", "_lo", "_hi"]).where(F.col("item_1") < F.col("item_2"))
    apart = (F.col("_own_1") != F.col("_own_2")) | (F.col("_lo") == F.col("_hi"))
    return met.where(apart).select("item_1", "item_2", F.lit(1).cast("bigint").alias("weight"))


def pair_counts(
    df: DataFrame,
    basket: str,
    item: str,
    *,
    min_count: int = 1,
    min_share: Fraction | float = 0,
    min_lift: Fraction | float = 0,
    block: int = 512,
    array_limit: int = 10_000,
) -> DataFrame:
    """Pairs of items by the number of baskets that hold both, with lift and conviction.

    Kept are pairs in at least ``min_count`` baskets, in at least ``min_share`` of all
    baskets, and together at least ``min_lift`` times as often as if independent
    (n12 · N >= min_lift · n1 · n2, in exact integers).

    Columns: ``item_1 < item_2`` (byte order), ``n1``, ``n2``, ``n12``, ``baskets`` (N),
    ``lift``, ``conviction`` (of item_1 => item_2; null where item_1 never comes without item_2).

    The distinct rows are materialised once, with baskets and items as numbers. Then items
    are left out that lie in too few baskets for any pair to be kept, which loses
    nothing and bounds what is left: at most mean basket size / min_share items. Baskets
    with equal item sets are collapsed into weights, pairs are listed once for each
    different basket, and weights are summed. Baskets that still have more than
    ``array_limit`` items are never one row: pairs of their blocks meet in tasks of their own.

    Repeated rows count once; baskets of one item count in N; null items and baskets
    are no rows. An empty table gives an empty result.
    """
    share, lift = _fraction(min_share), _fraction(min_lift)
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item"))
    rows = rows.where(F.col("basket").isNotNull() & F.col("item").isNotNull())
    number = numbered(rows, "item")
    pairs = cut_lineage(basket_items(rows.select(numbered(rows, "basket").alias("basket"), number.alias("item")), "basket", "item"))
    total = pairs.select("basket").distinct().agg(F.count("*").alias("baskets")).withColumn("_one", F.lit(1))
    enough = (F.col("_n") >= min_count) & (
        F.col("_n").cast(WIDE) * F.lit(share.denominator) >= F.col("baskets").cast(WIDE) * F.lit(share.numerator)
    )
    counts = cut_lineage(
        pairs.groupBy("item")
        .agg(F.count("*").alias("_n"))
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .where(enough)
        .select("item", "_n", "baskets")
    )
    kept = pairs.join(counts.select("item"), "item", "left_semi")
    listed = None
    if counts.count() > array_limit:  # else no basket can have more items
        sizes = kept.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > array_limit)
        giants = cut_lineage(sizes)
        if giants.take(1):
            sized = salted_join(kept, giants, "basket", how="inner", spread=F.col("item"))
            listed = _of_giants(sized, block)
            kept = kept.join(giants, "basket", "left_anti")
    short = _enumerate(collapse_baskets(kept), block)
    listed = short if listed is None else short.unionByName(listed)
    together = listed.groupBy("item_1", "item_2").agg(F.sum("weight").alias("n12")).where(F.col("n12") >= min_count)
    one = counts.select(F.col("item").alias("item_1"), F.col("_n").alias("n1"), "baskets")
    two = counts.select(F.col("item").alias("item_2"), F.col("_n").alias("n2"))
    joined = together.join(one, "item_1").join(two, "item_2")
    n12, n1, n2, n = (F.col(c).cast(WIDE) for c in ("n12", "n1", "n2", "baskets"))
    joined = joined.where(n12 * F.lit(share.denominator) >= n * F.lit(share.numerator))
    if lift:
        joined = joined.where(n12 * n * F.lit(lift.denominator) >= n1 * n2 * F.lit(lift.numerator))
    # by their own names again, in their order
    named = rows.select("item", number.alias("no")).distinct()
    for end in (1, 2):
        own = named.select(F.col("no").alias(f"item_{end}"), F.col("item").alias(f"name_{end}"))
        joined = joined.join(own, f"item_{end}")
    swap = F.col("name_1") > F.col("name_2")
    joined = joined.select(
        F.least("name_1", "name_2").alias("item_1"),
        F.greatest("name_1", "name_2").alias("item_2"),
        F.when(swap, F.col("n2")).otherwise(F.col("n1")).alias("n1"),
        F.when(swap, F.col("n1")).otherwise(F.col("n2")).alias("n2"),
        "n12",
        "baskets",
    )
    real = {c: F.col(c).cast("double") for c in ("n12", "n1", "n2", "baskets")}
    conviction = F.when(
        F.col("n12") < F.col("n1"),
        (1 - real["n2"] / real["baskets"]) / (1 - real["n12"] / real["n1"]),
    )
    return joined.select(
        "item_1",
        "item_2",
        "n1",
        "n2",
        "n12",
        "baskets",
        (real["n12"] * real["baskets"] / (real["n1"] * real["n2"])).alias("lift"),
        conviction.alias("conviction"),
    )
