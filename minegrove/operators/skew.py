"""Aggregates over joins in which a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts of pairs are products of counts, which may not fit a bigint.
WIDE = "decimal(38,0)"


def _states(df: DataFrame, on: Sequence[str], groups: Sequence[str], measures: Sequence[str], side: str) -> DataFrame:
    """One compact state for each join key and group: rows, and count and sum of each measure."""
    states: list[Column] = [F.count("*").alias(f"_n_{side}")]
    for m in measures:
        states += [F.count(m).alias(f"_c_{side}_{m}"), F.sum(m).alias(f"_s_{side}_{m}")]
    keyed = df.where(" and ".join(f"`{k}` is not null" for k in on))
    return keyed.groupBy(*on, *groups).agg(*states)


def eager_join_states(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_measures: Sequence[str] = (),
    right_measures: Sequence[str] = (),
    right_rows_bound: int | None = None,
) -> DataFrame:
    """Both inputs aggregated by join key, then joined: the states before the roll-up.

    A key that holds a third of all rows is, after the map side of the aggregation,
    one row for each map task and group, so no task gets it whole. Columns: ``on``,
    groups, ``n_left`` and ``n_right`` (rows of either side in the state), and for each
    measure ``sum_<m>`` and ``count_<m>`` of its own side. Rows with a null join key
    join nothing and are left out.

    ``right_rows_bound``: a proven bound on the right states; up to 100,000 rows they
    are broadcast, so that a join key with few values isn't a bottleneck either.
    Else the join is left to AQE, which splits skewed partitions.
    """
    a = _states(left, on, left_groups, left_measures, "l")
    b = _states(right, on, right_groups, right_measures, "r")
    if right_rows_bound is not None and right_rows_bound <= 100_000:
        b = F.broadcast(b)
    out = [F.col(c) for c in (*on, *left_groups, *right_groups)]
    out += [F.col("_n_l").alias("n_left"), F.col("_n_r").alias("n_right")]
    for side, measures in (("l", left_measures), ("r", right_measures)):
        for m in measures:
            out += [F.col(f"_s_{side}_{m}").alias(f"sum_{m}"), F.col(f"_c_{side}_{m}").alias(f"count_{m}")]
    return a.join(b, list(on)).select(*out)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_measures: Sequence[str] = (),
    right_measures: Sequence[str] = (),
    right_rows_bound: int | None = None,
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY groups`` without building the join's rows.

    Returns the groups, ``n_rows`` (rows the plain join would have), and for each
    measure ``sum_<m>`` and ``count_<m>`` over those rows: a measure of one side counts
    once for each partner of its row, so its state is multiplied by the partner's count.
    Counts, and sums of whole numbers, are decimals: products of counts outgrow a bigint.
    Groups may be null; a measure that is always null has a null sum and count 0.
    """
    states = eager_join_states(
        left,
        right,
        on,
        left_groups=left_groups,
        right_groups=right_groups,
        left_measures=left_measures,
        right_measures=right_measures,
        right_rows_bound=right_rows_bound,
    )
    sums = [F.sum(F.col("n_left").cast(WIDE) * F.col("n_right")).cast(WIDE).alias("n_rows")]
    whole = {f.name for f in states.schema if f.dataType.simpleString() == "bigint"}
    for measures, other in ((left_measures, "n_right"), (right_measures, "n_left")):
        for m in measures:
            own = F.col(f"sum_{m}").cast(WIDE) if f"sum_{m}" in whole else F.col(f"sum_{m}")
            times = F.sum(own * F.col(other))
            sums += [
                (times.cast(WIDE) if f"sum_{m}" in whole else times).alias(f"sum_{m}"),
                F.sum(F.col(f"count_{m}").cast(WIDE) * F.col(other)).cast(WIDE).alias(f"count_{m}"),
            ]
    return states.groupBy(*left_groups, *right_groups).agg(*sums)


def shares_of_groups(
    df: DataFrame, on: Sequence[str], groups: Sequence[str], *, measures: Sequence[str] = (), on_bound: int | None = None
) -> DataFrame:
    """``df JOIN df USING (on) GROUP BY on, groups`` without the join's rows, to tell each group's share.

    Both inputs of the join are the same, so they are aggregated once, by ``on`` and
    groups, and the other side's states, the rows of each ``on``, are rolled up from these.
    The compact states are joined and their counts multiplied. Columns: ``on``, groups,
    ``n_rows`` (rows of the group), ``n_pairs`` (rows the join would have for it),
    ``n_all_pairs`` (for all groups of the ``on``: its rows squared; a group's share is the
    quotient), and ``sum_<m>`` and ``count_<m>`` of each measure over the group's rows.

    ``on_bound``: a proven bound on the values of ``on``, as ``right_rows_bound`` above. Rows
    with a null in ``on`` are left out, null groups are groups, an empty table has none.
    """
    a = _states(df, on, groups, measures, "l")
    b = a.groupBy(*on).agg(F.sum("_n_l").alias("_n_r"))
    if on_bound is not None and on_bound <= 100_000:
        b = F.broadcast(b)
    n, total = F.col("_n_l").cast(WIDE), F.col("_n_r")
    out = [F.col("_n_l").alias("n_rows"), (n * total).cast(WIDE).alias("n_pairs"), (total.cast(WIDE) * total).cast(WIDE).alias("n_all_pairs")]
    for m in measures:
        out += [F.col(f"_s_l_{m}").alias(f"sum_{m}"), F.col(f"_c_l_{m}").alias(f"count_{m}")]
    return a.join(b, list(on)).select(*on, *groups, *out)


def once_per_id(df: DataFrame, row_id: str) -> DataFrame:
    """One row for each ``row_id``, the least by its other columns; rows without id all stay.

    Rows are combined before the shuffle, so an id that is delivered a million times is
    one row for each map task.
    """
    rest = [c for c in df.columns if c != row_id]
    least = (
        df.where(F.col(row_id).isNotNull())
        .groupBy(row_id)
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(row_id, *[F.col("_row")[c].alias(c) for c in rest])
    )
    return least.unionByName(df.where(F.col(row_id).isNull()))


def unpivot_keys(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row ``(field, key_value, *keep)`` for each field that is not null."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key_value")) for f in fields])
    return (
        df.select(*keep, F.explode(pairs).alias("_p"))
        .select(F.col("_p.field"), F.col("_p.key_value"), *keep)
        .where(F.col("key_value").isNotNull())
    )
