"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join


@dataclass(frozen=True)
class Reference:
    """A foreign key, perhaps composite, perhaps valid only for a time.

    ``keys`` maps columns of the referring table to columns of ``target``.
    ``match`` says what a null in some, but not all, of the key columns means:

    * ``simple``: nothing is referred to, so nothing can be missing;
    * ``partial``: some target row must agree on the columns that are not null;
    * ``full``: a key must be null throughout or not at all, else it is an orphan.

    A key that is null throughout refers to nothing. With ``valid_from`` and
    ``valid_to`` a target row counts only at times in [from, to); a null bound is
    open. The time is then the last component of the key: it may be null by itself,
    and is always matched partially, so a reference without a time asks only that
    the target has the key.
    """

    name: str
    target: DataFrame
    keys: dict[str, str] = field(default_factory=dict)
    match: str = "simple"
    valid_from: str | None = None
    valid_to: str | None = None


def _versions(ref: Reference, columns: list[str]) -> DataFrame:
    """Target keys with their times of validity, one row for each key and start."""
    start = F.col(ref.valid_from) if ref.valid_from else F.lit(None).cast("timestamp_ntz")
    end = F.col(ref.valid_to) if ref.valid_to else F.lit(None).cast("timestamp_ntz")
    named = [F.col(ref.keys[c]).alias(f"_t{i}") for i, c in enumerate(columns)]
    rows = ref.target.select(*named, start.alias("_from"), end.alias("_to"))
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(f"_t{i}").isNotNull() for i in range(len(columns)))))
    groups = [f"_t{i}" for i in range(len(columns))]
    # of rows with the same start, the one that ends last covers the others
    return rows.groupBy(*groups, "_from").agg(
        F.when(F.max(F.col("_to").isNull()), F.lit(None)).otherwise(F.max("_to")).alias("_to")
    )


def _target_keys(ref: Reference, columns: list[str]) -> DataFrame:
    """The distinct keys of the target, ``_key``, that are not null in these columns."""
    rows = ref.target.select(*[F.col(ref.keys[c]).alias(f"_t{i}") for i, c in enumerate(columns)]).dropna()
    return _one_key(rows, rows.columns).select("_key").distinct()


def _masks(columns: list[str], timed: bool) -> Iterator[tuple[list[str], bool]]:
    """The ways in which a key may be null that refer to something: columns that are not null, and whether the time is."""
    for there in product((True, False), repeat=len(columns)):
        if any(there):
            present = [c for c, one in zip(columns, there, strict=True) if one]
            yield from ((present, with_time) for with_time in ((True, False) if timed else (False,)))


def _of_mask(refs: DataFrame, columns: list[str], present: list[str], at: str | None, with_time: bool) -> DataFrame:
    """The references of one null mask."""
    wanted = [F.col(c).isNotNull() if c in present else F.col(c).isNull() for c in columns]
    if at is not None:
        wanted.append(F.col(at).isNotNull() if with_time else F.col(at).isNull())
    return refs.where(reduce(lambda a, b: a & b, wanted))


def _one_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """``_key``: a single column as it is, several as a struct."""
    parts = [F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]
    return df.withColumn("_key", F.struct(*parts) if len(parts) > 1 else F.col(columns[0]))


def orphan_references(
    refs: DataFrame, ref: Reference, *, row_id: str, at: str | None = None, hot_share: float | None = None
) -> DataFrame:
    """Rows of ``refs`` whose reference finds no target row, whole, with ``ref_table``.

    References are grouped by null mask, that is by which components of their key are
    null, the time ``at`` among them; each group is anti-joined on the components it
    has, under the declared match. A group without times needs the target's keys only,
    one with times their spans of validity. The rows of keys that hold more than
    ``hot_share`` of the references with these columns are spread over several tasks by
    ``row_id``.

    Repeated rows of ``refs`` stay repeated; repeated target rows change nothing.
    An empty target makes every reference an orphan, empty ``refs`` give no rows.
    ``refs`` may have any further columns but those starting with an underscore.
    """
    if ref.match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match: {ref.match}")
    columns = list(ref.keys)
    timed = at is not None and bool(ref.valid_from or ref.valid_to)
    found: list[DataFrame] = []
    for present, with_time in _masks(columns, timed):
        partly = len(present) < len(columns)
        if partly and ref.match == "simple":
            continue
        group = _of_mask(refs, columns, present, at if timed else None, with_time)
        if partly and ref.match == "full":
            found.append(group)
            continue
        group = _one_key(group, present)
        # with and without times alike, so that the keys are counted once
        counts = _one_key(_of_mask(refs, columns, present, None, False), present).groupBy("_key").agg(F.count("*").alias("_n"))
        how = {"spread": F.col(row_id), "share": hot_share, "counts": counts}
        if with_time:
            targets = [f"_t{i}" for i in range(len(present))]
            versions = _one_key(_versions(ref, present), targets).drop(*targets)
            spans = (F.col("_from").isNull() | (F.col("_from") <= F.col(at))) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
            kept = salted_join(group, versions, "_key", how="left_anti", condition=spans, **how)
        else:
            # keys are joined before rows: both sides distinct, neither has a hot one
            missing = group.select("_key").distinct().join(_target_keys(ref, present), "_key", "left_anti")
            kept = salted_join(group, missing, "_key", how="left_semi", **how)
        found.append(kept.drop("_key"))
    if not found:
        return refs.limit(0).withColumn("ref_table", F.lit(ref.name))
    return reduce(lambda a, b: a.unionByName(b), found).withColumn("ref_table", F.lit(ref.name))


def why_orphaned(orphans: DataFrame, ref: Reference, *, at: str) -> DataFrame:
    """Adds ``kind`` to orphans of a single-column reference.

    ``missing``: the target never has the key; ``later``: it has it, but only from a
    time after the reference; ``deleted``: it had it before.
    """
    (column,) = ref.keys
    spans = (
        _versions(ref, [column])
        .groupBy("_t0")
        .agg(F.when(F.max(F.col("_from").isNull()), F.lit(None)).otherwise(F.min("_from")).alias("_first"))
        .withColumn("_known", F.lit(True))
    )
    joined = orphans.join(spans, F.col(column) == F.col("_t0"), "left")
    kind = (
        F.when(F.col("_known").isNull(), "missing")
        .when(F.col("_first") > F.col(at), "later")
        .otherwise("deleted")
    )
    return joined.withColumn("kind", kind).drop("_t0", "_first", "_known")
