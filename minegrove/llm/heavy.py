"""Most frequent values in bounded memory: Space-Saving summaries merged in a tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

SUMMARY = "field string, n bigint, error bigint, items array<string>, lower array<bigint>"


@dataclass
class Summary:
    """At most ``k`` counters over ``n`` values.

    An item's count lies between ``lower`` and ``lower + error`` (its Space-Saving
    counter); an item without counter occurs at most ``error`` times. Subtracting the
    least counter from all, as is done here, is the form of Space-Saving that merges
    without loosening the bound: error <= n / (k + 1), however summaries are merged.
    """

    k: int
    n: int = 0
    error: int = 0
    items: pa.Array = None
    lower: pa.Array = None

    def __post_init__(self) -> None:
        if self.items is None:
            self.items, self.lower = pa.array([], pa.string()), pa.array([], pa.int64())

    def merge(self, items: pa.Array, lower: pa.Array, n: int, error: int = 0) -> None:
        both = pa.table(
            {
                "item": pa.concat_arrays([self.items, items.cast(pa.string())]),
                "low": pa.concat_arrays([self.lower, lower.cast(pa.int64())]),
            }
        )
        summed = both.group_by("item").aggregate([("low", "sum")])
        low = summed["low_sum"].combine_chunks()
        self.n, self.error = self.n + n, self.error + error
        if len(low) > self.k:
            # the largest count that gets no counter
            cut = pc.sort_indices(low, sort_keys=[("", "descending")])[self.k].as_py()
            least = low[cut].as_py()
            summed = summed.filter(pc.greater(summed["low_sum"], least))
            low = pc.subtract(summed["low_sum"].combine_chunks(), least)
            self.error += least
        self.items, self.lower = summed["item"].combine_chunks(), low

    def add(self, values: pa.Array) -> None:
        """Counts a batch of values exactly and merges it; nulls are no values."""
        values = values.drop_null()
        counted = pc.value_counts(values)
        self.merge(counted.field("values"), counted.field("counts"), len(values))


def _rows(summaries: dict[str, Summary]) -> pa.RecordBatch:
    made = [(f, s.n, s.error, s.items.to_pylist(), s.lower.to_pylist()) for f, s in sorted(summaries.items())]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
    names = ("field", "n", "error", "items", "lower")
    return pa.RecordBatch.from_arrays(
        [pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)], names=list(names)
    )


def summarise(df: DataFrame, fields: Sequence[str], k: int, fan_in: int = 16) -> DataFrame:
    """One summary of each field of the whole table: a row ``(field, n, error, items, lower)``.

    Each partition keeps ``k`` counters a field; the summaries, one row each, are
    merged ``fan_in`` to one until a single task has the last few.
    """
    names = list(fields)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f: Summary(k) for f in names}
        for batch in batches:
            for i, f in enumerate(names):
                own[f].add(batch.column(i))
        yield _rows(own)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Summary] = {}
        for batch in batches:
            for f, n, error, items, lower in zip(*batch.columns, strict=True):
                own.setdefault(f.as_py(), Summary(k)).merge(items.values, lower.values, n.as_py(), error.as_py())
        if own:
            yield _rows(own)

    level = df.select(*[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(names)]).mapInArrow(scan, SUMMARY)
    width = shuffle_width(df.sparkSession)
    while width > 1:
        level = level.repartition(width, F.xxhash64("field", "items", "n", "lower")).mapInArrow(merge, SUMMARY)
        width //= fan_in
    return level.repartition(1).mapInArrow(merge, SUMMARY)


def frequent_values(
    df: DataFrame, fields: Sequence[str], share: tuple[int, int] = (1, 100), k: int = 1000
) -> DataFrame:
    """Values with at least ``share`` (a fraction) of a field's values, with exact counts.

    The first pass summarises with ``k`` counters, which must exceed the fraction's
    inverse: then no such value is missed. Those whose upper bound reaches the share,
    at most ``k`` a field, are broadcast to a second pass that counts them exactly.

    Columns: ``field``, ``key_value``, ``n`` (exact), ``total`` (values of the field),
    ``lower`` and ``upper`` (bounds after the first pass). Nulls are no values. A field
    without values gives no rows.
    """
    part, whole = share
    if k * part <= whole:
        raise ValueError(f"{k} counters cannot find values with {part}/{whole} of all")
    found = (
        summarise(df, fields, k)
        .select("field", F.col("n").alias("total"), "error", F.explode(F.arrays_zip("items", "lower")).alias("_z"))
        .select(
            "field",
            "total",
            F.col("_z.items").alias("key_value"),
            F.col("_z.lower").alias("lower"),
            (F.col("_z.lower") + F.col("error")).alias("upper"),
        )
        .where(F.col("upper") * whole >= F.col("total") * part)
    )
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields]
    )
    rows = df.select(F.explode(pairs).alias("_p")).select("_p.field", "_p.key_value")
    counted = (
        rows.join(F.broadcast(found), ["field", "key_value"])
        .groupBy("field", "key_value", "total", "lower", "upper")
        .agg(F.count("*").alias("n"))
    )
    return counted.where(F.col("n") * whole >= F.col("total") * part).select(
        "field", "key_value", "n", "total", "lower", "upper"
    )
