"""All pairs of records whose sets of values are similar: a size-aware overlap join."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut_lineage


def needed_overlap(a: int, b: int, threshold: Fraction) -> int:
    """The least overlap with which sets of these sizes are similar enough."""
    return ceil(threshold * (a + b) / (1 + threshold))


def _ceil_of(value: Column, times: int, over: int) -> Column:
    """ceil(value * times / over) in integers."""
    return F.call_function("div", value * F.lit(times) + F.lit(over - 1), F.lit(over))


def _similar(overlap: Column, a: Column, b: Column, threshold: Fraction) -> Column:
    return overlap * threshold.denominator >= (a + b - overlap) * threshold.numerator


def small_limit(min_size: int, threshold: Fraction, max_subsets: int) -> tuple[int, int]:
    """The overlap that any two sets need, and the largest size of small sets.

    Sets up to that size have at most ``max_subsets`` subsets of any overlap that they
    need with each other.
    """
    part = needed_overlap(min_size, min_size, threshold)
    size = min_size
    while all(comb(size + 1, needed_overlap(size + 1, b, threshold)) <= max_subsets for b in range(min_size, size + 2)):
        size += 1
    return part, size


@dataclass(frozen=True)
class Meeting:
    """Sets of ``left`` sizes and of ``right`` sizes that share ``overlap`` tokens are similar, whichever they are."""

    overlap: int
    left: tuple[int, ...]
    right: tuple[int, ...]

    @property
    def alike(self) -> bool:
        return self.left == self.right


def meetings(least: int, limit: int, threshold: Fraction) -> list[Meeting]:
    """How small sets meet, so that each pair of sizes meets on subsets of the overlap it needs, and none on smaller ones.

    For each overlap: the sizes any two of which need no more of it meet each other, and
    each larger size meets the lesser ones with which it needs that much. So whatever
    meets shares enough, and a subset that many sets have lists no pair in vain.
    """
    sizes = range(least, limit + 1)
    pairs = {(a, b): needed_overlap(a, b, threshold) for a in sizes for b in sizes if needed_overlap(a, b, threshold) <= min(a, b)}
    out = []
    for overlap in sorted(set(pairs.values())):
        within = [s for s in sizes if pairs.get((s, s), overlap + 1) <= overlap]
        near = tuple(s for s in within if any(pairs.get((s, p)) == overlap for p in within))
        if near:
            out.append(Meeting(overlap, near, near))
        for large in sizes:
            lesser = tuple(a for a in sizes if a < large and large not in within and pairs.get((a, large)) == overlap)
            if lesser:
                out.append(Meeting(overlap, lesser, (large,)))
    return out


def _subset_keys(places: list[tuple[int, Meeting]], size: int) -> Column:
    """For a set of ``size`` tokens, of each meeting it goes to: hashes of its subsets, and whether only unlike sizes meet there."""

    def keys(number: int, meeting: Meeting) -> Column:
        chosen = F.lit([list(c) for c in combinations(range(size), meeting.overlap)])
        key = lambda c: F.xxhash64(F.lit(number), F.transform(c, lambda i: F.get("tokens", i)))
        return F.transform(chosen, lambda c: F.struct(key(c).alias("key"), F.lit(not meeting.alike).alias("unlike")))

    return F.concat(*[keys(number, meeting) for number, meeting in places])


def _renamed(df: DataFrame, end: int, *columns: str) -> DataFrame:
    """``side``, ``id``, ``no`` and ``columns`` of one end of a pair; others as they are."""
    return df.withColumnsRenamed({c: f"{c}_{end}" for c in ("side", "id", "no", *columns)})


def _ordered(pairs: DataFrame, cross: bool, *columns: str) -> DataFrame:
    """Pairs with the lesser id, or the left table's, first."""
    swap = F.col("side_1") > F.col("side_2") if cross else F.col("id_1") > F.col("id_2")
    names = ("side", "id", *columns)
    first = [F.when(swap, F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(f"{c}_1") for c in names]
    second = [F.when(swap, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(f"{c}_2") for c in names]
    rest = [c for c in pairs.columns if c not in {f"{n}_{e}" for n in names for e in (1, 2)}]
    return pairs.select(*first, *second, *rest)


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n"))


def numbered(rows: DataFrame, column: str, tries: int = 3) -> Column:
    """A 64-bit number for each value, no two alike: short to shuffle, and as good as the value.

    A hash serves if it is shown to tell all values apart; if none of a few does
    (to be expected only beyond a billion values), the value itself is used.
    """
    values = rows.groupBy(column).agg(F.count("*").alias("_n"))
    for seed in range(tries):
        number = F.xxhash64(F.lit(seed), F.col(column))
        repeated = values.groupBy(number.alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        if not repeated.take(1):
            return number
    return F.col(column)


def named_numbers(rows: DataFrame, column: str, tries: int = 3) -> tuple[Column, DataFrame]:
    """The same, and the values' table ``(id, name)`` by their numbers, materialised."""
    for seed in range(tries):
        number = F.xxhash64(F.lit(seed), F.col(column))
        names = cut_lineage(rows.select(number.alias("id"), F.col(column).alias("name")).distinct())
        if not names.groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).take(1):
            return number, names
    return F.col(column), rows.select(F.col(column).alias("id"), F.col(column).alias("name")).distinct()


class SimilarSets:
    """Pairs of sets with ``|A ∩ B| / |A ∪ B| >= threshold``, both of ``min_size`` or more.

    ``df`` has a row for each value of each set, in ``id_column`` and ``token``;
    repeated rows and nulls don't count, other columns are ignored. With ``right`` (same
    columns) pairs are sought between the tables, else within one. An empty table, or
    none with sets of ``min_size``, gives no pairs.

    Sets that are equal form a class, of which the least id stands for all. A set is
    *small* if it has few enough (``max_subsets``) subsets of each overlap that it needs
    with other small sets. Small sets meet on the subsets of just the overlap that their
    two sizes need (``meetings``), so all that meet are similar. A larger set scans the inverted lists of its rarest tokens, as many as any partner must hit, for partners
    of fitting size. Candidates are then compared whole, so neither hashes nor
    the order of tokens decide a pair.

    Sets of more than ``array_limit`` values never stand in one row: their inverted lists
    are scanned in full and overlaps counted. ``classes``, ``links`` and ``pairs`` have them too.

    The sets are materialised once, in the shared checkpoint folder, with values as numbers.
    """

    def __init__(
        self,
        df: DataFrame,
        id_column: str,
        token: str,
        right: DataFrame | None = None,
        *,
        threshold: Fraction = Fraction(1, 2),
        min_size: int = 1,
        max_subsets: int = 70,
        array_limit: int = 100_000,
    ) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must lie in (0, 1]")
        self.cross, self.threshold, self.min_size = right is not None, threshold, max(1, min_size)
        self.array_limit = array_limit
        self.part, self.limit = small_limit(self.min_size, threshold, max_subsets)
        named = [F.col(id_column).alias("id"), F.col(token).alias("token")]
        rows = df.select(F.lit(0).alias("side"), *named)
        if right is not None:
            rows = rows.unionByName(right.select(F.lit(1).alias("side"), *named))
        rows = rows.where(F.col("id").isNotNull() & F.col("token").isNotNull())
        # distinct values only: other stages read them again and again; ids get their names back set by set
        number, self._names = named_numbers(rows, "id")
        self._rows = cut_lineage(rows.select("side", number.alias("id"), numbered(rows, "token").alias("token")).distinct())
        self._sizes = self._rows.groupBy("side", "id").agg(F.count("*").alias("size"))
        self._giants = self._sizes.where(F.col("size") > array_limit)
        self.has_giants = bool(self._giants.take(1))
        self.sets = cut_lineage(self._gather())
        alike = self.sets.groupBy("side", "tokens", "size").agg(F.min("id").alias("id"), F.count("*").alias("members"))
        # numbered, to be short in the joins; the numbers stay, as they are materialised
        self.reps = cut_lineage(alike.withColumn("no", F.monotonically_increasing_id()))

    def _gather(self) -> DataFrame:
        """``(side, id, tokens, size)``, tokens rarest first; as often, any fixed order will do."""
        rows = self._rows
        if self.has_giants:
            rows = rows.join(self._giants.select("side", "id"), ["side", "id"], "left_anti")
        frequency = _counts(self._rows, "token")
        ranked = salted_join(
            rows, frequency.withColumnRenamed("_n", "_f"), "token", how="inner", spread=F.col("id"), counts=frequency
        )
        return (
            ranked.groupBy("side", "id")
            .agg(F.array_sort(F.collect_list(F.struct("_f", "token"))).alias("_t"))
            .where(F.size("_t") >= self.min_size)
            .join(self._names, "id")
            .select("side", F.col("name").alias("id"), F.col("_t.token").alias("tokens"), F.size("_t").cast("bigint").alias("size"))
        )

    def _listed(self, end: int, places: list[tuple[int, Meeting]]) -> DataFrame:
        """``(key, no, side, unlike)`` of the small sets at one end of the meetings."""
        keys = None
        for size in range(self.min_size, self.limit + 1):
            own = [(n, m) for n, m in places if size in (m.left if end == 1 else m.right)]
            if own:
                made = _subset_keys(own, size)
                keys = F.when(F.col("size") == size, made) if keys is None else keys.when(F.col("size") == size, made)
        if keys is None:
            keys = F.array().cast("array<struct<key: bigint, unlike: boolean>>")
        listed = self.reps.where(F.col("size") <= self.limit).select("side", "no", F.explode(keys).alias("_k"))
        side = [F.col("side").alias(f"side_{end}")] if self.cross else []
        unlike = [F.col("_k.unlike").alias("unlike")] if end == 1 else []
        return listed.select(F.col("_k.key").alias("key"), F.col("no").alias(f"no_{end}"), *side, *unlike)

    def _by_subset(self) -> DataFrame:
        """Pairs of small sets that share a subset of the overlap that their sizes need."""
        places = list(enumerate(meetings(self.min_size, self.limit, self.threshold)))
        one, two = self._listed(1, places), self._listed(2, places)
        # of one size group each pair meets from one end; between unlike sizes the ends are given
        order = (
            (F.col("side_1") < F.col("side_2")) | (F.col("unlike") & (F.col("side_1") > F.col("side_2")))
            if self.cross
            else F.col("unlike") | (F.col("no_1") < F.col("no_2"))
        )
        met = salted_join(
            one,
            two,
            "key",
            how="inner",
            spread=F.col("no_1"),
            condition=order,
            counts=_counts(one, "key"),
            right_spread=F.col("no_2"),
            right_counts=_counts(one, "key"),
        )
        # a pair may meet more than once, and from either end
        swap = F.col("side_1") > F.col("side_2") if self.cross else F.col("no_1") > F.col("no_2")
        ends = [F.when(swap, F.col(f"no_{b}")).otherwise(F.col(f"no_{a}")).alias(f"no_{a}") for a, b in ((1, 2), (2, 1))]
        return met.select(*ends)

    def _by_list(self) -> DataFrame:
        """Pairs with a larger set, met in the inverted list of one of its rarest tokens."""
        t = self.threshold
        size = F.col("size")
        reach = size - _ceil_of(size, t.numerator, t.denominator) + 1
        least_partner = ceil(t * (self.limit + 1))
        listed = self.reps.where(size >= least_partner).select(
            "side", "no", "size", F.posexplode(F.slice("tokens", F.lit(1), reach.cast("int"))).alias("pos", "token")
        )
        scanning = listed.where(size > self.limit)
        a, b = F.col("size_1"), F.col("size_2")
        # what is left of both sets from the shared token on must still suffice
        overlap = _ceil_of(a + b, t.numerator, t.numerator + t.denominator)
        condition = self._scans("no") & (F.least(a - F.col("pos_1"), b - F.col("pos_2")) >= overlap)
        met = salted_join(
            _renamed(scanning, 1, "size", "pos"),
            _renamed(listed, 2, "size", "pos"),
            "token",
            how="inner",
            spread=F.col("no_1"),
            condition=condition,
            counts=_counts(listed, "token"),
            right_spread=F.col("no_2"),
            right_counts=_counts(listed, "token"),
        )
        return met.select("no_1", "no_2")

    def _scans(self, name: str = "id") -> Column:
        """The larger set scans, of equals the one with the lesser name, so that each pair is met from one end; sizes must fit."""
        a, b = F.col("size_1"), F.col("size_2")
        ends = (a > b) | ((a == b) & (F.struct("side_1", f"{name}_1") < F.struct("side_2", f"{name}_2")))
        fits = b * self.threshold.denominator >= a * self.threshold.numerator
        return ends & fits & (F.col("side_1") != F.col("side_2")) if self.cross else ends & fits

    def _row_links(self) -> DataFrame:
        """``links`` of the classes of sets that stand in a row."""
        # materialised, so that the comparison is planned by the number of candidates there really are
        candidates = cut_lineage(self._by_subset().unionByName(self._by_list()).distinct())
        one = _renamed(self.reps.select("side", "id", "no", "tokens", "size"), 1, "tokens", "size")
        two = _renamed(self.reps.select("side", "id", "no", "tokens", "size"), 2, "tokens", "size")
        similar = (
            candidates.join(one, "no_1")
            .join(two, "no_2")
            .withColumn("overlap", F.size(F.array_intersect("tokens_1", "tokens_2")).cast("bigint"))
            .where(_similar(F.col("overlap"), F.col("size_1"), F.col("size_2"), self.threshold))
        )
        return _ordered(
            similar.select("side_1", "id_1", "size_1", "side_2", "id_2", "size_2", "overlap"), self.cross, "size"
        )

    def _row_classes(self) -> DataFrame:
        """``classes`` of the sets that stand in a row."""
        several = self.reps.where(F.col("members") > 1).select("side", "tokens", F.col("id").alias("class_id"))
        return self.sets.join(several, ["side", "tokens"], "left").select(
            "side", "id", "size", F.coalesce("class_id", "id").alias("class_id")
        )

    def _named(self, df: DataFrame, column: str) -> DataFrame:
        """The names of ids that are numbers."""
        names = self._names.withColumnsRenamed({"id": column, "name": "_name"})
        return df.join(names, column).withColumn(column, F.col("_name")).drop("_name")

    def _giant_classes(self) -> DataFrame:
        """The same of the giants: of those of one size, equal are the ones that share as many values."""
        keyed = self._rows.withColumn("_set", F.struct("side", "id"))
        giants = self._giants.select(F.struct("side", "id").alias("_set"), "size")
        rows = salted_join(keyed, giants, "_set", how="inner", spread=F.col("token")).drop("_set")
        one, two = rows.withColumnRenamed("id", "id_1"), rows.withColumnRenamed("id", "id_2")
        met = one.join(two, ["side", "size", "token"]).where(F.col("id_1") != F.col("id_2"))
        shared = met.groupBy("side", "size", "id_1", "id_2").agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("size"))
        least = self._named(shared, "id_1").groupBy("side", F.col("id_2").alias("id")).agg(F.min("id_1").alias("class_id"))
        each = self._named(self._giants.withColumn("_no", F.col("id")), "id")
        told = each.join(least.withColumnRenamed("id", "_no"), ["side", "_no"], "left")
        return told.select("side", "id", "size", F.least("id", F.coalesce("class_id", "id")).alias("class_id"))

    def classes(self) -> DataFrame:
        """``(side, id, size, class_id)`` of every set, however large."""
        return self._row_classes().unionByName(self._giant_classes()) if self.has_giants else self._row_classes()

    def links(self) -> DataFrame:
        """Similar pairs of class representatives: ``side``, ``id``, ``size`` of both, and ``overlap``."""
        if not self.has_giants:
            return self._row_links()
        least = cut_lineage(self.classes().where(F.col("id") == F.col("class_id")).select("side", "id"))
        far = self.giant_pairs()
        for end in (1, 2):
            far = far.join(_renamed(least, end), [f"side_{end}", f"id_{end}"], "left_semi")
        return self._row_links().unionByName(far)

    def giant_pairs(self) -> DataFrame:
        """Pairs with a set too large for a row: inverted lists in full, overlaps counted."""
        keyed = self._rows.withColumn("_set", F.struct("side", "id"))
        least = ceil(self.threshold * self.array_limit)
        fitting = self._sizes.where(F.col("size") >= least).select(F.struct("side", "id").alias("_set"), "size")
        sized = salted_join(keyed, fitting, "_set", how="inner", spread=F.col("token")).drop("_set")
        met = salted_join(
            _renamed(sized.where(F.col("size") > self.array_limit), 1, "size"),
            _renamed(sized, 2, "size"),
            "token",
            how="inner",
            spread=F.col("id_1"),
            condition=self._scans(),
        )
        counted = met.groupBy("side_1", "id_1", "size_1", "side_2", "id_2", "size_2").agg(F.count("*").alias("overlap"))
        similar = counted.where(_similar(F.col("overlap"), F.col("size_1"), F.col("size_2"), self.threshold))
        return _ordered(self._named(self._named(similar, "id_1"), "id_2"), self.cross, "size")

    def pairs(self) -> DataFrame:
        """``(id_1, id_2, overlap, size_1, size_2)`` of all similar pairs; the lesser id, or the left table's, first."""
        names = ["id_1", "id_2", "overlap", "size_1", "size_2"]
        several = self.reps.where(F.col("members") > 1)
        members = self._row_classes().select("side", "id", F.col("class_id"))
        one = members.select(F.col("side").alias("side_1"), F.col("class_id").alias("id_1"), F.col("id").alias("_id_1"))
        two = members.select(F.col("side").alias("side_2"), F.col("class_id").alias("id_2"), F.col("id").alias("_id_2"))
        between = (
            self._row_links()
            .join(one, ["side_1", "id_1"])
            .join(two, ["side_2", "id_2"])
            .select(
                "side_1", F.col("_id_1").alias("id_1"), "size_1", "side_2", F.col("_id_2").alias("id_2"), "size_2", "overlap"
            )
        )
        out = _ordered(between, self.cross, "size").select(*names)
        if not self.cross:
            # equal sets are pairs among themselves
            copies = self.sets.join(
                several.select("side", "tokens", F.col("id").alias("class_id")), ["side", "tokens"]
            ).select("class_id", "id", "size")
            within = salted_join(
                copies.withColumnsRenamed({"id": "id_1", "size": "size_1"}),
                copies.select("class_id", F.col("id").alias("id_2")),
                "class_id",
                how="inner",
                spread=F.col("id_1"),
                condition=F.col("id_1") < F.col("id_2"),
                counts=several.select(F.col("id").alias("class_id"), F.col("members").alias("_n")),
                right_spread=F.col("id_2"),
                right_counts=several.select(F.col("id").alias("class_id"), F.col("members").alias("_n")),
            )
            out = out.unionByName(
                within.select("id_1", "id_2", F.col("size_1").alias("overlap"), "size_1", F.col("size_1").alias("size_2"))
            )
        if self.has_giants:
            out = out.unionByName(self.giant_pairs().select(*names))
        return out
