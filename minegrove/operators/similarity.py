"""MinHash, banding, and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime above all slots of the hash family.
PRIME = 10_000_019


@dataclass(frozen=True)
class HashFamily:
    """h_i(x) = ((a_i x + b_i) mod PRIME) mod m, with fixed coefficients."""

    size: int = 20
    modulus: int = 9_999_991

    @property
    def coefficients(self) -> list[tuple[int, int]]:
        """From a linear congruential rule, so that SQL and every task have the same."""
        out, x = [], 12345
        for _ in range(self.size):
            x = (x * 1_103_515_245 + 12_345) % 2**31
            a = 1 + x % 999_999
            x = (x * 1_103_515_245 + 12_345) % 2**31
            out.append((a, x % 1_000_000))
        return out


def token_number(column: str) -> Column:
    """A number below PRIME for a token, by the digits of its MD5 (the same in other engines)."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(column).cast("binary")), 1, 12), 16, 10).cast("bigint"), F.lit(PRIME))


def minhash_signatures(pairs: DataFrame, family: HashFamily = HashFamily()) -> DataFrame:
    """``(id, signature)`` from distinct ``(id, token)``: the least hash of each function.

    One pass; every function's minimum is combined on the map side, so a huge set is
    one row for each task.
    """
    x = pairs.select("id", token_number("token").alias("_x"))
    least = [
        F.min(F.pmod(F.pmod(F.col("_x") * a + b, F.lit(PRIME)), F.lit(family.modulus))).alias(f"_h{i}")
        for i, (a, b) in enumerate(family.coefficients)
    ]
    signed = x.groupBy("id").agg(*least)
    return signed.select("id", F.array(*[F.col(f"_h{i}") for i in range(family.size)]).alias("signature"))


def lsh_candidates(signatures: DataFrame, bands: int, rows: int) -> DataFrame:
    """Distinct ``(id_1 < id_2)`` that agree on a whole band.

    Sets with equal signatures agree on every band; one of them stands for all in the
    bands, and the group is linked to it and within by its own join.
    """
    alike = signatures.groupBy("signature").agg(F.min("id").alias("rep"))
    band = [
        F.struct(F.lit(b).alias("band"), F.slice("signature", b * rows + 1, rows).alias("key")) for b in range(bands)
    ]
    keyed = alike.select("rep", F.explode(F.array(*band)).alias("_b")).select("rep", "_b.band", "_b.key")
    a, b = keyed.withColumnRenamed("rep", "rep_1"), keyed.withColumnRenamed("rep", "rep_2")
    met = a.join(b, ["band", "key"]).where(F.col("rep_1") < F.col("rep_2")).select("rep_1", "rep_2").distinct()
    both = met.unionByName(alike.select(F.col("rep").alias("rep_1"), F.col("rep").alias("rep_2")))
    members = signatures.join(alike, "signature").select("id", "rep")
    one = members.select(F.col("rep").alias("rep_1"), F.col("id").alias("x"))
    two = members.select(F.col("rep").alias("rep_2"), F.col("id").alias("y"))
    expanded = both.join(one, "rep_1").join(two, "rep_2").where((F.col("rep_1") != F.col("rep_2")) | (F.col("x") < F.col("y")))
    return expanded.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))


def similar_overlaps(overlaps: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """``(id_1, id_2, similarity)`` of pairs of sets with a known ``overlap`` that are similar enough."""
    sizes = pairs.groupBy("id").agg(F.count("*").alias("n"))
    sized = overlaps.join(sizes.select(F.col("id").alias("id_1"), F.col("n").alias("n_1")), "id_1").join(
        sizes.select(F.col("id").alias("id_2"), F.col("n").alias("n_2")), "id_2"
    )
    union = F.col("n_1") + F.col("n_2") - F.col("overlap")
    return sized.where(F.col("overlap") * threshold.denominator >= union * threshold.numerator).select(
        "id_1", "id_2", (F.col("overlap") / union).alias("similarity")
    )


def verify_jaccard(candidates: DataFrame, pairs: DataFrame, threshold: Fraction) -> DataFrame:
    """``(id_1, id_2, similarity)`` of candidates that are similar enough, by exact overlap."""
    one = pairs.select(F.col("id").alias("id_1"), "token")
    two = pairs.select(F.col("id").alias("id_2"), "token")
    overlap = (
        candidates.join(one, "id_1").join(two, ["id_2", "token"]).groupBy("id_1", "id_2").agg(F.count("*").alias("overlap"))
    )
    return similar_overlaps(overlap, pairs, threshold)


def overlap_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """``(id_1 < id_2, overlap)`` of sets that share at least ``least`` tokens.

    ``pairs``: distinct ``(id, token)``. The ``least`` - 1 most frequent tokens of all are
    not joined on: two such sets share another one too. Each set carries which of them
    it has, at most ``least`` - 1, and they are added to the overlap counted on the
    others. So a token that most sets have lists no pairs, and no set stands in one row.
    """
    frequency = pairs.groupBy("token").agg(F.count("*").alias("_f"))
    top = frequency.orderBy(F.desc("_f"), "token").limit(least - 1).select("token")
    common = F.broadcast(top)  # less than ``least`` rows
    carried = pairs.join(common, "token").groupBy("id").agg(F.collect_set("token").alias("_h"))
    none = F.array().cast(f"array<{dict(pairs.dtypes)['token']}>")
    rest = pairs.join(common, "token", "left_anti")
    a = rest.withColumnRenamed("id", "id_1")
    b = rest.withColumnRenamed("id", "id_2")
    met = a.join(b, "token").where(F.col("id_1") < F.col("id_2")).groupBy("id_1", "id_2").agg(F.count("*").alias("_o"))
    one = carried.withColumnsRenamed({"id": "id_1", "_h": "_h1"})
    two = carried.withColumnsRenamed({"id": "id_2", "_h": "_h2"})
    both = met.join(one, "id_1", "left").join(two, "id_2", "left")
    shared = F.size(F.array_intersect(F.coalesce("_h1", none), F.coalesce("_h2", none)))
    return both.select("id_1", "id_2", (F.col("_o") + shared).alias("overlap")).where(F.col("overlap") >= least)


def distinct_pairs(df: DataFrame, id_column: str, token: str) -> DataFrame:
    """Distinct ``(id, token)`` without nulls."""
    named = df.select(F.col(id_column).alias("id"), F.col(token).alias("token"))
    return named.where(F.col("id").isNotNull() & F.col("token").isNotNull()).distinct()


def band_rows(size: int, bands: int) -> int:
    """Rows of a band, so that all ``size`` hashes lie in ``bands`` bands."""
    return -(-size // bands)


def recall(found: DataFrame, wanted: DataFrame, on: Sequence[str]) -> float:
    """The share of wanted pairs that were found; 1 where none are wanted."""
    total = wanted.count()
    return wanted.join(found, list(on), "left_semi").count() / total if total else 1.0
