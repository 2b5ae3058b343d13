"""Queries on streams: Bloom filter, distinct estimates, reservoir. The stream is orders by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import coefficients
from ..operators import sketches as K
from ..sources import table

BLOOM_SLOTS = 4_999


def _stream(spark: SparkSession, d: str, size: int) -> DataFrame:
    return K.batched(table(spark, d, "orders"), "o_custkey", "o_orderkey", size)


def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    """False positives of a Bloom filter over customers, by batches of 100 orders."""
    return K.bloom_rates(_stream(spark, d, 100), slots=BLOOM_SLOTS)


def fm_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customers in batches of 300 orders, and their estimate."""
    return K.distinct_estimates(_stream(spark, d, 300))


def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    """A reservoir of 100 customers after each batch of 100 orders."""
    return K.reservoir(_stream(spark, d, 100), 100)


QUERIES = {f.__name__: f for f in (bloom_fpr, fm_estimate, reservoir_sample)}


def _number(prime: int) -> str:
    """Digits of an order's customer as bytes, folded modulo a prime."""
    return (
        "list_reduce([0::bigint] || list_transform(string_split(v, ''), lambda c: ascii(c)::bigint), "
        f"lambda a, x: (a * 256 + x) % {prime})"
    )


def _hashes(prime: int, slots: int) -> str:
    return ", ".join(f"((x * {a % prime} + {b % prime}) % {prime}) % {slots}" for a, b in coefficients(7))


def _stream_sql(size: int) -> str:
    return f"s as (select o_orderkey // {size} + 1 as batch, o_orderkey + 1 as seq, cast(o_custkey as varchar) as v from orders)"


def _draw(salt: int) -> str:
    once = f"(((seq % 2147483648) * 1103515245 + {12345 + salt}) % 2147483648)"
    return f"((({once} // 65536) * 22695477 + ({once} % 65536) * 69069 + 1) % 2147483648)"


_ZEROS = "case when h = 0 then 3 else bit_count((h & -h) - 1) end"
SQL = {
    "bloom_fpr": f"""with {_stream_sql(100)},
f as (select v, min(batch) as first from s group by v),
b as (select v, first, unnest([{_hashes(114_514, BLOOM_SLOTS)}]) as bit from (select v, first, {_number(114_514)} as x from f)),
t as (select bit, min(first) as since from b group by bit),
r as (select v, max(since) as ready, any_value(first) as first from b join t using (bit) group by v),
c as (select batch, cast(count(*) filter (where ready < batch and first = batch) as bigint) as fp,
  cast(count(*) filter (where ready >= batch) as bigint) as tn from s join r using (v) group by batch)
select batch, fp, tn, cast(fp as double) / nullif(fp + tn, 0) as fpr from c""",
    "fm_estimate": f"""with {_stream_sql(300)},
d as (select batch, v, {_number(69_997)} as x from (select distinct batch, v from s)),
h as (select batch, unnest([{_hashes(69_997, 1_919)}]) as h, unnest(range(7)) as i from d),
r as (select batch, i, max({_ZEROS}) as r from h group by batch, i),
e as (select batch, cast(round_even(sum(2.0 ** r) / 7, 0) as bigint) as estimate from r group by batch)
select batch, truth, estimate from e join (select batch, count(*) as truth from d group by batch) using (batch)""",
    "reservoir_sample": f"""with {_stream_sql(100)},
x as (select batch, seq, v, case when seq <= 100 then seq - 1 else {_draw(2)} % 100 end as slot
  from s where seq <= 100 or {_draw(1)} % seq < 100),
n as (select batch, max(seq) as n from s group by batch)
select n.batch, slot, arg_max(v, seq) as value, n from n join x on x.batch <= n.batch group by n.batch, n, slot""",
}
