"""The sketches over a live stream, in Structured Streaming.

Each micro-batch is one batch of the sketch: a query's trigger decides how many
elements it has. State lives in tables of the shared folder between micro-batches,
under the number of the batch that wrote it, so that a batch run again after a failure
starts from the same state and writes the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketches import BLOOM, DISTINCT, distinct_estimates, draw, with_bits
from ..session import shuffle_width

Sink = Callable[[DataFrame, int], None]


class _Grown:
    """A set that batches add to, in files below ``folder``, to be read as it was before any recent batch.

    Each batch writes what it adds; every ``every`` batches the whole is written as one
    snapshot, so a batch reads one snapshot and at most ``every`` small folders, however
    old the stream is. What the last two snapshots make superfluous is deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, every: int) -> None:
        self.spark, self.folder, self.schema, self.every = spark, folder, schema, every

    def before(self, batch: int) -> DataFrame:
        """What all batches before this one added."""
        start = batch // self.every * self.every
        paths = [f"{self.folder}/upto={start}"] if start else []
        paths += [f"{self.folder}/batch={b}" for b in range(start, batch)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def add(self, new: DataFrame, batch: int) -> None:
        """What this batch adds; written again, it is the same."""
        new.write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        now = batch + 1
        if now % self.every:
            return
        whole = self.before(batch).unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={batch}"))
        whole.coalesce(max(1, shuffle_width(self.spark))).write.mode("overwrite").parquet(f"{self.folder}/upto={now}")
        # the batch that wrote this snapshot may be run again, from the one before it
        self._delete(f"upto={now - 2 * self.every}")
        for b in range(now - 2 * self.every, now - self.every):
            self._delete(f"batch={b}")

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bloom_batch(folder: str, sink: Sink, *, value: str = "value", every: int = 16) -> Sink:
    """For ``foreachBatch``: false-positive counts of each batch against a Bloom filter of all earlier ones.

    State: the bits set, of which there are as many as the filter has at most, and the
    values seen so far, which tell false positives. A batch reads both by join, and writes
    only the bits and values that it adds; every ``every`` batches they are compacted.
    """

    def run(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        values = batch_df.select(F.col(value).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
        values = values.persist()
        all_bits = _Grown(spark, f"{folder}/bits", "bit bigint", every)
        all_values = _Grown(spark, f"{folder}/values", "value string", every)
        set_bits, seen = all_bits.before(batch), all_values.before(batch)
        missing_bits = with_bits(values.select("value"), **BLOOM).join(set_bits, "bit", "left_anti")
        negative = missing_bits.select("value").distinct().withColumn("negative", F.lit(True))
        fresh = values.select("value").join(seen, "value", "left_anti").withColumn("fresh", F.lit(True))
        tested = values.join(negative, "value", "left").join(fresh, "value", "left")
        counted = tested.agg(
            F.coalesce(F.sum(F.when(F.col("negative").isNull() & F.col("fresh"), F.col("n"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(F.col("negative"), F.col("n"))), F.lit(0)).alias("tn"),
        )
        rate = F.try_divide(F.col("fp").cast("double"), (F.col("fp") + F.col("tn")).cast("double"))
        sink(counted.select(F.lit(batch + 1).cast("bigint").alias("batch"), "fp", "tn", rate.alias("fpr")), batch)
        all_bits.add(missing_bits.select("bit").distinct(), batch)
        all_values.add(fresh.select("value"), batch)
        values.unpersist()

    return run


def distinct_batch(sink: Sink, *, value: str = "value") -> Sink:
    """For ``foreachBatch``: distinct values of each batch and their Flajolet-Martin estimate; no state."""

    def run(batch_df: DataFrame, batch: int) -> None:
        stream = batch_df.select(F.lit(batch + 1).cast("bigint").alias("batch"), F.col(value).alias("value"))
        sink(distinct_estimates(stream, **DISTINCT), batch)

    return run


def reservoir_batch(folder: str, sink: Sink, *, value: str = "value", order: str = "seq", size: int = 100) -> Sink:
    """For ``foreachBatch``: the reservoir after each batch; ``order`` numbers all elements from 1.

    State: the slots and the count so far, a few rows written anew by each batch.
    """
    schema = "slot bigint, value string, seq bigint, n bigint"

    def run(batch_df: DataFrame, batch: int) -> None:
        spark = batch_df.sparkSession
        held = spark.read.schema(schema).parquet(f"{folder}/slots/{batch - 1}") if batch else spark.createDataFrame([], schema)
        n = F.col("seq")
        rows = batch_df.select(F.col(order).cast("bigint").alias("seq"), F.col(value).alias("value"))
        enters = (n <= size) | (F.pmod(draw(n, 1), n) < size)
        slot = F.when(n <= size, n - 1).otherwise(F.pmod(draw(n, 2), F.lit(size)))
        entered = rows.where(enters).select(slot.alias("slot"), "value", "seq")
        total = rows.agg(F.max("seq").alias("n"))
        both = held.select("slot", "value", "seq").unionByName(entered)
        latest = both.groupBy("slot").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        now = latest.crossJoin(F.broadcast(total)).select("slot", "value", "seq", "n")  # one row
        now.write.mode("overwrite").parquet(f"{folder}/slots/{batch}")
        done = spark.read.schema(schema).parquet(f"{folder}/slots/{batch}")
        sink(done.select(F.lit(batch + 1).cast("bigint").alias("batch"), "slot", "value", "n"), batch)

    return run
