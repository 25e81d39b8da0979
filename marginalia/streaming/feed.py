
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marginalia.operators.relational import first_seen


def replay(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 1) -> DataFrame:
    """Captured pages of a feed, as they arrive in a folder (S8, T1). The checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def upsert_into(stream: DataFrame, store: str, key: str, order: list[str], checkpoint: str, check: Callable[[DataFrame], None] | None = None, buckets: int = 64) -> StreamingQuery:
    """The first row of each key in an order, of all rows that ever arrive and whatever the order of arrival, in a folder of Parquet.

    New keys are appended. A key that comes again with a row that is earlier in the order replaces the old one: the buckets of keys where that
    happens are written anew. A batch that fails its check is not written, and its offset not committed (T4); a batch that runs again changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if check:
            check(batch)
        batch = batch.persist()
        try:
            rows = first_seen(batch, [key], [F.col(c) for c in order]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            try:
                have = spark.read.schema(rows.schema).parquet(store)
            except Exception as e:  # the first batch
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                have = spark.createDataFrame([], rows.schema)
            place = lambda d: F.struct(*[F.col(f"{d}.{c}") for c in order])
            earlier = rows.alias("n").join(have.alias("o"), key).filter(place("n") < place("o")).select("n.*")
            touched = [r["bucket"] for r in earlier.select("bucket").distinct().collect()]  # at most `buckets`
            rows.join(have.select(key), key, "left_anti").write.mode("append").partitionBy("bucket").parquet(store)
            if touched:
                have = spark.read.schema(rows.schema).parquet(store).filter(F.col("bucket").isin(touched))
                first = first_seen(have.unionByName(rows.filter(F.col("bucket").isin(touched))), [key], [F.col(c) for c in order])
                first.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, at: str, width: str, group: str, lateness: str | None = None) -> DataFrame:
    """Counts by window; the same plan for a table and, with lateness as watermark, for a stream."""
    source = events.withWatermark(at, lateness) if lateness else events
    return source.groupBy(F.window(at, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")


def sessions(events: DataFrame, at: str, gap: str, group: str, lateness: str | None = None) -> DataFrame:
    source = events.withWatermark(at, lateness) if lateness else events
    return source.groupBy(F.session_window(at, gap), group).agg(F.count(F.lit(1)).alias("n")).select(group, F.col("session_window.start").alias("start"), "n")
