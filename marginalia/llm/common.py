"""Small helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these (Java and Python regular expressions).
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch where rows carry whole texts.
TEXT_BATCH = 256


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir; where none is set, one of our own in local mode and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marginalia-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again; columnar, so fit for wider rows than settle()."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, whatever their length. Batches are sized when a job runs, so the setting of the session stays as it is set here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def broadcast_if_small(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most `most` rows; df is counted, so it should be stored."""
    return F.broadcast(df) if df.count() <= most else df


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; inside higher-order functions a plain column would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def remainder_of(doc_id: Column, divisor: int = 5) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Rows numbered from 0 in an order: sorted by range, numbered inside each range, and offset by a table of the sizes of the ranges."""
    from pyspark.sql import Window as W

    ranged = settle(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1)
    return placed.join(before, "_range").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, name: str = "rank", extras: DataFrame | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gathering a hot key in one task.

    Rows are numbered within (key, salt); a small table of counts per (key, salt) holds what comes before each salt.
    Every row has one place, and the numbering depends on the rows alone (order must be total up to equal rows).
    extras: a row of further columns for each key; they reach the rows by that table, so without another join of the hot key.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
    added = [c for c in extras.columns if c not in keys] if extras is not None else []
    if extras is not None:
        before = before.alias("b").join(extras.alias("x"), [F.col(f"b.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys], "left").select("b.*", *[F.col(f"x.{c}") for c in added])
    local = salted.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)) - 1)
    joined = local.alias("l").join(before.alias("b"), [F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_salt"]], "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._local") + F.coalesce(F.col("b._before"), F.lit(0))).cast("long").alias(name), *[F.col(f"b.{c}") for c in added])
