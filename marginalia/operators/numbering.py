"""Places of rows inside their groups, also where one group is too large for a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.storage import scratch

#: Rows of a group that one task may sort.
HOT_ROWS = 1 << 20


def numbered_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], place: str, total: str | None = None) -> DataFrame:
    """df with `place`, from 0 in the order inside each group, and `total`, the size of the group, if wanted. order must be total up to equal rows.

    Groups are counted first. Where none is hot, a window sorts each; else rows are sorted by ranges of (group, order), which cut a hot group into many, and a table with a row
    for each group that a range holds tells what lies before it. Both ways number alike.
    """
    most = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    here = W.partitionBy(*group)
    if most <= HOT_ROWS:
        out = df.withColumn(place, F.row_number().over(here.orderBy(*order)) - 1)
        return out.withColumn(total, F.count(F.lit(1)).over(here)) if total else out
    spark, path = df.sparkSession, scratch(df.sparkSession, "numbering")
    df.withColumn("_numbering_tie", F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    rows, order = spark.read.parquet(f"{path}/rows"), [*order, F.col("_numbering_tie")]
    rows.repartitionByRange(*group, *order).withColumn("_numbering_range", F.spark_partition_id()).write.parquet(f"{path}/ranges")
    ranged = spark.read.parquet(f"{path}/ranges")
    sizes = ranged.groupBy(*group, "_numbering_range").agg(F.count(F.lit(1)).alias("_numbering_size"))
    before = F.coalesce(F.sum("_numbering_size").over(here.orderBy("_numbering_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(g).alias(f"_numbering_g{i}") for i, g in enumerate(group)], F.col("_numbering_range").alias("_numbering_r"), before.alias("_numbering_before"), F.sum("_numbering_size").over(here).alias("_numbering_total"))
    local = ranged.withColumn("_numbering_local", F.row_number().over(W.partitionBy(*group, "_numbering_range").orderBy(*order)) - 1)
    same = F.col("_numbering_range") == F.col("_numbering_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_numbering_g{i}"))
    out = local.join(sizes, same).withColumn(place, (F.col("_numbering_before") + F.col("_numbering_local")).cast("int"))
    return out.select(*df.columns, place, *([F.col("_numbering_total").alias(total)] if total else []))
