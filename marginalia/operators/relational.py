
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.operators.numbering import numbered_in


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the order (W3). An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")) if rest else df.select(*keys).distinct()
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns) if rest else picked


def insert_if_absent(store: DataFrame, new: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Rows of the store, and of new those whose key it lacks, the first of each."""
    fresh = first_seen(new, [key], order).join(store.select(key), key, "left_anti")
    return store.unionByName(fresh.select(*store.columns))


def known_and_new(batch: DataFrame, store: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(J2, J5, U5)"""
    return batch.join(store.select(key), key, "left_semi"), batch.join(store.select(key), key, "left_anti")


def before_first_known(captured: DataFrame, store: DataFrame, key: str, feed: str, order: str) -> DataFrame:
    """What an incremental pull takes of each feed: rows before the first known id in descending order (T1). The known ids shrink to one place a feed."""
    stop = captured.join(store.select(key), key, "left_semi").groupBy(feed).agg(F.max(order).alias("_stop"))
    return captured.join(stop, feed, "left").filter(F.col("_stop").isNull() | (F.col(order) > F.col("_stop"))).drop("_stop")


def newest(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of each group (W2, O1, O2, O9). Spark keeps n rows a group and task before the shuffle."""
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= n)


def running_totals(df: DataFrame, order: str, columns: Sequence[str], prefix: str = "cum_") -> DataFrame:
    """For tables with a row for each step of the order, such as months."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.sum(c).over(w).alias(prefix + c) for c in columns])


def sums_before(parts: DataFrame, part: str, value: str, stretch: int = 4096) -> DataFrame:
    """(part, _before): the sum of value over all smaller parts, a whole number each. Parts are summed inside stretches of them, and only a
    row for each stretch meets in one task."""
    cut = parts.withColumn("_stretch", F.floor(F.col(part) / stretch))
    whole = cut.groupBy("_stretch").agg(F.sum(value).alias("_sum"))
    ahead = W.rowsBetween(W.unboundedPreceding, -1)
    starts = whole.select("_stretch", F.coalesce(F.sum("_sum").over(ahead.orderBy("_stretch")), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(value).over(ahead.partitionBy("_stretch").orderBy(part)), F.lit(0))
    return cut.withColumn("_inside", inside).join(starts, "_stretch").select(part, (F.col("_start") + F.col("_inside")).alias("_before"))


def budget_prefix(df: DataFrame, eligible: Column, order: Sequence[Column], limit: int, parts: str) -> DataFrame:
    """Rows up to where `limit` eligible ones have been seen, with `taken`.

    `parts` is a column of whole numbers that cuts the order into stretches that follow one another; sums run inside a stretch and a
    small table has what comes before each, so the whole order never meets in one task.
    """
    marked = df.withColumn("_e", F.coalesce(eligible, F.lit(False)).cast("int"))
    before = sums_before(marked.groupBy(parts).agg(F.sum("_e").alias("_n")), parts, "_n")
    open_parts = before.filter(F.col("_before") < limit)
    inside = F.sum("_e").over(W.partitionBy(parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    seen = marked.join(open_parts, parts).withColumn("_seen", F.col("_before") + inside - F.col("_e"))
    return seen.filter(F.col("_seen") < limit).withColumn("taken", F.col("_e") == 1).select(*df.columns, "taken")


def positional_zip(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[Column], right_order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """The i-th row of a key on the left with the i-th on the right, which may be missing."""
    numbered = lambda d, o: numbered_in(d, [key], o, "_i").withColumn("_i", F.col("_i") + 1)
    other = numbered(right, right_order).select(key, "_i", *[F.col(v).alias(f"fresh_{v}") for v in values])
    return numbered(left, left_order).join(other, [key, "_i"], "left").withColumnRenamed("_i", "place")


def batches(df: DataFrame, order: Sequence[Column], size: int, parts: str) -> DataFrame:
    """Consecutive batches of `size` (W9); `parts` as for budget_prefix."""
    before = sums_before(df.groupBy(parts).agg(F.count(F.lit(1)).alias("_n")), parts, "_n")
    place = F.row_number().over(W.partitionBy(parts).orderBy(*order)) - 1
    return df.withColumn("_place", place).join(before, parts).select(*df.columns, F.floor((F.col("_before") + F.col("_place")) / size).cast("long").alias("batch"))


def evenly(df: DataFrame, group: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, both ends kept, spread evenly (W8): the places round(k * last / (most - 1)), half to even.

    A place i is kept if a whole k near i * (most - 1) / last rounds to it, so no list of places is made."""
    numbered = numbered_in(df, group, order, "_i", "_last").withColumn("_last", F.col("_last") - 1)
    steps = max(1, most - 1)
    near = F.floor(F.col("_i") * steps / F.greatest("_last", F.lit(1)))
    hits = [(near + d).between(0, most - 1) & (F.bround((near + d) * F.col("_last") / F.lit(steps)) == F.col("_i")) for d in (-1, 0, 1)]
    kept = (F.col("_last") < most) | hits[0] | hits[1] | hits[2]
    return numbered.filter(kept).drop("_i", "_last")


def same_bag(a: Column, b: Column) -> Column:
    """Equal as multisets."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def replace_kind(items: Column, kind: str, new: Column) -> Column:
    """Array without the elements of a kind, and the new ones behind (U8)."""
    return F.concat(F.filter(items, lambda s: s["kind"] != kind), new)


def term_cosine(a: DataFrame, b: DataFrame, key: str, token: str) -> DataFrame:
    """(key, similarity) of token rows of both sides; 0 where a side has none."""
    count = lambda d, name: d.groupBy(key, token).agg(F.count(F.lit(1)).cast("double").alias(name))
    both = count(a, "_a").join(count(b, "_b"), [key, token], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    sums = both.groupBy(key).agg(F.sum(x * y).alias("dot"), F.sum(x * x).alias("aa"), F.sum(y * y).alias("bb"))
    return sums.select(key, F.when((F.col("aa") == 0) | (F.col("bb") == 0), 0.0).otherwise(F.col("dot") / F.sqrt("aa") / F.sqrt("bb")).alias("similarity"))


def fail_if_all_failed(df: DataFrame, attempted: str, succeeded: str, message: str) -> DataFrame:
    """A report of one row; an error where something was tried and nothing went right."""
    bad = (F.col(attempted) > 0) & (F.col(succeeded) == 0)
    return df.withColumn(attempted, F.when(bad, F.raise_error(F.lit(message)).cast("long")).otherwise(F.col(attempted)))
