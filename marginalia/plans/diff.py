
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scalars import grew, growth_pct, overview_flag, tokens
from marginalia.operators.relational import term_cosine


def both_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, topic_a, topic_b) of the ids on both sides (U1). a and b: id, topic (null: not enriched)."""
    return a.select("id", F.col("topic").alias("topic_a")).join(b.select("id", F.col("topic").alias("topic_b")), "id")


def items_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts (J6). A change from or to null is no reassignment."""
    judged = F.col("topic_a").isNotNull() & F.col("topic_b").isNotNull()
    counts = both_sides(a, b).agg(F.count(F.lit(1)).alias("in_both"), F.count_if(judged).alias("enriched_in_both"), F.count_if(judged & (F.col("topic_a") != F.col("topic_b"))).alias("reassigned"))
    return counts.withColumn("reassigned_pct", F.when(F.col("enriched_in_both") > 0, F.col("reassigned") / F.col("enriched_in_both")).otherwise(0.0))


def transitions(a: DataFrame, b: DataFrame, top_n: int) -> DataFrame:
    """Most frequent changes, also from and to null; ties by name with null as '' (A17)."""
    changed = both_sides(a, b).filter(~F.col("topic_a").eqNullSafe(F.col("topic_b")))
    counts = changed.groupBy(F.col("topic_a").alias("from_topic"), F.col("topic_b").alias("to_topic")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.coalesce("from_topic", F.lit("")), F.coalesce("to_topic", F.lit(""))).limit(top_n)


def topics_diff(a: DataFrame, b: DataFrame, slugs: DataFrame | None = None, threshold: float = 0.10) -> DataFrame:
    """For each slug of either side: members, added, removed, unchanged, growth (J7, U2-U4). a, b: (slug, id)."""
    left, right = (d.select("slug", "id").distinct() for d in (a, b))
    joined = left.withColumn("in_a", F.lit(1)).join(right.withColumn("in_b", F.lit(1)), ["slug", "id"], "full")
    if slugs is not None:
        joined = joined.unionByName(slugs.select("slug").distinct(), allowMissingColumns=True)
    x, y = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    counted = joined.groupBy("slug").agg(F.count_if(x).alias("members_a"), F.count_if(y).alias("members_b"), F.count_if(y & ~x).alias("added"), F.count_if(x & ~y).alias("removed"), F.count_if(x & y).alias("unchanged"))
    return counted.select("*", growth_pct(F.col("members_a"), F.col("members_b")).alias("growth_pct"), grew(F.col("members_a"), F.col("members_b"), threshold).alias("flagged_growth"))


def overviews_diff(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Term cosine of overviews on both sides, and what it means (A18, A19). a, b: (slug, overview)."""
    exploded = lambda d: d.filter("overview is not null").select("slug", F.explode(tokens(F.col("overview"))).alias("token"))
    sides = a.select("slug", F.col("overview").alias("overview_a")).join(b.select("slug", F.col("overview").alias("overview_b")), "slug", "full")
    scored = sides.join(term_cosine(exploded(a), exploded(b), "slug", "token"), "slug", "left")
    both = F.col("overview_a").isNotNull() & F.col("overview_b").isNotNull()
    return scored.withColumn("similarity", F.when(both, F.coalesce("similarity", F.lit(0.0)))).withColumn("flag", overview_flag(F.col("similarity"), threshold))
