"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and `most` copies that is as close to even as the token constraints allow: the entropy of
rate / most is greatest under "the words taken from each source equal its target". The solution is exponentially tilted,
rate / (most - rate) = exp(a_source * size / mean size), and the dual in a_source is convex: Newton steps, kept inside a shrinking
bracket, find it. Rates depend on source and size only, so the corpus is first reduced to counts of (source, size), and every
step is one aggregation of that table over the cluster.

Rounding: in each source, sizes from large to small, each size takes as many extra copies as bring the words taken so far nearest to the
words wanted so far; the error left is that of the smallest sizes. Which documents of a size get the extra copy is decided by a hash
of their id, numbered across the cluster, so reruns agree.

Defined results: a null text has size 0 and gives no words; a null source is a source of its own, the last; repeated rows are documents
each. A source without words has target 0. Texts of any length count whole; other columns are left out. It is an error if STEPS
Newton steps don't bring every source within CLOSE_ENOUGH of its target.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import WORD_PATTERN, numbered, salted_rank, settle, stored

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
STEPS, CLOSE_ENOUGH, SALTS = 100, 1e-10, 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares of `share` times all words by repeating weights; what would be above `most` times a source is reshared."""
    totals = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    weighed = settle(numbered(totals, F.col("source").asc_nulls_last(), "place").withColumn("weight", weight))
    budget = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # each round fills at least one more source
        at_most = F.col("weight") * level >= most * F.col("source_size") if full >= 0 else F.lit(False)
        n, filled, rest = weighed.agg(F.count_if(at_most), F.sum(F.when(at_most, most * F.col("source_size"))), F.sum(F.when(~at_most, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, max(level, (budget - (filled or 0)) / rest)
    return weighed.select("source", "source_size", F.least(F.col("weight") * level, most * F.col("source_size").cast("double")).alias("target"))


def tilts(counts: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, unit, tilt): Newton iterations of the dual. counts: (source, size, n). tilt is null where the target is 0 or the most possible."""
    n = F.col("n").cast("double")
    means = counts.filter("size > 0").groupBy("source").agg((F.sum(F.col("size") * n) / F.sum(n)).alias("unit"))
    state = targets.join(means, targets["source"].eqNullSafe(means["source"])).select(targets["source"], "unit", (F.col("target") / F.col("unit")).alias("goal"), "source_size", "target")
    inner = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size"))
    even = F.col("target") / (most * F.col("source_size"))
    state = settle(state.filter(inner).select("source", "unit", "goal", F.log(even / (1 - even)).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    for _ in range(STEPS):
        x, p = F.col("size") / F.col("unit"), F.lit(1.0) / (1.0 + F.exp(-F.col("tilt") * F.col("size") / F.col("unit")))
        joined = counts.filter("size > 0").alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
        sums = joined.groupBy(F.col("s.source").alias("source"), "unit", "goal", "tilt", "low", "high").agg(F.sum(most * n * p * x).alias("value"), F.sum(most * n * p * (1 - p) * x * x).alias("slope"))
        over = F.col("value") - F.col("goal")
        low, high = F.when(over < 0, F.greatest("low", "tilt")).otherwise(F.col("low")), F.when(over > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope"))
        nearer = sums.withColumns({"low": low, "high": high, "step": step, "off": F.abs(over) / F.col("goal")})
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        wide = F.when(F.col("low") == float("-inf"), 2 * F.col("high") - F.abs("high") - 1).when(F.col("high") == float("inf"), 2 * F.col("low") + F.abs("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("off") <= CLOSE_ENOUGH
        state = settle(nearer.select("source", "unit", "goal", F.when(done, F.col("tilt")).when(inside, F.col("step")).otherwise(wide).alias("tilt"), "low", "high", "off"))
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE_ENOUGH:
            return state.select("source", "unit", "tilt")
        state = state.drop("off")
    raise RuntimeError(f"the tilts are still off their targets after {STEPS} Newton steps")


ROUNDED = "source string, size long, source_size long, target double, rate double, base int, extra long"


def _round(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size", ascending=False)
    owed, extra = 0.0, []
    for size, n, rate in zip(group["size"].tolist(), group["n"].tolist(), group["rate"].tolist(), strict=True):
        owed += n * (rate - int(rate)) * size
        k = min(n, max(0, round(owed / size))) if size and rate > int(rate) else 0
        owed -= k * size
        extra.append(k)
    return group.assign(base=group["rate"].astype(int), extra=extra)[ROUNDED.replace(",", "").split()[::2]]


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (size times copies) for every row."""
    rows = stored(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size")))
    counts = settle(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = settle(source_targets(rows, weights, share, most))
    found = tilts(counts, targets, most)
    rated = counts.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).join(found.alias("f"), F.col("c.source").eqNullSafe(F.col("f.source")), "left")
    tilted = F.lit(float(most)) / (1.0 + F.exp(-F.col("f.tilt") * F.col("c.size") / F.col("f.unit")))
    rate = F.when(F.col("c.size") == 0, 0.0).when(F.col("f.tilt").isNotNull(), tilted).when(F.col("target") > 0, float(most)).otherwise(0.0)
    rated = rated.select("c.source", "c.size", "n", "source_size", "target", rate.alias("rate"))
    rounded = settle(rated.groupBy("source").applyInPandas(_round, ROUNDED))  # a row for each size of a source
    ranked = salted_rank(rows, ["source", "size"], [F.xxhash64("doc_id"), F.col("doc_id")], F.xxhash64("doc_id", F.lit("salt")), SALTS, extras=rounded)
    copies = F.col("base") + (F.col("rank") < F.col("extra")).cast("int")
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
