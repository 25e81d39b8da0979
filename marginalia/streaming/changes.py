
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed(fetched: DataFrame, enriched: DataFrame, horizon_seconds: int, lateness: str) -> DataFrame:
    """(id, fetched_at, enriched_at): each fetch with the enrichments that follow it within the horizon, or, once the watermark says that none can come, with null.

    fetched: (id, fetched_at), enriched: (id, enriched_at), both streams, or both tables. Rows may come in any order; those later than `lateness` behind are passed over, as are rows
    without id or time. State is dropped with the watermark. Keys are (id, stretch of time), so that the history of a busy id isn't one state.
    """
    stretch = lambda at: F.floor(F.unix_timestamp(at) / horizon_seconds)
    f = fetched.select(F.col("id").alias("_id"), "fetched_at").filter("_id is not null and fetched_at is not null")
    e = enriched.select("id", "enriched_at").filter("id is not null and enriched_at is not null")
    if f.isStreaming:
        f, e = f.withWatermark("fetched_at", lateness), e.withWatermark("enriched_at", lateness)
    f = f.withColumn("_stretch", stretch(F.col("fetched_at")))
    e = e.withColumn("stretch", F.explode(F.array(stretch(F.col("enriched_at")), stretch(F.col("enriched_at")) - 1)))
    inside = F.col("enriched_at").between(F.col("fetched_at"), F.col("fetched_at") + F.expr(f"INTERVAL '{int(horizon_seconds)}' SECOND"))
    joined = f.join(e, (F.col("_id") == F.col("id")) & (F.col("_stretch") == F.col("stretch")) & inside, "left")
    return joined.select(F.col("_id").alias("id"), "fetched_at", "enriched_at")


def latest_state(joined: DataFrame) -> DataFrame:
    """(id, fetched_at, enriched_at, pending) by the last fetch of each id: an aggregate, so a busy id is combined before the shuffle."""
    last = joined.groupBy("id").agg(F.max(F.struct("fetched_at", "enriched_at")).alias("m"))  # null sorts first
    return last.select("id", "m.fetched_at", "m.enriched_at", F.col("m.enriched_at").isNull().alias("pending"))
