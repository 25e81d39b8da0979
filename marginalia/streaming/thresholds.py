
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "total long, at_synthesis long, signalled boolean"
DUE = "slug string, step long, total long"


class Growth(StatefulProcessor):
    """One counter a topic: posts so far, posts at the last synthesis (none: -1), and whether this period has been signalled."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("growth", STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = initialState.iloc[0]
        self.state.update((int(first["total"]), int(first["at_synthesis"]), False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total, at, signalled = self.state.get() if self.state.exists() else (0, -1, False)
        steps = pd.concat(list(rows)).groupby("step", sort=True).agg(posts=("posts", "sum"), synthesized=("synthesized", "max"))
        out = []
        for step, posts, synthesized in zip(steps.index, steps["posts"], steps["synthesized"], strict=True):
            total += int(posts)
            crossing = at + self.threshold if at >= 0 else 1
            if total >= crossing and not signalled:
                out.append((key[0], int(step), crossing))
                signalled = True
            if synthesized:
                at, signalled = total, False
        self.state.update((total, at, signalled))
        if out:
            yield pd.DataFrame(out, columns=["slug", "step", "total"])

    def close(self) -> None:
        pass


def combined(changes: DataFrame) -> DataFrame:
    """(slug, step, posts, synthesized): rows of one Arrow batch with the same topic and step as one, before the shuffle, so that a topic with a third of all posts is a few rows a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby(["slug", "step"], as_index=False).agg(posts=("posts", "sum"), synthesized=("synthesized", "max"))[["slug", "step", "posts", "synthesized"]]

    return changes.select("slug", "step", F.col("posts").cast("long").alias("posts"), F.col("synthesized").cast("boolean").alias("synthesized")).filter("slug is not null and step is not null").mapInPandas(run, "slug string, step long, posts long, synthesized boolean")


def due_topics(changes: DataFrame, threshold: int, pages: DataFrame | None = None) -> DataFrame:
    """(slug, step, total) once for each time that a topic falls due (T7): at its first post if it was never synthesized, else when `threshold` posts have come since. A
    synthesis resets it; until then nothing more is said.

    changes: a stream of (slug, step, posts, synthesized), step being a whole number that grows with time, such as a day; posts of a step come before its synthesis.
    pages: (slug, total, at_synthesis), what there is when the stream starts. total is the number of posts that made the topic due, so the result doesn't depend on how
    the stream is cut into batches, as long as steps of a topic don't come in an earlier batch than smaller ones. Rows without topic or step count for nothing.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    grouped = combined(changes).groupBy("slug")
    first = pages.select("slug", "total", "at_synthesis").groupBy("slug") if pages is not None else None
    return grouped.transformWithStateInPandas(Growth(threshold), DUE, "Append", "None", initialState=first)
