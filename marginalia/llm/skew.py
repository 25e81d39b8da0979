"""Joins whose rows may share a few very frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of up to so many rows is broadcast.
BROADCAST_ROWS = 100_000
#: A key with more than one part in so many of all rows is hot. No more keys than that can be, so the table of hot keys may always be broadcast.
HOT_SHARE = 4096


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The inner join of rows with a stored table that has one row a key and, in `count`, at least the number of its rows (up to repetitions inside one document).

    A table of a checked size is broadcast. A larger one is split: its hot keys are broadcast, so their rows aren't moved, and the others meet their rows in a shuffle in
    which no key has more than a small share. Null keys meet nothing; encode them before.
    """
    plain = table.drop(count)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(count).alias("total")).first()
    if size["n"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(plain), keys)
    is_hot = F.col(count) * HOT_SHARE > F.lit(size["total"])
    hot, cold = table.filter(is_hot).drop(count), table.filter(~is_hot).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
