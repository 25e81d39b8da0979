"""Distributed prefix doubling by the book, one row for each byte position: what suffix_dedup is compared with, in results and in what it moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import numbered, settle

LENGTH = 50


def repeated_starts(documents: DataFrame, offsets: tuple[int, ...] = (1, 2, 4, 8, 16, 18)) -> DataFrame:
    """(doc_id, pos) of the LENGTH-byte strings that a document with a smaller doc_id has too.

    A position's rank is for 1, 2, 4, ..., 32 and then 50 bytes (32 + 18). Each round sorts the pairs (rank, rank at the offset) by range, numbers the different ones
    that several positions have, and goes on with those positions; the others are unique, and so are the longer strings that begin there.
    """
    hexed = F.hex(F.coalesce("text", F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    pos = F.explode(F.sequence(F.lit(0), size - 1)).alias("pos")
    rows = documents.filter("doc_id is not null").filter(size >= LENGTH).select("doc_id", hexed.alias("x"), pos)
    ranks = rows.select("doc_id", "pos", F.conv(F.expr("substring(x, 2 * pos + 1, 2)"), 16, 10).cast("long").alias("rank"))
    for offset in offsets:
        ranks = settle(ranks)
        ahead = ranks.select("doc_id", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("other"))
        pairs = ranks.join(ahead, ["doc_id", "pos"])
        shared = pairs.groupBy("rank", "other").count().filter("count > 1")
        named = numbered(shared.select(F.struct("rank", "other").alias("pair")), F.col("pair"), "name").select("pair.rank", "pair.other", "name")
        ranks = pairs.join(named, ["rank", "other"]).select("doc_id", "pos", F.col("name").alias("rank"))
    first = ranks.groupBy("rank").agg(F.min("doc_id").alias("first"))
    return ranks.join(first, "rank").filter("doc_id > first").select("doc_id", "pos")


def removed_bytes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_removed)"""
    starts = repeated_starts(documents)
    before = F.lag("pos").over(W.partitionBy("doc_id").orderBy("pos"))
    return starts.withColumn("n", F.least(F.lit(LENGTH), F.coalesce(F.col("pos") - before, F.lit(LENGTH)))).groupBy("doc_id").agg(F.sum("n").alias("n_removed"))
