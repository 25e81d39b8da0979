"""The corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, and what is left is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.

Nulls in any column are values like others: a null text is empty, a null source is a source, rows without doc_id are rows of their own. Texts may have any
length. An empty table gives empty tables of the same columns. Columns beyond those of documents are left out at the first stage.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint_dir
from marginalia.llm.mixing import mix
from marginalia.llm.ngram_join import join_components
from marginalia.llm.packing import pack
from marginalia.llm.suffix_dedup import remove_repeats
from marginalia.llm.toxicity import fit, score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half stay. Each row is judged by its own text: an empty or null one has the score of a text
    without features, repeated rows have equal scores and stay or go together. Without labels all stay."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(*COLUMNS), model, "toxic_score").filter("toxic_score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays; rows that share this doc_id all stay. Texts without words (empty, null)
    are linked with nothing and stay. Rows without doc_id aren't told apart here: all stay unless each is linked with a row that has one."""
    found = join_components(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; documents of which nothing is left (also those that were empty or null) go. Rows of one doc_id don't remove
    from one another, and rows without doc_id keep all their text."""
    return remove_repeats(docs.select(*COLUMNS)).filter(F.octet_length(F.coalesce("text", F.lit(""))) > 0)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. Rows that share a doc_id go alike, as the one taken most."""
    taken = mix(docs).filter("copies > 0").select("doc_id", "copies").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    joined = docs.select(*COLUMNS).join(taken.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences. A repeated row is packed as often as it occurs; empty and null texts are packed as their end alone."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A fitted classifier and a tokenizer have no SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{i}")
    return docs
