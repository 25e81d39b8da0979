"""Stores as versioned Parquet, their JSON forms, and inbound archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schema import ITEM, JUDGMENT, TOPIC_PAGE, item_schema


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def read_items_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of id -> item; a missing file is an empty store (S1). Order is by id wherever it matters."""
    if not _exists(spark, path):
        return spark.createDataFrame([], item_schema())
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"MAP<STRING, STRUCT<{_struct(ITEM)}>>"))).select("value.*")


def _struct(ddl: str) -> str:
    """`a INT, b STRUCT<...>` as the inside of a struct type."""
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in item_schema()) if ddl == ITEM else ddl


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet store."""
    return spark.read.schema(item_schema()).parquet(path) if _exists(spark, path) else spark.createDataFrame([], item_schema())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(S2)"""
    return spark.read.schema(TOPIC_PAGE).json(path) if _exists(spark, path) else spark.createDataFrame([], TOPIC_PAGE)


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """A worksheet: one JSON object with a list."""
    rows = spark.read.schema(f"judgments ARRAY<STRUCT<{', '.join(x.replace(' ', ': ', 1) for x in JUDGMENT.split(', '))}>>").json(path, multiLine=True)
    return rows.select(F.explode("judgments").alias("j")).select("j.*")


def export_worksheet(pending: DataFrame, columns: list[str]) -> DataFrame:
    """Pending rows as JSON lines with nulls kept."""
    return pending.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_version(df: DataFrame, root: str, label: str) -> str:
    """A new version beside the old ones (K1, M14); restoring one is reading its path. Spark's commit makes it whole or absent."""
    path = f"{root}/{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')[:-3]}-{label}"
    df.write.parquet(path)
    return path


def read_manifests(spark: SparkSession, paths: str) -> DataFrame:
    """Newest first; what can't be read is kept with nulls, last."""
    read = spark.read.schema("created_at TIMESTAMP, command STRING, item_count INT, topic_count INT, vocab_size INT").option("mode", "PERMISSIVE").json(paths)
    return read.orderBy(F.desc_nulls_last("created_at"))


def to_prune(manifests: DataFrame, keep_last: int, name: str = "name") -> DataFrame:
    """All but the newest (K5)."""
    if keep_last < 0:
        raise ValueError("keep_last can't be negative")
    from pyspark.sql import Window as W

    place = F.row_number().over(W.orderBy(F.desc_nulls_last("created_at"), name))  # one row a version
    return manifests.withColumn("_place", place).filter(F.col("_place") > keep_last).drop("_place")


TWEET = "id_str STRING, full_text STRING, created_at STRING"


def _archive_rows(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Every row of the script file of an exported archive, id_str being null where a row is malformed."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = []
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in names if n in z.namelist()]
                    if not found:
                        raise ValueError(f"the archive has none of {', '.join(names)}")
                    text = z.read(found[0]).decode()
                for row in json.loads(text[text.find("[") :]):
                    raw.append(json.dumps(row.get("tweet", row) if isinstance(row, dict) else {}))
            yield pd.DataFrame({"value": raw})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "value string")
    return rows.select(F.from_json("value", TWEET).alias("t")).select("t.*")


ARCHIVE_FILES = ("data/tweets.js", "data/tweet.js")


def read_archive(spark: SparkSession, path: str, names: tuple[str, ...] = ARCHIVE_FILES) -> DataFrame:
    """Rows of an exported archive: a zip whose script file is a prefix and a JSON array; one without that file is an error."""
    return _archive_rows(spark, path, names).filter("id_str is not null")


def count_malformed(spark: SparkSession, path: str, names: tuple[str, ...] = ARCHIVE_FILES) -> int:
    """How many rows of an archive read_archive leaves out."""
    return _archive_rows(spark, path, names).filter("id_str is null").count()


def unreadable(responses: DataFrame) -> DataFrame:
    """Captured responses whose body is no JSON, which find_tweets leaves out."""
    return responses.filter(F.try_parse_json("body").isNull())


def find_tweets(responses: DataFrame) -> DataFrame:
    """Captured feed responses (seq, body JSON) -> one row for each post, the first of each id.

    The tree has no fixed depth, so it is walked in Python; quoted and reposted subtrees are left out, visibility envelopes opened.
    """

    def walk(node: object) -> Iterator[dict]:
        if isinstance(node, list):
            for x in node:
                yield from walk(x)
        elif isinstance(node, dict):
            for name, x in node.items():
                if name == "tweet_results" and isinstance(x, dict) and isinstance(x.get("result"), dict):
                    result = x["result"]
                    yield result.get("tweet", result) if result.get("__typename") == "TweetWithVisibilityResults" else result
                elif name not in ("quoted_status_result", "retweeted_status_result"):
                    yield from walk(x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for seq, body in zip(frame["seq"], frame["body"], strict=True):
                try:
                    tree = json.loads(body)
                except (TypeError, ValueError):  # see unreadable()
                    continue
                for pos, t in enumerate(walk(tree)):
                    legacy, user = t.get("legacy") or {}, ((t.get("core") or {}).get("user_results") or {}).get("result") or {}
                    who = {**(user.get("core") or {}), **(user.get("legacy") or {})}
                    links = [u["expanded_url"] for u in (legacy.get("entities") or {}).get("urls", []) if u.get("expanded_url")]
                    out.append((seq, pos, t.get("rest_id"), who.get("screen_name"), who.get("name") or who.get("screen_name"), legacy.get("full_text"), legacy.get("created_at"), legacy.get("quoted_status_id_str"), (legacy.get("self_thread") or {}).get("id_str"), links))
            yield pd.DataFrame(out, columns=["seq", "pos", "id", "handle", "name", "text", "created", "quoted_id", "root_id", "links"])

    from marginalia.operators.relational import first_seen

    rows = responses.select("seq", "body").mapInPandas(run, "seq long, pos int, id string, handle string, name string, text string, created string, quoted_id string, root_id string, links array<string>")
    return first_seen(rows.filter("id is not null and handle is not null"), ["id"], [F.col("seq"), F.col("pos")])
