
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.predicates import unsafe_path
from marginalia.functions.scalars import user_tail
from marginalia.sources.file_sink import write_files
from marginalia.storage import exists, in_tasks

KEY = "<!-- key: "


def read_markdown(df: DataFrame, out: str) -> DataFrame:
    """(key, old_path, old) of the files that are there; their first line has the key."""
    spark = df.sparkSession
    if not exists(spark, out):
        return spark.createDataFrame([], "key string, old_path string, old string")
    whole = spark.read.option("pathGlobFilter", "*.md").text(out, wholetext=True).select(F.col("_metadata.file_name").alias("old_path"), F.col("value").alias("old"))
    key = F.regexp_extract("old", rf"^{KEY}(.*?) -->", 1)
    # of several files of a key, the first by name
    return whole.withColumn("key", key).filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("old_path", "old"), F.col("old_path")).alias("f")).select("key", "f.*")


def write_markdown(df: DataFrame, out: str, marker: str) -> int:
    """df: (key, path, body). One file a row, with what the user wrote below the marker of the file that the key had (X23, K6, K7); that one goes
    if it had another name. Rows whose path leaves the folder are an error. All files are put in place, or, where a task fails for good, none."""
    joined = df.join(read_markdown(df, out), "key", "left")
    text = F.concat(F.lit(KEY), "key", F.lit(" -->\n"), "body", F.lit(f"\n\n{marker}"), user_tail(F.col("old"), marker, "\n"))
    bad = F.raise_error(F.concat(F.lit("not a path inside the folder: "), "path")).cast("string")
    return write_files(joined.select(F.when(unsafe_path(F.col("path")), bad).otherwise(F.col("path")).alias("path"), "old_path", text.alias("body")), out)


def mirror(paths: DataFrame, out: str) -> int:
    """Copies files (path) into a folder by their names, where they aren't there with the same size (K10). Returns how many were copied; missing files are passed over."""

    def missing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there, root = in_tasks(out)
        for frame in frames:
            due = []
            for path in frame["path"]:
                files, at = in_tasks(path)
                source, name = files.get_file_info(at), at.rsplit("/", 1)[-1]
                if source.type == fs.FileType.File and there.get_file_info(f"{root}/{name}").size != source.size:
                    due.append((name, path))
            yield pd.DataFrame(due, columns=["path", "from_path"])

    # of several files of one name the first by path is copied
    due = paths.select("path").distinct().mapInPandas(missing, "path string, from_path string").groupBy("path").agg(F.min("from_path").alias("from_path"))
    return write_files(due, out)
