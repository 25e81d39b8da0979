"""

Tasks write files aside, below `_staging`, and a list of what they wrote; the commit names the lists of the tasks that count. From then on the write is decided, and publish() moves
the files to their places as a Spark job. It may be broken off and run again: the next one finishes it. A write that fails before its commit leaves nothing in any place, and what it
wrote aside is deleted at once, or by sweep().

Names that begin with `_` aren't read by Spark, so a reader of the folder sees published files only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from marginalia.storage import exists, in_tasks, on_driver

SCHEMA = "path string, old_path string, body binary, from_path string"


def _leaves(path: str) -> bool:
    steps = path.replace("\\", "/").split("/")
    return path.startswith("/") or ".." in steps or ":" in steps[0] or not path or steps[0].startswith("_")


@dataclass
class Staged(WriterCommitMessage):
    listed: str
    n: int


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.run = options["path"], options.get("run") or uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        files, root = in_tasks(self.root)
        own = uuid.uuid4().hex  # a repeated task has a folder of its own
        folder, listed = f"{root}/_staging/{self.run}/{own}", []
        files.create_dir(folder, recursive=True)
        for i, row in enumerate(iterator):
            if _leaves(row["path"]):
                raise ValueError(f"not a path inside the folder: {row['path']}")
            if row["from_path"] is not None:
                source, at = in_tasks(row["from_path"])
                fs.copy_files(at, f"{folder}/{i}.part", source_filesystem=source, destination_filesystem=files)
            else:
                with files.open_output_stream(f"{folder}/{i}.part") as f:
                    f.write(bytes(row["body"] or b""))
            listed.append({"staged": f"{self.run}/{own}/{i}.part", "path": row["path"], "old_path": row["old_path"]})
        with files.open_output_stream(f"{folder}/list.json") as f:
            f.write("".join(json.dumps(x) + "\n" for x in listed).encode())
        return Staged(f"{self.run}/{own}/list.json", len(listed))

    def commit(self, messages: list[Staged | None]) -> None:
        """One line a task; written aside and renamed, which decides the write."""
        files, root = in_tasks(self.root)
        files.create_dir(f"{root}/_commits", recursive=True)
        with files.open_output_stream(f"{root}/_commits/.{self.run}") as f:
            f.write("".join(json.dumps({"list": m.listed, "n": m.n}) + "\n" for m in messages if m).encode())
        files.move(f"{root}/_commits/.{self.run}", f"{root}/_commits/{self.run}.json")

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = in_tasks(self.root)
        if files.get_file_info(f"{root}/_staging/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_staging/{self.run}")


class FilesSink(DataSource):
    """spark.dataSource.register(FilesSink); rows of SCHEMA .write.format("files").option("path", ...)"""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options))


def _move(frames: Iterator[pd.DataFrame], out: str) -> Iterator[pd.DataFrame]:
    files, root = in_tasks(out)
    for frame in frames:
        moved = 0
        for staged, path, old in zip(frame["staged"], frame["path"], frame["old_path"], strict=True):
            if files.get_file_info(f"{root}/_staging/{staged}").type == fs.FileType.File:  # else an earlier attempt has moved it
                files.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
                files.move(f"{root}/_staging/{staged}", f"{root}/{path}")
                moved += 1
            if old and old != path and files.get_file_info(f"{root}/{old}").type == fs.FileType.File:
                files.delete_file(f"{root}/{old}")
        yield pd.DataFrame({"moved": [moved]})


def publish(spark: SparkSession, out: str) -> int:
    """Moves what committed writes have set aside, also earlier ones that were broken off before, run by run in the order of their commits. Returns how many files."""
    if not exists(spark, f"{out}/_commits"):
        return 0
    files, where = on_driver(spark, f"{out}/_commits")
    found = sorted((s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().endswith(".json"))
    moved = 0
    for _, name in found:  # a commit a write, as a rule one
        lists = [f"{out}/_staging/{r['list']}" for r in spark.read.schema("list string, n long").json(f"{out}/_commits/{name}").filter("n > 0").collect()]  # a line a task
        if lists:
            rows = spark.read.schema("staged string, path string, old_path string").option("recursiveFileLookup", "true").json(lists)
            moved += rows.mapInPandas(lambda frames: _move(frames, out), "moved long").agg(F.sum("moved")).first()[0] or 0
        for path in (f"{out}/_commits/{name}", f"{out}/_staging/{name.removesuffix('.json')}"):
            gone, at = on_driver(spark, path)
            gone.delete(at, True)
    return int(moved)


def write_files(rows: DataFrame, out: str) -> int:
    """rows: path, and body or from_path, and old_path if a file of another name goes (K6, K7, K10, K14). Returns how many files were put in place, those of earlier broken writes included."""
    spark = rows.sparkSession
    spark.dataSource.register(FilesSink)
    have = set(rows.columns)
    column = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    rows.select("path", column("old_path", "string"), column("body", "binary"), column("from_path", "string")).write.format("files").option("path", out).option("run", uuid.uuid4().hex).mode("append").save()
    return publish(spark, out)


def sweep(spark: SparkSession, out: str, min_age_seconds: int = 86_400) -> int:
    """Deletes what writes without a commit have left, once it is old enough not to be a write that goes on (K14). Returns how many writes."""
    if not exists(spark, f"{out}/_staging"):
        return 0
    files, where = on_driver(spark, f"{out}/_staging")
    gone = 0
    for status in files.listStatus(where):
        run = status.getPath().getName()
        if not exists(spark, f"{out}/_commits/{run}.json") and status.getModificationTime() <= (time.time() - min_age_seconds) * 1000:
            gone += bool(files.delete(status.getPath(), True))
    return gone
