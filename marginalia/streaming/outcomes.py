
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.storage import exists, in_tasks, on_driver

#: Micro-batches that a run is cut into at most: each costs about the same whatever it holds, so beyond this they grow instead.
MOST_BATCHES = 64


def _persisting(key: str, argument: str, function: Callable[[str], dict], names: list[str], folder: str, every: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = in_tasks(folder)
        files.create_dir(root, recursive=True)

        def keep(rows: list[dict]) -> None:
            """Written aside and renamed, so that what has a name is whole."""
            name = uuid.uuid4().hex
            with files.open_output_stream(f"{root}/_{name}") as f:
                f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
            files.move(f"{root}/_{name}", f"{root}/{name}.json")

        for frame in frames:
            rows: list[dict] = []
            for k, a in zip(frame[key], frame[argument], strict=True):
                try:
                    found, error = function(a), None
                except Exception as e:  # one unit's failure is its outcome
                    found, error = {}, f"{type(e).__name__}: {e}"[:500]
                rows.append({key: k, **{n: found.get(n) for n in names}, "error": error})
                if len(rows) >= every:
                    keep(rows)
                    rows = []
            if rows:
                keep(rows)
            yield pd.DataFrame({"n": [len(frame)]})

    return run


def run_units(work: DataFrame, log: str, key: str, argument: str, function: Callable[[str], dict], fields: str, units_per_file: int = 16, files_per_batch: int = 64, persist_every: int = 1) -> DataFrame:
    """(key, fields, error) for each distinct key of work; function gets the argument of a key and returns the fields.

    `log` is a folder that all share. Work is dealt into files once, and a stream takes some of them a micro-batch; its checkpoint says which batches are done. Inside a
    batch each task writes its outcomes every `persist_every` units. Where a run ends before its time, the next call with the same log goes on: batches that are done aren't
    read again, and of the broken one only units without an outcome are called. An outcome is in the result once, whatever was repeated. A micro-batch takes `files_per_batch` files, more
    where there would be over MOST_BATCHES micro-batches.

    A key is a text, and not null. A second call with a log takes its work from there, not from `work`. Outcomes of a batch become one Parquet folder by the number of the batch, which a
    repeated batch replaces.
    """
    spark = work.sparkSession
    names = StructType.fromDDL(fields).names
    shape = f"{key} string, {fields}, error string"
    if not exists(spark, f"{log}/work/_SUCCESS"):
        units = work.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.min(argument).alias(argument))
        files = max(1, -(-units.count() // units_per_file))
        units.repartition(files, key).write.mode("overwrite").parquet(f"{log}/work")
    kind = spark.read.parquet(f"{log}/work").schema

    def write(batch: DataFrame, number: int) -> None:
        session, parts = batch.sparkSession, f"{log}/parts/batch={number}"
        made = lambda: session.read.schema(shape).json(parts)
        todo = batch.join(made().select(key), key, "left_anti") if exists(session, parts) else batch
        todo.mapInPandas(_persisting(key, argument, function, names, parts, persist_every), "n long").write.format("noop").mode("overwrite").save()
        rest = [*names, "error"]
        if exists(session, parts):  # of a unit that ran twice one outcome counts
            once = made().groupBy(key).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("o"))
            once.select(key, "o.*").write.mode("overwrite").parquet(f"{log}/outcomes/batch={number}")
            files, where = on_driver(session, parts)
            files.delete(where, True)

    files, where = on_driver(spark, f"{log}/work")
    dealt = len(files.listStatus(where))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", max(files_per_batch, -(-dealt // MOST_BATCHES))).parquet(f"{log}/work")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{log}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shape).parquet(f"{log}/outcomes") if exists(spark, f"{log}/outcomes") else spark.createDataFrame([], shape)
