"""Adapters for what runs outside: models, transcription, vision, downloads. Each takes a callable that the caller injects, and tests give
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions.visual import deck_frames, visual_kinds
from marginalia.operators.relational import fail_if_all_failed
from marginalia.storage import scratch


def require_tools(*names: str) -> None:
    """(B23)"""
    missing = [n for n in names if shutil.which(n) is None]
    if missing:
        raise RuntimeError(f"not installed: {', '.join(missing)}")


def call_each(df: DataFrame, key: str, argument: str, function: Callable[[str], dict], fields: str) -> DataFrame:
    """(key, fields, error) for each distinct key (E1-E6, S13-S20, X19, B12, B16, B17): function gets the argument and returns the fields."""
    names = StructType.fromDDL(fields).names

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, a in zip(frame[key], frame[argument], strict=True):
                try:
                    found, error = function(a), None
                except Exception as e:  # one row's failure stays its own
                    found, error = {}, f"{type(e).__name__}: {e}"[:500]
                rows.append({key: k, **{n: found.get(n) for n in names}, "error": error})
            yield pd.DataFrame(rows, columns=[key, *names, "error"])

    once = df.groupBy(key).agg(F.min(argument).alias(argument))
    return once.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {fields}, error string")


def report(outcomes: DataFrame) -> DataFrame:
    """attempted, succeeded; an error if all failed."""
    counts = outcomes.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("error").isNull()).alias("succeeded"))
    return fail_if_all_failed(counts, "attempted", "succeeded", "every row failed")


def first_json_object(reply: str) -> dict | None:
    """The first JSON object in a model's reply (S21): the decoder is tried at each brace, since braces nest and strings hold them."""
    decoder = json.JSONDecoder()
    at = reply.find("{")
    while at >= 0:
        try:
            found, _ = decoder.raw_decode(reply, at)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
        at = reply.find("{", at + 1)
    return None


def digest_videos(items: DataFrame, transcribe: Callable[[str], dict]) -> DataFrame:
    """One transcript for each video, fanned out to all items that show it (C11, M5, A26, J3). items: id, video_key, url."""
    spoken = call_each(items, "video_key", "url", transcribe, "text string, language string, has_speech boolean")
    return items.select("id", "video_key").distinct().join(spoken, "video_key")


def digest_visuals(items: DataFrame, extract: Callable[[str], list[tuple[float, bytes]]]) -> tuple[DataFrame, DataFrame]:
    """What each video looks like, and the frames of those that are slides (C11, M5, A33, S19), once a video, whatever number of items show it.

    extract: url -> (second, PNG bytes) of its key frames. Returns (video_key, visual_kind, error) and (video_key, place, second, content).
    """
    folder = scratch(items.sparkSession, "frames")
    shape = "array<struct<second: double, content: binary>>"
    found = call_each(items, "video_key", "url", lambda url: {"frames": [{"second": float(t), "content": bytes(b)} for t, b in extract(url)]}, f"frames {shape}")
    found.write.parquet(folder)  # one call a video, whatever reads the result
    found = items.sparkSession.read.parquet(folder)
    frames = found.select("video_key", F.posexplode("frames").alias("place", "f")).select("video_key", "place", "f.second", "f.content")
    kinds = visual_kinds(found.filter("error is null"), frames)
    return found.select("video_key", "error").join(kinds, "video_key", "left").select("video_key", "visual_kind", "error"), deck_frames(frames, kinds)


def induce_vocabulary(items: DataFrame, propose: Callable[[list[str]], list[str]], consolidate: Callable[[list[str]], list[str]], chunk: int = 80, most: int = 1000) -> DataFrame:
    """(slug) of candidates from chunks of posts, consolidated (A32, E9): a tree of calls over tasks, so candidates meet in one place only when they fit one call.

    Distinct candidates are counted; while there are more than `most`, they are dealt into groups by hash, and one call consolidates at most `most` of a group, the most frequent first.
    What comes back is dealt again with another hash, as long as that makes them fewer by a tenth. The last call has all that is left, at most `most`; where rounds end
    before that, their result is what there is. Each round is stored, so that no call is made twice for one result.
    """
    spark = items.sparkSession
    folder = scratch(spark, "induction")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for frame in frames:
            held.extend(frame["text"])
            while len(held) >= chunk:
                yield pd.DataFrame({"slug": propose(held[:chunk])})
                held = held[chunk:]
        if held:
            yield pd.DataFrame({"slug": propose(held)})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(frame["slug"], frame["n"], strict=True))
        order = sorted(counts, key=lambda s: (-counts[s], s))
        made = dict.fromkeys(s for i in range(0, len(order), most) for s in consolidate(order[i : i + most]))
        return pd.DataFrame({"slug": list(made), "n": [int(counts.get(s, 1)) for s in made]})

    def stored(frame: DataFrame, name: str) -> tuple[DataFrame, int]:
        counted = frame.filter("slug is not null").groupBy("slug").agg(F.sum("n").alias("n"))
        counted.write.parquet(f"{folder}/{name}")
        kept = spark.read.schema("slug string, n long").parquet(f"{folder}/{name}")
        return kept, kept.count()

    found, left = stored(items.select("text").mapInPandas(run, "slug string").withColumn("n", F.lit(1).cast("long")), "0")
    for level in range(1, 64):
        groups = -(-left // most)
        last = groups <= 1
        dealt = found.withColumn("_group", F.lit(0) if last else F.pmod(F.xxhash64(F.lit(level), "slug"), F.lit(groups)))
        before = left
        found, left = stored(dealt.groupBy("_group").applyInPandas(lambda frame: merge(frame[["slug", "n"]]), "slug string, n long"), str(level))
        if last or left * 10 > before * 9:
            break
    return found.select("slug")
