
from __future__ import annotations

import socket
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import predicates as P
from marginalia.functions.scalars import is_network_url
from marginalia.operators.relational import replace_kind, same_bag

#: Runs on the executors: one URL in, outcome fields out. Real ones go to the network; tests give fakes.
Fetcher = Callable[[str], dict]
FETCHED = "url string, outcome string, title string, text string, failure_reason string, error string, http_status int"


def material(sources: Column) -> Column:
    """What counts as change: everything but the number of attempts and the error text."""
    return F.transform(sources, lambda s: F.to_json(s.dropFields("attempts", "error")))


def with_sources(content: Column, kind: str, fresh: Column, as_of: Column, always: bool = False) -> Column:
    """Content whose sources of a kind are replaced; fetched_at moves on material change only, or always (M1, M3, M5, U8)."""
    old = F.coalesce(content["sources"], F.filter(fresh, lambda s: F.lit(False)))
    new = replace_kind(old, kind, fresh)
    same = content.isNotNull() & same_bag(material(old), material(new))
    at = as_of if always else F.when(same, content["fetched_at"]).otherwise(as_of)
    return F.struct(at.alias("fetched_at"), new.alias("sources"))


def reason_for_error(error: Exception) -> str:
    """Why a fetch failed, by the kind of its error."""
    return "timeout" if isinstance(error, TimeoutError) else "dns_error" if isinstance(error, socket.gaierror) else "unknown_error"


def fetch_urls(urls: DataFrame, fetch: Fetcher) -> DataFrame:
    """Each distinct URL once; one that fails is a row with a reason, not an error of the batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FETCHED.split(", ")]
        for frame in frames:
            out = []
            for url in frame["url"]:
                try:
                    found = fetch(url)
                except Exception as e:  # isolates the row
                    found = {"outcome": "failure", "failure_reason": reason_for_error(e), "error": str(e)[:500]}
                out.append({n: found.get(n) for n in names} | {"url": url})
            yield pd.DataFrame(out, columns=names)

    return urls.select("url").distinct().mapInPandas(run, FETCHED)


def fetch_pending(items: DataFrame, fetch: Fetcher, as_of: Column, force: bool = False) -> DataFrame:
    """Items with their external sources rebuilt where due (M2), as_of being the clock (E7): the filter comes before the fetch, and a URL is fetched once."""
    due = P.fetch_candidate(F.col("links")) & P.should_refetch(F.col("content"), force)
    links = items.filter(due).select("id", F.posexplode("links").alias("pos", "link")).filter(~is_network_url(F.col("link.url"))).select("id", "pos", F.col("link.url").alias("url"))
    found = links.join(fetch_urls(links, fetch), "url")
    shape = items.schema["content"].dataType["sources"].dataType.elementType
    fields = {"kind": F.lit("external_article"), "attempts": F.lit(1)} | {c: F.col(c) for c in ("outcome", "url", "title", "text", "failure_reason", "error", "http_status")}
    source = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    fresh = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", source.alias("s"))), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("f")).select("id", F.transform("f", lambda x: x["s"]).alias("fresh"))
    joined = items.join(fresh, "id", "left")
    content = F.when(F.col("fresh").isNotNull(), with_sources(F.col("content"), "external_article", F.col("fresh"), as_of)).otherwise(F.col("content"))
    return joined.withColumn("content", content).select(*items.columns)


def media_outcome(media: Column, outcome: Column, as_of: Column) -> Column:
    """pending -> downloaded, or failed with one more attempt (M7). outcome: struct of ok, local_path, bytes_size, width, height, reason, error."""
    base = F.regexp_extract(media["kind"], "^(photo|video)", 1)
    good = media.withField("kind", F.concat(base, F.lit("_downloaded"))).withField("local_path", outcome["local_path"]).withField("bytes_size", outcome["bytes_size"]).withField("width", outcome["width"]).withField("height", outcome["height"]).withField("downloaded_at", as_of).withField("failure_reason", F.lit(None).cast("string"))
    bad = media.withField("kind", F.concat(base, F.lit("_failed"))).withField("failure_reason", outcome["reason"]).withField("error", outcome["error"]).withField("attempts", F.coalesce(media["attempts"], F.lit(0)) + 1).withField("last_attempt_at", as_of)
    return F.when(outcome.isNull(), media).when(outcome["ok"], good).otherwise(bad)


def described(media: Column, judgment: Column, version: str, language: str, as_of: Column) -> Column:
    """downloaded or described -> described; a decorative photo has no text (M9, J9). judgment: struct of is_decorative, description."""
    fits = media["kind"].isin("photo_downloaded", "photo_described") & judgment.isNotNull()
    text = F.when(judgment["is_decorative"], F.lit("")).otherwise(judgment["description"])
    new = media.withField("kind", F.lit("photo_described")).withField("is_decorative", judgment["is_decorative"]).withField("description", text).withField("description_version", F.lit(version)).withField("description_lang", F.lit(language)).withField("described_at", as_of)
    return F.when(fits, new).otherwise(media)


def slide_copies(frames: DataFrame, there: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of frames to make for each post, and files of these posts that no frame stands for any more (M6). frames: id, place, local_path; there: path."""
    wanted = frames.select("id", F.col("local_path").alias("from_path"), F.concat_ws("/", F.lit("slides"), "id", F.format_string("%03d.jpg", "place")).alias("path"))
    mine = there.withColumn("id", F.regexp_extract("path", "^slides/([^/]+)/", 1)).join(frames.select("id").distinct(), "id", "left_semi")
    return wanted.join(there.select("path"), "path", "left_anti"), mine.join(wanted.select("path"), "path", "left_anti").select("path")


def refresh_videos(existing: Column, fresh: Column) -> Column:
    """The i-th pending video becomes the i-th fresh one if that is a real stream; nothing is ever degraded or dropped."""

    def step(state: Column, entry: Column) -> Column:
        pending = entry["kind"] == "video_pending"
        other = F.get(fresh, state["i"])
        better = pending & F.coalesce(P.real_stream(other["url"], other["thumbnail_url"]), F.lit(False)) & other.isNotNull()
        return F.struct(F.when(pending, state["i"] + 1).otherwise(state["i"]).alias("i"), F.concat(state["out"], F.array(F.when(better, other).otherwise(entry))).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.filter(existing, lambda m: F.lit(False)).alias("out"))
    return F.aggregate(existing, start, step, lambda s: s["out"])
