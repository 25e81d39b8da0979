"""Shapes of the stored tables: wide structs with a discriminator for each union, and the migration of older records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MEDIA = """STRUCT<type: STRING, kind: STRING, url: STRING, local_path: STRING, width: INT, height: INT, bytes_size: BIGINT, downloaded_at: TIMESTAMP,
failure_reason: STRING, error: STRING, attempts: INT, last_attempt_at: TIMESTAMP, is_decorative: BOOLEAN, description: STRING, description_lang: STRING,
description_version: STRING, described_at: TIMESTAMP, thumbnail_url: STRING, bitrate: BIGINT, duration_millis: BIGINT>"""
SOURCE = f"""STRUCT<outcome: STRING, kind: STRING, url: STRING, title: STRING, text: STRING, failure_reason: STRING, error: STRING, http_status: INT, attempts: INT,
has_speech: BOOLEAN, language: STRING, frames: ARRAY<STRUCT<timestamp: DOUBLE, local_path: STRING, description: STRING>>,
blocks: ARRAY<STRUCT<kind: STRING, text: STRING, alt: STRING, media: {MEDIA}>>, ok: BOOLEAN>"""
ITEM = f"""id STRING, source STRING, url STRING, author STRUCT<handle: STRING, name: STRING>, text STRING, created_at TIMESTAMP, captured_at TIMESTAMP,
media ARRAY<{MEDIA}>, links ARRAY<STRUCT<url: STRING, domain: STRING>>, quoted_id STRING, thread STRUCT<is_thread: BOOLEAN, root_id: STRING, position: INT>,
content STRUCT<fetched_at: TIMESTAMP, sources: ARRAY<{SOURCE}>>,
enriched STRUCT<enriched_at: TIMESTAMP, executor: STRING, summary: STRING, primary_topic: STRING, topics: ARRAY<STRING>, user_notes: STRING>, bookmark_folder STRING"""
TOPIC_PAGE = "slug STRING, overview STRING, notes ARRAY<STRING>, synthesized_at TIMESTAMP, post_count_at_synth INT"
VOCAB = "pos INT, slug STRING, description STRING"
JUDGMENT = "item_id STRING, summary STRING, primary_topic STRING, topics ARRAY<STRING>"

#: Variants of the unions.
PHOTO_KINDS = ("photo_pending", "photo_downloaded", "photo_failed", "photo_described")
VIDEO_KINDS = ("video_pending", "video_downloaded", "video_failed")
SOURCE_KINDS = ("external_article", "x_article", "thread", "quoted_tweet", "x_video")
FETCH_FAILURES = ("not_found", "forbidden", "paywall", "timeout", "dns_error", "js_required", "empty_content", "unknown_error")


def item_schema() -> StructType:
    return StructType.fromDDL(ITEM)


def migrate_media(media: Column) -> Column:
    """Entries without a kind become pending ones of their type."""
    kind = lambda m: F.coalesce(m["kind"], F.when(m["type"] == "photo", "photo_pending").otherwise("video_pending"))
    return F.transform(media, lambda m: m.withField("kind", kind(m)))


def migrate_sources(sources: Column) -> Column:
    """`ok` becomes `outcome`; a failure without a reason gets unknown_error."""

    def one(s: Column) -> Column:
        outcome = F.coalesce(s["outcome"], F.when(s["ok"], "success").when(~s["ok"], "failure"))
        return s.withField("outcome", outcome).withField("failure_reason", F.when(outcome == "failure", F.coalesce(s["failure_reason"], F.lit("unknown_error"))))

    return F.transform(sources, one)


def migrate(items: DataFrame) -> DataFrame:
    """Older records in today's shape, with `problem`, null for good rows."""
    empty = lambda c: F.coalesce(F.col(c), F.array())
    content = F.when(F.col("content").isNotNull(), F.col("content").withField("sources", migrate_sources(F.col("content.sources"))))
    moved = items.withColumns({"media": migrate_media(empty("media")), "links": empty("links"), "content": content})
    return moved.withColumn("problem", item_problem())


def item_problem() -> Column:
    """The first thing wrong with a row (V6)."""
    media, sources = F.col("media"), F.coalesce(F.col("content.sources"), F.array())
    text_of = lambda s: F.array_join(F.transform(F.filter(s["blocks"], lambda b: b["kind"] == "text"), lambda b: b["text"]), "")
    return (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "id is missing")
        .when(~F.coalesce(F.col("source").isin("bookmark", "own_tweet"), F.lit(False)), "source is unknown")
        .when(F.exists(media, lambda m: ~F.coalesce(m["kind"].isin(*PHOTO_KINDS, *VIDEO_KINDS), F.lit(False))), "media kind is unknown")
        .when(F.exists(media, lambda m: m["kind"].isin("photo_downloaded", "photo_described") & ~F.coalesce((m["width"] > 0) & (m["height"] > 0) & (m["bytes_size"] > 0), F.lit(False))), "photo has no size")
        .when(F.exists(media, lambda m: m["kind"].endswith("_failed") & ~F.coalesce(m["attempts"] >= 1, F.lit(False))), "failure has no attempts")
        .when(F.exists(media, lambda m: F.coalesce(m["is_decorative"], F.lit(False)) & (F.coalesce(m["description"], F.lit("")) != "")), "decorative photo has a description")
        .when(F.exists(sources, lambda s: s["outcome"].isNull()), "source has neither outcome nor ok")
        .when(F.exists(sources, lambda s: ~F.coalesce(s["kind"].isin(*SOURCE_KINDS), F.lit(False))), "source kind is unknown")
        .when(F.exists(sources, lambda s: (F.coalesce(F.size(s["blocks"]), F.lit(0)) > 0) & ~text_of(s).eqNullSafe(s["text"])), "blocks don't add up to the text")
    )


def split_valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those set aside with their problem."""
    moved = migrate(items)
    return moved.filter("problem is null").drop("problem"), moved.filter("problem is not null")
