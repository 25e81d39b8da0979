
from __future__ import annotations

from datetime import UTC, datetime, time

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.scalars import is_network_url, video_class

#: Failures that may pass by themselves, of photos and of fetched pages.
TRANSIENT_MEDIA = ("http_5xx", "timeout", "unknown_error")
TRANSIENT_FETCH = ("timeout", "dns_error", "unknown_error")
EXTERNAL = "external_article"
SOURCES = {"bookmarks": ("bookmark",), "tweets": ("own_tweet",), "all": ("bookmark", "own_tweet")}


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def parse_bound(value: str, end_of_day: bool = False) -> datetime:
    """A date or time as an aware instant; a bare date as an upper bound means its last microsecond (F2)."""
    at = datetime.fromisoformat(value)
    if end_of_day and len(value.strip()) == 10:
        at = datetime.combine(at.date(), time.max)
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def in_window(at: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """Both bounds optional and inclusive (F1)."""
    kept = F.lit(True)
    if since is not None:
        kept = kept & (at >= since)
    if until is not None:
        kept = kept & (at <= until)
    return _sure(kept)


def in_scope(source: Column, scope: str) -> Column:
    """(F4, V7)"""
    if scope not in SOURCES:
        raise ValueError(f"source must be one of {', '.join(SOURCES)}")
    return source.isin(*SOURCES[scope])


def fetch_candidate(links: Column) -> Column:
    """Some link leads outside the network; an item without links is none."""
    return _sure(F.exists(links, lambda x: ~is_network_url(x["url"])))


def should_refetch(content: Column, force: bool = False) -> Column:
    """Never fetched, forced, or every external source failed for a reason that may pass."""
    own = F.filter(content["sources"], lambda s: s["kind"] == EXTERNAL)
    passing = (F.size(own) > 0) & F.forall(own, lambda s: (s["outcome"] == "failure") & _sure(s["failure_reason"].isin(*TRANSIENT_FETCH)))
    return content.isNull() | F.lit(force) | _sure(passing)


def needs_network_fetch(links: Column, content: Column, force: bool = False) -> Column:
    """(F8)"""
    has = _sure(F.exists(links, lambda x: is_network_url(x["url"])))
    return has & (F.lit(force) | content.isNull() | ~has_source(content, "x_article"))


def has_source(content: Column, kind: str) -> Column:
    """(F9, F18)"""
    return _sure(F.exists(content["sources"], lambda s: s["kind"] == kind))


def needs_thread(thread: Column, content: Column, force: bool = False) -> Column:
    """(F9)"""
    return _sure(thread["is_thread"]) & (F.lit(force) | ~has_source(content, "thread"))


def pending_enrichment(enriched_at: Column, fetched_at: Column) -> Column:
    """Never enriched, or fetched since."""
    return enriched_at.isNull() | _sure(fetched_at > enriched_at)


def photo_eligible(media: Column, force: bool = False) -> Column:
    """(F11)"""
    kind = media["kind"]
    return _sure(F.when(kind == "photo_pending", True).when(kind.isin("photo_downloaded", "photo_described"), force).when(kind == "photo_failed", F.lit(force) | _sure(media["failure_reason"].isin(*TRANSIENT_MEDIA))))


def video_eligible(media: Column, force: bool = False) -> Column:
    """(F12)"""
    kind = media["kind"]
    state = F.when(kind == "video_pending", True).when(kind == "video_downloaded", force).when(kind == "video_failed", F.lit(force) | _sure(media["failure_reason"].isin(*TRANSIENT_MEDIA)))
    return _sure(state) & (video_class(media["url"], media["thumbnail_url"]) == "mp4")


def describe_eligible(media: Column, version: str, language: str, force: bool = False) -> Column:
    """(F13)"""
    stale = ~(media["description_version"].eqNullSafe(F.lit(version)) & media["description_lang"].eqNullSafe(F.lit(language)))
    return _sure(F.when(media["kind"] == "photo_downloaded", True).when(media["kind"] == "photo_described", F.lit(force) | stale))


def size_gate(size: Column, cap: int | None) -> Column:
    """Null if it passes, else why not."""
    if cap is None:
        return F.lit(None).cast("string")
    return F.when(size.isNull(), "size_unknown").when(size > cap, "too_large")


def has_note(links: Column, media: Column, enriched: Column) -> Column:
    """(F16)"""
    return _sure(F.size(links) > 0) | _sure(F.size(media) > 0) | enriched.isNotNull()


def described_images(media: Column) -> Column:
    """(F19)"""
    return F.transform(F.filter(media, lambda m: (m["kind"] == "photo_described") & ~_sure(m["is_decorative"]) & (F.coalesce(m["description"], F.lit("")) != "")), lambda m: m["description"])


def spoken_texts(sources: Column) -> Column:
    """(F20)"""
    return F.transform(F.filter(sources, lambda s: (s["outcome"] == "success") & (s["kind"] == "x_video") & _sure(s["has_speech"]) & (F.coalesce(s["text"], F.lit("")) != "")), lambda s: s["text"])


def article_texts(sources: Column) -> Column:
    """(F21)"""
    return F.transform(F.filter(sources, lambda s: (s["outcome"] == "success") & (s["kind"] != "x_video") & (F.coalesce(s["text"], F.lit("")) != "")), lambda s: s["text"])


def unsafe_id(item_id: Column) -> Column:
    """(F22)"""
    return item_id.isNull() | item_id.isin("", ".", "..") | item_id.rlike(r"[/\\\x00]")


def unsafe_path(path: Column) -> Column:
    """Absolute, or with a step upwards."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    return _sure(flat.startswith("/") | flat.rlike("^[A-Za-z]:") | F.array_contains(F.split(flat, "/"), ".."))


def real_stream(url: Column, thumbnail_url: Column) -> Column:
    """(F23)"""
    return ~url.eqNullSafe(thumbnail_url)


def video_bytes(content_type: Column, body: Column) -> Column:
    """body: binary."""
    head = F.lower(F.ltrim(F.decode(F.substring(body, 1, 64), "ISO-8859-1")))
    markup = head.startswith("<!doctype") | head.startswith("<html") | head.startswith("<?xml") | head.startswith("{")
    box = (F.octet_length(body) >= 12) & (F.decode(F.substring(body, 5, 4), "ISO-8859-1") == "ftyp")
    return ~_sure(markup) & _sure(F.lower(content_type).startswith("video/") | box)


def response_class(url: Column, status: Column, operation: str) -> Column:
    """(F25)"""
    return F.when(status == 429, "rate_limited").when(status.isin(401, 403), "logged_out").when(url.contains(operation), "matched").otherwise("other")


def rate_limit_action(new_hits: Column, used: Column, budget: int) -> Column:
    """(F26)"""
    return F.when(new_hits == 0, "scroll").when(used >= budget, "abort").otherwise("backoff")


def wants_second_extractor(reason: Column) -> Column:
    """(F29)"""
    return _sure(reason.isin("js_required", "empty_content"))
