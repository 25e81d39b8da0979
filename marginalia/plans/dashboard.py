
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import scalars as S
from marginalia.operators.relational import newest, running_totals
from marginalia.schema import VIDEO_KINDS

#: How many of each list are shown.
TOP_AUTHORS, TOP_DOMAINS, PER_MONTH, TOPIC_SAMPLES, AUTHOR_SAMPLES, DOMAIN_SAMPLES, MONTH_SAMPLES, ARTICLES, VIDEOS = 10, 10, 6, 5, 8, 7, 6, 60, 12


def narrow(items: DataFrame) -> DataFrame:
    """The columns that all sections share, once."""
    return items.select(
        "id", "source", "url", "created_at", F.col("author.handle").alias("handle"), F.col("author.name").alias("name"), S.month(F.col("created_at")).alias("month"), S.day(F.col("created_at")).alias("day"),
        F.col("enriched.primary_topic").alias("topic"), S.summary_or_text(F.col("enriched.summary"), F.col("text")).alias("summary"), "links", "media", F.col("content.sources").alias("sources"),
    )


def growth(items: DataFrame) -> DataFrame:
    """By month, with running totals; months without posts are absent."""
    counts = items.groupBy("month").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("source") == "bookmark").alias("bm"), F.count_if(F.col("source") == "own_tweet").alias("own"))
    return running_totals(counts, "month", ["total", "bm", "own"]).withColumnRenamed("total", "new_total").select("month", "new_total", "cum_total", "cum_bm", "cum_own")


def _order() -> list:
    return [F.desc("created_at"), F.col("id")]


def _first(*more: str):
    """Where a value is met first in the order of the posts, for ties of counts (W11). A minimum, so it is combined before the shuffle as the counts are."""
    return F.min(F.struct((-F.unix_micros("created_at")).alias("t"), F.col("id").alias("i"), *more)).alias("first")


def _listed(rows: DataFrame, group: str, most: int, *more: str) -> DataFrame:
    """(group, samples): the newest posts of each group, as an array in their order."""
    picked = newest(rows.select(group, "id", "created_at", "day", "handle", "summary", "url", *more), [group], [*_order(), *more], most)
    return picked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "summary", "url", "day", "handle"))).alias("samples"))


def topic_section(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(slug, label, n, overview, samples), the most frequent first, of equal ones that which comes first."""
    judged = items.filter("topic is not null").withColumn("slug", F.col("topic"))
    counts = judged.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), _first())
    made = counts.join(pages.select("slug", "overview"), "slug", "left").join(_listed(judged, "slug", TOPIC_SAMPLES), "slug")
    return made.withColumn("label", S.topic_label(F.col("slug"))).orderBy(F.desc("n"), "first").drop("first")


def author_section(items: DataFrame) -> DataFrame:
    """Bookmarked authors, the display name from their newest post."""
    marked = items.filter("source = 'bookmark'")
    place = F.struct((-F.unix_micros("created_at")).alias("t"), F.col("id"))
    top = marked.groupBy("handle").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", place).alias("name"), _first()).orderBy(F.desc("n"), "first").limit(TOP_AUTHORS)
    samples = _listed(marked.join(F.broadcast(top.select("handle")), "handle", "left_semi"), "handle", AUTHOR_SAMPLES)  # at most TOP_AUTHORS rows
    return top.join(samples, "handle").orderBy(F.desc("n"), "first").drop("first")


def domain_section(items: DataFrame) -> DataFrame:
    """(domain, n, samples) of links by domain: an item with two links to one counts twice, and is twice among the samples."""
    links = items.select("id", "created_at", "day", "handle", "summary", "url", F.posexplode("links").alias("pos", "link")).withColumn("domain", F.col("link.domain")).filter("domain <> 'x.com'")
    top = links.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), _first("pos")).orderBy(F.desc("n"), "first").limit(TOP_DOMAINS)
    samples = _listed(links.join(F.broadcast(top.select("domain")), "domain", "left_semi"), "domain", DOMAIN_SAMPLES, "pos")  # at most TOP_DOMAINS rows
    return top.join(samples, "domain").orderBy(F.desc("n"), "first").drop("first")


def month_section(items: DataFrame) -> DataFrame:
    """(month, count, bm, own, top_topics, top_authors, samples): a row a month with its most frequent topics and bookmarked authors and its newest posts."""

    def top(rows: DataFrame, column: str, name: str, shown: Column) -> DataFrame:
        counts = rows.groupBy("month", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), _first())
        picked = newest(counts, ["month"], [F.desc("n"), F.col("first")], PER_MONTH)
        return picked.groupBy("month").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("value"), "n"))).alias(name))

    counts = items.groupBy("month").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("source") == "bookmark").alias("bm"), F.count_if(F.col("source") == "own_tweet").alias("own"))
    topics = top(items.filter("topic is not null"), "topic", "top_topics", S.topic_label(F.col("value")))
    authors = top(items.filter("source = 'bookmark'"), "handle", "top_authors", F.col("value"))
    none = F.array().cast("array<struct<rank:int,value:string,n:bigint>>")
    joined = counts.join(topics, "month", "left").join(authors, "month", "left").join(_listed(items, "month", MONTH_SAMPLES), "month")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("top_topics", "top_authors")}).orderBy("month")


def longform(items: DataFrame) -> DataFrame:
    """One row of captured and failed long reads."""
    s = items.select(F.explode("sources").alias("s")).filter(F.col("s.kind").isin("external_article", "x_article"))
    ext, ok = F.col("s.kind") == "external_article", F.col("s.outcome") == "success"
    counts = s.agg(F.count_if(ext & ok).alias("ext_saved"), F.count_if(ext & ~ok).alias("ext_failed"), F.count_if(~ext & ok).alias("x_saved"), F.count_if(~ext & ~ok).alias("x_failed"))
    counts = counts.withColumn("saved", F.col("ext_saved") + F.col("x_saved")).withColumn("total", F.col("saved") + F.col("ext_failed") + F.col("x_failed"))
    return counts.withColumn("saved_pct", S.share_pct(F.col("saved"), F.col("total")))


def longform_items(items: DataFrame) -> DataFrame:
    """(title, url, source, handle, day, summary, post, place) of the newest long reads that were captured (A9, O9); place is that of the source in its post."""
    reads = items.select("id", "created_at", "handle", "day", "summary", F.col("url").alias("post"), F.posexplode("sources").alias("place", "s"))
    saved = reads.filter(F.col("s.kind").isin("external_article", "x_article") & (F.col("s.outcome") == "success")).orderBy(*_order(), "place").limit(ARTICLES)
    title = F.coalesce(F.nullif(F.col("s.title"), F.lit("")), F.substring("s.url", 1, 80))
    return saved.orderBy(*_order(), "place").select(title.alias("title"), F.col("s.url").alias("url"), F.when(F.col("s.kind") == "external_article", "External").otherwise("X Article").alias("source"), "handle", "day", "summary", "post", "place")


def post_samples(items: DataFrame) -> DataFrame:
    """(list, count, samples) of bookmarks, own posts and posts with a photo."""
    photo = F.exists("media", lambda m: m["kind"].isin("photo_downloaded", "photo_described"))
    kinds = F.array_compact(F.array(F.when(F.col("source").isin("bookmark", "own_tweet"), F.col("source")), F.when(photo, "photo")))
    rows = items.withColumn("list", F.explode(kinds))
    return rows.groupBy("list").agg(F.count(F.lit(1)).alias("count")).join(_listed(rows, "list", MONTH_SAMPLES), "list").orderBy("list")


def media_counts(items: DataFrame) -> DataFrame:
    """Failed photos are in no count (A10)."""
    kind = F.col("m.kind")
    return items.select(F.explode("media").alias("m")).agg(F.count_if(kind.isin("photo_downloaded", "photo_described")).alias("photos_downloaded"), F.count_if(kind == "photo_pending").alias("photos_pending"), F.count_if(kind.isin(*VIDEO_KINDS)).alias("videos"))


def video_section(items: DataFrame) -> DataFrame:
    """The newest posts with a video, by their first one."""
    video = F.try_element_at(F.filter("media", lambda m: m["kind"].isin(*VIDEO_KINDS)), F.lit(1))
    rows = items.withColumn("v", video).filter("v is not null").orderBy(*_order()).limit(VIDEOS)
    return rows.select("handle", "day", "summary", F.bround(F.nullif(F.col("v.duration_millis"), F.lit(0)) / 1000).cast("long").alias("dur"), F.col("v.thumbnail_url").alias("poster"), "url")


def thumbnails(images: DataFrame, most: int = 18) -> DataFrame:
    """(id, pos, data) of the first readable pictures by post and position, as data URLs; unreadable ones use no place (R11). images: id, pos, content."""
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png").when(head.startswith("474946383"), "gif")
    readable = images.withColumn("_kind", kind).filter("_kind is not null").orderBy("id", "pos").limit(most)
    return readable.select("id", "pos", F.concat(F.lit("data:image/"), "_kind", F.lit(";base64,"), F.base64("content")).alias("data"))


def shown_topics(topics: DataFrame, most: int, without_misc: bool) -> DataFrame:
    """The largest topics, the catch-all left out if wanted (F30). topics: slug, n."""
    kept = topics.filter("slug <> 'misc'") if without_misc else topics
    return kept.orderBy(F.desc("n"), "slug").limit(most)


def dashboard_data(items: DataFrame, pages: DataFrame) -> str:
    """All sections as one JSON text (R10, K9, X22): top lists and a row a month, so small at any scale."""
    base = narrow(items)
    sections = {
        "growth": growth(base), "topics": topic_section(base, pages), "authors": author_section(base), "domains": domain_section(base), "months": month_section(base),
        "longform": longform(base), "articles": longform_items(base), "media": media_counts(base), "videos": video_section(base), "samples": post_samples(base),
    }
    blob = {name: [json.loads(r["j"]) for r in d.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()] for name, d in sections.items()}
    text = json.dumps(blob, ensure_ascii=False)
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = text.replace(raw, safe)
    return text
