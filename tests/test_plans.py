"""Dashboard, state transitions and rendered text over a small store."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.plans import dashboard, render, state


@pytest.fixture(scope="module")
def items(spark):
    link = lambda u, d: {"url": u, "domain": d}
    rows = [
        {"id": "10", "source": "bookmark", "url": "p10", "author": {"handle": "ann", "name": "Ann"}, "text": "first line", "created_at": "2024-01-05T10:00:00Z", "links": [link("http://b.org/1", "b.org"), link("http://b.org/2", "b.org")],
         "media": [{"kind": "photo_downloaded", "url": "m", "local_path": "m.jpg", "width": 1, "height": 1, "bytes_size": 9}, {"kind": "video_pending", "url": "v", "thumbnail_url": "v", "duration_millis": 2500}],
         "content": {"fetched_at": "2024-01-06T00:00:00Z", "sources": [{"outcome": "success", "kind": "external_article", "url": "http://b.org/1", "title": "T", "text": "body"}]},
         "enriched": {"enriched_at": "2024-01-07T00:00:00Z", "summary": "sum <b>", "primary_topic": "ai-tools", "topics": ["ai-tools", "ux"]}, "bookmark_folder": "Read later"},
        {"id": "9", "source": "own_tweet", "url": "p9", "author": {"handle": "me", "name": "Me"}, "text": "second", "created_at": "2024-03-05T10:00:00Z", "links": [link("http://c.org", "c.org"), link("https://x.com/a", "x.com")], "media": [], "content": None},
        {"id": "8", "source": "bookmark", "url": "p8", "author": {"handle": "ann", "name": "Ann Old"}, "text": "x", "created_at": "2023-12-05T10:00:00Z", "links": [], "media": [], "enriched": {"primary_topic": "ai-tools", "topics": ["ai-tools"], "enriched_at": "2024-01-07T00:00:00Z"}},
    ]
    return spark.read.schema(schema.item_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


PAGES = "slug string, overview string, notes array<string>"


def test_dashboard_sections(spark, items):
    base = dashboard.narrow(items)
    assert [tuple(r) for r in dashboard.growth(base).orderBy("month").collect()] == [("2023-12", 1, 1, 1, 0), ("2024-01", 1, 2, 2, 0), ("2024-03", 1, 3, 2, 1)]
    assert [(r["handle"], r["n"], r["name"]) for r in dashboard.author_section(base).collect()] == [("ann", 2, "Ann")]
    assert [(r["domain"], r["n"], [x["id"] for x in r["samples"]]) for r in dashboard.domain_section(base).collect()] == [("b.org", 2, ["10", "10"]), ("c.org", 1, ["9"])]
    month = {r["month"]: r for r in dashboard.month_section(base).collect()}["2024-01"]
    assert (month["count"], month["bm"], month["own"], [tuple(t) for t in month["top_topics"]], [x["id"] for x in month["samples"]]) == (1, 1, 0, [(1, "AI Tools", 1)], ["10"])
    assert [(r["title"], r["source"]) for r in dashboard.longform_items(base).collect()] == [("T", "External")] and [(r["list"], r["count"]) for r in dashboard.post_samples(base).collect()] == [("bookmark", 2), ("own_tweet", 1), ("photo", 1)]
    assert dashboard.longform(base).first()["saved_pct"] == 100.0 and tuple(dashboard.media_counts(base).first()) == (1, 0, 1)
    assert [(r["slug"], r["label"], r["n"], [s["id"] for s in r["samples"]]) for r in dashboard.topic_section(base, spark.createDataFrame([], PAGES)).collect()] == [("ai-tools", "AI Tools", 2, ["10", "8"])]
    blob = dashboard.dashboard_data(items, spark.createDataFrame([("ai-tools", "o", [])], PAGES))
    assert "<" not in blob and json.loads(blob)["videos"][0]["dur"] == 2 and json.loads(blob)["topics"][0]["overview"] == "o"
    empty = dashboard.dashboard_data(items.limit(0), spark.createDataFrame([], PAGES))
    assert json.loads(empty)["growth"] == []


def test_ties_go_by_the_first_post_and_link(spark):
    """Names are in the reverse of the order in which they are met."""
    rows = [{"id": f"{9 - i}", "source": "bookmark", "url": "p", "author": {"handle": f"z{9 - i % 3}", "name": f"N{i}"}, "text": "x", "created_at": f"2024-01-0{9 - i}T00:00:00Z", "media": [], "links": [{"url": "u", "domain": d} for d in (("y.org", "x.org") if i < 2 else ("a.org", "a.org"))[: 2 if i < 3 else 0]],
             "enriched": {"primary_topic": f"t{9 - i % 3}", "topics": [], "enriched_at": "2024-01-07T00:00:00Z"}} for i in range(6)]
    base = dashboard.narrow(spark.read.schema(schema.item_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows])).repartition(3))
    assert [(r["handle"], r["name"], r["n"]) for r in dashboard.author_section(base).collect()] == [("z9", "N0", 2), ("z8", "N1", 2), ("z7", "N2", 2)]
    assert [r["slug"] for r in dashboard.topic_section(base, spark.createDataFrame([], PAGES)).collect()] == ["t9", "t8", "t7"]
    assert [(r["domain"], r["n"]) for r in dashboard.domain_section(base).collect()] == [("y.org", 2), ("x.org", 2), ("a.org", 2)]
    month = dashboard.month_section(base).first()
    assert [t["value"] for t in month["top_topics"]] == ["T9", "T8", "T7"] and [a["value"] for a in month["top_authors"]] == ["z9", "z8", "z7"]


def test_fetch_isolates_failures_and_moves_time_on_change_only(spark, items):
    def fetch(url):
        if "c.org" in url:
            raise OSError("down")
        return {"outcome": "success", "title": "T", "text": "body"}

    at = F.lit("2025-01-01").cast("timestamp")
    once = state.fetch_pending(items, fetch, at)
    rows = {r["id"]: r for r in once.collect()}
    assert rows["9"]["content"]["sources"][0]["failure_reason"] == "unknown_error" and rows["8"]["content"] is None and rows["10"]["content"]["fetched_at"].year == 2024
    again = {r["id"]: r for r in state.fetch_pending(once, fetch, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert again["9"]["content"]["fetched_at"].year == 2025
    forced = {r["id"]: r for r in state.fetch_pending(items, lambda u: {"outcome": "success", "text": "new"}, at, force=True).collect()}
    assert forced["10"]["content"]["fetched_at"].year == 2025 and len(forced["10"]["content"]["sources"]) == 2


def test_media_transitions(spark, items):
    one = items.filter("id = '10'")
    media, fresh = F.col("media"), F.array(F.col("media")[1].withField("url", F.lit("s.mp4")))
    assert [m["url"] for m in one.select(state.refresh_videos(media, fresh).alias("m")).first()["m"]] == ["m", "s.mp4"]
    assert [m["url"] for m in one.select(state.refresh_videos(media, F.array(F.col("media")[1])).alias("m")).first()["m"]] == ["m", "v"]
    outcome = F.struct(F.lit(False).alias("ok"), F.lit("p").alias("local_path"), F.lit(1).cast("long").alias("bytes_size"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("timeout").alias("reason"), F.lit("e").alias("error"))
    failed = one.select(state.media_outcome(media[1], outcome, F.lit("2025-01-01").cast("timestamp")).alias("m")).first()["m"]
    assert (failed["kind"], failed["attempts"]) == ("video_failed", 1)
    judgment = F.struct(F.lit(True).alias("is_decorative"), F.lit("text").alias("description"))
    said = one.select(state.described(media[0], judgment, "1", "en", F.lit("2025-01-01").cast("timestamp")).alias("m")).first()["m"]
    assert (said["kind"], said["description"]) == ("photo_described", "")


def test_rendered_text(spark, items):
    notes = {r["id"]: r for r in render.notes(items).collect()}
    assert notes["10"]["path"] == "2024-01-05-t-10.md" and "tags: [x-knowledge, ai-tools, ux, read-later]\nbookmark_folder: Read later\n---" in notes["10"]["body"] and set(notes) == {"8", "9", "10"}
    assert notes["10"]["body"].split("---\n")[2] == """
# T

sum <b>

**Topics:** [[ai-tools]] · [[ux]]

## Tweet

first line

![[_media/m.jpg]]
> 🎥 [Ver vídeo](v) (pendiente de descarga)

## Enlaces
- <http://b.org/1>
- <http://b.org/2>

[Ver tweet original](p10)

## Content: T

body"""
    spanish = {r["id"]: r["body"] for r in render.notes(items, "hashtag", "es").collect()}["10"]
    assert "**Temas:** #ai-tools #ux" in spanish and "## Contenido: T" in spanish
    prompt = {r["id"]: r["prompt"] for r in render.enrichment_prompt(items, ["ai-tools"]).collect()}["10"]
    assert prompt.index("topics:") < prompt.index("author:") < prompt.index("links:") < prompt.index("articles:")
    posts = spark.createDataFrame([("ai-tools", "primary", "8"), ("ai-tools", "primary", "10"), ("ai-tools", "also", "9"), ("ux", "also", "10")], "slug string, role string, id string")
    vocab = spark.createDataFrame([(0, "ai-tools", "Tools."), (1, "ux", "")], schema.VOCAB)
    pages = spark.createDataFrame([("ai-tools", "About.", ["n"], 1)], PAGES + ", post_count_at_synth int")
    bodies = {r["slug"]: r["body"] for r in render.topic_pages(posts, items, pages, vocab).collect()}
    assert bodies["ai-tools"] == """---
topic: ai-tools
tags: [x-knowledge-topic, ai-tools]
posts: 3
primary_posts: 2
---

# ai-tools

> Tools.

## Overview

> ⚠ Overview desactualizado: +2 posts desde la última síntesis.

About.

## Notas importantes

- n

## Primary posts (2)

- `2024-01-05` · @ann · [[items/2024-01-05-t-10|first line]]
- `2023-12-05` · @ann · [[items/2023-12-05-x-8|x]]

## Also relevant (1)

- `2024-03-05` · @me · [[items/2024-03-05-second-9|second]]"""
    assert "*(Overview pendiente.)*" in bodies["ux"] and "## Primary" not in bodies["ux"]
    index = render.index_page(items, "2024-05-06").first()["body"]
    assert "- Items totales: 3\n- Bookmarks: 2 · Tweets propios: 1\n- Con nota propia: 3\n- Enriquecidos: 2" in index and index.endswith("- [[ai-tools]] (2)\n- [[ux]] (1)")
    assert render.index_page(items.limit(0), "2024-05-06").first()["body"].endswith("## Topics\n")
    assert {r["id"]: r["line"] for r in render.log_lines(items).collect()}["9"] == "- `2024-03-05` @me: second → [[items/2024-03-05-second-9|nota]]"
    with pytest.raises(ValueError):
        render.topic_refs(F.array(F.lit("x")), "nothing")


def test_lines_of_quotations(spark):
    texts = ["a\nb", "a\r\nb\n", "\n", "a\n\n", "", None, "a\u2028b\x85"]
    found = [r["q"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(render.quoted(F.col("t")).alias("q")).collect()]
    assert found == [[f"> {x}" for x in (t or "").splitlines()] for t in texts]


def test_what_a_source_leaves_in_a_note(spark):
    def lines(*sources):
        row = {"content": {"fetched_at": "2024-02-03T00:00:00Z", "sources": sources}}
        frame = spark.read.schema(schema.item_schema()).json(spark.sparkContext.parallelize([json.dumps(row)]))
        return frame.select(render.source_lines(F.col("content.sources"), F.col("content.fetched_at")).alias("x")).first()["x"]

    picture = lambda **m: {"kind": "image", "alt": m.pop("alt", None), "media": m}
    blog = {"outcome": "success", "kind": "x_article", "url": "u", "text": "t"}
    assert lines(blog | {"blocks": [picture(kind="photo_pending", url="x"), {"kind": "text", "text": "\n\n"}]}) == []
    assert lines(blog | {"blocks": [{"kind": "text", "text": "\n\n\n\nP"}, picture(kind="photo_described", local_path="a", alt="A\nB", description="D")]}) == ["## Content: u", "", "\n\nP", "", "![[_media/a]]", "> A", "> B", "> D", ""]
    assert lines(blog, {"outcome": "failure", "kind": "quoted_tweet", "url": "q", "failure_reason": "timeout"}) == ["## Content: u", "", "t", ""]
    assert lines({"outcome": "failure", "kind": "x_article", "url": "q", "failure_reason": "dns_error"}) == ["> ⚠ Enlace roto: <q> — dominio no resuelto (verificado 2024-02-03)", ""]
    video = {"outcome": "success", "kind": "x_video", "url": "v"}
    assert lines(video | {"text": "said", "has_speech": False}) == ["> 🔇 Silent video (no speech detected).", ""] and lines(video | {"text": "said"}) == ["## Video digest: v", "", "said", ""]
    assert lines(video | {"text": "", "has_speech": False, "frames": [{"local_path": "f", "description": "a\nb"}]}) == ["## Video digest: v", "", "![[_media/f]]", "> a b", ""]
