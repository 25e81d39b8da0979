from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.workspace import Settings, Workspace


def store(spark, rows):
    return spark.read.schema(schema.item_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def item(i, **more):
    return {"id": str(i), "source": "bookmark", "url": f"https://x.com/a/status/{i}", "author": {"handle": "a", "name": "A"}, "text": f"text {i}", "created_at": f"2024-01-0{i}T00:00:00Z", "media": [], "links": [{"url": "http://b.org", "domain": "b.org"}], **more}


def test_a_corpus_from_capture_to_diff(spark, tmp_path):
    at = F.lit("2025-01-01").cast("timestamp")
    ws = Workspace(spark, str(tmp_path / "data"))
    video = {"kind": "video_pending", "url": "p", "thumbnail_url": "p", "bitrate": 8000, "duration_millis": 1000}
    captured = store(spark, [item(1), item(2, media=[video]), item(2, url="later")])
    assert ws.extract(captured, "bookmark", at) == 2 and ws.extract(captured, "bookmark", at) == 0 and ws.table("cursors").first()["last_seen_id"] == "2"
    with pytest.raises(RuntimeError):
        ws.extract(captured, "bookmark", at, complete=False)
    ws.fetch(lambda url: {"outcome": "success", "text": "body"}, at)
    ws.attach_threads(spark.createDataFrame([("1", "a thread")], "id string, text string"), F.lit("2026-01-01").cast("timestamp"))
    first = {r["id"]: r for r in ws.table("items").collect()}["1"]
    assert first["content"]["fetched_at"].year == 2025 and [s["kind"] for s in first["content"]["sources"]] == ["external_article", "thread"]
    ws.apply_vocabulary(spark.createDataFrame([(0, "ai", ""), (1, "ux", ""), (2, "ai", "again")], schema.VOCAB))
    with pytest.raises(ValueError):
        ws.apply_vocabulary(spark.createDataFrame([(0, "Bad Slug", "")], schema.VOCAB))
    bad = ws.enrich(spark.createDataFrame([("1", "s", "ai", ["ai"]), ("2", "", "ux", ["ux"])], schema.JUDGMENT), "fake", at)
    assert [r["item_id"] for r in bad.collect()] == ["2"] and [r["id"] for r in ws.pending().collect()] == ["2"]
    before = ws.snapshot("test")
    assert ws.enrich(spark.createDataFrame([("1", "s", "ux", ["ux"]), ("2", "t", "ux", ["ux", "ai"])], schema.JUDGMENT), "fake", at).count() == 0
    found = ws.diff(before)
    assert found["items"].first()["reassigned"] == 1 and {(r["slug"], r["added"], r["removed"]) for r in found["topics"].collect()} == {("ai", 0, 1), ("ux", 2, 0)}
    assert [r["slug"] for r in ws.topics_due().collect()] == ["ai", "ux"]
    ws.synthesize(lambda slug, pool: {"overview": f"{slug}: {len(pool)}" if slug == "ux" else "[[no]]", "notes": []}, at)
    assert [(r["slug"], r["overview"], r["post_count_at_synth"]) for r in ws.table("pages").collect()] == [("ux", "ux: 2", 2)]
    assert ws.videos().first()["state"] == "poster-era" and [r["reason"] for r in ws.select_videos(["9", "2", "..", "1"]).collect()] == ["unknown_item", "poster_era", "invalid_id", "no_video"]
    with pytest.raises(RuntimeError):
        ws.refresh_media(store(spark, [item(7)]))
    assert ws.refresh_media(store(spark, [item(2, media=[video | {"url": "https://video.twimg.com/v.mp4"}])])) == {"seen": 1, "not_seen": 1} and ws.videos().first()["state"] == "pending"
    assert ws.generate(str(tmp_path / "out"))["notes"] == 2
    note = next((tmp_path / "out/items").glob("*-1.md"))
    note.write_text(note.read_text() + "my own words\n")
    note.rename(note.with_name("renamed.md"))
    assert ws.generate(str(tmp_path / "out"))["notes"] == 2
    assert note.read_text().endswith("## My notes\nmy own words\n") and not note.with_name("renamed.md").exists() and "[[ux]] (2)" in (tmp_path / "out/index.md").read_text()
    assert tuple(ws.status().first()) == (2, 2, 2, 2)
    versions = lambda: sum(1 for _ in (tmp_path / "data/items").iterdir())
    assert ws.restore(before)["items"] == "copied" and ws.pending().count() == 1
    had = versions()
    assert len(ws.prune(1)) >= 1 and len(ws.snapshots()) == 1 and versions() < had and ws.table("items").count() == 2
    stale = ws._generation()
    ws._generation = lambda: stale - 1  # as a writer that has read an older list
    with pytest.raises(RuntimeError, match="another writer"):
        ws.publish(vocab=ws.spark.createDataFrame([], schema.VOCAB))


def test_all_verbs_at_once_go_on_after_an_error(spark, tmp_path):
    at = F.lit("2025-01-01").cast("timestamp")
    ws = Workspace(spark, str(tmp_path / "data"))
    ws.apply_vocabulary(spark.createDataFrame([(0, "ai", "")], schema.VOCAB))
    judge = lambda pending: pending.select(F.col("id").alias("item_id"), F.lit("s").alias("summary"), F.lit("ai").alias("primary_topic"), F.array(F.lit("ai")).alias("topics"))

    def offline(url):
        raise OSError("offline")

    done = ws.sync(store(spark, [item(1), item(2)]), "bookmark", offline, offline, judge, lambda slug, pool: {"overview": "o", "notes": []}, at, str(tmp_path / "out"))
    assert done["extract"] == 2 and done["enrich"] == 0 and done["generate"] == 2 and ws.table("pages").count() == 1
    done = ws.sync(None, "bookmark", offline, offline, judge, lambda slug, pool: {"overview": "o", "notes": []}, at, str(tmp_path / "out"))
    assert "AttributeError" in done["extract"] and done["generate"] == 2


def test_media_is_mirrored_once(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"abc")
    ws = Workspace(spark, str(tmp_path / "data"))
    photo = {"kind": "photo_downloaded", "url": "m", "local_path": str(tmp_path / "a.jpg"), "width": 1, "height": 1, "bytes_size": 3}
    ws.backfill(store(spark, [item(1, media=[photo]), item(2, media=[photo])]))
    assert ws.mirror_media(str(tmp_path / "media")) == 1 and ws.mirror_media(str(tmp_path / "media")) == 0 and (tmp_path / "media/a.jpg").read_bytes() == b"abc"


def test_descriptions_archives_and_settings(spark, tmp_path):
    at = F.lit("2025-01-01").cast("timestamp")
    ws = Workspace(spark, str(tmp_path / "data"))
    photo = {"kind": "photo_downloaded", "url": "m", "local_path": "m", "width": 1, "height": 1, "bytes_size": 1}
    ws.extract(store(spark, [item(1, media=[photo])]), "bookmark", at)
    lost = ws.describe(spark.createDataFrame([("1", 0, False, "a cat"), ("1", 5, False, "x"), ("1", 0, False, " ")], "item_id string, index int, is_decorative boolean, description string"), at)
    assert ws.table("items").first()["media"][0]["description"] == "a cat" and [r["index"] for r in lost.collect()] == [5]
    ws.backfill(store(spark, [item(3, media=[{"kind": "photo_pending", "url": "good"}, {"kind": "photo_pending", "url": "bad"}]), item(4, media=[{"kind": "photo_pending", "url": "late"}])]))

    def get(url):
        if url == "bad":
            raise OSError("gone")
        return {"local_path": f"{url}.jpg", "bytes_size": 3, "width": 1, "height": 1}

    assert {(r["kind"], r["reason"], r["n"]) for r in ws.download(get, at, limit=2).collect()} == {("photo_downloaded", None, 1), ("photo_failed", "unknown_error", 1)}
    kinds = {(r["id"], m["url"]): (m["kind"], m["attempts"]) for r in ws.table("items").collect() for m in r["media"]}
    assert kinds[("3", "bad")] == ("photo_failed", 1) and kinds[("4", "late")][0] == "photo_pending" and kinds[("1", "m")][0] == "photo_described"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/tweets.js", 'x = [{"tweet": {"id_str": "5", "full_text": "old", "created_at": "Wed Oct 10 20:19:24 +0000 2018"}}]')
    assert ws.import_archive(str(tmp_path / "a.zip"), "me", at) == 1 and ws.table("items").count() == 4
    assert Settings.parse('language = "es"').language == "es"
    for bad in ('language = "xx"', "nothing = 1"):
        with pytest.raises(ValueError):
            Settings.parse(bad)
