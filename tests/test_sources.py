from __future__ import annotations

import json
import uuid

import pytest

from marginalia.sources import articles, external


def tree():
    state = {
        "blocks": [{"type": "header-one", "text": "Head"}, {"type": "unstyled", "text": "Body", "entityRanges": []}, {"type": "atomic", "text": " ", "entityRanges": [{"key": 0}]}, {"type": "unstyled", "text": "  "}],
        "entityMap": [{"key": "0", "value": {"type": "MEDIA", "data": {"mediaItems": [{"mediaId": 5}, {"mediaId": 6}]}}}],
    }
    return json.dumps({"data": {"x": [{"title": "T", "cover_media": {"media_info": {"original_img_url": "c.jpg"}}, "media_entities": [{"media_id": "5", "media_info": {"original_img_url": "a.jpg"}}], "content_state": json.dumps(state)}]}})


def test_article_trees(spark):
    title, blocks, seen, _ = articles.parse_article(tree())
    assert title == "T" and [b["url"] or b["text"] for b in blocks] == ["c.jpg", "# Head", "\n\nBody", "a.jpg"] and seen == 1
    assert articles.parse_article("not json") is None and articles.parse_article('{"a": 1}') is None
    captures = spark.createDataFrame([("1", 0, "{}"), ("1", 1, tree()), ("2", 0, "bad")], "id string, seq long, body string")
    out = {r["id"]: r for r in articles.with_fallback(articles.parse_captures(captures), spark.createDataFrame([("1", "Head Body"), ("2", "plain")], "id string, plain string")).collect()}
    assert out["1"]["text"] == "# Head\n\nBody" and not out["1"]["fell_back"] and out["2"]["text"] == "plain" and out["2"]["fell_back"]


def test_adapters(spark):
    def transcribe(url):
        if url == "bad":
            raise ValueError("no sound")
        return {"text": "hello", "language": "en", "has_speech": True}

    rows = spark.createDataFrame([("1", "k", "u"), ("2", "k", "u"), ("3", "q", "bad")], "id string, video_key string, url string")
    out = {r["id"]: (r["text"], r["error"]) for r in external.digest_videos(rows, transcribe).collect()}
    assert out == {"1": ("hello", None), "2": ("hello", None), "3": (None, "ValueError: no sound")}
    with pytest.raises(Exception, match="every row failed"):
        external.report(external.digest_videos(rows.filter("id = '3'"), transcribe)).collect()
    assert external.first_json_object('say {not} then {"a": {"b": "}"}} end') == {"a": {"b": "}"}} and external.first_json_object("none [1]") is None
    texts = spark.createDataFrame([(f"t{i}",) for i in range(5)], "text string")
    assert "x" in {r["slug"] for r in external.induce_vocabulary(texts, lambda some: ["x", f"n{len(some)}"], sorted, chunk=2).collect()}


def test_candidates_meet_in_one_call_only_when_they_fit_it(spark, tmp_path):
    """Every call notes its size in a file, since calls run on the executors."""
    texts = spark.createDataFrame([(f"t{i}",) for i in range(1500)], "text string")

    def consolidate(some):
        (tmp_path / f"{uuid.uuid4().hex}").write_text(str(len(some)))
        return [s for s in some if s.endswith("7")] or some[:1]

    found = {r["slug"] for r in external.induce_vocabulary(texts, list, consolidate, chunk=80, most=200).collect()}
    assert {s for s in found if s.endswith("7")} == {f"t{i}" for i in range(1500) if i % 10 == 7} and len(found) <= 200
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert max(sizes) <= 200 and len(sizes) > 8
    assert external.induce_vocabulary(texts, list, list, most=1000).count() == 1500  # nothing is lost where nothing gets fewer
    assert external.induce_vocabulary(texts.limit(0), list, list).count() == 0
