"""Truth tables and edge cases of functions, predicates, operators and plans."""

from __future__ import annotations

import json
import os
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.functions import predicates as P
from marginalia.functions import scalars as S
from marginalia.operators import relational as R
from marginalia.plans import diff, topics
from marginalia.sources import tables
from marginalia.streaming import feed


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def test_text_functions(spark):
    assert value(spark, S.slug(lit("Crème  Brûlée, 2x!"))) == "creme-brulee-2x" and value(spark, S.slug(lit("日本"))) == "item"
    assert value(spark, S.snippet(lit("a  b\nc"))) == "a b c" and value(spark, S.snippet(lit("x" * 90))) == "x" * 80 + "…"
    assert value(spark, S.truncate_transcript(lit("abc   def"), 5)) == "abc\n[… transcript truncated …]" and value(spark, S.truncate_transcript(lit("abc"), 5)) == "abc"
    assert value(spark, S.tokens(lit("À la carte, x 42"))) == ["la", "carte", "42"]
    assert value(spark, S.topic_label(lit("ai-tools-and-ux"))) == "AI Tools & UX"
    assert value(spark, S.title_of(lit("7"), lit("a\nb"), F.array(lit(""), lit("T")))) == "T" and value(spark, S.title_of(lit("7"), lit(""), F.array().cast("array<string>"))) == "7"
    assert value(spark, S.user_tail(lit("xEND mine"), "END", "d")) == " mine" and value(spark, S.user_tail(lit("mine"), "END", "d")) == "\n\nmine" and value(spark, S.user_tail(lit(" "), "END", "d")) == "d"
    assert value(spark, S.escape_for_script(lit("</script>&"))) == "\\u003c/script\\u003e\\u0026"


def test_url_and_media_functions(spark):
    assert value(spark, S.canonical_url_key(lit("http://Twitter.com/i/article/9/?a=1#x"))) == "x.com/i/article/9"
    assert value(spark, S.url_class(lit("https://x.com/i/article/1/status/2"))) == "article" and value(spark, S.status_id(lit("https://x.com/u/status/42"))) == "42"
    assert value(spark, S.with_query(lit("http://a/b.jpg?x=1&name=small&y=2"), "name", "orig")) == "http://a/b.jpg?x=1&name=orig&y=2" and value(spark, S.with_query(lit("http://a/b"), "name", "orig")) == "http://a/b?name=orig"
    assert value(spark, S.with_query(lit("https://a/b#f"), "name", "l")) == "https://a/b?name=l#f" and value(spark, S.with_query(lit("https://a/b?x=1#f"), "name", "l")) == "https://a/b?x=1&name=l#f"
    assert value(spark, S.video_key(lit("https://video.twimg.com/ext_tw_video/12/pu/v.mp4"))) == "ext_tw_video/12" and value(spark, S.video_key(lit("https://V.com/a/b"))) == "v.com/a/b"
    assert value(spark, S.video_class(lit("http://a/b.m3u8"), lit("p"))) == "hls" and value(spark, S.video_class(lit("p"), lit("p"))) == "poster"
    assert value(spark, S.estimated_bytes(lit(2_000_000), lit(3_600_000))) == 900_000_000 and value(spark, S.estimated_bytes(lit(0), lit(5))) is None
    assert [value(spark, S.parse_size(lit(x))) for x in ("1.5GB", "500", "2 kb", "-1MB", "x")] == [1_500_000_000, 500_000_000, 2000, None, None]
    assert value(spark, S.format_size(lit(12_340_000))) == "12.3 MB" and value(spark, S.format_size(lit(None).cast("long"))) == "unknown"


def test_numbers_and_statuses(spark):
    assert [value(spark, S.reason_for_status(lit(c))) for c in (404, 403, 451, 500)] == ["not_found", "forbidden", "paywall", None]
    assert value(spark, S.share_pct(lit(1), lit(0))) == 0.0 and value(spark, S.share_pct(lit(1), lit(3))) == 33.3
    assert value(spark, S.growth_pct(lit(0), lit(3))) is None and value(spark, S.grew(lit(4), lit(8))) is False and value(spark, S.grew(lit(5), lit(6))) is True
    assert value(spark, S.parse_network_date(lit("Wed Oct 10 20:19:24 +0000 2018"), lit(None).cast("timestamp"))) == datetime(2018, 10, 10, 20, 19, 24)
    assert value(spark, S.parse_network_date(lit("bad"), lit("2020-01-01").cast("timestamp"))) == datetime(2020, 1, 1)


def test_window_bounds():
    assert P.parse_bound("2024-01-02", True) == datetime(2024, 1, 2, 23, 59, 59, 999999, UTC) and P.parse_bound("2024-01-02T03:04:05", True).hour == 3


SOURCES = "sources array<struct<kind:string,outcome:string,failure_reason:string,text:string,has_speech:boolean>>"


def test_refetch_truth_table(spark):
    ext = lambda outcome, reason=None: ("external_article", outcome, reason, None, None)
    cases = [(None, True), (([],), False), (([ext("failure", "timeout")],), True), (([ext("failure", "timeout"), ext("failure", "not_found")],), False), (([ext("success")],), False), (([("thread", "failure", "timeout", None, None)],), False)]
    frame = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, content struct<{SOURCES.replace(' ', ':', 1)}>")
    assert [r["v"] for r in frame.select("i", P.should_refetch(F.col("content")).alias("v")).orderBy("i").collect()] == [w for _, w in cases]


def test_link_predicates(spark):
    frame = spark.createDataFrame([(0, []), (1, [("https://x.com/a",)]), (2, [("https://x.com/a",), ("http://b.org",)]), (3, None)], "i int, links array<struct<url:string>>")
    assert [r["v"] for r in frame.select("i", P.fetch_candidate(F.col("links")).alias("v")).orderBy("i").collect()] == [False, False, True, False]
    assert value(spark, P.unsafe_path(lit("a\\..\\b"))) and value(spark, P.unsafe_path(lit("/a"))) and not value(spark, P.unsafe_path(lit("a/..b")))
    assert value(spark, P.size_gate(lit(None).cast("long"), 5)) == "size_unknown" and value(spark, P.size_gate(lit(9), 5)) == "too_large" and value(spark, P.size_gate(lit(9), None)) is None
    assert value(spark, P.video_bytes(lit("video/mp4"), lit(b"<html>"))) is False and value(spark, P.video_bytes(lit(""), lit(b"\x00\x00\x00\x18ftypisom"))) is True
    with pytest.raises(ValueError):
        P.in_scope(lit("bookmark"), "nothing")


def test_relational_operators(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, seq int, v string")
    assert {(r["k"], r["v"]) for r in R.first_seen(rows, ["k"], [F.col("seq")]).collect()} == {("a", "y"), ("b", "z")}
    once = R.insert_if_absent(rows.limit(0), rows, "k", [F.col("seq")])
    assert R.insert_if_absent(once, rows, "k", [F.col("seq")]).count() == once.count() == 2
    numbers = spark.range(100).select(F.col("id"), F.floor(F.col("id") / 10).alias("part"))
    cut = R.budget_prefix(numbers, F.col("id") % 3 == 0, [F.col("id")], 5, "part")
    assert sorted(r["id"] for r in cut.collect()) == list(range(13)) and cut.filter("taken").count() == 5
    assert sorted(r["count"] for r in R.batches(numbers, [F.col("id")], 30, "part").groupBy("batch").count().collect()) == [10, 30, 30, 30]
    assert sorted(r["id"] for r in R.evenly(numbers, [], [F.col("id")], 4).collect()) == [0, 33, 66, 99]


def test_migration_and_quarantine(spark):
    rows = [
        {"id": "1", "source": "bookmark", "media": [{"type": "photo", "url": "u"}], "content": {"sources": [{"ok": False, "kind": "thread", "url": "u"}]}},
        {"id": "2", "source": "bookmark", "content": {"sources": [{"kind": "thread", "url": "u"}]}},
        {"id": "3", "source": "elsewhere"},
    ]
    items = spark.read.schema(schema.item_schema()).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    good, bad = schema.split_valid(items)
    first = good.collect()
    assert [r["id"] for r in first] == ["1"] and first[0]["media"][0]["kind"] == "photo_pending" and first[0]["content"]["sources"][0]["failure_reason"] == "unknown_error"
    assert {r["id"]: r["problem"] for r in bad.collect()} == {"2": "source has neither outcome nor ok", "3": "source is unknown"}


def test_diff_edge_cases(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "x"), ("4", "y")], "id string, topic string")
    b = spark.createDataFrame([("1", "y"), ("2", "x"), ("3", "x"), ("5", "x")], "id string, topic string")
    row = diff.items_diff(a, b).first()
    assert (row["in_both"], row["enriched_in_both"], row["reassigned"], row["reassigned_pct"]) == (3, 2, 1, 0.5)
    assert [(r["from_topic"], r["to_topic"], r["n"]) for r in diff.transitions(a, b, 5).collect()] == [(None, "x", 1), ("x", "y", 1)]
    over = diff.overviews_diff(spark.createDataFrame([("s", "one two"), ("t", None)], "slug string, overview string"), spark.createDataFrame([("s", "one two"), ("t", "x y")], "slug string, overview string"))
    assert {r["slug"]: r["flag"] for r in over.collect()} == {"s": "identical", "t": "not_comparable"}
    members = lambda rows: spark.createDataFrame(rows, "slug string, id string")
    found = {r["slug"]: r for r in diff.topics_diff(members([("p", "1"), ("p", "2")]), members([("p", "2"), ("q", "3")])).collect()}
    assert (found["p"]["removed"], found["p"]["unchanged"], found["q"]["added"], found["q"]["growth_pct"]) == (1, 1, 1, None)


def test_topics_and_judgments(spark):
    vocab = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "pos int, slug string")
    items = spark.createDataFrame([("1", 1, "x", ["x", "y", "y"]), ("2", 2, "w", ["w", "x"]), ("3", 3, None, ["y"])], "id string, created_at int, primary_topic string, topics array<string>")
    posts = topics.topic_posts(items, vocab)
    assert sorted((r["slug"], r["role"], r["id"]) for r in posts.collect()) == [("x", "also", "2"), ("x", "primary", "1"), ("y", "also", "1")]
    pages = spark.createDataFrame([("x", 1)], "slug string, post_count_at_synth int")
    assert [r["slug"] for r in topics.topics_needing_synthesis(posts, vocab, pages, 2).collect()] == ["y"] and [r["slug"] for r in topics.topics_needing_synthesis(posts, vocab, pages, 1).collect()] == ["x", "y"]
    judged = spark.createDataFrame([("1", "s", "x", ["x"]), ("2", " ", "q", ["x", "x"]), ("9", "s", "x", ["x"]), ("3", "s", None, None)], schema.JUDGMENT)
    good, bad = topics.attach(items, judged, ["x", "y"])
    errors = {r["item_id"]: r["errors"] for r in bad.collect()}
    assert [r["item_id"] for r in good.collect()] == ["1"] and errors["9"] == ["unknown item"] and errors["3"] == ["topics must be a list"]
    assert errors["2"] == ["summary is missing or empty", "topics has duplicate entries", "primary_topic 'q' is not in the vocabulary", "primary_topic 'q' is not inside topics"]


def test_feed_responses_and_archives(spark, tmp_path):
    def post(i, handle="h", **more):
        return {"tweet_results": {"result": {"rest_id": str(i), "core": {"user_results": {"result": {"legacy": {"screen_name": handle, "name": "N"}}}}, "legacy": {"full_text": f"t{i}"}, **more}}}

    body = {"a": [post(1), {"b": post(2, quoted_status_result=post(3))}, post(4, handle=None), {"tweet_results": {"result": {"__typename": "TweetWithVisibilityResults", "tweet": post(5)["tweet_results"]["result"]}}}]}
    responses = spark.createDataFrame([(0, json.dumps(body)), (1, json.dumps(post(1)))], "seq long, body string")
    assert sorted(r["id"] for r in tables.find_tweets(responses).collect()) == ["1", "2", "5"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data/tweets.js", 'window.YTD.tweets.part0 = [{"tweet": {"id_str": "1", "full_text": "x"}}, {"tweet": {"full_text": "no id"}}]')
    assert [r["id_str"] for r in tables.read_archive(spark, str(tmp_path / "a.zip")).collect()] == ["1"] and tables.count_malformed(spark, str(tmp_path / "a.zip")) == 1
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("other.js", "[]")
    with pytest.raises(Exception, match="the archive has none of"):
        tables.read_archive(spark, str(tmp_path / "b.zip")).collect()
    broken = responses.union(spark.createDataFrame([(7, "{no json"), (8, None)], "seq long, body string"))
    assert tables.find_tweets(broken).count() == 3 and sorted(r["seq"] for r in tables.unreadable(broken).collect()) == [7, 8]
    assert tables.read_items(spark, str(tmp_path / "missing")).count() == 0
    path = tables.write_version(spark.range(3), str(tmp_path / "v"), "test")
    assert spark.read.parquet(path).count() == 3


def test_replayed_feed_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(1, "z")]]):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "v": v, "seq": n}) for i, v in rows))
    ddl = "id long, v string, seq int"
    for _ in range(2):  # a second run finds nothing new
        feed.upsert_into(feed.replay(spark, str(tmp_path / "in"), ddl), str(tmp_path / "out"), "id", ["seq"], str(tmp_path / "cp")).awaitTermination(120)
    rows = {r["id"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1: "a", 2: "b", 3: "d"}


def test_a_feed_that_arrives_in_any_order_gives_the_same_store(spark, tmp_path):
    pages = [[(1, "a"), (2, "b")], [(2, "c"), (3, "d")], [(1, "z")]]
    for turn, order in enumerate([(2, 1, 0), (1, 2, 0), (0, 1, 2)]):
        folder = tmp_path / str(turn)
        (folder / "in").mkdir(parents=True)
        for n in order:
            (folder / "in" / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "v": v, "seq": n}) for i, v in pages[n]))
            os.utime(folder / "in" / f"{n}.json", (order.index(n) + 1e9, order.index(n) + 1e9))
        feed.upsert_into(feed.replay(spark, str(folder / "in"), "id long, v string, seq int"), str(folder / "out"), "id", ["seq"], str(folder / "cp")).awaitTermination(120)
        rows = spark.read.parquet(str(folder / "out")).collect()
        assert len(rows) == 3 and {r["id"]: r["v"] for r in rows} == {1: "a", 2: "b", 3: "d"}


def test_a_hot_group_is_numbered_by_ranges_as_by_a_window(spark, monkeypatch):
    from marginalia.operators import numbering
    from marginalia.operators.relational import evenly, positional_zip

    rows = spark.createDataFrame([("hot" if i % 3 else None if i % 5 else "cold", i * 7919 % 1000, "v") for i in range(600)] + [("hot", 3, "v")] * 5, "g string, x int, _before string").repartition(7)
    run = lambda: sorted(map(tuple, numbering.numbered_in(rows, ["g"], [F.col("x")], "p", "n").select("g", "x", "p", "n").collect()), key=repr)
    even = lambda: sorted(tuple(r) for r in evenly(rows.filter("g is not null"), ["g"], [F.col("x")], 20).select("g", "x").collect())
    zipped = lambda: sorted(tuple(r) for r in positional_zip(rows.filter("g = 'hot'"), rows.filter("g = 'hot'").withColumn("x", F.col("x") + 1), "g", [F.col("x")], [F.col("x")], ["x"]).select("x", "place", "fresh_x").collect())
    before = run(), even(), zipped()
    monkeypatch.setattr(numbering, "HOT_ROWS", 100)
    assert (run(), even(), zipped()) == before and before[0][-1][3] > 100
