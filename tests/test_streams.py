"""The feed source, state, change feeds, units of work and the file sink: restarts, batches of any size, writes that fail."""

from __future__ import annotations

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.plans.catalogue import ORACLES, QUERIES
from marginalia.sources import file_sink, files
from marginalia.sources.feed_source import FeedSource, FeedTruncated, scroll
from marginalia.streaming.changes import followed, latest_state
from marginalia.streaming.outcomes import run_units
from marginalia.streaming.thresholds import due_topics
from marginalia.workspace import Workspace
from tests.parity import TABLES, difference
from tests.test_workspace import item, store


def posts(*ids):
    return [{"id": str(i), "body": f"b{i}"} for i in ids]


def to_the_end(stream, out):
    stream.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


# --- feed ----------------------------------------------------------------------------------------------------------------------------


def taken(pages, known=(), **more):
    waits = []
    found = [key for _, _, key, _ in scroll(pages, lambda ids: set(known) & set(ids), waits.append, **more)]
    return found, waits


def test_a_pull_ends_at_the_first_known_post_or_when_nothing_comes():
    pages = [{"page": 0, "items": posts(9, 8)}, {"page": 1, "items": posts(7, 6)}, {"page": 2, "items": posts(5)}]
    assert taken(pages) == (["9", "8", "7", "6", "5"], []) and taken(pages, ["6"]) == (["9", "8", "7"], []) and taken(pages, ["7"])[0] == ["9", "8", "6"]
    idle = [pages[0], *[{"page": 1 + i, "items": []} for i in range(4)], pages[2] | {"page": 9}]
    assert taken(idle)[0] == ["9", "8"] and taken(idle, max_idle=5)[0] == ["9", "8", "5"]


def test_a_pull_waits_within_its_budget_and_is_cut_short_beyond_it():
    page, wait = {"page": 0, "items": posts(1)}, {"page": 0, "status": 429}
    assert taken([wait, wait, page, wait]) == (["1"], [1, 2, 3])
    for bad in ([wait] * 4 + [page], [{"page": 0, "status": 401}], [page, {"page": 1, "status": 403}]):
        with pytest.raises(FeedTruncated):
            taken(bad)


def put(root, pull, feed, pages):
    folder = root / f"pull={pull}" / f"feed={feed}"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join(map(json.dumps, pages)))


def done(root, pull):
    (root / f"pull={pull}" / "_SUCCESS").write_text("")


def test_feed_source_goes_on_where_it_was_and_keeps_nothing_of_a_truncated_pull(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    root = tmp_path / "captured"
    pull = lambda **o: to_the_end(spark.readStream.format("feed").options(path=str(root), waitSeconds="0", **o).load(), str(tmp_path / "out"))
    got = lambda: sorted((r["feed"], r["pull"], int(r["id"])) for r in spark.read.parquet(str(tmp_path / "out/table")).collect())
    put(root, 1, "a", [{"page": 0, "items": posts(3, 2)}, {"page": 1, "status": 429}, {"page": 2, "items": posts(1)}])
    put(root, 1, "b", [{"page": 0, "items": posts(10)}])
    done(root, 1)
    put(root, 2, "a", [{"page": 0, "items": posts(6, 5)}, {"page": 1, "items": posts(4, 3)}, {"page": 2, "items": posts(2, 1)}])
    pull()
    assert got() == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 1, 10)]  # the second pull isn't finished
    done(root, 2)
    pull()
    pull()
    first = got()
    assert first == [("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("a", 2, 4), ("a", 2, 5), ("a", 2, 6), ("b", 1, 10)]
    put(root, 3, "a", [{"page": 0, "items": posts(7)}, *[{"page": 1, "status": 429}] * 4])
    put(root, 3, "b", [{"page": 0, "items": posts(11)}])
    done(root, 3)
    with pytest.raises(Exception, match="rate limit"):
        pull()
    assert got() == first
    (root / "pull=3/feed=a/a.json").write_text(json.dumps({"page": 0, "items": posts(8, 7, 6)}))
    pull()
    assert got() == sorted([*first, ("a", 3, 7), ("a", 3, 8), ("b", 3, 11)])


def test_feed_source_asks_the_store_what_is_known(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    spark.createDataFrame([("2", "x"), ("1", "x")], "id string, text string").write.parquet(str(tmp_path / "store"))
    put(tmp_path / "captured", 1, "a", [{"page": 0, "items": posts(4, 3)}, {"page": 1, "items": posts(2)}, {"page": 2, "items": posts(0)}])
    done(tmp_path / "captured", 1)
    to_the_end(spark.readStream.format("feed").options(path=str(tmp_path / "captured"), known=str(tmp_path / "store")).load(), str(tmp_path / "out"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/table")).collect()) == ["3", "4"]


# --- state ---------------------------------------------------------------------------------------------------------------------------


def brute_due(rows, threshold, start=None):
    state, out = dict(start or {}), []
    for step in sorted({r[1] for r in rows}):
        for slug in sorted({r[0] for r in rows if r[1] == step}):
            total, at, said = state.get(slug, (0, -1, False))
            now = [r for r in rows if r[:2] == (slug, step)]
            total += sum(r[2] for r in now)
            crossing = at + threshold if at >= 0 else 1
            if total >= crossing and not said:
                out.append((slug, step, crossing))
                said = True
            if any(r[3] for r in now):
                at, said = total, False
            state[slug] = (total, at, said)
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [17], [5, 6, 30]])
def test_topics_fall_due_alike_however_the_stream_is_cut(spark, tmp_path, cuts):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(3)}", step, rng.randrange(3), rng.random() < 0.04) for step in range(40) for _ in range(rng.randrange(4))]
    frame = spark.createDataFrame(rows, "slug string, step long, posts int, synthesized boolean")
    pages = spark.createDataFrame([("t0", 10, 8)], "slug string, total long, at_synthesis long")
    for low, high in zip([-1, *cuts], [*cuts, 99], strict=True):
        frame.filter((F.col("step") > low) & (F.col("step") <= high)).write.mode("append").parquet(str(tmp_path / "in"))
        to_the_end(due_topics(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 5, pages), str(tmp_path / "out"))
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out/table")).collect())
    assert found == brute_due(rows, 5, {"t0": (10, 8, False)}) and len(found) >= 3


def test_feed_pull_rounds_seconds_at_the_end_of_a_week_as_its_sql_does(spark, tmp_path):
    end = datetime.fromtimestamp(2818 * 604800, UTC).replace(tzinfo=None)
    at = [end + timedelta(seconds=s) for s in (-86400, -1, -0.500001, -0.5, -0.499999, -0.000001, 0, 0.5, 604799.4, 604799.6)]
    rows = [(i, t, "view") for i, t in enumerate(at)] + [(100 + i, t - timedelta(days=3), "click") for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "sf/events.parquet"))
    for table in set(TABLES) - {"events"}:
        spark.range(1).write.parquet(str(tmp_path / f"sf/{table}.parquet"))
    assert difference(spark, "feed_pull", QUERIES["feed_pull"], ORACLES["feed_pull"], str(tmp_path / "sf")) == ""


# --- two feeds -----------------------------------------------------------------------------------------------------------------------


def test_changes_that_come_late_and_in_any_order_give_what_the_tables_give(spark, tmp_path):
    rng, start = random.Random(7), datetime(2024, 1, 1)
    event = lambda: (rng.randrange(12), start + timedelta(minutes=rng.randrange(5000)))
    fetched, enriched = [event() for _ in range(120)], [event() for _ in range(120)]
    tables = [spark.createDataFrame(rows, f"id long, {name}_at timestamp") for rows, name in ((fetched, "fetched"), (enriched, "enriched"))]
    whole = sorted(tuple(r) for r in latest_state(followed(*tables, 3600, "10 days")).collect())
    assert {r[3] for r in whole} == {True, False}
    streams = []
    for rows, name in ((fetched, "fetched"), (enriched, "enriched")):
        rng.shuffle(rows)
        folder = str(tmp_path / name)
        for part in (rows[:40], rows[40:80], rows[80:], [(-1, start + timedelta(days=60))], [(-1, start + timedelta(days=61))]):
            spark.createDataFrame(part, f"id long, {name}_at timestamp").coalesce(1).write.mode("append").parquet(folder)
        streams.append(spark.readStream.schema(f"id long, {name}_at timestamp").option("maxFilesPerTrigger", 1).parquet(folder))
    to_the_end(followed(*streams, 3600, "10 days"), str(tmp_path / "out"))
    found = latest_state(spark.read.parquet(str(tmp_path / "out/table")).filter("id >= 0"))
    assert sorted(tuple(r) for r in found.collect()) == whole


# --- units of work -------------------------------------------------------------------------------------------------------------------


def counting(folder, broken):
    """Notes each call in a file; ends its process at one unit as long as `broken` is there."""

    def call(url):
        if url.endswith("7") and os.path.exists(broken):
            os._exit(1)
        with open(f"{folder}/{url}", "a") as f:
            f.write("x")
        if url.endswith("3"):
            raise OSError("gone")
        return {"local_path": f"{url}.jpg", "bytes_size": 1}

    return call


def test_a_run_that_is_killed_keeps_its_outcomes_and_does_not_call_again(spark, tmp_path):
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    broken.write_text("")
    work = spark.createDataFrame([(f"u{i:02}", f"u{i:02}") for i in range(40)] + [("u01", "u01"), (None, "x")], "url string, target string")
    run = lambda: run_units(work, str(tmp_path / "log"), "url", "target", counting(str(calls), str(broken)), "local_path string, bytes_size long", units_per_file=4, files_per_batch=2)
    with pytest.raises(Exception):  # noqa: B017
        run()
    before = len(list(calls.iterdir()))
    assert 0 < before < 40
    broken.unlink()
    got = {r["url"]: (r["bytes_size"], r["error"]) for r in run().collect()}
    assert len(got) == 40 and got["u07"] == (1, None) and got["u03"] == (None, "OSError: gone")
    assert {f.name: f.read_text() for f in calls.iterdir()} == {f"u{i:02}": "x" for i in range(40)}
    assert run().count() == 40 and all(f.read_text() == "x" for f in calls.iterdir())


def test_a_large_run_takes_larger_batches_instead_of_more(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("marginalia.streaming.outcomes.MOST_BATCHES", 3, raising=False)
    work = spark.createDataFrame([(f"v{i}", f"v{i}") for i in range(24)], "url string, target string")
    got = run_units(work, str(tmp_path / "log"), "url", "target", lambda u: {"n": len(u)}, "n long", units_per_file=2, files_per_batch=1)
    assert sorted((r["url"], r["n"]) for r in got.collect()) == sorted((f"v{i}", len(f"v{i}")) for i in range(24))
    assert 1 < len(list((tmp_path / "log/outcomes").glob("batch=*"))) <= 3


def test_downloads_go_on_after_a_broken_run_and_count_once(spark, tmp_path):
    at, calls, broken = F.lit("2025-01-01").cast("timestamp"), tmp_path / "calls", tmp_path / "broken"
    calls.mkdir()
    broken.write_text("")
    ws = Workspace(spark, str(tmp_path / "data"))
    ws.backfill(store(spark, [item(i, media=[{"kind": "photo_pending", "url": f"u{i}"}, {"kind": "photo_pending", "url": "shared"}]) for i in range(1, 9)]))
    get = counting(str(calls), str(broken))
    with pytest.raises(Exception):  # noqa: B017
        ws.download(get, at, units_per_file=2, files_per_batch=1)
    assert ws.pointers()["download-photo"].startswith("runs/") and {m["kind"] for r in ws.table("items").collect() for m in r["media"]} == {"photo_pending"}
    name = ws.snapshot("between")
    ws.backfill(store(spark, [item(9, media=[{"kind": "photo_pending", "url": "late"}])]))
    broken.unlink()
    assert {(r["kind"], r["n"]) for r in ws.download(get, at).collect()} == {("photo_downloaded", 15), ("photo_failed", 1)}
    media = {(r["id"], m["url"]): m for r in ws.table("items").collect() for m in r["media"]}
    assert media[("3", "u3")]["attempts"] == 1 and media[("3", "u3")]["failure_reason"] == "unknown_error" and media[("9", "late")]["kind"] == "photo_pending"
    assert all(f.read_text() == "x" for f in calls.iterdir()) and "download-photo" not in ws.pointers()
    ws.restore(name)
    assert "download-photo" not in ws.pointers() and ws.table("items").count() == 8


def test_two_writers_of_snapshots_keep_both(spark, tmp_path):
    a, b = (Workspace(spark, str(tmp_path / "data")) for _ in range(2))
    names = {a.snapshot("one"), b.snapshot("two")}
    assert {s["name"] for s in a.snapshots()} == names and len(a.prune(1)) == 1 and len(b.snapshots()) == 1


# --- files ---------------------------------------------------------------------------------------------------------------------------


def visible(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not str(p.relative_to(folder)).startswith("_") and not p.name.endswith(".crc"))


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    good = spark.createDataFrame([(f"d/{i}.md", f"text {i}") for i in range(20)], "path string, body string")
    with pytest.raises(Exception, match="not a path inside"):
        file_sink.write_files(good.unionByName(spark.createDataFrame([("../x.md", "bad")], "path string, body string")), str(out))
    assert visible(out) == [] and file_sink.publish(spark, str(out)) == 0
    assert file_sink.write_files(good, str(out)) == 20 and len(visible(out)) == 20 and (out / "d/3.md").read_text() == "text 3"
    orphan = out / "_staging" / "lost" / "t"
    orphan.mkdir(parents=True)
    (orphan / "0.part").write_text("x")
    assert file_sink.sweep(spark, str(out)) == 0 and file_sink.sweep(spark, str(out), 0) == 1 and not orphan.exists()


def test_a_write_that_is_broken_off_after_its_commit_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i}.md", f"new {i}", "old.md") for i in range(6)], "path string, body string, old_path string")
    file_sink.write_files(spark.createDataFrame([("old.md", "old")], "path string, body string"), str(out))

    def stop(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(file_sink, "publish", stop)
        with pytest.raises(RuntimeError):
            file_sink.write_files(rows, str(out))
    assert visible(out) == ["old.md"] and file_sink.sweep(spark, str(out), 0) == 0  # decided, so not an orphan
    assert file_sink.publish(spark, str(out)) == 6 and visible(out) == [f"{i}.md" for i in range(6)] and file_sink.publish(spark, str(out)) == 0


def test_mirror_takes_the_first_of_equal_names_and_passes_missing_files_over(spark, tmp_path):
    for folder, text in (("a", "1"), ("b", "22")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jpg").write_text(text)
    paths = spark.createDataFrame([(str(tmp_path / p),) for p in ("b/x.jpg", "a/x.jpg", "a/none.jpg")], "path string")
    assert files.mirror(paths, str(tmp_path / "out")) == 1 and (tmp_path / "out/x.jpg").read_text() == "1"
