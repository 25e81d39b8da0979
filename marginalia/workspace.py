"""

Every table is a series of versions and a pointer, so a verb reads one version and publishes the next (M14): nothing is overwritten, a
failed verb leaves the old version, a snapshot is a list of pointers, and lists of pointers are numbered and written once.
"""

from __future__ import annotations

import json
import tomllib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia import schema
from marginalia.functions import predicates as P
from marginalia.functions import scalars as S
from marginalia.operators.relational import first_seen, insert_if_absent, known_and_new
from marginalia.plans import dashboard, diff, judgments, render, state, topics
from marginalia.sources import external, files, tables
from marginalia.streaming import outcomes

TABLES = {"items": schema.ITEM, "vocab": schema.VOCAB, "pages": schema.TOPIC_PAGE, "cursors": "source STRING, last_seen_id STRING, last_run TIMESTAMP"}
#: Fixed value: what a topic's slug looks like.
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
LABELS = {"en": {"notes": "My notes", "topics": "Topics"}, "es": {"notes": "Mis notas", "topics": "Temas"}}


@dataclass(frozen=True)
class Settings:
    """(S6) From TOML; unknown names are an error, the rest has defaults."""

    language: str = "en"
    style: str = "wikilink"
    resynth_threshold: int = 5
    description_version: str = "1"
    keep_snapshots: int = 10
    target_topics: int = 30

    @staticmethod
    def parse(text: str) -> Settings:
        """(S6, S5, V7)"""
        found = tomllib.loads(text)
        unknown = set(found) - {f.name for f in fields(Settings)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        settings = Settings(**found)
        labels_for(settings.language)
        return settings


def labels_for(language: str) -> dict[str, str]:
    """(X33)"""
    if language not in LABELS:
        raise ValueError(f"language must be one of {', '.join(LABELS)}")
    return LABELS[language]


@dataclass
class Workspace:
    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)

    # --- storage through Spark's own file systems (S3, S4, K2, K3, K14) ----------------------------------------------------------

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read_text(self, name: str) -> str | None:
        files, path = self._path(name)
        if not files.exists(path):
            return None
        return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(files.open(path), "UTF-8")

    def _write_text(self, name: str, text: str, replace: bool = True) -> None:
        """Written beside, then moved over the old file in one step, or, without replace, only where there is none."""
        jvm = self.spark.sparkContext._jvm
        files, path = self._path(name)
        _, part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        out = files.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if replace else kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(part), files.makeQualified(path), options)
        except Exception:
            files.delete(part, False)
            raise

    def _delete(self, name: str) -> None:
        files, path = self._path(name)
        files.delete(path, True)

    def _generation(self) -> int:
        """The newest list of pointers; 0 before the first."""
        files, path = self._path("pointers")
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max((int(n[:-5]) for n in found if n.endswith(".json")), default=0)

    def pointers(self) -> dict[str, str]:
        n = self._generation()
        return json.loads(self._read_text(f"pointers/{n:012d}.json")) if n else {}

    def _point(self, change: Callable[[dict[str, str]], dict[str, str]]) -> None:
        """The next list of pointers. Lists are numbered and never replaced, so of two writers at once the second gets an error and changes nothing."""
        n = self._generation()
        now = json.loads(self._read_text(f"pointers/{n:012d}.json")) if n else {}
        try:
            self._write_text(f"pointers/{n + 1:012d}.json", json.dumps(change(now), sort_keys=True), replace=False)
        except Exception as e:
            raise RuntimeError("another writer has published since; nothing is changed") from e

    def table(self, name: str) -> DataFrame:
        """The current version; without one an empty table."""
        kind, at = StructType.fromDDL(TABLES[name]), self.pointers().get(name)
        return self.spark.read.schema(kind).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], kind)

    def publish(self, closing: str | None = None, **frames: DataFrame) -> None:
        """New versions of some tables, all visible at once by one pointer file (K1, K2, B24), which also closes an open run of work."""
        stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
        for name, frame in frames.items():
            wanted = StructType.fromDDL(TABLES[name])
            frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted]).write.parquet(f"{self.root}/{name}/{stamp}")
        self._point(lambda now: {n: p for n, p in now.items() if n != closing} | {n: f"{n}/{stamp}" for n in frames})

    def _open_run(self, name: str, due: Callable[[], DataFrame]) -> str:
        """The folder of the open run of this name, with what is due; a new one if none is open."""
        run = self.pointers().get(name)
        if run is None:
            run = f"runs/{uuid.uuid4().hex}"
            due().write.parquet(f"{self.root}/{run}/due")
            self._point(lambda now: now | {name: run})
        return f"{self.root}/{run}"

    # --- snapshots (C18) -------------------------------------------------------------------------------------------------------

    def snapshots(self) -> list[dict]:
        """Newest first (S17, A34). A file each, written once, so that two writers don't lose one another's."""
        files, path = self._path("snapshots")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted((json.loads(self._read_text(f"snapshots/{n}") or "{}") for n in names if n.endswith(".json")), key=lambda s: s["name"], reverse=True)

    def _tables(self) -> dict[str, str]:
        return {n: p for n, p in self.pointers().items() if n in TABLES}

    def snapshot(self, command: str) -> str:
        """Pointers and counts; if it fails, so does the verb that wanted it."""
        name = f"{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%f')[:-3]}-{command}"
        entry = {"name": name, "command": command, "pointers": self._tables(), "counts": {t: self.table(t).count() for t in ("items", "vocab", "pages")}}
        self._write_text(f"snapshots/{name}.json", json.dumps(entry), replace=False)
        return name

    def restore(self, name: str) -> dict[str, str]:
        """What happens to each table: copied, deleted or skipped (K4)."""
        chosen = next((s for s in self.snapshots() if s["name"] == name), None)
        if chosen is None:
            raise ValueError(f"no snapshot {name}")
        then, now = chosen["pointers"], self._tables()
        self._point(lambda all_: {n: p for n, p in all_.items() if n not in TABLES} | then)
        return {t: "copied" if t in then else "deleted" if t in now else "skipped" for t in TABLES}

    def prune(self, keep_last: int) -> list[str]:
        """Forgets all but the newest, and deletes the versions that only those had (K5)."""
        if keep_last < 0:
            raise ValueError("keep_last can't be negative")
        kept, gone = self.snapshots()[:keep_last], self.snapshots()[keep_last:]
        for s in gone:
            self._delete(f"snapshots/{s['name']}.json")
        used = {*self.pointers().values(), *(p for s in kept for p in s["pointers"].values())}
        for path in {p for s in gone for p in s["pointers"].values()} - used:
            self._delete(path)
        return [s["name"] for s in gone]

    # --- capture (C2, C3, C6) --------------------------------------------------------------------------------------------------

    def extract(self, captured: DataFrame, source: str, as_of: Column, complete: bool = True) -> int:
        """Insert-if-absent of captured items, and the cursor if there were any; a truncated capture saves nothing."""
        P.in_scope(F.lit(source), "all")
        if not complete:
            raise RuntimeError("the capture was cut short; nothing is saved")
        store = self.table("items")
        known, fresh = known_and_new(captured, store, "id")
        added = fresh.select("id").distinct().count()
        if added or known.limit(1).count():
            last = captured.agg(F.max(F.col("id").cast("decimal(38,0)")).cast("string").alias("last_seen_id")).select(F.lit(source).alias("source"), "last_seen_id", as_of.alias("last_run"))
            self.publish(items=insert_if_absent(store, captured, "id", [F.col("created_at"), F.col("url")]), cursors=self.table("cursors").filter(F.col("source") != source).unionByName(last))
        return added

    def backfill(self, captured: DataFrame) -> None:
        """As extract, without known ids or cursors (T5)."""
        self.publish(items=insert_if_absent(self.table("items"), captured, "id", [F.col("created_at"), F.col("url")]))

    def import_archive(self, path: str, handle: str, as_of: Column) -> int:
        """(C3, B3, B4)"""
        at = S.parse_network_date(F.col("created_at"), as_of)
        rows = tables.read_archive(self.spark, path).select(F.col("id_str").alias("id"), F.concat(F.lit(f"https://x.com/{handle}/status/"), F.col("id_str")).alias("url"), F.col("full_text").alias("text"), at.alias("created_at"))
        author = F.struct(F.lit(handle).alias("handle"), F.lit(handle).alias("name"))
        known = {"id": F.col("id"), "source": F.lit("own_tweet"), "url": F.col("url"), "author": author, "text": F.col("text"), "created_at": F.col("created_at"), "captured_at": as_of, "media": F.array(), "links": F.array()}
        shape = schema.item_schema()
        return self.extract(rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]), "own_tweet", as_of)

    def refresh_media(self, fresh: DataFrame, force: bool = False) -> dict[str, int]:
        """Pending videos get their streams; nothing seen again on a store that isn't empty is an error (C6, M13, J3, J5). fresh: id, media."""
        items = self.table("items")
        again = first_seen(fresh.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in fresh.columns else fresh, ["id"], [F.col("seq")]).select("id", F.filter("media", lambda m: m["kind"] == "video_pending").alias("fresh"))
        seen, total = items.join(again, "id", "left_semi").count(), items.count()
        if total and not seen and not force:
            raise RuntimeError("none of the items was seen again; is the session still valid?")
        joined = items.join(again, "id", "left")
        media = F.when(F.col("fresh").isNotNull(), state.refresh_videos(F.col("media"), F.col("fresh"))).otherwise(F.col("media"))
        self.snapshot("refresh-media")
        self.publish(items=joined.withColumn("media", media).drop("fresh"))
        return {"seen": seen, "not_seen": total - seen}

    # --- content (C4, C5, C7, C11, C16) ------------------------------------------------------------------------------------------

    def fetch(self, fetcher: state.Fetcher, as_of: Column, force: bool = False) -> None:
        """(C4, B19)"""
        self.publish(items=state.fetch_pending(self.table("items"), fetcher, as_of, force))

    def attach_threads(self, threads: DataFrame, as_of: Column) -> None:
        """(M4, T8) threads: id, text. fetched_at of content that is there already doesn't move."""
        items = self.table("items")
        shape = items.schema["content"].dataType["sources"].dataType.elementType
        known = {"outcome": F.lit("success"), "kind": F.lit("thread"), "url": F.col("url"), "text": F.col("thread_text"), "attempts": F.lit(1)}
        fresh = F.array(F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]))
        made = state.with_sources(F.col("content"), "thread", fresh, as_of, always=True)
        kept = made.withField("fetched_at", F.coalesce(F.col("content.fetched_at"), as_of))
        joined = items.join(threads.select("id", F.col("text").alias("thread_text")), "id", "left")
        self.publish(items=joined.withColumn("content", F.when(F.col("thread_text").isNotNull(), kept).otherwise(F.col("content"))).drop("thread_text"))

    def describe(self, said: DataFrame, as_of: Column) -> DataFrame:
        """Judgments (item_id, index, is_decorative, description) into their photos; returns those without one."""
        items, good = self.table("items"), said.filter("item_id is not null and index >= 0 and is_decorative is not null and (is_decorative or trim(description) <> '')")
        first = first_seen(good, ["item_id", "index"], [F.coalesce("description", F.lit(""))])
        by_item = first.groupBy(F.col("item_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("index", F.struct("is_decorative", "description")))).alias("_said"))
        one = lambda m, i: state.described(m, F.try_element_at(F.col("_said"), i), self.settings.description_version, self.settings.language, as_of)
        joined = items.join(by_item, "id", "left").withColumn("media", F.when(F.col("_said").isNotNull(), F.transform("media", one)).otherwise(F.col("media")))
        photos = items.select(F.col("id").alias("item_id"), F.posexplode("media").alias("index", "m")).filter(F.col("m.kind").isin("photo_downloaded", "photo_described")).select("item_id", "index")
        self.snapshot("describe")
        self.publish(items=joined.drop("_said"))
        return said.join(photos, ["item_id", "index"], "left_anti")

    def describe_worksheet(self, raw: DataFrame, as_of: Column) -> DataFrame:
        """As describe, from the JSON texts of a worksheet's judgments, (pos, raw); returns (pos, item_id, index, errors) of those that aren't applied, each with all its errors."""
        checked = judgments.parsed_judgments(raw)
        good = checked.filter(F.size("errors") == 0)
        lost = self.describe(good.select("item_id", F.col("index").cast("int").alias("index"), "is_decorative", "description"), as_of)
        unmatched = good.join(lost.select("item_id", "index").distinct(), ["item_id", "index"], "left_semi").withColumn("errors", F.array(F.lit("no photo at this address")))
        shown = ["pos", "item_id", "index", "errors"]
        return checked.filter(F.size("errors") > 0).select(*shown).unionByName(unmatched.select(*shown))

    def download(self, get: Callable[[str], dict], as_of: Column, kind: str = "photo", force: bool = False, limit: int | None = None, units_per_file: int = 16, files_per_batch: int = 64) -> DataFrame:
        """Photos or videos that are due, by id and position up to a limit, each URL once (C5, C8, M7, M8, T8, T10). Returns the report.

        get runs on the executors: url -> local_path, bytes_size, width, height, reason (null if all went well). Outcomes are kept as they are made. A run that ends
        before its time stays open: the next call goes on with what was due then, without calling again what has an outcome, and one pointer file puts the outcomes
        into the items and closes the run, so that they count once.
        """
        if kind not in ("photo", "video"):
            raise ValueError("kind must be photo or video")
        eligible = P.photo_eligible if kind == "photo" else P.video_eligible

        def due_now() -> DataFrame:
            rows = self.table("items").select("id", F.posexplode("media").alias("pos", "m")).filter(eligible(F.col("m"), force)).select("id", "pos", F.col("m.url").alias("url"))
            return rows.orderBy("id", "pos").limit(limit) if limit is not None else rows

        run = self._open_run(f"download-{kind}", due_now)
        due = self.spark.read.schema("id string, pos int, url string").parquet(f"{run}/due")
        got = outcomes.run_units(due.withColumn("target", F.col("url")), f"{run}/log", "url", "target", get, "local_path string, bytes_size long, width int, height int, reason string", units_per_file, files_per_batch)
        got = got.withColumn("reason", F.when(F.col("error").isNotNull(), "unknown_error").otherwise(F.col("reason"))).withColumn("ok", F.col("reason").isNull())
        outcome = F.struct("ok", "local_path", "bytes_size", "width", "height", "reason", F.col("error"))
        done = due.join(got, "url").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("url", outcome.alias("outcome"))))).alias("done"))

        def step(m: Column, i: Column) -> Column:
            found = F.try_element_at(F.col("done"), i)
            return F.when(found["url"].eqNullSafe(m["url"]), state.media_outcome(m, found["outcome"], as_of)).otherwise(m)  # the item may have changed since

        joined = self.table("items").join(done, "id", "left")
        self.publish(closing=f"download-{kind}", items=joined.withColumn("media", F.when(F.col("done").isNotNull(), F.transform("media", step)).otherwise(F.col("media"))).drop("done"))
        tried = self.table("items").select("id", F.posexplode("media").alias("pos", "m")).join(due.select("id", "pos"), ["id", "pos"])
        return tried.groupBy(F.col("m.kind").alias("kind"), F.col("m.failure_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))

    # --- judgments (C12, C13, C14) ------------------------------------------------------------------------------------------------

    def pending(self) -> DataFrame:
        """What enrichment would work on."""
        return self.table("items").filter(P.pending_enrichment(F.col("enriched.enriched_at"), F.col("content.fetched_at")))

    def enrich(self, judgments: DataFrame, executor: str, as_of: Column) -> DataFrame:
        """Stores valid judgments and returns the others with their errors."""
        items, slugs = self.table("items"), [r["slug"] for r in self.table("vocab").select("slug").collect()]  # a closed vocabulary is small
        good, bad = topics.attach(items, first_seen(judgments, ["item_id"], [F.coalesce("summary", F.lit(""))]), slugs)
        joined = items.join(good.select(F.col("item_id").alias("id"), F.col("summary").alias("_s"), F.col("primary_topic").alias("_p"), F.col("topics").alias("_t")), "id", "left")
        made = F.struct(as_of.alias("enriched_at"), F.lit(executor).alias("executor"), F.col("_s").alias("summary"), F.col("_p").alias("primary_topic"), F.col("_t").alias("topics"), F.col("enriched.user_notes").alias("user_notes"))
        self.publish(items=joined.withColumn("enriched", F.when(F.col("_p").isNotNull(), made).otherwise(F.col("enriched"))).drop("_s", "_p", "_t"))
        return bad

    def apply_vocabulary(self, entries: DataFrame, regenerate: bool = False) -> None:
        """(pos, slug, description); the first of equal slugs counts, bad ones are an error (C13, V3, J13). regenerate clears judgments."""
        bad = [r["slug"] for r in entries.filter(~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False))).select("slug").limit(5).collect()]
        if bad:
            raise ValueError(f"not a slug: {bad}")
        self.snapshot("vocab")
        fresh = {"vocab": first_seen(entries, ["slug"], [F.col("pos")])}
        if regenerate:
            fresh["items"] = self.table("items").withColumn("enriched", F.lit(None).cast(schema.item_schema()["enriched"].dataType))
        self.publish(**fresh)

    def topic_posts(self) -> DataFrame:
        items = self.table("items").select("id", "created_at", F.col("enriched.primary_topic").alias("primary_topic"), F.col("enriched.topics").alias("topics"))
        return topics.topic_posts(items, self.table("vocab"))

    def topics_due(self, resynth: bool = False) -> DataFrame:
        """(C14, T7)"""
        return topics.topics_needing_synthesis(self.topic_posts(), self.table("vocab"), self.table("pages"), self.settings.resynth_threshold, resynth)

    def synthesize(self, write: Callable[[str, list[str]], dict], as_of: Column, resynth: bool = False) -> None:
        """One call for each topic that is due, on the executors."""
        posts = self.topic_posts().join(self.topics_due(resynth), "slug").join(self.table("items").select("id", F.col("enriched.summary").alias("summary")), "id")
        order = F.array_sort(F.collect_list(F.struct(F.when(F.col("role") == "primary", 0).otherwise(1).alias("r"), (-F.unix_micros("created_at")).alias("t"), "id", "summary")))
        pooled = posts.groupBy("slug").agg(F.to_json(F.transform(order, lambda p: p["summary"])).alias("pool"))

        def run(frames):
            import pandas as pd

            for frame in frames:
                made = [write(s, json.loads(p)) for s, p in zip(frame["slug"], frame["pool"], strict=True)]
                yield pd.DataFrame({"slug": frame["slug"], "overview": [m["overview"] for m in made], "notes": [m["notes"] for m in made]})

        written = pooled.mapInPandas(run, "slug string, overview string, notes array<string>")
        good = written.filter(F.size(topics.overview_errors(F.col("overview"), F.col("notes"), F.array(F.lit("overview"), F.lit("notes")))) == 0)
        totals = self.topic_posts().groupBy("slug").agg(F.count(F.lit(1)).alias("total"))
        self.publish(pages=topics.merge_overviews(self.table("pages"), good.withColumn("seq", F.lit(0)).withColumn("synthesized_at", as_of), totals))

    # --- outputs (C8, C9, C10, C15, C17, C19) --------------------------------------------------------------------------------------

    def status(self) -> DataFrame:
        """(C17)"""
        return self.table("items").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("links") > 0).alias("with_links"), F.count_if(F.col("content").isNotNull()).alias("with_content"), F.count_if(F.col("enriched").isNotNull()).alias("enriched"))

    def videos(self, scope: str = "all", topic: str | None = None, status: str | None = None, cap: int | None = None) -> DataFrame:
        """A row for each video with its state, size and stream."""
        rows = self.table("items").filter(P.in_scope(F.col("source"), scope)).select("id", "url", F.col("enriched.primary_topic").alias("topic"), "text", F.posexplode("media").alias("pos", "m")).filter(F.col("m.kind").startswith("video_"))
        stream = S.video_class(F.col("m.url"), F.col("m.thumbnail_url"))
        size = F.when(F.col("m.kind") == "video_downloaded", F.col("m.bytes_size")).otherwise(S.estimated_bytes(F.col("m.bitrate"), F.col("m.duration_millis")))
        out = rows.select("id", "pos", "url", S.video_state(F.col("m.kind"), stream).alias("state"), "topic", size.alias("size_bytes"), F.when(stream != "poster", F.col("m.url")).alias("mp4_url"), S.snippet(F.col("text")).alias("text"))
        for name, wanted in (("topic", topic), ("state", status)):
            out = out.filter(F.col(name) == wanted) if wanted is not None else out
        return out.filter(P.size_gate(F.col("size_bytes"), cap).isNull()).orderBy("id", "pos")

    def select_videos(self, ids: list[str], topic: str | None = None) -> DataFrame:
        """Named ids first, then a topic's; each once, with why it can't be had."""
        named = self.spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "place int, id string")
        more = self.videos(topic=topic).select(F.lit(len(ids)).alias("place"), "id").distinct() if topic else named.limit(0)
        chosen = named.unionByName(more).groupBy("id").agg(F.min("place").alias("place"))
        videos = self.videos().groupBy("id").agg(F.min_by(F.struct("state", "mp4_url", "size_bytes"), "pos").alias("v"))
        joined = chosen.join(self.table("items").select("id", F.lit(True).alias("known")), "id", "left").join(videos, "id", "left")
        reason = F.when(P.unsafe_id(F.col("id")), "invalid_id").when(F.col("known").isNull(), "unknown_item").when(F.col("v").isNull(), "no_video").when(F.col("v.mp4_url").isNull(), "poster_era").when(F.col("v.mp4_url").contains(".m3u8"), "hls")
        return joined.select("place", "id", reason.alias("reason"), "v.*").orderBy("place", "id")

    def generate(self, out: str) -> dict[str, int]:
        """Notes and topic pages as Markdown files, the index as one, the log as lines of text in order, and the dashboard (C15, K6, K7, K8, J21). Returns how many files were written.

        What the user wrote below the marker of a file stays, also where the file has a new name; the file of the old name goes. `out` is
        a folder that the executors share.
        """
        items, pages, label = self.table("items"), self.table("pages"), labels_for(self.settings.language)
        marker = f"## {label['notes']}"
        language = self.settings.language
        notes = render.notes(items, self.settings.style, language).withColumnRenamed("id", "key")
        counts = {"notes": files.write_markdown(notes, f"{out}/items", marker)}
        topic = render.topic_pages(self.topic_posts(), items, pages, self.table("vocab"), language).select(F.col("slug").alias("key"), F.concat("slug", F.lit(".md")).alias("path"), "body")
        counts["topics"] = files.write_markdown(topic, f"{out}/topics", marker)
        index = render.index_page(items, datetime.now(UTC).date().isoformat(), language)
        files.write_markdown(index.select(F.lit("index").alias("key"), F.lit("index.md").alias("path"), "body"), out, marker)
        # a line a post: files of sorted ranges, which follow one another
        render.log_lines(items).orderBy(F.desc("created_at"), "id").select("line").write.mode("overwrite").text(f"{out}/log")
        self.spark.createDataFrame([(dashboard.dashboard_data(items, pages),)], "value string").write.mode("overwrite").text(f"{out}/dashboard")
        return counts

    def mirror_media(self, out: str) -> int:
        """Downloaded files of photos and videos, copied to where the notes look for them, each once."""
        paths = self.table("items").select(F.explode("media").alias("m")).filter("m.local_path is not null").select(F.col("m.local_path").alias("path")).distinct()
        return files.mirror(paths, out)

    def sync(self, captured: DataFrame, source: str, fetcher: state.Fetcher, get: Callable[[str], dict], judge: Callable[[DataFrame], DataFrame], write: Callable[[str, list[str]], dict], as_of: Column, out: str) -> dict[str, int | str]:
        """All verbs in their order; each step's result, or its error, after which the others still run."""
        steps: list[tuple[str, Callable[[], object]]] = [
            ("extract", lambda: self.extract(captured, source, as_of)),
            ("fetch", lambda: self.fetch(fetcher, as_of)),
            ("media", lambda: self.download(get, as_of).agg(F.sum("n")).first()[0] or 0),
            ("enrich", lambda: self.enrich(judge(self.pending()), "sync", as_of).count()),
            ("topics", lambda: self.synthesize(write, as_of)),
            ("generate", lambda: self.generate(out)["notes"]),
        ]
        done: dict[str, int | str] = {}
        for name, step in steps:
            try:
                done[name] = step() or 0
            except Exception as e:  # the next steps work on what is there
                done[name] = f"{type(e).__name__}: {e}"[:500]
        return done

    def diff(self, before: str, top_n: int = 10) -> dict[str, DataFrame]:
        """The current tables against a snapshot."""
        chosen = next((s for s in self.snapshots() if s["name"] == before), None)
        if chosen is None:
            raise ValueError(f"no snapshot {before}")
        old = lambda t: self.spark.read.schema(StructType.fromDDL(TABLES[t])).parquet(f"{self.root}/{chosen['pointers'][t]}") if t in chosen["pointers"] else self.spark.createDataFrame([], StructType.fromDDL(TABLES[t]))
        topic = lambda d: d.select("id", F.col("enriched.primary_topic").alias("topic"))
        a, b = topic(old("items")), topic(self.table("items"))
        member = lambda d: d.filter("topic is not null").select(F.col("topic").alias("slug"), "id")
        slugs = old("vocab").select("slug").union(self.table("vocab").select("slug"))
        return {"items": diff.items_diff(a, b), "transitions": diff.transitions(a, b, top_n), "topics": diff.topics_diff(member(a), member(b), slugs), "overviews": diff.overviews_diff(old("pages"), self.table("pages"))}
