
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits that judgments must keep; the wording of the errors below is fixed too.
TOPICS_MIN, TOPICS_MAX, NOTES_MIN, NOTES_MAX = 1, 4, 0, 15


def topic_posts(items: DataFrame, vocab: DataFrame) -> DataFrame:
    """(slug, role, id, created_at): primary under the primary topic, also under the others; only slugs of the vocabulary.

    items: id, created_at, primary_topic, topics. An item without primary topic is under none. The vocabulary side is left to Spark to
    broadcast by its size.
    """
    judged = items.filter(F.coalesce("primary_topic", F.lit("")) != "")
    primary = judged.select(F.col("primary_topic").alias("slug"), F.lit("primary").alias("role"), "id", "created_at")
    also = judged.select(F.explode(F.array_distinct("topics")).alias("slug"), F.lit("also").alias("role"), "id", "created_at", "primary_topic").filter("slug <> primary_topic").drop("primary_topic")
    return primary.unionByName(also).join(vocab.select("slug"), "slug")


def topics_needing_synthesis(posts: DataFrame, vocab: DataFrame, pages: DataFrame, threshold: int, resynth: bool = False) -> DataFrame:
    """(pos, slug) (F17): never an empty topic, always one without a page, else by what has changed."""
    totals = posts.groupBy("slug").agg(F.count(F.lit(1)).alias("total"))
    joined = vocab.join(totals, "slug").join(pages.select("slug", "post_count_at_synth"), "slug", "left")
    delta = F.col("total") - F.col("post_count_at_synth")
    due = (delta != 0) if resynth else (delta >= threshold)
    return joined.filter(F.col("post_count_at_synth").isNull() | due).select("pos", "slug").orderBy("pos")


def merge_overviews(pages: DataFrame, judged: DataFrame, totals: DataFrame) -> DataFrame:
    """Pages with new overviews over old ones, and their post counts (M11). judged: slug, overview, notes, seq; the last wins."""
    last = judged.groupBy("slug").agg(F.max_by(F.struct("overview", "notes", "synthesized_at"), "seq").alias("j"))
    fresh = last.join(totals, "slug", "left").select("slug", "j.overview", "j.notes", "j.synthesized_at", F.coalesce("total", F.lit(0)).cast("int").alias("post_count_at_synth"))
    return pages.join(fresh.select("slug"), "slug", "left_anti").unionByName(fresh.select(*pages.columns))


def _found(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def judgment_errors(summary: Column, primary: Column, topics: Column, keys: Column, vocab: Column) -> Column:
    """All errors of an enrichment judgment, an empty array if it is valid (V1). keys: names that the judgment has; vocab: known slugs."""
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in ("summary", "primary_topic", "topics")])))
    first = F.when(F.size(extra) > 0, F.concat(F.lit("unexpected keys: "), F.array_join(extra, ", ")))
    blank = F.when(F.trim(F.coalesce(summary, F.lit(""))) == "", F.lit("summary is missing or empty"))
    count = F.when(~F.size(topics).between(TOPICS_MIN, TOPICS_MAX), F.format_string(f"topics has %d entries, must be {TOPICS_MIN}-{TOPICS_MAX}", F.size(topics)))
    twice = F.when(F.size(F.array_distinct(topics)) != F.size(topics), F.lit("topics has duplicate entries"))
    unknown = F.transform(F.filter(topics, lambda t: ~F.array_contains(vocab, t)), lambda t: F.concat(F.lit("topic '"), t, F.lit("' is not in the vocabulary")))
    missing = F.coalesce(primary, F.lit("")) == ""
    outside = F.when(~missing & ~F.array_contains(vocab, primary), F.concat(F.lit("primary_topic '"), primary, F.lit("' is not in the vocabulary")))
    elsewhere = F.when(~missing & ~F.array_contains(topics, primary), F.concat(F.lit("primary_topic '"), primary, F.lit("' is not inside topics")))
    listed = F.concat(_found(first, blank, count, twice), unknown, _found(F.when(missing, F.lit("primary_topic is missing")), outside, elsewhere))
    return F.when(topics.isNull(), _found(first, blank, F.lit("topics must be a list"))).otherwise(listed)


def overview_errors(overview: Column, notes: Column, keys: Column) -> Column:
    """(V2)"""
    extra = F.array_sort(F.array_except(keys, F.array(F.lit("overview"), F.lit("notes"))))
    first = F.when(F.size(extra) > 0, F.concat(F.lit("unexpected keys: "), F.array_join(extra, ", ")))
    blank = F.when(F.trim(F.coalesce(overview, F.lit(""))) == "", F.lit("overview must be a non-empty string"))
    count = F.when(~F.size(notes).between(NOTES_MIN, NOTES_MAX), F.format_string(f"notes has %d entries, must be {NOTES_MIN}-{NOTES_MAX}", F.size(notes)))
    link = F.when(F.contains(F.concat(F.coalesce(overview, F.lit("")), F.array_join(notes, " ")), F.lit("[[")), F.lit("overview and notes must not contain a wikilink"))
    return F.when(notes.isNull(), _found(first, blank, F.lit("notes must be a list"))).otherwise(_found(first, blank, count, link))


def attach(items: DataFrame, judgments: DataFrame, vocab: list[str]) -> tuple[DataFrame, DataFrame]:
    """Judgments that may be stored with their items, and those refused with their errors (J8, V4). Unknown ids are refused."""
    known = F.array(*[F.lit(v) for v in vocab])
    keys = F.array(F.lit("summary"), F.lit("primary_topic"), F.lit("topics"))
    joined = judgments.join(items.select(F.col("id").alias("item_id"), F.lit(True).alias("found")), "item_id", "left")
    errors = F.when(F.col("found").isNull(), F.array(F.lit("unknown item"))).otherwise(judgment_errors(F.col("summary"), F.col("primary_topic"), F.col("topics"), keys, known))
    checked = joined.withColumn("errors", errors).drop("found")
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
