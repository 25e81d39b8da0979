
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import predicates as P
from marginalia.functions import scalars as S

#: Limits of what a prompt takes.
ARTICLE_LIMIT, TRANSCRIPT_LIMIT, TOPIC_TRANSCRIPT_LIMIT = 4000, 12000, 2000


#: Where media lie, and the tags of notes and topic pages.
MEDIA_FOLDER, NOTE_TAG, TOPIC_TAG = "_media", "x-knowledge", "x-knowledge-topic"
#: Headings by language.
HEADINGS = {
    "en": {"topics": "Topics", "content": "Content", "summary": "Summary", "primary": "Primary posts", "also": "Also relevant", "digest": "Video digest", "silent": "🔇 Silent video (no speech detected)."},
    "es": {"topics": "Temas", "content": "Contenido", "summary": "Resumen", "primary": "Posts primarios", "also": "También relevante", "digest": "Resumen del vídeo", "silent": "🔇 Vídeo sin voz (sin transcripción)."},
}
#: Why a link has no content.
LINK_REASONS = {
    "not_found": "no encontrado", "forbidden": "acceso denegado", "paywall": "muro de pago", "timeout": "tiempo de espera agotado", "dns_error": "dominio no resuelto",
    "js_required": "requiere JavaScript", "empty_content": "sin contenido extraíble", "unknown_error": "error desconocido",
}
#: Why a picture or video isn't there.
MEDIA_REASONS = {
    "http_4xx": "URL no encontrada (HTTP 4xx)", "http_5xx": "error del servidor (HTTP 5xx)", "timeout": "tiempo de espera agotado", "format_error": "formato no reconocido", "unknown_error": "error desconocido",
}
#: Fixed value: what ends a line.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def _some(text: Column) -> Column:
    """Null if empty."""
    return F.nullif(text, F.lit(""))


def _said(reasons: dict[str, str], reason: Column) -> Column:
    out = reason
    for name, text in reasons.items():
        out = F.when(reason == name, text).otherwise(out)
    return out


def _array(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _none() -> Column:
    return F.array().cast("array<string>")


def split_lines(text: Column) -> Column:
    """The lines of a text, an end of line at its end starting no other; none for an empty one."""
    return F.when(F.coalesce(text, F.lit("")) == "", _none()).otherwise(F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END))


def quoted(text: Column) -> Column:
    """Each line as a quotation of its own, so that none becomes structure of the note."""
    return F.transform(split_lines(text), lambda x: F.concat(F.lit("> "), x))


def topic_refs(topics: Column, style: str = "wikilink") -> Column:
    """(R2)"""
    if style not in ("wikilink", "hashtag"):
        raise ValueError("style must be wikilink or hashtag")
    if style == "wikilink":
        return F.array_join(F.transform(topics, lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), " · ")
    return F.array_join(F.transform(topics, lambda t: F.concat(F.lit("#"), t)), " ")


def tags(topics: Column, folder: Column, fixed: str = NOTE_TAG) -> Column:
    """The fixed tag, the topics and the folder, where there is one."""
    return F.array_distinct(F.array_compact(F.concat(F.array(F.lit(fixed)), F.coalesce(topics, _none()), F.array(F.when(F.coalesce(folder, F.lit("")) != "", S.slug(folder))))))


def _embed(path: Column) -> Column:
    return F.concat(F.lit(f"![[{MEDIA_FOLDER}/"), path, F.lit("]]"))


def media_lines(media: Column) -> Column:
    """The lines of all entries (R3): what is there is shown, a description below it; what failed is named with its reason and address, pending photos are silent."""

    def one(m: Column) -> Column:
        kind = m["kind"]
        failed = lambda what: F.array(F.concat(F.lit(f"> ⚠ {what} ("), _said(MEDIA_REASONS, m["failure_reason"]), F.lit("): <"), m["url"], F.lit(">")))
        return (
            F.when(kind == "photo_described", F.concat(F.array(_embed(m["local_path"])), quoted(m["description"]))).when(kind.isin("photo_downloaded", "video_downloaded"), F.array(_embed(m["local_path"])))
            .when(kind == "photo_failed", failed("Foto no disponible")).when(kind == "video_failed", failed("Vídeo no disponible"))
            .when(kind == "video_pending", F.array(F.concat(F.lit("> 🎥 [Ver vídeo]("), m["url"], F.lit(") (pendiente de descarga)")))).otherwise(_none())
        )

    return F.flatten(F.transform(F.coalesce(media, F.array()), one))


def _heading(label: str, s: Column) -> Column:
    return F.concat(F.lit(f"## {label}: "), F.coalesce(_some(s["title"]), s["url"]))


def _block_lines(b: Column) -> Column:
    """A paragraph, or a picture with its captions."""
    m = b["media"]
    text = F.regexp_replace(b["text"], r"\A\n\n", "")
    described = F.when(m["kind"] == "photo_described", quoted(m["description"])).otherwise(_none())
    picture = (
        F.when(m["kind"].isin("photo_downloaded", "photo_described"), F.concat(F.array(_embed(m["local_path"])), quoted(b["alt"]), described, _array("")))
        .when(m["kind"] == "photo_failed", _array(F.concat(F.lit("> ⚠ Imagen no disponible ("), _said(MEDIA_REASONS, m["failure_reason"]), F.lit("): <"), m["url"], F.lit(">")), "")).otherwise(_none())
    )
    return F.when(b["kind"] == "text", F.when(F.coalesce(text, F.lit("")) != "", _array(text, "")).otherwise(_none())).otherwise(picture)


def _digest_lines(s: Column, names: dict[str, str]) -> Column:
    """What is said in a video, and its slides with their captions."""
    spoken = F.coalesce(s["has_speech"], F.lit(True)) & (F.coalesce(s["text"], F.lit("")) != "")
    frames = F.coalesce(s["frames"], F.array())
    caption = lambda f: F.when(F.coalesce(f["description"], F.lit("")) != "", F.array(F.concat(F.lit("> "), F.array_join(split_lines(f["description"]), " ")))).otherwise(_none())
    slides = F.flatten(F.transform(frames, lambda f: F.concat(F.array(_embed(f["local_path"])), caption(f), _array(""))))
    whole = F.concat(_array(_heading(names["digest"], s), ""), F.when(spoken, _array(s["text"], "")).otherwise(_none()), slides)
    return F.when(~spoken & (F.size(frames) == 0), _array(f"> {names['silent']}", "")).otherwise(whole)


def source_lines(sources: Column, fetched_at: Column, names: dict[str, str] | None = None) -> Column:
    """The lines of all sources (R4, R5): articles as text or as ordered paragraphs and pictures, without a heading where nothing is shown, digests of videos, and broken
    links with the day they were tried; threads and quoted posts that failed are silent."""
    names = names or HEADINGS["en"]

    def one(s: Column) -> Column:
        body = F.flatten(F.transform(F.coalesce(s["blocks"], F.array()), _block_lines))
        blocks = F.when(F.size(body) > 0, F.concat(_array(_heading(names["content"], s), ""), body)).otherwise(_none())
        plain = _array(_heading(names["content"], s), "", F.coalesce(s["text"], F.lit("")), "")
        why = F.array_join(F.array_compact(F.array(F.when(s["http_status"] != 0, F.concat(F.lit("HTTP "), s["http_status"].cast("string"))), _said(LINK_REASONS, s["failure_reason"]))), " · ")
        broken = _array(F.concat(F.lit("> ⚠ Enlace roto: <"), s["url"], F.lit("> — "), F.coalesce(_some(why), F.lit("no se pudo recuperar")), F.lit(" (verificado "), F.coalesce(S.day(fetched_at), F.lit("-")), F.lit(")")), "")
        good = F.when(s["kind"] == "x_video", _digest_lines(s, names)).when((s["kind"] == "x_article") & (F.coalesce(F.size(s["blocks"]), F.lit(0)) > 0), blocks).otherwise(plain)
        return F.when(s["outcome"] == "success", good).when(s["kind"].isin("external_article", "x_article"), broken).otherwise(_none())

    return F.flatten(F.transform(F.coalesce(sources, F.array()), one))


def transition_lines(transitions: DataFrame) -> DataFrame:
    """(place, line) of the changes of topic, the most frequent first."""
    name = lambda c: F.coalesce(c, F.lit("(none)"))
    place = F.row_number().over(W.orderBy(F.desc("n"), F.coalesce("from_topic", F.lit("")), F.coalesce("to_topic", F.lit(""))))  # the few rows of a report
    return transitions.select(place.alias("place"), F.format_string("  %s -> %s: %d", name(F.col("from_topic")), name(F.col("to_topic")), "n").alias("line"))


def video_lines(videos: DataFrame) -> DataFrame:
    """(id, pos, line): a table of videos with columns of fixed width."""
    cell = lambda c, wide: F.rpad(F.coalesce(c, F.lit("-")), wide, " ")
    return videos.select("id", "pos", F.rtrim(F.concat_ws("  ", cell(F.col("id"), 20), cell(F.col("state"), 10), cell(S.format_size(F.col("size_bytes")), 10), S.snippet(F.col("text"), 40))).alias("line"))


def _title(items_text: Column) -> Column:
    titles = F.transform(F.filter(F.coalesce(F.col("content.sources"), F.array()), lambda s: s["outcome"] == "success"), lambda s: s["title"])
    return S.title_of(F.col("id"), items_text, titles)


def notes(items: DataFrame, style: str = "wikilink", language: str = "en") -> DataFrame:
    """(id, path, body) of items that have a note (R1, X2, X3, F16, J20): front matter, title, summary and topics, the post with its media, its links, and what they led to."""
    names, url = HEADINGS[language], F.col("url")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    listed = lambda name, values: F.concat(F.lit(f"{name}: ["), values, F.lit("]"))
    folder = F.when(F.coalesce(F.col("bookmark_folder"), F.lit("")) != "", F.array(field("bookmark_folder", F.col("bookmark_folder")))).otherwise(_none())
    front = F.concat(
        _array("---", F.concat(F.lit('id: "'), F.col("id"), F.lit('"')), field("source", F.col("source")), field("url", F.coalesce(url, F.lit(""))), field("created", S.day(F.col("created_at"))), field("author", F.coalesce(F.col("author.handle"), F.lit(""))),
               listed("domains", S.distinct_domains(F.coalesce(F.col("links"), F.array()))), listed("tags", F.array_join(tags(F.col("enriched.topics"), F.col("bookmark_folder")), ", "))), folder, _array("---", ""),
    )
    summary, refs = _some(F.col("enriched.summary")), _some(topic_refs(F.col("enriched.topics"), style))
    judged = F.concat(F.when(summary.isNotNull(), _array(summary, "")).otherwise(_none()), F.when(refs.isNotNull(), _array(F.concat(F.lit(f"**{names['topics']}:** "), refs), "")).otherwise(_none()))
    media = media_lines(F.col("media"))
    shown = F.when(F.size(media) > 0, F.concat(media, _array(""))).otherwise(_none())
    links = F.when(F.size("links") > 0, F.concat(_array("## Enlaces"), F.transform("links", lambda x: F.concat(F.lit("- <"), x["url"], F.lit(">"))), _array(""))).otherwise(_none())
    lines = F.concat(
        front, _array(F.concat(F.lit("# "), _title(F.col("text"))), ""), judged, _array("## Tweet", "", F.coalesce("text", F.lit("")), ""), shown, links,
        _array(F.concat(F.lit("[Ver tweet original]("), F.coalesce(url, F.lit("")), F.lit(")")), ""), source_lines(F.col("content.sources"), F.col("content.fetched_at"), names),
    )
    body = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)\s+\z", "")
    return _with_path(items, body)


def _with_path(items: DataFrame, body: Column) -> DataFrame:
    path = S.note_filename(F.col("created_at"), S.slug(_title(F.col("text"))), F.col("id"))
    return items.filter(P.has_note(F.col("links"), F.col("media"), F.col("enriched"))).select("id", path.alias("path"), body.alias("body"))


def log_lines(items: DataFrame) -> DataFrame:
    """(created_at, id, line): the chronology, a line a post, with a link to its note where it has one (K8)."""
    stem = F.regexp_replace(S.note_filename(F.col("created_at"), S.slug(_title(F.col("text"))), F.col("id")), r"\.md$", "")
    link = F.when(P.has_note(F.col("links"), F.col("media"), F.col("enriched")), F.concat(F.lit(" → [[items/"), stem, F.lit("|nota]]"))).otherwise("")
    line = F.concat(F.lit("- `"), S.day(F.col("created_at")), F.lit("` @"), F.coalesce(F.col("author.handle"), F.lit("")), F.lit(": "), F.substring(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), 1, 120), link)
    return items.select("created_at", "id", line.alias("line"))


def index_page(items: DataFrame, day: str, language: str = "en", title: str = "Index", dashboard: str = "dashboard/") -> DataFrame:
    """(body): one row with totals and the topics by how many posts name them."""
    names = HEADINGS[language]
    total = items.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "bookmark").alias("bm"), F.count_if(F.col("source") == "own_tweet").alias("own"),
        F.count_if(P.has_note(F.col("links"), F.col("media"), F.col("enriched"))).alias("noted"), F.count_if(F.col("enriched").isNotNull()).alias("enriched"),
    )
    counts = items.select(F.explode("enriched.topics").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "t", "n")))  # a line a topic
    topics = counts.agg(F.transform(order, lambda x: F.concat(F.lit("- [["), x["t"], F.lit("]] ("), x["n"].cast("string"), F.lit(")"))).alias("topics"))
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))
    lines = F.concat(
        _array(f"# {title}", "", f"> Generado: {day}", "", f"## {names['summary']}", "", count("Items totales", "n"), F.concat(F.lit("- Bookmarks: "), F.col("bm").cast("string"), F.lit(" · Tweets propios: "), F.col("own").cast("string")),
               count("Con nota propia", "noted"), count("Enriquecidos", "enriched"), "", "## Índices", "", "- [[log|Log cronológico completo]]", f"- [📊 Dashboard interactivo]({dashboard}) — métricas, drill-down y enlaces (se abre en el navegador)", "", f"## {names['topics']}", ""), F.col("topics"),
    )
    return total.join(topics, F.lit(True)).select(F.array_join(lines, "\n").alias("body"))


def enrichment_prompt(items: DataFrame, vocab: list[str]) -> DataFrame:
    """(id, prompt): vocabulary, author, text, folder, images, transcript, links, articles."""
    section = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:\n"), c))
    sources = F.coalesce(F.col("content.sources"), F.expr("array()"))
    articles = F.array_join(F.transform(P.article_texts(sources), lambda t: F.substring(t, 1, ARTICLE_LIMIT)), "\n\n")
    spoken = F.array_join(F.transform(P.spoken_texts(sources), lambda t: S.truncate_transcript(t, TRANSCRIPT_LIMIT)), "\n\n")
    prompt = F.concat_ws("\n\n", F.lit("topics:\n" + "\n".join(vocab)), section("author", F.col("author.handle")), section("text", F.col("text")), section("folder", F.col("bookmark_folder")), section("images", F.array_join(P.described_images(F.col("media")), "\n")), section("transcript", spoken), section("links", F.array_join(F.transform("links", lambda x: x["url"]), "\n")), section("articles", articles))
    return items.select("id", prompt.alias("prompt"))


def topic_pages(posts: DataFrame, items: DataFrame, pages: DataFrame, vocab: DataFrame, language: str = "en") -> DataFrame:
    """(slug, body) of topics that have posts (R6, O2, J22): front matter, description, overview with a warning where posts came since, notes, posts by role with day, author and note.

    posts: slug, role, id. A page is one file, so the lines of one topic meet in a task.
    """
    names = HEADINGS[language]
    stem = F.regexp_replace(S.note_filename(F.col("created_at"), S.slug(_title(F.col("text"))), F.col("id")), r"\.md$", "")
    title = F.coalesce(_some(F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 80)), F.col("id"))
    line = F.concat(F.lit("- `"), S.day(F.col("created_at")), F.lit("` · @"), F.coalesce(F.col("author.handle"), F.lit("")), F.lit(" · [[items/"), stem, F.lit("|"), title, F.lit("]]"))
    rows = posts.select("slug", "role", "id").join(items.select("id", "created_at", line.alias("line")), "id")
    block = F.array_sort(F.collect_list(F.struct(F.when(F.col("role") == "primary", 0).otherwise(1).alias("r"), (-F.unix_micros("created_at")).alias("t"), "id", "line")))
    listed = rows.groupBy("slug").agg(block.alias("all"))
    of = lambda r: F.transform(F.filter("all", lambda p: p["r"] == r), lambda p: p["line"])
    joined = listed.join(vocab.select("slug", "description"), "slug", "left").join(pages.select("slug", "overview", "notes", "post_count_at_synth"), "slug", "left")
    joined = joined.select("slug", "description", "overview", "notes", "post_count_at_synth", of(0).alias("primary"), of(1).alias("also"))
    n = F.size("primary") + F.size("also")
    number = lambda c: c.cast("string")
    stale = F.when(n > F.col("post_count_at_synth"), _array(F.concat(F.lit("> ⚠ Overview desactualizado: +"), number(n - F.col("post_count_at_synth")), F.lit(" posts desde la última síntesis.")), "")).otherwise(_none())
    notes_ = F.when(F.size("notes") > 0, F.concat(_array("## Notas importantes", ""), F.transform("notes", lambda x: F.concat(F.lit("- "), x)), _array(""))).otherwise(_none())
    about = F.when(F.col("overview").isNull(), _array("*(Overview pendiente.)*", "")).otherwise(F.concat(stale, _array(F.col("overview"), ""), notes_))
    section = lambda name, c: F.when(F.size(c) > 0, F.concat(F.array(F.concat(F.lit(f"## {name} ("), number(F.size(c)), F.lit(")")), F.lit("")), F.col(c), _array(""))).otherwise(_none())
    front = _array("---", F.concat(F.lit("topic: "), "slug"), F.concat(F.lit(f"tags: [{TOPIC_TAG}, "), "slug", F.lit("]")), F.concat(F.lit("posts: "), number(n)), F.concat(F.lit("primary_posts: "), number(F.size("primary"))), "---", "")
    lines = F.concat(front, _array(F.concat(F.lit("# "), "slug"), "", F.concat(F.lit("> "), F.coalesce("description", F.lit(""))), "", "## Overview", ""), about, section(names["primary"], "primary"), section(names["also"], "also"))
    return joined.select("slug", F.regexp_replace(F.array_join(lines, "\n"), r"(?U)\s+\z", "").alias("body"))
