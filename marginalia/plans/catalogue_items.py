"""More of the registry: the library's own functions over items made of the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marginalia import schema
from marginalia.functions import predicates as P
from marginalia.functions import scalars as S
from marginalia.operators.relational import before_first_known, positional_zip, replace_kind
from marginalia.plans import dashboard, diff, render, state, topics
from marginalia.plans.registry import read, register
from marginalia.sources import articles, external, tables

# --- items: orders as posts, customers as authors, lines as media ----------------------------------------------------------------------

_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus"
#: What a line of each flag and status stands for.
_KINDS = {"AF": "photo_downloaded", "AO": "photo_pending", "NF": "photo_described", "NO": "video_pending", "RF": "video_downloaded", "RO": "photo_failed"}
_KIND_SQL = "CASE l_returnflag || l_linestatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_ITEMS_SQL = """items AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'bookmark' WHEN 'O' THEN 'own_tweet' END AS source, o_orderdate AS created_at,
  CAST(o_custkey AS VARCHAR) AS handle, c_name AS name, nullif(o_orderpriority, '5-LOW') AS topic, strftime(o_orderdate, '%Y-%m') AS month,
  row_number() OVER (ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS pos FROM orders JOIN customer ON c_custkey = o_custkey)"""
_VIDEO_SQL = f"""v AS (SELECT l_orderkey, {_KIND_SQL} AS kind, CAST(l_quantity AS BIGINT) * 1300 AS duration, CAST(l_partkey AS VARCHAR) AS thumb,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINES}) AS i FROM lineitem)"""


def _kind() -> Column:
    out, flags = F.lit(None).cast("string"), F.concat("l_returnflag", "l_linestatus")
    for flag, kind in _KINDS.items():
        out = F.when(flags == flag, kind).otherwise(out)
    return out


def _posts(spark: SparkSession, sf_dir: str, media: bool = False) -> DataFrame:
    """Items as the dashboard reads them."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    source = F.when(F.col("o_orderstatus") == "F", "bookmark").when(F.col("o_orderstatus") == "O", "own_tweet")
    enriched = F.struct(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("primary_topic"), F.concat(F.lit("about "), "o_orderkey").alias("summary"))
    author = F.struct(F.col("o_custkey").cast("string").alias("handle"), F.col("c_name").alias("name"))
    nothing = F.array().cast("array<struct<url:string,domain:string>>")
    out = orders.select(F.col("o_orderkey").cast("string").alias("id"), source.alias("source"), F.concat(F.lit("https://x.com/p/"), "o_orderkey").alias("url"), F.col("o_orderdate").cast("timestamp").alias("created_at"), author.alias("author"), enriched.alias("enriched"), F.lit("text").alias("text"), nothing.alias("links"), F.lit(None).cast("struct<sources:array<struct<kind:string,outcome:string>>>").alias("content"), "o_orderkey")
    if not media:
        return out.withColumn("media", F.array().cast("array<struct<kind:string,duration_millis:bigint,thumbnail_url:string>>")).drop("o_orderkey")
    entry = F.struct(_kind().alias("kind"), (F.col("l_quantity").cast("long") * 1300).alias("duration_millis"), F.col("l_partkey").cast("string").alias("thumbnail_url"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINES.split(", "), entry.alias("m")))).alias("lines"))  # the media of one post
    joined = out.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.withColumn("media", F.coalesce(F.transform("lines", lambda x: x["m"]), F.array())).drop("o_orderkey", "l_orderkey", "lines")


@register(f"WITH {_ITEMS_SQL}" + """
SELECT month, new_total, CAST(sum(new_total) OVER w AS BIGINT) AS cum_total, CAST(sum(bm) OVER w AS BIGINT) AS cum_bm, CAST(sum(own) OVER w AS BIGINT) AS cum_own
FROM (SELECT month, count(*) AS new_total, count(*) FILTER (source = 'bookmark') AS bm, count(*) FILTER (source = 'own_tweet') AS own FROM items GROUP BY 1) WINDOW w AS (ORDER BY month ROWS UNBOUNDED PRECEDING)
""")
def growth_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by month; one row a month, so the ordered window is small."""
    return dashboard.growth(dashboard.narrow(_posts(spark, sf_dir)))


def _overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = read(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderpriority").alias("slug")).distinct()
    return slugs.withColumn("overview", F.concat(F.lit("all about "), "slug"))


_LABEL_SQL = "array_to_string(list_transform(string_split({0}, '-'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@register(f"""WITH {_ITEMS_SQL}
SELECT topic, {_LABEL_SQL.format('topic')} AS label, count(*) AS n, CASE WHEN topic <> '1-URGENT' THEN 'all about ' || topic END AS overview FROM items WHERE topic IS NOT NULL GROUP BY topic
""")
def topic_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of the dashboard with their overviews."""
    return dashboard.topic_section(dashboard.narrow(_posts(spark, sf_dir)), _overviews(spark, sf_dir)).select(F.col("slug").alias("topic"), "label", "n", "overview")


@register(f"""WITH {_ITEMS_SQL}
SELECT topic, id, rank, 'about ' || id AS summary FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created_at DESC, id) AS rank FROM items WHERE topic IS NOT NULL) WHERE rank <= 5
""")
def topic_recent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest posts of each topic."""
    section = dashboard.topic_section(dashboard.narrow(_posts(spark, sf_dir)), _overviews(spark, sf_dir))
    return section.select(F.col("slug").alias("topic"), F.explode("samples").alias("s")).select("topic", "s.id", F.col("s.rank").cast("long").alias("rank"), "s.summary")


@register(f"""WITH {_ITEMS_SQL}, t AS (SELECT handle, count(*) AS n, arg_min(name, pos) AS name, min(pos) AS first FROM items WHERE source = 'bookmark' GROUP BY 1 ORDER BY n DESC, first LIMIT 10),
s AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY pos) AS rank FROM items WHERE source = 'bookmark'), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS place FROM t)
SELECT p.place, p.handle, p.name, p.n, s.rank, s.id FROM p JOIN s USING (handle) WHERE s.rank <= 8
""")
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most bookmarked authors and their newest posts; ties by the first post."""
    section = _placed(dashboard.author_section(dashboard.narrow(_posts(spark, sf_dir))))
    return section.select("place", "handle", "name", "n", F.explode("samples").alias("s")).select("place", "handle", "name", "n", F.col("s.rank").cast("long").alias("rank"), "s.id")


def _placed(section: DataFrame) -> DataFrame:
    """The order of a top list as a column."""
    rows = section.collect()  # a top list
    return section.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], StructType([StructField("place", LongType()), *section.schema.fields]))


_PAGE_POSTS_SQL = """p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, epoch_ms(1700000000000 + (page_id * 37 % 500) * 3600000) AS created_at, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
l AS (SELECT page_id, id, created_at, u.domain, u.place FROM p, LATERAL (SELECT unnest(CASE WHEN page_id % 4 = 0 THEN ['x.com', host, host] WHEN page_id % 4 = 1 THEN [host || '.' || page_id % 7, host] ELSE [host] END) AS domain,
  unnest([0, 1, 2][1:CASE WHEN page_id % 4 = 0 THEN 3 WHEN page_id % 4 = 1 THEN 2 ELSE 1 END]) AS place) u),
o AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id, place) AS pos FROM l WHERE domain <> 'x.com')"""


def _page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as posts of the same hours with several links."""
    host, k = S.host(F.col("url")), F.col("page_id") % 4
    link = lambda d: F.struct(F.lit("u").alias("url"), d.alias("domain"))
    links = F.when(k == 0, F.array(link(F.lit("x.com")), link(host), link(host))).when(k == 1, F.array(link(F.concat_ws(".", host, (F.col("page_id") % 7).cast("string"))), link(host))).otherwise(F.array(link(host)))
    at = F.timestamp_millis(F.lit(1700000000000) + (F.col("page_id") * 37 % 500) * 3600000)
    source = F.struct(F.when(F.col("page_id") % 3 == 0, "external_article").when(F.col("page_id") % 3 == 1, "x_article").otherwise("thread").alias("kind"), F.when(F.col("page_id") % 5 == 0, "failure").otherwise("success").alias("outcome"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), "page_id")).otherwise("").alias("title"), F.col("url").alias("url"))
    return read(spark, sf_dir, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("id"), F.lit("bookmark").alias("source"), F.concat(F.lit("post/"), "page_id").alias("url"), at.alias("created_at"), F.struct(host.alias("handle"), host.alias("name")).alias("author"), F.struct(F.lit(None).cast("string").alias("primary_topic"), F.lit("s").alias("summary")).alias("enriched"),
        F.lit("text").alias("text"), links.alias("links"), F.array().cast("array<struct<kind:string,duration_millis:bigint,thumbnail_url:string>>").alias("media"), F.struct(F.array(source, source).alias("sources")).alias("content"),
    ).drop("page_id")


@register(f"""WITH {_PAGE_POSTS_SQL}, t AS (SELECT domain, count(*) AS n, min(pos) AS first FROM o GROUP BY 1 ORDER BY n DESC, first LIMIT 10), s AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY pos) AS rank FROM o),
p2 AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS place FROM t)
SELECT p2.place, domain, n, rank, id FROM p2 JOIN s USING (domain) WHERE rank <= 7
""")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by domain with their newest posts; ties by the first link."""
    section = _placed(dashboard.domain_section(dashboard.narrow(_page_posts(spark, sf_dir))))
    return section.select("place", "domain", "n", F.explode("samples").alias("s")).select("place", "domain", "n", F.col("s.rank").cast("long").alias("rank"), "s.id")


@register(f"""WITH {_ITEMS_SQL},
c AS (SELECT month, 'topics' AS list, {_LABEL_SQL.format('topic')} AS value, count(*) AS n, min(pos) AS first FROM items WHERE topic IS NOT NULL GROUP BY month, topic UNION ALL SELECT month, 'authors', handle, count(*), min(pos) FROM items WHERE source = 'bookmark' GROUP BY 1, 3
  UNION ALL SELECT month, 'posts', id, 0, pos FROM items)
SELECT month, total, bm, own, list, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY month, list ORDER BY n DESC, first) AS rank FROM c)
JOIN (SELECT month, count(*) AS total, count(*) FILTER (source = 'bookmark') AS bm, count(*) FILTER (source = 'own_tweet') AS own FROM items GROUP BY 1) USING (month) WHERE rank <= 6
""")
def month_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's counts, its top topics and authors, its newest posts."""
    section = dashboard.month_section(dashboard.narrow(_posts(spark, sf_dir)))
    posts = F.transform("samples", lambda s: F.struct(s["rank"].alias("rank"), s["id"].alias("value"), F.lit(0).cast("long").alias("n")))
    tagged = lambda name, column: F.transform(column, lambda x: F.struct(F.lit(name).alias("list"), x["value"].alias("value"), x["n"].alias("n"), x["rank"].cast("long").alias("rank")))
    lists = F.concat(tagged("topics", F.col("top_topics")), tagged("authors", F.col("top_authors")), tagged("posts", posts))
    return section.select("month", F.col("count").alias("total"), "bm", "own", F.explode(lists).alias("x")).select("month", "total", "bm", "own", "x.*")


@register("""
WITH p AS (SELECT page_id, url, epoch_ms(1700000000000 + (page_id * 37 % 500) * 3600000) AS created_at FROM pages WHERE page_id % 3 <> 2 AND page_id % 5 <> 0),
r AS (SELECT *, unnest([0, 1]) AS place FROM p)
SELECT CASE WHEN page_id % 2 = 0 THEN 'T' || page_id ELSE substr(url, 1, 80) END AS title, url, CASE WHEN page_id % 3 = 0 THEN 'External' ELSE 'X Article' END AS source, strftime(created_at, '%Y-%m-%d') AS day, 'post/' || page_id AS post, place
FROM r ORDER BY created_at DESC, CAST(page_id AS VARCHAR), place LIMIT 60
""")
def newest_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest long reads that were captured."""
    found = dashboard.longform_items(dashboard.narrow(_page_posts(spark, sf_dir)))
    return found.select("title", "url", "source", "day", "post", F.col("place").cast("long").alias("place"))


@register(f"""WITH {_ITEMS_SQL}, {_VIDEO_SQL}, k AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id FROM v WHERE kind IN ('photo_downloaded', 'photo_described')),
r AS (SELECT source AS list, id, pos FROM items WHERE source IS NOT NULL UNION ALL SELECT 'photo', id, pos FROM items SEMI JOIN k USING (id))
SELECT * FROM (SELECT list, count(*) OVER (PARTITION BY list) AS n, id, row_number() OVER (PARTITION BY list ORDER BY pos) AS rank FROM r) WHERE rank <= 6
""")
def source_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest bookmarks, own posts and posts with a photo."""
    found = dashboard.post_samples(dashboard.narrow(_posts(spark, sf_dir, media=True)))
    return found.select("list", F.col("count").alias("n"), F.explode("samples").alias("s")).select("list", "n", "s.id", F.col("s.rank").cast("long").alias("rank"))


@register("""
SELECT *, ext_saved + x_saved AS saved, ext_saved + x_saved + ext_failed + x_failed AS total, round_even(CAST((ext_saved + x_saved) / (ext_saved + x_saved + ext_failed + x_failed) * 100 AS DOUBLE), 1) AS saved_pct FROM (
  SELECT count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS ext_saved, count(*) FILTER (l_returnflag = 'A' AND l_linestatus <> 'F') AS ext_failed,
         count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS x_saved, count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'F') AS x_failed FROM lineitem)
""")
def outcome_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured and failed long reads."""
    kind = F.when(F.col("l_returnflag") == "A", "external_article").when(F.col("l_returnflag") == "N", "x_article").otherwise("thread")
    source = F.struct(kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "success").otherwise("failure").alias("outcome"))
    return dashboard.longform(read(spark, sf_dir, "lineitem").select(F.array(source).alias("sources")))


@register(f"""SELECT count(*) FILTER (k IN ('photo_downloaded', 'photo_described')) AS photos_downloaded, count(*) FILTER (k = 'photo_pending') AS photos_pending, count(*) FILTER (k LIKE 'video_%') AS videos
FROM (SELECT {_KIND_SQL} AS k FROM lineitem)""")
def media_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return dashboard.media_counts(read(spark, sf_dir, "lineitem").select(F.array(F.struct(_kind().alias("kind"))).alias("media")))


@register(f"""WITH {_ITEMS_SQL}, {_VIDEO_SQL}, f AS (SELECT l_orderkey, arg_min(duration, i) AS duration, arg_min(thumb, i) AS poster FROM v WHERE kind LIKE 'video_%' GROUP BY 1)
SELECT handle, strftime(created_at, '%Y-%m-%d') AS day, 'about ' || id AS summary, CAST(round_even(duration / 1000.0, 0) AS BIGINT) AS dur, poster, 'https://x.com/p/' || id AS url
FROM items JOIN f ON CAST(l_orderkey AS VARCHAR) = id ORDER BY created_at DESC, id LIMIT 12
""")
def video_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest posts with a video, by their first one."""
    return dashboard.video_section(dashboard.narrow(_posts(spark, sf_dir, media=True)))


@register("""SELECT '{"month":"' || strftime(o_orderdate, '%Y-%m') || '","n":' || count(*) || ',"none":null}' AS value FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')""")
def worksheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with nulls kept."""
    months = read(spark, sf_dir, "orders").groupBy(S.month(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return tables.export_worksheet(months.withColumn("none", F.lit(None).cast("string")), ["month", "n", "none"])


# --- functions -------------------------------------------------------------------------------------------------------------------------


@register(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN substr(text, 1, 200) ELSE source END AS summary, md5(CASE WHEN length(text) > 200 THEN regexp_replace(substr(text, 1, 200), '\s+$', '') || E'\n[… transcript truncated …]' ELSE text END) AS transcript,
  coalesce(CASE WHEN lang <> 'en' THEN source END, nullif(substr(trim(replace(text, E'\n', ' ')), 1, 80), ''), CAST(doc_id AS VARCHAR)) AS title,
  md5(CASE WHEN position('. ' IN text) > 0 THEN substr(text, position('. ' IN text) + 2) WHEN regexp_matches(text, '\S') THEN E'\n\n' || text ELSE 'none' END) AS tail,
  md5(replace(replace(replace(replace(replace(text, '&', '\u0026'), '<', '\u003c'), '>', '\u003e'), chr(8232), '\u2028'), chr(8233), '\u2029')) AS escaped,
  CASE WHEN length(text) > 50 THEN substr(text, 1, 49) || '…' ELSE text END AS error FROM d
""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, X6, X7, X21, X22, X23, W7"""
    rows = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    text, named = F.col("text"), F.when(F.col("lang") == "en", "").otherwise(F.col("source"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select(
        "doc_id", S.summary_or_text(named, text).alias("summary"), md5(S.truncate_transcript(text, 200)).alias("transcript"), S.title_of(F.col("doc_id").cast("string"), text, F.array(F.lit(None).cast("string"), named)).alias("title"),
        md5(S.user_tail(text, ". ", "none")).alias("tail"), md5(S.escape_for_script(text)).alias("escaped"), S.error_text(text, 50).alias("error"),
    )


@register(r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path,
  split_part(url, '#', 1) AS whole, regexp_extract(url, '(?s)(#.*)$', 1) AS fragment FROM pages),
q AS (SELECT *, split_part(whole, '?', 1) AS head, list_filter(string_split(regexp_extract(whole, '\?(.*)$', 1), '&'), lambda x: x <> '') AS parts, regexp_replace(path, '/(en|fr)/', '/ext_tw_video/') AS moved FROM u)
SELECT page_id, host IN ('x.com', 'www.x.com', 'twitter.com', 'www.twitter.com', 'mobile.twitter.com') AS network,
  CASE WHEN moved LIKE '%/ext_tw_video/%' THEN 'ext_tw_video/' || split_part(split_part(moved, '/ext_tw_video/', 2), '/', 1) ELSE host || path END AS video,
  head || '?' || array_to_string(CASE WHEN len(list_filter(parts, lambda x: split_part(x, '=', 1) = 'page')) > 0 THEN list_transform(parts, lambda x: CASE WHEN split_part(x, '=', 1) = 'page' THEN 'page=9' ELSE x END) ELSE list_append(parts, 'page=9') END, '&') || fragment AS paged,
  CASE page_id % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'hls' ELSE 'poster' END AS class, page_id % 3 <> 2 AS stream,
  path LIKE '/%' OR list_contains(string_split(path, '/'), '..') AS unsafe, path LIKE '%/%' OR path IN ('', '.', '..') AS unsafe_id FROM q
""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, F22, F23, X11, X12, X20"""
    rows = read(spark, sf_dir, "pages").select("page_id", "url")
    url, path = F.col("url"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    moved = F.concat(F.lit("https://"), S.host(url), F.regexp_replace(path, "/(en|fr)/", "/ext_tw_video/"))
    kind, poster = F.col("page_id") % 3, F.lit("https://i.example/p.jpg")
    media = F.when(kind == 0, "https://v.example/a.mp4").when(kind == 1, "https://v.example/a.m3u8").otherwise(poster)
    return rows.select(
        "page_id", S.is_network_url(url).alias("network"), S.video_key(moved).alias("video"), S.with_query(url, "page", "9").alias("paged"), S.video_class(media, poster).alias("class"),
        P.real_stream(media, poster).alias("stream"), P.unsafe_path(path).alias("unsafe"), P.unsafe_id(path).alias("unsafe_id"),
    )


@register(f"""
WITH m AS (SELECT {_KIND_SQL} AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_4xx' END AS reason, l_suppkey % 5 = 0 AS poster, l_linenumber AS n, l_suppkey % 2 = 0 AS fine FROM lineitem),
x AS (SELECT kind = 'photo_pending' OR (kind = 'photo_failed' AND coalesce(reason = 'timeout', false)) AS photo, kind = 'video_pending' AND NOT poster AS video,
  CASE kind WHEN 'video_downloaded' THEN 'downloaded' WHEN 'video_failed' THEN 'failed' ELSE CASE WHEN poster THEN 'poster-era' ELSE 'pending' END END AS state,
  CASE WHEN fine THEN split_part(kind, '_', 1) || '_downloaded' ELSE split_part(kind, '_', 1) || '_failed' END AS next, CASE WHEN fine THEN 1 ELSE 3 END AS attempts,
  CASE WHEN n = 1 THEN 'scroll' WHEN n - 1 >= 4 THEN 'abort' ELSE 'backoff' END AS action, CASE n WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'logged_out' WHEN 3 THEN 'logged_out' WHEN 4 THEN 'matched' ELSE 'other' END AS response,
  CASE n WHEN 1 THEN NULL WHEN 2 THEN 'forbidden' WHEN 3 THEN 'forbidden' WHEN 4 THEN 'not_found' WHEN 5 THEN 'not_found' WHEN 6 THEN 'paywall' ELSE 'paywall' END AS why, n IN (2, 3) AS second FROM m)
SELECT *, count(*) AS n FROM x GROUP BY ALL
""")
def media_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each medium and response."""
    n, url = F.col("l_linenumber"), F.concat(F.lit("https://video.twimg.com/"), F.col("l_partkey"), F.lit(".mp4"))
    thumb = F.when(F.col("l_suppkey") % 5 == 0, url).otherwise("t")
    reason = F.when(n % 3 == 0, "timeout").when(n % 3 == 1, "http_4xx")
    given = {"kind": _kind(), "url": url, "thumbnail_url": thumb, "failure_reason": reason, "attempts": F.lit(2)}
    shape = schema.item_schema()["media"].dataType.elementType
    rows = read(spark, sf_dir, "lineitem").select(F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]).alias("m"), n.alias("n"), (F.col("l_suppkey") % 2 == 0).alias("fine"))
    at = F.lit("2024-01-01").cast("timestamp")
    outcome = F.struct(F.col("fine").alias("ok"), F.lit("p").alias("local_path"), F.lit(1).cast("long").alias("bytes_size"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit("timeout").alias("reason"), F.lit("e").alias("error"))
    after = state.media_outcome(F.col("m"), outcome, at)
    code = lambda *codes: F.element_at(F.array(*[F.lit(c) for c in codes]), F.least(F.col("n"), F.lit(len(codes))))
    out = rows.select(
        P.photo_eligible(F.col("m")).alias("photo"), P.video_eligible(F.col("m")).alias("video"), S.video_state(F.col("m.kind"), S.video_class(F.col("m.url"), F.col("m.thumbnail_url"))).alias("state"), after["kind"].alias("next"),
        F.when(F.col("fine"), F.lit(1)).otherwise(after["attempts"]).alias("attempts"), P.rate_limit_action(F.col("n") - 1, F.col("n") - 1, 4).alias("action"),
        P.response_class(F.when(F.col("n") == 4, "http://a/Bookmarks").otherwise("http://a/b"), code(429, 401, 403, 200, 200, 200, 200), "Bookmarks").alias("response"),
        S.reason_for_status(code(200, 401, 403, 404, 410, 402, 451)).alias("why"), P.wants_second_extractor(code("timeout", "js_required", "empty_content", "paywall", "x", "x", "x")).alias("second"),
    )
    return out.groupBy(*out.columns).agg(F.count(F.lit(1)).alias("n"))


@register("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, lang = 'fr' AS has_thread, lang <> 'en' AND lang <> 'fr' AS needs_thread, lang = 'en' AND NOT coalesce(quality = 1, false) AS needs_network, lang <> 'en' AS candidate, coalesce(toxic = 0 AND quality = 1, false) AS fresh,
  CASE WHEN coalesce(quality = 1, false) AND text <> '' THEN 1 ELSE 0 END AS n_articles, CASE WHEN coalesce(toxic = 1, false) AND text <> '' THEN 1 ELSE 0 END AS n_spoken,
  CASE WHEN coalesce(toxic = 0, false) AND source <> 'src0' THEN 1 ELSE 0 END AS n_images, true AS noted FROM d
""")
def source_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates over a document's links, sources and media."""
    rows = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).join(read(spark, sf_dir, "labels"), "doc_id", "left")
    source = lambda kind, ok, speech: F.struct(F.lit(kind).alias("kind"), F.when(ok, "success").otherwise("failure").alias("outcome"), F.lit(None).cast("string").alias("failure_reason"), F.col("text").alias("text"), speech.alias("has_speech"))
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    listed = F.filter(F.array(source("x_article", good, F.lit(None).cast("boolean")), source("x_video", toxic, toxic), source("thread", F.lit(False), F.lit(None).cast("boolean"))), lambda s: ((s["kind"] != "thread") | (F.col("lang") == "fr")) & ((s["kind"] != "x_article") | good))
    content, links = F.struct(listed.alias("sources")), F.array(F.struct(F.when(F.col("lang") == "en", "https://x.com/a").otherwise("https://b.example/a").alias("url")))
    media = F.array(F.struct(F.lit("photo_described").alias("kind"), F.coalesce(F.col("toxic") != 0, F.lit(True)).alias("is_decorative"), F.when(F.col("source") == "src0", "").otherwise("a picture").alias("description")))
    at = F.lit("2024-01-01").cast("timestamp")
    return rows.select(
        "doc_id", P.has_source(content, "thread").alias("has_thread"), P.needs_thread(F.struct((F.col("lang") != "en").alias("is_thread")), content).alias("needs_thread"), P.needs_network_fetch(links, content).alias("needs_network"),
        P.fetch_candidate(links).alias("candidate"), (P.pending_enrichment(at, at + F.expr("INTERVAL 1 DAY")) & P.in_scope(F.when(F.col("toxic") == 0, "bookmark").otherwise("own_tweet"), "bookmarks") & good).alias("fresh"),
        F.size(P.article_texts(content["sources"])).alias("n_articles"), F.size(P.spoken_texts(content["sources"])).alias("n_spoken"), F.size(P.described_images(media)).alias("n_images"), P.has_note(links, media, F.lit(None)).alias("noted"),
    )


@register("""
WITH s AS (SELECT p_partkey, p_size, ['', 'b', 'kb', ' MB', 'GB', 'tb'][1 + p_partkey % 6] AS unit FROM part)
SELECT p_partkey, CASE WHEN p_size > 0 THEN CASE unit WHEN '' THEN p_size * 1000000 WHEN 'b' THEN p_size WHEN 'kb' THEN p_size * 1000 WHEN ' MB' THEN p_size * 1000000 WHEN 'GB' THEN p_size * 1000000000::BIGINT END END AS parsed,
  CASE p_partkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN p_size || ' B' WHEN 2 THEN printf('%.1f KB', CAST(p_size + 1 AS DOUBLE)) ELSE printf('%.1f MB', p_size / 10.0 + 1) END AS formatted,
  CASE WHEN p_partkey % 4 = 0 THEN 'size_unknown' WHEN p_partkey % 4 = 3 AND p_size > 20 THEN 'too_large' END AS gate FROM s
""")
def size_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15, X16, F14, F15"""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "b", "kb", " MB", "GB", "tb")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    number = F.col("p_size").cast("long")
    size = F.when(F.col("p_partkey") % 4 == 1, number).when(F.col("p_partkey") % 4 == 2, (number + 1) * 1000).when(F.col("p_partkey") % 4 == 3, number * 100_000 + 1_000_000)
    return read(spark, sf_dir, "part").select("p_partkey", S.parse_size(F.concat(F.col("p_size"), unit)).alias("parsed"), S.format_size(size).alias("formatted"), P.size_gate(size, 3_000_000).alias("gate"))


@register("""
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day, strftime(ts, '%Y-%m-%d') || '-' || event_type || '-' || event_id || '.md' AS name FROM events
""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date of the network's form, read back."""
    rows = read(spark, sf_dir, "events")
    written = F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    at = S.parse_network_date(written, F.lit(None).cast("timestamp"))
    return rows.select("event_id", F.unix_timestamp(at).alias("at"), F.when(F.col("event_type") != "error", S.day(F.col("ts"))).alias("day"), S.note_filename(F.col("ts"), S.ascii_slug(F.col("event_type")), F.col("event_id").cast("string")).alias("name"))


@register(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN false ELSE true END AS speech, md5(CASE WHEN lang = 'fr' AND trim(text) <> '' THEN trim(text) ELSE 'seg ' || source END) AS said,
  CASE lang WHEN 'en' THEN '# ' WHEN 'fr' THEN '- ' WHEN 'de' THEN '> ' ELSE '' END AS prefix, md5(text || source) AS flat FROM d
""")
def transcript_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as speech, its text, and blocks made flat."""
    rows = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    segments = F.array(F.struct(F.lit(" seg").alias("text")), F.struct(F.lit(" ").alias("text")), F.struct(F.col("source").alias("text")))
    spoken = F.when(F.col("lang") == "fr", F.col("text"))
    blocks = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text")), F.struct(F.lit("image").alias("kind"), F.lit("no").alias("text")), F.struct(F.lit("text").alias("kind"), F.col("source").alias("text")))
    kind = F.when(F.col("lang") == "en", "header-one").when(F.col("lang") == "fr", "unordered-list-item").when(F.col("lang") == "de", "blockquote").otherwise("unstyled")
    md5 = lambda c: F.md5(c.cast("binary"))
    return rows.select("doc_id", S.has_speech(F.when(F.col("lang") == "en", F.lit(False)), spoken, segments).alias("speech"), md5(S.transcript_text(spoken, segments)).alias("said"), S.block_prefix(kind).alias("prefix"), md5(S.flatten_blocks(blocks)).alias("flat"))


# --- judgments, topics and states --------------------------------------------------------------------------------------------------------


@register("""
WITH v AS (SELECT DISTINCT o_orderpriority AS slug FROM orders), t AS (SELECT o_orderpriority AS slug, count(*) AS total, count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS earlier FROM orders GROUP BY 1)
SELECT slug FROM v JOIN t USING (slug) WHERE slug = '5-LOW' OR total - earlier >= 100
""")
def topics_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without a page, or with enough new posts since."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("primary_topic"), F.array("o_orderpriority").alias("topics"))
    vocab = orders.select(F.col("primary_topic").alias("slug")).distinct().withColumn("pos", F.ascii("slug"))
    earlier = orders.filter("primary_topic <> '5-LOW'").groupBy(F.col("primary_topic").alias("slug")).agg(F.count_if(F.col("created_at") < F.lit("2001-01-01").cast("timestamp_ntz")).alias("post_count_at_synth"))
    return topics.topics_needing_synthesis(topics.topic_posts(orders, vocab), vocab, earlier, 100).select("slug")


@register("""
SELECT l.doc_id AS item_id, CASE WHEN d.doc_id IS NULL THEN 'unknown item' WHEN l.toxic = 1 THEN 'summary is missing or empty' ELSE '' END AS errors
FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang <> 'de') d USING (doc_id)
""")
def attached_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments that may be stored, and the others with their errors."""
    items = read(spark, sf_dir, "documents").filter("lang <> 'de'").select(F.col("doc_id").alias("id"))
    judged = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, " ").otherwise("fine").alias("summary"), F.lit("ai").alias("primary_topic"), F.array(F.lit("ai")).alias("topics"))
    good, bad = topics.attach(items, judged, ["ai"])
    return good.select("item_id", F.lit("").alias("errors")).unionByName(bad.select("item_id", F.array_join("errors", "; ").alias("errors")))


@register("""
SELECT doc_id, concat_ws('; ', CASE WHEN lang = 'fr' THEN 'overview must be a non-empty string' END, CASE WHEN source = 'src0' THEN 'notes must be a list' END, CASE WHEN source <> 'src0' AND lang = 'de' THEN 'overview and notes must not contain a wikilink' END) AS errors FROM documents
""")
def overview_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2"""
    notes = F.when(F.col("source") != "src0", F.array(F.when(F.col("lang") == "de", "see [[this]]").otherwise("note")))
    errors = topics.overview_errors(F.when(F.col("lang") == "fr", " ").otherwise("text"), notes, F.array(F.lit("overview"), F.lit("notes")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(errors, "; ").alias("errors"))


@register("""
SELECT doc_id, 'thread, ' || CASE WHEN source = 'src0' THEN '' ELSE 'x_article, ' END || 'external_article' AS kinds, CASE WHEN lang = 'en' THEN '2024-01-01' ELSE '2025-01-01' END AS moved FROM documents
""")
def replaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of source replaced; the date moves on material change only."""
    one = lambda kind, text, tries: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(tries).alias("attempts"), F.lit(None).cast("string").alias("error"))
    old = F.filter(F.array(one("external_article", F.lit("body"), 1), one("thread", F.lit("t"), 1), one("x_article", F.lit("x"), 1)), lambda s: (s["kind"] != "x_article") | (F.col("source") != "src0"))
    content = F.struct(F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"), old.alias("sources"))
    fresh = F.array(one("external_article", F.when(F.col("lang") == "en", "body").otherwise("changed"), 2))
    new = state.with_sources(content, "external_article", fresh, F.lit("2025-01-01").cast("timestamp_ntz"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(replace_kind(old, "external_article", fresh), lambda s: s["kind"]), ", ").alias("kinds"), F.date_format(new["fetched_at"], "yyyy-MM-dd").alias("moved"))


@register(f"""
WITH m AS (SELECT {_KIND_SQL} AS kind, l_linenumber AS n FROM lineitem)
SELECT CASE WHEN kind IN ('photo_downloaded', 'photo_described') AND n <> 1 THEN 'photo_described' ELSE kind END AS kind, CASE WHEN kind IN ('photo_downloaded', 'photo_described') AND n <> 1 THEN CASE WHEN n % 2 = 0 THEN '' ELSE 'seen' END ELSE 'old' END AS description, count(*) AS n FROM m GROUP BY 1, 2
""")
def described_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions by position; a decorative photo has no text."""
    shape = schema.item_schema()["media"].dataType.elementType
    given = {"kind": _kind(), "description": F.lit("old")}
    media = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
    said = F.when(F.col("l_linenumber") != 1, F.struct((F.col("l_linenumber") % 2 == 0).alias("is_decorative"), F.lit("seen").alias("description")))
    after = state.described(media, said, "1", "en", F.lit("2024-01-01").cast("timestamp"))
    return read(spark, sf_dir, "lineitem").select(after["kind"].alias("kind"), after["description"].alias("description")).groupBy("kind", "description").agg(F.count(F.lit(1)).alias("n"))


@register(f"""
WITH {_VIDEO_SQL}, p AS (SELECT *, sum(CASE WHEN kind = 'video_pending' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS k FROM v)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (kind = 'video_pending' AND k = 1) AS refreshed FROM p GROUP BY 1
""")
def refreshed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pending video of a post gets the stream that was found; nothing is dropped."""
    entry = F.struct(_kind().alias("kind"), F.lit("p").alias("url"), F.lit("p").alias("thumbnail_url"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINES.split(", "), entry.alias("m")))).alias("lines"))  # the media of one post
    fresh = F.array(F.struct(F.lit("video_pending").alias("kind"), F.lit("https://video.twimg.com/a.mp4").alias("url"), F.lit("p").alias("thumbnail_url")), F.struct(F.lit("video_pending").alias("kind"), F.lit("q").alias("url"), F.lit("q").alias("thumbnail_url")))
    after = state.refresh_videos(F.transform("lines", lambda x: x["m"]), fresh)
    return lines.select("l_orderkey", F.size(after).cast("long").alias("n"), F.size(F.filter(after, lambda m: m["url"].endswith(".mp4"))).cast("long").alias("refreshed"))


@register(f"""
WITH n AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_LINES}) AS i FROM lineitem),
a AS (SELECT l_orderkey, i FROM n WHERE l_returnflag = 'A'), r AS (SELECT l_orderkey, i FROM n WHERE l_returnflag = 'R')
SELECT a.l_orderkey, count(*) AS frames, count(r.i) AS paired FROM a LEFT JOIN r ON a.l_orderkey = r.l_orderkey AND a.i = r.i GROUP BY 1
""")
def frame_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th frame with the i-th timestamp."""
    rows, order = read(spark, sf_dir, "lineitem"), [F.col(c) for c in _LINES.split(", ")]
    zipped = positional_zip(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), "l_orderkey", order, order, ["l_linenumber"])
    return zipped.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("frames"), F.count("fresh_l_linenumber").alias("paired"))


@register("""
WITH r AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'source is unknown' WHEN lang = 'de' THEN 'failure has no attempts' WHEN source = 'src1' THEN 'source has neither outcome nor ok' END AS problem FROM documents)
SELECT problem, count(*) AS n FROM r GROUP BY 1
""")
def record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older records in today's shape, and what is wrong with those set aside."""
    shape, rows = schema.item_schema(), read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    media, source = shape["media"].dataType.elementType, shape["content"].dataType["sources"].dataType.elementType
    entry = {"type": F.lit("photo"), "kind": F.when(F.col("lang") == "de", "photo_failed")}
    found = {"kind": F.lit("thread"), "ok": F.when(F.col("source") != "src1", F.lit(True))}
    cast = lambda fields, given: F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    given = {"id": F.col("doc_id"), "source": F.when(F.col("lang") == "fr", "feed").otherwise("bookmark"), "media": F.array(cast(media, entry)), "content": F.struct(F.lit(None).cast("timestamp").alias("fetched_at"), F.array(cast(source, found)).alias("sources"))}
    good, bad = schema.split_valid(rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape]))
    return good.select(F.lit(None).cast("string").alias("problem")).unionByName(bad.select("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# --- text made of rows, and what comes from outside ----------------------------------------------------------------------------------------


_NOTE_SQL = r"""n AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS posted, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS topic, c_name AS name, CAST(o_custkey AS VARCHAR) AS handle, o_orderkey % 7 AS v
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts with all kinds of media and sources, by their keys; as JSON, so that whatever isn't named is null."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    v = F.col("o_orderkey") % 7
    text = lambda **fields: F.struct(*[(F.lit(x) if isinstance(x, (str, int, bool)) else x).alias(n) for n, x in fields.items()])
    as_json = lambda *rows: F.concat(F.lit("["), F.concat_ws(", ", *[F.to_json(r) for r in rows]), F.lit("]"))
    photo, failed = text(kind="photo_described", local_path="1/0.jpg", description="A cat\n# no heading\n"), text(kind="photo_failed", url="u", failure_reason="http_4xx")
    media = F.when(v == 1, as_json(photo, failed, text(kind="photo_pending", url="p"))).when(v == 2, as_json(text(kind="video_pending", url="v"), text(kind="video_downloaded", local_path="1/1.mp4"), text(kind="video_failed", url="w", failure_reason="other"))).otherwise(F.lit("[]"))
    article = text(outcome="success", kind="external_article", title="Head", url="u", text="body")
    # arrays of unlike structs have one type in SQL, but not in JSON
    blog = F.concat(F.lit('{"outcome": "success", "kind": "x_article", "url": "blog", "text": "x", "blocks": ['), F.concat_ws(", ", *[F.to_json(x) for x in (text(kind="text", text="\n\nPara"), text(kind="image", alt="Alt", media=text(kind="photo_downloaded", local_path="1/article/0.jpg")), text(kind="image", media=text(kind="photo_pending", url="x")), text(kind="image", media=text(kind="photo_failed", url="y", failure_reason="timeout")))]), F.lit("]}"))
    pending = F.lit('{"outcome": "success", "kind": "x_article", "url": "only", "title": "T", "text": "x", "blocks": [{"kind": "image", "media": {"kind": "photo_pending", "url": "x"}}]}')
    silent, deck = text(outcome="success", kind="x_video", url="vid", text="", has_speech=False), F.lit('{"outcome": "success", "kind": "x_video", "url": "vid", "title": "Deck", "text": "Said", "has_speech": true, "frames": [{"timestamp": 1.0, "local_path": "1/frames/0.png", "description": "One\\nslide"}, {"timestamp": 2.0, "local_path": "1/frames/1.png"}]}')
    broken, thread = text(outcome="failure", kind="external_article", url="gone", http_status=404, failure_reason="not_found"), text(outcome="failure", kind="thread", url="t", failure_reason="timeout")
    listed = lambda *parts: F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]"))
    sources = F.when(v == 1, listed(F.to_json(article))).when(v == 2, listed(F.to_json(broken), F.to_json(thread))).when(v == 3, listed(blog)).when(v == 4, listed(pending)).when(v == 5, listed(F.to_json(silent))).when(v == 6, listed(deck)).otherwise(F.lit("[]"))
    links = F.when(v == 0, F.lit("[]")).otherwise(F.lit('[{"url": "http://b.org/1", "domain": "b.org"}, {"url": "http://a.org", "domain": "a.org"}, {"url": "http://b.org/2", "domain": "b.org"}]'))
    shape = schema.item_schema()
    parsed = lambda name, column: F.from_json(column, shape[name].dataType.simpleString()).alias(name)
    content = F.concat(F.lit('{"fetched_at": "2024-02-03T00:00:00Z", "sources": '), sources, F.lit("}"))
    enriched = F.when(v != 5, F.to_json(F.struct(F.when(v != 4, F.concat(F.lit("Summary "), "o_orderkey")).alias("summary"), F.col("o_orderpriority").alias("primary_topic"), F.array("o_orderpriority", F.lit("extra")).alias("topics"))))
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("bookmark").alias("source"), F.concat(F.lit("https://p/"), "o_orderkey").alias("url"), F.struct(F.col("o_custkey").cast("string").alias("handle"), F.col("c_name").alias("name")).alias("author"),
        F.concat(F.lit("Post of "), "c_name").alias("text"), F.col("o_orderdate").cast("timestamp").alias("created_at"), parsed("media", media), parsed("links", links), parsed("content", content), parsed("enriched", enriched), F.when(v == 3, "Read later").alias("bookmark_folder"), F.col("o_orderpriority").alias("slug"), F.col("o_orderstatus").alias("status"),
    )


@register(rf"""WITH {_NOTE_SQL},
t AS (SELECT *, CASE v WHEN 1 THEN 'Head' WHEN 4 THEN 'T' WHEN 6 THEN 'Deck' ELSE 'Post of ' || name END AS title FROM n)
SELECT id, day || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || id || '.md' AS path,
  md5(rtrim(E'---
id: "' || id || E'"
source: bookmark
url: https://p/' || id || E'
created: ' || day || E'
author: ' || handle || E'
domains: [' || CASE WHEN v = 0 THEN '' ELSE 'a.org, b.org' END || E']
tags: [x-knowledge' || CASE WHEN v <> 5 THEN ', ' || topic || ', extra' ELSE '' END
  || CASE WHEN v = 3 THEN E', read-later]
bookmark_folder: Read later' ELSE ']' END || E'
---

# ' || title || E'

' || CASE WHEN v NOT IN (4, 5) THEN 'Summary ' || id || E'

' ELSE '' END || CASE WHEN v <> 5 THEN '**Topics:** [[' || topic || E']] · [[extra]]

' ELSE '' END
  || E'## Tweet

Post of ' || name || E'

'
  || CASE v WHEN 1 THEN E'![[_media/1/0.jpg]]
> A cat
> # no heading
> ⚠ Foto no disponible (URL no encontrada (HTTP 4xx)): <u>

' WHEN 2 THEN E'> 🎥 [Ver vídeo](v) (pendiente de descarga)
![[_media/1/1.mp4]]
> ⚠ Vídeo no disponible (other): <w>

' ELSE '' END
  || CASE WHEN v = 0 THEN '' ELSE E'## Enlaces
- <http://b.org/1>
- <http://a.org>
- <http://b.org/2>

' END || '[Ver tweet original](https://p/' || id || E')

'
  || CASE v WHEN 1 THEN E'## Content: Head

body' WHEN 2 THEN '> ⚠ Enlace roto: <gone> — HTTP 404 · no encontrado (verificado 2024-02-03)'
     WHEN 3 THEN E'## Content: blog

Para

![[_media/1/article/0.jpg]]
> Alt

> ⚠ Imagen no disponible (tiempo de espera agotado): <y>' WHEN 5 THEN '> 🔇 Silent video (no speech detected).'
     WHEN 6 THEN E'## Video digest: Deck

Said

![[_media/1/frames/0.png]]
> One slide

![[_media/1/frames/1.png]]' ELSE '' END, E'
')) AS body
FROM t""")
def rendered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of posts with all kinds of media and sources."""
    return render.notes(_notes(spark, sf_dir)).select("id", "path", F.md5(F.col("body").cast("binary")).alias("body"))


@register(rf"""WITH {_NOTE_SQL}, p AS (SELECT *, CASE v WHEN 1 THEN 'Head' WHEN 4 THEN 'T' WHEN 6 THEN 'Deck' ELSE 'Post of ' || name END AS title FROM n SEMI JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P') USING (k)),
r AS (SELECT topic AS slug, 0 AS role, * FROM p UNION ALL SELECT 'extra', 1, * FROM p WHERE v = 1),
l AS (SELECT slug, role, count(*) AS n, string_agg('- `' || day || '` · @' || handle || ' · [[items/' || day || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || id || '|Post of ' || name || ']]', E'
' ORDER BY posted DESC, id) AS lines FROM r GROUP BY 1, 2)
SELECT slug, md5(E'---
topic: ' || slug || E'
tags: [x-knowledge-topic, ' || slug || E']
posts: ' || n || E'
primary_posts: ' || CASE WHEN role = 0 THEN n ELSE 0 END || E'
---

# ' || slug || E'

> About ' || slug || E'

## Overview

'
  || CASE WHEN slug = 'extra' THEN E'*(Overview pendiente.)*

' ELSE CASE WHEN n > 2 THEN '> ⚠ Overview desactualizado: +' || (n - 2) || E' posts desde la última síntesis.

' ELSE '' END || 'all about ' || slug || E'

## Notas importantes

- first

' END
  || CASE WHEN role = 0 THEN '## Primary posts (' ELSE '## Also relevant (' END || n || E')

' || lines) AS body FROM l""")
def topic_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic's front matter, overview with its warning, notes and posts."""
    items = _notes(spark, sf_dir).filter("status = 'P'")
    posts = items.select("slug", F.lit("primary").alias("role"), "id").unionByName(items.filter(F.col("id").cast("long") % 7 == 1).select(F.lit("extra").alias("slug"), F.lit("also").alias("role"), "id"))
    slugs = items.select("slug").distinct()
    pages = slugs.select("slug", F.concat(F.lit("all about "), "slug").alias("overview"), F.array(F.lit("first")).alias("notes"), F.lit(2).alias("post_count_at_synth"))
    vocab = posts.select("slug").distinct().select("slug", F.concat(F.lit("About "), "slug").alias("description"))
    return render.topic_pages(posts, items, pages, vocab).select("slug", F.md5(F.col("body").cast("binary")).alias("body"))


@register(rf"""WITH {_NOTE_SQL}, t AS (SELECT topic, count(*) AS n FROM (SELECT topic FROM n WHERE v <> 5 UNION ALL SELECT 'extra' FROM n WHERE v <> 5) GROUP BY 1)
SELECT E'# Index

> Generado: 2024-05-06

## Summary

- Items totales: ' || count(*) || E'
- Bookmarks: ' || count(*) || E' · Tweets propios: 0
- Con nota propia: ' || count(*) || E'
- Enriquecidos: ' || count(*) FILTER (v <> 5)
  || E'

## Índices

- [[log|Log cronológico completo]]
- [📊 Dashboard interactivo](dashboard/) — métricas, drill-down y enlaces (se abre en el navegador)

## Topics

' || (SELECT string_agg('- [[' || topic || ']] (' || n || ')', E'
' ORDER BY n DESC, topic) FROM t) AS body FROM n""")
def index_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with its totals and topics."""
    return render.index_page(_notes(spark, sf_dir), "2024-05-06")


@register(rf"""WITH {_NOTE_SQL}, t AS (SELECT *, CASE v WHEN 1 THEN 'Head' WHEN 4 THEN 'T' WHEN 6 THEN 'Deck' ELSE 'Post of ' || name END AS title FROM n)
SELECT id, '- `' || day || '` @' || handle || ': Post of ' || name || ' → [[items/' || day || '-' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || id || '|nota]]' AS line FROM t""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a line for each post, with its note."""
    return render.log_lines(_notes(spark, sf_dir)).select("id", "line")


@register(r"""
SELECT doc_id AS id, md5(E'topics:\nai\nux\n\nauthor:\n' || source || CASE WHEN coalesce(text, '') <> '' THEN E'\n\ntext:\n' || text ELSE '' END || E'\n\nimages:\na cat\n\ntranscript:\nwords\n\nlinks:\nhttp://a\n\narticles:\n' || substr(repeat(lang, 3000), 1, 4000)) AS prompt FROM documents
""")
def enrichment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about a post."""
    media = F.array(F.struct(F.lit("photo_described").alias("kind"), F.lit(False).alias("is_decorative"), F.lit("a cat").alias("description")))
    one = lambda kind, text: F.struct(F.lit("success").alias("outcome"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(True).alias("has_speech"))
    content = F.struct(F.array(one("x_article", F.repeat("lang", F.lit(3000))), one("x_video", F.lit("words"))).alias("sources"))
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.struct(F.col("source").alias("handle")).alias("author"), "text", F.lit(None).cast("string").alias("bookmark_folder"), media.alias("media"), content.alias("content"), F.array(F.struct(F.lit("http://a").alias("url"))).alias("links"))
    return render.enrichment_prompt(items, ["ai", "ux"]).select("id", F.md5(F.col("prompt").cast("binary")).alias("prompt"))


@register("""
SELECT CAST(doc_id AS VARCHAR) AS id, source AS handle, lang AS name, md5(coalesce(text, '')) AS text, CASE WHEN lang = 'fr' THEN 'q' || doc_id END AS quoted_id, doc_id AS seq FROM documents
""")
def feed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts out of captured responses, quoted ones left out."""
    legacy = F.struct(F.coalesce("text", F.lit("")).alias("full_text"), F.when(F.col("lang") == "fr", F.concat(F.lit("q"), "doc_id")).alias("quoted_status_id_str"))
    user = F.struct(F.struct(F.struct(F.struct(F.col("source").alias("screen_name"), F.col("lang").alias("name")).alias("legacy")).alias("result")).alias("user_results"))
    post = lambda key, *more: F.struct(F.struct(F.struct(key.alias("rest_id"), user.alias("core"), legacy.alias("legacy"), *more).alias("result")).alias("tweet_results"))
    quoted = post(F.concat(F.lit("q"), "doc_id"))
    body = F.to_json(F.struct(F.array(post(F.col("doc_id").cast("string"), quoted.alias("quoted_status_result"))).alias("entries")))
    found = tables.find_tweets(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), body.alias("body")))
    return found.select("id", "handle", "name", F.md5(F.col("text").cast("binary")).alias("text"), "quoted_id", "seq")


@register(r"""
WITH l AS (SELECT doc_id, lang || '-' || source AS id, list_filter(string_split(coalesce(text, ''), E'\n'), lambda x: trim(x) <> '') AS lines FROM documents),
b AS (SELECT id, arg_max(lines, (len(lines), -doc_id)) AS lines FROM l WHERE len(lines) > 0 GROUP BY 1)
SELECT id, len(lines) AS n, md5(array_to_string(lines, E'\n\n')) AS text FROM b
""")
def article_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richest capture of each article, as blocks."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    body = F.to_json(F.struct(F.struct(F.transform(lines, lambda x: F.struct(F.lit("unstyled").alias("type"), x.alias("text"))).alias("blocks")).alias("content_state")))
    captures = read(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", "source").alias("id"), F.col("doc_id").alias("seq"), body.alias("body"))
    return articles.parse_captures(captures).select("id", F.size("blocks").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("text"))


@register("""
SELECT url, CASE WHEN url LIKE '%/de/%' OR url LIKE '%/fr/%' THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN url LIKE '%/de/%' THEN 'timeout' WHEN url LIKE '%/fr/%' THEN 'dns_error' END AS failure_reason,
  CASE WHEN url LIKE '%/de/%' OR url LIKE '%/fr/%' THEN NULL ELSE length(url) END AS n FROM (SELECT DISTINCT url FROM pages)
""")
def fetched_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each URL once, an error staying with its row and named by its kind."""

    def fetch(url: str) -> dict:
        import socket

        if "/de/" in url:
            raise TimeoutError("too slow")
        if "/fr/" in url:
            raise socket.gaierror("no such host")
        return {"outcome": "success", "text": url}

    return state.fetch_urls(read(spark, sf_dir, "pages"), fetch).select("url", "outcome", "failure_reason", F.length("text").cast("long").alias("n"))


@register("""
WITH v AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS video_key FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, video_key, 'said ' || video_key AS text, l_orderkey IS NOT NULL AS has_speech FROM v
""")
def video_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each video transcribed once, for all posts that show it."""
    items = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_partkey").cast("string").alias("video_key"), F.col("l_partkey").cast("string").alias("url"))
    return external.digest_videos(items, lambda url: {"text": f"said {url}", "language": "en", "has_speech": True}).select("id", "video_key", "text", "has_speech")


@register("""SELECT DISTINCT unnest(list_filter(string_split(lower(text), ' '), lambda w: regexp_matches(w, '^[a-z]{6,}$'))) AS slug FROM benchmark""")
def induced_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every chunk of posts, consolidated."""

    def propose(texts: list[str]) -> list[str]:
        return sorted({w for t in texts for w in t.lower().split(" ") if len(w) >= 6 and w.isascii() and w.isalpha()})

    return external.induce_vocabulary(read(spark, sf_dir, "benchmark"), propose, sorted, most=50)


@register("""SELECT count(DISTINCT l_partkey) AS attempted, count(DISTINCT l_partkey) FILTER (l_partkey % 3 <> 0) AS succeeded FROM lineitem""")
def call_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was tried and what went right."""

    def call(argument: str) -> dict:
        if int(argument) % 3 == 0:
            raise OSError("gone")
        return {"text": argument}

    keys = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_partkey").cast("string").alias("argument"))
    return external.report(external.call_each(keys, "l_partkey", "argument", call, "text string"))


# --- reports, pictures and frames -----------------------------------------------------------------------------------------------------------


@register("""SELECT o_orderstatus AS status, CAST(floor(count(*) FILTER (o_orderpriority = '1-URGENT') / CAST(count(*) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS pct FROM orders GROUP BY 1""")
def kpi_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12"""
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("part"), F.count(F.lit(1)).alias("whole"))
    return counts.select("status", S.kpi_pct(F.col("part"), F.col("whole")).alias("pct"))


@register("""
WITH k AS (SELECT source, max(doc_id) AS stop FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1)
SELECT d.doc_id, d.source FROM documents d LEFT JOIN k USING (source) WHERE stop IS NULL OR d.doc_id > stop
""")
def incremental_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed up to its first known id."""
    known = read(spark, sf_dir, "labels").filter("quality = 0")
    return before_first_known(read(spark, sf_dir, "documents").select("doc_id", "source"), known, "doc_id", "source", "doc_id")


@register("""
WITH a AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
c AS (SELECT nullif(a.t, 'error') AS x, nullif(b.t, 'error') AS y, count(*) AS n FROM a JOIN b USING (id) WHERE nullif(a.t, 'error') IS DISTINCT FROM nullif(b.t, 'error') GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY n DESC, coalesce(x, ''), coalesce(y, '')) AS place, '  ' || coalesce(x, '(none)') || ' -> ' || coalesce(y, '(none)') || ': ' || n AS line FROM c
""")
def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of topic as lines of a report."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", "ts", "event_id")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    latest = lambda d: d.groupBy("id").agg(F.nullif(F.max_by("event_type", F.struct("ts", "event_id")), F.lit("error")).alias("topic"))
    lines = render.transition_lines(diff.transitions(latest(events.filter(F.col("ts") < cut)), latest(events.filter(F.col("ts") >= cut)), 1000))
    return lines.withColumn("place", F.col("place").cast("long"))


@register("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS pos, rtrim(rpad(CAST(p_partkey AS VARCHAR), 20, ' ') || '  ' || rpad(coalesce(nullif(p_type, 'ECONOMY'), '-'), 10, ' ') || '  ' || rpad(CASE WHEN p_size % 2 = 0 THEN 'unknown' ELSE p_size || ' B' END, 10, ' ') || '  ' || p_name) AS line FROM part
""")
def video_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13, X16, X5"""
    size = F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("long"))
    return render.video_lines(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("pos"), F.nullif("p_type", F.lit("ECONOMY")).alias("state"), size.alias("size_bytes"), F.col("p_name").alias("text")))


@register("""
WITH i AS (SELECT doc_id AS id, unhex(CASE lang WHEN 'en' THEN 'FFD8FF' WHEN 'fr' THEN '89504E470D0A1A0A' WHEN 'de' THEN '474946383961' ELSE '00' END) || encode(source) AS content, CASE lang WHEN 'en' THEN 'jpeg' WHEN 'fr' THEN 'png' WHEN 'de' THEN 'gif' END AS kind FROM documents)
SELECT id, 0 AS pos, 'data:image/' || kind || ';base64,' || base64(content) AS data FROM i WHERE kind IS NOT NULL ORDER BY id LIMIT 18
""")
def dashboard_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eighteen readable pictures."""
    lang = F.col("lang")
    head = F.when(lang == "en", "FFD8FF").when(lang == "fr", "89504E470D0A1A0A").when(lang == "de", "474946383961").otherwise("00")
    return dashboard.thumbnails(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("pos"), F.concat(F.unhex(head), F.col("source").cast("binary")).alias("content")))


@register("""SELECT p_type AS slug, count(*) AS n FROM part WHERE p_type <> 'ECONOMY' GROUP BY 1 ORDER BY n DESC, slug LIMIT 3""")
def shown_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """economy stands for the catch-all."""
    counts = read(spark, sf_dir, "part").groupBy(F.when(F.col("p_type") == "ECONOMY", "misc").otherwise(F.col("p_type")).alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    return dashboard.shown_topics(counts, 3, True)


@register("""
SELECT doc_id, CASE WHEN lang <> 'es' THEN CASE WHEN lang = 'en' THEN 'said ' || source ELSE 'a b' END END AS text, CASE WHEN lang <> 'es' THEN lang END AS language, CASE WHEN lang <> 'es' THEN lang <> 'de' END AS has_speech, CAST(CASE WHEN lang = 'en' THEN 1.5 ELSE 12.25 END AS DOUBLE) AS second FROM documents
""")
def parsed_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's output and an extractor's log, parsed."""
    spoken, segments = F.when(F.col("lang") == "en", F.concat(F.lit("said "), "source")), F.array(F.struct(F.lit(0.0).alias("start"), F.lit(" a ").alias("text")), F.struct(F.lit(1.0).alias("start"), F.lit("b").alias("text")))
    made = F.to_json(F.struct(spoken.alias("text"), F.col("lang").alias("language"), F.when(F.col("lang") == "de", F.lit(False)).alias("has_speech"), segments.alias("segments")))
    t = S.parse_transcript(F.when(F.col("lang") == "es", F.lit("[1]")).otherwise(made))
    log = F.concat(F.lit("[showinfo] n: 0 pts_time:"), F.when(F.col("lang") == "en", "1.5").otherwise("12.25"), F.lit(" fmt:yuv"))
    frames = S.pair_frames(F.array(F.lit("f.jpg")), S.frame_times(log))
    return read(spark, sf_dir, "documents").select("doc_id", t["text"].alias("text"), t["language"].alias("language"), t["has_speech"].alias("has_speech"), frames[0]["timestamp"].alias("second"))


@register("""
WITH w AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS place FROM lineitem WHERE l_returnflag = 'A'), h AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS place FROM lineitem WHERE l_returnflag = 'N')
SELECT 'copy' AS action, count(*) AS n FROM w ANTI JOIN h USING (id, place) UNION ALL SELECT 'clear', count(*) FROM (SELECT * FROM h SEMI JOIN w USING (id)) x ANTI JOIN w USING (id, place)
""")
def slide_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: slides to copy for each post, and stale ones to clear."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("place"), "l_returnflag")
    path = F.concat_ws("/", F.lit("slides"), "id", F.format_string("%03d.jpg", "place")).alias("path")
    copies, stale = state.slide_copies(lines.filter("l_returnflag = 'A'").select("id", "place", F.lit("f.jpg").alias("local_path")).distinct(), lines.filter("l_returnflag = 'N'").select(path).distinct())
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("action"), "n")
    return count(copies, "copy").unionByName(count(stale, "clear"))
