"""The registry: name -> query over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import predicates, scalars
from marginalia.operators.relational import batches, budget_prefix, evenly, first_seen, insert_if_absent, known_and_new, positional_zip, same_bag
from marginalia.plans import catalogue_items, catalogue_media, catalogue_streams, diff, topics
from marginalia.plans.registry import ORACLES, QUERIES, read, register
from marginalia.streaming import feed

__all__ = ["ORACLES", "QUERIES", "catalogue_items", "catalogue_media", "catalogue_streams"]  # importing the catalogues fills the registry


# --- aggregates and top lists ------------------------------------------------------------------------------------------------------


@register("""SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1""")
def tag_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, O3"""
    return read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT count(*) AS items, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS enriched, count(*) FILTER (n_chars > 0) AS with_content, count(*) FILTER (lang = 'en') AS english FROM documents
""")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A13, F16"""
    labels = read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count_if("labelled").alias("enriched"), F.count_if(F.col("n_chars") > 0).alias("with_content"), F.count_if(F.col("lang") == "en").alias("english"))


_KINDS = "AF AO NF NO RF RO".split()


@register("SELECT " + ", ".join(f"count(*) FILTER (l_returnflag || l_linestatus = '{k}') AS n_{k.lower()}" for k in _KINDS) + " FROM lineitem")
def media_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, A15"""
    kind = F.concat("l_returnflag", "l_linestatus")
    return read(spark, sf_dir, "lineitem").agg(*[F.count_if(kind == k).alias(f"n_{k.lower()}") for k in _KINDS])


@register("""
SELECT l_returnflag || l_linestatus AS kind, count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS before, count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') AS after,
       count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') - count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') AS delta FROM lineitem GROUP BY 1
""")
def state_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    later = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    counts = read(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("kind")).agg(F.count_if(~later).alias("before"), F.count_if(later).alias("after"))
    return counts.withColumn("delta", F.col("after") - F.col("before"))


@register("""SELECT event_type, max(event_id) AS last_seen_id, count(*) AS n FROM events GROUP BY 1""")
def cursor_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29"""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("last_seen_id"), F.count(F.lit(1)).alias("n"))


@register("""SELECT s_nationkey, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1""")
def variant_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest, of equal ones the first."""
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("s_suppkey"))


@register("""
SELECT l_orderkey, arg_max(reason, rank) AS worst FROM (
  SELECT l_orderkey, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'http_4xx' WHEN 'NF' THEN 'unknown_error' WHEN 'RF' THEN 'timeout' ELSE 'http_5xx' END AS reason,
         CASE l_returnflag || l_linestatus WHEN 'AF' THEN 1 WHEN 'NF' THEN 2 WHEN 'RF' THEN 3 ELSE 4 END AS rank FROM lineitem) GROUP BY 1
""")
def severity_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28"""
    kind = F.concat("l_returnflag", "l_linestatus")
    reason = F.when(kind == "AF", "http_4xx").when(kind == "NF", "unknown_error").when(kind == "RF", "timeout").otherwise("http_5xx")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", reason.alias("reason")).groupBy("l_orderkey").agg(F.max_by("reason", scalars.severity(F.col("reason"))).alias("worst"))


@register("""
SELECT count(*) AS eligible, CAST(coalesce(sum(CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS BIGINT) * 1000000 * 4000 // 8000 END), 0) AS BIGINT) AS known_bytes,
       count(*) FILTER (p_size % 10 <> 0) AS known, count(*) FILTER (p_size % 10 = 0) AS unknown FROM part WHERE p_retailprice > 1000
""")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size in tens stands for an unknown bitrate."""
    bitrate = F.when(F.col("p_size") % 10 == 0, F.lit(0).cast("long")).otherwise(F.col("p_size").cast("long") * 1_000_000)
    rows = read(spark, sf_dir, "part").filter("p_retailprice > 1000").select(scalars.estimated_bytes(bitrate, F.lit(4000)).alias("size"))
    return rows.agg(F.count(F.lit(1)).alias("eligible"), F.coalesce(F.sum("size"), F.lit(0)).alias("known_bytes"), F.count("size").alias("known"), F.count_if(F.col("size").isNull()).alias("unknown"))


@register("""
SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS authors, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM pages) AS pages
""")
def kpi_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row from three one-row aggregates."""
    orders = read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("authors"))
    one = F.lit(1).alias("one")
    documents, pages = (read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(t)).select(one, t) for t in ("documents", "pages"))
    return orders.select(one, "orders", "authors").join(documents, "one").join(pages, "one").drop("one")


# --- joins, sets, diffs -----------------------------------------------------------------------------------------------------------


@register("""
SELECT doc_id, source, CASE WHEN lang <> 'fr' THEN 'a' ELSE 'b' END AS origin FROM documents
""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come into a store that has those of the other languages."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    store, new = rows.filter("lang <> 'fr'").drop("lang").withColumn("origin", F.lit("a")), rows.drop("lang").withColumn("origin", F.lit("b"))
    return insert_if_absent(store, new, "doc_id", [F.col("source")])


@register("""
SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS known, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS fresh FROM documents GROUP BY 1
""")
def known_new_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2"""
    known, new = known_and_new(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels"), "doc_id")
    tagged = known.withColumn("k", F.lit(True)).unionByName(new.withColumn("k", F.lit(False)))
    return tagged.groupBy("lang").agg(F.count_if("k").alias("known"), F.count_if(~F.col("k")).alias("fresh"))


@register("""SELECT md5(lower(text)) AS fingerprint, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3"""
    rows = read(spark, sf_dir, "documents").select(F.md5(F.lower("text").cast("binary")).alias("fingerprint"), "doc_id")
    return first_seen(rows, ["fingerprint"], [F.col("doc_id")])


_HALVES = """
WITH a AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS topic FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
b AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS topic FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
j AS (SELECT a.id, nullif(a.topic, 'error') AS topic_a, nullif(b.topic, 'error') AS topic_b FROM a JOIN b USING (id))
"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's latest event before and from a day; error stands for not enriched."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_type", "ts", "event_id")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    latest = lambda d: d.groupBy("id").agg(F.nullif(F.max_by("event_type", F.struct("ts", "event_id")), F.lit("error")).alias("topic"))
    return latest(events.filter(F.col("ts") < cut)), latest(events.filter(F.col("ts") >= cut))


@register(_HALVES + """
SELECT count(*) AS in_both, count(*) FILTER (topic_a IS NOT NULL AND topic_b IS NOT NULL) AS enriched_in_both, count(*) FILTER (topic_a <> topic_b) AS reassigned,
       coalesce(count(*) FILTER (topic_a <> topic_b) / CAST(nullif(count(*) FILTER (topic_a IS NOT NULL AND topic_b IS NOT NULL), 0) AS DOUBLE), 0.0) AS reassigned_pct FROM j
""")
def snapshot_items_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6"""
    return diff.items_diff(*_halves(spark, sf_dir))


@register(_HALVES + """
SELECT topic_a AS from_topic, topic_b AS to_topic, count(*) AS n FROM j WHERE topic_a IS DISTINCT FROM topic_b GROUP BY 1, 2 ORDER BY n DESC, coalesce(from_topic, ''), coalesce(to_topic, '') LIMIT 10
""")
def snapshot_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17, O5"""
    return diff.transitions(*_halves(spark, sf_dir), top_n=10)


@register("""
WITH a AS (SELECT DISTINCT event_type AS slug, user_id AS id FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT DISTINCT event_type AS slug, user_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
j AS (SELECT coalesce(a.slug, b.slug) AS slug, a.id IS NOT NULL AS x, b.id IS NOT NULL AS y FROM a FULL JOIN b ON a.slug = b.slug AND a.id = b.id),
c AS (SELECT slug, count(*) FILTER (x) AS members_a, count(*) FILTER (y) AS members_b, count(*) FILTER (y AND NOT x) AS added, count(*) FILTER (x AND NOT y) AS removed, count(*) FILTER (x AND y) AS unchanged FROM j GROUP BY 1)
SELECT *, (members_b - members_a) / CAST(nullif(members_a, 0) AS DOUBLE) AS growth_pct, members_a >= 5 AND coalesce(abs((members_b - members_a) / CAST(nullif(members_a, 0) AS DOUBLE)) >= 0.10, false) AS flagged_growth FROM c
""")
def topic_membership_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, A14, A20, U1-U4"""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("slug"), F.col("user_id").alias("id"), "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return diff.topics_diff(events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut))


@register("""
SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'removed' WHEN a.source IS NULL THEN 'added' ELSE 'kept' END AS change
FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en') a FULL JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'fr') b ON a.source = b.source
""")
def vocab_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of English and of French documents."""
    rows = read(spark, sf_dir, "documents").select("source", "lang")
    a, b = (rows.filter(F.col("lang") == lang).select("source").distinct().withColumn(name, F.lit(True)) for lang, name in (("en", "a"), ("fr", "b")))
    return a.join(b, "source", "full").select("source", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("kept").alias("change"))


@register(r"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
t AS (SELECT conv_id, turn, side, unnest(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+'), lambda w: length(w) >= 2)) AS token FROM (SELECT conv_id, turn, 'x' AS side, x AS text FROM p UNION ALL SELECT conv_id, turn, 'y', y FROM p)),
n AS (SELECT conv_id, turn, token, count(*) FILTER (side = 'x')::DOUBLE AS x, count(*) FILTER (side = 'y')::DOUBLE AS y FROM t GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, sum(x * y) AS dot, sum(x ** 2) AS xx, sum(y ** 2) AS yy FROM n GROUP BY 1, 2),
c AS (SELECT p.conv_id, p.turn, CASE WHEN coalesce(xx, 0) = 0 OR yy = 0 THEN 0 ELSE dot / sqrt(xx) / sqrt(yy) END AS similarity FROM p LEFT JOIN s USING (conv_id, turn))
SELECT conv_id, turn, round(similarity, 9) AS similarity, CASE WHEN similarity >= 0.99 THEN 'identical' WHEN similarity >= 0.7 THEN 'similar' ELSE 'different' END AS flag FROM c
""")
def overview_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation with the next one."""
    rows, slug = read(spark, sf_dir, "conversations"), lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back).alias("slug")
    found = diff.overviews_diff(rows.select(slug(0), F.col("text").alias("overview")), rows.select(slug(1), F.col("text").alias("overview"))).filter("similarity is not null")
    part = lambda i: F.split_part("slug", F.lit("-"), F.lit(i)).cast("long")
    return found.select(part(1).alias("conv_id"), part(2).alias("turn"), F.round("similarity", 9).alias("similarity"), "flag")


@register(r"""SELECT conv_id, string_agg(text, E'\n\n' ORDER BY turn, text) AS text FROM conversations WHERE role = 'user' GROUP BY 1""")
def thread_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, J18, O7"""
    rows = read(spark, sf_dir, "conversations").filter("role = 'user'")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))  # one thread at a time
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


@register("""SELECT c.conv_id, c.turn, length(c.text) AS n_chars FROM conversations c JOIN (SELECT conv_id, role FROM conversations WHERE turn = 1) a USING (conv_id, role)""")
def linked_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17"""
    rows = read(spark, sf_dir, "conversations")
    anchor = rows.filter("turn = 1").select("conv_id", "role")
    return rows.join(anchor, ["conv_id", "role"]).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


_LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus"
_LINE_ORDER = _LINE.split(", ")


@register(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS i FROM lineitem)
SELECT a.l_orderkey, a.i AS place, coalesce(b.l_extendedprice, a.l_extendedprice) AS price FROM n a LEFT JOIN n b ON b.l_orderkey = a.l_orderkey + 1 AND b.i = a.i AND b.l_returnflag = 'R' WHERE a.l_returnflag = 'A'
""")
def positional_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th line and the i-th line of the next order, which replaces it only if it is a returned one."""
    rows = read(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in _LINE_ORDER]
    fresh = rows.withColumn("l_orderkey", F.col("l_orderkey") - 1)
    zipped = positional_zip(rows, fresh, "l_orderkey", order, order, ["l_extendedprice", "l_returnflag"]).filter("l_returnflag = 'A'")
    price = F.when(F.col("fresh_l_returnflag") == "R", F.col("fresh_l_extendedprice"))
    return zipped.select("l_orderkey", F.col("place").cast("long").alias("place"), F.coalesce(price, F.col("l_extendedprice")).alias("price"))


@register("""
WITH s AS (SELECT l_orderkey, list_sort(list(l_returnflag || l_linestatus)) AS bag FROM lineitem GROUP BY 1)
SELECT a.l_orderkey, a.bag = b.bag AS same FROM s a JOIN s b ON b.l_orderkey = a.l_orderkey + 1
""")
def material_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31"""
    bags = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("bag"))
    following = bags.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("bag").alias("other"))
    return bags.join(following, "l_orderkey").select("l_orderkey", same_bag(F.col("bag"), F.col("other")).alias("same"))


@register("""SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey""")
def id_semi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, U5"""
    chosen = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@register("""
WITH v(slug) AS (SELECT DISTINCT l_returnflag FROM lineitem UNION SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT slug, role, count(*) AS n FROM (
  SELECT o_orderpriority AS slug, 'primary' AS role, o_orderkey FROM orders UNION ALL SELECT DISTINCT l_returnflag, 'also', l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) JOIN v USING (slug) GROUP BY 1, 2
""")
def topic_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, J12"""
    flags = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("topics"))
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("primary_topic")).join(flags, "id", "left")
    vocab = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("slug")).union(read(spark, sf_dir, "orders").filter("o_orderpriority <> '5-LOW'").select("o_orderpriority")).distinct()
    return topics.topic_posts(items, vocab).groupBy("slug", "role").agg(F.count(F.lit(1)).alias("n"))


@register("""
WITH t AS (SELECT o_orderpriority AS slug, count(*) AS total, count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS earlier FROM orders GROUP BY 1)
SELECT slug, total - earlier AS delta, total - earlier >= 100 AS due FROM t
""")
def page_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, J22, T7"""
    earlier = F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("slug")).agg(F.count(F.lit(1)).alias("total"), F.count_if(earlier).alias("at"))
    return counts.select("slug", (F.col("total") - F.col("at")).alias("delta"), (F.col("total") - F.col("at") >= 100).alias("due"))


@register("""SELECT d.doc_id, l.quality IS NULL OR d.n_chars > 5000 AS pending FROM documents d LEFT JOIN labels l USING (doc_id)""")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long text stands for newer content."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    at, fetched = F.when(F.col("quality").isNotNull(), F.lit(5000)), F.col("n_chars")
    return rows.select("doc_id", predicates.pending_enrichment(at, fetched).alias("pending"))


@register("""
SELECT o_orderkey, coalesce(bool_and(l_returnflag = 'R'), true) AS refetch FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
""")
def refetch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """never fetched, or every source failed for a reason that may pass."""
    source = F.struct(F.lit("external_article").alias("kind"), F.lit("failure").alias("outcome"), F.when(F.col("l_returnflag") == "R", "timeout").otherwise("not_found").alias("failure_reason"))
    content = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.struct(F.collect_list(source).alias("sources")).alias("content"))
    rows = read(spark, sf_dir, "orders").join(content, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", predicates.should_refetch(F.col("content")).alias("refetch"))


@register("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59.999999'""")
def date_window_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2"""
    since, until = (F.lit(predicates.parse_bound(d, end).replace(tzinfo=None).isoformat()).cast("timestamp_ntz") for d, end in (("1996-01-01", False), ("1996-12-31", True)))
    return read(spark, sf_dir, "orders").filter(predicates.in_window(F.col("o_orderdate"), since, until)).select("o_orderkey", "o_orderdate")


@register("""
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'size_unknown' WHEN p_size * 500000 > 20000000 THEN 'too_large' END AS skip,
       CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS BIGINT) * 500000 END AS size_bytes FROM part WHERE p_type = (SELECT min(p_type) FROM part)
""")
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13, X14, F14, F15"""
    rows = read(spark, sf_dir, "part")
    first = rows.agg(F.min("p_type").alias("p_type"))
    size = F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("long") * 500_000)
    return rows.join(first, "p_type", "left_semi").select("p_partkey", predicates.size_gate(size, 20_000_000).alias("skip"), size.alias("size_bytes"))


@register("""
WITH n AS (SELECT o_orderkey, o_orderstatus = 'F' AS e, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM orders)
SELECT o_orderkey, e AS taken FROM n WHERE s - CASE WHEN e THEN 1 ELSE 0 END < 1000
""")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 4096 keys, so no window spans the table."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_orderkey") / 4096).alias("stretch"))
    return budget_prefix(rows, F.col("o_orderstatus") == "F", [F.col("o_orderkey")], 1000, "stretch").select("o_orderkey", "taken")


@register("""SELECT l_linestatus AS outcome, count(*) AS n, count(DISTINCT l_orderkey) AS items FROM lineitem GROUP BY 1""")
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24"""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("items"))


@register("""SELECT doc_id, NOT (lang = 'en' AND source = 'src0') AS stale FROM documents""")
def stale_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13"""
    media = F.struct(F.lit("photo_described").alias("kind"), F.col("source").alias("description_version"), F.col("lang").alias("description_lang"))
    return read(spark, sf_dir, "documents").select("doc_id", predicates.describe_eligible(media, "src0", "en").alias("stale"))


@register("""
WITH j AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN ' ' ELSE 'text' END AS summary, lang AS p, [source, lang] AS t FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, concat_ws('; ', CASE WHEN trim(summary) = '' THEN 'summary is missing or empty' END, CASE WHEN t[1] NOT IN ('en', 'fr', 'de', 'src0', 'src1') THEN 'topic ''' || t[1] || ''' is not in the vocabulary' END,
  CASE WHEN p NOT IN ('en', 'fr', 'de', 'src0', 'src1') THEN 'topic ''' || p || ''' is not in the vocabulary' END, CASE WHEN p NOT IN ('en', 'fr', 'de', 'src0', 'src1') THEN 'primary_topic ''' || p || ''' is not in the vocabulary' END) AS errors FROM j
""")
def judgment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, U6"""
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    vocab, keys = F.array(*[F.lit(v) for v in ("en", "fr", "de", "src0", "src1")]), F.array(F.lit("summary"), F.lit("primary_topic"), F.lit("topics"))
    errors = topics.judgment_errors(F.when(F.col("toxic") == 1, " ").otherwise("text"), F.col("lang"), F.array("source", "lang"), keys, vocab)
    return rows.select("doc_id", F.array_join(errors, "; ").alias("errors"))


@register("""SELECT d.doc_id, l.doc_id IS NOT NULL AS matched, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def describe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8-J10"""
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.col("quality").isNotNull().alias("matched"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@register(f"""SELECT l_orderkey, i - 1 AS index, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) AS i FROM lineitem WHERE l_returnflag = 'R')""")
def running_media_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4"""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)) - 1
    return read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", place.cast("long").alias("index"), "l_extendedprice")


@register("""SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 80 AS batch FROM documents) GROUP BY 1""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9, A32"""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4096).alias("stretch"))
    return batches(rows, [F.col("doc_id")], 80, "stretch").groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@register("""
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) - 1 AS last FROM events)
SELECT user_id, event_id FROM n WHERE last < 40 OR i IN (SELECT CAST(round_even(k * last / 39.0, 0) AS BIGINT) FROM range(40) t(k))
""")
def even_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8"""
    return evenly(read(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 40).select("user_id", "event_id")


# --- functions ---------------------------------------------------------------------------------------------------------------------


@register("""
SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) || rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/') AS key, 'other' AS class FROM pages
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X10"""
    return read(spark, sf_dir, "pages").select("page_id", scalars.canonical_url_key(F.col("url")).alias("key"), scalars.url_class(F.col("url")).alias("class"))


@register(r"""
SELECT p_partkey, coalesce(nullif(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'item') AS slug FROM part
""")
def title_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1"""
    return read(spark, sf_dir, "part").select("p_partkey", scalars.ascii_slug(F.col("p_name")).alias("slug"))


@register("""
SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS label FROM part
""")
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4"""
    return read(spark, sf_dir, "part").select("p_partkey", scalars.topic_label(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("label"))


@register(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS snippet FROM f
""")
def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5"""
    return read(spark, sf_dir, "documents").select("doc_id", scalars.snippet(F.col("text")).alias("snippet"))


@register(r"""SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+'), lambda x: length(x) >= 2)) AS token FROM benchmark) GROUP BY 1""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8"""
    return read(spark, sf_dir, "benchmark").select(F.explode(scalars.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register("""
SELECT 100 * l_linenumber AS code, CASE WHEN 100 * l_linenumber BETWEEN 400 AND 499 THEN 'http_4xx' WHEN 100 * l_linenumber BETWEEN 500 AND 599 THEN 'http_5xx' ELSE 'unknown_error' END AS class, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def status_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17, X18"""
    code = 100 * F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").groupBy(code.alias("code"), scalars.status_class(code).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X28"""
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@register("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def html_links_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, S12"""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return read(spark, sf_dir, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ', ') AS targets FROM pages""")
def domains_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35"""
    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: F.struct(h.alias("domain")))
    return read(spark, sf_dir, "pages").select("page_id", scalars.distinct_domains(links).alias("targets"))


@register("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages""")
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, R5"""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@register("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' ' || c_name || ' #' || replace(lower(o_orderpriority), ' ', '-') AS line FROM orders JOIN customer ON c_custkey = o_custkey""")
def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, R2, R10"""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("o_orderkey", F.concat_ws(" ", scalars.day(F.col("o_orderdate")), "c_name", F.concat(F.lit("#"), F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("-")))).alias("line"))


@register("""SELECT strftime(o_orderdate, '%Y-%m') AS month, '{"n":' || count(*) || ',"first":"' || min(o_orderpriority) || '","none":null}' AS row FROM orders GROUP BY 1""")
def dashboard_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are kept."""
    months = read(spark, sf_dir, "orders").groupBy(scalars.month(F.col("o_orderdate")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderpriority").alias("first"))
    return months.select("month", F.to_json(F.struct("n", "first", F.lit(None).cast("string").alias("none")), {"ignoreNullFields": "false"}).alias("row"))


@register("""SELECT lang AS pool, count(*) AS n FROM documents WHERE lang <> 'de' GROUP BY 1 UNION ALL SELECT 'de', count(*) FROM pages""")
def multi_source_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind replaced by another table's rows."""
    kept = read(spark, sf_dir, "documents").filter("lang <> 'de'").select(F.col("lang").alias("pool"))
    return kept.unionByName(read(spark, sf_dir, "pages").select(F.lit("de").alias("pool"))).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


# --- extensions: the batch form of streams, vectors and text overlap -----------------------------------------------------------------


@register("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.tumbling(read(spark, sf_dir, "events"), "ts", "1 hour", "event_type")


@register("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.sessions(read(spark, sf_dir, "events"), "ts", "30 minutes", "user_id")
