
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

# --- text -------------------------------------------------------------------------------------------------------------------------


def ascii_slug(text: Column, longest: int = 60, default: str = "item") -> Column:
    """Lower-case ASCII words joined by dashes, for text that is ASCII already."""
    dashed = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(dashed, 1, longest), F.lit("")), F.lit(default))


@pandas_udf(StringType())
def _ascii_fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def slug(text: Column, longest: int = 60, default: str = "item") -> Column:
    """ascii_slug after compatibility decomposition, which drops accents (X1); the one text function that needs Python."""
    return ascii_slug(_ascii_fold(text), longest, default)


def snippet(text: Column, longest: int = 80) -> Column:
    """White space of any script collapsed; longer text is cut and marked."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest), F.lit("…"))).otherwise(flat)


def summary_or_text(summary: Column, text: Column, longest: int = 200) -> Column:
    """(X6)"""
    return F.coalesce(F.nullif(summary, F.lit("")), F.substring(text, 1, longest))


def truncate_transcript(text: Column, limit: int, marker: str = "\n[… transcript truncated …]") -> Column:
    """Text up to the limit, without white space before the marker."""
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+$", ""), F.lit(marker))).otherwise(text)


#: Fixed value: what counts as a token when overviews are compared.
TOKEN_PATTERN = "[a-zà-ÿ0-9]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0)), lambda t: F.length(t) >= 2)


def title_of(item_id: Column, text: Column, titles: Column) -> Column:
    """First title that isn't empty, else the beginning of the text in one line, else the id (X2, W7). titles: array in order."""
    first = F.try_element_at(F.filter(titles, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(1))
    line = F.substring(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), 1, 80)
    return F.coalesce(first, F.nullif(line, F.lit("")), item_id)


def note_filename(created_at: Column, title_slug: Column, item_id: Column) -> Column:
    """(X3)"""
    return F.concat(F.date_format(created_at, "yyyy-MM-dd"), F.lit("-"), title_slug, F.lit("-"), item_id, F.lit(".md"))


#: Fixed value: slug words that are written in capitals.
ACRONYMS = ("ai", "ml", "llm", "mcp", "api", "ux", "ui", "gpu", "seo", "vc", "3d", "x")


def topic_label(topic: Column, acronyms: tuple[str, ...] = ACRONYMS) -> Column:
    """`machine-learning-and-ai` as `Machine Learning & AI`."""
    words = F.split(topic, "-")
    word = lambda w: F.when(w.isin(*acronyms), F.upper(w)).when(w == "and", F.lit("&")).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.array_join(F.transform(words, word), " ")


def user_tail(existing: Column, marker: str, default: str) -> Column:
    """What the user wrote below the marker; all of it, set off, where there is no marker; else the default."""
    at = F.instr(existing, marker)
    whole = F.concat(F.lit("\n\n"), existing)
    return F.when(at > 0, F.substring(existing, at + len(marker), F.length(existing))).when(F.coalesce(existing, F.lit("")).rlike(r"\S"), whole).otherwise(F.lit(default))


def escape_for_script(text: Column) -> Column:
    """JSON that is safe inside a script element."""
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def error_text(message: Column, longest: int = 500) -> Column:
    """(X21)"""
    return F.when(F.length(message) > longest, F.concat(F.substring(message, 1, longest - 1), F.lit("…"))).otherwise(message)


# --- URLs -------------------------------------------------------------------------------------------------------------------------

#: Hosts of the network that the corpus comes from.
NETWORK_HOSTS = ("x.com", "www.x.com", "twitter.com", "www.twitter.com", "mobile.twitter.com")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_network_url(url: Column) -> Column:
    """(F5)"""
    return F.coalesce(host(url).isin(*NETWORK_HOSTS), F.lit(False))


def canonical_url_key(url: Column) -> Column:
    """Host (aliases as one) and path, without scheme, query, fragment and trailing slashes."""
    name = F.when(is_network_url(url), F.lit("x.com")).otherwise(host(url))
    return F.concat(name, F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")))


def status_id(url: Column) -> Column:
    """(X10)"""
    return F.nullif(F.regexp_extract(url, r"/status/(\d+)", 1), F.lit(""))


def url_class(url: Column) -> Column:
    """article, status or other."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(path.startswith("/i/article/"), "article").when(status_id(url).isNotNull(), "status").otherwise("other")


def video_key(url: Column) -> Column:
    """category/id where the path has a known category, else host and path (X11)."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    known = F.regexp_extract(path, r"(?:^|/)((?:amplify_video|ext_tw_video|tweet_video)/[^/]+)", 1)
    return F.when(known != "", known).otherwise(F.concat(host(url), path))


def with_query(url: Column, name: str, value: str) -> Column:
    """The URL with one query parameter set, the others and their order and the fragment kept."""
    whole, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "(?s)(#.*)$", 1)
    head, query, pair = F.substring_index(whole, "?", 1), F.regexp_extract(whole, r"(?s)\?(.*)$", 1), f"{name}={value}"
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    has = F.exists(parts, lambda p: F.substring_index(p, "=", 1) == name)
    changed = F.transform(parts, lambda p: F.when(F.substring_index(p, "=", 1) == name, pair).otherwise(p))
    return F.concat(head, F.lit("?"), F.array_join(F.when(has, changed).otherwise(F.array_append(parts, F.lit(pair))), "&"), fragment)


# --- media ------------------------------------------------------------------------------------------------------------------------


def video_class(url: Column, thumbnail_url: Column) -> Column:
    """(X12)"""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(url.eqNullSafe(thumbnail_url), "poster").when(path.endswith(".m3u8"), "hls").when((host(url) == "video.twimg.com") | path.endswith(".mp4"), "mp4").otherwise("poster")


def estimated_bytes(bitrate: Column, duration_millis: Column) -> Column:
    """Null where either is unknown, also where the bitrate is 0 (X14). In BIGINT, since the product of two INT may overflow."""
    product = bitrate.cast("long") * duration_millis.cast("long")
    return F.when((bitrate != 0) & duration_millis.isNotNull(), F.floor(product / 8000).cast("long"))


def video_state(kind: Column, stream: Column) -> Column:
    """(X13)"""
    return F.when(kind == "video_downloaded", "downloaded").when(kind == "video_failed", "failed").when(stream == "poster", "poster-era").otherwise("pending")


#: Decimal units of sizes.
UNITS = {"gb": 10**9, "mb": 10**6, "kb": 10**3, "b": 1}


def parse_size(text: Column) -> Column:
    """`1.5GB` in bytes; a bare number is MB; anything else, or nothing positive, is null."""
    number = F.try_to_number(F.regexp_extract(F.lower(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*(?:gb|mb|kb|b)?$", 1), F.lit("999999999999.999999")).cast("double")
    unit = F.regexp_extract(F.lower(F.trim(text)), r"(gb|mb|kb|b)$", 1)
    factor = F.lit(float(UNITS["mb"]))
    for name, value in UNITS.items():
        factor = F.when(unit == name, float(value)).otherwise(factor)
    return F.when(number > 0, F.floor(number * factor).cast("long"))


def format_size(size: Column) -> Column:
    """(X16)"""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for name, value in (("KB", 1e3), ("MB", 1e6), ("GB", 1e9)):
        out = F.when(size >= value, F.format_string(f"%.1f {name}", size / value)).otherwise(out)
    return F.when(size.isNull(), "unknown").otherwise(out)


# --- statuses and numbers ---------------------------------------------------------------------------------------------------------


def reason_for_status(code: Column) -> Column:
    """(X17)"""
    return F.when(code.isin(404, 410), "not_found").when(code.isin(401, 403), "forbidden").when(code.isin(402, 451), "paywall")


def status_class(code: Column) -> Column:
    """(X18)"""
    return F.when(code.between(400, 499), "http_4xx").when(code.between(500, 599), "http_5xx").otherwise("unknown_error")


#: Failures from the mildest on.
SEVERITY = ("http_4xx", "unknown_error", "timeout", "http_5xx")


def severity(reason: Column) -> Column:
    """(A28)"""
    return F.array_position(F.array(*[F.lit(r) for r in SEVERITY]), reason)


def share_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part / whole * 100, digits))


def kpi_pct(part: Column, whole: Column) -> Column:
    """A whole percentage, halves up; 0 where there is nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part / whole * 100 + 0.5)).cast("long")


def month(at: Column) -> Column:
    """(X25)"""
    return F.date_format(at, "yyyy-MM")


def day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def parse_network_date(text: Column, fallback: Column) -> Column:
    """`Wed Oct 10 20:19:24 +0000 2018`; the fallback where it is missing or bad."""
    return F.coalesce(F.try_to_timestamp(F.substring(text, 5, 100), F.lit("MMM dd HH:mm:ss Z yyyy")), fallback)


def growth_pct(before: Column, after: Column) -> Column:
    """Null from nothing."""
    return F.when(before != 0, (after - before) / before)


def grew(before: Column, after: Column, threshold: float = 0.10, least: int = 5) -> Column:
    """(A20)"""
    return (before >= least) & F.coalesce(F.abs(growth_pct(before, after)) >= threshold, F.lit(False))


def overview_flag(similarity: Column, threshold: float = 0.7, identical: float = 0.99) -> Column:
    """(A19)"""
    return F.when(similarity.isNull(), "not_comparable").when(similarity >= identical, "identical").when(similarity >= threshold, "similar").otherwise("different")


def has_speech(flag: Column, text: Column, segments: Column) -> Column:
    """What the tool says; else whether there is text or any segment, be it blank."""
    return F.coalesce(flag, (F.trim(F.coalesce(text, F.lit(""))) != "") | (F.coalesce(F.size(segments), F.lit(0)) > 0))


def transcript_text(text: Column, segments: Column) -> Column:
    """(X32)"""
    joined = F.array_join(F.filter(F.transform(segments, lambda s: F.trim(s["text"])), lambda t: t != ""), " ")
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), joined)


TRANSCRIPT = "text STRING, language STRING, has_speech BOOLEAN, segments ARRAY<STRUCT<start: DOUBLE, text: STRING>>"


def parse_transcript(raw: Column) -> Column:
    """A tool's JSON as struct of text, language and has_speech; null where it is no JSON object."""
    t = F.from_json(raw, TRANSCRIPT)
    made = F.struct(transcript_text(t["text"], t["segments"]).alias("text"), t["language"].alias("language"), has_speech(t["has_speech"], t["text"], t["segments"]).alias("has_speech"))
    return F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(raw)), F.lit("")).startswith("OBJECT"), made)


def frame_times(log: Column) -> Column:
    """The seconds that a frame extractor's log names, in order."""
    return F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda t: t.cast("double"))


def pair_frames(paths: Column, times: Column) -> Column:
    """Frames with their times by position; different numbers are an error."""
    paired = F.transform(paths, lambda p, i: F.struct(F.get(times, i).alias("timestamp"), p.alias("local_path")))
    return F.when(F.size(paths) == F.size(times), paired).otherwise(F.raise_error(F.format_string("%d frames, %d times", F.size(paths), F.size(times))))


#: Block types of an article body and what they look like in text.
BLOCK_PREFIXES = {"header-one": "# ", "header-two": "## ", "header-three": "### ", "header-four": "#### ", "unordered-list-item": "- ", "ordered-list-item": "1. ", "blockquote": "> "}


def block_prefix(kind: Column) -> Column:
    """(X30)"""
    out = F.lit("")
    for name, prefix in BLOCK_PREFIXES.items():
        out = F.when(kind == name, prefix).otherwise(out)
    return out


def flatten_blocks(blocks: Column) -> Column:
    """Text of the text blocks, in order."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kind"] == "text"), lambda b: b["text"]), "")


def distinct_domains(links: Column) -> Column:
    """(A35, X34) links: array of struct with domain."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(links, lambda x: x["domain"]))), ", ")
