"""Queries over pictures, frames and judgments made of the given tables, each compared with SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BinaryType

from marginalia.functions.images import image_info
from marginalia.functions.visual import deck_frames, encode_png, visual_kinds
from marginalia.plans.judgments import parsed_judgments, parsed_replies
from marginalia.plans.registry import read, register


def _bytes(value: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * n, "0"))


@register("""
SELECT page_id, CASE WHEN k < 3 THEN (CASE WHEN k = 2 THEN 1 + page_id % 60000 ELSE 1 + page_id % 4000 END)::INT END AS width, CASE WHEN k < 3 THEN (1 + page_id * 7 % 3000)::INT END AS height, CASE k WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' END AS format
FROM (SELECT page_id, page_id % 6 AS k FROM pages)
""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose headers carry the number of a page, with a piece of it and a false start of frame in between; some are cut, have a wrong checksum or are no pictures."""
    w, h, k = 1 + F.col("page_id") % 4000, 1 + F.col("page_id") * 7 % 3000, F.col("page_id") % 6
    raw = F.concat(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    piece = F.concat(F.substring(raw, 1, 200), F.unhex(F.lit("FFC0001108000100010311")))
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000FFFFE1")), _bytes(F.octet_length(piece) + 2, 2), piece, F.unhex(F.lit("FFC2001108")), _bytes(h, 2), _bytes(w, 2), F.unhex(F.lit("03011100FFDA")), raw)
    header = F.concat(F.unhex(F.lit("49484452")), _bytes(w, 4), _bytes(h, 4), F.unhex(F.lit("0802000000")))
    png = lambda crc: F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D")), header, _bytes(crc, 4), raw)
    little = lambda x: F.concat(_bytes(x % 256, 1), _bytes(F.floor(x / 256), 1))
    gif = F.concat(F.unhex(F.lit("474946383961")), little(1 + F.col("page_id") % 60000), little(h), raw)
    body = F.when(k == 0, jpeg).when(k == 1, png(F.crc32(header))).when(k == 2, gif).when(k == 3, png(F.crc32(header) % 1000)).when(k == 4, F.substring(jpeg, 1, 60)).otherwise(raw)
    return read(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", image_info(F.col("body")).alias("i")).select("page_id", "i.*")


@pandas_udf(BinaryType())
def _frame(digests: pd.Series) -> pd.Series:
    """30 bytes as a picture of five rows."""
    return digests.map(lambda d: encode_png(np.frombuffer(bytes(d), np.uint8).reshape(5, 6)))


_FRAMES_SQL = """
p AS (SELECT page_id, page_id // 16 AS video_key, CASE WHEN page_id // 16 % 5 = 1 OR page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN list_transform(range(30), lambda i: 9 + i % 2)
  ELSE list_transform(range(30), lambda i: ('0x' || substr(sha256(html), 2 * i + 1, 2))::INT // (CASE WHEN page_id // 16 % 2 = 0 THEN 1 ELSE 64 END)) END AS x FROM pages),
d AS (SELECT page_id, video_key, CASE WHEN x IS NOT NULL THEN list_sum(list_transform(range(30), lambda i: CASE WHEN i % 6 IN (0, 5) OR i < 6 OR i >= 24 THEN x[i + 1] ELSE
  greatest(0, least(255, 9 * x[i + 1] - list_sum(list_transform([-7, -6, -5, -1, 0, 1, 5, 6, 7], lambda o: x[i + 1 + o])))) END)) / 30.0 / 255 END AS density FROM p),
v AS (SELECT video_key, CASE WHEN count(density) = 0 THEN 'unreadable' WHEN count(*) FILTER (density >= 0.03) >= 0.5 * count(density) THEN 'slides' ELSE 'talking_head' END AS visual_kind FROM d GROUP BY 1)
"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen pages a video: noise, faint noise or a smooth picture each, some of them cut."""
    key = F.floor(F.col("page_id") / 16)
    noise = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.floor(F.conv(F.substring(F.sha2("html", 256), i * 2 + 1, F.lit(2)), 16, 10).cast("int") / F.when(key % 2 == 0, 1).otherwise(64)))
    smooth = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: (9 + i % 2).cast("long"))
    digest = F.unhex(F.array_join(F.transform(F.when(F.col("page_id") % 3 == 0, smooth).otherwise(noise), lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    made = read(spark, sf_dir, "pages").select(key.alias("video_key"), F.col("page_id").alias("place"), _frame(digest).alias("content"))
    broken = (F.col("video_key") % 5 == 1) | (F.col("place") % 7 == 0)
    return made.withColumn("content", F.when(broken, F.substring("content", 1, 50)).otherwise(F.col("content")))


@register(f"WITH {_FRAMES_SQL} SELECT * FROM v")
def visual_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority of readable frames, by the density of their edges."""
    frames = _frames(spark, sf_dir)
    return visual_kinds(frames, frames)


@register(f"WITH {_FRAMES_SQL} SELECT video_key, page_id AS place FROM p JOIN v USING (video_key) WHERE visual_kind = 'slides'")
def slide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: frames of decks alone are kept."""
    frames = _frames(spark, sf_dir)
    return deck_frames(frames, visual_kinds(frames, frames)).select("video_key", "place")


@register("""
SELECT doc_id AS pos, array_to_string([e FOR e IN [
    CASE WHEN k = 0 THEN 'not a JSON object' END, CASE WHEN k = 1 THEN 'missing keys: description, index' END, CASE WHEN k = 2 THEN 'unexpected keys: color, size' END,
    CASE WHEN k IN (3, 4, 5) THEN 'index must be a whole number' END, CASE WHEN k = 6 THEN 'index is not below 8' END, CASE WHEN k IN (7, 3) THEN 'is_decorative must be true or false' END,
    CASE WHEN k = 8 THEN 'description must be a text' END,
    CASE WHEN k >= 9 AND row_number() OVER (PARTITION BY source, k >= 9, k % 8 ORDER BY doc_id) > 1 THEN 'duplicate judgment for this address' END] IF e IS NOT NULL], '; ') AS errors
FROM (SELECT doc_id, source, doc_id % 14 AS k FROM documents)
""")
def typed_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: judgments with wrong types, keys, ranges and addresses, each with all its errors."""
    k = F.col("doc_id") % 14
    text = lambda index, decorative="false", said='"a cat"', more="": F.concat(F.lit('{"item_id": "'), "source", F.lit('", "index": '), index, F.lit(f', "is_decorative": {decorative}, "description": {said}{more}' + "}"))
    raw = (
        F.when(k == 0, F.lit("[1, 2]")).when(k == 1, F.lit('{"item_id": "a", "is_decorative": true}')).when(k == 2, text(F.lit("1"), more=', "size": 1, "color": null'))
        .when(k == 3, text(F.lit("true"), '"no"')).when(k == 4, text(F.lit("1.5"))).when(k == 5, text(F.lit('"1"'))).when(k == 6, text(F.lit("8"))).when(k == 7, text(F.lit("1"), "0"))
        .when(k == 8, text(F.lit("1"), said="null")).otherwise(text((k % 8).cast("string"), "true", '""'))
    )
    checked = parsed_judgments(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "source", raw.alias("raw")), batch_size=8)
    return checked.select("pos", F.array_join("errors", "; ").alias("errors"))


@register("""
SELECT doc_id AS reply, CASE doc_id % 5 WHEN 0 THEN 'not a JSON list' WHEN 1 THEN 'index is not below 3' WHEN 2 THEN 'duplicate index' END AS error, CASE WHEN doc_id % 5 = 4 THEN 2 WHEN doc_id % 5 = 3 THEN 0 END AS n,
  CASE WHEN doc_id % 5 = 4 THEN source || '/' || lang END AS said FROM documents
""")
def typed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: replies of a model as batches of judgments, refused as a whole where one is bad."""
    k = F.col("doc_id") % 5
    one = lambda index, said: F.concat(F.lit('{"index": ' + str(index) + ', "is_decorative": false, "note": 1, "description": "'), said, F.lit('"}'))
    pair = lambda i, j: F.concat(F.lit("```json\n["), one(i, F.col("source")), F.lit(", "), one(j, F.col("lang")), F.lit("]\n```"))
    text = F.when(k == 0, F.lit('{"index": 0}')).when(k == 1, pair(0, 3)).when(k == 2, pair(1, 1)).when(k == 3, F.lit("[]")).otherwise(pair(0, 2))
    got = parsed_replies(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("reply"), text.alias("text"), "source", "lang"), 3)
    return got.select("reply", "error", F.when(F.col("error").isNull(), F.size("judgments")).alias("n"), F.nullif(F.array_join(F.transform("judgments", lambda j: j["description"]), "/"), F.lit("")).alias("said"))
