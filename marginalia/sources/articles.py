
from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.scalars import BLOCK_PREFIXES

PARSED = "id string, seq long, title string, blocks array<struct<kind:string,text:string,alt:string,url:string>>, media_seen int, dropped int"
_COLUMNS = ["id", "seq", "title", "blocks", "media_seen", "dropped"]


def _find(tree: Any) -> dict | None:
    """The nearest node with content blocks, breadth first; JSON in strings is opened."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        if isinstance(node, dict):
            state = node.get("content_state")
            if isinstance(state, str):
                try:
                    state = json.loads(state)
                except ValueError:
                    state = None
            blocks = state.get("blocks") if isinstance(state, dict) else None
            if isinstance(blocks, list) and any(isinstance(b, dict) and ("type" in b or "text" in b) for b in blocks):
                return {**node, "content_state": state}
            todo.extend(node.values())
        elif isinstance(node, list):
            todo.extend(node)
    return None


def _image(info: Any) -> str | None:
    return ((info or {}).get("media_info") or {}).get("original_img_url")


def parse_article(body: str) -> tuple[str | None, list[dict], int, int] | None:
    """(title, blocks, media entries seen, blocks dropped); null leads to the plain text instead."""
    try:
        found = _find(json.loads(body))
    except (TypeError, ValueError):
        return None
    if not found:
        return None
    state = found["content_state"]
    pictures = {str(m.get("media_id")): _image(m) for m in found.get("media_entities") or []}
    entities = {str(e.get("key")): e.get("value") or {} for e in state.get("entityMap") or []}
    blocks: list[dict] = []
    dropped = 0
    for block in state["blocks"]:
        images = [entities.get(str(r.get("key")), {}) for r in block.get("entityRanges") or []]
        images = [e for e in images if str(e.get("type", "")).upper() in ("IMAGE", "MEDIA")]
        for entity in images:
            data = entity.get("data") or {}
            urls = [(i.get("alt") or data.get("caption"), pictures.get(str(i.get("mediaId")))) for i in data.get("mediaItems") or []] if "mediaItems" in data else [(data.get("caption"), data.get("url"))]
            blocks += [{"kind": "image", "text": None, "alt": alt, "url": url} for alt, url in urls if url]
            dropped += not any(u for _, u in urls)
        text = block.get("text") or ""
        if not images and text.strip():
            prefix = "\n\n" if any(b["kind"] == "text" for b in blocks) else ""  # only behind the first text (W10)
            blocks.append({"kind": "text", "text": prefix + BLOCK_PREFIXES.get(block.get("type"), "") + text, "alt": None, "url": None})
    cover = _image(found.get("cover_media"))
    if cover and not any(b["url"] == cover for b in blocks):
        blocks.insert(0, {"kind": "image", "text": None, "alt": None, "url": cover})
    return (found.get("title"), blocks, len(pictures), dropped) if blocks else None


def parse_captures(captures: DataFrame) -> DataFrame:
    """The richest capture of each item (B11, A30), with what may be wrong with it (B10). captures: id, seq, body."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, s, *parsed) for i, s, b in zip(frame["id"], frame["seq"], frame["body"], strict=True) if (parsed := parse_article(b))]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    parsed = captures.select("id", "seq", "body").mapInPandas(run, PARSED)
    best = parsed.groupBy("id").agg(F.max_by(F.struct("title", "blocks", "media_seen", "dropped"), F.struct(F.size("blocks"), -F.col("seq"))).alias("a"))
    images = F.size(F.filter("a.blocks", lambda b: b["kind"] == "image"))
    text = F.array_join(F.transform(F.filter("a.blocks", lambda b: b["kind"] == "text"), lambda b: b["text"]), "")
    return best.select("id", "a.title", "a.blocks", text.alias("text"), ((F.col("a.media_seen") > 0) & (images == 0)).alias("images_missing"), (F.col("a.dropped") > 0).alias("gallery_partial"))


def with_fallback(parsed: DataFrame, plain: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Structured text, else the plain one; `truncated` where the structured text is much shorter (S11, B10). plain: id, plain."""
    joined = plain.join(parsed, "id", "left")
    short = F.coalesce(F.length("text") < least_share * F.length("plain"), F.lit(False))
    return joined.select("id", "title", F.coalesce("text", "plain").alias("text"), "blocks", F.col("text").isNull().alias("fell_back"), short.alias("truncated"))
