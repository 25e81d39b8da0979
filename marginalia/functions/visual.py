
from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: From which edge density on a frame is like a slide, and from which share of readable frames on a video is a deck.
SLIDE_DENSITY, SLIDE_SHARE = 0.03, 0.5
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode_png(pixels: np.ndarray) -> bytes:
    """Grey (h, w) or colour (h, w, 3) bytes as a PNG."""
    h, w = pixels.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, np.uint8))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _chunks(data: bytes) -> dict[bytes, bytes]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, found = 8, {}
    while at + 12 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
        if kind == b"IEND":
            break
    return found


def _unfilter(raw: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    """Rows without their filters: none, left and up by whole rows, average and Paeth byte by byte."""
    if len(raw) < h * (stride + 1):
        raise ValueError("not enough pixels")
    out = np.zeros((h + 1, stride), np.uint8)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        up = out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // bpp) * bpp, np.uint8)
            padded[:stride] = line
            out[y + 1] = np.cumsum(padded.reshape(-1, bpp), 0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            done, above, given = [0] * (stride + bpp), [0] * bpp + up.tolist(), line.tolist()
            for i, x in enumerate(given):
                a, b, c = done[i], above[i + bpp], above[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[i + bpp] = (x + guess) & 255
            out[y + 1] = done[bpp:]
        else:
            raise ValueError("unknown filter")
    return out[1:]


def grey_pixels(data: bytes) -> np.ndarray | None:
    """(h, w) brightness of a PNG, null if it can't be read (X31). Interlaced pictures count as unreadable."""
    try:
        chunks = _chunks(data)
        w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        if interlace or not w or not h or colour not in CHANNELS:
            return None
        bits = CHANNELS[colour] * depth
        stride = -(-w * bits // 8)
        limit = h * (stride + 1)
        rows = _unfilter(zlib.decompressobj().decompress(chunks[b"IDAT"], limit), h, stride, max(1, bits // 8))
        if depth < 8:
            rows = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth) @ (1 << np.arange(depth)[::-1])
            samples = rows[..., None] if colour == 3 else (rows * (255 // ((1 << depth) - 1)))[..., None]
        else:
            samples = rows.reshape(h, w, CHANNELS[colour], depth // 8)[..., 0]  # of 16 bits the upper ones
        if colour == 3:
            table = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)
            samples = table[samples[..., 0]]
        samples = samples.astype(np.int64)
        if samples.shape[2] < 3:
            return samples[..., 0].astype(np.uint8)
        return ((samples[..., 0] * 19595 + samples[..., 1] * 38470 + samples[..., 2] * 7471 + 0x8000) >> 16).astype(np.uint8)
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None


def density(data: bytes | None) -> float | None:
    """Mean magnitude of edges, 0 to 1: eight times a pixel less its neighbours, cut to a byte; pixels of the border stay what they are."""
    pixels = None if data is None else grey_pixels(bytes(data))
    if pixels is None:
        return None
    x = pixels.astype(np.int64)
    edges = x.copy()
    if min(x.shape) > 2:
        around = sum(x[dy : dy + x.shape[0] - 2, dx : dx + x.shape[1] - 2] for dy in range(3) for dx in range(3))
        edges[1:-1, 1:-1] = np.clip(9 * x[1:-1, 1:-1] - around, 0, 255)
    return float(edges.mean() / 255)


@pandas_udf(DoubleType())
def edge_density(frames: pd.Series) -> pd.Series:
    return pd.Series([density(f) for f in frames], dtype="float64")


def visual_kinds(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_key, visual_kind): slides where at least half of the readable frames are like slides, unreadable where there are frames and none is readable, else talking_head.

    videos: video_key; frames: video_key, content. Frames are judged where they lie, and only their votes are shuffled, combined before.
    """
    marked = frames.select("video_key", edge_density("content").alias("density"))
    votes = marked.groupBy("video_key").agg(F.count("density").alias("readable"), F.count_if(F.col("density") >= SLIDE_DENSITY).alias("like_slides"))
    kind = F.when(F.col("readable").isNull(), "talking_head").when(F.col("readable") == 0, "unreadable").when(F.col("like_slides") >= SLIDE_SHARE * F.col("readable"), "slides").otherwise("talking_head")
    return videos.select("video_key").distinct().join(votes, "video_key", "left").select("video_key", kind.alias("visual_kind"))


def deck_frames(frames: DataFrame, kinds: DataFrame) -> DataFrame:
    """Frames of decks; those of other videos are camera cuts and are not described (M5)."""
    return frames.join(kinds.filter("visual_kind = 'slides'").select("video_key"), "video_key", "left_semi")
