"""Picture headers, frames and typed judgments against what they are made of."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from marginalia.functions.images import image_info
from marginalia.functions.visual import density, encode_png, grey_pixels, visual_kinds
from marginalia.plans.judgments import parsed_judgments, parsed_replies
from marginalia.sources import external
from marginalia.workspace import Workspace
from tests.test_workspace import item, store


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered_png(pixels, depth=8, colour=2, filters=(0, 1, 2, 3, 4), palette=None):
    """A PNG whose rows take turns with the filters, made the slow way."""
    h = pixels.shape[0]
    rows = pixels.reshape(h, -1).astype(int)
    bpp, out = max(1, rows.shape[1] // pixels.shape[1] if depth == 8 else 1), b""
    for y in range(h):
        kind, line = filters[y % len(filters)], []
        for i in range(rows.shape[1]):
            a = rows[y][i - bpp] if i >= bpp else 0
            b = rows[y - 1][i] if y else 0
            c = rows[y - 1][i - bpp] if y and i >= bpp else 0
            p = a + b - c
            paeth = min((abs(p - v), n, v) for n, v in enumerate((a, b, c)))[2]
            line.append((rows[y][i] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *line])
    size = struct.pack(">IIBBBBB", pixels.shape[1] * (8 // depth), h, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", size) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(out)[:7]) + chunk(b"IDAT", zlib.compress(out)[7:]) + chunk(b"IEND", b"")


def test_pixels_of_all_filters_and_colours():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (11, 7, 3))
    grey = (rgb @ [19595, 38470, 7471] + 0x8000) >> 16
    assert (grey_pixels(filtered_png(rgb)) == grey).all() and (grey_pixels(encode_png(rgb)) == grey).all()
    rgba = np.concatenate([rgb, rng.integers(0, 256, (11, 7, 1))], 2)
    assert (grey_pixels(filtered_png(rgba, colour=6)) == grey).all()
    one = rng.integers(0, 256, (6, 5, 1))
    assert (grey_pixels(filtered_png(one, colour=0)) == one[..., 0]).all()
    packed = rng.integers(0, 256, (6, 3, 1))
    bits = np.unpackbits(packed[..., 0].astype(np.uint8), axis=1)
    assert (grey_pixels(filtered_png(packed, 1, 0)) == bits * 255).all()
    table = rng.integers(0, 256, (4, 3))
    found = grey_pixels(filtered_png(packed, 2, 3, palette=table.astype(np.uint8).tobytes()))
    index = bits.reshape(6, -1, 2) @ [2, 1]
    assert (found == ((table @ [19595, 38470, 7471] + 0x8000) >> 16)[index]).all()
    good = filtered_png(rgb)
    for bad in (b"", b"x" * 90, good[:60], good[:-20], good[:50] + b"\0" + good[51:]):
        assert grey_pixels(bad) is None and density(bad) is None


def test_density_by_the_definition():
    x = np.random.default_rng(2).integers(0, 256, (9, 8))
    total = 0
    for r in range(9):
        for c in range(8):
            inside = 0 < r < 8 and 0 < c < 7
            total += min(255, max(0, 9 * x[r, c] - sum(x[r + i, c + j] for i in (-1, 0, 1) for j in (-1, 0, 1)))) if inside else x[r, c]
    assert abs(density(encode_png(x)) - total / 72 / 255) < 1e-12 and density(encode_png(np.zeros((4, 4)))) == 0 and density(None) is None
    assert abs(density(encode_png(np.full((2, 9), 51))) - 0.2) < 1e-12


def test_kind_of_a_video_is_the_vote_of_its_readable_frames(spark):
    deck, face = encode_png(np.indices((20, 20)).sum(0) % 2 * 255), encode_png(np.zeros((20, 20)))
    rows = [("half", deck), ("half", face), ("half", b"broken"), ("less", deck), ("less", face), ("less", face), ("none", b"x"), ("none", None)]
    videos = spark.createDataFrame([(k,) for k in ("half", "less", "none", "empty", "half")], "video_key string")
    found = visual_kinds(videos, spark.createDataFrame(rows, "video_key string, content binary"))
    assert {tuple(r) for r in found.collect()} == {("half", "slides"), ("less", "talking_head"), ("none", "unreadable"), ("empty", "talking_head")}


def test_frames_are_extracted_once_a_video_and_kept_for_decks(spark):
    deck, face = encode_png(np.indices((20, 20)).sum(0) % 2 * 255), encode_png(np.zeros((20, 20)))

    def extract(url):
        if url == "bad":
            raise OSError("gone")
        return [(0.5, deck), (1.5, deck)] if url == "deck" else [(0.0, face)]

    items = spark.createDataFrame([("1", "a", "deck"), ("2", "a", "deck"), ("3", "b", "face"), ("4", "c", "bad")], "id string, video_key string, url string")
    kinds, frames = external.digest_visuals(items, extract)
    assert {tuple(r) for r in kinds.collect()} == {("a", "slides", None), ("b", "talking_head", None), ("c", None, "OSError: gone")}
    assert sorted((r["video_key"], r["place"], r["second"]) for r in frames.collect()) == [("a", 0, 0.5), ("a", 1, 1.5)]


def jpeg(*segments, frame=b"\xff\xc0\x00\x11\x08\x00\x1e\x00\x28\x03" + b"\0" * 9):
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments) + frame + b"\xff\xda\0\x02rest"


def test_headers_of_pictures(spark):
    decoy = b"\xff\xc0\x00\x11\x08\x00\x01\x00\x01"
    png = encode_png(np.zeros((30, 40)))
    cases = {
        "plain": (jpeg((0xE0, b"JFIF")), (40, 30, "jpeg")), "decoy": (jpeg((0xE1, decoy), (0xC4, decoy), (0xFE, b"\xff" * 70)), (40, 30, "jpeg")),
        "progressive": (jpeg(frame=b"\xff\xff\xc2\x00\x11\x08\x00\x1e\x00\x28\x03" + b"\0" * 9), (40, 30, "jpeg")), "restart": (b"\xff\xd8\xff\xd0" + jpeg()[2:], (40, 30, "jpeg")),
        "no frame": (b"\xff\xd8\xff\xda\0\x02" + decoy, None), "cut": (jpeg((0xE0, b"JFIF"))[:14], None), "zero": (jpeg(frame=b"\xff\xc0\x00\x11\x08\0\0\0\x05" + b"\0" * 10), None), "loose": (b"\xff\xd8\0" + decoy, None),
        "png": (png, (40, 30, "png")), "cut png": (png[:30], None), "wrong png": (png[:20] + b"\1" + png[21:], None), "gif": (b"GIF89a\x2c\x01\x1e\0rest", (300, 30, "gif")), "short gif": (b"GIF87a\x05", None),
        "empty": (b"", None), "null": (None, None), "text": (b"<html>", None),
    }
    frame = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, body binary")
    found = {r["k"]: tuple(r["i"]) if r["i"] else None for r in frame.select("k", image_info(F.col("body")).alias("i")).collect()}
    assert found == {k: v[1] for k, v in cases.items()}


def brute_errors(raw, batch, seen):
    try:
        j = json.loads(raw)
    except (TypeError, ValueError):
        j = None
    if not isinstance(j, dict):
        return ["not a JSON object"]
    need = {"item_id", "index", "is_decorative", "description"}
    out = [f"missing keys: {', '.join(sorted(need - j.keys()))}"] * bool(need - j.keys()) + [f"unexpected keys: {', '.join(sorted(j.keys() - need))}"] * bool(j.keys() - need)
    whole = isinstance(j.get("index"), int) and not isinstance(j.get("index"), bool)
    if "index" in j:
        out += [] if whole else ["index must be a whole number"]
        out += [f"index is not below {batch}"] * (whole and not 0 <= j["index"] < batch)
    out += ["is_decorative must be true or false"] * ("is_decorative" in j and not isinstance(j["is_decorative"], bool))
    out += ["description must be a text"] * ("description" in j and not isinstance(j["description"], str))
    if not out:
        key = (str(j["item_id"]), j["index"])
        out = ["duplicate judgment for this address"] * (key in seen)
        seen.add(key)
    return out


def test_judgments_have_all_their_errors(spark):
    values = {"item_id": ['"a"', "7", '"7"'], "index": ["0", "1", "-1", "5", "true", "1.5", '"0"', "null"], "is_decorative": ["true", "0", "null"], "description": ['"x"', '""', "null", "3"]}
    raws = [f'{{"item_id": {i}, "index": {x}, "is_decorative": {d}, "description": {t}}}' for i in values["item_id"] for x in values["index"] for d in values["is_decorative"] for t in values["description"]]
    raws += ["", "[]", "null", "3", "{", None, "{}", '{"index": 1, "other": 2}', '{"item_id": "a", "index": 0, "is_decorative": true, "description": "", "b": 1, "a": null}']
    frame = spark.createDataFrame(list(enumerate(raws)), "pos long, raw string").repartition(3)
    seen: set = set()
    found = {r["pos"]: r["errors"] for r in parsed_judgments(frame, 3).collect()}
    assert found == {i: brute_errors(r, 3, seen) for i, r in enumerate(raws)}
    assert {r["errors"][0] for r in parsed_judgments(frame).filter("index = -1").collect()} == {"index is negative"}


def test_a_reply_is_good_as_a_whole_or_refused(spark):
    good = '{"index": 1, "is_decorative": true, "description": "a", "more": 1}'
    cases = {"list": (f"[{good}]", None), "fence": (f"```json\n[{good}]\n```", None), "object": (good, "not a JSON list"), "broken": (f"[{good}", "not a JSON list"), "empty": ("[]", None), "null": (None, "not a JSON list"),
             "twice": (f"[{good}, {good}]", "duplicate index"), "far": ('[{"index": 9, "is_decorative": true, "description": "a"}]', "index is not below 4"), "text": ('["a"]', "not a JSON object")}
    frame = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "reply string, text string")
    rows = {r["reply"]: r for r in parsed_replies(frame, 4).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {k: v[1] for k, v in cases.items()} and [tuple(j) for j in rows["fence"]["judgments"]] == [(1, True, "a")] and rows["empty"]["judgments"] == [] and rows["twice"]["judgments"] is None


def test_a_worksheet_applies_what_is_good_and_names_the_rest(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "data"))
    photo = {"kind": "photo_downloaded", "url": "m", "local_path": "m", "width": 1, "height": 1, "bytes_size": 1}
    ws.backfill(store(spark, [item(1, media=[photo, photo])]))
    raws = ['{"item_id": "1", "index": 0, "is_decorative": false, "description": "a cat"}', '{"item_id": "1", "index": 0, "is_decorative": false, "description": "again"}', '{"item_id": "1", "index": true, "is_decorative": 1, "description": "b"}', '{"item_id": "9", "index": 0, "is_decorative": false, "description": "c"}']
    lost = ws.describe_worksheet(spark.createDataFrame(list(enumerate(raws)), "pos long, raw string"), F.lit("2025-01-01").cast("timestamp"))
    assert {r["pos"]: r["errors"] for r in lost.collect()} == {1: ["duplicate judgment for this address"], 2: ["index must be a whole number", "is_decorative must be true or false"], 3: ["no photo at this address"]}
    assert [m["description"] for m in ws.table("items").first()["media"]] == ["a cat", None]
