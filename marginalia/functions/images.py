
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_at(body: Column, at: Column | int, n: int, little: bool = False) -> Column:
    """n bytes from the 1-based place `at` on as an unsigned number; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    one = lambda i: F.conv(F.hex(F.substring(body, at + i, F.lit(1))), 16, 10).cast("long")
    places = range(n) if not little else range(n - 1, -1, -1)
    out = one(next(iter(places)))
    for i in list(places)[1:]:
        out = out * 256 + one(i)
    return F.when(at + (n - 1) <= F.octet_length(body), out)


def _jpeg_size(body: Column) -> Column:
    """Segment by segment to the first start of frame; any other marker is stepped over by its length, so what looks like one inside a segment is not read."""
    state = lambda at, w, h, on: F.struct(at.cast("long").alias("at"), w.cast("long").alias("w"), h.cast("long").alias("h"), on.alias("on"))
    none = F.lit(None).cast("long")

    def step(s: Column, _: Column) -> Column:
        at, marker, length = s["at"], number_at(body, s["at"] + 1, 1), number_at(body, s["at"] + 2, 2)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        moved = (
            F.when(~F.coalesce(number_at(body, at, 1) == 0xFF, F.lit(False)) | marker.isNull(), state(at, none, none, F.lit(False)))
            .when(marker == 0xFF, state(at + 1, none, none, F.lit(True))).when((marker == 1) | marker.between(0xD0, 0xD7), state(at + 2, none, none, F.lit(True)))
            .when(frame & (length >= 7), state(at, number_at(body, at + 7, 2), number_at(body, at + 5, 2), F.lit(False)))
            .when(frame | marker.isin(0xD9, 0xDA) | ~F.coalesce(length >= 2, F.lit(False)), state(at, none, none, F.lit(False))).otherwise(state(at + 2 + length, none, none, F.lit(True)))
        )
        return F.when(s["on"], moved).otherwise(s)

    latin = F.decode(body, "ISO-8859-1")
    markers = F.length(latin) - F.length(F.replace(latin, F.lit("ÿ"), F.lit("")))  # no more segments than bytes of this value
    return F.aggregate(F.sequence(F.lit(1), F.greatest(markers, F.lit(1))), state(F.lit(3), none, none, F.lit(True)), step, lambda s: F.struct(s["w"].alias("width"), s["h"].alias("height")))


def image_info(body: Column) -> Column:
    """(width, height, format) of JPEG, PNG and GIF bytes, null where they are none, are cut before the size, or say a size of zero (S15). A PNG's header must match its checksum."""
    head = F.hex(F.substring(body, 1, 8))
    size = lambda w, h, kind: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), F.lit(kind).alias("format"))
    jpeg = _jpeg_size(body)
    png = (F.hex(F.substring(body, 13, 4)) == "49484452") & (F.crc32(F.substring(body, 13, 17)) == number_at(body, 30, 4))
    found = (
        F.when(head.startswith("FFD8"), size(jpeg["width"], jpeg["height"], "jpeg"))
        .when((head == "89504E470D0A1A0A") & F.coalesce(png, F.lit(False)), size(number_at(body, 17, 4), number_at(body, 21, 4), "png"))
        .when(head.startswith("474946383761") | head.startswith("474946383961"), size(number_at(body, 7, 2, True), number_at(body, 9, 2, True), "gif"))
    )
    return F.when(F.coalesce((found["width"] > 0) & (found["height"] > 0), F.lit(False)), found)
