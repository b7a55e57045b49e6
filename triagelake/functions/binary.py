"""What file bytes say: their kind, and the size of images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column

from . import lazy as F
from pyspark.sql import types as T

#: Magic numbers, as hexadecimal digits.
PDF_MAGIC, PNG_MAGIC, JPEG_MAGIC, PNG_HEADER = "255044462D", "89504E470D0A1A0A", "FFD8FF", "49484452"
#: JPEG markers that begin a frame header, which holds the size.
FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: Markers without a length.
BARE_MARKERS = frozenset({0x01, 0xD8, *range(0xD0, 0xD8)})


def sniff(data: Column) -> Column:
    """pdf, png, jpg or null, by the bytes alone."""
    magic = lambda h: F.expr(f"X'{h}'")
    return (
        F.when(F.contains(F.substring(data, 1, 1024), magic(PDF_MAGIC)), F.lit("pdf"))
        .when(F.startswith(data, magic(PNG_MAGIC)), F.lit("png"))
        .when(F.startswith(data, magic(JPEG_MAGIC)), F.lit("jpg"))
    )


def png_size(data: Column) -> Column:
    """(width, height) from the header chunk, or null."""
    side = lambda at: F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")
    good = (F.length(data) >= 24) & (F.hex(F.substring(data, 13, 4)) == PNG_HEADER)
    return F.when(good, F.struct(side(17).alias("width"), side(21).alias("height")))


SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def walk_jpeg(data: bytes) -> tuple[int, int] | None:
    """Segment by segment to the frame header."""
    at = 2
    while at + 9 < len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            at += 1
        elif marker in BARE_MARKERS:
            at += 2
        elif marker in FRAME_MARKERS:
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(SIZE)
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    """A walk from marker to marker has no native form."""
    found = [walk_jpeg(bytes(d)) if d is not None else None for d in data]
    return pd.DataFrame([f or (None, None) for f in found], columns=["width", "height"]).astype("Int64")


def image_size(data: Column, media: Column) -> Column:
    return F.when(media == "png", png_size(data)).when(media == "jpg", jpeg_size(data))
