"""Image facts from bytes: dimensions, digest, size."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dimensions(raw: bytes | None) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, JPEG or WebP; None where it can't be read."""
    if not raw:
        return None
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", raw[16:24])
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", raw[6:10])
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            kind = raw[12:16]
            if kind == b"VP8X":
                return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
            if kind == b"VP8L":
                bits = int.from_bytes(raw[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", raw[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if raw[:2] == b"\xff\xd8":
            at = 2
            while True:
                marker, length = raw[at + 1], struct.unpack(">H", raw[at + 2:at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", raw[at + 5:at + 9])
                    return w, h
                at += 2 + length
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def _dimensions(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(c) or (None, None) for c in content], columns=["width", "height"]).astype("Int32")


def image_facts(images: DataFrame, content: str = "content") -> DataFrame:
    """`images` with sha256, bytes, width and height instead of the content; unreadable headers have null dimensions."""
    c: Column = F.col(content)
    return (images.withColumn("sha256", F.sha2(c, 256)).withColumn("bytes", F.octet_length(c).cast("long"))
            .withColumn("_d", _dimensions(c)).withColumn("width", F.col("_d.width")).withColumn("height", F.col("_d.height")).drop("_d", content))
