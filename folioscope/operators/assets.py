"""Pictures of documents: which they show, which are left over, what may be fetched, what is served, how large they are."""

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import html

#: Pictures above so many bytes or pixels get a smaller copy, which must save a fifth.
LARGE_BYTES, LARGE_PIXELS, LEAST_SAVED = 300 * 1000, 1600, 0.2


def pictures(body: Column) -> Column:
    """Addresses of a text's pictures, Markdown's before HTML's, each once, in order."""
    marked = F.regexp_extract_all(body, F.lit(r"!\[[^\]]*\]\(<?([^)\s>]+)>?[^)]*\)"), F.lit(1))
    tagged = F.transform(F.regexp_extract_all(body, F.lit(r'(?i)<img\b[^>]*\bsrc="([^"]+)"'), F.lit(1)), html.unescape)
    return F.array_distinct(F.concat(marked, tagged))


def left_over(assets: DataFrame, docs: DataFrame) -> DataFrame:
    """Assets (slug, file) with a name that processing gives and no place in their document's body."""
    used = docs.select("slug", F.explode(F.regexp_extract_all("body", F.lit(r"\./assets/([0-9a-f]{12}\.[a-z]+)"), F.lit(1))).alias("file")).distinct()
    return assets.where(F.col("file").rlike(r"^[0-9a-f]{12}\.[a-z]+$")).join(used, ["slug", "file"], "left_anti")


def within_caps(found: DataFrame, count: int, size: int) -> DataFrame:
    """Pictures (slug, pos, bytes) in order while a document's number and bytes allow; of equal places the smaller goes first."""
    w = Window.partitionBy("slug").orderBy("pos", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("taken", (F.count("*").over(w) <= count) & (F.sum("bytes").over(w) <= size))


def local_name(content: Column, extension: Column) -> Column:
    return F.concat(F.lit("./assets/"), F.substring(F.sha2(content, 256), 1, 12), F.lit("."), extension)


def served(assets: DataFrame) -> DataFrame:
    """How each asset (file, bytes, width, height, copy_bytes) is served: as it is, as a smaller copy, or not at all."""
    large = (F.col("bytes") > LARGE_BYTES) | (F.greatest("width", "height") > LARGE_PIXELS)
    pays = F.col("copy_bytes") <= F.col("bytes") * (1 - LEAST_SAVED)
    return assets.withColumn("served", F.when(F.col("bytes") > 20 << 20, "no").when(large & F.col("file").rlike(r"(?i)\.(?:png|jpe?g)$") & F.coalesce(pays, F.lit(False)), "copy").otherwise("original"))


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from a picture's first bytes: PNG, GIF, WebP or JPEG."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def with_sizes(files: DataFrame) -> DataFrame:
    """Files (path, content) as path, bytes, width and height; the bytes stay in the task."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = [size_of(c) or (None, None) for c in part["content"]]
            yield pd.DataFrame({"path": part["path"], "bytes": part["content"].map(lambda c: len(c or b"")), "width": pd.array([w for w, _ in sizes], dtype="Int64"), "height": pd.array([h for _, h in sizes], dtype="Int64")})

    return files.select("path", "content").mapInPandas(run, "path string, bytes long, width long, height long")
