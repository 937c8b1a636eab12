"""Sizes and turns of images by their headers; flat drawings, colours and greys by their pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What makes a drawing: rows that are looked at, differences of neighbours in three channels, and shares.
LOOKED_AT, FLAT, EDGE, FLAT_SHARE, EDGE_SHARE = 400, 8, 150, 0.6, 0.003
MANY_COLORS = 1024
GREY_STEP = 97
# Frames of a JPEG have markers from C0 to CF but for tables and reserved ones.
NO_FRAME = (0xC4, 0xC8, 0xCC)
#: Pixels that are worked on at a time.
BLOCK = 1 << 20

_HEADER = pa.struct([("format", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("orientation", pa.int32())])


def _orientation(data: bytes, at: int) -> int:
    """The turn from 1 to 8 that the directory of a TIFF header tells; 1 where it tells none or is cut off."""
    order = "little" if data[at : at + 2] == b"II" else "big"
    number = lambda place, n: int.from_bytes(data[place : place + n], order)
    first = at + number(at + 4, 4)
    for k in range(number(first, 2)):
        entry = first + 2 + 12 * k
        if entry + 10 > len(data):
            break
        if number(entry, 2) == 0x0112:
            return number(entry + 8, 2) or 1
    return 1


def read_header(data: bytes) -> dict:
    """Format, width, height and orientation by the header of a PNG or JPEG; no format for other data, no size where it is cut off."""
    out = {"format": None, "width": None, "height": None, "orientation": 1}
    if data[:4] == b"\x89PNG":
        out["format"] = "png"
        if len(data) >= 24 and data[12:16] == b"IHDR":
            out |= {"width": int.from_bytes(data[16:20]), "height": int.from_bytes(data[20:24])}
    elif data[:2] == b"\xff\xd8" and len(data) >= 4:
        out["format"], at, turned = "jpeg", 2, False
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            if marker == 0xE1 and not turned and data[at + 4 : at + 8] == b"Exif":
                out["orientation"], turned = _orientation(data, at + 10), True
            if 0xC0 <= marker <= 0xCF and marker not in NO_FRAME:
                if at + 9 < len(data):
                    out |= {"width": int.from_bytes(data[at + 7 : at + 9]), "height": int.from_bytes(data[at + 5 : at + 7])}
                break
            at += 2 + size
    return out


def image_headers(files: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, format, width, height, orientation) of images, from their headers alone."""

    @F.arrow_udf("struct<format: string, width: bigint, height: bigint, orientation: int>")
    def read(data: pa.Array) -> pa.Array:
        return pa.array([read_header(bytes(x or b"")) for x in data.to_pylist()], _HEADER)

    return files.select(*key, read(F.col(content)).alias("h")).select(*key, "h.*")


def is_graphic(px: np.ndarray) -> bool:
    """Whether pixels (row, column, channel) are a drawing: most neighbours in a row hardly differ, and some differ much."""
    step = max(1, len(px) // LOOKED_AT)
    rows = px[::step]
    pairs = flat = edges = 0
    for lo in range(0, len(rows), max(1, BLOCK // max(1, px.shape[1]))):
        own = rows[lo : lo + max(1, BLOCK // max(1, px.shape[1]))].astype(np.int16)
        d = np.abs(np.diff(own, axis=1)).sum(axis=2) * (3 if px.shape[2] == 1 else 1)
        pairs, flat, edges = pairs + d.size, flat + int((d <= FLAT).sum()), edges + int((d >= EDGE).sum())
    return pairs > 0 and flat / pairs >= FLAT_SHARE and edges / pairs >= EDGE_SHARE


def has_many_colors(px: np.ndarray) -> bool:
    """Whether there are more than MANY_COLORS colours; looking ends when there are."""
    flat, seen = px.reshape(-1, px.shape[2]), np.empty(0, np.uint32)
    for lo in range(0, len(flat), BLOCK):
        own = flat[lo : lo + BLOCK].astype(np.uint32)
        seen = np.union1d(seen, own[:, 0] << 16 | own[:, 1] << 8 | own[:, 2] if own.shape[1] == 3 else own[:, 0])
        if len(seen) > MANY_COLORS:
            return True
    return False


def is_grey(px: np.ndarray) -> bool:
    """Whether every GREY_STEP-th pixel has equal channels."""
    some = px.reshape(-1, px.shape[2])[::GREY_STEP]
    return px.shape[2] == 1 or bool((some == some[:, :1]).all())


def image_kinds(images: DataFrame, key: list[str], width: str, channels: str, pixels: str) -> DataFrame:
    """(key, graphic, many_colors, grey) of decoded images: rows of ``width`` pixels of one or three bytes each.

    Pixels that do not fill a row count in none; an image without a row is no drawing, has few colours and is grey.
    """

    @F.arrow_udf("struct<graphic: boolean, many_colors: boolean, grey: boolean>")
    def judge(widths: pa.Array, kinds: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for w, c, raw in zip(widths.to_pylist(), kinds.to_pylist(), data, strict=True):
            size = (w or 0) * (c or 0)
            raw = np.frombuffer(raw.as_buffer(), np.uint8) if raw.is_valid and size else np.empty(0, np.uint8)
            px = raw[: len(raw) // size * size].reshape(-1, w, c) if size else np.empty((0, 1, 1), np.uint8)
            out.append({"graphic": is_graphic(px), "many_colors": has_many_colors(px), "grey": is_grey(px)})
        return pa.array(out, pa.struct([(n, pa.bool_()) for n in ("graphic", "many_colors", "grey")]))

    return images.select(*key, judge(F.col(width), F.col(channels), F.col(pixels)).alias("j")).select(*key, "j.*")
