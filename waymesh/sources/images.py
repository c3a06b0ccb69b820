"""Images as rows: files of a folder by their id, and PNG and PPM bytes as arrays of pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Endings of image files; of several files of one id the first ending counts.
ENDINGS = ("png", "jpg", "jpeg", "PNG", "JPG", "JPEG", "ppm")
#: Samples of a pixel by PNG colour type: grey, colours, palette, grey and opacity, colours and opacity.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (image_id, rank, path, content) of a folder's images; image_id is the name without its ending, rank that of the ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)
    ending = F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)
    return files.select(name.alias("image_id"), F.array_position(F.array(*map(F.lit, ENDINGS)), ending).cast("int").alias("rank"), "path", "content")


def pixels(data: bytes) -> np.ndarray:
    """An image's (height, width, 3) array of red, green and blue bytes; ValueError says what is not read."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"P6":
        return _ppm(data)
    raise ValueError("only PNG and PPM are read")


def _ppm(data: bytes) -> np.ndarray:
    values, at = [], 2
    while len(values) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        values.append(int(data[at:end] or b"-1"))
        at = end
    width, height, most = values
    if width <= 0 or height <= 0 or most != 255 or len(data) - at - 1 < 3 * width * height:
        raise ValueError("a PPM has a size, 255 levels and all its pixels")
    return np.frombuffer(data, np.uint8, 3 * width * height, at + 1).reshape(height, width, 3)


def _png(data: bytes) -> np.ndarray:
    at, packed, palette = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if colour not in SAMPLES or depth not in (8, 16) or interlaced or (colour == 3 and palette is None):
        raise ValueError("a PNG has 8 or 16 bits for each sample and is not interlaced")
    step = SAMPLES[colour] * depth // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (1 + width * step)].reshape(height, 1 + width * step)
    except (zlib.error, ValueError) as e:
        raise ValueError("a PNG with broken pixels") from e
    image = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, width, step))[:, :, :: depth // 8]
    if colour == 3:
        return palette[np.minimum(image[:, :, 0], len(palette) - 1)]
    return np.repeat(image[:, :, :1], 3, axis=2) if colour in (0, 4) else image[:, :, :3]


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pixels of rows that are stored as differences to their left and upper neighbours."""
    out, above = np.empty_like(rows), np.zeros_like(rows[0])
    for k, (kind, row) in enumerate(zip(kinds, rows, strict=True)):
        if kind == 1:
            row = np.cumsum(row, axis=0, dtype=np.uint8)
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = _along(int(kind), row, above)
        elif kind:
            raise ValueError("a PNG with an unknown filter")
        out[k] = above = row
    return out


def _along(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row of which each pixel depends on the one before it: differences to a mean (3) or to the nearest neighbour (4)."""
    done = np.empty_like(row)
    for c in range(row.shape[1]):
        left = corner = 0
        values = []
        for x, up in zip(row[:, c].tolist(), above[:, c].tolist(), strict=True):
            if kind == 3:
                guess = (left + up) // 2
            else:
                # of the three, the one nearest to left + up - corner, in this order
                guess = min((left, up, corner), key=lambda v, g=left + up - corner: abs(g - v))
            left, corner = (x + guess) & 255, up
            values.append(left)
        done[:, c] = values
    return done
