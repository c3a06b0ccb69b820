"""Lane markings in camera images: colour masks, connected pixels, and their places on the road's edges."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.camera import Calibration, pixel_on_ground, rotation
from waymesh.operators.spatial import snap
from waymesh.plans.components import union_pairs
from waymesh.sources.images import pixels


@dataclass(frozen=True)
class Settings:
    """white: least brightness of white (0 to 255). hue: degrees of yellow. saturation: least of yellow (0 to 255). length, size: pixels of a marking at least."""

    white: int = 200
    hue: tuple[float, float] = (20.0, 40.0)
    saturation: int = 100
    length: int = 30
    size: int = 10


#: Brightness of white from which on its colour is too strong to be white.
WHITE_SATURATION = np.float32(0.3)
LANE = "kind string, u double, v double, top int, left int, bottom int, right int, pixels int, length_px double"


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value (0 to 1) of an array of colours; grey has hue 0."""
    r, g, b = np.moveaxis(rgb.astype(np.float32) / np.float32(255), -1, 0)
    value = rgb.max(-1).astype(np.float32) / np.float32(255)
    spread = value - rgb.min(-1).astype(np.float32) / np.float32(255)
    some = np.where(spread > 0, spread, np.float32(1))
    sixth = np.select([spread <= 0, value == r, value == g], [np.float32(0), (g - b) / some % 6, (b - r) / some + 2], (r - g) / some + 4)
    return sixth * 60 % 360, spread / np.where(value > 0, value, np.float32(1)), value


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of each run of set pixels of a row, in reading order."""
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1]


def components(mask: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A label for each run of a mask, and the runs: runs whose pixels touch by a side are one component.

    Labels count components in the order of their first pixels.
    """
    row, first, end = runs(mask)
    width = mask.shape[1] + 1
    low, high = row * width + first, row * width + end
    # a run touches those of the next row that end after its start and start before its end
    a = np.searchsorted(high, low + width, side="right")
    b = np.searchsorted(low, high + width, side="left")
    n = np.maximum(b - a, 0)
    one = np.repeat(np.arange(len(row)), n)
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    root = union_pairs(len(row), one, other)
    return np.unique(root, return_inverse=True)[1], (row, first, end)


def markings(rgb: np.ndarray, s: Settings = Settings()) -> list[dict]:
    """The markings of an image, white ones first: their middles (u, v), boxes and lengths."""
    hue, saturation, value = hsv(rgb)
    white = (value >= np.float32(s.white / 255)) & (saturation < WHITE_SATURATION)
    yellow = (hue >= s.hue[0]) & (hue <= s.hue[1]) & (saturation >= np.float32(s.saturation / 255))
    found = []
    for kind, mask in (("white", white), ("yellow", yellow)):
        label, (row, first, end) = components(mask)
        for k, some in enumerate(np.split(np.argsort(label, kind="stable"), np.flatnonzero(np.diff(np.sort(label))) + 1) if len(label) else ()):
            size = int((end[some] - first[some]).sum())
            top, left, bottom, right = int(row[some].min()), int(first[some].min()), int(row[some].max()), int(end[some].max()) - 1
            if size < s.size or max(bottom - top, right - left) < s.length:
                continue
            rows = np.repeat(row[some], end[some] - first[some])
            columns = np.concatenate([np.arange(a, b) for a, b in zip(first[some], end[some], strict=True)])
            found.append({"kind": kind, "u": float(np.median(columns)), "v": float(np.median(rows)), "top": top, "left": left, "bottom": bottom, "right": right, "pixels": size, "length_px": math.hypot(bottom - top, right - left)})
    return found


def image_markings(images: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Rows (image_id, lanes, error) of images (image_id, content[, rank]), one for each id.

    Of several files of an id the one of the lowest rank counts. An image that is not
    read has null lanes and says why; one without markings has none. Images are decoded
    where they lie and only their markings leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(2):
                try:
                    rows.append((markings(pixels(content.as_py() or b""), s), None))
                except ValueError as e:
                    rows.append((None, str(e)))
            lanes, errors = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lanes, pa.list_(shape)), pa.array(errors, pa.string())], names=["image_id", "rank", "lanes", "error"])

    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    shape = pa.struct([(name, kinds[kind]) for name, kind in (c.split() for c in LANE.split(", "))])
    rank = F.col("rank") if "rank" in images.columns else F.lit(0)
    rows = images.select(F.col("image_id").cast("string").alias("image_id"), rank.cast("int").alias("rank"), "content")
    fields = LANE.replace(" ", ": ").replace(",: ", ", ")
    found = rows.mapInArrow(run, f"image_id string, rank int, lanes array<struct<{fields}>>, error string")
    return found.groupBy("image_id").agg(F.min_by(F.struct("lanes", "error"), "rank").alias("b")).select("image_id", "b.*")


def markings_on_edges(found: DataFrame, poses: DataFrame, camera: Calibration, edges: DataFrame, ground: float = 0.0, max_dist: float = 3.5) -> DataFrame:
    """Rows (image_id, k, edge_id, x, y, kind, side, confidence): markings of `image_markings` on the nearest edge within `max_dist`.

    poses: (image_id, pose_x_m, pose_y_m, heading_rad) of the vehicle, 0 where null. A
    marking lies where its middle pixel meets the ground; above the horizon, or with no
    edge that near, it is left out. Its side is that of the edge's direction, and a
    marking of 200 pixels or more has confidence 1.
    """
    known = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("pose_x_m", "pose_y_m", "heading_rad")]
    seen = found.select("image_id", F.posexplode("lanes").alias("k", "lane")).join(poses.select(F.col("image_id").cast("string").alias("image_id"), *known), "image_id")
    x, y = pixel_on_ground(F.col("lane.u"), F.col("lane.v"), camera, (F.col("pose_x_m"), F.col("pose_y_m"), F.lit(0.0)), rotation(F.lit(0.0), F.lit(0.0), F.col("heading_rad")), ground)
    placed = seen.withColumns({"x": x, "y": y}).where("x is not null").select("image_id", "k", "lane", "x", "y")
    near = snap(placed, edges, math.nextafter(max_dist, math.inf), keys=("image_id", "k")).where("edge_id is not null").join(edges.select("edge_id", "polyline"), "edge_id")
    a, b = (F.element_at("polyline", (F.col("seg_ord") + k).cast("int")) for k in (1, 2))
    cross = (b["x"] - a["x"]) * (F.col("y") - F.col("qy")) - (b["y"] - a["y"]) * (F.col("x") - F.col("qx"))
    side = F.when(cross > 0, "left").otherwise("right")
    return near.select("image_id", "k", "edge_id", "x", "y", "lane.kind", side.alias("side"), F.least(F.lit(1.0), F.col("lane.length_px") / 200.0).alias("confidence"))
