"""Images as rows, their connected pixels, and lane markings on edges."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.operators import camera, image_lanes
from waymesh.sources import documents, images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows, colour, filters, depth=8, palette=None):
    """A PNG of rows of bytes (height, width, samples), each row stored by the filter of its turn."""
    height, width, step = rows.shape
    raw, above = b"", [0] * (width * step)
    for k in range(height):
        kind, flat = filters[k % len(filters)], rows[k].reshape(-1).tolist()
        out = []
        for i, v in enumerate(flat):
            left = flat[i - step] if i >= step else 0
            corner = above[i - step] if i >= step else 0
            p = left + above[i] - corner
            paeth = min(((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner)))[2]
            out.append((v - (0, left, above[i], (left + above[i]) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *out])
        above = flat
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width // (depth // 8), height, depth, colour, 0, 0, 0))
    data = zlib.compress(raw)
    more = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + head + more + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def test_png_and_ppm_are_read(rng=np.random.default_rng(1)):
    rgb = rng.integers(0, 256, (13, 9, 3)).astype(np.uint8)
    assert np.array_equal(images.pixels(png(rgb, 2, (0, 1, 2, 3, 4))), rgb)
    assert np.array_equal(images.pixels(png(np.dstack([rgb, rgb[:, :, :1]]), 6, (4, 3))), rgb)
    grey = rng.integers(0, 256, (7, 5, 1)).astype(np.uint8)
    assert np.array_equal(images.pixels(png(grey, 0, (3,))), np.repeat(grey, 3, 2))
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
    assert np.array_equal(images.pixels(png(grey, 3, (1,), palette=palette)), palette[grey[:, :, 0]])
    assert np.array_equal(images.pixels(b"P6\n# note\n9 13\n255\n" + rgb.tobytes()), rgb)
    for bad in (b"", b"\xff\xd8\xff", b"P6 3 3 255\n12", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"junk")):
        with pytest.raises(ValueError):
            images.pixels(bad)


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for start in np.argwhere(mask):
        if label[tuple(start)]:
            continue
        n, stack = n + 1, [tuple(start)]
        while stack:
            r, c = stack.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not label[r, c]:
                label[r, c] = n
                stack += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return label


def test_components_are_those_of_a_flood_fill(rng=np.random.default_rng(2)):
    spiral = np.zeros((21, 21), bool)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[k : 21 - k, 20 - k] = spiral[20 - k, k : 21 - k] = spiral[k + 2 : 21 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    for mask in [spiral, np.ones((4, 5), bool), np.zeros((3, 3), bool), *(rng.random((17, 23)) < p for p in (0.2, 0.5, 0.6, 0.9))]:
        label, (row, first, end) = image_lanes.components(mask)
        got = np.zeros(mask.shape, int)
        for n, r, a, b in zip(label, row, first, end, strict=True):
            got[r, a:b] = n + 1
        assert np.array_equal(got, flood(mask))


def test_hue_saturation_and_value(rng=np.random.default_rng(3)):
    import colorsys

    rgb = np.concatenate([rng.integers(0, 256, (200, 3)), [(0, 0, 0), (255, 255, 255), (9, 9, 9), (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0)]]).astype(np.uint8)
    h, s, v = image_lanes.hsv(rgb)
    want = np.array([colorsys.rgb_to_hsv(*(c / 255 for c in x)) for x in rgb.tolist()])
    assert np.allclose(h, want[:, 0] * 360, atol=1e-3) and np.allclose(s, want[:, 1], atol=1e-6) and np.allclose(v, want[:, 2], atol=1e-6)


def test_markings_of_files_on_edges(spark, tmp_path):
    road = np.full((480, 640, 3), 40, np.uint8)
    road[300:470, 318:322] = 240  # white, straight ahead
    road[320:400, 500:506] = (255, 170, 0)  # yellow
    road[10:13, 10:13] = 255  # too small
    road[100:120, 5:300:2] = 255  # short stripes
    (tmp_path / "a.png").write_bytes(png(road, 2, (0, 1, 2)))
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8 not read, but the PNG counts")
    (tmp_path / "b.jpeg").write_bytes(b"\xff\xd8")
    (tmp_path / "c.ppm").write_bytes(b"P6 4 4 255\n" + bytes(48))
    (tmp_path / "note.txt").write_text("no image")
    found = image_lanes.image_markings(images.image_files(spark, str(tmp_path)))
    got = {r["image_id"]: r for r in found.collect()}
    assert set(got) == {"a", "b", "c"} and got["b"]["lanes"] is None and "PNG" in got["b"]["error"] and got["c"]["lanes"] == []
    white, yellow = got["a"]["lanes"]
    assert (white["kind"], white["top"], white["left"], white["bottom"], white["right"], white["pixels"], white["u"], white["v"]) == ("white", 300, 318, 469, 321, 680, 319.5, 384.5)
    assert yellow["kind"] == "yellow" and math.isclose(yellow["length_px"], math.hypot(79, 5))
    view = camera.Calibration(500.0, 500.0, 320.0, 240.0, shift=(0.0, 0.0, 1.5))
    edges = spark.createDataFrame([(0, "e", "p", "q", [(0.0, 1.0), (50.0, 1.0)]), (1, "d", "p", "q", [(50.0, -3.0), (0.0, -3.0)])], "ord long, edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>")
    poses = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("c", 0.0, 0.0, None)], "image_id string, pose_x_m double, pose_y_m double, heading_rad double")
    placed = image_lanes.markings_on_edges(found, poses, view, edges, max_dist=3.5)
    rows = {r["kind"]: r for r in placed.collect()}
    ahead = 1.5 * 500 / (384.5 - 240)
    assert math.isclose(rows["white"]["x"], ahead) and math.isclose(rows["white"]["y"], 0.5 / 500 * ahead) and (rows["white"]["edge_id"], rows["white"]["side"]) == ("e", "right")
    # to the right of the camera lies the road that comes back, on whose left it is
    assert (rows["yellow"]["edge_id"], rows["yellow"]["side"]) == ("d", "right" if rows["yellow"]["y"] > -3.0 else "left")
    assert math.isclose(rows["white"]["confidence"], math.hypot(169, 3) / 200) and rows["yellow"]["confidence"] < 1
    assert image_lanes.markings_on_edges(found, poses, view, edges, max_dist=0.1).count() == 0
    doc = json.loads("".join(r["value"] for r in documents.camera_lanes_json(placed).orderBy("part", "ord").collect()))
    assert [x["kind"] for x in doc["camera_lanes"]] == ["white", "yellow"] and len(doc["camera_lanes"][0]["world_xy_m"]) == 2
    assert image_lanes.image_markings(images.image_files(spark, str(tmp_path)).where(F.lit(False))).count() == 0
