"""Camera observations: poses, pixels on the ground and on edges, and what they say about edges and turns."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators.spatial import snap
from waymesh.plans.numbering import numbered

Matrix = tuple[tuple, tuple, tuple]


def rotation(roll, pitch, yaw) -> Matrix:
    """Rotation about x by roll, then about y by pitch, then about z by yaw; angles are radians, as numbers or Columns."""
    plain = all(isinstance(v, (int, float)) for v in (roll, pitch, yaw))
    sin, cos = (math.sin, math.cos) if plain else (F.sin, F.cos)
    roll, pitch, yaw = ((v if plain or isinstance(v, Column) else F.lit(v)) for v in (roll, pitch, yaw))
    (sr, cr), (sp, cp), (sy, cy) = ((sin(v), cos(v)) for v in (roll, pitch, yaw))
    return (
        (cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr),
        (sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr),
        (-sp, cp * sr, cp * cr),
    )


def moved(matrix: Matrix, vector, shift=(0.0, 0.0, 0.0)) -> tuple:
    """A vector, rotated and shifted."""
    return tuple(sum((m * v for m, v in zip(row[1:], vector[1:], strict=True)), row[0] * vector[0]) + s for row, s in zip(matrix, shift, strict=True))


@dataclass(frozen=True)
class Calibration:
    """A pinhole camera (fx, fy, cx, cy, distortion k1, k2, p1, p2, k3) mounted on a vehicle.

    mount turns vectors of the camera's body frame (ahead, left, up) to the vehicle's,
    shift is the camera's place there.
    """

    fx: float
    fy: float
    cx: float
    cy: float
    distortion: tuple[float, float, float, float, float] = (0.0, 0.0, 0.0, 0.0, 0.0)
    mount: Matrix = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)


def read_calibration(spark: SparkSession, path: str) -> Calibration:
    """The calibration of a JSON document: intrinsic, and camera_to_vehicle with rotation_matrix or rotation_rpy_rad and translation_m."""
    doc = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if "intrinsic" not in doc:
        raise KeyError("a calibration needs intrinsic")
    inner, outer = doc["intrinsic"], doc.get("camera_to_vehicle") or {}
    shift = tuple(map(float, outer.get("translation_m", (0.0, 0.0, 0.0))))
    if "rotation_matrix" in outer:
        mount = tuple(tuple(map(float, row)) for row in outer["rotation_matrix"])
    else:
        mount = rotation(*map(float, outer.get("rotation_rpy_rad", (0.0, 0.0, 0.0))))
    if len(shift) != 3 or len(mount) != 3 or any(len(row) != 3 for row in mount):
        raise ValueError("camera_to_vehicle needs a 3 x 3 rotation and 3 metres")
    bent = inner.get("distortion") or {}
    return Calibration(*(float(inner[c]) for c in ("fx", "fy", "cx", "cy")), tuple(float(bent.get(c, 0.0)) for c in ("k1", "k2", "p1", "p2", "k3")), mount, shift)


def undistorted(u: Column, v: Column, camera: Calibration, rounds: int = 12) -> tuple[Column, Column]:
    """Directions to the right and down of a pixel, one metre ahead; distortion is undone by fixed-point iteration."""
    x0, y0 = (u - camera.cx) / camera.fx, (v - camera.cy) / camera.fy
    k1, k2, p1, p2, k3 = camera.distortion
    if not any(camera.distortion):
        return x0, y0

    def step(acc: Column, _: Column) -> Column:
        a, b = acc["a"], acc["b"]
        r2 = a * a + b * b
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
        return F.struct(((x0 - (2 * p1 * a * b + p2 * (r2 + 2 * a * a))) / radial).alias("a"), ((y0 - (p1 * (r2 + 2 * b * b) + 2 * p2 * a * b)) / radial).alias("b"))

    plain = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x0.alias("a"), y0.alias("b")), step)
    return plain["a"], plain["b"]


def pixel_on_ground(u: Column, v: Column, camera: Calibration, place: tuple, turned: Matrix, ground: float = 0.0) -> tuple[Column, Column]:
    """Where a pixel's ray meets the ground, of a vehicle at `place` turned by a matrix; null at or above the horizon."""
    right, down = undistorted(u, v, camera)
    ray = moved(turned, moved(camera.mount, (F.lit(1.0), -right, -down)))
    eye = moved(turned, tuple(F.lit(s) for s in camera.shift), place)
    far = (ground - eye[2]) / F.when(F.abs(ray[2]) < 1e-9, None).otherwise(ray[2])
    far = F.when(far > 0, far)
    return eye[0] + far * ray[0], eye[1] + far * ray[1]


def ground_to_pixel(x: Column, y: Column, z: Column, camera: Calibration, place: tuple, turned: Matrix) -> tuple[Column, Column]:
    """The pixel in which a point of the world is seen, null if it lies behind the camera."""
    back = lambda m: tuple(zip(*m, strict=True))
    own = moved(back(turned), tuple(a - b for a, b in zip((x, y, z), place, strict=True)))
    ahead, left, up = moved(back(camera.mount), tuple(a - b for a, b in zip(own, camera.shift, strict=True)))
    a, b = -left / F.when(ahead > 1e-9, ahead), -up / F.when(ahead > 1e-9, ahead)
    k1, k2, p1, p2, k3 = camera.distortion
    r2 = a * a + b * b
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    return (camera.fx * (a * radial + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + camera.cx, camera.fy * (b * radial + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + camera.cy)


def image_detections(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pos, image_id, x, y, z, roll, pitch, yaw, kind, u, v, confidence, extra) of a document's detections, one for each.

    A pose without angles is level; extra is the whole detection as JSON.
    """
    shape = "array<struct<image_id:string,pose:struct<translation_m:array<double>,rotation_rpy_rad:array<double>>,detections:array<string>>>"
    text = spark.read.text(path, wholetext=True)
    images = text.select(F.posexplode(F.from_json("value", f"struct<image_detections:{shape}>")["image_detections"]).alias("image", "i"))
    rows = images.select("image", "i.image_id", "i.pose", F.posexplode("i.detections").alias("k", "item"))
    known = F.from_json("item", "struct<kind:string,pixel:struct<u:double,v:double>,confidence:double>")
    place = [F.element_at("pose.translation_m", k + 1).alias(c) for k, c in enumerate("xyz")]
    angles = [F.coalesce(F.element_at("pose.rotation_rpy_rad", k + 1), F.lit(0.0)).alias(c) for k, c in enumerate(("roll", "pitch", "yaw"))]
    rows = rows.select("image", "k", "image_id", *place, *angles, known.alias("d"), F.col("item").alias("extra"))
    return rows.select((F.col("image") * 1_000_000 + F.col("k")).alias("pos"), "image_id", *"xyz", "roll", "pitch", "yaw", "d.kind", "d.pixel.u", "d.pixel.v", "d.confidence", "extra")


def project_detections(detections: DataFrame, camera: Calibration, ground: float = 0.0) -> DataFrame:
    """Detections (pos, x, y, z, roll, pitch, yaw, kind, u, v, ...) with gx, gy, their place on the ground; null above the horizon.

    Rows without a kind or a pixel are left out.
    """
    seen = detections.where("kind <> '' and u is not null and v is not null")
    gx, gy = pixel_on_ground(F.col("u"), F.col("v"), camera, tuple(F.col(c) for c in "xyz"), rotation(*(F.col(c) for c in ("roll", "pitch", "yaw"))), ground)
    return seen.withColumns({"gx": gx, "gy": gy})


def observations_on_edges(detections: DataFrame, camera: Calibration, edges: DataFrame, ground: float = 0.0, max_dist: float = 5.0) -> DataFrame:
    """Detections with edge_id, arc and distance_m of the nearest edge closer than `max_dist`, and fate.

    fate: on_edge, no_edge or above_horizon, so that counts by fate are the report.
    """
    placed = project_detections(detections, camera, ground)
    rest = [c for c in placed.columns if c != "pos"]
    # detections go through the snapping themselves, so that they are neither made twice nor joined back
    points = placed.withColumnsRenamed({"x": "_x", "y": "_y"}).withColumns({"x": F.col("gx"), "y": F.col("gy")})
    near = snap(points, edges, max_dist, keys=("pos",))
    fate = F.when(F.col("gx").isNull(), "above_horizon").when(F.col("edge_id").isNull(), "no_edge").otherwise("on_edge")
    own = [F.col(f"_{c}").alias(c) if c in ("x", "y") else F.col(c) for c in rest]
    return near.select("pos", *own, "edge_id", "arc", F.col("d").alias("distance_m"), fate.alias("fate"))


def apply_observations(edges: DataFrame, observations: DataFrame) -> DataFrame:
    """Edges of `hd.enrich` whose semantic_rules end with their observations (pos, edge_id, rule), rule being JSON, in order."""
    rules = observations.where("edge_id is not null").groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule"))), lambda r: r["rule"]).alias("_rules"))
    out = edges.join(rules, "edge_id", "left")
    more = F.concat(F.coalesce("hd.semantic_rules", F.array().cast("array<string>")), F.coalesce("_rules", F.array().cast("array<string>")))
    hd = F.struct(*((more if c == "semantic_rules" else F.col(f"hd.{c}")).alias(c) for c in edges.schema["hd"].dataType.names))
    return out.withColumn("hd", hd).drop("_rules")


def restrictions_seen(observations: DataFrame) -> DataFrame:
    """Turn restrictions among observations (pos, kind, item), item being JSON, as `tables.turn_restrictions` has them.

    Only kind turn_restriction with a junction_node_id counts; missing ids are numbered
    among those in their order, directions default to forward and the source to
    camera_detection.
    """
    fields = "id:string,junction_node_id:string,from_edge_id:string,from_direction:string,to_edge_id:string,to_direction:string,restriction:string,source:string,confidence:double"
    rows = observations.where("kind = 'turn_restriction'").select("pos", F.from_json("item", f"struct<{fields}>").alias("r")).select("pos", "r.*").where("junction_node_id <> ''")
    rows = numbered(rows, "pos", name="_n")
    filled = {"id": F.format_string("tr_camera_%04d", "_n"), "from_direction": F.lit("forward"), "to_direction": F.lit("forward"), "source": F.lit("camera_detection")}
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in filled.items()}).drop("_n")
