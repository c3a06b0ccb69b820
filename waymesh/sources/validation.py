"""Rules that tables and documents keep, as rows of what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.sources.tables import RESTRICTIONS


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows (key, rule) for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items())))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def check_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (key, rule): ids are there and used once, places are finite, edges have two points and known ends."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    twice = lambda df, c: df.groupBy(c).count().where("count > 1").select(F.col(c).alias("key"), F.lit(f"{c}_unique").alias("rule"))
    unknown = lambda c: edges.join(nodes.select(F.col("id").alias(c)), c, "left_anti").select(F.col("edge_id").alias("key"), F.lit(f"{c}_known").alias("rule"))
    parts = [
        violations(nodes, "id", {"id": F.col("id").isNotNull(), "x": finite("x"), "y": finite("y")}),
        violations(edges, "edge_id", {"edge_id": F.col("edge_id").isNotNull(), "polyline": F.size("polyline") >= 2}),
        twice(nodes, "id"), twice(edges, "edge_id"), unknown("start_node_id"), unknown("end_node_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_restrictions(rows: DataFrame) -> DataFrame:
    """Rows (key, rule) of turn restrictions."""
    way = lambda c: F.col(c).isin("forward", "reverse")
    return violations(rows, "id", {
        "junction_node_id": F.col("junction_node_id").isNotNull(), "from_edge_id": F.col("from_edge_id").isNotNull(), "to_edge_id": F.col("to_edge_id").isNotNull(),
        "from_direction": way("from_direction"), "to_direction": way("to_direction"), "restriction": F.col("restriction").isin(*RESTRICTIONS),
        "confidence": F.col("confidence").isNull() | F.col("confidence").between(0, 1),
    })


def check_observations(rows: DataFrame) -> DataFrame:
    """Rows (key, rule) of camera observations."""
    return violations(rows, "pos", {"edge_id": F.length("edge_id") > 0, "kind": F.length("kind") > 0, "confidence": F.col("confidence").isNull() | F.col("confidence").between(0, 1)})


def check_navigation(rows: DataFrame) -> DataFrame:
    """Rows (key, rule) of navigation edges: lengths, vertices and known maneuvers, straight among them."""
    allowed = lambda c: F.forall(F.split(c, ","), lambda m: m.isin("straight", "left", "right", "u_turn")) & F.array_contains(F.split(c, ","), "straight")
    return violations(rows, "edge_id", {"length_m": F.col("length_m") >= 0, "vertices": F.col("vertices") >= 2, "allowed": allowed("allowed"), "allowed_reverse": allowed("allowed_reverse")})


def check_guidance(steps: DataFrame) -> DataFrame:
    """Rows (key, rule) of guidance steps: lengths, starts, known maneuvers, depart first and alone there."""
    known = ("depart", "arrive", "straight", "left", "right", "sharp_left", "sharp_right", "u_turn")
    rows = steps.withColumn("_key", F.concat_ws("/", "from_node", "to_node", "k"))
    return violations(rows, "_key", {
        "edge_id": F.length("edge_id") > 0, "length_m": F.col("length_m") >= 0, "start_m": F.col("start_m") >= 0, "maneuver": F.col("maneuver").isin(*known),
        "depart": (F.col("k") == 0) == (F.col("maneuver") == "depart"), "change_deg": F.abs("change_deg") <= 180,
    })


def check_markings(rows: DataFrame) -> DataFrame:
    """Rows (key, rule) of lane markings: a known side, two points, and counted points."""
    return violations(rows.withColumn("_key", F.concat_ws("/", "edge_id", "track")), "_key", {
        "edge_id": F.length("edge_id") > 0, "side": F.col("side").isin("left", "right", "center"), "polyline": F.size("polyline") >= 2, "points": F.col("points") >= 1, "intensity": F.col("intensity") >= 0,
    })


def check_manifest(manifests: DataFrame) -> DataFrame:
    """Rows (key, rule) of manifests (value, a JSON document): version, an origin on the globe, files and counts."""
    parsed = manifests.select(F.from_json("value", "struct<manifest_version:int,dataset:string,origin:struct<lat:double,lon:double>,files:array<string>,counts:map<string,bigint>>").alias("m")).select("m.*")
    counted = F.forall(F.map_values("counts"), lambda n: n >= 0)
    return violations(parsed.withColumn("_key", F.coalesce("dataset", F.lit(""))), "_key", {
        "manifest_version": F.col("manifest_version") == 1, "origin": F.col("origin.lat").between(-90, 90) & F.col("origin.lon").between(-180, 180), "files": F.size("files") >= 1, "counts": counted,
    })
