"""What differs between two versions of a graph or map, and how a graph compares to mapped roads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import distance
from waymesh.operators.hd import _normal
from waymesh.operators.spatial import snap
from waymesh.operators.topology import resampled

# OSM tag (key, value) of a point and the kind of rule that it is.
REGULATORY = (
    ("highway", "traffic_signals", "traffic_light"),
    ("highway", "stop", "stop_line"),
    ("highway", "give_way", "stop_line"),
    ("highway", "crossing", "crosswalk"),
    ("highway", "speed_camera", "speed_camera"),
)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, field, old, new), as text: fields that differ, and field `missing` or `added` for rows of one side alone."""
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    a = old.select(F.col(key).alias("key"), F.lit(True).alias("_a"), *(text(c).alias(f"a_{c}") for c in columns))
    b = new.select(F.col(key).alias("key"), F.lit(True).alias("_b"), *(text(c).alias(f"b_{c}") for c in columns))
    both = a.join(b, "key", "full")
    field = lambda name, x, y: F.struct(F.lit(name).alias("field"), F.get_json_object(x, "$.v").alias("old"), F.get_json_object(y, "$.v").alias("new"))
    none = F.lit(None).cast("string")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), field(c, F.col(f"a_{c}"), F.col(f"b_{c}"))) for c in columns)))
    told = F.when(F.col("_b").isNull(), F.array(field("missing", none, none))).when(F.col("_a").isNull(), F.array(field("added", none, none))).otherwise(differ)
    return both.select("key", F.explode(told).alias("d")).select(F.col("key").cast("string").alias("key"), "d.*")


def drift(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Rows (kind, common, missing, added, max_m): nodes and edge vertices of two graphs and how far common ones moved."""
    def of(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("key", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("key", F.col("x").alias("bx"), F.col("y").alias("by")), "key", "full")
        apart = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        return both.agg(F.count(apart).alias("common"), F.count_if(F.col("bx").isNull()).alias("missing"), F.count_if(F.col("ax").isNull()).alias("added"), F.coalesce(F.max(apart), F.lit(0.0)).alias("max_m")).select(F.lit(kind).alias("kind"), "*")

    spots = lambda g: g["nodes"].select(F.col("id").alias("key"), "x", "y")
    points = lambda g: g["edges"].select("edge_id", F.posexplode("polyline").alias("k", "p")).select(F.concat_ws("/", "edge_id", "k").alias("key"), "p.x", "p.y")
    return of("node", spots(old), spots(new)).unionByName(of("vertex", points(old), points(new)))


def navigation_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of the rows of `topology.sd_nav_edges`."""
    return changes(old, new, "edge_id", ["start_node_id", "end_node_id", "allowed", "allowed_reverse"])


def feature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes of GeoJSON features (layer, ord, value) by layer and order: their geometry and their properties."""
    parts = lambda df: df.select(F.concat_ws("/", "layer", "ord").alias("key"), F.get_json_object("value", "$.geometry").alias("geometry"), F.get_json_object("value", "$.properties").alias("properties"))
    return changes(parts(old), parts(new), "key", ["geometry", "properties"])


def lanelet_changes(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Changes of the tables of two lanelet maps (see `lanelets.read_osm`) by element."""
    plain = lambda df, kind, columns: df.select(F.concat_ws("/", F.lit(kind), "id").alias("key"), *columns, F.array_sort(F.map_entries("tags")).alias("tags"))
    of = lambda name, columns: changes(plain(old[name], name, columns), plain(new[name], name, columns), "key", [*columns, "tags"])
    return reduce(DataFrame.unionByName, (of("nodes", ["lat", "lon"]), of("ways", ["refs"]), of("relations", ["members"])))


def middles(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, x, y): the point halfway along each line."""
    return resampled(lines.select(F.col(key).alias("key"), "polyline").where(F.size("polyline") >= 2), "polyline", 3).where("k = 1").select("key", "x", "y")


def lane_accuracy(edges: DataFrame, ways: DataFrame, radius: float = 20.0) -> DataFrame:
    """One row (edges, matched, mae, exact) of edges' lane_count against the lanes of the mapped way (way_id, lanes, polyline) nearest to their middle."""
    lines = ways.where("lanes is not null").select(F.col("way_id").alias("ord"), F.col("way_id").cast("string").alias("edge_id"), "polyline")
    near = snap(middles(edges, "edge_id"), lines, radius, keys=("key",)).where("edge_ord is not null").select(F.col("key").alias("edge_id"), F.col("edge_ord").alias("way_id"))
    both = edges.select("edge_id", F.coalesce("lane_count", F.lit(1)).alias("n")).join(near.join(ways.select("way_id", "lanes"), "way_id"), "edge_id", "left")
    off = F.abs(F.col("n") - F.col("lanes"))
    return both.agg(F.count("*").alias("edges"), F.count("lanes").alias("matched"), F.avg(off).alias("mae"), F.avg((off == 0).cast("double")).alias("exact"))


def regulatory_kind(tags: Column) -> Column:
    """The kind of rule that a mapped point's tags stand for, null for others."""
    kind = F.lit(None).cast("string")
    for key, value, name in reversed(REGULATORY):
        kind = F.when(F.element_at(tags, F.lit(key)) == value, name).otherwise(kind)
    return kind


def stop_line(x: Column, y: Column, a: Column, b: Column, width: float = 4.0) -> Column:
    """A line across the road from a to b through a point, from its right to its left, as arrays of x and y; null if the road has no direction."""
    n = _normal(a, b, 1e-9)
    end = lambda side: F.array(x + side * width / 2 * n["x"], y + side * width / 2 * n["y"])
    return F.when((n["x"] != 0) | (n["y"] != 0), F.array(end(-1.0), end(1.0)))


def mapped_rules(points: DataFrame, edges: DataFrame, radius: float = 20.0, width: float = 4.0, max_crossings: int | None = None) -> DataFrame:
    """Observations (pos, edge_id, kind, distance_m, rule) of mapped points (pos, x, y, tags) on the nearest edge closer than `radius`.

    rule is JSON with the point's place and how far it is from the edge, in millimetres;
    signs to stop or give way are stop lines, which cross the edge where the point
    projects to, and a speed camera has the whole number that its maxspeed begins with.
    `max_crossings` keeps the first crosswalks only, for displays.
    """
    known = points.withColumn("kind", regulatory_kind(F.col("tags"))).where("kind is not null")
    near = snap(known, edges, radius, keys=("pos",)).where("edge_id is not null").join(edges.select("edge_id", "polyline"), "edge_id")
    a, b = (F.element_at("polyline", (F.col("seg_ord") + k).cast("int")) for k in (1, 2))
    limit = F.regexp_extract(F.coalesce(F.element_at("tags", F.lit("maxspeed")), F.lit("")), r"^\s*([+-]?\d+(?:\.\d+)?)(?:\s|$)", 1)
    rule = F.struct(
        "edge_id", "kind", F.lit("osm_node").alias("source"), F.col("pos").alias("osm_id"), F.lit(1.0).alias("confidence"), F.round("d", 3).alias("match_distance_m"),
        F.struct(F.round("x", 3).alias("x"), F.round("y", 3).alias("y")).alias("world_xy_m"),
        F.when((F.col("kind") == "speed_camera") & (limit != ""), limit.try_cast("double").cast("int")).alias("value_kmh"),
        F.when(F.col("kind") == "stop_line", stop_line(F.col("qx"), F.col("qy"), a, b, width)).alias("polyline_m"),
    )
    found = near.select("pos", "edge_id", "kind", F.col("d").alias("distance_m"), F.to_json(rule).alias("rule"))
    if max_crossings is None:
        return found
    first = found.where("kind = 'crosswalk'").orderBy("pos").limit(max_crossings)
    return found.where("kind <> 'crosswalk'").unionByName(first)


def tagged(edges: DataFrame, ways: DataFrame, radius: float = 15.0) -> DataFrame:
    """Edges with way_id and tags of the mapped way (way_id, tags, polyline) nearest to their middle, null beyond the radius."""
    lines = ways.select(F.col("way_id").alias("ord"), F.col("way_id").cast("string").alias("edge_id"), "polyline")
    near = snap(middles(edges, "edge_id"), lines, radius, keys=("key",)).select(F.col("key").alias("edge_id"), F.col("edge_ord").alias("way_id"))
    return edges.join(near.join(ways.select("way_id", "tags"), "way_id", "left"), "edge_id", "left")


def graph_of_features(features: DataFrame, lat0: float, lon0: float) -> dict[str, DataFrame]:
    """Nodes (id, ord, x, y) and edges of GeoJSON features (layer, ord, value) as `documents.map_features` makes them."""
    from waymesh.functions.geometry import lonlat_to_metres

    props = lambda c: F.get_json_object("value", f"$.properties.{c}")
    spot = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<double>")
    line = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<double>>")
    x, y = lonlat_to_metres(F.col("c")[0], F.col("c")[1], lat0, lon0)
    nodes = features.where("layer = 'node'").select(props("node_id").alias("id"), "ord", spot.alias("c")).select("id", "ord", x.alias("x"), y.alias("y"))

    def point(c: Column) -> Column:
        px, py = lonlat_to_metres(c[0], c[1], lat0, lon0)
        return F.struct(px.alias("x"), py.alias("y"))

    edges = features.where("layer = 'centerline'").select(props("edge_id").alias("edge_id"), "ord", props("start_node_id").alias("start_node_id"), props("end_node_id").alias("end_node_id"), F.transform(line, point).alias("polyline"))
    return {"nodes": nodes, "edges": edges}


