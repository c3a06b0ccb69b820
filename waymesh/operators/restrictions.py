"""Turn restrictions of OSM relations on the edges of a graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geometry import distance, lonlat_to_metres, polyline_length
from waymesh.operators.spatial import nearest_nodes
from waymesh.operators.topology import edge_ends


def convert_restrictions(elements: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame, lat0: float, lon0: float, max_snap: float = 25.0, min_alignment: float = 0.3) -> DataFrame:
    """Rows (relation_id, restriction, junction_node_id, from_edge_id, from_direction, to_edge_id, to_direction, skipped).

    The via node snaps to the nearest graph node within `max_snap`. Each way's side is
    the edge there whose tangent is most along the way's first step away from the via
    node, with a cosine of at least `min_alignment`; the to edge differs from the from
    edge unless the turn is a U-turn or both are one way. skipped names the first
    thing that is missing, null for the rows that hold. A vehicle comes in on from,
    so from_direction is reverse where that edge begins at the junction.
    """
    kind = F.element_at("tags", F.lit("restriction"))
    member = lambda role, type_: F.element_at(F.filter("members", lambda m: (m["role"] == role) & (m["type"] == type_)), F.lit(1))
    rel = elements["relations"].where(F.element_at("tags", F.lit("type")) == "restriction")
    has = lambda role, type_: F.exists("members", lambda m: (m["role"] == role) & (m["type"] == type_))
    rel = rel.select(
        F.col("id").alias("relation_id"), kind.alias("restriction"),
        F.when(has("from", "way"), member("from", "way")["ref"]).alias("from_way"), F.when(has("to", "way"), member("to", "way")["ref"]).alias("to_way"), F.when(has("via", "node"), member("via", "node")["ref"]).alias("via"),
    )
    x, y = lonlat_to_metres(F.col("lon"), F.col("lat"), lat0, lon0)
    places = elements["nodes"].select(F.col("id").alias("place"), x.alias("px"), y.alias("py")).dropDuplicates(["place"])
    rel = rel.join(places.select(F.col("place").alias("via"), F.col("px").alias("x"), F.col("py").alias("y")), "via", "left")
    near = nearest_nodes(rel.where("x is not null").select(F.col("relation_id").alias("key"), "x", "y"), nodes, max_snap, within=True)
    rel = rel.join(near.select(F.col("key").alias("relation_id"), F.col("node_id").alias("junction_node_id")), "relation_id", "left")

    steps = elements["ways"].select(F.col("id").alias("way"), F.posexplode("nodes").alias("k", "place")).join(places, "place")
    order = Window.partitionBy("way").orderBy("k")
    steps = steps.withColumns({f"{c}{n}": f(c).over(order) for c in ("px", "py") for n, f in ((0, F.lag), (1, F.lead))})
    beside = F.array(*(F.struct(F.col(f"px{n}").alias("x"), F.col(f"py{n}").alias("y")) for n in (0, 1)))
    steps = steps.select("way", "place", "px", "py", F.explode(beside).alias("q")).where("q.x is not null")
    away = steps.select("way", F.col("place").alias("via"), (F.col("q.x") - F.col("px")).alias("dx"), (F.col("q.y") - F.col("py")).alias("dy"), distance(F.col("px"), F.col("py"), F.col("q.x"), F.col("q.y")).alias("far")).where("far > 0")
    away = away.groupBy("way", "via").agg(F.min(F.struct("far", "dx", "dy")).alias("v")).select("way", "via", (F.col("v.dx") / F.col("v.far")).alias("ux"), (F.col("v.dy") / F.col("v.far")).alias("uy"))

    size = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    ends = edge_ends(edges).where(size > 0).select(F.col("node_id").alias("junction_node_id"), "edge_id", "ord", "at_end", (F.col("tx") / size).alias("tx"), (F.col("ty") / size).alias("ty"))

    def sides(role: str) -> DataFrame:
        along = rel.select("relation_id", "via", "junction_node_id", F.col(f"{role}_way").alias("way")).join(away, ["way", "via"]).join(ends, "junction_node_id")
        score = F.col("tx") * F.col("ux") + F.col("ty") * F.col("uy")
        return along.withColumn("score", score).where(F.col("score") >= min_alignment).select("relation_id", F.col("edge_id").alias(f"{role}_edge_id"), "ord", "at_end", "score")

    first = sides("from").groupBy("relation_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "from_edge_id", "at_end")).alias("f"))
    first = first.select("relation_id", "f.from_edge_id", F.when(F.col("f.at_end"), "forward").otherwise("reverse").alias("from_direction"))
    second = sides("to").join(first, "relation_id").join(rel.select("relation_id", "restriction", (F.col("from_way") == F.col("to_way")).alias("one")), "relation_id")
    second = second.where((F.col("to_edge_id") != F.col("from_edge_id")) | F.col("one") | F.col("restriction").contains("u_turn"))
    second = second.groupBy("relation_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "to_edge_id", "at_end")).alias("t"))
    second = second.select("relation_id", "t.to_edge_id", F.when(F.col("t.at_end"), "reverse").otherwise("forward").alias("to_direction"))
    out = rel.join(first, "relation_id", "left").join(second, "relation_id", "left")
    skipped = (
        F.when(F.col("from_way").isNull() | F.col("to_way").isNull() | F.col("via").isNull(), "members_missing").when(F.col("x").isNull(), "via_unknown")
        .when(F.col("junction_node_id").isNull(), "via_far_from_graph").when(F.col("from_edge_id").isNull(), "no_from_edge").when(F.col("to_edge_id").isNull(), "no_to_edge")
    )
    return out.select("relation_id", "restriction", "junction_node_id", "from_edge_id", "from_direction", "to_edge_id", "to_direction", skipped.alias("skipped"))


def elevate(nodes: DataFrame, edges: DataFrame, samples: DataFrame, radius: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Nodes with elevation_m, and edges with polyline_z and slope_deg, of the nearest samples (trace_id, ord, x, y, z).

    Each vertex takes the height of its nearest sample, the first of a trace in order
    where several are as near. The slope is the angle of the rise from the first to the
    last vertex over the length, 0 on an edge without length.
    """
    heights = samples.select(F.concat_ws("/", "trace_id", "ord").alias("id"), F.struct("trace_id", "ord").alias("ord"), "x", "y", "z")

    def height(points: DataFrame) -> DataFrame:
        return nearest_nodes(points, heights.select("id", "ord", "x", "y"), radius).join(heights.select(F.col("id").alias("node_id"), "z"), "node_id").select("key", "z")

    high = nodes.join(height(nodes.select(F.col("id").alias("key"), "x", "y")).select(F.col("key").alias("id"), F.col("z").alias("elevation_m")), "id", "left")
    vertices = edges.select("edge_id", F.posexplode("polyline").alias("k", "p")).select(F.struct("edge_id", "k").alias("key"), "p.x", "p.y")
    lines = height(vertices).groupBy("key.edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key.k", "z"))), lambda s: s["z"]).alias("polyline_z"))
    length = polyline_length("polyline")
    slope = F.atan2(F.element_at("polyline_z", -1) - F.element_at("polyline_z", 1), length) * (180.0 / math.pi)
    return high, edges.join(lines, "edge_id", "left").withColumn("slope_deg", F.when(length > 1e-6, slope).otherwise(0.0))
