"""Turn-by-turn steps of routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geometry import heading_change, polyline_length


def category(change: Column, slight: float = 20.0, sharp: float = 120.0, u_turn: float = 165.0) -> Column:
    """What a change of heading in degrees is called."""
    side = F.when(change > 0, "left").otherwise("right")
    size = F.abs(change)
    return F.when(size >= u_turn, "u_turn").when(size >= sharp, F.concat(F.lit("sharp_"), side)).when(size >= slight, side).otherwise("straight")


#: What a step is called, before its edge's id.
PHRASES = {
    "depart": "Depart on", "arrive": "Arrive at destination on", "straight": "Continue straight on",
    "left": "Turn left onto", "sharp_left": "Sharp left onto", "right": "Turn right onto", "sharp_right": "Sharp right onto", "u_turn": "Make a U-turn onto",
}


def describe(maneuver: Column, edge_id: Column) -> Column:
    phrase = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for item in PHRASES.items() for v in item)), maneuver), F.lit("Proceed on"))
    return F.concat(phrase, F.lit(" "), edge_id)


def guidance(routes: DataFrame, edges: DataFrame, nav: DataFrame | None = None) -> DataFrame:
    """Rows (from_node, to_node, k, edge_id, start_m, length_m, change_deg, maneuver, text) of routes (from_node, to_node, edges).

    The maneuver is the turn at the start of an edge; the first is depart, the last
    arrive. Lengths are metres. With the rows of `topology.sd_nav_edges`, steps have
    sd_nav_maneuvers, what is allowed at the end of the edge along it; none for an edge
    that is not there.
    """
    steps = routes.select("from_node", "to_node", F.posexplode("edges").alias("k", "step"))
    parts = F.split("step", "/")
    steps = steps.withColumns({"edge_id": parts[0], "back": parts[1] == "reverse"}).join(edges.select("edge_id", "polyline"), "edge_id")
    line = F.when(F.col("back"), F.reverse("polyline")).otherwise(F.col("polyline"))
    steps = steps.withColumn("line", line).withColumn("length_m", polyline_length("line"))
    heading = lambda a, b: F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    n = F.size("line")
    steps = steps.withColumns({"enter": heading(F.element_at("line", 1), F.element_at("line", 2)), "leave": heading(F.element_at("line", n - 1), F.element_at("line", n))})
    way = Window.partitionBy("from_node", "to_node").orderBy("k")
    change = heading_change(F.lag("leave").over(way), F.col("enter"))
    steps = steps.withColumns({
        "start_m": F.coalesce(F.sum("length_m").over(way.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "change_deg": F.coalesce(change, F.lit(0.0)), "last": F.lead("k").over(way).isNull(),
    })
    maneuver = F.when(F.col("k") == 0, "depart").when(F.col("last"), "arrive").otherwise(category(F.col("change_deg")))
    steps = steps.withColumn("maneuver", maneuver)
    out = steps.select("from_node", "to_node", "k", "edge_id", "start_m", "length_m", "change_deg", "maneuver", describe(F.col("maneuver"), F.col("edge_id")).alias("text"))
    if nav is None:
        return out
    allowed = F.filter(F.split("allowed", ","), lambda m: m != "")
    none = F.array().cast("array<string>")
    return out.join(nav.select("edge_id", allowed.alias("sd_nav_maneuvers")), "edge_id", "left").withColumn("sd_nav_maneuvers", F.coalesce("sd_nav_maneuvers", none))
