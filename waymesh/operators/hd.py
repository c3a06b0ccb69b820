"""Lane-level geometry of edges: offset boundaries, widths from several sources, lanes, and their summaries.

Lines are arrays of structs x, y, offsets are metres to the left of the direction of
travel. Everything is a Column expression over an edge's own row, so that millions of
edges need no shuffle but the joins with what was observed on them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import let, polyline_length
from waymesh.operators.lanes import clusters_1d

LINE = "array<struct<x:double,y:double>>"
#: Widest miter, in offsets; sharper corners are bevelled.
MITER = 4.0


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _normal(a: Column, b: Column, least: float) -> Column:
    """Unit normal to the left of the way from a to b; zero if they lie within `least`."""
    def unit(d: Column) -> Column:
        size = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])
        return let(F.when(size >= least, 1.0 / F.greatest(size, F.lit(least))).otherwise(0.0), lambda s: _point(-d["y"] * s, d["x"] * s))

    return let(_point(b["x"] - a["x"], b["y"] - a["y"]), unit)


def shifted(line: str | Column, offset: Column) -> Column:
    """A line whose vertices move along the normal of the way from the vertex before to the one after."""
    line = F.col(line) if isinstance(line, str) else line

    def moved(line: Column) -> Column:
        n = F.size(line)

        def move(p: Column, i: Column) -> Column:
            normal = _normal(F.element_at(line, F.greatest(F.lit(1), i)), F.element_at(line, F.least(n, i + 2)), 1e-9)
            return let(normal, lambda v: _point(p["x"] + offset * v["x"], p["y"] + offset * v["y"]))

        return F.when((n < 2) | (F.abs(offset) < 1e-9), line).otherwise(F.transform(line, move))

    return let(line, moved)


def offset_line(line: str | Column, offset: Column, miter: float = MITER) -> Column:
    """A line at an even distance: vertices move along the bisector of their two sides' normals, far ones are bevelled.

    A side without length has no normal and the other one's counts; where the line turns
    back on itself, that of the side before. Less than two points give an empty line.
    """
    line = F.col(line) if isinstance(line, str) else line
    none = lambda v: (v["x"] == 0) & (v["y"] == 0)

    def join(p: Column, w: Column) -> Column:
        """The vertices at p for the normals u and v of its sides, their sum s and its size."""
        back = (w["size"] < 1e-12) & ~none(w["u"]) & ~none(w["v"])
        safe = F.when(w["size"] < 1e-12, 1.0).otherwise(w["size"])
        b = _point(*(F.when(back, w["u"][c]).otherwise(w["s"][c] / safe) for c in "xy"))
        own = F.when(none(w["u"]), w["v"]).otherwise(w["u"])

        def placed(q: Column) -> Column:
            at = lambda v: _point(p["x"] + offset * v["x"], p["y"] + offset * v["y"])
            along = F.when(none(q["own"]), 1.0).otherwise(q["b"]["x"] * q["own"]["x"] + q["b"]["y"] * q["own"]["y"])
            return let(along, lambda a: F.when((a < 1e-6) | (1.0 / F.greatest(a, F.lit(1e-6)) > miter), F.array(at(w["u"]), at(w["v"]))).otherwise(F.array(at(_point(q["b"]["x"] / a, q["b"]["y"] / a)))))

        return let(F.struct(b.alias("b"), own.alias("own")), placed)

    def offsetted(line: Column) -> Column:
        n = F.size(line)

        def corner(p: Column, i: Column) -> Column:
            before = _normal(F.element_at(line, F.greatest(F.lit(1), i)), p, 1e-12)
            after = _normal(p, F.element_at(line, F.least(n, i + 2)), 1e-12)
            sides = F.struct(before.alias("u"), after.alias("v"))
            summed = lambda w: F.struct(w["u"].alias("u"), w["v"].alias("v"), _point(w["u"]["x"] + w["v"]["x"], w["u"]["y"] + w["v"]["y"]).alias("s"))
            sized = lambda w: F.struct(w["u"].alias("u"), w["v"].alias("v"), w["s"].alias("s"), F.sqrt(w["s"]["x"] * w["s"]["x"] + w["s"]["y"] * w["s"]["y"]).alias("size"))
            # an end has one side, whose normal is the bisector
            return let(let(let(sides, summed), sized), lambda w: join(p, w))

        return F.when(n < 2, F.array().cast(LINE)).otherwise(F.flatten(F.transform(line, corner)))

    return let(line, offsetted)


def boundaries(line: str | Column, width: Column) -> tuple[Column, Column]:
    """Left and right boundary of a lane of that width along a line; empty for widths of 0 or less."""
    none = F.array().cast(LINE)
    return tuple(F.when(width > 0, offset_line(line, side * width / 2.0)).otherwise(none) for side in (1.0, -1.0))


def enrich(nodes: DataFrame, edges: DataFrame, lane_width: float | None = None, refinements: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with a column hd.

    Of an edge: tier, target_tier, quality, left, right, semantic_rules (JSON) and
    slope_deg; of a node: vertical_model and elevation_m. With a lane width, boundaries
    are the line's offsets; what an earlier hd has in its fields stays otherwise.
    Refinements (see `refinements`) then give edges their own widths.
    """
    none = F.array().cast(LINE)
    fields = {
        "tier": F.lit("sd_seed"), "target_tier": F.lit("hd"), "quality": F.lit("trajectory_derived"), "left": none, "right": none,
        "semantic_rules": F.array().cast("array<string>"), "slope_deg": F.lit(None).cast("double"),
    }
    fields = _kept(edges, fields)
    if "slope_deg" in edges.columns:
        fields["slope_deg"] = F.coalesce("slope_deg", fields["slope_deg"])
    if lane_width is not None and lane_width > 0:
        fields["left"], fields["right"] = boundaries("polyline", F.lit(float(lane_width)))
        fields["quality"] = F.when(F.size("polyline") >= 2, "centerline_offset").otherwise("trajectory_derived_insufficient_polyline")
    edges = edges.withColumn("hd", F.struct(*(v.alias(k) for k, v in fields.items())))
    height = _kept(nodes, {"vertical_model": F.lit("unknown"), "elevation_m": F.lit(None).cast("double")})
    if "elevation_m" in nodes.columns:
        height["elevation_m"] = F.coalesce("elevation_m", height["elevation_m"])
    nodes = nodes.withColumn("hd", F.struct(*(v.alias(k) for k, v in height.items())))
    return nodes, edges if refinements is None else apply_refinements(edges, refinements)


def _kept(df: DataFrame, fields: dict[str, Column]) -> dict[str, Column]:
    """The fields, or those of the column hd that the table has already."""
    own = df.schema["hd"].dataType.names if "hd" in df.columns else []
    return {k: F.coalesce(F.col(f"hd.{k}"), v) if k in own else v for k, v in fields.items()}


def marking_widths(markings: DataFrame) -> DataFrame:
    """Rows (edge_id, source, half_width, offset, bins) from lane markings (edge_id, side, offset, points).

    Markings of a side count alike. With both sides the half width is the mean of their
    distances and the offset their middle; with one it is that side's distance.
    """
    sides = markings.where(F.col("side").isin("left", "right")).groupBy("edge_id").pivot("side", ["left", "right"]).agg(F.avg("offset"))
    bins = markings.groupBy("edge_id").agg(F.sum("points").alias("bins"))
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    width = F.when(both, (F.abs("left") + F.abs("right")) / 2).otherwise(F.abs(F.coalesce("left", "right")))
    middle = F.when(both, (F.col("left") + F.col("right")) / 2).otherwise(0.0)
    return sides.join(bins, "edge_id").select("edge_id", F.lit("lane_markings").alias("source"), width.alias("half_width"), middle.alias("offset"), "bins")


def camera_widths(observations: DataFrame) -> DataFrame:
    """The same from camera observations (edge_id, kind, offset) of lanes and curbs: their mean distance."""
    seen = observations.where((F.lower("kind").contains("lane") | F.lower("kind").contains("curb")) & F.col("offset").isNotNull())
    found = seen.groupBy("edge_id").agg(F.avg(F.abs("offset")).alias("half_width"), F.count("*").alias("bins"))
    return found.select("edge_id", F.lit("camera").alias("source"), "half_width", F.lit(None).cast("double").alias("offset"), "bins")


def trace_support(observed: DataFrame, least: int = 3) -> DataFrame:
    """The same from samples matched (edge_id, matched_samples): three or more support an edge, but tell no width."""
    none = F.lit(None).cast("double")
    return observed.where(F.col("matched_samples") >= least).select("edge_id", F.lit("traces").alias("source"), none.alias("half_width"), none.alias("offset"), F.col("matched_samples").alias("bins"))


def refinements(edges: DataFrame, sources: DataFrame, base_width: float = 3.5) -> DataFrame:
    """Rows (edge_id, base_half_width, half_width, centerline_offset, sources, confidence), one for each edge.

    sources: rows (edge_id, source, half_width, offset, bins) of the functions above.
    Widths and offsets are means over the sources that tell one. Confidence is the share
    of three sources, times 1 - exp(-bins / 10), to four places.
    """
    per = sources.where("bins > 0").groupBy("edge_id").agg(F.avg("half_width").alias("w"), F.avg("offset").alias("o"), F.array_sort(F.collect_set("source")).alias("sources"), F.sum("bins").alias("b"))
    out = edges.select("edge_id").join(per, "edge_id", "left")
    confidence = F.round(F.least(F.size("sources"), F.lit(3)) / 3.0 * (1 - F.exp(-F.col("b") / 10.0)), 4)
    half = F.lit(base_width / 2)
    return out.select(
        "edge_id", half.alias("base_half_width"), F.coalesce("w", half).alias("half_width"), F.coalesce("o", F.lit(0.0)).alias("centerline_offset"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.when(F.col("b").isNull(), 0.0).otherwise(confidence).alias("confidence"),
    )


def apply_refinements(edges: DataFrame, refined: DataFrame) -> DataFrame:
    """Edges of `enrich` with boundaries of their refined width about the shifted line, and a column refinement.

    Edges without a refinement stay as they are.
    """
    columns = [c for c in refined.columns if c != "edge_id"]
    out = edges.join(refined.select("edge_id", F.struct(*columns).alias("refinement")), "edge_id", "left")
    line = shifted("polyline", F.coalesce("refinement.centerline_offset", F.lit(0.0)))
    left, right = boundaries(line, 2 * F.col("refinement.half_width"))
    fits = (F.col("refinement.half_width") > 0) & (F.size("polyline") >= 2)
    new = {"left": left, "right": right, "quality": F.lit("multi_source")}
    hd = F.struct(*((F.when(fits, new[c]).otherwise(F.col(f"hd.{c}")) if c in new else F.col(f"hd.{c}")).alias(c) for c in edges.schema["hd"].dataType.names))
    return out.withColumn("hd", hd)


def lane_inferences(edges: DataFrame, markings: DataFrame, tags: DataFrame, offsets: DataFrame, widths: DataFrame | None = None, base_width: float = 3.5, gap: float = 2.0, least: int = 1, most: int = 6) -> DataFrame:
    """Rows (edge_id, lane_count, source, confidence, lanes): lanes is an array of (lane_index, offset_m, centerline).

    Markings (edge_id, offset) bound lanes, OSM tags (edge_id, osm_lanes) count them and
    widen the road to as many lanes, clusters of trace offsets (edge_id, offset) are
    lanes; the first of these that an edge has decides, else it has one lane. Lanes are
    spread evenly over the road's width, 2 * half_width of `widths` (edge_id,
    half_width) or one lane's, from the left.
    """
    def clusters(df: DataFrame, name: str) -> DataFrame:
        return clusters_1d(df.select("edge_id", "offset"), "edge_id", "offset", gap).groupBy("edge_id").agg((F.max("cluster") + 1).alias(name), F.count("*").alias(f"{name}_n"))

    out = edges.select("edge_id", "polyline").join(clusters(markings, "m"), "edge_id", "left").join(tags.where("osm_lanes > 0").select("edge_id", F.col("osm_lanes").alias("t")), "edge_id", "left").join(clusters(offsets, "o"), "edge_id", "left")
    known = widths.select("edge_id", "half_width") if widths is not None else edges.select("edge_id", F.lit(None).cast("double").alias("half_width"))
    out = out.join(known, "edge_id", "left")
    by_marking, by_tag, by_trace = F.col("m").isNotNull(), F.col("t").isNotNull(), F.col("o").isNotNull()
    count = F.when(by_marking, F.greatest(F.lit(1), F.col("m") - 1)).when(by_tag, F.col("t")).when(by_trace, F.col("o")).otherwise(1)
    count = F.greatest(F.lit(least), F.least(F.lit(most), count)).cast("int")
    source = F.when(by_marking, "lane_markings").when(by_tag, "osm_lanes").when(by_trace, "trace_offsets").otherwise("default")
    sure = F.when(by_marking, F.round(1 - F.exp(-F.col("m_n") / 5.0), 4)).when(by_tag, 0.6).when(by_trace, F.round(1 - F.exp(-F.col("o_n") / 10.0), 4)).otherwise(0.0)
    out = out.withColumns({"lane_count": count, "source": source, "confidence": sure})
    half = F.when(F.col("half_width") > 0, F.col("half_width")).otherwise(base_width / 2)
    half = F.when(F.col("source") == "osm_lanes", F.greatest(half, F.col("lane_count") * base_width / 2)).otherwise(half)
    step = 2 * half / F.col("lane_count")

    def lane(k: Column) -> Column:
        offset = F.when(F.col("lane_count") == 1, 0.0).otherwise(half - step / 2 - k * step)
        return F.struct(k.alias("lane_index"), F.round(offset, 6).alias("offset_m"), shifted("polyline", offset).alias("centerline"))

    return out.select("edge_id", "lane_count", "source", "confidence", F.transform(F.sequence(F.lit(0), F.col("lane_count") - 1), lane).alias("lanes"))


def apply_lane_inferences(edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """Edges with lane_count, lane_source, lane_confidence and lanes; null where nothing was inferred."""
    return edges.join(inferred.select("edge_id", "lane_count", F.col("source").alias("lane_source"), F.col("confidence").alias("lane_confidence"), "lanes"), "edge_id", "left")


def lane_summary(inferred: DataFrame) -> DataFrame:
    """Rows (kind, label, n): edges by lane_count and by source."""
    counts = inferred.groupBy(F.lit("lane_count").alias("kind"), F.col("lane_count").cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.unionByName(inferred.groupBy(F.lit("source").alias("kind"), F.col("source").alias("label")).agg(F.count("*").alias("n")))


def mean_curvature(line: str | Column) -> Column:
    """Mean turning angle of a line in radians over vertices between two sides with length; 0 without any."""
    line = F.col(line) if isinstance(line, str) else line
    n = F.size(line)
    inner = F.when(n >= 3, F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2)))).otherwise(F.array().cast("array<int>"))

    def angle(i: Column) -> Column:
        a, b, c = F.element_at(line, i - 1), F.element_at(line, i), F.element_at(line, i + 1)
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        lengths = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
        safe = F.when((lengths[0] >= 1e-9) & (lengths[1] >= 1e-9), lengths[0] * lengths[1])
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / safe)))

    mean = lambda angles: F.when(F.size(angles) > 0, F.aggregate(angles, F.lit(0.0), lambda s, x: s + x) / F.size(angles)).otherwise(0.0)
    return let(F.array_compact(F.transform(inner, angle)), mean)


def rms_residual(points: DataFrame, lines: DataFrame, by: str) -> DataFrame:
    """Rows (by, rms, n): root mean square distance of points (by, x, y) to their own line (by, polyline); 0 without points."""
    n = F.size("polyline")
    sides = F.arrays_zip(F.slice("polyline", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("polyline", 2, F.greatest(n - 1, F.lit(0))).alias("b"))

    def square(s: Column) -> Column:
        from waymesh.functions.geometry import position_on_segment

        a, b = s["a"], s["b"]
        t = position_on_segment(F.col("x"), F.col("y"), a["x"], a["y"], b["x"], b["y"])
        dx, dy = F.col("x") - a["x"] - t * (b["x"] - a["x"]), F.col("y") - a["y"] - t * (b["y"] - a["y"])
        return dx * dx + dy * dy

    apart = points.join(lines.select(by, sides.alias("_sides")), by).select(by, F.array_min(F.transform("_sides", square)).alias("d2")).where("d2 is not null")
    found = apart.groupBy(by).agg(F.sqrt(F.avg("d2")).alias("rms"), F.count("*").alias("n"))
    return lines.select(by).join(found, by, "left").select(by, F.coalesce("rms", F.lit(0.0)).alias("rms"), F.coalesce("n", F.lit(0)).alias("n"))


def widened(edges: DataFrame, lanes: Column, base_width: float = 3.5) -> DataFrame:
    """Edges of `enrich` whose boundaries make room for that many lanes; edges of one lane or less stay."""
    left, right = boundaries("polyline", lanes * base_width)
    hd = F.struct(*((F.when(lanes > 1, new).otherwise(F.col(f"hd.{c}")) if (new := {"left": left, "right": right}.get(c)) is not None else F.col(f"hd.{c}")).alias(c) for c in edges.schema["hd"].dataType.names))
    return edges.withColumn("hd", hd)


def slope_deg(line: str | Column, heights: str | Column) -> Column:
    """Angle of the rise from the first to the last height over the line's length, 0 without length, null without two heights."""
    heights = F.col(heights) if isinstance(heights, str) else heights
    length = polyline_length(line)
    rise = F.when(F.size(heights) >= 2, F.element_at(heights, -1) - F.element_at(heights, 1))
    return F.when(rise.isNull(), None).when(length < 1e-6, 0.0).otherwise(F.atan2(rise, length) * (180.0 / math.pi))
