"""Lane markings and lane boundaries from LiDAR points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.lanes import ground_plane, height_band, side_bins
from waymesh.operators.spatial import point_segment_pairs, segments


def along_edges(points: DataFrame, edges: DataFrame, max_lateral: float) -> DataFrame:
    """Points (key, x, y, intensity) in the frame of each edge within `max_lateral`: (edge_id, key, intensity, s, t, edge_len).

    s is metres along the edge, t metres to its left, by the nearest segment.
    """
    pairs = point_segment_pairs(points.select("key", "x", "y", "intensity"), segments(edges), max_lateral, inclusive=True).where("seg_len >= 1e-9")
    left = ((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))) / F.col("seg_len")
    best = pairs.groupBy("edge_id", "key", "intensity").agg(F.min(F.struct("d2", "seg_ord", F.col("arc").alias("s"), left.alias("t"), "edge_len")).alias("h"))
    return best.select("edge_id", "key", "intensity", "h.s", "h.t", "h.edge_len").where(F.abs("t") <= max_lateral)


def _bright_clusters(seen: DataFrame, percentile: float, bin_m: float, least: int, gap: float) -> DataFrame:
    """Rows (edge_id, bin, n_bins, edge_len, t, intensity, n): clusters of the bright points of a bin along an edge."""
    bound = seen.groupBy("edge_id").agg(F.percentile("intensity", F.lit(percentile / 100.0)).alias("threshold"))
    n_bins = F.greatest(F.lit(1), F.ceil(F.col("edge_len") / bin_m)).cast("int")
    place = F.floor(F.col("s") / F.col("edge_len") * n_bins).cast("int")
    rows = seen.withColumns({"n_bins": n_bins, "bin": place}).where("bin < n_bins").join(bound, "edge_id")
    own = Window.partitionBy("edge_id", "bin")
    bright = rows.withColumn("_all", F.count("*").over(own)).where((F.col("_all") >= least) & (F.col("intensity") >= F.col("threshold")))
    bright = bright.withColumn("_bright", F.count("*").over(own)).where(F.col("_bright") >= least)
    order = own.orderBy("t", "key")
    wide = F.coalesce((F.col("t") - F.lag("t").over(order) > gap).cast("int"), F.lit(0))
    bright = bright.withColumn("_wide", wide).withColumn("_cluster", F.sum("_wide").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = bright.groupBy("edge_id", "bin", "n_bins", "edge_len", "_cluster").agg(F.median("t").alias("t"), F.median("intensity").alias("intensity"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least).drop("_cluster")


def _tracks(gap: float, most_bins: int):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        """Numbers the tracks of an edge: a cluster goes on the first open one that ended near it a bin or two before."""
        rows = rows.sort_values(["bin", "t"]).reset_index(drop=True)
        ends: list[tuple[int, float]] = []
        track = np.zeros(len(rows), np.int64)
        for k, (place, t) in enumerate(zip(rows["bin"].tolist(), rows["t"].tolist(), strict=True)):
            fits = [j for j, (last, at) in enumerate(ends) if place - last <= most_bins and abs(t - at) < gap]
            if fits:
                ends[fits[0]], track[k] = (place, t), fits[0]
            else:
                track[k] = len(ends)
                ends.append((place, t))
        return rows.assign(track=track)

    return link


def on_edge(places: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (edge_id, s, t, ...) with the point x, y that lies s metres along and t metres to the left of the edge.

    Beyond the end the last segment goes on.
    """
    segs = segments(edges).where("seg_len >= 1e-9").withColumn("_last", F.col("arc_start") + F.col("seg_len") >= F.col("edge_len") - 1e-9)
    within = (F.col("s") >= F.col("arc_start")) & ((F.col("s") < F.col("arc_start") + F.col("seg_len")) | F.col("_last"))
    at = places.join(segs.select("edge_id", "seg_ord", "ax", "ay", "bx", "by", "seg_len", "arc_start", "_last"), "edge_id").where(within)
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("seg_len"), (F.col("by") - F.col("ay")) / F.col("seg_len")
    ahead = F.least(F.col("s") - F.col("arc_start"), F.col("seg_len"))
    out = at.withColumns({"x": F.col("ax") + ahead * ux - F.col("t") * uy, "y": F.col("ay") + ahead * uy + F.col("t") * ux})
    return out.drop("seg_ord", "ax", "ay", "bx", "by", "seg_len", "arc_start", "_last")


def lane_markings(points: DataFrame, edges: DataFrame, max_lateral: float = 2.5, percentile: float = 85.0, bin_m: float = 1.0, least: int = 3, gap: float = 0.5, least_bins: int = 5) -> DataFrame:
    """Rows (edge_id, track, side, offset, intensity, points, polyline) of painted lines along edges.

    Of an edge's points (key, x, y, z, intensity) those at or above its intensity
    percentile are bright. Bins of `bin_m` metres with `least` points and bright points
    are cut into clusters across the edge at gaps over `gap`; clusters of neighbouring
    bins (a bin may be missing) within `gap` are a track, and tracks of `least_bins`
    bins a marking. It is left or right if its median lies over `gap` metres off the
    line, else center. Clusters, a few for each metre of an edge, are linked edge by edge.
    """
    found = _bright_clusters(along_edges(points, edges, max_lateral), percentile, bin_m, least, gap)
    schema = "edge_id string, bin int, n_bins int, edge_len double, t double, intensity double, n long, track long"
    tracks = found.groupBy("edge_id").applyInPandas(_tracks(gap, 2), schema)
    # a track has one cluster of a bin: the last that went on it
    tracks = tracks.groupBy("edge_id", "track", "bin", "n_bins", "edge_len").agg(F.max_by(F.struct("t", "intensity", "n"), "t").alias("c")).select("edge_id", "track", "bin", "n_bins", "edge_len", "c.*")
    tracks = tracks.withColumn("_bins", F.count("*").over(Window.partitionBy("edge_id", "track"))).where(F.col("_bins") >= least_bins)
    placed = on_edge(tracks.withColumn("s", (F.col("bin") + 0.5) * F.col("edge_len") / F.col("n_bins")), edges)
    line = F.transform(F.array_sort(F.collect_list(F.struct("bin", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    out = placed.groupBy("edge_id", "track").agg(F.median("t").alias("offset"), F.median("intensity").alias("intensity"), F.sum("n").alias("points"), line.alias("polyline"))
    side = F.when(F.col("offset") > gap, "left").when(F.col("offset") < -gap, "right").otherwise("center")
    return out.select("edge_id", "track", side.alias("side"), "offset", "intensity", "points", "polyline")


def marking_style(points: Column, length_bins: Column, intensity: Column) -> Column:
    """solid for bright and dense markings, else dashed."""
    return F.when((intensity >= 180) & (points / F.greatest(length_bins - 1, F.lit(1)) >= 0.5), "solid").otherwise("dashed")


def boundary_lines(bins: DataFrame) -> DataFrame:
    """Rows (edge_id, left, right): a side's medians (see `side_bins`) in order along the edge; a side of one bin has no line."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("bin", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    lines = bins.groupBy("edge_id", "side").agg(line.alias("line")).where(F.size("line") >= 2)
    return lines.groupBy("edge_id").pivot("side", ["left", "right"]).agg(F.first("line"))


def fuse_boundaries(edges: DataFrame, points: DataFrame, max_dist: float = 5.0, bins: int = 32) -> DataFrame:
    """Edges of `hd.enrich` with the boundaries that points (key, x, y) show; sides without points keep theirs."""
    seen = boundary_lines(side_bins(points, edges, max_dist, bins))
    out = edges.join(seen.select("edge_id", F.col("left").alias("_left"), F.col("right").alias("_right")), "edge_id", "left")
    hit = F.col("_left").isNotNull() | F.col("_right").isNotNull()
    new = {"left": F.coalesce("_left", "hd.left"), "right": F.coalesce("_right", "hd.right"), "quality": F.when(hit, "lidar_fused").otherwise(F.col("hd.quality"))}
    hd = F.struct(*(new.get(c, F.col(f"hd.{c}")).alias(c) for c in edges.schema["hd"].dataType.names))
    return out.withColumn("hd", hd).drop("_left", "_right")


def fuse_boundaries_3d(edges: DataFrame, points: DataFrame, low: float = 0.0, high: float = 0.3, max_dist: float = 5.0, bins: int = 32, **plane) -> DataFrame:
    """The same from points (key, x, y, z) whose height above the fitted ground plane lies in a band."""
    return fuse_boundaries(edges, height_band(points, ground_plane(points, **plane), low, high), max_dist, bins)
