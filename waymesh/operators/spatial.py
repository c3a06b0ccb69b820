"""Spatial joins as equi-joins on grid cells.

Segments are spread over the cells that lie within the search radius of them, in
steps along their length, so a long segment costs cells in proportion to its length.
A point looks into its own cell only, so points, usually the larger side, are never
multiplied.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymesh.functions.geometry import crossing, distance, let, position_on_segment
from waymesh.plans.components import connected_components
from waymesh.plans.numbering import numbered
from waymesh.session import materialize, shuffle_partitions


def segments(edges: DataFrame) -> DataFrame:
    """Rows (edge_ord, edge_id, seg_ord, ax, ay, bx, by, seg_len, arc_start, edge_len) of edges' polylines.

    Edges have ord, edge_id and polyline, an array of structs x, y; one of fewer than
    two points has no segments.
    """
    pairs = F.arrays_zip(F.slice("polyline", 1, F.size("polyline") - 1).alias("a"), F.slice("polyline", 2, F.size("polyline") - 1).alias("b"))
    out = edges.where(F.size("polyline") >= 2).select(F.col("ord").alias("edge_ord"), "edge_id", F.posexplode(pairs).alias("seg_ord", "s"))
    out = out.select("edge_ord", "edge_id", "seg_ord", *(F.col(f"s.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"))
    out = out.withColumn("seg_len", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    along = Window.partitionBy("edge_ord").orderBy("seg_ord")
    return out.withColumn("arc_start", F.coalesce(F.sum("seg_len").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(
        "edge_len", F.sum("seg_len").over(Window.partitionBy("edge_ord"))
    )


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def spread(df: DataFrame, ax: Column, ay: Column, bx: Column, by: Column, reach: float, size: float) -> DataFrame:
    """Each row once for every cell (cx, cy) within `reach` of the segment, and few more.

    Most segments are so short that all cells of their box are taken, two by two at most. Others are cut into
    strips across their longer side, each of which has a range of cells; so no cell comes twice.
    """
    steep = F.abs(by - ay) > F.abs(bx - ax)
    au, av, bu, bv = (F.when(steep, p).otherwise(q) for p, q in ((ay, ax), (ax, ay), (by, bx), (bx, by)))
    line = F.struct(F.least(au, bu).alias("u0"), F.greatest(au, bu).alias("u1"), F.when(au <= bu, av).otherwise(bv).alias("v0"), F.when(au <= bu, bv).otherwise(av).alias("v1"), steep.alias("steep"))

    def strips(q: Column) -> Column:
        u0, u1, v0, v1 = (q[c] for c in ("u0", "u1", "v0", "v1"))
        at = lambda u: F.when(u1 > u0, v0 + (v1 - v0) * (F.least(F.greatest(u, u0), u1) - u0) / (u1 - u0)).otherwise(v0)

        def strip(cu: Column) -> Column:
            ends = at(cu * size - reach), at((cu + 1) * size + reach)
            across = F.sequence(cell(F.least(*ends) - reach, size), cell(F.greatest(*ends) + reach, size))
            return F.transform(across, lambda cv: F.struct(F.when(q["steep"], cv).otherwise(cu).alias("cx"), F.when(q["steep"], cu).otherwise(cv).alias("cy")))

        return F.flatten(F.transform(F.sequence(cell(u0 - reach, size), cell(u1 + reach, size)), strip))

    box = {f"_{n}{k}": cell(v + (reach if k else -reach), size) for n, p, q in (("x", ax, bx), ("y", ay, by)) for k, v in enumerate((F.least(p, q), F.greatest(p, q)))}
    x0, x1, y0, y1 = (F.col(c) for c in box)
    at = lambda x, y: F.struct(x.alias("cx"), y.alias("cy"))
    some = [F.array(at(x0, y0)), F.array(at(x0, y0), at(x0, y1)), F.array(at(x0, y0), at(x1, y0)), F.array(at(x0, y0), at(x0, y1), at(x1, y0), at(x1, y1))]
    few = F.when(x0 == x1, F.when(y0 == y1, some[0]).otherwise(some[1])).otherwise(F.when(y0 == y1, some[2]).otherwise(some[3]))
    every = F.when((x1 - x0 <= 1) & (y1 - y0 <= 1), few).otherwise(let(line, strips))
    out = df.withColumns(box).withColumn("_cell", F.explode(every))
    return out.withColumns({"cx": F.col("_cell.cx"), "cy": F.col("_cell.cy")}).drop("_cell", *box)


#: Rows over cells that are sent to all tasks, some 10 MB.
FEW = 1 << 16


def beside(wide: DataFrame, few: int = FEW) -> DataFrame:
    """Rows over cells as a side of a join: `few` are sent to all tasks, more are dealt by cells like the other side.

    Spark's own choice goes by an estimate that does not know how many rows explode() makes of
    one, and sends a table of any size through the driver.
    """
    return F.broadcast(wide) if wide.limit(few + 1).count() <= few else wide.hint("merge")


def point_segment_pairs(points: DataFrame, segs: DataFrame, radius: float, inclusive: bool = False, size: float = 0.0) -> DataFrame:
    """Pairs of points (key columns, x, y) and segments closer than `radius`, with d2, t, qx, qy, arc.

    A radius of 0 or less pairs nothing. Cells are of `size`, or twice the radius if that is more.
    """
    if radius <= 0:
        radius, size = 0.0, 1.0
    else:
        size = max(size, 2.0 * radius)
    wide = beside(spread(segs, *(F.col(c) for c in ("ax", "ay", "bx", "by")), radius, size))
    placed = points.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    out = placed.join(wide, ["cx", "cy"]).drop("cx", "cy")
    out = out.withColumn("t", position_on_segment(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))))
    out = out.withColumns({"qx": F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax")), "qy": F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))})
    out = out.withColumn("d2", (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")))
    near = F.col("d2") <= radius * radius if inclusive else F.col("d2") < radius * radius
    return out.where(near & F.lit(radius > 0)).withColumn("arc", F.col("arc_start") + F.col("t") * F.col("seg_len"))


HIT = ("d2", "edge_ord", "seg_ord", "edge_id", "qx", "qy", "arc", "edge_len")


def snap(samples: DataFrame, edges: DataFrame, radius: float = 15.0, keys: tuple[str, ...] = ("trace_id", "ord")) -> DataFrame:
    """Samples with their nearest edge closer than `radius`: edge_id, edge_ord, seg_ord, d2, d, qx, qy, arc, edge_len.

    Equal distances go to the lower edge, then the lower segment, in order. Samples
    without one keep nulls. The segments near a cell are one row, as a list, so that
    samples are joined once and neither grouped nor joined back; a radius of 0 or less
    finds nothing.
    """
    size = 2.0 * radius if radius > 0 else 1.0
    segs = segments(edges)
    wide = spread(segs, *(F.col(c) for c in ("ax", "ay", "bx", "by")), max(0.0, radius), size).where(F.lit(radius > 0))
    near = beside(wide).groupBy("cx", "cy").agg(F.collect_list(F.struct(*segs.columns)).alias("_near"))
    x, y = F.col("x"), F.col("y")

    def hit(s: Column) -> Column:
        t = position_on_segment(x, y, *(s[c] for c in ("ax", "ay", "bx", "by")))
        qx, qy = s["ax"] + t * (s["bx"] - s["ax"]), s["ay"] + t * (s["by"] - s["ay"])
        d2 = (x - qx) * (x - qx) + (y - qy) * (y - qy)
        values = {"d2": d2, "qx": qx, "qy": qy, "arc": s["arc_start"] + t * s["seg_len"]}
        return F.struct(*((values[c] if c in values else s[c]).alias(c) for c in HIT))

    # samples without a place find nothing; they are dealt by their keys, so that they do not meet in one task
    placed = samples.withColumns({"cx": F.coalesce(cell(x, size), F.xxhash64(*keys)), "cy": F.coalesce(cell(y, size), F.lit(0).cast("long"))}).join(near, ["cx", "cy"], "left")
    best = F.array_min(F.filter(F.transform("_near", hit), lambda h: h["d2"] < radius * radius))
    out = placed.withColumn("_hit", best).drop("cx", "cy", "_near")
    return out.withColumns({c: F.col(f"_hit.{c}") for c in HIT}).drop("_hit").withColumn("d", F.sqrt("d2"))


def candidates(samples: DataFrame, edges: DataFrame, radius: float = 20.0, limit: int = 5, keys: tuple[str, ...] = ("trace_id", "ord")) -> DataFrame:
    """The `limit` nearest edges of each sample, one hit for each edge, with their rank from 1."""
    pairs = point_segment_pairs(samples.select(*keys, "x", "y"), segments(edges), radius)
    best = pairs.groupBy(*keys, "edge_ord").agg(F.min(F.struct("d2", "seg_ord", "edge_id", "qx", "qy", "arc", "edge_len")).alias("hit"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("hit.d2", "edge_ord"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select(*keys, "rank", "edge_ord", "hit.*").withColumn("d", F.sqrt("d2"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, radius: float, within: bool = False) -> DataFrame:
    """Each point (key, x, y) with its nearest node: node_id, node_ord, d; ties go to the lower order.

    Nodes are spread over the at most four cells that lie within `radius` of them, and a
    point looks into its own. Points without a node that near go on with four times the
    radius, until it covers all nodes, or are left out if nodes `within` the radius are
    asked for. Without nodes all are null.
    """
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    if not box["n"]:
        return points.select("key", F.lit(None).cast("string").alias("node_id"), F.lit(None).cast("long").alias("node_ord"), F.lit(None).cast("double").alias("d"))
    east, north = (F.greatest(F.abs(F.col(c) - box[f"{c}0"]), F.abs(F.col(c) - box[f"{c}1"])) for c in "xy")
    far = points.agg(F.max(F.sqrt(east * east + north * north))).first()[0] or 0.0
    todo, done = points.select("key", "x", "y"), None
    dots = nodes.select(F.col("id").alias("node_id"), F.col("ord").alias("node_ord"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    while True:
        size = 2.0 * radius
        wide = beside(spread(dots, F.col("nx"), F.col("ny"), F.col("nx"), F.col("ny"), radius, size))
        hits = todo.withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)}).join(wide, ["cx", "cy"]).where(d2 <= radius * radius)
        best = hits.groupBy("key").agg(F.min(F.struct(d2.alias("d2"), "node_ord", "node_id")).alias("hit"))
        settled = best.select("key", "hit.node_id", "hit.node_ord", F.sqrt("hit.d2").alias("d"))
        if within or radius > far:
            return settled if done is None else done.unionByName(settled)
        settled = materialize(settled)
        done = settled if done is None else done.unionByName(settled)
        todo = materialize(todo.join(settled, "key", "left_anti"))
        if todo.isEmpty():
            return done
        radius *= 4


def coverage(snapped: DataFrame) -> DataFrame:
    """One row: samples, matched, matched_ratio, edges_touched, mean_distance, max_distance."""
    n, matched = F.count("*"), F.count("edge_id")
    return snapped.agg(
        n.alias("samples"),
        matched.alias("matched"),
        F.when(n > 0, matched / n).otherwise(0.0).alias("matched_ratio"),
        F.count_distinct("edge_id").alias("edges_touched"),
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_distance"),
        F.coalesce(F.max("d"), F.lit(0.0)).alias("max_distance"),
    )


#: Segments of a cell that meet as one key, and how often a cell with more is cut into quarters.
CAPACITY, CUTS = 2048, 8
#: Segments of a cell from which on numpy compares them, and pairs of them at a time.
DENSE, AT_ONCE = 128, 1 << 21
#: Metres around a segment in which a crossing may be placed by rounding.
ROUNDING = 1e-6


def cells_by_load(segs: DataFrame, size: float, capacity: int = CAPACITY) -> DataFrame:
    """Segments once for each cell that they meet: level, cx, cy, the cell's load and parts, by which it deals out what it has too much of.

    A cell of more than `capacity` segments is cut into quarters, and these again, up to
    CUTS times. What then still meets in one place is dealt over as many parts as make
    that capacity.
    """
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    done, wide = None, spread(segs, *ends, ROUNDING, size).withColumn("level", F.lit(0))
    for level in range(CUTS + 1):
        counted = materialize(wide.join(wide.groupBy("cx", "cy").agg(F.count("*").alias("_n")).hint("merge"), ["cx", "cy"]))
        last = level == CUTS
        parts = F.ceil(F.col("_n") / capacity).cast("int") if last else F.lit(1)
        fit = counted.where(F.lit(last) | (F.col("_n") <= capacity)).withColumn("parts", parts).withColumnRenamed("_n", "load")
        done = fit if done is None else done.unionByName(fit)
        full = counted.where(~(F.lit(last) | (F.col("_n") <= capacity)))
        if last or full.isEmpty():
            return done
        size /= 2
        kept = full.select(F.col("cx").alias("_px"), F.col("cy").alias("_py")).distinct()
        wide = spread(full.select(*segs.columns).distinct(), *ends, ROUNDING, size).withColumns({"level": F.lit(level + 1), "_px": F.shiftright(F.col("cx"), 1), "_py": F.shiftright(F.col("cy"), 1)})
        wide = wide.join(kept, ["_px", "_py"], "left_semi").drop("_px", "_py")
    return done


def segment_crossings(edges: DataFrame, size: float = 100.0, capacity: int = CAPACITY) -> DataFrame:
    """Strict crossings of segments of different edges: (edge_a, seg_a, edge_b, seg_b, ta, tb, x, y).

    Segments meet in cells that are smaller where there are many, and where cells do not
    part them, in pairs of parts, so that no key has many more than `capacity` of either
    side. A pair that shares several cells is found in the one where its crossing lies, so
    that crossings leave their task as they are and are not made distinct by a shuffle.
    """
    segs = segments(edges).select("edge_ord", "edge_id", "seg_ord", "ax", "ay", "bx", "by")
    every = cells_by_load(segs, size, capacity)
    return _joined_crossings(every.where(F.col("load") < DENSE), size).unionByName(_dense_crossings(every.where(F.col("load") >= DENSE), size))


def _sides(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments as either side of the pairs of parts (_i, _j) of their cell."""
    own = F.pmod(F.xxhash64("edge_ord", "seg_ord"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    return wide.withColumn("_i", own).withColumn("_j", every), wide.withColumn("_j", own).withColumn("_i", every)


def _dense_crossings(wide: DataFrame, size: float) -> DataFrame:
    """Crossings in cells of many segments, whose pairs of boxes numpy compares a block at a time."""
    keys, kept = ["level", "cx", "cy", "_i", "_j"], ["edge_ord", "edge_id", "seg_ord", "ax", "ay", "bx", "by"]
    a, b = (side.select(*keys, *kept) for side in _sides(wide))
    b = b.toDF(*(f"_{k}" for k in keys), *kept)
    schema = f"edge_a string, seg_a {wide.schema['seg_ord'].dataType.simpleString()}, edge_b string, seg_b {wide.schema['seg_ord'].dataType.simpleString()}, ta double, tb double, x double, y double"

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        p, q = ({c: t[c].to_numpy() for c in ("edge_ord", "seg_ord", "ax", "ay", "bx", "by")} for t in (left, right))
        low = [{c: np.minimum(t[f"a{c}"], t[f"b{c}"]) for c in "xy"} for t in (p, q)]
        high = [{c: np.maximum(t[f"a{c}"], t[f"b{c}"]) for c in "xy"} for t in (p, q)]
        found, rows = [], max(1, AT_ONCE // max(1, right.num_rows))
        for at in range(0, left.num_rows, rows):
            some = slice(at, at + rows)
            near = p["edge_ord"][some, None] < q["edge_ord"]
            for c in "xy":
                near &= low[0][c][some, None] <= high[1][c]
                near &= low[1][c] <= high[0][c][some, None]
            i, j = np.nonzero(near)
            i += at
            ax, ay, rx, ry = p["ax"][i], p["ay"][i], (p["bx"] - p["ax"])[i], (p["by"] - p["ay"])[i]
            sx, sy, ex, ey = (q["bx"] - q["ax"])[j], (q["by"] - q["ay"])[j], q["ax"][j] - ax, q["ay"][j] - ay
            # as in `crossing`
            det = rx * sy - ry * sx
            det = np.where(np.abs(det) < 1e-12, np.nan, det)
            t, u = (ex * sy - ey * sx) / det, (ex * ry - ey * rx) / det
            x, y = ax + t * rx, ay + t * ry
            side = size / 2.0 ** int(left["level"][0].as_py())
            own = (np.floor(x / side) == left["cx"][0].as_py()) & (np.floor(y / side) == left["cy"][0].as_py())
            own &= (t > 1e-9) & (t < 1 - 1e-9) & (u > 1e-9) & (u < 1 - 1e-9)
            found.append((i[own], j[own], t[own], u[own], x[own], y[own]))
        i, j, t, u, x, y = (np.concatenate(v) for v in zip(*found, strict=True)) if found else [np.zeros(0, int)] * 2 + [np.zeros(0)] * 4
        names = [pc.take(table[c].combine_chunks(), pa.array(k)) for table, k in ((left, i), (right, j)) for c in ("edge_id", "seg_ord")]
        return pa.table([*names, t, u, x, y], names=["edge_a", "seg_a", "edge_b", "seg_b", "ta", "tb", "x", "y"])

    n = shuffle_partitions(wide.sparkSession)
    a, b = a.repartition(n, *keys).groupBy(*keys), b.repartition(n, *b.columns[: len(keys)]).groupBy(*b.columns[: len(keys)])
    return a.cogroup(b).applyInArrow(searched, schema)


def _joined_crossings(wide: DataFrame, size: float) -> DataFrame:
    """Crossings in cells of few segments, which are joined."""
    a, b = (side.alias(name) for side, name in zip(_sides(wide), "ab", strict=True))
    col = lambda t, c: F.col(f"{t}.{c}")
    same = [col("a", c) == col("b", c) for c in ("level", "cx", "cy", "_i", "_j")]
    sides = {c: tuple(col(t, e + c) for t in "ab" for e in "ab") for c in "xy"}
    meet = [(F.least(p, q) <= F.greatest(r, s)) & (F.least(r, s) <= F.greatest(p, q)) for p, q, r, s in sides.values()]
    # each segment has its ends on both sides of the other; a little more may pass, as the crossing itself decides
    turn = lambda t, p, s: (col(t, "bx") - col(t, "ax")) * (col(s, p + "y") - col(t, "ay")) - (col(t, "by") - col(t, "ay")) * (col(s, p + "x") - col(t, "ax"))
    apart = [turn(t, "a", s) * turn(t, "b", s) <= ROUNDING for t, s in ("ab", "ba")]
    pairs = a.join(b, [*same, col("a", "edge_ord") < col("b", "edge_ord"), *meet, *apart])
    ta, tb = crossing(*(col("a", c) for c in ("ax", "ay", "bx", "by")), *(col("b", c) for c in ("ax", "ay", "bx", "by")))
    # as a row of its own, so that the join's condition stays small enough to be compiled
    found = F.inline(F.filter(F.array(F.struct(ta.alias("ta"), tb.alias("tb"))), lambda c: c["ta"].isNotNull()))
    names = [col(t, "edge_id" if n == "edge" else "seg_ord").alias(f"{n}_{t}") for t in "ab" for n in ("edge", "seg")]
    pairs = pairs.select(*names, *(col("a", c) for c in ("level", "cx", "cy", "ax", "ay", "bx", "by")), found)
    pairs = pairs.withColumns({c: F.col(f"a{c}") + F.col("ta") * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xy"})
    own = [cell(F.col(c), F.lit(size) / F.pow(F.lit(2.0), F.col("level"))) == F.col(f"c{c}") for c in "xy"]
    return pairs.where(own[0] & own[1]).select("edge_a", "seg_a", "edge_b", "seg_b", "ta", "tb", "x", "y")


def close_points(points: DataFrame, radius: float, inclusive: bool = True) -> DataFrame:
    """Pairs (a, b), a < b, of points (key, x, y) within `radius` of each other."""
    reach = max(radius, 1e-9)
    size = 2.0 * reach
    placed = points.select(F.col("key").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    wide = beside(spread(points.select(F.col("key").alias("b"), "x", "y"), *(F.col(c) for c in "xyxy"), reach, size))
    out = placed.join(wide, ["cx", "cy"]).where("a < b")
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    return out.where(d2 <= radius * radius if inclusive else d2 < radius * radius).select("a", "b", F.sqrt(d2).alias("d"))


#: How many boxes a side of a cell has, and each box again where it must be looked into.
FINER = 12


def close_cells(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Points (key, x, y) with `rep`, the smallest key of their cell, and links (a, b) of cells that have points within `radius` of each other.

    Cells are so small that all points of one are that close. Of cells that lie near each
    other, boxes around their points are compared, a bounded number for each cell however
    many points it has: two boxes that lie wholly within the radius link their cells, and
    where only boxes are near whose points may be or not, these are cut into smaller ones,
    down to single points. So the work does not grow with the pairs of close points.
    """
    side = radius / math.sqrt(2.0) * (1 - 1e-12)
    placed = points.select("key", "x", "y", cell(F.col("x"), side).alias("cx"), cell(F.col("y"), side).alias("cy"))
    own = placed.groupBy("cx", "cy").agg(F.min("key").alias("rep"))
    placed = materialize(placed.join(own, ["cx", "cy"]))
    # half of the cells around, as pairs count once
    around = [(dx, dy) for dx in range(-2, 3) for dy in range(3) if (dy, dx) > (0, 0)]
    offsets = F.explode(F.array(*(F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in around)))
    near, far = "near", "far"

    def boxed(rows: DataFrame, size: float) -> DataFrame:
        boxes = rows.groupBy("rep", "cx", "cy", cell(F.col("x"), size).alias("mx"), cell(F.col("y"), size).alias("my"))
        return boxes.agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))))

    def judged(pairs: DataFrame) -> DataFrame:
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.col(f"a.{c}0") - F.col(f"b.{c}1"))
        wide = lambda c: F.greatest(F.col(f"b.{c}1") - F.col(f"a.{c}0"), F.col(f"a.{c}1") - F.col(f"b.{c}0"))
        square = lambda f: f("x") * f("x") + f("y") * f("y")
        names = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("rep", "mx", "my")]
        return materialize(pairs.select(*names, (square(gap) <= radius * radius).alias(near), (square(wide) <= radius * radius).alias(far)).where(near))

    size = side / FINER
    boxes = boxed(placed, size)
    ahead = boxes.withColumn("_o", offsets).withColumns({"cx": F.col("cx") + F.col("_o.dx"), "cy": F.col("cy") + F.col("_o.dy")}).drop("_o")
    found = judged(ahead.alias("a").join(boxes.alias("b"), (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))))
    links = []
    while True:
        links.append(found.where(far).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct())
        open_ = found.where(~F.col(far)).join(links[-1].select(F.col("a").alias("a_rep"), F.col("b").alias("b_rep")), ["a_rep", "b_rep"], "left_anti")
        if open_.isEmpty():
            return placed.select("key", "x", "y", "rep"), reduce(DataFrame.unionByName, links)
        open_ = materialize(open_)
        inside = placed.withColumns({"_mx": cell(F.col("x"), size), "_my": cell(F.col("y"), size)})
        size /= FINER

        def half(s: str, rows: DataFrame = inside, finer: float = size, pairs: DataFrame = open_) -> DataFrame:
            wanted = pairs.select(*(F.col(f"{s}_{c}").alias(n) for c, n in (("rep", "rep"), ("mx", "_mx"), ("my", "_my")))).distinct()
            parts = rows.join(wanted, ["rep", "_mx", "_my"], "left_semi").groupBy("rep", "_mx", "_my", cell(F.col("x"), finer).alias("mx"), cell(F.col("y"), finer).alias("my"))
            return parts.agg(*(f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max)))).alias(s)

        meet = lambda s: [F.col(f"o.{s}_{c}") == F.col(f"{s}.{n}") for c, n in (("rep", "rep"), ("mx", "_mx"), ("my", "_my"))]
        found = judged(open_.alias("o").join(half("a"), meet("a")).join(half("b"), meet("b")))


def endpoint_clusters(points: DataFrame, merge_dist: float) -> DataFrame:
    """Points (key, x, y) with the node they merge into: node (n0, n1, ... by smallest key), node_x, node_y.

    Points within `merge_dist` of each other are one node, chains included; a
    distance of 0 merges exact duplicates only. A node lies at its points' mean.
    """
    same = points.groupBy("x", "y").agg(F.min("key").alias("key"))
    reps = points.join(same.withColumnRenamed("key", "rep"), ["x", "y"])
    if merge_dist > 0:
        cells, links = close_cells(same, merge_dist)
        linked = connected_components(links).withColumnRenamed("node", "_cell")
        reps = reps.join(cells.select(F.col("key").alias("rep"), F.col("rep").alias("_cell")), "rep").join(linked, "_cell", "left").withColumn("rep", F.coalesce("component", "_cell"))
    centre = reps.groupBy("rep").agg(F.min("key").alias("first"), F.avg("x").alias("node_x"), F.avg("y").alias("node_y"))
    centre = numbered(centre, "first").withColumn("node", F.concat(F.lit("n"), "place")).drop("place")
    return reps.join(centre, "rep").select("key", "x", "y", "node", "node_x", "node_y")
