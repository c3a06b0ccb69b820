"""A road graph kept in tiles: more traces read and rewrite only the tiles that they come near.

A store is a folder of three Parquet tables. `edges` is partitioned by tile, that of an
edge's first vertex, which never changes; each edge carries its two nodes. `reach` is
partitioned by near, and says which tiles have edges that pass through the tile near or
have a node there; it only grows. `marks` has the ids given so far.

An update is written to the folder `staged` first. Putting it into the tables may be
done any number of times, so one that was interrupted is done again by the next update.
A store has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.operators.spatial import cell, segments, spread
from waymesh.plans.build import Build, Numbers, add_lines, next_numbers, trace_lines
from waymesh.session import materialize

#: Up to so many tiles are named in a filter, so that only their folders are listed and read; more are joined.
NAMED = 10_000

_NODE = ("id", "ord", "x", "y")


def _tile(cx: Column, cy: Column) -> Column:
    return F.concat(F.lit("t"), cx, F.lit("_"), cy)


def _passed(edges: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Rows (edge_id, near): the tiles within `margin` of an edge's segments."""
    wide = spread(segments(edges), *(F.col(c) for c in ("ax", "ay", "bx", "by")), margin, size)
    return wide.select("edge_id", _tile(F.col("cx"), F.col("cy")).alias("near"))


def _reach(edges: DataFrame, size: float) -> DataFrame:
    """Rows (near, tile), each once, of edges with tile and their nodes start and end."""
    at = lambda c: _tile(cell(F.col(f"{c}.x"), size), cell(F.col(f"{c}.y"), size))
    passed = _passed(edges, size).join(edges.select("edge_id", "tile"), "edge_id").select("near", "tile")
    return passed.unionByName(edges.select(F.explode(F.array(at("start"), at("end"))).alias("near"), "tile")).distinct()


def _home(edges: DataFrame, size: float) -> DataFrame:
    first = F.element_at("polyline", 1)
    return edges.withColumn("tile", _tile(cell(first["x"], size), cell(first["y"], size)))


def _with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with structs start and end from `nodes`, or as they were where these lack them."""
    spot = F.struct(*_NODE).alias("_spot")
    for c, name in (("start", "start_node_id"), ("end", "end_node_id")):
        old = [F.col(c)] if c in edges.columns else []
        edges = edges.join(nodes.select(F.col("id").alias(name), spot), name, "left").withColumn(c, F.coalesce("_spot", *old)).drop("_spot")
    return edges


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("start", "end")).alias("n")).select("n.*").distinct()


def _picked(spark: SparkSession, path: str, column: str, tiles: DataFrame) -> DataFrame:
    """The rows of a table partitioned by `column` whose value is among `tiles`, a table of that column."""
    table = spark.read.parquet(path)
    few = [r[0] for r in tiles.limit(NAMED + 1).collect()]
    return table.where(F.col(column).isin(few)) if len(few) <= NAMED else table.join(tiles, column, "left_semi")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _folder(spark, path)
    return files.exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def _write(df: DataFrame, path: str, column: str, mode: str) -> None:
    df.hint("rebalance", column).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _marks(spark: SparkSession, numbers: Numbers, batch: int, size: float) -> DataFrame:
    row = (batch, float(size), numbers.node_ord, numbers.node, numbers.edge_ord, numbers.edge)
    return spark.createDataFrame([row], "batch long, size double, node_ord long, node long, edge_ord long, edge long").coalesce(1)


def _latest(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/marks").orderBy(F.desc("batch")).first()


def create_store(graph: dict[str, DataFrame], path: str, size: float = 2000.0) -> None:
    """Keep a graph of at least one edge, in tiles of `size` metres, at `path`, which must not have a store yet.

    Nodes keep id, ord, x and y; those without an edge are left out. Edges keep all columns.
    """
    nodes, edges = graph["nodes"], graph["edges"]
    spark = edges.sparkSession
    if edges.isEmpty():
        raise ValueError("a store begins with an edge")
    if _exists(spark, f"{path}/marks"):
        raise ValueError(f"{path} has a store already")
    if "trace_observation_count" not in edges.columns:
        edges = edges.withColumn("trace_observation_count", F.lit(0).cast("long"))
    rows = materialize(_home(_with_nodes(edges, nodes), size))
    _write(rows, f"{path}/edges", "tile", "overwrite")
    _write(_reach(rows, size), f"{path}/reach", "near", "overwrite")
    _marks(spark, next_numbers(nodes, edges), 0, size).write.parquet(f"{path}/marks")


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes (id, ord, x, y) and edges as they were last updated."""
    rows = spark.read.parquet(f"{path}/edges")
    return {"nodes": _ends(rows), "edges": rows.drop("tile", "start", "end")}


def settle(spark: SparkSession, path: str) -> bool:
    """Put a staged update into the tables; whether there was a whole one. What is staged in part is removed."""
    staged = f"{path}/staged"
    whole = _exists(spark, f"{staged}/marks/_SUCCESS")
    if whole:
        marks = spark.read.parquet(f"{staged}/marks")
        rows = spark.read.parquet(f"{staged}/edges")
        pairs = materialize(_reach(rows, marks.first()["size"]))
        known = _picked(spark, f"{path}/reach", "near", pairs.select("near").distinct())
        _write(pairs.join(known, ["near", "tile"], "left_anti"), f"{path}/reach", "near", "append")
        marks.write.mode("append").parquet(f"{path}/marks")
        _write(rows, f"{path}/edges", "tile", "overwrite")
    _remove(spark, staged)
    return whole


def update_store(spark: SparkSession, path: str, samples: DataFrame, p: Build = Build(), tolerance: float = 4.0) -> None:
    """Add traces to a store, by the rules of `add_lines`, reading and rewriting the tiles around them.

    Nodes that take part are those of edges in tiles that reach a tile near a trace;
    others stay as they are, also two of them that are close. Where a node moves or is
    merged into another one, all its edges are rewritten, as their tiles reach the node's.
    Without a line of two samples or more nothing is written.
    """
    settle(spark, path)
    last = _latest(spark, path)
    size, numbers = last["size"], Numbers(last["node_ord"], last["node"], last["edge_ord"], last["edge"])
    lines = materialize(trace_lines(samples, p))
    if lines.isEmpty():
        return
    drawn = lines.select(F.xxhash64("line").alias("ord"), F.col("line").alias("edge_id"), "polyline")
    near = materialize(_passed(drawn, size, 2 * p.merge + tolerance).select("near").distinct())
    homes = lambda tiles: materialize(_picked(spark, f"{path}/reach", "near", tiles).select("tile").distinct())
    inner = materialize(_picked(spark, f"{path}/edges", "tile", homes(near)))
    # tiles that share a node with those, or that a piece of theirs may begin in
    around = materialize(near.unionByName(_reach(inner, size).select("near")).distinct())
    outer = materialize(_picked(spark, f"{path}/edges", "tile", homes(around)))
    nodes, edges = add_lines(_ends(inner), outer.drop("tile"), lines, numbers, p, tolerance)
    nodes, edges = materialize(nodes), materialize(edges)
    rows = _home(_with_nodes(edges, nodes), size)
    _write(rows, f"{path}/staged/edges", "tile", "overwrite")
    _marks(spark, next_numbers(nodes, edges, numbers), last["batch"] + 1, size).write.mode("overwrite").parquet(f"{path}/staged/marks")
    settle(spark, path)
