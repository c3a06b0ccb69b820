"""A folder of trace files to a bundle of documents for each, in one build; files that fail are told apart."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.operators.hd import enrich
from waymesh.operators.topology import sd_nav_edges
from waymesh.plans.build import Build, build_each
from waymesh.session import materialize
from waymesh.sources.documents import map_features, map_head

FIELDS = ("timestamp", "x", "y")


def read_dataset(spark: SparkSession, folder: str, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Samples (trace_id, ord, t, x, y) of the good files of a folder, and all files (trace_id, file, error), error null for good ones.

    A file is a trace, named by its file name without the ending, with a header of its
    own in any case and column order. It is bad as a whole if a column is missing, a
    field is no number or there are no samples; others are read all the same. Samples
    are in order of time, equal times as they stand in the file. Spark's readers pass
    over files without a byte, so these are not among the files.
    """
    reader = spark.read.option("pathGlobFilter", pattern)
    name = lambda path: F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    files = reader.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("file"))
    lines = reader.text(folder).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = lines.where(F.trim("value") != "")
    fields = lambda c: F.transform(F.split(c, ","), lambda v: F.trim(F.regexp_replace(v, '^\\s*"|"\\s*$', "")))
    heads = lines.groupBy("file").agg(F.min(F.struct("start", "row", "value")).alias("h"), F.count("*").alias("n"))
    heads = heads.select("file", "n", F.col("h.row").alias("_head"), F.transform(fields(F.regexp_replace("h.value", "^﻿", "")), F.lower).alias("names"))
    heads = materialize(heads)
    at = lambda c: F.array_position("names", c)
    missing = F.filter(F.array(*map(F.lit, FIELDS)), lambda c: ~F.array_contains("names", c))
    heads = heads.withColumn("_missing", missing)
    rows = lines.join(heads.where(F.size("_missing") == 0), "file").where(F.col("row") != F.col("_head")).withColumn("_v", fields("value"))
    text = lambda c: F.get("_v", (at(c) - 1).cast("int"))
    rows = rows.select("file", "start", "row", *(text(c).alias(f"_{c}") for c in FIELDS), *(text(c).try_cast("double").alias(c) for c in FIELDS))
    rows = materialize(rows)
    said = lambda c: F.min(F.when(F.col(c).isNull(), F.concat(F.lit(f"{c} is no number: "), F.coalesce(F.col(f"_{c}"), F.lit("null")))))
    wrong = rows.groupBy("file").agg(F.coalesce(*map(said, FIELDS)).alias("wrong"))
    told = files.join(heads.select("file", "n", "_missing"), "file", "left").join(wrong, "file", "left")
    error = (
        F.when(F.size("_missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("_missing", ", ")))
        .when(F.coalesce("n", F.lit(0)) < 2, "no samples")
        .otherwise(F.col("wrong"))
    )
    told = materialize(told.select(name("file").alias("trace_id"), "file", error.alias("error")))
    order = Window.partitionBy("file").orderBy("timestamp", "start", "row")
    good = rows.join(told.where("error is null").select("file", "trace_id"), "file")
    return good.select("trace_id", F.row_number().over(order).cast("long").alias("ord"), F.col("timestamp").alias("t"), "x", "y"), told


def _document(name: str, traces: DataFrame, lists: dict[str, DataFrame], head: Column) -> DataFrame:
    """Rows (trace_id, document, part, ord, value): one JSON object for each trace, of `head` and lists of rows (trace_id, ord, value)."""
    line = lambda part, text: traces.select("trace_id", F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), text.alias("value"))
    parts = [line(0, F.concat(F.lit("{"), F.substring(head, F.lit(2), F.length(head) - 2)))]
    for k, (field, rows) in enumerate(lists.items()):
        place = F.row_number().over(Window.partitionBy("trace_id").orderBy("ord", "value"))
        items = rows.withColumn("_n", place).select("trace_id", F.lit(3 * k + 2).alias("part"), F.col("_n").cast("long").alias("ord"), F.concat(F.when(F.col("_n") > 1, ",").otherwise(""), "value").alias("value"))
        parts += [line(3 * k + 1, F.lit(f",{json.dumps(field)}:[")), items, line(3 * k + 3, F.lit("]"))]
    parts.append(line(3 * len(lists) + 1, F.lit("}")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("document", F.lit(name))


def own_names(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A graph of several traces with ids that begin at n0 and e0 for each of them; the ids before are columns whole_id."""
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("ord")) - 1
    rename = lambda df, c, letter: df.withColumn("ord", place.cast("long")).withColumns({"whole_id": F.col(c), c: F.concat(F.lit(letter), "ord")})
    nodes, edges = materialize(rename(graph["nodes"], "id", "n")), rename(graph["edges"], "edge_id", "e")
    for c in ("start_node_id", "end_node_id"):
        edges = edges.join(nodes.select(F.col("whole_id").alias(c), F.col("id").alias("_own")), c).drop(c).withColumnRenamed("_own", c)
    return {"nodes": nodes, "edges": materialize(edges)}


def process_dataset(
    spark: SparkSession, folder: str, out: str, lat0: float = 0.0, lon0: float = 0.0, pattern: str = "*.csv", p: Build = Build(),
    lane_width: float = 3.5, prefix: str | None = None, continue_on_error: bool = True,
) -> DataFrame:
    """Writes a bundle for each good trace file of a folder and returns the manifest, which it writes too.

    Bundles lie in out/bundles/trace_id=.../document=..., where graph, nav, map and
    manifest are text files whose concatenation in name order is the document. The
    manifest has a row (file, trace_id, status, error, samples, nodes, edges) for each
    file, and lies as JSON lines in out/manifest. A file fails by itself (see
    `read_dataset`), or if its samples give no edges; unless errors are to stop
    everything, which they do before anything is written, the others go on.
    """
    samples, told = read_dataset(spark, folder, pattern)

    def stop(rows: DataFrame) -> None:
        bad = None if continue_on_error else rows.where("error is not null").orderBy("file").first()
        if bad is not None:
            raise RuntimeError(f"{bad['file']}: {bad['error']}")

    stop(told)
    samples = materialize(samples)
    whole = build_each(samples, p)
    nav = sd_nav_edges(whole["edges"])
    graph = own_names(whole)
    counts = samples.groupBy("trace_id").agg(F.count("*").alias("samples"))
    size = lambda df, c: df.groupBy("trace_id").agg(F.count("*").alias(c))
    found = told.join(counts, "trace_id", "left").join(size(graph["nodes"], "nodes"), "trace_id", "left").join(size(graph["edges"], "edges"), "trace_id", "left")
    error = F.coalesce("error", F.when(F.col("edges").isNull(), "the samples give no edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    manifest = materialize(found.select("file", "trace_id", F.when(error.isNull(), "ok").otherwise("failed").alias("status"), error.alias("error"), zero("samples"), zero("nodes"), zero("edges")))
    stop(manifest)
    traces = manifest.where("status = 'ok'")
    label = F.concat(F.lit(f"{prefix}_" if prefix else ""), "trace_id")
    nodes, edges = enrich(graph["nodes"], graph["edges"], lane_width)
    item = lambda df, *columns: df.select("trace_id", "ord", F.to_json(F.struct(*columns)).alias("value"))
    hd = [c for c in edges.columns if c in ("hd",)]
    n = item(nodes, "id", F.struct("x", "y").alias("position"), F.struct("degree", "junction_hint", "junction_type").alias("attributes"))
    e = item(edges, F.col("edge_id").alias("id"), "start_node_id", "end_node_id", "polyline", F.struct(*hd).alias("attributes"))
    allowed = lambda c: F.split(c, ",").alias(c)
    ways = nav.select(F.col("edge_id").alias("whole_id"), "length_m", allowed("allowed"), allowed("allowed_reverse"))
    ways = item(edges.join(ways, "whole_id"), "edge_id", "start_node_id", "end_node_id", "length_m", "allowed", "allowed_reverse")
    layers = map_features(nodes.drop("whole_id"), edges.drop("whole_id"), samples.join(traces, "trace_id", "left_semi"), lat0, lon0, prefix or "", key="trace_id").withColumn("ord", F.struct("layer", "ord"))
    told_of = F.to_json(F.struct(F.lit(1).alias("manifest_version"), label.alias("dataset"), F.struct(F.lit(lat0).alias("lat"), F.lit(lon0).alias("lon")).alias("origin"), F.array(*map(F.lit, ("graph", "map", "nav"))).alias("files"), F.struct("samples", "nodes", "edges").alias("counts")))
    spots = item(nodes, F.col("id").alias("node_id"), "x", "y")
    of_map = F.struct(*(F.lit(v).alias(k) for k, v in map_head("", lat0, lon0)["properties"].items())).alias("properties")
    rows = _document("graph", traces, {"nodes": n, "edges": e}, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct(label.alias("dataset")).alias("metadata"))))
    rows = rows.unionByName(_document("nav", traces, {"nodes": spots, "edges": ways}, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("navigation_sd_seed").alias("role")))))
    rows = rows.unionByName(_document("map", traces, {"features": layers}, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), label.alias("name"), of_map))))
    rows = rows.unionByName(_document("manifest", traces, {}, told_of))
    order = ["trace_id", "document", "part", "ord"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("trace_id", "document", "value").write.partitionBy("trace_id", "document").mode("overwrite").text(f"{out}/bundles")
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return manifest
