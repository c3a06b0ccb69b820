"""Writers: graph, navigation and result documents, GeoJSON, SVG and OSM XML, and bundles of them.

Documents are rows (part, ord, value) that Spark makes in parallel. Written in that
order, the lines of all files one after the other are the document, so that none
passes through one row or one task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import metres_to_lonlat, polyline_length
from waymesh.operators.spatial import coverage
from waymesh.plans.numbering import numbered

#: What documents made of OpenStreetMap data must say.
OSM_SOURCE = {"attribution": "© OpenStreetMap contributors", "license": "ODbL-1.0", "license_url": "https://opendatacommons.org/licenses/odbl/1-0/"}


def _rows(df: DataFrame, part: int, order: Column, value: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), order.cast("long").alias("ord"), value.alias("value"))


def _line(df: DataFrame, part: int, text: str) -> DataFrame:
    return _rows(df.sparkSession.range(1), part, F.lit(0), F.lit(text))


def document(lists: dict[str, tuple[DataFrame, str | tuple[str, ...]]], head: dict | None = None) -> DataFrame:
    """One JSON object with the fields of `head` and lists of rows, each in the order of some columns.

    lists: name to (rows, order). A single column of order is left out of the items,
    several stay. Rows that tie come in any order. Null fields are left out of items.
    """
    parts, any_df = [], next(iter(lists.values()))[0]
    start = "{" + "".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}," for k, v in (head or {}).items())
    for k, (name, (df, order)) in enumerate(lists.items()):
        by, gone = ((order,), (order,)) if isinstance(order, str) else (order, ())
        rows = numbered(df, *by, name="_place")
        item = F.to_json(F.struct(*(F.col(c) for c in df.columns if c not in gone)))
        parts.append(_line(any_df, 2 * k, ("" if k else start) + ("]," if k else "") + f"{json.dumps(name)}:["))
        parts.append(_rows(rows, 2 * k + 1, F.col("_place"), F.concat(F.when(F.col("_place") > 0, ",").otherwise(""), item)))
    parts.append(_line(any_df, 2 * len(lists), "]}"))
    return reduce(DataFrame.unionByName, parts)


def _attributes(df: DataFrame, known: tuple[str, ...]) -> Column:
    """All other columns as one struct, null without any."""
    rest = [c for c in df.columns if c not in known]
    if rest == ["attributes"]:
        return F.col("attributes")
    return F.struct(*rest).alias("attributes") if rest else F.lit(None).cast("string").alias("attributes")


def graph_json(nodes: DataFrame, edges: DataFrame, metadata: dict | None = None) -> DataFrame:
    """The graph document: nodes and edges in their order; columns beyond the known ones are attributes."""
    n = nodes.select("ord", "id", F.struct("x", "y").alias("position"), _attributes(nodes, ("ord", "id", "x", "y")).alias("attributes"))
    e = edges.select("ord", F.col("edge_id").alias("id"), "start_node_id", "end_node_id", "polyline", _attributes(edges, ("ord", "edge_id", "start_node_id", "end_node_id", "polyline")).alias("attributes"))
    return document({"nodes": (n, "ord"), "edges": (e, "ord")}, {"schema_version": 1, "metadata": metadata or {}})


def navigation_json(nodes: DataFrame, edges: DataFrame, nav: DataFrame, restrictions: DataFrame | None = None) -> DataFrame:
    """The navigation document of the rows of `topology.sd_nav_edges`, with turn restrictions (pos, ...) if there are any."""
    allowed = lambda c: F.split(c, ",").alias(c)
    rows = nav.join(edges.select("edge_id", "ord"), "edge_id").select("ord", "edge_id", "start_node_id", "end_node_id", "length_m", allowed("allowed"), allowed("allowed_reverse"))
    spots = nodes.select("ord", F.col("id").alias("node_id"), "x", "y")
    lists = {"nodes": (spots, "ord"), "edges": (rows, "ord")}
    if restrictions is not None:
        lists["turn_restrictions"] = (restrictions, "pos")
    return document(lists, {"schema_version": 1, "role": "navigation_sd_seed"})


def result_json(name: str, rows: DataFrame, *order: str, head: dict | None = None) -> DataFrame:
    """A document with one list of result rows, in the order of some columns: trips, matches, steps, markings, ..."""
    return document({name: (rows, order)}, {"format_version": 1, **(head or {})})


def trips_json(trips: DataFrame) -> DataFrame:
    return result_json("trips", trips, "trace_id", "trip")


def matches_json(matches: DataFrame, algorithm: str = "hmm_viterbi") -> DataFrame:
    """Matches (trace_id, ord, edge_id, d, ...) of all samples with their coverage as stats; samples without an edge are told unmatched."""
    names = {"mean_distance": "mean_distance_m", "max_distance": "max_distance_m"}
    stats = {names.get(c, c): v for c, v in coverage(matches).first().asDict().items()}
    rows = matches.withColumn("unmatched", F.when(F.col("edge_id").isNull(), True))
    return result_json("matches", rows, "trace_id", "ord", head={"stats": {**stats, "algorithm": algorithm}})


def guidance_json(steps: DataFrame) -> DataFrame:
    return result_json("steps", steps, "from_node", "to_node", "k")


def markings_json(markings: DataFrame) -> DataFrame:
    return result_json("candidates", markings, "edge_id", "track")


def observations_json(observations: DataFrame) -> DataFrame:
    return result_json("observations", observations, "pos")


def camera_lanes_json(lanes: DataFrame) -> DataFrame:
    """Markings of `image_lanes.markings_on_edges`."""
    place = F.array("x", "y").alias("world_xy_m")
    return result_json("camera_lanes", lanes.select("image_id", "k", "edge_id", place, "kind", "side", "confidence"), "image_id", "k")


def restrictions_json(restrictions: DataFrame, source: dict | None = OSM_SOURCE) -> DataFrame:
    """Turn restrictions with what their source wants said; None for those seen by cameras or set by hand."""
    return result_json("turn_restrictions", restrictions, "id", head=source)


def routes_json(routes: DataFrame) -> DataFrame:
    return result_json("routes", routes, "from_node", "to_node")


def reachability_json(reached: DataFrame, spans: DataFrame, max_cost: float) -> DataFrame:
    """Reached nodes (origin, state, cost) and spans of edges of a service area."""
    n = reached.select("origin", F.col("state").alias("node_id"), "cost")
    return document({"nodes": (n, ("origin", "node_id")), "edges": (spans, ("origin", "edge_id", "direction"))}, {"format_version": 1, "max_cost_m": max_cost})


def _lonlat(x: Column, y: Column, lat0: float, lon0: float) -> Column:
    return F.array(*metres_to_lonlat(x, y, lat0, lon0))


def _feature(kind: str, coordinates: Column, *properties: Column) -> Column:
    shape = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")))


def feature_collection(features: DataFrame, *order: str, head: dict | None = None) -> DataFrame:
    """A GeoJSON document of rows (..., value), in the order of some columns."""
    rows = numbered(features, *order, name="_ord")
    start = "{" + "".join(f"{json.dumps(k)}:{json.dumps(v, ensure_ascii=False)}," for k, v in {"type": "FeatureCollection", **(head or {})}.items()) + '"features":['
    return _line(rows, 0, start).unionByName(_rows(rows, 1, F.col("_ord"), F.concat(F.when(F.col("_ord") > 0, ",").otherwise(""), F.col("value")))).unionByName(_line(rows, 2, "]}"))


def map_head(dataset: str, lat0: float, lon0: float, source: dict | None = None) -> dict:
    """The head of a map's GeoJSON document: its name, its origin and what its source wants said (see OSM_SOURCE)."""
    return {"name": dataset, "properties": {"origin_lat": lat0, "origin_lon": lon0, "crs_note": "lengths are metres, local to this WGS84 origin", **(source or {})}}


def semantic_summary(rules: Column) -> Column:
    """An edge's rules (an array of JSON texts) in a few words, in their order and with speed limits; null without a kind."""

    def said(rule: Column) -> Column:
        kind, kmh = F.get_json_object(rule, "$.kind"), F.get_json_object(rule, "$.value_kmh")
        limit = F.coalesce(F.concat(F.lit("speed_limit "), kmh.try_cast("double").try_cast("long").cast("string"), F.lit(" km/h")), F.lit("speed_limit"))
        return F.when((kind == "speed_limit") & kmh.isNotNull(), limit).when(kind != "", kind)

    told = F.array_compact(F.transform(rules, said))
    return F.when(F.size(told) > 0, F.array_join(told, "; "))


def map_features(nodes: DataFrame, edges: DataFrame, samples: DataFrame, lat0: float, lon0: float, dataset: str, key: str | None = None) -> DataFrame:
    """Rows (layer, ord, value): GeoJSON features of trajectories, centre lines, lane boundaries and nodes.

    With `key`, all three tables have that column (samples trace_id), and so have the rows.
    Lines of one point are left out. Further columns of nodes and edges are properties,
    where no property of the feature itself has the name. Edges with hd of `hd.enrich`
    have boundaries as layers lane_boundary_left and _right, and centre lines tell their
    semantic rules in short.
    """
    keys = [] if key is None else [key]

    def feature(kind: str, coordinates: Column, *properties: Column) -> Column:
        return _feature(kind, coordinates, F.lit(dataset).alias("dataset"), *properties)

    def further(df: DataFrame, *known: str) -> list[Column]:
        return [F.col(c) for c in df.columns if c not in {"ord", "kind", "dataset", *keys, *known}]

    line = F.transform("polyline", lambda p: _lonlat(p["x"], p["y"], lat0, lon0))
    rules = [semantic_summary(F.col("hd.semantic_rules")).alias("semantic_summary")] if "hd" in edges.columns else []
    rest = further(edges, "edge_id", "start_node_id", "end_node_id", "polyline", "hd", "length_m", "semantic_summary")
    lines = edges.where(F.size("polyline") >= 2).select(*keys, F.lit("centerline").alias("layer"), "ord", feature("LineString", line, F.lit("centerline").alias("kind"), F.col("edge_id"), F.col("start_node_id"), F.col("end_node_id"), polyline_length("polyline").alias("length_m"), *rules, *rest).alias("value"))
    for side in ("left", "right") if "hd" in edges.columns else ():
        shape = F.transform(f"hd.{side}", lambda p: _lonlat(p["x"], p["y"], lat0, lon0))
        kind = F.lit(f"lane_boundary_{side}")
        lines = lines.unionByName(edges.where(F.size(f"hd.{side}") >= 2).select(*keys, kind.alias("layer"), "ord", feature("LineString", shape, kind.alias("kind"), F.col("edge_id"), F.lit(side).alias("side")).alias("value")))
    dots = nodes.select(*keys, F.lit("node").alias("layer"), "ord", feature("Point", _lonlat(F.col("x"), F.col("y"), lat0, lon0), F.lit("node").alias("kind"), F.col("id").alias("node_id"), *further(nodes, "id", "node_id", "x", "y")).alias("value"))
    track = samples.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))), lambda s: _lonlat(s["x"], s["y"], lat0, lon0)).alias("c")).where(F.size("c") >= 2)
    tracks = track.select(*keys, F.lit("trajectory").alias("layer"), F.xxhash64("trace_id").alias("ord"), feature("LineString", F.col("c"), F.lit("trajectory").alias("kind"), F.col("trace_id")).alias("value"))
    return tracks.unionByName(lines).unionByName(dots)


def route_features(routes: DataFrame, edges: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """One GeoJSON feature for each route (from_node, to_node, cost, edges): edges turned to the direction of travel, shared points once."""
    steps = routes.select("from_node", "to_node", "cost", F.posexplode("edges").alias("k", "step"))
    parts = F.split("step", "/")
    steps = steps.withColumns({"edge_id": parts[0], "reverse": parts[1] == "reverse"}).join(edges.select("edge_id", "polyline"), "edge_id")
    way = F.when(F.col("reverse"), F.reverse("polyline")).otherwise(F.col("polyline"))
    piece = F.when(F.col("k") == 0, way).otherwise(F.slice(way, 2, F.size(way)))
    lines = steps.groupBy("from_node", "to_node", "cost").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("p")))), lambda s: s["p"])).alias("line"))
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("line", lambda p: _lonlat(p["x"], p["y"], lat0, lon0)).alias("coordinates"))
    return lines.select("from_node", "to_node", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct("from_node", "to_node", F.col("cost").alias("total_length_m")).alias("properties"))).alias("value"))


def reachability_features(reached: DataFrame, spans: DataFrame, nodes: DataFrame, edges: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Rows (layer, origin, key, value): GeoJSON features of a service area: reached nodes, and edges up to where they are reached."""
    lines = spans.join(edges.select("edge_id", "polyline"), "edge_id")
    way = F.when(F.col("direction") == "reverse", F.reverse("polyline")).otherwise(F.col("polyline"))
    lines = lines.withColumn("_line", way).withColumn("_part", clip(F.col("_line"), F.col("fraction"))).where(F.size("_part") >= 2)
    shape = F.transform("_part", lambda p: _lonlat(p["x"], p["y"], lat0, lon0))
    parts = lines.select(F.lit("edge").alias("layer"), "origin", step_key().alias("key"), _feature("LineString", shape, F.lit("reachable_edge").alias("kind"), F.col("edge_id"), F.col("direction"), F.col("start_cost").alias("start_cost_m"), F.col("fraction").alias("reachable_fraction")).alias("value"))
    dots = reached.join(nodes.select(F.col("id").alias("state"), "x", "y"), "state")
    spots = dots.select(F.lit("node").alias("layer"), "origin", F.col("state").alias("key"), _feature("Point", _lonlat(F.col("x"), F.col("y"), lat0, lon0), F.lit("reachable_node").alias("kind"), F.col("state").alias("node_id"), F.col("cost").alias("cost_m")).alias("value"))
    return parts.unionByName(spots)


def step_key() -> Column:
    return F.concat_ws("/", "edge_id", "direction")


def clip(line: Column, fraction: Column) -> Column:
    """The part of a polyline up to a fraction of its length."""
    total = polyline_length(line)
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def step(acc: Column, s: Column) -> Column:
        d = F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))
        w = F.when(d > 0, F.least(F.lit(1.0), acc["left"] / F.when(d > 0, d))).otherwise(1.0)
        point = F.struct((s["a"]["x"] + w * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + w * (s["b"]["y"] - s["a"]["y"])).alias("y"))
        return F.when(acc["left"] > 0, F.struct(F.concat(acc["line"], F.array(point)).alias("line"), (acc["left"] - d).alias("left"))).otherwise(acc)

    return F.aggregate(steps, F.struct(F.slice(line, 1, 1).alias("line"), (total * fraction).alias("left")), step, lambda a: a["line"])


def quoted(value: Column) -> Column:
    """Text as an XML attribute's value, quotes included."""
    out = value.cast("string")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), out, F.lit('"'))


def osm_xml(nodes: DataFrame, edges: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Rows (part, ord, value): the elements of an OSM XML file, nodes before ways.

    Every polyline vertex is a node of its own. Ids follow from the orders: a graph
    node's is its ord + 1, those of an edge's vertices and of the edge come after.
    """
    lon, lat = metres_to_lonlat(F.col("x"), F.col("y"), lat0, lon0)
    place = F.concat(F.lit(" lat="), quoted(F.format_string("%.9f", lat)), F.lit(" lon="), quoted(F.format_string("%.9f", lon)))
    base = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 2).first()[0]
    most = edges.agg(F.coalesce(F.max(F.size("polyline")), F.lit(0)) + 1).first()[0]
    own = nodes.select(F.lit(0).alias("part"), "ord", F.concat(F.lit("  <node id="), quoted(F.col("ord") + 1), place, F.lit('><tag k="graph_node_id" v='), quoted(F.col("id")), F.lit("/></node>")).alias("value"))
    vertex = lambda k: base + F.col("ord") * most + k
    points = edges.select("ord", F.posexplode("polyline").alias("k", "p")).select("ord", "k", "p.x", "p.y")
    dots = points.select(F.lit(1).alias("part"), vertex(F.col("k")).alias("ord"), F.concat(F.lit("  <node id="), quoted(vertex(F.col("k"))), place, F.lit("/>")).alias("value"))
    refs = F.array_join(F.transform(F.sequence(F.lit(0), F.size("polyline") - 1), lambda k: F.concat(F.lit("<nd ref="), quoted(vertex(k)), F.lit("/>"))), "")
    ways = edges.select(F.lit(2).alias("part"), "ord", F.concat(F.lit("  <way id="), quoted(vertex(F.lit(most - 1))), F.lit(">"), refs, F.lit('<tag k="type" v="line_thin"/><tag k="edge_id" v='), quoted(F.col("edge_id")), F.lit("/></way>")).alias("value"))
    return own.select("part", F.col("ord").cast("long").alias("ord"), "value").unionByName(dots.select("part", F.col("ord").cast("long").alias("ord"), "value")).unionByName(ways.select("part", F.col("ord").cast("long").alias("ord"), "value"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows (part, ord, value) as text files whose concatenation in name order is in the rows' order."""
    rows.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("value").write.mode("overwrite").text(path)


def svg(samples: DataFrame, nodes: DataFrame, edges: DataFrame, width: int = 1000, margin: int = 20) -> DataFrame:
    """Rows (part, ord, value): an SVG picture of samples, edges and nodes; without any, an empty one."""
    spots = samples.select("x", "y").unionByName(nodes.select("x", "y"))
    box = spots.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max)))).first()
    size = max(box["bx"] - box["ax"], box["by"] - box["ay"], 1e-9)
    scale = (width - 2 * margin) / size
    at = lambda x, y: F.concat_ws(",", F.format_string("%.2f", (x - box["ax"]) * scale + margin), F.format_string("%.2f", (box["by"] - y) * scale + margin))
    circle = lambda r, colour: F.concat(F.lit("<circle cx="), quoted(F.substring_index(at(F.col("x"), F.col("y")), ",", 1)), F.lit(" cy="), quoted(F.substring_index(at(F.col("x"), F.col("y")), ",", -1)), F.lit(f' r="{r}" fill="{colour}"/>'))
    line = F.concat(F.lit("<polyline fill=\"none\" stroke=\"#246\" points="), quoted(F.array_join(F.transform("polyline", lambda p: at(p["x"], p["y"])), " ")), F.lit("/>"))
    return reduce(DataFrame.unionByName, [
        _line(nodes, 0, f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{width}">'),
        _rows(samples, 1, F.xxhash64("trace_id", "ord"), circle(1, "#bbb")), _rows(edges, 2, F.col("ord"), line), _rows(nodes, 3, F.col("ord"), circle(3, "#c33")), _line(nodes, 4, "</svg>"),
    ])


def write_bundle(folder: str, nodes: DataFrame, edges: DataFrame, samples: DataFrame, nav: DataFrame, lat0: float, lon0: float, dataset: str = "", restrictions: DataFrame | None = None, per_lane: bool = False, source: dict | None = None) -> dict:
    """Writes graph, nav, map and lanelets below a folder, each as text files in order, and returns the manifest that it also writes.

    source is what the data's source wants said, as OSM_SOURCE; the map and the manifest say it.
    """
    from waymesh.sources.lanelets import lanelet_map

    written = {
        "graph": graph_json(nodes, edges, {"dataset": dataset}),
        "nav": navigation_json(nodes, edges, nav, restrictions),
        "map": feature_collection(map_features(nodes, edges, samples, lat0, lon0, dataset), "layer", "ord", head=map_head(dataset, lat0, lon0, source)),
    }
    if "hd" in edges.columns:
        turns = restrictions if restrictions is not None else None
        body = lanelet_map(nodes, edges, lat0, lon0, per_lane=per_lane, restrictions=turns)
        written["lanelets"] = _line(nodes, -1, '<osm version="0.6">').unionByName(body).unionByName(_line(nodes, 99, "</osm>"))
    for name, rows in written.items():
        write_lines(rows, f"{folder}/{name}")
    counts = {"nodes": nodes.count(), "edges": edges.count(), "samples": samples.count()}
    manifest = {"manifest_version": 1, "dataset": dataset, "origin": {"lat": lat0, "lon": lon0}, "files": sorted(written), "counts": counts, **(source or {})}
    write_lines(_line(nodes, 0, json.dumps(manifest, ensure_ascii=False)), f"{folder}/manifest")
    return manifest
