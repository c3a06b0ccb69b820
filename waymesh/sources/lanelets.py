"""Lanelet maps in OSM XML: lanelets of edges or of their lanes, rules that refer to them, and their checks.

All elements are rows that Spark makes in parallel. Ids follow from the order of
nodes, edges and lanes, so that an element knows the ids it refers to without a join:
a node's is its order, a way's that of its edge, lane and side, and so on, in ranges
that follow each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymesh.functions.geometry import metres_to_lonlat
from waymesh.operators.hd import boundaries, shifted
from waymesh.operators.spatial import nearest_nodes
from waymesh.plans.numbering import numbered
from waymesh.session import materialize
from waymesh.sources.documents import quoted

#: Prefix of tags that only say where an element comes from.
OWN = "graph:"
#: Metres of a degree of latitude, as maps of lights are drawn with.
METRES_A_DEGREE = 111_320.0
#: Rules that become regulatory elements.
REGULATED = ("traffic_light", "stop_sign", "stop_line", "yield", "priority_right", "pedestrian_marking")
RULE = "struct<kind:string,value_kmh:double,confidence:double,world_xy_m:struct<x:double,y:double>,polyline_m:array<array<double>>>"
TAGS = "array<struct<k:string,v:string>>"


def _tags(**values: Column | str | None) -> Column:
    """Tags in order; those whose value is null are left out. Two underscores in a name stand for a colon."""
    each = [F.when(v.isNotNull(), F.struct(F.lit(k.replace("__", ":")).alias("k"), v.cast("string").alias("v")).cast("struct<k:string,v:string>")) for k, v in ((k, F.lit(v) if isinstance(v, str) else v) for k, v in values.items() if v is not None)]
    return F.array_compact(F.array(*each))


def _xml(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("<tag k="), quoted(t["k"]), F.lit(" v="), quoted(t["v"]), F.lit("/>"))), "")


def _member(kind: str, ref: Column, role: str) -> Column:
    return F.concat(F.lit(f'<member type="{kind}" ref='), quoted(ref), F.lit(f' role="{role}"/>'))


def _node(number: Column, x: Column, y: Column, lat0: float, lon0: float, tags: Column | None = None) -> Column:
    lon, lat = metres_to_lonlat(x, y, lat0, lon0)
    place = F.concat(F.lit("<node id="), quoted(number), F.lit(" lat="), quoted(F.format_string("%.10f", lat)), F.lit(" lon="), quoted(F.format_string("%.10f", lon)))
    return F.concat(place, F.lit("/>")) if tags is None else F.concat(place, F.lit(">"), _xml(tags), F.lit("</node>"))


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def road_tags(df: DataFrame) -> dict[str, Column]:
    """Tags of a lanelet from the OSM columns of its edge: one_way, vehicles, speed_limit with its unit and name."""
    oneway = F.lower(F.trim(_or_null(df, "osm_oneway", "string")))
    speed = F.regexp_extract(F.trim(F.coalesce(_or_null(df, "osm_maxspeed", "string"), F.lit(""))), r"^(\d+(?:\.\d+)?)(?:\s|$)", 1).try_cast("double")
    return {
        "one_way": F.when(oneway.isin("yes", "true", "1", "-1", "reverse"), "yes").otherwise("no"), "participant__vehicle": F.lit("yes"),
        "speed_limit": F.when(speed > 0, F.concat(F.floor(speed).cast("string"), F.lit(" km/h"))), "name": F.nullif(_or_null(df, "osm_name", "string"), F.lit("")),
    }


def flows(df: DataFrame) -> tuple[Column, Column]:
    """Whether traffic runs along an edge and against it, from osm_oneway; unknown values are both."""
    tag = F.coalesce(F.lower(F.trim(_or_null(df, "osm_oneway", "string"))), F.lit(""))
    return ~tag.isin("-1", "reverse"), ~tag.isin("yes", "true", "1")


def lanelets(edges: DataFrame, per_lane: bool = False, base_width: float = 3.5) -> DataFrame:
    """Rows (ord, edge_id, lane, n_lanes, left, right, center, left_style, right_style, confidence, tags) of edges with hd.

    An edge with both boundaries is one lanelet. Per lane, an edge with lanes is one for
    each, an even share of its width about the lane's line; outer boundaries are solid,
    inner ones dashed unless column marking_style says otherwise.
    """
    style = F.coalesce(_or_null(edges, "marking_style", "string"), F.lit(None))
    none = F.lit(None).cast("double")
    road = _tags(type="lanelet", subtype="road", location="urban", **{"graph__edge_id": F.col("edge_id")}, **road_tags(edges))
    columns = ["ord", "edge_id", "lane", "n_lanes", "left", "right", "center", "left_style", "right_style", "confidence", "tags"]
    whole = edges.where((F.size("hd.left") >= 2) & (F.size("hd.right") >= 2))
    solid = F.coalesce(style, F.lit("solid"))
    whole = whole.select("ord", "edge_id", F.lit(0).alias("lane"), F.lit(1).alias("n_lanes"), "hd.left", "hd.right", F.col("polyline").alias("center"), solid.alias("left_style"), solid.alias("right_style"), none.alias("confidence"), road.alias("tags"))
    if not per_lane or "lanes" not in edges.columns:
        return whole.select(*columns)
    several = edges.where(F.size("lanes") >= 1)
    half = F.coalesce(F.col("refinement.half_width") if "refinement" in edges.columns else F.lit(None).cast("double"), F.lit(base_width / 2))
    sure = F.coalesce(_or_null(edges, "lane_confidence", "double"), none)
    laned = several.select("ord", "edge_id", "polyline", F.size("lanes").alias("n_lanes"), (2 * half / F.size("lanes")).alias("_width"), sure.alias("confidence"), F.coalesce(style, F.lit("dashed")).alias("_inner"), road.alias("_road"), F.explode("lanes").alias("l"))
    center = F.when(F.size("l.centerline") >= 2, F.col("l.centerline")).otherwise(shifted("polyline", F.col("l.offset_m")))
    laned = laned.withColumns({"center": center, "lane": F.col("l.lane_index")})
    left, right = boundaries("center", F.col("_width"))
    outer = lambda last: F.when((F.col("n_lanes") == 1) | (F.col("lane") == (F.col("n_lanes") - 1 if last else F.lit(0))), "solid").otherwise(F.col("_inner"))
    more = F.concat("_road", _tags(graph__lane_index=F.col("lane"), graph__confidence=F.format_string("%.4f", "confidence")))
    laned = laned.withColumns({"left": left, "right": right, "left_style": outer(False), "right_style": outer(True), "tags": more})
    rest = whole.join(several.select("edge_id"), "edge_id", "left_anti")
    return laned.select(*columns).unionByName(rest.select(*columns))


def lane_connections(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node_id, before, after, junction_type, junction_hint): edges (edge_id) that traffic leaves and enters at a node, different ones."""
    ahead, back = flows(edges)
    ends = F.array(
        F.when(ahead, F.struct(F.col("start_node_id").alias("node_id"), F.lit(True).alias("enters"))), F.when(ahead, F.struct(F.col("end_node_id").alias("node_id"), F.lit(False).alias("enters"))),
        F.when(back, F.struct(F.col("end_node_id").alias("node_id"), F.lit(True).alias("enters"))), F.when(back, F.struct(F.col("start_node_id").alias("node_id"), F.lit(False).alias("enters"))),
    )
    rows = edges.select("edge_id", F.explode(F.array_compact(ends)).alias("e")).select("edge_id", "e.*").distinct()
    out = rows.where("not enters").select("node_id", F.col("edge_id").alias("before"))
    into = rows.where("enters").select("node_id", F.col("edge_id").alias("after"))
    kinds = nodes.select(F.col("id").alias("node_id"), _or_null(nodes, "junction_type", "string").alias("junction_type"), _or_null(nodes, "junction_hint", "string").alias("junction_hint"))
    return out.join(into, "node_id").where("before <> after").join(kinds, "node_id", "left")


def speed_limits(rules: DataFrame) -> DataFrame:
    """Rows (edge_id, kmh): the lowest speed limit among an edge's rules."""
    return rules.where("kind = 'speed_limit' and value_kmh is not null").groupBy("edge_id").agg(F.min(F.floor("value_kmh")).cast("int").alias("kmh"))


def lanelet_map(nodes: DataFrame, edges: DataFrame, lat0: float, lon0: float, per_lane: bool = False, speed_as_rule: bool = False, restrictions: DataFrame | None = None) -> DataFrame:
    """Rows (part, ord, value): the elements of a lanelet map, MetaInfo and nodes before ways before relations.

    nodes have id, ord, x, y; edges ord, edge_id, ends, polyline, hd of `hd.enrich`, and,
    where known, lanes, osm_* and marking_style. hd.semantic_rules (JSON) give lanelets
    their speed_limit, or with `speed_as_rule` a relation of its own, and regulatory
    elements: a traffic light with a place gets a node, a stop line with a line a way.
    Neighbour lanes get a lane_change, lanelets that follow each other at a node a
    lane_connection, turn restrictions (id, from_edge_id, to_edge_id, restriction) a
    right_of_way. Edges without both boundaries have their centre line only.
    """
    ll = lanelets(edges, per_lane)
    most = ll.agg(F.coalesce(F.max("n_lanes"), F.lit(1)).alias("lanes"), F.coalesce(F.max(F.greatest(F.size("left"), F.size("right"))), F.lit(0)).alias("points")).first()
    ends = edges.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("ord"), F.coalesce(F.max(F.size("polyline")), F.lit(0)).alias("points")).first()
    n_edges, slots, points = ends["ord"] + 1, 1 + 2 * most["lanes"], max(most["points"], ends["points"], 1)
    way0 = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("n")).first()["n"] + 2
    dot0 = way0 + n_edges * slots
    rel0 = dot0 + n_edges * slots * points
    rule0 = rel0 + n_edges * most["lanes"]
    number = lambda slot: F.col("ord") * slots + slot
    lanelet = lambda edge, lane: F.lit(rel0) + edge * most["lanes"] + lane

    height = _or_null(nodes, "elevation_m", "double")
    known = _tags(graph__node_id=F.col("id"), ele=F.when(height.isNotNull(), F.format_string("%.3f", height)))
    parts = [
        nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit('<MetaInfo format_version="1" map_version="1" projector_type="local"'), F.lit(f' origin_lat="{lat0:.10f}" origin_lon="{lon0:.10f}"/>')).alias("value")),
        nodes.select(F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), _node(F.col("ord") + 1, F.col("x"), F.col("y"), lat0, lon0, known).alias("value")),
    ]
    side = lambda name, k: ll.select(number(1 + 2 * F.col("lane") + k).alias("way"), F.col(name).alias("line"), _tags(graph__edge_id=F.col("edge_id"), graph__side=F.lit(name), graph__lane_index=F.when(F.col("n_lanes") > 1, F.col("lane")), type="line_thin", subtype=F.col(f"{name}_style")).alias("tags"))
    middle = edges.where(F.size("polyline") >= 2).select(number(F.lit(0)).alias("way"), F.col("polyline").alias("line"), _tags(graph__edge_id=F.col("edge_id"), type="line_thin", subtype="solid").alias("tags"))
    ways = reduce(DataFrame.unionByName, (side("left", 0), side("right", 1), middle))
    dot = lambda way, k: F.lit(dot0) + way * points + k
    dots = ways.select("way", F.posexplode("line").alias("k", "p"))
    parts.append(dots.select(F.lit(2).alias("part"), dot(F.col("way"), F.col("k")).cast("long").alias("ord"), _node(dot(F.col("way"), F.col("k")), F.col("p.x"), F.col("p.y"), lat0, lon0).alias("value")))
    refs = F.array_join(F.transform("line", lambda _, k: F.concat(F.lit("<nd ref="), quoted(dot(F.col("way"), k)), F.lit("/>"))), "")
    parts.append(ways.select(F.lit(4).alias("part"), F.col("way").cast("long").alias("ord"), F.concat(F.lit("<way id="), quoted(way0 + F.col("way")), F.lit(">"), refs, _xml(F.col("tags")), F.lit("</way>")).alias("value")))

    parsed = F.from_json("rule", RULE)
    rules = edges.select("ord", "edge_id", F.posexplode("hd.semantic_rules").alias("k", "rule")).select("ord", "edge_id", "k", parsed.alias("r")).select("ord", "edge_id", "k", "r.*")
    rules = rules.join(ll.where("lane = 0").select("edge_id"), "edge_id", "left_semi")
    slow = speed_limits(rules)
    body = F.concat(_member("way", way0 + number(1 + 2 * F.col("lane")), "left"), _member("way", way0 + number(2 + 2 * F.col("lane")), "right"), F.when(F.col("n_lanes") == 1, _member("way", way0 + number(F.lit(0)), "centerline")).otherwise(""))
    told = ll.join(slow, "edge_id", "left")
    tags = F.col("tags") if speed_as_rule else F.when(F.col("kmh").isNotNull(), F.concat(F.filter("tags", lambda t: t["k"] != "speed_limit"), _tags(speed_limit=F.col("kmh")))).otherwise(F.col("tags"))
    parts.append(told.select(F.lit(6).alias("part"), lanelet(F.col("ord"), F.col("lane")).cast("long").alias("ord"), F.concat(F.lit("<relation id="), quoted(lanelet(F.col("ord"), F.col("lane"))), F.lit(">"), body, _xml(tags), F.lit("</relation>")).alias("value")))

    # rules as rows (kind of rule, order, members, tags, place, line), numbered together
    own = _member("relation", lanelet(F.col("ord"), F.lit(0)), "refers")
    sure = F.format_string("%.4f", "confidence")
    empty_line, no = F.array().cast("array<array<double>>"), F.lit(None).cast("double")

    def rule_rows(df: DataFrame, rank: int, order: Column, members: Column, tags: Column, x: Column = no, y: Column = no, line: Column = empty_line) -> DataFrame:
        return df.select(F.lit(rank).alias("rank"), order.alias("key"), members.alias("members"), tags.cast(TAGS).alias("tags"), x.alias("x"), y.alias("y"), line.alias("line"))

    order = F.format_string("%012d/%06d", F.col("ord"), F.col("k"))
    plain = rules.where(F.col("kind").isin(*REGULATED) & ~((F.col("kind") == "stop_line") & (F.size("polyline_m") >= 2)))
    groups = [rule_rows(plain, 0, order, own, _tags(type="regulatory_element", subtype=F.col("kind"), graph__confidence=F.when(F.col("confidence").isNotNull(), sure)), F.when(F.col("kind") == "traffic_light", F.col("world_xy_m.x")), F.when(F.col("kind") == "traffic_light", F.col("world_xy_m.y")))]
    groups.append(rule_rows(rules.where("kind = 'stop_line' and size(polyline_m) >= 2"), 1, order, F.lit(""), _tags(type="line_thin", subtype="solid", graph__kind="stop_line"), line=F.col("polyline_m")))
    if speed_as_rule:
        limits = edges.select("ord", "edge_id").join(slow, "edge_id")
        groups.append(rule_rows(limits, 2, F.format_string("%012d", "ord"), own, _tags(type="regulatory_element", subtype="speed_limit", speed_limit=F.col("kmh"))))
    pair = F.concat(_member("relation", lanelet(F.col("ord"), F.col("lane")), "lanelet"), _member("relation", lanelet(F.col("ord"), F.col("lane") + 1), "lanelet"))
    groups.append(rule_rows(ll.where("lane < n_lanes - 1"), 3, F.format_string("%012d/%06d", "ord", "lane"), pair, _tags(type="regulatory_element", subtype="lane_change", sign=F.col("right_style"), graph__edge_id=F.col("edge_id"))))
    first = ll.where("lane = 0").select("edge_id", "ord")
    links = lane_connections(edges, nodes)
    for c in ("before", "after"):
        links = links.join(first.select(F.col("edge_id").alias(c), F.col("ord").alias(f"{c}_ord")), c)
    follow = F.concat(_member("relation", lanelet(F.col("before_ord"), F.lit(0)), "predecessor"), _member("relation", lanelet(F.col("after_ord"), F.lit(0)), "successor"))
    groups.append(rule_rows(links, 4, F.format_string("%s/%012d/%012d", "node_id", "before_ord", "after_ord"), follow, _tags(type="regulatory_element", subtype="lane_connection", graph__junction_node_id=F.col("node_id"), graph__junction_type=F.col("junction_type"), graph__junction_hint=F.col("junction_hint"))))
    if restrictions is not None:
        turns = restrictions
        for c in ("from", "to"):
            turns = turns.join(first.select(F.col("edge_id").alias(f"{c}_edge_id"), F.col("ord").alias(f"{c}_ord")), f"{c}_edge_id")
        both = F.concat(_member("relation", lanelet(F.col("from_ord"), F.lit(0)), "refers"), _member("relation", lanelet(F.col("to_ord"), F.lit(0)), "refers"))
        groups.append(rule_rows(turns, 5, F.col("id"), both, _tags(type="regulatory_element", subtype="right_of_way", graph__restriction=F.col("restriction"))))
    every = numbered(reduce(DataFrame.unionByName, groups), "rank", "key", name="place")
    # a rule has one number for itself and, after all rules, one for each point of its own
    totals = every.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("line")), F.lit(0)).alias("points")).first()
    self_id, spot0, room = F.lit(rule0) + F.col("place"), rule0 + totals["n"], max(1, totals["points"])
    spot = lambda k: F.lit(spot0) + F.col("place") * room + k
    light = every.where("x is not null and y is not null")
    parts.append(light.select(F.lit(3).alias("part"), spot(F.lit(0)).cast("long").alias("ord"), _node(spot(F.lit(0)), F.col("x"), F.col("y"), lat0, lon0, _tags(type="traffic_light")).alias("value")))
    lines = every.where("size(line) >= 2")
    parts.append(lines.select("place", F.posexplode("line").alias("k", "p")).select(F.lit(3).alias("part"), spot(F.col("k")).cast("long").alias("ord"), _node(spot(F.col("k")), F.col("p")[0], F.col("p")[1], lat0, lon0).alias("value")))
    spots = F.array_join(F.transform("line", lambda _, k: F.concat(F.lit("<nd ref="), quoted(spot(k)), F.lit("/>"))), "")
    parts.append(lines.select(F.lit(5).alias("part"), F.col("place").cast("long").alias("ord"), F.concat(F.lit("<way id="), quoted(self_id), F.lit(">"), spots, _xml(F.col("tags")), F.lit("</way>")).alias("value")))
    lamp = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), _member("node", spot(F.lit(0)), "refers")).otherwise("")
    parts.append(every.where("size(line) < 2").select(F.lit(7).alias("part"), F.col("place").cast("long").alias("ord"), F.concat(F.lit("<relation id="), quoted(self_id), F.lit(">"), F.col("members"), lamp, _xml(F.col("tags")), F.lit("</relation>")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def read_osm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes (id, lat, lon, tags), ways (id, refs, tags) and relations (id, members, tags) of OSM XML; tags is a map."""
    tag = "tag array<struct<_k:string,_v:string>>"
    load = lambda kind, schema: spark.read.format("xml").option("rowTag", kind).schema(schema).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")
    nodes = load("node", f"_id long, _lat double, _lon double, {tag}").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags)
    ways = load("way", f"_id long, nd array<struct<_ref:long>>, {tag}").select(F.col("_id").alias("id"), F.col("nd._ref").alias("refs"), tags)
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role"))).alias("members")
    relations = load("relation", f"_id long, member array<struct<_type:string,_ref:long,_role:string>>, {tag}").select(F.col("_id").alias("id"), members, tags)
    return {"nodes": nodes, "ways": ways, "relations": relations}


def check_lanelets(relations: DataFrame) -> DataFrame:
    """Rows (key, level, rule): lanelets need subtype and location (error) and should have speed_limit (warning)."""
    of = lambda k: F.coalesce(F.element_at("tags", F.lit(k)), F.lit(""))
    missing = F.array_compact(F.array(*(F.when(of(k) == "", F.struct(F.lit(level).alias("level"), F.lit(k).alias("rule"))) for k, level in (("subtype", "error"), ("location", "error"), ("speed_limit", "warning")))))
    return relations.where(of("type") == "lanelet").select(F.col("id").cast("string").alias("key"), F.explode(missing).alias("m")).select("key", "m.*")


def lanelet_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (kind, n): nodes, ways and relations by type and subtype."""
    kind = F.concat_ws("/", F.coalesce(F.element_at("tags", F.lit("type")), F.lit("relation")), F.element_at("tags", F.lit("subtype")))
    rows = [tables[t].select(F.lit(t[:-1]).alias("kind")) for t in ("nodes", "ways")] + [tables["relations"].select(kind.alias("kind"))]
    return reduce(DataFrame.unionByName, rows).groupBy("kind").agg(F.count("*").alias("n"))


def center_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (id, line) of lanelets: their centre line, else the mean of both sides point by point, as (lon, lat)."""
    role = lambda r: F.element_at(F.filter("members", lambda m: (m["type"] == "way") & (m["role"] == r)), 1)["ref"]
    has = lambda r: F.exists("members", lambda m: (m["type"] == "way") & (m["role"] == r))
    ll = tables["relations"].where(F.element_at("tags", F.lit("type")) == "lanelet").select("id", *(F.when(has(r), role(r)).alias(r) for r in ("left", "right", "centerline")))
    dots = tables["ways"].select(F.col("id").alias("way"), F.posexplode("refs").alias("k", "node")).join(tables["nodes"].select(F.col("id").alias("node"), "lat", "lon"), "node")
    lines = dots.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))).alias("line"))
    for r in ("left", "right", "centerline"):
        ll = ll.join(lines.select(F.col("way").alias(r), F.col("line").alias(f"_{r}")), r, "left")
    n = F.least(F.size("_left"), F.size("_right"))
    mean = F.zip_with(F.slice("_left", F.lit(1), n), F.slice("_right", F.lit(1), n), lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
    return ll.select("id", F.coalesce("_centerline", F.when(n > 0, mean), "_left", "_right").alias("line"))


def light_lines(tables: dict[str, DataFrame], height: float = 5.0, half_width: float = 0.75) -> dict[str, DataFrame]:
    """Traffic lights of a lanelet map whose sign is a point, as lines across their lanelet.

    Gives new nodes (id, lat, lon, tags, signal) and ways, relations with members of the
    new form, in place of those with their ids, and rows (lanelet, rule) of lanelets that
    must name a rule. A light counts if its lanelet and the node that it refers to are
    there. Its line lies across the end of the lanelet's centre line, from right to left,
    and each light takes three ids after the greatest one, in the order of the lights.
    """
    of = lambda k: F.element_at("tags", F.lit(k))
    lights = tables["relations"].where((of("type") == "regulatory_element") & (of("subtype") == "traffic_light")).select(
        "id", "tags", last_of(F.filter("members", lambda m: (m["type"] == "relation") & m["role"].isin("refers", "lanelet"))).alias("lanelet"),
        last_of(F.filter("members", lambda m: (m["type"] == "node") & (m["role"] == "refers"))).alias("signal"),
    )
    places = tables["nodes"].select(F.col("id").alias("signal"), "lat", "lon")
    lights = lights.join(places, "signal").join(center_lines(tables).withColumnRenamed("id", "lanelet"), "lanelet")
    lat0 = tables["nodes"].agg(F.coalesce(F.avg("lat"), F.lit(0.0))).first()[0]
    n = F.size("line")
    a, b = F.get("line", n - 2), F.get("line", n - 1)
    dx, dy = (b["x"] - a["x"]) * METRES_A_DEGREE * F.cos(F.radians(F.lit(lat0))), (b["y"] - a["y"]) * METRES_A_DEGREE
    size = F.sqrt(dx * dx + dy * dy)
    known = F.coalesce(size > 1e-9, F.lit(False))
    hx, hy = F.when(known, dx / size).otherwise(1.0), F.when(known, dy / size).otherwise(0.0)
    most = F.greatest(*(F.coalesce(F.lit(tables[t].agg(F.max(F.col("id").try_cast("long"))).first()[0]).cast("long"), F.lit(0)) for t in ("nodes", "ways", "relations")))
    lights = numbered(lights.withColumns({"hx": hx, "hy": hy, "_id": F.col("id").try_cast("long")}), "_id", "id", name="_k")
    lights = materialize(lights.withColumn("base", most + 1 + 3 * F.col("_k")))
    kind = tables["nodes"].schema["id"].dataType
    number = lambda k: (F.col("base") + k).cast(kind)

    def end(k: int, side: float) -> Column:
        lat = F.col("lat") + side * half_width * F.col("hx") / METRES_A_DEGREE
        lon = F.col("lon") - side * half_width * F.col("hy") / (METRES_A_DEGREE * F.greatest(F.cos(F.radians("lat")), F.lit(1e-9)))
        return F.struct(number(k).alias("id"), lat.alias("lat"), lon.alias("lon"))

    none = F.create_map().cast("map<string,string>")
    nodes = lights.select("signal", F.explode(F.array(end(0, -1.0), end(1, 1.0))).alias("n")).select("n.*", none.alias("tags"), "signal")
    tags = F.create_map(F.lit("height"), F.lit(f"{height:.2f}"), F.lit("traffic_light_id"), F.col("id").cast("string"))
    ways = lights.select(number(2).alias("id"), F.array(number(0), number(1)).alias("refs"), tags.alias("tags"))
    member = lambda role: F.struct(F.lit("way").alias("type"), number(2).cast("string").alias("ref"), F.lit(role).alias("role"))
    shape = tables["relations"].schema["members"].dataType
    relations = lights.select("id", F.array(member("refers"), member("light_bulbs")).cast(shape).alias("members"), "tags")
    return {"nodes": nodes, "ways": ways, "relations": relations, "rules": lights.select("lanelet", F.col("id").cast("string").alias("rule"))}


def last_of(members: Column) -> Column:
    """What the last member refers to, null without any."""
    return F.get(members, F.size(members) - 1)["ref"]


def sanitized(tables: dict[str, DataFrame], ele: float = 0.0, threshold_deg: float = 35.0, light_height: float = 5.0) -> dict[str, DataFrame]:
    """The tables of a lanelet map as strict readers take them.

    Regulatory elements go, but for traffic lights that become lines (`light_lines`);
    tags that start with OWN go, and so do widths and points' marks of lights. Every
    node has ele, that of the nearest node that has it (else `ele`), a light's new nodes
    that of its point, and every lanelet turn_direction: left or right if its line turns
    by more than the threshold.
    """
    of = lambda k: F.element_at("tags", F.lit(k))
    clean = F.map_filter("tags", lambda k, _: ~k.startswith(OWN) & (k != "width"))
    lights = light_lines(tables, light_height)
    columns = ["id", "lat", "lon", "tags"]
    nodes = tables["nodes"].select(*columns)
    lat0 = nodes.agg(F.coalesce(F.avg("lat"), F.lit(0.0))).first()[0]
    height = nodes.select(F.col("id").alias("signal"), of("ele").try_cast("double").alias("_own"))
    made = lights["nodes"].join(height, "signal", "left").select("id", "lat", "lon", F.when(F.col("_own").isNotNull(), F.create_map(F.lit("ele"), F.col("_own").cast("string"))).otherwise(F.col("tags")).alias("tags"))
    x, y = F.radians("lon") * F.cos(F.radians(F.lit(lat0))) * 6_371_000.0, F.radians("lat") * 6_371_000.0
    placed = nodes.unionByName(made).withColumns({"x": x, "y": y, "_ele": of("ele").try_cast("double")})
    high = placed.where("_ele is not null").select(F.col("id").cast("string").alias("id"), F.col("id").cast("long").alias("ord"), "x", "y", "_ele")
    near = nearest_nodes(placed.where("_ele is null").select(F.col("id").alias("key"), "x", "y"), high.select("id", "ord", "x", "y"), 50.0)
    found = near.join(high.select(F.col("id").alias("node_id"), F.col("_ele").alias("_near")), "node_id").select(F.col("key").alias("id"), "_near")
    filled = F.coalesce("_ele", "_near", F.lit(float(ele)))
    kept = F.map_filter(clean, lambda k, v: (k != "ele") & ~((k == "type") & (v == "traffic_light")))
    nodes = placed.join(found, "id", "left").select("id", "lat", "lon", F.map_concat(kept, F.create_map(F.lit("ele"), F.format_string("%.3f", filled))).alias("tags"))
    lines = center_lines(tables).withColumn("line", F.transform("line", lambda p: F.struct((p["x"] * F.cos(F.radians(F.lit(lat0)))).alias("x"), p["y"].alias("y"))))
    n = F.size("line")
    heading = lambda a, b: F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    change = heading(F.element_at("line", n - 1), F.element_at("line", n)) - heading(F.element_at("line", 1), F.element_at("line", 2))
    turn = F.pmod(change + 180.0, F.lit(360.0)) - 180.0
    way = F.when(n < 3, "straight").when(turn > threshold_deg, "left").when(turn < -threshold_deg, "right").otherwise("straight")
    relations = tables["relations"].where(F.coalesce(of("type"), F.lit("")) != "regulatory_element").select("id", "members", "tags").unionByName(lights["relations"])
    shape = tables["relations"].schema["members"].dataType
    member = F.struct(F.lit("relation").alias("type"), F.col("rule").alias("ref"), F.lit("regulatory_element").alias("role"))
    rules = lights["rules"].groupBy(F.col("lanelet").alias("id")).agg(F.array_sort(F.collect_set(member)).cast(shape).alias("_rules"))
    relations = relations.join(lines.select("id", way.alias("_turn")), "id", "left").join(rules, "id", "left")
    members = F.when(F.col("_rules").isNull(), F.col("members")).otherwise(F.array_union("members", "_rules"))
    turned = F.when(F.col("_turn").isNotNull() & of("turn_direction").isNull(), F.map_concat(clean, F.create_map(F.lit("turn_direction"), F.col("_turn")))).otherwise(clean)
    ways = tables["ways"].select("id", "refs", clean.alias("tags"))
    return {"nodes": nodes, "ways": ways.unionByName(lights["ways"].withColumn("refs", F.col("refs").cast(ways.schema["refs"].dataType)).withColumn("id", F.col("id").cast(ways.schema["id"].dataType))), "relations": relations.select("id", members.alias("members"), turned.alias("tags"))}


def osm_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (part, ord, value) of OSM tables, for `documents.write_lines`."""
    tags = _xml(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.struct(t["key"].alias("k"), t["value"].alias("v"))))
    row = lambda t, part, head, body: tables[t].select(F.lit(part).alias("part"), F.col("id").cast("long").alias("ord"), F.concat(F.lit(f"<{t[:-1]} id="), quoted(F.col("id")), head, F.lit(">"), body, tags, F.lit(f"</{t[:-1]}>")).alias("value"))
    place = F.concat(F.lit(" lat="), quoted(F.format_string("%.10f", "lat")), F.lit(" lon="), quoted(F.format_string("%.10f", "lon")))
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("<nd ref="), quoted(r), F.lit("/>"))), "")
    members = F.array_join(F.transform("members", lambda m: F.concat(F.lit("<member type="), quoted(m["type"]), F.lit(" ref="), quoted(m["ref"]), F.lit(" role="), quoted(m["role"]), F.lit("/>"))), "")
    return row("nodes", 1, place, F.lit("")).unionByName(row("ways", 2, F.lit(""), refs)).unionByName(row("relations", 3, F.lit(""), F.coalesce(members, F.lit(""))))


def projector_yaml(lat0: float, lon0: float) -> str:
    """The projector of a map whose origin is known."""
    return f"projector_type: LocalCartesian\nvertical_datum: WGS84\nmap_origin:\n  latitude: {lat0:.10f}\n  longitude: {lon0:.10f}\n"
