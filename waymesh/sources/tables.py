"""Readers: trajectories, point files, OSM, restrictions, cameras and graph documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymesh.functions.geometry import lonlat_to_metres
from waymesh.plans.numbering import numbered

#: Road classes that cars use.
DRIVABLE = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
    "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service",
)
#: Kinds of turn restriction.
RESTRICTIONS = ("no_left_turn", "no_right_turn", "no_straight", "no_u_turn", "only_left", "only_right", "only_straight")

OVERPASS = """elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>,
  members:array<struct<type:string,ref:bigint,role:string>>>>"""
XY = "struct<x:double,y:double>"
GRAPH = f"""schema_version int, metadata map<string,string>, nodes array<struct<id:string,position:{XY},attributes:map<string,string>>>,
  edges array<struct<id:string,start_node_id:string,end_node_id:string,polyline:array<{XY}>,attributes:map<string,string>>>"""


def trajectories(spark: SparkSession, paths: str | list[str], with_z: bool = False, dtype: str = "double") -> DataFrame:
    """Rows (trace_id, ord, t, x, y[, z]) of CSV files with a header, in any case and column order.

    A file is a trace, ordered by time; equal times keep their place in the file. A
    missing column or a field that is no number is an error. dtype: double, or float
    for x and y.
    """
    if dtype not in ("double", "float"):
        raise ValueError("coordinates are double or float")
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(paths)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    wanted = ["timestamp", "x", "y", *(["z"] if with_z else [])]
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def number(c: str) -> Column:
        value = F.col(c).try_cast("double")
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit(f"{c} is no number: "), F.coalesce(F.col(c), F.lit("null")))).cast("double")).otherwise(value)

    rows = raw.select(F.col("_metadata.file_path").alias("trace_id"), F.monotonically_increasing_id().alias("row_id"), *(number(c).alias(c) for c in wanted))
    order = Window.partitionBy("trace_id").orderBy("timestamp", "row_id")
    xy = [F.col(c).cast(dtype).alias(c) for c in ("x", "y")]
    return rows.select("trace_id", F.row_number().over(order).cast("long").alias("ord"), F.col("timestamp").alias("t"), *xy, *(["z"] if with_z else []))


def points(spark: SparkSession, path: str, dims: int = 2) -> DataFrame:
    """Rows (x, y[, z[, intensity]]) of text separated by commas or white space.

    Comments (#) and blank lines are skipped, and so is a first line of names. Lines
    with fewer than `dims` numbers are an error; more columns than asked for are cut.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row"))
    parts = F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " ")
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select("row", "value", parts.alias("p"))
    first = rows.agg(F.min("row")).first()[0]
    heads = (F.col("row") == (-1 if first is None else first)) & F.col("p")[0].try_cast("double").isNull()
    names = ("x", "y", "z", "intensity")[:dims]
    bad = F.exists(F.slice("p", 1, dims), lambda v: v.try_cast("double").isNull()) | (F.size("p") < dims)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad point line: "), "value")).cast("array<string>")).otherwise(F.col("p"))
    return rows.where(~heads).select(checked.alias("p")).select(*(F.col("p")[k].try_cast("double").alias(n) for k, n in enumerate(names)))


def overpass(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes (id, lat, lon), ways (id, nodes, tags) and relations (id, tags, members) of an Overpass document."""
    rows = spark.read.option("multiLine", True).schema(OVERPASS).json(path).select(F.explode("elements").alias("e")).select("e.*")
    of = lambda kind, *columns: rows.where(F.col("type") == kind).select(*columns)
    return {"nodes": of("node", "id", "lat", "lon"), "ways": of("way", "id", "nodes", "tags"), "relations": of("relation", "id", "tags", "members")}


def highway_lines(elements: dict[str, DataFrame], lat0: float, lon0: float, classes: tuple[str, ...] = DRIVABLE) -> DataFrame:
    """Rows (way_id, tags, polyline) of ways of these classes in metres; unknown nodes are skipped, lines need two points."""
    ways = elements["ways"].where(F.element_at("tags", F.lit("highway")).isin(*classes)).select(F.col("id").alias("way_id"), "tags", F.posexplode("nodes").alias("pos", "node"))
    x, y = lonlat_to_metres(F.col("lon"), F.col("lat"), lat0, lon0)
    placed = ways.join(elements["nodes"].dropDuplicates(["id"]), F.col("node") == F.col("id")).select("way_id", "tags", "pos", x.alias("x"), y.alias("y"))
    tags = placed.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("polyline"))
    return elements["ways"].select(F.col("id").alias("way_id"), "tags").join(tags.where(F.size("polyline") >= 2), "way_id")


def turn_restrictions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, pos, junction_node_id, from_edge_id, from_direction, to_edge_id, to_direction, restriction, source, confidence).

    The document is an object with turn_restrictions or a bare list. Missing ids are
    numbered; a row without a required field, of an unknown kind or with a confidence
    outside 0 to 1 is an error.
    """
    fields = "id:string,junction_node_id:string,from_edge_id:string,from_direction:string,to_edge_id:string,to_direction:string,restriction:string,source:string,confidence:double"
    text = spark.read.text(path, wholetext=True)
    bare = F.trim("value").startswith("[")
    rows = F.when(bare, F.from_json("value", f"array<struct<{fields}>>")).otherwise(F.from_json("value", f"struct<turn_restrictions:array<struct<{fields}>>>")["turn_restrictions"])
    out = text.select(F.posexplode(rows).alias("pos", "r")).where("r is not null").select("pos", "r.*")
    out = out.withColumn("id", F.coalesce("id", F.format_string("tr_manual_%04d", "pos")))
    for c in ("from_direction", "to_direction"):
        out = out.withColumn(c, F.coalesce(c, F.lit("forward")))
    valid = F.col("restriction").isin(*RESTRICTIONS) & F.col("from_direction").isin("forward", "reverse") & F.col("to_direction").isin("forward", "reverse") & F.coalesce(F.col("confidence").between(0, 1), F.lit(True))
    for c in ("junction_node_id", "from_edge_id", "to_edge_id"):
        valid = valid & F.col(c).isNotNull()
    return out.withColumn("restriction", F.when(F.coalesce(valid, F.lit(False)), F.col("restriction")).otherwise(F.raise_error(F.concat(F.lit("bad turn restriction "), "id")).cast("string")))


def camera_observations(spark: SparkSession, path: str) -> DataFrame:
    """Rows (pos, edge_id, kind, value_kmh, confidence, extra) of a document's observations; extra keeps the whole item."""
    text = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "struct<observations:array<string>>")["observations"]
    rows = text.select(F.posexplode(items).alias("pos", "item"))
    known = F.from_json("item", "struct<edge_id:string,kind:string,value_kmh:double,confidence:double>")
    return rows.select("pos", known.alias("k"), F.parse_json("item").alias("extra")).select("pos", "k.*", "extra")


def graph_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes (id, ord, x, y, attributes) and edges (edge_id, ord, ends, polyline, attributes) of a graph document."""
    doc = spark.read.option("multiLine", True).schema(GRAPH).json(path)
    version = F.when(F.coalesce("schema_version", F.lit(1)) == 1, 1).otherwise(F.raise_error(F.lit("schema_version must be 1")).cast("int"))
    doc = doc.withColumn("schema_version", version).where("schema_version = 1")
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.id", F.col("ord").cast("long"), "n.position.x", "n.position.y", "n.attributes")
    edges = doc.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.id").alias("edge_id"), F.col("ord").cast("long"), "e.start_node_id", "e.end_node_id", "e.polyline", "e.attributes")
    return {"nodes": nodes, "edges": edges}


def gpx(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows (ord, t, lat, lon) of a GPX file's track points in time order; `limit` keeps the first of them."""
    points = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, time timestamp").load(path)
    rows = points.where("time is not null").select(F.col("time").cast("double").alias("t"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    out = numbered(rows, "t", "lat", "lon", name="ord").withColumn("ord", (F.col("ord") + 1).cast("long"))
    return out if limit is None else out.where(F.col("ord") <= limit)


def origin(spark: SparkSession, path: str) -> tuple[float, float]:
    """lat0 and lon0 of a JSON object; an error if either is missing."""
    row = spark.read.option("multiLine", True).schema("lat0 double, lon0 double").json(path).first()
    if row is None or row["lat0"] is None or row["lon0"] is None:
        raise KeyError(f"an origin needs lat0 and lon0: {path}")
    return row["lat0"], row["lon0"]


def fusion_points(spark: SparkSession, path: str, with_z: bool = False) -> DataFrame:
    """Rows (key, x, y[, z]) of a LAS file or of text, as boundaries are fused from."""
    names = ["x", "y", "z"][: 3 if with_z else 2]
    if path.lower().endswith(".laz"):
        raise ValueError(f"compressed points are not read, only LAS: {path}")
    if path.lower().endswith(".las"):
        from waymesh.sources.las import LasDataSource

        spark.dataSource.register(LasDataSource)
        found = spark.read.format("las").load(path)
    else:
        found = points(spark, path, len(names))
    return found.select(F.monotonically_increasing_id().alias("key"), *names)


def public(df: DataFrame) -> DataFrame:
    """Without columns whose names begin with an underscore."""
    return df.select(*(c for c in df.columns if not c.startswith("_")))
