"""Readers on written files, LAS bytes, and streams against their batch results."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from waymesh.operators import spatial
from waymesh.sources import documents, las, tables
from waymesh.streaming import live


def test_trajectories(spark, tmp_path):
    (tmp_path / "a.csv").write_text("X,Timestamp,y\n2,20,1\n1,10,1\n3,20,5\n")
    (tmp_path / "b.csv").write_text("x,timestamp,y\n9,5,9\n")
    got = [(r["trace_id"][-5:], r["ord"], r["t"], r["x"]) for r in tables.trajectories(spark, f"{tmp_path}/a.csv").orderBy("ord").collect()]
    assert got == [("a.csv", 1, 10.0, 1.0), ("a.csv", 2, 20.0, 2.0), ("a.csv", 3, 20.0, 3.0)]
    (tmp_path / "bad.csv").write_text("x,timestamp,y\n1,one,2\n")
    with pytest.raises(Exception, match="no number"):
        tables.trajectories(spark, f"{tmp_path}/bad.csv").collect()
    with pytest.raises(ValueError, match="missing columns: z"):
        tables.trajectories(spark, f"{tmp_path}/b.csv", with_z=True)


def test_point_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# made by hand\nx y z\n1,2,3\n\n 4  5 6 7\n")
    assert [tuple(r) for r in tables.points(spark, f"{tmp_path}/p.txt").collect()] == [(1.0, 2.0), (4.0, 5.0)]
    assert [tuple(r) for r in tables.points(spark, f"{tmp_path}/p.txt", 3).collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    (tmp_path / "q.txt").write_text("1 2\nx y\n")
    with pytest.raises(Exception, match="bad point line"):
        tables.points(spark, f"{tmp_path}/q.txt").collect()


def las_bytes(points, kind=1, version=(1, 2), length=28):
    head = bytearray(375 if version >= (1, 4) else 227)
    head[:4] = b"LASF"
    head[24:26] = bytes(version)
    struct.pack_into("<HI", head, 94, len(head), len(head))
    head[104] = kind
    struct.pack_into("<HI", head, 105, length, 0 if version >= (1, 4) else len(points))
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    if version >= (1, 4):
        struct.pack_into("<Q", head, 247, len(points))
    body = b"".join(struct.pack("<iiiH", *p).ljust(length, b"\0") for p in points)
    return bytes(head) + body


@pytest.mark.parametrize(("version", "kind", "length"), [((1, 2), 1, 28), ((1, 4), 6, 30)])
def test_las(spark, tmp_path, version, kind, length):
    spark.dataSource.register(las.LasDataSource)
    (tmp_path / "c.las").write_bytes(las_bytes([(100, 200, 300, 7), (-100, 0, 5, 65535)], kind, version, length))
    rows = spark.read.format("las").load(f"{tmp_path}/c.las").collect()
    assert [tuple(r) for r in rows] == [(101.0, 202.0, 3.0, 7.0), (99.0, 200.0, 0.05, 65535.0)]
    assert spark.read.format("las").schema("z double, x double").load(f"{tmp_path}/c.las").columns == ["z", "x"]
    assert sorted(tuple(r)[1:] for r in tables.fusion_points(spark, f"{tmp_path}/c.las").collect()) == [(99.0, 200.0), (101.0, 202.0)]


def test_las_errors():
    good = las_bytes([(0, 0, 0, 0)])
    with pytest.raises(ValueError, match="not a LAS"):
        las.parse_header(b"nope" + good[4:])
    zipped = bytearray(good)
    zipped[104] |= 0x80
    with pytest.raises(ValueError, match="LAZ"):
        las.parse_header(bytes(zipped))


def test_osm_and_restrictions(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": k, "lat": 52.0 + k / 1000, "lon": 13.0} for k in range(3)]
           + [{"type": "way", "id": 7, "nodes": [0, 1, 99, 2], "tags": {"highway": "residential"}}, {"type": "way", "id": 8, "nodes": [0, 99], "tags": {"highway": "residential"}}, {"type": "way", "id": 9, "nodes": [0, 1], "tags": {"highway": "footway"}}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    lines = tables.highway_lines(tables.overpass(spark, f"{tmp_path}/o.json"), 52.0, 13.0).collect()
    assert [(r["way_id"], len(r["polyline"])) for r in lines] == [(7, 3)] and abs(lines[0]["polyline"][2]["y"] - 222.39) < 0.01
    rule = {"junction_node_id": "n1", "from_edge_id": "e1", "to_edge_id": "e2", "restriction": "no_left_turn"}
    for name, content in (("bare", [rule]), ("whole", {"turn_restrictions": [rule]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
        got = tables.turn_restrictions(spark, f"{tmp_path}/{name}.json").collect()
        assert [(r["id"], r["from_direction"], r["restriction"]) for r in got] == [("tr_manual_0000", "forward", "no_left_turn")]
    (tmp_path / "bad.json").write_text(json.dumps([rule | {"confidence": 2}]))
    with pytest.raises(Exception, match="bad turn restriction"):
        tables.turn_restrictions(spark, f"{tmp_path}/bad.json").collect()


def test_graph_document_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 1, 5.0, 0.0)], "id string, ord long, x double, y double")
    edges = spark.createDataFrame([(0, "e0", "a", "b", [(0.0, 0.0), (5.0, 0.0)])], "ord long, edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>")
    documents.write_lines(documents.graph_json(nodes, edges.withColumn("lanes", F.lit("2"))), f"{tmp_path}/g")
    (tmp_path / "g.json").write_text("".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*.txt"))))
    back = tables.graph_document(spark, f"{tmp_path}/g.json")
    assert back["edges"].first()["attributes"] == {"lanes": "2"}
    assert [tuple(r)[:4] for r in back["nodes"].collect()] == [tuple(r) for r in nodes.collect()]
    assert back["edges"].first()["polyline"] == edges.first()["polyline"]


@pytest.fixture
def arriving(spark, tmp_path):
    rows = [("a", k, 1_700_000_000.0 + 10 * k + (4000 if k > 5 else 0), 10.0 * k, 1.0) for k in range(12)] + [("b", k, 1_700_000_000.0 + 5 * k, 3.0 * k, 50.0) for k in range(4)]
    df = spark.createDataFrame(rows, live.SAMPLES)
    df.where("ord < 6").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.where("ord >= 6").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df, f"{tmp_path}/in"


def drain(stream, name, mode, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)


def test_live_trips(spark, arriving, tmp_path):
    _, folder = arriving
    drain(live.live_trips(live.read_samples(spark, folder)), "trips", "append", tmp_path)
    got = {(r["trace_id"], r["samples"], r["distance"]) for r in spark.table("trips").collect()}
    assert ("a", 6, 50.0) in got


def test_stream_observations_are_those_of_the_batch(spark, arriving, tmp_path):
    df, folder = arriving
    edges = spark.createDataFrame([(0, "e0", "a", "b", [(0.0, 0.0), (200.0, 0.0)])], "ord long, edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>")
    drain(live.edge_observations(live.read_samples(spark, folder), edges, delay="0 seconds"), "seen", "append", tmp_path)
    streamed = {(r["edge_id"], str(r["start"])): r["samples"] for r in spark.table("seen").collect()}
    hour = F.window(F.timestamp_seconds("t"), "1 hour")["start"]
    batch = spatial.snap(df, edges).where("edge_id is not null").groupBy("edge_id", hour.alias("start")).count().collect()
    assert streamed and streamed.items() <= {(r["edge_id"], str(r["start"])): r["count"] for r in batch}.items()


def test_versions_follow_batches(spark, arriving, tmp_path):
    df, folder = arriving

    def update(session, batch, before):
        counts = batch.groupBy("trace_id").count()
        if before:
            counts = counts.unionByName(session.read.parquet(before)).groupBy("trace_id").agg(F.sum("count").alias("count"))
        return counts

    stream = spark.readStream.schema(live.SAMPLES).option("maxFilesPerTrigger", 1).parquet(folder)
    live.store_versions(stream, f"{tmp_path}/versions", f"{tmp_path}/checkpoint", update).awaitTermination(120)
    last = max((tmp_path / "versions").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert {r["trace_id"]: r["count"] for r in spark.read.parquet(str(last)).collect()} == {r["trace_id"]: r["count"] for r in df.groupBy("trace_id").count().collect()}


def test_osm_restrictions_find_their_edges(spark, tmp_path):
    from waymesh.operators.restrictions import convert_restrictions

    step = 0.001
    doc = {"elements": [{"type": "node", "id": i, "lat": 52.0 + a * step, "lon": 13.0 + b * step} for i, (a, b) in enumerate([(0, 0), (-1, 0), (0, 1), (1, 0)])]
           + [{"type": "way", "id": 10, "nodes": [1, 0]}, {"type": "way", "id": 11, "nodes": [0, 2]}, {"type": "way", "id": 12, "nodes": [0, 3]}]
           + [{"type": "relation", "id": 20, "tags": {"type": "restriction", "restriction": "no_right_turn"}, "members": [{"type": "way", "ref": 10, "role": "from"}, {"type": "node", "ref": 0, "role": "via"}, {"type": "way", "ref": 11, "role": "to"}]},
              {"type": "relation", "id": 21, "tags": {"type": "restriction", "restriction": "no_left_turn"}, "members": [{"type": "way", "ref": 10, "role": "from"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    nodes = spark.createDataFrame([("j", 0, 0.0, 0.0), ("s", 1, 0.0, -110.0), ("e", 2, 68.0, 0.0), ("n", 3, 0.0, 111.0)], "id string, ord long, x double, y double")
    edges = spark.createDataFrame([(0, "js", "j", "s", [(0.0, 0.0), (0.0, -110.0)]), (1, "ej", "e", "j", [(68.0, 0.0), (0.0, 0.0)]), (2, "jn", "j", "n", [(0.0, 0.0), (0.0, 111.0)])], "ord long, edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>")
    got = {r["relation_id"]: r for r in convert_restrictions(tables.overpass(spark, f"{tmp_path}/r.json"), nodes, edges, 52.0, 13.0).collect()}
    assert tuple(got[20])[1:] == ("no_right_turn", "j", "js", "reverse", "ej", "reverse", None)
    assert got[21]["skipped"] == "members_missing"


def test_elevations_and_slopes(spark):
    from waymesh.operators.restrictions import elevate

    nodes = spark.createDataFrame([("a", 0, 0.0, 0.0), ("b", 1, 100.0, 0.0)], "id string, ord long, x double, y double")
    edges = spark.createDataFrame([(0, "e", "a", "b", [(0.0, 0.0), (100.0, 0.0)])], "ord long, edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>")
    samples = spark.createDataFrame([("t", 0, 1.0, 1.0, 10.0), ("t", 1, 99.0, 0.0, 110.0), ("t", 2, 500.0, 500.0, 0.0)], "trace_id string, ord long, x double, y double, z double")
    high, rise = elevate(nodes, edges, samples)
    assert {r["id"]: r["elevation_m"] for r in high.collect()} == {"a": 10.0, "b": 110.0} and abs(rise.first()["slope_deg"] - 45.0) < 1e-9


def test_validation_names_what_is_broken(spark):
    from waymesh.sources import validation

    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, float("nan"))], "id string, x double, y double")
    edges = spark.createDataFrame([("e", "a", "zz", [(0.0, 0.0)])], "edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>")
    got = {tuple(r) for r in validation.check_graph(nodes, edges).collect()}
    assert got == {("a", "y"), ("a", "id_unique"), ("e", "polyline"), ("e", "end_node_id_known")}
    rules = spark.createDataFrame([("r", "j", "e", "forward", "f", "back", "no_turn", 2.0)], "id string, junction_node_id string, from_edge_id string, from_direction string, to_edge_id string, to_direction string, restriction string, confidence double")
    assert {r["rule"] for r in validation.check_restrictions(rules).collect()} == {"to_direction", "restriction", "confidence"}


def test_origins_and_points_to_fuse(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"lat0": 52.5, "lon0": 13.4, "name": "x"}')
    (tmp_path / "bad.json").write_text('{"lat0": 52.5}')
    assert tables.origin(spark, f"{tmp_path}/o.json") == (52.5, 13.4)
    with pytest.raises(KeyError):
        tables.origin(spark, f"{tmp_path}/bad.json")
    (tmp_path / "p.xyz").write_text("1 2 3\n4 5 6\n")
    got = tables.fusion_points(spark, f"{tmp_path}/p.xyz", with_z=True)
    assert got.columns == ["key", "x", "y", "z"] and sorted(r["z"] for r in got.collect()) == [3.0, 6.0]
    assert tables.public(got.withColumn("_own", F.lit(1))).columns == got.columns


def test_compressed_points_are_refused(spark):
    with pytest.raises(ValueError, match="only LAS"):
        tables.fusion_points(spark, "points.LAZ")
