import json

import pytest
from pyspark.sql import functions as F

from waymesh.operators import guidance, hd, topology
from waymesh.sources import documents

POLY = "array<struct<x:double,y:double>>"


def read(rows):
    return json.loads("".join(r["value"] for r in rows.orderBy("part", "ord").collect()))


@pytest.fixture(scope="module")
def bend(spark):
    """Two edges that meet at b in a right angle; columns beyond the known ones clash with names of properties."""
    nodes = spark.createDataFrame([("a", 0, 0.0, 0.0, 1, "x"), ("b", 1, 100.0, 0.0, 2, "x"), ("c", 2, 100.0, 100.0, 1, None)], "id string, ord long, x double, y double, degree int, kind string")
    rows = [(0, "ab", "a", "b", [(0.0, 0.0), (100.0, 0.0)], "Main", 7.0), (1, "bc", "b", "c", [(100.0, 0.0), (100.0, 100.0)], None, 7.0), (2, "dot", "c", "c", [(100.0, 100.0)], None, 7.0)]
    return nodes, spark.createDataFrame(rows, f"ord long, edge_id string, start_node_id string, end_node_id string, polyline {POLY}, osm_name string, length_m double")


def test_items_that_tie_are_parted_by_commas(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "d")], "pos long, v string")
    got = read(documents.document({"rows": (rows, "pos"), "none": (rows.limit(0), "pos"), "kept": (rows, ("pos", "v"))}, {"name": "é"}))
    assert got["name"] == "é" and got["none"] == []
    assert sorted(r.get("v", "") for r in got["rows"]) == ["", "a", "b", "d"] and got["rows"][3] == {"v": "d"}
    assert got["kept"] == [{"pos": 1}, {"pos": 1, "v": "a"}, {"pos": 1, "v": "b"}, {"pos": 2, "v": "d"}]


def test_maps_say_where_their_data_come_from_and_what_edges_have(spark, bend):
    nodes, edges = bend
    n, e = hd.enrich(nodes, edges, 3.5)
    told = [json.dumps(r) for r in ({"kind": "speed_limit", "value_kmh": 50.9}, {"kind": "stop_line"}, {"source": "x"}, {"kind": "speed_limit", "value_kmh": "fast"}, {"kind": "speed_limit"}, {"kind": ""})]
    new = F.when(F.col("edge_id") == "ab", F.array(*map(F.lit, told))).otherwise(F.col("hd.semantic_rules"))
    e = e.withColumn("hd", F.struct(*((new if c == "semantic_rules" else F.col(f"hd.{c}")).alias(c) for c in e.schema["hd"].dataType.names)))
    samples = spark.createDataFrame([("t", 0, 0.0, 0.0), ("t", 1, 5.0, 0.0), ("one", 0, 1.0, 1.0)], "trace_id string, ord long, x double, y double")
    features = documents.map_features(n, e, samples, 52.0, 13.0, "d")
    got = read(documents.feature_collection(features, "layer", "ord", head=documents.map_head("d", 52.0, 13.0, documents.OSM_SOURCE)))
    assert got["name"] == "d" and got["properties"]["attribution"] == "© OpenStreetMap contributors" and got["properties"]["license"] == "ODbL-1.0"
    assert (got["properties"]["origin_lat"], got["properties"]["origin_lon"]) == (52.0, 13.0)
    assert "attribution" not in documents.map_head("d", 52.0, 13.0)["properties"]
    by = {}
    for f in got["features"]:
        by.setdefault(f["properties"]["kind"], []).append(f["properties"])
    assert {k: len(v) for k, v in by.items()} == {"node": 3, "centerline": 2, "trajectory": 1, "lane_boundary_left": 2, "lane_boundary_right": 2}
    ab, bc = by["centerline"]
    assert ab["semantic_summary"] == "speed_limit 50 km/h; stop_line; speed_limit; speed_limit" and "semantic_summary" not in bc
    assert ab["osm_name"] == "Main" and ab["length_m"] == 100.0 and ab["dataset"] == "d"
    assert [p["degree"] for p in by["node"]] == [1, 2, 1] and by["lane_boundary_left"][0]["side"] == "left"


def test_matches_and_restrictions_carry_their_heads(spark):
    matches = spark.createDataFrame([("t", 0, "e", 1.0), ("t", 1, None, None), ("t", 2, "e", 3.0)], "trace_id string, ord long, edge_id string, d double")
    got = read(documents.matches_json(matches, "nearest_edge"))
    assert got["stats"] == {"samples": 3, "matched": 2, "matched_ratio": 2 / 3, "edges_touched": 1, "mean_distance_m": 2.0, "max_distance_m": 3.0, "algorithm": "nearest_edge"}
    assert got["matches"][1] == {"trace_id": "t", "ord": 1, "unmatched": True} and "unmatched" not in got["matches"][0]
    assert read(documents.matches_json(matches.limit(0)))["stats"]["matched_ratio"] == 0.0
    rules = spark.createDataFrame([("r1", "no_left_turn")], "id string, restriction string")
    got = read(documents.restrictions_json(rules))
    assert got["license_url"].startswith("https://opendatacommons.org") and got["turn_restrictions"] == [{"id": "r1", "restriction": "no_left_turn"}]
    assert set(read(documents.restrictions_json(rules, None))) == {"format_version", "turn_restrictions"}


def test_steps_say_what_is_allowed(spark, bend):
    _, edges = bend
    edges = edges.where("edge_id <> 'dot'")
    routes = spark.createDataFrame([("a", "c", ["ab/forward", "bc/forward"])], "from_node string, to_node string, edges array<string>")
    nav = topology.sd_nav_edges(edges).where("edge_id = 'ab'")
    got = guidance.guidance(routes, edges, nav).orderBy("k").collect()
    assert [(r["text"], r["sd_nav_maneuvers"]) for r in got] == [("Depart on ab", ["straight", "left"]), ("Arrive at destination on bc", [])]
    words = spark.createDataFrame([("sharp_left",), ("u_turn",), ("else",)], "m string").select(guidance.describe(F.col("m"), F.lit("e1"))).collect()
    assert [r[0] for r in words] == ["Sharp left onto e1", "Make a U-turn onto e1", "Proceed on e1"]
