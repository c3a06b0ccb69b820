"""Routes by tiles: the same as those of a search in rounds, whatever the tiles, and over parts that a pair needs only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymesh.operators import routing, tiles


def town(spark, n, seed):
    """A grid of whole metres with gaps, bends, one-way and free roads, ties, and a part of its own."""
    rng = np.random.default_rng(seed)
    nodes = [(f"g{a}_{b}", 100.0 * a, 100.0 * b) for a in range(n) for b in range(n)] + [("far", 9000.0, 0.0), ("far2", 9100.0, 0.0)]
    at = {k: (x, y) for k, x, y in nodes}
    lines = [("x", "far", "far2", None, 2), ("loop", "g1_1", "g1_1", None, 1)]
    for a in range(n):
        for b in range(n):
            for c, d in ((a + 1, b), (a, b + 1)):
                if c < n and d < n and rng.random() < 0.85:
                    lines.append((f"e{len(lines)}", f"g{a}_{b}", f"g{c}_{d}", rng.choice(["yes", "-1", None, None, None]), int(rng.integers(1, 4))))
    point = lambda k: {"x": at[k][0], "y": at[k][1]}
    rows = [(k, e, u, v, [point(u), point(v)], w if w is None else str(w), m) for k, (e, u, v, w, m) in enumerate(lines)]
    edges = spark.createDataFrame(rows, "ord long, edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>, osm_oneway string, lane_count int")
    names = list(at)
    pairs = [(names[i], names[j]) for i, j in rng.integers(0, len(names), (40, 2)).tolist()] + [("g0_0", f"g{n - 1}_{n - 1}"), ("far", "far2"), ("g2_2", "far"), ("g3_3", "g3_3")]
    return spark.createDataFrame(nodes, "id string, x double, y double"), edges, spark.createDataFrame(pairs, "from_node string, to_node string")


def ways(rows):
    return sorted((r["from_node"], r["to_node"], r["cost"], tuple(r["edges"])) for r in rows.collect())


@pytest.mark.parametrize("size", [40])
def test_routes_by_tiles_are_those_of_rounds(spark, monkeypatch, size):
    nodes, edges, pairs = town(spark, 7, 6)
    monkeypatch.setattr(routing, "FEW_STATES", 0)
    real = tiles.tile_routes
    monkeypatch.setattr(routing, "tile_routes", lambda *a: real(*a, size=size))
    adj = routing.adjacency(edges, respect_oneway=True)
    assert ways(routing.paths(adj, pairs, nodes)) == ways(routing.paths(adj, pairs))


def test_lane_routes_by_tiles_settle_no_table_of_moves(spark, monkeypatch):
    """Lanes by small tiles, and no moves are doubled over the whole network beforehand."""
    nodes, edges, pairs = town(spark, 5, 3)
    want = ways(routing.lane_paths(edges, edges.select("edge_id", "lane_count"), pairs))
    monkeypatch.setattr(routing, "FEW_STATES", 0)
    real = tiles.tile_routes
    monkeypatch.setattr(routing, "tile_routes", lambda *a: real(*a, size=40))
    monkeypatch.setattr(routing, "search", None)  # a search in rounds doubles moves
    assert ways(routing.lane_paths(edges, edges.select("edge_id", "lane_count"), pairs, nodes=nodes)) == want


def test_parts_without_a_pair_are_left_alone(spark):
    nodes, edges, _ = town(spark, 4, 5)
    pairs = spark.createDataFrame([("far", "far2"), ("g0_0", "far")], "from_node string, to_node string")
    joined, near = routing._connected(pairs, nodes, routing._links(edges))
    assert [tuple(r) for r in joined.collect()] == [("far", "far2")]
    assert sorted(r["id"] for r in near.select(F.col("id")).collect()) == ["far", "far2"]


def test_estimates_of_size_stay_short_in_a_fixpoint(spark):
    """Each join of a checkpoint with itself doubled the digits of its estimated size, which filled the driver."""
    from waymesh.session import LONGEST_ESTIMATE, materialize

    df = spark.range(50).withColumn("x", F.col("id") % 7)
    for _ in range(12):
        df = materialize(df.join(df.select("id"), "id"))
        assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= LONGEST_ESTIMATE
    assert sorted(map(tuple, df.collect())) == [(k, k % 7) for k in range(50)]


def test_moves_between_lanes_are_made_of_parts_with_a_pair_alone(spark, monkeypatch):
    """Lanes make some fifteen moves of an edge, which were made of the whole network before most of them were dropped."""
    nodes, edges, _ = town(spark, 4, 5)
    pairs = spark.createDataFrame([("far", "far2"), ("g0_0", "far")], "from_node string, to_node string")
    seen, real = [], routing._laned
    monkeypatch.setattr(routing, "_laned", lambda e, *a: seen.append({r["edge_id"] for r in e.collect()}) or real(e, *a))
    lanes = edges.select("edge_id", "lane_count")
    got = ways(routing.lane_paths(edges, lanes, pairs, nodes=nodes))
    assert seen == [{r["edge_id"] for r in edges.where("start_node_id in ('far', 'far2')").collect()}]
    assert got == ways(routing.lane_paths(edges, lanes, pairs)) and len(got) == 1
