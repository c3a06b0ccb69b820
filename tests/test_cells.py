"""Searches cell by cell: the same costs as those of a search in rounds, whatever the cells, and no search in rounds beside them."""

import numpy as np
import pytest

from waymesh.operators import cells, routing


def town(spark, n, seed):
    """A grid with gaps, bends, one-way roads, a loop without length, a node without a road and turn rules."""
    rng = np.random.default_rng(seed)
    at = {f"g{a}_{b}": (100.0 * a + int(rng.integers(-20, 20)), 100.0 * b - 300.0) for a in range(n) for b in range(n)} | {"alone": (-5000.0, 0.0)}
    lines = [("loop", "g1_1", "g1_1", None)]
    for a in range(n):
        for b in range(n):
            for c, d in ((a + 1, b), (a, b + 1)):
                if c < n and d < n and rng.random() < 0.85:
                    lines.append((f"e{len(lines)}", f"g{a}_{b}", f"g{c}_{d}", rng.choice(["yes", "-1", None, None])))
    rows = []
    for e, u, v, w in lines:
        (x0, y0), (x1, y1) = at[u], at[v]
        middle = [{"x": (x0 + x1) / 2 + 30.0, "y": (y0 + y1) / 2}] if rng.random() < 0.3 and u != v else []
        rows.append((e, u, v, [{"x": x0, "y": y0}, *middle, {"x": x1, "y": y1}], w if w is None else str(w)))
    edges = spark.createDataFrame(rows, "edge_id string, start_node_id string, end_node_id string, polyline array<struct<x:double,y:double>>, osm_oneway string")
    rules = []
    for e, _, v, _ in lines:
        after = [f for f, u, _, _ in lines if u == v and f != e]
        if after and rng.random() < 0.6:
            rules.append((v, e, "forward", after[0], rng.choice(["forward", "forward", "reverse", "sideways"]), rng.choice(["no_left_turn", "only_straight_on", "give_way"])))
    rules = spark.createDataFrame([tuple(map(str, r)) for r in rules], "junction_node_id string, from_edge_id string, from_direction string, to_edge_id string, to_direction string, restriction string")
    nodes = spark.createDataFrame([(k, *p) for k, p in at.items()], "id string, x double, y double")
    return nodes, edges, rules, nodes.selectExpr("id as origin")


def costs(rows):
    return {(r["origin"], r["node"]): round(r["cost"], 6) for r in rows.collect()}


@pytest.mark.parametrize("limits", [(2048, 1 << 18, 1 << 24, 1 << 21), (8, 150, 200, 100)])
def test_areas_by_cells_are_those_of_rounds(spark, monkeypatch, limits):
    for name, value in zip(("NODES", "ROWS", "GROUP", "AT_ONCE"), limits, strict=True):
        monkeypatch.setattr(cells, name, value)
    nodes, edges, rules, origins = town(spark, 9, 3)
    starts = origins.selectExpr("origin", "origin as state", "0.0D as cost")
    want = costs(routing.cheapest(routing.adjacency(edges, respect_oneway=True), starts, 260.0).withColumnRenamed("state", "node"))
    turns = costs(routing.restricted_costs(edges, rules, origins, 230.0))
    monkeypatch.setattr(routing, "search", None)  # rounds shuffle all that is found
    assert costs(routing.service_areas(edges, origins, nodes, 260.0, respect_oneway=True)) == want
    assert costs(routing.restricted_costs(edges, rules, origins, 230.0, nodes=nodes)) == turns
    assert want["alone", "alone"] == turns["alone", "alone"] == 0.0 and len(turns) > 300 and turns != costs(routing.restricted_costs(edges, rules.limit(0), origins, 230.0, nodes=nodes))


def test_areas_that_no_distance_bounds_are_searched_in_rounds(spark, monkeypatch):
    nodes, edges, _, origins = town(spark, 3, 1)
    want = costs(routing.service_areas(edges, origins, nodes, 200.0))
    assert costs(routing.service_areas(edges, origins, nodes.where("id <> 'g1_1'"), 200.0)) == want
    monkeypatch.setattr(cells, "ROWS", 2)
    assert costs(routing.service_areas(edges, origins, nodes, 200.0)) == want


def test_segments_are_spread_over_cells_without_comparing_cells(spark):
    """Cells of overlapping steps were made distinct as structs, in time that grows with their square."""
    from pyspark.sql import functions as F

    from waymesh.operators.spatial import spread

    rng = np.random.default_rng(4)
    rows = [(k, *map(float, (*a, *(a + rng.normal(0, size, 2) * flat)))) for k, (size, flat) in enumerate([(s, f) for s in (0, 1e-9, 6, 90) for f in ((1, 1), (0, 1), (1, 0))] * 3) for a in [rng.uniform(-200, 200, 2)]]
    wide = spread(spark.createDataFrame(rows, "k int, ax double, ay double, bx double, by double"), *(F.col(c) for c in ("ax", "ay", "bx", "by")), 4.0, 8.0)
    assert "array_distinct" not in wide._jdf.queryExecution().optimizedPlan().toString()
    found = [(r["k"], (r["cx"], r["cy"])) for r in wide.collect()]
    assert len(found) == len(set(found))
    for k, ax, ay, bx, by in rows:
        t, turn = np.linspace(0, 1, 200)[:, None], np.linspace(0, 2 * np.pi, 16)
        near = np.floor((ax + t * (bx - ax) + 3.999 * np.cos(turn)) / 8), np.floor((ay + t * (by - ay) + 3.999 * np.sin(turn)) / 8)
        need = set(zip(*(v.astype(int).ravel().tolist() for v in near), strict=True))
        assert need <= {c for j, c in found if j == k}


def test_center_lines_are_the_same_for_short_and_long_groups(spark):
    """A few samples are smoothed as a row; spread over all points they were many times as many rows, sorted twice."""
    from waymesh.operators import lanes

    rng = np.random.default_rng(6)
    rows = [(f"t{t}", k, float(x), float(y)) for t, (n, step) in enumerate([(2, 5), (9, 10), (40, 3), (7, 0), (30, 200), (1, 1)]) for k, (x, y) in enumerate(np.cumsum(rng.normal(0, step, (n, 2)), 0))]
    samples = spark.createDataFrame(rows, "trace_id string, ord long, x double, y double")
    want = {(r["trace_id"], r["k"]): (round(r["x"], 9), round(r["y"], 9)) for r in lanes.centerlines(samples, ["trace_id"], 8).collect()}
    for short in (1024, 8):
        lines = lanes.center_lines(samples, ["trace_id"], 8, short)
        assert {(r["trace_id"], k): (round(p["x"], 9), round(p["y"], 9)) for r in lines.collect() for k, p in enumerate(r["polyline"])} == want


def test_crossings_of_crowded_cells_are_those_of_the_join(spark, monkeypatch):
    """Pairs of a crowded cell were joined row by row; parts, quarters and borders of cells count as before."""
    from waymesh.operators import spatial

    rng = np.random.default_rng(2)
    at = np.vstack([rng.uniform(0, 120, (150, 4)), [[0, 50, 120, 50], [50, 0, 50, 120], [20, 20, 80, 80]]]).tolist()
    rows = [(k, f"e{k}", [{"x": a, "y": b}, {"x": c, "y": d}]) for k, (a, b, c, d) in enumerate(at)]
    edges = spark.createDataFrame(rows, "ord long, edge_id string, polyline array<struct<x:double,y:double>>")
    found = {}
    for dense in (0, 10**9):
        monkeypatch.setattr(spatial, "DENSE", dense)
        for capacity in (2048, 16):
            df = spatial.segment_crossings(edges, 50.0, capacity)
            found[dense, capacity] = sorted(map(tuple, df.collect()))
    assert len(found[0, 16]) > 1000 and all(v == found[0, 16] for v in found.values())
