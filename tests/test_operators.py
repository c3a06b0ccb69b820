"""Road operators on small networks and traces with known answers."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from waymesh import queries
from waymesh.functions import geometry
from waymesh.operators import camera, guidance, incremental, lanes, matching, routing, spatial, topology, traces
from waymesh.plans.components import connected_components
from waymesh.session import shuffle_partitions
from waymesh.sources import documents

POLY = "array<struct<x:double,y:double>>"


def make_edges(spark, lines):
    """Edges of (id, start, end, points)."""
    return spark.createDataFrame([(k, i, a, b, p) for k, (i, a, b, p) in enumerate(lines)], f"ord long, edge_id string, start_node_id string, end_node_id string, polyline {POLY}")


def make_nodes(spark, points):
    return spark.createDataFrame([(i, k, float(x), float(y)) for k, (i, (x, y)) in enumerate(points.items())], "id string, ord long, x double, y double")


def make_samples(spark, rows):
    return spark.createDataFrame([(str(t), k, float(s), float(x), float(y)) for t, k, s, x, y in rows], "trace_id string, ord long, t double, x double, y double")


@pytest.fixture(scope="module")
def cross(spark):
    """Four arms around c, and a bent road that ends at the east one."""
    at = {"c": (0, 0), "e": (100, 0), "n": (0, 100), "w": (-100, 0), "s": (0, -100), "f": (150, 80)}
    lines = [(f"c{k}", "c", k, [at["c"], at[k]]) for k in "enws"] + [("ef", "e", "f", [at["e"], (150, 0), at["f"]])]
    lines = [(i, a, b, [(float(x), float(y)) for x, y in p]) for i, a, b, p in lines]
    return make_nodes(spark, at), make_edges(spark, lines)


def brute_snap(x, y, lines, radius):
    best = None
    for k, (name, line) in enumerate(lines):
        for j, ((ax, ay), (bx, by)) in enumerate(itertools.pairwise(line)):
            d2 = (bx - ax) ** 2 + (by - ay) ** 2
            t = 0 if d2 < 1e-18 else max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2))
            d = (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2
            if d < radius * radius and (best is None or (d, k, j) < best[:3]):
                best = (d, k, j, name)
    return best and best[3]


def test_snap_is_brute_force(spark):
    rng = np.random.default_rng(4)
    lines = [(f"e{k}", [tuple(p) for p in np.cumsum(rng.normal(0, 60, (5, 2)), 0).tolist()]) for k in range(30)]
    lines.append(("long", [(-2000.0, -900.0), (2000.0, 1000.0)]))
    lines.append(("dot", [(5.0, 5.0), (5.0, 5.0)]))
    edges = make_edges(spark, [(n, "a", "b", p) for n, p in lines])
    points = rng.uniform(-300, 300, (200, 2))
    samples = make_samples(spark, [("t", k, k, *p) for k, p in enumerate(points)])
    for radius in (15.0, 3.0, 0.0):
        got = {r["ord"]: r["edge_id"] for r in spatial.snap(samples, edges, radius).collect()}
        assert got == {k: brute_snap(*p, lines, radius) for k, p in enumerate(points.tolist())}


def test_snap_radius_is_strict_and_ties_go_to_the_first(spark):
    edges = make_edges(spark, [("a", "1", "2", [(0.0, 0.0), (10.0, 0.0)]), ("b", "1", "2", [(0.0, 20.0), (10.0, 20.0)])])
    got = {r["ord"]: r["edge_id"] for r in spatial.snap(make_samples(spark, [("t", 0, 0, 5, 10), ("t", 1, 1, 5, 15), ("t", 2, 2, 5, -15)]), edges, 15.0).collect()}
    assert got == {0: "a", 1: "b", 2: None}


def test_nearest_nodes_near_and_far(spark):
    nodes = make_nodes(spark, {f"n{k}": ((37 * k) % 113, (19 * k) % 89) for k in range(60)})
    asked = [(k, float((k * 53) % 140 - 10), float((k * 31) % 120 - 10)) for k in range(50)] + [(99, 5000.0, -7000.0)]
    got = {r["key"]: (r["node_id"], r["d"]) for r in spatial.nearest_nodes(spark.createDataFrame(asked, "key long, x double, y double"), nodes, 5.0).collect()}
    rows = nodes.collect()
    for k, x, y in asked:
        d, _, name = min(((x - r["x"]) ** 2 + (y - r["y"]) ** 2, r["ord"], r["id"]) for r in rows)
        assert got[k][0] == name and math.isclose(got[k][1], math.sqrt(d))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}} or got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}}


def test_clusters_in_dense_places(spark):
    """Components of close points are those of all pairs, in rows that are linear in the points."""
    rng = np.random.default_rng(3)
    dense = rng.uniform(0, 4, (3000, 2))
    cells, links = spatial.close_cells(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(dense)], "key long, x double, y double"), 8.0)
    assert cells.count() == 3000 and links.count() <= 4
    spread = np.concatenate([rng.uniform(0, 60, (150, 2)), [50.0, 90.0] + rng.normal(0, 0.01, (80, 2)), [58.0, 90.0] + rng.normal(0, 0.01, (80, 2)), [(0.0, 200.0), (8.0, 200.0), (16.000001, 200.0), (16.000001, 208.0000005)]])
    points = [(k, *map(float, p)) for k, p in enumerate(spread)]
    group = list(range(len(points)))
    for i, j in itertools.combinations(range(len(points)), 2):
        if (spread[i] - spread[j]) @ (spread[i] - spread[j]) <= 64.0 and group[i] != group[j]:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    got = spatial.endpoint_clusters(spark.createDataFrame(points, "key long, x double, y double").repartition(3), 8.0)
    first = {}
    for r in got.orderBy("key").collect():
        assert first.setdefault(r["node"], r["key"]) == group[r["key"]]
    assert [int(r["node"][1:]) for r in got.orderBy("key").collect()][0] == 0


def test_crossings_where_many_meet(spark):
    """A star of roads and a bundle through one small place: cells and keys are bounded, crossings those of all pairs."""
    star = [(f"s{k}", "a", "b", [(-50.0, -20.0 + k * 0.37), (50.0, 20.0 - k * 0.41)]) for k in range(60)]
    other = [(f"o{k}", "a", "b", [(10.0 * k, -200.0), (10.0 * k + 3, 200.0), (10.0 * k + 9, -200.0)]) for k in range(8)]
    edges = make_edges(spark, star + other)
    row = lambda r: (r["edge_a"], r["seg_a"], r["edge_b"], r["seg_b"], round(r["x"], 6), round(r["y"], 6))
    want = {row(r) for r in spatial.segment_crossings(edges, 1000.0, 10**9).collect()}
    assert {row(r) for r in spatial.segment_crossings(edges, 100.0, 8).collect()} == want and len(want) > 500
    loads = spatial.cells_by_load(spatial.segments(edges), 100.0, 8)
    full = loads.groupBy("level", "cx", "cy", "parts").count().collect()
    assert all(r["count"] <= 8 * r["parts"] for r in full) and max(r["level"] for r in full) == spatial.CUTS


def test_endpoint_clusters(spark):
    points = [(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 10.0, 0.0), (3, 100.0, 0.0), (4, 100.0, 0.0), (5, 200.0, 0.0)]
    df = spark.createDataFrame(points, "key long, x double, y double")
    got = {r["key"]: (r["node"], r["node_x"]) for r in spatial.endpoint_clusters(df, 5.0).collect()}
    assert got == {0: ("n0", 5.0), 1: ("n0", 5.0), 2: ("n0", 5.0), 3: ("n1", 100.0), 4: ("n1", 100.0), 5: ("n2", 200.0)}
    assert len({r["node"] for r in spatial.endpoint_clusters(df, 0.0).collect()}) == 5


def test_gap_stop_and_trip(spark, cross):
    rows = [("t", k, 10 * k, 10 * k - 100, 1) for k in range(6)]  # moves east on cw
    rows += [("t", 6 + k, 60 + 10 * k, -50, 1) for k in range(8)]  # stands for 80 s
    rows += [("t", 14 + k, 140 + 10 * k, -45 + 20 * k, 1) for k in range(6)]
    rows += [("t", 20 + k, 500 + 10 * k, 0, 20 + 10 * k) for k in range(4)]  # much later, on cn
    samples = make_samples(spark, rows)
    stop = traces.stop_windows(samples, 0.1, 60).collect()
    assert [(r["first_ord"], r["last_ord"], r["duration"], r["x"]) for r in stop] == [(5, 13, 80.0, -50.0)]
    found = traces.trips(samples, cross[1], stop_speed=0.1).orderBy("trip").collect()
    assert [(r["first_ord"], r["last_ord"], r["edge_sequence"]) for r in found] == [(0, 4, ["cw"]), (14, 19, ["cw", "ce"]), (20, 23, ["cn"])]
    assert traces.gap_split(samples, 25.0).agg(F.max("segment")).first()[0] == 1
    empty = samples.limit(0)
    assert traces.trips(empty, cross[1]).count() == 0 and traces.trip_summary(traces.trips(empty, cross[1])).first()["trips"] == 0


def test_speeds_and_observations(spark, cross):
    samples = make_samples(spark, [("a", k, 1_657_584_000 + k, 12 * k + 3, 1) for k in range(8)] + [("b", k, k, -90 + k, 1) for k in range(3)])
    classes = {r["edge_id"]: (r["samples"], r["median_speed"], r["road_class"]) for r in traces.road_class(samples, cross[1]).collect()}
    assert classes == {"ce": (7, 12.0, "arterial")}
    seen = {r["edge_id"]: (r["trace_count"], r["sample_count"]) for r in traces.fuse_traces(samples, cross[1]).collect()}
    assert seen == {"ce": (1, 8), "cw": (1, 3), "cn": (0, 0), "cs": (0, 0), "ef": (0, 0)}
    days = traces.observation_times(samples, cross[1], by="weekday").collect()
    assert [(r["edge_id"], r["bin"], r["samples"]) for r in days] == [("ce", 1, 8)]  # 2022-07-12 was a Tuesday


def test_junctions_and_maneuvers(spark, cross):
    nodes, edges = cross
    degrees = {r["id"]: (r["degree"], r["junction_hint"]) for r in topology.node_degrees(nodes, edges).collect()}
    assert degrees["c"] == (4, "multi_branch") and degrees["f"] == (1, "dead_end") and degrees["e"] == (2, "through_or_corner")
    assert [(r["id"], r["junction_type"]) for r in topology.junction_types(nodes, edges).collect()] == [("c", "crossroads")]
    ways = {(r["edge_id"], r["reverse"]): r["maneuvers"] for r in topology.maneuvers(edges).collect()}
    assert ways["ce", True] == ["straight", "left", "right"] and ways["cn", False] == ["straight", "u_turn"]
    t = make_edges(spark, [("a", "j", "1", [(0.0, 0.0), (9.0, 0.0)]), ("b", "j", "2", [(0.0, 0.0), (-9.0, 1.0)]), ("c", "j", "3", [(0.0, 0.0), (0.0, 9.0)])])
    assert topology.junction_types(nodes, t).first()["junction_type"] == "t_junction"
    y = make_edges(spark, [(str(k), "j", str(k), [(0.0, 0.0), (math.cos(a), math.sin(a))]) for k, a in enumerate((0.0, 2.1, 4.2))])
    assert topology.junction_types(nodes, y).first()["junction_type"] == "y_junction"


def test_merge_duplicates(spark):
    edges = make_edges(spark, [("a", "1", "2", [(0.0, 0.0), (10.0, 0.0)]), ("b", "2", "1", [(10.0, 2.0), (0.0, 2.0)]), ("c", "1", "3", [(0.0, 0.0), (1.0, 1.0)])])
    got = {r["edge_id"]: r for r in topology.merge_duplicate_edges(edges, 3).collect()}
    assert set(got) == {"a", "c"} and got["a"]["merged_edge_count"] == 2
    assert [(p["x"], p["y"]) for p in got["a"]["polyline"]] == [(0.0, 1.0), (5.0, 1.0), (10.0, 1.0)]


def test_routes_and_service_areas(spark, cross):
    _, edges = cross
    adj = routing.adjacency(edges)
    pairs = spark.createDataFrame([("n", "f"), ("c", "c"), ("n", "nowhere")], "from_node string, to_node string")
    got = {(r["from_node"], r["to_node"]): (round(r["cost"], 6), r["edges"]) for r in routing.paths(adj, pairs).collect()}
    assert got == {("n", "f"): (330.0, ["cn/reverse", "ce/forward", "ef/forward"]), ("c", "c"): (0.0, [])}
    start = spark.createDataFrame([("c", "c", 0.0)], "origin string, state string, cost double")
    reached = routing.cheapest(adj, start, 165.0)
    assert {r["state"] for r in reached.collect()} == {"c", "e", "n", "w", "s"}
    spans = {(r["edge_id"], r["direction"]): r["fraction"] for r in routing.reachable_spans(adj, reached, 165.0).collect()}
    assert spans["ef", "forward"] == 0.5 and spans["cn", "forward"] == 1.0
    rules = spark.createDataFrame([("c", "cn", "reverse", "ce", "forward", "no_left_turn")], "junction_node_id string, from_edge_id string, from_direction string, to_edge_id string, to_direction string, restriction string")
    origin = spark.createDataFrame([("n",)], "origin string")
    costs = {r["node"]: r["cost"] for r in routing.restricted_costs(edges, rules, origin).collect()}
    assert costs["w"] == 200.0 and costs["e"] == 400.0  # over a turn at the end of an arm
    only = rules.withColumn("restriction", F.lit("only_left"))
    assert {r["node"]: r["cost"] for r in routing.restricted_costs(edges, only, origin).collect()}["w"] == 400.0
    steps = guidance.guidance(routing.paths(adj, pairs).where("size(edges) > 0"), edges).orderBy("k").collect()
    assert [(r["maneuver"], r["start_m"]) for r in steps] == [("depart", 0.0), ("left", 100.0), ("arrive", 200.0)]


def brute_routes(moves, origin):
    """(cost, hops, last step, previous state) of every state, by rounds over moves (u, v, cost, step)."""
    best, frontier = {origin: (0.0, 0, "", None)}, {origin}
    while frontier:
        step = {}
        for u, v, w, name in moves:
            if u in frontier:
                label = (best[u][0] + w, best[u][1] + 1, name, u)
                if v not in step or label < step[v]:
                    step[v] = label
        frontier = {v for v, label in step.items() if v not in best or label[0] < best[v][0] - 1e-9}
        best |= {v: step[v] for v in frontier}
    return best


def walk_back(best, state):
    steps = []
    while best[state][3] is not None:
        steps.append(best[state][2])
        state = best[state][3]
    return steps[::-1]


def test_routes_over_free_edges_and_ties(spark):
    """Random graphs with edges of no length and of equal lengths: every reachable pair has the brute-force route."""
    rng = np.random.default_rng(12)
    lines = []
    for k in range(70):
        a, b = rng.integers(0, 25, 2).tolist()
        lines.append((f"e{k}", f"v{a}", f"v{b}", [(0.0, 0.0), (float(rng.choice([0, 0, 1, 1, 2, 5])), 0.0)]))
    lines += [(f"c{k}", f"c{k}", f"c{k + 1}", [(0.0, 0.0), (float(k % 3 == 0), 0.0)]) for k in range(37)]  # a chain, mostly free
    adj = routing.adjacency(make_edges(spark, lines))
    names = sorted({x for i in lines for x in i[1:3]})
    pairs = spark.createDataFrame([(o, t) for o in ("v0", "v7", "c0", "c20") for t in names], "from_node string, to_node string")
    got = {(r["from_node"], r["to_node"]): (r["cost"], r["edges"]) for r in routing.paths(adj, pairs).collect()}
    moves = [(r["u"], r["v"], r["cost"], f"{r['edge_id']}/{r['direction']}") for r in adj.collect()]
    least = {}
    for u, v, w, name in moves:
        least[u, v] = min(least.get((u, v), (9e9, "")), (w, name))
    moves = [(u, v, w, name) for (u, v), (w, name) in least.items()]
    want = {}
    for o in ("v0", "v7", "c0", "c20"):
        best = brute_routes(moves, o)
        want |= {(o, t): (best[t][0], walk_back(best, t)) for t in best}
    assert got == want and len(got["c0", "c37"][1]) == 37


def test_routes_under_turn_rules_and_on_lanes(spark, cross):
    _, edges = cross
    rules = spark.createDataFrame([("c", "cn", "reverse", "ce", "forward", "no_left_turn")], "junction_node_id string, from_edge_id string, from_direction string, to_edge_id string, to_direction string, restriction string")
    pairs = spark.createDataFrame([("n", "f"), ("n", "w"), ("s", "s"), ("n", "nowhere")], "from_node string, to_node string")
    got = {(r["from_node"], r["to_node"]): (round(r["cost"], 6), r["edges"]) for r in routing.restricted_paths(edges, rules, pairs).collect()}
    assert got["n", "w"] == (200.0, ["cn/reverse", "cw/forward"]) and got["s", "s"] == (0.0, []) and len(got) == 3
    # the ban is kept by turning round at the end of an arm
    assert got["n", "f"][0] == 530.0 and got["n", "f"][1][-2:] == ["ce/forward", "ef/forward"] and got["n", "f"][1][1] != "ce/forward"
    lanes = edges.where("edge_id in ('ce', 'ef')").select("edge_id", F.lit(2).alias("lane_count"))
    found = {(r["from_node"], r["to_node"]): (round(r["cost"], 6), r["edges"]) for r in routing.lane_paths(edges, lanes, pairs).collect()}
    assert found["n", "f"] == (330.0, ["cn/reverse/0", "ce/forward/0", "ef/forward/0"])


def test_numbers_follow_the_order(spark):
    from waymesh.plans.numbering import numbered

    rows = [(k * 7919) % 1000 for k in range(500)]
    got = numbered(spark.createDataFrame([(x,) for x in rows], "x long").repartition(5), F.desc("x")).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(500)) and [r["x"] for r in got] == sorted(rows, reverse=True)
    assert numbered(spark.createDataFrame([], "x long"), "x").count() == 0


def test_lane_changes_cost(spark, cross):
    _, edges = cross
    two = edges.where("edge_id = 'ce'").select("edge_id", F.lit(2).alias("lane_count"))
    got = {(r["node"], r["lane"]): r["cost"] for r in routing.lane_costs(edges, two, spark.createDataFrame([("w",)], "origin string"), 500.0).collect()}
    assert got["e", 0] == 200.0 and got["e", 1] == 250.0 and got["w", None] == 0.0


def brute_lanes(adj, lanes, origin, swap):
    """Cheapest cost of each (edge, direction, lane), changes within an edge included, by rounds."""
    best = {}
    frontier = {(e, d, k): w for u, v, e, d, w in adj if u == origin for k in range(lanes.get(e, 1))}
    ends = {(e, d): v for u, v, e, d, w in adj}
    while frontier:
        best |= frontier
        step = {}
        for (e, d, lane), cost in frontier.items():
            moves = [((e, d, k), cost + swap) for k in range(lanes.get(e, 1)) if k != lane]
            for u, _, f, way, w in adj:
                if u == ends[e, d]:
                    n = lanes.get(f, 1)
                    moves += [((f, way, k), cost + w + (swap if n > 1 and k != lane else 0)) for k in range(n)]
            for state, c in moves:
                step[state] = min(c, step.get(state, math.inf))
        frontier = {s: c for s, c in step.items() if c < best.get(s, math.inf) - 1e-9}
    return best, ends


def test_lanes_of_random_graphs(spark):
    rng = np.random.default_rng(4)
    lines = [(f"e{k}", f"v{a}", f"v{b}", [(0.0, 0.0), (float(rng.integers(1, 40)), 0.0)]) for k, (a, b) in enumerate(rng.integers(0, 12, (26, 2)).tolist())]
    edges = make_edges(spark, lines)
    lanes = {f"e{k}": int(n) for k, n in enumerate(rng.integers(1, 4, 26)) if k % 5}
    table = spark.createDataFrame(list(lanes.items()), "edge_id string, lane_count int")
    adj = [(r["u"], r["v"], r["edge_id"], r["direction"], r["cost"]) for r in routing.adjacency(edges).collect()]
    origins = spark.createDataFrame([("v0",), ("v5",)], "origin string")
    got = {(r["origin"], r["node"], r["lane"]): round(r["cost"], 6) for r in routing.lane_costs(edges, table, origins, swap_cost=7.0).where("lane is not null").collect()}
    want = {}
    for o in ("v0", "v5"):
        best, ends = brute_lanes(adj, lanes, o, 7.0)
        for (e, d, k), c in best.items():
            key = (o, ends[e, d], k)
            want[key] = min(c, want.get(key, math.inf))
    assert got == {k: round(c, 6) for k, c in want.items()}
    # one edge with many lanes gives no lanes to others
    wide = spark.createDataFrame([("e3", 60)], "edge_id string, lane_count int")
    moves, _, ends = routing._laned(edges, wide, origins, 7.0, None)
    assert ends.count() == len(adj) + 59 * sum(1 for a in adj if a[2] == "e3")


def test_lane_costs_of_one_to_three_lanes(spark):
    edges = make_edges(spark, [("a", "n0", "n1", [(0.0, 0.0), (100.0, 0.0)]), ("b", "n1", "n2", [(100.0, 0.0), (200.0, 0.0)])])
    lanes = spark.createDataFrame([("b", 3)], "edge_id string, lane_count int")
    got = {r["lane"]: r["cost"] for r in routing.lane_costs(edges, lanes, spark.createDataFrame([("n0",)], "origin string"), 400.0).where("node = 'n2'").collect()}
    assert got == {0: 200.0, 1: 250.0, 2: 250.0}
    back = routing.lane_costs(edges, lanes, spark.createDataFrame([("n2",)], "origin string")).where("node = 'n0'").first()
    assert back["cost"] == 200.0  # nothing into an edge of one lane


def grid_roads(spark, n, skew=7.0):
    at = {f"g{a}_{b}": (100.0 * a + skew * (b % 3), 100.0 * b - skew * (a % 4)) for a in range(n) for b in range(n)}
    lines = []
    for a in range(n):
        for b in range(n):
            for c, d in ((a + 1, b), (a, b + 1)):
                if c < n and d < n and (a * 7 + b * 5 + c) % 11:
                    lines.append((f"e{len(lines)}", f"g{a}_{b}", f"g{c}_{d}", [at[f"g{a}_{b}"], at[f"g{c}_{d}"]]))
    return make_nodes(spark, at), make_edges(spark, lines)


def test_a_goal_directed_search_settles_less_and_finds_the_same(spark):
    nodes, edges = grid_roads(spark, 14)
    lone = make_nodes(spark, {"far": (9000.0, 9000.0), "far2": (9100.0, 9000.0)})
    nodes = nodes.unionByName(lone)
    edges = edges.unionByName(make_edges(spark, [("x", "far", "far2", [(9000.0, 9000.0), (9100.0, 9000.0)])]))
    adj = routing.adjacency(edges)
    pairs = spark.createDataFrame([("g1_1", "g3_2"), ("g1_1", "g2_4"), ("g12_12", "g9_12"), ("g0_0", "g13_13"), ("g5_5", "far"), ("far", "far2"), ("g2_2", "g2_2"), ("g2_2", "none")], "from_node string, to_node string")
    row = lambda r: (r["from_node"], r["to_node"], round(r["cost"], 6), tuple(r["edges"]))
    want = sorted(map(row, routing.paths(adj, pairs).collect()))
    assert sorted(map(row, routing.paths(adj, pairs, nodes).collect())) == want and len(want) == 6
    none = spark.createDataFrame([], "junction_node_id string, from_edge_id string, from_direction string, to_edge_id string, to_direction string, restriction string")
    plain = lambda rows: sorted((r["from_node"], r["to_node"], round(r["cost"], 6)) for r in rows.collect())
    assert plain(routing.restricted_paths(edges, none, pairs, nodes)) == plain(routing.restricted_paths(edges, none, pairs)) == [x[:3] for x in want]
    lanes = edges.select("edge_id", (1 + F.col("ord") % 2).cast("int").alias("lane_count"))
    assert plain(routing.lane_paths(edges, lanes, pairs, nodes=nodes)) == plain(routing.lane_paths(edges, lanes, pairs))
    near = pairs.where("from_node = 'g1_1'")
    moves = adj.select("u", "v", "cost", F.lit("").alias("step"))
    ends = nodes.select(F.col("id").alias("state"), F.col("id").alias("node"))
    start = near.select(F.col("from_node").alias("origin"), F.col("from_node").alias("state"), F.lit(0.0).alias("cost")).distinct()
    settled = routing.search(moves, start, goals=routing._directed(nodes, moves, ends, near)).count()
    assert settled < 40 and routing.search(moves, start).count() == 14 * 14


def test_hmm_follows_the_road(spark):
    edges = make_edges(spark, [("low", "a", "b", [(0.0, 0.0), (200.0, 0.0)]), ("high", "c", "d", [(0.0, 12.0), (200.0, 12.0)])])
    y = [1, 1, 5, 7, 5, 1, 1]
    samples = make_samples(spark, [("t", k, k, 20 * k, v) for k, v in enumerate(y)] + [("u", 0, 0, 0, 900), ("u", 1, 1, 10, 0)])
    got = {(r["trace_id"], r["ord"]): r["edge_id"] for r in matching.hmm_match(samples, edges).collect()}
    assert all(got["t", k] == "low" for k in range(len(y)))
    assert got["u", 0] is None and got["u", 1] is None


def test_long_traces_are_matched_in_blocks(spark):
    """Blocks of any size give the chain of the whole stretch, with restarts, gaps and steps without any way."""
    rng = np.random.default_rng(9)
    _, edges = grid_roads(spark, 4)
    lone = make_edges(spark, [("x", "far", "far2", [(150.0, 40.0), (150.0, 60.0)])])  # near the others, but joined to none
    edges = edges.unionByName(lone.withColumn("ord", F.col("ord") + 1000))
    rows = []
    for t in range(4):
        x, y = rng.uniform(0, 300, 2)
        for k in range(90):
            x, y = np.clip(x + rng.normal(4, 14), -30, 330), np.clip(y + rng.normal(2, 14), -30, 330)
            if k % 23 == 7:
                x, y = rng.uniform(0, 300, 2)
            rows.append((f"t{t}", k, k, x, y))
    rows += [("lone", k, k, 150.0 + (k % 3) * 3, 41.0 + k) for k in range(18)] + [("end", k, k, 20.0 * k, 3.0 if k < 9 else 900.0) for k in range(10)]
    samples = make_samples(spark, rows)
    key = lambda x: tuple(str(v) for v in x)
    found = lambda b: sorted(((r["trace_id"], r["ord"], r["edge_id"]) for r in matching.hmm_match(samples, edges, 30.0, block=b).collect()), key=key)
    whole = found(10**6)
    assert len(whole) == len(rows) and len({e for _, _, e in whole}) > 10
    for size in (1, 4, 7):
        assert found(size) == whole


def test_lanes_and_points(spark, cross):
    pts = spark.createDataFrame([(k, float(x), float(y), 0.01 * (k % 3)) for k, (x, y) in enumerate([(10, 2), (11, 3), (12, 2), (50, -1), (20, 0), (500, 500)])], "key long, x double, y double, z double")
    sides = {(r["edge_id"], r["side"], r["bin"]): (r["x"], r["y"], r["n"]) for r in lanes.side_bins(pts, cross[1], 5.0, 4).collect()}
    assert sides["ce", "left", 0] == (11.0, 2.0, 3) and sides["ce", "right", 2] == (50.0, -1.0, 1)
    a, b, c, d = lanes.ground_plane(spark.createDataFrame([(float(x), float(y), 0.1 * x + 2.0 + (3.0 if (x * y) % 7 == 3 else 0.0)) for x in range(12) for y in range(12)], "x double, y double, z double"))
    assert c > 0 and math.isclose(a / c, -0.1, abs_tol=0.02) and math.isclose(b / c, 0, abs_tol=0.02) and math.isclose(d / c, 2.0, abs_tol=0.1)
    # many points on a line with wide gaps: each is the weighted mean of samples, by log weights
    gaps = make_samples(spark, [("t", k, k, x, y) for k, (x, y) in enumerate([(0, 0), (100, 0), (100.5, 1), (700, 40), (701, 40)])] + [("u", 0, 0, 0, 0), ("u", 1, 1, 100, 0), ("still", 0, 0, 5, 5), ("still", 1, 1, 5, 5)])
    for bins in (2, 10, 100, 400):
        found = {(r["trace_id"], r["k"]): (r["x"], r["y"]) for r in lanes.centerlines(gaps, ["trace_id"], bins).collect()}
        assert len(found) == 3 * bins and found["still", 0] == (5.0, 5.0)
        xy = np.array([(0, 0), (100, 0), (100.5, 1), (700, 40), (701, 40)], float)
        s = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))])
        for k in range(1, bins - 1):
            log = -0.5 * ((s - s[-1] * k / (bins - 1)) / (s[-1] / bins)) ** 2
            w = np.exp(log - log.max())
            assert np.allclose(found["t", k], w @ xy / w.sum(), atol=1e-6)
        assert math.isclose(found["u", bins - 1][0], 100.0)
    line = make_edges(spark, [("z", "a", "b", [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (2.0, 5.0)])])
    assert [(p["x"], p["y"]) for p in lanes.simplify(line, 0.3).first()["polyline"]] == [(0.0, 0.0), (2.0, 0.0), (2.0, 5.0)]
    offsets = spark.range(1).select(lanes.lane_offsets(F.lit(3), 3.5).alias("o")).first()["o"]
    assert offsets == [3.5, 0.0, -3.5]


def test_absorbed_lines(spark, cross):
    lines = spark.createDataFrame([("on", [(10.0, 1.0), (90.0, 3.0)]), ("off", [(10.0, 1.0), (90.0, 30.0)])], f"line_id string, polyline {POLY}")
    found = incremental.absorb(lines, cross[1])
    assert {r["line_id"]: r["edge_id"] for r in found.collect()} == {"on": "ce", "off": None}
    assert {r["edge_id"]: r["trace_observation_count"] for r in incremental.update_counts(cross[1], found).collect()}["ce"] == 1


def test_documents(spark, cross, tmp_path):
    nodes, edges = cross
    doc = json.loads("".join(r["value"] for r in documents.graph_json(nodes, edges).orderBy("part", "ord").collect()))
    assert [n["id"] for n in doc["nodes"]] == list("cenwsf") and doc["edges"][4]["polyline"][1] == {"x": 150.0, "y": 0.0}
    samples = make_samples(spark, [("t", 0, 0, 0, 0), ("t", 1, 1, 5, 5)])
    features = [json.loads(r["value"]) for r in documents.map_features(nodes, edges, samples, 52.0, 13.0, "d<a>").collect()]
    assert len(features) == 12 and {f["geometry"]["type"] for f in features} == {"LineString", "Point"}
    import xml.etree.ElementTree as ET

    documents.write_lines(documents.osm_xml(nodes, edges, 52.0, 13.0), f"{tmp_path}/osm")
    body = "".join(p.read_text() for p in sorted((tmp_path / "osm").glob("part-*.txt")))
    root = ET.fromstring(f"<osm>{body}</osm>")
    ids = [n.get("id") for n in root.iter("node")]
    assert len(ids) == len(set(ids)) == 6 + 11 and all(nd.get("ref") in ids for nd in root.iter("nd"))
    cut = edges.where("edge_id = 'ef'").select(documents.clip(F.col("polyline"), F.lit(0.5)).alias("p")).first()["p"]
    assert [(p["x"], p["y"]) for p in cut] == [(100.0, 0.0), (150.0, 0.0), (150.0, 15.0)]


def test_plane_and_headings(spark):
    x, y = geometry.lonlat_to_metres(F.lit(13.41), F.lit(52.53), 52.52, 13.40)
    lon, lat = geometry.metres_to_lonlat(x, y, 52.52, 13.40)
    r = spark.range(1).select(x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat"), geometry.heading_change(F.lit(170.0), F.lit(-170.0)).alias("h"), geometry.heading_change(F.lit(0.0), F.lit(180.0)).alias("u")).first()
    assert math.isclose(r["lon"], 13.41) and math.isclose(r["lat"], 52.53) and 600 < r["x"] < 700 and 1100 < r["y"] < 1120
    assert (r["h"], r["u"]) == (20.0, 180.0)


def test_build_a_graph_of_crossing_traces(spark):
    from waymesh.plans.build import build_graph

    rows = [("a", k, k, 10 * k, 0) for k in range(21)] + [("b", k, k, 100, 10 * k - 100) for k in range(21)]
    rows += [("c", k, k, 10 * k, 2) for k in range(21)] + [("d", k, k, 150, 10 * k + 5) for k in range(11)]
    graph = build_graph(make_samples(spark, rows))
    nodes = {(round(r["x"], -1), round(r["y"], -1)): r["junction_hint"] for r in graph["nodes"].collect()}
    assert nodes[100, 0] == "multi_branch" and nodes[150, 0] == "multi_branch"
    assert {nodes[x, y] for x, y in ((0, 0), (200, 0), (100, -100), (100, 100), (150, 100))} == {"dead_end"}
    assert sorted(r["merged_edge_count"] for r in graph["edges"].collect())[-1] >= 2
    with pytest.raises(ValueError, match="no edges"):
        build_graph(make_samples(spark, rows[:1]))


def test_near_parallel_edges_and_clustered_junctions_become_one(spark):
    at = {"a": (0, 0), "b": (100, 0), "c": (1, 5), "d": (101, 4), "far": (300, 0), "up": (0, 90), "x": (300, 90)}
    nodes = make_nodes(spark, at)
    ways = [("e0", "a", "b"), ("e1", "d", "c"), ("e2", "b", "far"), ("e3", "a", "up"), ("e4", "far", "x")]
    edges = make_edges(spark, [(i, s, t, [tuple(map(float, at[s])), tuple(map(float, at[t]))]) for i, s, t in ways])
    n, e = topology.merge_near_parallel_edges(nodes, edges, 8.0, 4)
    assert {r["id"]: (r["x"], r["y"]) for r in n.collect()} == {"a": (0.5, 2.5), "b": (100.5, 2.0), "far": (300, 0), "up": (0, 90), "x": (300, 90)}
    got = {r["edge_id"]: r for r in e.collect()}
    assert set(got) == {"e0", "e2", "e3", "e4"} and got["e0"]["merged_edge_count"] == 2
    assert [(p["x"], round(p["y"], 6)) for p in got["e0"]["polyline"]][0] == (0.5, 2.5)
    assert topology.merge_near_parallel_edges(nodes, edges, 0.0)[1] is edges
    # two junctions of three roads each, 10 m apart
    at = {"j": (0, 0), "k": (10, 0), "1": (0, 99), "2": (-99, 0), "3": (10, 99), "4": (99, 0)}
    ways = [("jk", "j", "k"), ("j1", "j", "1"), ("j2", "j", "2"), ("k3", "k", "3"), ("k4", "k", "4")]
    nodes = make_nodes(spark, at)
    edges = make_edges(spark, [(i, s, t, [tuple(map(float, at[s])), tuple(map(float, at[t]))]) for i, s, t in ways])
    n, e = topology.consolidate_junctions(nodes, edges, 14.0)
    assert {r["id"]: (r["x"], r["y"]) for r in n.collect()}["j"] == (5.0, 0.0) and n.count() == 5
    assert {(r["start_node_id"], r["end_node_id"]) for r in e.collect()} == {("j", "j"), ("j", "1"), ("j", "2"), ("j", "3"), ("j", "4")}
    assert topology.consolidate_junctions(nodes, edges, 10.0)[0].count() == 6  # closer than the tolerance, not as close


def test_more_traces_update_a_graph(spark, cross):
    from waymesh.plans.build import next_suffix, update_graph

    nodes, edges = cross
    # along an edge; across one arm, from nowhere to nowhere; from the end of another arm on
    rows = [("on", k, k, 10 + 8 * k, 1) for k in range(10)]
    rows += [("over", k, k, 60, 10 * k - 60) for k in range(13)]
    rows += [("on_north", k, k, 2, 104 + 10 * k) for k in range(12)]
    n, e = update_graph(nodes, edges, make_samples(spark, rows))
    old = {r["edge_id"]: r["trace_observation_count"] for r in e.collect()}
    assert old["ce"] == 1 and all(old[i] == 0 for i in ("cn", "cw", "cs", "ef"))
    new = {r["edge_id"]: r for r in e.collect() if r["edge_id"] not in {x["edge_id"] for x in edges.collect()}}
    assert all(r["trace_observation_count"] == 1 for r in new.values()) and len(new) >= 4
    where = {r["id"]: (round(r["x"]), round(r["y"])) for r in n.collect()}
    ends = {frozenset((where[r["start_node_id"]], where[r["end_node_id"]])) for r in new.values()}
    assert frozenset(((60, 0), (60, 60))) in ends and frozenset(((60, -60), (60, 0))) in ends
    assert where["n"][1] in (100, 101, 102, 103) and any(where["n"] in pair for pair in ends)
    assert set(where) > {"c", "e", "w", "s", "f", "n"} and len(set(where)) == n.count()
    assert next_suffix(edges, "edge_id") == 0 and next_suffix(e, "edge_id") == len(new)
    # a second run of the same traces changes counts alone
    n2, e2 = update_graph(n, e, make_samples(spark, rows))
    assert n2.count() == n.count() and e2.count() == e.count()


def test_heights_follow_vertices(spark, cross):
    from waymesh.operators.restrictions import elevate

    samples = spark.createDataFrame([("t", k, float(k), 10.0 * k, 1.0, 0.5 * k) for k in range(11)], "trace_id string, ord long, t double, x double, y double, z double")
    _, rise = elevate(*cross, samples)
    got = {r["edge_id"]: r for r in rise.collect()}
    assert got["ce"]["polyline_z"] == [0.0, 5.0] and math.isclose(got["ce"]["slope_deg"], math.degrees(math.atan2(5, 100)))


def brute_offset(line, offset, miter=4.0):
    """A miter-joined line, vertex by vertex."""
    unit = []
    for (ax, ay), (bx, by) in itertools.pairwise(line):
        size = math.hypot(bx - ax, by - ay)
        unit.append((0.0, 0.0) if size < 1e-12 else ((ay - by) / size, (bx - ax) / size))
    out = []
    for k, (x, y) in enumerate(line):
        before, after = unit[max(0, k - 1)], unit[min(k, len(unit) - 1)]
        if k == 0:
            before = after
        sx, sy = before[0] + after[0], before[1] + after[1]
        size = math.hypot(sx, sy)
        reference = before if before != (0, 0) else after
        if size < 1e-12:
            b = before if before != (0, 0) else (0.0, 0.0)
        else:
            b = (sx / size, sy / size)
        if before == after == (0, 0):
            out.append((x, y))
            continue
        along = b[0] * reference[0] + b[1] * reference[1]
        if along < 1e-6 or abs(1 / along) > miter:
            out += [(x + offset * v[0], y + offset * v[1]) for v in (before, after)]
        else:
            out.append((x + offset / along * b[0], y + offset / along * b[1]))
    return out


def test_offset_lines(spark):
    from waymesh.operators import hd

    rng = np.random.default_rng(6)
    lines = [np.cumsum(rng.normal(0, 10, (n, 2)), 0).tolist() for n in (2, 3, 5, 9, 30)]
    lines += [[(0, 0), (10, 0), (10, 0), (10, 10)], [(0, 0), (10, 0), (0, 0.1)], [(0, 0), (10, 0), (0, 0)], [(1, 1), (1, 1)], [(1, 1)]]
    lines = [[(float(x), float(y)) for x, y in p] for p in lines]
    df = make_edges(spark, [(f"e{k}", "a", "b", p) for k, p in enumerate(lines)])
    left, right = hd.boundaries("polyline", F.lit(3.5))
    for r in df.select("ord", left.alias("left"), right.alias("right")).collect():
        for name, offset in (("left", 1.75), ("right", -1.75)):
            got = [(p["x"], p["y"]) for p in r[name]]
            want = brute_offset(lines[r["ord"]], offset) if len(lines[r["ord"]]) > 1 else []
            assert np.allclose(got, want), (r["ord"], name)
    none = df.select(hd.boundaries("polyline", F.lit(0.0))[0].alias("p")).where("size(p) > 0")
    assert none.count() == 0
    bend = make_edges(spark, [("z", "a", "b", [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)])])
    assert math.isclose(bend.select(hd.mean_curvature("polyline").alias("c")).first()["c"], math.pi / 2)
    move = bend.select(hd.shifted("polyline", F.lit(1.0)).alias("p")).first()["p"]
    assert np.allclose([(p["x"], p["y"]) for p in move], [(0, 1), (10 - 0.5**0.5, 0.5**0.5), (9, 10)])
    points = spark.createDataFrame([("z", 5.0, 3.0), ("z", 14.0, 5.0)], "edge_id string, x double, y double")
    fit = hd.rms_residual(points, bend, "edge_id").first()
    assert math.isclose(fit["rms"], math.sqrt((9 + 16) / 2)) and fit["n"] == 2


def test_hd_widths_and_lanes(spark, cross):
    from waymesh.operators import hd

    nodes, edges = cross
    high, seeded = hd.enrich(nodes, edges, lane_width=3.5)
    row = {r["edge_id"]: r["hd"] for r in seeded.collect()}["ce"]
    assert [(p["x"], p["y"]) for p in row["left"]] == [(0.0, 1.75), (100.0, 1.75)] and row["quality"] == "centerline_offset"
    assert high.first()["hd"]["vertical_model"] == "unknown"
    plain = {r["edge_id"]: r["hd"] for r in hd.enrich(nodes, edges)[1].collect()}["ce"]
    assert plain["left"] == [] and plain["tier"] == "sd_seed"
    kept = hd.enrich(nodes, hd.enrich(nodes, seeded)[1])[1].where("edge_id = 'ce'").first()["hd"]
    assert len(kept["left"]) == 2  # an earlier hd stays
    marks = spark.createDataFrame([("ce", "left", 2.0, 30), ("ce", "left", 2.2, 10), ("ce", "right", -1.5, 20), ("cn", "left", 1.9, 5), ("cw", "center", 0.0, 9)], "edge_id string, side string, offset double, points int")
    camera = spark.createDataFrame([("ce", "Lane_line", -2.0), ("ce", "curb", 2.4), ("ce", "sign", 9.0), ("cs", "lane", None)], "edge_id string, kind string, offset double")
    seen = spark.createDataFrame([("ce", 40), ("cs", 2), ("cn", 3)], "edge_id string, matched_samples int")
    sources = hd.marking_widths(marks).unionByName(hd.camera_widths(camera)).unionByName(hd.trace_support(seen))
    refined = {r["edge_id"]: r for r in hd.refinements(edges, sources).collect()}
    assert math.isclose(refined["ce"]["half_width"], ((2.1 + 1.5) / 2 + 2.2) / 2) and math.isclose(refined["ce"]["centerline_offset"], 0.3)
    assert refined["ce"]["sources"] == ["camera", "lane_markings", "traces"] and refined["ce"]["confidence"] == round(1 - math.exp(-10.2), 4)
    assert refined["cs"]["half_width"] == 1.75 and refined["cs"]["confidence"] == 0.0 and refined["cn"]["half_width"] == 1.9
    assert refined["cw"]["half_width"] == 1.75 and refined["cw"]["sources"] == []  # a marking in the middle tells no width
    wide = {r["edge_id"]: r["hd"] for r in hd.enrich(nodes, edges, 3.5, hd.refinements(edges, sources))[1].collect()}
    assert np.allclose([p["y"] for p in wide["ce"]["left"]], 2.3) and np.allclose([p["y"] for p in wide["ce"]["right"]], -1.7)
    tags = spark.createDataFrame([("cw", 3), ("ce", 5)], "edge_id string, osm_lanes int")
    offsets = spark.createDataFrame([("cs", v) for v in (-2.0, -1.9, 1.8)], "edge_id string, offset double")
    inferred = hd.lane_inferences(edges, marks.where("edge_id = 'ce'"), tags, offsets)
    got = {r["edge_id"]: r for r in inferred.collect()}
    assert (got["ce"]["lane_count"], got["ce"]["source"], got["cw"]["lane_count"], got["cs"]["lane_count"], got["ef"]["source"]) == (1, "lane_markings", 3, 2, "default")
    assert [x["offset_m"] for x in got["cw"]["lanes"]] == [3.5, 0.0, -3.5] and [x["offset_m"] for x in got["cs"]["lanes"]] == [0.875, -0.875]
    assert np.allclose([p["y"] for p in got["cw"]["lanes"][0]["centerline"]], -3.5)  # westwards, left is south
    assert hd.apply_lane_inferences(edges, inferred).where("lane_count = 3").first()["edge_id"] == "cw"
    assert {(r["kind"], r["label"]): r["n"] for r in hd.lane_summary(inferred).collect()}["source", "default"] == 2
    room = hd.widened(hd.apply_lane_inferences(seeded, inferred), F.col("lane_count")).where("edge_id = 'cw'").first()["hd"]
    assert np.allclose([p["y"] for p in room["left"]], -5.25)


def test_lane_markings_of_painted_lines(spark):
    from waymesh.operators import hd, markings

    edges = make_edges(spark, [("r", "a", "b", [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0)])])
    rng = np.random.default_rng(2)
    rows = []
    for s in np.arange(0.1, 59.9, 0.2):
        for t, bright in ((1.8, 200), (-1.7, 190), (0.9, 20), (-0.6, 25), (0.2, 10), (0.4, 12), (1.2, 15), (-1.1, 30), (-2.2, 5), (2.3, 9), (0.0, 3), (0.6, 8)):
            if bright > 100 and 20 < s < 25:
                continue  # worn paint
            t = t + rng.normal(0, 0.02)
            x, y = (s, t) if s < 30 else (30 - t, s - 30)
            rows.append((len(rows), float(x), float(y), 0.0, float(bright + rng.integers(0, 5))))
    points = spark.createDataFrame(rows, "key long, x double, y double, z double, intensity double").repartition(4)
    found = sorted((r["side"], round(r["offset"], 1), len(r["polyline"])) for r in markings.lane_markings(points, edges).collect())
    assert {x[0] for x in found} == {"left", "right"} and all(abs(x[1] - (1.8 if x[0] == "left" else -1.7)) <= 0.1 for x in found)
    assert [x[0] for x in found].count("left") == 2  # a gap of five bins ends a track
    spot = markings.on_edge(spark.createDataFrame([("r", 10.0, 1.0), ("r", 40.0, 1.0), ("r", 60.0, -2.0)], "edge_id string, s double, t double"), edges).orderBy("s").collect()
    assert np.allclose([(r["x"], r["y"]) for r in spot], [(10, 1), (29, 10), (32, 30)])
    assert spark.range(1).select(markings.marking_style(F.lit(9), F.lit(10), F.lit(200.0)).alias("a"), markings.marking_style(F.lit(2), F.lit(10), F.lit(200.0)).alias("b")).first() == ("solid", "dashed")
    nodes = make_nodes(spark, {"a": (0, 0), "b": (30, 30)})
    fused = markings.fuse_boundaries(hd.enrich(nodes, edges, 3.5)[1], points.where("intensity > 100"), bins=12).first()["hd"]
    assert fused["quality"] == "lidar_fused" and len(fused["left"]) >= 9 and abs(fused["left"][0]["y"] - 1.8) < 0.1
    raised = points.where("intensity > 100").withColumn("z", F.lit(0.1)).unionByName(points.where("intensity < 100"))
    assert markings.fuse_boundaries_3d(hd.enrich(nodes, edges, 3.5)[1], raised, 0.05, 0.3, tolerance=0.02).first()["hd"]["quality"] == "lidar_fused"


def test_cameras(spark, cross, tmp_path):
    from waymesh.operators import camera, hd

    def matrix(roll, pitch, yaw):
        c, s = math.cos, math.sin
        rx = np.array([[1, 0, 0], [0, c(roll), -s(roll)], [0, s(roll), c(roll)]])
        ry = np.array([[c(pitch), 0, s(pitch)], [0, 1, 0], [-s(pitch), 0, c(pitch)]])
        rz = np.array([[c(yaw), -s(yaw), 0], [s(yaw), c(yaw), 0], [0, 0, 1]])
        return rz @ ry @ rx

    assert np.allclose(camera.rotation(0.1, -0.2, 0.3), matrix(0.1, -0.2, 0.3))
    doc = {"intrinsic": {"fx": 900, "fy": 880, "cx": 640, "cy": 360, "distortion": {"k1": -0.05, "k2": 0.01, "p1": 0.001, "p2": -0.002, "k3": 0.0}}, "camera_to_vehicle": {"rotation_rpy_rad": [0.01, 0.12, -0.05], "translation_m": [1.2, 0.1, 1.6]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    own = camera.read_calibration(spark, f"{tmp_path}/c.json")
    # points on the ground are seen in a pixel, and that pixel lies on them
    pose = (5.0, -3.0, 0.4, 0.02, -0.01, 2.1)
    turned = matrix(*pose[3:])
    ground = []
    for ahead, left in ((8, 0), (12, 3), (20, -5), (35, 6)):
        x, y = (np.array(pose[:2]) + (turned @ np.array([ahead, left, 0]))[:2]).tolist()
        ground.append((len(ground), x, y))
    df = spark.createDataFrame(ground, "pos long, px double, py double")
    columns = [F.lit(v) for v in pose]
    u, v = camera.ground_to_pixel(F.col("px"), F.col("py"), F.lit(0.0), own, tuple(columns[:3]), camera.rotation(*columns[3:]))
    seen = df.withColumns({"u": u, "v": v, **{c: F.lit(x) for c, x in zip(("x", "y", "z", "roll", "pitch", "yaw"), pose, strict=True)}, "kind": F.lit("lane_line")})
    back = camera.project_detections(seen.unionByName(seen.withColumns({"v": F.lit(0.0), "pos": F.col("pos") + 100})), own).collect()
    for r in back:
        if r["pos"] < 100:
            assert math.isclose(r["gx"], r["px"], abs_tol=1e-3) and math.isclose(r["gy"], r["py"], abs_tol=1e-3)
        else:
            assert r["gx"] is None
    image = {"image_detections": [{"image_id": "i", "pose": {"translation_m": [10, 2, 0]}, "detections": [{"kind": "speed_limit", "pixel": {"u": 640, "v": 700}, "value_kmh": 30, "confidence": 0.9}, {"kind": "sign", "pixel": {"u": 640, "v": 10}}, {"kind": "", "pixel": {"u": 1, "v": 1}}]}, {"pose": {"translation_m": [500, 500, 0]}, "detections": [{"kind": "curb", "pixel": {"u": 640, "v": 700}}]}]}
    (tmp_path / "i.json").write_text(json.dumps(image))
    found = camera.observations_on_edges(camera.image_detections(spark, f"{tmp_path}/i.json"), own, cross[1], max_dist=5.0)
    assert {(r["kind"], r["fate"], r["edge_id"]) for r in found.collect()} == {("speed_limit", "on_edge", "ce"), ("sign", "above_horizon", None), ("curb", "no_edge", None)}
    _, edges = hd.enrich(*cross)
    ruled = camera.apply_observations(edges, found.select("pos", "edge_id", F.col("extra").alias("rule")))
    rules = {r["edge_id"]: r["hd"]["semantic_rules"] for r in ruled.collect()}
    assert json.loads(rules["ce"][0])["value_kmh"] == 30 and rules["cn"] == []
    seen = spark.createDataFrame([(0, "sign", "{}"), (3, "turn_restriction", json.dumps({"junction_node_id": "c", "from_edge_id": "cn", "to_edge_id": "ce", "restriction": "no_left_turn"})), (4, "turn_restriction", json.dumps({"edge_id": "x"})), (9, "turn_restriction", json.dumps({"id": "own", "junction_node_id": "c", "to_direction": "reverse"}))], "pos long, kind string, item string")
    turns = {r["id"]: r for r in camera.restrictions_seen(seen).collect()}
    assert set(turns) == {"tr_camera_0000", "own"} and turns["tr_camera_0000"]["source"] == "camera_detection" and turns["own"]["to_direction"] == "reverse" and turns["own"]["from_direction"] == "forward"


def osm_document(rows):
    import xml.etree.ElementTree as ET

    body = "".join(r["value"] for r in rows.orderBy("part", "ord").collect())
    return ET.fromstring(f"<osm>{body}</osm>")


def test_lanelet_maps(spark, cross, tmp_path):
    from waymesh.operators import camera, hd
    from waymesh.sources import lanelets

    nodes, edges = cross
    nodes = nodes.join(topology.node_degrees(nodes, edges), "id").join(topology.junction_types(nodes, edges), "id", "left").withColumn("elevation_m", F.when(F.col("id") == "c", 12.5))
    edges = edges.withColumns({"osm_oneway": F.when(F.col("edge_id") == "cw", "yes"), "osm_maxspeed": F.when(F.col("edge_id") == "cs", "50 mph"), "osm_name": F.when(F.col("edge_id") == "ce", 'A & "B"')})
    _, seeded = hd.enrich(nodes, edges, 3.5)
    rules = [(0, "ce", {"kind": "speed_limit", "value_kmh": 50}), (1, "ce", {"kind": "speed_limit", "value_kmh": 30.0}), (2, "ce", {"kind": "traffic_light", "world_xy_m": {"x": 90.0, "y": 4.0}, "confidence": 0.8}), (3, "ce", {"kind": "stop_line", "polyline_m": [[95, 2], [95, -2]]}), (4, "cn", {"kind": "yield"}), (5, "cn", {"kind": "tree"})]
    seeded = camera.apply_observations(seeded, spark.createDataFrame([(k, e, json.dumps(r)) for k, e, r in rules], "pos long, edge_id string, rule string"))
    turns = spark.createDataFrame([("t1", "cn", "ce", "no_left_turn")], "id string, from_edge_id string, to_edge_id string, restriction string")
    root = osm_document(lanelets.lanelet_map(nodes, seeded, 52.0, 13.0, restrictions=turns))
    ids = [x.get("id") for kind in ("node", "way", "relation") for x in root.iter(kind)]
    assert len(ids) == len(set(ids)) and root[0].tag == "MetaInfo"
    known = {x.get("id") for x in root.iter("node")}
    assert all(nd.get("ref") in known for nd in root.iter("nd"))
    tags = lambda x: {t.get("k"): t.get("v") for t in x.findall("tag")}
    relations = {x.get("id"): (tags(x), [(m.get("type"), m.get("ref"), m.get("role")) for m in x.findall("member")]) for x in root.iter("relation")}
    ll = {t["graph:edge_id"]: (i, t, m) for i, (t, m) in relations.items() if t["type"] == "lanelet"}
    assert set(ll) == {"ce", "cn", "cw", "cs", "ef"} and [m[2] for m in ll["ce"][2]] == ["left", "right", "centerline"]
    assert ll["ce"][1]["speed_limit"] == "30" and ll["cs"][1]["speed_limit"] == "50 km/h" and ll["cw"][1]["one_way"] == "yes" and ll["ce"][1]["name"] == 'A & "B"'
    assert all(r in {x.get("id") for x in root.iter("way")} for _, r, _ in ll["ce"][2])
    kinds = [(t["subtype"], m) for t, m in relations.values() if t["type"] == "regulatory_element"]
    assert sum(k == "traffic_light" for k, _ in kinds) == 1 and sum(k == "yield" for k, _ in kinds) == 1 and not any(k in ("tree", "stop_line") for k, _ in kinds)
    light = next(m for k, m in kinds if k == "traffic_light")
    assert light[0] == ("relation", ll["ce"][0], "refers") and light[1][0] == "node" and light[1][1] in known
    assert sum(tags(w).get("graph:kind") == "stop_line" for w in root.iter("way")) == 1
    assert next(m for k, m in kinds if k == "right_of_way") == [("relation", ll["cn"][0], "refers"), ("relation", ll["ce"][0], "refers")]
    follow = {(m[0][1], m[1][1]) for k, m in kinds if k == "lane_connection"}
    number = {k: v[0] for k, v in ll.items()}
    # traffic leaves c by cw alone, so nothing follows from cw there
    assert (number["ce"], number["cw"]) in follow and (number["cw"], number["ce"]) not in follow and (number["ce"], number["ef"]) in follow
    assert len(follow) == 3 * 2 + 3 + 2
    as_rule = osm_document(lanelets.lanelet_map(nodes, seeded, 52.0, 13.0, speed_as_rule=True))
    assert [tags(x)["speed_limit"] for x in as_rule.iter("relation") if tags(x).get("subtype") == "speed_limit"] == ["30"]
    inferred = hd.lane_inferences(edges, spark.createDataFrame([], "edge_id string, offset double"), spark.createDataFrame([("ce", 3)], "edge_id string, osm_lanes int"), spark.createDataFrame([], "edge_id string, offset double"))
    laned = osm_document(lanelets.lanelet_map(nodes, hd.apply_lane_inferences(seeded, inferred.where("edge_id = 'ce'")), 52.0, 13.0, per_lane=True))
    lanes = [tags(x) for x in laned.iter("relation") if tags(x).get("type") == "lanelet"]
    assert sorted(t.get("graph:lane_index", "") for t in lanes if t["graph:edge_id"] == "ce") == ["0", "1", "2"] and len(lanes) == 7
    assert sum(tags(x).get("subtype") == "lane_change" for x in laned.iter("relation")) == 2
    styles = sorted((tags(w)["graph:lane_index"], tags(w)["graph:side"], tags(w)["subtype"]) for w in laned.iter("way") if "graph:lane_index" in tags(w))
    assert styles == [("0", "left", "solid"), ("0", "right", "dashed"), ("1", "left", "dashed"), ("1", "right", "dashed"), ("2", "left", "dashed"), ("2", "right", "solid")]

    documents.write_lines(lanelets.lanelet_map(nodes, seeded, 52.0, 13.0), f"{tmp_path}/map")
    text = "".join(p.read_text() for p in sorted((tmp_path / "map").glob("part-*.txt")))
    (tmp_path / "map.osm").write_text(f"<osm>\n{text}</osm>\n")
    tables = lanelets.read_osm(spark, f"{tmp_path}/map.osm")
    assert {r["level"] for r in lanelets.check_lanelets(tables["relations"]).collect()} == {"warning"}
    counts = {r["kind"]: r["n"] for r in lanelets.lanelet_counts(tables).collect()}
    assert counts["lanelet/road"] == 5 and counts["way"] == 16 and counts["regulatory_element/lane_connection"] == len(follow)
    clean = lanelets.sanitized(tables)
    kept = [r["tags"] for r in clean["relations"].collect()]
    assert {t.get("subtype") for t in kept} == {"road", "traffic_light"} and all(not k.startswith("graph:") for t in kept for k in t)
    turns = {t["turn_direction"] for t in kept if t["type"] == "lanelet"}
    assert turns == {"straight", "left"}  # ef bends north
    assert {r["tags"]["ele"] for r in clean["nodes"].collect()} == {"12.500"}
    again = osm_document(lanelets.osm_rows(clean))
    assert len(list(again.iter("relation"))) == 6
    # the light is a line across its lanelet, which names it
    plain = {r["id"]: r for r in tables["nodes"].collect()}
    (light_row,) = [r for r in clean["relations"].collect() if r["tags"].get("subtype") == "traffic_light"]
    (line,) = [w for w in clean["ways"].collect() if "traffic_light_id" in w["tags"]]
    assert [(m["type"], m["ref"], m["role"]) for m in light_row["members"]] == [("way", line["id"], "refers"), ("way", line["id"], "light_bulbs")]
    assert line["tags"] == {"height": "5.00", "traffic_light_id": str(light_row["id"])} and len(line["refs"]) == 2
    most = max(int(r["id"]) for t in ("nodes", "ways", "relations") for r in tables[t].select("id").collect())
    assert [int(r) for r in line["refs"]] + [int(line["id"])] == [most + 1, most + 2, most + 3]
    point = plain[next(m["ref"] for r in tables["relations"].collect() if r["id"] == light_row["id"] for m in r["members"] if m["type"] == "node")]
    right, left = ({r["id"]: r for r in clean["nodes"].collect()}[i] for i in line["refs"])
    metre = 1 / 111320.0
    # ce goes east, so the line goes from south to north
    assert math.isclose(right["lat"], point["lat"] - 0.75 * metre, abs_tol=1e-9) and math.isclose(left["lat"], point["lat"] + 0.75 * metre, abs_tol=1e-9) and math.isclose(left["lon"], point["lon"], abs_tol=1e-9)
    named = [r for r in clean["relations"].collect() if r["tags"]["type"] == "lanelet" and any(m["role"] == "regulatory_element" for m in r["members"])]
    assert len(named) == 1 and named[0]["members"][-1]["ref"] == light_row["id"] and all("width" not in r["tags"] for r in clean["relations"].collect())
    assert "latitude: 52.0" in lanelets.projector_yaml(52.0, 13.0)


def test_comparisons(spark, cross):
    from waymesh.operators import compare

    nodes, edges = cross
    moved = nodes.where("id <> 'f'").withColumn("x", F.col("x") + F.when(F.col("id") == "e", 0.25).otherwise(0.0))
    got = {r["kind"]: (r["common"], r["missing"], r["added"], r["max_m"]) for r in compare.drift({"nodes": nodes, "edges": edges}, {"nodes": moved, "edges": edges}).collect()}
    assert got == {"node": (5, 1, 0, 0.25), "vertex": (11, 0, 0, 0.0)}
    nav = topology.sd_nav_edges(edges)
    other = nav.where("edge_id <> 'cn'").withColumn("allowed", F.when(F.col("edge_id") == "ce", "straight,left,right").otherwise(F.col("allowed")))
    assert {(r["key"], r["field"]) for r in compare.navigation_changes(nav, other).collect()} == {("cn", "missing"), ("ce", "allowed")}
    features = documents.map_features(nodes, edges, make_samples(spark, []), 52.0, 13.0, "d")
    assert compare.feature_changes(features, features).count() == 0 and compare.feature_changes(features, features.where("layer <> 'node' or ord > 0")).first()["field"] == "missing"
    back = compare.graph_of_features(features, 52.0, 13.0)
    assert {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in back["nodes"].collect()} == {r["id"]: (r["x"], r["y"]) for r in nodes.collect()}
    assert {r["edge_id"]: len(r["polyline"]) for r in back["edges"].collect()}["ef"] == 3
    points = spark.createDataFrame([(0, 50.0, 3.0, {"highway": "traffic_signals"}), (1, 2.0, 60.0, {"highway": "stop"}), (2, 3.0, 3.0, {"shop": "x"}), (3, 900.0, 0.0, {"highway": "stop"}), (4, 40.0, 2.0, {"highway": "give_way"}), (5, 40.0, 2.0, {"highway": "speed_camera", "maxspeed": "50 mph"}), (6, 40.0, 2.0, {"highway": "speed_camera", "maxspeed": "walk"}), (7, 40.0, 2.0, {"highway": "crossing"}), (8, 60.0, 2.0, {"highway": "crossing"})], "pos long, x double, y double, tags map<string,string>")
    rules = [(r["pos"], r["edge_id"], r["kind"], json.loads(r["rule"])) for r in compare.mapped_rules(points, edges).orderBy("pos").collect()]
    assert [(p, e, k) for p, e, k, _ in rules] == [(0, "ce", "traffic_light"), (1, "cn", "stop_line"), (4, "ce", "stop_line"), (5, "ce", "speed_camera"), (6, "ce", "speed_camera"), (7, "ce", "crosswalk"), (8, "ce", "crosswalk")]
    assert rules[1][3]["polyline_m"] == [[2.0, 60.0], [-2.0, 60.0]] and rules[0][3]["world_xy_m"] == {"x": 50.0, "y": 3.0} and rules[0][3]["match_distance_m"] == 3.0
    assert rules[2][3]["polyline_m"] == [[40.0, -2.0], [40.0, 2.0]] and "polyline_m" not in rules[3][3]
    assert rules[3][3]["value_kmh"] == 50 and "value_kmh" not in rules[4][3] and rules[5][3]["source"] == "osm_node"
    assert [r["pos"] for r in compare.mapped_rules(points, edges, max_crossings=1).where("kind = 'crosswalk'").collect()] == [7]
    ways = spark.createDataFrame([(7, 2, {"lanes": "2"}, [(0.0, 3.0), (100.0, 3.0)]), (8, None, {}, [(0.0, -30.0), (0.0, -80.0)])], f"way_id long, lanes int, tags map<string,string>, polyline {POLY}")
    score = compare.lane_accuracy(edges.withColumn("lane_count", F.lit(1)), ways).first()
    assert (score["edges"], score["matched"], score["mae"], score["exact"]) == (5, 1, 1.0, 0.0)
    assert {r["edge_id"]: r["way_id"] for r in compare.tagged(edges, ways).collect()} == {"ce": 7, "cn": None, "cw": None, "cs": 8, "ef": None}


def test_result_documents_and_bundles(spark, cross, tmp_path):
    from waymesh.operators import hd
    from waymesh.sources import validation

    nodes, edges = cross
    read = lambda rows: json.loads("".join(r["value"] for r in rows.orderBy("part", "ord").collect()))
    adj = routing.adjacency(edges)
    pairs = spark.createDataFrame([("n", "f"), ("w", "s")], "from_node string, to_node string")
    routes = routing.paths(adj, pairs)
    steps = guidance.guidance(routes, edges)
    assert validation.check_guidance(steps).count() == 0 and validation.check_guidance(steps.withColumn("maneuver", F.lit("fly"))).count() > 0
    assert [s["maneuver"] for s in read(documents.guidance_json(steps))["steps"]] == ["depart", "left", "arrive", "depart", "right"][:3] + ["depart", "arrive"]
    assert read(documents.routes_json(routes))["routes"][0]["to_node"] == "f"
    assert read(documents.result_json("none", routes.limit(0), "from_node")) == {"format_version": 1, "none": []}
    start = spark.createDataFrame([("c", "c", 0.0)], "origin string, state string, cost double")
    reached = routing.cheapest(adj, start, 165.0)
    spans = routing.reachable_spans(adj, reached, 165.0)
    area = read(documents.reachability_json(reached, spans, 165.0))
    assert area["max_cost_m"] == 165.0 and {n["node_id"] for n in area["nodes"]} == {"c", "e", "n", "w", "s"}
    features = documents.reachability_features(reached, spans, nodes, edges, 52.0, 13.0)
    map_ = read(documents.feature_collection(features, "layer", "key"))
    half = next(f for f in map_["features"] if f["properties"].get("edge_id") == "ef" and f["properties"]["direction"] == "forward")
    assert half["properties"]["reachable_fraction"] == 0.5 and len(half["geometry"]["coordinates"]) == 3 and len(map_["features"]) == spans.count() + 5
    samples = make_samples(spark, [("t", k, k, 10 * k, 1) for k in range(5)])
    nav = topology.sd_nav_edges(edges)
    manifest = documents.write_bundle(f"{tmp_path}/out", *hd.enrich(nodes, edges, 3.5), samples, nav, 52.0, 13.0, "d")
    assert manifest["counts"] == {"nodes": 6, "edges": 5, "samples": 5} and manifest["files"] == ["graph", "lanelets", "map", "nav"]
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / "out" / name).glob("part-*.txt")))
    graph = json.loads(text("graph"))
    assert graph["edges"][0]["attributes"]["hd"]["left"][0] == {"x": 0.0, "y": 1.75} and graph["metadata"] == {"dataset": "d"}
    assert json.loads(text("nav"))["edges"][0]["allowed"] == ["straight"] and len(json.loads(text("map"))["features"]) == 1 + 5 * 3 + 6
    assert text("lanelets").startswith("<osm") and text("lanelets").rstrip().endswith("</osm>")
    rows = spark.createDataFrame([(text("manifest"),), (json.dumps({"manifest_version": 2, "dataset": "x"}),)], "value string")
    assert {r["key"] for r in validation.check_manifest(rows).collect()} == {"x"}
    picture = "".join(r["value"] for r in documents.svg(samples, nodes, edges).orderBy("part", "ord").collect())
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(picture)) == 5 + 5 + 6


def test_a_graph_for_each_trace(spark):
    from waymesh.plans.build import build_each, build_graph

    rows = [("a", k, k, 10 * k, 0) for k in range(21)] + [("b", k, k, 100, 10 * k - 100) for k in range(21)] + [("one", 0, 0, 5, 5)]
    rows += [("c", k, k, 300 + 100 * math.cos(k / 6), 100 * math.sin(k / 6)) for k in range(25)]
    each = build_each(make_samples(spark, rows))
    place = lambda r: (round(r["x"], 6), round(r["y"], 6))
    got = {t: {place(r) for r in each["nodes"].collect() if r["trace_id"] == t} for t in "abc"}
    for t in "abc":  # as if the others were not there
        alone = build_graph(make_samples(spark, [r for r in rows if r[0] == t]))
        assert got[t] == {place(r) for r in alone["nodes"].collect()}
        assert each["edges"].where(F.col("trace_id") == t).count() == alone["edges"].count()
    assert {r["trace_id"] for r in each["edges"].select("trace_id").distinct().collect()} == set("abc")


def test_few_pairs_are_joined_in_few_jobs(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(100, 400)], "a string, b string")
    spark.sparkContext.setJobGroup("chain", "components")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {f"n{k}": "n100" for k in range(101, 401)} and jobs <= 12
    assert got == {r["node"]: r["component"] for r in connected_components(edges, few=0).collect()}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_images_are_drawn_by_all_tasks(spark):
    drawn = queries._images(spark, "/root/testdata/sf0.001")
    assert drawn.rdd.getNumPartitions() == shuffle_partitions(spark) > 1


def test_crossings_leave_their_task_as_they_are(spark):
    """Crossings on borders and corners of cells are found once, without a shuffle of the pairs."""
    line = lambda a, b: [(float(a[0]), float(a[1])), (float(b[0]), float(b[1]))]
    lines = [line((50, 100), (150, 100)), line((100, 50), (100, 150)), line((60, 60), (140, 140)), line((0, 30), (200, 31)), line((100, 0), (100, 40))]
    rows = [(k, f"e{k}", [Row(x=x, y=y) for x, y in p]) for k, p in enumerate(lines)]
    found = spatial.segment_crossings(spark.createDataFrame(rows, "ord long, edge_id string, polyline array<struct<x:double,y:double>>"), 100.0, 2)
    assert sorted((r["edge_a"], r["edge_b"]) for r in found.collect()) == [("e0", "e1"), ("e0", "e2"), ("e1", "e2"), ("e3", "e4")]
    assert "Aggregate" not in _plan(found)


def test_near_parallel_pairs_are_found_once(spark, rng=np.random.default_rng(8)):
    at = np.vstack([rng.uniform(0, 60, (150, 4)), [[5, 5, 5, 5], [5, 5, 5, 5], [0, 0, 8, 0], [8, 0, 0, 0]]]).tolist()
    rows = [(k, f"e{k}", [Row(x=a, y=b), Row(x=c, y=d)]) for k, (a, b, c, d) in enumerate(at)]
    found = topology.near_parallel_pairs(spark.createDataFrame(rows, "ord long, edge_id string, polyline array<struct<x:double,y:double>>"), 10.0)
    want = {}
    for i, (a, b, c, d) in enumerate(at):
        for j, (e, f, g, h) in enumerate(at[i + 1 :], i + 1):
            ahead, turned = math.sqrt((a - e) ** 2 + (b - f) ** 2) + math.sqrt((c - g) ** 2 + (d - h) ** 2), math.sqrt((a - g) ** 2 + (b - h) ** 2) + math.sqrt((c - e) ** 2 + (d - f) ** 2)
            if min(ahead, turned) < 20:
                want[f"e{i}", f"e{j}"] = (round(min(ahead, turned), 9), turned < ahead)
    got = [((r["edge_a"], r["edge_b"]), (round(r["apart"], 9), r["turned"])) for r in found.collect()]
    assert len(got) == len(want) > 300 and dict(got) == want and "Aggregate" not in _plan(found)


def test_detections_are_not_joined_back(spark):
    edges = spark.createDataFrame([(0, "e0", [Row(x=0.0, y=0.0), Row(x=100.0, y=0.0)])], "ord long, edge_id string, polyline array<struct<x:double,y:double>>")
    rows = [("a", 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, "sign", 320.0, 400.0), ("b", 10.0, 1.0, 0.0, 0.0, 0.0, 0.0, "sign", 320.0, 0.0), ("c", 10.0, 50.0, 0.0, 0.0, 0.0, 0.0, "sign", 320.0, 400.0)]
    seen = spark.createDataFrame(rows, "pos string, x double, y double, z double, roll double, pitch double, yaw double, kind string, u double, v double")
    found = camera.observations_on_edges(seen, camera.Calibration(500.0, 500.0, 320.0, 240.0, shift=(0.0, 0.0, 1.5)), edges)
    assert {r["pos"]: (r["fate"], r["edge_id"], r["x"], r["y"]) for r in found.collect()} == {"a": ("on_edge", "e0", 10.0, 1.0), "b": ("above_horizon", None, 10.0, 1.0), "c": ("no_edge", None, 10.0, 50.0)}
    assert _plan(found).count("Join") == 1


def test_moves_are_not_joined_beforehand_within_a_budget(spark, monkeypatch):
    seen, real = [], routing.search
    monkeypatch.setattr(routing, "search", lambda *a, **k: seen.append(k.get("doublings", routing.DOUBLINGS)) or real(*a, **k))
    adj = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 2.0), ("c", "d", 2.0), ("a", "c", 5.0)], "u string, v string, cost double")
    starts = spark.createDataFrame([("a", "a", 0.0)], "origin string, state string, cost double")
    assert {r["state"]: r["cost"] for r in routing.cheapest(adj, starts, 4.0).collect()} == {"a": 0.0, "b": 2.0, "c": 4.0} and seen == [0]


def test_rows_over_many_cells_are_not_sent_through_the_driver(spark):
    """Estimates of size do not know what explode() makes of a row, so that Spark sent all cells of all roads to every task."""
    at = lambda x: F.struct(F.lit(x).cast("double").alias("x"), (10.0 * F.col("id")).alias("y"))
    roads = spark.range(700).select(F.col("id").alias("ord"), F.concat(F.lit("e"), "id").alias("edge_id"), F.array(at(0), at(400)).alias("polyline"))
    points = spark.range(500).select(F.col("id").alias("key"), F.lit(50.0).alias("x"), (10.0 * F.col("id") + 1).alias("y"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = spatial.point_segment_pairs(points, spatial.segments(roads), 2.0)
    assert "Broadcast" not in plan(many) and "Broadcast" in plan(spatial.point_segment_pairs(points, spatial.segments(roads.where("ord < 9")), 2.0))
    assert sorted((r["key"], r["edge_id"], r["d2"]) for r in many.collect()) == [(k, f"e{k}", 1.0) for k in range(500)]
    samples = points.select(F.col("key").cast("string").alias("trace_id"), F.lit(0).cast("long").alias("ord"), "x", "y")
    snapped = spatial.snap(samples, roads, 2.0)
    assert "Broadcast" not in plan(snapped)
    assert {(r["trace_id"], r["edge_id"], r["d"]) for r in snapped.collect()} == {(str(k), f"e{k}", 1.0) for k in range(500)}


def test_ways_between_candidates_are_found_by_pairs_of_edges(spark, cross):
    """Every pair of candidates was joined with the ways between their ends, four rows for one, and these were grouped again."""
    from waymesh.session import materialize

    found = materialize(spatial.candidates(make_samples(spark, [("t", 0, 0, -30, 1), ("t", 1, 1, 40, 1), ("t", 2, 2, 60, 2), ("t", 3, 3, 102, 30)]), cross[1], 20.0))
    steps = matching.transitions(found, cross[1])
    assert "Aggregate [trace_id" not in steps._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["ord"], r["from_edge"], r["to_edge"]): r["route"] for r in steps.collect()}
    assert got[0, "cw", "ce"] == 70.0 and got[1, "ce", "ce"] == 20.0
