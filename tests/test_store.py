import os

import pytest

from waymesh.plans import store
from waymesh.plans.build import update_graph

POLY = "array<struct<x:double,y:double>>"


def make_graph(spark, points, ways):
    """Nodes of {id: (x, y)} and straight edges of (id, start, end)."""
    nodes = spark.createDataFrame([(i, k, float(x), float(y)) for k, (i, (x, y)) in enumerate(points.items())], "id string, ord long, x double, y double")
    line = lambda *ids: [tuple(map(float, points[i])) for i in ids]
    rows = [(k, i, a, b, line(a, b), f"road {i}") for k, (i, a, b) in enumerate(ways)]
    return {"nodes": nodes, "edges": spark.createDataFrame(rows, f"ord long, edge_id string, start_node_id string, end_node_id string, polyline {POLY}, osm_name string")}


def make_samples(spark, rows):
    return spark.createDataFrame([(str(t), k, float(k), float(x), float(y)) for t, k, x, y in rows], "trace_id string, ord long, t double, x double, y double")


def town(spark, far=5000):
    """Roads around n0, with two nodes 12 m apart, and a road far away."""
    points = {"n0": (0, 0), "n1": (100, 0), "n2": (0, 100), "n3": (-100, 0), "n4": (0, -100), "n5": (200, 6), "n6": (200, -6), "n7": (300, 60), "n8": (300, -60), "n9": (far, far), "n10": (far + 90, far)}
    ways = [("e0", "n0", "n1"), ("e1", "n0", "n2"), ("e2", "n0", "n3"), ("e3", "n0", "n4"), ("e4", "n5", "n7"), ("e5", "n6", "n8"), ("e6", "n9", "n10")]
    return make_graph(spark, points, ways)


#: Along e0; across it; from the end of e1 on; to the middle between n5 and n6, which thereby become one.
TRACES = [("on", k, 10 + 8 * k, 1) for k in range(10)] + [("over", k, 60, 10 * k - 60) for k in range(13)]
TRACES += [("on_north", k, 2, 104 + 10 * k) for k in range(12)] + [("joins", k, 120 + 10 * k, 0) for k in range(9)]


def drawn(graph):
    """Edges without ids: ends by place, vertices, count and attribute."""
    where = {r["id"]: (round(r["x"], 6), round(r["y"], 6)) for r in graph["nodes"].collect()}
    rows = graph["edges"].collect()
    return sorted((where[r["start_node_id"]], where[r["end_node_id"]], [(round(q["x"], 6), round(q["y"], 6)) for q in r["polyline"]], r["trace_observation_count"], str(r["osm_name"])) for r in rows)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_updates_touch_their_tiles_alone(spark, tmp_path, monkeypatch):
    path, graph = str(tmp_path / "store"), town(spark)
    store.create_store(graph, path, 60.0)
    before = files(path)
    far = {f for f in before if "tile=t83_" in f and "/edges/" in f}
    assert far
    store.update_store(spark, path, make_samples(spark, TRACES))
    after = files(path)
    assert all(after.get(f) == before[f] for f in far) and set(before) - set(after)  # others are written anew
    nodes, edges = update_graph(graph["nodes"], graph["edges"], make_samples(spark, TRACES))
    got = store.read_store(spark, path)
    assert drawn(got) == drawn({"nodes": nodes, "edges": edges})
    merged = [r for r in got["edges"].collect() if r["edge_id"] in ("e4", "e5")]
    assert {r["start_node_id"] for r in merged} == {"n5"}
    ids = [r["edge_id"] for r in got["edges"].collect()]
    assert len(ids) == len(set(ids)) and not os.path.exists(f"{path}/staged")
    assert got["nodes"].count() == got["nodes"].select("id").distinct().count()
    # ids of a later batch go on, though it is elsewhere; more tiles than are named in a filter are joined
    monkeypatch.setattr(store, "NAMED", 1)
    store.update_store(spark, path, make_samples(spark, [("new", k, -3000 + 10 * k, 70) for k in range(9)]))
    later = [r["edge_id"] for r in store.read_store(spark, path)["edges"].collect()]
    assert set(later) - set(ids) == {f"e{max(int(i[1:]) for i in ids) + 1}"} and len(later) == len(ids) + 1
    with pytest.raises(ValueError):
        store.create_store(graph, path)


def test_an_interrupted_update_is_finished(spark, tmp_path, monkeypatch):
    path, graph = str(tmp_path / "store"), town(spark)
    store.create_store(graph, path, 60.0)
    write, calls = store._write, []

    def fails(df, where, *rest):
        calls.append(where)
        if where == f"{path}/edges":
            raise OSError("lost")
        write(df, where, *rest)

    monkeypatch.setattr(store, "_write", fails)
    with pytest.raises(OSError):
        store.update_store(spark, path, make_samples(spark, TRACES))
    assert calls[-1] == f"{path}/edges"
    monkeypatch.setattr(store, "_write", write)
    assert store.settle(spark, path) and not store.settle(spark, path)
    nodes, edges = update_graph(graph["nodes"], graph["edges"], make_samples(spark, TRACES))
    assert drawn(store.read_store(spark, path)) == drawn({"nodes": nodes, "edges": edges})


def test_a_store_without_lines_or_edges(spark, tmp_path):
    path, graph = str(tmp_path / "store"), town(spark)
    store.create_store(graph, path)
    before = files(path)
    store.update_store(spark, path, make_samples(spark, [("one", 0, 5, 5)]))
    assert files(path) == before
    with pytest.raises(ValueError):
        store.create_store({"nodes": graph["nodes"], "edges": graph["edges"].limit(0)}, str(tmp_path / "none"))
