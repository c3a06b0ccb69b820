"""A folder of trace files: bundles of the good ones, errors of the others."""

import json
import pathlib

import pytest

from waymesh.plans import build, datasets


def whole(folder):
    return "".join(f.read_text() for f in sorted(pathlib.Path(folder).glob("part-*")))


@pytest.fixture(scope="module")
def traces(tmp_path_factory):
    folder = tmp_path_factory.mktemp("traces")
    road = [(k, 10.0 * k, 0.5 * (k % 2)) for k in range(12)]
    (folder / "a.csv").write_text("timestamp,x,y\n" + "".join(f"{t},{x},{y}\n" for t, x, y in road))
    # another header, other order of columns and rows, and the same place
    (folder / "b.csv").write_text("﻿ Y , note,X,Timestamp\n" + "".join(f'{y},"n",{x},{t}\n' for t, x, y in reversed(road)) + "\n")
    (folder / "bad.csv").write_text("timestamp,x,y\n0,1,2\n1,oops,3\n")
    (folder / "short.csv").write_text("timestamp,x\n0,1\n")
    (folder / "empty.csv").write_text("\n \n")
    (folder / "head.csv").write_text("timestamp,x,y\n")
    (folder / "one.csv").write_text("timestamp,x,y\n0,5,5\n")
    (folder / "other.txt").write_text("timestamp,x,y\n0,5,5\n")
    return folder


def test_one_bad_file_does_not_stop_the_others(spark, traces, tmp_path):
    got = {r["trace_id"]: r for r in datasets.process_dataset(spark, str(traces), str(tmp_path), 52.0, 13.0, prefix="d").collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "b": "ok", "bad": "failed", "short": "failed", "empty": "failed", "head": "failed", "one": "failed"}
    assert got["bad"]["error"] == "x is no number: oops" and got["short"]["error"] == "missing columns: y"
    assert got["empty"]["error"] == got["head"]["error"] == "no samples" and got["one"]["error"] == "the samples give no edges"
    assert got["a"]["samples"] == got["b"]["samples"] == 12 and got["a"]["edges"] == got["b"]["edges"] >= 1
    bundles = tmp_path / "bundles"
    assert sorted(x.name for x in bundles.iterdir() if x.is_dir()) == ["trace_id=a", "trace_id=b"]
    read = lambda t, d: json.loads(whole(bundles / f"trace_id={t}" / f"document={d}"))
    for t in "ab":
        graph = read(t, "graph")
        assert graph["schema_version"] == 1 and graph["metadata"]["dataset"] == f"d_{t}" and graph["nodes"][0]["id"] == "n0"
        names = {n["id"] for n in graph["nodes"]}
        assert all({e["start_node_id"], e["end_node_id"]} <= names for e in graph["edges"]) and graph["edges"][0]["id"] == "e0"
        assert len(read(t, "nav")["edges"]) == len(graph["edges"]) == got[t]["edges"]
        features = read(t, "map")["features"]
        assert {f["properties"]["kind"] for f in features} >= {"trajectory", "centerline", "node", "lane_boundary_left"}
        assert read(t, "manifest")["counts"] == {"samples": 12, "nodes": got[t]["nodes"], "edges": got[t]["edges"]}
    line = lambda t: [[round(p[c], 6) for c in "xy"] for e in read(t, "graph")["edges"] for p in e["polyline"]]
    assert line("a") == line("b")
    assert len(whole(tmp_path / "manifest").splitlines()) == 7
    with pytest.raises(RuntimeError, match="missing|number|samples|edges"):
        datasets.process_dataset(spark, str(traces), str(tmp_path / "no"), continue_on_error=False)
    assert not (tmp_path / "no").exists()


def test_a_trace_is_built_as_if_alone(spark, traces):
    samples, _ = datasets.read_dataset(spark, str(traces))
    far = samples.where("trace_id = 'b'").selectExpr("'far' as trace_id", "ord", "t", "x + 4e6 as x", "y - 7e6 as y")
    each = build.build_each(samples.where("trace_id in ('a', 'b')").unionByName(far))
    alone = build.build_graph(samples.where("trace_id = 'a'"))
    spots = lambda df: sorted((round(r["x"], 6), round(r["y"], 6), r["degree"]) for r in df.collect())
    assert spots(each["nodes"].where("trace_id = 'a'")) == spots(each["nodes"].where("trace_id = 'b'")) == spots(alone["nodes"])
    assert spots(each["nodes"].where("trace_id = 'far'").selectExpr("x - 4e6 as x", "y + 7e6 as y", "degree")) == spots(alone["nodes"])
