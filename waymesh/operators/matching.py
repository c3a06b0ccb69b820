"""Hidden-Markov map matching: candidates and transition costs by joins, the best chain by keyed batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymesh.operators.routing import adjacency, cheapest
from waymesh.operators.spatial import beside, candidates
from waymesh.session import materialize

#: Stretches of a trace that are matched together, and samples of a stretch that are.
STRETCHES, BLOCK = 256, 512


def transitions(found: DataFrame, edges: DataFrame, limit: float = 200.0) -> DataFrame:
    """Rows (trace_id, ord, from_edge, to_edge, route) between candidates of successive samples.

    On one edge the route is the difference along it; else the shortest way over the
    ends of both edges, with node distances up to `limit`. Pairs without a way within
    the limit are left out.
    """
    adj = adjacency(edges)
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("start_node_id").alias("node"), F.lit(False).alias("far")), F.struct(F.col("end_node_id").alias("node"), F.lit(True).alias("far")))).alias("e")).select("edge_id", "e.*")
    # only ends of edges that are candidates somewhere are searched from
    nodes = ends.join(found.select("edge_id").distinct(), "edge_id", "left_semi").select(F.col("node").alias("origin")).distinct()
    between = cheapest(adj, nodes.select("origin", F.col("origin").alias("state"), F.lit(0.0).alias("cost")), limit)
    # ways between ends are put together by pairs of edges, of which there are as many as the graph has, not as samples
    a, b = ends.select(F.col("edge_id").alias("from_edge"), F.col("node").alias("origin"), F.col("far").alias("far_a")), ends.select(F.col("edge_id").alias("to_edge"), F.col("node").alias("state"), F.col("far").alias("far_b"))
    ways = between.join(a, "origin").join(b, "state").where("from_edge <> to_edge").groupBy("from_edge", "to_edge").agg(F.collect_list(F.struct("far_a", "far_b", "cost")).alias("ways"))
    x = found.select("trace_id", "ord", F.col("edge_id").alias("from_edge"), F.col("arc").alias("arc_a"), F.col("edge_len").alias("len_a"))
    y = found.select("trace_id", (F.col("ord") - 1).alias("ord"), F.col("edge_id").alias("to_edge"), F.col("arc").alias("arc_b"), F.col("edge_len").alias("len_b"))
    steps = x.join(y, ["trace_id", "ord"])
    out = lambda w: F.when(w["far_a"], F.col("len_a") - F.col("arc_a")).otherwise(F.col("arc_a"))
    into = lambda w: F.when(w["far_b"], F.col("len_b") - F.col("arc_b")).otherwise(F.col("arc_b"))
    other = F.array_min(F.transform("ways", lambda w: out(w) + w["cost"] + into(w)))
    route = F.when(F.col("from_edge") == F.col("to_edge"), F.abs(F.col("arc_b") - F.col("arc_a"))).otherwise(other)
    steps = steps.join(beside(materialize(ways)), ["from_edge", "to_edge"], "left")
    return steps.select("trace_id", "ord", "from_edge", "to_edge", route.alias("route")).where(F.col("route") <= limit)


def hmm_match(samples: DataFrame, edges: DataFrame, radius: float = 20.0, sigma: float = 5.0, limit: float = 200.0, block: int = BLOCK) -> DataFrame:
    """Rows (trace_id, ord, edge_id): each sample's edge on the trace's likeliest chain of edges.

    Up to five candidates within `radius` cost half their squared distance in sigmas;
    a step costs the difference between its route and the straight line. The chain
    starts anew after a sample without candidates or a step without any way. A trace
    whose first sample has no candidate has none at all, and one whose last sample
    has none keeps each sample's nearest edge. Samples without candidates have null, and
    what lies between two of them is matched by itself; if that is more than `block`
    samples, in blocks of so many.
    """
    # candidates and chains are read several times
    found = materialize(candidates(samples, edges, radius))
    steps = transitions(found, edges, limit).groupBy("trace_id", "ord").agg(F.collect_list(F.struct("from_edge", "to_edge", "route")).alias("moves"))
    options = found.groupBy("trace_id", "ord").agg(F.array_sort(F.collect_list(F.struct("rank", "edge_id", "d"))).alias("options"))
    rows = samples.select("trace_id", "ord", "x", "y").join(options, ["trace_id", "ord"], "left")
    walk, whole = Window.partitionBy("trace_id").orderBy("ord"), Window.partitionBy("trace_id")
    has = F.col("options").isNotNull()
    rows = rows.withColumn("part", F.sum((~has).cast("int")).over(walk)).withColumns({"first": F.min_by(has, "ord").over(whole), "last": F.max_by(has, "ord").over(whole), "parts": F.max("part").over(whole)})
    chained = rows.where(has & F.col("first") & F.col("last")).join(steps, ["trace_id", "ord"], "left")
    plain = rows.where(~(has & F.col("first") & F.col("last"))).select("trace_id", "ord", F.when(F.col("first"), F.col("options")[0]["edge_id"]).alias("edge_id"))

    def parts_of(rows: pd.DataFrame) -> tuple[list, list, list]:
        named = [[(c["edge_id"], 0.5 * (c["d"] / sigma) ** 2) for c in o] for o in rows["options"]]
        return named, rows["moves"].tolist(), np.hypot(rows["x"].diff(), rows["y"].diff()).tolist()

    def chains(rows: pd.DataFrame) -> pd.DataFrame:
        """Stretches that are short enough to be matched as they are."""
        rows = rows.sort_values("ord")
        named, moved, gap = parts_of(rows)
        part = rows["part"].to_numpy()
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        chosen: list[str] = []
        for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
            score, back = _forward(named[a:b], moved[a:b], gap[a:b], dict(named[a]))
            chosen += _backward(named[a:b], back, _cheapest(score) if part[a] == rows["parts"].iloc[0] else named[b - 1][0][0])
        return pd.DataFrame({"trace_id": rows["trace_id"], "ord": rows["ord"], "edge_id": chosen})

    place = Window.partitionBy("trace_id", "part").orderBy("ord")
    chained = chained.withColumns({"at": (F.row_number().over(place) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy("trace_id", "part"))})
    chained = materialize(chained)
    # a group is so many stretches of a trace at most
    grouped = chained.where(F.col("n") <= block).groupBy("trace_id", F.floor(F.col("part") / STRETCHES).alias("group"))
    short = grouped.applyInPandas(chains, "trace_id string, ord long, edge_id string")
    return plain.unionByName(short).unionByName(_long_stretches(chained.where(F.col("n") > block), parts_of, block))


def _forward(named: list, moved: list, gap: list, score: dict, anew: bool = True, start: int = 0) -> tuple[dict, list[dict]]:
    """Least costs by edge of the last sample, from costs by edge of sample `start`, and where each came from.

    Where no edge is reached the chain starts anew there; with `anew` off it ends, and
    the costs are empty. There are as many steps back as the chain came far.
    """
    back: list[dict] = [{} for _ in range(start + 1)]
    for k in range(start + 1, len(named)):
        moves: dict[str, list] = {}
        for m in moved[k - 1] if moved[k - 1] is not None else ():
            if m["from_edge"] in score:
                moves.setdefault(m["to_edge"], []).append((score[m["from_edge"]] + abs(gap[k] - m["route"]), m["from_edge"]))
        new, before = {}, {}
        for edge, cost in named[k]:
            if edge in moves:
                best, before[edge] = min(moves[edge])
                new[edge] = best + cost
        if not new and not anew:
            return {}, back
        back.append(before)
        score = new or dict(named[k])
    return score, back


def _backward(named: list, back: list[dict], at: str) -> list[str]:
    """The edges of a chain that ends at an edge; where it began anew, the sample before has its nearest edge."""
    chosen: list[str] = []
    for k in range(len(named) - 1, -1, -1):
        chosen.append(at)
        at = back[k][at] if at in back[k] else named[k - 1][0][0]
    return chosen[::-1]


def _cheapest(score: dict) -> str:
    return min((c, e) for e, c in score.items())[1]


def _long_stretches(rows: DataFrame, parts_of, block: int) -> DataFrame:
    """Rows (trace_id, ord, edge_id) of stretches of any length, in blocks that know only the sample before them.

    A block's costs are a matrix from the edges of that sample to those of its own last
    one, or where the chain from an edge ends, and the costs of chains that start anew
    there. The matrices are applied in order, one at a time, which gives each block the
    costs that it begins with; then blocks find their ways back from each of their last
    edges, and these are followed from the last block to the first.
    """
    key = ["trace_id", "part", "block"]
    own = F.floor(F.col("at") / block)
    lead = F.when(F.col("at") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    wide = materialize(rows.withColumn("block", F.explode(lead)).where((F.col("block") == 0) | (F.col("block") * block <= F.col("n") - 1)))
    costs = "map<string,double>"

    def summary(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        named, moved, gap = parts_of(group)
        if keys[2] == 0:
            found, anew = [{"edge": "", "ends": -1, "costs": _forward(named, moved, gap, dict(named[0]))[0]}], []
        else:
            found = []
            for edge, _ in named[0]:
                score, back = _forward(named, moved, gap, {edge: 0.0}, anew=False)
                found.append({"edge": edge, "ends": -1 if score else len(back), "costs": score})
            places = sorted({x["ends"] for x in found} - {-1})
            anew = [{"ends": k, "costs": _forward(named, moved, gap, dict(named[k]), start=k)[0]} for k in places]
        return pd.DataFrame({"trace_id": [keys[0]], "part": [keys[1]], "block": [keys[2]], "found": [found], "anew": [anew]})

    shape = f"trace_id string, part long, block long, found array<struct<edge:string,ends:int,costs:{costs}>>, anew array<struct<ends:int,costs:{costs}>>"
    matrices = wide.groupBy(*key).applyInPandas(summary, shape)

    def plain(value) -> dict:
        return dict(value) if value is not None else {}

    def applied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score: dict = {}
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.block == 0:
                    out.append({})
                    score = plain(r.found[0]["costs"])
                    continue
                out.append(score)
                alive = [x for x in r.found if x["edge"] in score]
                new: dict = {}
                for x in alive:
                    for edge, cost in plain(x["costs"]).items():
                        new[edge] = min(new.get(edge, np.inf), score[x["edge"]] + cost)
                if not new:
                    last = max(x["ends"] for x in alive)
                    new = next(plain(x["costs"]) for x in r.anew if x["ends"] == last)
                score = new
            yield part[key].assign(begin=out)

    begun = matrices.repartition("trace_id", "part").sortWithinPartitions(*key).mapInPandas(applied, f"trace_id string, part long, block long, begin {costs}")

    def ways(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        named, moved, gap = parts_of(group)
        lead = int(keys[2] > 0)
        score, back = _forward(named, moved, gap, plain(group["begin"].iloc[0]) if lead else dict(named[0]))
        best, found = _cheapest(score), []
        last = group["part"].iloc[0] == group["parts"].iloc[0]
        for edge, _ in named[-1]:
            way = _backward(named, back, edge)
            found.append((*keys, edge, way[0] if lead else None, way[lead:], edge == (best if last else named[-1][0][0])))
        return pd.DataFrame(found, columns=[*key, "end", "into", "way", "chosen"])

    shape = "trace_id string, part long, block long, end string, into string, way array<string>, chosen boolean"
    found = wide.join(begun, key).groupBy(*key).applyInPandas(ways, shape)

    def followed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, block_, want = None, None, None
        for part in parts:
            keep = []
            for r in part.itertuples(index=False):
                if (r.trace_id, r.part) != stretch:
                    stretch, block_, want, after = (r.trace_id, r.part), r.block, None, None
                elif r.block != block_:
                    block_, want = r.block, after
                hit = r.chosen if want is None else r.end == want
                after = r.into if hit else after
                keep.append(hit)
            yield part.loc[keep, [*key, "way"]]

    order = ["trace_id", "part", F.desc("block"), "end"]
    way = found.repartition("trace_id", "part").sortWithinPartitions(*order).mapInPandas(followed, "trace_id string, part long, block long, way array<string>")
    named = way.select("trace_id", "part", "block", F.posexplode("way").alias("k", "edge_id")).select("trace_id", "part", (F.col("block") * block + F.col("k")).alias("at"), "edge_id")
    return rows.select("trace_id", "part", "at", "ord").join(named, ["trace_id", "part", "at"]).select("trace_id", "ord", "edge_id")
