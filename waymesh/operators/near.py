"""Routes of pairs that lie near each other: a task has the origins of a cell and the network that their budgets reach.

Edges alone are shuffled, and moves between turns or lanes are made of them as a search comes to them. What is
found within the budget is settled in one round, and so is what hangs together with nothing beyond it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.operators.cells import NODES, ROWS
from waymesh.operators.spatial import beside, cell
from waymesh.operators.tiles import MORE, ORIGINS, walked
from waymesh.plans.components import union_pairs
from waymesh.session import materialize, shuffle_partitions

#: Squares of a cell's side, and squares that an origin may reach; what needs more is not near.
SQUARES, REACHED = 4, 1024
_FOUND = "kind string, origin string, target string, cost double, steps array<string>"


class Moves:
    """Moves of a network's rows by state, made as they are asked for: states are nodes, or edge/direction where turns count, or edge/direction/lane."""

    def __init__(self, rows: pd.DataFrame, turning: bool, swap_cost: float | None) -> None:
        self.turning, self.swap, self.made = turning, swap_cost, {}
        self.out: dict[str, list] = {}
        self.end: dict[str, str] = {}
        self.into: dict[str, list] = {}
        self.no, self.only = set(), {}
        for edge, direction, u, v, cost, n, x, y, rule in rows[["edge_id", "direction", "u", "v", "cost", "n", "vx", "vy", "rule"]].itertuples(index=False, name=None):
            on = f"{edge}/{direction}"
            if isinstance(rule, str):
                kind, to = rule.split("/", 1)
                self.only.setdefault((u, on), set())
                if kind == "no":
                    self.no.add((u, on, f"{v}/{to}"))
                else:
                    self.only[u, on].add(f"{v}/{to}")
                if kind == "no" and not self.only[u, on]:
                    del self.only[u, on]
                continue
            self.out.setdefault(u, []).append((on, v, x, y, cost, int(n)))
            self.end[on] = v
            self.into.setdefault(v, []).append((on, int(n)))

    def names(self, on: str, n: int) -> list[str]:
        return [on] if self.swap is None else [f"{on}/{k}" for k in range(n)]

    def states(self, node: str) -> list[str]:
        """The states that end at a node."""
        return [s for on, n in self.into.get(node, ()) for s in self.names(on, n)] if self.turning else [node]

    def seeds(self, node: str, x: float, y: float) -> list[tuple]:
        if not self.turning:
            return [(node, (0.0, 0, "", ""), x, y)]
        return [(s, (cost, 1, s, ""), vx, vy) for on, _, vx, vy, cost, n in self.out.get(node, ()) for s in self.names(on, n)]

    def get(self, state: str, default: tuple = ()) -> list[tuple]:
        """Rows (state, x, y, cost, step) of the moves from a state."""
        if state not in self.made:
            self.made[state] = self._after(state)
        return self.made[state]

    def _after(self, state: str) -> list[tuple]:
        if not self.turning:
            return [(v, x, y, w, on) for on, v, x, y, w, _ in self.out.get(state, ())]
        before, lane = (state, 0) if self.swap is None else state.rsplit("/", 1)
        node, found = self.end[before], []
        right = self.only.get((node, before))
        for on, _, x, y, w, n in self.out.get(node, ()):
            if (node, before, on) in self.no or (right is not None and on not in right):
                continue
            for k, s in enumerate(self.names(on, n)):
                found.append((s, x, y, w if self.swap is None or n <= 1 or k == int(lane) else w + self.swap, s))
        return found


def _parts(rows: pd.DataFrame, square: float, box: tuple) -> tuple[dict, set]:
    """The part of the network that each node hangs together with, and parts from which a row leads out of the box of squares."""
    ways = rows[rows["rule"].isna()]
    names = pd.Index(pd.unique(pd.concat((ways["u"], ways["v"]))))
    a, b = names.get_indexer(ways["u"]), names.get_indexer(ways["v"])
    root = union_pairs(len(names), a, b) if len(names) else np.zeros(0, int)
    x, y = np.floor(ways["vx"].to_numpy(float) / square), np.floor(ways["vy"].to_numpy(float) / square)
    out = (x < box[0]) | (x > box[1]) | (y < box[2]) | (y > box[3])
    return dict(zip(names, root.tolist(), strict=True)), set(root[a[out]].tolist())


def near_routes(adj: DataFrame, pairs: DataFrame, nodes: DataFrame, first: float, turning: bool = False, swap_cost: float | None = None, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Routes (from_node, to_node, cost, edges) of pairs of different nodes, and the pairs that are not near enough to be settled here.

    adj: (edge_id, direction, u, v, cost, n), n being the lanes, which count with a swap_cost. rules: (u, edge_id,
    direction, v, rule) with the junction, the edge gone on to and no or only with its direction. Budgets
    begin at `first` times the straight line and grow; None where no distance bounds what moves cost.
    """
    # nodes are never sent to all tasks, as estimates do not know how many rows others are made of
    at = lambda c, p: nodes.select(F.col("id").alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).hint("merge")
    rows = materialize(adj.select("edge_id", "direction", "u", "v", "cost", "n").join(at("u", "u"), "u", "left").join(at("v", "v"), "v", "left"))
    apart = F.sqrt((F.col("ux") - F.col("vx")) ** 2 + (F.col("uy") - F.col("vy")) ** 2)
    box = [f(c).alias(f"{g}{d}") for d, c in (("x", "ux"), ("y", "uy")) for g, f in (("least", F.min), ("most", F.max))]
    lost = F.count(F.when(apart.isNull() | F.col("cost").isNull() | (F.col("cost") < 0), 1))
    facts = rows.agg(F.min(F.when(apart > 0, F.col("cost") / apart)).alias("rate"), F.avg("cost").alias("unit"), lost.alias("lost"), F.count("*").alias("n"), *box).first()
    if facts["lost"] or not facts["rate"] or facts["rate"] <= 0:
        return None
    least = facts["rate"] * (1 - 1e-9)
    area = (facts["mostx"] - facts["leastx"]) * (facts["mosty"] - facts["leasty"])
    size = max(1.0, math.sqrt(area * 3 * NODES / facts["n"]))
    square, few = size / SQUARES, ROWS if not turning else ROWS // 4
    rows = rows.withColumn("rule", F.lit(None).cast("string"))
    if rules is not None:
        rows = rows.unionByName(rules.join(at("u", "u"), "u"), allowMissingColumns=True)
    rows = rows.withColumns({"gx": cell(F.col("ux"), square), "gy": cell(F.col("uy"), square)})
    per_square = materialize(rows.groupBy("gx", "gy").agg(F.count("*").alias("rows")))
    wanted = pairs.where("from_node <> to_node").select(F.col("from_node").alias("origin"), F.col("to_node").alias("target")).distinct()
    wanted = wanted.join(at("origin", "o"), "origin").join(at("target", "t"), "target")
    far = F.max(F.sqrt((F.col("tx") - F.col("ox")) ** 2 + (F.col("ty") - F.col("oy")) ** 2))
    sides = [f(f"t{c}").alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]
    started = wanted.groupBy("origin", "ox", "oy").agg(F.collect_list("target").alias("targets"), *sides, F.greatest(first * least * far, F.lit(facts["unit"])).alias("budget"))
    begun, settled, rest = materialize(started), [], []
    n = shuffle_partitions(adj.sparkSession)

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left):
            one = left.iloc[0]
            moves = Moves(right, turning, swap_cost)
            parts, leading = _parts(right, square, (one["gx0"], one["gx1"], one["gy0"], one["gy1"]))
            for origin, ox, oy, targets, x0, x1, y0, y1, budget in left[["origin", "ox", "oy", "targets", "x0", "x1", "y0", "y1", "budget"]].itertuples(index=False, name=None):
                own = parts.get(origin)
                if own is None:
                    continue
                # what hangs together with nothing outside is all that can be reached
                some = [t for t in targets if own in leading or parts.get(t) == own]
                if not some:
                    continue
                ends = {t: moves.states(t) for t in some}
                goal = {s: t for t, states in ends.items() for s in states}
                labels, back, beyond = walked(moves.seeds(origin, ox, oy), moves, (x0, x1, y0, y1), least, budget, goal, all(ends.values()))
                for t, states in ends.items():
                    best = min(((*labels[s][:2], s) for s in states if s in labels), default=None)
                    if best is None:
                        if beyond < math.inf:
                            found.append(("more", origin, t, beyond, []))
                        continue
                    state, steps = best[2], []
                    while state in back:
                        steps.append(labels[state][2])
                        state = back[state]
                    found.append(("found", origin, t, best[0], (steps + [labels[state][2]] * (labels[state][1] > 0))[::-1]))
        return pd.DataFrame(found, columns=["kind", "origin", "target", "cost", "steps"])

    while True:
        # a way that goes beyond the origin and the targets comes back as far
        half = F.col("budget") / least * (0.5 + 1e-9)
        reach = {f"g{c}{k}": cell(f(f"o{c}", f"{c}{k}") + (half if k else -half), square) for c in "xy" for k, f in enumerate((F.least, F.greatest))}
        placed = begun.withColumns({**reach, "cx": cell(F.col("ox"), size), "cy": cell(F.col("oy"), size)})
        fits = (F.col("gx1") - F.col("gx0") + 1.0) * (F.col("gy1") - F.col("gy0") + 1.0) <= REACHED
        rest.append(placed.where(~fits).select("origin", "targets"))
        placed = placed.where(fits)
        regions = placed.groupBy("cx", "cy").agg(*(f(c).alias(c) for c, f in (("gx0", F.min), ("gx1", F.max), ("gy0", F.min), ("gy1", F.max))), F.ceil(F.count("*") / ORIGINS).cast("int").alias("parts"))
        squares = regions.withColumn("gx", F.explode(F.sequence("gx0", "gx1"))).withColumn("gy", F.explode(F.sequence("gy0", "gy1")))
        load = squares.join(per_square.hint("merge"), ["gx", "gy"]).groupBy("cx", "cy").agg(F.sum("rows").alias("rows"))
        regions = materialize(regions.join(load, ["cx", "cy"], "left").withColumn("fits", F.coalesce("rows", F.lit(0)) <= few))
        placed = placed.drop("gx0", "gx1", "gy0", "gy1").join(beside(regions), ["cx", "cy"])
        rest.append(placed.where("not fits").select("origin", "targets"))
        left = placed.where("fits").withColumn("part", F.pmod(F.xxhash64("origin"), F.col("parts")).cast("int")).drop("parts", "rows", "fits")
        squares = regions.where("fits").withColumn("gx", F.explode(F.sequence("gx0", "gx1"))).withColumn("gy", F.explode(F.sequence("gy0", "gy1"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # names of their own, as both sides may come from one table
        squares = beside(squares.select("gx", "gy", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("part").alias("_part")))
        right = rows.join(squares, ["gx", "gy"]).drop("gx", "gy", "ux", "uy")
        a, b = left.repartition(n, "cx", "cy", "part").groupBy("cx", "cy", "part"), right.repartition(n, "_cx", "_cy", "_part").groupBy("_cx", "_cy", "_part")
        found = materialize(a.cogroup(b).applyInPandas(searched, _FOUND))
        settled.append(found.where("kind = 'found'"))
        more = found.where("kind = 'more'").groupBy("origin").agg(F.collect_list("target").alias("targets"), F.min("cost").alias("beyond"))
        begun = materialize(begun.drop("targets").join(more, "origin").withColumn("budget", F.greatest(F.col("budget") * MORE, F.col("beyond") * (1 + 1e-9))).drop("beyond"))
        if begun.isEmpty():
            break
    every = settled[0]
    for df in settled[1:]:
        every = every.unionByName(df)
    far_away = rest[0]
    for df in rest[1:]:
        far_away = far_away.unionByName(df)
    ways = every.select(F.col("origin").alias("from_node"), F.col("target").alias("to_node"), "cost", F.col("steps").alias("edges"))
    return ways, materialize(far_away.select(F.col("origin").alias("from_node"), F.explode("targets").alias("to_node")))
