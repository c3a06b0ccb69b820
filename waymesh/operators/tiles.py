"""Routes over graphs of any size, tile by tile: what lies within a tile is searched by the task that has it.

States are dealt into tiles of near states. A round searches every tile of an origin that
is entered more cheaply than before, from all of its entries, and sends only what leaves
the tile to the next round; so rounds are as many as tiles on a way, not as moves, and
tables hold states at tiles' edges, not all that a search settles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.plans.numbering import numbered
from waymesh.session import materialize, shuffle_partitions

#: States of a tile, and origins that a group searches in it.
TILE, ORIGINS = 4096, 128
#: How much a budget grows each time that it does not suffice.
MORE = 2.0

LABEL = ["cost", "hops", "step", "via"]
_FOUND = "kind string, origin string, tile long, state string, cost double, hops long, step string, via string, root string"


def tiled(places: DataFrame, size: int = TILE) -> DataFrame:
    """Rows (state, x, y, tile): states in strips by x, and these by y in tiles of at most `size` states."""
    n = places.count()
    strips = max(1, math.isqrt(math.ceil(n / size)))
    wide = math.ceil(max(n, 1) / strips)
    placed = numbered(places, "x", "state").withColumn("strip", F.floor(F.col("place") / wide)).drop("place")
    return numbered(placed, "strip", "y", "state").select("state", "x", "y", F.floor(F.col("place") / size).cast("long").alias("tile"))


def walked(seeds: list[tuple], graph: dict, box: tuple, least: float, limit: float, wanted: dict, alone: bool) -> tuple[dict, dict, float]:
    """Labels (cost, hops, step, via) and states before, from seeds (state, label, x, y), and the least bound beyond the limit.

    graph has rows (v, x, y, w, step) by state; states without are not gone on from. If all
    targets have a state in `wanted` (target by state), nothing is looked at that is dearer than all of them.
    """
    x0, x1, y0, y1 = box
    labels: dict[str, tuple] = {}
    back: dict[str, str] = {}
    heap: list[tuple] = []
    beyond, open_, known = math.inf, set(wanted.values()) if alone else {None}, {}

    def bound(cost: float, x: float, y: float) -> float:
        dx = x0 - x if x < x0 else x - x1 if x > x1 else 0.0
        dy = y0 - y if y < y0 else y - y1 if y > y1 else 0.0
        return cost + least * math.sqrt(dx * dx + dy * dy)

    def reached(state: str) -> float:
        target, cost = wanted[state], labels[state][0]
        open_.discard(target)
        known[target] = min(cost, known.get(target, cost))
        return limit if open_ else min(limit, max(known.values()) * (1 + 1e-9) + 1e-9)

    for state, label, x, y in seeds:
        f = bound(label[0], x, y)
        if f > limit:
            beyond = min(beyond, f)
            continue
        labels[state] = label
        heappush(heap, (f, label, state))
        if state in wanted:
            limit = reached(state)
    while heap:
        f, label, state = heappop(heap)
        if f > limit:
            break
        if labels[state] is not label:
            continue
        cost, hops = label[0], label[1] + 1
        for v, x, y, w, step in graph.get(state, ()):
            new, old = (cost + w, hops, step, state), labels.get(v)
            if old is not None and old <= new:
                continue
            f = bound(new[0], x, y)
            if f > limit:
                beyond = min(beyond, f)
                continue
            labels[v], back[v] = new, state
            heappush(heap, (f, new, v))
            if v in wanted:
                limit = reached(v)
    return labels, back, beyond


def _graph(moves: pd.DataFrame) -> tuple[dict, dict]:
    graph: dict[str, list] = {}
    own = dict(zip(moves["v"], moves["own"], strict=True))
    for u, *rest in moves[["u", "v", "x", "y", "w", "name"]].itertuples(index=False, name=None):
        graph.setdefault(u, []).append(rest)
    return graph, own


def _origins(rows: pd.DataFrame, graph: dict, least: float) -> Iterator[tuple]:
    """Each origin of a group with its walk: origin, the rows that ask for states, labels, states before, bound beyond."""
    for origin, part in rows.groupby("origin", sort=False):
        entry = part["asked"].isna()
        seeds = [(s, tuple(label), x, y) for s, x, y, *label in part.loc[entry, ["state", "x", "y", *LABEL]].itertuples(index=False, name=None)]
        asked = part[~entry]
        one = part.iloc[0]
        inside = set(asked.loc[asked["asked"] == "t", "state"])
        yield origin, asked, *walked(seeds, graph, (one["x0"], one["x1"], one["y0"], one["y1"]), least, one["reach"], {s: s for s in inside}, len(inside) == one["n"])


def _dealt(rows: DataFrame, moves: DataFrame, searched, schema: str) -> DataFrame:
    """Rows of (origin, tile) with the moves of the tile, so many origins at a time."""
    parts = rows.groupBy("tile").agg(F.ceil(F.approx_count_distinct("origin") / ORIGINS).cast("int").alias("parts"))
    parts = materialize(parts)
    n = shuffle_partitions(rows.sparkSession)
    left = rows.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("origin"), F.col("parts")).cast("int")).drop("parts")
    right = moves.join(parts, "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # names of their own, as both sides may come from one table
    right = right.select(F.col("tile").alias("_tile"), F.col("part").alias("_part"), "u", "v", "x", "y", "w", "name", "own")
    a, b = left.repartition(n, "tile", "part").groupBy("tile", "part"), right.repartition(n, "_tile", "_part").groupBy("_tile", "_part")
    return a.cogroup(b).applyInPandas(searched, schema)


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least label of each key; of equal ones that of the last round, whose way back is the one that counts."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*LABEL, -F.col("round"))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def tile_routes(moves: DataFrame, starts: DataFrame, places: DataFrame, targets: DataFrame, boxes: DataFrame, least: float, size: int = TILE, max_rounds: int = 100_000) -> DataFrame:
    """Rows (origin, state, cost, hops, steps) of the targets that a way leads to: cheapest ways over moves (u, v, cost, step).

    starts: (origin, state, cost), and step where reaching the start is a move. targets:
    (origin, target, state); a target's cost is that of the cheapest of its states, and
    others have theirs only where they are within it. places: (state, x, y). boxes: (origin,
    x0, x1, y0, y1, budget) around the targets; no move costs less than `least` for a metre.
    Equal costs go by fewest moves, then by the last move's and state's name.
    """
    tiles = materialize(tiled(places, size))
    to = tiles.select(F.col("state").alias("v"), "x", "y", F.col("tile").alias("to"))
    moves = moves.groupBy("u", "v").agg(F.min(F.struct(F.col("cost").alias("w"), F.col("step").alias("name"))).alias("m")).select("u", "v", "m.*")
    moves = moves.join(tiles.select(F.col("state").alias("u"), "tile"), "u").join(to, "v")
    moves = materialize(moves.withColumn("own", F.col("to") == F.col("tile")).drop("to"))
    first = F.col("step") if "step" in starts.columns else F.lit("")
    text, none = F.lit("").cast("string"), F.lit(None).cast("string")
    begun = starts.groupBy("origin", "state").agg(F.min(F.struct("cost", first.alias("step"))).alias("b")).join(boxes.select("origin"), "origin")
    begun = begun.select("origin", "state", none.cast("long").alias("src"), "b.cost", F.when(F.col("b.step") == "", 0).otherwise(1).cast("long").alias("hops"), "b.step", text.alias("via"), none.alias("root"), F.lit(0).alias("round"))
    entries = materialize(begun.join(tiles, "state"))
    wanted = materialize(targets.join(tiles, "state").select("origin", "target", "state", "tile"))
    counted = wanted.groupBy("origin").agg(F.count_distinct("state").alias("n"), F.count_distinct("target").alias("goals"))
    boxes = materialize(boxes.join(counted, "origin"))
    asks = wanted.select("origin", "state", "tile").distinct()
    ends: DataFrame | None = None
    pruned: DataFrame | None = None

    def rows_of(active: DataFrame, asked: DataFrame, boxes: DataFrame) -> DataFrame:
        """Entries of the active (origin, tile), the states asked for there, and the origin's box."""
        keep = ["origin", "tile", "state", "x", "y", *LABEL]
        seeds = entries.join(active, ["origin", "tile"], "left_semi").select(*keep, none.alias("asked"))
        box = boxes.select("origin", "x0", "x1", "y0", "y1", "reach", "n")
        return seeds.unionByName(asked.join(active, ["origin", "tile"], "left_semi"), allowMissingColumns=True).join(box, "origin")

    def search(keys: tuple, rows: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        graph, own = _graph(moves)
        found = []
        for origin, asked, labels, back, beyond in _origins(rows, graph, least):
            inside = set(asked["state"])
            for state, label in labels.items():
                out = not own.get(state, True)
                if out or state in inside:
                    root = state
                    while root in back:
                        root = back[root]
                    found.append(("x" if out else "t", origin, keys[0], state, *label, root))
            found.append(("p", origin, keys[0], "", beyond, 0, "", "", ""))
        return pd.DataFrame(found, columns=[c.split()[0] for c in _FOUND.split(", ")])

    def reach(boxes: DataFrame) -> DataFrame:
        """Boxes with how far it makes sense to look: the budget, or the dearest target if each is known."""
        plain = boxes.select("origin", "x0", "x1", "y0", "y1", "budget", "n", "goals")
        if ends is None:
            return plain.withColumns({"most": F.lit(None).cast("double"), "reach": F.col("budget")})
        known = wanted.join(ends, ["origin", "state"]).groupBy("origin", "target").agg(F.min("cost").alias("c")).groupBy("origin").agg(F.max("c").alias("c"), F.count("*").alias("k"))
        most = F.when(F.col("k") == F.col("goals"), F.col("c"))
        return plain.join(known, "origin", "left").withColumn("most", most).drop("c", "k").withColumn("reach", F.least("budget", F.col("most") * (1 + 1e-9) + 1e-9))

    active = entries.select("origin", "tile").distinct()
    boxes = reach(boxes)
    for k in range(1, max_rounds):
        asked = asks.withColumn("asked", F.lit("t"))
        found = materialize(_dealt(rows_of(active, asked, boxes), moves, search, _FOUND).withColumn("round", F.lit(k)))
        hits = found.where("kind = 't'").select("origin", "state", "tile", *LABEL, "root", "round")
        ends = materialize(_best(hits if ends is None else ends.unionByName(hits), ["origin", "state"]))
        left = found.where("kind = 'p'").select("origin", "tile", F.col("cost").alias("bound"), "round")
        pruned = left if pruned is None else pruned.unionByName(left).groupBy("origin", "tile").agg(F.max_by("bound", "round").alias("bound"), F.max("round").alias("round"))
        pruned = materialize(pruned)
        over = found.where("kind = 'x'").select("origin", "state", F.col("tile").alias("src"), *LABEL, "root", "round")
        over = over.join(tiles, "state")
        key = lambda p: F.struct(*(F.col(c) for c in LABEL)).alias(p)
        before = entries.select("origin", "state", key("old"))
        entries = materialize(_best(entries.unionByName(over), ["origin", "state"]))
        new = entries.where(F.col("round") == k).join(before, ["origin", "state"], "left").where(F.col("old").isNull() | (F.struct(*LABEL) < F.col("old")))
        active = materialize(new.select("origin", "tile").distinct())
        boxes = materialize(reach(boxes))
        if active.isEmpty():
            # what is left where a target is still open: its budget grows
            rest = pruned.join(boxes.where(F.col("most").isNull() | (F.col("most") > F.col("budget"))).select("origin", "budget"), "origin").where(F.col("bound") < math.inf)
            grown = materialize(rest.groupBy("origin").agg(F.greatest(F.max("budget") * MORE, F.min("bound") * (1 + 1e-9)).alias("more")))
            if grown.isEmpty():
                break
            active = materialize(rest.join(grown, "origin").where("bound <= more").select("origin", "tile"))
            boxes = materialize(reach(boxes.join(grown, "origin", "left").withColumn("budget", F.coalesce("more", "budget"))))
    else:
        raise RuntimeError("the search did not end")

    # of each target the cheapest state, and the entries on the way to it, back to the start
    best = wanted.join(ends, ["origin", "state"]).groupBy("origin", "target").agg(F.min(F.struct("cost", "hops", "state")).alias("b"))
    chosen = best.select("origin", F.col("b.state").alias("state")).distinct()
    chosen = materialize(ends.join(chosen, ["origin", "state"]).select("origin", F.col("state").alias("end"), "state", "tile", "cost", "hops", "root"))
    legs, at, heads = [chosen.select("origin", "end", "state", "tile", "hops")], chosen, []
    while True:
        at = materialize(at.select("origin", "end", F.col("root").alias("state")).join(entries.select("origin", "state", F.col("src").alias("tile"), "hops", "step", "root"), ["origin", "state"]))
        heads.append(at.where("root is null and hops > 0").select("origin", "end", "hops", F.array("step").alias("steps")))
        at = at.where("root is not null")
        if at.isEmpty():
            break
        legs.append(at.select("origin", "end", "state", "tile", "hops"))
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    every = materialize(every)

    def follow(keys: tuple, rows: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        graph, _ = _graph(moves)
        found = []
        for origin, asked, labels, back, _ in _origins(rows, graph, least):
            for state, end in asked.loc[asked["asked"] == "f", ["state", "end"]].itertuples(index=False, name=None):
                hops, steps = labels[state][1], []
                while state in back:
                    steps.append(labels[state][2])
                    state = back[state]
                found.append((origin, end, hops, steps[::-1]))
        return pd.DataFrame(found, columns=["origin", "end", "hops", "steps"])

    asked = every.withColumn("asked", F.lit("f")).drop("hops").unionByName(asks.withColumn("asked", F.lit("t")), allowMissingColumns=True)
    rows = rows_of(every.select("origin", "tile").distinct(), asked, boxes)
    pieces = _dealt(rows, moves, follow, "origin string, end string, hops long, steps array<string>")
    for head in heads:
        pieces = pieces.unionByName(head)
    steps = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hops", "steps"))), lambda s: s["steps"]))
    ways = pieces.where(F.size("steps") > 0).groupBy("origin", "end").agg(steps.alias("steps"))
    return chosen.select("origin", "end", "cost", "hops").join(ways, ["origin", "end"], "left").select("origin", F.col("end").alias("state"), "cost", "hops", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))
