"""Routing as relational fixpoints: adjacency, costs, turn rules, cheapest costs, service areas, paths.

A search keeps the cheapest cost of every (origin, state) and joins only what the last
round improved with the adjacency, so many origins are searched at once and a round
is one shuffle. States are nodes, edges with a direction where turns matter, or also
with a lane. Each state remembers the move that reached it, from which routes are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymesh.functions.geometry import polyline_length
from waymesh.operators.cells import areas
from waymesh.operators.near import near_routes
from waymesh.operators.tiles import TILE, tile_routes
from waymesh.plans.components import connected_components
from waymesh.session import materialize


def adjacency(edges: DataFrame, respect_oneway: bool = False) -> DataFrame:
    """Rows (u, v, edge_id, direction, cost): each edge both ways, a self-loop once.

    One-way tags count only on request (column osm_oneway: yes, true, 1 or -1).
    """
    base = edges.withColumn("cost", polyline_length("polyline"))
    ahead = base.select(F.col("start_node_id").alias("u"), F.col("end_node_id").alias("v"), "edge_id", F.lit("forward").alias("direction"), "cost", *_oneway(base))
    back = base.where("start_node_id <> end_node_id").select(F.col("end_node_id").alias("u"), F.col("start_node_id").alias("v"), "edge_id", F.lit("reverse").alias("direction"), "cost", *_oneway(base))
    out = ahead.unionByName(back)
    if respect_oneway and "osm_oneway" in edges.columns:
        tag = F.lower(F.trim(F.coalesce("osm_oneway", F.lit(""))))
        out = out.where(~((tag.isin("yes", "true", "1") & (F.col("direction") == "reverse")) | ((tag == "-1") & (F.col("direction") == "forward"))))
    return out.drop("osm_oneway")


def _both_ways(edges: DataFrame, respect_oneway: bool = False) -> DataFrame:
    """Rows (edge_id, u, v, cost, ahead, back) of edges once, with the directions that `adjacency` has."""
    tag = F.lower(F.trim(F.coalesce("osm_oneway", F.lit("")))) if respect_oneway and "osm_oneway" in edges.columns else F.lit("")
    ends = [F.col("start_node_id").alias("u"), F.col("end_node_id").alias("v")]
    return edges.select("edge_id", *ends, polyline_length("polyline").alias("cost"), (tag != "-1").alias("ahead"), (~tag.isin("yes", "true", "1")).alias("back"))


def _oneway(df: DataFrame) -> list[str]:
    return [c for c in ("osm_oneway",) if c in df.columns]


def weighted(adj: DataFrame, facts: DataFrame, observed_bonus: float = 0.5, unobserved_penalty: float = 2.0, uphill: float = 0.0, downhill: float = 0.0, min_confidence: float | None = None) -> DataFrame:
    """Adjacency with costs changed by what is known of edges: (edge_id, trace_count, slope_deg, confidence).

    Observed edges cost `observed_bonus` times, others `unobserved_penalty` times their
    length; a degree of slope adds its factor, with the sign of the direction. Edges
    below `min_confidence` go, edges of unknown confidence stay.
    """
    out = adj.join(facts, "edge_id", "left")
    if min_confidence is not None:
        out = out.where(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
    slope = F.coalesce("slope_deg", F.lit(0.0)) * F.when(F.col("direction") == "forward", 1.0).otherwise(-1.0)
    factor = F.when(F.coalesce("trace_count", F.lit(0)) > 0, observed_bonus).otherwise(unobserved_penalty)
    hill = 1.0 + F.when(slope > 0, slope * uphill).otherwise(-slope * downhill)
    return out.select("u", "v", "edge_id", "direction", (F.col("cost") * factor * hill).alias("cost"))


#: How often moves are doubled before a search: 2 makes a round go up to four moves.
DOUBLINGS = 2
#: States of a network that is searched in rounds even where places are given; more are searched by tiles.
FEW_STATES = TILE
#: Rounds of a search whose improvements are kept apart before they are put together.
APART = 12


#: How far beyond the straight line a goal-directed search looks at first, and by how much more each time it does not suffice.
FIRST, MORE = 1.5, 2.0


@dataclass(frozen=True)
class Goals:
    """What a search looks for, so that it can leave states alone that lead nowhere near.

    places: (state, x, y). targets: (origin, target, state), any state of a target will
    do. boxes: (origin, x0, x1, y0, y1, budget) around an origin's targets, with the cost
    within which they may be. least: no move costs less than this for a metre of straight
    line, so that least times the distance to a box is never more than what is to come.
    """

    places: DataFrame
    targets: DataFrame
    boxes: DataFrame
    least: float

    def bound(self) -> Column:
        """The least cost of any way over a state at x, y."""
        away = lambda c: F.greatest(F.lit(0.0), F.col(f"goal.{c}0") - F.col(c), F.col(c) - F.col(f"goal.{c}1"))
        return F.col("cost") + self.least * F.sqrt(away("x") * away("x") + away("y") * away("y"))


def goals(moves: DataFrame, places: DataFrame, targets: DataFrame, origins: DataFrame) -> Goals | None:
    """Goals of origins (origin, x, y) for `search` over moves (u, v, cost, ...); None where moves can be free, as no distance bounds costs then."""
    at = lambda c, p: places.select(F.col("state").alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    apart = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    rate = moves.join(at("u", "a"), "u").join(at("v", "b"), "v").agg(F.min(F.when(apart > 0, F.col("cost") / apart)).alias("least"), F.avg("cost").alias("unit")).first()
    if not rate["least"] or rate["least"] <= 0:
        return None
    # a little less, so that rounding does not hide a state
    least = rate["least"] * (1 - 1e-9)
    spots = targets.join(places, "state").join(origins.select("origin", F.col("x").alias("ox"), F.col("y").alias("oy")), "origin")
    far = F.max(F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2))
    sides = [f(c).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]
    boxes = spots.groupBy("origin").agg(*sides, F.greatest(FIRST * least * far, F.lit(rate["unit"])).alias("budget"))
    return Goals(places, targets, materialize(boxes), least)


def search(moves: DataFrame, starts: DataFrame, max_cost: float | None = None, max_rounds: int = 100_000, goals: Goals | None = None, doublings: int = DOUBLINGS) -> DataFrame:
    """Rows (origin, state, cost, hops, via, step): cheapest costs and the last move of a cheapest way.

    moves: (u, v, cost, step), step naming the move. starts: (origin, state, cost), with
    a column step where reaching the start is a move of its own. A budget includes costs
    equal to it. Of ways of equal cost the one of fewest moves counts, then the one whose
    last move has the smallest name. A state improves only by a lower cost, so moves
    without cost are taken like any other and never go round. Unknown states reach
    only themselves. Before the search moves are joined to cheapest ways of two and then
    four (`doublings`), which saves rounds and costs as many rows as states have others
    that near; 0 is right where a few origins search a small part of a vast graph.

    With `goals`, states over which no way within an origin's budget leads to its
    targets are put aside; where a target is still open when all others are done, the
    budget grows and the search goes on from them. Only the targets, and what lies on
    cheapest ways to them, have final costs then; origins without a target are left out.
    """
    columns = ["origin", "state", "cost", "hops", "via", "step"]
    first = F.col("step") if "step" in starts.columns else F.lit(None).cast("string")
    begun = starts.groupBy("origin", "state").agg(F.min(F.struct("cost", first.alias("step"))).alias("b"))
    begun = begun.select("origin", "state", "b.cost", F.when(F.col("b.step").isNull(), 0).otherwise(1).alias("hops"), F.lit(None).cast("string").alias("via"), "b.step")
    if max_cost is not None:
        begun = begun.where(F.col("cost") <= max_cost)
    least = lambda m: m.groupBy("u", "v").agg(F.min(F.struct("w", "h", "name", "before")).alias("m")).select("u", "v", "m.*")
    moves = least(moves.select("u", "v", F.col("cost").alias("w"), F.lit(1).alias("h"), F.col("step").alias("name"), F.col("u").alias("before")))
    for _ in range(doublings):
        moves = materialize(moves)
        a, b = moves.alias("a"), moves.alias("b")
        both = a.join(b, (F.col("a.v") == F.col("b.u")) & (F.col("a.u") != F.col("b.v"))).select("a.u", "b.v", (F.col("a.w") + F.col("b.w")).alias("w"), (F.col("a.h") + F.col("b.h")).alias("h"), "b.name", "b.before")
        moves = least(moves.unionByName(both if max_cost is None else both.where(F.col("w") <= max_cost)))
    carried, place, scale = [], [], 1.0
    if goals is not None:
        moves = moves.join(goals.places.select(F.col("state").alias("v"), "x", "y"), "v")
        box = F.struct(*(c for c in goals.boxes.columns if c != "origin")).alias("goal")
        begun = begun.join(goals.places, "state").join(goals.boxes.select("origin", box), "origin")
        begun, carried = begun.withColumn("bound", goals.bound()).select(*columns, "bound", "goal"), ["bound", "goal"]
        place = ["x", "y", "goal"]
    moves = materialize(moves)
    within = lambda: F.col("bound") <= F.col("goal.budget") * scale if carried else F.lit(True)
    fresh = materialize(begun)
    frontier, aside, found = fresh.where(within()), [fresh.where(~within())], [fresh.where(within()).select(*columns)]
    order = F.struct("cost", "hops", "step")

    def best(parts: list[DataFrame], kept: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts).groupBy("origin", "state").agg(F.min_by(F.struct(*kept), order).alias("b")).select("origin", "state", "b.*")

    def new(step: DataFrame) -> DataFrame:
        """What is cheaper than known, or as cheap with fewer moves or a smaller name."""
        known = best(found, columns[2:]).select("origin", "state", F.struct("cost", "hops", "step").alias("k"))
        tie = (F.col("cost") <= F.col("k.cost") + 1e-9) & (F.struct("hops", "step") < F.struct("k.hops", "k.step"))
        better = F.col("k").isNull() | (F.col("cost") < F.col("k.cost") - 1e-9) | tie
        return materialize(step.join(known, ["origin", "state"], "left").where(better).select(*columns, *carried))

    for _ in range(max_rounds):
        if frontier.isEmpty():
            if not carried:
                return best(found, columns[2:])
            # a target that is found within the budget has its final cost
            reached = goals.targets.join(reduce(DataFrame.unionByName, found).select("origin", "state").distinct(), ["origin", "state"]).select("origin", "target").distinct()
            still = goals.targets.select("origin", "target").distinct().join(reached, ["origin", "target"], "left_anti").select("origin").distinct()
            rest = materialize(reduce(DataFrame.unionByName, aside).join(still, "origin", "left_semi"))
            nearest = rest.agg(F.min(F.col("bound") / F.col("goal.budget"))).first()[0]
            if nearest is None:
                return best(found, columns[2:])
            scale = max(scale * MORE, nearest)
            frontier, aside = new(best([rest], [*columns[2:], *carried]).where(within())), [rest.where(~within())]
        else:
            step = frontier.join(moves, F.col("state") == F.col("u")).select("origin", F.col("v").alias("state"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + F.col("h")).alias("hops"), F.col("before").alias("via"), F.col("name").alias("step"), *place)
            if max_cost is not None:
                step = step.where(F.col("cost") <= max_cost)
            step = step.groupBy("origin", "state").agg(F.min(F.struct("cost", "hops", "step", "via", *place)).alias("b")).select("origin", "state", "b.*")
            fresh = new(step.withColumn("bound", goals.bound()) if carried else step)
            frontier = fresh.where(within())
            aside.append(fresh.where(~within()))
        found.append(frontier.select(*columns))
        if len(found) > APART:
            found = [materialize(best(found, columns[2:]).select(*columns))]
            if carried:
                aside = [materialize(best(aside, [*columns[2:], *carried]))]
    raise RuntimeError("the search did not end")


def _doublings(max_cost: float | None) -> int:
    """None within a budget: moves of several moves are then as many as what is found, and are joined with it again."""
    return DOUBLINGS if max_cost is None else 0


def cheapest(adj: DataFrame, starts: DataFrame, max_cost: float | None = None, max_rounds: int = 100_000) -> DataFrame:
    """Rows (origin, state, cost): cheapest cost from each start (origin, state, cost) over rows (u, v, cost)."""
    return search(adj.select("u", "v", "cost", F.lit("").alias("step")), starts, max_cost, max_rounds, doublings=_doublings(max_cost)).select("origin", "state", "cost")


def service_areas(edges: DataFrame, origins: DataFrame, nodes: DataFrame, max_cost: float, respect_oneway: bool = False) -> DataFrame:
    """Rows (origin, node, cost): what origins (origin: a node id) reach within the budget, searched cell by cell where nodes (id, x, y) lie."""
    found = areas(_both_ways(edges, respect_oneway), origins, nodes, max_cost)
    if found is None:
        starts = origins.select("origin", F.col("origin").alias("state"), F.lit(0.0).alias("cost"))
        found = cheapest(adjacency(edges, respect_oneway), starts, max_cost).withColumnRenamed("state", "node")
    return found


def traced(found: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows (origin, state, steps): the moves of the ways to `ends` (origin, state), from the results of a search.

    Ways are cut in halves at ancestors that lie a power of two of moves back, until
    each piece is one move; so a way of n moves takes 2 log n rounds of joins, and no
    row holds more than one move before the last.
    """
    found = materialize(found.join(found.join(ends.distinct(), ["origin", "state"]).select("origin").distinct(), "origin"))
    back = found.where("via is not null").select("origin", "state", "via")
    pieces = found.join(ends.distinct(), ["origin", "state"]).select("origin", F.col("state").alias("end"), "state", "hops", F.col("hops").alias("place"))
    most = pieces.agg(F.max("hops")).first()[0] or 0
    jumps = [back]
    while 2 << len(jumps) <= 2 * most:
        half, rest = jumps[-1], jumps[-1].select("origin", F.col("state").alias("via"), F.col("via").alias("far"))
        jumps.append(materialize(half.join(rest, ["origin", "via"]).select("origin", "state", F.col("far").alias("via"))))
    for k in reversed(range(len(jumps))):
        size = 1 << k
        # the last 2^k moves of a longer piece, and what comes before them
        cut = pieces.join(jumps[k], ["origin", "state"], "left").withColumn("long", (F.col("hops") > size) & F.col("via").isNotNull())
        head = F.struct(F.col("via").alias("state"), (F.col("hops") - size).alias("hops"), (F.col("place") - size).alias("place"))
        tail = F.struct("state", F.least("hops", F.lit(size)).alias("hops"), "place")
        parts = F.when(F.col("long"), F.array(tail, head)).otherwise(F.array(F.struct("state", "hops", "place")))
        pieces = materialize(cut.select("origin", "end", F.explode(parts).alias("p")).select("origin", "end", "p.*"))
    named = pieces.where("hops > 0").join(found.select("origin", "state", "step"), ["origin", "state"])
    steps = named.groupBy("origin", F.col("end").alias("state")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "step"))), lambda s: s["step"]).alias("steps"))
    return ends.distinct().join(found, ["origin", "state"], "left_semi").join(steps, ["origin", "state"], "left").withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))


def step_name(*parts: str | Column) -> Column:
    return F.concat_ws("/", *parts)


def reachable_spans(adj: DataFrame, reached: DataFrame, max_cost: float) -> DataFrame:
    """How far each directed edge is reached within the budget: (origin, edge_id, direction, start_cost, fraction)."""
    rows = reached.join(adj, F.col("state") == F.col("u"))
    left = max_cost - reached["cost"]
    fraction = F.when(adj["cost"] <= 0, 1.0).otherwise(F.least(F.lit(1.0), left / adj["cost"]))
    return rows.where(left > 0).select("origin", "edge_id", "direction", reached["cost"].alias("start_cost"), fraction.alias("fraction"))


def _all_turns(adj: DataFrame) -> DataFrame:
    """Every pair of directed edges of which the second begins where the first ends."""
    a, b = adj.alias("a"), adj.alias("b")
    return a.join(b, F.col("a.v") == F.col("b.u")).select(
        F.col("a.v").alias("junction_node_id"), F.col("a.edge_id").alias("from_edge_id"), F.col("a.direction").alias("from_direction"),
        F.col("b.edge_id").alias("to_edge_id"), F.col("b.direction").alias("to_direction"), F.col("b.cost").alias("cost"),
    )


def _as_moves(turns: DataFrame) -> DataFrame:
    ahead = step_name("to_edge_id", "to_direction")
    return turns.select(step_name("from_edge_id", "from_direction").alias("u"), ahead.alias("v"), "cost", ahead.alias("step"))


def _turns(adj: DataFrame) -> DataFrame:
    return _as_moves(_all_turns(adj))


def turn_adjacency(adj: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Moves between directed edges that turn rules allow: rows (u, v, cost, step), states written edge/direction.

    restrictions: (junction_node_id, from_edge_id, from_direction, to_edge_id,
    to_direction, restriction). no_* forbids a move; where an only_* stands for an
    approach, moves outside its targets are forbidden.
    """
    moves = _all_turns(adj)
    approach = ["junction_node_id", "from_edge_id", "from_direction"]
    full = [*approach, "to_edge_id", "to_direction"]
    no = restrictions.where(F.col("restriction").startswith("no_")).select(full).distinct()
    only = restrictions.where(F.col("restriction").startswith("only_")).select(full).distinct()
    moves = moves.join(no, full, "left_anti")
    ruled = only.select(approach).distinct().withColumn("_ruled", F.lit(True))
    right = only.withColumn("_right", F.lit(True))
    return _as_moves(moves.join(ruled, approach, "left").join(right, full, "left").where("_ruled is null or _right"))


def _turning(edges: DataFrame, restrictions: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves, starts and end nodes (state, node) of a search over directed edges."""
    adj = adjacency(edges)
    state = step_name("edge_id", "direction")
    first = origins.join(adj, F.col("origin") == F.col("u")).select("origin", state.alias("state"), "cost", state.alias("step"))
    return turn_adjacency(adj, restrictions), first, adj.select(state.alias("state"), F.col("v").alias("node"))


def restricted_costs(edges: DataFrame, restrictions: DataFrame, origins: DataFrame, max_cost: float | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Rows (origin, node, cost) under turn rules: cheapest cost to each node from origins (origin: a node id).

    With nodes (id, x, y) a search within a budget goes cell by cell.
    """
    if nodes is not None and max_cost is not None:
        forward = lambda c: F.when(F.col(c) == "forward", True).when(F.col(c) == "reverse", False)
        kind = F.when(F.col("restriction").startswith("no_"), "no").when(F.col("restriction").startswith("only_"), "only")
        rules = restrictions.select(F.col("junction_node_id").alias("u"), F.col("from_edge_id").alias("edge_id"), forward("from_direction").alias("ahead"), F.col("to_edge_id").alias("v"), forward("to_direction").alias("back"), kind.alias("rule")).where("rule is not null and ahead is not null")
        found = areas(_both_ways(edges), origins, nodes, max_cost, rules)
        if found is not None:
            return found
    moves, starts, ends = _turning(edges, restrictions, origins)
    reached = search(moves, starts, max_cost, doublings=_doublings(max_cost)).join(ends, "state").groupBy("origin", "node").agg(F.min("cost").alias("cost"))
    own = origins.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"))
    return reached.unionByName(own).groupBy("origin", "node").agg(F.min("cost").alias("cost"))


def _routes(found: DataFrame, ends: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (from_node, to_node, cost, edges) of pairs, from a search whose states end at nodes (state, node)."""
    pairs = pairs.select("from_node", "to_node").distinct()
    wanted = pairs.where("from_node <> to_node").join(ends, F.col("to_node") == F.col("node")).select(F.col("from_node").alias("origin"), "to_node", "state")
    best = wanted.join(found.select("origin", "state", "cost", "hops"), ["origin", "state"]).groupBy("origin", "to_node").agg(F.min(F.struct("cost", "hops", "state")).alias("b"))
    best = materialize(best.select("origin", "to_node", "b.cost", "b.state"))
    ways = best.join(traced(found, best.select("origin", "state")), ["origin", "state"])
    own = pairs.where("from_node = to_node").select("from_node", "to_node", F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("edges"))
    return own.unionByName(ways.select(F.col("origin").alias("from_node"), "to_node", "cost", F.col("steps").alias("edges")))


def _origins(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("from_node").alias("origin")).distinct()


def _directed(nodes: DataFrame | None, moves: DataFrame, ends: DataFrame, pairs: DataFrame) -> Goals | None:
    """Goals of pairs for a search whose states end at nodes (state, node); None without places of nodes."""
    if nodes is None:
        return None
    spots = nodes.select(F.col("id").alias("node"), "x", "y")
    wanted = pairs.where("from_node <> to_node").select(F.col("from_node").alias("origin"), F.col("to_node").alias("target")).distinct()
    places = ends.join(spots, "node").select("state", "x", "y").distinct()
    starts = wanted.select("origin").distinct().join(spots.withColumnRenamed("node", "origin"), "origin")
    return goals(moves, materialize(places), materialize(wanted.join(ends, F.col("target") == F.col("node")).select("origin", "target", "state")), starts)


def _parts(pairs: DataFrame, links: DataFrame) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """Pairs whose nodes hang together by links (a, b) in any direction, and what keeps the rows of a table whose node, in a column, hangs together with those."""
    parts = connected_components(links)
    part = lambda df, c, name: df.join(parts.withColumnRenamed("node", c).withColumnRenamed("component", name), c, "left").withColumn(name, F.coalesce(name, c))
    found = part(part(pairs.where("from_node <> to_node").distinct(), "from_node", "_part"), "to_node", "_other").where("_part = _other")
    found = materialize(found.select("from_node", "to_node", "_part"))
    return found.drop("_part"), lambda df, c: part(df, c, "_part").join(found.select("_part").distinct(), "_part", "left_semi").select(*df.columns)


def _connected(pairs: DataFrame, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose nodes hang together by links (a, b) in any direction, and the nodes that hang together with those."""
    joined, within = _parts(pairs, links)
    return joined, materialize(within(nodes, "id").select("id", "x", "y"))


def _route_search(over: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], network: DataFrame, a: str, b: str, pairs: DataFrame, nodes: DataFrame | None, near: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]) -> DataFrame:
    """Rows (from_node, to_node, cost, edges) over a network whose rows join nodes in columns a and b.

    Of more than a few nodes, `near` first settles the pairs (pairs, nodes) that lie near each other.

    `over` makes moves, starts and ends (state, node) of a network; with nodes these are made of
    the parts alone that have a pair, as moves are many more than edges, and searched tile by tile.
    """
    if nodes is None:
        moves, starts, ends = over(network)
        return _routes(search(materialize(moves), starts), ends, pairs)
    pairs = pairs.select("from_node", "to_node")
    found = near(pairs, nodes) if nodes.limit(FEW_STATES + 1).count() > FEW_STATES else None
    if found is not None:
        own = pairs.where("from_node = to_node").distinct().select("from_node", "to_node", F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("edges"))
        ways, far = found[0].unionByName(own), found[1]
        return ways if far.isEmpty() else ways.unionByName(_far_routes(over, network, a, b, far, nodes))
    return _far_routes(over, network, a, b, pairs, nodes)


def _far_routes(over: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], network: DataFrame, a: str, b: str, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Routes of `_route_search` in the parts of the network that have a pair, in rounds or tile by tile."""
    joined, within = _parts(pairs, network.select(F.col(a).alias("a"), F.col(b).alias("b")))
    near = materialize(within(nodes, "id").select("id", "x", "y"))
    moves, starts, ends = over(materialize(within(network, a)))
    ends = materialize(ends.join(near.select(F.col("id").alias("node")), "node", "left_semi"))
    moves = materialize(moves)
    own = pairs.where("from_node = to_node")
    goal = _directed(near, moves, ends, joined)
    if goal is None or ends.count() <= FEW_STATES:
        return _routes(search(moves, starts, goals=goal), ends, joined.unionByName(own))
    found = materialize(tile_routes(moves, starts, goal.places, goal.targets, goal.boxes, goal.least))
    reached = goal.targets.join(found, ["origin", "state"]).groupBy("origin", "target").agg(F.min(F.struct("cost", "hops", "state", "steps")).alias("b"))
    ways = reached.select(F.col("origin").alias("from_node"), F.col("target").alias("to_node"), "b.cost", F.col("b.steps").alias("edges"))
    return ways.unionByName(own.distinct().select("from_node", "to_node", F.lit(0.0).alias("cost"), F.array().cast("array<string>").alias("edges")))


def restricted_paths(edges: DataFrame, restrictions: DataFrame, pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Cheapest routes of pairs (from_node, to_node) under turn rules: (from_node, to_node, cost, edges).

    Turns are judged between an edge and the next; the first edge is free. Pairs
    without a route are left out; a node to itself is an empty route. With nodes (id, x,
    y) the search is goal-directed.
    """


    def near(some: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        return near_routes(adjacency(edges).withColumn("n", F.lit(1)), some, spots, FIRST, True, rules=_rules(restrictions))

    return _route_search(lambda e: _turning(e, restrictions, _origins(pairs)), edges, "start_node_id", "end_node_id", pairs, nodes, near)


def _rules(restrictions: DataFrame) -> DataFrame:
    """Turn rules (u, edge_id, direction, v, rule) at junctions u onto edges v, rule being no or only with the direction there."""
    kind = F.when(F.col("restriction").startswith("no_"), "no").when(F.col("restriction").startswith("only_"), "only")
    rows = restrictions.select(F.col("junction_node_id").alias("u"), F.col("from_edge_id").alias("edge_id"), F.col("from_direction").alias("direction"), F.col("to_edge_id").alias("v"), F.concat(kind, F.lit("/"), F.coalesce("to_direction", F.lit(""))).alias("rule"))
    return rows.where("rule is not null")


def _links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("start_node_id").alias("a"), F.col("end_node_id").alias("b"))


def _laned(edges: DataFrame, lanes: DataFrame, origins: DataFrame, swap_cost: float, restrictions: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves, starts and ends (state, node, lane) of a search over edge/direction/lane.

    Changing lanes within an edge is no move of its own: coming to an edge in another
    lane costs the same, so nothing is cheaper by it.
    """
    adj = adjacency(edges)
    state = step_name("edge_id", "direction")
    count = F.greatest(F.lit(1), F.coalesce("lane_count", F.lit(1)))
    wide = adj.join(lanes.select("edge_id", "lane_count"), "edge_id", "left").select(state.alias("on"), "u", "v", "cost", count.cast("int").alias("n"))
    wide = materialize(wide)
    name = lambda on, lane: step_name(on, F.col(lane).cast("string"))
    lane = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    turns = turn_adjacency(adj, restrictions) if restrictions is not None else _turns(adj)
    after = wide.select(F.col("on").alias("v"), F.col("n").alias("n_v"))
    both = turns.join(wide.select(F.col("on").alias("u"), F.col("n").alias("n_u")), "u").join(after, "v")
    both = both.withColumn("old", F.explode(F.sequence(F.lit(0), F.col("n_u") - 1))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("n_v") - 1)))
    change = F.when((F.col("n_v") > 1) & (F.col("lane") != F.col("old")), swap_cost).otherwise(0.0)
    moves = both.select(name("u", "old").alias("u"), name("v", "lane").alias("v"), (F.col("cost") + change).alias("cost"), name("v", "lane").alias("step"))
    placed = wide.withColumn("lane", lane)
    starts = origins.join(placed, F.col("origin") == F.col("u")).select("origin", name("on", "lane").alias("state"), "cost", name("on", "lane").alias("step"))
    return moves, starts, placed.select(name("on", "lane").alias("state"), F.col("v").alias("node"), "lane")


def lane_costs(edges: DataFrame, lanes: DataFrame, origins: DataFrame, max_cost: float | None = None, swap_cost: float = 50.0, restrictions: DataFrame | None = None) -> DataFrame:
    """Rows (origin, node, lane, cost): cheapest ways that come to a node in a lane, where changing lanes costs `swap_cost`.

    lanes: (edge_id, lane_count); an edge without has one. Going on in a lane of another
    number costs the same however many lanes lie between, and nothing where the next
    edge has one lane. The first edge is free to start on in any lane; the origin itself
    has cost 0 and no lane.
    """
    moves, starts, ends = _laned(edges, lanes, origins, swap_cost, restrictions)
    found = search(moves, starts, max_cost).join(ends, "state").groupBy("origin", "node", "lane").agg(F.min("cost").alias("cost"))
    own = origins.select("origin", F.col("origin").alias("node"), F.lit(None).cast("int").alias("lane"), F.lit(0.0).alias("cost"))
    return found.unionByName(own)


def lane_paths(edges: DataFrame, lanes: DataFrame, pairs: DataFrame, swap_cost: float = 50.0, restrictions: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Cheapest routes of pairs where lane changes cost: (from_node, to_node, cost, edges), edges as edge/direction/lane."""

    def over(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        moves, starts, ends = _laned(part, lanes, _origins(pairs), swap_cost, restrictions)
        return moves, starts, ends.select("state", "node")

    def near(some: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        count = F.greatest(F.lit(1), F.coalesce("lane_count", F.lit(1))).cast("int")
        wide = adjacency(edges).join(lanes.select("edge_id", "lane_count"), "edge_id", "left").withColumn("n", count)
        return near_routes(wide, some, spots, FIRST, True, swap_cost, None if restrictions is None else _rules(restrictions))

    return _route_search(over, edges, "start_node_id", "end_node_id", pairs, nodes, near)


def paths(adj: DataFrame, pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Cheapest routes of pairs (from_node, to_node): (from_node, to_node, cost, edges), edges as edge/direction in order.

    Pairs without a route are left out; a node to itself is an empty route. Of routes of
    equal cost the one of fewest edges counts, then the one whose edges' names are
    smaller, read from the end. All origins are searched at once. With nodes (id, x, y)
    the search is goal-directed: it leaves alone what lies too far from the targets.
    """

    def over(part: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        ends = part.select(F.explode(F.array("u", "v")).alias("state")).distinct().select("state", F.col("state").alias("node"))
        starts = _origins(pairs).select("origin", F.col("origin").alias("state"), F.lit(0.0).alias("cost"))
        return part.select("u", "v", "cost", step_name("edge_id", "direction").alias("step")), starts, ends

    return _route_search(over, adj, "u", "v", pairs, nodes, lambda some, spots: near_routes(adj.withColumn("n", F.lit(1)), some, spots, FIRST))


def merge_restrictions(*groups: DataFrame) -> DataFrame:
    """Restrictions of several sources; of one id, that of the first source, and there the first row (column pos)."""
    out = None
    for k, g in enumerate(groups):
        g = g.withColumn("_source", F.lit(k))
        out = g if out is None else out.unionByName(g)
    rest = [c for c in out.columns if c not in ("id", "_source", "pos")]
    first = out.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("_source", "pos")).alias("r"))
    return first.select("id", "r.*")
