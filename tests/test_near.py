"""Routes of near pairs: those of a search in rounds, in few rounds and without moves of the whole network."""

import pytest
from test_cells import town as ruled_town
from test_tiles import town, ways

from waymesh.operators import near, routing


@pytest.fixture
def alone(monkeypatch):
    """Nothing but the search of near pairs is there."""

    def only(settled=True):
        monkeypatch.setattr(routing, "FEW_STATES", 0)
        if settled:
            for name in ("search", "tile_routes", "connected_components"):
                monkeypatch.setattr(routing, name, None)

    return only


def test_lane_routes_of_near_pairs_are_those_of_rounds(spark, alone):
    nodes, edges, pairs = town(spark, 6, 9)
    lanes = edges.select("edge_id", "lane_count")
    want, plain = ways(routing.lane_paths(edges, lanes, pairs)), ways(routing.paths(routing.adjacency(edges, respect_oneway=True), pairs))
    alone()
    assert ways(routing.lane_paths(edges, lanes, pairs, nodes=nodes)) == want
    assert ways(routing.paths(routing.adjacency(edges, respect_oneway=True), pairs, nodes)) == plain and 20 < len(plain) <= len(want)


def test_routes_under_turn_rules_of_near_pairs_are_those_of_rounds(spark, alone):
    nodes, edges, rules, origins = ruled_town(spark, 6, 3)
    pairs = origins.selectExpr("origin as from_node").join(origins.selectExpr("origin as to_node").where("to_node in ('g5_4', 'g0_3', 'alone')"))
    # rounds add up moves of several edges, in another order
    rounded = lambda found: [(a, b, round(cost, 9), edges) for a, b, cost, edges in ways(found)]
    want = rounded(routing.restricted_paths(edges, rules, pairs))
    alone()
    assert rounded(routing.restricted_paths(edges, rules, pairs, nodes)) == want and len(want) > 40


def test_pairs_that_are_not_near_are_searched_by_tiles(spark, alone, monkeypatch):
    nodes, edges, pairs = town(spark, 5, 2)
    adj = routing.adjacency(edges)
    want = ways(routing.paths(adj, pairs))
    alone(settled=False)
    monkeypatch.setattr(near, "REACHED", 60)
    monkeypatch.setattr(near, "NODES", 2)
    far, real = [], routing._far_routes
    monkeypatch.setattr(routing, "_far_routes", lambda *a: far.append(a[4].count()) or real(*a))
    assert ways(routing.paths(adj, pairs, nodes)) == want and len(far) == 1 and 0 < far[0] < pairs.count()
