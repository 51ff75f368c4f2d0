"""Shortest paths, reachability and components as iterated joins.

Edges are ``src``, ``dst``, ``w`` and ``edge_id``. Each round sends only the nodes
that improved along their edges, keeps the best per (source, node) by one aggregate
and writes the small state to the shared folder, so plans stay short and lost
executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, materialise

# How much slower routes treat smaller roads, and lane capacity per class.
ROUTE_SPEED_FACTOR = {"highway": 1.0, "arterial": 0.9, "collector": 0.7, "local": 0.45}
LANE_CAPACITY_VPH = {"highway": 1800, "arterial": 1400, "collector": 1000, "local": 600}
DEFAULT_SPEED_KMH = 50


def by_class(column: str, table: dict, other) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {other} end"


def travel_time(length: str = "length", speed: str = "speed_limit") -> str:
    return f"{length} / (coalesce(nullif({speed}, 0D), {DEFAULT_SPEED_KMH}D) / 3.6D)"


def route_time(length: str = "length", speed: str = "speed_limit", road_class: str = "road_class") -> str:
    """Travel time as route choice sees it."""
    return f"({travel_time(length, speed)} / {by_class(road_class, {k: f'{v}D' for k, v in ROUTE_SPEED_FACTOR.items()}, '0.45D')})"


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_d", "dst": "src"}).withColumnRenamed("_d", "dst")


def shortest(edges: DataFrame, seeds: DataFrame, limit: float | str | None = None, hops: int = 3) -> DataFrame:
    """Least cost from each source key ``k`` to every node it reaches.

    ``seeds``: ``k``, ``node`` and ``d`` (start cost). Nodes at ``limit`` or beyond are
    recorded but not expanded; it may depend on the source key (SQL text over ``k``).
    Several hops are taken per round to keep rounds few.
    Result: ``k``, ``node``, ``d``, ``edge_id`` (arriving edge), ``prev`` (node before).
    """
    e = edges.select("src", "dst", "w", "edge_id")
    edge_type, node_type = dict(e.dtypes)["edge_id"], dict(e.dtypes)["src"]
    state = materialise(seeds.groupBy("k", "node").agg(F.min("d").alias("d")).selectExpr(
        "k", "node", "d", f"cast(null as {edge_type}) as edge_id", f"cast(null as {node_type}) as prev", "true as fresh"), "paths")
    within = "true" if limit is None else f"d < {limit if isinstance(limit, str) else repr(float(limit)) + 'D'}"
    reach = f"fresh and {within}"
    while not state.filter(reach).isEmpty():  # costs are not negative, so improvements end
        wave = state.filter(reach).select("k", "node", "d")
        found = state.drop("fresh").withColumn("old", F.col("d"))
        for _hop in range(hops):
            step = wave.filter(within).join(e, wave["node"] == e["src"]).selectExpr(
                "k", "dst as node", "d + w as d", "edge_id", "src as prev")
            step = step.groupBy("k", "node").agg(F.min(F.struct("d", "edge_id", "prev")).alias("b")).select("k", "node", "b.*")
            found = found.unionByName(step.withColumn("old", F.lit(None).cast("double")))
            wave = step.select("k", "node", "d")
        best = found.groupBy("k", "node").agg(F.min(F.struct("d", "edge_id", "prev")).alias("b"), F.min("old").alias("old"))
        new = materialise(best.selectExpr("k", "node", "b.d", "b.edge_id", "b.prev", "old is null or b.d < old as fresh"), "paths")
        forget(state)
        state = new
    return state.drop("fresh")


def reachable(edges: DataFrame, seeds: DataFrame, where: str = "true", hops: int = 3) -> DataFrame:
    """Every node that each source key ``k`` of the seeds (``k``, ``node``) reaches, theirs included.

    ``where`` says which edges a key may use (SQL text over ``k`` and the edges' columns). A
    round goes on from, and writes, only the pairs that are new.
    """
    fresh = known = materialise(seeds.select("k", "node").distinct(), "reached")
    while not fresh.isEmpty():  # pairs are finitely many, so new ones end
        wave, found = fresh, None
        for _hop in range(hops):
            wave = wave.join(edges.hint("merge"), wave["node"] == edges["src"]).filter(where).selectExpr("k", "dst as node").distinct()
            found = wave if found is None else found.unionByName(wave)
        fresh = materialise(found.distinct().join(known.hint("merge"), ["k", "node"], "left_anti"), "reached")
        known = known.unionByName(fresh)
    return known


def route_trees(edges: DataFrame, targets: DataFrame, hops: int = 3) -> DataFrame:
    """Per target: cost from every node that can reach it and the next edge towards it."""
    t = shortest(reversed_edges(edges), targets.selectExpr("node as k", "node", "0D as d"), hops=hops)
    return t.selectExpr("k as target", "node", "d as cost", "edge_id as next_edge", "prev as next_node")


def paths(trees: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """Edges along the route of every (origin, target) pair: ``edge_id`` with its ``step``.

    ``pairs`` carries ``pair``, ``origin`` and ``target``; all routes advance together.
    """
    nxt = trees.filter("next_edge is not null").select("target", F.col("node").alias("at"), "next_edge", "next_node")
    now = materialise(pairs.selectExpr("pair", "target", "origin as at"), "walk")
    first, parts = now, []
    while not now.isEmpty():  # next edges lead strictly nearer to the target, so routes end
        here, begun = now, len(parts) * hops
        for hop in range(hops):  # a route that has ended stays with nulls
            here = here.join(nxt, ["target", "at"], "left").drop("at").withColumnsRenamed({"next_node": "at", "next_edge": f"_e{hop}"})
        taken = ", ".join(f"struct({begun + hop} as step, _e{hop} as edge_id)" for hop in range(hops))
        walked = materialise(here.selectExpr("pair", "target", "at", f"filter(array({taken}), _s -> _s.edge_id is not null) as taken"), "walked")
        parts.append(walked.selectExpr("pair", "inline(taken)"))
        now = walked.filter("at <> target").select("pair", "target", "at")
    forget(first)
    out = parts[0] if parts else pairs.limit(0).selectExpr("pair", "0 as step", "cast(null as string) as edge_id")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cheapest_via(edges: DataFrame, choices: DataFrame) -> DataFrame:
    """Way of every pair that uses one of its given edges, with the least free-flow time.

    ``edges``: ``src``, ``dst``, ``edge_id``, ``w`` (route choice) and ``t`` (free flow). ``choices``: ``pair``,
    ``origin``, ``target`` and the ``edge_id`` to use, any number per pair. Drivers reach the edge
    and go on from it as route choice has it; only then are the free-flow times of the
    choices compared. Result: ``pair``, ``edge_id``, ``seconds`` and the ``route`` of edge ids.
    """
    c = materialise(choices.join(edges.select("edge_id", "src", "dst", "t"), "edge_id"), "choices")
    trees = materialise(route_trees(edges, c.selectExpr("src as node").unionByName(c.selectExpr("target as node")).distinct()), "trees")
    legs = c.selectExpr("pair", "edge_id", "inline(array(named_struct('leg', 0, 'a', origin, 'b', src), named_struct('leg', 2, 'a', dst, 'b', target)))")
    legs = legs.selectExpr("struct(pair, edge_id, leg) as pair", "a as origin", "b as target")
    driven = materialise(legs.join(trees.selectExpr("node as origin", "target"), ["origin", "target"], "left_semi"), "legs")
    complete = driven.groupBy("pair.pair", "pair.edge_id").agg(F.expr("count(1) = 2").alias("whole")).filter("whole").select("pair", "edge_id")
    walked = paths(trees, driven.filter("origin <> target")).selectExpr("pair.pair as pair", "pair.edge_id as edge_id", "pair.leg as leg", "step", "edge_id as over")
    middle = c.selectExpr("pair", "edge_id", "1 as leg", "0 as step", "edge_id as over")
    steps = walked.unionByName(middle).join(complete, ["pair", "edge_id"]).join(edges.selectExpr("edge_id as over", "t"), "over")
    ways = steps.groupBy("pair", "edge_id").agg(F.sum("t").alias("seconds"), F.expr("transform(array_sort(collect_list(struct(leg, step, over))), _s -> _s.over)").alias("route"))
    return ways.groupBy("pair").agg(F.expr("min_by(struct(edge_id, seconds, route), struct(seconds, edge_id))").alias("b")).select("pair", "b.*")


def star_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is its component's smallest node.

    Alternating large and small stars: every round ties a node's larger neighbours to its
    smallest one, then a node and its smaller neighbours to the smallest of them. A node's
    neighbourhood is only ever reduced to its minimum, by a partial aggregation, and links
    become stars without a common intermediate, so neither a hub nor the root of a giant
    component gathers rows in one task. Edges may repeat, point either way or join a node to
    itself. Rounds go on until every node hangs on one root.
    """
    nodes = edges.select(F.col(left).alias("node")).unionByName(edges.select(F.col(right).alias("node"))).filter("node is not null").distinct()
    now = materialise(edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u"), F.expr(f"{left} is not null and {right} is not null").alias("ok"))
                      .filter("ok and u <> v").select("v", "u").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = materialise(both.filter("u > v").join(least, "v").selectExpr("u as v", "m as u").filter("u <> v").distinct(), "links")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").filter("u <> m").selectExpr("u as v", "m as u")
        after = materialise(small.unionByName(low.selectExpr("v", "m as u")).distinct(), "links")
        ends = after.selectExpr("v as n", "1 as child", "0 as parent").unionByName(after.selectExpr("u as n", "0 as child", "1 as parent"))
        done = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or (c > 0 and p > 0)").isEmpty()
        forget(now)
        forget(large)
        now = after
        if done:
            return nodes.join(now.selectExpr("v as node", "u as root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node id of the component of every node, directions ignored."""
    return star_components(edges).withColumnRenamed("root", "component")
