"""Study areas around selected roads: extent, boundary, problems, dependence, loads.

Edges: study key ``city``, ``edge_id``, ``segment_key``, ``road_id``, ``src``, ``dst``,
``length``, ``lanes``, ``speed_limit``, ``road_class``. Seeds: ``city``, ``road_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import angle_between, norm_deg
from ..session import materialise
from . import graph as G
from .nearest import road_hits


@dataclass
class StudyArea:
    edges: DataFrame       # every edge, with in-area flags
    segments: DataFrame    # stretches in the area with role and distance
    sources: DataFrame     # ends of the seed roads
    node_distance: DataFrame


def grow(edges: DataFrame, seeds: DataFrame, range_m: float, direction: str = "both") -> StudyArea:
    """Stretches within range downstream or upstream of the seed roads."""
    e = edges.join(seeds.selectExpr("city", "road_id", "true as seed").distinct(), ["city", "road_id"], "left").withColumn(
        "seed", F.coalesce("seed", F.lit(False)))
    sources = e.filter("seed").selectExpr("city", "explode(array(src, dst)) as node").distinct()
    start = sources.selectExpr("city as k", "node", "0D as d")
    w = edges.withColumn("w", F.col("length"))

    def distances(graph):
        return G.shortest(graph, start, range_m).selectExpr("k as city", "node", "d")
    down, up = distances(w), distances(G.reversed_edges(w))
    far = f"{float(range_m)!r}D"
    e = e.join(down.selectExpr("city", "node as src", "d as d_down"), ["city", "src"], "left").join(
        up.selectExpr("city", "node as dst", "d as d_up"), ["city", "dst"], "left")
    want_down, want_up = str(direction != "upstream").lower(), str(direction != "downstream").lower()
    e = e.selectExpr("*", f"coalesce(d_down < {far}, false) as near_down", f"coalesce(d_up < {far}, false) as near_up")
    e = e.selectExpr("*", f"near_down and {want_down} as in_down", f"near_up and {want_up} as in_up", "seed or near_down or near_up as in_range")
    e = e.selectExpr("*", "seed or in_down or in_up as included", "case when seed then 0D else least(case when in_down then d_down end, case when in_up then d_up end) end as dist")
    e = materialise(e, "study")
    seg = e.filter("included").groupBy("city", "segment_key", "road_id").agg(
        F.expr("bool_or(seed)").alias("_s"), F.expr("bool_or(in_down)").alias("_d"), F.expr("bool_or(in_up)").alias("_u"),
        F.min("dist").alias("distance"), F.max("length").alias("length"), F.expr("min(struct(src, dst))").alias("ends"))
    seg = seg.selectExpr("city", "segment_key", "road_id", "length", "distance", "ends.src as node_a", "ends.dst as node_b",
                         "case when _s then 'seed' when _d and _u then 'both' when _d then 'downstream' else 'upstream' end as role")
    nd = down.unionByName(up) if direction == "both" else (up if direction == "upstream" else down)
    return StudyArea(e, seg, sources, nd.groupBy("city", "node").agg(F.min("d").alias("distance")))


def boundary_points(area: StudyArea, direction: str = "both") -> DataFrame:
    """Nodes of the area where a stretch outside it leaves (exit) or arrives (entry)."""
    nodes = area.segments.selectExpr("city", "explode(array(node_a, node_b)) as node").distinct()
    # A stretch is in the area as a whole, in both directions.
    out = area.edges.join(area.segments.select("city", "segment_key"), ["city", "segment_key"], "left_anti")
    sides = []
    if direction != "upstream":
        sides.append(out.selectExpr("city", "src as node", "true as leaves", "false as arrives"))
    if direction != "downstream":
        sides.append(out.selectExpr("city", "dst as node", "false as leaves", "true as arrives"))
    flags = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    return flags.groupBy("city", "node").agg(F.expr("bool_or(leaves)").alias("x"), F.expr("bool_or(arrives)").alias("n")).join(
        nodes, ["city", "node"], "left_semi").selectExpr(
        "city", "node", "case when x and n then 'entry_exit' when x then 'exit' else 'entry' end as kind")


def node_arms(edges: DataFrame) -> DataFrame:
    """Arms, ways in and ways out of every node."""
    both = edges.selectExpr("city", "segment_key", "road_id", "inline(array(named_struct('node', src, 'o', 1), named_struct('node', dst, 'o', 0)))")
    return both.groupBy("city", "node").agg(F.expr("count(distinct segment_key)").alias("arms"), F.sum("o").alias("ways_out"),
                                            F.expr("count(1) - sum(o)").alias("ways_in"), F.min("road_id").alias("road_id"))


def area_stats(area: StudyArea, boundary: DataFrame, arms: DataFrame, range_m: float) -> DataFrame:
    """Roads, stretches, junctions (not dead ends), km, entries and exits per study."""
    s = area.segments.groupBy("city").agg(F.expr("count(distinct road_id)").alias("roads"), F.expr("count(1)").alias("segments"), F.expr("sum(length) / 1000").alias("km"))
    nodes = area.segments.selectExpr("city", "explode(array(node_a, node_b)) as node").distinct()
    j = nodes.join(area.node_distance.filter(f"distance < {float(range_m)!r}D"), ["city", "node"]).join(arms.filter("arms >= 3"), ["city", "node"])
    j = j.groupBy("city").agg(F.expr("count(1)").alias("junctions"))
    b = boundary.groupBy("city").agg(F.expr("count_if(kind <> 'exit')").alias("entries"), F.expr("count_if(kind <> 'entry')").alias("exits"))
    return s.join(j, "city", "left").join(b, "city", "left").na.fill(0)


def node_problems(area: StudyArea, arms: DataFrame, range_m: float, near_misses: DataFrame | None = None,
                  cut_ends: DataFrame | None = None) -> DataFrame:
    """One finding per node inside the range, the first rule that fits winning.

    Order: cut at a mapped area's edge, near miss, one-way trap, no way in, dead end.
    """
    nodes = area.segments.selectExpr("city", "explode(array(node_a, node_b)) as node").distinct()
    df = nodes.join(area.node_distance.filter(f"distance < {float(range_m)!r}D"), ["city", "node"]).join(arms, ["city", "node"])

    def flag(df, other, name):
        if other is None:
            return df.withColumn(name, F.lit(False))
        return df.join(other.selectExpr("city", "node", f"true as {name}").distinct(), ["city", "node"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    df = flag(flag(df, near_misses, "near"), cut_ends, "cut_here")
    kind = """case when arms = 1 and cut_here then 'area_edge' when arms = 1 and near then 'near_miss' when ways_in > 0 and ways_out = 0 then 'one_way_trap'
        when ways_out > 0 and ways_in = 0 then 'one_way_source' when arms = 1 then 'dead_end' end"""
    severity = "case kind when 'near_miss' then 'error' when 'one_way_trap' then 'warning' when 'one_way_source' then 'warning' else 'info' end"
    return df.selectExpr("city", "node", "road_id", "distance", f"{kind} as kind").filter("kind is not null").selectExpr("*", f"{severity} as severity")


def dependent_pairs(area: StudyArea) -> DataFrame:
    """Entry-exit routes through the range, and those that exist only over the seed roads."""
    e = area.edges
    inside = e.filter("in_range").select("city", "segment_key").distinct()
    e = e.drop("in_range").join(inside.withColumn("in_range", F.lit(True)), ["city", "segment_key"], "left").withColumn("in_range", F.coalesce("in_range", F.lit(False)))
    e = materialise(e.select("city", "src", "dst", "edge_id", "seed", "in_range"), "reach")
    nodes = e.filter("in_range").selectExpr("city", "explode(array(src, dst)) as node").distinct()
    free = nodes.join(area.sources, ["city", "node"], "left_anti")
    entries = free.join(e.filter("not in_range").selectExpr("city", "dst as node"), ["city", "node"], "left_semi")
    exits = free.join(e.filter("not in_range").selectExpr("city", "src as node"), ["city", "node"], "left_semi")
    # Each entry sets out twice in the same rounds: over all roads, and bound to keep off the seed roads.
    seeds = entries.selectExpr("city", "node", "explode(array(false, true)) as off").selectExpr("named_struct('city', city, 'entry', node, 'off', off) as k", "node")
    ways = e.filter("in_range").select("src", "dst", "seed").distinct()
    reached = G.reachable(ways, seeds, "not (k.off and seed)").selectExpr("k.city as city", "k.entry as entry", "k.off as off", "node")
    reached = materialise(reached.join(exits, ["city", "node"]).filter("entry <> node"), "routes")
    with_seeds, without = (reached.filter(which).drop("off") for which in ("not off", "off"))
    lost = with_seeds.join(without.hint("merge"), ["city", "entry", "node"], "left_anti")
    return with_seeds.groupBy("city").agg(F.expr("count(1)").alias("pairs")).join(
        lost.groupBy("city").agg(F.expr("count(1)").alias("dependent")), "city", "left").na.fill(0)


def edge_capacity_flows(area: StudyArea, junctions: DataFrame | None = None) -> DataFrame:
    """Capacity that enters and leaves the area at each of its junctions.

    ``junctions`` (node, root) as :func:`editing.fold_junctions` gives them: outside roads at
    any node of a joined junction count for it, roads wholly inside one do not. Without it
    every node is its own. Entering capacity counts where an inside road leads on, leaving
    capacity where one leads there.
    """
    edges = area.edges
    if junctions is not None:
        for end in ("src", "dst"):
            root = junctions.selectExpr(f"node as {end}", f"root as {end}_root")
            edges = edges.join(root, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
        edges = edges.filter("src <> dst")
    own = area.segments.select("city", "segment_key")
    inside = edges.join(own, ["city", "segment_key"], "left_semi")
    ways = inside.selectExpr("city", "inline(array(named_struct('node', src, 'on', 1, 'off', 0), named_struct('node', dst, 'on', 0, 'off', 1)))").groupBy("city", "node").agg(
        F.max("on").alias("on"), F.max("off").alias("off"))
    out = edges.join(own, ["city", "segment_key"], "left_anti").selectExpr(
        "city", "src", "dst", f"greatest(1, lanes) * {G.by_class('road_class', G.LANE_CAPACITY_VPH, 600)} as vph")
    both = out.selectExpr("city", "inline(array(named_struct('node', dst, 'vin', vph, 'vout', 0L), named_struct('node', src, 'vin', 0L, 'vout', vph)))")
    flows = both.groupBy("city", "node").agg(F.sum("vin").alias("vin"), F.sum("vout").alias("vout")).join(ways, ["city", "node"])
    return flows.selectExpr("city", "node", "vin * on as in_vph", "vout * off as out_vph").filter("in_vph > 0 or out_vph > 0")


# Share of boundary capacity used, fleet shares, detour limits.
REFERENCE_LEVEL = 0.12
FLEET = {"car": 0.3, "two_wheeler": 0.6, "bus_auto": 0.1}
FREE_DETOUR, DETOUR_DECAY, MAX_DETOUR = 1.15, 0.2, 2.0


def synthetic_od(flows: DataFrame, reach: DataFrame, fleet: dict | None = None) -> DataFrame:
    """Boundary traffic: each entry's capacity share over the exits it reaches, by their capacity.

    ``reach``: ``city``, ``entry``, ``node`` pairs that are connected.
    """
    src = flows.filter("in_vph > 0").selectExpr("city", "node as entry", "in_vph")
    snk = flows.filter("out_vph > 0").selectExpr("city", "node", "out_vph")
    pairs = reach.filter("entry <> node").join(src, ["city", "entry"]).join(snk, ["city", "node"])
    total = pairs.groupBy("city", "entry").agg(F.sum("out_vph").alias("total"))
    kinds = ", ".join(f"named_struct('kind', '{k}', 'share', {v}D)" for k, v in (fleet or FLEET).items())
    return pairs.join(total, ["city", "entry"]).selectExpr(
        "city", "entry", "node as exit", f"inline(array({kinds}))", "in_vph", "out_vph", "total").selectExpr(
        "city", "entry", "exit", "kind", f"in_vph * {REFERENCE_LEVEL}D * out_vph / total * share as vph")


def select_link_pairs(sources: DataFrame, watched: DataFrame, sinks: DataFrame, times: DataFrame) -> DataFrame:
    """Weight of every entry, watched link and exit: high where the link lies on or near the fastest way.

    ``times``: ``target``, ``node``, ``cost`` route trees to every exit and watched link start.
    """
    to_link = times.selectExpr("target as link_from", "node as entry", "cost as to_link")
    onward = times.selectExpr("target as exit", "node as link_to", "cost as onward")
    direct = times.selectExpr("target as exit", "node as entry", "cost as direct")
    df = (sources.join(to_link, "entry").join(watched, ["city", "link_from"]).join(onward, "link_to")
          .join(sinks, ["city", "exit"]).join(direct, ["exit", "entry"]).filter("entry <> exit"))
    df = df.selectExpr("city", "entry", "link", "exit", "(to_link + link_time + onward) / greatest(direct, 1D) as detour", "rate * sink_weight as w")
    df = df.selectExpr("*", f"case when detour > {MAX_DETOUR}D then 0D else w * exp(-greatest(0D, detour - {FREE_DETOUR}D) / {DETOUR_DECAY}D) end as near", "w / power(detour, 2) as fallback")
    any_near = df.groupBy("city").agg(F.expr("max(near) > 0").alias("use_near"))
    return df.join(any_near, "city").selectExpr("city", "entry", "link", "exit", "detour", "case when use_near then near else fallback end as weight").filter("weight > 0")


def edge_loads(trees: DataFrame, demand: DataFrame) -> DataFrame:
    """Flow on every edge when each pair takes its fastest route.

    ``demand``: ``origin``, ``target``, ``flow``; trips within one node are skipped.
    """
    d = demand.filter("origin <> target").groupBy("origin", "target").agg(F.sum("flow").alias("flow"))
    d = materialise(d.selectExpr("struct(origin, target) as pair", "origin", "target", "flow"), "demand")
    return G.paths(trees, d).join(d.select("pair", "flow"), "pair").groupBy("edge_id").agg(F.sum("flow").alias("load"))


def junction_control(edges: DataFrame, signalled: DataFrame | None = None) -> DataFrame:
    """Control of every node with three arms or more. ``edges`` carry ``heading_end`` and ``rank``.

    With known signals: signal where one was matched and approaches lie on two axes.
    Without: signal where four arms or more have a collector or bigger on both axes.
    All others are priority junctions, with the main rank when ranks differ.
    """
    arms = node_arms(edges).filter("arms >= 3").select("city", "node", "arms")
    inc = edges.withColumnRenamed("dst", "node").join(arms, ["city", "node"])
    first = inc.groupBy("city", "node").agg(F.expr("min_by(heading_end, ord_key)").alias("ref"))
    gap = angle_between(norm_deg("heading_end"), norm_deg("ref"))
    inc = inc.join(first, ["city", "node"]).selectExpr("*", f"case when {gap} < 45 or {gap} > 135 then 0 else 1 end as axis")
    n = inc.groupBy("city", "node", "arms").agg(
        F.expr("bool_or(axis = 0 and rank >= 2) and bool_or(axis = 1 and rank >= 2)").alias("both_major"),
        F.expr("count(distinct axis) = 2").alias("two_axes"), F.max("rank").alias("top"), F.min("rank").alias("low"))
    if signalled is None:
        signal = "arms >= 4 and both_major"
    else:
        n = n.join(signalled.selectExpr("city", "node", "true as lit").distinct(), ["city", "node"], "left")
        signal = "coalesce(lit, false) and two_axes"
    return n.selectExpr("city", "node", "arms", f"case when {signal} then 'signal' else 'priority' end as control",
                        f"case when not ({signal}) and low < top then top end as major_rank")


def isolated_pieces(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, range_m: float) -> DataFrame:
    """Parts of the network without a link to the seed roads that come within range of them.

    ``nodes``: ``city``, ``node``, ``lon``, ``lat``, ``z``; ``seeds``: ``city``, ``ord``, ``road_id``,
    ``coordinates``. One row per piece with its roads and distance.
    """
    part = materialise(G.connected_components(edges), "parts")
    at = edges.selectExpr("city", "road_id", "src as node").join(part, "node")
    linked = edges.join(seeds.select("city", "road_id"), ["city", "road_id"], "left_semi").selectExpr("src as node").join(part, "node").select("component").distinct()
    loose = at.join(linked, "component", "left_anti")
    size = loose.groupBy("city", "component").agg(F.expr("count(distinct road_id)").alias("roads"))
    ends = nodes.join(part, "node").join(size.select("component"), "component", "left_semi").select("city", "component", "node", "lon", "lat", "z")
    near = road_hits(ends, seeds, range_m, ["component", "node"]).groupBy("city", "component").agg(F.min("hit.d").alias("metres"))
    return size.join(near, ["city", "component"])
