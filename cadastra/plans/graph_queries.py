"""Routing, reachability and study area queries on the derived street grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import fixed
from ..operators import graph as gr
from ..operators import study as st
from ..session import materialise
from ..sources import citydata as city
from ..sources.citydata import cte, sql_fixed, sql_hav
from .registry import query

# Street grid: node = city * 121 + row * 11 + column; one edge per road and direction.
_HAV1 = sql_hav("xa0 / 1e7", "ya0 / 1e7", "xm / 1e7", "ym / 1e7")
_HAV2 = sql_hav("xm / 1e7", "ym / 1e7", "xb0 / 1e7", "yb0 / 1e7")
EDGES = cte("roads") + f""", g AS (SELECT city, ord, road_id, road_class, lane_count, speed_limit, one_way, city * 121 + r * 11 + c AS a, city * 121 + (r + vertical) * 11 + c + 1 - vertical AS b,
  {_HAV1} + {_HAV2} AS length, xa0, ya0, xm, ym, xb0, yb0 FROM roads),
edges AS (SELECT city, ord * 2 AS edge_id, ord AS segment_key, road_id, a AS src, b AS dst, length, greatest(1, CASE WHEN one_way THEN lane_count ELSE (lane_count + 1) // 2 END) AS lanes, speed_limit, road_class, (xb0 - xm) AS hx, (yb0 - ym) AS hy FROM g
 UNION ALL SELECT city, ord * 2 + 1, ord, road_id, b, a, length, greatest(1, lane_count // 2), speed_limit, road_class, xa0 - xm, ya0 - ym FROM g WHERE NOT one_way)
"""
RANGE = 250.0


def grid_edges(spark, sf):
    from ..functions.geo import haversine
    length = f"{haversine('xa0 / 1e7', 'ya0 / 1e7', 'xm / 1e7', 'ym / 1e7')} + {haversine('xm / 1e7', 'ym / 1e7', 'xb0 / 1e7', 'yb0 / 1e7')}"
    g = city.derive(spark, sf, "roads").selectExpr(
        "city", "ord", "road_id", "road_class", "lane_count", "speed_limit", "one_way", "city * 121 + r * 11 + c as a",
        "city * 121 + (r + vertical) * 11 + c + 1 - vertical as b", f"{length} as length", "xb0 - xm as fx", "yb0 - ym as fy", "xa0 - xm as bx", "ya0 - ym as by_")
    both = """inline(filter(array(
        named_struct('edge_id', ord * 2, 'src', a, 'dst', b, 'lanes', greatest(1L, case when one_way then lane_count else ceil(lane_count / 2) end), 'hx', fx, 'hy', fy),
        case when not one_way then named_struct('edge_id', ord * 2 + 1, 'src', b, 'dst', a, 'lanes', greatest(1L, floor(lane_count / 2)), 'hx', bx, 'hy', by_) end), _e -> _e is not null))"""
    return materialise(g.selectExpr("city", "ord as segment_key", "road_id", "road_class", "speed_limit", "length", both), "grid")


def seed_roads(spark, sf):
    """One selected road per city."""
    return city.derive(spark, sf, "roads").filter("j = 90").select("city", "road_id")


_TT = "length / (speed_limit / 3.6::DOUBLE)"
_RT = f"({_TT} / CASE road_class WHEN 'highway' THEN 1.0::DOUBLE WHEN 'arterial' THEN 0.9::DOUBLE WHEN 'collector' THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END)"


def _dist(name: str, edges: str, seeds: str, limit: str = "") -> str:
    """Recursive least-cost table (k, node, d) in SQL."""
    return f"""{name}(k, node, d) USING KEY (k, node) AS ({seeds} UNION SELECT s.k, e.dst, min(s.d + e.w) FROM {name} s JOIN {edges} e ON e.src = s.node
  LEFT JOIN recurring.{name} r ON r.k = s.k AND r.node = e.dst WHERE (r.d IS NULL OR s.d + e.w < r.d) {limit} GROUP BY s.k, e.dst)"""


def _rec(text: str) -> str:
    return "WITH RECURSIVE" + text[len("WITH"):]


_SRC = "SELECT DISTINCT city AS k, city * 121 + 60 AS node, 0.0::DOUBLE AS d FROM roads"


@query("g02_shortest_times", _rec(EDGES) + f", ew AS (SELECT src, dst, {_TT} AS w FROM edges), " + _dist("dd", "ew", _SRC) + f" SELECT k AS city, node, {sql_fixed('d', 5)} AS seconds FROM dd")
def shortest_times(spark, sf):
    e = grid_edges(spark, sf).withColumn("w", F.expr(gr.travel_time()))
    seeds = e.selectExpr("city as k", "city * 121 + 60 as node", "0D as d").distinct()
    return gr.shortest(e, seeds).selectExpr("k as city", "node", f"{fixed('d', 5)} as seconds")


@query("g03_bounded_distances", _rec(EDGES) + ", ew AS (SELECT src, dst, length AS w FROM edges), " + _dist("dd", "ew", _SRC, "AND s.d < 300") + f" SELECT k AS city, node, {sql_fixed('d', 4)} AS metres FROM dd")
def bounded(spark, sf):
    e = grid_edges(spark, sf).withColumn("w", F.col("length"))
    seeds = e.selectExpr("city as k", "city * 121 + 60 as node", "0D as d").distinct()
    return gr.shortest(e, seeds, 300.0).selectExpr("k as city", "node", f"{fixed('d', 4)} as metres")


_TREE = f", ew AS (SELECT dst AS src, src AS dst, {_RT} AS w FROM edges), " + _dist(
    "dd", "ew", "SELECT DISTINCT city * 121 + t.v AS k, city * 121 + t.v AS node, 0.0::DOUBLE AS d FROM roads, (VALUES (0), (115), (60)) t(v)")


def _targets(e):
    return e.selectExpr("city", "explode(array(0, 115, 60)) as v").selectExpr("city * 121 + v as node").distinct()


@query("g04_route_trees", _rec(EDGES) + _TREE + f" SELECT k AS target, node, {sql_fixed('d', 5)} AS cost FROM dd")
def trees(spark, sf):
    e = grid_edges(spark, sf).withColumn("w", F.expr(gr.route_time()))
    return gr.route_trees(e, _targets(e)).selectExpr("target", "node", f"{fixed('cost', 5)} as cost")


@query("g04_route_paths", _rec(EDGES) + _TREE + f" SELECT k AS target, node AS origin, {sql_fixed('d', 5)} AS cost FROM dd WHERE k <> node")
def route_paths(spark, sf):
    """Costs added up along the reconstructed routes, which must equal the tree's costs."""
    e = materialise(grid_edges(spark, sf).withColumn("w", F.expr(gr.route_time())), "weighted")
    t = gr.route_trees(e, _targets(e))
    pairs = t.filter("node <> target").selectExpr("struct(node as origin, target) as pair", "node as origin", "target")
    walked = gr.paths(t, pairs).join(e.select("edge_id", "w"), "edge_id").groupBy("pair").agg(F.sum("w").alias("cost"))
    return walked.selectExpr("pair.target as target", "pair.origin as origin", f"{fixed('cost', 5)} as cost")


@query("g07_connected_components", _rec(EDGES) + """, sym AS (SELECT src, dst, 0.0::DOUBLE AS w FROM edges UNION SELECT dst, src, 0.0::DOUBLE FROM edges),
 cc(node, c) USING KEY (node) AS (SELECT src AS node, src AS c FROM (SELECT DISTINCT src FROM sym) UNION SELECT e.dst, min(s.c) FROM cc s JOIN sym e ON e.src = s.node JOIN recurring.cc r ON r.node = e.dst WHERE s.c < r.c GROUP BY e.dst)
 SELECT node, c AS component FROM cc""")
def components(spark, sf):
    """Pieces the road network consists of."""
    return gr.connected_components(grid_edges(spark, sf))


_STUDY = f""", seed AS (SELECT city, road_id FROM roads WHERE j = 90), es AS (SELECT e.*, s.road_id IS NOT NULL AS seed FROM edges e LEFT JOIN seed s USING (city, road_id)),
 ed AS (SELECT src, dst, length AS w FROM edges), eu AS (SELECT dst AS src, src AS dst, length AS w FROM edges), src0 AS (SELECT DISTINCT city AS k, unnest([src, dst]) AS node, 0.0::DOUBLE AS d FROM es WHERE seed),
 {_dist('dn', 'ed', 'SELECT * FROM src0', f'AND s.d < {RANGE}')}, {_dist('up', 'eu', 'SELECT * FROM src0', f'AND s.d < {RANGE}')},
 e1 AS (SELECT es.*, dn.d AS dd, up.d AS du, coalesce(dn.d < {RANGE}, false) AS ind, coalesce(up.d < {RANGE}, false) AS inu FROM es LEFT JOIN dn ON dn.k = es.city AND dn.node = es.src LEFT JOIN up ON up.k = es.city AND up.node = es.dst),
 seg AS (SELECT city, segment_key, road_id, max(length) AS length, CASE WHEN bool_or(seed) THEN 'seed' WHEN bool_or(ind) AND bool_or(inu) THEN 'both' WHEN bool_or(ind) THEN 'downstream' ELSE 'upstream' END AS role,
  min(CASE WHEN seed THEN 0 WHEN ind AND inu THEN least(dd, du) WHEN ind THEN dd ELSE du END) AS distance FROM e1 WHERE seed OR ind OR inu GROUP BY ALL),
 anode AS (SELECT DISTINCT city, unnest([src, dst]) AS node FROM e1 WHERE seed OR ind OR inu), outer_e AS (SELECT * FROM e1 WHERE (city, segment_key) NOT IN (SELECT city, segment_key FROM seg)),
 bnd AS (SELECT city, node, CASE WHEN bool_or(x) AND bool_or(NOT x) THEN 'entry_exit' WHEN bool_or(x) THEN 'exit' ELSE 'entry' END AS kind FROM (SELECT city, src AS node, true AS x FROM outer_e UNION ALL SELECT city, dst, false FROM outer_e)
  WHERE (city, node) IN (SELECT city, node FROM anode) GROUP BY ALL),
 nd AS (SELECT k AS city, node, min(d) AS distance FROM (SELECT * FROM dn UNION ALL SELECT * FROM up) GROUP BY ALL),
 arm AS (SELECT city, node, count(DISTINCT segment_key) AS arms, count(*) FILTER (o) AS ways_out, count(*) FILTER (NOT o) AS ways_in FROM (SELECT city, src AS node, segment_key, true AS o FROM edges UNION ALL SELECT city, dst, segment_key, false FROM edges) GROUP BY ALL)
"""
_S = _rec(EDGES) + _STUDY


def study(spark, sf):
    return st.grow(grid_edges(spark, sf), seed_roads(spark, sf), RANGE)


@query("g08_study_area", _S + f" SELECT city, segment_key, role, {sql_fixed('distance', 4)} AS distance FROM seg")
def study_area(spark, sf):
    return study(spark, sf).segments.selectExpr("city", "segment_key", "role", f"{fixed('distance', 4)} as distance")


@query("f03_segments_by_distance", _S + " SELECT city, segment_key, row_number() OVER (PARTITION BY city ORDER BY distance, segment_key) AS position FROM seg")
def by_distance(spark, sf):
    return study(spark, sf).segments.selectExpr("city", "segment_key", "bigint(row_number() over (partition by city order by distance, segment_key)) as position")


@query("g09_boundary_points", _S + " SELECT city, node, kind FROM bnd")
def boundary(spark, sf):
    return st.boundary_points(study(spark, sf))


@query("d14_study_area_stats", _S + f""" SELECT city, count(DISTINCT road_id) AS roads, count(*) AS segments, {sql_fixed('sum(length) / 1000', 5)} AS km,
  (SELECT count(*) FROM anode a JOIN nd USING (city, node) JOIN arm USING (city, node) WHERE a.city = seg.city AND arms >= 3 AND nd.distance < {RANGE}) AS junctions,
  (SELECT count(*) FROM bnd WHERE bnd.city = seg.city AND kind <> 'exit') AS entries, (SELECT count(*) FROM bnd WHERE bnd.city = seg.city AND kind <> 'entry') AS exits FROM seg GROUP BY city""")
def stats(spark, sf):
    area = study(spark, sf)
    return st.area_stats(area, st.boundary_points(area), st.node_arms(area.edges), RANGE).withColumn("km", F.expr(fixed("km", 5)))


_PROB = f""", prob AS (SELECT city, node, distance, CASE WHEN ways_in > 0 AND ways_out = 0 THEN 'one_way_trap' WHEN ways_out > 0 AND ways_in = 0 THEN 'one_way_source' WHEN arms = 1 THEN 'dead_end' END AS kind
  FROM anode JOIN nd USING (city, node) JOIN arm USING (city, node) WHERE distance < {RANGE})"""


@query("g10_node_problems", _S + _PROB + " SELECT city, node, kind, CASE kind WHEN 'dead_end' THEN 'info' ELSE 'warning' END AS severity FROM prob WHERE kind IS NOT NULL")
def problems(spark, sf):
    area = study(spark, sf)
    return st.node_problems(area, st.node_arms(area.edges), RANGE).select("city", "node", "kind", "severity")


@query("f02_problem_order", _S + _PROB + """ SELECT city, node, row_number() OVER (PARTITION BY city ORDER BY CASE kind WHEN 'dead_end' THEN 2 ELSE 1 END, distance, node) AS position FROM prob WHERE kind IS NOT NULL""")
def problem_order(spark, sf):
    area = study(spark, sf)
    df = st.node_problems(area, st.node_arms(area.edges), RANGE)
    return df.selectExpr("city", "node", "bigint(row_number() over (partition by city order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, distance, node)) as position")


_REACH = """, inr AS (SELECT DISTINCT city, segment_key FROM e1 WHERE seed OR ind OR inu), e2 AS (SELECT *, (city, segment_key) IN (SELECT city, segment_key FROM inr) AS inside FROM e1),
 inn AS (SELECT DISTINCT city, unnest([src, dst]) AS node FROM e2 WHERE inside), fre AS (SELECT * FROM inn WHERE (city, node) NOT IN (SELECT k, node FROM src0)),
 ent AS (SELECT DISTINCT f.city, f.node FROM fre f JOIN e2 ON e2.dst = f.node AND NOT e2.inside), exi AS (SELECT DISTINCT f.city, f.node FROM fre f JOIN e2 ON e2.src = f.node AND NOT e2.inside),
 ea AS (SELECT src, dst FROM e2 WHERE inside), eb AS (SELECT src, dst FROM e2 WHERE inside AND NOT seed),
 ra(k, node) AS (SELECT node, node FROM ent UNION SELECT ra.k, ea.dst FROM ra JOIN ea ON ea.src = ra.node), rb(k, node) AS (SELECT node, node FROM ent UNION SELECT rb.k, eb.dst FROM rb JOIN eb ON eb.src = rb.node)"""


@query("g11_no_alternative", _S + _REACH + """ SELECT x.city, count(*) AS pairs, count(*) FILTER ((k, node) NOT IN (SELECT k, node FROM rb)) AS dependent FROM ra JOIN exi x USING (node) WHERE k <> node GROUP BY x.city""")
def no_alternative(spark, sf):
    return st.dependent_pairs(study(spark, sf))


_CAPQ = """, cap AS (SELECT *, lanes * CASE road_class WHEN 'highway' THEN 1800 WHEN 'arterial' THEN 1400 WHEN 'collector' THEN 1000 ELSE 600 END AS vph FROM outer_e),
 ins AS (SELECT city, src, dst FROM e1 WHERE (city, segment_key) IN (SELECT city, segment_key FROM seg)),
 f0 AS (SELECT city, node, CAST(sum(vin) AS BIGINT) AS vin, CAST(sum(vout) AS BIGINT) AS vout FROM (SELECT city, dst AS node, vph AS vin, 0 AS vout FROM cap UNION ALL SELECT city, src, 0, vph FROM cap) GROUP BY ALL),
 f1 AS (SELECT city, node, CASE WHEN node IN (SELECT src FROM ins) THEN vin ELSE 0 END AS in_vph, CASE WHEN node IN (SELECT dst FROM ins) THEN vout ELSE 0 END AS out_vph FROM f0),
 fl AS (SELECT * FROM f1 WHERE in_vph > 0 OR out_vph > 0)"""


@query("d25_edge_capacity_flows", _S + _CAPQ + " SELECT city, node, in_vph, out_vph FROM fl")
def capacity_flows(spark, sf):
    return st.edge_capacity_flows(study(spark, sf))


_OD = _CAPQ + """, inc AS (SELECT src, dst FROM e1 WHERE (city, segment_key) IN (SELECT city, segment_key FROM seg)), rr(k, node) AS (SELECT node, node FROM fl WHERE in_vph > 0 UNION SELECT rr.k, inc.dst FROM rr JOIN inc ON inc.src = rr.node),
 pr AS (SELECT a.city, a.node AS entry, b.node AS exit, a.in_vph, b.out_vph, sum(b.out_vph) OVER (PARTITION BY a.node) AS total FROM rr JOIN fl a ON a.node = rr.k JOIN fl b ON b.node = rr.node WHERE rr.k <> rr.node AND b.out_vph > 0)"""


def _inner_reach(area, flows):
    inner = area.edges.join(area.segments.select("city", "segment_key"), ["city", "segment_key"], "left_semi").select("src", "dst").distinct()
    seeds = flows.filter("in_vph > 0").selectExpr("named_struct('city', city, 'entry', node) as k", "node")
    return gr.reachable(inner, seeds).selectExpr("k.city as city", "k.entry as entry", "node")


@query("g18_synthetic_od", _S + _OD + f""" SELECT city, entry, exit, v.kind, {sql_fixed('in_vph * 0.12::DOUBLE * out_vph / total * v.share', 5)} AS vph FROM pr, (VALUES ('car', 0.3::DOUBLE), ('two_wheeler', 0.6::DOUBLE), ('bus_auto', 0.1::DOUBLE)) v(kind, share)""")
def synthetic(spark, sf):
    area = study(spark, sf)
    flows = materialise(st.edge_capacity_flows(area), "flows")
    return st.synthetic_od(flows, _inner_reach(area, flows)).withColumn("vph", F.expr(fixed("vph", 5)))


@query("g19_assigned_loads", None)
def loads(spark, sf):
    """Car flow per edge when every place's trips to three targets take the fastest route."""
    e = grid_edges(spark, sf).withColumn("w", F.expr(gr.route_time()))
    t = materialise(gr.route_trees(e, _targets(e)), "trees")
    demand = t.selectExpr("node as origin", "target", "double(node % 7 + 1) as flow")
    return st.edge_loads(t, demand).selectExpr("edge_id", f"{fixed('load', 3)} as load")


@query("g17_select_link_pairs", None)
def select_links(spark, sf):
    area = study(spark, sf)
    flows = materialise(st.edge_capacity_flows(area), "flows")
    inner = materialise(area.edges.join(area.segments.select("city", "segment_key"), ["city", "segment_key"], "left_semi").withColumn("w", F.expr(gr.route_time())), "inner")
    watched = inner.filter("seed").selectExpr("city", "edge_id as link", "src as link_from", "dst as link_to", "w as link_time")  # as route choice sees it, like the ways to and from it
    sinks = flows.filter("out_vph > 0").selectExpr("city", "node as exit", "out_vph as sink_weight")
    sources = flows.filter("in_vph > 0").selectExpr("city", "node as entry", "in_vph / 3600 as rate")
    targets = sinks.selectExpr("exit as node").unionByName(watched.selectExpr("link_from as node")).distinct()
    times = materialise(gr.route_trees(inner, targets), "times")
    return st.select_link_pairs(sources, watched, sinks, times).selectExpr("city", "entry", "link", "exit", f"{fixed('detour', 4)} as detour", f"{fixed('weight', 4)} as weight")


@query("g20_junction_control", EDGES + """, h AS (SELECT *, degrees(atan2(hx::DOUBLE, hy::DOUBLE)) AS hd, CASE road_class WHEN 'highway' THEN 4 WHEN 'arterial' THEN 3 WHEN 'collector' THEN 2 ELSE 1 END AS rank FROM edges),
 arm AS (SELECT node, count(DISTINCT segment_key) AS arms FROM (SELECT src AS node, segment_key FROM edges UNION ALL SELECT dst, segment_key FROM edges) GROUP BY 1 HAVING count(DISTINCT segment_key) >= 3),
 i AS (SELECT h.*, arms, first_value(hd) OVER (PARTITION BY dst ORDER BY edge_id) AS ref FROM h JOIN arm ON arm.node = h.dst),
 x AS (SELECT *, CASE WHEN abs(hd - ref) > 180 THEN 360 - abs(hd - ref) ELSE abs(hd - ref) END AS gap FROM i),
 n AS (SELECT city, dst AS node, arms, bool_or((gap < 45 OR gap > 135) AND rank >= 2) AND bool_or(NOT (gap < 45 OR gap > 135) AND rank >= 2) AS bm, max(rank) AS top, min(rank) AS low FROM x GROUP BY ALL)
 SELECT city, node, arms, CASE WHEN arms >= 4 AND bm THEN 'signal' ELSE 'priority' END AS control, CASE WHEN NOT (arms >= 4 AND bm) AND low < top THEN top END AS major_rank FROM n""")
def control(spark, sf):
    e = grid_edges(spark, sf).selectExpr("*", "degrees(atan2(double(hx), double(hy))) as heading_end",
                                         "case road_class when 'highway' then 4 when 'arterial' then 3 when 'collector' then 2 else 1 end as rank", "edge_id as ord_key")
    return st.junction_control(e)


_SEEDPTS = """, sp AS (SELECT city, xa0 / 1e7 AS ax, ya0 / 1e7 AS ay, xm / 1e7 AS bx, ym / 1e7 AS by_ FROM roads WHERE j = 90 UNION ALL SELECT city, xm / 1e7, ym / 1e7, xb0 / 1e7, yb0 / 1e7 FROM roads WHERE j = 90)"""


@query("g10_isolated_pieces", _rec(EDGES).replace(cte("roads").removeprefix("WITH "), cte("roads", "proposals").removeprefix("WITH "), 1) + f""", drawn AS (SELECT city, id AS road_id, -2 * ord - 1 AS src, -2 * ord - 2 AS dst, xa, ya, xb, yb FROM proposals WHERE type = 'road'),
 used AS (SELECT city, road_id, src, dst FROM edges UNION ALL SELECT city, road_id, src, dst FROM drawn), sym AS (SELECT src, dst FROM used UNION SELECT dst, src FROM used),
 cc(node, c) USING KEY (node) AS (SELECT src AS node, src AS c FROM (SELECT DISTINCT src FROM sym) UNION SELECT e.dst, min(s.c) FROM cc s JOIN sym e ON e.src = s.node JOIN recurring.cc r ON r.node = e.dst WHERE s.c < r.c GROUP BY e.dst){_SEEDPTS},
 pts AS (SELECT DISTINCT city, a AS node, xa0 / 1e7 AS lon, ya0 / 1e7 AS lat FROM g UNION SELECT DISTINCT city, b, xb0 / 1e7, yb0 / 1e7 FROM g UNION SELECT city, src, xa / 1e7, ya / 1e7 FROM drawn UNION SELECT city, dst, xb / 1e7, yb / 1e7 FROM drawn), lk AS (SELECT DISTINCT cc.c FROM cc JOIN used u ON u.src = cc.node JOIN roads r ON r.road_id = u.road_id WHERE r.j = 90),
 sz AS (SELECT u.city, c AS component, count(DISTINCT u.road_id) AS roads FROM cc JOIN used u ON u.src = cc.node WHERE c NOT IN (SELECT c FROM lk) GROUP BY ALL),
 d AS (SELECT p.city, cc.c AS component, p.lon, p.lat, s.*, greatest(0, least(1, ((p.lon - ax) * (bx - ax) * pow(cos(radians(p.lat)), 2) + (p.lat - ay) * (by_ - ay)) / (pow(bx - ax, 2) * pow(cos(radians(p.lat)), 2) + pow(by_ - ay, 2)))) AS t FROM pts p JOIN cc USING (node) JOIN sp s ON s.city = p.city),
 m AS (SELECT city, component, min(sqrt(pow((ax + t * (bx - ax) - lon) * 111320.0::DOUBLE * cos(radians(lat)), 2) + pow((ay + t * (by_ - ay) - lat) * 111320.0::DOUBLE, 2))) AS metres FROM d GROUP BY ALL)
 SELECT city, component, roads, {sql_fixed('metres', 3)} AS metres FROM sz JOIN m USING (city, component) WHERE metres <= 300""")
def isolated(spark, sf):
    """Pieces of the network of all roads and proposed roads cut off from the selected road, within 300 m of it."""
    from ..functions.geo import pt
    from .nearest_queries import grid_nodes
    seeds = city.derive(spark, sf, "roads").filter("j = 90").selectExpr(
        "city", "ord", "road_id", f"array({pt('xa0 / 1e7', 'ya0 / 1e7')}, {pt('xm / 1e7', 'ym / 1e7')}, {pt('xb0 / 1e7', 'yb0 / 1e7')}) as coordinates")
    drawn = city.derive(spark, sf, "proposals").filter("type = 'road'")
    every = grid_edges(spark, sf).select("city", "road_id", "src", "dst").unionByName(drawn.selectExpr("city", "id as road_id", "-2 * ord - 1 as src", "-2 * ord - 2 as dst"))
    ends = drawn.selectExpr("city", "inline(array(struct(-2 * ord - 1 as node, xa / 1e7 as lon, ya / 1e7 as lat), struct(-2 * ord - 2 as node, xb / 1e7 as lon, yb / 1e7 as lat)))").selectExpr("*", "0D as z")
    return st.isolated_pieces(materialise(every, "network"), grid_nodes(spark, sf).unionByName(ends), seeds, 300.0).withColumn("metres", F.expr(fixed("metres", 3)))
