"""Road network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import fixed
from ..operators import network as nw
from ..session import materialise
from ..sources import citydata as city
from ..sources.citydata import cte, sql_fixed, sql_hav
from .registry import query

_LANES = ["lane_count", "one_way", "speed_limit", "capacity", "cast(null as bigint) as lanes_a", "cast(null as bigint) as lanes_b"]


def mapped_roads(spark, sf):
    """Every road as the map has it: ends on shared vertices."""
    from ..functions.geo import pt
    line = f"array({pt('xa0 / 1e7', 'ya0 / 1e7')}, {pt('xm / 1e7', 'ym / 1e7')}, {pt('xb0 / 1e7', 'yb0 / 1e7')}) as coordinates"
    return city.derive(spark, sf, "roads").selectExpr("city", "ord", "road_id", "road_class", "roundabout", line, "true as osm", "true as imported", "layer", *_LANES)


def drawn_roads(spark, sf):
    """Imported and drawn roads mixed, drawn ones with ends off by a few metres."""
    return city.roads(spark, sf).selectExpr("city", "ord", "road_id", "road_class", "roundabout", "coordinates", "imported as osm", "imported",
                                            "case when imported then layer end as layer", *_LANES)


def mapped_network(spark, sf):
    roads = materialise(mapped_roads(spark, sf), "roads")
    return roads, nw.build_network(roads)


# The mapped grid in closed form: every road is one stretch between its end vertices.
# Where another road meets its first vertex, the cut there takes number 0 for an empty
# piece (dropped as too short), so the stretch is number 1.
def _name(x: str, y: str) -> str:
    def part(v, w):
        f5 = f"CAST(floor({v} / 1e7 * 1e5::DOUBLE + 0.5) AS BIGINT)"
        return f"format('{{}}.{{:05d}}', {f5} // 100000, {f5} % 100000)"
    return f"concat('node_', {part(x, 0)}, '_', {part(y, 0)}, '_0.0')"


_L1 = sql_hav("xa0 / 1e7", "ya0 / 1e7", "xm / 1e7", "ym / 1e7")
_L2 = sql_hav("xm / 1e7", "ym / 1e7", "xb0 / 1e7", "yb0 / 1e7")
GRID = cte("roads") + f""", ends_at AS (SELECT city, x, y, count(*) AS n FROM (SELECT city, xa0 AS x, ya0 AS y FROM roads UNION ALL SELECT city, xb0, yb0 FROM roads) GROUP BY ALL),
g AS (SELECT r.*, {_name('xa0', 'ya0')} AS na, {_name('xb0', 'yb0')} AS nb, {_L1} + {_L2} AS length, concat(road_id, '_seg_', CASE WHEN t.n > 1 THEN '1' ELSE '0' END) AS segment_key
  FROM roads r JOIN ends_at t ON t.city = r.city AND t.x = r.xa0 AND t.y = r.ya0),
edges AS (SELECT city, ord, road_id, concat(segment_key, '_fwd') AS edge_id, segment_key, na AS from_node, nb AS to_node, length, greatest(1, CASE WHEN one_way THEN lane_count ELSE (lane_count + 1) // 2 END) AS lanes,
  CASE WHEN one_way THEN 'forward' ELSE 'both' END AS direction, speed_limit, CASE WHEN one_way THEN capacity ELSE capacity // 2 END AS capacity, road_class,
  xa0 AS sx, ya0 AS sy, xm AS mx, ym AS my, xb0 AS tx, yb0 AS ty FROM g
 UNION ALL SELECT city, ord, road_id, concat(segment_key, '_bwd'), segment_key, nb, na, length, greatest(1, lane_count // 2), 'backward', speed_limit, capacity // 2, road_class, xb0, yb0, xm, ym, xa0, ya0 FROM g WHERE NOT one_way)
"""


@query("c02_road_pairs", cte("roads") + """, b AS (SELECT city, ord, road_id, least(xa, xm, xb) / 1e7 AS x0, least(ya, ym, yb) / 1e7 AS y0, greatest(xa, xm, xb) / 1e7 AS x1, greatest(ya, ym, yb) / 1e7 AS y1 FROM roads)
 SELECT a.city, a.road_id AS road_a, b.road_id AS road_b FROM b a JOIN b b ON a.city = b.city AND a.ord < b.ord AND a.x0 <= b.x1 + 0.00012::DOUBLE AND a.x1 + 0.00012::DOUBLE >= b.x0
  AND a.y0 <= b.y1 + 0.00012::DOUBLE AND a.y1 + 0.00012::DOUBLE >= b.y0""")
def road_pairs(spark, sf):
    return nw.road_pairs(city.roads(spark, sf))


@query("g01_network_edges", GRID + f"SELECT city, edge_id, from_node, to_node, {sql_fixed('length', 4)} AS length, lanes, direction, speed_limit, capacity FROM edges")
def edges(spark, sf):
    _, net = mapped_network(spark, sf)
    return net.edges.selectExpr("city", "edge_id", "from_node", "to_node", f"{fixed('length', 4)} as length", "lanes", "direction", "speed_limit", "capacity")


@query("g01_network_drawn_roads", None)
def drawn(spark, sf):
    net = nw.build_network(materialise(drawn_roads(spark, sf), "roads"))
    return net.edges.selectExpr("city", "edge_id", "from_node", "to_node", f"{fixed('length', 2)} as length")


@query("g05_cluster_nodes", None)
def clusters(spark, sf):
    roads = city.roads(spark, sf)
    ends = roads.selectExpr("city", "imported as osm", "inline(array(named_struct('p', coordinates[0], 'first', ord * 2), named_struct('p', coordinates[2], 'first', ord * 2 + 1)))").selectExpr(
        "city", "osm", "p.lon", "p.lat", "p.z", "first")
    return nw.cluster_nodes(ends).select("city", "first", "node_first", "node_id")


@query("d10_network_diagnostics", GRID + """, n AS (SELECT city, node, count(DISTINCT ord) AS roads, bool_or(rb) AS rb FROM (SELECT city, na AS node, ord, roundabout AS rb FROM g UNION ALL SELECT city, nb, ord, roundabout FROM g) GROUP BY ALL)
 SELECT r.city, r.roads, n.nodes, e.edges, 0::BIGINT AS unconnected, n.roundabout_nodes, n.suspicious FROM (SELECT city, count(*) AS roads FROM g GROUP BY 1) r JOIN (SELECT city, count(*) AS edges FROM edges GROUP BY 1) e USING (city)
 JOIN (SELECT city, count(*) AS nodes, count(*) FILTER (rb) AS roundabout_nodes, count(*) FILTER (roads > 4) AS suspicious FROM n GROUP BY 1) n USING (city)""")
def diagnostics(spark, sf):
    roads, net = mapped_network(spark, sf)
    d = nw.node_degrees(net.edges, roads.filter("roundabout"))
    return nw.diagnostics(roads, net, d).select("city", "roads", "nodes", "edges", "unconnected", "roundabout_nodes", "suspicious")


_DEG = """, n AS (SELECT city, node, count(DISTINCT ord) AS roads, bool_or(rb) AS rb FROM (SELECT city, na AS node, ord, roundabout AS rb FROM g UNION ALL SELECT city, nb, ord, roundabout FROM g) GROUP BY ALL)"""


@query("d11_node_degree_audit", GRID + _DEG + """ SELECT city, CASE roads WHEN 1 THEN 'dead_end' WHEN 2 THEN 'link' WHEN 3 THEN 't' WHEN 4 THEN 'x' ELSE 'complex' END AS kind, count(*) AS nodes FROM n GROUP BY ALL""")
def audit(spark, sf):
    _, net = mapped_network(spark, sf)
    return nw.degree_audit(nw.node_degrees(net.edges))


@query("d12_junction_kinds", GRID + _DEG + """ SELECT city, node AS node_id, CASE WHEN roads = 1 THEN 'dead_end' WHEN roads = 2 THEN NULL WHEN rb THEN 'roundabout' WHEN roads = 3 THEN 't_junction' WHEN roads = 4 THEN 'crossroads' ELSE 'complex' END AS kind FROM n""")
def kinds(spark, sf):
    roads, net = mapped_network(spark, sf)
    return nw.node_degrees(net.edges, roads.filter("roundabout")).selectExpr("city", "node_id", f"{nw.junction_kind()} as kind")


_TURN = GRID + """, ni AS (SELECT city, to_node AS node, count(*) AS n_in FROM edges GROUP BY ALL), no AS (SELECT city, from_node AS node, count(*) AS n_out FROM edges GROUP BY ALL),
 t AS (SELECT i.city, i.to_node AS node_id, i.edge_id AS from_edge, o.edge_id AS to_edge, degrees(atan2((o.my - o.sy)::DOUBLE, (o.mx - o.sx)::DOUBLE) - atan2((i.ty - i.my)::DOUBLE, (i.tx - i.mx)::DOUBLE)) AS a0
  FROM edges i JOIN edges o ON i.city = o.city AND i.to_node = o.from_node JOIN ni ON ni.city = i.city AND ni.node = i.to_node JOIN no ON no.city = i.city AND no.node = i.to_node
  WHERE NOT (i.road_id = o.road_id AND i.direction <> o.direction AND NOT (n_in = 1 AND n_out = 1))),
 u AS (SELECT *, CASE WHEN a0 > 180 THEN a0 - 360 WHEN a0 < -180 THEN a0 + 360 ELSE a0 END AS a FROM t)
"""


@query("c24_turns", _TURN + """SELECT city, node_id, from_edge, to_edge, CASE WHEN abs(a) <= 35 THEN 'straight' WHEN a > 35 AND a < 145 THEN 'right' WHEN a < -35 AND a > -145 THEN 'left' ELSE 'u_turn' END AS direction FROM u""")
def turns(spark, sf):
    _, net = mapped_network(spark, sf)
    return nw.turns(net.edges).select("city", "node_id", "from_edge", "to_edge", "direction")


@query("h19_turn_labels", _TURN + """SELECT CASE WHEN abs(a) <= 35 THEN 'straight' WHEN a > 35 AND a < 145 THEN 'right' WHEN a < -35 AND a > -145 THEN 'left' ELSE 'u_turn' END AS direction,
  CASE WHEN abs(a) <= 35 THEN 'straight' WHEN a > 35 AND a < 145 THEN 'left' WHEN a < -35 AND a > -145 THEN 'right' ELSE 'u_turn' END AS geometric_turn, count(*) AS movements FROM u GROUP BY ALL""")
def turn_labels(spark, sf):
    _, net = mapped_network(spark, sf)
    return nw.turns(net.edges).groupBy("direction", "geometric_turn").agg(F.expr("count(1)").alias("movements"))


@query("e02_split_points", cte("roads") + "," + city.ROAD_POINTS + """, v AS (SELECT p.*, r.imported FROM road_points p JOIN roads r USING (city, ord))
 SELECT DISTINCT a.city, a.ord, least(a.pos, 1)::INT AS seg, a.x, a.y FROM v a JOIN v b ON a.city = b.city AND a.x = b.x AND a.y = b.y AND a.ord <> b.ord AND a.imported AND b.imported""")
def splits(spark, sf):
    return nw.shared_vertex_splits(drawn_roads(spark, sf)).selectExpr("city", "ord", "seg", "floor(lon * 1e7 + 0.5D) as x", "floor(lat * 1e7 + 0.5D) as y").distinct()
