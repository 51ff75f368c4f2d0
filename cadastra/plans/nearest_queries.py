"""Nearest, within-distance and overlap join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import bounds, fixed, pt, widen
from ..operators import demand as dm
from ..operators import nearest as ne
from ..operators import structures
from ..operators.spatial import join_boxes
from ..sources import citydata as city
from ..sources.citydata import ROAD_POINTS, ROAD_SEGMENTS, cte, sql_fixed, sql_hav
from .registry import query


def roads(spark, sf):
    return city.roads(spark, sf).select("city", "ord", "road_id", "coordinates", "imported", "lane_count", "capacity", "size")


def corners(spark, sf):
    return city.derive(spark, sf, "buildings").selectExpr("city", "building_id as id", "x0 / 1e7 as lon", "y0 / 1e7 as lat", "0D as z")


def grid_nodes(spark, sf):
    """Street vertices as routing nodes."""
    r = city.derive(spark, sf, "roads")
    ends = r.selectExpr("city", "inline(array(struct(city * 121 + r * 11 + c as node, xa0 as x, ya0 as y), struct(city * 121 + (r + vertical) * 11 + c + 1 - vertical as node, xb0 as x, yb0 as y)))")
    return ends.distinct().selectExpr("city", "node", "x / 1e7 as lon", "y / 1e7 as lat", "0D as z")


def grid_lines(spark, sf):
    return city.derive(spark, sf, "roads").selectExpr(
        "city", "ord", "road_id as edge_id", "city * 121 + r * 11 + c as from_node", "city * 121 + (r + vertical) * 11 + c + 1 - vertical as to_node",
        f"array({pt('xa0 / 1e7', 'ya0 / 1e7')}, {pt('xm / 1e7', 'ym / 1e7')}, {pt('xb0 / 1e7', 'yb0 / 1e7')}) as coordinates")


_NODES = """, nodes AS (SELECT DISTINCT city, city * 121 + r * 11 + c AS node, xa0 / 1e7 AS lon, ya0 / 1e7 AS lat FROM roads UNION SELECT DISTINCT city, city * 121 + (r + vertical) * 11 + c + 1 - vertical, xb0 / 1e7, yb0 / 1e7 FROM roads)"""


def _seg_join(points: str, max_m: float, extra: str = "true") -> str:
    """Rows (point columns, road, d in metres, x, y) of all points and road pieces of a city."""
    return f""", sj AS (SELECT p.*, s.ord AS r_ord, s.road_id AS r_id, s.seg, s.ax, s.ay, s.bx, s.by_, greatest(0, least(1, ((p.lon - ax) * (bx - ax) * pow(cos(radians(p.lat)), 2) + (p.lat - ay) * (by_ - ay))
  / (pow(bx - ax, 2) * pow(cos(radians(p.lat)), 2) + pow(by_ - ay, 2)))) AS t FROM {points} p JOIN road_segments s ON s.city = p.city AND {extra}),
 sd AS (SELECT *, ax + t * (bx - ax) AS x, ay + t * (by_ - ay) AS y FROM sj), sm AS (SELECT *, sqrt(pow((x - lon) * 111320.0::DOUBLE * cos(radians(lat)), 2) + pow((y - lat) * 111320.0::DOUBLE, 2)) AS d FROM sd),
 hits AS (SELECT * FROM sm WHERE d <= {max_m})"""


_C = cte("roads", "buildings") + "," + ROAD_SEGMENTS + ", pts AS (SELECT city, building_id AS id, x0 / 1e7 AS lon, y0 / 1e7 AS lat FROM buildings)"


@query("c04_points_in_zones", cte("roads", "zones") + """, v AS (SELECT city, road_id, xa AS x, ya AS y FROM roads), zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0]) AS ax, unnest([y0,y0,y1,ym,y1]) AS ay, unnest([x1,x1,xm,x0,x0]) AS bx, unnest([y0,y1,ym,y1,y0]) AS by_ FROM zones)
 SELECT v.city, v.road_id, zone_id FROM v JOIN zr z ON z.city = v.city WHERE (z.by_ > y) <> (z.ay > y) AND x < (z.ax - z.bx) * ((y - z.by_)::DOUBLE / (z.ay - z.by_)) + z.bx GROUP BY ALL HAVING count(*) % 2 = 1""")
def points_in_zones(spark, sf):
    pts = city.derive(spark, sf, "roads").selectExpr("city", "road_id", "xa / 1e7 as lon", "ya / 1e7 as lat")
    return dm.points_in_zones(pts, city.zones(spark, sf), ["road_id"])


@query("d04_zone_summary", cte("roads", "zones", "buildings", "gateways") + """, v AS (SELECT city, 'road' AS k, road_id AS id, xa AS x, ya AS y FROM roads UNION ALL SELECT city, 'building', building_id, x0, y0 FROM buildings UNION ALL SELECT city, 'gateway', gateway_id, x, y FROM gateways),
 zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0]) AS ax, unnest([y0,y0,y1,ym,y1]) AS ay, unnest([x1,x1,xm,x0,x0]) AS bx, unnest([y0,y1,ym,y1,y0]) AS by_ FROM zones),
 h AS (SELECT z.zone_id, v.k, v.id FROM v JOIN zr z ON z.city = v.city WHERE (z.by_ > y) <> (z.ay > y) AND x < (z.ax - z.bx) * ((y - z.by_)::DOUBLE / (z.ay - z.by_)) + z.bx GROUP BY ALL HAVING count(*) % 2 = 1)
 SELECT z.zone_id, count(*) FILTER (k = 'road') AS roads, count(*) FILTER (k = 'building') AS buildings, count(*) FILTER (k = 'gateway') AS gateways FROM zones z LEFT JOIN h USING (zone_id) GROUP BY 1""")
def zone_summary(spark, sf):
    def rows(name, kind, key, x, y):
        return city.derive(spark, sf, name).selectExpr("city", f"'{kind}' as kind", f"{key} as id", f"{x} / 1e7 as lon", f"{y} / 1e7 as lat")
    pts = rows("roads", "road", "road_id", "xa", "ya").unionByName(rows("buildings", "building", "building_id", "x0", "y0")).unionByName(rows("gateways", "gateway", "gateway_id", "x", "y"))
    zones = city.zones(spark, sf)
    return dm.zone_counts(dm.points_in_zones(pts, zones, ["kind", "id"]), zones)


@query("c05_building_access", cte("roads", "buildings") + f""", e AS (SELECT city, ord, road_id AS edge_id, city * 121 + r * 11 + c AS fn, city * 121 + (r + vertical) * 11 + c + 1 - vertical AS tn, xa0, ya0, xm, ym, xb0, yb0 FROM roads),
 s AS (SELECT city, ord, edge_id, fn, tn, 0 AS seg, xa0 / 1e7 AS ax, ya0 / 1e7 AS ay, xm / 1e7 AS bx, ym / 1e7 AS by_ FROM e UNION ALL SELECT city, ord, edge_id, fn, tn, 1, xm / 1e7, ym / 1e7, xb0 / 1e7, yb0 / 1e7 FROM e),
 j AS (SELECT b.building_id AS id, x0 / 1e7 AS lon, y0 / 1e7 AS lat, s.*, greatest(0, least(1, ((x0 / 1e7 - ax) * (bx - ax) + (y0 / 1e7 - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM buildings b JOIN s USING (city)),
 d AS (SELECT *, ax + t * (bx - ax) AS x, ay + t * (by_ - ay) AS y FROM j), m AS (SELECT *, sqrt(pow(lon - x, 2) + pow(lat - y, 2)) AS d FROM d)
 SELECT city, id, arg_min(edge_id, (d, ord, seg)) AS edge_id, arg_min(CASE WHEN {sql_hav('x', 'y', 'ax', 'ay')} < {sql_hav('x', 'y', 'bx', 'by_')} THEN fn ELSE tn END, (d, ord, seg)) AS access_node FROM m GROUP BY ALL""")
def building_access(spark, sf):
    return ne.building_access(corners(spark, sf), grid_lines(spark, sf)).select("city", "id", "edge_id", "access_node")


_GW = cte("roads", "gateways") + _NODES + f""", gd AS (SELECT g.city, gateway_id, g.x / 1e7 AS glon, g.y / 1e7 AS glat, node, n.lon, n.lat, {sql_hav('g.x / 1e7', 'g.y / 1e7', 'n.lon', 'n.lat')} AS d FROM gateways g JOIN nodes n USING (city)),
 near AS (SELECT *, row_number() OVER (PARTITION BY gateway_id ORDER BY d, node) AS rn FROM gd)"""


@query("c06_gateway_nodes", _GW + f""" SELECT gateway_id, node, {sql_fixed('d', 3)} AS metres, (SELECT arg_min(road_id, ({sql_hav('glon', 'glat', 'xa0 / 1e7', 'ya0 / 1e7')}, ord)) FROM roads r WHERE r.city = near.city
  AND node IN (r.city * 121 + r * 11 + c, r.city * 121 + (r + vertical) * 11 + c + 1 - vertical)) AS edge_id FROM near WHERE rn = 1""".replace("r.city * 121 + r * 11", "r.city * 121 + r.r * 11").replace("(r + vertical)", "(r.r + r.vertical)"))
def gateway_nodes(spark, sf):
    placed = ne.gateway_nodes(city.points(spark, sf, "gateways").select("city", "gateway_id", "lon", "lat"), grid_nodes(spark, sf).drop("z"))
    edges = ne.gateway_edges(placed, grid_lines(spark, sf))
    return placed.join(edges.drop("node"), "gateway_id").selectExpr("gateway_id", "node", f"{fixed('d', 3)} as metres", "edge_id")


@query("c07_gateway_placement", _GW + " SELECT gateway_id, sqrt(pow(glon - lon, 2) + pow(glat - lat, 2)) <= 0.0004::DOUBLE AS placed FROM near WHERE rn = 1")
def gateway_placement(spark, sf):
    """Gateways near enough to a node; the limit is tightened so that both outcomes occur."""
    placed = ne.gateway_nodes(city.points(spark, sf, "gateways").select("city", "gateway_id", "lon", "lat"), grid_nodes(spark, sf).drop("z"))
    return placed.selectExpr("gateway_id", "sqrt(power(lon - nlon, 2) + power(lat - nlat, 2)) <= 0.0004D as placed")


_PL = "sqrt(pow((n.lon - p.lon) * 111320.0::DOUBLE * cos(radians(p.lat)), 2) + pow((n.lat - p.lat) * 111320.0::DOUBLE, 2))"


@query("c08_point_nearest_node", _C + _NODES + f""" SELECT p.id, arg_min(n.node, ({_PL}, n.node)) FILTER ({_PL} < 45) AS node FROM pts p JOIN nodes n USING (city) GROUP BY p.id""")
def point_node(spark, sf):
    return ne.nearest_node(corners(spark, sf), grid_nodes(spark, sf), 45.0, ["id"], where="abs(nz - z) <= 3").select("id", "node")


_SG = cte("roads", "signals") + _NODES + f""", pts AS (SELECT city, ord AS id, x / 1e7 AS lon, y / 1e7 AS lat FROM signals)"""


@query("c09_signalised_junctions", _SG + f""", m AS (SELECT p.id, arg_min(n.node, ({_PL}, n.node)) FILTER ({_PL} < 35) AS node FROM pts p JOIN nodes n USING (city) GROUP BY p.id) SELECT DISTINCT node FROM m WHERE node IS NOT NULL""")
def signalised(spark, sf):
    pts = city.points(spark, sf, "signals").selectExpr("city", "ord as id", "lon", "lat")
    return ne.nearest_node(pts, grid_nodes(spark, sf), 35.0, ["id"]).filter("node is not null").select("node").distinct()


@query("c10_placed_junction_nodes", _SG + f""", nr AS (SELECT n.city, n.node, n.lon, n.lat, list(r.ord % 3) AS kinds FROM nodes n JOIN (SELECT ord, city * 121 + r * 11 + c AS node FROM roads UNION ALL SELECT ord, city * 121 + (r + vertical) * 11 + c + 1 - vertical FROM roads) r USING (node) GROUP BY ALL)
 SELECT p.id, arg_min(n.node, ({_PL}, n.node)) FILTER ({_PL} < 35 AND list_contains(kinds, p.id % 3)) AS node FROM pts p JOIN nr n USING (city) GROUP BY p.id""")
def placed_junctions(spark, sf):
    """A placed junction lists roads (here one kind of them); one of them must arrive at the node."""
    g = grid_lines(spark, sf)
    arriving = g.selectExpr("explode(array(from_node, to_node)) as node", "ord % 3 as kind").groupBy("node").agg(F.collect_set("kind").alias("kinds"))
    pts = city.points(spark, sf, "signals").selectExpr("city", "ord as id", "lon", "lat")
    return ne.nearest_node(pts, grid_nodes(spark, sf).join(arriving, "node"), 35.0, ["id"], where="arrays_overlap(kinds, array(id % 3))").select("id", "node")


@query("c11_point_nearest_road", _C + _seg_join("pts", 40) + f" SELECT id, arg_min(r_id, (d, -r_ord)) AS road_id, {sql_fixed('min(d)', 3)} AS metres FROM hits GROUP BY 1")
def point_road(spark, sf):
    return ne.nearest_road(corners(spark, sf), roads(spark, sf), 40.0, ["id"], later_wins=True).selectExpr("id", "road_id", f"{fixed('d', 3)} as metres")


_ST = cte("stations", "tracks") + """, seg AS (SELECT city, ord, track_id, 0 AS seg, xa/1e7 AS ax, ya/1e7 AS ay, xm/1e7 AS bx, ym/1e7 AS by_ FROM tracks UNION ALL SELECT city, ord, track_id, 1, xm/1e7, ym/1e7, xb/1e7, yb/1e7 FROM tracks),
 j AS (SELECT s.*, g.track_id, g.seg, (ax - s.x/1e7) * 111320.0::DOUBLE * cos(radians(s.y/1e7)) AS ux, (ay - s.y/1e7) * 110540.0::DOUBLE AS uy, (bx - ax) * 111320.0::DOUBLE * cos(radians(s.y/1e7)) AS dx, (by_ - ay) * 110540.0::DOUBLE AS dy
  FROM stations s LEFT JOIN seg g ON g.city = s.city), k AS (SELECT *, greatest(0, least(1, -(ux*dx + uy*dy) / (dx*dx + dy*dy))) AS t FROM j), m AS (SELECT *, sqrt(pow(ux + t*dx, 2) + pow(uy + t*dy, 2)) AS d, degrees(atan2(dx, dy)) AS br FROM k),
 b AS (SELECT station_id, any_value(heading) AS heading, any_value(align_to_track) AS al, arg_min(track_id, (d, seg)) FILTER (d <= 100) AS track_id, arg_min(br, (d, seg)) FILTER (d <= 100) AS br FROM m GROUP BY 1)
"""


@query("c12_station_headings", _ST + f""" SELECT station_id, {sql_fixed("CASE WHEN al AND track_id IS NOT NULL THEN CASE WHEN br < 0 THEN br + 360 ELSE br END ELSE coalesce(heading, 0) - 360 * floor(coalesce(heading, 0) / 360) END", 4)} AS heading,
  CASE WHEN al AND track_id IS NOT NULL THEN 'track' ELSE 'manual' END AS source, CASE WHEN al THEN track_id END AS track_id FROM b""")
def station_headings(spark, sf):
    return ne.station_headings(city.points(spark, sf, "stations"), city.tracks(spark, sf)).selectExpr("station_id", f"{fixed('heading', 4)} as heading", "source", "track_id")


_ENDS = cte("roads") + "," + ROAD_SEGMENTS + """, ends AS (SELECT city, road_id AS own, 'start' AS which, xa/1e7 AS lon, ya/1e7 AS lat FROM roads UNION ALL SELECT city, road_id, 'end', xb/1e7, yb/1e7 FROM roads)""" + _seg_join("ends", 25, "s.road_id <> p.own")


# Loose ends: those that no other road and no flyover passes within the tolerance in degrees.
_LOOSE = cte("roads", "flyovers") + _ENDS[len(cte("roads")):] + """, lines AS (SELECT city, road_id, ax, ay, bx, by_ FROM road_segments UNION ALL SELECT city, flyover_id, xa/1e7, ya/1e7, xb/1e7, yb/1e7 FROM flyovers),
 rest AS (SELECT own, which, lon, lat, ax, ay, bx, by_, greatest(0, least(1, ((lon - ax) * (bx - ax) + (lat - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS u FROM ends e JOIN lines l ON l.city = e.city AND l.road_id <> e.own),
 resting AS (SELECT DISTINCT own, which FROM rest WHERE sqrt(pow(lon - ax - u * (bx - ax), 2) + pow(lat - ay - u * (by_ - ay), 2)) < 0.00006::DOUBLE),
 gap AS (SELECT city, own, which, arg_min(r_id, (d, r_ord)) AS target, min(d) AS gap_m, arg_min(x, (d, r_ord)) AS x, arg_min(y, (d, r_ord)) AS y, arg_min(seg, (d, r_ord)) AS seg, arg_min(t, (d, r_ord)) AS t
  FROM hits WHERE NOT EXISTS (SELECT 1 FROM resting q WHERE q.own = hits.own AND q.which = hits.which) GROUP BY ALL)"""


def decks(spark, sf):
    return city.flyovers(spark, sf).selectExpr("city", "flyover_id as road_id", "coordinates")


@query("c13_road_end_gaps", _LOOSE + f""" SELECT own AS road_id, which, target, {sql_fixed('gap_m', 3)} AS gap_m, {sql_fixed('x', 6)} AS x, {sql_fixed('y', 6)} AS y FROM gap""")
def end_gaps(spark, sf):
    return ne.road_end_gaps(roads(spark, sf), decks=decks(spark, sf)).selectExpr("road_id", "which", "target", f"{fixed('gap_m', 3)} as gap_m", f"{fixed('x', 6)} as x", f"{fixed('y', 6)} as y")


_CARRIED = _ENDS + """, carried AS (SELECT city, own, which, arg_min(r_id, (d, r_ord)) AS target, min(d) AS gap_m, arg_min(x, (d, r_ord)) AS x, arg_min(y, (d, r_ord)) AS y, arg_min(seg, (d, r_ord)) AS seg, arg_min(t, (d, r_ord)) AS t FROM hits GROUP BY city, own, which HAVING min(d) >= 0.5)"""


@query("c14_end_connections", _CARRIED + f""" SELECT own AS road_id, which, target, {sql_fixed('gap_m', 3)} AS gap_m, CASE WHEN gap_m <= 3 THEN 'move_end' ELSE 'add_vertex' END AS action FROM carried""")
def end_connections(spark, sf):
    return ne.end_connections(roads(spark, sf)).selectExpr("road_id", "which", "target", f"{fixed('gap_m', 3)} as gap_m", "action")


@query("c15_near_misses", cte("roads") + "," + ROAD_SEGMENTS + """, rp AS (SELECT city, xa AS x, ya AS y, road_id, imported FROM roads UNION ALL SELECT city, xb, yb, road_id, imported FROM roads),
 lone AS (SELECT city, x/1e7 AS lon, y/1e7 AS lat, any_value(road_id) AS own, any_value(imported) AS imp FROM rp GROUP BY city, x, y HAVING count(*) = 1)""" + _seg_join("lone", 25, "s.road_id <> p.own AND NOT (p.imp AND s.ord % 3 <> 0)") + f"""
 SELECT own AS road_id, arg_min(r_id, (d, r_ord)) AS other, {sql_fixed('min(d)', 3)} AS gap_m FROM hits WHERE d < 25 GROUP BY own, lon, lat""")
def near_misses(spark, sf):
    """Ends only one road uses that stop short of another; two unedited map roads do not count."""
    r = roads(spark, sf)
    ends = ne.road_ends(r, keep=["imported as own_imported"])
    lone = ends.groupBy("city", "lon", "lat").agg(F.expr("count(1)").alias("n"), F.first("own").alias("own"), F.first("own_imported").alias("own_imported"), F.first("z").alias("z")).filter("n = 1")
    hits = ne.road_hits(lone, r, 25.0, ["own", "lon", "lat"], not_same="road_id <> own and not (own_imported and ord % 3 <> 0)", strict=True)
    best = hits.filter("abs(hit.hz - z) <= 3").groupBy("own", "lon", "lat").agg(F.expr("min(struct(hit.d as d, ord, road_id))").alias("b"))
    return best.selectExpr("own as road_id", "b.road_id as other", f"{fixed('b.d', 3)} as gap_m")


@query("c16_snap_points", cte("roads", "buildings", "signals") + "," + ROAD_POINTS + "," + ROAD_SEGMENTS + """, pts AS (SELECT city, building_id AS id, (x0 - 2000) / 1e7 AS lon, (y0 - 2300) / 1e7 AS lat FROM buildings),
 c AS (SELECT p.id, 1 AS prio, concat('j', CAST(s.ord AS VARCHAR)) AS target, sqrt(pow(p.lon - s.x/1e7, 2) + pow(p.lat - s.y/1e7, 2)) AS d, 0.00015::DOUBLE AS lim FROM pts p JOIN signals s USING (city)
  UNION ALL SELECT p.id, 2, v.road_id, sqrt(pow(p.lon - v.x/1e7, 2) + pow(p.lat - v.y/1e7, 2)), 0.00015::DOUBLE FROM pts p JOIN road_points v USING (city)
  UNION ALL SELECT id, 3, road_id, sqrt(pow(lon - ax - t * (bx - ax), 2) + pow(lat - ay - t * (by_ - ay), 2)), 0.0001::DOUBLE FROM (SELECT p.id, s.*, p.lon, p.lat, ((p.lon - ax) * (bx - ax) + (p.lat - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)) AS t FROM pts p JOIN road_segments s USING (city)) WHERE t BETWEEN 0.05::DOUBLE AND 0.95::DOUBLE)
 SELECT id, arg_min(prio, (prio, d, target)) AS prio, arg_min(target, (prio, d, target)) AS target FROM c WHERE d < lim GROUP BY 1""")
def snap_points(spark, sf):
    pts = city.derive(spark, sf, "buildings").selectExpr("city", "building_id as id", "(x0 - 2000) / 1e7 as lon", "(y0 - 2300) / 1e7 as lat")
    j = city.points(spark, sf, "signals").selectExpr("city", "concat('j', ord) as junction_id", "lon", "lat")
    return ne.snap_points(pts, j, roads(spark, sf)).select("id", "prio", "target")


_FR = cte("roads", "flyovers") + "," + ROAD_SEGMENTS + "," + ROAD_POINTS


@query("c17_deck_crossings", _FR + """, q AS (SELECT f.city, flyover_id, road_id, xb/1e7 - xa/1e7 AS rx, yb/1e7 - ya/1e7 AS ry, bx - ax AS sx, by_ - ay AS sy, ax - xa/1e7 AS qx, ay - ya/1e7 AS qy FROM flyovers f JOIN road_segments s USING (city)),
 h AS (SELECT DISTINCT city, flyover_id, road_id FROM q WHERE (qx*sy - qy*sx) / nullif(rx*sy - ry*sx, 0) BETWEEN 0 AND 1 AND (qx*ry - qy*rx) / nullif(rx*sy - ry*sx, 0) BETWEEN 0 AND 1)
 SELECT flyover_id AS deck_id, road_id FROM h WHERE NOT EXISTS (SELECT 1 FROM flyovers f JOIN road_points p ON p.city = f.city AND ((p.x = f.xa AND p.y = f.ya) OR (p.x = f.xb AND p.y = f.yb)) WHERE f.flyover_id = h.flyover_id AND p.road_id = h.road_id)""")
def deck_crossings(spark, sf):
    decks = city.flyovers(spark, sf).selectExpr("city", "flyover_id as deck_id", "coordinates")
    return ne.deck_crossings(decks, roads(spark, sf)).select("deck_id", "road_id")


_FLY = _FR + f""", fl AS (SELECT *, {sql_hav('xa/1e7', 'ya/1e7', 'xb/1e7', 'yb/1e7')} AS total, ceil(elevation / 0.05::DOUBLE) AS need FROM flyovers), fk AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil(total / 10) AS BIGINT)) + 1)) AS k, greatest(1, CAST(ceil(total / 10) AS BIGINT)) AS n FROM fl),
 fs AS (SELECT city, flyover_id, xa/1e7 + k::DOUBLE / n * (xb/1e7 - xa/1e7) AS lon, ya/1e7 + k::DOUBLE / n * (yb/1e7 - ya/1e7) AS lat FROM fk WHERE k::DOUBLE / n * total > need AND k::DOUBLE / n * total < total - need),
 under AS (SELECT DISTINCT s.flyover_id, p.road_id FROM fs s JOIN road_points p USING (city) WHERE sqrt(pow(s.lon - p.x/1e7, 2) + pow(s.lat - p.y/1e7, 2)) < 30.0::DOUBLE / 111000),
 fe AS (SELECT city, flyover_id, 'start' AS which, xa/1e7 AS lon, ya/1e7 AS lat FROM flyovers UNION ALL SELECT city, flyover_id, 'end', xb/1e7, yb/1e7 FROM flyovers),
 adj AS (SELECT DISTINCT e.flyover_id, e.which, p.road_id FROM fe e JOIN road_points p USING (city) WHERE sqrt(pow(e.lon - p.x/1e7, 2) + pow(e.lat - p.y/1e7, 2)) < 60.0::DOUBLE / 111000),
 rl AS (SELECT road_id, {sql_hav('xa/1e7', 'ya/1e7', 'xm/1e7', 'ym/1e7')} + {sql_hav('xm/1e7', 'ym/1e7', 'xb/1e7', 'yb/1e7')} AS metres, lane_count, capacity, CASE WHEN size % 3 = 0 THEN 4 ELSE 1 END AS median FROM roads),
 app AS (SELECT e.flyover_id, e.which, coalesce(max(metres) FILTER ({sql_hav('e.lon', 'e.lat', 'p.x/1e7', 'p.y/1e7')} <= 60), 0) AS m FROM fe e JOIN road_points p USING (city) JOIN rl USING (road_id) GROUP BY ALL)
"""


@query("c18_roads_under_flyover", _FLY + " SELECT flyover_id, road_id FROM under")
def under(spark, sf):
    return ne.roads_under_middle(city.flyovers(spark, sf), roads(spark, sf)).select("flyover_id", "road_id")


@query("c19_roads_at_flyover_ends", _FLY + " SELECT flyover_id, which, road_id FROM adj")
def at_ends(spark, sf):
    return ne.roads_at_flyover_ends(city.flyovers(spark, sf), roads(spark, sf)).select("flyover_id", "which", "road_id")


@query("g14_bridge_geometry", None)
def bridge_heights(spark, sf):
    """Heights of bridges, cuts and the roads that lead onto them; checked by its properties in the tests."""
    r = roads(spark, sf).selectExpr("city", "road_id", "coordinates", "imported as liftable", "case size % 10 when 5 then 1 when 3 then -1 else 0 end as level")
    return structures.bridge_geometry(r).selectExpr("road_id", "pos", f"{fixed('z', 3)} as z", "original")


@query("g21_bridge_feasibility", _FLY + """, a AS (SELECT flyover_id, min(m) AS avail FROM app GROUP BY 1), u AS (SELECT flyover_id, min(median) AS median FROM under JOIN rl USING (road_id) GROUP BY 1),
 l AS (SELECT flyover_id, min(lane_count) AS lo, max(lane_count) AS hi FROM (SELECT DISTINCT flyover_id, road_id FROM adj) JOIN rl USING (road_id) GROUP BY 1), z AS (SELECT f.*, avail, median, lo, hi FROM fl f LEFT JOIN a USING (flyover_id) LEFT JOIN u USING (flyover_id) LEFT JOIN l USING (flyover_id))
 SELECT flyover_id, 'ramp_grade' AS "check", CASE WHEN avail >= need THEN 'pass' ELSE 'fail' END AS status, floor(avail + 0.5)::DOUBLE AS actual, need::DOUBLE AS required FROM z
 UNION ALL SELECT flyover_id, 'deck_length', CASE WHEN total >= 2 * need + 50 THEN 'pass' ELSE 'fail' END, floor(total + 0.5), 2 * need + 50 FROM z
 UNION ALL SELECT flyover_id, 'pier_fit', CASE WHEN coalesce(median, 3) >= 3 THEN 'pass' ELSE 'warn' END, coalesce(median, 3)::DOUBLE, 3 FROM z
 UNION ALL SELECT flyover_id, 'lane_match', CASE WHEN lane_count <= coalesce(lo, lane_count) THEN 'pass' ELSE 'warn' END, lane_count::DOUBLE, coalesce(hi, lane_count)::DOUBLE FROM z""")
def feasibility(spark, sf):
    r = roads(spark, sf).withColumn("median", F.expr("case when size % 3 = 0 then 4D else 1D end"))
    return ne.bridge_feasibility(city.flyovers(spark, sf), r).select("flyover_id", "check", "status", "actual", "required")


@query("c26_ramp_impacts", _FLY + """ SELECT road_id, capacity AS before, CASE WHEN road_id IN (SELECT road_id FROM adj) THEN CAST(floor(capacity * 0.75::DOUBLE + 0.5) AS BIGINT) ELSE capacity END AS capacity FROM rl""")
def impacts(spark, sf):
    return ne.ramp_impacts(city.flyovers(spark, sf), roads(spark, sf)).select("road_id", "before", "capacity")


@query("d13_duplicate_roads", _C + """, mvs AS (SELECT s.city, s.ord, concat('m', CAST(s.ord AS VARCHAR)) AS road_id, s.seg, s.ax + 0.0001::DOUBLE AS ax, s.ay + 0.00005::DOUBLE AS ay, s.bx + 0.0001::DOUBLE AS bx, s.by_ + 0.00005::DOUBLE AS by_ FROM road_segments s JOIN roads r USING (road_id) WHERE r.imported),
 sz AS (SELECT city, road_id AS own, seg AS oseg, ax AS x1, ay AS y1, bx AS x2, by_ AS y2, sqrt(pow((bx - ax) * 111320.0::DOUBLE * cos(radians(by_)), 2) + pow((by_ - ay) * 111320.0::DOUBLE, 2)) AS m FROM road_segments),
 sn AS (SELECT *, greatest(1, CAST(floor(m / 20 + 0.5) AS BIGINT)) AS n FROM sz), smp AS (SELECT city, own, oseg, k, x1 + k::DOUBLE / n * (x2 - x1) AS lon, y1 + k::DOUBLE / n * (y2 - y1) AS lat FROM (SELECT *, unnest(range(0, n)) AS k FROM sn))"""
       + _seg_join("smp", 25).replace("road_segments s", "mvs s") + """, nr AS (SELECT city, own, oseg, k, arg_min(r_id, (d, r_ord)) AS along FROM hits GROUP BY ALL), pr AS (SELECT city, own, along, count(*) AS n FROM nr GROUP BY ALL),
 cv AS (SELECT city, own, sum(n) AS covered, arg_max(along, (n, along)) AS along FROM pr GROUP BY ALL), tot AS (SELECT city, own, sum(m) AS metres, sum(n) AS samples FROM sn GROUP BY ALL)
 SELECT own AS road_id, along, covered::BIGINT AS covered, samples::BIGINT AS samples FROM cv JOIN tot USING (city, own) WHERE metres >= 50 AND covered >= samples * 0.8::DOUBLE""")
def duplicates(spark, sf):
    """Drawn roads against copies of all roads moved by a few metres."""
    r = roads(spark, sf)
    moved = r.filter("imported").selectExpr("city", "ord", "concat('m', ord) as road_id", "transform(coordinates, p -> named_struct('lon', p.lon + 0.0001D, 'lat', p.lat + 0.00005D, 'z', p.z)) as coordinates")
    return ne.duplicate_roads(r, moved).select("road_id", "along", "covered", "samples")


@query("c20_samples_near_roads", _C + ", mp AS (SELECT city, road_id AS own, xm / 1e7 AS lon, ym / 1e7 AS lat FROM roads)" + _seg_join("mp", 80, "s.road_id <> p.own") + f" SELECT own, arg_min(r_id, (d, r_ord)) AS road_id, {sql_fixed('min(d)', 3)} AS metres FROM hits GROUP BY 1")
def samples(spark, sf):
    """Nearest other road to the middle of every road."""
    pts = city.derive(spark, sf, "roads").selectExpr("city", "road_id as own", "xm / 1e7 as lon", "ym / 1e7 as lat", "0D as z")
    return ne.nearest_road(pts, roads(spark, sf), 80.0, ["own"], same_level=True, not_same="road_id <> own").selectExpr("own", "road_id", f"{fixed('d', 3)} as metres")


_Z = cte("roads", "zones") + "," + ROAD_POINTS + """, zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0]) AS ax, unnest([y0,y0,y1,ym,y1]) AS ay, unnest([x1,x1,xm,x0,x0]) AS bx, unnest([y0,y1,ym,y1,y0]) AS by_ FROM zones),
 inz AS (SELECT DISTINCT road_id, zone_id FROM (SELECT p.road_id, p.pos, z.zone_id FROM road_points p JOIN zr z USING (city) WHERE (z.by_ > y) <> (z.ay > y) AND x < (z.ax - z.bx) * ((y - z.by_)::DOUBLE / (z.ay - z.by_)) + z.bx GROUP BY ALL HAVING count(*) % 2 = 1))"""


@query("c21_imported_roads_in_area", _Z + " SELECT road_id FROM roads WHERE imported AND road_id IN (SELECT road_id FROM inz)")
def in_area(spark, sf):
    from ..operators.spatial import vertices
    pts = vertices(roads(spark, sf).filter("imported"), ["city", "road_id"])
    return dm.points_in_zones(pts, city.zones(spark, sf), ["road_id"]).select("road_id").distinct()


@query("c22_new_ways", """SELECT o_orderkey AS osm_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)""")
def new_ways(spark, sf):
    li = city.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "osm_id")
    return ne.new_roads(city.table(spark, sf, "orders").selectExpr("o_orderkey as osm_id"), li.filter("l_returnflag = 'R'"), li.filter("l_linenumber = 7"), li.filter("l_quantity > 48"))


@query("c27_roads_around_roads", cte("roads") + """, b AS (SELECT city, ord, road_id, least(xa, xm, xb)/1e7 AS x0, least(ya, ym, yb)/1e7 AS y0, greatest(xa, xm, xb)/1e7 AS x1, greatest(ya, ym, yb)/1e7 AS y1 FROM roads),
 w AS (SELECT *, 30 / (111320.0::DOUBLE * cos(radians((y0 + y1) / 2))) AS dx, 30 / 111320.0::DOUBLE AS dy FROM b) SELECT w.road_id, b.road_id AS nearby FROM w JOIN b ON b.city = w.city AND b.road_id <> w.road_id AND b.x0 <= w.x1 + dx AND b.x1 >= w.x0 - dx AND b.y0 <= w.y1 + dy AND b.y1 >= w.y0 - dy""")
def around(spark, sf):
    r = roads(spark, sf).selectExpr("city", "road_id", f"{bounds('coordinates')} as b_box")
    wide = r.selectExpr("city", "road_id as own", f"{widen('b_box', '30D')} as a_box")
    return join_boxes(wide, r, 0.002).filter("own <> road_id").selectExpr("own as road_id", "road_id as nearby")


def _cross_sql(a, b, c, d) -> str:
    def o(p, q, r):
        return f"(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    return f"({o(a, b, c)} * {o(a, b, d)} < 0 AND {o(c, d, a)} * {o(c, d, b)} < 0)"


@query("c28_lines_touching_areas", _Z + "," + ROAD_SEGMENTS + f""" SELECT road_id AS id, zone_id AS area_id FROM inz UNION
 SELECT s.road_id, z.zone_id FROM road_segments s JOIN zr z USING (city) WHERE {_cross_sql(('s.ax', 's.ay'), ('s.bx', 's.by_'), ('z.ax / 1e7', 'z.ay / 1e7'), ('z.bx / 1e7', 'z.by_ / 1e7'))}""")
def touching(spark, sf):
    lines = roads(spark, sf).selectExpr("city", "road_id as id", "coordinates")
    areas = city.zones(spark, sf).selectExpr("city", "zone_id as area_id", "boundary")
    return ne.lines_touching_areas(lines, areas).select("id", "area_id")


_ACC = cte("roads", "zones") + _NODES + """, zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0])/1e7 AS ax, unnest([y0,y0,y1,ym,y1])/1e7 AS ay, unnest([x1,x1,xm,x0,x0])/1e7 AS bx, unnest([y0,y1,ym,y1,y0])/1e7 AS by_ FROM zones),
 ins AS (SELECT n.node, z.zone_id FROM nodes n JOIN zr z USING (city) WHERE (z.by_ > n.lat) <> (z.ay > n.lat) AND n.lon < (z.ax - z.bx) * (n.lat - z.by_) / (z.ay - z.by_) + z.bx GROUP BY ALL HAVING count(*) % 2 = 1),
 at AS (SELECT node, greatest(1000, max(capacity)) AS cap, arg_max(road_class, ord) AS cls FROM (SELECT ord, capacity, road_class, city * 121 + r * 11 + c AS node FROM roads UNION ALL SELECT ord, capacity, road_class, city * 121 + (r + vertical) * 11 + c + 1 - vertical FROM roads) GROUP BY 1)"""


@query("d03_zone_access_weights", _ACC.replace(" at AS (", " nat AS (") + f""", w AS (SELECT zone_id, node, CASE cls WHEN 'highway' THEN 3.0::DOUBLE WHEN 'arterial' THEN 2 WHEN 'collector' THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END * ln(1 + cap) AS w FROM ins JOIN nat USING (node))
 SELECT zone_id, node, {sql_fixed('w / sum(w) OVER (PARTITION BY zone_id)', 7)} AS weight FROM w""")
def zone_access(spark, sf):
    edges = city.derive(spark, sf, "roads").selectExpr("ord as ord_key", "capacity", "road_class", "city * 121 + r * 11 + c as src", "city * 121 + (r + vertical) * 11 + c + 1 - vertical as dst")
    return dm.zone_access_weights(city.zones(spark, sf), grid_nodes(spark, sf), edges).selectExpr("zone_id", "node", f"{fixed('weight', 7)} as weight")


@query("e11_nearest_three_nodes", cte("roads", "gateways") + _NODES + f""" SELECT gateway_id AS zone_id, node FROM (SELECT gateway_id, node, row_number() OVER (PARTITION BY gateway_id ORDER BY {sql_hav('g.x / 1e7', 'g.y / 1e7', 'n.lon', 'n.lat')}, node) AS rk FROM gateways g JOIN nodes n USING (city)) WHERE rk <= 3""")
def nearest_three(spark, sf):
    centres = city.derive(spark, sf, "gateways").selectExpr("city", "gateway_id as zone_id", "x / 1e7 as zlon", "y / 1e7 as zlat")
    return dm.nearest_k(centres, grid_nodes(spark, sf), 3).select("zone_id", "node")
