"""Import, repair, clipping and connection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import convert as cv
from ..operators import editing as ed
from ..operators import joining as jo
from ..operators import rings
from ..operators.nearest import road_ends
from ..operators.network import build_network
from ..session import materialise, scratch_path
from ..sources import citydata as city
from ..sources import geojson as gj
from ..sources.citydata import ROAD_POINTS, ROAD_SEGMENTS, cte, sql_fixed
from .convert_queries import _SECT, _W, tagged_ways
from .graph_queries import EDGES, grid_edges
from .nearest_queries import _CARRIED, _LOOSE, _Z, decks, grid_nodes, roads
from .network_queries import drawn_roads
from .registry import query


def _geojson(spark, sf):
    """Roads, buildings and stations as one feature collection per line."""
    path = scratch_path(spark, "geojson")

    def line(kind, geometry, props):
        return (f"to_json(named_struct('type', 'FeatureCollection', 'features', array(named_struct('type', 'Feature', 'id', id,"
                f" 'properties', {props}, 'geometry', named_struct('type', '{kind}', 'coordinates', {geometry}))))) as value")
    pts = "transform(coordinates, p -> array(p.lon, p.lat))"
    r = city.roads(spark, sf).selectExpr("road_id as id", "*").selectExpr(line("LineString", pts, """named_struct('type', 'road', 'laneCount', case when ord % 3 = 0 then lane_count when ord % 3 = 1 then 0 end,
        'speedLimit', case when ord % 2 = 0 then speed_limit end, 'name', case when ord % 4 = 0 then p_name end, 'hasFootpath', case when ord % 5 = 0 then false end)"""))
    b = city.buildings(spark, sf).selectExpr("building_id as id", "*").selectExpr(line("Polygon", f"array({pts})", """named_struct('usageType', case when ord % 3 = 0 then 'commercial' end,
        'population', case when ord % 2 = 0 then population end, 'employees', case when ord % 9 = 0 then 0 end)"""))
    s = city.points(spark, sf, "stations").selectExpr("station_id as id", "*").selectExpr(line("Point", "array(lon, lat)", "named_struct('type', 'metro_station')"))
    r.unionByName(b).unionByName(s).write.text(path)
    return gj.read_geojson(spark, path, "base", multi_line=False)


@query("a04_read_geojson_roads", cte("roads") + """SELECT road_id AS id, CASE WHEN ord % 4 = 0 THEN p_name ELSE concat('Road #', substr(road_id, 1, 4)) END AS name, CASE WHEN ord % 3 = 0 THEN lane_count ELSE 2 END::INT AS lane_count,
  CASE WHEN ord % 2 = 0 THEN speed_limit ELSE 50 END AS speed_limit, 1200::INT AS capacity, ord % 5 <> 0 AS has_footpath, 3::BIGINT AS points FROM roads""")
def geojson_roads(spark, sf):
    return gj.typed_features(_geojson(spark, sf), "road").selectExpr("id", "name", "laneCount as lane_count", "speedLimit as speed_limit", "trafficCapacity as capacity",
                                                                     "hasFootpath as has_footpath", "bigint(size(coordinates)) as points")


@query("a04_read_geojson_buildings", cte("buildings") + """SELECT building_id AS id, CASE WHEN ord % 3 = 0 THEN 'commercial' ELSE 'residential' END AS category, pop::INT AS population, CASE WHEN ord % 3 = 0 THEN 0 ELSE pop END::INT AS residents,
  CASE WHEN ord % 9 = 0 THEN 0 WHEN ord % 3 = 0 THEN floor(pop * 0.8::DOUBLE + 0.5) ELSE 0 END::INT AS employees, 5::BIGINT AS points FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN population ELSE 40 END AS pop FROM buildings)""")
def geojson_buildings(spark, sf):
    return gj.typed_features(_geojson(spark, sf), "building").selectExpr("id", "category", "population", "residents", "employees", "bigint(size(coordinates)) as points")


@query("a12_assemble_buildings", cte("buildings") + """SELECT ord AS relation_id, 5::BIGINT AS points, x0 AS west, y1 AS north FROM buildings WHERE ord % 7 <> 0""")
def multipolygons(spark, sf):
    """Outlines given as two half rings; one in seven lacks its second half and is rejected."""
    b = city.buildings(spark, sf)
    halves = b.selectExpr("inline(array(named_struct('id', ord * 2, 'geometry', slice(coordinates, 1, 3)), named_struct('id', ord * 2 + 1, 'geometry', reverse(slice(coordinates, 3, 3)))))")
    rel = b.selectExpr("ord as id", "array(named_struct('type', 'way', 'ref', ord * 2, 'role', 'outer'), named_struct('type', 'way', 'ref', case when ord % 7 = 0 then -1L else ord * 2 + 1 end, 'role', 'outer')) as members")
    out = rings.assemble_buildings(rel, halves)
    return out.selectExpr("relation_id", "bigint(size(coordinates)) as points", f"{G.e7('array_min(coordinates.lon)')} as west", f"{G.e7('array_max(coordinates.lat)')} as north")


@query("a16_repair_and_restore_sections", cte("roads") + "SELECT road_id AS id, ord % 5 <> 0 AS changed, true AS restored, true AS stable FROM roads")
def repair(spark, sf):
    """Repair, repeat it (nothing more changes), then restore the originals."""
    table = materialise(city.derive(spark, sf, "roads").selectExpr("road_id as id", "11 as vertex_count", _SECT), "sections")
    backup = materialise(ed.repair_plan(table)[0], "backup")
    fixed = materialise(ed.apply_repair(table, backup), "fixed")
    again = cv.repaired_sections(fixed).selectExpr("id", "not changed as stable")
    back = ed.restore_sections(fixed, backup).selectExpr("id", "sections as back")
    # The tables are small in their files only, so none is gathered for a join.
    return (table.join(back.hint("merge"), "id").join(again.hint("merge"), "id").join(backup.selectExpr("id", "true as hit").hint("merge"), "id", "left")
            .selectExpr("id", "coalesce(hit, false) as changed", "back = sections as restored", "stable"))


_ON = cte("roads", "proposals") + "," + ROAD_SEGMENTS + """, vs AS (SELECT city, road_id, ax AS x, ay AS y FROM road_segments UNION SELECT city, road_id, bx, by_ FROM road_segments),
 e AS (SELECT city, xa / 1e7 AS lon, ya / 1e7 AS lat FROM proposals WHERE type = 'road' UNION SELECT city, xb / 1e7, yb / 1e7 FROM proposals WHERE type = 'road'),
 j AS (SELECT s.city, s.road_id, s.seg, e.lon, e.lat, ax, ay, bx, by_, ((lon - ax) * (bx - ax) + (lat - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)) AS t FROM e JOIN road_segments s ON s.city = e.city),
 onto AS (SELECT road_id, lon, lat, min(seg) AS seg, arg_min(t, seg) AS t FROM j WHERE t > 0.02 AND t < 0.98 AND sqrt(pow(lon - ax - t * (bx - ax), 2) + pow(lat - ay - t * (by_ - ay), 2)) < 0.00012::DOUBLE
  AND NOT EXISTS (SELECT 1 FROM vs WHERE vs.road_id = j.road_id AND abs(vs.x - lon) < 0.00001::DOUBLE AND abs(vs.y - lat) < 0.00001::DOUBLE) GROUP BY ALL)"""


def proposed_ends(spark, sf):
    return road_ends(city.proposals(spark, sf).filter("type = 'road'").selectExpr("city", "id as road_id", "coordinates"))


@query("g22_split_roads_at_points", _ON + f" SELECT road_id, seg, {sql_fixed('t', 5)} AS t FROM onto")
def split_at(spark, sf):
    """Where the ends of proposed roads lie on the pieces of roads."""
    return jo.points_on_roads(roads(spark, sf), proposed_ends(spark, sf)).selectExpr("road_id", "seg", f"{G.fixed('t', 5)} as t")


@query("g22_split_roads", _ON + f""", all_points AS (SELECT road_id, seg + t AS place, lon AS x, lat AS y FROM onto UNION ALL SELECT road_id, pos, x / 1e7, y / 1e7 FROM road_points)
 SELECT road_id, row_number() OVER (PARTITION BY road_id ORDER BY place) - 1 AS pos, {sql_fixed('x', 7)} AS x, {sql_fixed('y', 7)} AS y FROM all_points WHERE road_id IN (SELECT road_id FROM onto)""".replace("all_points AS", ROAD_POINTS + ", all_points AS"))
def split_roads(spark, sf):
    """All vertices of the roads that got new ones."""
    out = jo.split_roads_at_points(roads(spark, sf), proposed_ends(spark, sf)).filter("changed")
    return out.selectExpr("road_id", "posexplode(coordinates) as (pos, p)").selectExpr("road_id", "bigint(pos) as pos", f"{G.fixed('p.lon', 7)} as x", f"{G.fixed('p.lat', 7)} as y")


# Joins of loose ends: a vertex within a metre is reused, one of two facing ends gives way, near spots are one.
def _joins(source: str) -> str:
    return f""", sp AS (SELECT g.*, o.ord, 111320.0::DOUBLE * sqrt(pow((ax - x) * cos(radians(y)), 2) + pow(ay - y, 2)) AS da, 111320.0::DOUBLE * sqrt(pow((bx - x) * cos(radians(y)), 2) + pow(by_ - y, 2)) AS db, ax, ay, bx, by_
  FROM {source} g JOIN road_segments s ON s.road_id = g.target AND s.seg = g.seg JOIN roads o ON o.road_id = g.own),
 sv AS (SELECT *, CASE WHEN least(da, db) <= 1 THEN CASE WHEN da <= db THEN seg ELSE seg + 1 END END AS vertex FROM sp),
 se AS (SELECT *, CASE vertex WHEN 0 THEN 'start' WHEN 2 THEN 'end' END AS te, CASE WHEN vertex = seg THEN ax WHEN vertex IS NULL THEN x ELSE bx END AS jx, CASE WHEN vertex = seg THEN ay WHEN vertex IS NULL THEN y ELSE by_ END AS jy FROM sv),
 st AS (SELECT * FROM se a WHERE NOT EXISTS (SELECT 1 FROM se b WHERE b.own = a.target AND b.which = a.te AND b.target = a.own AND b.te = a.which AND b.ord < a.ord)),
 joins AS (SELECT *, vertex IS NULL AND coalesce(da - lag(da) OVER (PARTITION BY target, seg, vertex IS NULL ORDER BY da) > 1, true) AS fresh FROM st)"""


_JOINS = _LOOSE + _joins("gap")


@query("g22_connect_road_ends", _JOINS + f""" SELECT r.road_id, 3 + (SELECT count(*) FROM joins j WHERE j.own = r.road_id) + (SELECT count(*) FROM joins j WHERE j.target = r.road_id AND fresh) AS points,
  {sql_fixed('coalesce(s.jx, xa / 1e7)', 6)} AS first_x, {sql_fixed('coalesce(s.jy, ya / 1e7)', 6)} AS first_y, {sql_fixed('coalesce(e.jx, xb / 1e7)', 6)} AS last_x, {sql_fixed('coalesce(e.jy, yb / 1e7)', 6)} AS last_y
 FROM roads r LEFT JOIN joins s ON s.own = r.road_id AND s.which = 'start' LEFT JOIN joins e ON e.own = r.road_id AND e.which = 'end'""")
def connect(spark, sf):
    """Every road after loose ends were led to the roads they stop short of."""
    joined, _ = jo.connect_road_ends(roads(spark, sf), decks(spark, sf))
    end = lambda i, c: f"{G.fixed(f'element_at(coordinates, {i}).{c}', 6)}"
    return joined.selectExpr("road_id", "bigint(size(coordinates)) as points", f"{end(1, 'lon')} as first_x", f"{end(1, 'lat')} as first_y", f"{end(-1, 'lon')} as last_x", f"{end(-1, 'lat')} as last_y")


@query("g22_joined_network", _JOINS + " SELECT own AS road_id, which, target, true AS shared FROM joins")
def joined_network(spark, sf):
    """Whether each join gives a node of the network that both roads use."""
    joined, made = jo.connect_road_ends(drawn_roads(spark, sf), decks(spark, sf))
    net = build_network(materialise(joined.drop("changed"), "joined"))
    at = net.edges.selectExpr("city", "road_id", "explode(array(from_node, to_node)) as node").distinct()
    both = made.select("city", "road_id", "which", "target").join(at.hint("merge"), ["city", "road_id"]).join(at.withColumnRenamed("road_id", "target").hint("merge"), ["city", "target", "node"])
    return made.select("road_id", "which", "target").join(both.selectExpr("road_id", "which", "target", "true as shared").distinct().hint("merge"), ["road_id", "which", "target"], "left").na.fill(False)


@query("c14_carried_ends", _CARRIED + _joins("carried") + f""" SELECT own AS road_id, which, target, {sql_fixed('jx', 6)} AS x, {sql_fixed('jy', 6)} AS y,
  3 + (SELECT count(*) FROM joins o WHERE o.own = joins.own AND o.gap_m > 3) + (SELECT count(*) FROM joins o WHERE o.target = joins.own AND o.fresh) AS points FROM joins""")
def carried(spark, sf):
    """Where loose ends are after they were carried, and how many points their roads have then."""
    moved, made = jo.carry_ends(roads(spark, sf))
    own = moved.selectExpr("road_id", "element_at(coordinates, 1) as s", "element_at(coordinates, -1) as e", "bigint(size(coordinates)) as points")
    p = "if(which = 'start', s, e)"
    return made.select("road_id", "which", "target").join(own, "road_id").selectExpr("road_id", "which", "target", f"{G.fixed(p + '.lon', 6)} as x", f"{G.fixed(p + '.lat', 6)} as y", "points")


@query("g23_clip_roads_to_areas", None)
def clip_roads(spark, sf):
    areas = city.zones(spark, sf).selectExpr("city", "zone_id as area_id", "boundary")
    out = ed.clip_lines(roads(spark, sf).selectExpr("city", "road_id as id", "coordinates"), areas)
    return out.selectExpr("id", "area_id", "piece", "bigint(size(coordinates)) as points", f"{G.fixed(G.line_length('coordinates'), 2)} as metres")


@query("g23_clip_buildings_to_areas", cte("buildings", "zones") + """, zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0]) AS ax, unnest([y0,y0,y1,ym,y1]) AS ay, unnest([x1,x1,xm,x0,x0]) AS bx, unnest([y0,y1,ym,y1,y0]) AS by_ FROM zones), c AS (SELECT city, building_id AS id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM buildings)
 SELECT id, zone_id AS area_id FROM c JOIN zr z USING (city) WHERE (z.by_ > y) <> (z.ay > y) AND x < (z.ax - z.bx) * ((y - z.by_)::DOUBLE / (z.ay - z.by_)) + z.bx GROUP BY ALL HAVING count(*) % 2 = 1""")
def clip_buildings(spark, sf):
    areas = city.zones(spark, sf).selectExpr("city", "zone_id as area_id", "boundary")
    return ed.clip_buildings(city.buildings(spark, sf).selectExpr("city", "building_id as id", "coordinates"), areas).select("id", "area_id")


@query("g24_import_study_area", _Z + _W[len(cte("roads")):] + """,
 t AS (SELECT ord AS id FROM roads WHERE road_id IN (SELECT road_id FROM inz)), c AS (SELECT w2.id, reason FROM w2 JOIN t USING (id))
 SELECT CASE WHEN reason IS NOT NULL THEN reason WHEN id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') THEN 'preserved' WHEN id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'deleted' ELSE 'added' END AS outcome, count(*) AS ways FROM c GROUP BY 1""")
def import_area(spark, sf):
    """Ways touching any area, classified, less those present or deleted, with a report."""
    from ..operators.demand import points_in_zones
    from ..operators.spatial import vertices
    ways = tagged_ways(spark, sf)
    hits = points_in_zones(vertices(ways, ["city", "id"]), city.zones(spark, sf), ["id"]).select("id").distinct()
    touched = cv.classified_ways(ways.join(hits, "id", "left_semi"))
    o = city.table(spark, sf, "orders")
    known = o.filter("o_orderstatus in ('P', 'F')").selectExpr("o_orderkey as id", "case o_orderstatus when 'P' then 'preserved' else 'deleted' end as seen")
    return touched.join(known, "id", "left").groupBy(F.expr("coalesce(reason, seen, 'added')").alias("outcome")).agg(F.expr("count(1)").alias("ways"))


@query("f06_fold_order", EDGES + f" SELECT city, edge_id, {sql_fixed('length', 3)} AS metres, row_number() OVER (PARTITION BY city ORDER BY length, edge_id) AS rank FROM edges WHERE length < 92")
def fold_order(spark, sf):
    e = grid_edges(spark, sf).selectExpr("city", "length", "edge_id as ord_key")
    return ed.fold_order(e, 92.0).selectExpr("city", "ord_key as edge_id", f"{G.fixed('length', 3)} as metres", "rank")


@query("g06_fold_junctions", None)
def fold(spark, sf):
    """On the street grid, with limits scaled to its block length so that merges occur."""
    e = grid_edges(spark, sf).selectExpr("length", "edge_id as ord_key", "src", "dst")
    return ed.fold_junctions(e, grid_nodes(spark, sf), 92.0, 240.0)


@query("g13_flyovers_connected", cte("flyovers", "roads") + """, v AS (SELECT city, xa0 AS x, ya0 AS y FROM roads UNION SELECT city, xb0, yb0 FROM roads), f AS (SELECT f.*, EXISTS (SELECT 1 FROM v WHERE v.city = f.city AND sqrt(pow((v.x - f.xa) / 1e7, 2) + pow((v.y - f.ya) / 1e7, 2)) < 0.00006::DOUBLE) AS s,
  EXISTS (SELECT 1 FROM v WHERE v.city = f.city AND sqrt(pow((v.x - f.xb) / 1e7, 2) + pow((v.y - f.yb) / 1e7, 2)) < 0.00006::DOUBLE) AS e FROM flyovers f) SELECT flyover_id, s AS start_connected, e AS end_connected, s AND e AS connected FROM f""")
def connected(spark, sf):
    return ed.flyovers_connected(city.flyovers(spark, sf), grid_nodes(spark, sf), grid_edges(spark, sf)).select("flyover_id", "start_connected", "end_connected", "connected")


@query("g12_road_connections", EDGES + """, n AS (SELECT DISTINCT city, road_id, unnest([src, dst]) AS node FROM edges), e AS (SELECT city, road_id, a, b FROM g)
 SELECT DISTINCT m.road_id, CASE WHEN m.node = e.a THEN 'start' ELSE 'end' END AS place, o.road_id AS other FROM n m JOIN e USING (road_id) JOIN n o ON o.city = m.city AND o.node = m.node AND o.road_id <> m.road_id""")
def connections(spark, sf):
    e = grid_edges(spark, sf)
    ends = city.derive(spark, sf, "roads").selectExpr("city", "road_id", "city * 121 + r * 11 + c as start_node", "city * 121 + (r + vertical) * 11 + c + 1 - vertical as end_node")
    return ed.road_connections(e, ends).select("road_id", "place", "other")
