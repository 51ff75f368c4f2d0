"""Geometry expressions, each evaluated over a whole derived table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import polygons as P
from ..operators import geometry as op
from ..sources import citydata as city
from ..sources.citydata import cte, sql_fixed, sql_hav
from .registry import query

_R = cte("roads")
_A, _M, _B = ("xa / 1e7", "ya / 1e7"), ("xm / 1e7", "ym / 1e7"), ("xb / 1e7", "yb / 1e7")
_LEN1, _LEN2 = sql_hav(*_A, *_M), sql_hav(*_M, *_B)


def _pl(x1, y1, x2, y2):
    return f"sqrt(pow(({x2} - {x1}) * 111320.0::DOUBLE * cos(radians({y1})), 2) + pow(({y2} - {y1}) * 111320.0::DOUBLE, 2))"


@query("h01_line_lengths", _R + f"""SELECT road_id, {sql_fixed(f'{_LEN1} + {_LEN2}', 4)} AS metres,
  {sql_fixed(f'{_pl(*_A, *_M)} + {_pl(*_M, *_B)}', 4)} AS planar_metres FROM roads""")
def lengths(spark, sf):
    return city.roads(spark, sf).selectExpr("road_id", f"{G.fixed(G.line_length('coordinates'), 4)} as metres",
                                            f"{G.fixed(G.line_length('coordinates', G.planar_pts), 4)} as planar_metres")


@query("h02_bounds", _R + f"""SELECT road_id, x0, y0, x1, y1, {sql_fixed('x0 / 1e7 - 150 / (111320.0::DOUBLE * cos(radians((y0 / 1e7 + y1 / 1e7) / 2)))', 6)} AS wide_west,
  {sql_fixed('y1 / 1e7 + 150 / 111320.0::DOUBLE', 6)} AS wide_north FROM (SELECT road_id, least(xa, xm, xb) AS x0, least(ya, ym, yb) AS y0,
  greatest(xa, xm, xb) AS x1, greatest(ya, ym, yb) AS y1 FROM roads)""")
def box(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", f"{G.bounds('coordinates')} as b").selectExpr("road_id", "b", f"{G.widen('b', '150D')} as w")
    return df.selectExpr("road_id", f"{G.e7('b.min_lon')} as x0", f"{G.e7('b.min_lat')} as y0", f"{G.e7('b.max_lon')} as x1", f"{G.e7('b.max_lat')} as y1",
                         f"{G.fixed('w.min_lon', 6)} as wide_west", f"{G.fixed('w.max_lat', 6)} as wide_north")


@query("h03_box_area", _R + f"""SELECT road_id, {sql_fixed(f"{sql_hav('x0', 'y0', 'x1', 'y0')} * {sql_hav('x0', 'y0', 'x0', 'y1')} / 1e6", 7)} AS km2 FROM (
  SELECT road_id, least(xa, xm, xb) / 1e7 AS x0, least(ya, ym, yb) / 1e7 AS y0, greatest(xa, xm, xb) / 1e7 AS x1, greatest(ya, ym, yb) / 1e7 AS y1 FROM roads)""")
def box_area(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", f"{G.bounds('coordinates')} as b")
    return df.selectExpr("road_id", f"{G.fixed(G.box_area_km2('b'), 7)} as km2")


@query("h04_point_to_segment", cte("buildings") + f"""SELECT building_id AS id, {sql_fixed('t', 6)} AS t, {sql_fixed('sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2))', 9)} AS d FROM (
  SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM (
  SELECT building_id, x0 / 1e7 AS px, y0 / 1e7 AS py, (x0 - 3000) / 1e7 AS ax, (y0 - 500 + ord % 700) / 1e7 AS ay, (x0 + 2500) / 1e7 AS bx, (y0 - 900) / 1e7 AS by_ FROM buildings))""")
def point_segment(spark, sf):
    df = city.derive(spark, sf, "buildings").selectExpr(
        "building_id as id", "x0 / 1e7 as px", "y0 / 1e7 as py", "(x0 - 3000) / 1e7 as ax", "(y0 - 500 + ord % 700) / 1e7 as ay",
        "(x0 + 2500) / 1e7 as bx", "(y0 - 900) / 1e7 as by_")
    df = df.selectExpr("*", f"{G.project_t('px', 'py', 'ax', 'ay', 'bx', 'by_')} as t")
    gap = G.degrees_apart("px", "py", G.along("ax", "bx", "t"), G.along("ay", "by_", "t"))
    return df.selectExpr("id", f"{G.fixed('t', 6)} as t", f"{G.fixed(gap, 9)} as d")


@query("h05_segment_crossings", _R + """SELECT road_id, u IS NOT NULL AS meets, floor(u * 1e6::DOUBLE + 0.5) / 1e6 AS u, floor(v * 1e6::DOUBLE + 0.5) / 1e6 AS v FROM (
  SELECT road_id, CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN u END AS u, CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN v END AS v FROM (
  SELECT road_id, (qx * sy - qy * sx) / den AS u, (qx * ry - qy * rx) / den AS v FROM (SELECT *, nullif(rx * sy - ry * sx, 0) AS den FROM (
  SELECT road_id, xb/1e7 - xa/1e7 AS rx, yb/1e7 - ya/1e7 AS ry, (xm + 900)/1e7 - (xm - 400)/1e7 AS sx, (ym + 700)/1e7 - (ym - 700 + ord % 300)/1e7 AS sy,
  (xm - 400)/1e7 - xa/1e7 AS qx, (ym - 700 + ord % 300)/1e7 - ya/1e7 AS qy FROM roads))))""")
def crossings(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr(
        "road_id", f"{G.pt('xa / 1e7', 'ya / 1e7')} as a", f"{G.pt('xb / 1e7', 'yb / 1e7')} as b",
        f"{G.pt('(xm - 400) / 1e7', '(ym - 700 + ord % 300) / 1e7')} as c", f"{G.pt('(xm + 900) / 1e7', '(ym + 700) / 1e7')} as d")
    df = df.selectExpr("road_id", f"{G.cross_params('a', 'b', 'c', 'd')} as hit")
    return df.selectExpr("road_id", "hit is not null as meets", f"{G.fixed('hit.u', 6)} as u", f"{G.fixed('hit.v', 6)} as v")


@query("h06_densify", _R + f"""SELECT road_id, 1 + greatest(1, CAST(ceil({_LEN1} / 10) AS BIGINT)) + greatest(1, CAST(ceil({_LEN2} / 10) AS BIGINT)) AS points, 3::BIGINT AS originals FROM roads""")
def densify(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", f"{G.densify('coordinates', 10)} as p")
    return df.selectExpr("road_id", "bigint(size(p)) as points", "bigint(size(filter(p, q -> q.original))) as originals")


_AG1 = "sqrt(pow((xm - xa) / 1e7 * 111000.0::DOUBLE * cos(radians(ya / 1e7)), 2) + pow((ym - ya) / 1e7 * 111000.0::DOUBLE, 2))"
_AG2 = "sqrt(pow((xb - xm) / 1e7 * 111000.0::DOUBLE * cos(radians(ym / 1e7)), 2) + pow((yb - ym) / 1e7 * 111000.0::DOUBLE, 2))"


@query("h07_point_along_line", _R + f"""SELECT road_id, {sql_fixed('CASE WHEN l1 >= d THEN xa / 1e7 + d / l1 * (xm - xa) / 1e7 WHEN l1 + l2 >= d THEN xm / 1e7 + (d - l1) / l2 * (xb - xm) / 1e7 ELSE xb / 1e7 END', 6)} AS lon
  FROM (SELECT *, (20 + ord % 140)::DOUBLE AS d, {_AG1} AS l1, {_AG2} AS l2 FROM roads)""")
def along(spark, sf):
    return city.roads(spark, sf).selectExpr("road_id", f"{G.fixed(G.point_at('coordinates', 'double(20 + ord % 140)') + '.lon', 6)} as lon")


@query("h07_slice_path", _R + f"""SELECT road_id, {sql_fixed('least(l1 + l2, 90) - 25', 3)} AS metres, (2 + CASE WHEN l1 > 25 AND l1 < 90 THEN 1 ELSE 0 END)::BIGINT AS points
  FROM (SELECT road_id, {_LEN1} AS l1, {_LEN2} AS l2 FROM roads)""")
def slice_path(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", f"{G.slice_path('coordinates', '25D', '90D')} as p")
    return df.selectExpr("road_id", f"{G.fixed(G.line_length('p'), 3)} as metres", "bigint(size(p)) as points")


_PIP = cte("buildings", "zones") + """, zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0]) AS ax, unnest([y0,y0,y1,ym,y1]) AS ay,
  unnest([x1,x1,xm,x0,x0]) AS bx, unnest([y0,y1,ym,y1,y0]) AS by_ FROM zones),
 p AS (SELECT city, building_id AS id, CASE WHEN ord % 5 = 0 THEN (SELECT max(z.x0) FROM zones z WHERE z.city = b.city) ELSE x0 END AS x, y0 AS y FROM buildings b),
 h AS (SELECT p.city, p.id, z.zone_id, count(*) FILTER ((z.by_ > p.y) <> (z.ay > p.y) AND p.x < (z.ax - z.bx) * ((p.y - z.by_)::DOUBLE / (z.ay - z.by_)) + z.bx) % 2 = 1 AS parity,
  bool_or((z.ax - p.x) * (z.by_ - p.y) = (z.bx - p.x) * (z.ay - p.y) AND p.x BETWEEN least(z.ax, z.bx) AND greatest(z.ax, z.bx) AND p.y BETWEEN least(z.ay, z.by_) AND greatest(z.ay, z.by_)) AS edge
  FROM p JOIN zr z USING (city) GROUP BY ALL)
"""


@query("h08_point_in_polygon_boundary", _PIP + "SELECT id, zone_id FROM h WHERE parity OR edge")
def pip_boundary(spark, sf):
    return op.edge_points_in_zones(spark, sf, "boundary")


@query("h08_point_in_polygon_strict", _PIP + "SELECT id, zone_id FROM h WHERE parity AND NOT edge")
def pip_strict(spark, sf):
    return op.edge_points_in_zones(spark, sf, "strict")


@query("h09_ring_self_crossing", cte("zones") + "SELECT zone_id, ord % 2 = 1 AS crosses, ord % 4 <> 0 AS closed FROM zones")
def self_cross(spark, sf):
    df = city.zones(spark, sf).selectExpr("zone_id", """case when ord % 2 = 1 then array(boundary[0], boundary[2], boundary[1], boundary[4], boundary[0])
        when ord % 4 = 0 then slice(boundary, 1, 5) else boundary end as r""")
    return df.selectExpr("zone_id", f"{P.self_crosses('r')} as crosses", f"{P.is_closed('r')} as closed")


_RING = cte("zones") + """, zr AS (SELECT zone_id, unnest([0, x1-x0, x1-x0, xm-x0, 0])::DOUBLE AS ax, unnest([0, 0, y1-y0, ym-y0, y1-y0])::DOUBLE AS ay,
  unnest([x1-x0, x1-x0, xm-x0, 0, 0])::DOUBLE AS bx, unnest([0, y1-y0, ym-y0, y1-y0, 0])::DOUBLE AS by_ FROM zones),
 m AS (SELECT zone_id, sum(ax * by_ - bx * ay) AS w, sum((ax + bx) * (ax * by_ - bx * ay)) AS cx, sum((ay + by_) * (ax * by_ - bx * ay)) AS cy FROM zr GROUP BY 1)
"""


@query("h10_ring_area_centroid", _RING + f"""SELECT zone_id, {sql_fixed('abs(w) / 2 / 1e8', 4)} AS area, {sql_fixed('x0 / 1e7 + cx / (3 * w) / 1e7', 6)} AS lon,
  {sql_fixed('y0 / 1e7 + cy / (3 * w) / 1e7', 6)} AS lat, {sql_fixed('(x0 + x1 + x1 + xm + x0 + x0) / 6 / 1e7', 6)} AS mean_lon FROM zones JOIN m USING (zone_id)""")
def ring_measures(spark, sf):
    return city.zones(spark, sf).selectExpr("zone_id", f"{G.fixed(P.shoelace('boundary') + ' * 1e6', 4)} as area", f"{G.fixed(P.centroid('boundary') + '.lon', 6)} as lon",
                                            f"{G.fixed(P.centroid('boundary') + '.lat', 6)} as lat", f"{G.fixed(P.mean_of('boundary', 'lon'), 6)} as mean_lon")


@query("h11_clip_ring_to_box", cte("zones") + f"""SELECT zone_id, {sql_fixed('(x1 - 9000 - x0) / 1e4 * (y1 - 9000 - y0 - 8000) / 1e4', 4)} AS area_left FROM zones""")
def clip_box(spark, sf):
    # A box that cuts the notched ring along straight stretches only, below the notch.
    df = city.zones(spark, sf).selectExpr(
        "zone_id", "boundary", "x0 / 1e7 as min_lon", "(x1 - 9000) / 1e7 as max_lon", "(y0 + 8000) / 1e7 as min_lat", "(y1 - 9000) / 1e7 as max_lat")
    return op.clip_rings(df).selectExpr("zone_id", f"{G.fixed(P.shoelace('clipped') + ' * 1e6', 4)} as area_left")


_MX = "6378137.0::DOUBLE * radians(xa / 1e7)"
_MY = "6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(ya / 1e7) / 2))"


@query("h12_mercator_cells", _R + f"SELECT road_id, CAST(floor({_MX} / 150) AS BIGINT) AS cx, CAST(floor({_MY} / 150) AS BIGINT) AS cy FROM roads")
def cells(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr("road_id", f"{G.mercator_cell('xa / 1e7', 'ya / 1e7', 150)} as c")
    return df.selectExpr("road_id", "c.cx", "c.cy")


_CELL = """, ends AS (SELECT road_id, seg, 6378137.0::DOUBLE * radians(ax) AS x1, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(ay) / 2)) AS y1,
  6378137.0::DOUBLE * radians(bx) AS x2, 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(by_) / 2)) AS y2 FROM road_segments),
 spans AS (SELECT *, unnest(range(CAST(floor(least(x1, x2) / 50) AS BIGINT), CAST(floor(greatest(x1, x2) / 50) AS BIGINT) + 1)) AS cx FROM ends),
 parts AS (SELECT *, greatest(least(x1, x2), cx * 50) AS xl, least(greatest(x1, x2), (cx + 1) * 50) AS xh FROM spans),
 rows_ AS (SELECT *, CASE WHEN x1 = x2 THEN least(y1, y2) ELSE least(y1 + (xl - x1) / (x2 - x1) * (y2 - y1), y1 + (xh - x1) / (x2 - x1) * (y2 - y1)) END AS yl,
  CASE WHEN x1 = x2 THEN greatest(y1, y2) ELSE greatest(y1 + (xl - x1) / (x2 - x1) * (y2 - y1), y1 + (xh - x1) / (x2 - x1) * (y2 - y1)) END AS yh FROM parts)
 SELECT road_id, count(DISTINCT (cx, cy)) AS cells FROM (SELECT road_id, cx, unnest(range(CAST(floor(yl / 50) AS BIGINT), CAST(floor(yh / 50) AS BIGINT) + 1)) AS cy FROM rows_) GROUP BY 1"""


@query("h12_cells_crossed", _R + "," + city.ROAD_SEGMENTS + _CELL)
def crossed(spark, sf):
    return op.cells_crossed(city.roads(spark, sf).select("road_id", "coordinates"), 50.0).groupBy("road_id").agg(
        F.expr("count(distinct cx, cy)").alias("cells"))


@query("h15_content_keys", None)
def content_keys(spark, sf):
    return op.content_keys(city.buildings(spark, sf), "building_id", ["residents", "employees", "coordinates"])


@query("h15_content_classes", cte("buildings") + "SELECT building_id, min(building_id) OVER (PARTITION BY category, floor(bal / 1000), ord % 3) AS first_alike FROM buildings")
def content_classes(spark, sf):
    """Buildings of the same content get the same key, others another one."""
    df = city.derive(spark, sf, "buildings").selectExpr("building_id", "category", "floor(bal / 1000) as worth", "ord % 3 as kind")
    keys = op.content_keys(df, "building_id", ["category", "worth", "kind"])
    key = next(c for c in keys.columns if c != "building_id")
    first = keys.groupBy(key).agg(F.min("building_id").alias("first_alike"))
    return keys.join(first, key).select("building_id", "first_alike")


_BEAR = "degrees(atan2((xb - xa) / 1e7 * 111320.0::DOUBLE * cos(radians(ya / 1e7)), (yb - ya) / 1e7 * 110540.0::DOUBLE))"


@query("h18_bearings", _R + f"""SELECT road_id, {sql_fixed('h', 4)} AS heading, {sql_fixed('CASE WHEN abs(h - b2) > 180 THEN 360 - abs(h - b2) ELSE abs(h - b2) END', 4)} AS to_plan FROM (
  SELECT road_id, CASE WHEN {_BEAR} < 0 THEN {_BEAR} + 360 ELSE {_BEAR} END AS h, ((ord * 37) % 360)::DOUBLE AS b2 FROM roads)""")
def bearings(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr("road_id", f"{G.pt('xa / 1e7', 'ya / 1e7')} as a", f"{G.pt('xb / 1e7', 'yb / 1e7')} as b", "double((ord * 37) % 360) as plan")
    df = df.selectExpr("road_id", f"{G.bearing('a', 'b')} as h", "plan")
    return df.selectExpr("road_id", f"{G.fixed('h', 4)} as heading", f"{G.fixed(G.angle_between('h', 'plan'), 4)} as to_plan")


@query("h21_parse_boxes", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k FROM orders)
 SELECT id, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 1 ELSE 0 END::BIGINT AS boxes,
 CASE WHEN k IN (2, 3) THEN 'bad box' WHEN k = 5 THEN 'no box given' END AS reason FROM t""")
def boxes(spark, sf):
    df = city.table(spark, sf, "orders").selectExpr("o_orderkey as id", """case o_orderkey % 6 when 0 then '73.8,18.5,73.9,18.6;74,19,74.5,19.5'
        when 1 then ' 73.8 , 18.5,73.9,18.6 ;' when 2 then '1,2,3' when 3 then '5,2,3,x' when 4 then '-1,-2,3,4' else ' ; ' end as txt""")
    return op.parse_boxes(df, "txt").selectExpr("id", "bigint(size(boxes)) as boxes", "reason")


@query("h22_suggested_range", _R + f"""SELECT road_id, CAST(least(5000, greatest(100, greatest(300, floor(m * 2.5::DOUBLE / 50 + 0.5) * 50))) AS BIGINT) AS range_m
  FROM (SELECT road_id, ({_pl(*_A, *_M)} + {_pl(*_M, *_B)}) * (1 + ord % 30) AS m FROM roads)""")
def ranges(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", f"{G.line_length('coordinates', G.planar_pts)} * (1 + ord % 30) as m")
    return df.selectExpr("road_id", f"bigint({op.suggested_range('m')}) as range_m")


@query("h23_tiles_around_bounds", _R + """SELECT tx, ty, count(*) AS roads FROM (SELECT road_id, tx, unnest(range(CAST(floor((y0 - 300 / 111320.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT), CAST(floor((y1 + 300 / 111320.0::DOUBLE) / 0.01::DOUBLE) AS BIGINT) + 1)) AS ty FROM (
  SELECT road_id, y0, y1, unnest(range(CAST(floor((x0 - 300 / (111320.0::DOUBLE * cos(radians((y0 + y1) / 2)))) / 0.01::DOUBLE) AS BIGINT), CAST(floor((x1 + 300 / (111320.0::DOUBLE * cos(radians((y0 + y1) / 2)))) / 0.01::DOUBLE) AS BIGINT) + 1)) AS tx FROM (
  SELECT road_id, least(xa, xm, xb) / 1e7 AS x0, least(ya, ym, yb) / 1e7 AS y0, greatest(xa, xm, xb) / 1e7 AS x1, greatest(ya, ym, yb) / 1e7 AS y1 FROM roads))) GROUP BY ALL""")
def tiles(spark, sf):
    return op.coverage_tiles(city.roads(spark, sf).select("road_id", "coordinates"), 300.0).groupBy("tx", "ty").agg(F.expr("count(1)").alias("roads"))


@query("e01_cumulative_distance", _R + f"""SELECT road_id, 0::BIGINT AS pos, 0.0::DOUBLE AS metres FROM roads UNION ALL SELECT road_id, 1, {sql_fixed(_LEN1, 3)} FROM roads
  UNION ALL SELECT road_id, 2, {sql_fixed(f'{_LEN1} + {_LEN2}', 3)} FROM roads""")
def cumulative(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", f"posexplode({G.cumulative('coordinates')}) as (pos, m)")
    return df.selectExpr("road_id", "bigint(pos) as pos", f"{G.fixed('m', 3)} as metres")


@query("u04_shared_vertices", _R + "," + city.ROAD_POINTS + """SELECT a.road_id AS road_a, b.road_id AS road_b, count(DISTINCT (a.x, a.y)) AS shared
  FROM road_points a JOIN road_points b ON a.city = b.city AND a.x = b.x AND a.y = b.y AND a.ord < b.ord GROUP BY ALL""")
def shared(spark, sf):
    return op.shared_vertices(city.roads(spark, sf))


_FLY = cte("flyovers") + f""", n AS (SELECT *, greatest(1, CAST(ceil({sql_hav('xa / 1e7', 'ya / 1e7', 'xb / 1e7', 'yb / 1e7')} / 10) AS BIGINT)) AS n FROM flyovers),
 k AS (SELECT flyover_id, elevation, n, unnest(range(0, n + 1)) AS pos, xa / 1e7 AS xa, ya / 1e7 AS ya, xb / 1e7 AS xb, yb / 1e7 AS yb FROM n),
 p AS (SELECT flyover_id, elevation, n, pos, xa + (xb - xa) * pos / n AS x, ya + (yb - ya) * pos / n AS y FROM k),
 q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY flyover_id ORDER BY pos)),
 c AS (SELECT *, sum(CASE WHEN px IS NULL THEN 0 ELSE {sql_hav('px', 'py', 'x', 'y')} END) OVER (PARTITION BY flyover_id ORDER BY pos) AS m FROM q),
 t AS (SELECT *, max(m) OVER (PARTITION BY flyover_id) AS total FROM c),
 r AS (SELECT *, least(1, least(m, total - m) / least(40, total / 2)) AS s FROM t)
 SELECT flyover_id, pos, {sql_fixed('m', 3)} AS metres, {sql_fixed('0.25::DOUBLE + (elevation - 0.25::DOUBLE) * s * s * (3 - 2 * s)', 3)} AS height FROM r"""


@query("h20_flyover_heights", _FLY)
def flyover_heights(spark, sf):
    return op.flyover_profile(city.flyovers(spark, sf))
