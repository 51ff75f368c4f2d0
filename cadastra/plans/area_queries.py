"""Junction stretches, footprints, coverage, readiness and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import fixed
from ..operators import coverage as cg
from ..operators import demand as dm
from ..operators import graph as gr
from ..session import materialise
from ..sources import citydata as city
from ..sources.citydata import ROAD_POINTS, ROAD_SEGMENTS, cte, sql_fixed
from .demand_queries import _IN, MATRIX_CTE, demand_inputs
from .graph_queries import _RT as ROUTE_TIME
from .graph_queries import EDGES, grid_edges
from .nearest_queries import grid_nodes, roads
from .registry import query

# Own and other pieces of a city's roads in the own road's metric frame.
_GAPS = cte("roads") + "," + ROAD_SEGMENTS + """, sg AS (SELECT s.city, s.road_id, s.seg, s.ax, s.ay, s.bx, s.by_, r.xa / 1e7 AS x0, r.ya / 1e7 AS y0, 111320.0::DOUBLE * cos(radians(r.ya / 1e7)) AS kx, r.lane_count * 3.5::DOUBLE + 3 AS width FROM road_segments s JOIN roads r USING (road_id)),
 l AS (SELECT *, sqrt(pow((bx - ax) * kx, 2) + pow((by_ - ay) * 111320.0::DOUBLE, 2)) AS len FROM sg), la AS (SELECT *, sum(len) OVER (PARTITION BY road_id) AS total, CASE WHEN seg = 0 THEN 0 ELSE sum(len) OVER (PARTITION BY road_id) - len END AS along FROM l),
 pr AS (SELECT p.road_id, p.seg, p.len, p.total, p.along, q.road_id AS oid, q.seg AS oseg, q.width / 2 + 1.5 AS half, q.width / 2 + 6 AS lim, (p.ax - p.x0) * p.kx AS ax, (p.ay - p.y0) * 111320.0::DOUBLE AS ay, (p.bx - p.x0) * p.kx AS bx, (p.by_ - p.y0) * 111320.0::DOUBLE AS by_,
  (q.ax - p.x0) * p.kx AS cx, (q.ay - p.y0) * 111320.0::DOUBLE AS cy, (q.bx - p.x0) * p.kx AS ex, (q.by_ - p.y0) * 111320.0::DOUBLE AS ey, p.bx - p.ax AS rx, p.by_ - p.ay AS ry, q.bx - q.ax AS sx, q.by_ - q.ay AS sy, q.ax - p.ax AS qx, q.ay - p.ay AS qy FROM la p JOIN la q ON p.city = q.city AND p.road_id <> q.road_id),
 cr AS (SELECT *, (bx - ax) * (ey - cy) - (by_ - ay) * (ex - cx) AS den, sqrt(pow(ex - cx, 2) + pow(ey - cy, 2)) AS fl FROM pr),
 c1 AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM cr WHERE abs(den) >= 1e-9),
 oe AS (SELECT *, cx AS px, cy AS py FROM cr WHERE oseg = 0 UNION ALL SELECT *, ex, ey FROM cr WHERE oseg = 1), ot AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (len * len))) AS t FROM oe),
 me AS (SELECT *, 0 AS k, ax AS px, ay AS py FROM cr WHERE seg = 0 UNION ALL SELECT *, 1, bx, by_ FROM cr WHERE seg = 1), mt AS (SELECT *, greatest(0, least(1, ((px - cx) * (ex - cx) + (py - cy) * (ey - cy)) / (fl * fl))) AS u FROM me),
 gaps AS (SELECT road_id, total, along + t * len - half / greatest(abs(den) / (len * fl), 0.35::DOUBLE) AS g0, along + t * len + half / greatest(abs(den) / (len * fl), 0.35::DOUBLE) AS g1 FROM c1 WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1
  UNION ALL SELECT road_id, total, along + t * len - half, along + t * len + half FROM ot WHERE sqrt(pow(ax + t * (bx - ax) - px, 2) + pow(ay + t * (by_ - ay) - py, 2)) <= lim
  UNION ALL SELECT road_id, total, CASE WHEN k = 0 THEN 0 ELSE total - half END, CASE WHEN k = 0 THEN half ELSE total END FROM mt WHERE sqrt(pow(cx + u * (ex - cx) - px, 2) + pow(cy + u * (ey - cy) - py, 2)) <= lim),
 cl AS (SELECT road_id, total, greatest(0, g0) AS g0, least(total, g1) AS g1 FROM gaps WHERE least(total, g1) > greatest(0, g0)),
 fr AS (SELECT *, CASE WHEN g0 <= max(g1) OVER (PARTITION BY road_id ORDER BY g0, g1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM cl),
 il AS (SELECT *, sum(fresh) OVER (PARTITION BY road_id ORDER BY g0, fresh DESC, g1 ROWS UNBOUNDED PRECEDING) AS island FROM fr), mg AS (SELECT road_id, total, island, min(g0) AS g0, max(g1) AS g1 FROM il GROUP BY ALL)
"""


def gaps(spark, sf):
    r = roads(spark, sf).selectExpr("city", "road_id", "coordinates", "lane_count * 3.5D + 3 as width")
    return cg.merge_intervals(cg.crossing_gaps(r), ["city", "road_id"])


@query("e05_junction_gaps", _GAPS + f"SELECT road_id, {sql_fixed('g0', 4)} AS g0, {sql_fixed('g1', 4)} AS g1 FROM mg")
def junction_gaps(spark, sf):
    return gaps(spark, sf).selectExpr("road_id", f"{fixed('g0', 4)} as g0", f"{fixed('g1', 4)} as g1")


@query("e05_clear_pieces", _GAPS + f""", pc AS (SELECT road_id, coalesce(lag(g1) OVER w, 0) AS p0, g0 AS p1 FROM mg WINDOW w AS (PARTITION BY road_id ORDER BY g0) UNION ALL SELECT road_id, max(g1), any_value(total) FROM mg GROUP BY road_id
  UNION ALL SELECT DISTINCT road_id, 0, total FROM la WHERE road_id NOT IN (SELECT road_id FROM mg)) SELECT road_id, {sql_fixed('p0', 4)} AS p0, {sql_fixed('p1', 4)} AS p1 FROM pc WHERE p1 - p0 >= 2""")
def clear_pieces(spark, sf):
    from ..functions.geo import METRES_PER_DEG
    m = f"{METRES_PER_DEG}D"
    step = f"sqrt(power((_q.b.lon - _q.a.lon) * {m} * cos(radians(coordinates[0].lat)), 2) + power((_q.b.lat - _q.a.lat) * {m}, 2))"
    from ..functions.geo import steps
    lengths = roads(spark, sf).selectExpr("city", "road_id", f"aggregate({steps('coordinates')}, 0D, (_acc, _q) -> _acc + {step}) as total")
    merged = materialise(gaps(spark, sf), "gaps")
    return cg.clear_pieces(merged, lengths, ["city", "road_id"]).selectExpr("road_id", f"{fixed('p0', 4)} as p0", f"{fixed('p1', 4)} as p1")


@query("h24_junction_footprints", None)
def footprints(spark, sf):
    """Outlines of junctions placed near street corners."""
    j = city.points(spark, sf, "signals").selectExpr("city", "ord as junction_id", "lon - 0.00009D as lon", "lat + 0.00007D as lat", "0D as z")
    r = roads(spark, sf).withColumn("median", F.expr("case when size % 3 = 0 then 2D else 0D end"))
    return cg.junction_footprints(cg.junction_arms(j, r)).withColumn("area_m2", F.expr(fixed("area_m2", 2)))


_SAMPLES = cte("sites", "zones") + """, st AS (SELECT city, concat('s', CAST(ord AS VARCHAR)) AS study_id, (ox + 30000) / 1e7 AS x0, (oy + 30000) / 1e7 AS y0, (ox + 50000) / 1e7 AS x1, (oy + 50000) / 1e7 AS y1 FROM sites WHERE j = 0),
 k AS (SELECT *, 111320.0::DOUBLE * cos(radians((y0 + y1) / 2)) AS kx FROM st), w AS (SELECT *, (x1 - x0) * kx + 1200 AS w, (y1 - y0) * 111320.0::DOUBLE + 1200 AS h FROM k), sp AS (SELECT *, 150.0::DOUBLE AS step FROM w),
 gx AS (SELECT *, unnest(range(0, CAST(floor(w / step) AS BIGINT) + 1)) AS ix FROM sp), gy AS (SELECT *, unnest(range(0, CAST(floor(h / step) AS BIGINT) + 1)) AS iy FROM gx),
 p AS (SELECT *, x0 - 600 / kx + ix * step / kx AS lon, y0 - 600 / 111320.0::DOUBLE + iy * step / 111320.0::DOUBLE AS lat FROM gy), r AS (SELECT * FROM p WHERE sqrt(pow(greatest(x0 - lon, 0, lon - x1) * kx, 2) + pow(greatest(y0 - lat, 0, lat - y1) * 111320.0::DOUBLE, 2)) <= 600),
 zr AS (SELECT city, zone_id, unnest([x0,x1,x1,xm,x0])/1e7 AS ax, unnest([y0,y0,y1,ym,y1])/1e7 AS ay, unnest([x1,x1,xm,x0,x0])/1e7 AS bx, unnest([y0,y1,ym,y1,y0])/1e7 AS by_ FROM zones WHERE total_population > 1500),
 hit AS (SELECT DISTINCT study_id, ix, iy FROM (SELECT study_id, ix, iy, zone_id FROM r JOIN zr z USING (city) WHERE (z.by_ > lat) <> (z.ay > lat) AND lon < (z.ax - z.bx) * (lat - z.by_) / (z.ay - z.by_) + z.bx GROUP BY ALL HAVING count(*) % 2 = 1))"""


@query("e09_coverage_samples", _SAMPLES + """ SELECT study_id, ix::INT AS ix, iy::INT AS iy, CASE WHEN (study_id, ix, iy) IN (SELECT study_id, ix, iy FROM hit) THEN 2 ELSE 1 END AS state FROM r""")
def samples(spark, sf):
    areas = city.zones(spark, sf).filter("total_population > 1500").select("city", "boundary")
    studies = city.derive(spark, sf, "sites").filter("j = 0").selectExpr(
        "city", "concat('s', ord) as study_id", "600D as range_m", "named_struct('min_lon', (ox + 30000) / 1e7, 'min_lat', (oy + 30000) / 1e7, 'max_lon', (ox + 50000) / 1e7, 'max_lat', (oy + 50000) / 1e7) as box")
    return cg.coverage_samples(studies, areas)


@query("g25_missing_coverage", _SAMPLES + """, o AS (SELECT study_id, ix, iy, ix - row_number() OVER (PARTITION BY study_id, iy ORDER BY ix) AS k FROM r WHERE (study_id, ix, iy) NOT IN (SELECT study_id, ix, iy FROM hit)),
 n AS (SELECT study_id, iy, min(ix) AS ix0, max(ix) AS ix1 FROM o GROUP BY study_id, iy, k), pp AS (SELECT *, iy - row_number() OVER (PARTITION BY study_id, ix0, ix1 ORDER BY iy) AS pile FROM n)
 SELECT study_id, ix0::INT AS ix0, ix1::INT AS ix1, min(iy)::INT AS iy0, max(iy)::INT AS iy1 FROM pp GROUP BY study_id, ix0, ix1, pile""")
def missing(spark, sf):
    """Parts of each city's 600 m study range that no zone with roads covers yet."""
    areas = city.zones(spark, sf).filter("total_population > 1500").select("city", "boundary")
    studies = city.derive(spark, sf, "sites").filter("j = 0").selectExpr(
        "city", "concat('s', ord) as study_id", "600D as range_m", "named_struct('min_lon', (ox + 30000) / 1e7, 'min_lat', (oy + 30000) / 1e7, 'max_lon', (ox + 50000) / 1e7, 'max_lat', (oy + 50000) / 1e7) as box")
    return cg.missing_boxes(cg.coverage_samples(studies, areas))


_EDGE_PART = EDGES[len(cte("roads")):]
_ROADS_CTE = cte("roads")[len("WITH "):]


@query("d07_route_readiness", "WITH RECURSIVE " + _IN[len("WITH "):] + MATRIX_CTE + ", " + _ROADS_CTE + _EDGE_PART + """, nodes AS (SELECT DISTINCT city, a AS node, xa0 / 1e7 AS lon, ya0 / 1e7 AS lat FROM g UNION SELECT DISTINCT city, b, xb0 / 1e7, yb0 / 1e7 FROM g),
 places AS (SELECT DISTINCT city, building_id AS id, x0 / 1e7 AS lon, y0 / 1e7 AS lat FROM buildings UNION ALL SELECT city, zone_id, x0 / 1e7, y0 / 1e7 FROM zones UNION ALL SELECT city, gateway_id, x / 1e7, y / 1e7 FROM gateways),
 seeded AS (SELECT p.id, arg_min(n.node, (sqrt(pow(p.lon - n.lon, 2) + pow(p.lat - n.lat, 2)), n.node)) AS node FROM places p JOIN nodes n USING (city) GROUP BY 1), od AS (SELECT DISTINCT city, origin_id, destination_id FROM matrix),
 on_ AS (SELECT od.*, a.node AS a, b.node AS b FROM od LEFT JOIN seeded a ON a.id = origin_id LEFT JOIN seeded b ON b.id = destination_id), rr(k, node) AS (SELECT DISTINCT a, a FROM on_ UNION SELECT rr.k, e.dst FROM rr JOIN edges e ON e.src = rr.node)
 SELECT city, count(*) AS od_pairs, count(a) AS valid_origins, count(b) AS valid_destinations, count(*) FILTER (a <> b AND r.k IS NOT NULL) AS routed, count(*) FILTER (NOT (coalesce(a <> b, false) AND r.k IS NOT NULL)) AS failed FROM on_ LEFT JOIN rr r ON r.k = a AND r.node = b GROUP BY city""")
def readiness(spark, sf):
    """Every OD pair of the gravity matrix checked against the street network."""
    od = dm.od_matrix(demand_inputs(spark, sf)).select("city", "origin_id", "destination_id")
    b = city.derive(spark, sf, "buildings").selectExpr("city", "building_id as id", "x0 / 1e7 as lon", "y0 / 1e7 as lat")
    z = city.derive(spark, sf, "zones").selectExpr("city", "zone_id as id", "x0 / 1e7 as lon", "y0 / 1e7 as lat")
    g = city.points(spark, sf, "gateways").selectExpr("city", "gateway_id as id", "lon", "lat")
    # Only cities with streets have nodes to start from.
    nodes = grid_nodes(spark, sf)
    places = b.unionByName(z).unionByName(g).join(nodes.select("city").distinct(), "city", "left_semi")
    return dm.route_readiness(od, dm.nearest_seed_nodes(places, nodes), grid_edges(spark, sf))


@query("b14_drivable_objects", cte("proposals") + "SELECT id, type IN ('road', 'flyover', 'metro_flyover') AS drivable FROM proposals")
def drivable(spark, sf):
    return city.derive(spark, sf, "proposals").selectExpr("id", "type in ('road', 'flyover', 'metro_flyover') as drivable")


@query("b19_area_cut_ends", cte("roads") + """SELECT road_id, (ord % 3 = 0) OR (ord % 4 = 0 AND xa = xb AND ya = yb) AS cut_at_start, ord % 4 = 0 AS cut_at_end FROM roads""")
def cut_ends(spark, sf):
    """Road ends made by clipping: the recorded cut flag and a position within 1e-7 degrees."""
    def near(p, q):
        return f"(abs({p}.lon - {q}.lon) < 1e-7 and abs({p}.lat - {q}.lat) < 1e-7)"
    df = city.roads(spark, sf).selectExpr("road_id", "coordinates[0] as s", "coordinates[2] as e", "ord % 3 = 0 as start_cut", "ord % 4 = 0 as end_cut")
    return df.selectExpr("road_id", *[f"(start_cut and {near('s', p)}) or (end_cut and {near('e', p)}) as cut_at_{n}" for n, p in (("start", "s"), ("end", "e"))])


@query("u03_distinct_pairs", cte("roads") + "," + ROAD_POINTS + """SELECT DISTINCT least(a.road_id, b.road_id) AS road_a, greatest(a.road_id, b.road_id) AS road_b FROM road_points a JOIN road_points b ON a.city = b.city AND a.x = b.x AND a.y = b.y AND a.road_id <> b.road_id""")
def distinct_pairs(spark, sf):
    """Findings about two roads, reported from either side, kept once."""
    from ..operators.geometry import shared_vertices
    both = shared_vertices(city.roads(spark, sf)).selectExpr("inline(array(struct(road_a as a, road_b as b), struct(road_b as a, road_a as b)))")
    return both.withColumn("k", F.expr("array_sort(array(a, b))")).dropDuplicates(["k"]).selectExpr("k[0] as road_a", "k[1] as road_b")


@query("u05_typed_feature_identity", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'way' ELSE 'relation' END AS element_type FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = o_orderkey % 2)""")
def typed_identity(spark, sf):
    """Incoming features not stored yet; way 200 and relation 200 are different features."""
    kind = "case when {0} % 2 = 0 then 'way' else 'relation' end as element_type"
    incoming = city.table(spark, sf, "orders").selectExpr("o_orderkey as id", kind.format("o_orderkey"))
    stored = city.table(spark, sf, "lineitem").selectExpr("l_orderkey as id", kind.format("l_linenumber"))
    return incoming.join(stored, ["id", "element_type"], "left_anti")


@query("f05_cheapest_via_route", "WITH RECURSIVE" + EDGES[len("WITH"):] + f""", ew AS (SELECT src, dst, length / (speed_limit / 3.6::DOUBLE) AS t, {ROUTE_TIME} AS w FROM edges), er AS (SELECT dst AS src, src AS dst, t, w FROM ew), sd AS (SELECT DISTINCT city * 121 + 60 AS node FROM roads),
 fw(k, node, d, t) USING KEY (k, node) AS (SELECT node AS k, node, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t FROM sd UNION SELECT s.k, e.dst, min(s.d + e.w), arg_min(s.t + e.t, s.d + e.w) FROM fw s JOIN ew e ON e.src = s.node LEFT JOIN recurring.fw r ON r.k = s.k AND r.node = e.dst WHERE r.d IS NULL OR s.d + e.w < r.d GROUP BY s.k, e.dst),
 bw(k, node, d, t) USING KEY (k, node) AS (SELECT node + 55 AS k, node + 55 AS node, 0.0::DOUBLE AS d, 0.0::DOUBLE AS t FROM sd UNION SELECT s.k, e.dst, min(s.d + e.w), arg_min(s.t + e.t, s.d + e.w) FROM bw s JOIN er e ON e.src = s.node LEFT JOIN recurring.bw r ON r.k = s.k AND r.node = e.dst WHERE r.d IS NULL OR s.d + e.w < r.d GROUP BY s.k, e.dst)
 SELECT e.city, {sql_fixed("min(f.t + e.length / (e.speed_limit / 3.6::DOUBLE) + b.t)", 4)} AS seconds FROM edges e JOIN fw f ON f.k = e.city * 121 + 60 AND f.node = e.src JOIN bw b ON b.k = e.city * 121 + 115 AND b.node = e.dst WHERE e.road_id IN (SELECT road_id FROM roads WHERE j = 90) GROUP BY e.city""")
def via_route(spark, sf):
    """Way from one corner to another that uses the selected road of the city."""
    e = materialise(grid_edges(spark, sf).withColumns({"w": F.expr(gr.route_time()), "t": F.expr(gr.travel_time())}), "weighted")
    via = e.join(city.derive(spark, sf, "roads").filter("j = 90").select("road_id"), "road_id", "left_semi")
    choices = via.selectExpr("city as pair", "city * 121 + 60 as origin", "city * 121 + 115 as target", "edge_id")
    return gr.cheapest_via(e.select("src", "dst", "edge_id", "w", "t"), choices).selectExpr("pair as city", f"{fixed('seconds', 4)} as seconds")
