"""Demand queries: zone matching, trip events, gravity matrix and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import demand as D
from ..functions.geo import fixed
from ..operators import demand as op
from ..session import materialise
from ..sources import citydata as city
from ..sources import objects as store
from ..sources.citydata import cte, sql_fixed, sql_hav
from .registry import query

# ---- shared inputs ----------------------------------------------------------


def parsed_buildings(spark, sf):
    """Base buildings from the raw store; the parsed list is what the demand model reads."""
    raw = store.scan_city_objects(store.raw_objects(spark, sf, ("building", "proposal")), "base")
    return store.parse_city_objects(raw, "building")


def gateway_flows(spark, sf):
    def flow_map(p):
        return "map(" + ", ".join(f"'{n}', double({p}_{s})" for s, n in (
            ("am", "AM_Peak"), ("pm", "PM_Peak"), ("mid", "Midday"), ("night", "Night"))) + ")"
    return city.points(spark, sf, "gateways").selectExpr(
        "city", "gateway_id", "lon", "lat", f"{flow_map('in')} as inbound", f"{flow_map('out')} as outbound",
        f"{D.default_split()} as split")


def demand_inputs(spark, sf):
    buildings = parsed_buildings(spark, sf)
    residuals = op.zone_residuals(op.zone_building_totals(buildings.filter(F.size("coordinates") > 0), city.zones(spark, sf)))
    events = op.building_trip_events(op.explicit_buildings(buildings.filter(F.size("coordinates") > 0)))
    # Read several times below, so worked out once and kept as a table.
    return materialise(op.demand_ends(events, residuals, gateway_flows(spark, sf)), "demand_ends")


# ---- SQL for the same inputs ------------------------------------------------

_GOOD = "ord % 101 <> 100"
SPLIT_SQL = {"car": "0.25", "two_wheeler": "0.35", "bus": "0.2", "metro": "0.1", "walking": "0.08", "other": "0.02"}


def _period_sql(t: str) -> str:
    h = f"CAST(split_part({t}, ':', 1) AS INT)"
    return (f"CASE WHEN {h} >= 7 AND {h} < 11 THEN 'AM_Peak' WHEN {h} >= 11 AND {h} < 16 THEN 'Midday' "
            f"WHEN {h} >= 16 AND {h} < 21 THEN 'PM_Peak' WHEN {t} IS NOT NULL THEN 'Night' END")


EVENTS_CTE = f""",
b0 AS (SELECT *, x0/1e7 AS lon0, y0/1e7 AS lat0, (x0/1e7 + x1/1e7 + x1/1e7 + x0/1e7 + x0/1e7)/5 AS mlon,
       (y0/1e7 + y0/1e7 + y1/1e7 + y1/1e7 + y0/1e7)/5 AS mlat,
       {_period_sql('departure_start')} AS dep, {_period_sql('arrival_start')} AS arr,
       (departure_start IS NOT NULL OR arrival_start IS NOT NULL OR daily_trips IS NOT NULL OR am_trips IS NOT NULL OR pm_trips IS NOT NULL) AS own
       FROM buildings WHERE {_GOOD}),
b1 AS (SELECT *, split_car / (split_car + split_walk) AS s_car, split_walk / (split_car + split_walk) AS s_walk FROM b0),
explicit AS (SELECT * FROM b1 WHERE category IN ('office','retail','commercial') OR employees > 100 OR residents > 150
       OR source = 'manual' OR own OR split_car IS NOT NULL),
usual AS (SELECT e.*, v.role, v.period, v.trips FROM explicit e, LATERAL (VALUES
       ('origin','AM_Peak', residents*2.0::DOUBLE*0.35::DOUBLE), ('destination','PM_Peak', residents*2.0::DOUBLE*0.4::DOUBLE),
       ('destination','AM_Peak', employees*1.5::DOUBLE*0.35::DOUBLE), ('origin','PM_Peak', employees*1.5::DOUBLE*0.4::DOUBLE)) v(role,period,trips)
       WHERE NOT own),
own0 AS (SELECT *, COALESCE(dep, CASE WHEN residents >= employees THEN 'AM_Peak' ELSE 'PM_Peak' END) AS leave,
       COALESCE(arr, CASE WHEN residents >= employees THEN 'PM_Peak' ELSE 'AM_Peak' END) AS arrive,
       CASE WHEN daily_trips > 0 THEN daily_trips ELSE residents*2.0::DOUBLE + employees*1.5::DOUBLE END AS daily FROM explicit WHERE own),
own1 AS (SELECT *, 'origin' AS role, leave AS period FROM own0 UNION ALL SELECT *, 'destination', arrive FROM own0),
own2 AS (SELECT *, CASE WHEN period='AM_Peak' AND am_trips > 0 THEN am_trips WHEN period='PM_Peak' AND pm_trips > 0 THEN pm_trips
       ELSE daily * CASE period WHEN 'AM_Peak' THEN 0.35::DOUBLE WHEN 'PM_Peak' THEN 0.4::DOUBLE WHEN 'Midday' THEN 0.15::DOUBLE ELSE 0.1::DOUBLE END END AS trips FROM own1),
events AS (SELECT city, building_id AS id, lon0 AS lon, lat0 AS lat, role, period, trips, s_car, s_walk FROM usual WHERE trips > 0
       UNION ALL SELECT city, building_id, lon0, lat0, role, period, trips, s_car, s_walk FROM own2 WHERE trips > 0)
"""

# Ring sides of the notched zones, for a ray test written independently as set logic.
ZONE_CTE = """,
zring AS (SELECT city, ord, zone_id, unnest([x0,x1,x1,xm,x0])/1e7 AS ax, unnest([y0,y0,y1,ym,y1])/1e7 AS ay,
          unnest([x1,x1,xm,x0,x0])/1e7 AS bx, unnest([y0,y1,ym,y1,y0])/1e7 AS by_ FROM zones),
zhit AS (SELECT p.city, p.building_id, z.ord, z.zone_id FROM b0 p JOIN zring z ON z.city = p.city
         WHERE (z.by_ > p.mlat) <> (z.ay > p.mlat) AND p.mlon < (z.ax - z.bx) * (p.mlat - z.by_) / (z.ay - z.by_) + z.bx
         GROUP BY ALL HAVING count(*) % 2 = 1),
bzone AS (SELECT city, building_id, min_by(zone_id, ord) AS zone_id FROM zhit GROUP BY ALL),
ztot AS (SELECT z.city, z.ord, z.zone_id, z.total_population, z.total_employment,
         CAST(COALESCE(sum(b.residents),0) AS BIGINT) AS residents, CAST(COALESCE(sum(b.employees),0) AS BIGINT) AS employees
         FROM zones z LEFT JOIN bzone m ON m.zone_id = z.zone_id LEFT JOIN b0 b ON b.building_id = m.building_id GROUP BY ALL),
zres AS (SELECT *, greatest(0, total_population - residents) AS rp, greatest(0, total_employment - employees) AS re FROM ztot)
"""

ENDS_CTE = EVENTS_CTE + ZONE_CTE + """,
zmean AS (SELECT zone_id, ((x0/1e7 + x1/1e7 + x1/1e7 + xm/1e7 + x0/1e7 + x0/1e7)/6) AS lon,
          ((y0/1e7 + y0/1e7 + y1/1e7 + ym/1e7 + y1/1e7 + y0/1e7)/6) AS lat FROM zones),
zev AS (SELECT r.city, r.zone_id AS id, m.lon, m.lat, v.role, v.period, v.trips FROM zres r JOIN zmean m USING (zone_id), LATERAL (VALUES
        ('origin','AM_Peak', rp*1.8::DOUBLE*0.35::DOUBLE), ('destination','PM_Peak', rp*1.8::DOUBLE*0.4::DOUBLE),
        ('destination','AM_Peak', re*1.2::DOUBLE*0.35::DOUBLE), ('origin','PM_Peak', re*1.2::DOUBLE*0.4::DOUBLE)) v(role,period,trips)),
gev AS (SELECT city, gateway_id AS id, x/1e7 AS lon, y/1e7 AS lat, v.role, v.period, v.trips FROM gateways, LATERAL (VALUES
        ('origin','AM_Peak',in_am),('origin','PM_Peak',in_pm),('origin','Midday',in_mid),('origin','Night',in_night),
        ('destination','AM_Peak',out_am),('destination','PM_Peak',out_pm),('destination','Midday',out_mid),('destination','Night',out_night)) v(role,period,trips)),
ends AS (SELECT city, id, 'building' AS type, lon, lat, role, period, trips, s_car, s_walk FROM events
         UNION ALL SELECT city, id, 'zone', lon, lat, role, period, trips, NULL, NULL FROM zev WHERE trips > 0
         UNION ALL SELECT city, id, 'gateway', lon, lat, role, period, trips, NULL, NULL FROM gev WHERE trips > 0)
"""

_W = f"d.trips / pow(greatest(100.0::DOUBLE, {sql_hav('o.lon', 'o.lat', 'd.lon', 'd.lat')}), 2)"
_MODES_SQL = ", ".join(
    f"('{m}', CASE WHEN s_car IS NULL THEN {v}::DOUBLE ELSE {'s_car' if m == 'car' else 's_walk' if m == 'walking' else '0.0::DOUBLE'} END)"
    for m, v in SPLIT_SQL.items())
MATRIX_CTE = ENDS_CTE + f""",
pairs AS (SELECT o.city, o.period, o.id AS origin_id, o.type AS origin_type, d.id AS destination_id, d.type AS destination_type,
          o.trips AS volume, o.s_car, o.s_walk, {_W} AS w FROM ends o JOIN ends d ON o.city = d.city AND o.period = d.period
          WHERE o.role = 'origin' AND d.role = 'destination' AND o.id <> d.id),
shared AS (SELECT *, w / sum(w) OVER (PARTITION BY city, period, origin_id) AS share FROM pairs),
ptrips AS (SELECT *, CAST(floor(volume * share + 0.5) AS BIGINT) AS pair_trips FROM shared WHERE floor(volume * share + 0.5) > 0),
matrix AS (SELECT p.city, p.period, p.origin_id, p.origin_type, p.destination_id, p.destination_type, v.mode,
           CAST(floor(pair_trips * v.f + 0.5) AS BIGINT) AS trips FROM ptrips p, LATERAL (VALUES {_MODES_SQL}) v(mode, f)
           WHERE floor(pair_trips * v.f + 0.5) > 0)
"""
_IN = cte("buildings", "zones", "gateways")


@query("b16_explicit_buildings", cte("buildings") + EVENTS_CTE + "SELECT city, building_id AS id, category, residents, employees FROM explicit")
def explicit(spark, sf):
    return op.explicit_buildings(parsed_buildings(spark, sf)).select("city", "id", "category", "residents", "employees")


@query("h14_trip_events", cte("buildings") + EVENTS_CTE
       + f"SELECT city, id, role, period, {sql_fixed('trips', 6)} AS trips, {sql_fixed('coalesce(s_car, 0.25::DOUBLE)', 6)} AS car_share FROM events")
def events(spark, sf):
    ev = op.building_trip_events(op.explicit_buildings(parsed_buildings(spark, sf)))
    return ev.select("city", "id", "role", "period", F.expr(fixed("trips", 6)).alias("trips"),
                     F.expr(fixed("split.car", 6)).alias("car_share"))


@query("c03_building_first_zone", _IN + EVENTS_CTE + ZONE_CTE + "SELECT city, building_id AS id, zone_id FROM bzone")
def first_zone(spark, sf):
    b = op.with_mean_point(parsed_buildings(spark, sf).filter(F.size("coordinates") > 0))
    return op.first_zone(b, city.zones(spark, sf))


@query("d01_zone_building_totals", _IN + EVENTS_CTE + ZONE_CTE + "SELECT city, zone_id, residents, employees FROM ztot")
def zone_totals(spark, sf):
    b = parsed_buildings(spark, sf).filter(F.size("coordinates") > 0)
    return op.zone_building_totals(b, city.zones(spark, sf)).select("city", "zone_id", "residents", "employees")


@query("d02_zone_residuals", _IN + EVENTS_CTE + ZONE_CTE
       + "SELECT city, zone_id, CAST(rp AS BIGINT) AS residual_population, CAST(re AS BIGINT) AS residual_employment FROM zres")
def residuals(spark, sf):
    b = parsed_buildings(spark, sf).filter(F.size("coordinates") > 0)
    return op.zone_residuals(op.zone_building_totals(b, city.zones(spark, sf))).select(
        "city", "zone_id", "residual_population", "residual_employment")


@query("d06_demand_totals", _IN + EVENTS_CTE + ZONE_CTE + """SELECT
  (SELECT CAST(sum(residents) AS BIGINT) FROM explicit) AS explicit_population, (SELECT CAST(sum(employees) AS BIGINT) FROM explicit) AS explicit_employment,
  CAST(sum(rp) AS BIGINT) AS residual_population, CAST(sum(re) AS BIGINT) AS residual_employment,
  CAST(sum(total_population) AS BIGINT) AS zone_population, CAST(sum(total_employment) AS BIGINT) AS zone_employment FROM zres""")
def totals(spark, sf):
    b = parsed_buildings(spark, sf)
    z = op.zone_residuals(op.zone_building_totals(b.filter(F.size("coordinates") > 0), city.zones(spark, sf)))
    return op.demand_totals(op.explicit_buildings(b), z)


@query("c25_gravity_pairs", _IN + MATRIX_CTE + "SELECT city, period, origin_id, destination_id, pair_trips FROM ptrips")
def pairs(spark, sf):
    return op.gravity_pairs(demand_inputs(spark, sf)).select("city", "period", "origin_id", "destination_id", "pair_trips")


@query("g15_od_matrix", _IN + MATRIX_CTE + "SELECT * FROM matrix")
def matrix(spark, sf):
    return op.od_matrix(demand_inputs(spark, sf))


@query("d05_od_summary", _IN + MATRIX_CTE + """SELECT period, mode, CAST(sum(trips) AS BIGINT) AS trips,
  CAST(sum(CASE WHEN mode IN ('car','two_wheeler','bus') THEN trips ELSE 0 END) AS BIGINT) AS vehicle_trips
  FROM matrix GROUP BY GROUPING SETS ((period),(mode),())""")
def summary(spark, sf):
    return op.od_summary(op.od_matrix(demand_inputs(spark, sf)))


@query("e03_normalised_weights", _IN + MATRIX_CTE + f"""SELECT city, period, origin_id, count(*) AS pairs, {sql_fixed('sum(share)', 6)} AS share_sum,
  {sql_fixed('max(share)', 6)} AS top_share FROM shared GROUP BY ALL""")
def weights(spark, sf):
    return op.gravity_shares(demand_inputs(spark, sf)).select(
        "city", "period", "origin_id", "pairs", F.expr(fixed("share_sum", 6)).alias("share_sum"),
        F.expr(fixed("top_share", 6)).alias("top_share"))


# ---- study rectangle, top destinations, zone access ------------------------------

def study_boxes(spark, sf):
    return city.derive(spark, sf, "sites").filter("j = 0").selectExpr(
        "city", "(ox + 10000) / 1e7 as min_lon", "(ox + 60000) / 1e7 as max_lon", "(oy + 8000) / 1e7 as min_lat", "(oy + 35000) / 1e7 as max_lat")


_ALL = EVENTS_CTE.replace("""WHERE category IN ('office','retail','commercial') OR employees > 100 OR residents > 150
       OR source = 'manual' OR own OR split_car IS NOT NULL""", "").replace("lon0 AS lon, lat0 AS lat", "mlon AS lon, mlat AS lat").replace("SELECT city, building_id, lon0, lat0, role", "SELECT city, building_id, mlon, mlat, role")
_STUDY_ENDS = cte("buildings", "zones", "gateways", "sites") + _ALL + ZONE_CTE + """,
box AS (SELECT city, ox + 10000 AS bx0, ox + 60000 AS bx1, oy + 8000 AS by0, oy + 35000 AS by1 FROM sites WHERE j = 0),
held AS (SELECT zone_id, CAST(sum(residents) AS BIGINT) AS residents, CAST(sum(employees) AS BIGINT) AS employees FROM zhit JOIN b0 USING (building_id) GROUP BY 1),
zc AS (SELECT z.city, z.zone_id, greatest(x0, bx0) AS cx0, least(x1, bx1) AS cx1, greatest(y0, by0) AS cy0, least(y1, by1) AS cy1, 46000.0::DOUBLE * 46000 - 46000.0::DOUBLE * 9000 / 2 AS full_area, total_population, total_employment FROM zones z JOIN box USING (city)),
zp AS (SELECT zc.*, (cx1 - cx0)::DOUBLE * (cy1 - cy0) / full_area AS part, greatest(0, total_population - coalesce(residents, 0)) AS rp, greatest(0, total_employment - coalesce(employees, 0)) AS re FROM zc LEFT JOIN held USING (zone_id) WHERE cx1 > cx0 AND cy1 > cy0),
ends AS (SELECT e.city, id, lon, lat, role, trips AS volume, s_car FROM events e JOIN box b ON b.city = e.city AND lon BETWEEN bx0 / 1e7 AND bx1 / 1e7 AND lat BETWEEN by0 / 1e7 AND by1 / 1e7 WHERE period = 'AM_Peak'
 UNION ALL SELECT city, zone_id, (cx0 + cx1) / 2 / 1e7, (cy0 + cy1) / 2 / 1e7, v.role, v.f, NULL FROM zp, LATERAL (VALUES ('origin', rp * part * 1.8::DOUBLE * 0.35::DOUBLE), ('destination', re * part * 1.2::DOUBLE * 0.35::DOUBLE)) v(role, f) WHERE v.f > 0),
w AS (SELECT o.city, o.id AS origin_id, d.id AS destination_id, o.volume, o.s_car, d.volume / pow(greatest(100, sqrt(pow((d.lon - o.lon) * 111320.0::DOUBLE * cos(radians(o.lat)), 2) + pow((d.lat - o.lat) * 111320.0::DOUBLE, 2))), 2) AS w
 FROM ends o JOIN ends d ON d.city = o.city AND o.role = 'origin' AND d.role = 'destination' AND o.id <> d.id),
top AS (SELECT *, w / sum(w) OVER (PARTITION BY city, origin_id) AS share FROM (SELECT *, row_number() OVER (PARTITION BY city, origin_id ORDER BY w DESC, destination_id) AS rk FROM w) WHERE rk <= 32)
"""


def study_ends(spark, sf):
    b = parsed_buildings(spark, sf).filter(F.size("coordinates") > 0)
    return materialise(op.study_ends(b, city.zones(spark, sf), gateway_flows(spark, sf), study_boxes(spark, sf), "AM_Peak"), "study_ends")


@query("g16_study_demand", _STUDY_ENDS + f"""SELECT city, origin_id, destination_id, k.kind, {sql_fixed('volume * share * k.f', 6)} AS vph FROM top, LATERAL (VALUES ('car', coalesce(s_car, 0.25::DOUBLE)),
  ('two_wheeler', CASE WHEN s_car IS NULL THEN 0.35::DOUBLE ELSE 0 END), ('bus_auto', CASE WHEN s_car IS NULL THEN 0.2::DOUBLE + 0.02::DOUBLE ELSE 0 END)) k(kind, f) WHERE volume * share * k.f > 0""")
def study_demand(spark, sf):
    return op.study_demand(study_ends(spark, sf)).withColumn("vph", F.expr(fixed("vph", 6)))


_PLW = "d.trips / pow(greatest(100.0::DOUBLE, sqrt(pow((d.lon - o.lon) * 111320.0::DOUBLE * cos(radians(o.lat)), 2) + pow((d.lat - o.lat) * 111320.0::DOUBLE, 2))), 2)"


@query("f04_top_destinations", _IN + ENDS_CTE + f""", w AS (SELECT o.city, o.period, o.id AS origin_id, d.id AS destination_id, {_PLW} AS w FROM ends o JOIN ends d ON o.city = d.city AND o.period = d.period WHERE o.role = 'origin' AND d.role = 'destination' AND o.id <> d.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY city, period, origin_id ORDER BY w DESC, destination_id) AS rk FROM w)
 SELECT city, period, origin_id, count(*) AS destinations, {sql_fixed('min(w) / max(w)', 6)} AS spread FROM r WHERE rk <= 32 GROUP BY ALL""")
def top_destinations(spark, sf):
    best = op.top_destinations(demand_inputs(spark, sf))
    return best.groupBy("city", "period", "origin_id").agg(F.expr("count(1)").alias("destinations"), F.expr(fixed("min(weight) / max(weight)", 6)).alias("spread"))
