"""Observed traffic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import fixed
from ..operators import observe as ob
from ..sources import citydata as city
from ..sources.citydata import cte, sql_fixed
from .registry import query

_O = cte("observations", "roads")
_PEAK = """, peaks AS (SELECT road_id, max(n) AS peak FROM (SELECT road_id, floor(epoch(ts) / 21600) AS tick, count(DISTINCT vehicle_id) AS n FROM observations GROUP BY ALL) GROUP BY road_id),
 cong AS (SELECT *, least(1, vc) AS factor, CASE WHEN vc <= 0.6::DOUBLE THEN 'A' WHEN vc <= 0.7::DOUBLE THEN 'B' WHEN vc <= 0.8::DOUBLE THEN 'C' WHEN vc <= 0.9::DOUBLE THEN 'D' WHEN vc <= 1 THEN 'E' ELSE 'F' END AS level,
  greatest(10, CAST(floor(speed_limit * (1 - least(1, vc) * 0.7::DOUBLE) + 0.5) AS BIGINT)) AS speed FROM (
  SELECT r.road_id, r.lane_count, r.speed_limit, coalesce(p.peak, 0) AS peak, coalesce(p.peak, 0) / (r.lane_count * 2) AS vc FROM roads r LEFT JOIN peaks p USING (road_id)))"""


def observations(spark, sf):
    return city.derive(spark, sf, "observations")


def congestion(spark, sf):
    roads = city.derive(spark, sf, "roads").select("road_id", "lane_count", "speed_limit")
    return ob.road_congestion(roads, ob.road_peak_occupancy(observations(spark, sf), 21600))


@query("d16_road_peak_occupancy", _O + _PEAK + "SELECT road_id, peak FROM peaks")
def peak(spark, sf):
    return ob.road_peak_occupancy(observations(spark, sf), 21600)


@query("d17_level_of_service", _O + _PEAK + """SELECT level, count(*) AS roads, floor(count(*) / (SELECT count(*) FROM roads) * 1000 + 0.5) / 10 AS pct FROM cong GROUP BY level""")
def los(spark, sf):
    df = congestion(spark, sf).groupBy("level").agg(F.expr("count(1)").alias("roads"))
    total = city.derive(spark, sf, "roads").agg(F.expr("count(1)").alias("total"))
    return df.join(F.broadcast(total), F.lit(True)).selectExpr("level", "roads", "floor(roads / total * 1000 + 0.5D) / 10 as pct")


@query("d18_road_congestion", _O + _PEAK + f"SELECT road_id, peak, {sql_fixed('factor', 4)} AS factor, level, speed FROM cong")
def road_congestion(spark, sf):
    return congestion(spark, sf).selectExpr("road_id", "peak", f"{fixed('factor', 4)} as factor", "level", "speed")


@query("d18_traffic_summary", _O + _PEAK + f"""SELECT roads, s AS average_speed, {sql_fixed('least(2.5::DOUBLE, 1 + (1 - s / 50))', 4)} AS travel_time_index, pct_A, pct_B, pct_C, pct_D, pct_E, pct_F FROM (
  SELECT count(*) AS roads, CAST(floor(avg(speed) + 0.5) AS BIGINT) AS s, {", ".join(f"floor(count(*) FILTER (level = '{v}') / count(*) * 1000 + 0.5) / 10 AS pct_{v}" for v in "ABCDEF")} FROM cong)""")
def summary(spark, sf):
    return ob.traffic_summary(congestion(spark, sf)).selectExpr("roads", "average_speed", f"{fixed('travel_time_index', 4)} as travel_time_index", *(f"pct_{v}" for v in "ABCDEF"))


@query("d19_congestion_state", _O + _PEAK + """SELECT CASE WHEN factor > 0.8::DOUBLE THEN 'Severe' WHEN factor > 0.4::DOUBLE THEN 'Heavy' WHEN factor > 0.1::DOUBLE THEN 'Moderate' ELSE 'Free Flow' END AS state,
  count(*) AS roads FROM cong GROUP BY 1""")
def state(spark, sf):
    return congestion(spark, sf).groupBy("state").agg(F.expr("count(1)").alias("roads"))


_TM = """count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'under_way') AS on_network, count(*) FILTER (status = 'removed') AS removed,
  avg(travel_s / greatest(free_flow_s, 1)) FILTER (status = 'completed') AS delay_index, avg(travel_s) FILTER (status = 'completed') AS mean_travel_s,
  avg(greatest(0, travel_s - free_flow_s)) FILTER (status = 'completed') AS mean_delay_s, avg(stops) FILTER (status = 'completed') AS stops_per_trip"""


@query("d20_trip_metrics", cte("trips") + f"""SELECT line, completed, on_network, removed, {sql_fixed('delay_index', 4)} AS delay_index, {sql_fixed('mean_travel_s', 3)} AS mean_travel_s,
  {sql_fixed('mean_delay_s', 3)} AS mean_delay_s, {sql_fixed('stops_per_trip', 4)} AS stops_per_trip FROM (SELECT l_linenumber AS line, {_TM} FROM trips GROUP BY 1)""")
def trips(spark, sf):
    df = city.derive(spark, sf, "trips").withColumnRenamed("l_linenumber", "line")
    return ob.trip_metrics(df, ("line",)).selectExpr("line", "completed", "on_network", "removed", f"{fixed('delay_index', 4)} as delay_index",
                                                     *[f"{fixed(c, d)} as {c}" for c, d in (("mean_travel_s", 3), ("mean_delay_s", 3), ("stops_per_trip", 4))])


@query("d21_segment_speed_ratio", _O + f"SELECT segment_key, {sql_fixed('avg(least(1, speed_mps / (limit_kmh / 3.6::DOUBLE)))', 8)} AS speed_share, count(*) AS n FROM observations GROUP BY 1")
def speed_ratio(spark, sf):
    return ob.segment_speed_ratio(observations(spark, sf)).selectExpr("segment_key", f"{fixed('speed_share', 8)} as speed_share", "n")


@query("d22_watched_roads", _O + f""", w AS (SELECT road_id, count(DISTINCT vehicle_id) AS passed, {sql_fixed('avg(speed_mps) * 3.6::DOUBLE', 8)} AS mean_speed_kmh,
  floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS span_s FROM observations WHERE road_id IN (SELECT road_id FROM roads WHERE road_class = 'highway') GROUP BY 1)
 SELECT road_id, passed, mean_speed_kmh, CASE WHEN span_s >= 120 THEN CAST(floor(passed / (span_s / 3600) + 0.5) AS BIGINT) END AS per_hour FROM w""")
def watched(spark, sf):
    roads = city.derive(spark, sf, "roads").filter("road_class = 'highway'")
    return ob.watched_roads(observations(spark, sf), roads).selectExpr("road_id", "passed", f"{fixed('mean_speed_kmh', 8)} as mean_speed_kmh", "per_hour")


_RUNS = cte("trips") + f""", a AS (SELECT l_linenumber AS line, {_TM} FROM trips WHERE l_returnflag <> 'A' GROUP BY 1), b AS (SELECT l_linenumber AS line, {_TM} FROM trips WHERE l_returnflag <> 'N' GROUP BY 1),
 c AS (SELECT a.line, CASE WHEN a.mean_delay_s > 0.1 THEN (a.mean_delay_s - b.mean_delay_s) / a.mean_delay_s * 100 END AS red, a.on_network AS ub, b.on_network AS ua,
  b.completed >= a.completed AND b.on_network <= a.on_network AND b.removed <= a.removed AS rest FROM a JOIN b USING (line))"""


@query("d23_run_comparison", _RUNS + f"SELECT line, {sql_fixed('red', 4)} AS delay_reduction, ub AS unfinished_before, ua AS unfinished_after, coalesce(red >= 10 AND rest, false) AS objective_met FROM c")
def comparison(spark, sf):
    t = city.derive(spark, sf, "trips").withColumnRenamed("l_linenumber", "line")
    a, b = (ob.trip_metrics(t.filter(f"l_returnflag <> '{x}'"), ("line",)) for x in "AN")
    return ob.run_comparison(a, b, "line").withColumn("delay_reduction", F.expr(fixed("delay_reduction", 4)))


@query("d24_staleness_check", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'no baseline' WHEN o_orderkey % 5 = 0 THEN 'demand changed' WHEN o_orderkey % 7 = 0 THEN 'study area changed'
  WHEN o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 THEN 'settings changed' END AS stale_reason FROM orders""")
def stale(spark, sf):
    runs = city.table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 11 <> 0 then 1 end as a_run", "'k' as a_demand", "case when o_orderkey % 5 = 0 then 'x' else 'k' end as b_demand",
        "'s' as a_study", "case when o_orderkey % 7 = 0 then 'x' else 's' end as b_study", "1 as a_seed", "case when o_orderkey % 3 = 0 then 2 else 1 end as b_seed",
        "2 as a_level", "2 as b_level", "cast(null as string) as a_focus", "case when o_orderkey % 4 = 0 then 'f' end as b_focus")
    return ob.staleness(runs).select("id", "stale_reason")


@query("d27_building_trip_estimate", cte("buildings") + """SELECT building_id AS id, CAST(floor(d * 0.35::DOUBLE + 0.5) AS BIGINT) AS am_trips, CAST(floor(d * 0.3::DOUBLE + 0.5) AS BIGINT) AS pm_trips,
  CAST(floor(d * 0.15::DOUBLE + 0.5) AS BIGINT) AS midday_trips, CAST(floor(d * 0.05::DOUBLE + 0.5) AS BIGINT) AS night_trips FROM (
  SELECT *, CASE WHEN category = 'residential' THEN residents * 2.2::DOUBLE ELSE employees * 1.5::DOUBLE END AS d FROM buildings)""")
def estimate(spark, sf):
    return ob.building_trip_estimate(city.derive(spark, sf, "buildings").withColumnRenamed("building_id", "id"))


@query("e07_stop_counts", _O + """, s AS (SELECT vehicle_id, ts, ord, CASE WHEN speed_mps > 2 THEN 1 WHEN speed_mps < 0.3 THEN 0 END AS st FROM observations),
 p AS (SELECT vehicle_id, st, lag(st) OVER (PARTITION BY vehicle_id ORDER BY ts, ord) AS b FROM s WHERE st IS NOT NULL)
 SELECT vehicle_id, count(*) FILTER (st = 0 AND b = 1) AS stops FROM p GROUP BY 1""")
def stops(spark, sf):
    return ob.stop_counts(observations(spark, sf))


_EDITS = """WITH e AS (SELECT event_type AS object_id, concat('f', CAST(user_id % 7 AS VARCHAR)) AS field, ts, event_id AS ord, value AS after_v, value - 1 AS before_v FROM events),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY object_id, field ORDER BY ts, ord)),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY object_id, field ORDER BY ts, ord) AS grp FROM g)"""


@query("e10_edit_sessions", _EDITS + f"""SELECT object_id, field, {sql_fixed('arg_min(before_v, (ts, ord))', 2)} AS before_value, {sql_fixed('arg_max(after_v, (ts, ord))', 2)} AS after_value, count(*) AS edits, min(ts) AS started FROM h GROUP BY object_id, field, grp""")
def edit_sessions(spark, sf):
    e = city.table(spark, sf, "events").selectExpr("event_type as object_id", "concat('f', user_id % 7) as field", "ts", "event_id as ord", "value as after", "value - 1 as before")
    return ob.edit_sessions(e, "20 minutes").selectExpr("object_id", "field", f"{fixed('before', 2)} as before_value", f"{fixed('after', 2)} as after_value", "edits", "started")


@query("e04_largest_remainder", """WITH s AS (SELECT o_custkey AS k, o_orderkey AS ord, CAST(floor(o_totalprice / 1000) AS BIGINT) AS w FROM orders),
 x AS (SELECT *, CASE WHEN sum(w) OVER p > 0 THEN w::DOUBLE / sum(w) OVER p ELSE 1.0::DOUBLE / count(*) OVER p END * 100 AS exact FROM s WINDOW p AS (PARTITION BY k)),
 y AS (SELECT *, floor(exact) AS whole, row_number() OVER (PARTITION BY k ORDER BY exact - floor(exact) DESC, ord) AS rk, 100 - sum(floor(exact)) OVER (PARTITION BY k) AS rest FROM x)
 SELECT k, ord, CAST(whole + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM y""")
def remainder(spark, sf):
    s = city.table(spark, sf, "orders").selectExpr("o_custkey as k", "o_orderkey as ord", "double(floor(o_totalprice / 1000)) as weight")
    return ob.largest_remainder(s, "k")


@query("e08_cumulative_weights", """SELECT o_orderpriority AS grp, o_orderkey AS ord, CAST(floor(o_totalprice / 1000) AS BIGINT) AS weight,
  CAST(sum(CAST(floor(o_totalprice / 1000) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS cumulative FROM orders""")
def cumulative(spark, sf):
    p = city.table(spark, sf, "orders").selectExpr("o_orderpriority as grp", "o_orderkey as ord", "floor(o_totalprice / 1000) as weight")
    return ob.cumulative_weights(p, ["grp"], "ord")
