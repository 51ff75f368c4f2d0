"""Observed traffic: occupancy, level of service, trips, stops, run comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import js_round

# Level-of-service limits and congestion state limits.
LEVELS = (("A", 0.6), ("B", 0.7), ("C", 0.8), ("D", 0.9), ("E", 1.0), ("F", None))
STATES = (("Severe", 0.8), ("Heavy", 0.4), ("Moderate", 0.1))
STOP_BELOW, MOVING_ABOVE = 0.3, 2.0


def road_peak_occupancy(observations: DataFrame, tick_seconds: int) -> DataFrame:
    """Most vehicles seen on a road in one tick; counted per tick first, then the maximum."""
    seen = observations.selectExpr("road_id", "vehicle_id", f"floor(unix_timestamp(ts) / {tick_seconds}) as tick").distinct()
    return seen.groupBy("road_id", "tick").agg(F.expr("count(1)").alias("n")).groupBy("road_id").agg(F.max("n").alias("peak"))


def level_of_service(ratio: str) -> str:
    return "case " + " ".join(f"when {ratio} <= {limit}D then '{name}'" for name, limit in LEVELS if limit) + " else 'F' end"


def congestion_state(ratio: str) -> str:
    return "case " + " ".join(f"when {ratio} > {limit}D then '{name}'" for name, limit in STATES) + " else 'Free Flow' end"


def road_congestion(roads: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per road: v/c, level, congestion factor and speed; roads never used count as empty."""
    df = roads.join(peaks, "road_id", "left").selectExpr(
        *roads.columns, "coalesce(peak, 0L) as peak", "coalesce(peak, 0L) / (coalesce(nullif(lane_count, 0), 2) * 2) as vc")
    df = df.selectExpr("*", "least(1D, vc) as factor")
    return df.selectExpr("*", f"{level_of_service('vc')} as level", f"{congestion_state('factor')} as state",
                         f"greatest(10L, {js_round('coalesce(nullif(speed_limit, 0D), 50D) * (1 - factor * 0.7D)')}) as speed")


def traffic_summary(congestion: DataFrame) -> DataFrame:
    """One row: mean speed, travel-time index (against 50 km/h) and share of roads per level."""
    shares = [F.expr(f"count_if(level = '{n}') as n_{n}") for n, _ in LEVELS]
    df = congestion.agg(F.expr("count(1)").alias("roads"), F.expr(js_round("avg(speed)")).alias("average_speed"), *shares)
    pct = [f"case when roads > 0 then {js_round(f'n_{n} / roads * 1000')} / 10 else 0D end as pct_{n}" for n, _ in LEVELS]
    return df.selectExpr("roads", "average_speed", "least(2.5D, 1 + (1 - average_speed / 50)) as travel_time_index", *pct)


def trip_metrics(trips: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Figures over completed trips; null where none completed."""
    done = "status = 'completed'"
    return trips.groupBy(*by).agg(
        F.expr(f"count_if({done})").alias("completed"), F.expr("count_if(status = 'under_way')").alias("on_network"),
        F.expr("count_if(status = 'removed')").alias("removed"),
        F.expr(f"avg(travel_s / greatest(free_flow_s, 1)) filter (where {done})").alias("delay_index"),
        F.expr(f"avg(travel_s) filter (where {done})").alias("mean_travel_s"),
        F.expr(f"avg(greatest(0, travel_s - free_flow_s)) filter (where {done})").alias("mean_delay_s"),
        F.expr(f"avg(stops) filter (where {done})").alias("stops_per_trip"))


def segment_speed_ratio(observations: DataFrame) -> DataFrame:
    return observations.groupBy("segment_key").agg(
        F.expr("avg(least(1D, speed_mps / (limit_kmh / 3.6D)))").alias("speed_share"), F.expr("count(1)").alias("n"))


def watched_roads(observations: DataFrame, watched: DataFrame) -> DataFrame:
    """Per watched road: vehicles that ever used it, mean speed, and rate per hour after two minutes."""
    seen = observations.join(watched.select("road_id"), "road_id", "left_semi")
    per_vehicle = seen.groupBy("road_id", "vehicle_id").agg(
        F.sum("speed_mps").alias("s"), F.expr("count(1)").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    df = per_vehicle.groupBy("road_id").agg(F.expr("count(1)").alias("passed"), F.expr("sum(s) / sum(n) * 3.6D").alias("mean_speed_kmh"),
                                            F.expr("unix_timestamp(max(last)) - unix_timestamp(min(first))").alias("span_s"))
    return df.selectExpr("*", f"case when span_s >= 120 then {js_round('passed / (span_s / 3600)')} end as per_hour")


def run_comparison(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Two runs' metrics side by side: delay reduction in percent and whether the aim is met."""
    b = before.select(key, *[F.col(c).alias(f"b_{c}") for c in before.columns if c != key])
    df = b.join(after, key).selectExpr(
        "*", "case when b_mean_delay_s > 0.1 then (b_mean_delay_s - mean_delay_s) / b_mean_delay_s * 100 end as delay_reduction")
    return df.selectExpr(key, "delay_reduction", "b_on_network as unfinished_before", "on_network as unfinished_after",
                         """coalesce(delay_reduction >= 10 and completed >= b_completed and on_network <= b_on_network
                         and removed <= b_removed, false) as objective_met""")


def staleness(runs: DataFrame) -> DataFrame:
    """Why two runs may not be compared (null: they may); the first failing check wins."""
    return runs.selectExpr("*", """case when a_run is null then 'no baseline' when a_demand <> b_demand then 'demand changed'
        when a_study <> b_study then 'study area changed'
        when a_seed <> b_seed or a_level <> b_level or not (a_focus <=> b_focus) then 'settings changed' end as stale_reason""")


def building_trip_estimate(buildings: DataFrame) -> DataFrame:
    """Panel estimate of trips per period; on purpose not the demand model's rates."""
    daily = "case when category = 'residential' then residents * 2.2D else employees * 1.5D end"
    shares = {"am": 0.35, "pm": 0.30, "midday": 0.15, "night": 0.05}
    return buildings.selectExpr("id", *[f"{js_round(f'{daily} * {v}D')} as {k}_trips" for k, v in shares.items()])


def stop_counts(observations: DataFrame) -> DataFrame:
    """Stops per vehicle: falling below 0.3 m/s after having exceeded 2 m/s.

    Days are summarised first (stops inside the day, first and last known state) and
    the short day summaries are then joined up per vehicle, so one vehicle with very
    many rows is spread over its days.
    """
    state = f"case when speed_mps > {MOVING_ABOVE}D then 1 when speed_mps < {STOP_BELOW}D then 0 end"
    df = observations.selectExpr("vehicle_id", "to_date(ts) as day", "ts", "ord", f"{state} as s").filter("s is not null")
    w = W.partitionBy("vehicle_id", "day").orderBy("ts", "ord")
    days = df.withColumn("p", F.lag("s").over(w)).groupBy("vehicle_id", "day").agg(
        F.expr("count_if(s = 0 and p = 1)").alias("inside"), F.expr("min_by(s, struct(ts, ord))").alias("first_s"),
        F.expr("max_by(s, struct(ts, ord))").alias("last_s"))
    before = F.lag("last_s").over(W.partitionBy("vehicle_id").orderBy("day"))
    return days.withColumn("b", before).groupBy("vehicle_id").agg(
        F.expr("sum(inside) + count_if(first_s = 0 and b = 1)").alias("stops"))


def edit_sessions(edits: DataFrame, gap: str = "1 second") -> DataFrame:
    """Bursts of edits to one field of one object, each within ``gap`` of the one before."""
    return edits.groupBy("object_id", "field", F.session_window("ts", gap)).agg(
        F.expr("min_by(before, struct(ts, ord))").alias("before"), F.expr("max_by(after, struct(ts, ord))").alias("after"),
        F.expr("count(1)").alias("edits"), F.min("ts").alias("started")).drop("session_window")


def largest_remainder(shares: DataFrame, key: str, total: int = 100) -> DataFrame:
    """Whole shares per key that sum to ``total``: floors, then the largest remainders get one more."""
    g = W.partitionBy(key)
    df = shares.withColumn("exact", F.expr("case when sum(weight) over (partition by {0}) > 0 then weight / sum(weight) over (partition by {0})"
                                           " else 1D / count(1) over (partition by {0}) end * {1}".format(key, total)))
    df = df.withColumn("whole", F.floor("exact")).withColumn("left_over", F.lit(total) - F.sum("whole").over(g))
    rank = F.row_number().over(g.orderBy(F.expr("exact - whole").desc(), "ord"))
    return df.withColumn("rank", rank).selectExpr(key, "ord", "whole + int(rank <= left_over) as share")


def cumulative_weights(pairs: DataFrame, key: list[str], order: str, chunk: int = 4096) -> DataFrame:
    """Running sum of weights in ``order`` (a whole number), for weighted draws.

    Each stretch of ``chunk`` numbers is summed on its own; the stretches' totals
    give every stretch its start, so one large key is spread over many tasks.
    """
    b = pairs.withColumn("_c", F.expr(f"floor({order} / {chunk})"))
    start = (b.groupBy(*key, "_c").agg(F.sum("weight").alias("t"))
             .withColumn("start", F.sum("t").over(W.partitionBy(*key).orderBy("_c")) - F.col("t")).drop("t"))
    inner = F.sum("weight").over(W.partitionBy(*key, "_c").orderBy(order))
    return b.withColumn("_w", inner).join(start, [*key, "_c"]).withColumn("cumulative", F.col("start") + F.col("_w")).drop("_w", "_c", "start")
