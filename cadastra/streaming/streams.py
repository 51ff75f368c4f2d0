"""Structured Streaming forms of the live figures, with watermarks for late rows.

Observations carry ``ts``, ``vehicle_id``, ``road_id``, ``segment_key``, ``speed_mps``,
``limit_kmh`` and ``lanes``. Every function takes and returns a streaming DataFrame
unless it starts a query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observe import MOVING_ABOVE, STOP_BELOW, congestion_state
from ..operators.tables import upsert

# Fixed value: a vehicle standing longer than this counts as stuck.
STUCK_SECONDS = 180


def stream_road_occupancy(observations: DataFrame, window: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Vehicles per road and window with the congestion state.

    Exact distinct counts are not allowed on streams, so a vehicle's rows are first
    reduced to one per window and road, which keeps the count exact.
    """
    once = (observations.withWatermark("ts", late).withColumn("w", F.window("ts", window))
            .groupBy("w", "road_id", "vehicle_id").agg(F.max("lanes").alias("lanes")))
    per = once.groupBy(F.window(F.window_time("w"), window).alias("w2"), "road_id").agg(
        F.expr("count(1)").alias("vehicles"), F.max("lanes").alias("lanes"))
    return per.selectExpr("w2.start as window_start", "road_id", "vehicles", f"{congestion_state('vehicles / (coalesce(nullif(lanes, 0), 2) * 1.5D)')} as state")


def stream_segment_speed(observations: DataFrame, window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Mean share of the speed limit per stretch over sliding windows."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "segment_key").agg(
        F.expr("avg(least(1D, speed_mps / (limit_kmh / 3.6D)))").alias("speed_share"), F.expr("count(1)").alias("n")).selectExpr(
        "window.start as window_start", "segment_key", "speed_share", "n")


def stream_edit_sessions(edits: DataFrame, gap: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Bursts of edits to one field of one object become one edit."""
    return edits.withWatermark("ts", late).groupBy("object_id", "field", F.session_window("ts", gap)).agg(
        F.expr("min_by(before, ts)").alias("before"), F.expr("max_by(after, ts)").alias("after"), F.expr("count(1)").alias("edits")).selectExpr(
        "object_id", "field", "session_window.start as started", "before", "after", "edits")


def trip_figures(trace: str = "trace") -> str:
    """Stops and whether the vehicle got stuck, from a trip's (ts, speed_mps) in time order, as SQL text.

    A stop is falling below 0.3 m/s after having exceeded 2 m/s; a vehicle is stuck when it
    stays below 0.3 m/s for longer than the limit.
    """
    start = "named_struct('stops', 0L, 'moving', false, 'still', cast(null as timestamp), 'stuck', false)"
    slow = f"x.speed_mps < {STOP_BELOW}D"
    step = (f"named_struct('stops', s.stops + if({slow} and s.moving, 1, 0), 'moving', coalesce(if({slow}, false, s.moving or x.speed_mps > {MOVING_ABOVE}D), s.moving),"
            f" 'still', if({slow}, coalesce(s.still, x.ts), null), 'stuck', s.stuck or coalesce({slow} and timestampdiff(second, s.still, x.ts) > {STUCK_SECONDS}, false))")
    return f"aggregate({trace}, {start}, (s, x) -> {step})"


def stream_trip_completion(observations: DataFrame, gap_s: float = 600.0, late: str = "5 minutes") -> DataFrame:
    """Finished trips per vehicle: start, end, stops. A trip ends when nothing came for ``gap_s``.

    A trip is a session window. Its observations are put in order of time when it closes,
    so they may arrive in any order within ``late``.
    """
    trips = observations.select("vehicle_id", "ts", "speed_mps").withWatermark("ts", late).groupBy("vehicle_id", F.session_window("ts", f"{int(gap_s)} seconds")).agg(
        F.min("ts").alias("depart_ts"), F.max("ts").alias("arrive_ts"), F.array_sort(F.collect_list(F.struct("ts", "speed_mps"))).alias("trace"))
    return trips.selectExpr("vehicle_id", "depart_ts", "arrive_ts", f"{trip_figures()} as f", "timestampdiff(microsecond, depart_ts, arrive_ts) / 1e6D as travel_s").selectExpr(
        "vehicle_id", "depart_ts", "arrive_ts", "travel_s", "f.stops as stops", "f.stuck as stuck")


def newest_version(spark: SparkSession, table_path: str) -> int:
    """Number of the newest version below ``table_path``."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(table_path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return max(int(f.getPath().getName()[1:]) for f in found if f.getPath().getName()[1:].isdigit())


def stream_apply_changes(changes: DataFrame, table_path: str, checkpoint: str, order: Sequence[str] = ("updated_at",)):
    """Upsert a change stream into the object table at ``table_path``; the newest change of a row, by ``order``, wins.

    The table is a folder of versions: batch n reads version n and writes n + 1, so
    repeating a batch after a failure gives the same result. A change counts only if it is
    not older than the row it meets, so repeated and late changes in any batch do no harm.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            table = spark.read.parquet(f"{table_path}/v{number}")
        except Exception as missing:  # the folder was never seeded
            raise ValueError(f"no table version v{number} below {table_path}") from missing
        upsert(table, batch.drop("change_id"), ["id"], order, keep_newer=True).write.mode("overwrite").parquet(f"{table_path}/v{number + 1}")
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
