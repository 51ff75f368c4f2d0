"""Streaming operators run to completion over the whole event table.

The derived observations are written as files to the shared folder and read back as a
stream; the finished output is returned as a table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import fixed
from ..session import materialise, scratch_path, stream_partitions
from ..sources import citydata as city
from ..sources.citydata import cte, sql_fixed
from ..streaming import streams as sm
from .object_queries import _STORE, base_objects
from .registry import query

# A closing row far in the future moves the watermark past every real window.
_CLOSE = "timestamp'2100-01-01 00:00:00'"


#: Spans of time a replayed table is cut into.
SPANS = 4


def _stream(spark, df, order: str = "ts", files: int = 64, close: bool = True):
    """``df`` as a stream of files in order of time, and how late its rows can be.

    The table is written span by span, and files are read in the order they were written, so
    a row is late by the length of a span at most and results leave as the stream goes on.
    A last file closes all windows, unless ``close`` is off. A real source's lateness would be its own.
    """
    path = scratch_path(spark, "stream-in")
    df = materialise(df, "replay")
    first, seconds = df.agg(F.min(order), F.expr(f"coalesce(timestampdiff(second, min({order}), max({order})), 0) + 1")).first()
    length = -(-seconds // SPANS)
    at = f"least({SPANS - 1}L, timestampdiff(second, timestamp'{first}', {order}) div {length})"
    for span in range(SPANS):
        df.filter(f"{at} = {span}").write.parquet(f"{path}/part={span}")
    tail = df.limit(1).withColumn(order, F.expr(_CLOSE))
    for c, t in df.dtypes:
        if c in ("vehicle_id", "change_id"):
            tail = tail.withColumn(c, F.lit(-1).cast(t))
        elif c in ("road_id", "segment_key", "object_id"):
            tail = tail.withColumn(c, F.lit("closing"))
    if close:
        tail.write.parquet(f"{path}/part={SPANS}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*"), f"{length} seconds"


def _finish(spark, out, mode: str = "append"):
    """Run a streaming plan until its input is used up and return what it wrote."""
    sink, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    with stream_partitions(spark):
        q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(sink)
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)


def observations(spark, sf):
    return city.derive(spark, sf, "observations").select("ts", "vehicle_id", "road_id", "segment_key", "speed_mps", "limit_kmh", "lanes")


@query("s01_stream_road_occupancy", cte("observations") + """, o AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, road_id, count(DISTINCT vehicle_id) AS vehicles, max(lanes) AS lanes FROM observations GROUP BY ALL)
 SELECT window_start, road_id, vehicles, CASE WHEN vehicles / (lanes * 1.5::DOUBLE) > 0.8::DOUBLE THEN 'Severe' WHEN vehicles / (lanes * 1.5::DOUBLE) > 0.4::DOUBLE THEN 'Heavy' WHEN vehicles / (lanes * 1.5::DOUBLE) > 0.1::DOUBLE THEN 'Moderate' ELSE 'Free Flow' END AS state FROM o""")
def occupancy(spark, sf):
    rows, late = _stream(spark, observations(spark, sf))
    out = sm.stream_road_occupancy(rows, "1 hour", late)
    return _finish(spark, out).filter("road_id <> 'closing'")


@query("s02_stream_segment_speed", cte("observations") + f""", w AS (SELECT *, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS window_start FROM observations)
 SELECT window_start, segment_key, {sql_fixed('avg(least(1, speed_mps / (limit_kmh / 3.6::DOUBLE)))', 8)} AS speed_share, count(*) AS n FROM w GROUP BY ALL""")
def segment_speed(spark, sf):
    rows, late = _stream(spark, observations(spark, sf))
    out = sm.stream_segment_speed(rows, "6 hours", "3 hours", late)
    return _finish(spark, out).filter("segment_key <> 'closing'").withColumn("speed_share", F.expr(fixed("speed_share", 8)))


_TRIPS = """, o AS (SELECT vehicle_id, ts, ord, speed_mps, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM observations WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts, ord)),
 t AS (SELECT *, sum(fresh) OVER (PARTITION BY vehicle_id ORDER BY ts, ord) AS trip FROM o), s AS (SELECT *, CASE WHEN speed_mps > 2 THEN 1 WHEN speed_mps < 0.3 THEN 0 END AS st FROM t),
 k AS (SELECT vehicle_id, trip, st, lag(st) OVER (PARTITION BY vehicle_id, trip ORDER BY ts, ord) AS b FROM s WHERE st IS NOT NULL), n AS (SELECT vehicle_id, trip, count(*) FILTER (st = 0 AND b = 1) AS stops FROM k GROUP BY ALL)
"""


@query("s03_stream_trip_completion", cte("observations") + _TRIPS + """ SELECT t.vehicle_id, CAST(floor(epoch(min(t.ts))) AS BIGINT) AS depart_s, count(*) > 0 AS done, CAST(coalesce(max(n.stops), 0) AS BIGINT) AS stops FROM t LEFT JOIN n USING (vehicle_id, trip) GROUP BY t.vehicle_id, t.trip""")
def trip_completion(spark, sf):
    rows, late = _stream(spark, observations(spark, sf))
    out = sm.stream_trip_completion(rows, gap_s=6 * 3600.0, late=late)
    return _finish(spark, out).filter("vehicle_id >= 0").selectExpr("vehicle_id", "unix_timestamp(depart_ts) as depart_s", "arrive_ts is not null as done", "stops")


@query("s04_stream_edit_sessions", """WITH e AS (SELECT event_type AS object_id, concat('f', CAST(user_id % 7 AS VARCHAR)) AS field, ts, event_id AS ord FROM events),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY object_id, field ORDER BY ts, ord)),
 h AS (SELECT *, sum(fresh) OVER (PARTITION BY object_id, field ORDER BY ts, ord) AS grp FROM g) SELECT object_id, field, min(ts) AS started, count(*) AS edits FROM h GROUP BY object_id, field, grp""")
def edit_sessions(spark, sf):
    e = city.table(spark, sf, "events").selectExpr("event_type as object_id", "concat('f', user_id % 7) as field", "ts", "value as after", "value - 1 as before")
    rows, late = _stream(spark, e)
    out = sm.stream_edit_sessions(rows, "20 minutes", late)
    return _finish(spark, out).filter("object_id <> 'closing'").select("object_id", "field", "started", "edits")


@query("s05_stream_apply_changes", cte("buildings", "roads", "zones", "proposals") + f""", {_STORE}, b AS (SELECT id, type, population, updated_at, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, ord DESC) AS rn FROM proposals)
 SELECT COALESCE(x.id, p.id) AS id, COALESCE(p.type, x.type) AS type, CASE WHEN p.id IS NULL THEN x.population ELSE p.population END AS population, COALESCE(p.updated_at, TIMESTAMP '1990-01-01') AS updated_at
 FROM base x FULL JOIN (SELECT * FROM b WHERE rn = 1) p ON p.id = x.id""")
def apply_changes(spark, sf):
    table, state = scratch_path(spark, "objects"), scratch_path(spark, "stream-state")
    base = "timestamp'1990-01-01 00:00:00'"
    base_objects(spark, sf).selectExpr("*", "-1L as seq", f"{base} as created_at", f"{base} as updated_at").write.parquet(f"{table}/v0")
    changes = city.derive(spark, sf, "proposals").selectExpr("ord as change_id", "id", "type", "population", "ord as seq", "updated_at as created_at", "updated_at")
    # The same changes arrive twice; each must count once.
    path = scratch_path(spark, "changes")
    changes.unionByName(changes).write.parquet(path)
    # No state is kept between batches, so the shuffles of a merge stay as many as for any other table.
    sm.stream_apply_changes(spark.readStream.schema(changes.schema).parquet(path), table, state, order=("updated_at", "seq")).awaitTermination()
    return spark.read.parquet(f"{table}/v{sm.newest_version(spark, table)}").select("id", "type", "population", "updated_at")
