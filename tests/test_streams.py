"""Replayed streams give results as they go on, not only when the last file closes them."""

import datetime

from cadastra.plans import stream_queries as sq
from cadastra.streaming import streams as sm

START = datetime.datetime(2024, 1, 1)


def test_windows_leave_before_the_stream_ends(spark):
    rows = [(START + datetime.timedelta(minutes=(7919 * i) % 4800), i % 9, f"r{i % 4}", f"r{i % 4}_0", float(i % 20), 50.0, 2) for i in range(3000)]
    table = spark.createDataFrame(rows, "ts timestamp, vehicle_id bigint, road_id string, segment_key string, speed_mps double, limit_kmh double, lanes bigint")
    windows = {(r.ts.replace(minute=0), r.road_id) for r in table.select("ts", "road_id").collect()}
    counts = {}
    for close in (False, True):
        stream, late = sq._stream(spark, table, files=1, close=close)
        out = sq._finish(spark, sm.stream_road_occupancy(stream, "1 hour", late)).filter("road_id <> 'closing'")
        counts[close] = out.count()
    assert counts[True] == len(windows) and 0.4 * len(windows) < counts[False] < len(windows)
