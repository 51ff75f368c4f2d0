"""Order-dependent and iterative operators against plain one-by-one computations."""
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastra.functions import demand as D
from cadastra.functions import geo as G
from cadastra.functions import polygons as P
from cadastra.operators import convert as cv
from cadastra.operators import editing as ed
from cadastra.operators import joining as jo
from cadastra.operators import graph as gr
from cadastra.operators import nearest as ne
from cadastra.operators import network as nw
from cadastra.operators import study as st
from cadastra.operators import tables as tb

LON, LAT = 73.8, 18.5
M = 1 / 111320


def ring(*pts):
    return [(float(x), float(y), 0.0) for x, y in pts]


def one(spark, text, **cols):
    df = spark.range(1).selectExpr(*[f"{v} as {k}" for k, v in cols.items()]) if cols else spark.range(1)
    return df.selectExpr(f"{text} as v").first()["v"]


def pts_sql(points):
    return "array(" + ", ".join(G.pt(f"{x}D", f"{y}D") for x, y in points) + ")"


SQUARE = pts_sql([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)])


@pytest.mark.parametrize("x,y,plain,boundary,strict", [(1, 1, True, True, True), (2, 3, False, False, False), (5, 1, False, False, False),
                                                       (0, 2, None, True, False), (2, 1, None, True, False), (3, 0, None, True, False)])
def test_point_in_concave_ring(spark, x, y, plain, boundary, strict):
    for mode, want in (("plain", plain), ("boundary", boundary), ("strict", strict)):
        if want is not None:
            assert one(spark, P.in_polygon(f"{x}D", f"{y}D", "r", mode), r=SQUARE) is want


def test_self_crossing_ring(spark):
    assert one(spark, P.self_crosses("r"), r=pts_sql([(0, 0), (2, 2), (2, 0), (0, 2)])) is True
    assert one(spark, P.self_crosses("r"), r=SQUARE) is False


def test_flat_ring_centroid_is_vertex_mean(spark):
    c = one(spark, P.centroid("r"), r=pts_sql([(0, 0), (2, 0), (4, 0), (0, 0)]))
    assert (c["lon"], c["lat"]) == (2.0, 0.0)


def test_half_up_rounding_is_towards_plus_infinity(spark):
    assert [one(spark, G.js_round(f"{v}D")) for v in ("2.5", "-2.5", "-0.4")] == [3, -2, 0]


def test_clock_periods(spark):
    got = [one(spark, D.clock_period(f"'{t}'")) for t in ("7:00", "10:59", "11:00", "16:00", "20:59", "21:00", "3:30", "25:00", "soon")]
    assert got == ["AM_Peak", "AM_Peak", "Midday", "PM_Peak", "PM_Peak", "Night", "Night", None, None]


def ends_frame(spark, n=400, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # A few dense clumps chained within the tolerance, and scattered points.
        cx, cy = (LON, LAT) if i % 3 == 0 else (LON + rnd.randrange(40) * 0.0002, LAT)
        rows.append((i % 2, round(cx + rnd.uniform(-1.5e-4, 1.5e-4), 7), round(cy + rnd.uniform(-1.5e-4, 1.5e-4), 7), rnd.choice([0.0, 0.0, 5.0]), rnd.random() < 0.5, i))
    rows += [(r[0], r[1], r[2], r[3], r[4], n + k) for k, r in enumerate(rows[:30])]
    return rows, spark.createDataFrame(rows, "city bigint, lon double, lat double, z double, osm boolean, first bigint")


def test_node_clusters_match_one_by_one(spark):
    rows, df = ends_frame(spark)
    got = {(r["city"], r["lon"], r["lat"], r["z"], r["osm"]): r["node_first"] for r in nw.cluster_nodes(df).collect()}
    nodes, want = {0: [], 1: []}, {}
    key = lambda x, y: (math.floor(x * 1e7 + .5), math.floor(y * 1e7 + .5))
    for city, lon, lat, z, osm, first in rows:
        match = None
        for nlon, nlat, nz, nosm, nfirst in nodes[city]:
            if osm and nosm and key(lon, lat) != key(nlon, nlat):
                continue
            if math.hypot(lon - nlon, lat - nlat) < G.JOIN_TOLERANCE_DEG and abs(z - nz) < 3:
                match = nfirst
                break
        if match is None:
            nodes[city].append((lon, lat, z, osm, first))
            match = first
        want.setdefault((city, lon, lat, z, osm), match)
    assert got == want


def test_junction_folding_matches_one_by_one(spark):
    rnd = random.Random(3)
    nodes = [(i, LON + rnd.uniform(0, 60) * M, LAT + rnd.uniform(0, 60) * M) for i in range(60)]
    pos = {i: (x, y) for i, x, y in nodes}
    edges = []
    for k in range(200):
        a, b = rnd.sample(range(60), 2)
        edges.append((math.hypot(pos[a][0] - pos[b][0], pos[a][1] - pos[b][1]) / M, k, a, b))
    e = spark.createDataFrame(edges, "length double, ord_key bigint, src bigint, dst bigint")
    n = spark.createDataFrame(nodes, "node bigint, lon double, lat double")
    got = {r["node"]: r["root"] for r in ed.fold_junctions(e, n).collect()}
    of, members = {i: i for i in pos}, {i: [i] for i in pos}
    for length, _, a, b in sorted(edges):
        if length >= 12 or of[a] == of[b]:
            continue
        merged = members[of[a]] + members[of[b]]
        xs, ys = [pos[m][0] for m in merged], [pos[m][1] for m in merged]
        span = math.hypot((max(xs) - min(xs)) * 111320 * math.cos(math.radians(ys[0])), (max(ys) - min(ys)) * 111320)
        if span > 30:
            continue
        root, gone = of[a], of[b]
        members[root] = merged
        for m in members.pop(gone):
            of[m] = root
    assert got == of
    assert len(set(of.values())) < 60


def grid(spark, n=8, seed=1):
    rnd = random.Random(seed)
    rows, k = [], 0
    for x in range(n):
        for y in range(n):
            for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1)):
                if 0 <= x + dx < n and 0 <= y + dy < n and rnd.random() < 0.8:
                    rows.append((k, x * n + y, (x + dx) * n + y + dy, round(rnd.uniform(1, 20), 3)))
                    k += 1
    return rows, spark.createDataFrame(rows, "edge_id bigint, src bigint, dst bigint, w double")


def bellman(rows, source, n=64):
    d = {source: 0.0}
    for _ in range(n):
        for _, a, b, w in rows:
            if a in d and d[a] + w < d.get(b, math.inf):
                d[b] = d[a] + w
    return d


def test_shortest_times_match_bellman_ford(spark):
    rows, df = grid(spark)
    seeds = spark.createDataFrame([(0, 0, 0.0), (9, 9, 0.0)], "k bigint, node bigint, d double")
    got = gr.shortest(df, seeds).collect()
    for k in (0, 9):
        want = bellman(rows, k)
        mine = {r["node"]: r["d"] for r in got if r["k"] == k}
        assert mine.keys() == want.keys()
        assert all(abs(mine[n] - want[n]) < 1e-9 for n in want)


def test_edge_loads_follow_fastest_routes(spark):
    rows, df = grid(spark, seed=4)
    trees = gr.route_trees(df, spark.createDataFrame([(0,), (63,)], "node bigint"))
    info = {r["edge_id"]: r for r in df.collect()}
    demand = trees.selectExpr("node as origin", "target", "1D as flow")
    load = {r["edge_id"]: r["load"] for r in st.edge_loads(trees, demand).collect()}
    # Every unit of flow travels its tree cost in total.
    want = sum(r["cost"] for r in trees.collect())
    assert abs(sum(info[e]["w"] * v for e, v in load.items()) - want) < 1e-6


def test_components_of_a_long_chain(spark):
    rows = [(i, i, i + 1, 1.0) for i in range(50) if i != 25]
    df = spark.createDataFrame(rows, "edge_id bigint, src bigint, dst bigint, w double")
    got = {r["node"]: r["component"] for r in gr.connected_components(df).collect()}
    assert got == {n: 0 if n <= 25 else 26 for n in range(51)}


def road(i, *pts, **kw):
    base = {"city": 0, "ord": i, "road_id": f"r{i}", "coordinates": [(LON + x * M, LAT + y * M, float(z)) for x, y, z in pts], "osm": False, "imported": False,
            "layer": None, "lane_count": 2, "one_way": False, "speed_limit": 50.0, "capacity": 2000, "lanes_a": None, "lanes_b": None}
    return {**base, **kw}


SCHEMA = f"city bigint, ord bigint, road_id string, coordinates {G.LINE}, osm boolean, imported boolean, layer int, lane_count bigint, one_way boolean, speed_limit double, capacity bigint, lanes_a bigint, lanes_b bigint"


def network(spark, *roads):
    return nw.build_network(spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.replace("array<struct<lon:double,lat:double,z:double>>", "line").split(", ")) for r in roads], SCHEMA))


def test_t_junction_joins_three_ways(spark):
    net = network(spark, road(0, (-100, 0, 0), (100, 0, 0)), road(1, (0, 0, 0), (0, 100, 0)))
    deg = {r["arms"] for r in nw.node_degrees(net.edges).collect()}
    assert net.edges.count() == 6 and net.nodes.count() == 4 and 3 in deg


def test_bridge_passes_over(spark):
    net = network(spark, road(0, (-100, 0, 0), (100, 0, 0)), road(1, (0, -100, 8), (0, 100, 8)))
    assert net.edges.count() == 4 and net.separations.count() == 1
    assert net.separations.first()["upper_road"] == "r1"


def test_mapped_ways_join_only_at_shared_vertices(spark):
    m = {"osm": True, "imported": True, "layer": 0}
    crossing = network(spark, road(0, (-100, 0, 0), (100, 0, 0), **m), road(1, (0, -100, 0), (0, 100, 0), **m))
    assert crossing.edges.count() == 4 and crossing.crossings.count() == 1
    shared = network(spark, road(0, (-100, 0, 0), (0, 0, 0), (100, 0, 0), **m), road(1, (0, -100, 0), (0, 0, 0), (0, 100, 0), **m))
    assert shared.edges.count() == 8 and shared.crossings.count() == 0


def test_end_within_tolerance_joins_and_farther_is_a_gap(spark):
    near = network(spark, road(0, (-100, 0, 0), (100, 0, 0)), road(1, (0, 4, 0), (0, 100, 0)))
    assert near.edges.count() > 4
    roads = spark.createDataFrame([(0, 0, "a", [(LON - 100 * M, LAT, 0.0), (LON + 100 * M, LAT, 0.0)]), (0, 1, "b", [(LON, LAT + 15 * M, 0.0), (LON, LAT + 100 * M, 0.0)])],
                                  f"city bigint, ord bigint, road_id string, coordinates {G.LINE}")
    gaps = ne.road_end_gaps(roads).collect()
    assert [(g["road_id"], g["which"], g["target"]) for g in gaps] == [("b", "start", "a")] and abs(gaps[0]["gap_m"] - 15) < 0.01
    assert {r["road_id"]: len(r["coordinates"]) for r in jo.connect_road_ends(roads)[0].collect()} == {"a": 3, "b": 3}


def test_concave_clip_gives_two_pieces(spark):
    line = spark.createDataFrame([(0, "l", ring((-1, 3), (5, 3)))], f"city bigint, id string, coordinates {G.LINE}")
    area = spark.createDataFrame([(0, "a", ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)))], f"city bigint, area_id string, boundary {G.LINE}")
    got = sorted((r["piece"], round(r["coordinates"][0]["lon"], 6), round(r["coordinates"][-1]["lon"], 6)) for r in ed.clip_lines(line, area).collect())
    assert got == [(0, 0.0, 0.666667), (1, 3.333333, 4.0)]


def test_duplicate_road_found_and_far_road_not(spark):
    schema = f"city bigint, ord bigint, road_id string, coordinates {G.LINE}"
    built = spark.createDataFrame([(0, 0, "copy", [(LON, LAT + 5 * M, 0.0), (LON + 200 * M, LAT + 5 * M, 0.0)]), (0, 1, "own", [(LON, LAT + 300 * M, 0.0), (LON + 200 * M, LAT + 300 * M, 0.0)])], schema)
    mapped = spark.createDataFrame([(0, 2, "m", [(LON, LAT, 0.0), (LON + 200 * M, LAT, 0.0)])], schema)
    assert [(r["road_id"], r["along"]) for r in ne.duplicate_roads(built, mapped).collect()] == [("copy", "m")]


def test_select_link_prefers_ways_near_the_link(spark):
    src = spark.createDataFrame([(0, 1, 2.0)], "city bigint, entry bigint, rate double")
    snk = spark.createDataFrame([(0, 9, 3.0), (0, 8, 1.0)], "city bigint, exit bigint, sink_weight double")
    link = spark.createDataFrame([(0, 5, 2, 3, 10.0)], "city bigint, link bigint, link_from bigint, link_to bigint, link_time double")
    times = spark.createDataFrame([(2, 1, 10.0), (9, 3, 10.0), (9, 1, 30.0), (8, 3, 50.0), (8, 1, 20.0)], "target bigint, node bigint, cost double")
    got = {r["exit"]: r["weight"] for r in st.select_link_pairs(src, link, snk, times).collect()}
    assert got == {9: pytest.approx(6.0)}


def test_change_feed_update_of_a_deleted_row_does_nothing(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    img = "struct<v:int>"
    feed = spark.createDataFrame([("a", 1, "delete", (1,), None), ("a", 2, "update", (1,), (7,)), ("c", 3, "add", None, (3,)), ("c", 4, "update", (3,), (4,))],
                                 f"id string, seq int, kind string, before {img}, after {img}")
    assert sorted(map(tuple, tb.apply_change_feed(table, feed).collect())) == [("b", 2), ("c", 4)]
    after = tb.apply_change_feed(table, feed)
    assert sorted(map(tuple, tb.apply_change_feed(after, feed, "reverse").collect())) == [("a", 1), ("b", 2)]


def test_base_scenario_cannot_be_deleted(spark):
    df = spark.createDataFrame([("base",)], "scenario_id string")
    with pytest.raises(ValueError):
        tb.delete_scenario(df, df.withColumnRenamed("scenario_id", "id"), "base")


def test_restore_refuses_edited_rows(spark):
    sec = "array<struct<first:double,last:double,lanes:int>>"
    t = spark.createDataFrame([("a", 11, [(0.0, 3.0, 1), (6.0, 10.0, 2)])], f"id string, vertex_count int, sections {sec}")
    backup = ed.repair_plan(t)[0]
    fixed = ed.apply_repair(t, backup)
    assert [tuple(s) for s in fixed.first()["sections"]] == [(0.0, 6.0, 1), (6.0, 10.0, 2)]
    assert ed.restore_sections(fixed, backup).first()["sections"] == t.first()["sections"]
    with pytest.raises(ValueError):
        ed.restore_sections(t.withColumn("sections", F.expr("slice(sections, 1, 1)")), backup)


@pytest.mark.parametrize("tags,want", [({"highway": "footway"}, "other_way"), ({"highway": "track"}, "closed_track"),
                                       ({"highway": "track", "motor_vehicle": "yes"}, None), ({"highway": "service", "access": "no"}, "no_access"),
                                       ({"highway": "service", "access": "no", "motor_vehicle": "destination"}, None), ({}, "untagged"),
                                       ({"highway": "service", "area": "yes"}, "area")])
def test_way_rules(spark, tags, want):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    assert cv.classified_ways(df).first()["reason"] == want


def test_office_trip_events(spark):
    df = spark.sql("select 0 as residents, 200 as employees").selectExpr(f"inline({D.trip_events('named_struct(' + chr(39) + 'dailyTrips' + chr(39) + ', double(null), ' + chr(39) + 'amPeakTrips' + chr(39) + ', double(null), ' + chr(39) + 'pmPeakTrips' + chr(39) + ', double(null))', 'false', chr(39) + 'AM_Peak' + chr(39), chr(39) + 'PM_Peak' + chr(39))})")
    got = {(r["role"], r["period"]): r["trips"] for r in df.filter("trips > 0").collect()}
    assert got == {("destination", "AM_Peak"): pytest.approx(105.0), ("origin", "PM_Peak"): pytest.approx(120.0)}


def test_stuck_vehicle_is_flagged(spark):
    from cadastra.streaming.streams import trip_figures

    for speeds, want in (((9.0, 9.0, 0.1, 0.0), (1, True)), ((9.0, 0.1, 9.0, 0.2), (2, False)), ((1.0, 0.1, 1.0, 1.0), (0, False))):
        at = ", ".join(f"named_struct('ts', timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {s}), 'speed_mps', {v}D)" for s, v in zip((0, 10, 20, 260), speeds))
        got = spark.sql(f"select {trip_figures('array(' + at + ')')} as f").first()["f"]
        assert (got["stops"], got["stuck"]) == want


def test_long_chain_of_road_ends(spark):
    rows = [(0, round(LON + i * 4e-5, 7), LAT, 0.0, False, i) for i in range(80)]
    got = nw.cluster_nodes(spark.createDataFrame(rows, "city bigint, lon double, lat double, z double, osm boolean, first bigint")).collect()
    nodes = []
    for row in rows:
        if not any(abs(row[1] - n) < G.JOIN_TOLERANCE_DEG for n in nodes):
            nodes.append(row[1])
    assert len({r["node_id"] for r in got}) == len(nodes)


@pytest.mark.parametrize("files", [1, 20])
def test_stream_loses_no_row_with_many_files(spark, files):
    from cadastra.plans import stream_queries as sq
    from cadastra.streaming import streams as sm

    rows = spark.range(400).selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 7 * id, 0) as ts", "id % 9 as vehicle_id", "concat('r', id % 3) as road_id", "2L as lanes")
    stream, late = sq._stream(spark, rows.repartition(40, "ts"), files=files * 2)
    out = sq._finish(spark, sm.stream_road_occupancy(stream, "1 hour", late)).filter("road_id <> 'closing'")
    want = rows.groupBy(F.window("ts", "1 hour").start.alias("window_start"), "road_id").agg(F.countDistinct("vehicle_id").alias("vehicles"))
    assert sorted(map(tuple, out.select("window_start", "road_id", "vehicles").collect())) == sorted(map(tuple, want.collect()))

