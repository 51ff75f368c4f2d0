"""Roads joined at their loose ends, on small layouts and against joining one by one."""

import math
import random

import pytest

from cadastra.operators import joining as jo
from cadastra.operators import nearest as ne

LON, LAT = 73.8, 18.5
M = 1 / 111320
MX = M / math.cos(math.radians(LAT))
SCHEMA = ("city bigint, ord bigint, road_id string, coordinates array<struct<lon:double,lat:double,z:double>>, "
          "sections array<struct<first:double,last:double,lanes:int>>")


def table(spark, layout, sections=None):
    rows = [(0, i, name, [(LON + x * MX, LAT + y * M, float(z)) for x, y, z in line], (sections or {}).get(name)) for i, (name, line) in enumerate(layout)]
    return spark.createDataFrame(rows, SCHEMA)


def lines(df):
    return {r.road_id: [(round((p.lon - LON) / MX, 2), round((p.lat - LAT) / M, 2), round(p.z, 2)) for p in r.coordinates] for r in df.collect()}


FLAT = ("a", [(-100, 0, 0), (100, 0, 0)])


def test_gap_gets_a_shared_vertex_at_the_targets_height(spark):
    roads = table(spark, [("a", [(-100, 0, 2), (100, 0, 4)]), ("b", [(0, 15, 3), (0, 100, 3)])])
    joined, made = jo.connect_road_ends(roads)
    got = lines(joined)
    assert got == {"a": [(-100, 0, 2), (0, 0, 3), (100, 0, 4)], "b": [(0, 0, 3), (0, 15, 3), (0, 100, 3)]}
    both = {r.road_id: {(p.lon, p.lat, p.z) for p in r.coordinates} for r in joined.collect()}
    assert len(both["a"] & both["b"]) == 1  # the same numbers to the last digit
    assert [(r.road_id, r.which, r.target, r.fresh) for r in made.collect()] == [("b", "start", "a", True)]


def test_other_height_or_too_far_is_no_gap(spark):
    roads = table(spark, [FLAT, ("b", [(0, 15, 4), (0, 100, 4)]), ("c", [(50, 26, 0), (50, 100, 0)])])
    assert lines(jo.connect_road_ends(roads)[0]) == lines(roads)


def test_end_on_a_deck_is_not_loose(spark):
    roads = table(spark, [FLAT, ("b", [(0, 15, 0), (0, 100, 0)])])
    deck = table(spark, [("deck", [(-50, 15, 0), (50, 15, 0)])])
    assert jo.connect_road_ends(roads, deck)[1].count() == 0
    assert jo.connect_road_ends(roads)[1].count() == 1


def test_vertex_in_reach_is_reused(spark):
    roads = table(spark, [("a", [(-100, 0, 0), (0.6, 0, 0), (100, 0, 0)]), ("b", [(0, 15, 0), (0, 100, 0)])])
    got = lines(jo.connect_road_ends(roads)[0])
    assert len(got["a"]) == 3 and got["b"][0] == (0.6, 0, 0)


def test_near_spots_become_one_and_order_follows_the_piece(spark):
    roads = table(spark, [FLAT, ("b", [(30, 10, 0), (30, 100, 0)]), ("c", [(30.5, -12, 0), (30.5, -100, 0)]), ("d", [(-40, 9, 0), (-40, 100, 0)])])
    got = lines(jo.connect_road_ends(roads)[0])
    assert got["a"] == [(-100, 0, 0), (-40, 0, 0), (30, 0, 0), (100, 0, 0)]
    assert got["b"][0] == got["c"][0] == (30, 0, 0)


def test_only_one_of_two_facing_ends_runs_over(spark):
    roads = table(spark, [("a", [(-100, 0, 0), (0, 0, 0)]), ("b", [(12, 0, 0), (100, 0, 0)])])
    assert lines(jo.connect_road_ends(roads)[0]) == {"a": [(-100, 0, 0), (0, 0, 0), (12, 0, 0)], "b": [(12, 0, 0), (100, 0, 0)]}


def test_sections_keep_their_stretches(spark):
    sections = {"a": [(0.0, 1.0, 2), (1.0, 2.0, 3)], "b": [(0.0, 1.0, 1)]}
    roads = table(spark, [("a", [(-100, 0, 0), (0, 0, 0), (100, 0, 0)]), ("b", [(50, 15, 0), (50, 100, 0)]), ("c", [(-60, 8, 0), (-60, 100, 0)]), ("d", [(-30, 7, 0), (-30, 100, 0)])], sections)
    got = {r.road_id: [tuple(s) for s in r.sections or []] for r in jo.connect_road_ends(roads)[0].collect()}
    assert got["a"] == [(0.0, 3.0, 2), (3.0, 5.0, 3)] and got["b"] == [(0.0, 2.0, 1)]


def test_carried_end_moves_or_grows(spark):
    roads = table(spark, [FLAT, ("b", [(0, 2, 0), (0, 100, 0)]), ("c", [(50, 9, 0), (50, 100, 0)]), ("d", [(-50, 0.2, 0), (-50, 90, 0)])])
    got = lines(jo.carry_ends(roads)[0])
    assert got["b"] == [(0, 0, 0), (0, 100, 0)] and got["c"] == [(50, 0, 0), (50, 9, 0), (50, 100, 0)] and got["d"] == [(-50, 0.2, 0), (-50, 90, 0)]
    assert got["a"] == [(-100, 0, 0), (0, 0, 0), (50, 0, 0), (100, 0, 0)]


def test_split_takes_the_first_piece_and_no_vertex_twice(spark):
    roads = table(spark, [("a", [(-100, 0, 5), (0, 0, 5), (0, 100, 5)]), ("b", [(-50, 8, 0), (-50, 90, 0)]), ("c", [(0, 0, 0), (0, -90, 0)]), ("d", [(-8, 8, 1), (-80, 80, 1)])])
    ends = ne.road_ends(roads)
    got = lines(jo.split_roads_at_points(roads, ends))
    assert got["a"] == [(-100, 0, 5), (-50, 8, 5), (-8, 8, 1), (0, 0, 5), (0, 100, 5)]
    assert {k: len(v) for k, v in got.items()} == {"a": 5, "b": 2, "c": 2, "d": 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_gap_is_closed(spark, seed):
    """After one pass every end that was loose rests on another road, also those that gave way to a facing end."""
    rng = random.Random(seed)
    layout = []
    for i in range(60):
        x, y, turn, length = rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(0, 2 * math.pi), rng.uniform(30, 150)
        layout.append((f"r{i}", [(x, y, 0), (x + length * math.cos(turn), y + length * math.sin(turn), 0)]))
    roads = table(spark, layout)
    joined, made = jo.connect_road_ends(roads)
    gaps = ne.road_end_gaps(roads)
    assert gaps.count() >= made.count() > 5
    resting = ne.resting_ends(ne.road_ends(joined), joined.select("city", "road_id", "coordinates")).withColumnRenamed("own", "road_id")
    assert gaps.join(resting, ["city", "road_id", "which"], "left_anti").count() == 0
    corners = {name: set(line) for name, line in lines(joined).items()}
    for row in made.collect():
        spot = (round((row.spot.lon - LON) / MX, 2), round((row.spot.lat - LAT) / M, 2), 0)
        assert spot in corners[row.road_id] and spot in corners[row.target]
