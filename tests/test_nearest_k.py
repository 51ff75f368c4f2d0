"""The k nearest places at any distance against comparing all."""

import math
import random

import pytest

from cadastra.functions.geo import haversine
from cadastra.operators.spatial import k_nearest_global


def metres(a, b):
    y0, y1 = math.radians(a[1]), math.radians(b[1])
    h = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 12742000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("k", [1, 3])
def test_same_as_comparing_all(spark, k):
    rng = random.Random(k)
    near = lambda: (73.8 + rng.random() * 0.01, 18.5 + rng.random() * 0.01)
    points = [(c, i, *((74.3, 18.9) if i == 0 else near())) for c in range(3) for i in range(20)]
    places = [(c, j, *near()) for c, n in ((0, 60), (1, 2), (2, 9)) for j in range(n)]
    got = k_nearest_global(spark.createDataFrame(points, "city bigint, id bigint, lon double, lat double"), spark.createDataFrame(places, "city bigint, node bigint, lon double, lat double"), k,
                           haversine("lon", "lat", "plon", "plat"), point_key=["id"], place_key="node")
    want = {(c, i): [j for _, j in sorted((metres((x, y), p[2:]), p[1]) for p in places if p[0] == c)[:k]] for c, i, x, y in points}
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        found.setdefault((r.city, r.id), []).append(r.node)
    assert found == want
