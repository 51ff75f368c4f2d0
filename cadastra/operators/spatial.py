"""Location joins: tile both sides, equi-join on the tile, then the exact test.

A point lies in one tile, so point joins meet each pair once. Two boxes may share
several tiles; a pair is kept only in the tile holding the lower-left corner of
their overlap, so no ``distinct`` is needed afterwards. Boxes are
``STRUCT<min_lon, min_lat, max_lon, max_lat>``.

Tiling and unfolding lines multiply rows in a way the optimizer's estimate does not see (it
goes by the size of compressed files), so these joins ask for a sorted merge: a side is
never gathered in the driver on a wrong guess.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import grid_span, segment_box
from ..session import forget, materialise

# A degree of latitude or longitude is never shorter than this times cos(latitude).
SAFE_METRES_PER_DEG = 111000.0


def metre_pad(metres: float, box: str = "box") -> str:
    """Degrees that certainly cover ``metres`` around the box, as SQL text."""
    return f"({float(metres)!r}D / ({SAFE_METRES_PER_DEG!r}D * cos(radians(greatest(abs({box}.min_lat), abs({box}.max_lat))))))"


def tile_boxes(df: DataFrame, box: str, size: float, pad: float | str = 0.0) -> DataFrame:
    """One row per tile (``tx``, ``ty``) the padded box overlaps."""
    p = pad if isinstance(pad, str) else f"{pad!r}D"
    return (df.selectExpr("*", f"explode({grid_span(f'{box}.min_lon - {p}', f'{box}.max_lon + {p}', size)}) as tx")
            .selectExpr("*", f"explode({grid_span(f'{box}.min_lat - {p}', f'{box}.max_lat + {p}', size)}) as ty"))


def join_points(points: DataFrame, shapes: DataFrame, size: float, *, box: str = "box", by: Sequence[str] = ("city",),
                pad: float | str = 0.0, salts: int = 1) -> DataFrame:
    """Pairs of a point (``lon``, ``lat``) and a shape whose padded box shares the point's tile.

    ``salts`` spreads the points of a crowded tile over that many tasks.
    """
    left = points.selectExpr("*", f"floor(lon / {size!r}D) as tx", f"floor(lat / {size!r}D) as ty")
    right = tile_boxes(shapes, box, size, pad)
    keys = [*by, "tx", "ty"]
    if salts > 1:
        left = left.selectExpr("*", f"pmod(xxhash64(lon, lat), {salts}L) as salt")
        right = right.selectExpr("*", f"explode(sequence(0L, {salts - 1}L)) as salt")
        keys.append("salt")
    return left.join(right.hint("merge"), keys).drop("tx", "ty", "salt")


def join_boxes(a: DataFrame, b: DataFrame, size: float, *, by: Sequence[str] = ("city",), pad: float = 0.0,
               a_box: str = "a_box", b_box: str = "b_box") -> DataFrame:
    """Pairs whose boxes, each widened by ``pad``, overlap; every pair once."""
    left, right = tile_boxes(a, a_box, size, pad), tile_boxes(b, b_box, size, pad)
    p2 = f"{2 * pad!r}D"
    overlap = (f"{a_box}.min_lon <= {b_box}.max_lon + {p2} and {a_box}.max_lon + {p2} >= {b_box}.min_lon"
               f" and {a_box}.min_lat <= {b_box}.max_lat + {p2} and {a_box}.max_lat + {p2} >= {b_box}.min_lat")
    home = (f"tx = floor((greatest({a_box}.min_lon, {b_box}.min_lon) - {pad!r}D) / {size!r}D)"
            f" and ty = floor((greatest({a_box}.min_lat, {b_box}.min_lat) - {pad!r}D) / {size!r}D)")
    return left.join(right.hint("merge"), [*by, "tx", "ty"]).filter(f"{overlap} and {home}").drop("tx", "ty")


def segments(lines: DataFrame, keep: Sequence[str], line: str = "coordinates") -> DataFrame:
    """One row per straight piece: ``seg``, ends ``a`` and ``b``, and its ``box``."""
    pieces = (f"transform(sequence(1, size({line}) - 1), _i -> named_struct('seg', _i - 1,"
              f" 'a', element_at({line}, _i), 'b', element_at({line}, _i + 1)))")
    out = lines.filter(f"size({line}) >= 2").selectExpr(*keep, f"inline({pieces})")
    return out.selectExpr("*", f"{segment_box()} as box")


def vertices(lines: DataFrame, keep: Sequence[str], line: str = "coordinates") -> DataFrame:
    """One row per vertex: ``pos``, ``lon``, ``lat``, ``z``."""
    return lines.selectExpr(*keep, f"posexplode({line}) as (pos, _p)").selectExpr(*keep, "pos", "_p.lon", "_p.lat", "_p.z")


def nearest_global(points: DataFrame, shapes: DataFrame, rank: str, *, point_key: Sequence[str], box: str = "box",
                   by: Sequence[str] = ("city",), first_size: float = 0.002, degrees: bool = False) -> DataFrame:
    """Nearest shape at any distance, without a cross join.

    ``rank`` is a struct expression that begins with the distance ``d`` in metres, or
    in raw degrees with ``degrees``.
    Tiles start small and double. A point is settled once its best shape is nearer
    than the padding searched, since nothing outside can beat it; only unsettled
    points go on to the next, wider round. Points of groups without shapes have no row. Adds
    the winning struct as ``best``.
    """
    size, done, cached = first_size, None, None
    todo = points.join(shapes.select(*by).distinct(), list(by), "left_semi")
    while True:
        best = join_points(todo, shapes, size, box=box, by=by, pad=size).groupBy(*point_key).agg(
            F.expr(f"min({rank})").alias("best"), F.expr("max(cos(radians(lat)))").alias("shrink"))
        found = materialise(best.filter(f"best.d <= {size!r}D" if degrees else f"best.d <= {size * SAFE_METRES_PER_DEG!r}D * shrink").drop("shrink"), "nearest")
        done = found if done is None else done.unionByName(found)
        rest = materialise(todo.join(found, list(point_key), "left_anti"), "unsettled")
        forget(cached)
        cached = todo = rest
        if rest.isEmpty():
            return points.join(done, list(point_key))
        size *= 2


def k_nearest_global(points: DataFrame, places: DataFrame, k: int, distance: str, *, point_key: Sequence[str], place_key: str,
                     by: Sequence[str] = ("city",), first_size: float = 0.002) -> DataFrame:
    """The ``k`` places nearest to each point at any distance (all, where a group has fewer), with ``d`` and ``rank``.

    ``points`` and ``places`` have ``lon`` and ``lat``; ``distance`` is SQL text in metres over ``lon``, ``lat``,
    ``plon``, ``plat``; equals rank by ``place_key``. Tiles start small and double. A point is settled once its
    k-th place is nearer than the padding searched, so nothing outside can come before it;
    only unsettled points go on to the next, wider round.
    """
    key = [*by, *point_key]
    order = Window.partitionBy(*key).orderBy("d", place_key)
    there = places.selectExpr(*by, place_key, "lon as plon", "lat as plat").selectExpr("*", "named_struct('min_lon', plon, 'min_lat', plat, 'max_lon', plon, 'max_lat', plat) as box")
    wanted = there.groupBy(*by).agg(F.least(F.lit(k), F.expr("count(1)")).alias("wanted"))
    todo = points.select(*key, "lon", "lat").join(wanted, list(by))
    size, done, cached = first_size, None, None
    while True:
        near = join_points(todo, there, size, by=by, pad=size).withColumn("d", F.expr(distance))
        best = materialise(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*key, "lat", "wanted", place_key, "d", "rank"), "nearest")
        sure = best.groupBy(*key).agg(F.expr("count(1)").alias("n"), F.max("d").alias("far"), F.first("wanted").alias("wanted"), F.expr("max(cos(radians(lat)))").alias("shrink"))
        sure = sure.filter(f"n = wanted and far <= {size * SAFE_METRES_PER_DEG!r}D * shrink").select(*key)
        found = materialise(best.join(sure, key, "left_semi").select(*key, place_key, "d", "rank"), "nearest")
        done = found if done is None else done.unionByName(found)
        rest = materialise(todo.join(sure, key, "left_anti"), "unsettled")
        forget(best)
        forget(cached)
        cached = todo = rest
        if rest.isEmpty():
            return done
        size *= 2
