"""Geometry jobs that need more than one expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..session import pin
from ..sources import citydata as city
from .demand import points_in_zones
from .polygons import clip_rings  # noqa: F401 - part of this module's surface
from .spatial import segments, vertices


def edge_points_in_zones(spark, sf_dir: str, mode: str) -> DataFrame:
    """Building corners against zones, a fifth of them moved onto a zone side."""
    zones = city.zones(spark, sf_dir)
    side = zones.groupBy("city").agg(F.expr("max(x0)").alias("zx"))
    pts = city.derive(spark, sf_dir, "buildings").join(side, "city", "left").selectExpr(
        "city", "building_id as id", "(case when ord % 5 = 0 then zx else x0 end) / 1e7 as lon", "y0 / 1e7 as lat").filter("lon is not null")
    return points_in_zones(pts, zones, ["id"], mode=mode).select("id", "zone_id")


def cells_crossed(lines: DataFrame, size_m: float) -> DataFrame:
    """Mercator grid cells each line passes through, found column by column.

    Within one column of cells a straight piece covers a single interval of rows,
    so no walking from cell to cell is needed.
    """
    keep = [c for c in lines.columns if c != "coordinates"]
    s = segments(lines, keep).selectExpr(
        *keep, f"{G.mercator_x('a.lon')} as x1", f"{G.mercator_y('a.lat')} as y1", f"{G.mercator_x('b.lon')} as x2", f"{G.mercator_y('b.lat')} as y2")
    z = f"{float(size_m)}D"
    cols = s.selectExpr("*", f"explode(sequence(floor(least(x1, x2) / {z}), floor(greatest(x1, x2) / {z}))) as cx")
    cols = cols.selectExpr("*", f"greatest(least(x1, x2), cx * {z}) as xl", f"least(greatest(x1, x2), (cx + 1) * {z}) as xh")
    cols = cols.selectExpr("*", "case when x1 = x2 then y1 else y1 + (xl - x1) / (x2 - x1) * (y2 - y1) end as ya",
                           "case when x1 = x2 then y2 else y1 + (xh - x1) / (x2 - x1) * (y2 - y1) end as yb")
    return cols.selectExpr(*keep, "cx", f"explode(sequence(floor(least(ya, yb) / {z}), floor(greatest(ya, yb) / {z}))) as cy")


def content_keys(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stable key of what the named columns hold, for telling whether inputs changed."""
    return df.selectExpr(key, f"hex(xxhash64(to_json(struct({', '.join(columns)})))) as content_key")


def parse_boxes(df: DataFrame, text: str) -> DataFrame:
    """``min_lng,min_lat,max_lng,max_lat;...`` to boxes; unusable rows carry a ``reason``."""
    parts = f"filter(split({text}, ';'), _b -> trim(_b) <> '')"
    out = pin(df, _n=f"transform({parts}, _b -> transform(split(_b, ','), _v -> try_cast(trim(_v) as double)))")
    good = "size(_b) = 4 and not exists(_b, _v -> _v is null) and _b[0] <= _b[2] and _b[1] <= _b[3]"
    out = out.selectExpr("*", f"case when size(_n) = 0 then 'no box given' when not forall(_n, _b -> coalesce({good}, false)) then 'bad box' end as reason")
    shaped = G.box("_b[0]", "_b[1]", "_b[2]", "_b[3]")
    return out.selectExpr(*df.columns, f"transform(case when reason is null then _n else slice(_n, 1, 0) end, _b -> {shaped}) as boxes", "reason")


def suggested_range(metres: str) -> str:
    """Study range for a road of that length: 2.5 times it in steps of 50 m, 300 to 5000 m."""
    return f"least(5000D, greatest(100D, greatest(300D, {G.js_round(f'{metres} * 2.5D / 50')} * 50D)))"


def coverage_tiles(lines: DataFrame, range_m: float, size_deg: float = 0.01) -> DataFrame:
    """Tiles covering each line's box widened by a range."""
    keep = [c for c in lines.columns if c != "coordinates"]
    df = lines.selectExpr(*keep, f"{G.bounds('coordinates')} as _b").selectExpr(*keep, f"{G.widen('_b', f'{float(range_m)}D')} as _w")
    df = df.selectExpr(*keep, "_w", f"explode({G.grid_span('_w.min_lon', '_w.max_lon', size_deg)}) as tx")
    return df.selectExpr(*keep, "tx", f"explode({G.grid_span('_w.min_lat', '_w.max_lat', size_deg)}) as ty")


def vertex_rows(roads: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Road vertices with their identity ``kx``, ``ky`` (whole 1e-7 degrees)."""
    return vertices(roads, keep).selectExpr(*keep, "pos", "lon", "lat", "z", f"{G.e7('lon')} as kx", f"{G.e7('lat')} as ky")


def shared_vertices(roads: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Pairs of roads with the number of vertices they share."""
    v = vertex_rows(roads, [*by, "ord", "road_id"]).select(*by, "kx", "ky", "ord", "road_id").distinct()
    a = v.withColumnsRenamed({"ord": "ord_a", "road_id": "road_a"})
    b = v.withColumnsRenamed({"ord": "ord_b", "road_id": "road_b"})
    return a.join(b, [*by, "kx", "ky"]).filter("ord_a < ord_b").groupBy("road_a", "road_b").agg(F.expr("count(1)").alias("shared"))


def flyover_profile(flyovers: DataFrame) -> DataFrame:
    """Height along a flyover: ramps of at most 40 m with a smooth step, feet at 0.25 m."""
    df = pin(flyovers.select("flyover_id", "elevation", "coordinates"), p=G.densify("coordinates", 10))
    df = pin(df, d=G.cumulative("p"))
    df = df.selectExpr("flyover_id", "elevation", "element_at(d, -1) as total", "posexplode(d) as (pos, m)")
    df = df.selectExpr("*", "least(40D, total / 2) as ramp")
    df = df.selectExpr("*", "greatest(0D, least(1D, least(m, total - m) / nullif(ramp, 0D))) as s")
    return df.selectExpr("flyover_id", "bigint(pos) as pos", f"{G.fixed('m', 3)} as metres",
                         f"{G.fixed('0.25D + (elevation - 0.25D) * s * s * (3 - 2 * s)', 3)} as height")
