"""Polygon tests and measures as Spark SQL expressions over rings of points."""

from __future__ import annotations

from .geo import pt, proper_cross, steps


def ring_sides(ring: str) -> str:
    """Sides of a ring: every vertex with the one before it, the first with the last."""
    return f"transform({ring}, (_p, _i) -> named_struct('a', coalesce(get({ring}, _i - 1), element_at({ring}, -1)), 'b', _p))"


def ray_parity(x: str, y: str, ring: str) -> str:
    """True when a ray from the point crosses the ring an odd number of times."""
    hit = (f"(_s.b.lat > {y}) <> (_s.a.lat > {y}) and {x} < (_s.a.lon - _s.b.lon) * ({y} - _s.b.lat)"
           f" / coalesce(nullif(_s.a.lat - _s.b.lat, 0D), 1D) + _s.b.lon")
    return f"(size(filter({ring_sides(ring)}, _s -> {hit})) % 2 = 1)"


def on_ring(x: str, y: str, ring: str, tolerance: float) -> str:
    len2 = "(power(_s.b.lon - _s.a.lon, 2) + power(_s.b.lat - _s.a.lat, 2))"
    t = (f"greatest(0D, least(1D, coalesce((({x} - _s.a.lon) * (_s.b.lon - _s.a.lon) + ({y} - _s.a.lat)"
         f" * (_s.b.lat - _s.a.lat)) / nullif({len2}, 0D), 0D)))")
    gap = (f"sqrt(power({x} - _s.a.lon - {t} * (_s.b.lon - _s.a.lon), 2)"
           f" + power({y} - _s.a.lat - {t} * (_s.b.lat - _s.a.lat), 2))")
    return f"exists({ring_sides(ring)}, _s -> {gap} <= {tolerance!r}D)"


def in_reach(x: str, y: str, box: str = "box") -> str:
    """False only for points outside a ring's box, to be asked before the ring itself, which costs far more."""
    return f"({x} between {box}.min_lon - 1e-9D and {box}.max_lon + 1e-9D and {y} between {box}.min_lat - 1e-9D and {box}.max_lat + 1e-9D)"


def in_polygon(x: str, y: str, ring: str, mode: str = "plain", tolerance: float = 1e-12) -> str:
    """Point in polygon.

    ``plain``: ray parity only (both demand variants agree on it, because the
    division guard is never reached on a straddling side); ``boundary``: points on
    the ring count as inside; ``strict``: points on the ring count as outside.
    """
    inside = ray_parity(x, y, ring)
    if mode == "plain":
        return inside
    if mode == "boundary":
        return f"({inside} or {on_ring(x, y, ring, tolerance)})"
    if mode == "strict":
        return f"({inside} and not {on_ring(x, y, ring, tolerance)})"
    raise ValueError(f"unknown mode {mode}")


def shoelace(ring: str) -> str:
    """Unsigned area in squared degrees, taken around the first vertex to keep precision."""
    ox, oy = f"element_at({ring}, 1).lon", f"element_at({ring}, 1).lat"
    return (f"abs(aggregate({ring_sides(ring)}, 0D, (_acc, _s) -> _acc + (_s.a.lon - {ox}) * (_s.b.lat - {oy})"
            f" - (_s.b.lon - {ox}) * (_s.a.lat - {oy}))) / 2")


def mean_of(ring: str, field: str) -> str:
    """Mean of one coordinate over all listed vertices, the closing one included."""
    return f"(aggregate({ring}.{field}, 0D, (_acc, _v) -> _acc + _v) / nullif(size({ring}), 0))"


def is_closed(ring: str) -> str:
    return (f"(element_at({ring}, 1).lon = element_at({ring}, -1).lon"
            f" and element_at({ring}, 1).lat = element_at({ring}, -1).lat)")


def close_ring(ring: str) -> str:
    return f"case when {is_closed(ring)} then {ring} else concat({ring}, slice({ring}, 1, 1)) end"


def centroid(ring: str) -> str:
    """Area-weighted centroid, worked out around the first vertex; vertex mean when flat."""
    ox, oy = f"element_at({ring}, 1).lon", f"element_at({ring}, 1).lat"
    w = f"((_s.a.lon - {ox}) * (_s.b.lat - {oy}) - (_s.b.lon - {ox}) * (_s.a.lat - {oy}))"
    sums = (f"aggregate({ring_sides(ring)}, named_struct('w', 0D, 'x', 0D, 'y', 0D), (_acc, _s) -> named_struct("
            f"'w', _acc.w + {w}, 'x', _acc.x + (_s.a.lon + _s.b.lon - 2 * {ox}) * {w},"
            f" 'y', _acc.y + (_s.a.lat + _s.b.lat - 2 * {oy}) * {w}), _acc -> case when abs(_acc.w) >= 1e-18 then"
            f" named_struct('lon', {ox} + _acc.x / (3 * _acc.w), 'lat', {oy} + _acc.y / (3 * _acc.w)) end)")
    opened = f"slice({ring}, 1, size({ring}) - int({is_closed(ring)} and size({ring}) > 1))"
    return f"coalesce({sums}, named_struct('lon', {mean_of(opened, 'lon')}, 'lat', {mean_of(opened, 'lat')}))"


def self_crosses(ring: str) -> str:
    """True when two sides of the closed ring that are not neighbours cross."""
    sides = steps(close_ring(ring))
    n = f"size({sides})"
    numbered = f"transform({sides}, (_q, _j) -> named_struct('a', _q.a, 'b', _q.b, 'j', _j))"
    return (f"exists({numbered}, _u -> exists({numbered}, _v -> _v.j > _u.j + 1 and not (_u.j = 0 and _v.j = {n} - 1)"
            f" and {proper_cross('_u.a', '_u.b', '_v.a', '_v.b')}))")


def clip_half_plane(ring: str, axis: str, limit: str, keep_above: bool) -> str:
    """Part of a ring on one side of a line of constant longitude or latitude."""
    op, other = (">=" if keep_above else "<="), ("lat" if axis == "lon" else "lon")
    t = f"(({limit} - _s.a.{axis}) / nullif(_s.b.{axis} - _s.a.{axis}, 0D))"
    level = f"_s.a.{other} + {t} * (_s.b.{other} - _s.a.{other})"
    z = f"_s.a.z + {t} * (_s.b.z - _s.a.z)"
    meet = pt(limit, level, z) if axis == "lon" else pt(level, limit, z)
    return (f"flatten(transform({ring_sides(ring)}, _s -> case when _s.a.{axis} {op} {limit} and _s.b.{axis} {op} {limit}"
            f" then array(_s.b) when _s.a.{axis} {op} {limit} then array({meet})"
            f" when _s.b.{axis} {op} {limit} then array({meet}, _s.b) else slice(array(_s.b), 1, 0) end))")


BOX_CUTS = (("lon", "min_lon", True), ("lon", "max_lon", False), ("lat", "min_lat", True), ("lat", "max_lat", False))
