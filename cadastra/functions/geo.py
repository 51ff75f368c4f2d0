"""Geometry as Spark SQL expressions (no Python per row).

Every function takes and returns SQL text, to be used with ``F.expr`` or
``selectExpr``: one call builds a whole expression, and Catalyst sees only built-in
functions. Points are ``STRUCT<lon DOUBLE, lat DOUBLE, z DOUBLE>`` in WGS84 degrees
and metres; lines and rings are arrays of points.
"""

from __future__ import annotations

# Numeric conventions every result depends on.
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEG = 111320.0
AGENT_METRES_PER_DEG = 111000.0
STATION_METRES_PER_LAT = 110540.0
MERCATOR_RADIUS_M = 6378137.0
MERCATOR_MAX_LAT = 85.05112878
JOIN_TOLERANCE_DEG = 0.00006
LEVEL_GAP_M = 3.0

POINT = "struct<lon:double,lat:double,z:double>"
LINE = f"array<{POINT}>"


def pt(lon: str, lat: str, z: str = "0D") -> str:
    return f"named_struct('lon', {lon}, 'lat', {lat}, 'z', double({z}))"


def js_round(x: str) -> str:
    """Round half up towards plus infinity (not away from zero)."""
    return f"floor({x} + 0.5D)"


def fixed(x: str, digits: int) -> str:
    """``x`` at a fixed number of decimals, by the same half-up rule."""
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5D) / {scale})"


def e7(x: str) -> str:
    """Degrees as whole 1e-7 steps: the identity of a vertex coordinate."""
    return f"floor(({x}) * 1e7 + 0.5D)"


# ---- distances -------------------------------------------------------------

def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = (f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * power(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"({2 * EARTH_RADIUS_M}D * atan2(sqrt({a}), sqrt(1 - {a})))"


def haversine_pts(a: str, b: str) -> str:
    return haversine(f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")


def planar(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Local planar metres: longitude scaled by the cosine of the first latitude."""
    return (f"sqrt(power(({lon2} - {lon1}) * {METRES_PER_DEG}D * cos(radians({lat1})), 2)"
            f" + power(({lat2} - {lat1}) * {METRES_PER_DEG}D, 2))")


def planar_pts(a: str, b: str) -> str:
    return planar(f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")


def agent_pts(a: str, b: str) -> str:
    """Planar 3D metres at 111,000 m per degree, as vehicles measure their path."""
    m = f"{AGENT_METRES_PER_DEG}D"
    return (f"sqrt(power(({b}.lon - {a}.lon) * {m} * cos(radians({a}.lat)), 2)"
            f" + power(({b}.lat - {a}.lat) * {m}, 2) + power({b}.z - {a}.z, 2))")


def steps(line: str) -> str:
    """Consecutive point pairs of a line as ``array<struct<a,b>>`` (empty below 2)."""
    return (f"filter(transform({line}, (_p, _i) -> named_struct('a', get({line}, _i - 1), 'b', _p)),"
            f" _s -> _s.a is not null)")


def line_length(line: str, metric=haversine_pts) -> str:
    return f"aggregate({steps(line)}, 0D, (_acc, _q) -> _acc + {metric('_q.a', '_q.b')})"


def cumulative(line: str, metric=haversine_pts) -> str:
    """Distance from the start at every vertex of the line."""
    return (f"aggregate({steps(line)}, array(0D), (_acc, _q) ->"
            f" concat(_acc, array(element_at(_acc, -1) + {metric('_q.a', '_q.b')})))")


# ---- boxes -----------------------------------------------------------------

def box(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"named_struct('min_lon', {x0}, 'min_lat', {y0}, 'max_lon', {x1}, 'max_lat', {y1})"


def bounds(line: str) -> str:
    lon, lat = f"{line}.lon", f"{line}.lat"
    return box(f"array_min({lon})", f"array_min({lat})", f"array_max({lon})", f"array_max({lat})")


def segment_box(a: str = "a", b: str = "b") -> str:
    return box(f"least({a}.lon, {b}.lon)", f"least({a}.lat, {b}.lat)",
               f"greatest({a}.lon, {b}.lon)", f"greatest({a}.lat, {b}.lat)")


def widen(b: str, metres: str) -> str:
    dlat = f"({metres}) / {METRES_PER_DEG}D"
    dlon = f"({metres}) / ({METRES_PER_DEG}D * cos(radians(({b}.min_lat + {b}.max_lat) / 2)))"
    return box(f"{b}.min_lon - {dlon}", f"{b}.min_lat - {dlat}", f"{b}.max_lon + {dlon}", f"{b}.max_lat + {dlat}")


def box_union(a: str, b: str) -> str:
    return box(f"least({a}.min_lon, {b}.min_lon)", f"least({a}.min_lat, {b}.min_lat)",
               f"greatest({a}.max_lon, {b}.max_lon)", f"greatest({a}.max_lat, {b}.max_lat)")


def boxes_touch(a: str, b: str) -> str:
    return (f"({a}.min_lon <= {b}.max_lon and {a}.max_lon >= {b}.min_lon"
            f" and {a}.min_lat <= {b}.max_lat and {a}.max_lat >= {b}.min_lat)")


def box_contains(outer: str, inner: str) -> str:
    return (f"({outer}.min_lon <= {inner}.min_lon and {outer}.max_lon >= {inner}.max_lon"
            f" and {outer}.min_lat <= {inner}.min_lat and {outer}.max_lat >= {inner}.max_lat)")


def box_area_km2(b: str) -> str:
    width = haversine(f"{b}.min_lon", f"{b}.min_lat", f"{b}.max_lon", f"{b}.min_lat")
    height = haversine(f"{b}.min_lon", f"{b}.min_lat", f"{b}.min_lon", f"{b}.max_lat")
    return f"({width} * {height} / 1e6)"


# ---- points and segments ---------------------------------------------------

def project_t(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Parameter in [0, 1] of the point of segment ``ab`` closest to ``p`` (raw degrees)."""
    len2 = f"(power({bx} - {ax}, 2) + power({by} - {ay}, 2))"
    dot = f"(({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay}))"
    return f"greatest(0D, least(1D, coalesce({dot} / nullif({len2}, 0D), 0D)))"


def project_t_m(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """As :func:`project_t`, in local metres around the query point."""
    k = f"power(cos(radians({py})), 2)"
    len2 = f"(power({bx} - {ax}, 2) * {k} + power({by} - {ay}, 2))"
    dot = f"(({px} - {ax}) * ({bx} - {ax}) * {k} + ({py} - {ay}) * ({by} - {ay}))"
    return f"greatest(0D, least(1D, coalesce({dot} / nullif({len2}, 0D), 0D)))"


def degrees_apart(px: str, py: str, qx: str, qy: str) -> str:
    return f"sqrt(power({px} - ({qx}), 2) + power({py} - ({qy}), 2))"


def along(a: str, b: str, t: str) -> str:
    return f"({a} + {t} * ({b} - {a}))"


def cross_params(a: str, b: str, c: str, d: str) -> str:
    """``struct<u,v>`` where closed segments ``ab`` and ``cd`` meet, or null (parallel: null)."""
    rx, ry = f"({b}.lon - {a}.lon)", f"({b}.lat - {a}.lat)"
    sx, sy = f"({d}.lon - {c}.lon)", f"({d}.lat - {c}.lat)"
    qx, qy = f"({c}.lon - {a}.lon)", f"({c}.lat - {a}.lat)"
    den = f"nullif({rx} * {sy} - {ry} * {sx}, 0D)"
    u, v = f"(({qx} * {sy} - {qy} * {sx}) / {den})", f"(({qx} * {ry} - {qy} * {rx}) / {den})"
    return f"case when {u} between 0 and 1 and {v} between 0 and 1 then named_struct('u', {u}, 'v', {v}) end"


def orientation(a: str, b: str, c: str) -> str:
    """Twice the signed area of ``abc``: positive when counter-clockwise."""
    return f"(({b}.lon - {a}.lon) * ({c}.lat - {a}.lat) - ({b}.lat - {a}.lat) * ({c}.lon - {a}.lon))"


def proper_cross(a: str, b: str, c: str, d: str) -> str:
    """True when the two segments cross strictly inside both of them."""
    return (f"({orientation(a, b, c)} * {orientation(a, b, d)} < 0"
            f" and {orientation(c, d, a)} * {orientation(c, d, b)} < 0)")


# ---- directions ------------------------------------------------------------

def norm_deg(x: str) -> str:
    """Heading in [0, 360)."""
    return f"pmod({x}, 360D)"


def bearing(a: str, b: str, ref_lat: str | None = None) -> str:
    """Compass bearing from a to b over a plane at the reference latitude (default a's)."""
    dx = f"({b}.lon - {a}.lon) * {METRES_PER_DEG}D * cos(radians({ref_lat or a + '.lat'}))"
    return norm_deg(f"degrees(atan2({dx}, ({b}.lat - {a}.lat) * {STATION_METRES_PER_LAT}D))")


def angle_between(a: str, b: str) -> str:
    """Smallest angle between two headings, 0 to 180."""
    d = f"pmod(abs({a} - {b}), 360D)"
    return f"least({d}, 360D - {d})"


def turn_angle(a1: str, a2: str, b1: str, b2: str) -> str:
    """Signed change of direction in degrees, raw degree plane."""
    d = (f"degrees(atan2({b2}.lat - {b1}.lat, {b2}.lon - {b1}.lon)"
         f" - atan2({a2}.lat - {a1}.lat, {a2}.lon - {a1}.lon))")
    return f"(case when {d} > 180 then {d} - 360 when {d} < -180 then {d} + 360 else {d} end)"


def turn_label(angle: str) -> str:
    """Turn name. Counter-clockwise turns are named "right", as the planners' tool does."""
    return (f"case when abs({angle}) <= 35 then 'straight' when {angle} > 35 and {angle} < 145 then 'right'"
            f" when {angle} < -35 and {angle} > -145 then 'left' else 'u_turn' end")


def geometric_turn(angle: str) -> str:
    """Turn name by map geometry: counter-clockwise is left."""
    return (f"case when abs({angle}) <= 35 then 'straight' when {angle} > 35 and {angle} < 145 then 'left'"
            f" when {angle} < -35 and {angle} > -145 then 'right' else 'u_turn' end")


# ---- grid cells ------------------------------------------------------------

def mercator_x(lon: str) -> str:
    return f"({MERCATOR_RADIUS_M}D * radians({lon}))"


def mercator_y(lat: str) -> str:
    clamped = f"greatest(-{MERCATOR_MAX_LAT}D, least({MERCATOR_MAX_LAT}D, {lat}))"
    return f"({MERCATOR_RADIUS_M}D * ln(tan(pi() / 4 + radians({clamped}) / 2)))"


def mercator_cell(lon: str, lat: str, size_m: float) -> str:
    return (f"named_struct('cx', floor({mercator_x(lon)} / {float(size_m)}D),"
            f" 'cy', floor({mercator_y(lat)} / {float(size_m)}D))")


def grid_span(lo: str, hi: str, size: float) -> str:
    """Whole-number cells covering ``[lo, hi]``."""
    return f"sequence(floor(({lo}) / {size!r}D), floor(({hi}) / {size!r}D))"


# ---- resampling ------------------------------------------------------------

def densify(line: str, step_m: float, metric=haversine_pts) -> str:
    """Insert points so no step is longer than ``step_m``; marks original vertices."""
    n = f"greatest(1L, ceil({metric('_q.a', '_q.b')} / {float(step_m)}D))"
    def mid(f):
        return f"_w.a.{f} + (_w.b.{f} - _w.a.{f}) * _k / _w.n"
    piece = (f"transform(sequence(1L, _w.n), _k -> named_struct('lon', {mid('lon')}, 'lat', {mid('lat')},"
             f" 'z', {mid('z')}, 'original', _k = _w.n))")
    sized = f"transform({steps(line)}, _q -> named_struct('a', _q.a, 'b', _q.b, 'n', {n}))"
    first = f"transform(slice({line}, 1, 1), _p -> named_struct('lon', _p.lon, 'lat', _p.lat, 'z', _p.z, 'original', true))"
    return f"concat({first}, flatten(transform({sized}, _w -> {piece})))"


def point_at(line: str, metres: str, metric=agent_pts) -> str:
    """Position after ``metres`` along the line, clamped to its ends."""
    step = metric("_q.a", "_q.b")
    inside = f"(not _acc.hit and _acc.done + {step} >= {metres})"
    t = f"greatest(0D, coalesce(({metres} - _acc.done) / nullif({step}, 0D), 0D))"
    here = pt(*[along(f"_q.a.{f}", f"_q.b.{f}", t) for f in ("lon", "lat", "z")])
    start = f"named_struct('done', 0D, 'hit', false, 'p', element_at({line}, 1))"
    return (f"aggregate({steps(line)}, {start}, (_acc, _q) -> named_struct('done', _acc.done + {step},"
            f" 'hit', _acc.hit or {inside}, 'p', case when _acc.hit then _acc.p when {inside} then {here} else _q.b end)).p")


def slice_path(line: str, start_m: str, end_m: str, metric=haversine_pts) -> str:
    """Part of a line between two distances along it (interior vertices kept)."""
    cum = cumulative(line, metric)
    inner = (f"transform(filter(zip_with({line}, {cum}, (_v, _d) -> named_struct('p', _v, 'd', _d)),"
             f" _z -> _z.d > {start_m} and _z.d < least({end_m}, element_at({cum}, -1))), _z -> _z.p)")
    return f"concat(array({point_at(line, start_m, metric)}), {inner}, array({point_at(line, end_m, metric)}))"
