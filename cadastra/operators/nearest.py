"""Nearest and within-distance joins: points to roads, nodes, tracks and areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.polygons import in_polygon, in_reach
from ..session import materialise, pin
from .geometry import cells_crossed
from .spatial import join_boxes, join_points, metre_pad, nearest_global, segments, vertices

TILE_DEG = 0.001
# Fixed value: how far a building's edge is looked for on small tiles (degrees).
BESIDE_DEG = 0.0005
LEVEL = G.LEVEL_GAP_M


def road_hits(points: DataFrame, roads: DataFrame, max_m: float, point_key: Sequence[str], *, by: Sequence[str] = ("city",),
              not_same: str | None = None, strict: bool = False) -> DataFrame:
    """Closest spot of every road within ``max_m`` of each point.

    ``points``: key, ``lon``, ``lat``, ``z``; ``roads``: ``ord``, ``road_id``, ``coordinates``.
    One row per (point, road): ``hit`` = struct(d, seg, t, x, y, hz).
    """
    seg = segments(roads, [*by, "ord", "road_id"])
    df = join_points(points, seg, TILE_DEG, by=by, pad=metre_pad(max_m))
    if not_same:
        df = df.filter(not_same)
    df = pin(df, t=G.project_t_m("lon", "lat", "a.lon", "a.lat", "b.lon", "b.lat"))
    df = pin(df, x=G.along("a.lon", "b.lon", "t"), y=G.along("a.lat", "b.lat", "t"), hz=G.along("a.z", "b.z", "t"))
    d = f"sqrt(power((x - lon) * {G.METRES_PER_DEG}D * cos(radians(lat)), 2) + power((y - lat) * {G.METRES_PER_DEG}D, 2))"
    df = pin(df, d=d).filter(f"d {'<' if strict else '<='} {float(max_m)!r}D")
    keep = [c for c in points.columns if c not in by and c not in point_key]
    return df.groupBy(*by, *point_key, "ord", "road_id").agg(
        *[F.first(c).alias(c) for c in keep], F.expr("min(struct(d, seg, t, x, y, hz))").alias("hit"))


def nearest_road(points: DataFrame, roads: DataFrame, max_m: float, point_key: Sequence[str], *, by: Sequence[str] = ("city",),
                 later_wins: bool = False, same_level: bool = False, not_same: str | None = None, strict: bool = False) -> DataFrame:
    """Nearest road within ``max_m`` per point: ``road_id``, ``d`` and the spot on it."""
    hits = road_hits(points, roads, max_m, point_key, by=by, not_same=not_same, strict=strict)
    if same_level:
        hits = hits.filter(f"abs(hit.hz - z) <= {LEVEL}D")
    rank = "-ord" if later_wins else "ord"
    best = hits.groupBy(*by, *point_key).agg(F.expr(f"min(struct(hit.d as d, {rank} as o, road_id, hit.seg as seg, hit.x as x, hit.y as y))").alias("b"))
    return best.select(*by, *point_key, "b.d", "b.road_id", "b.seg", "b.x", "b.y")


def road_ends(roads: DataFrame, *, by: Sequence[str] = ("city",), keep: Sequence[str] = ()) -> DataFrame:
    """Both ends of every road: ``own`` (road id), ``which``, position."""
    e = "inline(array(named_struct('which', 'start', 'p', element_at(coordinates, 1)), named_struct('which', 'end', 'p', element_at(coordinates, -1))))"
    out = roads.selectExpr(*by, "road_id as own", *keep, e)
    return out.select(*[c for c in out.columns if c != "p"], "p.lon", "p.lat", "p.z")


def resting_ends(ends: DataFrame, lines: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """(own, which) of the ends that lie on another line at their height, within the join tolerance in degrees."""
    df = join_points(ends, segments(lines, [*by, "road_id"]), TILE_DEG, by=by, pad=G.JOIN_TOLERANCE_DEG).filter("road_id <> own")
    df = pin(df, t=G.project_t("lon", "lat", "a.lon", "a.lat", "b.lon", "b.lat"))
    apart = G.degrees_apart("lon", "lat", G.along("a.lon", "b.lon", "t"), G.along("a.lat", "b.lat", "t"))
    return df.filter(f"{apart} < {G.JOIN_TOLERANCE_DEG!r}D and abs(z - {G.along('a.z', 'b.z', 't')}) <= {LEVEL}D").select(*by, "own", "which").distinct()


def road_end_gaps(roads: DataFrame, max_gap_m: float = 25.0, *, decks: DataFrame | None = None, by: Sequence[str] = ("city",)) -> DataFrame:
    """Ends of roads no other line meets, with the nearest road they could join.

    ``decks`` (``road_id``, ``coordinates``) are lines an end may rest on but is not led to.
    The spot on the target is ``seg``, ``t``, ``x``, ``y``, ``z``.
    """
    ends = road_ends(roads, by=by, keep=["ord as own_ord"])
    lines = roads.select(*by, "road_id", "coordinates")
    resting = resting_ends(ends, lines if decks is None else lines.unionByName(decks.select(*by, "road_id", "coordinates")), by=by)
    loose = ends.join(resting.hint("merge"), [*by, "own", "which"], "left_anti")
    hits = road_hits(loose, roads, max_gap_m, ["own", "which"], by=by, not_same="road_id <> own").filter(f"abs(hit.hz - z) <= {LEVEL}D")
    best = hits.groupBy(*by, "own", "which", "own_ord").agg(F.expr("min(struct(hit.d as gap_m, ord, road_id, hit.seg as seg, hit.t as t, hit.x as x, hit.y as y, hit.hz as z))").alias("b"))
    return best.select(*by, F.col("own").alias("road_id"), "which", "own_ord", F.col("b.road_id").alias("target"), "b.gap_m", "b.seg", "b.t", "b.x", "b.y", "b.z")


def end_connections(roads: DataFrame, reach_m: float = 25.0, touching_m: float = 0.5, move_m: float = 3.0, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Where loose road ends are carried to; none if any road at that level already touches."""
    ends = road_ends(roads, by=by, keep=["ord as own_ord"])
    hits = road_hits(ends, roads, reach_m, ["own", "which"], by=by, not_same="road_id <> own").filter(f"abs(hit.hz - z) <= {LEVEL}D")
    best = hits.groupBy(*by, "own", "which", "own_ord").agg(F.expr("min(hit.d)").alias("nearest"), F.expr("min(struct(hit.d as d, ord, road_id, hit.seg as seg, hit.t as t, hit.x as x, hit.y as y, hit.hz as z))").alias("b"))
    return best.filter(f"nearest >= {touching_m}D").selectExpr(*by, "own as road_id", "which", "own_ord", "b.road_id as target", "b.d as gap_m", "b.seg", "b.t", "b.x", "b.y", "b.z",
                                                            f"case when b.d <= {move_m}D then 'move_end' else 'add_vertex' end as action")


def nearest_node(points: DataFrame, nodes: DataFrame, max_m: float, point_key: Sequence[str], *, by: Sequence[str] = ("city",),
                 metric=G.planar, where: str = "true") -> DataFrame:
    """Nearest node closer than ``max_m`` (left: null when there is none)."""
    n = nodes.withColumnsRenamed({"lon": "nlon", "lat": "nlat", "z": "nz"}).selectExpr("*", f"{G.box('nlon', 'nlat', 'nlon', 'nlat')} as box")
    df = join_points(points, n, TILE_DEG * 2, by=by, pad=metre_pad(max_m)).withColumn("d", F.expr(metric("lon", "lat", "nlon", "nlat")))
    best = df.filter(f"d < {float(max_m)!r}D and {where}").groupBy(*by, *point_key).agg(F.expr("min(struct(d, node))").alias("b"))
    return points.join(best, [*by, *point_key], "left").select(*points.columns, "b.node", "b.d")


def building_access(buildings: DataFrame, edges: DataFrame, cell_m: float = 200.0, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Nearest edge of every building and the edge's end to start from.

    Edges whose cells fall in the 3x3 block around the building are compared; where
    there is none, all edges of the city are. The access node is the end of the edge
    on the side of the nearer end of the closest piece. An edge nearer than a cell's
    side lies in the block for certain, so buildings close to one are settled on small
    tiles first and only the rest meet whole blocks.
    """
    seg = segments(edges, [*by, "ord", "edge_id", "from_node", "to_node"])
    t = G.project_t("lon", "lat", "a.lon", "a.lat", "b.lon", "b.lat")
    x, y = G.along("a.lon", "b.lon", "t"), G.along("a.lat", "b.lat", "t")
    first_nearer = f"{G.haversine(x, y, 'a.lon', 'a.lat')} < {G.haversine(x, y, 'b.lon', 'b.lat')}"
    homes = buildings.select(*by, "id", "lon", "lat")

    def ranked(df, within="true"):
        df = pin(pin(df, t=t), d=G.degrees_apart("lon", "lat", x, y)).filter(within)
        df = df.selectExpr(*by, "id", f"struct(d, ord, edge_id, seg, case when {first_nearer} then from_node else to_node end as access) as s")
        return df.groupBy(*by, "id").agg(F.min("s").alias("b")).select(*by, "id", "b.d", "b.edge_id", F.col("b.access").alias("access_node"))
    # A cell is narrowest in degrees of latitude; the tenth taken off covers the curve of long edges.
    certain = f"d <= {BESIDE_DEG!r}D and d <= {0.9 * cell_m!r}D / {G.METRES_PER_DEG}D * cos(radians(lat))"
    found = materialise(ranked(join_points(homes, seg, TILE_DEG, by=by, pad=BESIDE_DEG), certain), "access")
    rest = materialise(homes.join(found.hint("merge"), [*by, "id"], "left_anti"), "unplaced")
    if rest.isEmpty():
        return found
    cells = cells_crossed(edges.select(*by, "edge_id", "coordinates"), cell_m)
    cells = cells.selectExpr(*by, "edge_id", "explode(sequence(cx - 1, cx + 1)) as cx", "cy as cy0").selectExpr(
        *by, "edge_id", "cx", "explode(sequence(cy0 - 1, cy0 + 1)) as cy").distinct()
    block = rest.selectExpr("*", f"{G.mercator_cell('lon', 'lat', cell_m)} as c").selectExpr(*by, "id", "lon", "lat", "c.cx as cx", "c.cy as cy")
    near = block.join(cells.hint("merge"), [*by, "cx", "cy"]).select(*by, "id", "lon", "lat", "edge_id").join(seg.hint("merge"), [*by, "edge_id"])
    found = found.unionByName(materialise(ranked(near), "access"))
    missing = rest.join(found.hint("merge"), [*by, "id"], "left_anti")
    if missing.isEmpty():
        return found
    first = f"{G.haversine(G.along('a.lon', 'b.lon', t), G.along('a.lat', 'b.lat', t), 'a.lon', 'a.lat')} < {G.haversine(G.along('a.lon', 'b.lon', t), G.along('a.lat', 'b.lat', t), 'b.lon', 'b.lat')}"
    gap = G.degrees_apart("lon", "lat", G.along("a.lon", "b.lon", t), G.along("a.lat", "b.lat", t))
    rank = f"struct({gap} as d, ord, edge_id, seg, case when {first} then from_node else to_node end as access)"
    far = nearest_global(materialise(missing, "unplaced"), seg, rank, point_key=["id"], by=by, first_size=0.004, degrees=True)
    return found.unionByName(far.select(*by, "id", "best.d", "best.edge_id", F.col("best.access").alias("access_node")))


def gateway_nodes(gateways: DataFrame, nodes: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Nearest node of each gateway at any distance: ``node``, ``d`` (metres)."""
    n = nodes.withColumnsRenamed({"lon": "nlon", "lat": "nlat"}).selectExpr("*", f"{G.box('nlon', 'nlat', 'nlon', 'nlat')} as box")
    rank = f"struct({G.haversine('lon', 'lat', 'nlon', 'nlat')} as d, node, nlon, nlat)"
    out = nearest_global(gateways, n, rank, point_key=["gateway_id"], by=by)
    return out.select(*gateways.columns, "best.node", "best.d", "best.nlon", "best.nlat")


def gateway_edges(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge at the gateway's node whose first vertex is nearest."""
    at = edges.selectExpr("edge_id", "ord", "coordinates[0] as v", "explode(array_distinct(array(from_node, to_node))) as node")
    return placed.join(at, "node").groupBy("gateway_id", "node").agg(F.expr(
        f"min(struct({G.haversine('lon', 'lat', 'v.lon', 'v.lat')} as d, ord, edge_id))").alias("b")).select("gateway_id", "node", "b.edge_id")


def station_headings(stations: DataFrame, tracks: DataFrame, max_m: float = 100.0, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Way each station faces: along the nearest track, else its own heading."""
    seg = segments(tracks, [*by, "ord", "track_id"]).withColumnRenamed("ord", "track_ord")
    df = join_points(stations, seg, TILE_DEG * 2, by=by, pad=metre_pad(max_m))
    kx, ky = f"{G.METRES_PER_DEG}D * cos(radians(lat))", f"{G.STATION_METRES_PER_LAT}D"
    df = pin(df, ux="(a.lon - lon) * " + kx, uy="(a.lat - lat) * " + ky, dx="(b.lon - a.lon) * " + kx, dy="(b.lat - a.lat) * " + ky)
    df = df.filter("dx <> 0 or dy <> 0").selectExpr("*", "greatest(0D, least(1D, -(ux * dx + uy * dy) / (dx * dx + dy * dy))) as t")
    df = df.selectExpr("*", "sqrt(power(ux + t * dx, 2) + power(uy + t * dy, 2)) as d", f"{G.norm_deg('degrees(atan2(dx, dy))')} as bearing")
    best = df.filter(f"d <= {max_m}D").groupBy(*by, "station_id").agg(F.expr("min(struct(d, track_ord, seg, track_id, bearing))").alias("b"))
    out = stations.join(best, [*by, "station_id"], "left")
    use = "align_to_track and b is not null"
    return out.selectExpr(*by, "station_id", f"case when {use} then b.bearing else {G.norm_deg('coalesce(heading, 0D)')} end as heading",
                          f"case when {use} then 'track' else 'manual' end as source", f"case when {use} then b.track_id end as track_id")


def snap_points(points: DataFrame, junctions: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",),
                vertex_deg: float = 0.00015, edge_deg: float = 0.00010) -> DataFrame:
    """Snap target per point: a junction, else a road vertex, else the middle part of an edge."""
    j = junctions.selectExpr(*by, "junction_id as target", "lon as tlon", "lat as tlat", f"{G.box('lon', 'lat', 'lon', 'lat')} as box", "1 as prio")
    v = vertices(roads, [*by, "road_id"]).selectExpr(*by, "road_id as target", "lon as tlon", "lat as tlat", f"{G.box('lon', 'lat', 'lon', 'lat')} as box", "2 as prio")
    near = join_points(points, j.unionByName(v), TILE_DEG, by=by, pad=vertex_deg)
    near = near.selectExpr(*by, "id", "prio", "target", f"{G.degrees_apart('lon', 'lat', 'tlon', 'tlat')} as d").filter(f"d < {vertex_deg!r}D")
    seg = segments(roads, [*by, "road_id"])
    mid = join_points(points, seg, TILE_DEG, by=by, pad=edge_deg)
    mid = pin(mid, t=G.project_t("lon", "lat", "a.lon", "a.lat", "b.lon", "b.lat")).filter("t >= 0.05 and t <= 0.95")
    gap = G.degrees_apart("lon", "lat", G.along("a.lon", "b.lon", "t"), G.along("a.lat", "b.lat", "t"))
    mid = mid.selectExpr(*by, "id", "3 as prio", "road_id as target", f"{gap} as d").filter(f"d < {edge_deg!r}D")
    return near.unionByName(mid).groupBy(*by, "id").agg(F.expr("min(struct(prio, d, target))").alias("b")).select(*by, "id", "b.prio", "b.target", "b.d")


def deck_crossings(decks: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Lower roads a deck crosses without sharing a vertex with it."""
    a = segments(decks, [*by, "deck_id"]).selectExpr(*by, "deck_id", "a as pa", "b as pb", "box as a_box")
    b = segments(roads, [*by, "road_id"]).selectExpr(*by, "road_id", "a as qa", "b as qb", "box as b_box")
    hit = join_boxes(a, b, TILE_DEG * 2, by=by).filter(f"{G.cross_params('pa', 'pb', 'qa', 'qb')} is not null").select(*by, "deck_id", "road_id").distinct()

    def keys(df, name):
        return vertices(df, [*by, name]).selectExpr(*by, name, f"{G.e7('lon')} as kx", f"{G.e7('lat')} as ky")
    shared = keys(decks, "deck_id").join(keys(roads, "road_id"), [*by, "kx", "ky"]).select(*by, "deck_id", "road_id").distinct()
    return hit.join(shared, [*by, "deck_id", "road_id"], "left_anti")


def roads_under_middle(flyovers: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",), grade: float = 0.05) -> DataFrame:
    """Roads with a vertex within 30 m (in degrees) of a flyover's flat middle, sampled every 10 m."""
    f = pin(flyovers, ramp=f"ceil(elevation / {grade}D)", total=G.line_length("coordinates"))
    s = segments(f, [*by, "flyover_id", "ramp", "total"])
    s = pin(s, n=f"greatest(1L, ceil({G.haversine_pts('a', 'b')} / 10D))", len=G.haversine_pts("a", "b"))
    done = F.expr("coalesce(sum(len) over (partition by {0} order by seg rows between unbounded preceding and 1 preceding), 0D)".format(", ".join([*by, "flyover_id"])))
    s = s.withColumn("done", done).selectExpr("*", "explode(sequence(0L, n)) as k").filter(
        "done + k / n * len > ramp and done + k / n * len < total - ramp")
    pts = s.selectExpr(*by, "flyover_id", "a.lon + k / n * (b.lon - a.lon) as lon", "a.lat + k / n * (b.lat - a.lat) as lat")
    return _vertex_near(pts, roads, 30 / 111000, "flyover_id", by)


def _vertex_near(pts: DataFrame, roads: DataFrame, deg: float, key: str, by) -> DataFrame:
    v = vertices(roads, [*by, "road_id"]).selectExpr(*by, "road_id", "lon as vlon", "lat as vlat", f"{G.box('lon', 'lat', 'lon', 'lat')} as box")
    hits = join_points(pts, v, TILE_DEG, by=by, pad=deg)
    return hits.filter(f"{G.degrees_apart('lon', 'lat', 'vlon', 'vlat')} < {deg!r}D").select(*by, key, "road_id").distinct()


def roads_at_flyover_ends(flyovers: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """(flyover, end, road) with a road vertex within 60 m (in degrees) of the end."""
    ends = flyovers.selectExpr(*by, "flyover_id", "inline(array(named_struct('which', 'start', 'p', element_at(coordinates, 1)), named_struct('which', 'end', 'p', element_at(coordinates, -1))))")
    ends = ends.selectExpr(*by, "struct(flyover_id, which) as k", "p.lon", "p.lat")
    return _vertex_near(ends, roads, 60 / 111000, "k", by).selectExpr(*by, "k.flyover_id as flyover_id", "k.which as which", "road_id")


def longest_approach(flyovers: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Longest road with a vertex within 60 m of each flyover end (0 when there is none)."""
    ends = flyovers.selectExpr(*by, "flyover_id", "inline(array(named_struct('which', 'start', 'p', element_at(coordinates, 1)), named_struct('which', 'end', 'p', element_at(coordinates, -1))))").selectExpr(
        *by, "flyover_id", "which", "p.lon", "p.lat")
    r = roads.filter("size(coordinates) >= 2").selectExpr(*by, "road_id", "coordinates", f"{G.line_length('coordinates')} as metres")
    v = vertices(r, [*by, "road_id", "metres"]).selectExpr(*by, "metres", "lon as vlon", "lat as vlat", f"{G.box('lon', 'lat', 'lon', 'lat')} as box")
    hits = join_points(ends, v, TILE_DEG, by=by, pad=metre_pad(60)).filter(f"{G.haversine('lon', 'lat', 'vlon', 'vlat')} <= 60")
    best = hits.groupBy(*by, "flyover_id", "which").agg(F.max("metres").alias("m"))
    return ends.join(best, [*by, "flyover_id", "which"], "left").selectExpr(*by, "flyover_id", "which", "coalesce(m, 0D) as approach_m")


def bridge_feasibility(flyovers: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """One row per flyover and check, with status, actual and required values.

    ``roads`` carry ``median`` (width, 0 without divider), ``lane_count``, ``capacity``.
    """
    key = [*by, "flyover_id"]
    f = pin(flyovers, need="ceil(elevation / 0.05D)", total=G.line_length("coordinates"))
    ramp = longest_approach(flyovers, roads, by=by).groupBy(*key).agg(F.min("approach_m").alias("avail"))
    under = roads_under_middle(flyovers, roads, by=by).join(roads.select(*by, "road_id", "median"), [*by, "road_id"]).groupBy(*key).agg(F.min("median").alias("median"))
    adj = roads_at_flyover_ends(flyovers, roads, by=by).select(*key, "road_id").distinct().join(
        roads.select(*by, "road_id", "lane_count"), [*by, "road_id"]).groupBy(*key).agg(F.min("lane_count").alias("least_lanes"), F.max("lane_count").alias("most_lanes"))
    df = f.join(ramp, key, "left").join(under, key, "left").join(adj, key, "left")
    # 50 m flat deck, 3 m median for a pier.
    checks = {"ramp_grade": ("avail >= need", "fail", G.js_round("avail"), "need"),
              "deck_length": ("total >= 2 * need + 50", "fail", G.js_round("total"), "2 * need + 50"),
              "pier_fit": ("coalesce(median, 3D) >= 3", "warn", "coalesce(median, 3D)", "3"),
              "lane_match": ("lane_count <= coalesce(least_lanes, lane_count)", "warn", "lane_count", "coalesce(most_lanes, lane_count)")}
    rows = ", ".join(f"named_struct('check', '{c}', 'status', case when {ok} then 'pass' else '{bad}' end, 'actual', double({a}), 'required', double({r}))"
                     for c, (ok, bad, a, r) in checks.items())
    return df.selectExpr(*key, f"inline(array({rows}))")


def ramp_impacts(flyovers: DataFrame, roads: DataFrame, *, by: Sequence[str] = ("city",), cut: float = 0.25) -> DataFrame:
    """Reduced capacity of roads beside flyover ramps; other roads keep theirs."""
    hit = roads_at_flyover_ends(flyovers, roads, by=by).select(*by, "road_id", F.lit(True).alias("hit")).distinct()
    return roads.join(hit, [*by, "road_id"], "left").selectExpr(
        *by, "road_id", "capacity as before", f"case when hit then {G.js_round(f'capacity * (1 - {cut}D)')} else capacity end as capacity")


def duplicate_roads(built: DataFrame, mapped: DataFrame, *, by: Sequence[str] = ("city",), max_m: float = 25.0) -> DataFrame:
    """Built roads that run along mapped ones: at least 80 % of points every 20 m within 25 m."""
    s = pin(segments(built, [*by, "road_id"]), m=f"sqrt(power((b.lon - a.lon) * {G.METRES_PER_DEG}D * cos(radians(b.lat)), 2) + power((b.lat - a.lat) * {G.METRES_PER_DEG}D, 2))")
    s = pin(s, n=f"greatest(1L, {G.js_round('m / 20')})")
    size = s.groupBy(*by, F.col("road_id").alias("own")).agg(F.sum("m").alias("metres"), F.sum("n").alias("samples"))
    pts = s.selectExpr(*by, "road_id as own", "seg", "a", "b", "n", "explode(sequence(0L, n - 1)) as k").selectExpr(
        *by, "own", "seg as own_seg", "k", *[f"a.{f} + k / n * (b.{f} - a.{f}) as {f}" for f in ("lon", "lat", "z")])
    near = nearest_road(pts, mapped, max_m, ["own", "own_seg", "k"], by=by, same_level=True)
    per = near.groupBy(*by, "own", "road_id").agg(F.expr("count(1)").alias("n")).groupBy(*by, "own").agg(
        F.sum("n").alias("covered"), F.expr("max_by(road_id, struct(n, road_id))").alias("along"))
    return per.join(size, [*by, "own"]).filter("metres >= 50 and covered >= samples * 0.8D").select(*by, F.col("own").alias("road_id"), "along", "covered", "samples")


def lines_touching_areas(lines: DataFrame, areas: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """(line, area) where a vertex lies in the area or a piece properly crosses its ring."""
    box_a = areas.selectExpr(*by, "area_id", "boundary", f"{G.bounds('boundary')} as box")
    pts = vertices(lines, [*by, "id"])
    inside = join_points(pts, box_a, TILE_DEG * 4, by=by).filter(f"{in_reach('lon', 'lat')} and {in_polygon('lon', 'lat', 'boundary', 'boundary')}").select(*by, "id", "area_id")
    a = segments(lines, [*by, "id"]).selectExpr(*by, "id", "a as pa", "b as pb", "box as a_box")
    b = segments(areas, [*by, "area_id"], "boundary").selectExpr(*by, "area_id", "a as qa", "b as qb", "box as b_box")
    cross = join_boxes(a, b, TILE_DEG * 4, by=by).filter(G.proper_cross("pa", "pb", "qa", "qb")).select(*by, "id", "area_id")
    return inside.unionByName(cross).distinct()


def new_roads(incoming: DataFrame, present: DataFrame, deleted: DataFrame, pieces: DataFrame) -> DataFrame:
    """Incoming ways neither present, nor deleted by the user, nor present as cut pieces."""
    out = incoming
    for other in (present, deleted, pieces):
        out = out.join(other.select("osm_id").distinct(), "osm_id", "left_anti")
    return out
