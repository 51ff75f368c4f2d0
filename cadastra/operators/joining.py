"""Roads joined to the roads their ends stop at or just short of, all in one pass.

Every join is a spot on a target road: a vertex in reach is reused, else a new one goes in
between two vertices, ordered by piece and place on it. Spots that nearly coincide become
one, and of two ends that would run to each other only one does. Heights come from the
target, and section ranges move along with the vertices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..session import materialise, pin
from .nearest import TILE_DEG, end_connections, road_end_gaps
from .spatial import join_points, segments, vertices

# A vertex this close to a join is used for it (m); a point this close to a vertex is that vertex (degrees).
REUSE_M, SAME_DEG = 1.0, 0.00001


def _metres(p: str, x: str = "x", y: str = "y") -> str:
    return f"({G.METRES_PER_DEG}D * sqrt(power(({p}.lon - {x}) * cos(radians({y})), 2) + power({p}.lat - {y}, 2)))"


def with_vertex(spots: DataFrame, roads: DataFrame, reuse_m: float = REUSE_M, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Adds to spots (``target``, ``seg``, ``t``, ``x``, ``y``, ``z``) the target's vertex in reach.

    ``vertex`` is its number or null, ``spot`` its place (else the spot's own), ``along`` the
    metres from the piece's first vertex, ``target_end`` 'start' or 'end' if the vertex is one.
    """
    at = segments(roads.withColumn("n", F.size("coordinates")), [*by, "road_id", "n"]).selectExpr(*by, "road_id as target", "seg", "n", "a", "b")
    df = pin(spots.join(at.hint("merge"), [*by, "target", "seg"]), to_a=_metres("a"), to_b=_metres("b"))
    df = df.withColumn("vertex", F.expr(f"case when least(to_a, to_b) <= {reuse_m!r}D then if(to_a <= to_b, seg, seg + 1) end"))
    return df.selectExpr(*spots.columns, "vertex", "case when vertex = seg then a when vertex is not null then b else " + G.pt("x", "y", "z") + " end as spot",
                         "to_a as along", "case when vertex = 0 then 'start' when vertex = n - 1 then 'end' end as target_end")


def settled(spots: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Without the second of two ends that would each run to the other; the road that comes first (``own_ord``) keeps its join."""
    facing = spots.filter("target_end is not null").selectExpr(
        *by, "target as road_id", "target_end as which", "road_id as target", "which as target_end", "own_ord as other_ord", "road_id as other_id").distinct()
    both = spots.join(facing.hint("merge"), [*by, "road_id", "which", "target", "target_end"], "left")
    return both.filter("other_ord is null or struct(own_ord, road_id) < struct(other_ord, other_id)").select(*spots.columns)


def merged_spots(spots: DataFrame, reuse_m: float = REUSE_M, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Spots between vertices brought together: along a piece, one within reach of the last kept spot takes that one.

    ``spot`` is replaced and ``fresh`` marks those that need a new vertex.
    """
    own = [c for c in spots.columns if c not in (*by, "target", "seg", "spot")]
    pieces = spots.filter("vertex is null").groupBy(*by, "target", "seg").agg(
        F.array_sort(F.collect_list(F.struct("along", "own_ord", F.struct(*own).alias("row"), "spot"))).alias("s"))

    def step(seen, s):
        close = s["along"] - seen["along"] <= reuse_m
        spot = F.when(close, seen["spot"]).otherwise(s["spot"])
        return F.struct(F.when(close, seen["along"]).otherwise(s["along"]).alias("along"), spot.alias("spot"),
                        F.concat(seen["out"], F.array(F.struct(s["row"].alias("row"), spot.alias("spot"), (~close).alias("fresh")))).alias("out"))

    none = F.slice(F.transform("s", lambda s: F.struct(s["row"].alias("row"), s["spot"].alias("spot"), F.lit(True).alias("fresh"))), 1, 0)
    first = F.struct(F.lit(float("-inf")).alias("along"), F.col("s")[0]["spot"].alias("spot"), none.alias("out"))
    between = pieces.select(*by, "target", "seg", F.inline(F.aggregate("s", first, step, lambda done: done["out"]))).select(*by, "target", "seg", "row.*", "spot", "fresh")
    return between.unionByName(spots.filter("vertex is not null").withColumn("fresh", F.lit(False)))


def insert_points(roads: DataFrame, points: DataFrame, ends: DataFrame | None = None, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Roads with all points put in at once; adds ``changed``.

    ``points``: ``road_id``, ``seg``, ``t`` (place on the piece), ``p``. ``ends``: ``road_id``,
    ``which``, ``p``, ``move`` (the end itself goes there, else a vertex is added). Where roads
    carry ``sections`` (structs with ``first`` and ``last`` vertex), each still covers the same
    stretch: a first vertex that is added joins the first section, a last one the last.
    """
    key = [*by, "road_id"]
    inner = points.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("seg").cast("int").alias("seg"), F.col("t").cast("double").alias("t"), "p"))).alias("_in"))
    out = roads.join(inner.hint("merge"), key, "left")
    if ends is None:
        out = out.selectExpr("*", "cast(null as struct<p:struct<lon:double,lat:double,z:double>,move:boolean>) as _s").withColumn("_e", F.col("_s"))
    else:
        both = ends.groupBy(*key).agg(*[F.max(F.when(F.col("which") == w, F.struct("p", "move"))).alias(c) for w, c in (("start", "_s"), ("end", "_e"))])
        out = out.join(both.hint("merge"), key, "left")
    out = out.withColumn("_in", F.coalesce("_in", F.filter(F.transform("coordinates", lambda p: F.struct(F.lit(0).alias("seg"), F.lit(0.0).alias("t"), p.alias("p"))), lambda x: F.lit(False))))
    moved = "case when i = 0 and _s.move then _s.p when i = size(coordinates) - 1 and _e.move then _e.p else p end"
    line = f"transform(array_sort(concat(transform(coordinates, (p, i) -> named_struct('seg', i, 't', -1D, 'p', {moved})), _in)), v -> v.p)"
    extra = [f"if({c} is not null and not {c}.move, array({c}.p), slice(coordinates, 1, 0))" for c in ("_s", "_e")]
    line = f"concat({extra[0]}, {line}, {extra[1]})"
    columns = [F.expr(line).alias(c) if c == "coordinates" else F.col(c) for c in roads.columns]
    if "sections" in roads.columns:
        before, behind = F.expr("if(_s is not null and not _s.move, 1, 0)"), F.expr("if(_e is not null and not _e.move, 1, 0)")

        def shifted(s):
            upto = lambda place: place + before + F.size(F.filter("_in", lambda x: x["seg"] < place))
            last = upto(s["last"]) + F.when(s["last"] == F.size("coordinates") - 1, behind).otherwise(0)
            return s.withField("first", F.when(s["first"] > 0, upto(s["first"])).otherwise(s["first"]).cast("double")).withField("last", last.cast("double"))

        columns[roads.columns.index("sections")] = F.transform("sections", shifted).alias("sections")
    return out.select(*columns, F.expr("size(_in) > 0 or _s is not null or _e is not null").alias("changed"))


def join_ends(roads: DataFrame, spots: DataFrame, reuse_m: float = REUSE_M, *, by: Sequence[str] = ("city",)) -> tuple[DataFrame, DataFrame]:
    """(roads joined at the spots, the joins made).

    ``spots``: ``road_id``, ``which`` end, ``own_ord``, ``target``, ``seg``, ``t``, ``x``, ``y``, ``z``, ``move``.
    The joins have ``spot``, shared by both roads to the last digit, and ``fresh``.
    """
    made = materialise(merged_spots(settled(with_vertex(spots, roads, reuse_m, by=by), by=by), reuse_m, by=by), "joins")
    points = made.filter("fresh").selectExpr(*by, "target as road_id", "seg", "t", "spot as p")
    ends = made.selectExpr(*by, "road_id", "which", "spot as p", "move")
    return insert_points(roads, points, ends, by=by), made


def connect_road_ends(roads: DataFrame, decks: DataFrame | None = None, max_gap_m: float = 25.0, *, by: Sequence[str] = ("city",)) -> tuple[DataFrame, DataFrame]:
    """Every loose end that stops short of a road at its height is extended to it, and the road gets the point too.

    An end that rests on a road or deck is not loose. Returns the roads and the joins.
    """
    gaps = road_end_gaps(roads, max_gap_m, decks=decks, by=by).withColumn("move", F.lit(False))
    return join_ends(roads, gaps, by=by)


def carry_ends(roads: DataFrame, reach_m: float = 25.0, touching_m: float = 0.5, move_m: float = 3.0, *, by: Sequence[str] = ("city",)) -> tuple[DataFrame, DataFrame]:
    """Loose ends carried onto the nearest road: moved when at most ``move_m`` away, else with a vertex more.

    An end that any road at its height touches stays. Returns the roads and the joins.
    """
    spots = end_connections(roads, reach_m, touching_m, move_m, by=by).withColumn("move", F.expr("action = 'move_end'"))
    return join_ends(roads, spots, by=by)


def points_on_roads(roads: DataFrame, points: DataFrame, tolerance_deg: float = 0.00012, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Where points (``own`` road, ``lon``, ``lat``, ``z``) lie on other roads away from the ends of a piece.

    The first such piece of a road counts; a road that has the point as a vertex is left alone.
    """
    df = join_points(points, segments(roads, [*by, "road_id"]), TILE_DEG, by=by, pad=tolerance_deg).filter("road_id <> own")
    df = pin(df, t=G.project_t("lon", "lat", "a.lon", "a.lat", "b.lon", "b.lat")).filter("t > 0.02 and t < 0.98")
    df = pin(df, x=G.along("a.lon", "b.lon", "t"), y=G.along("a.lat", "b.lat", "t")).filter(f"{G.degrees_apart('lon', 'lat', 'x', 'y')} < {tolerance_deg!r}D")
    first = df.groupBy(*by, "road_id", "lon", "lat", "z").agg(F.expr("min(struct(seg, t, a.z as az))").alias("m"))
    near = vertices(roads, [*by, "road_id"]).selectExpr(*by, "road_id", "lon as vlon", "lat as vlat")
    cell = lambda c: f"floor({c} / {SAME_DEG!r}D)"
    here = first.selectExpr("*", f"{cell('lon')} as cx", f"{cell('lat')} as cy")
    there = near
    for c, v in (("cx", "vlon"), ("cy", "vlat")):
        there = there.selectExpr("*", f"explode(sequence({cell(v)} - 1, {cell(v)} + 1)) as {c}")
    same = here.join(there.hint("merge"), [*by, "road_id", "cx", "cy"]).filter(f"abs(lon - vlon) < {SAME_DEG!r}D and abs(lat - vlat) < {SAME_DEG!r}D").select(*by, "road_id", "lon", "lat", "z")
    return first.join(same, [*by, "road_id", "lon", "lat", "z"], "left_anti").selectExpr(*by, "road_id", "lon", "lat", "z", "m.seg as seg", "m.t as t", "m.az as az")


def split_roads_at_points(roads: DataFrame, points: DataFrame, tolerance_deg: float = 0.00012, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Roads with a vertex at every point that lies on one of their pieces; a point without height takes the piece's."""
    hits = points_on_roads(roads, points, tolerance_deg, by=by).dropDuplicates([*by, "road_id", "lon", "lat"])
    return insert_points(roads, hits.selectExpr(*by, "road_id", "seg", "t", f"{G.pt('lon', 'lat', 'if(z <> 0, z, az)')} as p"), by=by)
