"""Origin-destination demand: zone matching, residuals, gravity matrix, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import demand as D
from ..functions.geo import bounds, box, degrees_apart, haversine, js_round, planar
from ..functions.polygons import in_polygon, in_reach, mean_of, shoelace
from ..session import materialise, pin
from .graph import reversed_edges, shortest
from .polygons import clip_rings
from .spatial import join_points, k_nearest_global, nearest_global

ZONE_TILE_DEG = 0.002


def _with_profile_terms(buildings: DataFrame) -> DataFrame:
    """What the activity profile says, worked out once per building."""
    df = pin(buildings, _gen="activityProfile.tripGeneration", _departs=D.clock_period("activityProfile.peakDepartureStart"),
             _arrives=D.clock_period("activityProfile.peakArrivalStart"), _split=D.profile_split("activityProfile.modeSplit"))
    return pin(df, _own=D.has_trip_overrides("_gen", "_departs", "_arrives"))


def explicit_buildings(buildings: DataFrame) -> DataFrame:
    df = _with_profile_terms(buildings)
    return df.filter(D.is_explicit("_own", "_split")).drop("_gen", "_departs", "_arrives", "_split", "_own")


def building_trip_events(buildings: DataFrame) -> DataFrame:
    """One row per building, role and period with trips and mode split."""
    df = _with_profile_terms(buildings)
    homes = "coalesce(residents, 0) >= coalesce(employees, 0)"
    df = pin(df, _leave=f"coalesce(_departs, case when {homes} then 'AM_Peak' else 'PM_Peak' end)",
             _arrive=f"coalesce(_arrives, case when {homes} then 'PM_Peak' else 'AM_Peak' end)",
             _mode=f"coalesce(_split, {D.default_split()})")
    df = pin(df, _events=D.trip_events("_gen", "_own", "_leave", "_arrive"))
    return df.selectExpr("city", "id", "coordinates", "_mode as split", "inline(_events)").filter("trips > 0")


def first_zone(points: DataFrame, zones: DataFrame, key: str = "id", *, by: Sequence[str] = ("city",),
               mode: str = "plain") -> DataFrame:
    """Zone of each point: the first in list order whose ring holds it."""
    shapes = zones.select(*by, "zone_id", F.col("ord").alias("zone_ord"), "boundary", F.expr(bounds("boundary")).alias("box"))
    hits = join_points(points.select(*by, key, "lon", "lat"), shapes, ZONE_TILE_DEG, by=by)
    hits = hits.filter(f"{in_reach('lon', 'lat')} and {in_polygon('lon', 'lat', 'boundary', mode)}")
    return hits.groupBy(*by, key).agg(F.min(F.struct("zone_ord", "zone_id"))["zone_id"].alias("zone_id"))


def points_in_zones(points: DataFrame, zones: DataFrame, keep: Sequence[str], *, by: Sequence[str] = ("city",),
                    mode: str = "plain") -> DataFrame:
    """Every (point, zone) with the point inside the zone's ring."""
    shapes = zones.select(*by, "zone_id", "boundary", F.expr(bounds("boundary")).alias("box"))
    hits = join_points(points.select(*by, *keep, "lon", "lat"), shapes, ZONE_TILE_DEG, by=by)
    return hits.filter(f"{in_reach('lon', 'lat')} and {in_polygon('lon', 'lat', 'boundary', mode)}").select(*by, *keep, "zone_id")


def with_mean_point(buildings: DataFrame) -> DataFrame:
    return buildings.selectExpr("*", f"{mean_of('coordinates', 'lon')} as lon", f"{mean_of('coordinates', 'lat')} as lat")


def zone_building_totals(buildings: DataFrame, zones: DataFrame) -> DataFrame:
    """Residents and employees of the buildings in each zone; 0 for empty zones."""
    matched = first_zone(with_mean_point(buildings), zones).join(
        buildings.select("city", "id", "residents", "employees"), ["city", "id"])
    totals = matched.groupBy("city", "zone_id").agg(F.sum("residents").alias("residents"), F.sum("employees").alias("employees"))
    return zones.join(totals, ["city", "zone_id"], "left").withColumns(
        {"residents": F.expr("coalesce(residents, 0L)"), "employees": F.expr("coalesce(employees, 0L)")})


def zone_residuals(zone_totals: DataFrame) -> DataFrame:
    """People and jobs of a zone beyond its modelled buildings, never below zero."""
    return zone_totals.selectExpr("*", "greatest(0L, total_population - residents) as residual_population",
                                  "greatest(0L, total_employment - employees) as residual_employment")


def demand_ends(events: DataFrame, residuals: DataFrame, gateways: DataFrame) -> DataFrame:
    """Origins and destinations of every period.

    ``gateways`` has map columns ``inbound`` and ``outbound`` (period -> flow) and
    ``split``. Zones take part in the two peaks only.
    """
    b = events.selectExpr("city", "role", "period", "id", "'building' as type", "element_at(coordinates, 1).lon as lon",
                          "element_at(coordinates, 1).lat as lat", "trips as volume", "split")
    pop, emp = f"residual_population * {D.ZONE_RESIDENT_TRIPS}D", f"residual_employment * {D.ZONE_EMPLOYEE_TRIPS}D"
    peaks = ", ".join(
        f"named_struct('role', '{role}', 'period', '{period}', 'volume', {amount} * {D.PERIOD_SHARE[period]}D)"
        for role, period, amount in (("origin", "AM_Peak", pop), ("destination", "PM_Peak", pop),
                                     ("destination", "AM_Peak", emp), ("origin", "PM_Peak", emp)))
    z = residuals.selectExpr("city", f"inline(array({peaks}))", "zone_id as id", "'zone' as type",
                             f"{mean_of('boundary', 'lon')} as lon", f"{mean_of('boundary', 'lat')} as lat",
                             f"{D.default_split()} as split")
    out = b.unionByName(z)
    for role, column in (("origin", "inbound"), ("destination", "outbound")):
        out = out.unionByName(gateways.selectExpr("city", f"'{role}' as role", f"explode({column}) as (period, volume)",
                                                  "gateway_id as id", "'gateway' as type", "lon", "lat", "split"))
    return out.filter("volume > 0")


#: Origins of one group that a task takes.
ORIGINS_PER_TASK = 2000


def _gravity_sides(ends: DataFrame, keys: list[str], salts: int | None, metric=haversine):
    """Salted origins, replicated destinations, the pair weight and the self-pair test.

    Unless ``salts`` is given, a group is spread by its number of origins, so that a city that
    grows with the table gets more tasks.
    """
    if salts is None:
        spread = ends.filter("role = 'origin'").groupBy(*keys).agg(F.expr(f"cast(ceil(count(1) / {ORIGINS_PER_TASK}) as bigint)").alias("salts"))
        ends = ends.join(spread, keys)
    else:
        ends = ends.withColumn("salts", F.lit(salts).cast("bigint"))
    o = ends.filter("role = 'origin'").selectExpr(
        *keys, "id as origin_id", "type as origin_type", "lon as o_lon", "lat as o_lat", "volume", "split",
        "pmod(xxhash64(id), salts) as salt")
    d = ends.filter("role = 'destination'").selectExpr(
        *keys, "id as destination_id", "type as destination_type", "lon as d_lon", "lat as d_lat",
        "volume as attraction", "explode(sequence(0L, salts - 1L)) as salt")
    metres = f"greatest(100D, {metric('o_lon', 'o_lat', 'd_lon', 'd_lat')})"
    return o, d, f"attraction / power({metres}, 2)", "origin_id <> destination_id"


def gravity_pairs(ends: DataFrame, *, by: Sequence[str] = ("city",), salts: int | None = None) -> DataFrame:
    """Whole trips between places of one group and period.

    weight = attraction / max(100 m, distance)^2; an origin's trips are shared by
    weight over all destinations but itself and rounded half up. The sum of weights
    is taken first, with partial sums before any shuffle, so only pairs that still
    carry a trip (at most twice the origin's volume) ever leave a task. Salting
    spreads a large group over several tasks.
    """
    keys = [*by, "period"]
    o, d, weight, differs = _gravity_sides(ends, keys, salts)
    totals = (o.drop("volume", "split", "origin_type").join(d.drop("destination_type"), [*keys, "salt"]).filter(differs)
              .groupBy(*keys, "origin_id").agg(F.expr(f"sum({weight})").alias("total_weight")).filter("total_weight > 0"))
    trips = js_round(f"volume * ({weight} / total_weight)")
    return (o.join(totals, [*keys, "origin_id"]).join(d, [*keys, "salt"]).filter(differs)
            .withColumn("pair_trips", F.expr(trips)).filter("pair_trips > 0")
            .select(*keys, "origin_id", "origin_type", "destination_id", "destination_type", "pair_trips", "split"))


def od_matrix(ends: DataFrame, *, by: Sequence[str] = ("city",), salts: int | None = None) -> DataFrame:
    """Trips per origin, destination, period and mode; rounded again per mode, zeros vanish."""
    pairs = gravity_pairs(ends, by=by, salts=salts)
    modes = ", ".join(f"named_struct('mode', '{m}', 'trips', {js_round(f'pair_trips * split.{m}')})" for m in D.MODES)
    return pairs.selectExpr(*by, "period", "origin_id", "origin_type", "destination_id", "destination_type",
                            f"inline(array({modes}))").filter("trips > 0")


def od_summary(matrix: DataFrame) -> DataFrame:
    """Trips by period, by mode and overall, in one pass over the matrix."""
    return (matrix.groupBy("period", "mode").agg(F.sum("trips").alias("trips")).withColumn("m", F.col("mode"))
            .groupingSets([["period"], ["mode"], []], "period", "mode")
            .agg(F.sum("trips").alias("trips"), F.expr(
                "sum(case when m in ('car', 'two_wheeler', 'bus') then trips else 0 end)").alias("vehicle_trips")))


def gravity_shares(ends: DataFrame, *, by: Sequence[str] = ("city",), salts: int | None = None) -> DataFrame:
    """Per origin: number of candidate destinations, sum of shares (1) and the largest share."""
    keys = [*by, "period"]
    o, d, weight, differs = _gravity_sides(ends, keys, salts)
    agg = (o.join(d, [*keys, "salt"]).filter(differs).groupBy(*keys, "origin_id").agg(
        F.expr("count(1)").alias("pairs"), F.expr(f"sum({weight})").alias("total"), F.expr(f"max({weight})").alias("top")))
    return agg.select(*keys, "origin_id", "pairs", (F.col("total") / F.col("total")).alias("share_sum"),
                      (F.col("top") / F.col("total")).alias("top_share"))


def demand_totals(explicit: DataFrame, residuals: DataFrame) -> DataFrame:
    """One row: explicit, residual and zone totals of people and jobs."""
    b = explicit.agg(F.sum(F.coalesce("residents", "population", F.lit(0))).alias("explicit_population"),
                     F.sum(F.coalesce("employees", F.lit(0))).alias("explicit_employment"))
    z = residuals.agg(F.sum("residual_population").alias("residual_population"),
                      F.sum("residual_employment").alias("residual_employment"),
                      F.sum("total_population").alias("zone_population"), F.sum("total_employment").alias("zone_employment"))
    return b.join(z, F.lit(True))


def zone_counts(placed: DataFrame, zones: DataFrame) -> DataFrame:
    """Roads, buildings and gateways per zone from (kind, id, zone_id) rows; zones without any count 0."""
    n = placed.groupBy("zone_id").agg(*[F.expr(f"count_if(kind = '{k}')").alias(f"{k}s") for k in ("road", "building", "gateway")])
    return zones.select("zone_id").join(n, "zone_id", "left").na.fill(0)


# ---- study rectangles -----------------------------------------------------------

STUDY_KINDS = {"car": "split.car", "two_wheeler": "split.two_wheeler", "bus_auto": "split.bus + split.other"}


def study_ends(buildings: DataFrame, zones: DataFrame, gateways: DataFrame, boxes: DataFrame, period: str) -> DataFrame:
    """Origins and destinations of one period inside each city's study rectangle.

    All buildings count, at their entrance or vertex mean. A zone's residual, taken
    against every building inside it, is shared by the part of its area in the
    rectangle and placed at the mean of the clipped ring's vertices.
    """
    b = with_mean_point(buildings)
    inside = "lon >= min_lon and lon <= max_lon and lat >= min_lat and lat <= max_lat"
    # Rectangles are one row per study, so this join prunes early.
    near = b.join(boxes, "city").filter(inside)
    events = building_trip_events(near.drop("min_lon", "min_lat", "max_lon", "max_lat")).filter(F.col("period") == period)
    events = events.join(near.select("city", "id", "lon", "lat"), ["city", "id"]).selectExpr(
        "city", "role", "id", "lon", "lat", "trips as volume", "split")
    held = points_in_zones(b, zones, ["id", "residents", "employees"]).groupBy("zone_id").agg(
        F.expr("sum(coalesce(residents, 0))").alias("residents"), F.expr("sum(coalesce(employees, 0))").alias("employees"))
    z = clip_rings(zones.join(boxes, "city").withColumn("_full", F.expr(shoelace("boundary"))))
    z = z.join(held, "zone_id", "left").filter("size(clipped) > 0").selectExpr(
        "*", f"least(1D, {shoelace('clipped')} / greatest(1e-20D, _full)) as part").filter("part > 0")
    share = D.PERIOD_SHARE[period]
    pop = f"greatest(0L, total_population - coalesce(residents, 0L)) * part * {D.ZONE_RESIDENT_TRIPS}D * {share}D"
    emp = f"greatest(0L, total_employment - coalesce(employees, 0L)) * part * {D.ZONE_EMPLOYEE_TRIPS}D * {share}D"
    roles = {"AM_Peak": ("origin", "destination"), "PM_Peak": ("destination", "origin")}.get(period)
    out = events
    if roles:
        out = out.unionByName(z.selectExpr(
            "city", f"inline(array(named_struct('role', '{roles[0]}', 'volume', {pop}), named_struct('role', '{roles[1]}', 'volume', {emp})))", "zone_id as id",
            f"{mean_of('clipped', 'lon')} as lon", f"{mean_of('clipped', 'lat')} as lat", f"{D.default_split()} as split"))
    g = gateways.join(boxes, "city").filter(inside)
    for role, column in (("origin", "inbound"), ("destination", "outbound")):
        out = out.unionByName(g.selectExpr("city", f"'{role}' as role", "gateway_id as id", "lon", "lat", f"{column}['{period}'] as volume", "split"))
    return out.filter("volume > 0").selectExpr("city", f"'{period}' as period", "role", "id", "'' as type", "lon", "lat", "volume", "split")


def top_destinations(ends: DataFrame, k: int = 32, *, by: Sequence[str] = ("city",), salts: int | None = None) -> DataFrame:
    """The ``k`` strongest destinations of every origin and their share of its flow.

    The rank limit is applied in each task before rows move, so at most ``k``
    candidates per origin and task are exchanged.
    """
    keys = [*by, "period"]
    o, d, weight, differs = _gravity_sides(ends, keys, salts, planar)
    pairs = o.join(d, [*keys, "salt"]).filter(differs).selectExpr(*keys, "origin_id", "destination_id", "volume", "split", f"{weight} as weight")
    rank = F.row_number().over(W.partitionBy(*keys, "origin_id").orderBy(F.desc("weight"), "destination_id"))
    best = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.withColumn("share", F.col("weight") / F.sum("weight").over(W.partitionBy(*keys, "origin_id")))


def study_demand(ends: DataFrame, k: int = 32, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Vehicles per hour by kind between places of a study rectangle (not rounded)."""
    kinds = ", ".join(f"named_struct('kind', '{n}', 'vph', volume * share * ({s}))" for n, s in STUDY_KINDS.items())
    return top_destinations(ends, k, by=by).selectExpr(*by, "origin_id", "destination_id", f"inline(array({kinds}))").filter("vph > 0")


# ---- zone access ------------------------------------------------------------------

# Weight of a node by the class of its last listed road.
ACCESS_MULTIPLIER = {"highway": 3.0, "arterial": 2.0, "collector": 1.2}


def zone_access_weights(zones: DataFrame, nodes: DataFrame, edges: DataFrame, *, by: Sequence[str] = ("city",), nearest: int = 3) -> DataFrame:
    """Share of each zone's traffic per node: nodes inside it, else the three nearest.

    ``edges``: ``src``, ``dst``, ``ord_key``, ``capacity``, ``road_class``. The class that
    counts is that of the edge listed last at the node.
    """
    inside = points_in_zones(nodes, zones, ["node"])
    empty = zones.join(inside.select("zone_id").distinct(), "zone_id", "left_anti").selectExpr(
        *by, "zone_id", f"{mean_of('boundary', 'lon')} as zlon", f"{mean_of('boundary', 'lat')} as zlat")
    ranked = nearest_k(empty, nodes, nearest, by=by)
    at = edges.selectExpr("ord_key", "capacity", "road_class", "explode(array_distinct(array(src, dst))) as node").groupBy("node").agg(
        F.expr("greatest(1000, max(capacity))").alias("cap"), F.expr("max_by(road_class, ord_key)").alias("cls"))
    m = "case cls " + " ".join(f"when '{c}' then {v}D" for c, v in ACCESS_MULTIPLIER.items()) + " when 'local' then 0.5D else 1D end"
    w = inside.unionByName(ranked).join(at.hint("merge"), "node", "left").selectExpr(*by, "zone_id", "node", f"{m} * ln(1 + coalesce(cap, 1000)) as weight")
    return w.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy(*by, "zone_id")))


def nearest_k(centres: DataFrame, nodes: DataFrame, k: int, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """The ``k`` nodes nearest to each centre (``zlon``, ``zlat``) of its own group."""
    at = centres.selectExpr(*by, "zone_id", "zlon as lon", "zlat as lat")
    found = k_nearest_global(at, nodes, k, haversine("lon", "lat", "plon", "plat"), point_key=["zone_id"], place_key="node", by=by)
    return found.select(*by, "node", "zone_id")


# ---- routing readiness ---------------------------------------------------------------

# Fixed value: nodes per group that are searched both ways before any other.
READINESS_PIVOTS = 3

def nearest_seed_nodes(places: DataFrame, nodes: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Node nearest to each place in raw degrees (``id``, ``node``)."""
    n = nodes.selectExpr(*by, "node", "lon as nlon", "lat as nlat", f"{box('lon', 'lat', 'lon', 'lat')} as box")
    rank = f"struct({degrees_apart('lon', 'lat', 'nlon', 'nlat')} as d, node)"
    return nearest_global(places, n, rank, point_key=["id"], by=by, degrees=True).select(*by, "id", "best.node")


def route_readiness(pairs: DataFrame, seeded: DataFrame, edges: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Per group: OD pairs, those with a valid origin and destination, routed and failed ones.

    Every pair is checked, not a sample. Pairs are counted by their nodes first. A few
    pivots per group, searched both ways, settle nearly all: a pair that leads to a pivot and on
    is routed; one that starts where a pivot leads but ends where it does not, or ends where
    a pivot is reached from but starts elsewhere, is not. Only start nodes with a pair left over are
    searched by themselves. A pair whose two ends share one node counts as failed.
    """
    p = pairs.select(*by, "origin_id", "destination_id").distinct()
    p = p.join(seeded.selectExpr(*by, "id as origin_id", "node as a"), [*by, "origin_id"], "left").join(
        seeded.selectExpr(*by, "id as destination_id", "node as b"), [*by, "destination_id"], "left")
    p = materialise(p.groupBy(*by, "a", "b").agg(F.expr("count(1)").alias("n")), "od_nodes")
    e = edges.selectExpr("src", "dst", "0D as w", "edge_id")
    degree = e.selectExpr("inline(array(struct(src as a, 1 as o, 0 as i), struct(dst as a, 0 as o, 1 as i)))").groupBy("a").agg(F.expr("sum(o) * sum(i)").alias("ways"))
    best = W.partitionBy(*by).orderBy(F.desc("ways"), "a")
    starts = p.filter("a is not null").select(*by, "a").distinct().join(degree, "a").withColumn("rank", F.row_number().over(best))
    pivots = materialise(starts.filter(F.col("rank") <= READINESS_PIVOTS).selectExpr(*by, "a as k"), "pivots")
    seeds = pivots.selectExpr("k", "k as node", "0D as d").distinct()
    onward = shortest(e, seeds).select("k", "node", F.lit(True).alias("fed"))
    back = shortest(reversed_edges(e), seeds).select("k", "node", F.lit(True).alias("feeds"))
    seen = onward.join(back, ["k", "node"], "full_outer").na.fill(False)
    # What each node is to the pivots of its group.
    ties = materialise(pivots.join(seen, "k").groupBy(*by, "node").agg(
        F.expr("collect_set(k) filter (where fed)").alias("fed_by"), F.expr("collect_set(k) filter (where feeds)").alias("feeds_to")), "ties")
    at = lambda c: ties.selectExpr(*by, f"node as {c}", f"fed_by as {c}_fed", f"feeds_to as {c}_feeds")
    known = p.filter("a <> b").join(at("a").hint("merge"), [*by, "a"], "left").join(at("b").hint("merge"), [*by, "b"], "left")
    for c in ("a_fed", "a_feeds", "b_fed", "b_feeds"):
        known = known.withColumn(c, F.coalesce(c, F.array().cast(dict(known.dtypes)[c])))
    known = materialise(known.selectExpr(*by, "a", "b", """case when arrays_overlap(a_feeds, b_fed) then true
        when size(array_except(a_fed, b_fed)) > 0 or size(array_except(b_feeds, a_feeds)) > 0 then false end as linked"""), "settled")
    left = known.filter("linked is null").select(*by, "a", "b")
    reach = shortest(e, left.selectExpr("a as k", "a as node", "0D as d").distinct())
    late = left.join(reach.selectExpr("k as a", "node as b"), ["a", "b"]).selectExpr(*by, "a", "b", "true as linked")
    linked = known.filter("linked").unionByName(late)
    ok = p.join(linked.hint("merge"), [*by, "a", "b"], "left").selectExpr("*", "coalesce(linked, false) as ok")
    some = lambda where, name: F.expr(f"coalesce(sum(n) filter (where {where}), 0)").alias(name)
    return ok.groupBy(*by).agg(F.sum("n").alias("od_pairs"), some("a is not null", "valid_origins"), some("b is not null", "valid_destinations"),
                               some("ok", "routed"), some("not ok", "failed"))
