"""Map features to typed roads, buildings and metro, and the roads' lane profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geo import js_round
from ..functions.polygons import mean_of
from ..session import pin


def classified_ways(ways: DataFrame) -> DataFrame:
    """Ways with ``reason`` (null: import it)."""
    df = pin(ways, _highway=T.highway_value(), _access=T.motor_access())
    return df.withColumn("reason", F.expr(T.way_refusal("_highway", "_access"))).drop("_highway", "_access")


def non_drivable_roads(roads: DataFrame) -> DataFrame:
    """Imported roads whose recorded tags the importer would now refuse, with the reason."""
    tagged = roads.filter("type = 'road' and coalesce(tags['highway'], '') <> ''")
    return classified_ways(tagged).filter("reason is not null")


def ways_to_roads(ways: DataFrame) -> DataFrame:
    """Road attributes of every importable way."""
    df = classified_ways(ways).filter("reason is null").drop("reason")
    classes = " ".join(f"when '{h}' then '{c}'" for h, c in T.CLASS_OF_HIGHWAY.items())
    df = pin(df, _hw="tags['highway']", road_class=f"case tags['highway'] {classes} else 'local' end",
             is_one_way="coalesce(tags['oneway'] in ('yes', '1', '-1'), false) or tags['highway'] in ('motorway', 'motorway_link')",
             _lanes=T.leading_int(T.tag("lanes")), _fwd=T.leading_int(T.tag("lanes:forward")), _bwd=T.leading_int(T.tag("lanes:backward")),
             _speed=T.leading_int("tags['maxspeed']"), layer=f"coalesce({T.leading_int(T.tag('layer'))}, 0)",
             bridge=T.is_bridge(), tunnel=T.is_tunnel(), roundabout="coalesce(tags['junction'] = 'roundabout', false)",
             _link="endswith(tags['highway'], '_link')")
    # Lanes per direction: own tags first, then the total, then the road's kind.
    big = "_hw in ('motorway', 'trunk')"
    narrow = "_link or _hw = 'service'"
    df = pin(df, lanes_a=f"""case when is_one_way then coalesce(_fwd, _lanes, case when {big} then 3 when {narrow} then 1 else 2 end)
            when _fwd is not null then _fwd
            when _bwd is not null then case when _lanes is not null then greatest(1, _lanes - _bwd) else _bwd end
            when _lanes is not null then case when _lanes = 1 then 1 else int(ceil(_lanes / 2)) end
            when {big} then 2 when {narrow} then 1 when road_class = 'highway' then 2 else 1 end""",
             lanes_b=f"""case when is_one_way then 0
            when _bwd is not null then _bwd
            when _fwd is not null then case when _lanes is not null then greatest(1, _lanes - _fwd) else _fwd end
            when _lanes is not null then case when _lanes = 1 then 1 else int(floor(_lanes / 2)) end
            when {big} then 2 when {narrow} then 1 when road_class = 'highway' then 2 else 1 end""")
    speeds = " ".join(f"when '{c}' then {v}" for c, v in T.SPEED_OF_CLASS.items())
    df = pin(df, lane_count="lanes_a + lanes_b", has_divider="(road_class = 'highway' and not is_one_way) or coalesce(tags['divider'] = 'yes', false)",
             has_footpath=f"not ({big})", speed_limit=f"coalesce(nullif(_speed, 0), case road_class {speeds} else {T.OTHER_SPEED} end)")
    return df.selectExpr(
        *[c for c in df.columns if not c.startswith("_")],
        f"lane_count * {T.LANE_CAPACITY} as capacity",
        f"lane_count * {T.LANE_WIDTH}D + case when has_divider then {T.DIVIDER_WIDTH}D else 0D end"
        f" + case when has_footpath then {2 * T.FOOTPATH_WIDTH}D else 0D end as width",
        f"coalesce({T.tag('name')}, concat(upper(substr(_hw, 1, 1)), substr(_hw, 2), ' Road')) as name")


#: Category of a building by (tag, values), in order of precedence; no values
#: means any. What no row names takes the usage, a school for educational use.
BUILDING_CATEGORIES = [
    ("IT", [("office", ["it"]), ("building", ["it"]), ("amenity", ["it"])]),
    ("school", [("building", ["school"]), ("amenity", ["school"])]),
    ("college", [("building", ["college", "university"]), ("amenity", ["college", "university"])]),
    ("hospital", [("building", ["hospital"]), ("amenity", ["hospital"])]),
    ("hotel", [("building", ["hotel"]), ("tourism", ["hotel"])]),
    ("office", [("building", ["office"]), ("office", [])]),
    ("retail", [("building", ["retail"]), ("shop", [])]),
    ("commercial", [("building", ["commercial"]), ("amenity", ["bank"])]),
    ("residential", [("building", ["residential", "apartments", "house"])]),
    ("mixed_use", [("building", ["mixed_use"])]),
    ("industrial", [("building", ["industrial", "manufactory"])]),
    ("government", [("building", ["government"]), ("amenity", ["townhall"])]),
]
#: Usage by tag values, likewise.
BUILDING_USAGES = [
    ("educational", [("amenity", ["school"]), ("building", ["school"])]),
    ("commercial", [("building", ["commercial", "office"])]),
    ("industrial", [("building", ["industrial", "manufactory"])]),
]
#: People and visitors per head of population by category, else the last entry.
BUILDING_SHARES = {
    "employees": ({"office": 0.9, "IT": 0.9, "commercial": 0.5, "retail": 0.5, "school": 0.15, "college": 0.15, "hospital": 0.4}, 0),
    "students": ({"school": 0.85, "college": 0.85}, 0),
    "patients": ({"hospital": 0.6}, 0),
    "visitors_per_day": ({"residential": 0.1, "office": 0.15, "IT": 0.15, "commercial": 2.0, "retail": 2.0, "school": 0.05, "college": 0.05, "hospital": 1.2}, 10),
}
#: Storeys of untagged buildings, people and parking per storey, height of a storey, demand per head.
STOREYS, PER_STOREY, PARKING_PER_STOREY, STOREY_M, WATER, POWER = 3, 12, 2, 3, 135, 5


def _first_match(table: list, other: str) -> str:
    """First name in a table of (name, [(tag, values)]) that a feature's tags fit."""
    def fits(tag: str, values: list) -> str:
        return f"tags['{tag}'] in ({', '.join(repr(v) for v in values)})" if values else f"{T.tag(tag)} is not null"
    return "case " + " ".join(f"when coalesce({' or '.join(fits(t, v) for t, v in rules)}, false) then '{name}'" for name, rules in table) + f" else {other} end"


def features_to_buildings(features: DataFrame) -> DataFrame:
    """Use, size, people and demand of every building feature from its tags."""
    df = pin(features, _levels=T.leading_int("tags['building:levels']"), _tall=T.leading_number("tags['height']"), usage=_first_match(BUILDING_USAGES, "'residential'"))
    df = pin(df, category=_first_match(BUILDING_CATEGORIES, "if(usage = 'educational', 'school', usage)"), floors=f"if(_levels > 0, _levels, {STOREYS})")
    df = pin(df, height=f"if(_tall > 0, _tall, floors * {STOREY_M}D)", population=f"floors * {PER_STOREY}")

    def people(name: str) -> str:
        shares, other = BUILDING_SHARES[name]
        pairs = ", ".join(f"'{c}', {v}D" for c, v in shares.items())
        return f"coalesce({js_round(f'population * map({pairs})[category]')}, {other}) as {name}"
    return df.selectExpr(*features.columns, "usage", "category", "floors", "height", "population", "if(category = 'residential', population, 0) as residents",
                         *(people(n) for n in BUILDING_SHARES), f"population * {WATER} as water_demand", f"population * {POWER} as electricity_demand", f"floors * {PARKING_PER_STOREY} as parking")


def features_to_metro(features: DataFrame) -> DataFrame:
    """Metro stations and lines. ``features``: element_type, geometry (array of points), tags."""
    level = "try_cast(tags['layer'] as double)"
    df = pin(features, _station="coalesce(tags['railway'] = 'station', false)",
             elevation=f"""case when tags['tunnel'] = 'yes' or {level} < 0 then -6 when tags['bridge'] = 'yes' or {level} > 0 then 12 else 0 end""",
             _sub="coalesce(tags['railway'] = 'subway', false)",
             _build="coalesce(tags['railway'] = 'construction' and tags['construction'] = 'subway', false)")
    good = ("(_station and element_type in ('node', 'way') and size(geometry) > 0)"
            " or (not _station and element_type = 'way' and size(geometry) >= 2 and (_sub or _build))")
    return df.filter(good).selectExpr(
        *features.columns, "case when _station then 'metro_station' else 'metro_line' end as type", "elevation",
        "case when _station then null when _sub then 'operational' else 'under_construction' end as status",
        f"case when _station then {mean_of('geometry', 'lon')} end as lon", f"case when _station then {mean_of('geometry', 'lat')} end as lat")


# ---- lane profiles (sections) -------------------------------------------------

def default_profile(roads: DataFrame) -> DataFrame:
    """Lane profile of a road without sections: lanes per direction and footpaths per side."""
    df = roads.selectExpr("*", "coalesce(nullif(lane_count, 0), 2) as _n", "coalesce(nullif(footpath_width, 0D), 1.5D) as _foot",
                          "has_divider or coalesce(divider_width, 0D) > 0 as has_median")
    df = df.selectExpr("*", "case when is_one_way then _n else ceil(_n / 2) end as lanes_a",
                       "case when is_one_way then 0L else floor(_n / 2) end as lanes_b")
    right = "case when has_footpath and (has_median or lanes_b > 0) then _foot else 0D end"
    return df.selectExpr(*roads.columns, "has_median", "lanes_a", "lanes_b", "case when has_footpath then _foot else 0D end as left_footpath",
                         f"case when lanes_b > 0 or is_one_way or not has_median then {right} else 0D end as right_footpath")


def synced_properties(roads: DataFrame) -> DataFrame:
    """Road totals that follow from its first section (``a``, ``b`` carriageways, ``median``)."""
    b_lanes, foot_r = "coalesce(b.lanes, 0)", "coalesce(case when b is not null then b.right_footpath else a.right_footpath end, 0D)"
    df = roads.selectExpr("*", f"a.lanes + {b_lanes} as new_lane_count", f"{b_lanes} = 0 as new_one_way", f"{foot_r} as _right",
                          "coalesce(median, 0D) as divider_width")
    return df.selectExpr(*roads.columns, "new_lane_count", "new_one_way", "divider_width",
                         f"a.lanes * a.lane_width + {b_lanes} * coalesce(b.lane_width, 0D) + divider_width + a.left_footpath + _right as new_width",
                         "a.left_footpath > 0 or _right > 0 as new_has_footpath", "greatest(a.left_footpath, _right) as new_footpath_width",
                         f"new_lane_count * {T.LANE_CAPACITY} as new_capacity")


def complete_coverage(sections: str, n: str) -> str:
    """Whether sections join end to end from the first vertex to the last of ``n``."""
    whole = "_s.first = floor(_s.first) and _s.last = floor(_s.last)"
    joined = f"_s.first = coalesce(get({sections}, _i - 1).last, 0D) and _s.last >= _s.first and ({n} <= 1 or _s.last > _s.first)"
    checks = f"transform({sections}, (_s, _i) -> coalesce({whole} and {joined}, false))"
    return f"(size({sections}) > 0 and forall({checks}, _c -> _c) and element_at({sections}, -1).last = greatest(0, {n} - 1))"


def repaired_sections(roads: DataFrame, sections: str = "sections", n: str = "vertex_count") -> DataFrame:
    """Sections that cover the road: sorted by start, last wins on one start, each ends at the next.

    Complete ones stay as they are. Adds ``repaired`` and ``changed``. Section fields
    are ``first``, ``last`` and anything else.
    """
    last = f"double(greatest(0, {n} - 1))"
    usable = f"_s.first is not null and _s.last is not null and _s.last >= _s.first and ({last} = 0 or _s.first < {last})"
    df = pin(roads, _ok=complete_coverage(sections, n),
             _c=f"array_sort(filter(transform({sections}, (_s, _i) -> case when {usable} then named_struct("
                f"'at', greatest(0D, double(floor(_s.first))), 'i', _i, 's', _s) end), _x -> _x is not null))")
    df = pin(df, _u="filter(_c, (_x, _i) -> get(_c, _i + 1) is null or get(_c, _i + 1).at <> _x.at)")
    fixed = (f"transform(_u, (_x, _i) -> named_struct('first', case when _i = 0 then 0D else _x.at end,"
             f" 'last', coalesce(get(_u, _i + 1).at, {last}), 'lanes', _x.s.lanes))")
    return pin(df, repaired=f"case when _ok then {sections} else {fixed} end").selectExpr(
        *roads.columns, "repaired", f"not (repaired <=> {sections}) as changed")


def insert_vertex(roads: DataFrame) -> DataFrame:
    """Insert point ``p`` as vertex ``at``; every section still covers the same stretch.

    A section that starts at the very first vertex keeps it, and appending extends
    the section that ended there.
    """
    first = "case when _s.first > 0 and _s.first >= at then _s.first + 1 else _s.first end"
    last = "case when _s.last >= at or (at = size(coordinates) and _s.last = at - 1) then _s.last + 1 else _s.last end"
    return roads.selectExpr(
        "*", "concat(slice(coordinates, 1, at), array(p), slice(coordinates, at + 1, size(coordinates))) as new_coordinates",
        f"transform(sections, _s -> named_struct('first', {first}, 'last', {last}, 'lanes', _s.lanes)) as new_sections")


def retained_indices(before: str, after: str) -> str:
    """Where each point of ``before`` is found again in ``after``, in order; null if one is missing.

    Both are arrays of ``struct<lon,lat>``. Every point is looked for behind the match of
    the one before it.
    """
    pos = f"int(array_position(slice({after}, _acc.seen + 1, greatest(size({after}), 1)), _p))"
    return (f"aggregate({before}, named_struct('seen', 0, 'idx', cast(array() as array<int>), 'ok', true), (_acc, _p) -> named_struct("
            f"'seen', _acc.seen + {pos}, 'idx', concat(_acc.idx, array(_acc.seen + {pos} - 1)), 'ok', _acc.ok and {pos} > 0),"
            f" _acc -> case when _acc.ok then _acc.idx end)")


def remapped_sections(roads: DataFrame) -> DataFrame:
    """Repaired sections of roads whose line was densified or thinned since they were drawn.

    Where the sections cover the source line and its vertices are all still there, their
    ends move to the vertices' new places first; then they are repaired as usual.
    Columns: ``sections``, ``source_coordinates``, ``coordinates``, ``geometry_modified``.
    """
    def flat(c):
        return f"transform({c}, _p -> struct(_p.lon as lon, _p.lat as lat))"
    df = pin(roads, _b=flat("source_coordinates"), _a=flat("coordinates"))
    df = pin(df, _idx=f"case when not geometry_modified and {complete_coverage('sections', 'size(source_coordinates)')}"
                      f" and not {complete_coverage('sections', 'size(coordinates)')} then {retained_indices('_b', '_a')} end")
    moved = "transform(sections, _s -> named_struct('first', double(get(_idx, int(_s.first))), 'last', double(get(_idx, int(_s.last))), 'lanes', _s.lanes))"
    df = df.withColumn("_sections", F.expr(f"case when _idx is not null then {moved} else sections end")).withColumn("_n", F.expr("size(coordinates)"))
    return repaired_sections(df, "_sections", "_n").selectExpr(*roads.columns, "repaired")
