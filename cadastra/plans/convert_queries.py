"""Map extract and tag conversion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geo import densify, fixed, pt
from ..operators import convert as cv
from ..session import materialise, scratch_path
from ..sources import citydata as city
from ..sources import osm
from ..sources.citydata import cte, sql_fixed, sql_hav
from .registry import query

_KINDS = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "motorway_link", "trunk_link",
          "secondary_link", "track", "footway", "cycleway", "living_street", "unclassified", " Primary ", "primary_link", "tertiary_link"]


def _pick(by: str, values: dict[int, str]) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


# Tags of the derived ways, one expression per key, readable by both engines.
WAY_TAGS = {
    "highway": _pick("ord % 20", dict(enumerate(_KINDS))), "oneway": _pick("size % 9", {0: "yes", 1: "-1", 2: "no", 3: "1"}),
    "lanes": _pick("ord % 7", {0: "4", 1: "3;4", 2: "1", 3: "x", 4: "5"}), "lanes:forward": _pick("ord % 11", {0: "2", 1: "3"}),
    "lanes:backward": _pick("ord % 13", {0: "1", 1: "2"}), "maxspeed": _pick("ord % 5", {0: "40", 1: "50 mph", 2: "none", 3: "0"}),
    "layer": _pick("ord % 17", {0: "1", 1: "-1", 2: "5"}), "bridge": _pick("ord % 19", {0: "yes", 1: "viaduct", 2: "no"}),
    "tunnel": _pick("ord % 23", {0: "yes", 1: "building_passage"}), "junction": _pick("ord % 29", {0: "roundabout"}),
    "access": _pick("ord % 10", {0: "no", 1: "yes", 2: " Private;yes", 3: "permissive"}),
    "motor_vehicle": _pick("ord % 12", {0: "no", 1: "designated;x", 2: ""}), "vehicle": _pick("ord % 14", {0: "no"}),
    "area": _pick("ord % 31", {0: "yes"}), "divider": _pick("ord % 8", {3: "yes"}), "name": "CASE WHEN ord % 2 = 0 THEN p_name END",
}
BUILDING_TAGS = {
    "building": _pick("ord % 17", dict(enumerate(["yes", "school", "college", "hospital", "hotel", "office", "retail", "commercial",
                                                  "apartments", "mixed_use", "industrial", "government", "it", "manufactory", "house", "shed"]))),
    "amenity": _pick("ord % 19", {0: "school", 1: "bank", 2: "townhall", 3: "university"}), "office": _pick("ord % 23", {0: "it", 1: "company"}),
    "shop": _pick("ord % 29", {0: "books"}), "tourism": _pick("ord % 31", {0: "hotel"}),
    "building:levels": _pick("ord % 6", {0: "7", 1: "12.5", 2: "0", 3: "two"}), "height": _pick("ord % 5", {0: "21.5 m", 1: "-3", 2: "40"}),
}
METRO_TAGS = {
    "railway": _pick("ord % 5", {0: "station", 1: "subway", 2: "construction", 3: "subway"}), "construction": _pick("ord % 4", {0: "subway", 2: "subway"}),
    "station": _pick("ord % 2", {0: "subway"}), "tunnel": _pick("ord % 7", {0: "yes"}), "bridge": _pick("ord % 6", {0: "yes"}),
    "layer": _pick("ord % 11", {0: "-2", 1: "1", 2: "x"}),
}


def _tag_map(tags: dict) -> str:
    return "map_filter(map(" + ", ".join(f"'{k}', {v}" for k, v in tags.items()) + "), (_k, _v) -> _v is not null) as tags"


def _tag_cols(tags: dict) -> str:
    return ", ".join(f'{v} AS "{k}"' for k, v in tags.items())


def tagged_ways(spark, sf):
    return city.roads(spark, sf).selectExpr("city", "ord as id", "coordinates", _tag_map(WAY_TAGS))


_W = cte("roads") + f""", w0 AS (SELECT ord AS id, {_tag_cols(WAY_TAGS)} FROM roads),
w1 AS (SELECT *, nullif(lower(trim(highway)), '') AS hw, coalesce(nullif(lower(trim(split_part(motor_vehicle, ';', 1))), ''),
  nullif(lower(trim(split_part(vehicle, ';', 1))), ''), nullif(lower(trim(split_part(access, ';', 1))), '')) AS acc FROM w0),
w2 AS (SELECT *, CASE WHEN hw IS NULL THEN 'untagged' WHEN area = 'yes' THEN 'area'
  WHEN hw = 'track' THEN CASE WHEN coalesce(acc IN ('yes', 'designated', 'permissive', 'destination'), false) THEN NULL ELSE 'closed_track' END
  WHEN hw IN ('footway', 'cycleway') THEN 'other_way' WHEN acc = 'no' THEN 'no_access' END AS reason FROM w1)
"""


@query("b02_vehicle_highways", _W + "SELECT id, coalesce(highway NOT IN ('footway', 'cycleway', ' Primary '), false) AS vehicle FROM w0")
def vehicle_highways(spark, sf):
    return tagged_ways(spark, sf).selectExpr("id", f"{T.is_vehicle_highway()} as vehicle")


@query("b03_motor_access", _W + "SELECT id, acc AS access FROM w1")
def access(spark, sf):
    return tagged_ways(spark, sf).selectExpr("id", f"{T.motor_access()} as access")


@query("b04_classified_ways", _W + "SELECT id, reason IS NULL AS included, reason FROM w2")
def classified(spark, sf):
    return cv.classified_ways(tagged_ways(spark, sf)).selectExpr("id", "reason is null as included", "reason")


@query("b06_non_drivable_roads", _W + "SELECT id, reason FROM w2 WHERE reason IS NOT NULL AND highway IS NOT NULL")
def non_drivable(spark, sf):
    return cv.non_drivable_roads(tagged_ways(spark, sf).selectExpr("*", "'road' as type")).select("id", "reason")


@query("d15_import_report", _W + """SELECT 'roads' AS category, coalesce(reason, 'added') AS outcome, count(*) AS ways FROM w2 GROUP BY ALL""")
def import_report(spark, sf):
    return cv.classified_ways(tagged_ways(spark, sf)).groupBy(F.lit("roads").alias("category"), F.expr("coalesce(reason, 'added')").alias("outcome")).agg(
        F.expr("count(1)").alias("ways"))


_ROADS_SQL = _W + """, w3 AS (SELECT *, CASE WHEN highway IN ('motorway', 'trunk', 'motorway_link') THEN 'highway' WHEN highway IN ('primary', 'secondary', 'primary_link') THEN 'arterial'
  WHEN highway IN ('tertiary', 'tertiary_link') THEN 'collector' ELSE 'local' END AS road_class, coalesce(oneway IN ('yes', '1', '-1'), false) OR highway IN ('motorway', 'motorway_link') AS ow,
  CASE lanes WHEN '4' THEN 4 WHEN '3;4' THEN 3 WHEN '1' THEN 1 WHEN '5' THEN 5 END AS tl, CAST("lanes:forward" AS INT) AS tf, CAST("lanes:backward" AS INT) AS tb,
  CASE WHEN highway IN ('motorway', 'trunk') THEN 3 WHEN highway LIKE '%_link' OR highway = 'service' THEN 1 ELSE 2 END AS d1,
  CASE WHEN highway IN ('motorway', 'trunk') THEN 2 ELSE 1 END AS d2 FROM w2 WHERE reason IS NULL),
w4 AS (SELECT *, CASE WHEN ow THEN coalesce(tf, tl, d1) WHEN tf IS NOT NULL THEN tf WHEN tb IS NOT NULL AND tl IS NOT NULL THEN greatest(1, tl - tb) WHEN tb IS NOT NULL THEN tb
   WHEN tl = 1 THEN 1 WHEN tl IS NOT NULL THEN (tl + 1) // 2 ELSE d2 END AS la,
  CASE WHEN ow THEN 0 WHEN tf IS NOT NULL AND tb IS NOT NULL THEN tb WHEN tf IS NOT NULL AND tl IS NOT NULL THEN greatest(1, tl - tf) WHEN tf IS NOT NULL THEN tf WHEN tb IS NOT NULL THEN tb
   WHEN tl = 1 THEN 1 WHEN tl IS NOT NULL THEN tl // 2 ELSE d2 END AS lb,
  (road_class = 'highway' AND NOT ow) OR coalesce(divider = 'yes', false) AS div, highway NOT IN ('motorway', 'trunk') AS foot FROM w3)
SELECT id, coalesce(name, concat(upper(substr(highway, 1, 1)), substr(highway, 2), ' Road')) AS name, road_class, ow AS is_one_way, la AS lanes_a, lb AS lanes_b, la + lb AS lane_count,
  (la + lb) * 1000 AS capacity, (la + lb) * 3.5::DOUBLE + CASE WHEN div THEN 2 ELSE 0 END + CASE WHEN foot THEN 3 ELSE 0 END AS width,
  CASE maxspeed WHEN '40' THEN 40 WHEN '50 mph' THEN 50 ELSE CASE road_class WHEN 'highway' THEN 100 WHEN 'arterial' THEN 60 ELSE 50 END END AS speed_limit,
  coalesce(CAST(layer AS INT), 0) AS layer, coalesce(bridge <> 'no', false) AS bridge, coalesce(tunnel = 'yes', false) AS tunnel, junction IS NOT NULL AS roundabout FROM w4"""


@query("b07_ways_to_roads", _ROADS_SQL)
def ways_to_roads(spark, sf):
    return cv.ways_to_roads(tagged_ways(spark, sf)).select(
        "id", "name", "road_class", "is_one_way", "lanes_a", "lanes_b", "lane_count", "capacity", "width", "speed_limit", "layer", "bridge", "tunnel", "roundabout")


@query("h13_tag_numbers", _W + """SELECT id, CASE lanes WHEN '4' THEN 4 WHEN '3;4' THEN 3 WHEN '1' THEN 1 WHEN '5' THEN 5 END AS lanes,
  CASE maxspeed WHEN '40' THEN 40 WHEN '50 mph' THEN 50 WHEN '0' THEN 0 END AS speed, CAST(layer AS INT) AS layer FROM w0""")
def tag_numbers(spark, sf):
    return tagged_ways(spark, sf).selectExpr("id", f"{T.leading_int(T.tag('lanes'))} as lanes", f"{T.leading_int(T.tag('maxspeed'))} as speed",
                                             f"{T.leading_int(T.tag('layer'))} as layer")


@query("b18_bridge_levels", _W + """SELECT id, CASE WHEN coalesce(bridge <> 'no', false) THEN least(3, greatest(1, coalesce(CAST(layer AS INT), 0))) ELSE 0 END AS up,
  CASE WHEN coalesce(bridge <> 'no', false) OR tunnel = 'building_passage' THEN 0 WHEN CAST(layer AS INT) < 0 THEN 1 WHEN tunnel = 'yes' THEN 1 ELSE 0 END AS down FROM w0""")
def bridge_levels(spark, sf):
    df = tagged_ways(spark, sf).selectExpr("id", "tags", f"coalesce({T.leading_int(T.tag('layer'))}, 0) as layer", f"{T.is_bridge()} as bridge")
    return df.selectExpr("id", f"{T.bridge_level()} as up", f"{T.cut_level()} as down")


_BT = cte("buildings") + f""", f AS (SELECT ord AS id, {_tag_cols(BUILDING_TAGS)} FROM buildings),
g AS (SELECT *, coalesce(building, '') AS b, coalesce(amenity, '') AS am, CASE "building:levels" WHEN '7' THEN 7 WHEN '12.5' THEN 12 ELSE 3 END AS floors FROM f),
h AS (SELECT *, floors * 12 AS population, CASE height WHEN '21.5 m' THEN 21.5::DOUBLE WHEN '40' THEN 40 ELSE floors * 3 END AS tall,
  CASE WHEN am = 'school' OR b = 'school' THEN 'educational' WHEN b IN ('commercial', 'office') THEN 'commercial' WHEN b IN ('industrial', 'manufactory') THEN 'industrial' ELSE 'residential' END AS usage FROM g),
c AS (SELECT *, CASE WHEN office = 'it' OR b = 'it' THEN 'IT' WHEN usage = 'educational' THEN 'school' WHEN b IN ('college', 'university') OR am = 'university' THEN 'college' WHEN b = 'hospital' THEN 'hospital'
  WHEN b = 'hotel' OR tourism IS NOT NULL THEN 'hotel' WHEN b = 'office' OR office IS NOT NULL THEN 'office' WHEN b = 'retail' OR shop IS NOT NULL THEN 'retail' WHEN b = 'commercial' OR am = 'bank' THEN 'commercial'
  WHEN b IN ('apartments', 'house') THEN 'residential' WHEN b = 'mixed_use' THEN 'mixed_use' WHEN b IN ('industrial', 'manufactory') THEN 'industrial' WHEN b = 'government' OR am = 'townhall' THEN 'government'
  ELSE usage END AS category FROM h)
SELECT id, usage, category, floors, tall AS height, population, CASE WHEN category = 'residential' THEN population ELSE 0 END AS residents,
  CAST(floor(population * CASE WHEN category IN ('office', 'IT') THEN 0.9::DOUBLE WHEN category IN ('commercial', 'retail') THEN 0.5::DOUBLE WHEN category IN ('school', 'college') THEN 0.15::DOUBLE WHEN category = 'hospital' THEN 0.4::DOUBLE ELSE 0::DOUBLE END + 0.5) AS BIGINT) AS employees,
  CAST(floor(CASE WHEN category IN ('school', 'college') THEN population * 0.85::DOUBLE ELSE 0 END + 0.5) AS BIGINT) AS students,
  CAST(floor(CASE WHEN category = 'hospital' THEN population * 0.6::DOUBLE ELSE 0 END + 0.5) AS BIGINT) AS patients,
  CAST(floor(CASE WHEN category = 'residential' THEN population * 0.1::DOUBLE WHEN category IN ('office', 'IT') THEN population * 0.15::DOUBLE WHEN category IN ('commercial', 'retail') THEN population * 2.0::DOUBLE
   WHEN category IN ('school', 'college') THEN population * 0.05::DOUBLE WHEN category = 'hospital' THEN population * 1.2::DOUBLE ELSE 10 END + 0.5) AS BIGINT) AS visitors_per_day,
  population * 135 AS water_demand, population * 5 AS electricity_demand, floors * 2 AS parking FROM c"""


@query("b08_features_to_buildings", _BT)
def to_buildings(spark, sf):
    df = city.derive(spark, sf, "buildings").selectExpr("ord as id", _tag_map(BUILDING_TAGS))
    return cv.features_to_buildings(df).drop("tags")


_MT = cte("sites") + f""", f AS (SELECT ord AS id, CASE WHEN ord % 3 = 0 THEN 'node' ELSE 'way' END AS et, ox, oy, j, {_tag_cols(METRO_TAGS)} FROM sites),
g AS (SELECT *, coalesce(railway = 'station', false) AS st, CASE WHEN tunnel = 'yes' OR layer = '-2' THEN -6 WHEN bridge = 'yes' OR layer = '1' THEN 12 ELSE 0 END AS elevation FROM f)"""


@query("b09_features_to_metro", _MT + f""" SELECT id, CASE WHEN st THEN 'metro_station' ELSE 'metro_line' END AS type, elevation,
  CASE WHEN st THEN NULL WHEN railway = 'subway' THEN 'operational' ELSE 'under_construction' END AS status,
  {sql_fixed("CASE WHEN st THEN CASE WHEN et = 'node' THEN ox / 1e7 ELSE (ox / 1e7 + (ox + j * 900) / 1e7) / 2 END END", 6)} AS lon FROM g
  WHERE st OR (et = 'way' AND (railway = 'subway' OR (railway = 'construction' AND construction = 'subway')))""")
def to_metro(spark, sf):
    line = f"case when ord % 3 = 0 then array({pt('ox / 1e7', 'oy / 1e7')}) else array({pt('ox / 1e7', 'oy / 1e7')}, {pt('(ox + j * 900) / 1e7', '(oy + 4000) / 1e7')}) end"
    df = city.derive(spark, sf, "sites").selectExpr("ord as id", "case when ord % 3 = 0 then 'node' else 'way' end as element_type", f"{line} as geometry", _tag_map(METRO_TAGS))
    return cv.features_to_metro(df).selectExpr("id", "type", "elevation", "status", f"{fixed('lon', 6)} as lon")


@query("b05_metro_features", _MT + """ SELECT id, coalesce(railway = 'subway' OR (railway = 'construction' AND construction = 'subway') OR (st AND station = 'subway'), false) AS metro FROM g""")
def metro_features(spark, sf):
    return city.derive(spark, sf, "sites").selectExpr("ord as id", _tag_map(METRO_TAGS)).selectExpr("id", f"{T.is_metro()} as metro")


@query("b11_default_sections", cte("roads") + """SELECT road_id, med AS has_median, CASE WHEN one_way THEN lane_count ELSE (lane_count + 1) // 2 END AS lanes_a, b AS lanes_b,
  CASE WHEN foot THEN 1.5::DOUBLE ELSE 0 END AS left_footpath, CASE WHEN foot AND (b > 0 OR (med AND one_way)) THEN 1.5::DOUBLE ELSE 0 END AS right_footpath FROM (
  SELECT *, size % 3 = 0 AS med, ord % 4 <> 0 AS foot, CASE WHEN one_way THEN 0 ELSE lane_count // 2 END AS b FROM roads)""")
def default_sections(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr("road_id", "lane_count", "one_way as is_one_way", "false as has_divider",
                                                    "case when size % 3 = 0 then 2D end as divider_width", "ord % 4 <> 0 as has_footpath", "0D as footpath_width")
    return cv.default_profile(df).select("road_id", "has_median", "lanes_a", "lanes_b", "left_footpath", "right_footpath")


@query("b10_synced_road_properties", cte("roads") + """SELECT road_id, lane_count + lb AS lane_count, lb = 0 AS one_way, (lane_count + lb) * 1000 AS capacity,
  lane_count * 3.5::DOUBLE + lb * 3.0::DOUBLE + m + 1.5::DOUBLE + CASE WHEN ord % 3 = 0 THEN 0 ELSE 2 END AS width,
  CASE WHEN ord % 3 = 0 THEN 1.5::DOUBLE ELSE 2 END AS footpath_width FROM (SELECT *, CASE WHEN ord % 5 = 0 THEN 0 ELSE size % 3 END AS lb, CASE WHEN size % 4 = 0 THEN 2 ELSE 0 END AS m FROM roads)""")
def synced(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr(
        "road_id", "named_struct('lanes', lane_count, 'lane_width', 3.5D, 'left_footpath', 1.5D, 'right_footpath', case when ord % 3 = 0 then 0D else 2D end) as a",
        "case when ord % 5 <> 0 then named_struct('lanes', size % 3, 'lane_width', 3D, 'right_footpath', case when ord % 3 = 0 then 0D else 2D end) end as b",
        "case when size % 4 = 0 then 2D end as median")
    return cv.synced_properties(df).selectExpr("road_id", "new_lane_count as lane_count", "new_one_way as one_way", "new_capacity as capacity",
                                               "new_width as width", "new_footpath_width as footpath_width")


@query("b12_osm_topology", cte("roads") + "SELECT road_id, imported AND size % 8 <> 1 AND start_gap = 0 AND ord % 6 <> 0 AS osm_topology FROM roads")
def osm_topology(spark, sf):
    df = city.roads(spark, sf).selectExpr(
        "road_id", "imported", "size % 8 = 1 as geometry_modified", "coordinates",
        f"case when ord % 6 = 0 then array({pt('(xa + 5) / 1e7', 'ya / 1e7')}, coordinates[2]) when ord % 6 < 3 then array(coordinates[0], coordinates[2]) end as source_coordinates")
    return df.selectExpr("road_id", """imported and not geometry_modified and (source_coordinates is null or (
        coordinates[0] = source_coordinates[0] and element_at(coordinates, -1) = element_at(source_coordinates, -1))) as osm_topology""")


def _sections(*rows) -> str:
    return "array(" + ", ".join(f"named_struct('first', {a}D, 'last', {b}D, 'lanes', {n})" for a, b, n in rows) + ")"


# Whole, with a gap, overlapping and unordered, repeated start, and out of range.
_SECT = (f"case ord % 5 when 0 then {_sections((0, 4, 2), (4, 10, 3))} when 1 then {_sections((0, 3, 2), (6, 10, 3))}"
         f" when 2 then {_sections((6, 10, 3), (0, 8, 2))} when 3 then {_sections((0, 5, 1), (0, 7, 2), (7.6, 10, 3))}"
         f" else {_sections((2, 4, 1), (12, 14, 2), (5, 3, 4))} end as sections")


@query("e06_repaired_sections", cte("roads") + """SELECT road_id, CASE ord % 5 WHEN 0 THEN '0-4:2 4-10:3' WHEN 1 THEN '0-6:2 6-10:3' WHEN 2 THEN '0-6:2 6-10:3' WHEN 3 THEN '0-7:2 7-10:3' ELSE '0-10:1' END AS ranges,
  ord % 5 <> 0 AS changed FROM roads""")
def repaired(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr("road_id", "11 as vertex_count", _SECT)
    return cv.repaired_sections(df).selectExpr(
        "road_id", "array_join(transform(repaired, s -> concat(bigint(s.first), '-', bigint(s.last), ':', s.lanes)), ' ') as ranges", "changed")


@query("h17_insert_vertex", cte("roads") + """SELECT road_id, 4::BIGINT AS points, CASE k WHEN 0 THEN '0-2 2-3' WHEN 1 THEN '0-2 2-3' WHEN 2 THEN '0-1 1-3' ELSE '0-1 1-3' END AS ranges, k AS inserted_at
  FROM (SELECT road_id, CAST(ord % 4 AS INT) AS k FROM roads)""")
def insert_vertex(spark, sf):
    df = city.roads(spark, sf).selectExpr("road_id", "coordinates", "int(ord % 4) as at", f"{pt('7D', '7D')} as p",
                                          f"{_sections((0, 1, 1), (1, 2, 2))} as sections")
    return cv.insert_vertex(df).selectExpr(
        "road_id", "bigint(size(new_coordinates)) as points", "array_join(transform(new_sections, s -> concat(bigint(s.first), '-', bigint(s.last))), ' ') as ranges",
        "array_position(transform(new_coordinates, c -> c.lon), 7D) - 1 as inserted_at").withColumn("inserted_at", F.expr("int(inserted_at)"))


# ---- map extract: the derived roads written as XML, then read back -------------

# Fixed value: rows of a file of the extract. A file of XML is read whole by one task, so its size must not grow with the city.
EXTRACT_ROWS = 50_000


def _extract(spark, sf, buildings: bool = False):
    """The derived city as a map extract in the shared folder; with ``buildings`` their outlines too, as closed ways."""
    path = scratch_path(spark, "extract")
    w = city.derive(spark, sf, "roads")
    ids = [f"({x} * 1000000000 + {y})" for x, y in (("xa", "ya"), ("xm", "ym"), ("xb", "yb"))]
    # One way in fifty names a node the extract lacks.
    refs = f"transform(array({ids[0]}, case when ord % 50 = 49 then -ord - 1 else {ids[1]} end, {ids[2]}), r -> struct(r as _ref))"
    tags = "transform(map_entries(tags), e -> struct(e.key as _k, e.value as _v)) as tag"
    ways = w.selectExpr("ord as _id", f"{refs} as nd", _tag_map(WAY_TAGS)).selectExpr("_id", "nd", tags)
    pts = w.selectExpr("ord", "inline(array(struct(xa as x, ya as y), struct(xm as x, ym as y), struct(xb as x, yb as y)))")
    if buildings:
        h = city.derive(spark, sf, "buildings")
        corners = "array(struct(x0 as x, y0 as y), struct(x1 as x, y0 as y), struct(x1 as x, y1 as y), struct(x0 as x, y1 as y))"
        pts = pts.unionByName(h.selectExpr("cast(null as bigint) as ord", f"inline({corners})"))
        outline = f"transform(concat({corners}, slice({corners}, 1, 1)), c -> struct(c.x * 1000000000 + c.y as _ref)) as nd"
        ways = ways.unionByName(h.selectExpr(f"ord + {BUILDING_WAYS} as _id", outline, "array(struct('building' as _k, 'yes' as _v)) as tag"))
    pts = pts.groupBy("x", "y").agg(F.min("ord").alias("o"))
    nodes = pts.selectExpr("x * 1000000000 + y as _id", "y / 1e7 as _lat", "x / 1e7 as _lon",
                           "case when o % 40 = 7 then array(struct('highway' as _k, 'traffic_signals' as _v)) end as tag")
    for tag, df in (("node", nodes), ("way", ways)):
        df.write.format("xml").option("rootTag", "osm").option("rowTag", tag).option("maxRecordsPerFile", EXTRACT_ROWS).save(f"{path}/{tag}")
    return osm.read_osm_xml(spark, [f"{path}/node", f"{path}/way"])


_X = cte("roads") + "," + city.ROAD_POINTS + f""", w0 AS (SELECT ord AS id, *, {_tag_cols(WAY_TAGS)} FROM roads),
nodes AS (SELECT x, y, min(ord) AS o FROM road_points GROUP BY x, y),
lines AS (SELECT id, highway, least(xa, xm, xb) AS x0, least(ya, ym, yb) AS y0, greatest(xa, xm, xb) AS x1, greatest(ya, ym, yb) AS y1 FROM w0 WHERE ord % 50 <> 49)"""
BUILDING_WAYS = 1_000_000_000_000


@query("a09_read_osm_xml", _X + """SELECT 'node' AS element, count(*) AS rows_, CAST(sum(x) AS BIGINT) AS checksum FROM nodes
  UNION ALL SELECT 'way', count(*), CAST(sum(ord) AS BIGINT) FROM roads""")
def read_xml(spark, sf):
    nodes, ways, _ = _extract(spark, sf)
    n = nodes.selectExpr("'node' as element", "floor(lon * 1e7 + 0.5D) as v")
    return n.unionByName(ways.selectExpr("'way' as element", "id as v")).groupBy("element").agg(F.expr("count(1)").alias("rows_"), F.sum("v").alias("checksum"))


@query("a10_assemble_ways", _X + "SELECT id, x0, y1, 3::BIGINT AS points FROM lines")
def assemble(spark, sf):
    nodes, ways, _ = _extract(spark, sf)
    return osm.assemble_ways(ways, nodes).selectExpr("id", "floor(box.min_lon * 1e7 + 0.5D) as x0", "floor(box.max_lat * 1e7 + 0.5D) as y1", "bigint(size(geometry)) as points")


_ROADWAYS = "highway NOT IN ('footway', 'cycleway', ' Primary ')"
_XB = _X.replace(cte("roads"), cte("roads", "buildings"), 1)


def _index(spark, sf):
    """Folder of the index of the whole extract: its box is that of the data."""
    nodes, ways, relations = _extract(spark, sf, buildings=True)
    nodes = materialise(nodes, "nodes")
    box, path = osm.extract_box(nodes), scratch_path(spark, "index")
    osm.write_map_index(osm.build_map_index(nodes, ways, box), path, box)
    return path


@query("a11_build_map_index", _XB + f"""SELECT 'ways' AS category, count(*) AS features FROM lines WHERE {_ROADWAYS}
  UNION ALL SELECT 'signals', count(*) FROM nodes WHERE o % 40 = 7 UNION ALL SELECT 'buildings', count(*) FROM buildings UNION ALL SELECT 'metro', 0""")
def build_index(spark, sf):
    path = _index(spark, sf)
    held = spark.read.schema(osm.META).parquet(f"{path}/meta")
    return held.select("category", "features")


def _query_boxes(spark, sf):
    return city.derive(spark, sf, "stations").selectExpr(
        "city", "ord", "named_struct('min_lon', (x - 12000) / 1e7, 'min_lat', (y - 9000) / 1e7, 'max_lon', (x + 12000) / 1e7, 'max_lat', (y + 9000) / 1e7) as box")


_BOXES = cte("roads", "stations") + """, boxes AS (SELECT city, ord, x - 12000 AS x0, x + 12000 AS x1, y - 9000 AS y0, y + 9000 AS y1 FROM stations),
 lines AS (SELECT city, ord AS id, road_id, least(xa, xm, xb) AS x0, least(ya, ym, yb) AS y0, greatest(xa, xm, xb) AS x1, greatest(ya, ym, yb) AS y1 FROM roads)"""


@query("a13_read_index_boxes", _BOXES + " SELECT DISTINCT l.id FROM lines l JOIN boxes b ON l.x1 >= b.x0 AND l.x0 <= b.x1 AND l.y1 >= b.y0 AND l.y0 <= b.y1")
def read_boxes(spark, sf):
    from ..functions.geo import bounds
    features = city.roads(spark, sf).selectExpr("ord as id", f"{bounds('coordinates')} as box")
    return osm.read_index(features, _query_boxes(spark, sf)).select("id")


@query("c01_features_in_boxes", _BOXES + " SELECT l.id, b.ord AS box_id FROM lines l JOIN boxes b ON l.city = b.city AND l.x1 >= b.x0 AND l.x0 <= b.x1 AND l.y1 >= b.y0 AND l.y0 <= b.y1")
def in_boxes(spark, sf):
    from ..functions.geo import bounds
    from ..operators.spatial import join_boxes
    features = city.roads(spark, sf).selectExpr("city", "ord as id", f"{bounds('coordinates')} as a_box")
    return join_boxes(features, _query_boxes(spark, sf).selectExpr("city", "ord as box_id", "box as b_box"), 0.002).select("id", "box_id")


@query("a14_index_status", cte("roads", "buildings", "sites") + _X[len(cte("roads")):] + f""", span AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM (SELECT x, y FROM road_points UNION ALL SELECT x0, y0 FROM buildings UNION ALL SELECT x1, y1 FROM buildings))
 SELECT true AS available, 'buildings,metro,roads,signals' AS capabilities, (SELECT count(*) FROM lines WHERE {_ROADWAYS}) AS ways, (SELECT count(*) FROM nodes WHERE o % 40 = 7) AS signals, (SELECT count(*) FROM buildings) AS buildings, 0 AS metro,
  {sql_fixed('x0 / 1e7', 7)} AS min_lon, {sql_fixed('y1 / 1e7', 7)} AS max_lat, (SELECT bool_and(ox >= x0 AND oy >= y0 AND ox + 90000 <= x1 AND oy + 60000 <= y1) FROM sites) AS covered FROM span""")
def status(spark, sf):
    held = osm.index_status(spark, _index(spark, sf))
    boxes = city.derive(spark, sf, "sites").selectExpr("named_struct('min_lon', ox / 1e7, 'min_lat', oy / 1e7, 'max_lon', (ox + 90000) / 1e7, 'max_lat', (oy + 60000) / 1e7) as box")
    return held.join(osm.covers(boxes, held), F.lit(True)).select("available", "capabilities", "ways", "signals", "buildings", "metro", "min_lon", "max_lat", "covered")


@query("h16_remapped_sections", cte("roads") + f""", n AS (SELECT road_id, ord, greatest(1, CAST(ceil({sql_hav('xa / 1e7', 'ya / 1e7', 'xm / 1e7', 'ym / 1e7')} / 10) AS BIGINT)) AS n1, greatest(1, CAST(ceil({sql_hav('xm / 1e7', 'ym / 1e7', 'xb / 1e7', 'yb / 1e7')} / 10) AS BIGINT)) AS n2 FROM roads)
 SELECT road_id, CASE WHEN ord % 4 = 3 THEN concat('0-1:1 1-', n1 + n2, ':2') ELSE concat('0-', n1, ':1 ', n1, '-', n1 + n2, ':2') END AS ranges FROM n""")
def remapped(spark, sf):
    """Profiles drawn on the three-point line, moved to its densified form; edited ones cannot be moved."""
    df = city.roads(spark, sf).selectExpr(
        "road_id", "coordinates as source_coordinates", f"transform({densify('coordinates', 10)}, p -> named_struct('lon', p.lon, 'lat', p.lat, 'z', p.z)) as coordinates",
        f"{_sections((0, 1, 1), (1, 2, 2))} as sections", "ord % 4 = 3 as geometry_modified")
    return cv.remapped_sections(df).selectExpr("road_id", "array_join(transform(repaired, s -> concat(bigint(s.first), '-', bigint(s.last), ':', s.lanes)), ' ') as ranges")
