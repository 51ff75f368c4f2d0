"""The city object store: raw rows with JSON geometry and properties, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import citydata
from ..session import pin

# Object types and which of them carry a single point.
OBJECT_TYPES = ("road", "building", "junction", "flyover", "utility", "metro_line", "metro_station",
                "zone", "gateway", "metro_flyover")
POINT_TYPES = ("junction", "metro_station", "gateway", "utility")

SCENARIO_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("year", T.IntegerType())])

BUILDING_PROPERTIES = (
    "category string, usageType string, source string, residents bigint, employees bigint, population bigint, "
    "waterDemand double, electricityDemand double, floors int, height double, "
    "activityProfile struct<peakDepartureStart:string,peakArrivalStart:string,"
    "tripGeneration:struct<dailyTrips:double,amPeakTrips:double,pmPeakTrips:double>,"
    "modeSplit:struct<car:double,twoWheeler:double,bus:double,metro:double,walk:double,other:double>>,"
    "accessPoints struct<vehicleEntrance:array<double>,mainEntrance:array<double>,serviceEntrance:array<double>>")
ROAD_PROPERTIES = (
    "roadClass string, laneCount int, speedLimit double, isOneWay boolean, trafficCapacity bigint, "
    "osmProvenance struct<osmId:bigint,layer:int,roundabout:boolean,originalTags:map<string,string>>")
ZONE_PROPERTIES = "totalPopulation bigint, totalEmployment bigint"
FLOWS = "struct<AM_Peak:double,PM_Peak:double,Midday:double,Night:double>"
GATEWAY_PROPERTIES = f"inboundFlows {FLOWS}, outboundFlows {FLOWS}"
PROPERTIES = {"building": BUILDING_PROPERTIES, "road": ROAD_PROPERTIES, "zone": ZONE_PROPERTIES,
              "gateway": GATEWAY_PROPERTIES}


LINE_JSON = "to_json(transform(coordinates, _p -> array(_p.lon, _p.lat, _p.z)))"
POINT_JSON = "to_json(array(element_at(coordinates, 1).lon, element_at(coordinates, 1).lat, element_at(coordinates, 1).z))"


def _flows(p: str) -> str:
    return ("named_struct(" + ", ".join(f"'{n}', double({p}_{s})" for s, n in (
        ("am", "AM_Peak"), ("pm", "PM_Peak"), ("mid", "Midday"), ("night", "Night"))) + ")")


BASE_TIME = "timestamp'2026-01-01 00:00:00'"

# Stored form per source: id, type, geometry text, properties text, scenario, update time.
_PROFILE = """case when coalesce(departure_start, arrival_start) is not null
    or coalesce(daily_trips, am_trips, pm_trips, split_car) is not null then named_struct(
    'peakDepartureStart', departure_start, 'peakArrivalStart', arrival_start,
    'tripGeneration', named_struct('dailyTrips', daily_trips, 'amPeakTrips', am_trips, 'pmPeakTrips', pm_trips),
    'modeSplit', case when split_car is not null then named_struct('car', split_car, 'walk', split_walk) end) end"""
_STORED = {
    # A stored text can be damaged; the readers must turn it into an empty object.
    "building": ("building_id", "'building'", LINE_JSON, f"""case when ord % 101 = 100 then '{{broken' else to_json(named_struct(
        'category', category, 'source', source, 'residents', residents, 'employees', employees, 'population', population,
        'floors', floors, 'waterDemand', population * 135D, 'electricityDemand', population * 5D,
        'activityProfile', {_PROFILE})) end""", "'base'", None),
    "road": ("road_id", "'road'", LINE_JSON, """to_json(named_struct('roadClass', road_class, 'laneCount', lane_count,
        'speedLimit', speed_limit, 'isOneWay', one_way, 'trafficCapacity', capacity, 'osmProvenance',
        case when imported then named_struct('osmId', ord, 'layer', layer, 'roundabout', roundabout) end))""", "'base'", None),
    "zone": ("zone_id", "'zone'", LINE_JSON.replace("coordinates", "boundary"),
             "to_json(named_struct('totalPopulation', total_population, 'totalEmployment', total_employment))", "'base'", None),
    "gateway": ("gateway_id", "'gateway'", "to_json(array(lon, lat, 0D))",
                f"to_json(named_struct('inboundFlows', {_flows('in')}, 'outboundFlows', {_flows('out')}))", "'base'", None),
    "proposal": ("id", "type", f"case when type = 'metro_station' then {POINT_JSON} else {LINE_JSON} end",
                 """to_json(named_struct('population', population, 'waterDemand', population * 135D, 'electricityDemand',
        population * 5D, 'category', 'office', 'source', 'manual', 'laneCount', ord % 4 + 1))""", "scenario_id", "updated_at"),
}


def raw_objects(spark: SparkSession, sf_dir: str, parts=("building", "road", "zone", "gateway", "proposal")) -> DataFrame:
    """Stored form of the derived city: every object with its JSON texts.

    ``parts`` plays the role of partition pruning on a store laid out by scenario
    and type: base objects of the named types and, as ``proposal``, all proposals.
    """
    source = {"building": citydata.buildings, "road": citydata.roads, "zone": citydata.zones,
              "gateway": lambda s, d: citydata.points(s, d, "gateways"), "proposal": citydata.proposals}
    out = None
    for part in parts:
        id_, type_, geometry, props, scenario, updated = _STORED[part]
        rows = source[part](spark, sf_dir).selectExpr(
            "city", f"{id_} as id", f"{type_} as type", f"concat({type_}, ' ', {id_}) as name", f"concat({type_}, 's') as layer_id",
            f"{scenario} as scenario_id", f"{geometry} as geometry_geojson", f"{props} as properties_json",
            f"{BASE_TIME} as created_at",
            f"{updated or BASE_TIME} as updated_at")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- A1, A2, A3 -------------------------------------------------------------

def scan_city_objects(objects: DataFrame, scenario_id: str | None = None) -> DataFrame:
    """All objects, or those of one scenario (the store is partitioned by it)."""
    return objects if not scenario_id else objects.filter(F.col("scenario_id") == scenario_id)


def scan_scenarios(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumns({"description": F.expr("coalesce(description, '')"), "year": F.expr("coalesce(year, 2026)")})


def parse_geometry(df: DataFrame) -> DataFrame:
    """``coordinates`` from the JSON text: a bare point or an array of points.

    If either text of a row is unreadable, both become empty.
    """
    is_line = "trim(geometry_geojson) rlike '^\\\\[\\\\s*(\\\\[|\\\\])'"
    one = f"from_json(case when not {is_line} then geometry_geojson end, 'array<double>')"
    many = f"from_json(case when {is_line} then geometry_geojson end, 'array<array<double>>')"
    df = pin(df, _nested=f"coalesce({many}, filter(array({one}), _a -> _a is not null))",
             _ok="try_parse_json(properties_json) is not null")
    readable = "coalesce(_ok and (size(_nested) > 0 or trim(geometry_geojson) = '[]'), false)"
    point = "named_struct('lon', get(_a, 0), 'lat', get(_a, 1), 'z', coalesce(get(_a, 2), 0D))"
    return pin(df, coordinates=f"transform(case when {readable} then _nested else slice(_nested, 1, 0) end, _a -> {point})",
               readable=readable).drop("_nested", "_ok")


def parse_city_objects(raw: DataFrame, type_: str, properties: str | None = None) -> DataFrame:
    """Typed rows of one object type; only its rows are parsed."""
    schema = properties or PROPERTIES[type_]
    df = parse_geometry(raw.filter(F.col("type") == type_))
    df = pin(df, props=f"from_json(case when readable then properties_json else '{{}}' end, '{schema}')")
    base = [c for c in BASE_FIELDS if c in df.columns and c not in ("type", "coordinates")]
    return df.select(*base, "coordinates", "props.*")


BASE_FIELDS = ("city", "id", "type", "name", "layer_id", "scenario_id", "created_at", "updated_at", "coordinates")


def encode_city_objects(df: DataFrame, type_: str) -> DataFrame:
    """Inverse of parsing: base fields stay columns, all others go to the JSON text."""
    rest = [c for c in df.columns if c not in BASE_FIELDS]
    base = [c for c in BASE_FIELDS if c in df.columns and c not in ("coordinates", "type")]
    geometry = POINT_JSON if type_ in POINT_TYPES else LINE_JSON
    return df.selectExpr(*base, f"'{type_}' as type", f"{geometry} as geometry_geojson",
                         f"to_json(struct({', '.join(rest)})) as properties_json")
