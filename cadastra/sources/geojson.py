"""GeoJSON feature collections to city objects with the importer's defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pin

SCHEMA = ("type string, features array<struct<id:string,properties:string,geometry:struct<type:string,coordinates:string>>>")

# Defaults per object type. ``zero_counts`` holds those kept when 0 is given.
DEFAULTS = {
    "road": {"roadClass": ("string", "'local'"), "width": ("double", "8D"), "laneCount": ("int", "2"), "laneWidth": ("double", "3.5D"),
             "dividerWidth": ("double", "2D"), "footpathWidth": ("double", "1.5D"), "speedLimit": ("double", "50D"), "trafficCapacity": ("int", "1200")},
    "building": {"usageType": ("string", "'residential'"), "floors": ("int", "4"), "population": ("int", "40"), "height": ("double", "15D"),
                 "parkingSpaces": ("int", "10"), "waterDemand": ("double", "6000D"), "electricityDemand": ("double", "240D"),
                 "constructionYear": ("int", "2020"), "state": ("string", "'existing'"), "source": ("string", "'municipal'")},
    "junction": {"signalTiming": ("int", "90")},
    "flyover": {"roadClass": ("string", "'arterial'"), "width": ("double", "19D"), "laneCount": ("int", "4"), "laneWidth": ("double", "3.5D"),
                "dividerWidth": ("double", "2D"), "footpathWidth": ("double", "1.5D"), "speedLimit": ("double", "80D"),
                "elevation": ("double", "6D"), "pierSpacing": ("double", "30D")},
    "utility": {"utilityType": ("string", "'water'"), "depth": ("double", "1.5D"), "capacity": ("double", "100D")},
}
FLAGS = {"road": {"hasDivider": "false", "hasFootpath": "true", "isOneWay": "false"}, "junction": {"hasSignals": "true", "hasPedestrianCrossing": "true"},
         "flyover": {"hasDivider": "true", "hasFootpath": "true", "isOneWay": "false"}, "building": {}, "utility": {}}


def read_geojson(spark: SparkSession, path: str, scenario_id: str, multi_line: bool = True) -> DataFrame:
    """All features as (id, type, name, layer, scenario, coordinates, properties text).

    A point becomes a line of one point, a polygon its outer ring; types the planner
    does not import are dropped.
    """
    df = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(path).filter("type = 'FeatureCollection'")
    df = df.selectExpr("inline(features)")
    kinds = ", ".join(f"'{k}'" for k in DEFAULTS)
    df = pin(df, obj_type="coalesce(nullif(get_json_object(properties, '$.type'), ''), 'building')",
             obj_id="coalesce(nullif(id, ''), get_json_object(properties, '$.id'))",
             line="""case geometry.type when 'Point' then array(from_json(geometry.coordinates, 'array<double>'))
                 when 'LineString' then from_json(geometry.coordinates, 'array<array<double>>')
                 when 'Polygon' then get(from_json(geometry.coordinates, 'array<array<array<double>>>'), 0) end""")
    point = "named_struct('lon', get(_a, 0), 'lat', get(_a, 1), 'z', coalesce(get(_a, 2), 0D))"
    return df.filter(f"obj_type in ({kinds})").selectExpr(
        "obj_id as id", "obj_type as type", "coalesce(nullif(get_json_object(properties, '$.name'), ''), concat(initcap(obj_type), ' #', substr(obj_id, 1, 4))) as name",
        "coalesce(nullif(get_json_object(properties, '$.layerId'), ''), concat(obj_type, 's')) as layer_id", f"'{scenario_id}' as scenario_id",
        f"transform(line, _a -> {point}) as coordinates", "coalesce(properties, '{}') as properties")


def typed_features(features: DataFrame, type_: str) -> DataFrame:
    """Features of one type with missing (or zero and empty) properties set to their defaults."""
    schema = ", ".join([f"{k} {t}" for k, (t, _) in DEFAULTS[type_].items()] + [f"{k} boolean" for k in FLAGS[type_]]
                       + (["category string", "residents int", "employees int", "parkingCapacity int"] if type_ == "building" else []))
    df = pin(features.filter(F.col("type") == type_), p=f"from_json(properties, '{schema}')")
    cols = []
    for k, (t, d) in DEFAULTS[type_].items():
        empty = "''" if t == "string" else "0"
        cols.append(f"coalesce(nullif(p.{k}, {empty}), {d}) as {k}")
    cols += [f"coalesce(p.{k}, {d}) as {k}" for k, d in FLAGS[type_].items()]
    out = df.selectExpr("id", "name", "layer_id", "scenario_id", "coordinates", "p as _p", *cols)
    if type_ == "building":
        out = out.selectExpr("*", "coalesce(nullif(_p.category, ''), case when usageType = 'commercial' then 'commercial' else 'residential' end) as category",
                             "coalesce(_p.residents, case when usageType = 'residential' then population else 0 end) as residents",
                             "coalesce(_p.employees, case when usageType = 'commercial' then int(floor(population * 0.8D + 0.5D)) else 0 end) as employees",
                             "coalesce(_p.parkingCapacity, parkingSpaces) as parkingCapacity")
    return out.drop("_p")
