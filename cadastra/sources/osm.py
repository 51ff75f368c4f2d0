"""Map extracts in XML: reading, way assembly, and the feature index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geo import bounds, boxes_touch, fixed
from ..session import forget, materialise


TAGS = "tag array<struct<_k:string,_v:string>>"
NODE_SCHEMA = f"_id bigint, _lat double, _lon double, {TAGS}"
WAY_SCHEMA = f"_id bigint, nd array<struct<_ref:bigint>>, {TAGS}"
RELATION_SCHEMA = f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {TAGS}"
TAG_MAP = "map_from_entries(transform(coalesce(tag, array()), _t -> struct(_t._k, _t._v)))"


def read_osm_xml(spark: SparkSession, path: str | Sequence[str]):
    """(nodes, ways, relations) of a map extract; tags become a map."""
    def rows(tag, schema):
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = rows("node", NODE_SCHEMA).selectExpr("_id as id", "_lon as lon", "_lat as lat", f"{TAG_MAP} as tags")
    ways = rows("way", WAY_SCHEMA).selectExpr("_id as id", "transform(nd, _n -> _n._ref) as refs", f"{TAG_MAP} as tags")
    relations = rows("relation", RELATION_SCHEMA).selectExpr(
        "_id as id", "transform(member, _m -> struct(_m._type as type, _m._ref as ref, _m._role as role)) as members", f"{TAG_MAP} as tags")
    return nodes, ways, relations


def assemble_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way geometry in node order at seven decimals; ways lacking a node, or below two, are dropped.

    Nodes and lines unfold far beyond what their files tell the optimizer, so both joins ask for sorted merges.
    """
    refs = ways.selectExpr("id", "posexplode(refs) as (pos, ref)")
    pts = nodes.selectExpr("id as ref", f"{fixed('lon', 7)} as lon", f"{fixed('lat', 7)} as lat")
    line = refs.join(pts.hint("merge"), "ref").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("_p"))
    out = ways.join(line.hint("merge"), "id").filter("size(_p) = size(refs) and size(_p) >= 2")
    return out.selectExpr("id", "tags", "transform(_p, _q -> named_struct('lon', _q.lon, 'lat', _q.lat, 'z', 0D)) as geometry").selectExpr(
        "*", f"{bounds('geometry')} as box")


def extract_box(nodes: DataFrame) -> dict | None:
    """Bounds of an extract's nodes, one row of the whole table; None if there are none."""
    row = nodes.agg(*[F.expr(f"{f}({fixed(c, 7)})").alias(f"{f}_{c}") for f in ("min", "max") for c in ("lon", "lat")]).first()
    return row.asDict() if row["min_lon"] is not None else None


def build_map_index(nodes: DataFrame, ways: DataFrame, box: dict, relations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Roads, signals, buildings and metro of an extract that overlap ``box``.

    A building is a closed way, or the outer rings of a relation, with a ``building`` tag.
    The ways wanted and their lines are written once, so no category parses the extract again.
    """
    from ..operators.rings import assemble_buildings
    b = "named_struct(" + ", ".join(f"'{k}', {v!r}D" for k, v in box.items()) + ")"
    built = "coalesce(tags['building'], 'no') <> 'no'"
    kept = materialise(ways.filter(f"{T.is_vehicle_highway()} or {T.is_metro()} or {built}"), "ways")
    lines = materialise(assemble_ways(kept, nodes).selectExpr("*", f"{b} as _b").filter(boxes_touch("box", "_b")).drop("_b"), "lines")
    forget(kept)
    inside = nodes.filter(f"lon between {box['min_lon']!r}D and {box['max_lon']!r}D and lat between {box['min_lat']!r}D and {box['max_lat']!r}D")
    stations = inside.filter(T.is_metro()).selectExpr(
        "'node' as element_type", "id", "tags", "array(named_struct('lon', lon, 'lat', lat, 'z', 0D)) as geometry",
        "named_struct('min_lon', lon, 'min_lat', lat, 'max_lon', lon, 'max_lat', lat) as box")
    metro = lines.filter(T.is_metro()).selectExpr("'way' as element_type", "id", "tags", "geometry", "box").unionByName(stations)
    buildings = lines.filter(f"{built} and size(geometry) >= 4 and geometry[0] = element_at(geometry, -1)").selectExpr("'way' as element_type", "id", "tags", "geometry", "box")
    if relations is not None:
        rel = relations.filter(built)
        members = ways.join(rel.selectExpr("explode(members) as m").selectExpr("m.ref as id").distinct().hint("merge"), "id", "left_semi")
        rings = assemble_buildings(rel, assemble_ways(members, nodes)).filter("role = 'outer'").join(rel.selectExpr("id as relation_id", "tags").hint("merge"), "relation_id")
        rings = rings.selectExpr("'relation' as element_type", "relation_id as id", "tags", "transform(coordinates, p -> named_struct('lon', p.lon, 'lat', p.lat, 'z', 0D)) as geometry")
        rings = rings.selectExpr("*", f"{bounds('geometry')} as box", f"{b} as _b").filter(boxes_touch("box", "_b")).drop("_b")
        buildings = buildings.unionByName(rings)
    return {"ways": lines.filter(T.is_vehicle_highway()), "metro": metro, "buildings": buildings,
            "signals": inside.filter(T.is_signal()).selectExpr("id", f"{fixed('lon', 7)} as lon", f"{fixed('lat', 7)} as lat")}


def write_map_index(index: dict[str, DataFrame], path: str, box: dict, cell_deg: float = 0.05) -> None:
    """Each category as Parquet, laid out by grid cell so box queries prune files, and what the index holds.

    ``meta`` is written last, from the files themselves, so an index without it is not complete.
    """
    spark = next(iter(index.values())).sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for category, df in index.items():
        lon, lat = ("lon", "lat") if "lon" in df.columns else ("box.min_lon", "box.min_lat")
        cells = df.selectExpr("*", f"concat_ws('_', floor({lon} / {cell_deg}D), floor({lat} / {cell_deg}D)) as cell")
        # One shuffle on the cell, so a cell is one file. The number of tasks is fixed: opening files is the
        # work, and left to their bytes all cells of small features would fall to one task.
        cells.repartition(tasks, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{category}")
    corners = [f"{v!r}D as {k}" for k, v in box.items()]
    counts = [spark.read.schema(df.withColumn("cell", F.lit("")).schema).parquet(f"{path}/{c}").selectExpr(f"'{c}' as category") for c, df in index.items()]
    held = counts[0]
    for more in counts[1:]:
        held = held.unionByName(more)
    names = spark.createDataFrame([(c,) for c in index], "category string")
    names.join(held.groupBy("category").agg(F.expr("count(1)").alias("features")), "category", "left").na.fill(0).selectExpr("*", *corners).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(features: DataFrame, boxes: DataFrame, key: Sequence[str] = ("id",), tile: float = 0.01) -> DataFrame:
    """Features whose box overlaps any query box (edges included), each once."""
    from ..operators.spatial import join_boxes
    f = features.withColumnRenamed("box", "a_box").withColumn("_g", F.lit(0))
    q = boxes.select(F.col("box").alias("b_box"), F.lit(0).alias("_g"))
    hits = join_boxes(f.select(*key, "a_box", "_g"), q, tile, by=("_g",)).select(*key).distinct()
    return features.join(hits, list(key), "left_semi")


#: What a category of the index is called to its users. Fixed values.
CAPABILITY = {"ways": "roads", "signals": "signals", "buildings": "buildings", "metro": "metro"}
META = "category string, features bigint, min_lon double, min_lat double, max_lon double, max_lat double"


def index_status(spark: SparkSession, path: str) -> DataFrame:
    """One row: whether there is a complete index at ``path``, what it can answer, its counts and its box."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    meta = spark.read.schema(META).parquet(f"{path}/meta") if there else spark.createDataFrame([], META)
    names = "map(" + ", ".join(f"'{c}', '{n}'" for c, n in CAPABILITY.items()) + ")"
    counts = [F.expr(f"coalesce(sum(features) filter (where category = '{c}'), 0)").alias(c) for c in CAPABILITY]
    return meta.agg(F.expr("count(1) > 0").alias("available"), F.expr(f"array_join(array_sort(collect_list({names}[category])), ',')").alias("capabilities"), *counts,
                    *[F.first(c).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")])


def covers(boxes: DataFrame, status: DataFrame) -> DataFrame:
    """Whether every query box lies inside the indexed box (one row; no index covers nothing)."""
    inside = "box.min_lon >= min_lon and box.min_lat >= min_lat and box.max_lon <= max_lon and box.max_lat <= max_lat"
    return boxes.join(F.broadcast(status.select("min_lon", "min_lat", "max_lon", "max_lat")), F.lit(True)).agg(F.expr(f"coalesce(every(coalesce({inside}, false)), true)").alias("covered"))


__all__ = ["read_osm_xml", "assemble_ways", "extract_box", "build_map_index", "write_map_index", "read_index", "index_status", "covers"]
