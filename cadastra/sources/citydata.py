"""City tables derived from the driver's relational tables.

The given tables carry no geometry, so every city object is index arithmetic over
their rows: ``part`` gives roads, ``customer`` buildings, ``supplier`` zones,
gateways, metro and flyovers, ``orders`` planning proposals, ``events`` vehicle
observations and ``lineitem`` trips. Rows fall into cities of a fixed size, so the
number of cities, not the size of one, grows with the data. Expressions are kept to
the SQL both Spark and the checking database read, so one text defines a table for
both. Coordinates are whole 1e-7 degrees, which makes vertex identity exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import pt

ROADS_PER_CITY = 200
BUILDINGS_PER_CITY = 150
SITES_PER_CITY = 10


def _idiv(a: str, b: int) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


def vertex_x(city: str, c: str, r: str) -> str:
    return (f"(737000000 + ({city} % 1000) * 200000 + ({c}) * 9000"
            f" + (({c}) * 7919 + ({r}) * 104729 + {city} * 1299709) % 1201)")


def vertex_y(city: str, c: str, r: str) -> str:
    return (f"(185700000 + ({_idiv(city, 1000)} % 2000) * 200000 + ({r}) * 9000"
            f" + (({c}) * 15485863 + ({r}) * 32452843 + {city} * 49979687) % 1201)")


# Each entry: source table, then layers of (new columns) applied one after another.
_DERIVED: dict[str, tuple[str, list[list[str]], list[str]]] = {
    "roads": ("part", [
        ["p_partkey AS ord", f"{_idiv('p_partkey', 200)} AS city", "p_partkey % 200 AS j",
         "CAST(p_size AS BIGINT) AS size", "p_retailprice", "p_brand", "p_type", "p_name"],
        ["*", f"{_idiv('j', 2)} % 10 AS c", f"{_idiv('j', 20)} AS r", "j % 2 AS vertical",
         "ord % 3 <> 0 AS imported"],
        ["*", "concat('r', CAST(ord AS VARCHAR(20))) AS road_id",
         "CASE WHEN size % 4 = 0 THEN 'highway' WHEN size % 4 = 1 THEN 'arterial'"
         " WHEN size % 4 = 2 THEN 'collector' ELSE 'local' END AS road_class",
         "1 + size % 5 AS lane_count", "CAST(30 + 10 * (size % 6) AS DOUBLE) AS speed_limit",
         "size % 7 = 0 AS one_way", "CASE WHEN size % 10 = 5 THEN 1 ELSE 0 END AS layer",
         "size % 16 = 9 AS roundabout",
         "CASE WHEN NOT imported AND size % 11 = 3 THEN 300 ELSE 0 END AS start_gap",
         "CASE WHEN NOT imported AND size % 13 = 4 THEN 1500 ELSE 0 END AS end_gap",
         f"{vertex_x('city', 'c', 'r')} AS xa0", f"{vertex_y('city', 'c', 'r')} AS ya0",
         f"{vertex_x('city', 'c + 1 - vertical', 'r + vertical')} AS xb0",
         f"{vertex_y('city', 'c + 1 - vertical', 'r + vertical')} AS yb0"],
        ["*", "xa0 + start_gap * (1 - vertical) AS xa", "ya0 + start_gap * vertical AS ya",
         "xb0 - end_gap * (1 - vertical) AS xb", "yb0 - end_gap * vertical AS yb"],
        ["*", f"{_idiv('(xa + xb)', 2)} + (ord * 31) % 401 - 200 AS xm",
         f"{_idiv('(ya + yb)', 2)} + (ord * 57) % 401 - 200 AS ym",
         "CAST(lane_count * 1000 AS BIGINT) AS capacity"],
    ], []),
    "buildings": ("customer", [
        ["c_custkey AS ord", f"{_idiv('c_custkey', 150)} AS city", "c_custkey % 150 AS j",
         "c_nationkey", "abs(c_acctbal) AS bal", "c_mktsegment"],
        ["*", "j % 10 AS c", f"{_idiv('j', 10)} % 10 AS r", f"{_idiv('j', 100)} AS k",
         "concat('b', CAST(ord AS VARCHAR(20))) AS building_id",
         "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'MACHINERY' THEN 'industrial'"
         " WHEN 'BUILDING' THEN 'office' WHEN 'AUTOMOBILE' THEN 'retail' ELSE 'commercial' END AS category",
         "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CAST(floor(bal / 20) AS BIGINT) ELSE 0 END AS residents",
         "CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(floor(bal / 25) AS BIGINT) ELSE 0 END AS employees",
         "CASE WHEN c_nationkey % 5 = 0 THEN 'manual' ELSE 'OSM' END AS source",
         "CASE WHEN ord % 9 = 0 THEN concat(CAST(6 + ord % 17 AS VARCHAR(2)), ':30') END AS departure_start",
         "CASE WHEN ord % 18 = 0 THEN concat(CAST(10 + ord % 13 AS VARCHAR(2)), ':15') END AS arrival_start",
         "CASE WHEN ord % 27 = 0 THEN CAST(100 + ord % 900 AS DOUBLE) END AS daily_trips",
         "CASE WHEN ord % 36 = 0 THEN CAST(50 + ord % 200 AS DOUBLE) END AS am_trips",
         "CASE WHEN ord % 45 = 0 THEN CAST(40 + ord % 300 AS DOUBLE) END AS pm_trips",
         "CASE WHEN ord % 10 = 0 THEN CAST(20 + ord % 50 AS DOUBLE) END AS split_car",
         "CASE WHEN ord % 10 = 0 THEN CAST(10 + ord % 30 AS DOUBLE) END AS split_walk"],
        ["*", "737000000 + (city % 1000) * 200000 + c * 9000 + 2600 + k * 3000 + (ord * 7919) % 601 AS x0",
         f"185700000 + ({_idiv('city', 1000)} % 2000) * 200000 + r * 9000 + 2600 + (ord * 104729) % 3001 AS y0",
         "3 + ord % 12 AS floors"],
        ["*", "x0 + 1000 AS x1", "y0 + 800 AS y1", "floors * 12 AS population"],
    ], []),
    "sites": ("supplier", [
        ["s_suppkey AS ord", f"{_idiv('s_suppkey', 10)} AS city", "s_suppkey % 10 AS j",
         "abs(s_acctbal) AS bal", "s_nationkey"],
        ["*", "737000000 + (city % 1000) * 200000 AS ox",
         f"185700000 + ({_idiv('city', 1000)} % 2000) * 200000 AS oy"],
    ], []),
    "zones": ("sites WHERE j < 4", [
        ["ord", "city", "concat('z', CAST(ord AS VARCHAR(20))) AS zone_id",
         "CAST(floor(bal / 2) AS BIGINT) AS total_population",
         "CAST(floor(bal / 3) + s_nationkey * 200 AS BIGINT) AS total_employment",
         "ox + (j % 2) * 46000 - 1500 AS x0", f"oy + {_idiv('j', 2)} * 46000 - 1500 AS y0"],
        ["*", "x0 + 46000 AS x1", "y0 + 46000 AS y1", "x0 + 20000 AS xm", "y0 + 37000 AS ym"],
    ], []),
    "gateways": ("sites WHERE j IN (4, 5)", [
        ["ord", "city", "concat('g', CAST(ord AS VARCHAR(20))) AS gateway_id",
         "CASE WHEN j = 4 THEN ox - 3000 ELSE ox + 93000 END AS x", "oy + 45300 + s_nationkey * 100 AS y",
         "floor(bal / 10) AS in_am", "floor(bal / 16) AS in_pm", "floor(bal / 25) AS in_mid", "floor(bal / 60) AS in_night",
         "floor(bal / 14) AS out_am", "floor(bal / 11) AS out_pm", "floor(bal / 27) AS out_mid", "floor(bal / 55) AS out_night"],
    ], []),
    "signals": ("sites", [
        ["ord", "city", f"{vertex_x('city', '(j * 3) % 10', '(j * 7) % 10')} + 900 AS x",
         f"{vertex_y('city', '(j * 3) % 10', '(j * 7) % 10')} - 700 AS y"],
    ], []),
    "stations": ("sites WHERE j IN (6, 7)", [
        ["ord", "city", "concat('s', CAST(ord AS VARCHAR(20))) AS station_id",
         "ox + 20000 + j * 2500 + s_nationkey * 300 AS x", "oy + 30000 + j * 2500 AS y",
         "CASE WHEN ord % 3 = 0 THEN CAST(ord % 720 - 90 AS DOUBLE) END AS heading",
         "s_nationkey % 6 <> 0 AS align_to_track"],
    ], []),
    "tracks": ("sites WHERE j = 8", [
        ["ord", "city", "concat('m', CAST(ord AS VARCHAR(20))) AS track_id",
         "ox + 12000 AS xa", "oy + 20000 AS ya", "ox + 40000 AS xm", "oy + 50000 + s_nationkey * 50 AS ym",
         "ox + 80000 AS xb", "oy + 61000 AS yb"],
    ], []),
    "flyovers": ("sites WHERE j IN (8, 9)", [
        ["ord", "city", "concat('f', CAST(ord AS VARCHAR(20))) AS flyover_id",
         f"{vertex_x('city', '1', '2 + 4 * (j - 8)')} AS xa", f"{vertex_y('city', '1', '2 + 4 * (j - 8)')} AS ya",
         f"{vertex_x('city', '5 + s_nationkey % 4', '3 + 4 * (j - 8)')} AS xb",
         f"{vertex_y('city', '5 + s_nationkey % 4', '3 + 4 * (j - 8)')} AS yb",
         "CAST(5 + s_nationkey % 5 AS DOUBLE) AS elevation", "2 + 2 * (s_nationkey % 3) AS lane_count"],
    ], []),
    "proposals": ("orders", [
        ["o_orderkey AS ord", f"{_idiv('o_custkey', 150)} AS city", "o_custkey",
         f"concat('prop', CAST({_idiv('o_custkey', 50)} AS VARCHAR(20))) AS scenario_id", "o_orderstatus AS status",
         "o_orderkey % 2 = 0 AS overrides", "o_totalprice", "o_orderpriority", "o_orderdate AS updated_at",
         "CASE o_orderkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'road' WHEN 2 THEN 'building'"
         " WHEN 3 THEN 'metro_line' ELSE 'metro_station' END AS new_type"],
        ["*", "CASE WHEN overrides THEN 'building' ELSE new_type END AS type",
         "CASE WHEN overrides THEN concat('b', CAST(o_custkey AS VARCHAR(20)))"
         " ELSE concat('n', CAST(ord AS VARCHAR(20))) END AS id",
         "CAST(floor(o_totalprice / 1000) AS BIGINT) AS population",
         "737000000 + (city % 1000) * 200000 + (ord * 7919) % 80000 AS xa",
         f"185700000 + ({_idiv('city', 1000)} % 2000) * 200000 + (ord * 104729) % 80000 AS ya"],
        ["*", "xa + 2000 + ord % 3000 AS xb", "ya + 1500 AS yb"],
    ], []),
    "observations": ("events", [
        ["event_id AS ord", "user_id AS vehicle_id", "ts", "event_type", "value",
         "CASE WHEN value > 60 THEN 60.0 ELSE value END AS speed_raw"],
        ["*", "vehicle_id * 4 + (ord * 7) % 16 AS road"],
        ["ord", "vehicle_id", "ts", "event_type", "CAST(speed_raw AS DOUBLE) / 3 AS speed_mps", "road % 4 + 1 AS lanes",
         "concat('r', CAST(road AS VARCHAR(20))) AS road_id",
         "concat('r', CAST(road AS VARCHAR(20)), '_', CAST(ord % 2 AS VARCHAR(2))) AS segment_key",
         "CAST(30 + 10 * (road % 6) AS DOUBLE) AS limit_kmh"],
    ], []),
    "trips": ("lineitem", [
        ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate AS depart_ts", "l_returnflag", "l_linestatus",
         "CAST(round(l_extendedprice / 50) AS BIGINT) AS travel_s", "CAST(l_quantity AS BIGINT) AS stops",
         "CAST(round(l_extendedprice / 80 * (1 - l_discount)) AS BIGINT) AS free_flow_s",
         "CASE WHEN l_returnflag = 'R' THEN 'removed' WHEN l_linestatus = 'O' THEN 'under_way' ELSE 'completed' END AS status"],
    ], []),
}


def cte(*names: str) -> str:
    """``WITH`` clause defining the named derived tables (and what they need)."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        source, layers, _ = _DERIVED[name]
        base = source.split()[0]
        if base in _DERIVED:
            add(base)
        text = f"SELECT {', '.join(layers[0])} FROM {source}"
        for layer in layers[1:]:
            text = f"SELECT {', '.join(layer)} FROM ({text})"
        seen[name] = text
    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in seen.items())


# Column types of the given tables (saves a schema-reading job per scan).
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Tables whose short rows unfold into geometry. Their files are small, so few tasks read them; rows are dealt out first.
DEALT = {"part": "p_partkey", "customer": "c_custkey"}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` as a lazy DataFrame (columns prune to the scan)."""
    source, layers, _ = _DERIVED[name]
    base, _, where = source.partition(" WHERE ")
    df = derive(spark, sf_dir, base) if base in _DERIVED else table(spark, sf_dir, base)
    if base in DEALT:
        df = df.repartition(DEALT[base])
    if where:
        df = df.filter(where)
    for layer in layers:
        df = df.selectExpr(*layer)
    return df


def _p(x: str, y: str, z: str = "0D") -> str:
    return pt(f"{x} / 1e7", f"{y} / 1e7", z)


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of three points: start, bend, end."""
    return derive(spark, sf_dir, "roads").selectExpr(
        "*", f"array({_p('xa', 'ya')}, {_p('xm', 'ym')}, {_p('xb', 'yb')}) as coordinates")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with a closed rectangular footprint."""
    ring = ", ".join(_p(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")))
    return derive(spark, sf_dir, "buildings").selectExpr("*", f"array({ring}) as coordinates")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand zones: a block of the city with a notch in its top side (concave)."""
    ring = ", ".join(_p(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("xm", "ym"), ("x0", "y1"), ("x0", "y0")))
    return derive(spark, sf_dir, "zones").selectExpr("*", f"array({ring}) as boundary")


def points(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Derived point tables (gateways, signals, stations) with ``lon`` and ``lat``."""
    return derive(spark, sf_dir, name).selectExpr("*", "x / 1e7 as lon", "y / 1e7 as lat")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "tracks").selectExpr(
        "*", f"array({_p('xa', 'ya', '12D')}, {_p('xm', 'ym', '12D')}, {_p('xb', 'yb', '12D')}) as coordinates")


def flyovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "flyovers").selectExpr("*", f"array({_p('xa', 'ya')}, {_p('xb', 'yb')}) as coordinates")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "proposals").selectExpr("*", f"array({_p('xa', 'ya')}, {_p('xb', 'yb')}) as coordinates")


# ---- SQL text shared by the oracles -----------------------------------------

def sql_hav(x1: str, y1: str, x2: str, y2: str) -> str:
    """Haversine over columns in degrees, as SQL text."""
    a = (f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2}))"
         f" * pow(sin(radians({x2} - {x1}) / 2), 2))")
    return f"(12742000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def sql_fixed(x: str, digits: int) -> str:
    s = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({x}) * {s} + 0.5::DOUBLE) / {s})"


# Road vertices and segments as rows, for oracles.
ROAD_POINTS = (
    "road_points AS (SELECT city, ord, road_id, 0 AS pos, xa AS x, ya AS y FROM roads UNION ALL "
    "SELECT city, ord, road_id, 1, xm, ym FROM roads UNION ALL SELECT city, ord, road_id, 2, xb, yb FROM roads)")
ROAD_SEGMENTS = (
    "road_segments AS (SELECT city, ord, road_id, 0 AS seg, xa / 1e7 AS ax, ya / 1e7 AS ay, xm / 1e7 AS bx, ym / 1e7 AS by_ FROM roads UNION ALL "
    "SELECT city, ord, road_id, 1, xm / 1e7, ym / 1e7, xb / 1e7, yb / 1e7 FROM roads)")
