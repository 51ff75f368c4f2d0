"""Object store and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import fixed
from ..operators import scenarios as sc
from ..operators import tables as tb
from ..sources import citydata as city
from ..sources import objects as store
from ..sources.citydata import cte, sql_fixed, sql_hav
from .registry import query


def typed_objects(spark, sf):
    """Base buildings and roads plus all proposals, with the columns summaries need."""
    b = city.buildings(spark, sf).selectExpr(
        "city", "building_id as id", "'building' as type", "'base' as scenario_id", "population", "population * 135D as water",
        "population * 5D as electricity", "cast(null as bigint) as lane_count", "source", "coordinates")
    r = city.roads(spark, sf).selectExpr(
        "city", "road_id as id", "'road' as type", "'base' as scenario_id", "0L as population", "0D as water", "0D as electricity",
        "lane_count", "case when imported then 'OSM' end as source", "coordinates")
    p = city.proposals(spark, sf).selectExpr(
        "city", "id", "type", "scenario_id", "population", "population * 135D as water", "population * 5D as electricity",
        "ord % 4 + 1 as lane_count", "'manual' as source", "coordinates")
    return b.unionByName(r).unionByName(p)


_OBJ = cte("buildings", "roads", "proposals") + """,
objs AS (SELECT city, building_id AS id, 'building' AS type, 'base' AS scenario_id, population, NULL::BIGINT AS lane_count, source FROM buildings
 UNION ALL SELECT city, road_id, 'road', 'base', 0, lane_count, CASE WHEN imported THEN 'OSM' END FROM roads
 UNION ALL SELECT city, id, type, scenario_id, population, ord % 4 + 1, 'manual' FROM proposals)
"""


@query("a01_scan_scenario_objects", cte("proposals") + "SELECT id, type, scenario_id FROM proposals WHERE scenario_id = 'prop1'")
def scan(spark, sf):
    return store.scan_city_objects(store.raw_objects(spark, sf), "prop1").select("id", "type", "scenario_id")


@query("a02_parse_roads", cte("roads") + """SELECT road_id AS id, road_class, lane_count, speed_limit, one_way, capacity, layer_or_null AS layer,
  3::BIGINT AS points, xa AS first_x, yb AS last_y FROM (SELECT *, CASE WHEN imported THEN layer END AS layer_or_null FROM roads)""")
def parse_roads(spark, sf):
    df = store.parse_city_objects(store.raw_objects(spark, sf, ("road", "proposal")).filter("scenario_id = 'base'"), "road")
    return df.selectExpr("id", "roadClass as road_class", "bigint(laneCount) as lane_count", "speedLimit as speed_limit",
                         "isOneWay as one_way", "trafficCapacity as capacity", "osmProvenance.layer as layer",
                         "bigint(size(coordinates)) as points", "floor(coordinates[0].lon * 1e7 + 0.5D) as first_x",
                         "floor(coordinates[2].lat * 1e7 + 0.5D) as last_y")


@query("a02_parse_damaged_buildings", cte("buildings") + """SELECT building_id AS id, CASE WHEN ord % 101 = 100 THEN 0 ELSE 5 END::BIGINT AS points,
  CASE WHEN ord % 101 = 100 THEN NULL ELSE category END AS category FROM buildings""")
def parse_damaged(spark, sf):
    df = store.parse_city_objects(store.raw_objects(spark, sf, ("building",)), "building")
    return df.selectExpr("id", "bigint(size(coordinates)) as points", "category")


@query("a03_encode_round_trip", cte("zones") + "SELECT zone_id AS id, 'zone' AS type, total_population, total_employment, 6::BIGINT AS points, x1 AS east FROM zones")
def encode(spark, sf):
    raw = store.raw_objects(spark, sf, ("zone",))
    again = store.encode_city_objects(store.parse_city_objects(raw, "zone"), "zone")
    return store.parse_city_objects(again, "zone").selectExpr(
        "id", "'zone' as type", "totalPopulation as total_population", "totalEmployment as total_employment",
        "bigint(size(coordinates)) as points", "floor(coordinates[1].lon * 1e7 + 0.5D) as east")


_STORE = """base AS (SELECT building_id AS id, 'building' AS type, population FROM buildings UNION ALL SELECT road_id, 'road', NULL FROM roads UNION ALL SELECT zone_id, 'zone', total_population FROM zones)"""


def base_objects(spark, sf):
    """Buildings, roads and zones of the base layer in one table."""
    parts = (("buildings", "building", "building_id", "population"), ("roads", "road", "road_id", "cast(null as bigint)"), ("zones", "zone", "zone_id", "total_population"))
    out = None
    for table, kind, key, people in parts:
        rows = city.derive(spark, sf, table).selectExpr(f"{key} as id", f"'{kind}' as type", f"{people} as population")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a05_upsert_objects", cte("buildings", "roads", "zones", "proposals") + f""", {_STORE},
batch AS (SELECT id, type, population, updated_at, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, ord DESC) AS rn FROM proposals)
SELECT COALESCE(b.id, p.id) AS id, COALESCE(p.type, b.type) AS type, CASE WHEN p.id IS NULL THEN b.population ELSE p.population END AS population,
 CASE WHEN b.id IS NULL THEN p.updated_at ELSE TIMESTAMP '2026-01-01' END AS created_at,
 COALESCE(p.updated_at, TIMESTAMP '2026-01-01') AS updated_at
FROM base b FULL JOIN (SELECT * FROM batch WHERE rn = 1) p ON p.id = b.id""")
def upsert(spark, sf):
    """Proposals of every type put into a table of all base objects."""
    table = base_objects(spark, sf).selectExpr("*", "-1L as ord", f"{store.BASE_TIME} as created_at", f"{store.BASE_TIME} as updated_at")
    batch = city.derive(spark, sf, "proposals").selectExpr("id", "type", "population", "ord", "updated_at as created_at", "updated_at")
    return tb.upsert(table, batch, ["id"], ["updated_at", "ord"]).drop("ord")


_CHANGES = """,
ch AS (SELECT concat('b', CAST(o_custkey AS VARCHAR)) AS id, o_orderkey AS seq,
  CASE o_orderstatus WHEN 'P' THEN 'update' WHEN 'F' THEN 'delete' ELSE 'add' END AS kind,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS after_pop, CAST(floor(o_totalprice / 2000) AS BIGINT) AS before_pop FROM orders)"""


def change_feed(spark, sf):
    return city.table(spark, sf, "orders").selectExpr(
        "concat('b', o_custkey) as id", "o_orderkey as seq",
        "case o_orderstatus when 'P' then 'update' when 'F' then 'delete' else 'add' end as kind",
        "named_struct('population', floor(o_totalprice / 2000)) as before", "named_struct('population', floor(o_totalprice / 1000)) as after")


def _replay_sql(order: str, add: str, gone: str, image: str) -> str:
    return cte("buildings") + _CHANGES + f""",
k AS (SELECT id, arg_max(kind, {order}) FILTER (kind <> 'update') AS structural, arg_max({image}, {order}) FILTER (kind <> '{gone}') AS image FROM ch GROUP BY id)
SELECT COALESCE(b.building_id, k.id) AS id, COALESCE(k.image, b.population) AS population FROM buildings b FULL JOIN k ON k.id = b.building_id
WHERE structural = '{add}' OR (structural IS NULL AND b.building_id IS NOT NULL)"""


@query("a06_apply_change_feed", _replay_sql("seq", "add", "delete", "after_pop"))
def replay(spark, sf):
    table = city.derive(spark, sf, "buildings").selectExpr("building_id as id", "population")
    return tb.apply_change_feed(table, change_feed(spark, sf))


@query("a06_undo_change_feed", _replay_sql("-seq", "delete", "add", "before_pop"))
def undo(spark, sf):
    table = city.derive(spark, sf, "buildings").selectExpr("building_id as id", "population")
    return tb.apply_change_feed(table, change_feed(spark, sf), "reverse")


@query("a07_delete_objects", cte("buildings", "proposals") + """SELECT building_id AS id, category FROM buildings
  WHERE building_id NOT IN (SELECT id FROM proposals WHERE scenario_id = 'prop2')""")
def delete_ids(spark, sf):
    ids = city.derive(spark, sf, "proposals").filter("scenario_id = 'prop2'").select("id")
    return tb.delete_objects(city.derive(spark, sf, "buildings").selectExpr("building_id as id", "category"), ids)


@query("a07_delete_scenario", _OBJ + "SELECT scenario_id, count(*) AS objects, (SELECT count(*) FROM objs WHERE scenario_id = 'prop3') AS removed FROM objs WHERE scenario_id <> 'prop3' GROUP BY 1")
def delete_scenario(spark, sf):
    objects = typed_objects(spark, sf)
    scenarios = objects.selectExpr("scenario_id as id").distinct()
    left, _, removed = tb.delete_scenario(objects, scenarios, "prop3")
    return left.groupBy("scenario_id").agg(F.expr("count(1)").alias("objects")).join(F.broadcast(removed), F.lit(True))


_AREAS = """,
areas AS (SELECT city, x - 12000 AS x0, x + 12000 AS x1, y - 9000 AS y0, y + 9000 AS y1 FROM stations)"""


def station_areas(spark, sf):
    return city.derive(spark, sf, "stations").selectExpr(
        "city", "named_struct('min_lon', (x - 12000) / 1e7, 'min_lat', (y - 9000) / 1e7, 'max_lon', (x + 12000) / 1e7, 'max_lat', (y + 9000) / 1e7) as box")


@query("a08_delete_objects_in_area", cte("roads", "stations") + _AREAS + "," + city.ROAD_POINTS + """
SELECT road_id AS id FROM roads WHERE road_id NOT IN (SELECT p.road_id FROM road_points p JOIN areas a ON a.city = p.city
  AND p.x / 1e7 BETWEEN a.x0 / 1e7 AND a.x1 / 1e7 AND p.y / 1e7 BETWEEN a.y0 / 1e7 AND a.y1 / 1e7)""")
def delete_in_area(spark, sf):
    roads = city.roads(spark, sf).selectExpr("city", "road_id as id", "coordinates")
    return tb.delete_objects_in_areas(roads, station_areas(spark, sf)).select("id")


def scenario_list(spark, sf):
    return city.table(spark, sf, "orders").groupBy(
        F.expr("concat('prop', o_custkey div 50)").alias("id")).agg(
        F.expr("min(concat(' Plan ', o_orderpriority))").alias("name"), F.expr("cast(null as string)").alias("description"),
        F.expr("int(max(year(o_orderdate)))").alias("year"))


_SCEN = """WITH scen AS (SELECT concat('prop', CAST(o_custkey // 50 AS VARCHAR)) AS id, min(concat(' Plan ', o_orderpriority)) AS name,
  CAST(max(year(o_orderdate)) AS INT) AS year FROM orders GROUP BY 1)"""


@query("a15_ensure_base_scenario", _SCEN + """SELECT id, name, '' AS description, year FROM scen UNION ALL
  SELECT 'base', 'Base city', 'What every plan builds on', 2026""")
def ensure_base(spark, sf):
    once = tb.ensure_base_scenario(scenario_list(spark, sf))
    return store.scan_scenarios(tb.ensure_base_scenario(once))


@query("a17_save_areas", cte("zones") + """SELECT zone_id AS id, CASE WHEN ord % 3 = 0 THEN 'crosses itself' END AS reason, x0 AS west,
  CASE WHEN ord % 3 = 0 THEN y1 ELSE y1 END AS north, CASE WHEN ord % 3 = 0 THEN 5 ELSE 6 END::BIGINT AS points FROM zones""")
def save_areas(spark, sf):
    # Every third ring has two corners swapped, so it crosses itself; it also comes unclosed.
    z = city.zones(spark, sf).selectExpr("zone_id", """case when ord % 3 = 0 then array(boundary[0], boundary[2], boundary[1], boundary[4])
        else boundary end as boundary""")
    return tb.checked_areas(z).selectExpr("zone_id as id", "reason", "floor(box.min_lon * 1e7 + 0.5D) as west",
                                          "floor(box.max_lat * 1e7 + 0.5D) as north", "bigint(size(boundary)) as points")


@query("b01_validate_scenarios", """SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN 'name missing'
  WHEN o_orderkey % 7 = 0 THEN 'name too long' WHEN o_totalprice > 350000 THEN 'year out of range' END AS reason FROM orders""")
def validate(spark, sf):
    df = city.table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderpriority like '5%' then '   ' when o_orderkey % 7 = 0 then repeat('n', 121) else ' Plan ' end as name",
        "'' as description", "case when o_totalprice > 350000 then 2300 else 2026 end as year")
    return tb.validate_scenarios(df).select("id", "reason")


@query("b13_user_built", _OBJ + "SELECT id, type, scenario_id, id NOT LIKE 'osm_%' AND coalesce(source, '') <> 'OSM' AS user_built FROM objs")
def user_built(spark, sf):
    df = typed_objects(spark, sf).selectExpr("*", "source = 'OSM' and type = 'road' as has_provenance", "cast(null as bigint) as osm_id")
    return df.selectExpr("id", "type", "scenario_id", f"{sc.is_user_built()} as user_built")


@query("b15_visible_objects", _OBJ + "SELECT scenario_id, type, count(*) AS objects FROM objs WHERE type <> 'road' GROUP BY ALL")
def visible(spark, sf):
    layers = spark.sql("select * from values ('roads', false), ('buildings', true) as t(id, visible)")
    df = typed_objects(spark, sf).selectExpr("*", "concat(type, 's') as layer_id")
    return sc.visible_objects(df, layers).groupBy("scenario_id", "type").agg(F.expr("count(1)").alias("objects"))


@query("b17_resize_buildings", cte("buildings") + """SELECT building_id AS id, nf AS floors, nf * pf AS population, nf * pf * wf AS water,
  nf * pf * ef AS electricity, greatest(1, nf * kf) AS parking FROM (SELECT *, greatest(1, CAST(floor(bal / 100 / 3 + 0.5) AS BIGINT)) AS nf,
  CASE category WHEN 'residential' THEN 10 WHEN 'industrial' THEN 15 ELSE 25 END AS pf, CASE category WHEN 'residential' THEN 150 WHEN 'industrial' THEN 300 ELSE 60 END AS wf,
  CASE category WHEN 'residential' THEN 6 WHEN 'industrial' THEN 40 ELSE 15 END AS ef, CASE WHEN category IN ('residential', 'industrial') THEN 2 ELSE 8 END AS kf FROM buildings)""")
def resize(spark, sf):
    df = city.derive(spark, sf, "buildings").selectExpr(
        "building_id as id", "bal / 100 as height",
        "case category when 'residential' then 'residential' when 'industrial' then 'industrial' else 'commercial' end as usage")
    return sc.resized_buildings(df).selectExpr("id", "new_floors as floors", "new_population as population", "new_water as water",
                                               "new_electricity as electricity", "new_parking as parking")


@query("b20_lanes_text", cte("roads") + """SELECT road_id, CASE WHEN b = 0 THEN concat(a, ', one-way') WHEN a = b THEN concat(a, ' each way')
  ELSE concat(a, ' + ', b) END AS lanes FROM (SELECT road_id, CASE WHEN one_way THEN lane_count ELSE (lane_count + 1) // 2 END AS a,
  CASE WHEN one_way THEN 0 ELSE lane_count // 2 END AS b FROM roads)""")
def lanes(spark, sf):
    df = city.derive(spark, sf, "roads").selectExpr(
        "road_id", "case when one_way then lane_count else ceil(lane_count / 2) end as a", "case when one_way then 0L else floor(lane_count / 2) end as b")
    return df.selectExpr("road_id", f"{sc.lanes_text('a', 'b')} as lanes")


_VIEW = _OBJ + """, shown AS (SELECT * FROM objs WHERE scenario_id = 'prop1' UNION ALL SELECT * FROM objs o WHERE scenario_id = 'base'
  AND NOT EXISTS (SELECT 1 FROM objs p WHERE p.scenario_id = 'prop1' AND p.id = o.id))"""


@query("u01_scenario_view", _VIEW + "SELECT id, type, scenario_id, population FROM shown")
def view(spark, sf):
    return sc.scenario_view(typed_objects(spark, sf), "prop1").select("id", "type", "scenario_id", "population")


@query("c23_base_not_overridden", _VIEW + "SELECT id, type FROM shown WHERE scenario_id = 'base'")
def not_overridden(spark, sf):
    return sc.scenario_view(typed_objects(spark, sf), "prop1").filter("scenario_id = 'base'").select("id", "type")


@query("u02_clone_scenario", _OBJ + """SELECT id, scenario_id, population FROM objs UNION ALL
  SELECT concat(split_part(id, '__', 1), '__alt'), 'alt', population FROM objs WHERE scenario_id = 'prop1'""")
def clone(spark, sf):
    return sc.clone_scenario(typed_objects(spark, sf), "prop1", "alt").select("id", "scenario_id", "population")


_LEN = sql_hav("xa / 1e7", "ya / 1e7", "xb / 1e7", "yb / 1e7")


def _compare_sql(extra: str = "") -> str:
    pop = f"CAST(sum(CASE WHEN type = 'building' THEN population ELSE 0 END) AS BIGINT){extra}"
    return cte("proposals", "buildings") + f"""SELECT p.scenario_id, {pop} AS pop_delta,
      ({pop}) * 135.0::DOUBLE AS water_delta, ({pop}) * 5.0::DOUBLE AS elec_delta,
      {sql_fixed(f"sum(CASE WHEN type = 'road' THEN {_LEN} / 1000 * (ord % 4 + 1) ELSE 0 END)", 4)} AS new_road_lane_km, 0.0::DOUBLE AS new_flyover_km,
      {sql_fixed(f"sum(CASE WHEN type = 'metro_line' THEN {_LEN} / 1000 ELSE 0 END)", 4)} AS new_metro_km,
      count(*) FILTER (type = 'metro_station') AS new_stations, count(*) FILTER (type = 'building') AS new_buildings
      FROM proposals p GROUP BY 1"""


def _comparison(spark, sf, mode):
    return sc.compare_scenarios(typed_objects(spark, sf), mode).selectExpr(
        "scenario_id", "pop_delta", "water_delta", "elec_delta", *[f"{fixed(c, 4)} as {c}" for c in ("new_road_lane_km", "new_flyover_km", "new_metro_km")],
        "new_stations", "new_buildings")


@query("d08_scenario_comparison", _compare_sql())
def comparison(spark, sf):
    return _comparison(spark, sf, "as_reference")


@query("d08_scenario_comparison_effective", _compare_sql(
    " - COALESCE((SELECT CAST(sum(b.population) AS BIGINT) FROM buildings b WHERE b.building_id IN (SELECT id FROM proposals q WHERE q.scenario_id = p.scenario_id)), 0)"))
def comparison_effective(spark, sf):
    return _comparison(spark, sf, "effective")


@query("f01_scenario_order", _SCEN + """SELECT id, year, row_number() OVER (ORDER BY id <> 'base', year, name, id) AS position
  FROM (SELECT id, name, year FROM scen UNION ALL SELECT 'base', 'Base city', 2026)""")
def order(spark, sf):
    return sc.ordered_scenarios(tb.ensure_base_scenario(scenario_list(spark, sf))).selectExpr("id", "year", "bigint(position) as position")


_PLANAR = ("sqrt(pow((xb - xa) / 1e7 * 111320.0::DOUBLE * cos(radians(ya / 1e7)), 2) + pow((yb - ya) / 1e7 * 111320.0::DOUBLE, 2))")


@query("d26_project_list", cte("proposals") + f"""SELECT scenario_id, CASE type WHEN 'road' THEN 'Roads and flyovers' WHEN 'building' THEN 'Buildings' ELSE 'Metro' END AS grp,
  count(*) AS objects, {sql_fixed(f"sum(CASE WHEN type IN ('road', 'metro_line', 'metro_station') THEN {_PLANAR} ELSE 0 END) / 1000", 4)} AS km FROM proposals GROUP BY ALL""")
def projects(spark, sf):
    df = typed_objects(spark, sf).filter("scenario_id <> 'base'")
    return sc.project_list(df).selectExpr("scenario_id", "grp", "objects", f"{fixed('km', 4)} as km")


@query("d09_population_summary", cte("buildings") + f"""SELECT city, pop AS population, pop * 135.0::DOUBLE AS water, pop * 5.0::DOUBLE AS electricity,
  {sql_fixed('w * h / 1e6', 6)} AS area_km2, CAST(floor(pop * 0.45::DOUBLE + 0.5) AS BIGINT) AS peak_movement, CAST(floor(pop / (w * h / 1e6) + 0.5) AS BIGINT) AS density
  FROM (SELECT city, pop, {sql_hav('x0', 'y0', 'x1', 'y0')} AS w, {sql_hav('x0', 'y0', 'x0', 'y1')} AS h FROM (SELECT city, CAST(sum(population) AS BIGINT) AS pop,
  min(x0) / 1e7 AS x0, max(x1) / 1e7 AS x1, min(y0) / 1e7 AS y0, max(y1) / 1e7 AS y1 FROM buildings GROUP BY city))""")
def population(spark, sf):
    return sc.population_summary(city.buildings(spark, sf)).selectExpr(
        "city", "population", "water", "electricity", f"{fixed('area_km2', 6)} as area_km2", "peak_movement", "density")


@query("f07_listed_names", cte("proposals") + """, n AS (SELECT scenario_id, type, list_distinct(list(o_orderpriority)) AS names FROM proposals GROUP BY ALL),
 s AS (SELECT *, list_sort(names) AS s FROM n) SELECT scenario_id, type, concat(array_to_string(s[1:3], ', '),
 CASE WHEN len(s) > 3 THEN concat(' and ', len(s) - 3, ' more') ELSE '' END) AS names FROM s""")
def names(spark, sf):
    df = city.derive(spark, sf, "proposals").groupBy("scenario_id", "type").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return df.selectExpr("scenario_id", "type", f"{sc.listed_names('p')} as names")


@query("c26_flyover_impact", cte("roads", "flyovers") + """SELECT r.road_id, CAST(CASE WHEN f.city IS NULL THEN capacity ELSE floor(capacity * 0.75::DOUBLE + 0.5) END AS BIGINT) AS capacity
  FROM roads r LEFT JOIN (SELECT DISTINCT city, ord % 200 AS j FROM flyovers) f ON f.city = r.city AND f.j = r.j""")
def flyover_impact(spark, sf):
    hit = city.derive(spark, sf, "flyovers").selectExpr("city", "ord % 200 as j", "0.75D as kept").distinct()
    return city.derive(spark, sf, "roads").select("city", "j", "road_id", "capacity").join(hit, ["city", "j"], "left").selectExpr(
        "road_id", "case when kept is null then capacity else floor(capacity * kept + 0.5D) end as capacity")
