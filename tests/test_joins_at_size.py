"""Plans and files that must not grow in one place with the tables."""
import datetime
import random
import re

from pyspark.sql import functions as F

from cadastra.operators import joining as jo
from cadastra.operators import nearest as ne
from cadastra import session
from cadastra.operators import demand, editing, graph, network, tables
from cadastra.operators.spatial import join_boxes, join_points, segments
from cadastra.plans import area_queries, convert_queries, editing_queries, nearest_queries
from cadastra.sources import osm

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spatial_joins_gather_no_side_in_the_driver(spark):
    roads = nearest_queries.roads(spark, SF)
    seg = segments(roads, ["city", "road_id"])
    pairs = join_points(nearest_queries.corners(spark, SF), seg, ne.TILE_DEG, pad=0.0002)
    assert "Broadcast" not in plan(pairs)
    boxes = join_boxes(seg.withColumnRenamed("box", "a_box"), seg.selectExpr("city", "road_id as other", "box as b_box"), 0.002)
    assert "Broadcast" not in plan(boxes)


def test_spots_meet_their_pieces_without_a_broadcast(spark):
    roads = nearest_queries.roads(spark, SF)
    spots = roads.selectExpr("city", "road_id as target", "0 as seg", "0.5D as t", "coordinates[0].lon as x", "coordinates[0].lat as y", "0D as z")
    assert "Broadcast" not in plan(jo.with_vertex(spots, roads))


def test_no_file_of_the_extract_grows_with_the_city(spark, monkeypatch):
    monkeypatch.setattr(convert_queries, "EXTRACT_ROWS", 30, raising=False)
    nodes, ways, _ = convert_queries._extract(spark, SF)
    for df in (nodes, ways):
        read = df.withColumn("f", F.input_file_name()).groupBy("f").count()
        assert read.agg(F.max("count")).first()[0] <= 30
    assert ways.count() == convert_queries.city.table(spark, SF, "part").count()


def test_buildings_beside_a_street_meet_no_whole_block(spark, monkeypatch):
    edges = spark.createDataFrame([(0, i, f"e{i}", i, i + 1, [(73.0 + i * 0.001, 18.0, 0.0), (73.001 + i * 0.001, 18.0, 0.0)]) for i in range(20)],
                                  "city int, ord long, edge_id string, from_node long, to_node long, coordinates array<struct<lon:double,lat:double,z:double>>")
    homes = spark.createDataFrame([(0, f"b{i}", 73.0002 + i * 0.001, 18.0003) for i in range(20)], "city int, id string, lon double, lat double")

    def no_blocks(*_):
        raise AssertionError("whole blocks compared")
    monkeypatch.setattr(ne, "cells_crossed", no_blocks)
    got = {r.id: (r.edge_id, r.access_node) for r in ne.building_access(homes, edges).collect()}
    assert got == {f"b{i}": (f"e{i}", i) for i in range(20)}


def test_access_beside_in_the_block_and_beyond_it(spark):
    """A building whose block holds only a far edge takes that one, though a nearer edge lies outside the block."""
    line = lambda x0, y0, x1, y1: [(x0, y0, 0.0), (x1, y1, 0.0)]
    lon = lambda cell: cell * 200 / 111319.49079327358
    w = lon(1)
    x = lon(40650)  # west side of a column of cells near 73 degrees
    for lat in (0.0005, 60.0):
        edges = spark.createDataFrame([(0, 1, "corner", 1, 2, line(x + 1.9 * w, lat + 0.0008, x + 1.95 * w, lat + 0.0008)), (0, 2, "outside", 3, 4, line(x - 1.1 * w, lat, x - 1.1 * w, lat + 0.00001)),
                                       (1, 3, "alone", 5, 6, line(x + 0.3, lat, x + 0.4, lat))],
                                      "city int, ord long, edge_id string, from_node long, to_node long, coordinates array<struct<lon:double,lat:double,z:double>>")
        homes = spark.createDataFrame([(0, "mid", x + 0.05 * w, lat), (0, "beside", x - 1.1 * w - 0.0002, lat), (1, "far", x, lat)], "city int, id string, lon double, lat double")
        got = {r.id: (r.edge_id, r.access_node) for r in ne.building_access(homes, edges).collect()}
        assert got["beside"] == ("outside", 3) and got["mid"] == ("corner", 1) and got["far"] == ("alone", 5)


def test_upsert_meets_its_table_once(spark):
    rows = "id string, population long, seq long, created_at timestamp, updated_at timestamp"
    t = lambda day: datetime.datetime(2026, 1, day)
    table = spark.createDataFrame([("a", 1, 0, t(1), t(5)), ("b", 2, 0, t(1), t(1)), ("c", 3, 0, t(1), t(1)), (None, 4, 0, t(1), t(1))], rows)
    batch = spark.createDataFrame([("a", 10, 1, t(4), t(4)), ("b", 20, 1, t(4), t(4)), ("b", 21, 2, t(4), t(4)), ("d", 40, 1, t(4), t(4)), (None, 50, 1, t(4), t(4))], rows)

    def held(**how):
        out = tables.upsert(table, batch, ["id"], ["updated_at", "seq"], **how)
        text = plan(out)
        assert len(re.findall(r"\w*Join\b", text)) == 1 and "Broadcast" not in text
        return sorted((r.id or "", r.population, r.created_at.day, r.updated_at.day) for r in out.collect())
    kept = [("", 4, 1, 1), ("", 50, 4, 4), ("b", 21, 1, 4), ("c", 3, 1, 1), ("d", 40, 4, 4)]
    assert held() == sorted([*kept, ("a", 10, 1, 4)])
    assert held(keep_newer=True) == sorted([*kept, ("a", 1, 1, 5)])


def test_repair_and_restore_gather_no_table_in_the_driver(spark):
    assert "Broadcast" not in plan(editing_queries.repair(spark, SF))


def test_readiness_searches_only_nodes_that_pivots_leave_open(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(i, (i + 1) % 30, i) for i in range(30)] + [(30 + rnd.randrange(30), rnd.randrange(60), 100 + i) for i in range(25)]
    seen = {i: {i} for i in range(62)}
    for _ in range(62):
        for s, d, _e in edges:
            for k in seen:
                if s in seen[k]:
                    seen[k].add(d)
    ids = [*range(62), 99]
    pairs = [(0, f"p{a}", f"p{b}") for a in ids for b in ids if a != b]
    node = {**{i: i for i in range(62)}, 61: 60}
    want = sum(1 for _, a, b in pairs if a != "p99" and b != "p99" and node[int(a[1:])] != node[int(b[1:])] and node[int(b[1:])] in seen[node[int(a[1:])]])
    searched, plainly = [], demand.shortest
    monkeypatch.setattr(demand, "shortest", lambda e, seeds, *a, **k: searched.append(seeds.select("k").distinct().count()) or plainly(e, seeds, *a, **k))
    got = demand.route_readiness(spark.createDataFrame(pairs, "city int, origin_id string, destination_id string"),
                                 spark.createDataFrame([(0, f"p{i}", node[i]) for i in node], "city int, id string, node int"),
                                 spark.createDataFrame(edges, "src int, dst int, edge_id int")).first()
    assert (got.od_pairs, got.valid_origins, got.valid_destinations) == (len(pairs), len(pairs) - 62, len(pairs) - 62)
    assert (got.routed, got.failed) == (want, len(pairs) - want)
    assert searched[:2] == [3, 3] and searched[2] < 32


def test_short_rows_are_dealt_out_before_they_unfold(spark):
    for name, key in (("roads", "p_partkey"), ("buildings", "c_custkey")):
        assert f"hashpartitioning({key}" in plan(nearest_queries.city.derive(spark, SF, name))


def test_rings_are_asked_behind_their_boxes(spark):
    zones = nearest_queries.city.zones(spark, SF).selectExpr("city", "zone_id as area_id", "boundary")
    lines = nearest_queries.roads(spark, SF).selectExpr("city", "road_id as id", "coordinates")
    homes = nearest_queries.city.buildings(spark, SF).selectExpr("city", "building_id as id", "coordinates")
    for df in (ne.lines_touching_areas(lines, zones), editing.clip_buildings(homes, zones)):
        shown = plan(df)
        assert "1.0E-9" in shown and shown.index("1.0E-9") < shown.index("filter(transform(")
    # On the ring and on a corner counts as inside, whatever the box.
    area = spark.createDataFrame([(0, "a", [(73.0, 18.0, 0.0), (73.004, 18.0, 0.0), (73.004, 18.004, 0.0), (73.0, 18.004, 0.0)])], "city int, area_id string, boundary array<struct<lon:double,lat:double,z:double>>")
    spots = [(73.0, 18.0), (73.004, 18.004), (73.002, 18.004), (73.002, 18.002), (73.0041, 18.002), (72.9999, 18.0)]
    pts = spark.createDataFrame([(0, str(i), [(x, y, 0.0)] * 2) for i, (x, y) in enumerate(spots)], "city int, id string, coordinates array<struct<lon:double,lat:double,z:double>>")
    assert sorted(r.id for r in ne.lines_touching_areas(pts, area).collect()) == ["0", "1", "2", "3"]


def test_nodes_of_the_access_weights_are_not_gathered(spark):
    zones, nodes = nearest_queries.city.zones(spark, SF), nearest_queries.grid_nodes(spark, SF)
    edges = nearest_queries.city.derive(spark, SF, "roads").selectExpr("ord as ord_key", "capacity", "road_class", "city * 121 + r * 11 + c as src", "city * 121 + (r + vertical) * 11 + c + 1 - vertical as dst")
    shown = plan(demand.zone_access_weights(zones, nodes, edges))
    assert not re.search(r"BroadcastHashJoin \[node", shown)


def _written_without_broadcast(monkeypatch, *modules):
    def checked(df, name="step"):
        assert "Broadcast" not in plan(df), name
        return session.materialise(df, name)
    for m in modules:
        monkeypatch.setattr(m, "materialise", checked)


def test_roads_are_joined_and_built_into_a_network_without_a_broadcast(spark, monkeypatch):
    _written_without_broadcast(monkeypatch, jo, network, editing_queries)
    assert "Broadcast" not in plan(editing_queries.connect(spark, SF))
    assert "Broadcast" not in plan(editing_queries.joined_network(spark, SF))


def test_clear_pieces_gather_no_gaps_in_the_driver(spark, monkeypatch):
    _written_without_broadcast(monkeypatch, area_queries)
    assert "Broadcast" not in plan(area_queries.clear_pieces(spark, SF))


def test_reached_pairs_are_written_once(spark, monkeypatch):
    """A chain of 30 nodes walked from both ends, one of the keys bound to keep off the marked edges."""
    written = []

    def counted(df, name="step"):
        out = session.materialise(df, name)
        written.append(out.count())
        return out
    monkeypatch.setattr(graph, "materialise", counted)
    edges = spark.createDataFrame([(i, i + 1, i == 10) for i in range(30)], "src long, dst long, shut boolean")
    seeds = spark.createDataFrame([(0, 0), (1, 0), (2, 25)], "k int, node long")
    got = {tuple(r) for r in graph.reachable(edges, seeds, "not (k = 1 and shut)").collect()}
    assert got == {(0, n) for n in range(31)} | {(1, n) for n in range(11)} | {(2, n) for n in range(25, 31)}
    assert sum(written) == len(got)


def test_walked_routes_are_written_once_a_block(spark, monkeypatch):
    written = []

    def named(df, name="step"):
        written.append(name)
        return session.materialise(df, name)
    monkeypatch.setattr(graph, "materialise", named)
    trees = spark.createDataFrame([(9, n, f"e{n}" if n < 9 else None, n + 1 if n < 9 else None) for n in range(10)], "target long, node long, next_edge string, next_node long")
    pairs = spark.createDataFrame([(n, n, 9) for n in range(10)] + [(99, 50, 9)], "pair int, origin long, target long")
    got = {tuple(r) for r in graph.paths(trees, pairs, hops=4).collect()}
    assert got == {(n, step, f"e{n + step}") for n in range(9) for step in range(9 - n)}
    assert written == ["walk", "walked", "walked", "walked"]


def test_the_map_index_parses_an_extract_once(spark):
    nodes, ways, _ = convert_queries._extract(spark, SF, buildings=True)
    nodes = session.materialise(nodes, "nodes")
    assert "Broadcast" not in plan(osm.assemble_ways(ways, nodes))
    index = osm.build_map_index(nodes, ways, osm.extract_box(nodes))
    for category, df in index.items():
        assert "xml" not in plan(df).lower(), category
    assert index["buildings"].count() == convert_queries.city.table(spark, SF, "customer").count()


def test_buildings_of_relations_meet_their_tags_without_a_broadcast(spark):
    tag = "tags map<string,string>"
    at = {1: (73.0, 18.0), 2: (73.001, 18.0), 3: (73.001, 18.001), 4: (73.0, 18.001)}
    nodes = spark.createDataFrame([(i, x, y, {}) for i, (x, y) in at.items()], f"id long, lon double, lat double, {tag}")
    ways = spark.createDataFrame([(10, [1, 2, 3], {}), (11, [3, 4, 1], {})], f"id long, refs array<long>, {tag}")
    relations = spark.createDataFrame([(7, [("way", 10, "outer"), ("way", 11, "outer")], {"building": "yes"})], f"id long, members array<struct<type:string,ref:long,role:string>>, {tag}")
    nodes, ways, relations = (session.materialise(df) for df in (nodes, ways, relations))
    held = osm.build_map_index(nodes, ways, osm.extract_box(nodes), relations)["buildings"]
    assert "Broadcast" not in plan(held)
    assert [(r.element_type, r.id, len(r.geometry)) for r in held.collect()] == [("relation", 7, 5)]


def test_cells_of_small_features_are_written_by_several_tasks(spark, tmp_path):
    box = {"min_lon": 70.0, "min_lat": 18.0, "max_lon": 80.0, "max_lat": 18.0}
    signals = spark.range(100).selectExpr("id", "70D + id / 10 as lon", "18D as lat")
    osm.write_map_index({"signals": signals}, str(tmp_path), box)
    files = spark.read.parquet(f"{tmp_path}/signals").withColumn("f", F.input_file_name()).select("cell", "f").distinct().collect()
    assert len({r.cell for r in files}) == len(files) == 100
    assert len({re.search(r"part-(\d+)", r.f)[1] for r in files}) > 1
    assert spark.read.parquet(f"{tmp_path}/meta").first().features == 100
