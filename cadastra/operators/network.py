"""Routable network from roads: where roads meet, cuts, nodes, directed edges, turns.

All steps are joins and windows keyed by city and tile, vertex or road. Roads that
come unedited from the map meet at shared vertices only; others also where they
cross or end within the join tolerance. Written tables are small in their files only, so the
joins ask for sorted merges and none is gathered in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo as G
from ..session import forget, materialise, pin
from .geometry import vertex_rows
from .spatial import join_boxes, segments, tile_boxes

TOL = G.JOIN_TOLERANCE_DEG
LEVEL = G.LEVEL_GAP_M
PAIR_TILE_DEG = 0.0015
MIN_SPLIT_GAP = 0.000001


@dataclass
class Network:
    edges: DataFrame
    nodes: DataFrame
    separations: DataFrame
    crossings: DataFrame


def segment_pairs(roads: DataFrame) -> DataFrame:
    """Pieces of two different roads whose boxes, widened by the tolerance, overlap."""
    keep = ["city", "ord", "road_id", "osm", "imported", "layer", "size(coordinates) - 1 as pieces"]
    s = segments(roads.selectExpr(*keep, "coordinates"), ["city", "ord", "road_id", "osm", "imported", "layer", "pieces"])

    def side(p):
        return s.selectExpr("city", *[f"{c} as {p}_{c}" for c in s.columns if c != "city"])
    return join_boxes(side("p"), side("q"), PAIR_TILE_DEG, pad=TOL, a_box="p_box", b_box="q_box").filter("p_ord < q_ord")


def road_pairs(roads: DataFrame) -> DataFrame:
    """Pairs of roads whose boxes overlap, the one earlier in the list first."""
    r = roads.selectExpr("city", "ord", "road_id", f"{G.bounds('coordinates')} as box")
    a = r.selectExpr("city", "ord as ord_a", "road_id as road_a", "box as a_box")
    b = r.selectExpr("city", "ord as ord_b", "road_id as road_b", "box as b_box")
    return join_boxes(a, b, PAIR_TILE_DEG, pad=TOL).filter("ord_a < ord_b").select("city", "road_a", "road_b")


def _key(p: str) -> str:
    return f"named_struct('x', {G.e7(p + '.lon')}, 'y', {G.e7(p + '.lat')})"


def meetings(pairs: DataFrame) -> DataFrame:
    """Crossings and near touches of piece pairs.

    ``kind``: ``cross`` (both pieces cut), ``touch_p`` / ``touch_q`` (a vertex of one
    within tolerance of the other), with split point and both heights; ``apart`` is
    true where layers or heights keep the roads from joining.
    """
    df = pin(pairs, hit=G.cross_params("p_a", "p_b", "q_a", "q_b"),
             shared=f"array_intersect(array({_key('p_a')}, {_key('p_b')}), array({_key('q_a')}, {_key('q_b')}))",
             both_osm="p_osm and q_osm",
             layers_differ="p_imported and q_imported and p_layer <> q_layer")
    at = pin(df.filter("hit is not null"), x=G.along("p_a.lon", "p_b.lon", "hit.u"), y=G.along("p_a.lat", "p_b.lat", "hit.u"),
             zp=G.along("p_a.z", "p_b.z", "hit.u"), zq=G.along("q_a.z", "q_b.z", "hit.v"))
    at = at.filter(f"not ((both_osm or layers_differ) and array_contains(shared, named_struct('x', {G.e7('x')}, 'y', {G.e7('y')})))")
    cols = ["city", "p_ord", "p_road_id", "p_seg", "p_pieces", "p_layer", "q_ord", "q_road_id", "q_seg", "q_pieces", "q_layer", "both_osm"]
    cross = at.selectExpr(*cols, "'cross' as kind", "x", "y", "zp", "zq", "layers_differ as by_layer", "hit.u as u", "hit.v as v", "0D as vx", "0D as vy", "-1 as vpos")
    out = cross
    # Vertices of one road against pieces of the other: each piece stands for its
    # first vertex, the last piece also for its end.
    for me, other in (("p", "q"), ("q", "p")):
        ends = (f"filter(array(named_struct('pos', {me}_seg, 'v', {me}_a), case when {me}_seg = {me}_pieces - 1 then"
                f" named_struct('pos', {me}_seg + 1, 'v', {me}_b) end), _e -> _e is not null)")
        v = df.filter("not both_osm").selectExpr(*cols, "shared", "layers_differ", f"{other}_a as oa", f"{other}_b as ob", f"inline({ends})")
        v = pin(v, t=G.project_t("v.lon", "v.lat", "oa.lon", "oa.lat", "ob.lon", "ob.lat"))
        v = v.selectExpr("*", f"{G.along('oa.lon', 'ob.lon', 't')} as x", f"{G.along('oa.lat', 'ob.lat', 't')} as y", f"{G.along('oa.z', 'ob.z', 't')} as oz")
        v = v.filter(f"{G.degrees_apart('v.lon', 'v.lat', 'x', 'y')} < {TOL!r}D")
        out = out.unionByName(v.selectExpr(
            *cols, f"'touch_{me}' as kind", "x", "y", "v.z as zp", "oz as zq",
            f"layers_differ and not array_contains(shared, {_key('v')}) as by_layer",
            f"{G.degrees_apart('x', 'y', 'oa.lon', 'oa.lat')} as u", f"{G.degrees_apart('x', 'y', 'ob.lon', 'ob.lat')} as v", "v.lon as vx", "v.lat as vy", "pos as vpos"))
    return out.selectExpr("*", f"by_layer or abs(zp - zq) > {LEVEL}D as apart")


def split_points(roads: DataFrame, meets: DataFrame) -> DataFrame:
    """Where each road is cut: (city, ord, seg, lon, lat, z)."""
    joined = meets.filter("not both_osm and not apart")
    mid = "(zp + zq) / 2 as z"
    parts = []
    for me, other in (("p", "q"), ("q", "p")):
        parts.append(joined.filter("kind = 'cross'").selectExpr("city", f"{me}_ord as ord", f"{me}_seg as seg", "x as lon", "y as lat", mid))
        t = joined.filter(f"kind = 'touch_{me}'")
        parts.append(t.filter(f"u > {MIN_SPLIT_GAP} and v > {MIN_SPLIT_GAP}").selectExpr(
            "city", f"{other}_ord as ord", f"{other}_seg as seg", "x as lon", "y as lat", mid))
        parts.append(t.selectExpr("city", f"{me}_ord as ord", f"least(vpos, {me}_pieces - 1) as seg", "vx as lon", "vy as lat", "zp as z"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(shared_vertex_splits(roads)).distinct()


def shared_vertex_splits(roads: DataFrame) -> DataFrame:
    """Cuts of unedited map roads at vertices another such road has at the same level.

    One aggregate per vertex decides it; only vertices whose heights differ by more
    than a level are compared in pairs.
    """
    v = vertex_rows(roads.filter("osm").selectExpr("city", "ord", "size(coordinates) as n", "coordinates"), ["city", "ord", "n"])
    at = v.groupBy("city", "kx", "ky").agg(
        F.min("ord").alias("o0"), F.max("ord").alias("o1"), F.min("z").alias("z0"), F.max("z").alias("z1")).filter("o0 <> o1")
    rows = v.join(at.hint("merge"), ["city", "kx", "ky"])
    flat = rows.filter(f"z1 - z0 <= {LEVEL}D")
    steep = rows.filter(f"z1 - z0 > {LEVEL}D")
    levels = steep.selectExpr("city", "kx", "ky", "ord as other", "z as other_z").distinct()
    near = steep.alias("s").join(
        levels.hint("merge").alias("l"), (F.col("s.city") == F.col("l.city")) & (F.col("s.kx") == F.col("l.kx")) & (F.col("s.ky") == F.col("l.ky"))
        & (F.col("s.ord") != F.col("l.other")) & (F.abs(F.col("s.z") - F.col("l.other_z")) <= LEVEL), "left_semi")
    return flat.unionByName(near).selectExpr("city", "ord", "least(pos, n - 2) as seg", "lon", "lat", "z")


def cut_roads(roads: DataFrame, splits: DataFrame) -> DataFrame:
    """Pieces of every road between its cuts: (city, ord, road_id, idx, coordinates)."""
    verts = roads.selectExpr("city", "ord", "posexplode(coordinates) as (seg, p)").selectExpr(
        "city", "ord", "seg", "-1D as d2", "p.lon", "p.lat", "p.z", "0 as cut")
    starts = roads.selectExpr("city", "ord", "posexplode(coordinates) as (seg, s)")
    cuts = splits.join(starts.hint("merge"), ["city", "ord", "seg"]).selectExpr(
        "city", "ord", "seg", "power(lon - s.lon, 2) + power(lat - s.lat, 2) as d2", "lon", "lat", "z", "1 as cut")
    near = (f"cut = 1 and lag(cut) over (partition by city, ord, seg order by d2, lon, lat, z) = 1"
            f" and abs(lon - lag(lon) over (partition by city, ord, seg order by d2, lon, lat, z)) < {MIN_SPLIT_GAP}D"
            f" and abs(lat - lag(lat) over (partition by city, ord, seg order by d2, lon, lat, z)) < {MIN_SPLIT_GAP}D")
    cuts = cuts.withColumn("_near", F.expr(near)).filter("not coalesce(_near, false)").drop("_near")
    rows = verts.unionByName(cuts)
    piece = F.sum("cut").over(W.partitionBy("city", "ord").orderBy("seg", "d2", "lon", "lat", "z"))
    rows = rows.withColumn("piece", piece)
    # A cut ends one piece and starts the next.
    rows = rows.selectExpr("*", "explode(case when cut = 1 then array(piece - 1, piece) else array(piece) end) as idx")
    lines = rows.groupBy("city", "ord", "idx").agg(F.array_sort(F.collect_list(F.struct("seg", "d2", "lon", "lat", "z"))).alias("_c"))
    return lines.filter("size(_c) >= 2").selectExpr(
        "city", "ord", "idx", "transform(_c, _p -> named_struct('lon', _p.lon, 'lat', _p.lat, 'z', _p.z)) as coordinates").join(
        roads.select("city", "ord", "road_id", "osm").hint("merge"), ["city", "ord"])


# ---- nodes --------------------------------------------------------------------

def node_name(lon: str, lat: str, z: str) -> str:
    def part(x, d):
        return f"format_string('%.{d}f', {G.fixed(x, d)})"
    return f"concat('node_', {part(lon, 5)}, '_', {part(lat, 5)}, '_', {part(z, 1)})"


def cluster_nodes(ends: DataFrame) -> DataFrame:
    """Node of every road end: the earliest node within tolerance and level.

    ``ends``: city, lon, lat, z, osm and ``first`` (creation order, of any type that sorts).
    A point becomes a node unless an earlier node takes it. Points without neighbours are
    done at once; the rest are decided in rounds, each settling every point whose earlier
    neighbours are settled, which gives exactly the one-by-one result. The earliest open
    point can always be settled, so the rounds end; each works on what is still open only.
    Returns the distinct points with ``node_first`` (their node's order) and node id.
    """
    pts = materialise(ends.groupBy("city", "lon", "lat", "z", "osm").agg(F.min("first").alias("first")), "ends")
    box = pts.selectExpr("city", "first", "lon", "lat", "z", "osm", f"{G.box('lon', 'lat', 'lon', 'lat')} as box")
    size = 4 * TOL
    here = pts.selectExpr("city", "first as later", "lon", "lat", "z", "osm", f"floor(lon / {size!r}D) as tx", f"floor(lat / {size!r}D) as ty")
    there = tile_boxes(box.selectExpr("city", "first as earlier", "lon as elon", "lat as elat", "z as ez", "osm as eosm", "box"), "box", size, TOL)
    near = here.join(there.hint("merge"), ["city", "tx", "ty"]).filter(
        f"later > earlier and {G.degrees_apart('lon', 'lat', 'elon', 'elat')} < {TOL!r}D and abs(z - ez) < {LEVEL}D"
        f" and not (osm and eosm and ({G.e7('lon')} <> {G.e7('elon')} or {G.e7('lat')} <> {G.e7('elat')}))")
    near = materialise(near.select("city", "later", "earlier"), "near")
    # Verdicts, 1: a node, 0: taken by an earlier node. A point without earlier neighbours is a node.
    listed = near.select("city", F.col("later").alias("earlier")).distinct().withColumn("listed", F.lit(True))
    todo = materialise(near.join(listed.hint("merge"), ["city", "earlier"], "left").selectExpr("city", "later", "earlier", "case when listed is null then 1 end as e"), "open")
    settled = None
    while not todo.isEmpty():
        verdict = todo.groupBy("city", "later").agg(F.max("e").alias("any_node"), F.expr("count(*) - count(e)").alias("open"))
        now = materialise(verdict.selectExpr("city", "later", "case when any_node = 1 then 0 when open = 0 then 1 end as is_node").filter("is_node is not null"), "settled")
        if now.isEmpty():
            raise RuntimeError("no road end could be settled")
        left = todo.join(now.hint("merge"), ["city", "later"], "left_anti").join(now.selectExpr("city", "later as earlier", "is_node").hint("merge"), ["city", "earlier"], "left").selectExpr(
            "city", "later", "earlier", "coalesce(e, is_node) as e")
        after = materialise(left, "open")
        forget(todo)
        todo = after
        settled = now if settled is None else settled.unionByName(now)
    taken = (near.selectExpr("city", "later", "0 as is_node").limit(0) if settled is None else settled).filter("is_node = 0").select("city", "later")
    owner = near.join(taken.hint("merge"), ["city", "later"], "left_semi").join(taken.withColumnRenamed("later", "earlier").hint("merge"), ["city", "earlier"], "left_anti").groupBy(
        "city", "later").agg(F.min("earlier").alias("node_first"))
    placed = pts.join(owner.withColumnRenamed("later", "first").hint("merge"), ["city", "first"], "left").withColumn(
        "node_first", F.coalesce("node_first", "first"))
    at = placed.filter("node_first = first").selectExpr("city", "first as node_first", "lon as nlon", "lat as nlat", "z as nz")
    at = at.selectExpr("*", f"{node_name('nlon', 'nlat', 'nz')} as node_id")
    return placed.join(at.hint("merge"), ["city", "node_first"])


def build_network(roads: DataFrame) -> Network:
    """Nodes, directed edges, grade separations and unjoined crossings of all roads.

    ``roads``: city, ord, road_id, coordinates, osm, imported, layer, lane_count,
    one_way, speed_limit, capacity, lanes_a, lanes_b (lane columns may be null).
    """
    meets = materialise(meetings(segment_pairs(roads)), "meetings")
    pieces = materialise(cut_roads(roads, split_points(roads, meets)), "pieces")
    order = "named_struct('ord', ord, 'idx', idx, 'end', {})"  # creation order of any number of pieces
    ends = pieces.selectExpr("city", "osm", f"inline(array(named_struct('p', element_at(coordinates, 1), 'first', {order.format(0)}),"
                             f" named_struct('p', element_at(coordinates, -1), 'first', {order.format(1)})))").selectExpr(
        "city", "osm", "p.lon", "p.lat", "p.z", "first")
    placed = materialise(cluster_nodes(ends), "placed")
    nodes = placed.groupBy("city", "node_id").agg(F.min(F.struct("node_first", "nlon", "nlat", "nz")).alias("m")).selectExpr(
        "city", "node_id", "m.nlon as lon", "m.nlat as lat", "m.nz as z")
    look = placed.select("city", "lon", "lat", "z", "osm", "node_id")

    def end_node(df, which, name):
        p = f"element_at(coordinates, {which})"
        return df.selectExpr("*", f"{p}.lon as lon", f"{p}.lat as lat", f"{p}.z as z").join(
            look.withColumnRenamed("node_id", name).hint("merge"), ["city", "lon", "lat", "z", "osm"]).drop("lon", "lat", "z")
    e = end_node(end_node(pieces, 1, "start_node"), -1, "end_node")
    e = e.selectExpr("*", f"{G.line_length('coordinates')} as length").filter("length >= 0.1")
    attrs = roads.select("city", "ord", "lane_count", "one_way", "speed_limit", "capacity", "lanes_a", "lanes_b")
    e = e.join(attrs.hint("merge"), ["city", "ord"]).selectExpr(
        "*", "coalesce(nullif(lane_count, 0), 2) as _n").selectExpr("*", "coalesce(nullif(capacity, 0), _n * 1000) as _cap").selectExpr(
        "*", "coalesce(lanes_a, greatest(1, ceil(_n / (case when one_way then 1 else 2 end)))) as _fwd",
        "case when lanes_b > 0 then lanes_b when one_way then 0 else greatest(1, floor(_n / 2)) end as _bwd")
    fwd_cap = f"case when lanes_a is not null then {G.js_round('_cap * (_fwd / _n)')} else {G.js_round('_cap / (case when one_way then 1 else 2 end)')} end"
    bwd_cap = f"case when lanes_b > 0 then {G.js_round('_cap * (_bwd / _n)')} else {G.js_round('_cap / 2')} end"
    forward = (f"named_struct('dir', 'fwd', 'from_node', start_node, 'to_node', end_node, 'coords', coordinates, 'lanes', bigint(_fwd),"
               f" 'direction', case when one_way then 'forward' else 'both' end, 'cap', {fwd_cap})")
    back = (f"named_struct('dir', 'bwd', 'from_node', end_node, 'to_node', start_node, 'coords', reverse(coordinates), 'lanes', bigint(_bwd),"
            f" 'direction', 'backward', 'cap', {bwd_cap})")
    edges = e.selectExpr("city", "ord", "road_id", "idx", "length", "speed_limit",
                         f"inline(filter(array({forward}, case when not one_way and _bwd > 0 then {back} end), _e -> _e is not null))")
    edges = edges.selectExpr("city", "ord", "road_id", "concat(road_id, '_seg_', idx, '_', dir) as edge_id", "concat(road_id, '_seg_', idx) as segment_key",
                             "from_node", "to_node", "coords as coordinates", "length", "lanes", "direction", "speed_limit", "cap as capacity")
    seps = meets.filter("kind = 'cross' and (apart or (both_osm and coalesce(p_layer, 0) <> coalesce(q_layer, 0)))").selectExpr(
        "city", "x as lon", "y as lat", "greatest(zp, zq) as upper_z", "least(zp, zq) as lower_z",
        "case when zp > zq or (zp = zq and coalesce(p_layer, 0) >= coalesce(q_layer, 0)) then p_road_id else q_road_id end as upper_road",
        "case when zp > zq or (zp = zq and coalesce(p_layer, 0) >= coalesce(q_layer, 0)) then q_road_id else p_road_id end as lower_road")
    unjoined = meets.filter("kind = 'cross' and both_osm and not apart and coalesce(p_layer, 0) = coalesce(q_layer, 0)")
    return Network(materialise(edges, "edges"), materialise(nodes, "nodes"), seps, unjoined)


def turns(edges: DataFrame) -> DataFrame:
    """Allowed movements at every node with their names.

    Turning back along the same road is allowed only where the node has exactly one
    way in and one way out.
    """
    inc = edges.selectExpr("city", "to_node as node_id", "edge_id as from_edge", "road_id as road_in", "direction as dir_in",
                           "get(coordinates, size(coordinates) - 2) as i1", "element_at(coordinates, -1) as i2")
    out = edges.selectExpr("city", "from_node as node_id", "edge_id as to_edge", "road_id as road_out", "direction as dir_out",
                           "coordinates[0] as o1", "coordinates[1] as o2")
    degree = inc.groupBy("city", "node_id").agg(F.expr("count(1)").alias("n_in")).join(
        out.groupBy("city", "node_id").agg(F.expr("count(1)").alias("n_out")), ["city", "node_id"])
    df = inc.join(degree, ["city", "node_id"]).join(out, ["city", "node_id"]).filter(
        "not (road_in = road_out and dir_in <> dir_out and not (n_in = 1 and n_out = 1))")
    df = df.selectExpr("*", f"{G.turn_angle('i1', 'i2', 'o1', 'o2')} as angle")
    return df.selectExpr("city", "node_id", "from_edge", "to_edge", "angle", f"{G.turn_label('angle')} as direction",
                         f"{G.geometric_turn('angle')} as geometric_turn")


def node_degrees(edges: DataFrame, roundabouts: DataFrame | None = None) -> DataFrame:
    """Per node: distinct roads, arms (distinct stretches) and whether it is on a roundabout."""
    both = edges.selectExpr("city", "explode(array(from_node, to_node)) as node_id", "road_id", "segment_key").distinct()
    if roundabouts is not None:
        both = both.join(roundabouts.selectExpr("city", "road_id", "true as _r").distinct(), ["city", "road_id"], "left")
    else:
        both = both.withColumn("_r", F.lit(False))
    return both.groupBy("city", "node_id").agg(
        F.expr("count(distinct road_id)").alias("roads"), F.expr("count(distinct segment_key)").alias("arms"),
        F.expr("coalesce(bool_or(_r), false)").alias("roundabout"))


def degree_audit(degrees: DataFrame) -> DataFrame:
    kind = "case when roads = 1 then 'dead_end' when roads = 2 then 'link' when roads = 3 then 't' when roads = 4 then 'x' else 'complex' end"
    return degrees.groupBy("city", F.expr(kind).alias("kind")).agg(F.expr("count(1)").alias("nodes"))


def junction_kind() -> str:
    return ("case when arms = 1 then 'dead_end' when arms = 2 then null when roundabout then 'roundabout' when arms = 3 then 't_junction'"
            " when arms = 4 then 'crossroads' else 'complex' end")


def diagnostics(roads: DataFrame, net: Network, degrees: DataFrame) -> DataFrame:
    """One row per city: sizes, unconnected roads, separated and unjoined crossings, suspicious nodes."""
    def count(df, name, what="count(1)"):
        return df.groupBy("city").agg(F.expr(what).alias(name))
    parts = [count(net.nodes, "nodes"), count(net.edges, "edges"),
             count(roads.join(net.edges.select("city", "road_id"), ["city", "road_id"], "left_anti"), "unconnected"),
             count(net.separations, "separated"), count(net.crossings, "unjoined"),
             degrees.groupBy("city").agg(F.expr("count_if(roundabout)").alias("roundabout_nodes"), F.expr("count_if(roads > 4)").alias("suspicious"))]
    out = count(roads, "roads")
    for p in parts:
        out = out.join(p, "city", "left")
    return out.na.fill(0)
