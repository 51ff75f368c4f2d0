"""Bulk edits of roads: section repair with backup, joins, splits, clipping, import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.polygons import centroid, in_polygon, in_reach
from ..session import forget, materialise, pin
from . import convert as cv
from .nearest import TILE_DEG, road_ends
from .spatial import join_boxes, join_points, segments


def repair_plan(roads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(backup of rows to change with ``before`` and ``after``, ids that cannot be repaired)."""
    df = cv.repaired_sections(roads)
    changes = df.filter("changed and size(repaired) > 0").select("id", F.col("sections").alias("before"), F.col("repaired").alias("after"))
    skipped = df.filter("size(sections) = 0 or size(repaired) = 0").select("id")
    return changes, skipped


def apply_repair(roads: DataFrame, backup: DataFrame) -> DataFrame:
    return roads.join(backup.select("id", "after").hint("merge"), "id", "left").withColumn("sections", F.coalesce("after", "sections")).drop("after")


def restore_sections(roads: DataFrame, backup: DataFrame) -> DataFrame:
    """Put the originals back; refuses if any row was edited since the repair."""
    edited = backup.join(roads.select("id", "sections").hint("merge"), "id", "left").filter("not (sections <=> after)")
    if not edited.isEmpty():
        raise ValueError("a road was edited after the repair; nothing was restored")
    return roads.join(backup.select("id", "before").hint("merge"), "id", "left").withColumn("sections", F.coalesce("before", "sections")).drop("before")


def clip_lines(lines: DataFrame, areas: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Parts of lines inside (possibly concave) areas, numbered along each line.

    Each piece of line is cut at the parameters where it meets a side of the area;
    stretches are kept when their middle is inside and joined up again where they
    follow on without a gap.
    """
    key = [*by, "id", "area_id"]
    s = segments(lines, [*by, "id"]).selectExpr(*by, "id", "seg", "a", "b", "box as a_box")
    whole = areas.selectExpr(*by, "area_id", "boundary", f"{G.bounds('boundary')} as b_box")
    near = join_boxes(s, whole, TILE_DEG * 4, by=by).select(*key, "seg", "a", "b")
    sides = segments(areas, [*by, "area_id"], "boundary").selectExpr(*by, "area_id", "a as c", "b as d", "box as b_box")
    cuts = join_boxes(s, sides, TILE_DEG * 4, by=by)
    cuts = cuts.selectExpr(*key, "seg", f"({G.cross_params('a', 'b', 'c', 'd')}).u as t").filter("t > 1e-9 and t < 1 - 1e-9")
    ends = near.selectExpr(*key, "seg", "explode(array(0D, 1D)) as t")
    t = cuts.unionByName(ends).distinct()
    nxt = "lead(t) over (partition by {0}, seg order by t)".format(", ".join(key))
    spans = t.withColumn("t1", F.expr(nxt)).filter("t1 is not null and t1 - t > 1e-9").join(near, [*key, "seg"])
    spans = spans.join(areas.select(*by, "area_id", "boundary"), [*by, "area_id"])
    mid = "(t + t1) / 2"
    kept = pin(spans, mx=G.along("a.lon", "b.lon", mid), my=G.along("a.lat", "b.lat", mid)).filter(in_polygon("mx", "my", "boundary", "boundary"))
    order = ", ".join(key)
    kept = kept.withColumn("fresh", F.expr(
        f"case when lag(seg + t1) over (partition by {order} order by seg, t) = seg + t then 0 else 1 end"))
    kept = kept.withColumn("piece", F.expr(f"sum(fresh) over (partition by {order} order by seg, t) - 1"))
    row = G.pt(G.along("a.lon", "b.lon", "{0}"), G.along("a.lat", "b.lat", "{0}"), G.along("a.z", "b.z", "{0}"))
    parts = kept.groupBy(*key, "piece").agg(
        F.expr(f"array_sort(collect_list(struct(seg, t, {row.format('t')} as p, {row.format('t1')} as q)))").alias("_r"))
    return parts.selectExpr(*key, "piece", "concat(array(_r[0].p), transform(_r, x -> x.q)) as coordinates",
                            "_r[0].t > 0 or _r[0].seg > 0 as start_cut", "element_at(_r, -1).t as _t").drop("_t")


def clip_buildings(buildings: DataFrame, areas: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Buildings whose footprint centroid lies in an area."""
    b = pin(buildings.filter("size(coordinates) >= 3"), _c=centroid("coordinates")).selectExpr("*", "_c.lon as lon", "_c.lat as lat").drop("_c")
    shapes = areas.selectExpr(*by, "area_id", "boundary", f"{G.bounds('boundary')} as box")
    return join_points(b, shapes, TILE_DEG * 4, by=by).filter(f"{in_reach('lon', 'lat')} and {in_polygon('lon', 'lat', 'boundary', 'boundary')}").drop("boundary", "box", "lon", "lat")


def fold_order(edges: DataFrame, join_m: float = 12.0, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Short stretches in the order in which their ends are folded: ``rank`` by length, then ``ord_key``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("length", "ord_key"))
    return edges.filter(f"length < {join_m}").select(*by, "ord_key", "length", rank.cast("bigint").alias("rank"))


def fold_junctions(edges: DataFrame, nodes: DataFrame, join_m: float = 12.0, max_span_m: float = 30.0) -> DataFrame:
    """Junction of every node after merging nodes joined by short stretches, shortest first.

    A merge is refused when the merged junction would span more than ``max_span_m``.
    One by one order is kept without a single queue: in each round every stretch that
    is the shortest left at both of its junctions is settled, which no other open
    stretch can influence.
    """
    todo = materialise(edges.filter(f"length < {join_m}").selectExpr("struct(length, ord_key) as o", "src as a", "dst as b"), "short")
    of = materialise(nodes.selectExpr("node", "node as root"), "of")
    boxes = materialise(nodes.selectExpr("node as root", "lat as lat0", "lon as x0", "lat as y0", "lon as x1", "lat as y1"), "spans")
    while not todo.isEmpty():  # the shortest stretch of all is always settled, so this ends
        first = todo.selectExpr("o", "explode(array(a, b)) as r").groupBy("r").agg(F.min("o").alias("m"))
        ready = todo.join(first.selectExpr("r as a", "m as ma"), "a").join(first.selectExpr("r as b", "m as mb"), "b").filter("o = ma and o = mb")
        ba = boxes.selectExpr("root as a", *[f"{c} as a_{c}" for c in ("lat0", "x0", "y0", "x1", "y1")])
        bb = boxes.selectExpr("root as b", *[f"{c} as b_{c}" for c in ("x0", "y0", "x1", "y1")])
        ready = ready.join(ba, "a").join(bb, "b").selectExpr("o", "a", "b", "a_lat0 as lat0", "least(a_x0, b_x0) as x0", "least(a_y0, b_y0) as y0",
                                                           "greatest(a_x1, b_x1) as x1", "greatest(a_y1, b_y1) as y1")
        m = f"{G.METRES_PER_DEG}D"
        ready = materialise(ready.selectExpr("*", f"sqrt(power((x1 - x0) * {m} * cos(radians(lat0)), 2) + power((y1 - y0) * {m}, 2)) <= {max_span_m} as ok"), "ready")
        merged = ready.filter("ok")
        to = merged.selectExpr("b as root", "a as new_root")
        of2 = materialise(of.join(to, "root", "left").selectExpr("node", "coalesce(new_root, root) as root"), "of")
        grown = merged.selectExpr("a as root", "lat0", "x0", "y0", "x1", "y1")
        gone = grown.select("root").unionByName(to.select("root"))
        boxes2 = materialise(boxes.join(gone, "root", "left_anti").unionByName(grown), "spans")
        left = todo.join(ready.select("o"), "o", "left_anti")
        for side in ("a", "b"):
            left = left.join(to.withColumnsRenamed({"root": side, "new_root": "_n"}), side, "left").withColumn(side, F.coalesce("_n", side)).drop("_n")
        todo2 = materialise(left.filter("a <> b").select("o", "a", "b"), "short")
        for old in (todo, of, boxes, ready):
            forget(old)
        todo, of, boxes = todo2, of2, boxes2
    return of


def flyovers_connected(flyovers: DataFrame, nodes: DataFrame, edges: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Whether each flyover end meets, within tolerance and level, a node another road uses."""
    ends = road_ends(flyovers.withColumnRenamed("flyover_id", "road_id"), by=by)
    n = nodes.selectExpr(*by, "node", "lon as nlon", "lat as nlat", "z as nz", f"{G.box('lon', 'lat', 'lon', 'lat')} as box")
    hit = join_points(ends, n, TILE_DEG, by=by, pad=G.JOIN_TOLERANCE_DEG).filter(
        f"{G.degrees_apart('lon', 'lat', 'nlon', 'nlat')} < {G.JOIN_TOLERANCE_DEG!r}D and abs(z - nz) < {G.LEVEL_GAP_M}D")
    used = edges.selectExpr("road_id", "explode(array(src, dst)) as node").distinct()
    good = hit.join(used, "node").filter("road_id <> own").select(*by, "own", "which").distinct()
    per = ends.join(good.withColumn("hit", F.lit(True)), [*by, "own", "which"], "left").groupBy(*by, "own").agg(
        *[F.expr(f"coalesce(bool_or(which = '{w}' and hit), false)").alias(f"{w}_connected") for w in ("start", "end")])
    return per.selectExpr(*by, "own as flyover_id", "start_connected", "end_connected", "start_connected and end_connected as connected")


def road_connections(edges: DataFrame, ends: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    """Other roads at the start, the end and along every road.

    ``edges``: road_id, src, dst; ``ends``: road_id, start_node, end_node.
    """
    at = edges.selectExpr(*by, "road_id", "explode(array(src, dst)) as node").distinct()
    mine = at.join(ends, [*by, "road_id"]).selectExpr(
        *by, "road_id", "node", "case when node = start_node then 'start' when node = end_node then 'end' else 'along' end as place")
    return mine.join(at.withColumnRenamed("road_id", "other"), [*by, "node"]).filter("road_id <> other").select(*by, "road_id", "place", "other").distinct()


__all__ = ["repair_plan", "apply_repair", "restore_sections", "clip_lines", "clip_buildings",
           "fold_order", "fold_junctions", "flyovers_connected", "road_connections"]
