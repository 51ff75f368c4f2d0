"""Writes to the object store as DataFrame transformations: upsert, change feed, deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bounds
from ..functions.polygons import close_ring, self_crosses
from .spatial import join_points, vertices

BASE_SCENARIO = "base"


def newest(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order``. Partial per task, so a hot key never gathers."""
    rest = [c for c in batch.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return batch.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*batch.columns)


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str] = ("updated_at",), *, keep_newer: bool = False) -> DataFrame:
    """Insert or update by key; an update keeps the row's first ``created_at``.

    With ``keep_newer`` a row stays as it is if it is newer, by ``order``, than what meets it. Both
    tables meet once, by a full join, which no guess about their sizes turns into a broadcast.
    """
    rest = [c for c in table.columns if c not in keys]
    there = table.select(*keys, F.struct(*rest).alias("_old"))
    incoming = newest(batch, keys, order).select(*keys, F.struct(*rest).alias("_new"))
    both = there.join(incoming, list(keys), "full_outer")
    take = F.col("_new").isNotNull()
    if keep_newer:
        is_newer = F.struct(*[F.col(f"_new.{c}") for c in order]) >= F.struct(*[F.col(f"_old.{c}") for c in order])
        take = take & (F.col("_old").isNull() | is_newer)

    def value(c):
        new = F.coalesce("_old.created_at", "_new.created_at") if c == "created_at" else F.col(f"_new.{c}")
        return F.when(take, new).otherwise(F.col(f"_old.{c}")).alias(c)
    return both.select(*[F.col(c) if c in keys else value(c) for c in table.columns])


def apply_change_feed(table: DataFrame, changes: DataFrame, direction: str = "forward", key: str = "id") -> DataFrame:
    """Replay add / update / delete / snapshot changes on a keyed table, or undo them.

    ``changes`` has the key, ``seq``, ``kind`` and the images ``before`` and
    ``after`` (structs of the table's other columns). An update of a row that is
    absent at that moment does nothing. Undoing swaps the images and the order.
    """
    if direction == "reverse":
        changes = changes.selectExpr(
            key, "-seq as seq", "case kind when 'add' then 'delete' when 'delete' then 'add' else kind end as kind",
            "after as before", "before as after")
    elif direction != "forward":
        raise ValueError("direction is 'forward' or 'reverse'")
    rest = [c for c in table.columns if c != key]
    # A snapshot replaces everything before it; its sequence number is one value.
    reset = changes.filter("kind = 'snapshot'").agg(F.max("seq").alias("reset_seq"))
    changes = changes.join(F.broadcast(reset), F.lit(True)).filter("reset_seq is null or seq >= reset_seq")
    table = table.join(F.broadcast(reset), F.lit(True)).filter("reset_seq is null").drop("reset_seq")
    last = changes.groupBy(key).agg(
        F.expr("max_by(kind, seq) filter (where kind <> 'update')").alias("structural"),
        F.expr("max_by(after, seq) filter (where kind <> 'delete')").alias("image"))
    joined = table.select(key, F.struct(*rest).alias("_old")).join(last, key, "full_outer")
    alive = joined.filter("structural in ('add', 'snapshot') or (structural is null and _old is not null)")
    return alive.select(key, F.coalesce("image", "_old").alias("_r")).select(key, "_r.*")


def delete_objects(table: DataFrame, ids: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return table.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def delete_scenario(objects: DataFrame, scenarios: DataFrame, scenario_id: str):
    """(objects left, scenarios left, one-row count of removed objects)."""
    if scenario_id == BASE_SCENARIO:
        raise ValueError("the base scenario cannot be deleted")
    removed = objects.filter(F.col("scenario_id") == scenario_id).agg(F.count(F.lit(1)).alias("removed"))
    return (objects.filter(F.col("scenario_id") != scenario_id), scenarios.filter(F.col("id") != scenario_id), removed)


def ensure_base_scenario(scenarios: DataFrame, name: str = "Base city", description: str = "What every plan builds on", year: int = 2026) -> DataFrame:
    """Adds the base scenario if it is missing; running it again changes nothing."""
    base = scenarios.sparkSession.createDataFrame([("base", name, description, year)], "id string, name string, description string, year int")
    return scenarios.unionByName(base.join(scenarios, "id", "left_anti").select(*scenarios.columns))


def in_area_boxes(objects: DataFrame, areas: DataFrame, *, by: Sequence[str] = ("city",), tile: float = 0.004) -> DataFrame:
    """Ids of objects with any vertex inside the bounding box of any area."""
    pts = vertices(objects, [*by, "id"])
    hits = join_points(pts, areas.select(*by, "box"), tile, by=by)
    inside = hits.filter("lon >= box.min_lon and lon <= box.max_lon and lat >= box.min_lat and lat <= box.max_lat")
    return inside.select(*by, "id").distinct()


def delete_objects_in_areas(objects: DataFrame, areas: DataFrame, *, by: Sequence[str] = ("city",)) -> DataFrame:
    return objects.join(in_area_boxes(objects, areas, by=by), [*by, "id"], "left_anti")


def checked_areas(areas: DataFrame, ring: str = "boundary") -> DataFrame:
    """Areas with ``reason`` (null when good), closed ring and bounding box."""
    out = areas.selectExpr(*[c for c in areas.columns if c != ring], f"{close_ring(ring)} as {ring}", f"size({ring}) as _n")
    return out.selectExpr("*", f"case when _n < 3 then 'needs three points' when {self_crosses(ring)} then 'crosses itself' end as reason",
                          f"{bounds(ring)} as box").drop("_n")


def validate_scenarios(df: DataFrame) -> DataFrame:
    """Trimmed scenarios with ``reason`` saying why a row is refused (null: good)."""
    return df.selectExpr("id", "trim(name) as name", "description", "year", """case
        when length(coalesce(trim(name), '')) = 0 then 'name missing' when length(trim(name)) > 120 then 'name too long'
        when length(coalesce(description, '')) > 500 then 'description too long'
        when year is null or year < 1900 or year > 2200 then 'year out of range' end as reason""")
