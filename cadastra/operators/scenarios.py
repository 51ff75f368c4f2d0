"""Planning scenarios: layered views, copies, comparisons and object summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import box_area_km2, js_round, line_length, planar_pts
from .tables import BASE_SCENARIO


def scenario_view(objects: DataFrame, scenario_id: str, key: Sequence[str] = ("id",)) -> DataFrame:
    """A scenario's own objects over the base objects it does not replace."""
    base = objects.filter(F.col("scenario_id") == BASE_SCENARIO)
    if scenario_id == BASE_SCENARIO:
        return base
    own = objects.filter(F.col("scenario_id") == scenario_id)
    return own.unionByName(base.join(own.select(*key).distinct(), list(key), "left_anti"))


def clone_scenario(objects: DataFrame, source_id: str, target_id: str) -> DataFrame:
    """Copies of a scenario's objects under a new scenario, ids ``stem__target``."""
    copies = objects.filter(F.col("scenario_id") == source_id).withColumns({
        "id": F.concat(F.split_part("id", F.lit("__"), F.lit(1)), F.lit(f"__{target_id}")), "scenario_id": F.lit(target_id)})
    return objects.unionByName(copies)


def compare_scenarios(objects: DataFrame, mode: str = "as_reference") -> DataFrame:
    """What each proposal adds, one row per scenario.

    ``as_reference`` counts an override in full; ``effective`` subtracts the base
    building it replaces.
    """
    km = f"({line_length('coordinates')} / 1000)"
    own = objects.filter(F.col("scenario_id") != BASE_SCENARIO)
    measures = {"pop_delta": "population", "water_delta": "water", "elec_delta": "electricity"}
    sums = [F.expr(f"sum(case when type = 'building' then coalesce({c}, 0) else 0 end)").alias(n) for n, c in measures.items()]
    out = own.groupBy("scenario_id").agg(
        *sums,
        F.expr(f"sum(case when type = 'road' then {km} * coalesce(lane_count, 0) else 0 end)").alias("new_road_lane_km"),
        F.expr(f"sum(case when type in ('flyover', 'metro_flyover') then {km} else 0 end)").alias("new_flyover_km"),
        F.expr(f"sum(case when type in ('metro_line', 'metro_flyover') then {km} else 0 end)").alias("new_metro_km"),
        F.expr("count_if(type = 'metro_station')").alias("new_stations"), F.expr("count_if(type = 'building')").alias("new_buildings"))
    if mode == "as_reference":
        return out
    base = objects.filter((F.col("scenario_id") == BASE_SCENARIO) & (F.col("type") == "building"))
    replaced = own.select("scenario_id", "id").distinct().join(base.drop("scenario_id"), "id")
    less = replaced.groupBy("scenario_id").agg(*[F.expr(f"sum(coalesce({c}, 0))").alias(f"less_{n}") for n, c in measures.items()])
    return out.join(less, "scenario_id", "left").withColumns(
        {n: F.expr(f"{n} - coalesce(less_{n}, 0)") for n in measures}).select(*out.columns)


def ordered_scenarios(scenarios: DataFrame) -> DataFrame:
    """Base first, then by year and name; the list holds scenarios, not objects."""
    return scenarios.withColumn("position", F.row_number().over(W.orderBy(F.expr("id <> 'base'"), "year", "name", "id")))


def is_user_built() -> str:
    """SQL condition: drawn by a planner rather than imported."""
    return "(not startswith(id, 'osm_') and not coalesce(has_provenance, false) and osm_id is null and coalesce(source, '') <> 'OSM')"


def project_list(objects: DataFrame) -> DataFrame:
    """User-built objects by group with counts and lengths in km."""
    group = ("case when type in ('road', 'flyover', 'metro_flyover') then 'Roads and flyovers' when type in"
             " ('metro_line', 'metro_station') then 'Metro' when type = 'building' then 'Buildings' else 'Other' end")
    metres = f"case when type in ('building', 'zone') then 0D else {line_length('coordinates', planar_pts)} end"
    return objects.selectExpr("scenario_id", f"{group} as grp", f"{metres} as m").groupBy("scenario_id", "grp").agg(
        F.expr("count(1)").alias("objects"), F.expr("sum(m) / 1000").alias("km"))


def population_summary(buildings: DataFrame) -> DataFrame:
    """City totals, density over the box of all footprints, peak movement.

    Sums and box come from one pass over buildings, footprints reduced to their own
    boxes first so no row is repeated per vertex.
    """
    out = buildings.groupBy("city").agg(
        F.sum("population").alias("population"), F.expr("sum(population * 135D)").alias("water"),
        F.expr("sum(population * 5D)").alias("electricity"), F.expr(
            "named_struct('min_lon', min(array_min(coordinates.lon)), 'min_lat', min(array_min(coordinates.lat)),"
            " 'max_lon', max(array_max(coordinates.lon)), 'max_lat', max(array_max(coordinates.lat)))").alias("b"))
    return out.selectExpr("city", "population", "water", "electricity", f"{box_area_km2('b')} as area_km2",
                          f"{js_round('population * 0.45D')} as peak_movement").selectExpr(
        "*", f"case when area_km2 > 0 then {js_round('population / area_km2')} else 0 end as density")


def visible_objects(objects: DataFrame, layers: DataFrame) -> DataFrame:
    """Objects whose layer is shown; unknown layers are shown. ``layers`` is a short settings list."""
    return objects.join(layers.select(F.col("id").alias("layer_id"), "visible"), "layer_id", "left").filter(
        "coalesce(visible, true)").drop("visible")


# People per floor, litres and kWh per person, parking per floor by use.
RESIZE_FACTORS = {"residential": (10, 150, 6, 2), "commercial": (25, 60, 15, 8), "industrial": (15, 300, 40, 2),
                  "educational": (20, 45, 8, 2)}


def resized_buildings(buildings: DataFrame) -> DataFrame:
    """Floors, people, demand and parking that follow from a new height (columns ``height``, ``usage``)."""
    def factor(i):
        return "case usage " + " ".join(f"when '{u}' then {f[i]}" for u, f in RESIZE_FACTORS.items()) + f" else {RESIZE_FACTORS['residential'][i]} end"
    out = buildings.selectExpr("*", f"greatest(1L, {js_round('height / 3')}) as new_floors")
    out = out.selectExpr("*", f"new_floors * {factor(0)} as new_population")
    return out.selectExpr("*", f"new_population * {factor(1)} as new_water", f"new_population * {factor(2)} as new_electricity",
                          f"greatest(1L, new_floors * {factor(3)}) as new_parking")


def listed_names(names: str, most: int = 3) -> str:
    """SQL text: the first names of an array, once each, and how many more there are."""
    return (f"concat(array_join(slice(array_distinct({names}), 1, {most}), ', '), case when size(array_distinct({names})) > {most}"
            f" then concat(' and ', size(array_distinct({names})) - {most}, ' more') else '' end)")


def lanes_text(forward: str, backward: str) -> str:
    return (f"case when {backward} = 0 then concat({forward}, ', one-way') when {forward} = {backward}"
            f" then concat({forward}, ' each way') else concat({forward}, ' + ', {backward}) end")
