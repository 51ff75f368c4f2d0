"""Multipolygon buildings: member ways stitched into closed rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin

LINE = "array<struct<lon:double,lat:double>>"


def _rings(pieces: str) -> str:
    """Rings of one role (``done``): pieces are joined end to end until they close; not ``ok`` if one stays open."""
    none, no_line = f"cast(array() as array<{LINE}>)", f"cast(array() as {LINE})"
    state = lambda done, line, todo, ok: f"named_struct('done', {done}, 'line', {line}, 'todo', {todo}, 'ok', {ok})"
    start = state(none, no_line, pieces, f"forall({pieces}, _p -> coalesce(size(_p), 0) >= 2)")
    # The first piece left starts a ring, the first that touches its end goes on.
    touches = "transform(_a.todo, _p -> element_at(_a.line, -1) in (_p[0], element_at(_p, -1)))"
    place = f"case when not _a.ok then -1 when size(_a.line) = 0 then 0 else array_position({touches}, true) - 1 end"
    piece = "element_at(_a.todo, int(_j) + 1)"
    onward = f"if(element_at(_a.line, -1) = {piece}[0], {piece}, reverse({piece}))"
    grown = f"if(size(_a.line) = 0, {piece}, concat(_a.line, slice({onward}, 2, size({piece}))))"
    closed = "_l[0] = element_at(_l, -1)"
    rest = "concat(slice(_a.todo, 1, int(_j)), slice(_a.todo, int(_j) + 2, size(_a.todo)))"
    taken = state(f"if({closed}, concat(_a.done, array(_l)), _a.done)", f"if({closed}, {no_line}, _l)", rest, f"not ({closed}) or size(_l) >= 4")
    step = f"case when _j < 0 then {state('_a.done', '_a.line', '_a.todo', 'false')} else transform(array({grown}), _l -> {taken})[0] end"
    return (f"aggregate(sequence(1, size({pieces}) + 1), {start}, (_a, _i) -> if(size(_a.todo) = 0, _a, transform(array({place}), _j -> {step})[0]),"
            " _a -> named_struct('done', _a.done, 'ok', _a.ok and size(_a.line) = 0))")


def assemble_buildings(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Rings of every relation; one open or incomplete ring rejects the whole feature.

    ``relations``: ``id``, ``members`` (type, ref, role); ``ways``: ``id``, ``geometry``. Members
    of one relation are few, so a row is one feature's outline.
    """
    m = relations.selectExpr("id as relation_id", "posexplode(members) as (pos, m)").filter("m.type = 'way' and m.role in ('outer', 'inner')").selectExpr(
        "relation_id", "pos", "m.ref as ref", "m.role as role")
    g = ways.selectExpr("id as ref", "transform(geometry, p -> struct(p.lon, p.lat)) as geometry")
    listed = lambda role: F.expr(f"transform(array_sort(collect_list(struct(pos, geometry)) filter (where role = '{role}')), _m -> _m.geometry)").alias(role)
    pieces = m.join(g.hint("merge"), "ref", "left").groupBy("relation_id").agg(listed("outer"), listed("inner"))
    rings = pin(pieces, o=_rings("outer"), i=_rings("inner")).filter("o.ok and i.ok")
    rows = "inline(concat(transform(o.done, (_r, _n) -> named_struct('role', 'outer', 'ring', _n, 'coordinates', _r)), transform(i.done, (_r, _n) -> named_struct('role', 'inner', 'ring', _n, 'coordinates', _r))))"
    return rings.selectExpr("relation_id", rows)
