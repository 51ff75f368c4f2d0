"""Outlines of several ways, against stitching one relation at a time."""
import random

from cadastra.operators import rings


def stitched(pieces):
    """Rings of one role, or None if one stays open."""
    if any(p is None or len(p) < 2 for p in pieces):
        return None
    out, todo = [], list(pieces)
    while todo:
        line = list(todo.pop(0))
        while line[0] != line[-1]:
            nxt = next((p for p in todo if line[-1] in (p[0], p[-1])), None)
            if nxt is None:
                return None
            todo.remove(nxt)
            line += (nxt if nxt[0] == line[-1] else nxt[::-1])[1:]
        if len(line) < 4:
            return None
        out.append(line)
    return out


def relation(rng, ways):
    """Members of one relation: rings cut at random, turned round, shuffled and now and then damaged."""
    members = []
    for _ in range(rng.randint(0, 3)):
        x, y, n = rng.randint(0, 3) * 100, rng.randint(0, 3) * 100, rng.randint(2, 6)
        ring = [(float(x + i), float(y + i * i % 7)) for i in range(n)]
        ring.append(ring[0])
        cuts = [0, *sorted(rng.sample(range(1, n), rng.randint(0, min(3, n - 1)))), n]
        role = rng.choice(["outer", "outer", "inner", "label"])
        for a, b in zip(cuts, cuts[1:]):
            piece = ring[a:b + 1]
            ways.append(piece[::-1] if rng.random() < 0.4 else piece)
            members.append(("way" if rng.random() < 0.97 else "node", len(ways) - 1 if rng.random() < 0.95 else -1, role))
    rng.shuffle(members)
    if rng.random() < 0.1:
        ways.append([(1.0, 1.0)][:rng.randint(0, 1)])
        members.append(("way", len(ways) - 1, "outer"))
    return members


def test_rings_are_those_of_stitching_one_by_one(spark):
    rng = random.Random(3)
    ways = []
    relations = [(i, relation(rng, ways)) for i in range(400)]
    want = set()
    for i, members in relations:
        got = {role: stitched([ways[ref] if ref >= 0 else None for kind, ref, r in members if kind == "way" and r == role]) for role in ("outer", "inner")}
        if None not in got.values():
            want |= {(i, role, n, tuple(line)) for role, lines in got.items() for n, line in enumerate(lines)}
    rel = spark.createDataFrame(relations, "id long, members array<struct<type:string,ref:long,role:string>>")
    geo = spark.createDataFrame(list(enumerate(ways)), "id long, geometry array<struct<lon:double,lat:double>>")
    out = rings.assemble_buildings(rel, geo)
    assert {(r.relation_id, r.role, r.ring, tuple((p.lon, p.lat) for p in r.coordinates)) for r in out.collect()} == want and len(want) > 100
    assert len({i for i, *_ in want}) < 380


def test_rings_start_no_python_per_relation(spark):
    rel = spark.createDataFrame([(1, [("way", 1, "outer")])], "id long, members array<struct<type:string,ref:long,role:string>>")
    geo = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)])], "id long, geometry array<struct<lon:double,lat:double>>")
    plan = rings.assemble_buildings(rel, geo)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Broadcast" not in plan
