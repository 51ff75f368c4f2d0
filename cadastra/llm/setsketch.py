"""Near copies by SetSketch registers, banded, estimated by likelihood and verified on full sets.

A document's set holds its distinct word shingles. Every shingle has an exponentially
distributed value per register; a register keeps the least value of the set, truncated to
an exponential scale, ``floor(1 - log_b(least))``. Sketches of parts merge by the larger
register, and two sets agree in a register with at least the probability of their Jaccard
similarity, so registers serve both as keys and for estimates.

* Equal sets are one class from the start; only classes are compared.
* Bands of ``ROWS`` registers deal classes out. A pair at the threshold shares none of the
  ``BANDS`` bands with probability ``(1 - 0.8**4)**40``, 7e-10.
* Candidates first come as stars: in every bucket all members meet the head, the one that
  shares the most buckets with others. Groups that these links join are not compared
  further. Then, of all that met one head, those that are not in its group are compared with
  the others, part by part inside a task. So a dense group costs rows in proportion to its
  members, no pair of a group is written, and no link between groups is left out.
* The joint likelihood of the registers (with both set sizes known) drops the candidates
  for which the threshold is at least ``exp(EVIDENCE)`` times less likely than the best
  similarity, about 1e-8 for a true link. What is left is counted out on the full sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import forget, materialise

from .components import components

SHINGLE, PERCENT = 4, 80
#: Registers per sketch, the scale's base, rate and largest value (Q + 1).
REGISTERS, BASE, RATE, Q = 256, 1.001, 20.0, 65_534
BANDS, ROWS = 40, 4
EVIDENCE = 18.0
#: Members and shingles of a part when members of different groups are compared, and pairs estimated together.
PART, PART_SHINGLES, PAIRS = 512, 1 << 19, 1 << 16
#: Shingles that are sketched together (memory bound), and documents at most.
POINTS, SLICE = 1 << 16, 256


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased and words cut at ASCII white space; with fewer words than a shingle
    the whole sequence is the only one; no word (or null) gives the empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_values(hashes: np.ndarray, owner: np.ndarray, sets: int, m: int = REGISTERS) -> np.ndarray:
    """For each of ``sets`` sets and each register the least exponential value of its elements.

    An element's values come in ascending order, dealt to the registers of a random
    permutation; it drops out once its next value cannot lower any register of its set.
    """
    least = np.full(sets * m, np.inf)
    element, own, value, order = hashes, owner, np.zeros(len(hashes)), None
    for j in range(m):
        if not len(element):
            break
        draw = _mix(element + np.uint64(0x632BE59BD9B4E019 * (j + 1) % 2**64))
        unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
        value = value - np.log(unit) / (RATE * (m - j))
        keep = value < least.reshape(sets, m).max(axis=1)[own]
        if not keep.all():
            element, own, value, draw = element[keep], own[keep], value[keep], draw[keep]
            order = order if order is None else order[keep]
        pick = j + (_mix(draw) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            np.minimum.at(least, own * m + pick, value)
            keep = value < least.reshape(sets, m).max(axis=1)[own]
            element, own, value, pick = element[keep], own[keep], value[keep], pick[keep]
            order = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(element), m)).copy()
            rows = np.arange(len(element))
            order[rows, pick], order[:, 0] = 0, pick
            continue
        rows = np.arange(len(element))
        register = order[rows, pick]
        order[rows, pick] = order[:, j]
        np.minimum.at(least, own * m + register, value)
    return least.reshape(sets, m)


def registers(least: np.ndarray) -> np.ndarray:
    """Truncated exponential scale of least values; 0 where a set has none."""
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(least) / math.log(BASE))
    return np.clip(np.where(np.isfinite(level), level, 0), 0, Q + 1).astype(">u2")


def sketches(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of registers per set. Large sets are sketched in parts, which merge by the larger register."""
    out = np.zeros((len(sets), m), ">u2")
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and to - at < SLICE and (to == at or size + len(sets[to]) <= POINTS):
            size += len(sets[to])
            to += 1
        sizes = [len(s) for s in sets[at:to]]
        flat, owner = np.concatenate(sets[at:to]), np.repeat(np.arange(to - at), sizes)
        for part in range(0, max(size, 1), POINTS):
            got = registers(least_values(flat[part:part + POINTS], owner[part:part + POINTS], to - at, m))
            out[at:to] = np.maximum(out[at:to], got)
        at = to
    return out


def similarity(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, m: int = REGISTERS, at: float = PERCENT / 100) -> tuple[np.ndarray, np.ndarray]:
    """Most likely Jaccard similarity, and by how much its log likelihood exceeds that of ``at``.

    ``above`` and ``below`` count the registers that are larger in a and in b.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def p(x):
        return np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    def likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        return above * np.log(more) + below * np.log(less) + (m - above - below) * np.log(np.maximum(1 - more - less, 1e-12))

    low, high, cut = np.zeros_like(top), top.copy(), (math.sqrt(5) - 1) / 2
    for _ in range(28):  # the likelihood has a single peak
        left, right = high - cut * (high - low), low + cut * (high - low)
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    best = (low + high) / 2
    return best, np.maximum(likelihood(best), likelihood(top)) - likelihood(np.minimum(at, top))


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, uid, n, digest, registers, grams) of docs (doc_id, text); ``uid`` numbers the rows.

    Write the result before use: the numbers hold for one computation of the rows.
    """
    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                marks = sketches(sets)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.arange(uid, uid + len(sets))), pa.array(np.diff(offsets)),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([r.tobytes() for r in marks], pa.binary()), grams,
                ], names=["doc_id", "uid", "n", "digest", "registers", "grams"])
                uid += len(sets)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, uid bigint, n bigint, digest binary, registers binary, grams array<bigint>")


def _alike(percent: int) -> str:
    """Whether two set sizes allow the similarity at all."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that are links: estimated by registers, then counted on the full sets."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)

    def likely(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                col = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                r_a, r_b = (np.frombuffer(b"".join(col[c].to_pylist()), ">u2").reshape(part.num_rows, -1).astype(np.int32) for c in ("r_a", "r_b"))
                n_a, n_b = (col[c].to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
                best, doubt = similarity((r_a > r_b).sum(axis=1), (r_a < r_b).sum(axis=1), n_a, n_b, r_a.shape[1], percent / 100)
                keep = pa.array((best >= percent / 100) | (doubt <= EVIDENCE))
                yield pa.RecordBatch.from_arrays([col[c].filter(keep) for c in ("a", "b", "n_a", "n_b")], names=["a", "b", "n_a", "n_b"])

    pairs = materialise(pairs.mapInArrow(likely, "a bigint, b bigint, n_a bigint, n_b bigint"), "likely")
    used = materialise(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "used")  # a known size: few ids spare the sets a shuffle
    sets = materialise(sets.join(used, "uid", "left_semi"), "sets")
    both = pairs
    for side in "ab":
        both = both.join(sets.select(F.col("uid").alias(side), F.col("grams").alias(f"g_{side}")), side)
    shared = F.size(F.array_intersect("g_a", "g_b")).cast("bigint")
    links = materialise(both.withColumn("shared", shared).where(f"100 * shared >= {percent} * (n_a + n_b - shared)").select("a", "b"), "links")
    for done in (pairs, used, sets):
        forget(done)
    return links


def linked(classes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) for the classes (uid, n, registers) that have a link; ``sets`` holds (uid, grams)."""
    band = 2 * ROWS
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(registers, {band} * i + 1, {band})))")
    dealt = classes.select("uid", "n", F.explode(keys).alias("bucket"))
    crowded = dealt.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    dealt = materialise(dealt.join(crowded, "bucket"), "buckets")

    # stars: the member that meets most others stands for the bucket
    meets = dealt.groupBy("uid").agg(F.sum("members").alias("meets"))
    heads = (dealt.join(meets, "uid").groupBy("bucket")
             .agg(F.max(F.struct("meets", "uid", "n")).alias("head")).select("bucket", F.col("head.uid").alias("head"), F.col("head.n").alias("head_n")))
    headed = materialise(dealt.join(heads, "bucket").select("bucket", "uid", "n", "head", "head_n"), "headed")
    forget(dealt)
    stars = (headed.where("uid <> head").selectExpr("least(uid, head) a", "greatest(uid, head) b", "n AS n_a", "head_n AS n_b")
             .where(_alike(percent)).select("a", "b").distinct())
    first = confirmed(stars, classes, sets, percent)
    group = materialise(components(first), "groups")

    # then, among all that met one head, those in other groups than the head's against all
    met = headed.select("head", "uid").distinct().join(group.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    met = met.join(group.select(F.col("node").alias("head"), F.col("root").alias("own")), "head", "left")
    met = materialise(met.select("head", "uid", "root", F.expr("root <> coalesce(own, head)").alias("outside")), "met")
    second = materialise(across(met, classes, sets, percent), "links")
    out = materialise(components(first.unionByName(second)), "groups")
    for done in (headed, met, group, first, second):
        forget(done)
    return out


def across(met: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different groups of those that met one head: rows (head, uid, root, outside).

    Members outside the head's group are compared with all, in bounded parts of both, inside
    a task: a row per member and part goes in, one link per member and group comes out.
    """
    weighed = met.join(classes.select("uid", "n"), "uid")
    share = lambda size, total: f"cast(ceil(greatest({size} / {PART}, {total} / {PART_SHINGLES})) as int)"
    cuts = weighed.groupBy("head").agg(F.count("*").alias("s"), F.sum("n").alias("t"), F.expr("count_if(outside)").alias("o"), F.expr("sum(if(outside, n, 0))").alias("u")).where("o > 0")
    cuts = materialise(cuts.select("head", F.expr(share("o", "u")).alias("rows"), F.expr(share("s", "t")).alias("columns")), "cuts")
    placed = met.join(cuts, "head").select("*", F.expr("pmod(xxhash64(uid, 1), rows)").cast("int").alias("i0"), F.expr("pmod(xxhash64(uid, 2), columns)").cast("int").alias("j0"))
    used = materialise(placed.select("uid").distinct(), "used")
    payload = materialise(sets.join(used, "uid", "left_semi").join(classes, "uid"), "sets")
    column = "transform(sequence(0, rows - 1), i -> named_struct('i', i, 'j', j0))"
    row = "transform(sequence(0, columns - 1), j -> named_struct('i', i0, 'j', j))"
    placed = placed.withColumn("at", F.explode(F.expr(f"if(outside, array_union({row}, {column}), {column})")))
    placed = placed.select("head", "at", "uid", "root", F.expr("outside AND at.i = i0").alias("asks"), F.expr("at.j = j0").alias("answers"))
    parts = placed.join(payload, "uid").groupBy("head", "at").agg(F.collect_list(F.struct("uid", "root", "asks", "answers", "n", "registers", "grams")).alias("members"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                links = _links(batch.column(0)[k].values, percent)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return parts.select("members").mapInArrow(run, "a bigint, b bigint")


def _links(members: pa.StructArray, percent: int) -> np.ndarray:
    """Pairs (a, b) of uids: for each asking member and each other group one link into it, if there is any."""
    uid, root, n = (members.field(c).to_numpy() for c in ("uid", "root", "n"))
    asks, answers = (members.field(c).to_numpy(zero_copy_only=False) for c in ("asks", "answers"))
    marks = np.frombuffer(b"".join(members.field("registers").to_pylist()), ">u2").reshape(len(uid), -1).astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(n)])
    shingle = np.unique(members.field("grams").flatten().to_numpy(), return_inverse=True)[1]
    inside = np.zeros(int(shingle.max(initial=-1)) + 1, np.int64)
    columns = np.flatnonzero(answers)
    found, open_rows, held = [np.zeros((0, 2), np.int64)], [], 0

    def settle():
        xs, ys, above, below = (np.concatenate(c) for c in zip(*open_rows, strict=True))
        best, doubt = similarity(above, below, n[xs].astype(float), n[ys].astype(float), marks.shape[1], percent / 100)
        likely = (best >= percent / 100) | (doubt <= EVIDENCE)
        xs, ys = xs[likely], ys[likely]
        cuts = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1], [True]])) if len(xs) else []
        for at, to in zip(cuts[:-1], cuts[1:], strict=True):
            x, other = xs[at], ys[at:to]
            own = shingle[begin[x]:begin[x + 1]]
            inside[own] = 1
            ends = np.cumsum(n[other])
            place = np.arange(ends[-1]) + np.repeat(begin[other] - ends + n[other], n[other])
            shared = np.add.reduceat(inside[shingle[place]], ends - n[other])
            inside[own] = 0
            linked_to = other[100 * shared >= percent * (n[x] + n[other] - shared)]
            linked_to = linked_to[np.unique(root[linked_to], return_index=True)[1]]
            found.append(np.column_stack([np.full(len(linked_to), uid[x]), uid[linked_to]]))

    for x in np.flatnonzero(asks):
        alike = 100 * np.minimum(n[columns], n[x]) >= percent * np.maximum(n[columns], n[x])
        other = columns[alike & (root[columns] != root[x])]
        if len(other):
            open_rows.append((np.full(len(other), x), other, (marks[x] > marks[other]).sum(axis=1), (marks[x] < marks[other]).sum(axis=1)))
            held += len(other)
        if held > PAIRS:
            settle()
            open_rows, held = [], 0
    if open_rows:
        settle()
    return np.concatenate(found)


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle
    sets. Null, empty and wordless texts have an empty set and are linked with nothing, so
    they are kept. Repeated rows are copies of each other and give repeated results; a null
    id takes part but names a component only if no member has an id (then component_id is
    null and the row is kept). An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    rows = materialise(sketched(docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")), shingle), "sketches")
    classes = materialise(rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("registers").alias("registers")), "classes")
    tied = linked(classes.select("uid", "n", "registers"), rows.select("uid", "grams"), percent)
    named = (classes.select("digest", "least_id", "uid").join(tied.withColumnRenamed("node", "uid"), "uid", "left")
             .select("digest", "least_id", F.coalesce("root", "uid").alias("root")))
    named = materialise(named, "named")
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = named.join(smallest, "root").select("digest", "component_id", F.lit(True).alias("found"))
    return (rows.select("doc_id", "n", "digest").join(labels, "digest", "left")
            .withColumn("component_id", F.expr("if(found, component_id, doc_id)"))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.expr("doc_id <=> component_id").alias("kept")))


#: DuckDB SQL for the same rows: shared shingles counted pair by pair, then closed over links.
ORACLE = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
    FROM documents
), placed AS (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM worded WHERE len(words) > 0
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM placed
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * hits >= 80 * (x.n + y.n - hits)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other
), least_id AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least_id c ON c.doc_id = d.doc_id
"""
