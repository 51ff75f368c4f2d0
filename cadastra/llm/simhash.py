"""SimHash near copies through a Gray-order hierarchical index.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it.
Equal fingerprints are one class from the start, so the index holds distinct fingerprints.

Two fingerprints with at most ``distance`` differing bits agree in full on at least
``m - distance`` of any ``m`` segments of the 64 bits. Fingerprints are therefore dealt
out by the values of each choice of that many segments, and every pair within the distance
meets in some bucket. The number of segments follows from the number of fingerprints, so
that a bucket holds some hundreds to thousands of them at any size; a bucket that is still
too large is dealt out as pairs of its parts.

Inside a bucket the fingerprints are sorted by Gray rank, so neighbours share bits. Each
run of ``FAN`` neighbours has a node that keeps the bits all of them agree on; those nodes
have nodes above them in turn, and a bit that a node shares is not kept again below it.
The bucket joins itself from the top: a pair of nodes adds the differences of the bits
that both have fixed to those of the pair above it, and the whole pair of groups is dropped
as soon as the sum exceeds the distance. What reaches the leaves has its exact distance.
Buckets of a batch are joined together, so the work is array operations.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import materialise

from .components import components
from .text import free_name, map_batches, texts

DISTANCE = 4
FAN = 4
#: Fingerprints in a bucket that is joined in one go, and those in a bucket on average at most.
BUCKET, MEAN = 2048, 1024
#: Pairs that a join looks at together (memory bound).
FRONT = 1_000_000


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; no word gives zero.

    Words are cut at ASCII white space and A-Z are lower-cased; with fewer words than a
    shingle, the whole sequence is the only shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    hash_of = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash_of(joined[a:b], seed) for a, b in zip(starts[:len(words) - shingle + 1].tolist(), (ends[shingle - 1:] - 1).tolist(), strict=True)), np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the prefix parities of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def fingerprints(docs: DataFrame, text_column: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number and drops the text; null is the empty text."""
    place = docs.columns.index(text_column)
    kept = [i for i in range(len(docs.columns)) if i != place]

    def make():
        def step(batch):
            codes = np.fromiter((fingerprint(t) for t in texts(batch, place)), np.uint64, batch.num_rows)
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(codes.view(np.int64))], names=[*(batch.schema.names[i] for i in kept), name])
        return step

    return map_batches(docs, make, ", ".join([f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in kept] + [f"`{name}` bigint"]))


def segments(count: int, distance: int = DISTANCE) -> tuple[int, list[int]]:
    """How many segments, and the bit masks of the choices that key the buckets.

    The fewest segments for which ``count`` random fingerprints make buckets of at most
    ``MEAN`` on average; more segments mean longer keys and more choices.
    """
    m = distance + 1
    while m < 3 * distance and count / 2 ** (64 * (m - distance) / m) > MEAN:
        m += 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return m, [sum(c) for c in itertools.combinations(parts, m - distance)]


class Level:
    """Nodes of one height over all buckets: the bits all members share, their values, and the children's range."""

    def __init__(self, shared: np.ndarray, value: np.ndarray, first: np.ndarray, last: np.ndarray, bucket: np.ndarray):
        self.shared, self.value, self.first, self.last, self.bucket = shared, value, first, last, bucket


def build(codes: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[Level]]:
    """Sorts by (bucket, Gray rank) and builds the levels from the leaves to one root per bucket."""
    order = np.lexsort((gray_rank(codes), bucket))
    n = len(order)
    levels = [Level(np.full(n, ~np.uint64(0)), codes[order], np.arange(n), np.arange(n) + 1, bucket[order])]
    while True:
        below = levels[-1]
        m = len(below.bucket)
        start = np.r_[True, below.bucket[1:] != below.bucket[:-1]]
        heads = np.flatnonzero(start)
        if len(heads) == m:
            return order, levels
        within = np.arange(m) - heads[np.cumsum(start) - 1]
        cut = np.flatnonzero(start | (within % FAN == 0))
        ones, some = np.bitwise_and.reduceat(below.value, cut), np.bitwise_or.reduceat(below.value, cut)
        shared = np.bitwise_and.reduceat(below.shared, cut) & ~(ones ^ some)
        levels.append(Level(shared, ones & shared, cut, np.r_[cut[1:], m], below.bucket[cut]))


def _children(level: Level, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of node pairs, with the pair they come from; of a node with itself only the upper half."""
    across = level.last[b] - level.first[b]
    total = (level.last[a] - level.first[a]) * across
    pair = np.repeat(np.arange(len(total)), total)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(total) - total, total)
    x, y = level.first[a][pair] + k // across[pair], level.first[b][pair] + k % across[pair]
    keep = (a != b)[pair] | (x <= y)
    return pair[keep], x[keep], y[keep]


def close_pairs(codes: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of codes within the distance in the same bucket."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    if len(codes):
        order, levels = build(codes, bucket)
        roots = np.arange(len(levels[-1].first))
        stack = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64))]
    else:
        stack = []
    while stack:
        height, a, b, sums = stack.pop()
        if height == 0:
            keep = a != b
            found.append((order[a[keep]], order[b[keep]]))
            continue
        if len(a) > FRONT // FAN ** 2:  # in parts, depth first: the open pairs stay few
            half = len(a) // 2
            stack += [(height, a[:half], b[:half], sums[:half]), (height, a[half:], b[half:], sums[half:])]
            continue
        above, below = levels[height], levels[height - 1]
        pair, x, y = _children(above, a, b)
        # bits that both share now and not both above add their differences to the sum so far
        counted = (above.shared[a] & above.shared[b])[pair]
        fresh = below.shared[x] & below.shared[y] & ~counted
        sums = sums[pair] + np.bitwise_count((below.value[x] ^ below.value[y]) & fresh)
        keep = sums <= distance
        stack.append((height - 1, x[keep], y[keep], sums[keep]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the smallest item that the pairs connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            return label


def links(codes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that connect all pairs within the distance.

    Each bucket gives a star per connected group instead of its pairs, so a dense group
    of near copies costs a row per member and bucket.
    """
    _, masks = segments(codes.count(), distance)
    keys = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint")).alias("key")) for i, m in enumerate(masks)))
    dealt = codes.select("fp", F.inline(keys))
    sizes = dealt.groupBy("choice", "key").agg(F.count("*").alias("n")).where(f"n > {BUCKET}")
    large = materialise(sizes.selectExpr("choice", "key", f"cast(ceil(2 * n / {BUCKET}) as int) AS parts"), "buckets")
    dealt = dealt.join(large, ["choice", "key"], "left").withColumn("part", F.expr("pmod(xxhash64(fp), coalesce(parts, 1))").cast("int"))
    # a large bucket is joined as all pairs of its parts
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
    groups = (dealt.groupBy("choice", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
              .agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps"))

    def make():
        def step(batch):
            lists = batch.column(0)
            codes_ = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bucket = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            root = lowest(len(codes_), *close_pairs(codes_.view(np.uint64), bucket, distance))
            tied = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(codes_[tied]), pa.array(codes_[root[tied]])], names=["a", "b"])
        return step

    return map_batches(groups, make, "a bigint, b bigint")


def grouped(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, label, component_id, doc_id of it) for each distinct fingerprint of rows (doc_id, fp).

    ``label`` names the component by its smallest fingerprint; ``component_id`` is its
    smallest document, null if the component has no document id at all.
    """
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    tied = components(links(distinct.select("fp"), distance))
    labelled = materialise(distinct.join(tied, distinct["fp"] == tied["node"], "left")
                           .select("fp", "least", F.coalesce("root", "fp").alias("label")), "labels")
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(smallest, "label").select("fp", "label", "component_id", "least")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per document: fingerprint and the smallest document reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give
    repeated results; null ids take part but never name a component that has other ids.
    An empty table gives an empty result; other columns are not read.
    """
    rows = materialise(fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))), "simhash")
    named = grouped(rows, distance)
    return (rows.join(named, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Of every component one document: the one with the smallest id (a null id only if there is no other).

    The columns of ``docs`` come back unchanged; of repeated rows one is kept.
    """
    code = free_name(docs, "fp")
    copy = free_name(docs, "text_copy")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = materialise(fingerprints(docs.withColumn(copy, F.col(text_column)), copy, code), "simhash")
    named = grouped(rows.select(F.col(id_column).alias("doc_id"), F.col(code).alias("fp")), distance)
    # the component's document: among the fingerprints that reach the smallest id, one
    best = named.where("least <=> component_id").groupBy("label", "component_id").agg(F.min("fp").alias("_fp")).select("component_id", "_fp")
    kept = rows.join(best, rows[code].eqNullSafe(best["_fp"]) & rows[id_column].eqNullSafe(best["component_id"]), "left_semi")
    return kept.dropDuplicates([id_column, code]).select(*own)
