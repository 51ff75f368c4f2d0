"""Approximate nearest neighbours: one small-world graph per shard, results of the shards merged.

1. Equal vectors become one point with its smallest ids, as many as a result can need.
2. Points are dealt to shards by a hash of the vector; the number of shards follows from the
   number of points, so a shard's graph stays small. Each graph is written once to the shared
   folder as flat arrays.
3. Queries are gathered into blocks, and every block meets every shard once. Each meeting
   gives at most ``k`` rows per query, with products in double precision on the original
   vectors; the best ``k`` of all shards are the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import materialise

from . import hnsw

#: Points per shard and queries per block, about; beam width of the search.
SHARD, BLOCK, BEAM = 8192, 1024, 144
_INDEX = "shard int, dim int, points binary, ids binary, id_ends binary, nodes array<binary>, links array<binary>"


def usable(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v) of rows that take part: an id and a non-zero vector of finite numbers; exact repeats once."""
    v = F.col(vector_column).cast("array<float>")
    kept = rows.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf')) AND exists(v, x -> x <> 0)")
    return kept.dropDuplicates(["id", "v"])


def build_index(points: DataFrame, k: int = 20, shard_size: int = SHARD) -> tuple[DataFrame, int]:
    """One row per shard with its graph, and the number of shards. ``points`` has (id, v).

    A point keeps its ``k + 1`` smallest ids: no result can hold more of its copies. The limit
    per vector is applied before the shuffle too, so a vector with any number of copies
    costs a few rows per task.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = materialise(points.withColumn("_n", place).where(F.col("_n") <= k + 1)
                           .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    shards = -(-distinct.count() // shard_size)
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(max(1, shards))).cast("int"))

    def graph(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.argsort([i[0] for i in frame["ids"]], kind="stable")]
        vectors = np.stack(frame["v"].to_list()).astype(np.float32)
        made = hnsw.build(vectors)
        ids = np.concatenate(frame["ids"].to_list()).astype(np.int64)
        ends = np.cumsum([len(i) for i in frame["ids"]]).astype(np.int64)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "dim": [vectors.shape[1]], "points": [vectors.tobytes()], "ids": [ids.tobytes()], "id_ends": [ends.tobytes()],
                             "nodes": [[n.tobytes() for n, _ in made.layers]], "links": [[x.tobytes() for _, x in made.layers]]})

    return materialise(dealt.groupBy("shard").applyInPandas(graph, _INDEX), "index"), shards


def search_index(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for queries (id, v); a query's own id is left out."""
    schema = "query_id bigint, vec_id bigint, score double"
    blocks = max(1, -(-queries.count() // block))
    gathered = queries.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    meetings = gathered.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(1, shards) - 1)))).join(index, "shard")

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_pandas(_meet(batch.slice(at, 1).to_pylist()[0], k, beam), preserve_index=False)

    found = meetings.select("queries", "dim", "points", "ids", "id_ends", "nodes", "links").mapInArrow(run, schema)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(row: dict, k: int, beam: int) -> pd.DataFrame:
    """A block of queries against a shard."""
    dim = row["dim"]
    vectors = np.frombuffer(row["points"], np.float32).reshape(-1, dim)
    ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64)
    starts = np.r_[0, ends[:-1]]
    layers = [(nodes := np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(len(nodes), -1)) for a, b in zip(row["nodes"], row["links"], strict=True)]
    graph = hnsw.Graph(hnsw.lift(vectors), layers)
    asked = [q for q in row["queries"] if len(q["v"]) == dim]
    out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
    for at in range(0, len(asked), 512):
        part = asked[at:at + 512]
        own = np.array([q["id"] for q in part], np.int64)
        exact = np.array([q["v"] for q in part], np.float64).reshape(len(part), dim)
        near = graph.search(np.concatenate([exact, np.zeros((len(part), 1))], axis=1).astype(np.float32), beam)
        rows, cols = np.nonzero(near >= 0)
        node = near[rows, cols]
        score = (exact[rows] * vectors[node].astype(np.float64)).sum(axis=1)
        # a point stands for all its ids; sort by query, product and id and keep the first k of each query
        times = ends[node] - starts[node]
        which = np.repeat(np.arange(len(node)), times)
        vec = ids[np.repeat(starts[node], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
        q, s = rows[which], score[which]
        keep = vec != own[q]
        q, s, vec = q[keep], s[keep], vec[keep]
        order = np.lexsort((vec, -s, q))
        q, s, vec = q[order], s[order], vec[order]
        heads = np.searchsorted(q, np.arange(len(part)))
        first = np.arange(len(q)) - heads[q] < k
        out["query_id"].append(own[q[first]])
        out["vec_id"].append(vec[first])
        out["score"].append(s[first])
    return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(rows: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The ``k`` largest inner products for each row whose id is divisible by ``every``, against all rows.

    Null ids and vectors that are null, zero or hold a null or non-finite number take no
    part. Ties go to the smaller id. Vectors of another dimension than a query are no
    candidates of it as long as they are in other shards; tables hold one dimension. With
    fewer than ``k`` candidates all are returned; an empty table gives an empty result.
    """
    points = materialise(usable(rows, id_column, vector_column), "points")
    index, shards = build_index(points, k)
    return search_index(index, shards, points.where(F.col("id") % every == 0), k)
