"""Cross-entropy difference of two n-gram models.

The target model is made from chosen documents, the background model from all. Both are
bigram models over the ids of one public vocabulary, counted and smoothed alike:
``P(v | u) = (c(u, v) + S * P(v)) / (c(u) + S)`` with ``P(v) = (c(v) + 1) / (N + size)``. A
document's score is the mean over its tokens of the target's loss less the background's:
the lower, the nearer to the target.

Every document's bigrams are counted, first within a task, then by key. All bigrams of the
corpus are in the model with both losses, so scoring is one join on the bigram. The model
is broadcast while it is small and joined by key beyond that; either way a document's
losses are summed in the task before they are shuffled. Losses are whole micronats, so
sums do not depend on the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import materialise

from .bytebpe import codec
from .text import map_batches, texts

#: Weight of the unigram model in the bigram model, in counts.
SMOOTHING = 50.0
#: Bigrams (24 bytes each) and chosen ids (8 bytes each) up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_IDS = 2_000_000, 1_000_000
#: Tokens counted, and rows looked at, at a time in a task.
COUNTED, SLICE_ROWS = 2_000_000, 500
#: Keys hold the left token above the right one; the start of a text has the number after the last token.
SHIFT = 20


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, tokens) of (doc_id, text); null is the empty text."""
    def make():
        bpe = codec(vocabulary)

        def step(batch):
            rows = [bpe.ids(t).astype(np.int32) for t in texts(batch, 1)]
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
            return pa.RecordBatch.from_arrays([batch.column(0), tokens], names=["doc_id", "tokens"])
        return step

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>")


def keys_of(lists: pa.ListArray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram keys of all token lists back to back, and the lists' lengths."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    left = np.concatenate([[start], right[:-1]]) if len(right) else right
    left[(np.cumsum(lengths) - lengths)[lengths > 0]] = start
    return left << SHIFT | right, lengths


def bigrams(tokens: DataFrame, start: int) -> DataFrame:
    """(key, n) of all token lists: counted in Python within a task, then by Spark over all tasks."""
    def run(batches):
        held, size = [], 0

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

        for part in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            keys, _ = keys_of(part.column(0), start)
            held.append(keys)
            size += len(keys)
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return tokens.select("tokens").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def losses(target: DataFrame, background: DataFrame, size: int, smoothing: float = SMOOTHING) -> DataFrame:
    """(key, lt, lb): both models' losses in micronats of every bigram of the background (which holds the target)."""
    both = materialise(background.select("key", F.col("n").alias("b")).join(target.select("key", F.col("n").alias("t")), "key", "left")
                       .select("key", "b", F.coalesce("t", F.lit(0)).alias("t")), "bigrams")
    split = both.withColumn("u", F.shiftright("key", SHIFT)).withColumn("v", F.col("key").bitwiseAND((1 << SHIFT) - 1))
    lefts = split.groupBy("u").agg(F.sum("t").alias("tu"), F.sum("b").alias("bu"))
    rights = split.groupBy("v").agg(F.sum("t").alias("tv"), F.sum("b").alias("bv"))
    total = split.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("tn"), F.coalesce(F.sum("b"), F.lit(0)).alias("bn")).first()
    # one row per token of the vocabulary at most
    joined = split.join(F.broadcast(lefts), "u").join(F.broadcast(rights), "v")

    def loss(s: str):
        unigram = (F.col(f"{s}v") + 1.0) / (float(total[f"{s}n"]) + size)
        return F.round(-1e6 * F.log((F.col(s) + smoothing * unigram) / (F.col(f"{s}u") + smoothing))).cast("bigint")

    return joined.select("key", loss("t").alias("lt"), loss("b").alias("lb"))


def score(docs: DataFrame, chosen: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: tokens, both losses per token (nats), and their difference ``score``.

    ``chosen`` lists the ids of the target documents (ids that are not in ``docs`` and
    repeated ids make no difference). Null and empty texts have no tokens and null losses.
    Repeated rows are scored one by one and counted as often as they appear; null ids are
    scored, but never chosen. An empty table gives an empty result, an empty target a
    uniform target model.
    """
    lean = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    size = len(codec(vocabulary).widths)
    tokens = materialise(encode(lean, vocabulary), "tokens")
    wanted = materialise(chosen.select(F.col(chosen.columns[0]).alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "chosen")
    if wanted.count() <= BROADCAST_IDS:  # else the tokens are shuffled once to meet the ids
        wanted = F.broadcast(wanted)
    target = bigrams(tokens.join(wanted, "doc_id", "left_semi"), size)
    model = materialise(losses(target, bigrams(tokens, size), size), "model")
    if model.count() <= BROADCAST_ROWS:
        model = F.broadcast(model)

    def make():
        def step(batch):
            keys, lengths = keys_of(batch.column(1), size)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(keys))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "keys"])
        return step

    numbered = tokens.withColumn("row", F.monotonically_increasing_id())
    keyed = map_batches(numbered.select(F.struct("doc_id", "row").alias("row"), "tokens"), make, f"row struct<doc_id:{lean.schema['doc_id'].dataType.simpleString()},row:bigint>, keys array<bigint>")
    sums = (keyed.select("row", F.explode_outer("keys").alias("key")).join(model, "key", "left")
            .groupBy("row").agg(F.count("key").alias("n"), F.sum("lt").alias("lt"), F.sum("lb").alias("lb")))
    return sums.select("row.doc_id", F.col("n").alias("n_tokens"), (F.col("lt") / F.col("n") / 1e6).alias("target_loss"),
                       (F.col("lb") / F.col("n") / 1e6).alias("background_loss"), ((F.col("lt") - F.col("lb")) / F.col("n") / 1e6).alias("score"))
