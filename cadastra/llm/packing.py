"""Packing of documents into fixed-length sequences by shortest-pack-first over the length histogram.

1. Every document is encoded once; an end id is added and the ids are cut into pieces of
   at most the sequence length. A piece keeps its place, length and checksum, not its ids.
2. The histogram of piece lengths (one count per length, so at most ``capacity`` rows
   whatever the input) is packed on the driver: lengths are placed longest first, each
   into the open packing pattern with the most free room (:func:`pack_histogram`). The
   result is a table of patterns with their numbers of uses.
3. Pieces are ranked within their length and joined back to the patterns by rank.

The rank is made of blocks: a piece's position inside its (length, block) and the running
count of the earlier blocks, so that no task holds all the pieces of a common length.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import materialise

from .bytebpe import codec
from .text import map_batches, texts

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids of each document.

    A null or empty text is the end id alone. Repeated rows give repeated pieces; a null id
    stays null. Other columns are not read.
    """
    def make():
        bpe = codec(vocabulary)

        def step(batch):
            ids, docs_, starts, lengths, sums, totals = batch.column(0).to_pylist(), [], [], [], [], []
            for doc, text in zip(ids, texts(batch, 1), strict=True):
                row = np.append(bpe.ids(text), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(row), capacity):
                    piece = row[at:at + capacity]
                    docs_.append(doc)
                    starts.append(at)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(row))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs_, starts, lengths, sums, totals)], names=[c.split()[0] for c in PIECES.split(", ")])
        return step

    return map_batches(docs.select(F.col(id_column).cast("bigint"), F.col(text_column).cast("string")), make, PIECES)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (piece lengths in order) with their numbers of uses.

    Lengths are placed longest first. A length goes to the pattern with the most free room
    (the shortest pack), as long as it fits; when a pattern has more uses than there are
    pieces left, the rest of its uses stay as they are. Pieces without an open pattern
    start one of their own. Patterns are kept by free room, so the work depends on the
    number of lengths and patterns, never on the number of pieces.
    """
    rooms: list[int] = []  # distinct free rooms, ascending
    open_by_room: dict[int, list[list]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], uses: int, room: int) -> None:
        if room == 0:
            done.append((pattern, uses))
            return
        if room not in open_by_room:
            open_by_room[room] = []
            insort(rooms, room)
        open_by_room[room].append([pattern, uses])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        placed = []  # joins the open patterns once no piece of this length is left
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern, uses = open_by_room[room].pop()
            fits = room // length  # several pieces of one length share a pack
            if left >= uses * fits:
                placed.append((pattern + (length,) * fits, uses, room - fits * length))
                left -= uses * fits
            else:
                full, rest = divmod(left, fits)
                if full:
                    placed.append((pattern + (length,) * fits, full, room - fits * length))
                if rest:
                    placed.append((pattern + (length,) * rest, 1, room - rest * length))
                if (kept := uses - full - bool(rest)):
                    open_by_room[room].append([pattern, kept])
                left = 0
            if not open_by_room[room]:
                del open_by_room[room]
                rooms.pop(bisect_left(rooms, room))
        if left:
            fits = capacity // length
            full, rest = divmod(left, fits)
            if full:
                placed.append(((length,) * fits, full, capacity - fits * length))
            if rest:
                placed.append(((length,) * rest, 1, capacity - rest * length))
        for pattern, uses, room in placed:
            put(pattern, uses, room)
    return done + [(p, u) for room in rooms for p, u in open_by_room[room]]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, uses, first sequence, offset) for each place of each pattern."""
    out, next_rank, sequence = [], {}, 0
    for pattern, uses in patterns:
        offset = 0
        for length in pattern:
            first = next_rank.get(length, 0)
            out.append((length, first, uses, sequence, offset))
            next_rank[length] = first + uses
            offset += length
        sequence += uses
    return out


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (columns of :func:`cut_pieces`).

    Sequences are numbered from 0 without gaps and filled from offset 0 without gaps. Equal
    pieces take the places of their length in the order of their ranks; which of two equal
    rows comes first does not change the result. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces if getattr(pieces, "_cadastra_path", None) else materialise(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    # as many blocks as pieces in a block: neither a block nor the list of blocks gets long
    blocks = max(1, math.isqrt(max(histogram.values(), default=0)))
    order = ["doc_id", "start", "ids_crc32"]
    blocked = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)).cast("int"))
    ranked = blocked.withColumn("_place", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1)
    before = (blocked.groupBy("length", "_block").agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before")))
    ranked = ranked.join(before, ["length", "_block"]).withColumn("_rank", F.col("_before") + F.col("_place"))
    places = sorted(slots(pack_histogram(histogram, capacity)))
    found = spark.createDataFrame(places, "length bigint, _first bigint, _uses bigint, _sequence bigint, offset bigint")
    # for each length: its places as one array ordered by first rank, at most a few hundred patterns long
    found = found.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_first", "_uses", "_sequence", "offset"))).alias("_places"))
    at = F.element_at(F.filter("_places", lambda p: (p["_first"] <= F.col("_rank")) & (F.col("_rank") < p["_first"] + p["_uses"])), 1)
    return (ranked.join(F.broadcast(found), "length")  # bounded: one row per length
            .withColumn("_at", at)
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_at._sequence") + F.col("_rank") - F.col("_at._first")).alias("sequence_id"), F.col("_at.offset").alias("offset")))
