"""Helpers for operators that read texts batch by batch inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SLICE_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a batch function to every Arrow batch; ``make`` runs once per task, on the executor.

    Spark bounds a batch by rows and by bytes, and a batch is worked on in slices, so memory
    does not grow with the input and very long texts come in small batches.
    """
    def run(batches):
        step = make()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), SLICE_ROWS):
                yield step(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts of a batch; a null text is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def struct_text(spans: str, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of an array of (kind, start, end) structs, comma-joined in array order."""
    listed = F.col(spans)
    if kinds is not None:
        listed = F.filter(listed, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(listed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def span_array(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
    """Arrow array of spans per document from lists of (kind, start, end)."""
    offsets, kinds, starts, ends = [0], [], [], []
    for spans in rows:
        for kind, start, end in spans:
            kinds.append(kind)
            starts.append(start)
            ends.append(end)
        offsets.append(len(kinds))
    items = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
