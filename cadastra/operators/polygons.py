"""Polygon clipping jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import polygons as P
from ..session import pin


def clip_rings(rings: DataFrame, ring: str = "boundary") -> DataFrame:
    """Part of each ring inside its own box: one half-plane after another (column ``clipped``)."""
    df = rings.withColumnRenamed(ring, "clipped")
    for axis, limit, above in P.BOX_CUTS:
        rest = [c for c in df.columns if c != "clipped"]
        df = pin(df.withColumnRenamed("clipped", "_r"), clipped=P.clip_half_plane("_r", axis, limit, above)).select(*rest, "clipped")
    return df
