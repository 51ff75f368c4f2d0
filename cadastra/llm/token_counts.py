"""Token counts of a text's sections, from one encoding of the whole text.

The whole document is encoded once and each token gets its character span. An interval join
of those spans with the section spans, both in order within the document, gives each token to
sections; it needs no shuffle, since both sides are in the row. The allocation rule for a
token that touches several sections: it goes to the section that holds most of its
characters, the earliest of equals. A token whose characters lie in no section belongs to
section -1. So every token is counted exactly once, and the sections of a document add up to
its length in tokens, which counting the sections one by one would not give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import codec
from .text import map_batches, texts

ROWS = "doc_id bigint, section int, name string, start bigint, end bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """A text's lines, each with its line break; the first is the head, the others the body."""
    out, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        out.append(("body" if out else "head", at, end))
        at = end
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span (-1: none) and whether it reaches beyond that section.

    ``first`` and ``last`` are the borders of the sections, in order and without overlap.
    """
    if not len(first):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    low = np.searchsorted(last, starts, side="right")  # first section that ends behind the token's start
    high = np.searchsorted(first, ends, side="left") - 1  # last one that starts before its end
    section = np.where(low == high, low, -1)
    inside = (low <= high) & (low < len(first))
    at = np.minimum(low, len(first) - 1)
    crossing = inside & ((first[at] > starts) | (last[at] < ends))
    for k in np.flatnonzero(inside & (low < high)):
        shared = [min(ends[k], last[s]) - max(starts[k], first[s]) for s in range(low[k], high[k] + 1)]
        section[k] = low[k] + int(np.argmax(shared))
        crossing[k] = True
    return section, crossing


def count(docs: DataFrame, vocabulary: str, sections_column: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per section of each document: its span (code points), tokens, and those of them that cross its border.

    ``sections_column`` holds an array of (name, start, end) structs, in any order and
    without overlap; without it the sections are the lines. Null and empty texts have one
    empty line. A row for section -1 appears only if a token lies in no section; a null
    section list leaves all tokens there. Repeated rows are counted one by one; an empty
    table gives an empty result.
    """
    columns = [F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")]
    if sections_column is not None:
        columns.append(F.col(sections_column).alias("sections"))

    def make():
        bpe = codec(vocabulary)

        def step(batch):
            out: list[tuple] = []
            given = batch.column(2).to_pylist() if sections_column is not None else None
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True)):
                sections = line_sections(text) if given is None else sorted(((s["name"], s["start"], s["end"]) for s in given[k] or []), key=lambda s: (s[1], s[2]))
                first = np.array([s[1] for s in sections], np.int64)
                last = np.array([s[2] for s in sections], np.int64)
                ids = bpe.ids(text)
                section, crossing = allocate(*bpe.spans(text, ids), first, last) if len(ids) else (np.zeros(0, np.int64), np.zeros(0, bool))
                tokens = np.bincount(section + 1, minlength=len(sections) + 1)
                crossed = np.bincount(section[crossing] + 1, minlength=len(sections) + 1)
                if tokens[0]:
                    out.append((doc, -1, None, None, None, tokens[0], crossed[0], len(ids)))
                out += [(doc, i, *s, t, c, len(ids)) for i, (s, t, c) in enumerate(zip(sections, tokens[1:].tolist(), crossed[1:].tolist(), strict=True))]
            kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            names = [c.split()[0] for c in ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)
        return step

    return map_batches(docs.select(*columns), make, ROWS)
