"""Quality rules whose thresholds adapt to each language and source.

Every text is measured once. The measures of a group (language, source) are kept as a
quantile sketch: counts of logarithmic bins, exact to one part in 32, which merge by adding
up. The sketches of a language's sources merge into the language's sketch. Thresholds lie
around the shortest interval of values that holds half of a group's documents: its ends plus
a multiple of its length plus a slack. Bad documents scatter, so they do not move that
interval, on whichever side they are, until they are more than half of a group. A source's
threshold is drawn towards its language's by the weight of ``PRIOR`` documents, so that a
source with few documents does not set its own standard. Documents are then filtered by a
join with the thresholds.

A few bins per group are all that is shuffled, whatever a group's share of the rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.session import materialise

from .text import free_name, map_batches, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Measure -> (multiple of the interval's length, slack, slack below or None, largest threshold or None).
#: Symbols and doubled lines are per thousand words and lines, word length in hundredths.
FENCES = {"symbols": (2, 250, None, None), "doubled": (2, 400, None, 900), "length": (3, 300, 300, None)}
PRIOR = 100
#: A threshold table of at most this many rows (about 100 bytes each) is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 20_000
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The base counts of one text and its number of lines with a word.

    ``bytes.split`` cuts at exactly the ASCII white space that separates words here.
    """
    words = text.encode().split()
    n = len(words)
    if not n:
        return 0, 0, 0 if not text else sum(map(text.count, SYMBOLS)), 0, 0, 0
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.encode().split()]
    grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        first, marked = {}, bytearray(n)
        for at, gram in enumerate(grams):
            before = first.setdefault(gram, at)
            if before != at:
                marked[at:at + WINDOW] = marked[before:before + WINDOW] = b"\1" * WINDOW
        repeated = sum(marked)
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame, text_column: str = "text", keep_text: bool = False) -> tuple[DataFrame, str]:
    """Adds a struct column with the measures; the text is dropped unless asked for."""
    name = free_name(docs, "measures")
    place = docs.columns.index(text_column)
    fields = [f.split()[0] for f in MEASURES.split(", ")]
    kept = [i for i in range(len(docs.columns)) if keep_text or i != place]

    def make():
        def step(batch):
            rows = [measure(t) for t in texts(batch, place)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * len(fields)
            struct = pa.StructArray.from_arrays(columns, fields)
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), struct], names=[*(batch.schema.names[i] for i in kept), name])
        return step

    schema = ", ".join([f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in kept] + [f"`{name}` struct<{', '.join(MEASURES.split(', ')).replace(' bigint', ':bigint')}>"])
    return map_batches(docs, make, schema), name


def _value(m: str, kind: str) -> Column:
    part, whole = {"symbols": ("1000 * {m}.n_symbols", "n_words"), "doubled": ("1000 * {m}.n_dup_lines", "n_lines"), "length": ("100 * {m}.word_chars", "n_words")}[kind]
    return F.expr(f"coalesce(({part}) div nullif({m}.{whole}, 0), 0)".format(m=m))


#: Bin of a value v: exact below 64, then 32 bins for each doubling; and the largest and smallest value of a bin.
BIN = "shiftright({v}, greatest(length(bin({v})) - 6, 0)) + 32 * greatest(length(bin({v})) - 6, 0)"
TOP = "CASE WHEN {b} < 64 THEN {b} ELSE shiftleft({b} - 32 * ({b} div 32 - 1) + 1, cast({b} div 32 - 1 AS int)) - 1 END"
LOW = "CASE WHEN {b} < 64 THEN {b} ELSE shiftleft({b} - 32 * ({b} div 32 - 1), cast({b} div 32 - 1 AS int)) END"


def sketches(rows: DataFrame, measures: str, by: list[str]) -> DataFrame:
    """One row per (group, measure, bin) with its count: the mergeable sketch."""
    values = F.array(*(F.struct(F.lit(k).alias("kind"), _value(measures, k).alias("v")) for k in FENCES))
    return (rows.select(*by, F.inline(values)).withColumn("bin", F.expr(BIN.format(v="v")).cast("bigint"))
            .groupBy(*by, "kind", "bin").agg(F.count("*").alias("n")))


def shortest_half(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a group and, for each measure, the shortest interval ``low`` to ``top`` of bins with half of them (ties: lowest).

    A group has at most some hundreds of bins, so the array of one group stays small.
    """
    bins = sketch.groupBy(*by, "kind").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("rows"))
    bins = bins.withColumn("before", F.expr("transform(sequence(1, size(bins)), i -> aggregate(slice(bins, 1, i - 1), 0L, (s, x) -> s + x.n))"))
    # for an interval that ends with bin x, the last bin it can start with
    start = "size(filter(before, b -> 2 * (before[j] + x.n - b) >= rows))"
    ends = (f"filter(transform(bins, (x, j) -> named_struct('from', {start}, 'bin', x.bin)), e -> e.from > 0)")
    low, top = LOW.format(b="bins[e.from - 1].bin"), TOP.format(b="e.bin")
    best = F.expr(f"array_min(transform({ends}, e -> named_struct('length', cast({top} - {low} AS bigint), 'low', cast({low} AS bigint), 'top', cast({top} AS bigint))))")
    return bins.select(*by, "kind", "rows", best.alias("half")).select(*by, "kind", "rows", "half.low", "half.top")


def thresholds(rows: DataFrame, measures: str, language: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source) with the upper threshold of each measure and the lower one of word length."""
    own = rows.select(F.col(language).alias("_lang"), F.col(source).alias("_source"), measures)
    fine = materialise(sketches(own, measures, ["_lang", "_source"]), "sketch")
    coarse = shortest_half(fine.groupBy("_lang", "kind", "bin").agg(F.sum("n").alias("n")), ["_lang"])
    both = shortest_half(fine, ["_lang", "_source"]).alias("g").join(coarse.alias("l"), F.expr("g._lang <=> l._lang AND g.kind = l.kind"))

    def drawn(side: str) -> str:
        return f"(g.rows * ({side.format(t='g')}) + {PRIOR} * ({side.format(t='l')})) div (g.rows + {PRIOR})"

    bounds = []
    for kind, (times, slack, below, ceiling) in FENCES.items():
        upper = drawn(f"{{t}}.top + {times} * ({{t}}.top - {{t}}.low) + {slack}")
        upper = upper if ceiling is None else f"least({upper}, {ceiling}L)"
        bounds.append(F.max(F.expr(f"CASE WHEN g.kind = '{kind}' THEN {upper} END")).alias(f"_{kind}_most"))
        if below is not None:
            lower = drawn(f"{{t}}.low - {times} * ({{t}}.top - {{t}}.low) - {below}")
            bounds.append(F.max(F.expr(f"CASE WHEN g.kind = '{kind}' THEN {lower} END")).alias(f"_{kind}_least"))
    return both.groupBy("g._lang", "g._source").agg(*bounds)


def judged(rows: DataFrame, measures: str, limits: DataFrame, language: str = "lang", source: str = "source") -> DataFrame:
    """Joins the thresholds by language and source (nulls are a group) and adds ``base_failed`` and ``kept`` to the measures."""
    limits = materialise(limits, "limits")
    few = limits.count() <= BROADCAST_ROWS
    group_lang, group_source, bounds = (free_name(rows, c) for c in ("_lang", "_source", "_bounds"))  # whatever columns the rows have
    limits = limits.select(F.col("_lang").alias(group_lang), F.col("_source").alias(group_source),
                           F.struct(*(c for c in limits.columns if c not in ("_lang", "_source"))).alias(bounds))
    m = measures
    failed = F.expr(f"{m}.n_words < 10 OR 100 * {m}.n_repeat_words > 20 * {m}.n_words")
    odd = F.lit(False)
    for kind, (_, _, below, _) in FENCES.items():
        odd = odd | (_value(m, kind) > F.col(f"{bounds}._{kind}_most"))
        if below is not None:
            odd = odd | (_value(m, kind) < F.col(f"{bounds}._{kind}_least"))
    joined = rows.join(F.broadcast(limits) if few else limits, rows[language].eqNullSafe(limits[group_lang]) & rows[source].eqNullSafe(limits[group_source]), "left")
    return (joined.withColumn(m, F.col(m).withField("base_failed", failed))
            .withColumn(m, F.col(m).withField("kept", ~F.col(f"{m}.base_failed") & ~F.coalesce(odd, F.lit(False)))))


def assess(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """One row per document: measures, ``base_failed``, ``kept``.

    A null or empty text has no words and fails the base rule. Null languages and sources
    form groups of their own. Repeated rows are judged one by one; an empty table gives an
    empty result; other columns are not read.
    """
    lean = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(language).alias("lang"), F.col(source).alias("source"))
    rows, m = measured(lean)
    rows = materialise(rows, "measures")
    return judged(rows, m, thresholds(rows, m)).select("doc_id", f"{m}.*").drop("n_lines")


def keep_good(docs: DataFrame, text_column: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    lean = docs.select(F.col(text_column).alias("text"), F.col(language).alias("lang"), F.col(source).alias("source"))
    limits = thresholds(*measured(lean))
    rows, m = measured(docs, text_column, keep_text=True)
    return judged(rows, m, limits, language, source).where(f"{m}.kept").select(*(F.col(f"`{c}`") for c in docs.columns))


#: DuckDB SQL of the same rules over ``documents``.
ORACLE = """
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
grams AS (
  SELECT row_id, unnest(range(1, len(words) - 3)) AS pos, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS gram
  FROM cut WHERE len(words) >= 5),
twice AS (SELECT row_id, pos FROM grams QUALIFY count(*) OVER (PARTITION BY row_id, gram) > 1),
repeated AS (SELECT row_id, count(DISTINCT pos + k) AS n FROM twice, range(5) AS t(k) GROUP BY row_id),
m AS (
  SELECT row_id, doc_id, lang, source, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM cut LEFT JOIN repeated USING (row_id)),
v AS (
  SELECT row_id, lang, source, unnest(['symbols', 'doubled', 'length']) AS kind,
         unnest([coalesce(1000 * n_symbols // nullif(n_words, 0), 0), coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0), coalesce(100 * word_chars // nullif(n_words, 0), 0)]) AS v FROM m),
b AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM v),
c AS (SELECT *, (v >> e) + 32 * e AS bin, (v >> e) << e AS low, (((v >> e) + 1) << e) - 1 AS top FROM b),
fine AS (SELECT lang, source, kind, bin, low, CASE WHEN bin < 64 THEN bin ELSE top END AS top, count(*) AS n FROM c GROUP BY ALL),
coarse AS (SELECT lang, kind, bin, low, top, sum(n) AS n FROM fine GROUP BY ALL),
run_fine AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, kind ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY lang, source, kind) AS total FROM fine),
run_coarse AS (SELECT *, sum(n) OVER (PARTITION BY lang, kind ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY lang, kind) AS total FROM coarse),
g AS (SELECT a.lang, a.source, a.kind, a.total, a.low, b.top FROM run_fine a JOIN run_fine b ON a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source AND a.kind = b.kind AND a.bin <= b.bin AND 2 * (b.seen - a.seen + a.n) >= a.total
  QUALIFY row_number() OVER (PARTITION BY a.lang, a.source, a.kind ORDER BY b.top - a.low, a.low) = 1),
l AS (SELECT a.lang, a.kind, a.low, b.top FROM run_coarse a JOIN run_coarse b ON a.lang IS NOT DISTINCT FROM b.lang AND a.kind = b.kind AND a.bin <= b.bin AND 2 * (b.seen - a.seen + a.n) >= a.total
  QUALIFY row_number() OVER (PARTITION BY a.lang, a.kind ORDER BY b.top - a.low, a.low) = 1),
fence(kind, times, slack, below, ceiling) AS (VALUES ('symbols', 2, 250, NULL, NULL), ('doubled', 2, 400, NULL, 900), ('length', 3, 300, 300, NULL)),
limits AS (
  SELECT g.lang, g.source, g.kind,
         least(trunc((total * (g.top + times * (g.top - g.low) + slack) + 100 * (l.top + times * (l.top - l.low) + slack)) // (total + 100)), coalesce(ceiling, 1000000000000)) AS most,
         (total * (g.low - times * (g.top - g.low) - below) + 100 * (l.low - times * (l.top - l.low) - below)) // (total + 100) AS least
  FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang AND g.kind = l.kind JOIN fence ON fence.kind = g.kind),
odd AS (
  SELECT row_id, bool_or(v > most OR coalesce(v < least, false)) AS odd
  FROM v JOIN limits ON v.lang IS NOT DISTINCT FROM limits.lang AND v.source IS NOT DISTINCT FROM limits.source AND v.kind = limits.kind GROUP BY row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT odd AS kept
FROM m JOIN odd USING (row_id)
"""
