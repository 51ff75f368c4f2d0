"""Phrase collocations mined by relations of occurrences, one length at a time.

Texts are cut at punctuation and line breaks into pieces, pieces into words. The relation of
length k has a row for every occurrence of a phrase of k words that can be frequent. It is
kept as a table of blocks: a block holds whole documents of one language, its words in order
of piece and position as far as they are in such a phrase, and a bit per word for the places
where one starts.

Each length reads the relation of the length before:

1. merge-join: where two occurrences of length k - 1 are adjacent in a piece, one of length k
   starts; both sides are the sorted places, so the join is a lookup at the next place;
2. group-count: hashes of the new phrases are counted in the block, then over all blocks; a
   phrase that is frequent has a hash that is;
3. semi-join: only occurrences with such a hash are kept. Their phrases are then counted by
   their text, so a clash of hashes changes no result.

Only (block, code, hash, count) rows are shuffled for all phrases, texts for the frequent
ones alone. A frequent word or passage has one row per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.session import forget, materialise

LONGEST, LEAST, SHARE, KEEP = 4, 30, 80, 2000
UNKNOWN = "und"
#: Words of a block (a longer document is a block of its own).
BLOCK = 1 << 19

#: Ends of pieces become a byte that no UTF-8 text holds; code 0 stands for them.
_END = b"\xff"
_CUT = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))

RELATION = "block bigint, lang string, n bigint, vocabulary array<string>, words binary, starts binary, phrases array<string>, counts array<bigint>"
_NAMES = [part.split()[0] for part in RELATION.split(", ")]


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in order, with an end mark behind every piece."""
    return ((text or "").encode().translate(_CUT).replace(_END, b" \xff ") + b" \xff").split()


class _Codes(dict):
    """Numbers words in the order they come; the end mark is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _row(block: int, lang: str, n: int, vocabulary: np.ndarray, words: np.ndarray, place: np.ndarray, phrases, counts) -> pa.RecordBatch:
    """A row of the relation; codes take two bytes where the vocabulary allows it."""
    listed = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    starts = np.zeros(len(words), bool)
    starts[place] = True
    return pa.RecordBatch.from_arrays([
        pa.array([block]), pa.array([lang]), pa.array([n]), listed(vocabulary, pa.string()), pa.array([words.astype(_code_type(len(vocabulary))).tobytes()]),
        pa.array([np.packbits(starts).tobytes()]), listed(phrases, pa.string()), listed(counts, pa.int64()),
    ], names=_NAMES)


def _code_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.int32


def word_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The words of docs (lang, text) in blocks; write it before use, since blocks are numbered as they fill."""
    def run(batches):
        number = TaskContext.get().partitionId() << 33
        open_blocks: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        held: dict[str, int] = {}

        def close(langs):
            nonlocal number
            for lang in langs:
                codes, parts = open_blocks.pop(lang)
                del held[lang]
                words = np.concatenate(parts)
                place = np.flatnonzero(words)
                names = np.array([w.decode() if w != _END else "" for w in codes], object)
                yield _row(number, lang, len(place), names, words, place, [], [])
                number += 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lang = UNKNOWN if lang is None else lang
                if lang not in open_blocks:
                    open_blocks[lang], held[lang] = (_Codes({_END: 0}), [np.zeros(1, np.int32)]), 0
                codes, parts = open_blocks[lang]
                found = tokens(text)
                parts.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
                held[lang] += len(found)
                if held[lang] >= block:
                    yield from close([lang])
                elif sum(held.values()) >= 4 * block:  # many languages
                    yield from close(list(held))
        yield from close(list(held))

    return docs.select("lang", "text").mapInArrow(run, RELATION)


class _Block:
    """A block's occurrences of one length: where they start, and the hash of each."""

    def __init__(self, lang: str, vocabulary: pa.Array, words: np.ndarray, place: np.ndarray, length: int):
        self.vocabulary, self.words, self.length = vocabulary, words, length
        if length > 1:  # merge-join with the next place
            starts = np.zeros(len(words) + 1, bool)
            starts[place] = True
            place = place[starts[place + 1]]
        seed = xxhash.xxh64_intdigest(lang)
        word = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))
        hashes = word[words[place]]
        for step in range(1, length):
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[words[place + step]]
        self.place, self.hashes = place, hashes

    def keep(self, codes: np.ndarray) -> None:
        """Only occurrences whose hash is among these, numbered in ascending order of all hashes."""
        every, code = np.unique(self.hashes, return_inverse=True)
        good = np.zeros(len(every), bool)
        good[codes] = True
        self.place = self.place[good[code]]

    def trimmed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary, words and places without words outside all occurrences; an end mark stands for each gap."""
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, self.place, 1)
        np.add.at(edge, self.place + self.length, -1)
        inside = np.cumsum(edge[:-1]) > 0
        stays = inside.copy()
        stays[1:] |= inside[:-1]
        words = np.concatenate([[0], np.where(inside, self.words, 0)[stays]])
        used, words = np.unique(words, return_inverse=True)
        return self.vocabulary.to_numpy(zero_copy_only=False)[used], words, np.cumsum(stays)[self.place]

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """The phrases by their words, and how often each occurs."""
        code = self.words[self.place].astype(np.int64)  # exact: by words, not by hash
        for step in range(1, self.length):
            code = np.unique(code * len(self.vocabulary) + self.words[self.place + step], return_inverse=True)[1]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        names, first = self.vocabulary.to_numpy(zero_copy_only=False), self.place[first]
        out = names[self.words[first]]
        for step in range(1, self.length):
            out = out + " " + names[self.words[first + step]]
        return out, counts


def _blocks(batch: pa.RecordBatch, length: int):
    """(row, block number, lang, n, occurrences of the length) of rows that begin with block, lang, n, vocabulary, words, starts."""
    for at in range(batch.num_rows):
        block, lang, n = (batch.column(i)[at].as_py() for i in range(3))
        vocabulary = batch.column(3)[at].values
        words = np.frombuffer(batch.column(4)[at].as_buffer(), _code_type(len(vocabulary)))
        place = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column(5)[at].as_buffer(), np.uint8), count=len(words)))
        yield at, block, lang, n, _Block(lang, vocabulary, words, place, length)


_INPUT = ["block", "lang", "n", "vocabulary", "words", "starts"]


def hashed(relation: DataFrame, length: int, bits: int = 63) -> DataFrame:
    """(block, code, hash, count) of the phrases of ``length`` that adjacent occurrences of the relation make.

    ``bits`` of the hash are given out: some more than the number of words has keep clashes few.
    """
    mask = np.uint64((1 << bits) - 1)

    def run(batches):
        for batch in batches:
            for _, block, _, _, rows in _blocks(batch, length):
                hashes, counts = np.unique(rows.hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), block)), pa.array(np.arange(len(hashes), dtype=np.int32)), pa.array((hashes & mask).view(np.int64)), pa.array(counts)],
                                                 names=["block", "code", "hash", "count"])

    return relation.select(*_INPUT).mapInArrow(run, "block bigint, code int, hash bigint, count bigint")


def longer_relation(relation: DataFrame, kept: DataFrame, length: int) -> DataFrame:
    """The relation of ``length`` from the one before; ``kept`` has (block, codes) of the phrases that stay."""
    def run(batches):
        for batch in batches:
            for at, block, lang, n, rows in _blocks(batch, length):
                rows.keep(batch.column(6)[at].values.to_numpy())
                yield _row(block, lang, n, *rows.trimmed(), *rows.phrases())

    return relation.select(*_INPUT).join(kept, "block").select(*_INPUT, "codes").mapInArrow(run, RELATION)


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of docs (lang, text), and the words of each language.

    The first table has (lang, length, phrase, f) for all phrases of up to ``longest`` words
    that occur at least ``least`` times; the second has (lang, n). Both are written tables.
    """
    relation = materialise(word_blocks(docs), "words")
    totals = materialise(relation.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(63, max(16, words.bit_length() + 8))
    found = None
    for length in range(1, longest + 1):
        rows = hashed(relation, length, bits).withColumn("f", F.sum("count").over(Window.partitionBy("hash")))
        kept = rows.where(F.col("f") >= least).groupBy("block").agg(F.collect_list("code").alias("codes"))
        before, relation = relation, materialise(longer_relation(relation, kept, length), "phrases")
        named = relation.select("lang", F.inline(F.arrays_zip("phrases", "counts"))).groupBy("lang", F.col("phrases").alias("phrase")).agg(F.sum("counts").alias("f"))
        level = materialise(named.where(F.col("f") >= least).select("lang", F.lit(length).alias("length"), "phrase", "f"), "frequent")
        found = level if found is None else found.unionByName(level)
        forget(before)
    forget(relation)
    return found, totals


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, length, a, l, r, score) of the phrases of two words and more, by their weakest cut.

    ``score`` is ``floor(2000000 a / (l + r))``, counted in decimals of 38 digits; of equally
    weak cuts the earliest counts. Every part of a frequent phrase is frequent itself, so its
    count is at hand.
    """
    whole = found.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"))
    cut = whole.withColumn("words", F.split("phrase", " ")).select("*", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "length", "a", "k", F.array_join(F.expr("slice(words, 1, k)"), " ").alias("head"), F.array_join(F.expr("slice(words, k + 1, length - k)"), " ").alias("tail"))
    cut = cut.join(found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cut = cut.join(found.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = cut.withColumn("score", score).groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    return weakest.select("lang", "phrase", "length", "a", "w.l", "w.r", "w.score")


def covered(found: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of those that lie in a longer phrase with at least ``share`` percent of their count."""
    longer = found.where("length > 2").withColumn("words", F.split("phrase", " "))
    spans = F.expr("flatten(transform(sequence(2, length - 1), size -> transform(sequence(1, length - size + 1), i -> array_join(slice(words, i, size), ' '))))")
    inside = longer.select("lang", F.explode(spans).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    enough = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(f as decimal(20, 0)) * {share}")
    return found.join(inside, ["lang", "phrase"]).where(enough).select("lang", "phrase")


def collocations(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, keep: int = KEEP) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Phrases rank by score, then count, then bytes, so ties have one order. A null language
    is ``und``, a null or empty text has no words; repeated rows count again. A language
    without a phrase that is frequent has no row, an empty table gives an empty result, and
    other columns are not read, whatever their names. A text is worked on whole, however long.
    """
    found, totals = mine(docs.select(F.col(f"`{lang_column}`").alias("lang"), F.col(f"`{text_column}`").alias("text")), longest, least)
    best = scored(found).join(covered(found, share), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the same rows, all phrases counted at once.
ORACLE = r"""
WITH pieces AS (
    SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words FROM pieces
), placed AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded WHERE len(words) > 0
), totals AS (
    SELECT lang, count(*) AS n FROM placed GROUP BY lang
), counts AS (
    SELECT lang, k AS length, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM placed, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
    SELECT lang, length, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE length > 1
), cuts AS (
    SELECT lang, length, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:length], ' ') AS tail
    FROM candidates, (VALUES (1), (2), (3)) AS places(k) WHERE k < length
), scores AS (
    SELECT c.lang, c.length, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f)) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail
), weakest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), spans AS (
    SELECT c.lang, array_to_string(c.words[i:i + k - 1], ' ') AS phrase, c.a AS longer
    FROM candidates c, (VALUES (2), (3)) AS sizes(k), (VALUES (1), (2), (3)) AS places(i) WHERE k < c.length AND i + k - 1 <= c.length
), kept AS (
    SELECT w.* FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.lang = w.lang AND s.phrase = w.phrase AND 100::HUGEINT * s.longer >= 80::HUGEINT * w.a)
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
