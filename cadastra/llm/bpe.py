"""BPE encoding by backtracking over longest matches, decoding through an offset table.

Encoding follows the linear-time scheme: an Aho-Corasick automaton over all tokens gives
the longest token at each place; two neighbouring tokens are *compatible* if merging the
two joined strings by rank gives back exactly these two tokens; a token sequence in which
all neighbours are compatible is the merge result. Longest matches are tried first and
taken back where neighbours do not fit.

Whole texts are normalised and split as the vocabulary file says. A split part never
crosses white space, so the parts between spaces are encoded once per worker and kept in a
bounded table.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import free_name, map_batches, texts

#: Words that a worker remembers, pairs it remembers, and characters looked at together.
KEPT, KEPT_PAIRS, SLICE = 250_000, 400_000, 2_000_000
#: Control characters that Python splits at and the vocabulary's white-space class does not hold.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CODECS: dict[str, WordBpe] = {}


class WordBpe:
    """A vocabulary whose words end in a marked symbol.

    A token is written as a string of symbols: ``chr(b)`` for a byte inside a word and
    ``chr(256 + b)`` for a word's last byte.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}

        def symbols(token: str) -> str:
            last = token.endswith(end)
            raw = [byte_of[c] for c in (token[: -len(end)] if last else token)]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * last)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token_id = {symbols(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.token = {i: t for t, i in self.token_id.items()}
        # merged token -> the two it is made of, and its rank; pair -> merged token
        self.halves, self.rank, self.merged = {}, {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            a, b = self.token_id[symbols(a)], self.token_id[symbols(b)]
            whole = self.token_id[self.token[a] + self.token[b]]
            self.halves[whole], self.rank[whole], self.merged[a, b] = (a, b), rank, whole
        self.automaton = ahocorasick.Automaton()
        for token, i in self.token_id.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.parts = regex.compile(next(s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"))
        self.size = [0] * (1 + max(self.token))
        for i, token in self.token.items():
            self.size[i] = len(token)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    # ---- encoding

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank never joins the last symbol of ``left`` with the first of ``right``.

        Both tokens are undone from their last merge backwards, always the later merge of
        the two first. The pair that touches at the border would be merged, if it can be,
        unless a merge of an earlier rank has already taken one of its sides.
        """
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        rank, whole_left, whole_right = self.rank, -1, -1  # ranks of the merges that take the sides away
        while True:
            joint = self.merged.get((left, right))
            if joint is not None:
                r = rank[joint]
                # the joint merge happens unless a side is consumed at an earlier rank;
                # merges of equal rank go from the left, so the left side goes first
                if not ((whole_left != -1 and whole_left <= r) or (whole_right != -1 and whole_right < r)):
                    return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a == b == -1:
                return True
            if a >= b:
                whole_left, left = a, self.halves[left][1]
            else:
                whole_right, right = b, self.halves[right][0]

    def _search(self, word: str) -> list[int]:
        """Backtracking over the tokens at each place, longest first.

        What can follow depends on the place and the last token only, so pairs of the two
        that cannot be finished are remembered and no pair is tried twice.
        """
        size, pairs, n = self.size, self.pairs, len(word)
        starts: list[list[int]] = [[] for _ in word]
        for end, token in self.automaton.iter(word):
            starts[end + 1 - size[token]].append(token)  # ends ascend, so the longest comes last
        out, at, left, dead = [], 0, [len(starts[0])], set()
        while at < n:
            options, k = starts[at], left[-1]
            last = out[-1] if out else -1
            while k:
                k -= 1
                token = options[k]
                fits = last < 0 or pairs.get(last << 20 | token)
                if fits is None:
                    fits = self.compatible(last, token)
                if fits and (at + size[token], token) not in dead:
                    left[-1] = k
                    out.append(token)
                    at += size[token]
                    if at < n:
                        left.append(len(starts[at]))
                    break
            else:
                left.pop()
                dead.add((at, out[-1]))
                at -= size[out.pop()]
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks (text between spaces) that are not known yet."""
        if len(self.words) >= KEPT:
            self.words.clear()
        latin = [[w.encode().decode("latin-1") for w in self.parts.findall(c)] for c in chunks]
        marked = [w[:-1] + chr(256 + ord(w[-1])) for ws in latin for w in ws]
        ends = np.cumsum([len(w) for w in marked]) if marked else np.zeros(0, np.int64)
        # one pass of longest matches over all words: no token goes past a word's last symbol
        found = list(self.automaton.iter_long("".join(marked)))
        at = np.fromiter((e for e, _ in found), np.int64, len(found)) + 1
        ids = np.fromiter((i for _, i in found), np.int64, len(found))
        cuts = [0, *(np.searchsorted(at, ends) + 1).tolist()]
        inner = np.ones(len(ids), bool)
        inner[np.asarray(cuts[1:], np.int64) - 1] = False  # a word's last token has no right neighbour
        keys = (ids[:-1] << 20 | ids[1:])[inner[:-1]]
        distinct, back = np.unique(keys, return_inverse=True)
        fits = np.fromiter((self.compatible(k >> 20, k & 0xFFFFF) for k in distinct.tolist()), bool, len(distinct))[back]
        bad = np.zeros(len(ids), np.int64)
        bad[np.flatnonzero(inner[:-1])[~fits]] = 1
        wrong = np.add.reduceat(bad, cuts[:-1]) if marked else bad
        raw, word = ids.astype("<i4").tobytes(), 0
        for chunk, ws in zip(chunks, latin, strict=True):
            got = []
            for _ in ws:
                got.append(raw[4 * cuts[word]:4 * cuts[word + 1]] if not wrong[word] else array("i", self._search(marked[word])).tobytes())
                word += 1
            self.words[chunk] = b"".join(got)

    def _chunks(self, text: str) -> list[str]:
        """Normalise (NFC, lower case letter by letter) and cut at white space."""
        text = unicodedata.normalize("NFC", text)
        # lower() looks at the neighbours of this one letter only
        text = text.replace("\u03a3", "\u03c3").lower()
        return text.split() if not _CONTROL.search(text) else _SPACE.split(text)

    def many(self, rows: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit bytes."""
        out, at = [], 0
        while at < len(rows):
            end, size = at, 0
            while end < len(rows) and (end == at or size < SLICE):
                size += len(rows[end])
                end += 1
            # a text's pieces between special tokens are normalised one by one
            cut = [self.split_special.split(t) if self.split_special and any(s in t for s in self.special) else [t] for t in rows[at:end]]
            chunked = [[[p] if p in self.special else self._chunks(p) for p in pieces] for pieces in cut]
            new = {c for pieces in chunked for chunks in pieces for c in chunks}.difference(self.words, self.special)
            if new:
                if len(self.words) + len(new) > KEPT:
                    new = {c for pieces in chunked for chunks in pieces for c in chunks}.difference(self.special)
                    self.words.clear()
                self._learn(list(new))
            get = {s: array("i", [i]).tobytes() for s, i in self.special.items()}
            for pieces, chunks in zip(cut, chunked, strict=True):
                out.append(b"".join(get[p] if p in get else b"".join(map(self.words.__getitem__, c)) for p, c in zip(pieces, chunks, strict=True)))
            at = end
        return out


def codec(path: str) -> WordBpe:
    """The worker's codec for a vocabulary file; kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = WordBpe(path)
    return _CODECS[path]


def offset_table(path: str) -> pa.LargeStringArray:
    """The texts of all tokens by id, each with a space behind it, back to back with their offsets."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([shown[i] + " " if i in shown else "" for i in range(1 + max(shown))], pa.large_string())


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """Adds the ids of each whole text as ``array<int>``; null and empty texts have none.

    Special tokens' strings in a text become their ids, as the tokenizers library does.
    All columns pass through; if ``ids_column`` is taken, a free name is used instead.
    """
    name = free_name(docs, ids_column)
    place = docs.columns.index(text_column)

    def make():
        bpe = codec(vocabulary)

        def step(batch):
            rows = bpe.many(texts(batch, place))
            offsets = np.cumsum([0, *(len(r) // 4 for r in rows)])
            values = pa.array(np.frombuffer(b"".join(rows), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            return pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])
        return step

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` array<int>"])
    return map_batches(docs, make, schema)


def decode(rows: DataFrame, vocabulary: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """Adds the decoded text of each id list: the tokens as the vocabulary writes them, one space between.

    The vocabulary file names no decoder, so this is what the tokenizers library returns;
    special tokens are kept. Each token's text lies in one offset table, and a batch is one
    gather from it. Null and empty lists give the empty text; ids without a token are left out.
    """
    name = free_name(rows, text_column)
    place = rows.columns.index(ids_column)

    def make():
        table = offset_table(vocabulary)

        def step(batch):
            lists = batch.column(place)
            ids = lists.flatten().cast(pa.int64())
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table)))
            gathered = table.take(pc.if_else(known, ids, len(table) - 1)) if len(ids) else table.slice(0, 0)
            if len(ids) and not pc.all(known).as_py():
                gathered = pc.if_else(known, gathered, "")
            ends = np.frombuffer(gathered.buffers()[1], np.int64)[gathered.offset:gathered.offset + len(gathered) + 1] if len(gathered) else np.zeros(1, np.int64)
            cuts = ends[np.concatenate([[0], np.cumsum(lengths)])]
            joined = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(cuts.astype(np.int64)), gathered.buffers()[2] if len(gathered) else pa.py_buffer(b""))
            text = pc.utf8_rtrim(joined, " ").cast(pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, name])
        return step

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{name}` string"])
    return map_batches(rows, make, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes and decodes ``documents`` and keeps lengths and digests."""
    encoded = encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    both = decode(encoded, vocabulary)
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
