"""SetSketch near copies, phrase collocations and runs against brute-force versions, and their edge cases."""

import functools
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from cadastra.llm import periodic, phrases, setsketch
from cadastra.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def cut(text, marks):
    for mark in marks:
        text = text.replace(mark, "\0")
    return [part for part in text.split("\0") if part]


def shingles(text):
    words = cut(lower(text), SPACE)
    return {tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def grouped(texts, percent=80):
    """Component (smallest index) of each text, all pairs compared."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both) and sets[j]:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(1, "a b c d e f g h i j k l", "en"), (1, "a b c d e f g h i j k l", "en"), (2, None, "en"), (3, "", None), (None, "one two three", None),
            (4, "word " * 200_000, "en"), (5, "A b c d e f g h i j k l", "en"), (6, " \n\t ", "en"), (None, "One two\tthree", "fr")]
    extra = [(*r, "x", 1, True, 2, "y", 3, "z") for r in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, registers string, uid int, kept boolean, n int, runs string, rank int, phrase string")


def test_setsketch_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id", ignore_index=True)
    got = QUERIES["op11_setsketch"](spark, SF).toPandas().set_index("doc_id")
    roots, sizes = grouped(docs.text)
    for doc, root, size in zip(docs.doc_id, roots, sizes, strict=True):
        assert tuple(got.loc[doc][["n_shingles", "component_id", "kept"]]) == (size, docs.doc_id[root], doc == docs.doc_id[root])


def test_setsketch_dense_group(spark):
    """Copies of one text with changes that put pairs on both sides of the limit, and chains of copies."""
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4, 6, 9])):
            copy[at] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for step in range(20):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(" ".join(chain))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = setsketch.near_copies(rows).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == grouped(texts)[0]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    parts = np.maximum(setsketch.sketches([whole[:2500]]), setsketch.sketches([whole[2500:]]))
    assert (parts == setsketch.sketches([whole])).all()
    for common, own in ((900, 50), (600, 200), (200, 500)):
        sets = []
        for _ in range(80):
            shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (common, own, own))
            sets += [np.concatenate([shared, a]), np.concatenate([shared, b])]
        marks = setsketch.sketches(sets).astype(int)
        a, b, n = marks[::2], marks[1::2], np.full(80, float(common + own))
        best, doubt = setsketch.similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n, n)
        true = common / (common + 2 * own)
        assert abs(best.mean() - true) < 0.015 and best.std() < 0.05
        if true >= 0.8:
            assert (doubt[best < 0.8] < setsketch.EVIDENCE).all()


def test_setsketch_edges(spark, odd):
    got = setsketch.near_copies(odd).toPandas().sort_values(["doc_id", "n_shingles"])
    rows = [(None if pd.isna(a) else int(a), n, None if pd.isna(c) else int(c), k) for a, n, c, k in got[["doc_id", "n_shingles", "component_id", "kept"]].itertuples(index=False)]
    assert rows == [(1, 9, 1, True), (1, 9, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 9, 1, False), (6, 0, 6, True), (None, 1, None, True), (None, 1, None, True)]
    assert setsketch.near_copies(odd.limit(0)).count() == 0


def counted(docs, least, share, keep):
    """Phrases by counting them all."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in cut(lower(text), ".,;:!?\n\x0b\x0c\r"):
            words = cut(piece, " \t")
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:keep])]
    return sorted(out)


def rows_of(table):
    return sorted(tuple(r) for r in table.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("block", [phrases.BLOCK, 60])
def test_phrases(spark, monkeypatch, block):
    rng = random.Random(4)
    words = ["the", "of", "A", "bé", "x-1", "\U0001F600", "z", "and"]
    docs = []
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "; ", " \x0b"]) for _ in range(rng.randint(0, 40)))
        docs.append((rng.choice(["en", "de", None, "und", ""]), text))
    docs += [("en", None), (None, ""), ("rare", "one two"), ("en", "The of A the of a " * 30)]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    if block != phrases.BLOCK:  # many small blocks, as on a large table
        monkeypatch.setattr(phrases, "word_blocks", functools.partial(phrases.word_blocks, block=block))
    assert rows_of(phrases.collocations(table, least=5, keep=40)) == counted(docs, 5, 80, 40)


def test_phrases_edges(spark, odd):
    got = rows_of(phrases.collocations(odd, least=2))
    assert {r[2]: r[3:] for r in got}["word word word word"] == (199_997, 200_000, 199_998, 200_036, 999_989)
    assert {r[0] for r in got} == {"en"}
    assert phrases.collocations(odd.limit(0)).count() == 0


def brute_runs(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            stretch = words[start:i + q]
            if len(stretch) >= max(least, 2 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((start, i + q - start, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs(monkeypatch):
    rng = random.Random(6)
    texts = []
    for _ in range(1200):
        kinds, n = rng.choice([1, 2, 3, 9]), rng.randint(0, 90)
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            at = rng.randrange(n)
            p = rng.randint(1, max(1, (n - at) // 2))
            words = words[:at] + [words[at + (i - at) % p] for i in range(at, n)]
        texts.append(words)
    as_rows = lambda found: [[(s, e - s, p) for s, e, p in rows.tolist()] for rows in found]
    want = [brute_runs(t) for t in texts]
    assert as_rows(periodic.Finder().runs([np.array(t, np.int64) for t in texts])) == want
    monkeypatch.setattr(periodic, "TABLED", 16)  # texts one by one, grids in parts
    monkeypatch.setattr(periodic, "POINTS", 50)
    assert as_rows(periodic.Finder().runs([np.array(t, np.int64) for t in texts])) == want


def test_run_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_runs"](spark, SF).toPandas().set_index("doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        words = cut(text or "", SPACE)
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 4000:
            continue
        runs = brute_runs(words)
        some += len(runs)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        row = got.loc[doc]
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (row.n_runs, row.runs_sha256, row.collapsed_sha256) == (len(runs), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))
        if top is None:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()
        else:
            assert tuple(row[["start", "length", "period", "exponent_milli"]]) == (*top, 1000 * top[1] // top[2])
    assert some > 10


def test_run_edges(spark, odd):
    got = sorted(periodic.find(odd, rewrite=periodic.looped).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == 9 and got[0] == got[1]
    assert [tuple(r) for r in next(g for g in got if g.doc_id == 4).runs] == [(0, 200_000, 1)]
    assert next(g for g in got if g.doc_id == 4).collapsed == "word"
    assert next(g for g in got if g.doc_id == 2).collapsed == "" and next(g for g in got if g.doc_id is None).runs == []
    assert periodic.digests(periodic.find(odd.limit(0))).count() == 0


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_neighbour_recall_on_full_shards(spark, kind):
    """Two full shards: isotropic vectors, the hardest case, and tight clusters."""
    from cadastra.llm import ann
    rng = np.random.default_rng(7)
    n = 2 * ann.SHARD
    vectors = rng.standard_normal((n, 64))
    if kind == "clustered":
        vectors = rng.standard_normal((200, 64))[rng.integers(0, 200, n)] + 0.15 * vectors
    vectors = vectors.astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(vectors)}), "vec_id bigint, embedding array<float>")
    got = ann.nearest(rows, every=40).toPandas()
    asked = np.arange(0, n, 40)
    products = vectors[asked].astype(float) @ vectors.T.astype(float)
    products[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-products, axis=1, kind="stable")[:, :20]
    found = got.groupby("query_id").vec_id.agg(set)
    assert np.mean([len(found[q] & set(b)) / 20 for q, b in zip(asked, best.tolist(), strict=True)]) >= 0.95


@pytest.mark.parametrize("junk", [16, 60, 140])
@pytest.mark.parametrize("kind", ["symbols", "long", "lines"])
def test_quality_thresholds_hold_with_much_junk(spark, junk, kind):
    """140 good documents and 10, 30 or 50 % of bad ones in the same source: none of the bad stay, all the good do."""
    from cadastra.llm import quality
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([2, 3, 4, 5, 6, 7])))
    bad = {"symbols": lambda: " ".join(word() + "#" * rng.randint(1, 4) if rng.random() < 0.8 else word() for _ in range(80)),
           "long": lambda: " ".join(word() * rng.randint(4, 12) for _ in range(60)),
           "lines": lambda: "\n".join([" ".join(word() for _ in range(4))] * 2 + [word() + str(i) for i in range(2)] * rng.randint(6, 9))}[kind]
    rows = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(8)), "en", "s", 0) for i in range(140)] + [(1000 + i, bad(), "en", "s", 0) for i in range(junk)]
    rows += [(2000 + i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(8)), "en", f"s{i % 5}", 0) for i in range(100)]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")).collect()}
    assert all(kept for doc, kept in got.items() if not 1000 <= doc < 2000)
    assert not any(kept for doc, kept in got.items() if 1000 <= doc < 2000)


def test_licence_families_apart(spark):
    """Near namesakes get their own family, licences outside the families none, and German "mit" is no cue."""
    from cadastra.llm import licenses
    cases = {"Licensed under CC BY-SA 4.0.": "cc-by-sa", "This text is licensed under CC BY-ND 4.0.": "cc-by-nd", "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "This program is licensed under the GNU Affero General Public License, version 3.": "agpl", "This work is licensed under the GNU General Public License, version 3.": "gpl",
             "Licensed under the BSL 1.1 license.": "bsl", "Licensed under the GPL.": "gpl", "Licensed under the LGPL.": "lgpl", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-only": "gpl",
             "SPDX-License-Identifier: Apache-2.0": "apache", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
             "Licensed under the ISC License.": "isc", "Licensed under the Eclipse Public License 2.0.": "epl", "Released under the MIT License.": "mit",
             "Distributed under the Boost Software License, Version 1.0.": "", "Licensed under the zlib license.": "", "Er kam mit dem Zug und ging mit ihr.": "", "The driving licence was renewed.": ""}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    prose = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = licenses.train(spark, prose.selectExpr("doc_id AS id", "text"))
    got = {r.doc_id: r.families for r in licenses.scan(docs, model=model).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert docs.where(licenses.may_hold(docs.text) & docs.text.contains(" mit ")).count() == 0


@pytest.mark.parametrize("name", ["op5_lm_scores", "op3_quality"])
def test_same_rows_without_broadcasts(spark, monkeypatch, name):
    """The ways for tables too large to broadcast give what the broadcasts give."""
    from cadastra.llm import lm, quality
    rows = lambda: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in QUERIES[name](spark, SF).collect()), key=str)
    want = rows()
    for module, limit in ((lm, "BROADCAST_ROWS"), (lm, "BROADCAST_IDS"), (quality, "BROADCAST_ROWS")):
        monkeypatch.setattr(module, limit, 0)
    assert rows() == want and len(want) > 100
