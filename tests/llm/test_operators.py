"""The training-data operators against brute-force versions, and their edge cases."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from cadastra.llm import ann, bpe, components, hnsw, licenses, lm, packing, quality, simhash, token_counts
from cadastra.llm.queries import QUERIES
from cadastra.llm.vocab import vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(1, "a b c d e f g h i j k l", "en", "s", 23), (1, "a b c d e f g h i j k l", "en", "s", 23), (2, None, "en", None, None), (3, "", None, "s", 0),
            (None, "one two three", None, None, 13), (4, "word " * 200_000, "en", "s", 1_000_000), (5, "a b c d e f g h i j k l", "en", "t", 23), (6, " \n\t ", "en", "s", 4)]
    extra = [(*r, 1, "x", 2.0, "y", "z", 7, 8, "w") for r in rows]
    names = ", kept int, spans string, fp double, measures string, label string, n_words int, component_id int, _lang string"
    return spark.createDataFrame(extra, COLUMNS + names)


def test_word_bpe(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD)
    own = bpe.codec(WORD)
    rng = random.Random(1)
    texts = ["", " ", "don't <|endoftext|> X<|startoftext|>y", "\x1cx\x1f y\x85z\xa0q", "ΑΣ ΣΑΣ.", "İstanbul é", "a" * 3000, "hahahahahahah" * 30, *docs.text.dropna()[:60]]
    texts += ["".join(rng.choice(" \n'stabé1²日😀.,<|>ΣḰ") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text, raw in zip(texts, own.many(texts), strict=True):
        assert t.encode(text, add_special_tokens=False).ids == np.frombuffer(raw, "<i4").tolist(), text[:50]
    got = QUERIES["op2_bpe"](spark, SF).toPandas().set_index("doc_id")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert tuple(got.loc[doc][["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_compatible_pairs_are_merges():
    own = bpe.codec(WORD)
    ranks = {(own.token[a], own.token[b]): own.rank[w] for (a, b), w in own.merged.items()}

    def merged(word):
        parts = list(word)
        while len(parts) > 1:
            r, at = min((ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if r == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    rng = random.Random(2)
    inner = [i for i, t in own.token.items() if ord(t[-1]) < 256]
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(list(own.token))
        word = own.token[a] + own.token[b]
        assert own.compatible(a, b) == (merged(word) == [own.token[a], own.token[b]])


def test_packing(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE)
    got = QUERIES["op10_packing"](spark, SF).toPandas()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for p in got[got.doc_id == doc].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    _sequences(got)


def _sequences(got):
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id").length.cumsum()
    assert (ends - placed.length == placed.offset).all() and ends.max() <= 1024
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))


@pytest.mark.parametrize("seed", range(8))
def test_pack_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 1024])
    counts = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(rng.choice([0, 1, 40, 5000])))
    patterns = packing.pack_histogram(counts, capacity)
    got = Counter()
    for lengths, uses in patterns:
        assert sum(lengths) <= capacity and uses > 0
        got.update({k: v * uses for k, v in Counter(lengths).items()})
    assert got == counts
    ranks = Counter()
    for length, first, uses, _, _ in sorted(packing.slots(patterns)):
        assert first == ranks[length]
        ranks[length] += uses
    assert ranks == counts


def test_quality_measures():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b ", " ", "\n", "c# ", "é|", "\x0b", "a b c d e ", "\x1c"]) for _ in range(rng.randint(0, 40)))
        words, cur = [], ""
        for c in text + " ":
            if c in " \t\n\v\f\r":
                words += [cur] if cur else []
                cur = ""
            else:
                cur += c
        seen, doubled = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\n\v\f\r"):
                doubled += line in seen
                seen.add(line)
        grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        marked = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        assert quality.measure(text)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubled, len(marked))


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_of(codes):
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_simhash(spark, docs):
    got = QUERIES["op4_simhash"](spark, SF).toPandas().set_index("doc_id").loc[docs.doc_id]
    codes = [brute_fingerprint(t or "") for t in docs.text]
    assert list(got.fingerprint) == [f"{c:016x}" for c in codes]
    assert list(got.component_id) == [docs.doc_id[i] for i in components_of(codes)]


@pytest.mark.parametrize("bucket,mean", [(2048, 1024), (4, 1024), (4, 1)])
def test_links_lose_none(spark, monkeypatch, bucket, mean):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "MEAN", mean)
    rng = random.Random(6)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes):
        for _ in range(5):
            for _ in range(rng.randint(1, 4)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    rows = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp bigint")
    roots = {r.node: r.root for r in components.components(simhash.links(rows)).collect()}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    want = components_of(codes)
    got = [roots.get(s, s) for s in signed]
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_gray_index_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(5)]))
    bucket = rng.integers(0, 3, len(codes))
    a, b = simhash.close_pairs(codes, bucket)
    want = {(i, j) for i in range(len(codes)) for j in range(i) if bucket[i] == bucket[j] and int(codes[i] ^ codes[j]).bit_count() <= 4}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == want and len(a) == len(want)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (5, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    label = {n: n for e in edges[:-1] for n in e}
    for _ in label:
        for a, b in edges[:-1]:
            label[a] = label[b] = min(label[a], label[b])
    label.pop(5, None) if 5 not in got else None
    assert got == {n: r for n, r in label.items() if n in got} and {n for e in edges[:-1] if e[0] != e[1] for n in e} == set(got)
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_lm_scores(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE)
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    chosen = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    size, pairs, target, background = 50257, {}, Counter(), Counter()
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids
        pairs[doc] = list(zip([size, *ids], ids, strict=False))
        background.update(pairs[doc])
        if doc in chosen:
            target.update(pairs[doc])

    def model(c):
        left, right = Counter(), Counter()
        for (u, v), n in c.items():
            left[u] += n
            right[v] += n
        return lambda u, v: -math.log((c[u, v] + 50 * (right[v] + 1) / (c.total() + size)) / (left[u] + 50))

    near, far = model(target), model(background)
    for r in QUERIES["op5_lm_scores"](spark, SF).collect():
        p = pairs[r.doc_id]
        assert r.n_tokens == len(p) and (not p or abs(r.score - sum(near(*x) - far(*x) for x in p) / len(p)) < 2e-6)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BYTE)
    got = {d: g.sort_values("section") for d, g in QUERIES["op6_token_counts"](spark, SF).toPandas().groupby("doc_id")}
    for doc, text in list(zip(docs.doc_id, docs.text, strict=True))[:60]:
        rows, text = got[doc], text or ""
        spans = list(zip(rows.start.astype(int), rows.end.astype(int), strict=True))
        want = Counter(max(range(len(spans)), key=lambda k: (min(b, spans[k][1]) - max(a, spans[k][0]), -k)) for a, b in t.encode(text, add_special_tokens=False).offsets)
        assert [want[k] for k in range(len(spans))] == list(rows.n_tokens) and spans[-1][1] == len(text)
    rows = spark.createDataFrame([(1, "hello wonderful world", [("b", 8, 21), ("a", 0, 6)]), (2, "x y", None), (3, None, [("a", 0, 0)])],
                                 "doc_id bigint, text string, sections array<struct<name:string,start:bigint,end:bigint>>")
    out = sorted((r.doc_id, r.section, r.name or "", r.n_tokens, r.n_crossing) for r in token_counts.count(rows, BYTE, "sections").collect())
    assert out == [(1, 0, "a", 1, 0), (1, 1, "b", 2, 1), (2, -1, "", 2, 0), (3, 0, "a", 0, 0)]


def test_licences(spark, docs):
    lean = spark.createDataFrame(docs[["doc_id", "text"]].rename(columns={"doc_id": "id"}))
    model = licenses.train(spark, lean)
    known = {t: f for f, t in licenses.NOTICES}
    got = licenses.scan(spark.createDataFrame(docs[["doc_id", "text"]]), model=model).toPandas().set_index("doc_id")
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        assert got.places[doc] == ",".join(f"{k}:{known[x]}" for k, x in enumerate((text or "").split("\n")) if x in known)
    # held-out wording: not among the training rows
    fresh = [("mit", "Foo is made available under the MIT License."), ("apache", "released under the apache license version 2.0 by the foo authors"), ("proprietary", "(c) 2021 Foo Inc. All rights reserved."),
             ("cc-by-nc", "Text: Creative Commons Attribution NonCommercial 4.0 International License"), ("gpl", "covered by the GNU General Public License, version 3"), ("", "My fishing licence was renewed in May."),
             ("", "The copyright of the song was sold."), ("", "Permission to land was given."), ("", "She renewed her driving license and the car's warranty."), ("", "No rights of way cross the field.")]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(fresh)], "doc_id int, text string")
    out = {r.doc_id: r.families for r in licenses.scan(rows, model=model).collect()}
    assert sum(out[i] == f for i, (f, _) in enumerate(fresh)) >= 9


def test_each_notice_is_found(spark, docs):
    model = licenses.train(spark, spark.createDataFrame(docs[["doc_id", "text"]].rename(columns={"doc_id": "id"})))
    rows = spark.createDataFrame([(i, f"Some words.\n{t}") for i, (_, t) in enumerate(licenses.NOTICES)], "doc_id int, text string")
    got = {r.doc_id: r.places for r in licenses.scan(rows, model=model).collect()}
    assert got == {i: f"1:{f}" for i, (f, _) in enumerate(licenses.NOTICES)}


def test_wrapped_licences(spark, docs):
    import textwrap

    model = licenses.train(spark, spark.createDataFrame(docs[["doc_id", "text"]].rename(columns={"doc_id": "id"})))
    heads = [("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
             ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
             ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
             ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
             ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")]
    rows, want = [], []
    for family, text in heads:
        for width, lead in ((78, ""), (60, " * "), (30, "# "), (1, "")):  # 1: a word per line
            wrapped = "\n".join(lead + x for x in textwrap.wrap(text, width, break_long_words=False))
            rows.append((len(rows), f"The harbour was quiet that day.\n\n{wrapped}\n\nNobody came back before the evening."))
            want.append(family)
    rows += [(len(rows), "He asked for permission\nto land on the island\nand the licence\nwas granted by the person in charge."), (len(rows) + 1, "")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string"), model=model).collect()}
    assert {i: got[i].families for i, _ in rows} == dict(enumerate([*want, "", ""]))
    assert got[0].places == "2:mit" and got[0].n_paragraphs == 1


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, size=(1500, 1)).astype(np.float32)
    vectors[1000:1300] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (None, [1.0] * 16), (40, vectors[40].tolist())]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    points = ann.usable(table)
    index, shards = ann.build_index(points, shard_size=400)
    got = ann.search_index(index, shards, points.where("id % 20 = 0")).toPandas()
    assert shards > 1 and got.query_id.nunique() == 75
    hit = 0
    exact = vectors.astype(float)
    for q, rows_ in got.groupby("query_id"):
        scores = (exact[q] * exact).sum(1)
        order = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        rows_ = rows_.sort_values("rank")
        assert list(rows_["rank"]) == list(range(1, 21)) and q not in set(rows_.vec_id)
        assert np.allclose(rows_.score, scores[rows_.vec_id], rtol=0, atol=1e-12)
        hit += len(set(order) & set(rows_.vec_id))
    assert hit / (20 * 75) > 0.95
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0]), (7, [0.0, 1.0])], "vec_id bigint, embedding array<float>"))
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few.collect()) == [(0, 1, 20), (0, 2, 7), (20, 1, 0), (20, 2, 7)]


def test_graph_is_whole_when_small():
    assert hnsw.build(np.eye(3, dtype=np.float32)).search(np.zeros((1, 4), np.float32), 5).tolist() == [[0, 1, 2]]


def test_edge_rows(spark, odd):
    empty = odd.limit(0)
    marks = quality.assess(odd).collect()
    assert len(marks) == 8 and all(r.base_failed and not r.kept for r in marks if r.n_words < 10)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 5]
    named = sorted((str(r.doc_id), r.component_id) for r in simhash.near_copies(odd).collect())
    assert named == [("1", 1), ("1", 1), ("2", 2), ("3", 2), ("4", 4), ("5", 1), ("6", 2), ("None", None)]
    one = simhash.keep_one(odd)
    assert one.columns == odd.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "4", "None"]
    encoded = bpe.decode(bpe.encode(odd, WORD), WORD)
    assert encoded.columns == [*odd.columns, "ids", "decoded"] and encoded.where("text IS NULL").first().decoded == ""
    pieces = packing.pack(packing.cut_pieces(odd, BYTE)).toPandas()
    assert pieces[pieces.doc_id == 2].length.tolist() == [1] and pieces[pieces.doc_id.isna()].doc_tokens.iloc[0] == 4
    _sequences(pieces)
    scores = {str(r.doc_id): r.score for r in lm.score(odd, spark.createDataFrame([(1,), (1,), (99,), (None,)], "doc_id bigint"), BYTE).collect()}
    assert scores["2"] is None and scores["3"] is None and scores["None"] is not None
    counts = token_counts.count(odd, BYTE)
    assert counts.where("doc_id = 2").first().n_tokens == 0 and counts.where("doc_id = 4").first().n_tokens > 200_000
    assert len(licenses.scan(odd).collect()) == 8
    for table in (quality.assess(empty), quality.keep_good(empty), simhash.near_copies(empty), simhash.keep_one(empty), bpe.digests(empty, WORD), packing.pack(packing.cut_pieces(empty, BYTE)),
                  lm.score(empty, spark.createDataFrame([(1,)], "doc_id bigint"), BYTE), token_counts.count(empty, BYTE), licenses.scan(empty)):
        assert table.count() == 0


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    # each stage against its input, by brute force
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality"](spark, documents, SF).toPandas()
    judged = quality.assess(documents).toPandas()
    assert sorted(first.doc_id) == sorted(judged[judged.kept].doc_id)
    first = first.sort_values("doc_id").reset_index(drop=True)
    second = stage["near_copies"](spark, spark.createDataFrame(first, COLUMNS), SF).toPandas()
    assert sorted(second.doc_id) == sorted({first.doc_id[i] for i in components_of([brute_fingerprint(t) for t in first.text])})
    third = stage["personal_data"](spark, spark.createDataFrame(second, COLUMNS), SF).toPandas()
    assert sorted(third.doc_id) == sorted(second.doc_id) and not third.text.str.contains("@mail").any() and (third.n_chars == third.text.str.len()).all()
    assert sorted(out.toPandas().doc_id.unique()) == sorted(third.doc_id)
    for rows in (odd, odd.limit(0)):
        path = os.path.join(tmp_path, "odd" if rows is odd else "none")
        rows.write.parquet(f"{path}/documents.parquet")
        assert corpus_pipeline.run(spark, path).count() == (3 - 1 - 1 if rows is odd else 0)
