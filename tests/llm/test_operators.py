"""Each operator against a plain version on small rows, with nulls, empty and long texts, ties and repeated rows."""
import base64
import hashlib
import itertools
import math
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tablewise.llm import blocks, bpe, charlm, decontam, fixity, interpolation, knn, langid, licences, quality, registered, shared, simhash, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, component_id int, ids string"
WORDS = "the river runs over old stone while birds sing about rain and wind near a quiet village by the sea".split()


def _docs(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    rows = [(i, t, lang, "s", len(t or ""), "b", 1, "x") for i, (t, lang) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, DOCS)


def _texts(seed, n, low=5, high=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def mixed(spark):
    texts = _texts(1, 40) + [None, "", "   ", "one", "one two", "!!! ???", "Ünïcode — naïve \n\n  text\t ", "the sea " * 5000]
    texts += [texts[0], texts[0], texts[1].upper()]
    df = _docs(spark, texts)
    odd = spark.createDataFrame([(None, "a null id", None, None, None, None, None, None), (3, texts[3], "en", "s", 1, "b", 1, "x")], DOCS)
    return df.union(odd)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ 1
def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, vector string, shard int")


@pytest.mark.parametrize("shard_rows,query_rows", [(8, 2), (1000, 1000)])
def test_top_k(spark, shard_rows, query_rows):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(4)], 0, "x", 1) for i in range(120)]
    rows += [(200, rows[0][1], 0, "x", 1), (200, rows[0][1], 0, "x", 1), (201, None, 0, "x", 1), (202, [1.0, None, 0.0, 0.0], 0, "x", 1), (203, [float("nan")] * 4, 0, "x", 1), (None, [9.0] * 4, 0, "x", 1), (204, [1.0], 0, "x", 1)]
    got = sorted(tuple(r) for r in knn.top_k(_vectors(spark, rows), shard_rows=shard_rows, query_rows=query_rows).collect())
    whole = {i: [math.floor(256 * x) for x in v] for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_k_without_rows(spark):
    assert knn.top_k(_vectors(spark, [])).count() == 0
    assert knn.top_k(_vectors(spark, [(7, [1.0], 0, "x", 1)])).count() == 0


def test_tree_with_large_numbers_and_ties():
    points = np.array([[2**40, 1]] * 20 + [[-(2**40), 3]] * 5, np.int64)
    found = knn.search(points, np.arange(25), np.array([[2**20, 1]], np.int64), [3], [None], 5, leaf_rows=2)
    assert found == [[(2**60 + 1, i) for i in (0, 1, 2, 4, 5)]]


# ------------------------------------------------------------------ 2
def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    label = {i: i for i in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_fingerprints_and_components(spark):
    rng = random.Random(5)
    texts = _texts(4, 30, 30, 60)
    for t in texts[:12]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", texts[2], texts[2].upper(), "x", "x y"]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(_docs(spark, texts)).collect()}
    prints = {i: _print(t) for i, t in enumerate(texts)}
    label = _components(prints)
    assert got == {i: (f"{p:016x}", label[i]) for i, p in prints.items()}


def test_links_are_complete(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in (1, 2, 3, 4):
            x = p
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            prints.add(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fingerprint long")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3}
    assert got == want


def test_long_chains_become_one_component(spark):
    n = 200
    nodes = spark.range(n).select(F.col("id").alias("node"), F.struct(F.col("id").alias("x")).alias("label"))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"]["x"] for r in simhash.components(nodes, edges).collect()} == {0}


def test_near_duplicates_with_odd_rows(spark, mixed, none):
    assert simhash.near_duplicates(mixed).count() == mixed.count()
    kept = simhash.one_of_each(mixed)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == mixed.columns and len(ids) == len(set(ids)) and 0 in ids and None in ids and 48 not in ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    only = spark.createDataFrame([(None, "same text here", "en", "s", 1, "b", 1, "x")] * 3, DOCS)
    assert simhash.one_of_each(only).count() == 1


# ------------------------------------------------------------------ 3
def _tokens(text):
    return (text or "").encode().lower().split() + ["end"]


def _interpolated(rows, order, weights):
    """Scores by plain dictionaries, with the operator's weights."""
    learn = [_tokens(t) for t, learned in rows if learned]
    grams = [Counter() for _ in range(order + 1)]
    for tokens in learn:
        padded = ["begin"] * (order - 1) + tokens
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                grams[k][tuple(padded[i - k + 1 : i + 1])] += 1
    total, types = sum(grams[1].values()), len(grams[1])
    contexts = [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in grams[k].items():
            contexts[k][g[:-1]] += n
    out = []
    for text, _ in rows:
        tokens, score, base = _tokens(text), 0.0, 0.0
        padded = ["begin"] * (order - 1) + tokens
        for i in range(order - 1, len(padded)):
            p = 1 / (types + 1)
            for k in range(1, order + 1):
                g = tuple(padded[i - k + 1 : i + 1])
                n = contexts[k][g[:-1]]
                b = min(int(math.floor(math.log2(n + 0.5))) + 1, interpolation.FREQUENCY_BUCKETS - 1) if n else 0
                w = weights[k, b]
                p = w * (grams[k][g] / n if n else 0) + (1 - w) * p
            score += math.log10(p)
            base += math.log10((grams[1][padded[i],] + 0.5) / (total + 0.5 * (types + 1)))
        out.append((len(tokens), sum((w,) in grams[1] for w in tokens), total, base, score))
    return out


@pytest.mark.parametrize("order,block_bytes", [(2, 200), (3, 1_000_000)])
def test_interpolated_scores(spark, mixed, monkeypatch, order, block_bytes):
    kept = {}
    learn = interpolation.learn_weights
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: kept.setdefault("w", learn(*a)))
    held_out = registered.remainder(5) == 1
    got = interpolation.score(mixed, ~held_out, held_out, order=order, held_every=3, rounds=4, block_bytes=block_bytes).collect()
    rows = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    rest = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, _ in rows]
    want = _interpolated([(t, m != 1) for (_, t), m in zip(rows, rest)], order, kept["w"])
    key = lambda x: repr((x[0], x[1], x[2], x[3], x[4], round(x[5], 5), round(x[6], 5)))
    assert sorted(map(key, got)) == sorted(key((i, m == 1, *w)) for (i, _), m, w in zip(rows, rest, want))


def test_probabilities_sum_to_one_and_help(spark):
    texts = _texts(7, 200, 10, 30)
    got = interpolation.score(_docs(spark, texts), F.col("doc_id") < 150, F.col("doc_id") >= 150, rounds=6).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] >= got[1] - 1e-6 * abs(got[1])
    words = sorted(set(WORDS))
    probe = _docs(spark, texts[:150] + words + ["neverseen"])
    scored = interpolation.score(probe, F.col("doc_id") < 150, F.lit(False), order=1, rounds=3).where("doc_id >= 150").select("score").collect()
    ends = interpolation.score(_docs(spark, texts[:150] + [""]), F.col("doc_id") < 150, F.lit(False), order=1, rounds=3).where("doc_id = 150").first()["score"]
    assert sum(10 ** (r["score"] - ends) for r in scored) < 1.0 + 1e-6


def test_interpolation_without_rows(spark, none):
    assert interpolation.score(none, F.lit(True), F.lit(False)).count() == 0
    r = interpolation.score(_docs(spark, ["a b"]), F.lit(False), F.lit(True)).first()
    assert (r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0)


# ------------------------------------------------------------------ 4 and 8
def _kn(counts, order, modified):
    """Kneser-Ney by dictionaries: probability of the last character of an n-gram."""
    full = Counter(counts)
    suffixes = {g[i:] for g in full for i in range(1, len(g))}
    c = dict(full)
    for g in set(full) | suffixes:
        if len(g) > 1:
            c[g[1:]] = c.get(g[1:], 0) + 1 if g[1:] not in full else c[g[1:]]
    tot, cut = Counter(), Counter()
    disc = {}
    for k in {len(g) for g in c}:
        n = [sum(1 for g in c if len(g) == k and c[g] == i) for i in range(5)]
        y = min(max(n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5, 0.05), 0.95)
        disc[k] = [min(max(0.05, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else y), 0.95 * i) if modified else min(y, 0.95 * i) for i in (1, 2, 3)]
    for g, n in c.items():
        tot[g[:-1]] += n
        cut[g[:-1]] += disc[len(g)][min(n, 3) - 1]
    letters = len({g[-1] for g in full})

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / (letters + 1)
        h = g[:-1]
        if not tot[h]:
            return below
        own = (c[g] - disc[len(g)][min(c[g], 3) - 1]) / tot[h] if g in c else 0
        return own + cut[h] / tot[h] * below

    return p


@pytest.mark.parametrize("modified", [False, True])
def test_log_probabilities(spark, modified):
    from tablewise.llm import charlm

    strings = [charlm.START + w + "\x03" for w in WORDS]
    asked = [charlm.START + w + "\x03" for w in ("river", "zebra", "stones")]
    position_grams = lambda s: [s[max(0, i - 3) : i + 1] for i in range(1, len(s))]
    counts = Counter(g for s in strings for g in position_grams(s))
    grams, inverse, sizes = charlm.grams_of(strings, 1, 4)
    assert Counter(grams[i] for i in inverse) == counts and sizes.tolist() == [len(s) - 1 for s in strings]
    every = sorted({g for s in strings + asked for g in position_grams(s)})
    got = charlm.log_probabilities(spark.createDataFrame([(g,) for g in every], "gram string"), spark.createDataFrame([("x", g, n) for g, n in counts.items()], "class string, gram string, n long"), ["x"], 4, modified)
    p = _kn(counts, 4, modified)
    assert {r["gram"]: round(r["logs"][0], 4) for r in got.collect()} == pytest.approx({g: math.log10(p(g)) for g in every}, abs=2e-4)


def test_languages(spark):
    de = "der fluss und die alten steine liegen unter dem regen im stillen dorf am meer mit vielen vögeln".split()
    rng = random.Random(2)
    texts, langs = [], []
    for i in range(120):
        words, lang = ((WORDS, "en"), (de, "de"))[i % 2]
        texts.append(" ".join(rng.choice(words) for _ in range(20)))
        langs.append(lang if i % 7 else None)
    extra = [None, "", "12 34 !!", "Der Fluss", "the rain"]
    for size in (300, 1_000_000):
        got = {r["doc_id"]: r for r in langid.identify(_docs(spark, texts + extra, langs + [None] * 5), registered.remainder(3) != 1, block_bytes=size).collect()}
        assert all(got[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(120))
        assert [got[120 + k]["lang_pred"] for k in range(5)] == ["und", "und", "und", "de", "en"]
        assert all(got[i]["rejected"] and got[i]["score"] == 0 for i in (120, 121, 122)) and all(0 <= r["score"] <= 1 for r in got.values())
        assert sum(got[i]["rejected"] for i in range(120)) <= 2


def test_an_unlearned_language_is_rejected(spark):
    """Five per cent of the rows are of a language nobody labelled, two more are labelled wrongly; all rows may be learned from."""
    rng = random.Random(21)
    other = "zxqvk qjwzx vkqpz wxjkq zzvqx kqjxv pqzwx jvkzq".split()
    de = "der fluss und die alten steine liegen unter dem regen im stillen dorf am meer mit vielen vögeln".split()
    kinds = [("junk", None) if i % 20 == 0 else ("junk", "en") if i % 50 == 1 else (WORDS, "en") if i % 2 else (de, "de") for i in range(800)]
    texts = [" ".join("".join(rng.sample("zxqvkjwpy", 6)) for _ in range(40)) if w == "junk" and lang is None else " ".join(rng.choice(other if w == "junk" else w) for _ in range(rng.randint(20, 60))) for w, lang in kinds]
    got = {r["doc_id"]: r["rejected"] for r in langid.identify(_docs(spark, texts, [lang for _, lang in kinds]), F.lit(True)).collect()}
    unknown = [i for i, (w, lang) in enumerate(kinds) if w == "junk" and lang is None]
    assert len(unknown) == 40 and all(got[i] for i in unknown)
    clean = [i for i, (w, _) in enumerate(kinds) if w != "junk"]
    assert sum(got[i] for i in clean) <= 0.005 * len(clean)


def test_languages_without_learning(spark, none):
    assert langid.identify(none, F.lit(True)).count() == 0
    assert langid.identify(_docs(spark, ["text"]), F.lit(False)).first()["lang_pred"] == "und"


def test_quality(spark, none):
    good = _texts(11, 150, 20, 60)
    bad = [t.upper().replace(" ", "!! ") for t in good[:10]] + [" ".join(w + "$$$" for w in t.split()) for t in good[10:20]] + ["The " * 80]
    docs = _docs(spark, good + bad + [None, " "], ["en"] * 100 + [None] * 73)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(150, 160)] + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, labels).collect()}
    assert sum(not got[i] for i in range(150)) <= 3 and not any(got[i] for i in range(150, 173))
    assert quality.classify(none, labels).count() == 0
    assert [r["keep"] for r in quality.classify(_docs(spark, ["some text", None]), labels.where("false")).orderBy("doc_id").collect()] == [True, False]


def test_quality_of_rare_languages(spark):
    """A language with one or two held-back documents, or none, keeps its documents; labels beyond the fit set limits."""
    texts = _texts(13, 400, 20, 60)
    langs = ["en"] * 340 + ["xx"] * 40 + ["yy"] * 20
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(300), 340, 341, 342, 343, 344, 345]], "doc_id long, quality int, toxic int")
    for most in (100_000, 120):
        got = {r["doc_id"]: r for r in quality.classify(_docs(spark, texts, langs), labels, trusted_rows=most).collect()}
        for part in (range(340), range(340, 380), range(380, 400)):
            assert sum(not got[i]["keep"] for i in part) <= 0.1 * len(part)


def test_quality_learns_from_all_trusted_documents(spark):
    """However many documents are trusted, the model is fitted on all but the held-back ones."""
    n = 130_000
    ids = spark.range(n).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    late = {r["doc_id"] for r in ids.orderBy("h", "doc_id").tail(25_000)}  # beyond the first 100 000 by hash
    fitted = spark.range(n).where(F.pmod(F.xxhash64("id"), F.lit(quality.HELD_EVERY)) != 0)
    few = sorted(late & {r["id"] for r in fitted.collect()})[::50]
    text = F.when(F.col("id").isin(few), "zebra").otherwise("river")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = quality.classify(docs, labels)
    assert got.count() == n
    # what was seen 300 times in 100 000 is no surprise from its second character on
    assert len(few) > 300 and got.where(F.col("doc_id").isin(few)).agg(F.max("perplexity")).first()[0] < 5


def test_learning_places(spark):
    """The ids of every block marked by a shuffle of ids: nulls, repeated ids, empty blocks; equal to a plain look-up."""
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "the sea", "a village " * 9])) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    learned = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    found = charlm.learning_places(docs, learned, 200)
    tables = list(blocks.blocks_of([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])], "text", 200))
    assert len(tables) > 10 and {charlm._ids_key(t) for t in tables} == set(found)
    for t in tables:
        flags = np.unpackbits(np.frombuffer(found[charlm._ids_key(t)], np.uint8), count=t.num_rows).tolist()
        assert flags == [int(i is not None and i % 3 == 0) for i in t.column("doc_id").to_pylist()]
    assert set(charlm.learning_places(docs, learned.where("false"), 200).values()) == {b""}


# ------------------------------------------------------------------ 5
def _records(spark, rows):
    return spark.createDataFrame(rows, "file string, number long, offset long, data binary, node int, hash string")


def test_fixity(spark):
    rows = [(f, n, 10 * n, f"{f}{n}".encode(), 0, "h") for f in ("a", "b", None) for n in range(200)]
    rows += [("a", 3, 30, b"a3", 0, "h"), ("c", None, 0, b"x", 0, "h")]
    first = _records(spark, rows)
    other = [r for r in rows if r[:2] != ("a", 70)]
    other = [(r[0], r[1], r[2], b"b19!" if r[:2] == ("b", 199) else b"zz" if r[:2] == ("b", 0) else None if r[:2] == (None, 9) else r[3], *r[4:]) for r in other]
    other += [("d", 5000, 1, b"new", 0, "h"), ("b", 7, 70, b"b7", 0, "h")]
    got = {(r["file"], r["number"]): r["fault"] for r in fixity.audit(first, _records(spark, other), fanout=4).collect()}
    assert got == {("a", 70): "missing", ("b", 199): "length" if len(b"b19!") != len(b"b199") else "content", ("b", 0): "content", ("", 9): "length", ("d", 5000): "extra", ("b", 7): "length"}
    assert fixity.audit(first, first).count() == 0
    assert fixity.audit(first, _records(spark, [])).count() == 600 and fixity.audit(_records(spark, []), _records(spark, [])).count() == 0


# ------------------------------------------------------------------ 6
def test_licences(spark, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,\nINCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    parts = re.split(r"(?<=Software\.)\n\n", mit)
    texts = [mit, "Title\nReleased under the MIT License.\nmore", "We licensed under cc by nobody.", None, "", "Licensed under the Apache License, Version 2.0. Released under the MIT license", parts[1] + " " + parts[0], "word. " * 3000 + "All rights reserved."]
    got = sorted((r["doc_id"], r["licence"], len(r["rule"])) for r in licences.scan(_docs(spark, texts)).collect())
    assert got == [(0, "MIT", 3), (1, "MIT", 1), (5, "Apache-2.0", 1), (5, "MIT", 1), (7, "All-rights-reserved", 1)]
    assert licences.scan(none).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2020 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_FILE = """Copyright (c) 2020, A Writer

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3_END = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_FILE = """    A program that does things
    Copyright (C) 2020  A Writer

    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE_FILE = """   Copyright 2020 A Writer

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""


def test_licence_files(spark):
    """Unmodified files, with line marks of a comment or a list, and a notice wrapped twice in one sentence."""
    comment = "".join(f" * {line}\n" for line in GPL_FILE.replace("version 3", "version 2").splitlines())
    listed = BSD_FILE.replace("1. R", "(1) R").replace("2. R", "2) R")
    texts = [MIT_FILE, BSD_FILE, BSD_FILE + BSD3_END, GPL_FILE, APACHE_FILE, comment, listed, "Head\n\nReleased under the\nMIT License\n\nmore\nReleased under\nthe MIT License\nend", MIT_FILE.replace("\n", "\r\n"), BSD_FILE.replace("1. ", "* ").replace("2. ", "* ")]
    got = sorted((r["doc_id"], r["licence"], len(r["rule"])) for r in licences.scan(_docs(spark, texts)).collect())
    assert got == [(0, "MIT", 3), (1, "BSD-2-Clause", 3), (2, "BSD-3-Clause", 4), (3, "GPL-3.0-or-later", 3), (4, "Apache-2.0", 4), (5, "GPL-2.0-or-later", 3), (6, "BSD-2-Clause", 3), (7, "MIT", 1), (7, "MIT", 1), (8, "MIT", 3), (9, "BSD-2-Clause", 3)]


# ------------------------------------------------------------------ 7
def _edits(a, b):
    """Smallest word edit distance of ``a`` to any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return min(row)


def test_best_match_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 9))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
        want = _edits(a, b)
        got = decontam.best_match(a, b, 99)
        assert got[0] == want and decontam._ends(a, b[got[1] : got[2]], True)[-1] == want
        assert want == 0 or decontam.best_match(a, b, want - 1) is None


def test_decontamination(spark, none):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 4, 8, 15, 20, 30, 40, 56)]
    texts, want = [], set()
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        if d % 2:
            number = d % len(items)
            copy = list(items[number])
            for _ in range(int(0.1 * len(copy))):
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randint(0, len(words))
            words[at:at] = copy
        texts.append(" ".join(w.upper() + "," if k % 9 == 0 else w for k, w in enumerate(words)))
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            if _edits(item, decontam.words_of(t)) <= int(0.2 * len(item) + 1e-9):
                want.add((d, i))
    table = spark.createDataFrame([(i, " ".join(x), 1) for i, x in enumerate(items)] + [(90, None, 1), (91, "...", 1)], "item_id long, text string, edits int")
    for size in (1000, 10_000_000):
        rows = decontam.contaminated(_docs(spark, texts + [None, ""]), table, item_bytes=size, block_bytes=size).collect()
        got = {(r["doc_id"], r["item_id"]) for r in rows}
        assert got <= want and len(got & want) >= 0.95 * len(want) and len(rows) == len(got)
    assert decontam.contaminated(none, table).count() == 0 and decontam.contaminated(_docs(spark, texts), table.where("false")).count() == 0


def test_decontamination_at_the_limit(spark):
    """Exactly int(0.2 n) edits, in the first words, the last ones or anywhere: the wanted recall at every length."""
    rng = random.Random(16)
    vocabulary = [f"w{k}" for k in range(3000)]
    items, texts, want = {}, [], set()
    for n in (1, 4, 5, 9, 10, 12, 14, 15, 17, 20, 24, 30, 40, 56):
        for draw in range(12):
            item = rng.sample(vocabulary, n)
            limit, copy = int(0.2 * n + 1e-9), list(item)
            items[len(items)] = " ".join(item)
            places = (range(limit), range(n - limit, n), rng.sample(range(n), limit))[draw % 3]
            for k in sorted(places, reverse=True):
                copy[k : k + 1] = rng.choice([["edited"]] * 3 + [[]] + [["edited", copy[k]]])
            around = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 60))] for _ in range(2)]
            texts.append(" ".join(around[0] + copy + around[1]))
    for d, text in enumerate(texts):
        words = text.split()
        want |= {(d, i) for i, item in items.items() if _edits(item.split(), words) <= int(0.2 * len(item.split()) + 1e-9)}
    table = spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id long, text string, edits int")
    rows = decontam.contaminated(_docs(spark, texts), table, block_bytes=5000).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got <= want and {(d, d) for d in range(len(texts))} <= want and len(rows) == len(got)
    assert len(got) >= 0.97 * len(want)


def test_decontamination_recall_by_length():
    """Exactly int(0.2 n) edits anywhere, 200 items of each length, against the edit distance of every pair planted."""
    rng = random.Random(26)
    vocabulary = [f"w{k}" for k in range(3000)]
    for n in (1, 3, 5, 7, 10, 14, 15, 20, 30, 56):
        items, texts, limit = [], [], int(0.2 * n + 1e-9)
        for k in range(200):
            item = rng.sample(vocabulary, n)
            copy = list(item)
            for place in sorted(rng.sample(range(n), limit), reverse=True):
                copy[place : place + 1] = rng.choice([["edited"]] * 3 + [[]] + [["edited", copy[place]]])
            assert _edits(item, copy) <= limit
            items.append((k, " ".join(item)))
            texts.append(" ".join(["before"] * rng.randint(0, 9) + copy + ["behind"] * rng.randint(0, 9)))
        found = {(row, number) for row, number, *_ in decontam._hits(decontam.pa.table({"text": texts}), decontam.tables_of(items))}
        recall = sum((k, k) in found for k in range(200)) / 200
        assert recall >= (1.0 if limit == 0 else 0.95), (n, recall)


def test_tables_follow_from_the_wanted_recall():
    for stretch in (1, 2, 3, 4, 6):
        n = decontam.tables_for(stretch, 0.99)
        missed = math.prod((1 - decontam.chance(t, stretch)) ** 2 for t in range(n))
        assert missed <= 0.01 and (n == 1 or missed / (1 - decontam.chance(n - 1, stretch)) ** 2 > 0.01)
    assert decontam.tables_for(4, 0.9) < decontam.tables_for(4, 0.999)
    assert [decontam.stretch_of(n, int(0.2 * n)) for n in (1, 4, 5, 10, 20, 56)] == [1, 4, 2, 3, 4, 4]


# ------------------------------------------------------------------ 9
def test_byte_bpe(spark, mixed, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab1 \n\t'sre  ..!\x1c\x85é中　 ") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = mixed.union(_docs(spark, texts))
    for size in (500, 4_000_000):
        encoded = bpe.encode(df, ranks, public_tokenizers.PATTERN, size)
        got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bpe.decode(encoded, ranks).collect()), key=repr)
        want = sorted(((r["doc_id"], np.array(encoding.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode()) for r in df.collect()), key=repr)
        assert got == want
    r = bpe.digest(bpe.tokenize(_docs(spark, ["hello"]))).first()
    assert r["decoded_sha256"] == hashlib.sha256(b"hello").hexdigest() and r["n_tokens"] == 1
    assert bpe.tokenize(none).count() == 0


def test_pre_tokens_of_a_block_are_matched_joined():
    rng = random.Random(10)
    texts = [None, "", *(" ".join(f"w{rng.randrange(2000)}{rng.choice(['', ',', chr(10) + 'x', 'é中', chr(0x85), chr(0x1c), ' ', chr(0x200b)])}" for _ in range(200)) for _ in range(60))]
    calls = []

    class Counted:
        def __init__(self, pattern):
            self.of = regex.compile(pattern)

        def findall(self, text):
            calls.append(text)
            return self.of.findall(text)

    find = Counted(public_tokenizers.PATTERN)
    segments, plain, at, lengths = bpe.cut(bpe.pa.chunked_array([bpe.pa.array(texts, bpe.pa.string())]), find)
    assert len(segments) == len(plain) and lengths[:2].tolist() == [0, 0]
    parts, order, sizes = bpe._pre_tokens(segments, plain, find)
    solid = int(plain.sum())
    assert solid > 2000 and len(calls) <= len(segments) - solid + len(texts) + solid // bpe.SEGMENTS + 1
    cuts = bpe.starts_of(sizes[order])
    own = {int(k): parts[a:b] for k, a, b in zip(order, cuts, cuts[1:])}
    done = 0
    for text, n in zip(texts, lengths.tolist()):
        got = [w for k in at[done : done + n].tolist() for w in own[k]]
        assert got == find.of.findall(text or "")
        done += n


# ------------------------------------------------------------------ 10
def test_urls(spark):
    rows = ["http://a.net/x", "https://www.Example.NET/en/1?q=/de/", "https://example.com/de/", "http://b.org/fr/9#t", "http://b.org", "net/", None, "", "http://notnet.com/", "http://net/", "http://a.net", "http://x.com/fr/a", "http://c.org/xx/1"] * 12
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(rows)], "page_id long, url string, html string, ratio string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    want = ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, "net/", None, None, None]
    assert len(got) == len(rows) and [got[i]["rule"] for i in range(13)] == want
    assert [got[i]["verdict"] for i in range(4)] == ["block", "allow", "block", "allow"] and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert (got[1]["host"], got[1]["path"], got[5]["host"], got[6]["path"]) == ("www.example.net", "/en/1", "", "")
    assert got[10]["path"] == "" and all(got[i]["verdict"] == got[i + 13]["verdict"] for i in range(100))
    assert urls.judge(df.where("false")).count() == 0


def test_a_very_long_url_and_clashing_columns(spark):
    rows = [(i, f"http://a{i}.net/x{i}", "h", 1.0, 1) for i in range(40)] + [(i, f"https://b{i}.org/fr/{i}", "h", 1.0, 1) for i in range(40, 80)]
    rows += [(90, "https://long.example/" + "ab/é中" * 20_000, "h", 1.0, 1), (91, "", "h", 1.0, 1), (None, None, "h", 1.0, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, ratio double, salt int")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == 83 and got[90]["host"] == "long.example" and got[90]["verdict"] in ("allow", "block") and got[0]["verdict"] == "block" and got[50]["verdict"] == "allow"


def _plain_ratio(text, counts, letters, order):
    total = 0.0
    marked = "\x02" + text
    for i in range(1, len(marked)):
        logs = []
        for kind in ("yes", "no"):
            p = 1.0 / letters
            for k in range(1, order + 1):
                if i - k + 1 < 0:
                    break
                gram = marked[i - k + 1 : i + 1]
                after = {g[-1]: n for g, n in counts[kind].items() if len(g) == k and g[:-1] == gram[:-1]}
                if after:
                    p = (after.get(gram[-1], 0) + len(after) * p) / (sum(after.values()) + len(after))
            logs.append(math.log10(p))
        total += logs[0] - logs[1]
    return total / (len(marked) - 1) if len(marked) > 1 else 0.0


def test_url_ratios_match_plain_version(spark):
    rng = random.Random(12)
    texts = [f"http://{rng.choice(['cat', 'dog'])}{k}.net/{k}" for k in range(25)] + [f"https://{rng.choice(['sea', 'sun'])}{k}.org/fr/{k}" for k in range(25)] + ["http://cats.com/de", "https://suns.com/fr", "plain", "é中://x"]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    rows = urls.judge(df).collect()
    ruled = {t: ("block" if ".net/" in t else "allow" if ".org/fr/" in t else None) for t in texts}
    hashed = {r["url"]: r["h"] for r in df.select("url", F.xxhash64("url").alias("h")).collect()}
    held = {t for t in texts if ruled[t] and hashed[t] % urls.HELD_EVERY == 0}
    counts = {"yes": Counter(), "no": Counter()}
    for t in texts:
        if ruled[t] and t not in held:
            marked = "\x02" + t
            for i in range(1, len(marked)):
                longest = marked[max(0, i - urls.ORDER + 1) : i + 1]
                counts["yes" if ruled[t] == "allow" else "no"].update(longest[-k:] for k in range(1, len(longest) + 1))
    letters = 1 + len({g for c in counts.values() for g in c if len(g) == 1})
    want = {t: _plain_ratio(t, counts, letters, urls.ORDER) for t in texts}
    assert held and all(r["ratio"] == pytest.approx(want[texts[r["page_id"]]], abs=1e-6) for r in rows)
    bins = {kind: np.array([math.floor(want[t] / urls.BIN + 0.5) * urls.BIN for t in held if ruled[t] == kind]) for kind in ("allow", "block")}
    limit = (np.quantile(bins["allow"], 0.1) + np.quantile(bins["block"], 0.9)) / 2 if all(map(len, bins.values())) else 0.0
    assert all(r["verdict"] == (ruled[texts[r["page_id"]]] or ("allow" if r["ratio"] >= limit else "block")) for r in rows)


def test_licences_in_very_long_texts(spark):
    line = "Released under the MIT License\n"
    texts = [line * 100_000, "Released under the MIT License. " * 50_000, None, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, rule string, row int")
    found = {r["doc_id"]: r["n"] for r in licences.scan(df).groupBy("doc_id").agg(F.count("licence").alias("n")).collect()}
    assert found == {0: 100_000, 1: 50_000}


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, none):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert got == sorted(map(tuple, final.collect())) and len(got) == before.count() > 100
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, n, _, d, ids in got:
        own = np.frombuffer(bytes(ids), "<u4").tolist()
        assert d == hashlib.sha256(texts[i].encode()).hexdigest() and own == encoding.encode_ordinary(texts[i]) and len(own) == n
    empty = none.select(*docs.columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_clean_rows_stay_beside_rejected_ones(spark, monkeypatch):
    """Rows that share a doc_id with a rejected or a different row, or have none, are judged by themselves."""
    texts = _texts(31, 60, 20, 40)
    item = " ".join(f"item{k}" for k in range(20))
    rows = [(None if i % 2 else i // 4, t, "en", "s", len(t), "b", 1, "x") for i, t in enumerate(texts)]
    bad = [(i, item, "en", "s", 1, "b", 1, "x") for i in (None, 0, 3)]
    docs = spark.createDataFrame(rows + bad, DOCS)
    table = spark.createDataFrame([(1, item, 1)], "item_id long, text string, edits int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "read_table", lambda spark, sf_dir, name: {"benchmark": table, "labels": labels}[name])
    clean = sorted(texts)
    assert sorted(r["text"] for r in corpus_pipeline.decontamination_stage(spark, docs, "").collect()) == clean
    odd = docs.union(spark.createDataFrame([(i, "", "en", "s", 0, "b", 1, "x") for i in (None, 1)], DOCS))
    kept = {r["text"] for r in corpus_pipeline.language_stage(spark, odd, "").collect()}
    assert "" not in kept and len(kept & set(texts)) >= 55
    assert sorted(r["text"] for r in corpus_pipeline.near_duplicate_stage(spark, docs.union(docs), "").collect()) == sorted([*texts, item])


def test_row_keys(spark):
    """Only equal rows share a key; nulls count by their places."""
    rows = [(None, "", 1), ("", None, 1), (None, None, 1), ("a", "b", 1), ("a", "b", 1), ("a", "b", None)]
    df = spark.createDataFrame(rows, "`x.y` string, text string, n long")
    keys = [bytes(r[0]) for r in df.select(shared.row_key(df)).collect()]
    assert {len(k) for k in keys} == {16} and len(set(keys)) == 5 and keys[3] == keys[4]


def test_scores_do_not_depend_on_shards(spark, monkeypatch):
    """Many shards answer like few, and carried columns stay with their rows."""
    texts = _texts(41, 30) + [None, "", "the sea " * 50]
    df = _docs(spark, texts, ["en", "de", None] * 11).withColumn("mark", F.concat(F.lit("m"), "doc_id"))
    few = sorted(map(tuple, langid.identify(df, F.lit(True), carried=("mark",)).collect()), key=repr)
    monkeypatch.setattr(charlm, "SHARD_GRAMS", 40)
    many = sorted(map(tuple, langid.identify(df, F.lit(True), carried=("mark",)).collect()), key=repr)
    assert few == many and len(few) == 33 and all(r[-1] == f"m{r[0]}" for r in few)


def test_gaps_in_runs():
    """Each run comes back sorted; empty runs and an empty block stay."""
    import numpy as np

    from tablewise.llm.blocks import gaps_in_runs, runs_of_gaps

    runs = [[5, 1, 5], [], [2**32 - 1, 0], [7], []]
    lengths = np.array([len(r) for r in runs], np.int64)
    values = np.array([x for r in runs for x in r], np.uint32)
    assert runs_of_gaps(gaps_in_runs(values, lengths), lengths).tolist() == [x for r in runs for x in sorted(r)]
    none = np.zeros(0, np.uint32)
    assert runs_of_gaps(gaps_in_runs(none, np.zeros(2, np.int64)), np.zeros(2, np.int64)).tolist() == []


def test_simhash_links_send_no_probes_to_every_executor(spark, tmp_path):
    """A few fingerprints in a file look small to Spark, the probes made of them are not: the join stays a shuffled one."""
    path = str(tmp_path / "classes")
    spark.createDataFrame([(k,) for k in (0, 7, 1 << 40, -1, 15)], "fingerprint long").write.parquet(path)
    found = simhash.links(spark.read.parquet(path))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["a"], r["b"]) for r in found.collect()} == {(0, 7), (0, 1 << 40), (7, 15)}


def test_small_tables_go_to_few_files(spark, monkeypatch):
    """Tables whose rows are counted have a file for some thousand rows, not one for each shuffle partition."""
    made, path_of = [], shared.shared_path
    monkeypatch.setattr(shared, "shared_path", lambda session, name: made.append((name, path_of(session, name))) or made[-1][1])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = spark.range(60).select(F.col("id").alias("node"), F.struct(F.col("id").alias("x")).alias("label"))
        edges = spark.range(59).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r["label"]["x"] for r in simhash.components(nodes, edges).collect()} == {0}
        kept = simhash.one_of_each(_docs(spark, [*_texts(3, 50, 200, 300), None, "", "the sea"])).collect()
        assert len(kept) == 52  # null and empty text are one
        grams = sorted({("\x02" + w)[max(0, i - 2) : i + 1] for w in WORDS for i in range(1, len(w) + 1)})
        counts = spark.createDataFrame([("x", g, 1) for g in grams], "class string, gram string, n long")
        assert charlm.log_probabilities(counts.select("gram"), counts, ["x"], 3, False).count() == len(grams)
        files = {}
        for name, path in made:
            files.setdefault(name, []).append(len(spark.read.parquet(path).inputFiles()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {name: max(n) for name, n in files.items() if name in ("links", "labels", "rows", "classes", "own", "rest", "level")} == dict.fromkeys(("links", "labels", "rows", "classes", "own", "rest", "level"), 1)
    assert shared.written(spark.range(0, 10, 1, 5), "many", 10 * shared.FILE_ROWS).count() == 10 and len(spark.read.parquet(made[-1][1]).inputFiles()) == 5


def test_blocks_are_freed_before_memory_is_given_back(monkeypatch):
    """A worker that has ended its task holds no block, the last one neither."""
    held, freed = [], []
    monkeypatch.setattr(blocks, "give_back", lambda: freed.append([r() is None for r in held]))

    def work(table):
        held.append(weakref.ref(table))
        yield table.num_rows

    batches = [pa.record_batch({"text": ["a" * 10] * 4})] * 2
    assert list(blocks.each_block(iter(batches), work, 40)) == [4, 4]
    assert freed[0] == [True] and freed[-1] == [True, True]


def test_decontamination_codes_words_of_a_block():
    """Words coded by piece: white space of any kind, signs in and around words, nulls, several chunks."""
    texts = ["One two,\tTHREE\n\n--  four_five", None, "", "  six\x1cseven 'eight' ", "__ İx Σ", "two, one"]
    words, at, sizes = decontam._words_coded(pa.chunked_array([pa.array(texts[:3], pa.string()), pa.array(texts[3:], pa.string())]))
    ends = sizes.cumsum().tolist()
    assert [[words[c] for c in at[e - n : e].tolist()] for e, n in zip(ends, sizes.tolist())] == [decontam.words_of(t) for t in texts]


def test_decontamination_looks_first_words_up_once(monkeypatch):
    """The first place of a walk is looked up by word: a word that fills a block is no more work there than another."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    block = decontam.tables_of([(1, item)])
    asked, look = [], decontam._filter
    monkeypatch.setattr(decontam, "_filter", lambda keys, allowed: asked.append((len(keys), len(allowed))) or look(keys, allowed))
    text = "alpha " * 5_000 + item
    hits = decontam._hits(pa.table({"text": pa.array([text], pa.string())}), block)
    assert hits == [(0, 0, 0, 5_000, 5_010)]
    assert sum(n for n, _ in asked) < 5_000 * sum(len(t.prefixes) for t in block.tables)
