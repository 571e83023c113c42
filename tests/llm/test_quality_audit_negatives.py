"""Quality rules, the filter audit and hard negatives against plain Python on small tables."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import filter_audit, hard_negatives, quality, registry

DOCS = "doc_id long, text string, lang string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 260))) for _ in range(n)]
    out += [" ".join(w.upper() + "!!" for w in rng.choices(words, k=90)) for _ in range(n // 3)]
    return out + [" | ".join(rng.choices(words, k=40)) for _ in range(n // 4)]


@pytest.fixture(scope="module")
def rows():
    own = [(i, t, random.Random(i).choice(["en", "fr", None, ""])) for i, t in enumerate(texts(1, 60))]
    odd = [None, "", " \n\t ", "one", "And " * 30, "a b c d e " * 12, "É ü 漢字\x0b ü\r\n\n x\n x\nx", "line one\nline one\n \n \nline one ", "x" * 40_000, "wort " * 9_000]
    own += [(1000 + i, t, "en") for i, t in enumerate(odd)]
    own += [(2000 + i, own[5][1], "de") for i in range(40)]  # a hot text
    return [*own, own[3], (None, own[4][1], "en"), (None, None, None), (-7, own[9][1], "xx"), (3000, own[9][1], "xx")]


@pytest.fixture(scope="module")
def marks(rows):
    ids = [k for k, _, _ in rows if k is not None]
    return [(k, int(k % 3 > 0), int(k % 5 == 0)) for k in ids[::2]] + [(ids[0], None, None), (ids[0], 1, 1), (None, 1, 1), (77_777, 1, 1)]


def base_counts(text):
    text = text or ""
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x, n in __import__("collections").Counter(windows).items() if n > 1}
    covered = {i + j for i, x in enumerate(windows) if x in twice for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def features(text, buckets):
    w = SPACED.findall(text or "")
    cell = lambda x: zlib.crc32(x.encode()) % buckets
    ends = [cell(x[-1]) % 128 for x in w]
    return [cell(x) for x in w] + [a * 128 + b for a, b in itertools.pairwise(ends)]


def test_quality_by_brute_force(spark, rows, marks):
    b = quality.BUCKETS
    trusted = {k for k, q, _ in marks if q == 1 and k is not None}
    raw, own = np.zeros(b, int), np.zeros(b, int)
    for k, t, _ in rows:
        np.add.at(raw, features(t, b), 1)
        if k in trusted:
            np.add.at(own, features(t, b), 1)
    ratio = [round(1e6 * math.log((own[c] + 1) * (raw.sum() + b) / ((raw[c] + 1) * (own.sum() + b)))) for c in range(b)]
    want = []
    for k, t, _ in rows:
        counts, f = base_counts(t), features(t, b)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        total = sum(ratio[c] for c in f)
        want.append((k, *counts, failed, len(f), total / len(f) / 1e6 if f else 0.0, not failed and total >= -500_000 * len(f)))
    docs = spark.createDataFrame(rows, DOCS).withColumns({"own": F.lit("x"), "cells": F.lit(1), "total": F.lit(2)})
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in quality.judge(docs, labels.where("quality = 1").select("doc_id")).collect()]
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:8] == w[:8] and g[9] == w[9] and g[8] == pytest.approx(w[8], abs=1e-9)
    assert {w[6] for w in want} == {True, False} == {w[9] for w in want if not w[6]}


def test_quality_by_pairs_of_whole_words(spark, rows, marks):
    """with whole pairs, words that only share their endings are different features; all by brute force."""
    b = quality.BUCKETS

    def whole(text):
        cells = [zlib.crc32(x.encode()) % b for x in SPACED.findall(text or "")]
        return cells + [((x * b + y) * 2654435761 % 2**32) >> 18 for x, y in itertools.pairwise(cells)]

    same = "in tan fan man", "in man tan fan"  # the same words and endings in another order
    own = [*rows, (8000, f"{same[0]} " * 3, "en"), (8001, f"{same[1]} " * 3, "en")]
    trusted = {k for k, q, _ in marks if q == 1 and k is not None} | {8000}
    raw, good = np.zeros(b, int), np.zeros(b, int)
    for k, t, _ in own:
        np.add.at(raw, whole(t), 1)
        if k in trusted:
            np.add.at(good, whole(t), 1)
    ratio = [round(1e6 * math.log((good[c] + 1) * (raw.sum() + b) / ((raw[c] + 1) * (good.sum() + b)))) for c in range(b)]
    want = sorted((str(k), len(f), sum(ratio[c] for c in f) / max(len(f), 1) / 1e6) for k, f in ((k, whole(t)) for k, t, _ in own))
    docs, ids = spark.createDataFrame(own, DOCS), spark.createDataFrame([(k,) for k in trusted], "doc_id long")
    got = sorted((str(r.doc_id), r.n_features, r.score) for r in quality.judge(docs, ids, whole_pairs=True).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9)
    score = {k: s for k, _, s in got}
    assert score["8000"] > score["8001"]


def test_quality_without_trusted_texts(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    nothing = spark.createDataFrame([], "doc_id long")
    got = quality.judge(docs, nothing).collect()
    assert len(got) == len(rows) and all(r.score == 0 and r.kept != r.base_failed for r in got)
    assert quality.judge(docs.limit(0), nothing).count() == 0


def test_quality_keeps_the_good(spark):
    """On the given tables texts labelled good stay but for the base rules, and those labelled bad go."""
    sf = "/root/testdata/sf0.01"
    got = registry.op11_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.kept or r.base_failed for r in got if r.quality == 1) == sum(r.quality == 1 for r in got)
    assert sum(not r.kept for r in got if r.quality == 0) >= 0.98 * sum(r.quality == 0 for r in got)


def test_equal_hashes_of_windows_are_compared(spark, monkeypatch):
    """Where windows only share a hash, no word counts as repeated."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f a b c d e")], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measure(docs).collect()}
    assert got == {1: 0, 2: 10}


def plain_audit(rows, marks):
    good, toxic = ({k for k, *m in marks if k is not None and m[i] == 1} for i in (0, 1))
    smallest = {}
    for k, t, _ in rows:
        if k is not None:
            smallest[t or ""] = min(k, smallest.get(t or "", k))
    fails = []
    for k, t, part in rows:
        t = t or ""
        w = SPACED.findall(t)
        own = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), k is not None and k > smallest[t])
        fails.append((part or "", {f for f, bad in zip("ABCDE", own, strict=True) if bad}, k in good, k in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                before = [x for x in fails if x[0] == part and f in x[1] and x[1] & set(order[:i])]
                left = [x for x in left if f not in x[1]]
                only = sum(x[0] == part and x[1] == {f} for x in fails)
                out[part, "".join(order), i + 1] = [len(left), len(gone), len(before), only, sum(x[2] for x in gone), sum(x[3] for x in gone)]
    for (part, order, step), v in out.items():
        f = order[step - 1]
        v.append(sum(x[1] for (p, o, s), x in out.items() if p == part and o[s - 1] == f))
    return {(*k, *v) for k, v in out.items()}


def test_audit_by_brute_force(spark, rows, marks):
    some = [*rows[:30], *rows[60:]]
    docs = spark.createDataFrame(some, DOCS).withColumn("part", F.col("lang")).withColumns({"first": F.lit(1), "mask": F.lit("x"), "digest": F.lit(2)})
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("n", F.lit(5))
    got = filter_audit.audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    parts = {p or "" for _, _, p in some}
    assert len(got) == 600 * len(parts) and {tuple(r) for r in got} == plain_audit(some, marks)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    out = []
    for i in range(n):
        v = centre[i % 4] + 0.7 * rng.normal(size=dims)
        out.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))))
    return out


def plain_negatives(given):
    own = {}
    for k, v, label in given:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own[k] = min(own.get(k, (label, v)), (label, v))
    q = {k: [math.floor(256 * x) for x in v] for k, (_, v) in own.items()}
    out = []
    for a in own:
        if a % 100:
            continue
        s = {b: sum(x * y for x, y in zip(q[a], q[b], strict=False)) for b in own if b != a}
        positives = sorted((b for b in s if own[b][0] == own[a][0]), key=lambda b: (-s[b], b))[:5]
        for p in positives:
            fine = [b for b in s if own[b][0] != own[a][0] and 80 * s[p] <= 100 * s[b] <= 100 * s[p]]
            for rank, b in enumerate(sorted(fine, key=lambda b: (-s[b], b))[:5], 1):
                out.append((a, p, rank, b, s[p], s[b]))
    return sorted(out)


@pytest.mark.parametrize(("dims", "panel_bytes"), [(7, 1 << 34), (70, 1 << 34), (33, 1)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, dims, panel_bytes):
    """Several blocks, chunks and panels; ties, copies, odd rows, clashing names."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 2)
    given = vectors(dims, 700, dims)
    hot = given[150][1]
    given += [(1000 + i, hot, i % 3) for i in range(300)]
    given += [(5000, None, 1), (5100, [float("nan")] * dims, 1), (5200, [None] + [0.5] * (dims - 1), 1), (5300, [0.5] * dims, None), (None, hot, 1), (5400, [0.25] * (dims - 3), 2), (5500, [], 0), (5600, [1e6] * dims, 1), (200, hot, 3), (700, hot, 9)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "block": F.lit(2)})
    got = hard_negatives.mine(hard_negatives.clean_rows(df, "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0, panel_bytes=panel_bytes)
    got = got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = plain_negatives(given)
    assert want and sorted(map(tuple, got)) == want


def test_hard_negatives_of_small_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    run = lambda rows: hard_negatives.mine(hard_negatives.clean_rows(spark.createDataFrame(rows, schema), "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0)
    assert run([]).count() == 0 and run([(100, [1.0], 1)]).count() == 0 and run([(101, [1.0], 1), (102, [1.0], 2)]).count() == 0
    assert [tuple(r) for r in run([(100, [1.0], 1), (101, [0.5], 1), (102, [0.5], 2)]).collect()] == [(100, 101, 1, 102, 32768, 32768)]


def test_products_beyond_doubles_are_whole():
    a = np.full((1, hard_negatives.CHUNK), (1 << 29) + 1)
    b = np.full((1, hard_negatives.CHUNK), (1 << 27) + 3)
    assert hard_negatives._product(a, b)[0, 0] == hard_negatives.CHUNK * ((1 << 29) + 1) * ((1 << 27) + 3)
