"""The text operators against plain Python on small tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, neardup, ngram_lm, packing, registry, substring_dedup, textkit, toxicity

SCHEMA = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(400)]


def words(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empties, short, repeated, near and long texts; two rows of one doc_id."""
    rng = np.random.default_rng(11)
    passage, base = words(rng, 60), words(rng, 150)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "one two"), (6, "one two"), (7, "x" * 5000)]
    rows += [(10 + i, words(rng, 80)) for i in range(20)]
    rows += [(40 + i, f"{words(rng, 30)}\n{passage}  {words(rng, 25)}") for i in range(6)]
    for i in range(25):
        w = base.split()
        for k in rng.integers(0, len(w), i % 4):
            w[k] = f"edit{i}"
        rows.append((60 + i, " ".join(w)))
    rows += [(100, words(rng, 3000)), (101, "É ü 漢字 " * 40), (60, rows[-25][1])]
    half = words(rng, 45)
    return [*rows, (102, f"{half} middle {half}")]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_groups(rows, n, percent):
    sets = [(k, shingles(t, n)) for k, t in rows]
    up = {k: k for k, _ in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                up[hi] = lo
    return {k: (len(s), find(k)) for k, s in sets}


def test_near_duplicates_without_ids(spark):
    """Rows without a doc_id carry links between others, and are kept where their group has no id at all."""
    rng = np.random.default_rng(3)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(None, a), (5, a), (9, a + " more"), (None, b), (None, b + " end"), (7, c), (7, a), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit("x")).withColumn("rep", F.lit("y"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()), key=str)
    size = {t: len(shingles(t, 3)) for _, t in rows}
    want = [(None, size[a], 5, False), (5, size[a], 5, True), (9, size[a + " more"], 5, False), (None, size[b], None, True), (None, size[b + " end"], None, True), (7, size[c], 7, True), (7, size[a], 5, False), (None, 0, None, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)
    left = sorted(((r.doc_id, r.text) for r in neardup.dedup_near(docs, 3, 85).collect()), key=str)
    assert left == sorted([(5, a), (None, b), (None, b + " end"), (7, c), (None, None), (8, "")], key=str)
    assert neardup.near_duplicates(docs.limit(0), 3, 85).count() == 0 and neardup.dedup_near(docs.limit(0)).count() == 0


def test_sets_are_told_apart_by_size_and_both_sums(spark):
    """Sets that clash in all but one part of their key get numbers of their own, in one round."""
    keys = [(3, 7, 9), (3, 7, 8), (3, 6, 9), (4, 7, 9)]
    rows = [(i, 100 + i, *keys[i % 4], b"x") for i in range(40)] + [(None, 1, 3, 7, 9, b"x"), (99, 2, 0, 0, 0, b"")]
    sketch = spark.createDataFrame(rows, "doc_id long, tid long, n_shingles long, f1 long, f2 long, sig binary")
    got = neardup._representatives(sketch, neardup.Scratch(spark, "test")).collect()
    assert sorted((r.n_shingles, r.f1, r.f2, r.first.doc_id) for r in got) == sorted((*k, i) for i, k in enumerate(keys))
    assert len({r.rep for r in got}) == 4


def twins(n=1024):
    """Two words of two letters that collide under every sum of powers modulo 2**64."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("length", [64, 255, 256, 257, 1024, 2048])
def test_words_of_few_letters_have_their_own_hashes(length):
    import pyarrow as pa

    a, b = twins(length)
    (c,) = textkit.column_chunks(pa.array([f"{a} {b} {a.upper()} ab{a} {a}"]))
    h, low = c.words().word_hashes(False).tolist(), c.word_hashes(True).tolist()
    assert h[0] == h[4] and len(set(h)) == 4 and low[0] == low[2] == low[4] and len(set(low)) == 3
    x = np.array([1, 2], textkit.U64)[[i.bit_count() % 2 for i in range(4096)]]
    w = textkit.window_hashes(textkit.mix(np.r_[x, x[::-1], 3 - x, x]), 1024)
    assert w[0] == w[3 * 4096] and w[0] != w[2 * 4096]


def test_hashes_of_words_by_place_and_length():
    """A word's hash does not depend on what stands around it; all words of a page have their own."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    own = sorted({"".join(rng.choice(list("abé漢"), rng.integers(1, 40))) for _ in range(3000)})
    (a,) = textkit.column_chunks(pa.array([" ".join(own)]))
    (b,) = textkit.column_chunks(pa.array(["\t\n" + "  ".join(own[::-1])]))
    ha, hb = a.words().word_hashes(False), b.words().word_hashes(False)
    assert len(set(ha.tolist())) == len(own) and ha.tolist() == hb.tolist()[::-1]


def test_words_of_few_letters_in_every_operator(spark):
    """Documents that differ in one such word are different for all operators."""
    a, b = twins()
    frame = [f"w{i}" for i in range(34)]
    texts = [" ".join([*frame[:17], w, *frame[17:]]) for w in (a, b)]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], SCHEMA)
    assert [r.n_removed for r in substring_dedup.dedup_substrings(docs, window=35, digest=True).collect()] == [0, 0]
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()} == {(1, 1), (2, 2)}
    item = spark.createDataFrame([("x", " ".join([*frame[15:17], a, *frame[17:20]]))], "item string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, item, n=6).collect()} == {1: 6, 2: 0}
    inner = packing.CachedTokenizer(registry.tokenizer_path()).inner
    got = {r.doc_id: r for r in packing.pack(docs, registry.tokenizer_path(), with_ids=True).collect()}
    for k, t in zip((1, 2), texts, strict=True):
        want = np.array([*inner.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[k].length == len(want) and zlib.crc32(want.tobytes()) == got[k].ids_crc32
    model = ngram_lm.train(docs.where("doc_id = 1"))
    want, _, _ = kneser_ney([texts[0]], ngram_lm.ORDER)
    for r in ngram_lm.score(docs, model).collect():
        n, known, total, base, score = want(texts[r.doc_id - 1])
        assert (r.n_tokens, r.n_known) == (n, known) and r.score == pytest.approx(score, rel=1e-9)


def test_pieces_that_share_a_hash(monkeypatch):
    """The memo of pieces compares their bytes, so a shared hash changes no ids."""
    import pyarrow as pa

    monkeypatch.setattr(packing.CachedTokenizer, "_hashes", lambda self, c, begin, end: (end - begin).astype(textkit.U64))
    tok = packing.CachedTokenizer(registry.tokenizer_path())
    texts = ["one two six", "ten two one", "", "a longer text of words", " one  one"]
    for _ in range(2):
        (c,) = textkit.column_chunks(pa.array(texts))
        ids, off = tok.chunk(c)
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == tok.inner.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, n, percent):
    got = neardup.near_duplicates(spark.createDataFrame(corpus, SCHEMA), n, percent).collect()
    want = near_groups(corpus, n, percent)
    assert len(got) == len(corpus)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    """Large groups cut into blocks lose no link."""
    rng = np.random.default_rng(4)
    rows, base = [], words(rng, 120).split()
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, len(w), rng.integers(0, 5)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "LIST_BLOCK", 8)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 8)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert got == {k: v[1] for k, v in near_groups(rows, 3, 85).items()}


def test_a_chain_and_two_templates_in_small_blocks_lose_no_link(spark, monkeypatch):
    """A chain of small steps and two templates, in blocks smaller than any of them."""
    rng = np.random.default_rng(5)
    rows, w = [], words(rng, 120).split()
    for i in range(50):  # each is alike to its neighbours in the chain only
        w = list(w)
        w[(7 * i) % len(w)] = f"step{i}"
        rows.append((i, " ".join(w)))
    for t in range(2):
        base = words(rng, 100).split()
        for i in range(30):
            x = list(base)
            for k in rng.integers(0, len(x), rng.integers(0, 4)):
                x[k] = f"e{t}_{i}_{k}"
            rows.append((100 * (t + 1) + i, " ".join(x)))
    for name, value in (("LIST_BLOCK", 4), ("CLUSTER_BLOCK", 4)):
        monkeypatch.setattr(neardup, name, value)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert got == {k: v[1] for k, v in near_groups(rows, 3, 85).items()}


def test_dedup_keeps_one_of_each_group_and_all_columns(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA).withColumn("component_id", F.lit("mine")).withColumn("kept", F.lit(7))
    out = neardup.dedup_near(docs, 3, 85)
    assert out.columns == docs.columns
    want = near_groups(corpus, 3, 85)
    assert {r.doc_id for r in out.collect()} == {k for k, v in want.items() if v[1] == k}


def covered(rows, window):
    lists = [(k, (t or "").encode().split()) for k, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for _, w in lists for i in range(len(w) - window + 1))
    out = []
    for k, w in lists:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((k, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window", [3, 10, 35, 50])
def test_substring_dedup(spark, corpus, window):
    docs = spark.createDataFrame(corpus, SCHEMA)
    got = sorted(tuple(r) for r in substring_dedup.dedup_substrings(docs, window, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted((k, n, m, hashlib.sha256(b).hexdigest()) for k, n, m, b in covered(corpus, window))


def test_substring_dedup_keeps_columns_and_white_space(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA).withColumn("n_words", F.lit("old")).withColumn("kid", F.lit(1)).withColumn("starts", F.lit(2))
    out = substring_dedup.dedup_substrings(docs, 35).collect()
    want = sorted((k, b) for k, _, _, b in covered(corpus, 35))
    assert sorted((r.doc_id, b" ".join((r.text or "").encode().split())) for r in out) == want
    texts = dict(corpus)
    assert all(r.text == texts[r.doc_id] for r in out if r.n_removed == 0) and {r.kid for r in out} == {1}


def test_covers_reach_every_alignment():
    for v, cover in substring_dedup.COVERS.items():
        assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_decontaminate(spark):
    rng = np.random.default_rng(9)
    items = [(1, words(rng, 30)), (2, "Tiny item here"), (3, None), (4, "..."), (10, words(rng, 10)), (1, "tiny ITEM here!")]
    rows = [(0, None), (1, ""), (2, words(rng, 50) + " " + items[0][1][:60] + " tail"), (3, "A tiny-item, HERE. and more"), (4, items[4][1] + "\n" + items[0][1]), (4, "another text of one id"), (5, words(rng, 4000))]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_hit", F.lit("x")).withColumn("row", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").select(F.col("item_id").cast("string").alias("item"), "text")
    got = decontaminate.decontaminate(docs, bench, 10)
    want = []
    for k, t in rows:
        w = tokens(t)
        hit, found = np.zeros(len(w), bool), set()
        for i, text in items:
            b = tokens(text)
            n = min(10, len(b))
            for s in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit[p : p + n] = True
                        found.add(str(i))
        want.append((k, len(w), int(hit.sum()), sorted(found)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.hit_items)) for r in got.collect()) == sorted(want)
    none = decontaminate.decontaminate(docs, bench.limit(0), 10)
    assert none.where("n_hit <> 0").count() == 0 and none.count() == len(rows)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta uh gamma delta"), (3, "delta far away alpha one two three beta gamma")], SCHEMA)
    bench = spark.createDataFrame([("i", "alpha beta gamma delta")], "item string, text string")
    near = {r.doc_id: r.n_hit > 0 for r in decontaminate.decontaminate(docs, bench, 4, slop=1).collect()}
    exact = {r.doc_id: r.n_hit > 0 for r in decontaminate.decontaminate(docs, bench, 4).collect()}
    assert near == {1: True, 2: True, 3: False} and exact == {1: True, 2: False, 3: False}


def kneser_ney(train, order):
    """(words known, log10 p(text), base score) of a plain model: dictionaries, one token at a time."""
    split = lambda t: [w.lower() for w in (t or "").encode().split()] + [b"</s>"]
    raw = collections.Counter(w for t in train for w in split(t))
    level = {order: collections.Counter()}
    for t in train:
        row = [b"<s>"] * (order - 1) + split(t)
        for i in range(order - 1, len(row)):
            level[order][tuple(row[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        level[n] = collections.Counter(g[1:] for g in level[n + 1])
    discount, after = {}, {}
    for n, grams in level.items():
        c = collections.Counter(grams.values())
        discount[n] = ngram_lm._discounts(c[1], c[2], c[3], c[4])
        for g, k in grams.items():
            after.setdefault((n, g[:-1]), []).append(k)
    total, v = sum(raw.values()), len(raw)

    def p(n, context, w):
        if n == 0:
            return 1 / (v + 1)
        own, below = after.get((n, context)), p(n - 1, context[1:], w)
        if not own:
            return below
        less = [discount[n][min(k, 3) - 1] for k in own]
        k = level[n].get((*context, w), 0)
        return (max(k - discount[n][min(k, 3) - 1], 0) if k else 0) / sum(own) + sum(less) / sum(own) * below

    def score(t):
        row = [b"<s>"] * (order - 1) + split(t)
        logs = [np.log10(p(order, tuple(row[i - order + 1 : i]), row[i])) for i in range(order - 1, len(row))]
        base = sum(np.log10((raw[w] + 0.5) / (total + 0.5 * (v + 1))) for w in split(t))
        return len(row) - order + 1, sum(raw[w] > 0 for w in split(t)), total, base, sum(logs)

    return score, p, raw


@pytest.mark.parametrize(("order", "hot"), [(2, 256), (3, 256), (3, 64), (4, 64)])
def test_model_against_plain_kneser_ney(spark, corpus, monkeypatch, order, hot):
    """Every score of every text, with several runs and ranges; ``hot`` 64 deals some contexts over the ranges."""
    monkeypatch.setattr(ngram_lm, "RUN_TOKENS", 500)
    monkeypatch.setattr(ngram_lm, "RANGE_BYTES", 10_000)
    monkeypatch.setattr(ngram_lm, "HOT_SHARE", hot)
    rows = corpus + [(200 + i, "the very same two words the very same two words " * 30) for i in range(20)] + [(300, "x y " * 400)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).repartition(3)
    model = ngram_lm.train(docs.where("doc_id % 3 <> 0"), order)
    if hot == 64:
        assert all(len(h) for h in model.hot.values())
    want, p, raw = kneser_ney([t for k, t in rows if k % 3], order)
    texts = dict(rows)
    got = ngram_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    context = (b"very", b"same", b"two")[-(order - 1) :]
    assert sum(p(order, context, w) for w in raw) + p(order, context, b"neverseen") == pytest.approx(1)


def test_model_of_nothing(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    model = ngram_lm.train(docs.limit(0))
    assert {(r.train_tokens, r.n_known) for r in ngram_lm.score(docs, model).collect()} == {(0, 0)}


def test_packing(spark, corpus):
    docs = spark.createDataFrame(corpus, SCHEMA)
    tok = packing.CachedTokenizer(registry.tokenizer_path()).inner
    got = packing.pack(docs, registry.tokenizer_path(), capacity=256, with_ids=True).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for k, t in dict(corpus).items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for d, _ in corpus if d == k)
        pieces = sorted(by[k], key=lambda r: (r.piece, r.sequence_id))[::copies]
        assert [i for r in pieces for i in r.ids] == ids and all(r.length == 256 for r in pieces[1:])
        total += copies * len(ids)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.1 * -(-total // 256) + 1
    assert packing.pack(docs.limit(0), registry.tokenizer_path()).count() == 0


def test_cached_tokenizer_is_exact():
    import pyarrow as pa

    texts = ["", None, "a  b \n\n c  d", " <|endoftext|> x\n", "\n\n", "tab\t\tx ", "it's  we'll　  é́ 12abc", "x" * 3000, "a \n\nb", "end   \n x", "12 345,678!! ?? ..."]
    tok = packing.CachedTokenizer(registry.tokenizer_path())
    for c in textkit.column_chunks(pa.array(texts)):
        ids, off = tok.chunk(c)
        for i in range(c.n):
            assert ids[off[i] : off[i + 1]].tolist() == tok.inner.encode(texts[i] or "", add_special_tokens=False).ids


def test_configurations_cover_the_histogram():
    h = np.bincount(np.random.default_rng(1).integers(1, 513, 3000), minlength=513)
    plan = packing.solve_configurations(h, rounds=100)
    assert (sum(n * p for p, n in plan) == h).all() and all((p * np.arange(513)).sum() <= 512 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.03 * -(-(h * np.arange(513)).sum() // 512)


def test_configurations_of_all_lengths_at_full_capacity():
    rng = np.random.default_rng(0)
    h = np.bincount(np.clip(rng.lognormal(np.log(665), 0.3, 300_000).astype(int), 1, 2047), minlength=2049)
    plan = packing.solve_configurations(h)
    placed, rest = packing.solve_parts(h)
    assert (sum(n * p for p, n in plan) == h).all() and all((p * np.arange(2049)).sum() <= 2048 for p, _ in plan)
    figures = packing.figures(h, placed, rest)
    assert sum(n for _, n in plan) == figures["sequences"] <= 1.005 * figures["lower_bound"]
    assert figures["lp_share"] > 0.95 and ((h < 20) | (sum(n * p for p, n in placed) > 0)).all()


def test_lower_bound_of_packing():
    h = np.zeros(11, np.int64)
    h[[4, 6, 10]] = 3, 2, 1  # 6 + 4, 6 + 4, 4, 10
    assert packing.lower_bound(h) == 4 == sum(n for _, n in packing.solve_configurations(h))
    h[:] = 0
    assert packing.lower_bound(h) == 0
    h[6] = 5
    assert packing.lower_bound(h) == 5


def test_toxicity_on_held_out_labels(spark):
    rng = np.random.default_rng(6)
    bad = ["idiot", "m0ron", "scum"]
    rows, labels = [(0, None), (1, "")], []
    for i in range(2, 602):
        w = words(rng, 40).split()
        toxic = i % 5 == 0
        if toxic:
            w[rng.integers(0, 40)] = bad[rng.integers(0, 3)] + "!"
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("_lang", F.lit("en"))
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.where("doc_id % 7 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[k].predicted, t) for k, t in labels if k % 7 == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].score == got[1].score
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, marks.limit(0))).collect()} == {0.0}


def test_isotonic_calibration_is_monotone():
    rng = np.random.default_rng(3)
    m = rng.normal(size=500)
    p = toxicity.Isotonic().fit(m, (rng.random(500) < 1 / (1 + np.exp(-2 * m))).astype(float))(np.linspace(-3, 3, 50))
    assert (np.diff(p) >= 0).all()
