"""Every stage of the pipeline against brute force, on rows with nulls, empty texts, repeats and ties."""

import collections
import hashlib

import numpy as np
import pytest
import test_text_operators as plain

from fieldloom.llm import packing, registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stage_rows(corpus_rows=None):
    rng = np.random.default_rng(21)
    w = lambda n: plain.words(rng, n)
    passage, base, item = w(60), w(120), w(14)
    texts = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "one two"), (5, w(40)), (5, w(40)), (None, w(30)), (6, base), (7, base), (8, base + " end"), (8, base + " end"), (9, f"{w(20)} {passage}\n{w(9)}"), (10, f"{passage} {w(12)}"), (11, passage), (12, f"{w(15)} {item} {w(5)}"), (13, item.upper()), (14, w(4000)), (15, "Ünï  cödé\t漢字 " * 30)]
    return [(k, t, "en", None, None if t is None else len(t)) for k, t in texts], item


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_near_duplicate_stage(spark, stage_rows, tmp_path):
    rows, _ = stage_rows
    got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), str(tmp_path)).collect()), key=str)
    numbered = [(i, r[1]) for i, r in enumerate(rows)]
    groups = plain.near_groups(numbered, 5, 80)
    low = collections.defaultdict(list)
    for i, (_, root) in groups.items():
        if rows[i][0] is not None:
            low[root].append(rows[i][0])
    want = [r for i, r in enumerate(rows) if not groups[i][0] or r[0] == min(low[groups[i][1]], default=None)]
    assert got == sorted(want, key=str)


def test_passage_stage(spark, stage_rows, tmp_path):
    rows, _ = stage_rows
    got = sorted((r.doc_id, " ".join((r.text or "").encode().decode().split(" ")).encode().split()) for r in corpus_pipeline.repeated_passages(spark, docs_of(spark, [r for r in rows if r[0] is not None]), str(tmp_path)).collect())
    want = []
    for k, n, gone, left in plain.covered([(r[0], r[1]) for r in rows if r[0] is not None], 50):
        if not gone or gone < n:
            want.append((k, left.split()))
    assert got == sorted(want)


def test_leak_stage(spark, stage_rows, tmp_path):
    rows, item = stage_rows
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.benchmark_leaks(spark, docs_of(spark, rows), str(tmp_path)).collect())
    b = plain.tokens(item)
    windows = {tuple(b[i : i + 10]) for i in range(len(b) - 9)}
    clean = lambda t: not any(tuple(w[i : i + 10]) in windows for w in [plain.tokens(t)] for i in range(len(w) - 9))
    assert got == sorted((str(r[0]), str(r[1])) for r in rows if clean(r[1]))
    assert len(got) == len(rows) - 2


def test_toxicity_stage(spark, stage_rows, tmp_path):
    """Without labels nothing is rejected; with labels the planted word is, and clean rows stay as they are."""
    rows, _ = stage_rows
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    every = corpus_pipeline.toxic_documents(spark, docs_of(spark, rows), str(tmp_path)).collect()
    assert sorted(map(str, every)) == sorted(str(r) for r in docs_of(spark, rows).collect())
    rng = np.random.default_rng(1)
    more = [(100 + i, plain.words(rng, 40) + (" scum" if i % 4 == 0 else ""), "en", "s", 1) for i in range(200)]
    spark.createDataFrame([(r[0], 0, int(i % 4 == 0)) for i, r in enumerate(more)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    left = corpus_pipeline.toxic_documents(spark, docs_of(spark, rows + more), str(tmp_path))
    assert left.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = collections.Counter(r.doc_id for r in left.collect())
    assert ids == collections.Counter([r[0] for r in rows] + [r[0] for i, r in enumerate(more) if i % 4])


def test_packing_stage(spark, stage_rows, tmp_path):
    rows, _ = stage_rows
    tok = packing.CachedTokenizer(registry.tokenizer_path()).inner
    got = corpus_pipeline.sequences(spark, docs_of(spark, rows), str(tmp_path)).collect()
    ids = lambda t: tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    want = sum((len(ids(r[1])) for r in rows), 0)
    assert sum(r.length for r in got) == want == sum(len(r.ids) for r in got)
    whole = collections.Counter(tuple(r.ids) for r in got if r.length < 2048 and r.piece == 0)
    assert all(whole[ids(r[1])] >= 1 for r in rows if len(ids(r[1])) < 2048)


def test_all_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_whole_run_on_given_tables(spark):
    """Kept documents are whole rows of the input, but for cut passages; tokens are those of what was kept."""
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = packing.CachedTokenizer(registry.tokenizer_path()).inner
    pieces = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r.piece):
        pieces[r.doc_id] += r.ids
    assert set(pieces) <= set(texts)
    back = {k: hashlib.sha256(tok.decode(v[:-1], skip_special_tokens=False).encode()).digest() for k, v in pieces.items()}
    same = sum(back[k] == hashlib.sha256(tok.decode(tok.encode(texts[k] or "", add_special_tokens=False).ids, skip_special_tokens=False).encode()).digest() for k in back)
    assert same > 0.6 * len(back) and all(v[-1] == 0 for v in pieces.values())
