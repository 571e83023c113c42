"""The registered queries: their SQL where they have it, else their contracts in plain Python."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
import test_text_operators as plain

from fieldloom.llm import ngram_lm, packing, registry, toxicity
from fieldloom.llm import textkit as tk

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def table(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    cur = con.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == sorted(df.columns)
    want = sorted(tuple(r[at[c]] for c in df.columns) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want


def test_language_model_query(spark):
    """Folds, counts, base scores and scores of all documents, by a plain model of the training texts."""
    docs = table(spark, SMALL, "documents", "doc_id", "text")
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs}
    want, _, _ = plain.kneser_ney([t for k, t in docs if not held[k]], ngram_lm.ORDER)
    got = {r.doc_id: r for r in registry.op3_kneser_ney(spark, SMALL).collect()}
    assert set(got) == set(held)
    for k, t in docs:
        n, known, total, base, score = want(t)
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_url_query(spark):
    """Hosts, paths and rules of all pages; without links between hosts the rest is allowed or blocked by its host's own share."""
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = table(spark, MIDDLE, "pages", "page_id", "url")
    judged = {}
    for k, url in pages:
        rest = (url or "").partition("://")[2]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged[k] = (host, path, *(max(fit)[1:] if fit else (None, None)))
    share = collections.defaultdict(lambda: [0, 0, 0])
    for host, _, _, action in judged.values():
        share[host][0] += 1
        share[host][1] += action == "allow"
        share[host][2] += action == "block"
    got = {r.page_id: r for r in registry.op4_url_filter(spark, MIDDLE).collect()}
    assert set(got) == set(judged)
    for k, (host, path, rule, action) in judged.items():
        n, good, bad = share[host]
        verdict = action or ("block" if bad / n >= 0.25 and bad > good else "allow")
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule, verdict)


def test_toxicity_query(spark):
    docs = dict(table(spark, MIDDLE, "documents", "doc_id", "text"))
    got = {r.doc_id: r for r in registry.op5_toxicity(spark, MIDDLE).collect()}
    assert set(got) == set(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    marks = [(got[k], toxic) for k, toxic in table(spark, MIDDLE, "labels", "doc_id", "toxic") if toxic is not None and got[k].held_out]
    assert sum(r.predicted == t for r, t in marks) >= 0.95 * len(marks)


def plain_features(text, weight):
    """The dense features of one text, a byte at a time; ``weight`` maps (0, word) and (n, beginning) to (place, weight)."""
    raw, fold = text.encode(), lambda w: bytes(ord(toxicity.SUBSTITUTES.get(chr(x), chr(x))) if x < 128 else x for x in w.lower())
    letter, upper = lambda x: x >= 128 or chr(x).isalpha(), lambda x: 65 <= x <= 90
    words = []
    for w in raw.split():
        core = [i for i, x in enumerate(w) if letter(x) or 48 <= x <= 57]
        words.append(w[core[0] : core[-1] + 1] if core else w)
    found = []
    for w in words:
        keys = [(0, fold(w))] + [(n, fold(w[:n])) for n in (4, 5, 6) if len(w) > n]
        found.append([weight[k] for k in keys if k in weight])
    best = [max((v for _, v in f), default=0.0) for f in found]
    hit = [b > 0 for b in best]
    you = [w.decode(errors="replace").translate({c: c + 32 for c in range(65, 91)}) in toxicity.SECOND_PERSON for w in words]
    near = [any(you[max(0, i - 3) : i] + you[i + 1 : i + 4]) for i in range(len(words))]
    n, chars, hits = max(len(words), 1), max(len(raw), 1), sum(hit)
    signs = b"0134579@$!*"
    mixed = [len(w) > 2 and any(x in signs for x in w) for w in words]
    return [
        hits, hits / n, np.log1p(hits), len({max(p for p, _ in f) for f in found if f}), sum(best) / n, max(best, default=0.0),
        sum(h and q for h, q in zip(hit, near, strict=True)) / max(hits, 1), sum(you) / n, sum(map(upper, raw)) / chars,
        sum(len(w) > 2 and all(map(upper, w)) for w in words) / n, sum(x in b"!?" for x in raw) / chars,
        sum(not letter(x) and x > 32 for x in raw) / chars, sum(mixed) / n, sum(m and h for m, h in zip(mixed, hit, strict=True)),
        sum(letter(raw[i]) and raw[i] == raw[i - 1] == raw[i - 2] for i in range(2, len(raw))) / chars, np.log1p(len(words)),
    ]


def test_dense_features_by_brute_force():
    import pyarrow as pa

    def key(n, w):
        c = tk.Chunk(np.frombuffer(w, np.uint8), np.array([0, len(w)]), 0).words()
        return int(c.word_hashes(True)[0] + tk.U64(n))

    entries = {(0, b"idiot"): 3.0, (0, b"scum"): 2.5, (4, b"moro"): 4.0, (5, b"idiot"): 2.75}
    keys = sorted((key(n, w), n, w) for n, w in entries)
    lexicon = np.array([k for k, _, _ in keys], np.uint64), np.array([entries[n, w] for _, n, w in keys])
    weight = {(n, w): (i, entries[n, w]) for i, (_, n, w) in enumerate(keys)}
    texts = ["", "You IDIOT!!! you m0r0n", "aaa", "a plain text, of nothing: 12.", "id1ot idiots scum, SCUM é漢 tú", " \n !!! ... ", "aa", "abbb ccc $cum (moronic) your   words", "x" * 50 + " yourself far far far far scum"]
    (c,) = tk.column_chunks(pa.array(texts))
    got = toxicity.features(c, lexicon)
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == pytest.approx(plain_features(t, weight)), t


def test_packing_query(spark):
    """Pieces, checksums and places of all documents, most of them placed by the linear program."""
    docs = table(spark, MIDDLE, "documents", "doc_id", "text")
    tok = packing.CachedTokenizer(registry.tokenizer_path()).inner
    pieces, sequences = collections.defaultdict(dict), collections.defaultdict(list)
    for r in registry.op7_bestfit_packing(spark, MIDDLE).collect():
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    histogram = np.zeros(2049, np.int64)
    for (k, _), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        many = -(-len(ids) // 2048)
        cuts = [0, *range(len(ids) - 2048 * (many - 1), len(ids) + 1, 2048)]
        assert sorted(pieces[k]) == list(range(many))
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            r = pieces[k][i]
            assert (r.start, r.length, r.ids_crc32) == (lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))
            histogram[hi - lo] += 1
    for own in sequences.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    figures = packing.figures(histogram, *packing.solve_parts(histogram))
    assert len(sequences) == figures["sequences"] <= 1.005 * figures["lower_bound"] and figures["lp_share"] >= 0.9
