"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon, nearness of its words to second-person
words, capitals, punctuation and obfuscation.  The lexicon is learned from the labels: words
and word beginnings that occur in clearly more toxic than other documents, after undoing the
usual letter substitutions; it holds at most ``LEXICON_LIMIT`` entries.

The trees, the lexicon and the calibration are fitted on at most ``max_rows`` labelled rows,
those of the smallest hash of doc_id (the documented bound of the sample); a fifth of them, by
another hash, is kept from the lexicon and the trees and used for the calibration.  Scoring reads
every document, whole texts of any length, and nothing but its text.

Edge cases: null and empty texts have all features zero and get the score of such a text;
with no labels every score is 0, with labels of one kind it is that kind; several labels of
one document count as their majority (toxic on a tie); null labels are ignored; of several
texts of one labelled doc_id the first in their order is learned from; a null doc_id has no label and is
in no fold (null), its text is scored; repeated rows are scored each; columns named score and predicted are replaced, all others stay; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.shared import Scratch

LEXICON_LIMIT = 4096
#: Second-person words, and letters that digits and signs stand for.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tú", "usted", "ustedes", "ti", "su")
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ("hits", "hit_density", "log_hits", "distinct_hits", "weight_density", "max_weight", "near_you", "you_density", "capitals", "shouted", "exclaims", "punctuation", "obfuscated", "obfuscated_hits", "repeats", "log_words")
_PREFIXES = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b"0134579@$!*"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
for _a, _b in SUBSTITUTES.items():
    _FOLD[ord(_a)] = ord(_b)


def _trimmed(c: tk.Chunk) -> None:
    """Words without the punctuation around them (``!`` and ``$`` inside stay)."""
    c.words()
    core = _LETTER[c.data] | ((c.data >= 0x30) & (c.data <= 0x39))
    at = np.flatnonzero(core)
    i, j = np.searchsorted(at, c.starts), np.searchsorted(at, c.ends) - 1
    full = i <= j
    c.starts = np.where(full, at[np.minimum(i, len(at) - 1)] if len(at) else c.starts, c.starts)
    c.ends = np.where(full, at[np.maximum(j, 0)] + 1 if len(at) else c.ends, c.ends)


def _keys(c: tk.Chunk) -> list[np.ndarray]:
    """Hashes of the folded words and of their beginnings; beginnings of shorter words are 0."""
    folded = tk.Chunk(_FOLD[c.data], c.offsets, 0)
    folded.starts, folded.ends = c.starts, c.ends
    out = [folded.word_hashes(True)]
    for n in _PREFIXES:
        folded.ends = np.minimum(c.starts + n, c.ends)
        h = folded.word_hashes(True) + tk.U64(n)
        out.append(np.where(c.ends - c.starts > n, h, tk.U64(0)))
    return out


_YOU: np.ndarray | None = None


def _second_person() -> np.ndarray:
    global _YOU
    if _YOU is None:
        raw = " ".join(SECOND_PERSON).encode()
        c = tk.Chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0).words()
        _YOU = np.sort(c.word_hashes(True))
    return _YOU


def _in(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index in the sorted keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == h, i, -1)


def _sum(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    s = np.concatenate(([0], np.cumsum(x, dtype=float)))
    return s[off[1:]] - s[off[:-1]]


def features(c: tk.Chunk, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of ``FEATURES`` for each document of a chunk."""
    _trimmed(c)
    keys, weights = lexicon
    off, n = c.word_off, np.maximum(np.diff(c.word_off), 1).astype(float)
    chars = np.maximum(np.diff(c.offsets), 1).astype(float)
    found = np.stack([_in(keys, h) for h in _keys(c)]) if len(c.starts) else np.empty((1, 0), np.int64)
    best = np.where(found >= 0, weights[found] if len(weights) else 0.0, 0.0).max(0)
    hit = best > 0
    plain = c.word_hashes(True)
    you = _in(_second_person(), plain) >= 0
    near, of = np.zeros(len(hit), bool), tk.doc_of_words(c)
    for k in (1, 2, 3):  # a few words to either side, in the same document
        same_doc = of[k:] == of[:-k]
        near[k:] |= you[:-k] & same_doc
        near[:-k] |= you[k:] & same_doc
    letters, signs = _LETTER[c.data], _SIGN[c.data]
    by_word = np.concatenate(([0], np.cumsum(signs)))
    mixed = (by_word[c.ends] - by_word[c.starts] > 0) & (c.ends - c.starts > 2)
    up = np.concatenate(([0], np.cumsum(_UPPER[c.data])))
    shouted = (up[c.ends] - up[c.starts] == c.ends - c.starts) & (c.ends - c.starts > 2)
    same = np.zeros(len(c.data), bool)
    same[2:] = (c.data[2:] == c.data[1:-1]) & (c.data[2:] == c.data[:-2]) & letters[2:]
    edge = (c.offsets[:-1, None] + [0, 1]).ravel()  # two letters of the document before do not count
    same[edge[edge < len(same)]] = False
    distinct = np.zeros(c.n)
    where = np.flatnonzero(hit)
    if len(where):
        doc = of[where]
        pair = np.unique(np.stack([doc, found[:, where].max(0)]), axis=1)
        distinct = np.bincount(pair[0], minlength=c.n).astype(float)
    hits, byte = _sum(hit, off), c.offsets
    rep = np.zeros(c.n)
    if len(where):
        np.maximum.at(rep, of[where], best[where])
    cols = (hits, hits / n, np.log1p(hits), distinct, _sum(best, off) / n, rep, _sum(hit & near, off) / np.maximum(hits, 1), _sum(you, off) / n, _sum(_UPPER[c.data], byte) / chars, _sum(shouted, off) / n, _sum((c.data == 33) | (c.data == 63), byte) / chars, _sum(~letters & (c.data > 32), byte) / chars, _sum(mixed, off) / n, _sum(mixed & hit, off), _sum(same, byte) / chars, np.log1p(np.diff(off)))
    return np.stack(cols, 1)


def _document_keys(batches):
    """Per run of documents and key: documents that hold it, and toxic ones among them."""
    for b, c in tk.batch_chunks(batches, size=2 * tk.CHUNK_BYTES):
        _trimmed(c)
        toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        doc = tk.doc_of_words(c)
        seen = []
        for h in _keys(c):
            k, d = h[h != 0], doc[h != 0]
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            first = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.empty(0, bool)
            seen.append((k[first], d[first]))
        k, d = (np.concatenate(x) for x in zip(*seen, strict=True))
        u, inv = np.unique(k, return_inverse=True)
        cells = (u.view(np.int64), np.bincount(inv, minlength=len(u)), np.bincount(inv, toxic[d], len(u)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["key", "n", "bad"])


def _learn_lexicon(rows: DataFrame, n_bad: int, n_all: int, min_documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and weights (log odds ratio) of the words that mark toxic documents."""
    counted = rows.mapInArrow(_document_keys, "key long, n long, bad long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n_all - n_bad - F.col("n") + F.col("bad") + 0.5))
    top = counted.where(F.col("bad") >= min_documents).withColumn("weight", odds).where("weight >= 2.5").orderBy(F.desc("weight"), "key").limit(LEXICON_LIMIT).collect()
    keys = np.array([r.key for r in top], np.int64).view(tk.U64)
    order = np.argsort(keys)
    return keys[order], np.array([r.weight for r in top])[order]


class Trees:
    """Gradient boosting of the logistic loss over binned features."""

    def __init__(self, n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, min_leaf: int = 10, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.min_leaf, self.ridge = n_trees, depth, rate, bins, min_leaf, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(np.unique(col), q)) for col in x.T]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        score = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(b, y - prob, np.maximum(prob * (1 - prob), 1e-6))
            self.trees.append(tree)
            score += self._apply(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, col, "left") for e, col in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.empty((0, len(self.edges)), np.int64)

    def _grow(self, b, grad, hess):
        """Nodes in heap order: (feature, bin) of splits, values of leaves."""
        size = 2 ** (self.depth + 1)
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.ones(len(b), np.int64)
        for at in range(1, size):
            own = node == at
            if not own.any():
                continue
            g, h = grad[own], hess[own]
            total_g, total_h = g.sum(), h.sum()
            value[at] = self.rate * total_g / (total_h + self.ridge)
            if at >= size // 2 or own.sum() < 2 * self.min_leaf:
                continue
            best, base = 1e-6, total_g**2 / (total_h + self.ridge)
            for f in range(b.shape[1]):
                col = b[own, f]
                lg, lh, ln = (np.cumsum(np.bincount(col, w, self.bins + 1)) for w in (g, h, None))
                gain = lg**2 / (lh + self.ridge) + (total_g - lg) ** 2 / (total_h - lh + self.ridge) - base
                gain[(ln < self.min_leaf) | (len(g) - ln < self.min_leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], f, k
            if feature[at] >= 0:
                node[own] = 2 * at + (b[own, feature[at]] > cut[at])
        return feature, cut, value

    def _apply(self, tree, b):
        feature, cut, value = tree
        node = np.ones(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            split = f >= 0
            node = np.where(split, 2 * node + (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]), node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum((self._apply(t, b) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool-adjacent-violators fit of labels on margins; linear between the pools' centres."""

    def fit(self, margin: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []
        for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
            pools.append([v, 1.0, m])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                v2, n2, m2 = pools.pop()
                v1, n1, m1 = pools.pop()
                n = n1 + n2
                pools.append([(v1 * n1 + v2 * n2) / n, n, (m1 * n1 + m2 * n2) / n])
        self.x, self.p = np.array([p[2] for p in pools]), np.array([p[0] for p in pools])
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        """Mostly the calibrated value; a little of the margin keeps the order within pools."""
        own = 1 / (1 + np.exp(-margin))
        return np.clip(0.999 * np.interp(margin, self.x, self.p) + 0.001 * own, 0, 1)


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, c: tk.Chunk) -> np.ndarray:
        return np.full(c.n, self.value)


class Model:
    def __init__(self, lexicon, trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, c: tk.Chunk) -> np.ndarray:
        return self.calibration(self.trees.margin(features(c, self.lexicon)))


def _feature_rows(lexicon):
    def run(batches):
        for b, c in tk.batch_chunks(batches):
            x = features(c, lexicon)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("part"), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "part", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_documents: int = 5) -> Model | Constant:
    """A model of ``labels`` (doc_id, toxic 0/1) on texts of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # at most max_rows
    rows = scratch.table(rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).cast("int").alias("part")), "sample")
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if bad in (0, n):
        scratch.drop("sample")
        return Constant(bad / n if n else 0.0)
    counts = {r.part: (r.n, r.bad) for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).collect()}
    whole = len(counts) < 2 or any(b in (0, k) for k, b in counts.values())  # too few labels to part them
    own, (n_own, bad_own) = (rows, (n, bad)) if whole else (rows.where("part = 0"), counts[0])
    lexicon = _learn_lexicon(own, bad_own, n_own, min(min_documents, max(1, bad_own // 4)))
    got = rows.mapInArrow(_feature_rows(lexicon), "toxic int, part int, x binary").collect()  # at most max_rows
    x = np.frombuffer(b"".join(bytes(r.x) for r in got)).reshape(-1, len(FEATURES))
    y, part = np.array([r.toxic for r in got], float), np.array([r.part for r in got], bool)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    x, y, part = x[order], y[order], part[order]
    if whole:
        part = np.zeros(len(y), bool)
    trees = Trees(min_leaf=max(1, min(10, n // 20))).fit(x[~part], y[~part])
    held = part if part.any() else ~part
    scratch.drop("sample")
    return Model(lexicon, trees, Isotonic().fit(trees.margin(x[held]), y[held]))


def _scores(model, text: str):
    def run(batches):
        own = model.value
        for b, c in tk.batch_chunks(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(c))], [*b.schema.names, "score"])

    return run


def score(docs: DataFrame, model: Model | Constant, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus score and predicted (1 where score >= 0.5)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))  # the text goes once
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", score double"
    out = plain.mapInArrow(_scores(spark.sparkContext.broadcast(model), f"c{keep.index(text)}"), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
