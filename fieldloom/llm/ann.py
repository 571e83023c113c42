"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Learning: on a bounded sample vectors are centred, projected on their principal axes and
rotated so that signs lose as little as they can (iterative quantisation); a code is the signs
of ``bits // 64`` such rotations, each from a start of its own.  Every query has a Hamming radius:
the smallest that holds a learned share of the sample's codes, so outlying queries reach as far as
they must.  The share is learned too: the smallest at which the sample's own queries find the
wanted part of their true neighbours.

Index: the table is dealt into blocks, and a block keeps, for each substring of ``PART`` bits, its
rows by value.  By the pigeonhole principle a code within radius r = m * a + b of a query, with m
substrings, is within a on one of the first b + 1 or within a - 1 on one of the others, so probing
the values in these balls finds every code in the radius (a ball with more values than the block
has is met by testing those there are).  What is found is kept if the whole code is in the radius
and ranked by inner product of the original vectors in double precision; each block answers with
its best ``k``, and the best of all blocks are the result.

A query with fewer than k codes within its radius in all blocks is searched again with the
full radius, so it gets its k neighbours wherever there are that many candidates.

Queries stay a DataFrame: they are dealt into blocks too, and every pair of a block of queries and
a block of vectors is a task, which holds no more than the two.

Edge cases: vectors that are null, zero, of other length than most, or hold null or
non-finite components take no part; ties go to the smaller id; of rows of one id that with the
smallest vector, component by component, stands for it; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Scratch

SAMPLE_ROWS = 10_000
#: Rows of a block of vectors or queries at most, and bytes of their vectors.
BLOCK_ROWS, BLOCK_BYTES = 1 << 16, 64 << 20
BITS, PART = 256, 16
SHARES = (0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.11, 0.125, 0.15, 0.2, 0.3, 0.5, 1.0)


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


class Codes:
    """Rotations to binary codes, learned from a sample; codes are rows of 64-bit words."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7):
        self.mean = sample.mean(0)
        x = sample - self.mean
        axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :64]
        own = axes.shape[1]  # narrow vectors have fewer axes, so more rotations
        self.turn = np.concatenate([self._rotation(x @ axes, rounds, seed + k) for k in range(-(-bits // own))], 1)[:, :bits]
        self.turn = axes @ self.turn
        self.bits, self.radii = bits, None

    @staticmethod
    def _rotation(v: np.ndarray, rounds: int, seed: int) -> np.ndarray:
        n = v.shape[1]
        r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        return r

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = (x - self.mean) @ self.turn >= 0
        return np.packbits(b, axis=1, bitorder="little").view(np.uint64)

    def set_radii(self, sample: np.ndarray, share: float) -> None:
        """From now on a query's radius holds ``share`` of the sample's codes."""
        self.sample, self.share = self(sample), share

    def radius(self, code: np.ndarray) -> int:
        at = min(len(self.sample) - 1, int(np.ceil(self.share * len(self.sample))))
        return int(np.partition(hamming(self.sample, code), at)[at])


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def _ball(radius: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006  kept for the next call
    """Masks of ``PART`` bits with at most ``radius`` ones."""
    if radius not in _kept:
        _kept[radius] = np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(PART), r)], np.int64)
    return _kept[radius]


class MultiIndex:
    """Codes of one block by substring: rows sorted by value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, []
        for value in self._values(codes).T:
            count = np.bincount(value, minlength=1 << PART)
            self.parts.append((np.argsort(value, kind="stable"), np.r_[0, np.cumsum(count)], np.flatnonzero(count)))
        self.probes = self.scans = self.touched = 0

    @staticmethod
    def _values(codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint16).reshape(len(codes), -1).astype(np.int64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` bits from ``code``."""
        a, b = divmod(radius, len(self.parts))
        hit = np.zeros(len(self.codes), bool)
        for k, (own, (order, begin, keys)) in enumerate(zip(self._values(code[None])[0].tolist(), self.parts, strict=True)):
            near = min(a if k <= b else a - 1, PART)
            if near < 0:
                continue
            if len(_ball(near)) < len(keys):
                at = _ball(near) ^ own
                self.probes += 1
            else:
                at = keys[np.bitwise_count(keys ^ own) <= near]
                self.scans += 1
            lo, n = begin[at], begin[at + 1] - begin[at]
            full = n > 0
            lo, n = lo[full], n[full]
            if len(n):
                ends = np.cumsum(n)
                hit[order[np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)]] = True
        rows = np.flatnonzero(hit)
        self.touched += len(rows)
        return rows[hamming(self.codes[rows], code) <= radius]


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return table.column("id").to_numpy(), v.flatten().to_numpy().reshape(table.num_rows, -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(score) > 4 * k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= edge)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", x, q)


def _search(codes, k: int, whole: bool):
    """Best k of a block of vectors for each query of a block; ``near`` counts codes in the radius."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out_q, out_n, out_c, out_i, out_s = [], [], [], [], []
        if queries.num_rows and vectors.num_rows:
            coder, (ids, x), (q_ids, q_vecs) = codes.value, _rows(vectors), _rows(queries)
            index = MultiIndex(coder(x))
            for q, v, c in zip(q_ids.tolist(), q_vecs, coder(q_vecs), strict=True):
                rows = index.within(c, coder.bits if whole else coder.radius(c))
                rows = rows[ids[rows] != q]
                score = inner_products(x[rows], v)
                top = _best(score, ids[rows], k)
                out_q.append(q)
                out_n.append(min(len(rows), k))
                out_c.append(len(rows))
                out_i.append(ids[rows][top].tolist())
                out_s.append(score[top].tolist())
        cells = (pa.array(out_q, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_i, pa.list_(pa.int64())), pa.array(out_s, pa.list_(pa.float64())))
        return pa.table(list(cells), names=["query_id", "near", "candidates", "ids", "scores"])

    return run


def _merge(k: int):
    """Best k of all blocks' answers to a query."""

    def run(batches):
        for b in batches:
            q, rank, ids, scores, near = [], [], [], [], []
            for r in b.to_pylist():
                i = np.array([y for x in r["ids"] for y in x], np.int64)
                s = np.array([y for x in r["scores"] for y in x], float)
                top = np.lexsort((i, -s))[:k]
                q += [r["query_id"]] * len(top)
                rank += range(1, len(top) + 1)
                ids += i[top].tolist()
                scores += s[top].tolist()
                near += [r["candidates"]] * len(top)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(near, pa.int64())], ["query_id", "rank", "vec_id", "score", "candidates"])

    return run


def learn(vectors: DataFrame, k: int, recall: float, bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> Codes:
    """Codes and radii from the ``sample_rows`` vectors of the smallest hash of id."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    x = np.array([r.v for r in rows], float)
    codes = Codes(x, bits)
    own, far, all_far = codes(x), [], []
    queries = np.arange(min(200, len(x)))
    for q in queries:
        s = inner_products(x, x[q])
        s[q] = -np.inf
        top = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        d = hamming(own, own[q])
        far.append(d[top])
        all_far.append(np.sort(d))
    for share in SHARES:
        at = min(len(x) - 1, int(np.ceil(share * len(x))))
        found = sum(int((f <= d[at]).sum()) for f, d in zip(far, all_far, strict=True))
        if found >= recall * sum(map(len, far)):
            break
    codes.set_radii(x, share)
    return codes


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.92, bits: int = BITS, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, candidates): the k best of ``vectors`` (id, v) for each of
    ``queries`` (id, v), without the query's own id.  ``recall`` is the share of true neighbours that
    the radius is to keep on the sample; ``candidates`` counts the vectors ranked for the query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    vectors = scratch.table(vectors, "vectors")
    queries = scratch.table(queries, "queries")
    if vectors.isEmpty() or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, candidates long")
    width = vectors.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first().width
    vectors, queries = vectors.where(F.size("v") == width), queries.where(F.size("v") == width)
    codes = spark.sparkContext.broadcast(learn(vectors, k, recall, bits))  # the sample's codes and a matrix
    n, n_queries = vectors.count(), queries.count()
    rows = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    blocks = -(-n // rows)

    def answers(some: DataFrame, count: int, whole: bool, what: str) -> DataFrame:
        # few blocks of vectors have their queries parted further, so that all cores have tasks
        parts = max(-(-count // rows), min(count, -(-2 * spark.sparkContext.defaultParallelism // blocks)))
        deal = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        to_each = lambda df, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = some.select("id", "v", deal(some, parts).alias("part"), to_each(some, blocks).alias("block"))
        right = vectors.select("id", "v", deal(vectors, blocks).alias("block"), to_each(vectors, parts).alias("part"))
        hits = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_search(codes, k, whole), "query_id long, near long, candidates long, ids array<long>, scores array<double>")
        return scratch.table(hits.groupBy("query_id").agg(F.sum("near").alias("near"), F.sum("candidates").alias("candidates"), F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores")), what)

    first = answers(queries, n_queries, False, "near")
    few = first.where(F.col("near") < min(k, n - 1)).select("query_id")
    again = scratch.table(queries.join(few, queries["id"] == few["query_id"], "left_semi"), "few")
    if n_again := again.count():
        first = first.where(F.col("near") >= min(k, n - 1)).unionByName(answers(again, n_again, True, "far"))
    return first.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double, candidates long")
