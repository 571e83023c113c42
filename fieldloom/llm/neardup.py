"""MinHash near-duplicate detection by a signature-coordinate inverted join.

A document is the set of its distinct n-word shingles.  Its signature has ``COORDINATES``
coordinates, each made of ``ROWS`` minhashes, so two documents of Jaccard similarity J agree
on a coordinate with probability J**ROWS.  Documents are posted under (coordinate, value), and
a pair is a candidate when at least ``matches`` coordinates agree.

* Prefix: such a pair agrees on one of the first COORDINATES - matches + 1 coordinates, so
  only these are posted.
* Skip: a pair is counted only under the first coordinate on which it agrees.

For the default 32 coordinates of 3 and a threshold of 7 matches a pair at J = 0.85 is missed
with probability 1e-6 (at J = 0.80, with the 4 matches ``matches_for`` gives, 2e-6).

Candidates are never handed on as pairs.  Documents with equal sets - of one size and two equal
64-bit sums over all shingles - are one representative, with a number of its own;
a list of agreeing documents gives its components as stars; the connected components of all
stars are clusters, each a superset of the true groups in it.  Within a cluster the full
shingle sets are compared exactly, and again only stars of the confirmed links leave the task.  Long lists and large clusters are cut into blocks and every pair of
blocks is a task of its own, so no task holds more than two blocks.

Edge cases: null, empty and blank texts have an empty set and link with nothing; texts with
fewer words than a shingle are one shingle of all their words; texts of any length are taken
whole; repeated rows form one group with the smallest doc_id, and their text is compared once; rows
without a doc_id link like others but are kept only where their whole group has none; other columns,
whatever their names, are not read by ``near_duplicates`` and not changed by ``dedup_near``; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.components import connected_components
from fieldloom.llm.shared import Scratch, shuffle_partitions

COORDINATES, ROWS = 32, 3
LIST_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 256, 192, 1 << 20
MATRIX_COLUMNS = 4096
#: Equal of equal sets alone, but for a chance of 2**-128 a pair.
_KEY = ("n_shingles", "f1", "f2")
_MULTIPLIERS = tk.mix(np.arange(1, COORDINATES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def matches_for(similarity: float, miss: float = 2e-6) -> int:
    """Largest threshold at which a pair of just this similarity is missed with probability < miss."""
    p, tail = similarity**ROWS, 0.0
    for k in range(COORDINATES):
        tail += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if tail >= miss:
            return max(1, k)
    return COORDINATES


def _shingles(c: tk.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with repeats, by document, and the documents' offsets into them."""
    h = c.words().word_hashes(True)
    count = np.diff(c.word_off)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    off = np.r_[0, np.cumsum(own)]
    out = np.empty(off[-1], tk.U64)
    w = tk.window_hashes(h, n)
    full = np.where(count >= n, own, 0)
    out[tk.ragged(off[:-1], full)] = w[tk.ragged(c.word_off[:-1], full)]
    for d in np.flatnonzero((count > 0) & (count < n)):
        out[off[d]] = tk.window_hashes(h[c.word_off[d] : c.word_off[d + 1]], int(count[d]))[0]
    return out, off


def _sets(c: tk.Chunk, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    s, off = _shingles(c, n)
    out = []
    for d in range(c.n):
        x = np.sort(s[off[d] : off[d + 1]])
        out.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x)
    return out


def _sketch(n: int):
    """Ids, set size, two fingerprints of the set, signature (packed uint32)."""

    def run(batches):
        for b, c in tk.batch_chunks(batches):
            sets = _sets(c, n)
            size = np.array([len(x) for x in sets], np.int64)
            full = size > 0
            sig = np.zeros((c.n, COORDINATES), np.uint32)
            f1, f2 = np.zeros(c.n, tk.U64), np.zeros(c.n, tk.U64)
            if full.any():
                s = np.concatenate([x for x in sets if len(x)])
                at = np.r_[0, np.cumsum(size[full])[:-1]]
                f1[full], f2[full] = np.add.reduceat(s, at), np.add.reduceat(tk.mix(s), at)
                for k in range(COORDINATES):
                    v = np.full(len(at), k, tk.U64)
                    for m in _MULTIPLIERS[k * ROWS : (k + 1) * ROWS]:
                        v = tk.mix(v ^ np.minimum.reduceat(s * m, at))
                    sig[full, k] = v >> tk.U64(32)
            cells = [b.column("doc_id"), b.column("tid"), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "tid", "n_shingles", "f1", "f2", "sig"])

    return run


def _postings(prefix: int):
    """(coordinate, value) of the prefix coordinates as one key, packed in one row per document."""

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)[:, :prefix]
            key = (np.arange(prefix, dtype=np.int64) << 32) + sig
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(b.column("rep").to_numpy(), prefix))], ["key", "rep"])

    return run


class _Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _stars(rep: list[int], links: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member) of every component of the links: equal stars of other tasks fall together."""
    f = _Forest(len(rep))
    for i, j in links.tolist():
        f.join(i, j)
    low: dict[int, int] = {}
    roots = [f.find(i) for i in range(len(rep))]
    for i, r in enumerate(roots):
        low[r] = min(low.get(r, rep[i]), rep[i])
    return [(rep[i], low[r]) for i, r in enumerate(roots) if rep[i] != low[r]]


def _runs(batches, names: list[str]) -> Iterator[dict[str, list]]:
    """Groups of rows with equal first columns (block key) of batches sorted by them."""
    held: dict[str, list] = {k: [] for k in names}
    last = None
    for b in batches:
        cols = [b.column(k).to_pylist() for k in names]
        keys = list(zip(*cols[:3], strict=True))
        i = 0
        while i < len(keys):
            j = i
            while j < len(keys) and keys[j] == keys[i]:
                j += 1
            if keys[i] != last and held[names[0]]:
                yield held
                held = {k: [] for k in names}
            last = keys[i]
            for k, v in zip(names, cols, strict=True):
                held[k] += v[i:j]
            i = j
    if held[names[0]]:
        yield held


def _forest_rows(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _candidates(matches: int):
    """Components of the pairs of a list (or of two blocks of one) that agree often enough, as stars."""

    def run(batches):
        out: list[tuple[int, int]] = []
        for g in _runs(batches, ["key", "b1", "b2", "side", "rep", "sig"]):
            rep = np.array(g["rep"])
            if len(rep) < 2:  # sorted by side, then rep
                continue
            sig = np.frombuffer(b"".join(g["sig"]), np.uint32).reshape(-1, COORDINATES)
            side, coordinate = np.array(g["side"]), g["key"][0] >> 32
            two = g["b1"][0] != g["b2"][0]
            links = []
            for i in range(len(rep)):
                to = np.flatnonzero(side > side[i]) if two else np.arange(i + 1, len(rep))
                if two and side[i]:
                    continue
                agree = sig[to] == sig[i]
                new = ~agree[:, :coordinate].any(1)  # skip: counted under an earlier coordinate
                hit = to[new & (agree.sum(1) >= matches)]
                links.append(np.stack([np.full(len(hit), i), hit], 1))
            if links:
                out += _stars(g["rep"], np.concatenate(links))
            if len(out) > 50_000:
                yield _forest_rows(out)
                out = []
        yield _forest_rows(out)
        tk.release()

    return run


def _links(sets: list[np.ndarray], side: np.ndarray, two: bool, percent: int) -> np.ndarray:
    """Index pairs with 100 * intersection >= percent * union."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), MATRIX_COLUMNS):
        a, z = np.searchsorted(column, (lo, lo + MATRIX_COLUMNS))
        m = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
        m[owner[a:z], column[a:z] - lo] = 1
        both += m @ m.T
    inter = both.astype(np.int64)
    ok = np.triu(100 * inter >= percent * (size[:, None] + size[None, :] - inter), 1)
    if two:
        ok &= side[:, None] != side[None, :]
    return np.argwhere(ok)


def _confirm(percent: int):
    def run(batches):
        out: list[tuple[int, int]] = []
        for g in _runs(batches, ["cluster", "b1", "b2", "side", "rep", "shingles"]):
            if len(g["rep"]) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
                out += _stars(g["rep"], _links(sets, np.array(g["side"]), g["b1"][0] != g["b2"][0], percent))
            if len(out) > 50_000:
                yield _forest_rows(out)
                out = []
        yield _forest_rows(out)
        tk.release()

    return run


def _shingle_rows(n: int):
    def run(batches):
        for b, c in tk.batch_chunks(batches):
            rest = [x for x in b.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in rest), pa.array([x.tobytes() for x in _sets(c, n)], pa.binary())], [*rest, "shingles"])

    return run


def _in_blocks(rows: DataFrame, group: str, blocks: DataFrame) -> DataFrame:
    """Rows of the groups in ``blocks``, once for every pair of blocks that they are in.

    A group of one block stays whole; those of more are dealt by a hash of rep.
    """
    n = F.col("blocks")
    x = rows.join(blocks, group).withColumn("_b", F.when(n > 1, F.pmod(F.xxhash64("rep"), n).cast("int")).otherwise(0))
    x = x.withColumn("_c", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")
    return x.withColumns({"b1": F.least("_b", "_c"), "b2": F.greatest("_b", "_c"), "side": (F.col("_b") > F.col("_c")).cast("int")}).drop("_b", "_c")


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    spark = rows.sparkSession
    return rows.repartition(4 * shuffle_partitions(spark), group, "b1", "b2").sortWithinPartitions(group, "b1", "b2", "side", "rep")


def _representatives(sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a set: its key, ``rep`` (any number of its own), its first row that has a doc_id, signature."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_no"), "doc_id", "tid")).alias("first")
    reps = sketch.where("n_shingles > 0").groupBy(*_KEY).agg(first, F.first("sig").alias("sig"))
    return scratch.table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # written, so a number stays


def _judged(docs: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, tid, n_shingles, component_id, kept): as ``near_duplicates``, with a hash of the text."""
    matches = matches_for(percent / 100)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    sketch = texts.mapInArrow(_sketch(shingle), "doc_id long, tid long, n_shingles long, f1 long, f2 long, sig binary")
    sketch = scratch.table(sketch, "sketch")
    reps = _representatives(sketch, scratch)

    posted = reps.select("rep", "sig").mapInArrow(_postings(COORDINATES - matches + 1), "key long, rep long")
    posted = scratch.table(posted, "postings")
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / LIST_BLOCK).cast("int")).drop("n")
    lists = _in_blocks(posted, "key", scratch.table(sizes, "lists")).join(reps.select("rep", "sig"), "rep")
    clusters = connected_components(_dealt(lists, "key").mapInArrow(_candidates(matches), "u long, v long"), scratch, "clusters")
    scratch.drop("postings", "lists")

    heads = clusters.select(F.col("component").alias("rep"), F.col("component").alias("cluster")).distinct()
    member = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).union(heads)
    member = scratch.table(member.join(reps.drop("sig"), "rep").select("rep", "cluster", "n_shingles", F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.tid").alias("tid")).alias("row")), "members")
    sizes = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))
    own = texts.select(F.struct("doc_id", "tid").alias("row"), "text")  # a struct may hold a null
    full = own.join(member.drop("n_shingles").hint("merge"), "row")
    full = full.groupBy("rep", "cluster").agg(F.first("text").alias("text"))  # of repeated rows one
    full = full.mapInArrow(_shingle_rows(shingle), "rep long, cluster long, shingles binary")
    links = _dealt(_in_blocks(full, "cluster", scratch.table(sizes, "sizes")), "cluster").mapInArrow(_confirm(percent), "u long, v long")
    groups = connected_components(links, scratch, "groups")
    scratch.drop("sizes", "members")

    named = reps.select("rep", *_KEY, F.col("first.doc_id").alias("low")).join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(*_KEY, "low", F.coalesce("component", "rep").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = scratch.table(named.join(lowest, "component").select(*_KEY, "component_id"), "named")
    out = sketch.select("doc_id", "tid", *_KEY).join(named, list(_KEY), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "tid", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over links of similarity percent / 100 or more.
    """
    return _judged(docs, shingle, percent, scratch or Scratch(docs.sparkSession, "neardup")).drop("tid")


def dedup_near(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` whose document is the one its group keeps, all columns unchanged.

    Repeated rows of the kept doc_id stay together.
    """
    kept = _judged(docs, shingle, percent, Scratch(docs.sparkSession, "neardup")).where("kept")
    kept = kept.select(F.col("doc_id").alias("_kept"), F.col("tid").alias("_tid")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]) & F.xxhash64(docs["text"]).eqNullSafe(kept["_tid"]), "left_semi")
