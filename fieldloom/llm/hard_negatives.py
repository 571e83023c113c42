"""Hard-negative mining: integer scores by a two-dimensional block matrix product, then windows.

Vectors are dealt into blocks of rows (by a hash of their id) and of dimensions, and the anchors
among them into blocks of their own.  A block of anchors meets a block of rows in each chunk of
dimensions; the product is a partial tile of 64-bit integers, and the partial tiles of a place
are added up after a shuffle.  Summed tiles are a written table.  They are read twice: once for the
best rows of each anchor's own label (its positives), once for the best rows of other labels in
the window that each positive's score opens.  Both are cut to the wanted number within each tile
before they move, and then among all tiles.

A panel of anchors is worked off at a time, such that its partial tiles take ``panel_bytes`` at
most (and its anchors are ``PANEL_ANCHORS`` at most, which bounds the positives that tasks get): the
work is anchors times rows times dimensions, and the disk it takes is bounded.  A task holds one
tile and its partial tiles.

Edge cases: rows whose label, vector or id is null, or whose vector has a null or non-finite
component, take no part; of rows of one id that of the smallest label and vector stands for it; a
shorter vector is filled up with zeros; ties go to the smaller id; anchors without another row of
their label, and positives with an empty window, give no rows, nor does an empty table; sums beyond
63 bits wrap around; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import Scratch
from fieldloom.llm.textkit import release

ANCHOR_BLOCK, ROW_BLOCK, CHUNK = 128, 2048, 32
PANEL_ANCHORS, PANEL_BYTES = 1 << 14, 16 << 30
SCALE = 256

_BLOCK = "block int, chunk int, ids binary, labels binary, part binary"
_TILE = "i int, j int, a_ids binary, a_labels binary, b_ids binary, b_labels binary, tile binary"


def clean_rows(df: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, v) of the vectors that take part, one of each id."""
    v = F.col(vec_col).cast("array<double>")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & label.isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of rows in one chunk of dimensions: sorted ids, labels and a matrix."""
    t = pa.Table.from_batches(list(batches))
    order = np.argsort(ids := t["id"].to_numpy())
    lists = t["v"].combine_chunks()
    off, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    width = np.diff(off)
    m = np.zeros((len(ids), CHUNK))
    m[np.repeat(np.arange(len(ids)), width), np.arange(off[0], off[-1]) - np.repeat(off[:-1], width)] = flat[off[0] : off[-1]]
    m = np.clip(np.floor(SCALE * m[order]), -(2.0**62), 2.0**62).astype(np.int64)
    yield pa.RecordBatch.from_pydict({
        "block": pa.array([t["block"][0].as_py()], pa.int32()), "chunk": pa.array([t["chunk"][0].as_py()], pa.int32()),
        "ids": pa.array([ids[order].tobytes()]), "labels": pa.array([t["label"].to_numpy()[order].tobytes()]), "part": pa.array([m.tobytes()]),
    })


def blocks(rows: DataFrame, size: int, chunks: int, n: int) -> DataFrame:
    """``rows`` (id, label, v) in blocks of some ``size`` rows, each in ``chunks`` pieces of their dimensions."""
    block = F.pmod(F.xxhash64("id"), F.lit(-(-n // size))).cast("int")
    piece = lambda k: F.struct(k.alias("chunk"), F.slice("v", k * CHUNK + 1, CHUNK).alias("v"))
    pieces = rows.select("id", "label", block.alias("block"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), piece)).alias("p"))
    return pieces.select("id", "label", "block", "p.chunk", "p.v").groupBy("block", "chunk").applyInArrow(_pack, _BLOCK)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in 64-bit integers; through doubles where all sums are exact in them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * CHUNK
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _partial_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The product of each pair of pieces."""
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            a, b = (np.frombuffer(row[c][0].as_buffer(), np.int64).reshape(-1, CHUNK) for c in ("a_part", "b_part"))
            out = {c: row[c] for c in ("i", "j", "a_ids", "a_labels", "b_ids", "b_labels")}
            yield pa.RecordBatch.from_pydict(out | {"tile": pa.array([_product(a, b).tobytes()])})
    release()


def _add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the partial tiles of one place."""
    total = first = None
    for batch in batches:
        for r in range(batch.num_rows):
            tile = np.frombuffer(batch["tile"][r].as_buffer(), np.int64)
            if first is None:
                first, total = batch.slice(r, 1), tile.copy()
            else:
                total += tile
    out = {c: first[c] for c in ("i", "j", "a_ids", "a_labels", "b_ids", "b_labels")}
    yield pa.RecordBatch.from_pydict(out | {"tile": pa.array([total.tobytes()])})


def tiles(anchors: DataFrame, rows: DataFrame, row_blocks: int) -> DataFrame:
    """Summed score tiles of blocks of anchors and blocks of rows; each piece of anchors goes to every block of rows."""
    a = anchors.select(F.col("block").alias("i"), "chunk", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("part").alias("a_part"))
    a = a.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    b = rows.select(F.col("block").alias("j"), "chunk", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("part").alias("b_part"))
    partial = a.join(b, ["j", "chunk"]).select("i", "j", "a_ids", "a_labels", "b_ids", "b_labels", "a_part", "b_part").mapInArrow(_partial_tiles, _TILE)
    return partial.groupBy("i", "j").applyInArrow(_add_tiles, _TILE)


def _best(scores: np.ndarray, fine: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores among the fine ones, ties by place."""
    at = np.flatnonzero(fine)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def _of(row: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    a_ids, a_labels, b_ids, b_labels = (np.frombuffer(row[c][0].as_buffer(), np.int64) for c in ("a_ids", "a_labels", "b_ids", "b_labels"))
    return a_ids, a_labels, b_ids, b_labels, np.frombuffer(row["tile"][0].as_buffer(), np.int64).reshape(len(a_ids), len(b_ids))


def _positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a_ids, a_labels, b_ids, b_labels, s = _of(batch.slice(r, 1))
                best = [_best(s[x], (b_labels == a_labels[x]) & (b_ids != a_ids[x]), k) for x in range(len(a_ids))]
                at, of = np.concatenate([*best, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(a_ids)), [len(x) for x in best])
                yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(batch["i"][r].as_py(), len(at)), pa.int32()), "anchor_id": a_ids[of], "positive_id": b_ids[at], "positive_score": s[of, at]})
        release()

    return run


def _negatives(k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a_ids, a_labels, b_ids, b_labels, s = _of(batch.slice(r, 1))
                place, out = {int(x): n for n, x in enumerate(a_ids)}, []
                for p in batch["positives"][r].as_py():
                    x = place[p["anchor_id"]]
                    ps = p["positive_score"]
                    least, most = -(-low * ps // 100), high * ps // 100  # whole numbers: least <= score <= most
                    for y in _best(s[x], (b_labels != a_labels[x]) & (s[x] >= least) & (s[x] <= most), k) if least <= most else ():
                        out.append((p["anchor_id"], p["positive_id"], ps, int(b_ids[y]), int(s[x, y])))
                names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
                yield pa.RecordBatch.from_pydict({c: pa.array([o[n] for o in out], pa.int64()) for n, c in enumerate(names)})
        release()

    return run


def _first(df: DataFrame, by: list[str], score: str, then: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(then)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, panel_bytes: int = PANEL_BYTES) -> DataFrame:
    """For each anchor and positive the best rows of other labels whose score is ``low`` to ``high`` percent of the positive's.

    ``rows`` has id, label and v, as of :func:`clean_rows`.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    rows = scratch.table(rows, "rows")
    n, n_anchors, dims = rows.agg(F.count("*"), F.coalesce(F.sum(is_anchor.cast("int")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    chunks, row_blocks = max(1, -(-dims // CHUNK)), max(1, -(-n // ROW_BLOCK))
    packed = scratch.table(blocks(rows, ROW_BLOCK, chunks, max(n, 1)), "row-blocks")
    most = max(ANCHOR_BLOCK, min(PANEL_ANCHORS, panel_bytes // (8 * max(n, 1) * chunks)))
    panels, done = max(1, -(-n_anchors // most)), []
    for panel in range(panels):
        own = rows.where(is_anchor & (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(panels)) == panel))
        own = blocks(own, ANCHOR_BLOCK, chunks, max(1, -(-n_anchors // panels)))
        table = scratch.table(tiles(own, packed, row_blocks), f"tiles-{panel}")
        found = table.mapInArrow(_positives(positives), "i int, anchor_id long, positive_id long, positive_score long")
        found = _first(found, ["i", "anchor_id"], "positive_score", "positive_id", positives)
        found = found.groupBy("i").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("positives"))
        out = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
        found = table.join(F.broadcast(found), "i").mapInArrow(_negatives(negatives, low, high), out)
        found = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
        done.append(scratch.table(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), f"found-{panel}"))
        scratch.drop(f"tiles-{panel}")
    result = done[0]
    for d in done[1:]:
        result = result.union(d)
    return result
