"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: one shard is a run of whole training documents, and holds
for every term of the run the sorted positions at which it stands.  Tasks write shards to files in
the shared folder, named by attempt; the index table, whose committed rows alone are read, names
them by place, and can serve any number of test sets.

A query is a window of consecutive test words.  In each shard the window's terms are taken
from the rarest on: a term without postings ends the window at once, and otherwise the rarest
list, shifted back by the term's offset, gives the possible starts, which are kept only while
each next list holds the position that the offset asks for (exact phrase), or one at most
``slop`` words from it (proximity match).  Positions leave a gap between documents wider than
any window with its slop, so that no match spans two.

The windows go to every shard in blocks of at most ``WINDOW_BLOCK``, one after the other: what
a block finds is written and the block is released before the next is sent, so that what the driver
and the executors hold has a fixed bound however large the benchmark grows.

Edge cases: null and empty texts and texts without words have no hit; texts of any length are
indexed whole, a longer one than a run as a shard of its own; an item without words or id has no
window; repeated items count each by its own id, equal windows of several items count for each;
repeated rows and rows of one doc_id are judged each by its own text; columns named n_words, n_hit,
hit_spans and hit_items are replaced, all others stay; an empty table of either kind gives no hits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.ngram_lm import filesystem
from fieldloom.llm.shared import Scratch, fresh_path

WINDOW_BLOCK = 1 << 18
#: Bytes of shards that a task searches.
TASK_BYTES = 32 << 20
_SHARD = "path string, offset long, length long"


def _shards(gap: int, base: str):
    """Writes one shard for each run of documents: row keys, word counts, terms, list ends, positions."""

    def run(batches):
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        name, offset, out = f"shards-{uuid.uuid4().hex}", 0, None
        for b, c in tk.batch_chunks(batches):
            c.words(tk.ALNUM_WORD)
            h = c.word_hashes(True)
            doc = tk.doc_of_words(c)
            at = np.arange(len(h)) + doc * gap
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order].astype(np.uint32)
            last = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) if len(h) else np.empty(0, np.int64)
            head = np.array([c.n, len(last), len(at)], np.int64)
            cells = (head, b.column("row").to_numpy(), np.diff(c.word_off), h[last], (last + 1).astype(np.uint32), at)
            raw = b"".join(x.tobytes() for x in cells)
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            out.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}"]), pa.array([offset]), pa.array([len(raw)])], ["path", "offset", "length"])
            offset += len(raw)
        if out is not None:
            out.close()

    return run


def _read_shards(b: pa.RecordBatch, whole: bool) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of shards; without ``whole`` those of the documents alone."""
    last, f = None, None
    for path, offset, length in zip(*(b.column(k).to_pylist() for k in ("path", "offset", "length")), strict=True):
        if path != last:
            fs, own = filesystem(path)
            last, f = path, fs.open_input_file(own)
        n, terms, positions = np.frombuffer(f.read_at(24, offset), np.int64).tolist()
        raw = f.read_at(length - 24 if whole else 16 * n, offset + 24)
        shard = {"rows": np.frombuffer(raw, np.int64, n), "n_words": np.frombuffer(raw, np.int64, n, 8 * n)}
        if whole:
            at = 16 * n
            shard["terms"] = np.frombuffer(raw, np.uint64, terms, at)
            shard["ends"] = np.frombuffer(raw, np.uint32, terms, at + 8 * terms)
            shard["positions"] = np.frombuffer(raw, np.uint32, positions, at + 12 * terms)
        yield shard


def build_index(docs: DataFrame, scratch: Scratch, longest: int) -> DataFrame:
    """Written index of all texts (path, offset, length of shards); ``docs`` has row (long key) and text."""
    base = fresh_path(docs.sparkSession, "postings")
    return scratch.table(docs.select("row", "text").mapInArrow(_shards(longest, base), _SHARD), "index")


def _dealt(index: DataFrame) -> DataFrame:
    """Shards dealt by place to as many tasks as their bytes need."""
    spark = index.sparkSession
    parts = int((index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES) + spark.sparkContext.defaultParallelism
    return index.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")


def _windows(n: int):
    """(window key, term hashes) of every distinct-in-item window of the items."""

    def run(batches):
        for b, c in tk.batch_chunks(batches):
            h = c.words(tk.ALNUM_WORD).word_hashes(True)
            items, keys, terms = [], [], []
            ids = b.column("item").to_pylist()
            for d in range(c.n):
                own = h[c.word_off[d] : c.word_off[d + 1]]
                k = min(n, len(own))
                if k:
                    rows = np.unique(np.lib.stride_tricks.sliding_window_view(own, k), axis=0)
                    items += [ids[d]] * len(rows)
                    keys += [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in rows]
                    terms += [x.tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(keys, pa.int64()), pa.array(terms, pa.binary())], ["item", "window", "terms"])

    return run


def _near(keys: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """Whether the sorted keys hold a value within ``slop`` of each wanted one."""
    i = np.searchsorted(keys, want - slop)
    return (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= want + slop)


def _match(shard: dict, windows: list[tuple[np.ndarray, np.ndarray]], gap: int, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first word, end, window key) of the matches; windows by length: (keys, terms)."""
    terms, ends, positions, n_words = shard["terms"], shard["ends"].astype(np.int64), shard["positions"], shard["n_words"]
    if not len(terms):
        return
    begins = np.r_[0, ends[:-1]]
    first = np.r_[0, np.cumsum(n_words + gap)[:-1]]
    # one sorted array for all lists: list number in the high half, position in the low half
    keyed = (np.repeat(np.arange(len(terms), dtype=np.int64), ends - begins) << 33) + positions
    for keys, rows in windows:
        at = np.searchsorted(terms, rows)
        at[at == len(terms)] = 0
        there = (terms[at] == rows).all(1)
        keys, at = keys[there], at[there]
        if not len(keys):
            continue
        length = (ends - begins)[at]
        order = np.argsort(length, axis=1, kind="stable")  # rarest first
        lead = np.take_along_axis(at, order[:, :1], 1)[:, 0]
        count = ends[lead] - begins[lead]
        w = np.repeat(np.arange(len(keys)), count)
        start = positions[tk.ragged(begins[lead], count)].astype(np.int64) - order[w, 0]
        for j in range(1, rows.shape[1]):
            off = order[w, j]
            ok = _near(keyed, (at[w, off].astype(np.int64) << 33) + start + off, slop)
            w, start = w[ok], start[ok]
            if not len(w):
                break
        doc = np.searchsorted(first, start + order[w, 0], "right") - 1
        start = start - first[doc]
        yield doc, np.maximum(start, 0), np.minimum(start + rows.shape[1], n_words[doc]), keys[w]


def _search(windows, gap: int, slop: int):
    def run(batches):
        for b in batches:
            for shard in _read_shards(b, True):
                rows = shard["rows"]
                for doc, start, end, key in _match(shard, windows.value, gap, slop):
                    order = np.lexsort((key, end, start, doc))  # the same for equal texts
                    doc, start, end, key = doc[order], start[order], end[order], key[order]
                    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else []
                    cut = [np.split(x, at[1:]) if len(at) else [] for x in (start, end, key)]
                    spans = [np.stack(x, 1).astype(np.int64).tobytes() for x in zip(*cut[:2], strict=True)]
                    found = [np.unique(k).tobytes() for k in cut[2]]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[doc[at]] if len(at) else [], pa.int64()), pa.array(spans, pa.binary()), pa.array(found, pa.binary())], ["row", "spans", "windows"])

    return run


def _counts(batches):
    for b in batches:
        for shard in _read_shards(b, False):
            yield pa.RecordBatch.from_arrays([pa.array(shard["rows"]), pa.array(shard["n_words"])], ["row", "n_words"])


def _union(batches):
    """Per document: words covered by the matches, their merged spans, the windows met."""
    for b in batches:
        n_hit, merged, keys = [], [], []
        for spans, windows in zip(b.column("spans").to_pylist(), b.column("windows").to_pylist(), strict=True):
            x = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
            x = x[np.argsort(x[:, 0], kind="stable")]
            top = np.maximum.accumulate(x[:, 1])
            new = np.r_[True, x[1:, 0] > top[:-1]]
            lo, hi = x[new, 0], top[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]]
            n_hit.append(int((hi - lo).sum()))
            merged.append(np.stack([lo, hi], 1).ravel().tolist())
            keys.append(np.unique(np.frombuffer(b"".join(windows), np.int64)).tolist())
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n_hit, pa.int64()), pa.array(merged, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["row", "n_hit", "spans", "windows"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """(row, n_words, n_hit, spans array<long> of word ranges, items array<string>) of every document.

    ``docs`` has row (long, unique for a text) and text; ``benchmark`` has item (string) and text.
    n_hit counts words inside matches; with ``slop`` the ranges are those of the test window.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    longest = n + slop + 1
    index = _dealt(build_index(docs, scratch, longest))
    items = scratch.table(benchmark.select("item", "text").where("text is not null and item is not null").mapInArrow(_windows(n), "item string, window long, terms binary"), "windows")
    distinct = items.groupBy("window").agg(F.first("terms").alias("terms"))
    blocks = -(-items.count() // WINDOW_BLOCK)
    found = []
    for i in range(blocks):
        part = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i)
        by_length: dict[int, list] = {}
        for r in part.toLocalIterator():
            by_length.setdefault(len(r.terms) // 8, []).append(r)
        windows = [(np.array([r.window for r in rows]), np.frombuffer(b"".join(bytes(r.terms) for r in rows), np.uint64).reshape(-1, k)) for k, rows in by_length.items()]
        sent = spark.sparkContext.broadcast(windows)
        hits = index.mapInArrow(_search(sent, longest, slop), "row long, spans binary, windows binary")
        found.append(scratch.table(hits, f"found-{i}"))
        sent.destroy()
    words = index.mapInArrow(_counts, "row long, n_words long")
    if not found:
        return words.dropDuplicates(["row"]).selectExpr("row", "n_words", "0L n_hit", "array() :: array<bigint> spans", "array() :: array<string> items")
    hit = scratch.table(reduce(DataFrame.union, found).groupBy("row").agg(F.collect_set("spans").alias("spans"), F.collect_set("windows").alias("windows")).mapInArrow(_union, "row long, n_hit long, spans array<long>, windows array<long>"), "hits")
    named = hit.select("row", F.explode("windows").alias("window")).join(items.select("item", "window"), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hit.select("row", "n_hit", "spans").join(named, "row", "left")
    return words.dropDuplicates(["row"]).join(both, "row", "left").selectExpr("row", "n_words", "coalesce(n_hit, 0L) n_hit", "coalesce(spans, array()) spans", "coalesce(items, array()) items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, n_hit, hit_spans, hit_items.

    Columns of these names in the input are replaced.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    keep = [c for c in docs.columns if c not in {"n_words", "n_hit", "hit_spans", "hit_items"}]
    keyed = docs.select(*(F.col(f"`{c}`") for c in keep), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("_row"))
    found = find_contamination(keyed.select(F.col("_row").alias("row"), F.col(text).alias("text")), benchmark, n, slop, scratch)
    found = found.select(F.col("row").alias("_row"), "n_words", "n_hit", F.col("spans").alias("hit_spans"), F.col("items").alias("hit_items"))
    return keyed.join(found, "_row", "left").drop("_row")
