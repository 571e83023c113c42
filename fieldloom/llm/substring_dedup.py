"""Removal of long repeated passages by difference-cover anchors.

A window is ``window`` consecutive words.  Every word is removed that lies in a window whose
word sequence also starts anywhere else, in the same document or another.

Method.  D is a difference cover modulo v: for any two positions i, j some d < v puts both
i + d and j + d on cover positions (modulo v in D).  So two equal windows share, at equal
offset, an anchor of w = window - v + 1 words that starts on cover positions of both
documents.  Stage 1 hashes anchors at cover positions only and finds the hashes that occur
twice.  Stage 2 extends: only windows that hold a repeated anchor within their first v words
are hashed whole, and those that occur twice are the repeated windows.

Exchange.  Occurrences travel as packed arrays, one row per range of hashes and per run of
input; a hash met twice within a run is known to be repeated, so the run answers for its own
documents and sends one occurrence on.  A very common passage thus reaches a reducer once per
run, not once per document.

Windows are told apart by 64-bit hashes of their words, anchors first and windows then: only windows
that hold an anchor that really or by its hash stands twice are compared, and two such that differ count
as equal with a probability of about 2**-64 a pair (n of them: n**2 / 2**65 false pairs in all); rows by a 64-bit hash of doc_id and text, and starts beyond a text are left out.

Edge cases: null and empty texts, and texts with fewer words than a window, keep all words; texts
of any length are taken whole; repeated rows (even of one doc_id, or of none) repeat each other's
windows and both lose them; columns named as the results are replaced, all others stay; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.shared import Scratch, text_buckets

#: Difference covers: modulus and cover (fixed values; perfect difference sets).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
RUN_POSTINGS = 1 << 20
_POSTINGS = "bucket int, grp int, blob binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Modulus, cover and anchor length: the largest modulus that leaves anchors of 40 % of the window."""
    fit = [v for v in COVERS if window - v + 1 >= max(1, 0.4 * window)]
    v = max(fit, default=1)
    return v, COVERS.get(v, (0,)), window - v + 1


def _pack(h: np.ndarray, ords: np.ndarray, kids: np.ndarray, starts: np.ndarray, several: np.ndarray) -> bytes:
    """One run's occurrences in one range of hashes; only the documents met are listed."""
    met = np.zeros(len(kids), bool)
    met[ords] = True
    local = (np.cumsum(met) - 1).astype(np.uint32)
    own = kids[met]
    head = np.array([len(h), len(own)], np.int64)
    return b"".join(x.tobytes() for x in (head, h, own, local[ords], starts, several))


def _unpack(blob: memoryview) -> tuple[np.ndarray, ...]:
    n, k = np.frombuffer(blob, np.int64, 2)
    at, out = 16, []
    for kind, m in ((np.uint64, n), (np.int64, k), (np.uint32, n), (np.uint32, n), (np.bool_, n)):
        out.append(np.frombuffer(blob, kind, m, at))
        at += int(m) * np.dtype(kind).itemsize
    h, own, local, starts, several = out
    return h, own[local], starts, several


def _replies(kid: np.ndarray, value: np.ndarray, groups: int) -> tuple[list[int], list[bytes]]:
    """Values by document, packed by group of documents: (groups, blobs)."""
    if not len(kid):
        return [], []
    group = (kid.view(tk.U64) % tk.U64(groups)).astype(np.int64)
    order = np.lexsort((kid, group))
    group, kid, value = group[order], kid[order], value[order]
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    blobs = []
    for k, v in zip(np.split(kid, at[1:]), np.split(value, at[1:]), strict=True):
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        blobs.append(b"".join(x.tobytes() for x in (np.array([len(first)]), k[first], np.diff(np.r_[first, len(k)]), v)))
    return group[at].tolist(), blobs


def _gather(kind):
    """One row per document of a group: all values told of it."""

    def run(table: pa.Table) -> pa.Table:
        kids, values = [], []
        for x in table["blob"]:
            n = int(np.frombuffer(x.as_buffer(), np.int64, 1)[0])
            kid, count = np.frombuffer(x.as_buffer(), np.int64, 2 * n, 8).reshape(2, n)
            kids.append(np.repeat(kid, count))
            values.append(np.frombuffer(x.as_buffer(), kind, int(count.sum()), 8 + 16 * n))
        kid, value = np.concatenate(kids), np.concatenate(values)
        order = np.argsort(kid, kind="stable")
        kid, value = kid[order], value[order]
        at = np.flatnonzero(np.r_[True, kid[1:] != kid[:-1]])
        tk.release()
        return pa.table({"kid": pa.array(kid[at]), "told": pa.array([x.tobytes() for x in np.split(value, at[1:])], pa.binary())})

    return run


def _post(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], buckets: int, by_hash: bool) -> Iterator[pa.RecordBatch]:
    """Packs (hashes, document ordinals, starts, kids of the chunk's documents) into runs."""
    held: list[tuple[np.ndarray, ...]] = []
    size = docs = turn = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size, docs, turn
        h, ords, starts, kids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        h, ords, starts = h[order], ords[order], starts[order]
        first = np.r_[True, h[1:] != h[:-1]]
        count = np.diff(np.r_[np.flatnonzero(first), len(h)])
        several = np.repeat(count > 1, count)
        k, v = _replies(kids[ords[several]], h[several] if by_hash else starts[several], buckets)
        h, ords, starts, several = h[first], ords[first], starts[first], several[first]
        b = ((h >> tk.U64(32)) * tk.U64(buckets)) >> tk.U64(32)
        cut = np.searchsorted(b, np.arange(buckets + 1, dtype=tk.U64))
        full = [i for i in range(buckets) if cut[i] < cut[i + 1]]
        blobs = [_pack(*(x[cut[i] : cut[i + 1]] for x in (h, ords)), kids, *(x[cut[i] : cut[i + 1]] for x in (starts, several))) for i in full]
        near = [(turn + i) % buckets for i in range(len(k))]  # what is answered here rides along, dealt evenly
        held, size, docs, turn = [], 0, 0, turn + len(k)
        return pa.RecordBatch.from_arrays([pa.array(full + near, pa.int32()), pa.array([None] * len(full) + k, pa.int32()), pa.array(blobs + v, pa.binary())], ["bucket", "grp", "blob"])

    for h, ords, starts, kids in found:
        if not len(h):
            continue
        held.append((h, ords.astype(np.uint32) + np.uint32(docs), starts.astype(np.uint32), kids))
        size, docs = size + len(h), docs + len(kids)
        if size >= RUN_POSTINGS:
            yield flush()
    if held:
        yield flush()


def _reduce(by_hash: bool, buckets: int):
    """For a range of hashes: the documents (and starts, or hashes) of those that occur twice."""

    def run(table: pa.Table) -> pa.Table:
        ready = pc.is_valid(table["grp"])
        answered = table.filter(ready).select(["grp", "blob"])
        parts = [_unpack(x.as_buffer()) for x in table.filter(pc.invert(ready))["blob"]]
        if not parts:
            return answered
        h, kid, starts, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, kid, starts, several = h[order], kid[order], starts[order], several[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.r_[at, len(h)])
        told = np.repeat(count > 1, count)  # of one run's own repeats the run has answered all
        k, v = _replies(kid[told], h[told] if by_hash else starts[told], buckets)
        del h, kid, starts, several, order, parts
        tk.release()
        return pa.concat_tables([answered, pa.table({"grp": pa.array(k, pa.int32()), "blob": pa.array(v, pa.binary())})])

    return run


def _anchors(window: int, buckets: int):
    v, cover, w = cover_for(window)
    on = np.zeros(v, bool)
    on[list(cover)] = True

    def found(batches):
        for b, c in tk.batch_chunks(batches):
            c.words()
            h, at, doc = _anchor_hashes(c, w, on, window)
            yield h, doc, at - c.word_off[doc], b.column("kid").to_numpy()

    return lambda batches: _post(found(batches), buckets, True)


def _anchor_hashes(c: tk.Chunk, w: int, on: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Hashes, word positions and documents of the anchors at cover positions."""
    wh = c.word_hashes(False)
    if len(wh) < w:
        return np.empty(0, tk.U64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = tk.doc_of_words(c)
    n = np.diff(c.word_off)[doc]
    inside = np.arange(len(wh)) - c.word_off[doc]
    at = np.flatnonzero(on[inside % len(on)] & (inside + w <= n) & (n >= window))
    return tk.window_hashes(wh, w)[at], at, doc[at]


def _blobs(column: pa.Array, kind) -> list[np.ndarray]:
    """Per row the values packed in it; none where it is null."""
    out = []
    for x in column:
        out.append(np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.empty(0, kind))
    return out


def _windows(window: int, buckets: int):
    v, cover, w = cover_for(window)
    on = np.zeros(v, bool)
    on[list(cover)] = True

    def found(batches):
        for b, c in tk.batch_chunks(batches):
            c.words()
            told = _blobs(b.column("told"), np.uint64)
            h, at, doc = _anchor_hashes(c, w, on, window)
            hit = np.zeros(len(at), bool)
            cut = np.searchsorted(doc, np.arange(c.n + 1))
            for d in range(c.n):
                hit[cut[d] : cut[d + 1]] = np.isin(h[cut[d] : cut[d + 1]], told[d])
            at = at[hit]
            maybe = np.zeros(len(c.starts) + 1, np.int64)  # starts from v - 1 words before a repeated anchor up to it
            np.add.at(maybe, np.maximum(at - v + 1, c.word_off[doc[hit]]), 1)
            np.add.at(maybe, at + 1, -1)
            s = np.flatnonzero((np.cumsum(maybe[:-1]) > 0) & tk.windows_inside(c, window))
            wd = tk.doc_of_words(c)[s]
            wh = tk.window_hashes(c.word_hashes(False), window)
            yield wh[s] if len(s) else np.empty(0, tk.U64), wd, s - c.word_off[wd], b.column("kid").to_numpy()

    return lambda batches: _post(found(batches), buckets, False)


def repeated_windows(docs: DataFrame, window: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(kid, starts binary): packed uint32 starts of the repeated windows of each text.

    ``docs`` has kid (row key, equal only for equal texts) and text.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substrings")
    texts = docs.select("kid", "text").where("text is not null")
    buckets = text_buckets(spark, texts)

    def exchange(rows, by_hash):
        replies = rows.groupBy("bucket").applyInArrow(_reduce(by_hash, buckets), "grp int, blob binary")
        told = replies.groupBy("grp").applyInArrow(_gather(np.uint64 if by_hash else np.uint32), "kid long, told binary")
        return scratch.table(told, "anchors" if by_hash else "windows")

    anchors = exchange(texts.mapInArrow(_anchors(window, buckets), _POSTINGS), True)
    scratch.drop()
    windows = exchange(texts.join(anchors, "kid").mapInArrow(_windows(window, buckets), _POSTINGS), False)
    scratch.drop("anchors")
    return windows.withColumnRenamed("told", "starts")


def _remove(window: int, digest: bool):
    def run(batches):
        for b, c in tk.batch_chunks(batches):
            c.words()
            gone = np.zeros(len(c.starts) + 1, np.int64)
            starts = _blobs(b.column("starts"), np.uint32)
            for d, s in enumerate(starts):
                s = s[s + np.int64(window) <= c.word_off[d + 1] - c.word_off[d]]
                if len(s):
                    at = np.unique(s).astype(np.int64) + c.word_off[d]
                    gone[at] += 1
                    gone[at + window] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            n_removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), c.word_off[:-1]) if c.n else np.empty(0)
            n_words = np.diff(c.word_off)
            n_removed = np.where(n_words > 0, n_removed, 0)
            texts, valid = [], b.column("text").is_valid().to_pylist()
            for d in range(c.n):
                raw = c.bytes_of(d)
                lo, hi = c.word_off[d], c.word_off[d + 1]
                if digest:
                    words = raw.split()
                    kept = words if not n_removed[d] else compress(words, ~gone[lo:hi])
                    texts.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                elif not n_removed[d]:
                    texts.append(raw.decode() if valid[d] else None)
                else:  # a removed run goes with the white space before it
                    keep = np.flatnonzero(~gone[lo:hi])
                    ends = c.ends[lo:hi] - c.offsets[d]
                    before = np.r_[0, ends[:-1]]
                    texts.append(b"".join([raw[before[i] : ends[i]] for i in keep] + [raw[ends[-1] :]]).decode())
            rest = [x for x in b.schema.names if x not in ("kid", "text", "starts")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in rest), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*rest, "kept", "n_words", "n_removed"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, text: str = "text", digest: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` without repeated passages, plus n_words and n_removed.

    With ``digest`` the column kept_sha256 (SHA-256 of the kept words joined by one space)
    stands in place of every other column but doc_id.  Output columns that clash with input
    columns of the same name replace them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    out_names = ["kept_sha256" if digest else text, "n_words", "n_removed"]
    rest = [c for c in docs.columns if c not in {text, "n_words", "n_removed"} and (not digest or c == "doc_id")]
    safe = {c: f"c{i}" for i, c in enumerate(rest)}
    plain = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.col(text)).alias("kid"), F.col(text).alias("text"), *(F.col(f"`{c}`").alias(s) for c, s in safe.items()))
    windows = repeated_windows(plain, window, scratch)
    scratch.drop()
    joined = plain.join(windows, "kid", "left")
    fields = [f for f in plain.schema.fields if f.name in safe.values()]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "kept string", "n_words long", "n_removed long"])
    out = joined.mapInArrow(_remove(window, digest), schema)
    order = [c for c in docs.columns if c in safe or c == text] if not digest else rest
    named = [F.col(safe[c]).alias(c) if c in safe else F.col("kept").alias(text) for c in order]
    if digest:
        named.append(F.col("kept").alias(out_names[0]))
    return out.select(*named, "n_words", "n_removed")
