"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped to score.

Counting.  Tasks send the distinct n-grams of a run of training texts, packed and compressed by
ranges of a hash, so a very common n-gram leaves a run once.  An n-gram is at home in the range of its
context's last word; where that word is very common, in that of the context's last two words, and so
on, and where the whole context is very common, in that of the n-gram's own last word.  So a range
sees all words that stand before an n-gram of its own when their number, the count of the next lower
order, is taken there; only n-grams whose whole context is very common, and the words' own counts,
go through a second exchange, by the last word.  Contexts count as very common from about
1/``HOT_SHARE`` of a run's tokens, or half of a range's, whichever is less; they are found first, and
their sums are added up over the ranges where they are read.  A range writes, by order,

* its n-grams: sorted hashes of context and word, and counts,
* its contexts: sorted hashes, with tokens and the numbers of words seen once, twice, oftener;
  contexts of one n-gram seen once, which are most, are a list of hashes alone,
* its words' numbers of contexts, and plain counts.

Hashes are stored as 32 bits below a directory of their leading bits, about log2(n) + 27 bits in
all; numbers as single bytes, and once more in full where one does not fit.  Files are named by
attempt and only those named in the committed table are read.

Scoring.  Each worker maps the arrays of the ranges that it meets (from the shared folder, or from a
local copy of that file that is unlinked at once where it is not a file system) and looks sorted
runs of n-grams up.

The model is p(w|u) = (c(uw) - D)/c(u) + g(u) p(w|u without its first word) with three discounts an
order, estimated from its counts of counts, down to p(w) = (N(.w) - D')/N(..) + g' / (V + 1); unknown
words share one more word's chance each.  Texts start in a context of their own and end with an end
token.

Edge cases: null and empty texts are one end token; texts of any length are read whole, in runs;
repeated rows count each and are scored each; a null doc_id is scored like any other
(its fold is null in the query, so it trains nothing there); without
training texts every count is zero and scores are those of the uniform distribution over the one
unknown word (0); an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.shared import Scratch, fresh_path

ORDER = 3
RUN_TOKENS = 1 << 21
HOT_SHARE = 256
#: Text whose n-grams a range holds.
RANGE_BYTES = 24 << 20
START_HASH, END_HASH = np.uint64(0x5354415254), np.uint64(0x454E44)
#: level: the order of a blob's n-grams, 0 for plain counts of words; kind: which file, 0 for a blob.
_ROWS = "bucket int, level int, kind int, path string, stats array<long>, blob binary"
_NAMES = ["bucket", "level", "kind", "path", "stats", "blob"]
GRAMS, CONTEXTS, SINGLES, WORDS = 1, 2, 3, 4
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)
_UNSIGNED = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def write_arrays(base: str, name: str, arrays: list[np.ndarray]) -> str:
    """One file of arrays after one another, their sizes first; returns its path."""
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}.bin"
    with fs.open_output_stream(path, compression=None) as f:
        f.write(np.array([len(arrays), *(v for a in arrays for v in (a.itemsize, len(a)))], np.int64).tobytes())
        for a in sorted(arrays, key=lambda a: -a.itemsize):  # the widest first, so that all are aligned
            f.write(np.ascontiguousarray(a).tobytes())
    return f"{base}/{os.path.basename(path)}"


def map_arrays(path: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped."""
    fs, own = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(own, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as f:  # the map keeps the data when the name goes
            with fs.open_input_stream(own, compression=None) as g:
                while block := g.read(16 << 20):
                    f.write(block)
            f.flush()
            raw = np.memmap(f.name, np.uint8, "r")
    raw = np.asarray(raw)  # a plain view of the map, which is quicker to index
    n = int(raw[:8].view(np.int64)[0])
    shape = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2).tolist()
    out, at = [None] * n, 8 + 16 * n
    for i in sorted(range(n), key=lambda i: -shape[i][0]):
        size, length = shape[i]
        out[i] = raw[at : at + size * length].view(_UNSIGNED[size])
        at += size * length
    return out


def sorted_table(keys: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays of a look-up table of distinct 64-bit keys: directory, low halves, a byte of each column;
    and the same for the rows that need more than a byte, with whole columns."""
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    out = [*_directory(keys), *(np.minimum(c, 0xFF).astype(np.uint8) for c in columns)]
    if columns:
        wide = np.any([c >= 0xFF for c in columns], 0)
        out += [*_directory(keys[wide]), *(c[wide].astype(np.int64) for c in columns)]
    return out


def _directory(keys: np.ndarray) -> list[np.ndarray]:
    bits = (len(keys) // 32).bit_length()
    lead = (keys >> tk.U64(63 - bits) >> tk.U64(1)).astype(np.int64)
    begin = np.searchsorted(lead, np.arange((1 << bits) + 1)).astype(np.uint32)
    return [begin, ((keys << tk.U64(bits)) >> tk.U64(32)).astype(np.uint32)]


def _find(begin: np.ndarray, low: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row of each hash in a table, -1 where absent: binary search within its directory entry."""
    bits = (len(begin) - 1).bit_length() - 1
    lead = (h >> tk.U64(63 - bits) >> tk.U64(1)).astype(np.int64)
    want = ((h << tk.U64(bits)) >> tk.U64(32)).astype(np.uint32)
    at, end = begin[lead].astype(np.int64), begin[lead + 1].astype(np.int64)
    if not len(low) or not len(h):
        return np.full(len(h), -1)
    for k in range(int((end - at).max()).bit_length() - 1, -1, -1):  # as far as the rows before are less
        last = at + ((1 << k) - 1)
        at += ((last < end) & (low.take(last, mode="clip") < want)) * np.int64(1 << k)
    return np.where((at < end) & (low.take(at, mode="clip") == want), at, -1)


def look_up(table: list[np.ndarray], h: np.ndarray) -> list[np.ndarray]:
    """The columns of a ``sorted_table`` at hashes, 0 where absent."""
    k = len(table) // 2 - 2
    i = _find(table[0], table[1], h)
    there = np.flatnonzero(i >= 0)
    out = [np.zeros(len(h), np.int64) for _ in range(k)]
    for o, x in zip(out, table[2 : 2 + k], strict=True):
        o[there] = x[i[there]]
    wide = there[np.any([o[there] == 0xFF for o in out], 0)] if len(there) else there
    if len(wide):
        j = _find(table[2 + k], table[3 + k], h[wide])
        for o, x in zip(out, table[4 + k :], strict=True):
            o[wide] = x[j]
    return out


def _grouped(b: np.ndarray) -> np.ndarray:
    """Order by small numbers, kept within equal ones."""
    return np.argsort(b.astype(_least(int(b.max(initial=0)) + 1)), kind="stable")


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order; where one of each stands; the place of each value among them; counts.

    As np.unique, with whichever of equal values the sort, which need not be stable, has first.
    """
    order = np.argsort(h)
    ordered = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[begin], order[begin], of, np.diff(begin, append=len(h))


def _range_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> tk.U64(32)) * tk.U64(buckets)) >> tk.U64(32)).astype(np.int64)


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of words in order: of a context, or of a context and a word."""
    h = np.full(len(columns[0]), len(columns), tk.U64)
    for c in columns:
        h = tk.mix(h * _TURN + c)
    return h


def token_columns(c: tk.Chunk, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the order - 1 tokens before each token, oldest first, and the token; offsets by document) of a
    chunk: words in lower case, then the end, with starts before the first."""
    h = c.words().word_hashes(True)
    pad = order - 1
    off = c.word_off + np.arange(c.n + 1)
    at = np.arange(off[-1]) + pad * np.repeat(np.arange(1, c.n + 1), np.diff(off))  # in a row with starts
    row = np.full(off[-1] + pad * c.n, START_HASH, tk.U64)
    is_word = np.ones(off[-1], bool)
    is_word[off[1:] - 1] = False
    row[at[is_word]], row[at[~is_word]] = h, END_HASH
    return [row[at - k] for k in range(pad, -1, -1)], off


def _frequent(order: int, share: int):
    """Contexts, by order, of more than 1/share of a run's tokens."""

    def run(batches):
        for _, c in tk.batch_chunks(batches):
            columns, off = token_columns(c, order)
            for n in range(2, order + 1):
                u = np.sort(_joined(columns[order - n : -1]))
                begin = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                u, count = u[begin], np.diff(begin, append=len(u))
                often = count > max(16, int(off[-1]) // share)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum(), n), pa.int32()), pa.array(u[often].view(np.int64)), pa.array(count[often])], ["level", "u", "n"])

    return run


def _least(limit: int):
    return np.uint8 if limit < 1 << 8 else np.uint16 if limit < 1 << 16 else np.uint32 if limit < 1 << 32 else np.int64


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes first, which compress well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _sorted_by(numbers: list[np.ndarray], size: int) -> np.ndarray:
    """Order of distinct rows of numbers below ``size``, the first the most weighty."""
    bits = size.bit_length()
    if bits * len(numbers) > 64:
        return np.lexsort(numbers[::-1])
    key = np.zeros(len(numbers[0]), tk.U64)
    for x in numbers:
        key = (key << tk.U64(bits)) | x.astype(tk.U64)
    return np.argsort(key)


def _pack(columns: list[np.ndarray], count: np.ndarray) -> bytes:
    """n-grams, sorted from the context's last word on, as numbers in the list of their words' hashes
    (the commonest first), and counts; compressed."""
    words, _, number, often = _distinct(np.concatenate(columns))
    by_count = _grouped(often.max(initial=0) - often)
    rank = np.empty(len(words), np.int64)
    rank[by_count] = np.arange(len(words))
    number = rank[number].reshape(len(columns), -1)
    order = _sorted_by([*number[-2::-1], number[-1]], len(words))
    kind, count_kind = _least(len(words)), _least(int(count.max(initial=0)))
    head = np.array([len(count), len(columns), len(words), np.dtype(kind).itemsize, np.dtype(count_kind).itemsize], np.int64)
    body = b"".join((_planes(words[by_count]), *(_planes(x[order].astype(kind)) for x in number), _planes(count[order].astype(count_kind))))
    return head.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob) -> tuple[list[np.ndarray], np.ndarray]:
    n, k, v, size, count_size = np.frombuffer(blob, np.int64, 5).tolist()
    body = pa.decompress(blob.slice(40), decompressed_size=8 * v + n * (k * size + count_size), codec="zstd")
    plane = lambda at, n, m: np.frombuffer(body, np.uint8, n * m, at).reshape(m, n).T.copy().view(_UNSIGNED[m])[:, 0]
    words = plane(0, v, 8).view(np.uint64)
    return [words[plane(8 * v + i * n * size, n, size)] for i in range(k)], plane(8 * v + k * n * size, n, count_size)


def _all_of(blobs: list) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [_unpack(x) for x in blobs]
    return [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1].astype(np.int64) for p in parts])


def _among(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def home(columns: list[np.ndarray], buckets: int, hot: dict[int, np.ndarray]) -> np.ndarray:
    """The range of n-grams: of the context's shortest ending that is not very common; n-grams whose
    whole context is go by their own last word, in ranges of their own behind the others."""
    b = _range_of(columns[-1], buckets) + buckets
    for k in range(len(columns) - 1, 0, -1):
        u = _joined(columns[-1 - k : -1])
        plain = ~_among(hot[k + 1], u)
        b[plain] = _range_of(u[plain], buckets)
    return b


def _blobs(level: int, columns: list[np.ndarray], count: np.ndarray, b: np.ndarray) -> list[tuple]:
    """Rows of the ranges ``b`` that n-grams (or words, by themselves) go to."""
    order = _grouped(b)
    columns, count, b = [c[order] for c in columns], count[order], b[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else [0]
    return [(int(b[i]), level, 0, None, None, _pack([c[i:j] for c in columns], count[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _rows(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary())
    return [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]


def _count(order: int, buckets: int, hot: dict[int, np.ndarray]):
    """Distinct n-grams of runs, by home."""

    def flush(held):
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        _, first, _, n = _distinct(_joined(columns))
        columns = [c[first] for c in columns]
        return pa.RecordBatch.from_arrays(_rows(_blobs(order, columns, n, home(columns, buckets, hot))), _NAMES)

    def run(batches):
        held, size = [], 0
        for _, c in tk.batch_chunks(batches):
            columns, off = token_columns(c, order)
            held.append(columns)
            size += int(off[-1])
            if size >= RUN_TOKENS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct n-grams, their summed counts and joint hashes."""
    key, first, of, _ = _distinct(_joined(columns))
    return [c[first] for c in columns], np.bincount(of, n, len(key)).astype(np.int64), key


def _write_order(level: int, bucket: int, base: str, columns: list[np.ndarray], n: np.ndarray, key: np.ndarray) -> list[tuple]:
    """Writes the n-grams of one order and their contexts; the rows that name the files."""
    u = _joined(columns[:-1])
    order = np.argsort(u)
    begin = np.flatnonzero(np.r_[True, u[order][1:] != u[order][:-1]])
    per = [np.add.reduceat(x[order].astype(np.int64), begin) for x in (n, n == 1, n == 2, n > 2)]
    single, contexts = per[0] == 1, u[order][begin]
    files = {GRAMS: sorted_table(key, [n]), CONTEXTS: sorted_table(contexts[~single], [x[~single] for x in per]), SINGLES: sorted_table(contexts[single], [])}
    stats = {GRAMS: _counts_of_counts(n)}
    return [(bucket, level, k, write_arrays(base, f"order-{level}-{k}-{bucket}", x), stats.get(k), None) for k, x in files.items()]


def _write_home(order: int, base: str, buckets: int, hot: dict[int, np.ndarray]):
    """Writes all orders of a range; sends on the counts of n-grams of very common contexts, and of words."""

    def run(table: pa.Table) -> pa.Table:
        bucket, out = table["bucket"][0].as_py(), []
        columns, n, key = _summed(*_all_of([x.as_buffer() for x in table["blob"]]))
        word, _, of, _ = _distinct(columns[-1])
        out += _blobs(0, [word], np.bincount(of, n, len(word)).astype(np.int64), _range_of(word, buckets))
        del word, of
        for level in range(order, 1, -1):
            out += _write_order(level, bucket, base, columns, n, key)
            columns, n, key = _summed(columns[1:], np.ones(len(n), np.int64))
            if level == 2:
                out += _blobs(1, columns, n, _range_of(columns[-1], buckets))
                break
            b = home(columns, buckets, hot)
            away = b >= buckets  # these are not whole here; the others are at home here too
            out += _blobs(level - 1, [c[away] for c in columns], n[away], b[away] - buckets)
            columns, n, key = [c[~away] for c in columns], n[~away], key[~away]
            if not len(n):
                break
        return pa.Table.from_arrays(_rows(out), _NAMES)

    return run


def _write_words(order: int, base: str, buckets: int):
    """Writes the n-grams of very common contexts that end in the words of a range, and the words;
    keeps the rows that name files."""

    def run(table: pa.Table) -> pa.Table:
        bucket, kinds, levels = table["bucket"][0].as_py() % buckets, table["kind"].to_pylist(), table["level"].to_pylist()
        blobs: dict[int, list] = {}
        for x, kind, level in zip(table["blob"], kinds, levels, strict=True):
            if kind == 0:
                blobs.setdefault(level, []).append(x.as_buffer())
        out, above = [], None
        for level in range(order - 1, 0, -1):
            parts = [_all_of(blobs.pop(level))] if level in blobs else []
            if above is not None:
                parts.append((above[1:], np.ones(len(above[0]), np.int64)))
            if not parts:
                continue
            columns, n, key = _summed([np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))
            if level > 1:
                out += _write_order(level, bucket + buckets, base, columns, n, key)
                above = columns
        if blobs:
            words, contexts = columns[0], n  # of order 1; those of order 0 are the same
            _, plain, key = _summed(*_all_of(blobs[0]))
            stats = [len(words), int(contexts.sum()), int(plain.sum()), *_counts_of_counts(contexts)]
            out.append((bucket, 1, WORDS, write_arrays(base, f"words-{bucket}", sorted_table(key, [contexts, plain])), stats, None))
        return pa.concat_tables([table.filter(pa.array([k > 0 for k in kinds])), pa.Table.from_arrays(_rows(out), _NAMES)])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; plain ones where counts are too few."""
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


class Model:
    """Paths and totals; maps a range's files when they are first looked up in a process."""

    def __init__(self, order: int, files: dict[tuple[int, int, int], str], buckets: int, hot: dict[int, np.ndarray], counts: dict[int, list[int]], words: list[int]):
        self.order, self.files, self.buckets, self.hot = order, files, buckets, hot
        self.vocabulary, self.continuations, self.tokens = words[:3]
        self.discounts = {n: _discounts(*counts[n]) for n in range(2, order + 1)} | {1: _discounts(*words[3:])}
        self.word_counts = words[3:]
        self.maps: dict = {}
        self.hot_sums: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}, "hot_sums": {}}

    def _file(self, level: int, kind: int, bucket: int) -> list[np.ndarray] | None:
        at = (level, kind, bucket)
        if at not in self.maps:
            self.maps[at] = map_arrays(self.files[at]) if at in self.files else None
        return self.maps[at]

    def _look_up(self, level: int, kind: int, columns: int, b: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        """Columns of the tables of ranges ``b`` at hashes."""
        out = [np.zeros(len(h), np.int64) for _ in range(columns)]
        order = _grouped(b)
        cut = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]]) if len(b) else []
        for at in np.split(order, cut[1:]) if len(b) else []:
            if own := self._file(level, kind, int(b[at[0]])):
                found = look_up(own, h[at]) if kind != SINGLES else [_find(*own, h[at]) >= 0]
                for o, x in zip(out, found, strict=True):
                    o[at] = x
        return out

    def _contexts_at(self, level: int, b: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
        out = self._look_up(level, CONTEXTS, 4, b, u)
        rest = np.flatnonzero(out[0] == 0)
        out[0][rest] = out[1][rest] = self._look_up(level, SINGLES, 1, b[rest], u[rest])[0]
        return out

    def contexts(self, level: int, columns: list[np.ndarray], u: np.ndarray) -> list[np.ndarray]:
        """Tokens and numbers of words seen once, twice, oftener after each of distinct contexts, given
        as columns and as hashes."""
        b = home([*columns, columns[-1]], self.buckets, self.hot)  # the range of a very common one is not used
        out = self._contexts_at(level, b, u)
        spread = np.flatnonzero(b >= self.buckets)
        if len(spread):  # these stand in several ranges
            if level not in self.hot_sums:
                every = self.hot[level]
                parts = [self._contexts_at(level, np.full(len(every), self.buckets + i), every) for i in range(self.buckets)]
                self.hot_sums[level] = [np.sum(x, 0) for x in zip(*parts, strict=True)]
            i = np.searchsorted(self.hot[level], u[spread])
            for o, x in zip(out, self.hot_sums[level], strict=True):
                o[spread] = x[i]
        return out

    def grams(self, level: int, columns: list[np.ndarray], key: np.ndarray) -> np.ndarray:
        """Counts of distinct n-grams, given as columns and as hashes."""
        return self._look_up(level, GRAMS, 1, home(columns, self.buckets, self.hot), key)[0]

    def words(self, w: np.ndarray) -> list[np.ndarray]:
        """Numbers of distinct contexts, and plain counts, of distinct words."""
        return self._look_up(1, WORDS, 2, _range_of(w, self.buckets), _joined([w]))

    def _less(self, n: np.ndarray, level: int) -> np.ndarray:
        return np.maximum(n - np.array((0.0, *self.discounts[level]))[np.minimum(n, 3)], 0)

    def word_probability(self, contexts: np.ndarray) -> np.ndarray:
        """Chances of words that stand after so many distinct contexts."""
        n1, n2, _, _ = self.word_counts
        uniform, d = 1 / (self.vocabulary + 1), self.discounts[1]
        if not self.continuations:
            return np.full(len(contexts), uniform)
        rest = (d[0] * n1 + d[1] * n2 + d[2] * (self.vocabulary - n1 - n2)) / self.continuations
        return self._less(contexts, 1) / self.continuations + rest * uniform

    def score(self, c: tk.Chunk) -> tuple[np.ndarray, ...]:
        """Per document: tokens, known tokens, base score, score."""
        columns, off = token_columns(c, self.order)
        word, first, of, _ = _distinct(columns[-1])
        contexts, count = self.words(word)
        p, at_key = self.word_probability(contexts)[of], of
        head = np.zeros(off[-1], bool)
        head[off[:-1]] = True
        for n in range(2, self.order + 1):
            # a token's context is the n-gram, of one order less, that ends before it, and all starts at first
            before = [np.append(x[first], START_HASH) for x in columns[self.order - n + 1 :]]
            at_u = np.where(head, len(first), np.r_[0, at_key[:-1]])
            own = columns[self.order - n :]
            key, first, at_key, _ = _distinct(_joined(own))
            total, n1, n2, n3 = self.contexts(n, before, _joined(before))
            known = np.flatnonzero(total[at_u[first]] > 0)  # n-grams of other contexts have no count
            n_key = np.zeros(len(key), np.int64)
            n_key[known] = self.grams(n, [x[first[known]] for x in own], key[known])
            d, seen = self.discounts[n], np.maximum(total, 1)
            rest = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / seen, 1.0)
            p = self._less(n_key, n)[at_key] / seen[at_u] + rest[at_u] * p
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))[of]
        add = lambda x: np.add.reduceat(x, off[:-1])  # noqa: E731  every document has a token
        return np.diff(off), add((count[of] > 0).astype(np.int64)), add(base), add(np.log10(p))


def train(texts: DataFrame, order: int = ORDER, scratch: Scratch | None = None) -> Model:
    """A model of ``texts`` (text) with contexts of up to ``order`` - 1 words."""
    if order < 2:
        raise ValueError("the order has to be 2 or more")
    spark = texts.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    rows = texts.select("text")
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // RANGE_BYTES + 1
    base = fresh_path(spark, "ngram-arrays")
    share = max(HOT_SHARE, 2 * buckets)
    often = rows.mapInArrow(_frequent(order, share), "level int, u long, n long").groupBy("level", "u").agg(F.sum("n").alias("n"))
    often = often.where(F.col("n") * (8 * share) > size).collect()  # at most 8 * share an order, as a token takes a byte
    hot = {n: np.sort(np.array([r.u for r in often if r.level == n], np.int64).view(tk.U64)) for n in range(2, order + 1)}
    counted = rows.mapInArrow(_count(order, buckets, hot), _ROWS).groupBy("bucket").applyInArrow(_write_home(order, base, buckets, hot), _ROWS)
    named = scratch.table(counted.groupBy(F.col("bucket") % buckets).applyInArrow(_write_words(order, base, buckets), _ROWS).drop("blob"), "files")
    files: dict[tuple[int, int, int], str] = {}
    counts, words = {n: [0] * 4 for n in range(2, order + 1)}, [0] * 7
    for r in named.collect():  # some rows a range and order
        files[r.level, r.kind, r.bucket] = r.path
        if r.kind == GRAMS:
            counts[r.level] = [a + b for a, b in zip(counts[r.level], r.stats, strict=True)]
        elif r.kind == WORDS:
            words = [a + b for a, b in zip(words, r.stats, strict=True)]
    return Model(order, files, buckets, hot, counts, words)


_OPEN: dict[str, Model] = {}


def _scores(model, key: str):
    def run(batches):
        if key not in _OPEN:
            _OPEN.clear()
            _OPEN[key] = model.value
        own = _OPEN[key]
        for b, c in tk.batch_chunks(batches, size=4 * tk.CHUNK_BYTES):
            rest = [k for k in b.schema.names if k != "text"]
            cols = [pa.array(x) for x in own.score(c)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), *cols], [*rest, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with n_tokens, n_known, train_tokens, base_score, score
    (log10 of the text's chance) and perplexity."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", "text").mapInArrow(_scores(sent, uuid.uuid4().hex), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
