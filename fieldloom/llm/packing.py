"""Best-fit packing of token sequences through a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` counts) reaches the driver.  The
configuration LP over it - choose how often to use each multiset of lengths that fits a
sequence, so that all pieces are covered by as few as possible - is solved by multiplicative
weights: lengths carry weights, the best configurations for them are priced by a knapsack
dynamic program, and covered lengths lose weight, until every length is covered.  Rounding goes
by turns: whole uses of a configuration are placed, then the configurations with a part of a use
left are placed once each, the fullest first, as long as all of their pieces are still there, and
the program is solved again for the pieces that remain, until they hold at most ``REST`` of the
tokens; these few are packed best-fit.  The sequences, a lower bound for them and the share of
tokens that the program placed are logged.

Pieces get their places by (length, rank within length).  Ranks come from counts by task and
length, so a length that a third of all pieces share is never gathered in one task; what the tasks
before one hold is a small file of that task's in the shared folder, which whoever places its pieces
reads, so the pieces themselves are not exchanged.  The places of a length are intervals
of ranks; there is one for each piece of each configuration used, some thousands of which are used
at capacity 2048 whatever the corpus, so they go to the executors whole.

Tokens: a text is cut before each run of ASCII white space, where the tokenizer's pattern
never joins, and each distinct piece is encoded once per task.  Texts with other Unicode white
space or with an added token's string are encoded whole, for there such cuts could differ.

Ids are those of ``tokenizers`` for the given file.  Of a plain byte-level file the pieces between white
spaces are encoded by ``tiktoken`` with that file's vocabulary, which tests compare with ``tokenizers``; what could
differ (added tokens, spaces of several bytes) and every other kind of file goes to ``tokenizers`` itself.

Edge cases: null and empty texts are one piece of the final id alone, a null doc_id stays null;
a text of any length is encoded whole and cut into full pieces from its end; repeated rows are
packed each for itself and pieces of one length are told apart by their rank, so ties cannot
collide; other columns of the input, whatever their names, are not read; an empty table gives no
pieces.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.ngram_lm import filesystem
from fieldloom.llm.shared import Scratch, fresh_path

LOG = logging.getLogger(__name__)
RATE, STEP = 1.0, 0.34
REST = 0.05
TINY = 1e-9
MEMO_ENTRIES = 1 << 20
#: White space of Unicode beyond ASCII, as UTF-8 (fixed values).
_WIDE_SPACE = re.compile("[\u0085   -     　]")
#: How byte-level BPE splits text before its merges (fixed value of the format).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def _byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Byte sequences of a plain byte-level BPE file by id; None for any other kind of file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letter[x] for x in k): v for k, v in spec["model"]["vocab"].items() if k not in added}


@lru_cache(maxsize=1)
def shared_tokenizer(path: str) -> CachedTokenizer:
    """One per worker process, so that later tasks find earlier ones' pieces."""
    return CachedTokenizer(path)


class CachedTokenizer:
    """Ids of whole texts, encoding each distinct white-space-led piece once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks := _byte_level_ranks(path):
            import tiktoken

            self.quick = tiktoken.Encoding("byte-level", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            for k, v in ranks.items():
                self.token_bytes[v] = len(k)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.off = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)
        self.raw, self.raw_off = np.empty(1 << 16, np.uint8), np.zeros(1 << 12, np.int64)
        self.n = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        fast = getattr(self.inner, "encode_batch_fast", self.inner.encode_batch)
        return [e.ids for e in fast(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        if self.n + len(keys) > MEMO_ENTRIES and self.n:
            raise MemoryError  # the caller clears the memo and starts its chunk again
        # pieces of white space and a word keep their tokens when strung together
        joint = tk.WS_WORD[data[end - 1]] & ~tk.WS_WORD[data[begin]] & (self.quick is not None)
        if joint.any():
            size = (end - begin)[joint]
            text = data[tk.ragged(begin[joint], size)].tobytes().decode()
            ids = np.array(self.quick.encode_ordinary(text), np.uint32)
            cut = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(size)) + 1
            self._append(keys[joint], ids, np.diff(np.r_[0, cut]), data, begin[joint], end[joint])
        if not joint.all():
            own = self._encode([data[b:e].tobytes().decode() for b, e in zip(begin[~joint].tolist(), end[~joint].tolist(), strict=True)])
            self._append(keys[~joint], np.array([i for x in own for i in x], np.uint32), np.array([len(x) for x in own]), data, begin[~joint], end[~joint])

    def _append(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        last = self.n + len(keys)
        for values, off, new, size in (("ids", "off", ids, count), ("raw", "raw_off", data[tk.ragged(begin, end - begin)], end - begin)):
            base = int(getattr(self, off)[self.n])
            if base + len(new) > len(getattr(self, values)):
                setattr(self, values, np.resize(getattr(self, values), 2 * (base + len(new))))
            if last + 1 > len(getattr(self, off)):
                setattr(self, off, np.resize(getattr(self, off), 2 * (last + 1)))
            getattr(self, values)[base : base + len(new)] = new
            getattr(self, off)[self.n + 1 : last + 1] = base + np.cumsum(size)
        self.number.update(zip(keys.tolist(), range(self.n, last), strict=True))
        self.n = last

    def chunk(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a chunk, their offsets)."""
        try:
            return self._chunk(c)
        except MemoryError:
            self._clear()
            return self._chunk(c)

    def piece_sizes(self, c: tk.Chunk) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per document (ends of its pieces in bytes, their tokens); None where it is encoded whole."""
        try:
            begin, end, doc, odd, number = self._looked_up(c)
        except MemoryError:
            self._clear()
            begin, end, doc, odd, number = self._looked_up(c)
        n = self.off[number + 1] - self.off[number]
        cut = np.searchsorted(doc, np.arange(c.n + 1))
        own = set(odd)
        return [None if d in own else (end[cut[d] : cut[d + 1]] - c.offsets[d], n[cut[d] : cut[d + 1]]) for d in range(c.n)]

    def _looked_up(self, c: tk.Chunk) -> tuple:
        """(begin, end, document, of the pieces; documents encoded whole; numbers of the pieces)."""
        c.words()
        # pieces: white space and the word after it; what follows a document's last word is one more
        begin, end = np.r_[0, c.ends[:-1]] if len(c.ends) else c.ends, c.ends
        doc = tk.doc_of_words(c)
        begin = np.maximum(begin, c.offsets[doc])
        last = np.where(c.word_off[1:] > c.word_off[:-1], c.ends[np.maximum(c.word_off[1:] - 1, 0)] if len(c.ends) else 0, c.offsets[:-1])
        tail = np.flatnonzero(last < c.offsets[1:])
        begin, end, doc = np.r_[begin, last[tail]], np.r_[end, c.offsets[1:][tail]], np.r_[doc, tail]
        order = np.lexsort((begin, doc))
        begin, end, doc = begin[order], end[order], doc[order]
        odd = self._odd(c)
        if odd:
            plain = ~np.isin(doc, odd)
            begin, end, doc = begin[plain], end[plain], doc[plain]
        h = self._hashes(c, begin, end)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        known = self.number
        number = np.array([known.get(k, -1) for k in u.tolist()], np.int64)
        if (number < 0).any():
            new = number < 0
            at = first[new]
            self._learn(u[new], c.data, begin[at], end[at])
            number[new] = [known[k] for k in u[new].tolist()]
        number = number[inverse]
        other = self._differs(c, begin, end, number)
        if other.any():  # a hash that two pieces share
            odd = sorted({*odd, *doc[other].tolist()})
            plain = ~np.isin(doc, odd)
            begin, end, doc, number = begin[plain], end[plain], doc[plain], number[plain]
        return begin, end, doc, odd, number

    def _differs(self, c: tk.Chunk, begin: np.ndarray, end: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the bytes of pieces are not those kept under their numbers."""
        size = end - begin
        out = self.raw_off[number + 1] - self.raw_off[number] != size
        same = np.flatnonzero(~out & (size > 0))
        if len(same):
            size = size[same]
            wrong = c.data[tk.ragged(begin[same], size)] != self.raw[tk.ragged(self.raw_off[number[same]], size)]
            out[same] = np.add.reduceat(wrong, np.r_[0, np.cumsum(size)[:-1]]) > 0
        return out

    def _chunk(self, c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
        begin, end, doc, odd, number = self._looked_up(c)
        n_ids = self.off[number + 1] - self.off[number]
        ids = self.ids[tk.ragged(self.off[number], n_ids)]
        size = np.bincount(doc, n_ids, c.n).astype(np.int64)
        if not odd:
            return ids, np.r_[0, np.cumsum(size)]
        parts = np.split(ids, np.cumsum(size)[:-1])
        for d, own in zip(odd, self._encode([c.bytes_of(d).decode() for d in odd]), strict=True):
            parts[d] = np.array(own, np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]

    def _hashes(self, c: tk.Chunk, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = tk.Chunk(c.data, c.offsets, 0)
        p.starts, p.ends = begin, end
        return p.word_hashes(False)

    def _odd(self, c: tk.Chunk) -> list[int]:
        """Documents that have to be encoded whole."""
        leads = np.isin(c.data, _WIDE_LEADS)
        raw = c.data.tobytes()
        marked = [a.encode() for a in self.added if a.encode() in raw]
        if not marked and not leads.any():
            return []
        out = []
        count = np.add.reduceat(np.r_[leads, False].astype(np.int64), c.offsets[:-1]) * (np.diff(c.offsets) > 0)
        for d in range(c.n):
            if marked or count[d]:
                text = c.bytes_of(d)
                if any(a in text for a in marked) or (count[d] and _WIDE_SPACE.search(text.decode())):
                    out.append(d)
        return out


def _pieces(path: str, capacity: int, final_id: int, with_ids: bool):
    """Rows of pieces, with the task's number and the piece's rank of its length in the task."""

    def run(batches):
        tok = shared_tokenizer(path)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b, c in tk.batch_chunks(batches, size=2 * tk.CHUNK_BYTES):
            ids, off = tok.chunk(c)
            off = off + np.arange(len(off))  # each document gets one more id
            full = np.empty(off[-1], np.uint32)
            full[off[1:] - 1] = final_id
            keep = np.ones(len(full), bool)
            keep[off[1:] - 1] = False
            full[keep] = ids
            n = np.diff(off)
            many = -(-n // capacity)
            doc = np.repeat(np.arange(c.n), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            first = n[doc] - (many[doc] - 1) * capacity
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            rank = _rank_in_order(length, seen)
            raw = full.astype("<u4").view(np.uint8)
            lo = 4 * (off[doc] + start)
            own = [raw[a : a + 4 * k] for a, k in zip(lo.tolist(), length.tolist(), strict=True)]
            cells = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(np.full(len(doc), task), pa.int64()), pa.array(rank)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            if with_ids:
                ends = np.r_[0, 4 * np.cumsum(length)].astype(np.int32)  # pieces follow each other
                cells.append(pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(raw)]))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cells, names)

    return run


def _rank_in_order(value: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Running number of each value among its equals; ``seen`` carries the counts on."""
    order = np.argsort(value, kind="stable")
    v = value[order]
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)
    count = np.diff(np.r_[at, len(v)])
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - np.repeat(at, count) + seen[v]
    seen[v[at]] += count
    return rank


def _knapsack(price: np.ndarray) -> tuple[list[int], list[int]]:
    """For every room, the last length of the configuration of most price and the room it leaves; 0 where none fits."""
    capacity = len(price) - 1
    best, last, rest = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(price > 0)
    w = price[lengths]
    for c in range(int(lengths[0]), capacity + 1):
        k = np.searchsorted(lengths, c, "right")
        v = best[c - lengths[:k]] + w[:k]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], last[c], rest[c] = v[i], lengths[i], c - lengths[i]
        else:
            best[c], last[c], rest[c] = best[c - 1], last[c - 1], rest[c - 1]
    return last.tolist(), rest.tolist()


def _cover(demand: np.ndarray, rounds: int | None) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations as (length, count) and their fractional uses, which cover all of ``demand``.

    In a round, every open length in turn gets the configuration of most price that holds it, used
    until one of its lengths has moved by ``STEP`` of its demand; so a round moves all open lengths,
    however many, and at least one by the whole step.
    """
    limit, size = demand.tolist(), np.arange(len(demand))
    share, used = np.where(demand > 0, 0.0, 1.0), {}
    while (share < 1 - TINY).any() and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        open_ = share < 1 - TINY
        # the price of a length starts at its share of a sequence and falls as it is covered
        last, rest = _knapsack(np.where(open_, size * np.exp(-RATE * share), 0.0))
        end, at = np.minimum(1.0, share + STEP).tolist(), share.tolist()
        for k in np.flatnonzero(open_)[::-1].tolist():
            if end[k] - at[k] <= TINY:
                continue
            p, room = {k: 1}, len(demand) - 1 - k
            while last[room]:
                p[last[room]] = p.get(last[room], 0) + 1
                room = rest[room]
            p = {x: min(n, limit[x]) for x, n in p.items()}  # no more repeats than pieces
            times = min((end[x] - at[x]) * limit[x] / n for x, n in p.items())
            if times > TINY:
                for x, n in p.items():
                    at[x] += times * n / limit[x]
                key = tuple(p.items())
                used[key] = used.get(key, 0.0) + times
        share = np.array(at)
    return used


def lower_bound(histogram: np.ndarray) -> int:
    """Sequences that any packing needs: the largest sum of dual feasible functions of the lengths.

    Those are the share of a sequence or its steps of (k + 1)ths, with lengths under some e counted
    as nothing and those over capacity - e as a whole sequence.
    """
    capacity = len(histogram) - 1
    size, e = np.arange(capacity + 1), np.arange(capacity // 2 + 1)
    n, bound = np.r_[0, np.cumsum(histogram)], 0.0
    for k in range(41):
        f = size / capacity if k == 0 else np.where((k + 1) * size % capacity == 0, size / capacity, (k + 1) * size // capacity / k)
        s = np.r_[0.0, np.cumsum(histogram * f)]
        bound = max(bound, float((n[-1] - n[capacity - e + 1] + s[capacity - e + 1] - s[e]).max()))
    return int(np.ceil(bound - 1e-6))


def solve_configurations(histogram: np.ndarray, rounds: int | None = None) -> list[tuple[np.ndarray, int]]:
    """[(configuration as counts by length, times used)] that covers a histogram exactly.

    histogram[l] is the number of pieces of length l; the capacity is its last index.  The rounds of
    the linear program run until it covers every length, or as many as are given.
    """
    return [use for part in solve_parts(histogram, rounds) for use in part]


def solve_parts(histogram: np.ndarray, rounds: int | None = None) -> tuple[list[tuple[np.ndarray, int]], list[tuple[np.ndarray, int]]]:
    """(uses that the linear program gives, uses of the best-fit for the last ``REST`` of the tokens).

    A turn of rounding places something: if no use is whole, no piece is gone yet and the fullest
    configuration fits; from turn to turn twice the room may stay empty in those placed once.
    """
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    size = np.arange(capacity + 1)
    plan: list[tuple[np.ndarray, int]] = []

    def place(key: tuple[tuple[int, int], ...], times: int) -> None:
        p = np.zeros(capacity + 1, np.int64)
        for k, n in key:
            p[k] = n
            left[k] -= n * times
        plan.append((p, times))

    if left[capacity]:  # a full piece is a sequence of its own
        place(((capacity, 1),), int(left[capacity]))
    enough, loose = REST * float((left * size).sum()), 0
    while (left * size).sum() > enough:
        parts = []
        for key, x in sorted(_cover(left, rounds).items(), key=lambda kv: (-kv[1], kv[0])):
            times = min(int(x + TINY), *(int(left[k]) // n for k, n in key))
            if times:
                place(key, times)
            parts.append((capacity - sum(k * n for k, n in key), times - x, key))
        once = 0
        for room, _, key in sorted(parts):
            if once and (room > loose or (left * size).sum() <= enough):
                break
            if all(left[k] >= n for k, n in key):
                place(key, 1)
                once += 1
        loose = 2 * loose + 1  # what may stay empty in a configuration of this turn
    return plan, _best_fit(left)


def figures(histogram: np.ndarray, placed: list[tuple[np.ndarray, int]], rest: list[tuple[np.ndarray, int]]) -> dict[str, float]:
    """Sequences, the lower bound, the gap between them as a share of the bound, and the share of the
    tokens in pieces under the capacity that the linear program placed (1 where there are none)."""
    size = np.arange(len(histogram))
    size[-1] = 0
    tokens = int((histogram * size).sum())
    by_lp = sum(n * int((p * size).sum()) for p, n in placed)
    sequences, bound = sum(n for _, n in placed + rest), lower_bound(histogram)
    return {"sequences": sequences, "lower_bound": bound, "gap": (sequences - bound) / max(bound, 1), "lp_share": by_lp / tokens if tokens else 1.0}


def _best_fit(left: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """What rounding left over: each sequence takes the longest piece, then ever the longest that fits, as often as whole repeats allow."""
    capacity, out = len(left) - 1, []
    left = left.copy()
    while left.any():
        p, room = np.zeros(capacity + 1, np.int64), capacity
        while room > 0:
            fit = np.flatnonzero(left[: room + 1] > p[: room + 1])
            if not len(fit):
                break
            k = int(fit[-1])
            n = int(min(room // k, left[k] - p[k]))
            p[k] += n
            room -= n * k
        on = p > 0
        times = int((left[on] // p[on]).min())
        out.append((p, times))
        left -= times * p
    return out


def _intervals(plan: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
    """Per length and slot: first (length, rank) key, first sequence, offset; sorted by key."""
    rows, next_rank, sequence = [], {}, 0
    for p, times in plan:
        at = 0
        for k in np.flatnonzero(p)[::-1].tolist():
            for _ in range(int(p[k])):
                r = next_rank.get(k, 0)
                rows.append(((k << 44) + r, sequence, at))
                next_rank[k] = r + times
                at += k
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3


def _write_before(base: str, capacity: int):
    """Per task a file of the pieces that the tasks before it have, by length; the same at every attempt."""

    def run(table: pa.Table) -> pa.Table:
        fs, root = filesystem(base)
        fs.create_dir(root, recursive=True)
        own = np.zeros(capacity + 1, np.int64)
        own[table["length"].to_numpy()] = table["before"].to_numpy()
        with fs.open_output_stream(f"{root}/{table['task'][0].as_py()}", compression=None) as f:
            f.write(own.tobytes())
        return pa.table({"task": table["task"][:1]})

    return run


def _place(intervals, base: str):
    def run(batches):
        key, sequence, offset = intervals.value
        fs, root = filesystem(base)
        before: dict[int, np.ndarray] = {}
        for b in batches:
            length, task, rank = (b.column(k).to_numpy() for k in ("length", "task", "rank"))
            want = (length << 44) + rank
            for t in np.unique(task).tolist():
                if t not in before:
                    with fs.open_input_stream(f"{root}/{t}", compression=None) as f:
                        before[t] = np.frombuffer(f.read(), np.int64)
                own = task == t
                want[own] += before[t][length[own]]
            i = np.searchsorted(key, want, "right") - 1
            rest = [x for x in b.schema.names if x not in ("rank", "task", "ids")]
            cells, names = [b.column(x) for x in rest], list(rest)
            if "ids" in b.schema.names:
                ids = b.column("ids")
                _, ends, raw = ids.buffers()
                ends = np.frombuffer(ends, np.int32, b.num_rows + 1, 4 * ids.offset)
                values = np.frombuffer(raw, np.int32, (int(ends[-1]) - int(ends[0])) // 4, int(ends[0]))
                cells.append(pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*cells, pa.array(sequence[i] + want - key[i]), pa.array(offset[i])], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, final_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id, piece, start, length,
    ids_crc32, (ids,) sequence_id, offset.

    Texts longer than ``capacity`` are cut from the end, so only their first piece may be shorter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long" + (", ids binary" if with_ids else "")
    pieces = scratch.table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer_path, capacity, final_id, with_ids), schema), "pieces")
    counts = scratch.table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        histogram[r.length] = r.n
    placed, rest = solve_parts(histogram)
    LOG.info("packing: %s", json.dumps(figures(histogram, placed, rest)))
    intervals = spark.sparkContext.broadcast(_intervals(placed + rest))
    base = fresh_path(spark, "packing-before")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before.groupBy("task").applyInArrow(_write_before(base, capacity), "task long").count()
    names = [c for c in pieces.columns if c not in ("task", "rank")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields} | {"ids": "array<int>"}
    return pieces.mapInArrow(_place(intervals, base), ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long")
