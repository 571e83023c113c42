"""Chat formatting in budgeted windows.

A turn reads ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a text are made
harmless by one more backslash between ``<`` and ``|``; taking one away restores the text, so
the escape is reversible whatever the text holds.

A turn's size is the tokens of its role and escaped text by the given tokenizer, and ``OVERHEAD``
for the template.  A conversation is cut at turns.  With the running sum of turn tokens, a window
ends before the first turn at which the sum since the window's start, and what it repeats, passes
the budget.  Every later window opens with the conversation's system turn (its first turn, if that
is one; of a longer one the head that takes at most half of the budget), then repeats the last ``history`` turns as far as half
of the budget and the coming turn allow.  Loss spans cover the texts of assistant turns in the one
window where they are new; what is repeated is masked.

No window passes the budget: a turn too long for a window beside the system turn is cut into parts
that fit, before white space or, in a word longer than that, at a character; a part after the first
opens its window, which is marked ``continues``.  Only a role that is longer than the budget itself
can make a window longer.

Tasks.  A task streams conversations in the order of their turns and keeps no more than the current
window, the system turn and the history.  A conversation of more than ``section`` turns is dealt in
sections to several tasks, which changes no window: its turns are ranked by a range sort and sized, one
scan over the sizes alone finds where windows start, and a section begins at the first start in each
run of so many turns; it gets the system turn and the history before it as carried rows.

Edge cases: null texts and roles are empty; a null conv_id is a conversation of its own; repeated
turn numbers follow by role and text; repeated rows are turns each; other columns of the input,
whatever their names, are not read; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import textkit as tk
from fieldloom.llm.packing import shared_tokenizer
from fieldloom.llm.shared import Scratch, shuffle_partitions

#: The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of the two control strings and the two line ends of a turn.
OVERHEAD = 4
SECTION = 1 << 14
#: Kinds of rows of a section: its conversation's system turn, the history before it, its own turns.
SYSTEM, HISTORY, OWN = 0, 1, 2
_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_WINDOW = "conv_id long, section long, window long, continues boolean, n_repeated int, n_turns int, tokens long, text string, loss array<struct<start:long,end:long>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
_NAMES = ["conv_id", "section", "window", "continues", "n_repeated", "n_turns", "tokens", "text", "loss"]

Turn = tuple[str, str, int]
#: Ends in bytes of the pieces of an escaped text, and their tokens, which add up; None where they may not.
Pieces = tuple[np.ndarray, np.ndarray] | None
Counter = Callable[[list[str]], list[int]]


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


@lru_cache(maxsize=1)
def token_counter(path: str) -> Counter:
    """Numbers of tokens of texts by a tokenizer file."""
    tok = shared_tokenizer(path)

    def count(texts: list[str]) -> list[int]:
        return [n for c in tk.column_chunks(pa.array(texts, pa.string())) for n in np.diff(tok.chunk(c)[1]).tolist()]

    count.pieces = lambda texts: [x for c in tk.column_chunks(pa.array(texts, pa.string())) for x in tok.piece_sizes(c)]
    return count


def turn_sizes(turns: list[tuple[str, str]], count: Counter) -> list[int]:
    own = sorted({r for r, _ in turns})
    roles = dict(zip(own, count([_role_line(r) for r in own]), strict=True))
    return [OVERHEAD + roles[r] + n for (r, _), n in zip(turns, count([escape(t) for _, t in turns]), strict=True)]


def parse_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    turns = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        turns.append((_role(role), unescape(body[: body.rindex(END)])))
    return turns


class Windows:
    """Streams turns of one conversation after another into windows."""

    def __init__(self, budget: int, history: int, count: Counter):
        self.budget, self.history, self.count = budget, history, count

    def begin(self, conv, section: int = 0) -> None:
        self.conv, self.section, self.number, self.system = conv, section, 0, None
        self.past: deque[Turn] = deque(maxlen=self.history)
        self.repeated: list[Turn] = []
        self.new: list[Turn] = []
        self.continues = False
        self.sum = 0  # tokens of all new turns so far
        self.start = 0  # the sum at which the window's budget is counted from

    def carry(self, kind: int, turn: Turn, pieces: Pieces = None) -> None:
        """The system turn or a turn of the history from before this section."""
        if kind == SYSTEM:
            self.system = self._head(*turn, pieces)
        else:
            room = self.budget - sum(t[2] for t in self._kept())
            self.past.extend([turn] if turn[2] <= room else self._parts(turn[0], turn[1], room, pieces))

    def _kept(self) -> list[Turn]:
        return [self.system] if self.system else []

    def _head(self, role: str, text: str, size: int, pieces: Pieces) -> Turn:
        """What is retained of a system turn."""
        return (role, text, size) if size <= self.budget // 2 else self._parts(role, text, self.budget // 2, pieces)[0]

    def add(self, role: str, text: str, size: int, pieces: Pieces = None) -> list[tuple]:
        """The windows that this turn closes; ``pieces`` are those of a long text, if they are known."""
        first = self.section == 0 and self.number == 0 and not self.new
        if first and role == "system":
            self.system = self._head(role, text, size, pieces)
        whole = first and self.system and self.system[2] == size
        room, out = self.budget - (0 if whole else sum(t[2] for t in self._kept())), []
        parts = [(role, text, size)] if size <= room else self._parts(role, text, room, pieces)
        for k, turn in enumerate(parts):
            if k or (self.new and self.sum + turn[2] - self.start > self.budget):
                out.append(self.close())
            if not self.new and (self.number or self.section):
                self._repeat(turn[2])
                self.continues = k > 0
            self.new.append(turn)
            self.sum += turn[2]
            if k or not (first and role == "system"):
                self.past.append(turn)
        return out

    def _parts(self, role: str, text: str, room: int, pieces: Pieces) -> list[Turn]:
        """The turn in parts of at most ``room`` tokens."""
        head = OVERHEAD + self.count([_role_line(role)])[0]
        if pieces is None or head + pieces[1].max() > room:
            return self._parts_of_characters(role, text, room, head)
        raw, (ends, n) = escape(text).encode(), pieces
        total, out, at = np.cumsum(n), [], 0
        while at < len(n):
            before = total[at] - n[at]
            to = int(np.searchsorted(total, before + room - head, "right"))
            own = raw[ends[at - 1] if at else 0 : ends[to - 1]]
            out.append((role, unescape(own.decode()), head + int(total[to - 1] - before)))
            at = to
        return out

    def _parts_of_characters(self, role: str, text: str, room: int, head: int) -> list[Turn]:
        size = lambda k, n: head + self.count([escape(text[k : k + n])])[0]
        out, at = [], 0
        while at < len(text) or not out:
            low, high = 1, min(max(room, 2), len(text) - at)
            while high < len(text) - at and size(at, high) <= room:
                low, high = high, min(2 * high, len(text) - at)
            if size(at, high) <= room:
                low = high
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if size(at, mid) <= room else (low, mid)
            out.append((role, text[at : at + low], size(at, low)))
            at += low
        return out

    def _repeat(self, coming: int) -> None:
        keep = self._kept()
        room = min(self.budget // 2, self.budget - coming) - sum(t[2] for t in keep)
        recent: list[Turn] = []
        for t in reversed(self.past):
            if t[2] > room:
                break
            room -= t[2]
            recent.insert(0, t)
        self.repeated = keep + recent
        self.start = self.sum - sum(t[2] for t in self.repeated)

    def close(self) -> tuple:
        at, parts, loss = 0, [], []
        for i, (role, text, _) in enumerate(self.repeated + self.new):
            head, body = f"{START}{_role_line(role)}\n", escape(text)
            if role == "assistant" and i >= len(self.repeated):
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts.append(f"{head}{body}{END}\n")
            at += len(parts[-1])
        tokens = sum(t[2] for t in self.repeated + self.new)
        row = (self.conv, self.section, self.number, self.continues, len(self.repeated), len(self.repeated) + len(self.new), tokens, "".join(parts), loss)
        self.number, self.new, self.repeated, self.continues = self.number + 1, [], [], False
        return row


class Sizes(Windows):
    """The same windows from sizes alone: an over-long turn comes with the sizes of its last parts."""

    def fill(self, role: str, size: int, parts: list[int]) -> bool:
        """Whether a window starts at this turn."""
        self.parts, before = parts, self.number
        if parts and role == "system" and not (self.number or self.new):
            self.head = parts[0]
            self.parts = parts[1:]
        self.add(role, "", size)
        return self.number > before and len(self.new) == 1 and not self.parts

    def _head(self, role: str, text: str, size: int, pieces: Pieces) -> Turn:
        return (role, "", min(size, self.head if size > self.budget // 2 else size))

    def _parts(self, role: str, text: str, room: int, pieces: Pieces) -> list[Turn]:
        return [(role, "", n) for n in self.parts]


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _format(budget: int, history: int, tokenizer: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        w, last, rows, held = Windows(budget, history, count), None, [], 0
        for b in batches:
            turns = [(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            keys = zip(*(b.column(k).to_pylist() for k in ("conv_id", "section", "kind")), strict=True)
            sizes = turn_sizes(turns, count)
            long = [i for i, n in enumerate(sizes) if n > budget // 2]  # others fit beside any system turn
            pieces = dict(zip(long, count.pieces([escape(turns[i][1]) for i in long]), strict=True))
            for i, ((conv, section, kind), (role, text), size) in enumerate(zip(keys, turns, sizes, strict=True)):
                if last != (conv, section):
                    if last is not None and w.new:
                        rows.append(w.close())
                    w.begin(conv, section)
                    last = (conv, section)
                if kind == OWN:
                    rows += w.add(role, text, size, pieces.get(i))
                else:
                    w.carry(kind, (role, text, size), pieces.get(i))
                held += len(text)
                if rows and held > 4 << 20:
                    yield _window_batch(rows)
                    rows, held = [], 0
        if last is not None and w.new:
            rows.append(w.close())
        yield _window_batch(rows)

    return run


def _ranked(batches):
    """Rows with the task's number and their number within their conversation in the task."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        at = []
        for c in b.column("conv_id").to_pylist():
            n = n + 1 if (c,) == last else 0
            last = (c,)
            at.append(n)
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("conv_id", "role", "text")), pa.array([task] * len(at), pa.int64()), pa.array(at, pa.int64())], ["conv_id", "role", "text", "task", "at"])


def _in_sections(turns: DataFrame, budget: int, history: int, tokenizer: str, section: int, scratch: Scratch) -> DataFrame:
    """conv_id, section, kind, rank, turn, role, text; ``turns`` as they are where none is long."""
    plain = turns.select("conv_id", F.lit(0).cast("long").alias("section"), F.lit(OWN).alias("kind"), F.lit(0).cast("long").alias("rank"), "turn", "role", "text")
    long = scratch.table(turns.groupBy("conv_id").agg(F.count("*").alias("_n")).where(F.col("_n") > section), "long")
    if long.isEmpty():
        return plain
    same = turns["conv_id"].eqNullSafe(long["conv_id"])
    order = ["conv_id", "turn", "role", "text", "_row"]  # equal rows are told apart, so that no task gets all of them
    rows = turns.join(long, same, "left_semi").withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = scratch.table(rows.mapInArrow(_ranked, "conv_id long, role string, text string, task long, at long"), "ranked")
    counts = rows.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("task").alias("_t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    rank = (F.col("at") + F.col("_before")).cast("long")
    rows = rows.join(counts, rows["conv_id"].eqNullSafe(F.col("_c")) & (F.col("task") == F.col("_t"))).select("conv_id", "role", "text", rank.alias("rank"))
    rows = scratch.table(rows, "in-order")
    kept = rows.where((F.col("rank") == 0) & (F.col("role") == "system")).mapInArrow(_heads(budget, history, tokenizer), "conv_id long, head int, cut boolean")
    kept = kept.select(F.col("conv_id").alias("_k"), "head", "cut")
    sized = rows.join(kept, rows["conv_id"].eqNullSafe(F.col("_k")), "left").drop("_k")
    sized = sized.mapInArrow(_sized(budget, history, tokenizer), "conv_id long, rank long, system boolean, size int, parts array<int>")
    spark = turns.sparkSession
    scanned = sized.repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "rank").mapInArrow(_starts(budget, history, section), "conv_id long, block long, start long")
    starts = scratch.table(scanned, "starts")  # at most one a run of ``section`` turns, and one for each run's first turn
    runs = starts.groupBy("conv_id", "block").agg(F.max("start").alias("start"))
    before = F.max(F.when(F.col("start").isNotNull(), F.col("block"))).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    runs = scratch.table(runs.select(F.col("conv_id").alias("_c"), F.col("block").alias("_block"), "start", before.alias("_before")), "runs")
    block = F.floor(F.col("rank") / section).cast("long")
    placed = rows.join(runs, rows["conv_id"].eqNullSafe(F.col("_c")) & (block == F.col("_block")))
    own_section = F.when(F.col("rank") >= F.col("start"), F.col("_block")).otherwise(F.col("_before"))
    shape = lambda df, at, kind: df.select("conv_id", at.cast("long").alias("section"), F.lit(kind).alias("kind"), "rank", F.lit(None).cast("long").alias("turn"), "role", "text")
    own = shape(placed, own_section, OWN)
    cuts = runs.where("start > 0").select("_c", "_block", F.explode(F.sequence(F.greatest(F.col("start") - history, F.lit(0)), F.col("start") - 1)).alias("_rank")) if history else runs.limit(0).select("_c", "_block", F.col("start").alias("_rank"))
    has_system = kept.select(F.col("_k"), F.lit(True).alias("_s"))
    past = rows.join(cuts, rows["conv_id"].eqNullSafe(F.col("_c")) & (F.col("rank") == F.col("_rank"))).join(has_system, rows["conv_id"].eqNullSafe(F.col("_k")), "left")
    past = shape(past.where((F.col("rank") > 0) | F.col("_s").isNull()), F.col("_block"), HISTORY)
    first = rows.where((F.col("rank") == 0) & (F.col("role") == "system"))
    system = shape(first.join(runs.where("start > 0"), first["conv_id"].eqNullSafe(F.col("_c"))), F.col("_block"), SYSTEM)
    return plain.join(long, plain["conv_id"].eqNullSafe(long["conv_id"]), "left_anti").union(own).union(past).union(system)


def _heads(budget: int, history: int, tokenizer: str):
    """What is retained of system turns, in tokens, and whether that is less than the turn."""

    def run(batches):
        count = token_counter(tokenizer)
        w = Windows(budget, history, count)
        for b in batches:
            turns = [(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            sizes = turn_sizes(turns, count)
            pieces = [count.pieces([escape(t)])[0] if n > budget // 2 else None for (_, t), n in zip(turns, sizes, strict=True)]
            heads = [w._head(r, t, n, p)[2] for (r, t), n, p in zip(turns, sizes, pieces, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(heads, pa.int32()), pa.array([h < n for h, n in zip(heads, sizes, strict=True)], pa.bool_())], ["conv_id", "head", "cut"])

    return run


def _sized(budget: int, history: int, tokenizer: str):
    """Tokens of each turn and of the last parts of one too long for its window; a cut system turn's begin with its head."""

    def run(batches):
        count = token_counter(tokenizer)
        w = Windows(budget, history, count)
        for b in batches:
            turns = [(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            sizes, parts = turn_sizes(turns, count), []
            system = []
            for (role, text), n, rank, head, cut in zip(turns, sizes, *(b.column(c).to_pylist() for c in ("rank", "head", "cut")), strict=True):
                mine = rank == 0 and role == "system"
                room = budget - (0 if head is None or (mine and not cut) else head)
                own = [t[2] for t in w._parts(role, text, room, count.pieces([escape(text)])[0])][-max(history, 1) - 1 :] if n > room else []
                parts.append([head, *own] if mine and cut else own)
                system.append(mine)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("rank"), pa.array(system, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int32()))], ["conv_id", "rank", "system", "size", "parts"])

    return run


def _starts(budget: int, history: int, section: int):
    """Per conversation and run of ``section`` turns the first turn at which a window starts, if there is one, and a row without."""

    def run(batches):
        w, last, done = Sizes(budget, history, lambda texts: [0] * len(texts)), None, -1
        for b in batches:
            out: list[tuple] = []
            for conv, rank, system, size, parts in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rank", "system", "size", "parts")), strict=True):
                if last != (conv,):
                    w.begin(conv)
                    last, done = (conv,), -1
                started = w.fill("system" if system else "", size, parts) or rank == 0
                block = rank // section
                if rank % section == 0:
                    out.append((conv, block, None))
                if started and block > done:
                    out.append((conv, block, rank))
                    done = block
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["conv_id", "block", "start"])

    return run


def format_chats(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 2, section: int = SECTION, scratch: Scratch | None = None) -> DataFrame:
    """Windows of ``turns`` (conv_id, turn, role, text): conv_id, section, window, continues,
    n_repeated, n_turns, tokens, text, loss (spans of code points); in the order of section and window.
    """
    if budget < 64:
        raise ValueError("a budget of 64 tokens or more is needed")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = _in_sections(rows, budget, history, tokenizer, section, scratch or Scratch(turns.sparkSession, "chat"))
    dealt = rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id", "section")
    dealt = dealt.sortWithinPartitions("conv_id", "section", "kind", "rank", "turn", "role", "text")
    return dealt.select("conv_id", "section", "kind", "role", "text").mapInArrow(_format(budget, history, tokenizer), _WINDOW)


def _read_back(batches):
    """Per conversation the digests of its turns and of its loss texts."""
    out, conv, state, begun = [], None, None, False

    def done():
        n, turns, chars, loss, size = state
        turns.update(b"\n")  # the end of the last turn
        return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)

    for b in batches:
        for r in b.to_pylist():
            if not begun or r["conv_id"] != conv:
                if begun:
                    out.append(done())
                conv, state, begun = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            for i, (role, text) in enumerate(parse_window(r["text"])[r["n_repeated"] :]):
                if i or not r["continues"]:
                    state[1].update(("\n" if state[0] else "").encode() + f"{role}\n".encode())
                    state[0] += 1
                state[1].update(text.encode())
            for span in r["loss"]:
                own = unescape(r["text"][span["start"] : span["end"]])
                state[2] += len(own)
                state[3].update(own.encode())
            state[4] += len(r["text"])
    if begun:
        out.append(done())
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_chats(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted windows.

    A digest of a whole conversation is one stream by its nature; its task keeps one window.
    """
    dealt = windows.repartition(shuffle_partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "section", "window")
    return dealt.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_windows(turns: DataFrame, tokenizer: str, budget: int = 2048, history: int = 2) -> DataFrame:
    """As ``format_chats``, written and ready to read back."""
    scratch = Scratch(turns.sparkSession, "chat")
    return scratch.table(format_chats(turns, tokenizer, budget, history, scratch=scratch), "windows")
