"""Chat formatting into budgeted, turn-aligned windows.

Turns are dealt by conversation and sorted by turn; a task streams them, so it
never holds a conversation, only the open window.  Prefix sums of turn tokens
choose the spans: a window takes new turns while they fit into the budget next
to the system turn and a limited repeat of the latest history.  The loss mask
covers new assistant turns only, so a repeated target is never learnt twice.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``.  Control strings
inside roles and texts get a backslash after their first character and
backslashes are doubled, which ``unescape`` undoes.

Defined cases: null text or role counts as empty; turns that share a number are
ordered by role and text; a turn over the budget fills a window alone, whole; a system
turn of more than half the budget stands in the first window only;
rows without conversation id form one conversation of their own; an empty table
gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings of the template and of common chat formats.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: Production limits, in tokens (four UTF-8 bytes each); a longer share of the budget than this is not given to a repeated system turn.
BUDGET, HISTORY, SYSTEM_SHARE = 2048, 512, 0.5

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tokens(text: str) -> int:
    """Tokens that a text is charged: its UTF-8 bytes by four, rounded up, and one for the turn."""
    return (len(text.encode()) + 3) // 4 + 1


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the (start, length) of every turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        spans.append((at + len(head), len(body)))
        parts.append(head + body + END + "\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class Windows:
    """Turns of one conversation in, finished windows out.

    ``ends`` are the prefix sums of the held turns' tokens: turns i to j cost ends[j] - ends[i], so the
    spans of a window and of its repeated history are found by looking sums up.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.fixed, self.number = None, 0, 0
        self.held: list[tuple[str, str]] = []
        self.ends = [0]
        self.begin = self.opened = 0  # first repeated and first new turn among the held

    def add(self, role: str, text: str):
        cost = tokens(text)
        if self.opened < len(self.held) and self.fixed + self.ends[-1] - self.ends[self.begin] + cost > self.budget:
            yield self.close()
        if self.opened == len(self.held):
            # The repeat of history yields to the turn that opens the window.
            room = min(self.history, self.budget - cost - self.fixed)
            self.begin = bisect_left(self.ends, self.ends[self.opened] - room) if room > 0 else self.opened
        self.held.append((role, text))
        self.ends.append(self.ends[-1] + cost)

    def close(self):
        """The open window: number, turns repeated, text, loss spans."""
        repeated = ([self.system] if self.system else []) + self.held[self.begin:self.opened]
        new = self.held[self.opened:]
        formatted, spans = render(repeated + new)
        loss = [s for s, t in zip(spans[len(repeated):], new, strict=True) if t[0] == "assistant"]
        out = (self.number, len(repeated), formatted, loss)
        drop = bisect_left(self.ends, self.ends[-1] - self.history)
        if self.number == 0 and self.held[0][0] == "system":
            # It opens every later window, unless it would take more of them than SYSTEM_SHARE; it is no history.
            cost = self.ends[1] - self.ends[0]
            if cost <= SYSTEM_SHARE * self.budget:
                self.system, self.fixed = self.held[0], cost
            drop = max(drop, 1)
        self.held, self.ends = self.held[drop:], self.ends[drop:]
        self.opened, self.begin, self.number = len(self.held), 0, self.number + 1
        return out


WINDOW = "conv_id long, window long, repeated int, formatted string, loss array<struct<start:int,length:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def windows_of(budget: int, history: int):
    """Function for mapInArrow over turns sorted by conversation."""

    def made(batches):
        conv, open_ = None, None
        for b in batches:
            for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if open_ is None or c != conv:
                    if open_ is not None:
                        yield (conv, *open_.close())
                    conv, open_ = c, Windows(budget, history)
                for w in open_.add(r or "", t or ""):
                    yield (conv, *w)
        if open_ is not None:
            yield (conv, *open_.close())

    def run(batches):
        held, size = [], 0

        def batch():
            c, n, k, f, loss = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(f, pa.string()),
                 pa.array([[{"start": s, "length": m} for s, m in x] for x in loss], _LOSS)],
                names=["conv_id", "window", "repeated", "formatted", "loss"])

        for w in made(batches):
            held.append(w)
            size += len(w[3]) + 64
            if size > 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return run


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows: conv_id, window, repeated (turns that only give context), formatted, loss spans.

    A partition's windows are sorted by conversation and number.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(windows_of(budget, history), WINDOW))


def read_back(windows: DataFrame) -> DataFrame:
    """Parse windows (each conversation's in order, in one partition) and digest what they teach.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars; hashes
    run over the stream, so a long conversation needs no memory.
    """

    def run(batches):
        conv, begun, done = None, False, []
        turns = loss = None
        n = chars = total = 0

        def close():
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def batch():
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4]),
                 pa.array(cols[5], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, k, f, spans in zip(*(b.column(x).to_pylist() for x in ("conv_id", "repeated", "formatted", "loss")), strict=True):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, begun = c, True
                    turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text in parse(f)[k:]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in spans:
                    target = unescape(f[s["start"]:s["start"] + s["length"]])
                    loss.update(target.encode())
                    chars += len(target)
                total += len(f)
            if len(done) > 4096:
                yield batch()
        if begun:
            close()
        if done:
            yield batch()

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
