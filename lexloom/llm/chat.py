r"""Chat formatting into budgeted windows.

A conversation becomes one or more windows of at most ``budget`` tokens.  Prefix
sums of the turns' tokens choose spans of whole turns; every window repeats the
system turn(s) that open the conversation and, between them and its new turns, as
many of the turns just before as fit into ``history`` tokens.  The loss mask holds
the texts of new assistant turns only, so each is a target once.

A turn is written ``### role: text</turn>`` and a line end.  In roles and texts a
backslash goes before every ``\``, ``#``, ``<`` and ``:`` of a role, so neither can
hold a marker, and dropping those backslashes restores them.

Conversations stream through sorted partitions: memory holds one window, however
long a conversation is.  (The digest of a conversation is sequential by nature, so
its turns pass through one task.)  Defined results: null texts are empty; a null
role is written empty; turns are ordered by turn, then role and text, nulls first;
repeated rows are repeated turns; a turn longer than the budget gets a window to
itself; rows with null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import tune

BUDGET = 1024
HISTORY = 256
#: Tokens of a turn's markers.
MARKERS = 4

_TOKEN = re.compile(r"\w+|[^\w\s]")
_MARK = re.compile(r"[\\#<]")
_ROLE_MARK = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)

WINDOW_SCHEMA = "conv_id long, window int, formatted string, loss array<struct<start:long,end:long>>, n_repeated int, n_tokens long"


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_MARK if role else _MARK).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def tokens(text: str) -> int:
    return len(_TOKEN.findall(text)) + MARKERS


def write_turns(turns: list[tuple[str, str]], new: int) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask; turns from ``new`` on are new."""
    out, at, loss = [], 0, []
    for i, (role, text) in enumerate(turns):
        head, body = f"### {escape(role, True)}: ", escape(text)
        if i >= new and role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class _Conversation:
    def __init__(self, budget: int, history: int):
        self.budget, self.limit = budget, history
        self.system, self.kept, self.new = [], [], []  # (role, text, tokens)
        self.window, self.total, self.start, self.body = 0, 0, 0, False

    def _cost(self, turns) -> int:
        return sum(t[2] for t in turns)

    def add(self, role: str, text: str):
        turn = (role, text, tokens(text))
        if role == "system" and not self.body:
            self.system.append(turn)
            return
        self.body = True
        # self.total and self.start are prefix sums at the next turn and at the first new one
        if self.new and self._cost(self.system) + self._cost(self.kept) + self.total + turn[2] - self.start > self.budget:
            yield self.take()
            room = min(self.limit, self.budget - self._cost(self.system) - turn[2])
            last, kept = self.kept + self.last, []
            for t in reversed(last):
                if t[2] > room:
                    break
                room -= t[2]
                kept.append(t)
            self.kept, self.start = kept[::-1], self.total
        self.new.append(turn)
        self.total += turn[2]

    def take(self):
        repeated = (len(self.system) if self.window else 0) + len(self.kept)
        # In the first window the system turns are new; they come first, and there is no history yet.
        turns = self.system + self.kept + self.new
        formatted, loss = write_turns([t[:2] for t in turns], repeated)
        out = (self.window, formatted, [{"start": a, "end": b} for a, b in loss], repeated, self._cost(turns))
        self.last, self.new = self.new, []
        self.window += 1
        return out

    def close(self):
        if self.new or (self.system and not self.window):
            yield self.take()


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (spans in code points), n_repeated (turns seen before), n_tokens."""
    tune(conversations.sparkSession)
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        conv, now, out = None, None, []

        def rows():
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_repeated", pa.int32()), ("n_tokens", pa.int64())])
        names = schema.names
        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if now is None or c != conv:
                    out += [dict(zip(names, (conv, *w))) for w in (now.close() if now else ())]
                    conv, now = c, _Conversation(budget, history)
                out += [dict(zip(names, (c, *w))) for w in now.add(role, text)]
            if len(out) >= 200:
                yield rows()
                out = []
        out += [dict(zip(names, (conv, *w))) for w in (now.close() if now else ())]
        yield rows()

    return dealt.mapInArrow(run, WINDOW_SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the windows back (they come together and in order): one row per conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches):
        state, out = None, []

        def shut():
            conv, n, turns, chars, loss, size, count = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count))

        for b in batches:
            for conv, text, loss, repeated in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "loss", "n_repeated"))):
                if state is None or state[0] != conv:
                    if state:
                        shut()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if state:
            shut()
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
