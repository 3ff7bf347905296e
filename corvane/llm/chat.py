"""Chat formatting in budgeted windows (operator 3).

A conversation longer than the budget becomes several training examples. The
tokens of its turns are summed up as they come; a window takes whole turns as
long as the sum since its first one stays within the budget. Every window begins with the
system turn. The last turns of the window before are repeated, up to a limit of
tokens, as context: what they hold of the assistant's words was a target there and is
masked here.

One shuffle brings a conversation's turns together in order; the rest is one
pass that keeps a window's turns in memory, however long the conversation is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import small_batches
from corvane.llm.tokens import VOCABULARY, encoding

START, END = "<|im_start|>", "<|im_end|>"


def plain(text: str) -> str:
    """``text`` with every mark in it broken by a blank after its "<": whoever reads the window finds only the marks of its turns."""
    while START in text or END in text:  # once, but for a mark inside a mark
        text = text.replace(START, f"< {START[1:]}").replace(END, f"< {END[1:]}")
    return text


class _Windows:
    """The windows of one conversation, as its turns come. A turn: (turn, role, text, tokens before the text, all tokens)."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: list[tuple] = []
        self.turns: list[tuple] = []
        self.sums = [0]
        self.new = self.number = 0
        self.last: tuple | None = None

    def add(self, turn: tuple) -> Iterator[dict]:
        if self.last == turn[:3]:
            return
        self.last = turn[:3]
        if turn[1] == "system":
            self.system.append(turn)
            self.budget -= turn[4]
            return
        total = self.sums[-1] + turn[4]
        if self.new < len(self.turns) and total - self.sums[0] > self.budget:
            yield self.window()
            self.new = len(self.turns)
            begin = min(self.new, bisect_left(self.sums, max(self.sums[-1] - self.history, total - self.budget)))
            self.turns, self.sums, self.new = self.turns[begin:], self.sums[begin:], self.new - begin
        self.turns.append(turn)
        self.sums.append(total)

    def end(self) -> Iterator[dict]:
        if self.new < len(self.turns) or self.system and not self.number:
            yield self.window()

    def window(self) -> dict:
        text, at, targets = [], 0, []
        for k, (_, role, said, head, n) in enumerate([*self.system, *self.turns]):
            text.append(f"{START}{role}\n{said}{END}\n")
            if role == "assistant" and k - len(self.system) >= self.new:
                targets.append({"start": at + head, "length": n - head - 1})
            at += n
        new = self.turns[self.new :]
        out = {
            "conv_id": self.conv, "window": self.number, "first_turn": new[0][0] if new else None, "last_turn": new[-1][0] if new else None, "history_turns": self.new,
            "n_tokens": at, "n_targets": sum(t["length"] for t in targets), "over_budget": self.sums[-1] - self.sums[0] > self.budget, "text": "".join(text), "targets": targets,
        }
        self.number += 1
        return out


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256, vocabulary: str = VOCABULARY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a window: ``conv_id, window, first_turn, last_turn, history_turns, n_tokens, n_targets, over_budget, text, targets``.

    ``text``: the window rendered, each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Its tokens are those of the parts
    (both marks are one token each), ``n_tokens`` in all, at most ``budget``. ``targets``: (start, length) in tokens of what
    the loss counts, the text and end mark of the assistant turns that are new here. ``first_turn`` and ``last_turn`` are the new ones;
    ``history_turns`` before them are repeated, of at most ``history`` tokens, fewer if else the first new turn wouldn't fit.

    A turn that exceeds the budget alone with the system turn stays whole, in a window of its own, with ``over_budget``.
    All system turns are kept, in front. Null conversations are left out; a null turn comes last, a null role is "user",
    a null text is empty. Marks within a text or a role are broken by a blank (``< |im_end|>``), and counted so. Turns of equal number are ordered by role and text; a row that repeats another counts once.
    A conversation of system turns alone is one window without new turns. No rows: no rows. Other columns aren't looked at.
    """
    small_batches(turns.sparkSession)
    kind, nth = turns.schema[conv_col].dataType.simpleString(), turns.schema[turn_col].dataType.simpleString()
    lean = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = lean.repartition("conv").sortWithinPartitions("conv", F.col("role") != "system", F.col("turn").asc_nulls_last(), "role", "text")
    schema = f"conv_id {kind}, window int, first_turn {nth}, last_turn {nth}, history_turns int, n_tokens long, n_targets long, over_budget boolean, text string, targets array<struct<start: long, length: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, now = encoding(vocabulary), None
        count = lambda s: len(enc.encode_ordinary(s))
        heads: dict[str, int] = {}
        tail = 1 + count("\n")
        out: list[dict] = []
        arrow = None
        for b in batches:
            if arrow is None:
                arrow = pa.schema([
                    ("conv_id", b["conv"].type), ("window", pa.int32()), ("first_turn", b["turn"].type), ("last_turn", b["turn"].type), ("history_turns", pa.int32()), ("n_tokens", pa.int64()), ("n_targets", pa.int64()),
                    ("over_budget", pa.bool_()), ("text", pa.string()), ("targets", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                ])
            for conv, turn, role, text in zip(*(b[c].to_pylist() for c in ("conv", "turn", "role", "text"))):
                role, text = plain(role), plain(text)
                if now is None or conv != now.conv:
                    if now is not None:
                        out += now.end()
                    now = _Windows(conv, budget, history)
                if role not in heads:
                    heads[role] = 1 + count(f"{role}\n")
                out += now.add((turn, role, text, heads[role], heads[role] + count(text) + tail))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if now is not None and (out := [*now.end()]):
            yield pa.RecordBatch.from_pylist(out, arrow)

    return ordered.mapInArrow(run, schema)


def op3_chat_windows(spark, sf_dir: str) -> DataFrame:
    """Windows of all conversations; see :func:`chat_windows` for nulls, ties and repeated rows."""
    return chat_windows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
