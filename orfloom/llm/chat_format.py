"""Chat formatting in budgeted windows.

Running sums of turn tokens, counted by the tokenizer, cut a conversation into
spans of whole turns: a span goes on as long as its turns, with the history that
its window repeats, stay within the budget.  A window is the system turn, the
last turns before the span as far as they fit into ``history`` tokens, and the
span; a turn that is larger than the budget is a window of its own.  The loss
mask covers the assistant texts of the span only: what a window repeats is not
a target again.

A conversation is dealt to tasks by blocks of BLOCK_TURNS turns, counted by
their places and not by their numbers, so one with very many turns is many
tasks.  A block's rows come sorted and are cut as
they come, with one window in memory; a block that is not the first is sent the
system turn and the turns before it that may be its history.  Only the last
span of a block can be short.

Template: ``<turn ROLE>\\nTEXT</turn>\\n``.  In texts and roles ``\\`` is written
``\\\\``, ``<`` is ``\\l`` and ``>`` in roles ``\\g``, so no text can hold a
control string, and reading is exact.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orfloom.llm import scratch

#: Tokens of a window without the system turn, and of its history; template tokens of a turn.
BUDGET, HISTORY, TURN_TOKENS = 1024, 256, 4
#: Turns in a block, blocks whose keys may be broadcast, and ranges of turn numbers in which a long conversation's turns are placed.
BLOCK_TURNS, BROADCAST_BLOCKS, RANGES = 1024, 100_000, 256

_UNESCAPE = {"\\\\": "\\", "\\l": "<", "\\g": ">"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lg]", lambda m: _UNESCAPE[m[0]], text)


def format_window(turns: list[tuple[bool, str, str]]) -> tuple[str, list[dict]]:
    """(text, mask) of (is a new turn, role, text) turns: mask has the new assistant texts' character spans."""
    out, mask, at = [], [], 0
    for new, role, text in turns:
        head, body = f"<turn {escape(role).replace('>', chr(92) + 'g')}>\n", escape(text)
        out += [head, body, "</turn>\n"]
        if new and role == "assistant":
            mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(out), mask


def parse_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    turns = []
    for part in text.split("<turn ")[1:]:
        role, body = part.split(">\n", 1)
        turns.append((unescape(role), unescape(body.removesuffix("</turn>\n"))))
    return turns


def _counter(tokenizer: str | None):
    """Texts -> tokens of their turns: by a tokenizer file, or, without one, a token for four bytes; the template's are added."""
    if tokenizer is None:
        return lambda texts: [-(-len(t) // 4) + TURN_TOKENS for t in texts]
    from orfloom.llm.packing import WordEncoder

    encoder = WordEncoder(tokenizer)
    return lambda texts: [b - a + TURN_TOKENS for bounds in [encoder.encode(texts)[1].tolist()] for a, b in zip(bounds, bounds[1:])]


class _Cutter:
    """Cuts the sorted turns of one block into windows: (n_new, tokens, turns), turns as (is new, role, text)."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.opening = self.system = self.first = None  # the system turn while it is new, then as what windows repeat
        self.began = False
        self.past: list[tuple[int, str, str]] = []  # (tokens, role, text) before the span
        self.span: list[tuple[int, str, str]] = []
        self.used = 0  # tokens of the span and its window's history

    def mark(self, tokens: int, turn, role: str, text: str) -> None:
        """The block is not its conversation's first, which begins with this turn."""
        self.began = True
        if role == "system":
            self.system, self.first = (tokens, role, text), (turn, role, text)

    def carry(self, tokens: int, turn, role: str, text: str) -> None:
        """A turn before the block."""
        if (turn, role, text) != self.first:
            self.past.append((tokens, role, text))

    def add(self, tokens: int, role: str, text: str):
        """Take a turn; gives the window that ends before it, if any."""
        begins, self.began = not self.began, True
        if begins and role == "system":
            self.opening = (tokens, role, text)
            return None
        out = self.window() if self.span and self.used + tokens > self.budget else None
        if not self.span:
            room, held, n = min(self.history, self.budget - tokens), 0, 0
            while n < len(self.past) and held + self.past[-1 - n][0] <= room:
                held += self.past[-1 - n][0]
                n += 1
            self.past, self.used = self.past[len(self.past) - n :], held
        self.span.append((tokens, role, text))
        self.used += tokens
        return out

    def window(self):
        parts = [(True, [self.opening])] if self.opening else [(False, [self.system])] if self.system else []
        parts += [(False, self.past), (True, self.span)]
        turns = [(new, role, text) for new, own in parts for _, role, text in own]
        n_new, tokens = len(self.span) + bool(self.opening), sum(n for _, own in parts for n, _, _ in own)
        self.system, self.opening = self.opening or self.system, None
        self.past, self.span = self.past + self.span, []
        return n_new, tokens, turns

    def rest(self):
        return self.window() if self.span or self.opening else None


def _in_blocks(turns: DataFrame, size: int) -> DataFrame:
    """turns with ``block``: places in the conversation (whatever its turns' numbers) by ``size``.

    Only conversations of more than ``size`` turns are placed: they are cut into
    ranges of turn numbers of about equal counts, and a turn's place is the one
    in its range behind the ranges before.
    """
    id_ = ["none", "key"]
    long = turns.groupBy(*id_).count().where(F.col("count") > size).select(*id_)
    n = long.count()
    if not n:
        return turns.withColumn("block", F.lit(0).cast("long"))
    hint = F.broadcast if n <= BROADCAST_BLOCKS else (lambda df: df)
    number = F.coalesce("turn", F.lit(-(1 << 62)))
    cuts = F.percentile_approx(number, F.lit([k / RANGES for k in range(1, RANGES)]), F.lit(100 * RANGES))
    cuts = turns.join(hint(long), id_).groupBy(*id_).agg(F.array_distinct(cuts).alias("cuts"))
    rows = turns.join(hint(cuts), id_).withColumn("range", F.size(F.filter("cuts", lambda c: c < number))).drop("cuts")
    before = F.sum("count").over(Window.partitionBy(*id_).orderBy("range")) - F.col("count")  # at most RANGES rows a conversation
    counts = rows.groupBy(*id_, "range").count().withColumn("before", before).drop("count")
    place = F.row_number().over(Window.partitionBy(*id_, "range").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    rows = rows.withColumn("place", place).join(counts, [*id_, "range"])
    rows = rows.withColumn("block", F.floor((F.col("place") + F.col("before")) / size)).drop("place", "before", "range")
    return turns.join(hint(long), id_, "left_anti").withColumn("block", F.lit(0).cast("long")).unionByName(rows)


def format_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY,
    tokenizer: str | None = None, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row per window: conv_id, window (ascending in a conversation), n_new, n_tokens, text, mask array<struct<start, end>>.

    Rows of a conversation are ordered by turn (null first), then role and text;
    repeated rows are turns of their own.  The last n_new turns of a window's
    text are its span; before them come the system turn (a conversation's first
    turn, if its role is ``system``) and the repeated history.  n_tokens counts
    all of them, by the tokenizer file or, without one, a quarter of the bytes;
    history and span stay within the budget unless one turn alone is larger.  A
    null text or role is empty; a null id is a conversation; an empty table
    gives an empty result; further columns are not read.
    """
    scratch.small_batches(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    number = F.col(turn_col).cast("long")
    # Two columns instead of a null-safe key: a plain key keeps one partitioning through joins and sorts.
    t = turns.select(
        F.col(conv_col).isNull().alias("none"), F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("key"), F.col(conv_col).alias("conv"),
        number.alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    t = _in_blocks(t, block_turns)
    id_, at = ["none", "key"], ["none", "key", "block"]
    blocks = t.groupBy(*at).agg(F.max("turn").alias("last"))
    order = Window.partitionBy(*id_).orderBy("block")
    blocks = blocks.withColumn("next", F.lead("block").over(order)).withColumn("before", F.lag("block").over(order))
    # Only conversations of several blocks send anything on: usually few, and broadcast if so.
    ends, heads = blocks.where("next is not null").select(*at, "next"), blocks.where("before is null and next is not null").select(*at)
    small = ends.count() <= BROADCAST_BLOCKS
    hint = F.broadcast if small else (lambda df: df)
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text")
    first = t.join(hint(heads), at).groupBy(*id_).agg(F.min(place).alias("first"))
    marks = blocks.where("before is not null").select(*at).join(first, id_)
    marks = marks.select(*at, F.lit(0).alias("part"), F.col("first.turn").alias("turn"), F.col("first.role").alias("role"), F.col("first.text").alias("text"))
    latest = Window.partitionBy(*at).orderBy(F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    near = t.join(hint(ends), at).withColumn("n", F.row_number().over(latest)).where(F.col("n") <= max(1, history // TURN_TOKENS))
    carried = near.select(*id_, F.col("next").alias("block"), F.lit(1).alias("part"), "turn", "role", "text")
    every = t.select(*at, F.lit(2).alias("part"), "turn", "role", "text").unionByName(carried).unionByName(marks)

    def rows(batches):
        count = _counter(tokenizer)
        cutter, group, made, size, out = None, None, 0, 0, []
        names = ["none", "key", "block", "made", "n_new", "n_tokens", "text", "mask"]
        types = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = count([x.encode() for x in texts])
            columns = [batch.column(c).to_pylist() for c in ("none", "key", "block", "part", "turn", "role")]
            for none, key, block, part, turn, role, text, n in [*zip(*columns, texts, tokens)]:
                done = []
                if (none, key, block) != group:
                    if cutter is not None:
                        done.append((group, made, cutter.rest()))
                    group, cutter, made = (none, key, block), _Cutter(budget, history), 0
                if part == 0:
                    cutter.mark(n, turn, role, text)
                elif part == 1:
                    cutter.carry(n, turn, role, text)
                elif (window := cutter.add(n, role, text)) is not None:
                    done.append((group, made, window))
                    made += 1
                for own, k, (n_new, n_tokens, turns_) in (x for x in done if x[2]):
                    body, mask = format_window(turns_)
                    out.append((*own, k, n_new, n_tokens, body, mask))
                    size += len(body)
                if size > 8 << 20 or len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate(types)], names)
                    size, out = 0, []
        if cutter is not None and (window := cutter.rest()):
            body, mask = format_window(window[2])
            out.append((*group, made, *window[:2], body, mask))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], x) for i, x in enumerate(types)], names)

    schema = "none boolean, key string, block long, made long, n_new long, n_tokens long, text string, mask array<struct<start: long, end: long>>"
    sort = [*at, "part", F.asc_nulls_first("turn"), "role", "text"]
    cut = every.repartition(*at).sortWithinPartitions(*sort).mapInArrow(rows, schema)
    # Blocks come in order, and a block has fewer windows than turns.
    window = F.struct("block", "made")
    conv = F.when(~F.col("none"), F.col("key")).cast(kind)
    return cut.select(conv.alias(conv_col), window.alias("window"), "n_new", "n_tokens", "text", "mask")


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from its windows' texts and masks alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each new
    turn), loss_chars and loss_sha256 (unescaped text under the mask),
    formatted_chars.  A digest is sequential, so a conversation's windows come
    sorted to one task, which holds one window at a time.
    """
    kind = windows.schema[conv_col].dataType.simpleString()

    def rows(batches):
        conv, state = None, None

        def done():
            n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_pylist(
                [{"conv": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}],
                schema=schema,
            )

        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("conv", batch.schema.field("conv").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for c, n_new, text, mask in zip(*(batch.column(k).to_pylist() for k in ("conv", "n_new", "text", "mask"))):
                if state is None or c != conv:
                    if state is not None:
                        yield done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse_window(text)
                for role, body in turns[len(turns) - n_new :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for m in mask:
                    body = unescape(text[m["start"] : m["end"]])
                    state[2] += len(body)
                    state[3].update(body.encode())
                state[4] += len(text)
        if state is not None:
            yield done()

    src = windows.withColumnRenamed(conv_col, "conv").select("conv", "window", "n_new", "text", "mask")
    out = src.repartition("conv").sortWithinPartitions("conv", "window").mapInArrow(
        rows, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.withColumnRenamed("conv", conv_col)
