"""Repair of conversation structure: cheapest edits to alternating turns, by a dynamic programme over tensors.

A task gets conversations whole and in order.  Those of like length stand side
by side in one array of turn codes, time first.  Backwards over time, the least cost to
finish from each of four states (nothing yet, after system, after user, after
assistant) is found for all conversations at once and kept; forwards, all
conversations take the least edit letter whose cost agrees with what is kept.
The states are an automaton in which a letter settles the next state, so the
choice of the least letter at each step gives the least string of letters.

A conversation of more than LONG rows is cut into blocks of BLOCK rows, dealt out
by range, so no task holds it.  A block is a 4 x 4 matrix of least costs from
state to state; the (few) matrices of a conversation give the costs at each
block's end, each block is then traced from all four states, and the states met
are followed from block to block.  Only what is one value by contract, the letters and the running
hash of the repaired text, passes through one task, in order and block by block.

Defined results: a null role or text is one space, a null turn comes first and
has one space for its name; rows of equal turn stand by role and text; rows without a conversation id
are one conversation; a role whose first letter is not s, u or a can only be changed or
deleted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm.common import few
from noteloom.tables import written

# Fixed values of the contract: costs of the edits, and what the states are.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the next user or assistant turn, which each state allows only one of.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Codes of a row: initial (s, u, a, other), then flags.
OTHER, MUST_GO, CUT_OFF, PAD = 3, 4, 8, 16
NEVER = 1 << 40
#: Turns of a tensor, bytes of text that a task holds, rows of a block, and rows above which a conversation is cut into blocks.
CELLS, HELD_BYTES, BLOCK, LONG = 1 << 18, 32 << 20, 4096, 16_384

# --- the programme -------------------------------------------------------------------------------


def _rows(code: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs from each state of deleting, keeping and renaming a row; ``after``: costs behind it, (conversations, 4)."""
    late = ((code & CUT_OFF) > 0)[:, None] * TRUNCATED
    must = ((code & MUST_GO) > 0)[:, None]
    first = code & 3
    gone = after + DELETE
    renamed = np.where(must, NEVER, after[:, NEXT] + RENAME + late)
    fits = NEXT[None, :] == (first + 1)[:, None]  # u and a where the state asks for them
    fits |= (first == 0)[:, None] & (np.arange(4) == START)[None, :]
    kept = np.where(fits & ~must, np.take_along_axis(after, np.minimum(first + 1, 3)[:, None], 1) + late, NEVER)
    return gone, kept, renamed


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs when turns may be inserted first; two are enough to come from any state to any other that they reach."""
    for _ in range(3):
        cost = np.minimum(cost, cost[..., NEXT] + INSERT)
    return cost


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least cost to finish: (time + 1, conversations, 4), inserts at that time allowed.  ``codes``: (time, conversations); ``end``: costs behind the last row."""
    cost = np.empty((len(codes) + 1, *end.shape), dtype=np.int64)
    cost[-1] = _inserted(end)
    for t in range(len(codes) - 1, -1, -1):
        here = _inserted(np.minimum.reduce(_rows(codes[t], cost[t + 1])))
        cost[t] = np.where((codes[t] == PAD)[:, None], cost[t + 1], here)
    return cost


class Trace(NamedTuple):
    """Edit letters (0: none) and the roles' states after them, at (time + 1, three slots, conversations); the last states."""

    letters: np.ndarray
    states: np.ndarray
    last: np.ndarray


def trace(codes: np.ndarray, cost: np.ndarray, start: np.ndarray, to_end: bool = True) -> Trace:
    """Forwards from the states ``start``: at each time up to two inserted turns, then the row's own edit.

    ``to_end``: turns may be inserted behind the last row; else that is left to the next block.
    """
    time, n = codes.shape
    letters, states = np.zeros((time + 1, 3, n), np.uint8), np.zeros((time + 1, 3, n), np.int8)
    state, every = start.copy(), np.arange(n)
    for t in range(time + 1):
        if t == time and not to_end:
            break
        if t < time:
            gone, kept, renamed = _rows(codes[t], cost[t + 1])
            real = codes[t] != PAD
        for slot in range(3):
            best = cost[t, every, state]
            more = cost[t, every, NEXT[state]] + INSERT == best
            if t == time:
                # what is finished costs nothing more; a turn to insert always costs something
                insert = more & (best > 0)
                done = ~insert
            else:
                dropped = gone[every, state] == best
                insert = real & more & ~dropped & (slot < 2)
                done = ~insert
            if slot < 2:
                letters[t, slot, insert] = ord("I")
                state = np.where(insert, NEXT[state], state)
                states[t, slot] = state
            if done.all() or slot == 2:
                break
        if t == time:
            break
        best = cost[t, every, state]
        drop = gone[every, state] == best
        keep = ~drop & (kept[every, state] == best)
        letter = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
        after = np.where(drop, state, np.where(keep, np.minimum((codes[t] & 3) + 1, 3), NEXT[state]))
        letters[t, 2] = np.where(real, letter, 0)
        state = np.where(real, after, state)
        states[t, 2] = state
    return Trace(letters, states, state)


#: Costs behind the last row of a conversation: it may be empty or end with an assistant.
FINISHED = np.array([0, NEVER, NEVER, 0], dtype=np.int64)


def tensor(codes: list[np.ndarray]) -> np.ndarray:
    """Conversations side by side, time first, shorter ones padded behind their end."""
    out = np.full((max(map(len, codes)), len(codes)), PAD, np.int8)
    for k, c in enumerate(codes):
        out[: len(c), k] = c
    return out


def by_length(lengths: np.ndarray, cells: int = CELLS) -> Iterator[np.ndarray]:
    """Buckets of conversations of like length, none of more than ``cells`` turns (or one conversation)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        # of one power of two, so that at most half of a tensor is padding
        top = 1 << max(int(lengths[order[at]]) - 1, 0).bit_length()
        end = int(np.searchsorted(lengths[order], top, side="right"))
        end = min(end, at + max(1, cells // top))
        yield order[at:end]
        at = end


def repaired(trace_: Trace, k: int, roles: list[str], texts: list[str]) -> tuple[str, list[str]]:
    """Letters, and the lines ``role:text`` that are left, of one conversation of a trace."""
    letters = trace_.letters[:, :, k]
    audit, lines = [], []
    for t, slot in zip(*(x.tolist() for x in np.nonzero(letters))):
        letter = chr(letters[t, slot])
        audit.append(letter)
        if letter == "I":
            lines.append(f"{ROLES[int(trace_.states[t, slot, k])]}:")
        elif letter == "K":
            lines.append(f"{roles[t]}:{texts[t]}")
        elif letter == "R":
            lines.append(f"{ROLES[int(trace_.states[t, slot, k])]}:{texts[t]}")
    return "".join(audit), lines


# --- rows ----------------------------------------------------------------------------------------

#: White space by contract, to trim.
BLANKS = " \t\n\x0b\x0c\r"
RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: Pairs of initials of neighbours that are in order.
LEGAL = {(0, 1), (1, 2), (2, 1)}


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, here): rows after damage; a dropped row stays with here = false and without its text, so that its conversation is known."""
    own = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(name)
    plain = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), own(role_col, "role"), own(text_col, "text"), own(conv_col, "c"), own(turn_col, "t"))
    act = plain.withColumn("act", F.crc32(F.concat_ws(":", "c", "t").cast("binary")) % 20)
    text = F.when(F.col("act").isin(0, 1), "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("act") == 0, "").when(F.col("act") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("act") == 3, 2).otherwise(1).cast("int"))
    return act.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("act") != 0).alias("here"), F.explode(times).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with what each shows by itself: initial (0 to 3 for s, u, a, other), blank, cut."""
    trimmed, first = F.rtrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(OTHER).cast("byte")
    return rows.withColumns({"initial": initial, "blank": trimmed == "", "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})


class Conversation(NamedTuple):
    """Rows of one conversation, in order."""

    conv: object
    turns: list
    roles: list[str]
    texts: list[str]
    initials: list[int]
    blank: list[bool]
    cut: list[bool]


def faults_of(c: Conversation) -> tuple[np.ndarray, tuple[int, ...]]:
    """Codes of the rows, and (gaps, blank, duplicate, truncated, illegal)."""
    seen, codes, count = set(), np.array(c.initials, np.int8), [0, 0, 0, 0]
    for k, key in enumerate(zip(c.roles, c.texts)):
        kind = 0 if c.blank[k] else 1 if key in seen else 2 if c.cut[k] else 3
        seen.add(key)
        count[kind] += 1
        codes[k] += (MUST_GO, MUST_GO, CUT_OFF, 0)[kind]
    turns = {t for t in c.turns if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return codes, (gaps, *count[:3], sum(p not in LEGAL for p in zip(c.initials, c.initials[1:])))


def settled(held: list[Conversation]) -> Iterator[tuple]:
    """Rows of the result for conversations that a task holds together."""
    found = [faults_of(c) for c in held]
    for bucket in by_length(np.array([len(c.roles) for c in held])):
        codes = tensor([found[i][0] for i in bucket])
        cost = backward(codes, np.tile(FINISHED, (len(bucket), 1)))
        made = trace(codes, cost, np.zeros(len(bucket), np.int64))
        for k, i in enumerate(bucket):
            c = held[i]
            audit, lines = repaired(made, k, c.roles, c.texts)
            yield c.conv, *found[i][1], int(cost[0, k, START]), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), *(pa.array(c, pa.string()) for c in cols[7:])], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _in_order(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text")


def short_ones(rows: DataFrame) -> DataFrame:
    """The result for conversations that a task can hold: one exchange by conversation, then tensors of many at a time."""
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Conversation] = []
        turns = size = 0
        arrow = None
        for batch in batches:
            arrow = batch.column("conv").type
            for conv, turn, role, text, here, initial, blank, cut in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "here", "initial", "blank", "cut"))):
                if not held or held[-1].conv != conv:
                    if turns > CELLS or size > HELD_BYTES:
                        yield _table(list(settled(held)), arrow)
                        held, turns, size = [], 0, 0
                    held.append(Conversation(conv, [], [], [], [], [], []))
                if here:
                    for column, value in zip(held[-1][1:], (turn, role, text, initial, blank, cut)):
                        column.append(value)
                    turns, size = turns + 1, size + len(text)
        if held:
            yield _table(list(settled(held)), arrow)

    return _in_order(rows.repartition("conv")).mapInArrow(run, RESULT.format(id=kind.simpleString()))

# --- conversations that no task may hold ----------------------------------------------------------


def crossing(codes: np.ndarray) -> np.ndarray:
    """(blocks, 4, 4): least cost of each block from a state before its rows to a state behind them.  ``codes``: (time, blocks)."""
    time, n = codes.shape
    end = np.where(np.eye(4, dtype=bool), 0, NEVER)
    cost = backward(np.repeat(codes, 4, axis=1), np.tile(end, (n, 1)))[0]
    return np.minimum(cost.reshape(n, 4, 4).transpose(0, 2, 1), NEVER)


def behind(matrices: np.ndarray) -> np.ndarray:
    """Costs behind each of a conversation's blocks, in order."""
    out = np.empty((len(matrices), 4), np.int64)
    cost = FINISHED
    for k in range(len(matrices) - 1, -1, -1):
        out[k] = cost = _inserted(cost)
        cost = (matrices[k] + cost[None, :]).min(axis=1)
    return out


def numbered(rows: DataFrame, block: int) -> DataFrame:
    """Rows of long conversations in blocks: block numbers ascend in the order of the rows, seq within a block.

    Rows are dealt out by range, so a conversation lies in as many tasks as it needs.
    """
    schema = f"block long, seq int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seq, before = TaskContext.get().partitionId() << 40, -1, None
        for batch in batches:
            blocks, places = [], []
            for conv in batch.column("conv").to_pylist():
                if seq >= 0 and (conv != before or seq + 1 == block):
                    number, seq = number + 1, -1
                before, seq = conv, seq + 1
                blocks.append(number)
                places.append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), *batch.columns], ["block", "seq", *batch.schema.names])

    keys = (F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))
    return _in_order(rows.repartitionByRange(*keys)).mapInArrow(run, schema)


def long_ones(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The result for long conversations (rows that are here)."""
    kind = rows.schema["conv"].dataType.simpleString()
    rows = written(numbered(rows, block).withColumn("key", F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)), "turns")
    first = rows.groupBy("conv", "key").agg(F.min(F.struct("block", "seq")).alias("first"))
    keyed = rows.select("conv", "key", "block", "seq", "turn", "initial", "blank", "cut")
    same = keyed["conv"].eqNullSafe(first["conv"]) & (keyed["key"] == first["key"])
    fault = F.when(F.col("blank"), "blank").when(F.struct("block", "seq") != F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    flags = F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", CUT_OFF).otherwise(0)
    faulty = keyed.join(first, same).select(keyed["conv"], "block", "seq", "turn", "initial", fault.alias("fault"), (F.col("initial") + flags).cast("int").alias("code"))
    faulty = written(faulty, "faults")
    # a block has as many rows as ``block`` at most
    lists = F.transform(F.array_sort(F.collect_list(F.struct("seq", "code"))), lambda x: x["code"])
    blocks = written(faulty.groupBy("conv", "block").agg(lists.alias("codes")), "blocks")
    code_type, state_type = "conv {0}, block long, codes array<int>, ".format(kind), "block long, "

    def matrices(pdfs):
        for pdf in pdfs:
            if len(pdf):
                codes = [np.asarray(c, np.int8) for c in pdf["codes"]]
                cells = np.empty(len(codes), dtype=object)
                for part in by_length(np.array([len(c) for c in codes]), CELLS // 4):
                    for i, m in zip(part, crossing(tensor([codes[i] for i in part]))):
                        cells[i] = m.ravel().tolist()
                yield pdf.assign(matrix=cells)

    crossed = written(blocks.mapInPandas(matrices, code_type + "matrix array<long>"), "crossings")

    def costs(pdf):
        pdf = pdf.sort_values("block")
        cost = behind(np.stack([np.asarray(m).reshape(4, 4) for m in pdf["matrix"]]))
        return pdf[["block"]].assign(behind=[c.tolist() for c in cost], last=[False] * (len(pdf) - 1) + [True])

    # a row for each ``block`` turns of a conversation
    ends = crossed.select("conv", "block", "matrix").groupBy("conv").applyInPandas(costs, state_type + "behind array<long>, last boolean")
    followed = crossed.select("conv", "block", "codes").join(ends, "block")

    def traced(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                codes = np.repeat(np.asarray(r.codes, np.int8)[:, None], 4, axis=1)
                cost = backward(codes, np.tile(np.asarray(r.behind, np.int64), (4, 1)))
                made = trace(codes, cost, np.arange(4), bool(r.last))
                every = np.arange(4)
                yield pd.DataFrame({
                    "conv": pd.Series([r.conv] * 4, dtype=pdf["conv"].dtype), "block": r.block, "start": every, "finish": made.last, "cost": cost[0, every, every],
                    "letters": [made.letters[:, :, k].tobytes() for k in every], "states": [made.states[:, :, k].tobytes() for k in every],
                })

    pieces = written(followed.mapInPandas(traced, f"conv {kind}, block long, start int, finish int, cost long, letters binary, states binary"), "pieces")

    def follow(pdf):
        state, out = START, []
        finish = {(b, s): f for b, s, f in zip(pdf["block"], pdf["start"], pdf["finish"])}
        for b in sorted(set(pdf["block"])):
            out.append((b, state))
            state = finish[b, state]
        return pd.DataFrame(out, columns=["block", "start"])

    path = pieces.select("conv", "block", "start", "finish").groupBy("conv").applyInPandas(follow, "block long, start int")
    chosen = written(pieces.join(path, ["block", "start"]).select("conv", "block", "cost", "letters", "states"), "chosen")

    def lines(key, left, right):
        left = left.sort_values("seq")
        shape = (-1, 3, 1)
        made = Trace(np.frombuffer(right["letters"].iloc[0], np.uint8).reshape(shape), np.frombuffer(right["states"].iloc[0], np.int8).reshape(shape), np.zeros(1))
        audit, out = repaired(made, 0, left["role"].tolist(), left["text"].tolist())
        return pd.DataFrame({"conv": left["conv"].iloc[:1], "block": [key[0]], "audit": [audit], "text": ["\n".join(out)]})

    texts = rows.select("conv", "block", "seq", "role", "text").groupBy("block").cogroup(chosen.select("block", "letters", "states").groupBy("block"))
    written_blocks = written(texts.applyInPandas(lines, f"conv {kind}, block long, audit string, text string"), "repaired")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A running hash of one conversation after another; blocks come in order."""
        state, now, audit, any_line, open_ = None, None, [], False, False
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array(["".join(audit)]), pa.array([state.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])
        for batch in batches:
            arrow = batch.column("conv").type
            for conv, piece, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "text"))):
                if not open_ or conv != now:
                    if open_:
                        yield made()
                    state, now, audit, any_line, open_ = hashlib.sha256(), conv, [], False, True
                audit.append(piece)
                if text:
                    state.update((b"\n" if any_line else b"") + text.encode())
                    any_line = True
        if open_:
            yield made()

    one = written_blocks.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "block").mapInArrow(hashed, f"conv_id {kind}, audit string, repaired_sha256 string")
    # the first block's cost is the conversation's
    cost = chosen.groupBy("conv").agg(F.min_by("cost", "block").alias("cost"))
    count = lambda k: F.count(F.when(F.col("fault") == k, 1)).alias(k)
    turns = faulty.groupBy("conv", "turn").agg(*[count(k) for k in ("blank", "duplicate", "truncated")])
    seen = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("conv").agg(F.coalesce(seen, F.lit(0)).alias("gaps"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    # neighbours: within a block by position, across blocks by the least and the greatest place
    pairs = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda k: F.struct((F.element_at("codes", k) % 4).alias("l"), (F.element_at("codes", k + 1) % 4).alias("r")))
    wrong = lambda p: ~F.concat_ws(",", p["l"], p["r"]).isin(*[f"{a},{b}" for a, b in LEGAL])
    inner = F.when(F.size("codes") > 1, F.size(F.filter(pairs, wrong))).otherwise(0)
    edge = F.struct((F.lag(F.element_at("codes", -1)).over(Window.partitionBy("conv").orderBy("block")) % 4).alias("l"), (F.element_at("codes", 1) % 4).alias("r"))
    illegal = blocks.select("conv", inner.alias("inner"), edge.alias("edge")).groupBy("conv").agg(F.sum(F.col("inner") + F.when(F.col("edge.l").isNull(), 0).when(wrong(F.col("edge")), 1).otherwise(0)).alias("illegal"))
    out = one
    for t in (counts, illegal, cost):
        t = t.withColumnRenamed("conv", "c")
        out = out.join(t, out["conv_id"].eqNullSafe(t["c"])).drop("c")
    return out.select("conv_id", *[F.col(c).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], "audit", "repaired_sha256")


def repair_report(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", long: int = LONG, block: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after the contract's damage."""
    made = damaged(rows, conv_col, turn_col, role_col, text_col)
    size = made.groupBy("conv").agg(F.sum(F.col("here").cast("long")).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    named = written(size.filter((F.col("n") > long) | (F.col("bytes") > HELD_BYTES)).select(F.col("conv").alias("c")), "long")
    made = marked(made)
    if named.isEmpty():
        return short_ones(made)
    own = made["conv"].eqNullSafe(F.col("c"))
    named = few(named)
    return short_ones(made.join(named, own, "left_anti")).unionByName(long_ones(made.join(named, own, "left_semi").filter("here"), block))
