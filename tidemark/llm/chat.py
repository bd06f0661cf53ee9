"""Operator 9: chat formatting with minimum-cost repair of roles.

The legal turns are an automaton: perhaps one system turn, then user and assistant in turn, user first. A conversation
that it does not accept is repaired at the least cost by merging turns into the one before, giving turns another role, or
inserting empty turns. The cost is found by dynamic programming over turns and states; equal costs go to the choice that
comes first in the order of MOVES.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions, runs

ROLES = ("system", "user", "assistant")
#: What may follow: nothing yet, or the last turn's role.
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("user", "assistant")
MERGE, INSERT, RELABEL, NAME = 1.0, 2.0, 3.0, 1.0
OUT = "conv_id bigint, n_turns int, n_merged int, n_relabelled int, n_inserted int, cost double, rendered string"


def _inserted(state: str, role: str) -> tuple[str, ...] | None:
    """The fewest turns to insert after `state` so that `role` may follow; None if it never may."""
    paths = [((), state)]
    for _ in range(len(NEXT)):
        for path, at in paths:
            if role in NEXT[at]:
                return path
        paths = [((*path, r), r) for path, at in paths for r in NEXT[at]]
    return None


#: For each state: (given role, insertions) of a turn that is not merged, in the order of preference.
MOVES = {state: [(role, path) for role in ROLES if (path := _inserted(state, role)) is not None] for state in NEXT}


def repair(roles: tuple[str | None, ...]) -> tuple[float, tuple[tuple[str, bool, tuple[str, ...]], ...], tuple[str, ...]]:
    """(cost, steps, closing): for each turn its role, whether it is merged and the turns inserted before it; then at the end.

    A turn whose role is none of ROLES needs a role at the cost NAME; another role for a known one costs RELABEL.
    """
    best: dict[str, float] = {"": 0.0}
    back: list[dict[str, tuple]] = []
    for role in roles:
        now: dict[str, float] = {}
        how: dict[str, tuple] = {}
        for state, cost in best.items():
            choices = [(x, False, path) for x, path in MOVES[state]] + ([(state, True, ())] if state else [])
            for x, merged, path in choices:
                total = cost + (0 if x == role else RELABEL if role in ROLES else NAME) + MERGE * merged + INSERT * len(path)
                if x not in now or total < now[x]:
                    now[x], how[x] = total, (state, x, merged, path)
        best = now
        back.append(how)
    ends = []
    for state, cost in best.items():
        path = () if state in FINAL or not roles else _closing(state)
        ends.append((cost + INSERT * len(path), state, path))
    total, state, closing = min(ends, key=lambda e: e[0])
    steps = []
    for how in reversed(back):
        before, x, merged, path = how[state]
        steps.append((x, merged, path))
        state = before
    return total, tuple(reversed(steps)), closing


#: Short conversations repeat the same roles; long ones are worked out each time, so the cache stays small.
_repair_short = functools.lru_cache(maxsize=20_000)(repair)


def _closing(state: str) -> tuple[str, ...]:
    paths = [((r,), r) for r in NEXT[state]]
    while True:
        for path, at in paths:
            if at in FINAL:
                return path
        paths = [((*path, r), r) for path, at in paths for r in NEXT[at]]


def rendered(turns: list[tuple[str, str]]) -> str:
    """Turns in the im_start form; the markers' opening is broken where a text holds it."""
    return "".join(f"<|im_start|>{role}\n{text.replace('<|im_', '< |im_')}<|im_end|>\n" for role, text in turns)


def formatted(turns: list[tuple[str | None, str]]) -> tuple[int, int, int, int, float, str]:
    """(turns, merged, relabelled, inserted, cost, text) of one conversation's (role, text) in order."""
    known = tuple(r.strip().lower() if r is not None and r.strip().lower() in ROLES else None for r, _ in turns)
    cost, steps, closing = (_repair_short if len(known) <= 32 else repair)(known)
    out: list[list[str]] = []
    merged = relabelled = inserted = 0
    for (_, text), own, (role, joined, path) in zip(turns, known, steps, strict=True):
        relabelled += role != own
        inserted += len(path)
        merged += joined
        out += [[x] for x in path]
        if joined:
            out[-1].append(text)
        else:
            out.append([role, text])
    out += [[x] for x in closing]
    inserted += len(closing)
    return len(out), merged, relabelled, inserted, cost, rendered([(r, "\n\n".join(x for x in parts if x)) for r, *parts in out])


def _conversation(group: pa.Table) -> tuple:
    rows = list(zip(group.column("turn").to_pylist(), group.column("role").to_pylist(), group.column("text").to_pylist(), strict=True))
    once = [r for i, r in enumerate(rows) if not i or r != rows[i - 1]]
    return (group.column("conv_id")[0].as_py(), *formatted([(role, text or "") for _, role, text in once]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _format(alone: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (pa.Table.from_batches([b.slice(i, 1)]) for b in batches for i in range(b.num_rows)) if alone else runs(batches, ["conv_id"])
        rows, held = [], 0
        for group in each:
            rows.append(_conversation(group))
            held += len(rows[-1][-1])
            if held > 4_000_000 or len(rows) >= 5000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row (conv_id, n_turns, n_merged, n_relabelled, n_inserted, cost, rendered) for each conversation of
    turns (conv_id, turn, role, text).

    Turns are in the order of turn, null first, then role and text; rows that repeat all three are one turn. Roles are
    compared without case and blanks around them; a null or unknown role is given one. A null text is an empty one. A row
    without conv_id is a conversation of its own. A conversation ends with a user's or an assistant's turn. An empty
    table gives an empty result; other columns are not read. The turns of a conversation meet in one task, as its
    rendered text is one value; conversations are spread by their ids.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    named = rows.where("conv_id IS NOT NULL").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return named.mapInArrow(_format(False), OUT).unionAll(rows.where("conv_id IS NULL").mapInArrow(_format(True), OUT))
