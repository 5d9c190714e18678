"""Chat formatting with minimum-cost role repair.

Legal conversations are those of an automaton: an optional system turn, then user and assistant in
turns, an assistant turn last. Dynamic programming over its states picks for every turn of a conversation
the cheapest of: keep it, relabel it, merge it into the turn before (same role after repair), and insert an
empty turn before it; a missing answer at the end is inserted as well. Of equally cheap repairs the one
is taken that, from the last turn back, is in the first state in the order of `STATES`, kept before
merged before after an insertion.

A conversation may hold a third of all rows: turns are dealt into parts by range of (conversation, turn),
so a long one lies in several parts. Costs of a part are a (min, +) matrix over the states; matrices are
combined along each conversation that crosses parts, of which a part has at most two.

The result has a row for each turn, besides inserted ones, in the order `ord`: a conversation's
`rendered` pieces joined in that order are its formatted text. Roles are compared in lower case, with
common names for the three known; a null or unknown role has to be relabelled. Null texts are empty,
null turns come last, repeated rows are turns of their own, and rows with a null conv_id make up one
conversation.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import materialize

STATES = ("start", "system", "user", "assistant")
ROLES = STATES[1:]
NAMES = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "gpt": 3, "bot": 3, "model": 3, "ai": 3}
RELABEL, MERGE, INSERT = 3, 1, 4
ROWS = 20_000
FAR = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
#: Legal next roles of each state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


class Step(NamedTuple):
    cost: int
    action: str
    before: tuple[int, ...]  # roles of empty turns put in before


def _steps() -> dict[tuple[int, int], Step]:
    """The cheapest way from state p to a turn of role q, without relabelling."""
    out = {}
    for p in range(4):
        for q in (1, 2, 3):
            ways = []
            if q in NEXT[p]:
                ways.append(Step(0, "keep", ()))
            if p == q:
                ways.append(Step(MERGE, "merge", ()))
            ways += [Step(INSERT, "keep", (x,)) for x in NEXT[p] if q in NEXT[x]]
            if ways:
                out[p, q] = min(ways, key=lambda w: (w.cost, w.action))
    return out


STEPS = _steps()
#: What closes a conversation that ends in each state, and its cost.
END = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def code(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), 0)


def move(p: int, q: int, role: int) -> int:
    s = STEPS.get((p, q))
    return FAR if s is None else s.cost + (0 if role == q else RELABEL)


MOVES = {r: np.array([[FAR if q == 0 else move(p, q, r) for q in range(4)] for p in range(4)], np.int64) for r in range(4)}


def transfer(roles: list[int]) -> np.ndarray:
    """Costs from each state to each over some turns."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + MOVES[r][None]).min(1), FAR)
    return m


def forward(start: np.ndarray, roles: list[int]) -> list[np.ndarray]:
    """Costs of reaching each state before the first turn and after every one."""
    out = [start]
    for r in roles:
        out.append(np.minimum((out[-1][:, None] + MOVES[r]).min(0), FAR))
    return out


def backward(costs: list[np.ndarray], roles: list[int], last: int) -> list[int]:
    """The states on the cheapest way that ends in `last`, the one before the first turn included."""
    states = [last]
    for k in range(len(roles) - 1, -1, -1):
        states.append(int((costs[k] + MOVES[roles[k]][:, states[-1]]).argmin()))
    return states[::-1]


def closing(costs: np.ndarray) -> int:
    return int((costs + np.array([INSERT * len(END[s]) for s in range(4)])).argmin())


BEGIN = np.array([0, FAR, FAR, FAR], np.int64)


def repair(roles: list[str | None]) -> list[tuple[str, str, tuple[str, ...]]]:
    """(role, action, roles inserted before) for every turn of one conversation; plain version for one list."""
    codes = [code(r) for r in roles]
    costs = forward(BEGIN, codes)
    states = backward(costs, codes, closing(costs[-1]))
    return [_decided(p, q, c) for p, q, c in zip(states, states[1:], codes)]


def _decided(p: int, q: int, c: int) -> tuple[str, str, tuple[str, ...]]:
    s = STEPS[p, q]
    action = s.action if s.action == "merge" else "keep" if c == q else "relabel"
    return STATES[q], action, tuple(STATES[x] for x in s.before)


def _sorted(t: pa.Table) -> tuple[pa.Table, list[tuple[int, int]]]:
    """A part in order, and the bounds of its conversations."""
    t = t.combine_chunks().sort_by([("conv_id", "ascending"), ("turn", "ascending"), ("seq", "ascending")])
    ids = t.column("conv_id").to_pylist()
    edges = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
    return t, list(zip(edges, edges[1:]))


def format_chats(turns: DataFrame, rows: int = ROWS) -> DataFrame:
    """conv_id, ord, turn, role (as given), new_role, action and rendered, for every turn and inserted turn."""
    count = turns.count()
    parts = max(1, -(-count // rows))
    base = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # equal turns of a conversation are told apart by role and text, so that their order is fixed
    keyed = base.withColumn("mark", F.xxhash64("role", "text"))
    ranged = keyed.repartitionByRange(parts, F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("mark")).withColumn("part", F.spark_partition_id())
    dealt = materialize(ranged.withColumnRenamed("mark", "seq"), "turns")
    kind = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    slim = dealt.select("part", "conv_id", "turn", "seq", "role")

    def edges(t: pa.Table) -> pa.Table:
        t, bounds = _sorted(t)
        roles = [code(r) for r in t.column("role").to_pylist()]
        keep = sorted({0, len(bounds) - 1})
        return pa.table(
            {
                "part": pa.array([t.column("part")[0].as_py()] * len(keep), pa.int32()),
                "last": pa.array([k == len(bounds) - 1 for k in keep]),
                "conv": t.column("conv_id").take(pa.array([bounds[k][0] for k in keep])),
                "costs": pa.array([transfer(roles[slice(*bounds[k])]).ravel().tolist() for k in keep], pa.list_(pa.int64())),
            }
        )

    # at most two rows for each part, whatever the size of a conversation
    found = slim.groupBy("part").applyInArrow(edges, f"part int, last boolean, conv {kind['conv_id']}, costs array<bigint>").collect()
    ends: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.part, r.last)):
        ends.setdefault(r.part, []).append(r)
    starts: dict[int, list[int]] = {}  # costs before a part's first conversation that began in an earlier part
    follows: set[int] = set()  # parts whose last conversation goes on in the next
    previous = None
    for part in sorted(ends):
        first = ends[part][0]
        if previous is not None and ends[previous][-1].conv == first.conv:
            follows.add(previous)
            tail = ends[previous][-1]
            begin = np.array(starts[previous], np.int64) if len(ends[previous]) == 1 and previous in starts else BEGIN
            starts[part] = np.minimum((begin[:, None] + np.array(tail.costs, np.int64).reshape(4, 4)).min(0), FAR).tolist()
        previous = part

    def backs(t: pa.Table) -> pa.Table:
        """Where a part that is entered by a conversation leads back to, for each state at that piece's end."""
        part = t.column("part")[0].as_py()
        t, bounds = _sorted(t)
        out: list[list[int]] = []
        if part in starts:
            roles = [code(r) for r in t.column("role").to_pylist()[slice(*bounds[0])]]
            costs = forward(np.array(starts[part], np.int64), roles)
            alone = len(bounds) == 1 and part in follows
            out.append([1 if alone else 0, closing(costs[-1]), *(backward(costs, roles, s)[0] for s in range(4))])
        return pa.table({"part": pa.array([part] * len(out), pa.int32()), "back": pa.array(out, pa.list_(pa.int64()))})

    crossing = [r.asDict() for r in slim.where(F.col("part").isin(list(starts))).groupBy("part").applyInArrow(backs, "part int, back array<bigint>").collect()] if starts else []
    back = {r["part"]: r["back"] for r in crossing}
    finish: dict[int, int] = {}  # the state in which a part's last conversation goes on in the next
    for part in sorted(back, reverse=True):
        goes_on, closed, *to = back[part]
        finish_here = finish[part] if goes_on else closed
        before = max(p for p in ends if p < part)
        finish[before] = to[finish_here]

    def decide(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        t, bounds = _sorted(t)
        given, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
        conv, turn = t.column("conv_id").to_pylist(), t.column("turn").to_pylist()
        out: list[tuple] = []
        for k, (a, b) in enumerate(bounds):
            codes = [code(r) for r in given[a:b]]
            entered, left = k == 0 and part in starts, k == len(bounds) - 1 and part in follows
            costs = forward(np.array(starts[part], np.int64) if entered else BEGIN, codes)
            states = backward(costs, codes, finish[part] if left else closing(costs[-1]))
            for n, (p, q, c) in enumerate(zip(states, states[1:], codes)):
                role, action, inserted = _decided(p, q, c)
                shut = "" if n == 0 and not entered else CLOSE
                for x in inserted:
                    out.append((conv[a + n], turn[a + n], None, x, "insert", shut + OPEN.format(x)))
                    shut = CLOSE
                text = ("\n" if action == "merge" else shut + OPEN.format(role)) + texts[a + n]
                out.append((conv[a + n], turn[a + n], given[a + n], role, action, text))
            if not left:
                for x in END[states[-1]]:
                    out.append((conv[b - 1], turn[b - 1], None, STATES[x], "insert", CLOSE + OPEN.format(STATES[x])))
                last = list(out[-1])
                out[-1] = (*last[:5], last[5] + CLOSE)
        columns = list(zip(*out))
        types = [t.schema.field("conv_id").type, t.schema.field("turn").type, *[pa.string()] * 4]
        made = [pa.array(c, k) for c, k in zip(columns, types)]
        order = pa.array([part << 32 | k for k in range(len(out))], pa.int64())
        return pa.table(dict(zip(("conv_id", "ord", "turn", "role", "new_role", "action", "rendered"), [made[0], order, *made[1:]])))

    schema = f"conv_id {kind['conv_id']}, ord bigint, turn {kind['turn']}, role string, new_role string, action string, rendered string"
    return dealt.groupBy("part").applyInArrow(decide, schema)
