"""Chat formatting: minimum-cost repair of roles over a legal-turn automaton, then rendering.

Legal is: a system turn at most, at the start; then user and assistant by turns, with the assistant's last. Each input turn is kept,
relabelled, merged into the turn before it, or put behind an empty inserted turn; at the end missing turns are inserted empty. Dynamic programming
from the end gives the least cost from every state; from the start, the first option in the order of OPTIONS that reaches it is taken, so the repair is unique.

Conversations lie in range partitions ordered by conversation and turn, and one may go on over many partitions. Only the first and the
last conversation of a partition can. For these, each part's costs between states (a 4 x 4 table) are brought together first, two parts for a
partition at most, then the states in which parts begin; then all partitions are repaired independently.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs.
KEEP, GUESS, MERGE, RELABEL, INSERT, MERGE_RELABEL = 0, 1, 2, 3, 4, 5
INFINITE = 1 << 60
UNKNOWN = 0


def role_state(role: str | None) -> int:
    """The state behind a turn of a role; UNKNOWN for roles that have none."""
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return ROLES.index(role) + 1 if role in ROLES else UNKNOWN


def _options() -> list[list[list[tuple[int, int, str, tuple[int, ...]]]]]:
    """[state][role] -> (cost, next state, action, turns that begin) in the order of preference."""
    out = []
    for state in range(4):
        row = []
        for role in range(4):
            found = []
            price = lambda q, role=role: GUESS if role == UNKNOWN else KEEP if q == role else RELABEL
            name = lambda q, role=role: "keep" if q == role else "relabel"
            for q in LEGAL[state]:
                found.append((price(q), q, name(q), (q,)))
            if state != START:
                same = role in (UNKNOWN, state)
                found.append((MERGE if same else MERGE_RELABEL, state, "merge" if same else "merge+relabel", ()))
            for p in LEGAL[state]:
                if p != SYSTEM:
                    for q in LEGAL[p]:
                        found.append((INSERT + price(q), q, "insert+" + name(q), (p, q)))
            row.append(found)
        out.append(row)
    return out


OPTIONS = _options()
#: Cost and turns to end in each state.
ENDING = [(2 * INSERT, (USER, ASSISTANT)), (2 * INSERT, (USER, ASSISTANT)), (INSERT, (ASSISTANT,)), (0, ())]
END_COST = [c for c, _ in ENDING]


def costs(roles: list[int], end: list[int]) -> tuple[list[int], list[list[int]]]:
    """The least cost from each state before the turns, and for each turn and state the option to take."""
    after, plan = end, []
    for role in reversed(roles):
        now, pick = [], []
        for state in range(4):
            best, at = INFINITE, 0
            for i, (cost, nxt, _, _) in enumerate(OPTIONS[state][role]):
                if cost + after[nxt] < best:
                    best, at = cost + after[nxt], i
            now.append(best)
            pick.append(at)
        plan.append(pick)
        after = now
    plan.reverse()
    return after, plan


def walk(roles: list[int], plan: list[list[int]], state: int) -> tuple[int, int]:
    """The state after the turns, and the number of turns begun."""
    turns = 0
    for role, pick in zip(roles, plan, strict=True):
        _, state, _, begun = OPTIONS[state][role][pick[state]]
        turns += len(begun)
    return state, turns


def opened(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


CLOSED = "<|end|>\n"


def repair(roles: list[int], texts: list[str | None], end: list[int] = END_COST, state: int = START, turns: int = 0, last: bool = True):
    """For each turn: action, role and number of the repaired turn it is in, cost, and its piece of the rendered conversation."""
    _, plan = costs(roles, end)
    out = []
    for i, (role, pick, text) in enumerate(zip(roles, plan, texts, strict=True)):
        cost, nxt, action, begun = OPTIONS[state][role][pick[state]]
        piece = []
        if begun:
            if state != START:
                piece.append(CLOSED)
            for k, q in enumerate(begun):
                piece += [opened(q), CLOSED if k + 1 < len(begun) else ""]
        else:
            piece.append("\n")
        piece.append(text or "")
        turns += len(begun)
        state = nxt
        number = turns
        if last and i + 1 == len(roles):
            extra, more = ENDING[state]
            cost += extra
            piece.append(CLOSED)
            piece += [opened(q) + CLOSED for q in more]
        out.append((action, ROLES[state - 1], number, cost, "".join(piece)))
    return out


RESULT = "conv long, turn long, role string, out_turn long, out_role string, action string, cost long, piece string"


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv, turn, role, out_turn (from 1), out_role, action, cost, piece.

    Joined by (conv, turn, role, text) the pieces are the rendered conversation. Turns of one number are ordered by role and text, nulls
    first; null texts are empty, null or unknown roles go where they cost least; turns of a null conversation are one conversation. Repeated rows are turns of their own;
    conversation and turn are long numbers; other columns are not read."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    keys = ["conv", "turn", "role", F.xxhash64("text"), "text"]
    dealt = rows.repartitionByRange(*keys[:4]).sortWithinPartitions("conv", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)

    def parts(batches):
        """(part, conversation, rows) of a partition, one conversation at a time."""
        held, key, rank = [], None, -1
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("part", "conv", "turn", "role", "text")]
            for part, conv, *rest in zip(*cols, strict=True):
                if held and (conv != key[1] or part != key[0]):
                    yield key, held
                    held = []
                key = part, conv
                held.append(rest)
        if held:
            yield key, held

    def edges(batches):
        """The first and last conversation of a partition with its costs between states."""
        before = None
        rows_out = []

        def told(key, held):
            roles = [role_state(r) for _, r, _ in held]
            table = [costs(roles, [0 if s == e else INFINITE for s in range(4)])[0] for e in range(4)]
            return *key, [min(c, INFINITE) for row in table for c in row]

        for key, held in parts(batches):
            if before is None or before[0][0] != key[0]:
                if before is not None and not before[2]:
                    rows_out.append(told(*before[:2]))
                rows_out.append(told(key, held))
                before = key, held, True
            else:
                before = key, held, False
        if before is not None and not before[2]:
            rows_out.append(told(*before[:2]))
        if rows_out:
            part, conv, table = zip(*rows_out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(conv, pa.int64()), pa.array(table, pa.list_(pa.int64()))], names=["part", "conv", "costs"])

    # Two rows for each partition at most.
    ends = [(r["part"], r["conv"], r["costs"]) for r in dealt.mapInArrow(edges, "part int, conv long, costs array<long>").collect()]
    chains: dict = {}
    for part, conv, table in sorted(ends, key=lambda e: e[0]):
        chains.setdefault(conv, []).append((part, table))
    chains = {k: v for k, v in chains.items() if len(v) > 1}
    after: dict = {}
    for conv, chain in chains.items():
        end = END_COST
        for part, table in reversed(chain):
            after[part, conv] = end
            end = [min(table[4 * e + s] + end[e] for e in range(4)) for s in range(4)]
    begin: dict = {}
    if chains:
        spark = turns.sparkSession
        after_b = spark.sparkContext.broadcast(after)

        def steps(batches):
            for (part, conv), held in parts(batches):
                end = after_b.value.get((part, conv))
                if end is not None:
                    roles = [role_state(r) for _, r, _ in held]
                    _, plan = costs(roles, end)
                    to = [walk(roles, plan, s) for s in range(4)]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([conv], pa.int64()), pa.array([[x for t in to for x in t]], pa.list_(pa.int64()))], names=["part", "conv", "to"])

        known = {(r["part"], r["conv"]): r["to"] for r in dealt.mapInArrow(steps, "part int, conv long, to array<long>").collect()}
        for conv, chain in chains.items():
            state, count = START, 0
            for i, (part, _) in enumerate(chain):
                begin[part, conv] = state, count, i + 1 == len(chain)
                to = known[part, conv]
                state, count = to[2 * state], count + to[2 * state + 1]
    plan_b = turns.sparkSession.sparkContext.broadcast((after, begin))

    def run(batches):
        after, begin = plan_b.value
        cols: list[list] = [[] for _ in range(8)]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["conv", "turn", "role", "out_turn", "out_role", "action", "cost", "piece"]
        for (part, conv), held in parts(batches):
            state, count, last = begin.get((part, conv), (START, 0, True))
            done = repair([role_state(r) for _, r, _ in held], [t for *_, t in held], after.get((part, conv), END_COST), state, count, last)
            for (turn, role, _), (action, out_role, number, cost, piece) in zip(held, done, strict=True):
                for c, v in zip(cols, (conv, turn, role, number, out_role, action, cost, piece), strict=True):
                    c.append(v)
            if len(cols[0]) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
                cols = [[] for _ in range(8)]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return dealt.mapInArrow(run, RESULT)
