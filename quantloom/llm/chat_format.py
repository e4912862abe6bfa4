r"""Chat formatting: minimum-cost repair of the roles of a conversation, then rendering.

A legal conversation is one optional system turn, then user and assistant in turn, from user to
assistant. Every given turn is kept, relabelled (to any role) or merged into the turn before it,
and empty turns are inserted where the automaton wants one. Dynamic programming over
the automaton's states finds the cheapest repair: a turn is a matrix of least costs from state to
state, and a conversation is their product in the algebra of minimum and sum.

The product is associative, so a conversation of any length is solved in pieces. Rows are range
partitioned by (conv_id, turn) into parts of about PART rows; a part gives one small matrix for each of
its conversations that reaches over its edge (two at most), those matrices give the states at the edges,
and then every part is solved by itself. No task holds a whole long conversation.

Costs: keep 0, merge 1, relabel 2, insert an empty turn 3; a turn without role, or with one that is none of
the three, costs 2 whatever it becomes. Equal costs: the smaller number of the state before, and of
moves the one that comes first in MOVES.

Defined cases: null text is an empty text; null turns come first, then equal turns by role and text;
repeated rows are turns of their own; a null conv_id is a conversation; roles are compared
trimmed and lower-cased; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

ROLES = ("system", "user", "assistant")
KEEP, MERGE, RELABEL, INSERT = 0, 1, 2, 3
PART = 4096
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
FAR = 1 << 40

#: From a state, the empty turns to insert and the state of the new turn, without its own cost.
LEGAL = {
    START: {SYSTEM: (), USER: (), ASSISTANT: ("user",)},
    SYSTEM: {USER: (), ASSISTANT: ("user",)},
    USER: {ASSISTANT: (), USER: ("assistant",)},
    ASSISTANT: {USER: (), ASSISTANT: ("user",)},
}
#: (state before, state after, empty turns inserted, whether the turn is merged), in order of choice.
MOVES = [(s, t, put, False) for s, to in LEGAL.items() for t, put in sorted(to.items())] + [(s, s, (), True) for s in (SYSTEM, USER, ASSISTANT)]
#: Cost at the end of the conversation: it ends with an assistant's turn.
END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
END_TURNS = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}

REPAIRED = "conv_id long, turn long, position long, role string, role_out string, action string, before array<string>, after array<string>, rendered string"


def move_cost(move: tuple, role: str | None) -> int:
    """Cost of a turn with that role (one of ROLES, or None) under a move."""
    _, after, put, merged = move
    name = ROLES[after - 1]
    return INSERT * len(put) + (MERGE if merged else KEEP) + (0 if role == name else RELABEL)


def _matrices() -> dict:
    out = {}
    for role in (None, *ROLES):
        m = np.full((STATES, STATES), FAR, np.int64)
        for move in MOVES:
            m[move[0], move[1]] = min(m[move[0], move[1]], move_cost(move, role))
        out[role] = m
    return out


MATRICES = _matrices()


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the algebra of minimum and sum."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)


def product(roles: list) -> np.ndarray:
    """The matrix of a run of turns."""
    total = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for role in roles:
        total = times(total, MATRICES[role])
    return total


def best_path(roles: list, first: int, last: int) -> list[tuple]:
    """The cheapest moves for the turns from state first to state last."""
    costs = [np.where(np.arange(STATES) == first, 0, FAR)]
    for role in roles:
        costs.append(np.minimum((costs[-1][:, None] + MATRICES[role]).min(0), FAR))
    moves, state = [], last
    for role, before in zip(reversed(roles), reversed(costs[:-1]), strict=True):
        options = [(before[m[0]] + move_cost(m, role), m[0], i) for i, m in enumerate(MOVES) if m[1] == state]
        moves.append(MOVES[min(options)[2]])
        state = moves[-1][0]
    return moves[::-1]


def render_turn(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}<|end|>\n"


def repair(conversations: DataFrame, part_rows: int = PART) -> DataFrame:
    """Rows of REPAIRED, one for each turn given.

    before and after are the roles of empty turns inserted around it (after only at the end of a
    conversation); rendered are the characters that the turn, with those, adds to the rendered
    conversation: put together by position, they are that conversation. A merged turn continues the
    one before it on a new line, so the mark that ends a turn stands before the next one or at the end.
    """
    role = F.lower(F.trim("role"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"),
        F.when(role.isin(*ROLES), role).alias("known"), F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = max(1, -(-rows.count() // part_rows))
    order = ["conv_id", "turn", "role", "text"]
    salt = F.rand(7)  # only deals equal rows over the parts; they are alike wherever they come
    dealt = rows.withColumn("salt", salt).repartitionByRange(parts, *order, "salt").sortWithinPartitions(*order, "salt")
    dealt = stored(dealt.select(*order, "known", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "chat-parts")

    def edges(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """For the first and last conversation of a part: the matrix of its turns there."""
        group = group.sort_values("seq")
        conv = group["conv_id"].astype("Int64")
        out = []
        for c in dict.fromkeys([conv.iloc[0], conv.iloc[-1]]):
            own = group[conv.isna() if pd.isna(c) else (conv == c).fillna(False)]
            out.append((key[0], None if pd.isna(c) else int(c), len(own), product([r or None for r in own["known"]]).ravel().tolist()))
        return pd.DataFrame(out, columns=["part", "conv", "n", "matrix"]).astype({"conv": "Int64"})

    found = dealt.select("conv_id", "known", "part", "seq").groupBy("part").applyInPandas(edges, "part int, conv long, n long, matrix array<long>")
    # At most two rows a part: the parts are as many as the rows over PART. States at the edges come from their prefix products.
    runs = stored(_edge_states(found), "chat-edges")
    held = dealt.join(runs.select(F.col("part").alias("in_part"), F.col("conv").alias("in_conv"), "first", "last", "offset", "final"), (F.col("part") == F.col("in_part")) & F.col("conv_id").eqNullSafe(F.col("in_conv")), "left")

    def solve(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", ignore_index=True)
        out = []
        for _, own in group.groupby("conv_id", dropna=False, sort=False):
            out += _solved(own.to_dict("list"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in REPAIRED.split(", ")]).astype({"conv_id": "Int64", "turn": "Int64"})

    return held.groupBy("part").applyInPandas(solve, REPAIRED)


def _solved(own: dict) -> list[tuple]:
    """Rows of REPAIRED for the turns of one conversation in one part."""
    roles = [r or None for r in own["known"]]
    whole = pd.isna(own["first"][0])
    first, offset, final = (START, 0, True) if whole else (int(own["first"][0]), int(own["offset"][0]), bool(own["final"][0]))
    last = int(np.argmin(product(roles)[START] + np.array([END[s] for s in range(STATES)]))) if whole else int(own["last"][0])
    out = []
    for i, move in enumerate(best_path(roles, first, last)):
        before_state, state, put, merged = move
        name = ROLES[state - 1]
        after = END_TURNS[state] if final and i == len(roles) - 1 else ()
        action = "merge" if merged else "keep" if roles[i] == name else "relabel"
        opened = "" if before_state == START and offset + i == 0 else "<|end|>\n"
        text = own["text"][i]
        body = "\n" + text if merged else opened + "".join(render_turn(r, "") for r in put) + f"<|{name}|>\n{text}"
        closed = "<|end|>\n" + "".join(render_turn(r, "") for r in after) if final and i == len(roles) - 1 else ""
        ids = [None if pd.isna(x) else int(x) for x in (own["conv_id"][i], own["turn"][i])]
        out.append((*ids, offset + i, own["role"][i], name, action, list(put), list(after), body + closed))
    return out


def _edge_states(found: DataFrame) -> DataFrame:
    """part, conv, first, last, offset, final for conversations at the edges of parts.

    A conversation over several parts is a chain of one small matrix for each: of a conversation
    with a thousand million turns, a group here has a quarter of a million rows of 16 numbers.
    """

    def chained(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        matrices = [np.array(m).reshape(STATES, STATES) for m in group["matrix"]]
        sizes = group["n"].tolist()
        reach = [np.where(np.arange(STATES) == START, 0, FAR)]
        for m in matrices:
            reach.append(np.minimum((reach[-1][:, None] + m).min(0), FAR))
        state = int(np.argmin(reach[-1] + np.array([END[s] for s in range(STATES)])))
        states = [state]
        for m, before in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
            state = int(np.argmin(before + m[:, state]))
            states.append(state)
        states.reverse()
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        n = len(group)
        return pd.DataFrame({"part": group["part"].to_numpy(), "conv": group["conv"].astype("Int64").to_numpy(), "first": states[:-1], "last": states[1:], "offset": offsets, "final": [i == n - 1 for i in range(n)]}).astype({"conv": "Int64"})

    return found.groupBy("conv").applyInPandas(chained, "part int, conv long, first int, last int, offset long, final boolean")


def format_report(conversations: DataFrame) -> DataFrame:
    return repair(conversations)


def rendered(repaired: DataFrame) -> DataFrame:
    """conv_id, text: whole rendered conversations, for conversations short enough to be one value."""
    pieces = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda p: p["rendered"]), "").alias("text"))
