"""Cheapest edits that bring a conversation's turns into the order ``(s?(ua)+)?`` of role initials.

Backward, a vector of four costs to go (one per grammar state) is carried from turn to turn; forward, a walk takes the
ASCII-least edit that the costs allow. A turn matters only by its code, and vectors only by their differences, of which
there are few, so a step is looked up after it was worked out once.
"""

from __future__ import annotations

from functools import lru_cache

#: Grammar states: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn's role begins with, and what is wrong with the turn; a code is 3 * role + fault.
ROLES, OK, TRUNCATED, UNWANTED = "sua", 0, 1, 2
OTHER = len(ROLES)
#: Costs of edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, LEFT_IN = 2, 3, 2, 1
#: Where the next user or assistant turn leads, and which turn that is.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
_LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 40
#: Costs to go after the last turn, and the edits that go there.
END, LAST_EDITS = (0, 4, 2, 0), ("", "II", "I", "")

Costs = tuple[int, int, int, int]


def code(role: str, fault: int) -> int:
    return 3 * ((ROLES.find(role[0]) if role[:1] and role[0] in ROLES else OTHER)) + fault


def legal(a: int, b: int) -> bool:
    """Whether a turn of role number ``b`` may follow one of ``a``."""
    return (a, b) in _LEGAL


@lru_cache(maxsize=1 << 16)
def _step(turn: int, after: Costs) -> tuple[Costs, tuple[tuple[str, int], ...]]:
    """(costs before a turn, edits and state after it by state before it), given the costs after it."""
    role, fault = divmod(turn, 3)
    more = LEFT_IN if fault == TRUNCATED else 0
    choices = []
    for q in range(4):
        here = {"D": (DELETE + after[q], q)}
        if fault != UNWANTED:
            if (to := _KEPT.get((q, role))) is not None:
                here["K"] = (more + after[to], to)
            here["R"] = (REROLE + more + after[NEXT[q]], NEXT[q])
        choices.append(here)
    alone = [min(c for c, _ in x.values()) for x in choices]
    costs = []
    for q in range(4):
        once = NEXT[q]
        costs.append(min(alone[q], INSERT + alone[once], 2 * INSERT + alone[NEXT[once]]))
    edits = []
    for q in range(4):
        told = ""
        if costs[q] >= FAR:
            edits.append(("", q))
            continue
        while True:
            tight = sorted(e for e, (c, _) in choices[q].items() if c == costs[q])
            if costs[q] == INSERT + costs[NEXT[q]] and (not tight or tight[0] > "I"):
                told, q = told + "I", NEXT[q]
                continue
            edits.append((told + tight[0], choices[q][tight[0]][1]))
            break
    return (min(costs[0], FAR), min(costs[1], FAR), min(costs[2], FAR), min(costs[3], FAR)), tuple(edits)


def step(turn: int, after: Costs) -> tuple[Costs, tuple[tuple[str, int], ...]]:
    low = min(after)
    costs, edits = _step(turn, tuple(x - low if x < FAR else FAR for x in after))
    return tuple(x + low if x < FAR else FAR for x in costs), edits


def costs_before(codes: bytes, after: Costs = END) -> Costs:
    for turn in reversed(codes):
        after, _ = step(turn, after)
    return after


def across(codes: bytes) -> list[int]:
    """16 costs from each state before the turns to each state after them, ``FAR`` where there is no way: rows by state
    before. They compose like matrices, with sums for products and least values for sums."""
    columns = [costs_before(codes, tuple(0 if k == q else FAR for k in range(4))) for q in range(4)]
    return [columns[q][p] for p in range(4) for q in range(4)]


def walk(codes: bytes, state: int = START, after: Costs = END) -> tuple[list[str], int]:
    """(edits of each turn with the insertions before it, state after all), ASCII-least among the cheapest."""
    steps = []
    for turn in reversed(codes):
        after, edits = step(turn, after)
        steps.append(edits)
    out = []
    for edits in reversed(steps):
        told, state = edits[state]
        out.append(told)
    return out, state


def rebuilt(turns: list[tuple[str, str]], edits: list[str], state: int) -> list[tuple[str, str]]:
    """The turns (role, text) that the edits leave; one more entry of edits than turns inserts at the end."""
    out = []
    for k, told in enumerate(edits):
        for e in told:
            if e == "K":
                role, text = turns[k]
                out.append((role, text))
                state = _KEPT[state, divmod(code(role, OK), 3)[0]]
            elif e in "IR":
                state = NEXT[state]
                out.append((NAMES[state], turns[k][1] if e == "R" else ""))
    return out
