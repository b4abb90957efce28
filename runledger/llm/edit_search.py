"""Cheapest edits of a conversation by iterative-deepening A* (part of operator 13).

A row is one letter of a code: its role's initial (``s``, ``u``, ``a`` or any other) and its
fault. Edits walk the automaton of ``(s?(ua)+)?``; its states are named by what was put out
last. Long codes are searched in segments, which meet through small tables of costs.
"""

from __future__ import annotations

import math

#: States: nothing yet, after ``s``, after ``u``, after ``a``.
STATES = START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The role that an insertion or a new role has in each state, and the state after it.
WANTED = ("user", "user", "assistant", "user")
THEN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEEP_S, KEEP_U, KEEP_A, OTHER = range(4)
SOUND, REMOVED, TRUNCATED = range(3)
#: Letter of (role, fault) is at ``3 * role + fault``.
LETTERS = "abcdefghijkl"
RETELL, DELETE, INSERT, UNTRIMMED = 1, 2, 5, 5
#: Insertions that a state still needs at the end of a conversation, as costs.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Rows that one search covers.
SEGMENT = 64


def kept(state: int, role: int) -> int | None:
    """The state after a row that keeps its role, or None if the order forbids it."""
    if role == KEEP_S:
        return AFTER_S if state == START else None
    if role == KEEP_U:
        return None if state == AFTER_U else AFTER_U
    if role == KEEP_A:
        return AFTER_A if state == AFTER_U else None
    return None


def search(code: str, entry: int, exits: tuple) -> tuple[int, str, int]:
    """Cost, edits and last state of the cheapest way through ``code`` from ``entry``.

    ``exits`` is what it costs to go on from each state behind the last row; some finite
    state must be within reach. Edits are tried in ASCII order under a bound that rises to
    the least cost above it, so the first accepting path is the ASCII-least of the cheapest.
    ``failed`` keeps, for a row and state, the largest budget known not to suffice; it holds
    under every bound, and serves as a better estimate than the rest of the faults alone.
    """
    rows = [divmod(LETTERS.index(c), 3) for c in code]
    rest = [0] * (len(rows) + 1)
    rest[-1] = min(exits)
    for i in range(len(rows) - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if rows[i][1] else 0)
    failed: dict[tuple[int, int], float] = {}
    edits: list[str] = []
    over = math.inf

    def walk(i: int, state: int, budget: float) -> int | None:
        """The last state of an accepting path within ``budget``; its edits are in ``edits``."""
        nonlocal over
        need = max(rest[i], failed.get((i, state), -1) + 1)
        if need > budget:
            over = min(over, need - budget)
            return None
        if i == len(rows):
            if exits[state] <= budget:
                return state
            over = min(over, exits[state] - budget)
            return None
        role, fault = rows[i]
        late = UNTRIMMED if fault == TRUNCATED else 0
        steps = [("D", i + 1, state, DELETE), ("I", i, THEN[state], INSERT)]
        if fault != REMOVED:
            same = kept(state, role)
            if same is not None:
                steps.append(("K", i + 1, same, late))
            steps.append(("R", i + 1, THEN[state], RETELL + late))
        for edit, row, to, cost in steps:
            edits.append(edit)
            last = walk(row, to, budget - cost)
            if last is not None:
                return last
            edits.pop()
        failed[i, state] = max(budget, failed.get((i, state), -1))
        return None

    bound = rest[0]
    while True:
        over = math.inf
        last = walk(0, entry, bound)
        if last is not None:
            return bound, "".join(edits), last
        bound += over


def reachable(code: str, entry: int, last: int) -> bool:
    """Whether any edits lead from ``entry`` through ``code`` to ``last``."""
    if last == START:
        return entry == START
    if last == AFTER_S:
        return entry == AFTER_S or (entry == START and any(divmod(LETTERS.index(c), 3) in ((KEEP_S, SOUND), (KEEP_S, TRUNCATED)) for c in code))
    return True


def segments(code: str) -> list[str]:
    return [code[at : at + SEGMENT] for at in range(0, len(code), SEGMENT)]


def costs(code: str) -> list[list[float]]:
    """Least cost from each state before ``code`` to each state behind it."""
    total = [[0 if p == q else math.inf for q in STATES] for p in STATES]
    for part in segments(code):
        only = [tuple(0 if p == q else math.inf for p in STATES) for q in STATES]
        step = [[search(part, p, only[q])[0] if reachable(part, p, q) else math.inf for q in STATES] for p in STATES]
        total = [[min(total[p][m] + step[m][q] for m in STATES) for q in STATES] for p in STATES]
    return total


def before(cost: list[list[float]], after: tuple) -> tuple:
    """What it costs to go on from each state before a code with ``cost``."""
    return tuple(min(cost[p][q] + after[q] for q in STATES) for p in STATES)


def solve(code: str, entry: int, after: tuple) -> tuple[float, str, int]:
    """``search`` for a code of any length: cost with what follows, edits and last state."""
    parts = segments(code)
    goals = [after]
    for part in reversed(parts[1:]):
        goals.append(before(costs(part), goals[-1]))
    state, edits, total = entry, [], after[entry]
    for n, (part, goal) in enumerate(zip(parts, reversed(goals), strict=True)):
        cost, found, state = search(part, state, goal)
        edits.append(found)
        if not n:
            total = cost
    return total, "".join(edits), state
