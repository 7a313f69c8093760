"""The cheapest edits of a conversation, and of those the first in the order of their initials.

A conversation is read from left to right in one of four states: nothing so far, a system turn,
a user turn, an assistant turn. In front of each row and at the end turns may be inserted; each
row is kept, given another role, or deleted. A node is a row with the state before it. From a node
each initial leads to one other node only (a new turn's role follows from the state), so the
nodes that an audit passes are known from its letters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state after an inserted turn or one with a new role.
ADDED = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INSERT_COST, DELETE_COST, ROLE_COST, TRUNCATED_COST = 5, 2, 1, 5
#: Faults of rows; a blank or repeated row has to go.
SOUND, TRUNCATED, GONE = range(3)
_KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_INITIALS = "sua"
#: What it costs from each state to end here, with what must be inserted.
END_COSTS = (0, 2 * INSERT_COST, INSERT_COST, 0)
FAR = 1 << 60


def code_of(role: str, fault: int) -> int:
    """A row, as far as its edits are concerned."""
    return (_INITIALS.find(role[:1]) % 4 if role else 3) * 3 + fault


def _edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Initial, cost and next state of what can be done with a row, by initial."""
    initial, fault = _INITIALS[code // 3 : code // 3 + 1], code % 3
    found = [("D", DELETE_COST, state)]
    if fault != GONE:
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if state in _KEPT.get(initial, {}):
            found.append(("K", more, _KEPT[initial][state]))
        found.append(("R", more + ROLE_COST, ADDED[state]))
    return found


EDITS = [[_edits(code, state) for state in range(STATES)] for code in range(12)]
_D, _I = ord("D"), ord("I")


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs from each state if turns may be inserted first; two lead to every state that any
    number leads to."""
    once = [costs[ADDED[s]] + INSERT_COST for s in range(STATES)]
    twice = [costs[ADDED[ADDED[s]]] + 2 * INSERT_COST for s in range(STATES)]
    return list(map(min, costs, once, twice))


def costs_back(codes: Sequence[int], end: Sequence[int]) -> list[list[int]]:
    """For each row, and after the last, what it costs from each state on to the end."""
    layers = [list(end)]
    for code in reversed(codes):
        after = layers[-1]
        own = [min(cost + after[to] for _, cost, to in edits) for edits in EDITS[code]]
        layers.append(_with_inserts(own))
    return layers[::-1]


def moves(codes: Sequence[int]) -> list[int]:
    """What it costs to get over the rows, from each state to each; ``FAR`` or more: no way."""
    ways = [costs_back(codes, [0 if s == end else FAR for s in range(STATES)])[0] for end in range(STATES)]
    return [min(ways[end][start], FAR) for start in range(STATES) for end in range(STATES)]


def arcs(codes: Sequence[int], layers: list[list[int]], ends: bool) -> tuple[list[int], list[int], list[int]]:
    """Node, initial and target of each arc of a cheapest path. Node 4 i + s is row i in state s.
    ``ends``: the conversation ends with these rows, so turns may be inserted after the last."""
    node, letter, target = [], [], []
    for i, here in enumerate(layers):
        last = i == len(codes)
        if last and not ends:
            break
        for s, cost in enumerate(here):
            if here[ADDED[s]] + INSERT_COST == cost:
                node.append(STATES * i + s), letter.append(_I), target.append(STATES * i + ADDED[s])
            if last:
                continue
            after = layers[i + 1]
            for initial, own, to in EDITS[codes[i]][s]:
                if own + after[to] == cost:
                    node.append(STATES * i + s), letter.append(ord(initial)), target.append(STATES * (i + 1) + to)
    return node, letter, target


def _chosen(size: int, node: np.ndarray, letter: np.ndarray, target: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's least arc, by its letter and then the rank of its target; a node without
    arcs has letter 0 and leads to itself."""
    by = np.lexsort((rank[target], letter, node))
    node, letter, target = node[by], letter[by], target[by]
    first = np.concatenate(([True], node[1:] != node[:-1]))[: len(node)]
    letters, after = np.zeros(size, np.int64), np.arange(size)
    letters[node[first]], after[node[first]] = letter[first], target[first]
    return letters, after


def least_paths(
    size: int, node: np.ndarray, letter: np.ndarray, target: np.ndarray, starts: np.ndarray
) -> list[tuple[str, np.ndarray]]:
    """The audit of the least path from each start, and the nodes it passes, the last included.

    Nodes are ranked by the first letter of their least path, then by the first two, four, eight:
    the rank by twice as many letters follows from the rank of a node and that of the node that
    its pointer leads to, and pointers double with it. When all pointers have come to an end,
    ranks are those of whole paths; each node takes the arc with the least letter and then the
    least rank behind it, and the doubled pointers tell the node after any number of letters.
    The arcs of a node must differ in their letters, so that no prefix has two ends.
    """
    if len(np.unique(node * 256 + letter)) < len(node):
        raise ValueError("two arcs of a node share a letter")
    letters, after = _chosen(size, node, letter, target, np.zeros(size, np.int64))
    rank, jumps, steps = np.unique(letters, return_inverse=True)[1], [after], (letters > 0).astype(np.int64)
    while letters[jumps[-1]].any():
        ahead = jumps[-1]
        rank = np.unique(rank * size + rank[ahead], return_inverse=True)[1]
        steps = steps + steps[ahead]
        jumps.append(ahead[ahead])
    letters, _ = _chosen(size, node, letter, target, rank)
    # A place for each letter and one for the end.
    sizes = steps[starts] + 1
    ends = np.cumsum(sizes)
    place = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
    at = np.repeat(starts, sizes)
    for k, jump in enumerate(jumps):
        some = place >> k & 1 == 1
        at[some] = jump[at[some]]
    audit = letters[at].astype(np.uint8).tobytes().decode()
    return [(audit[b - n : b - 1], at[b - n : b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]


def solve(
    pieces: Sequence[tuple[Sequence[int], Sequence[int], bool, Sequence[int]]]
) -> list[list[tuple[int, str, list[int]]]]:
    """For each piece ``codes, end, ends, entries``: the least path from each entry state, as its
    cost, its audit and the states it passes."""
    parts, starts, costs, size = [], [], [], 0
    for codes, end, ends, entries in pieces:
        layers = costs_back(codes, end)
        node, letter, target = (np.array(x, np.int64) for x in arcs(codes, layers, ends))
        parts.append((node + size, letter, target + size))
        starts += [size + s for s in entries]
        costs.append(layers[0])
        size += STATES * len(layers)
    if not pieces:
        return []
    found = iter(least_paths(size, *map(np.concatenate, zip(*parts, strict=True)), np.array(starts, np.int64)))
    return [
        [(cost[s], audit, (at % STATES).tolist()) for s in entries for audit, at in (next(found),)]
        for cost, (*_, entries) in zip(costs, pieces, strict=True)
    ]


def repaired(audit: str, states: Sequence[int], rows: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Role and text of the turns that an audit makes of rows; ``states`` are those it passes."""
    done, at = [], 0
    for letter, after in zip(audit, states[1:], strict=True):
        if letter == "I":
            done.append((ROLES[after], ""))
            continue
        role, text = rows[at]
        at += 1
        if letter != "D":
            done.append((role if letter == "K" else ROLES[after], text))
    return done


def states_of(audit: str, entry: int, roles: Sequence[str]) -> list[int]:
    """The states that an audit passes from ``entry`` on."""
    states, at = [entry], 0
    for letter in audit:
        state = states[-1]
        if letter == "K":
            states.append(_KEPT[roles[at][:1]][state])
        else:
            states.append(state if letter == "D" else ADDED[state])
        at += letter != "I"
    return states
