"""Minimum vertex cut of an alignment graph: the cheapest tokens through which every match passes."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable


def minimum_vertex_cut(edges: list[tuple[Hashable, Hashable]], cost: dict[Hashable, int], source: Hashable, sink: Hashable) -> set[Hashable]:
    """Nodes of least total cost whose removal parts source from sink; nodes without a cost cannot be cut.

    Each node is split in two, joined by an edge of its cost; shortest augmenting paths then
    give a maximum flow, and the cut is where it is saturated. Graphs are of a needle's tokens: small.
    """
    free = sum(cost.values()) + 1
    room: dict[tuple, dict[tuple, int]] = {}

    def link(a: tuple, b: tuple, size: int) -> None:
        room.setdefault(a, {}).setdefault(b, 0)
        room.setdefault(b, {}).setdefault(a, 0)
        room[a][b] += size

    nodes = {x for e in edges for x in e} | {source, sink}
    for node in nodes:
        link((node, 0), (node, 1), free if node in (source, sink) else cost.get(node, free))
    for a, b in edges:
        link((a, 1), (b, 0), free)

    def reach() -> dict[tuple, tuple | None]:
        came: dict[tuple, tuple | None] = {(source, 0): None}
        queue = deque(came)
        while queue:
            a = queue.popleft()
            for b, size in room[a].items():
                if size > 0 and b not in came:
                    came[b] = a
                    queue.append(b)
        return came

    while (end := (sink, 1)) in (came := reach()):
        path = []
        while (before := came[end]) is not None:
            path.append((before, end))
            end = before
        flow = min(room[a][b] for a, b in path)
        if flow >= free:
            raise ValueError("no cut: an uncuttable path joins source and sink")
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow
    return {n for n in nodes if (n, 0) in came and (n, 1) not in came}


def needle_graph(needle: str, tokens: dict[str, int]) -> tuple[list[tuple], dict, dict[tuple[int, int], list[str]]]:
    """How dictionary tokens can cover an occurrence of ``needle`` in a token stream: edges, costs, and the tokens of each node.

    A node (a, b) stands for all tokens that can lie over the needle from place a to place b: a cut takes all of them or none, so
    their frequencies add up, and the graph is as small as the needle, whatever the dictionary. Between nodes are the places, which
    cannot be cut; a path from "begin" to "end" is one way in which a row can hold the needle.
    """
    size, cost, members = len(needle), {}, {}
    for token, frequency in tokens.items():
        for at in range(1 - len(token), size):
            a, b = max(at, 0), min(at + len(token), size)
            if token[a - at : b - at] == needle[a:b]:
                members.setdefault((a, b), []).append(token)
                cost[a, b] = cost.get((a, b), 0) + frequency
    place = {0: "begin", size: "end"}
    edges = [e for a, b in cost for e in ((place.get(a, ("place", a)), (a, b)), ((a, b), place.get(b, ("place", b))))]
    return edges, cost, members


def cover(needle: str, tokens: dict[str, int]) -> set[str]:
    """Tokens of which every row that holds ``needle`` has at least one. Empty if no row can hold it."""
    edges, cost, members = needle_graph(needle, tokens)
    if not any(b == "end" for _, b in edges):
        return set()
    return {token for node in minimum_vertex_cut(edges, cost, "begin", "end") for token in members[node]}
