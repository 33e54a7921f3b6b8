"""The auction algorithm for shortest paths on lattices, and the paths that its prices expose.

A lattice is a list: for each node its arcs (label, cost, next node), ascending by label. Costs are whole and not negative,
every cycle costs something, and the labels of a node's arcs differ.
"""

from __future__ import annotations

from collections.abc import Sequence

Arcs = Sequence[Sequence[tuple[object, int, int]]]
UNREACHABLE = 1 << 60


def towards(arcs: Arcs, prices: Sequence[int], target: int) -> list[int]:
    """Feasible prices for one target: those given, 0 at the target, and UNREACHABLE where no way leads to it.

    Without the last the prices on a cycle that cannot be left would rise for ever.
    """
    back: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for _, _, nxt in out:
            back[nxt].append(node)
    found, waiting = {target}, [target]
    while waiting:
        for node in back[waiting.pop()]:
            if node not in found:
                found.add(node)
                waiting.append(node)
    return [0 if i == target else p if i in found else UNREACHABLE for i, p in enumerate(prices)]


def auction(arcs: Arcs, prices: list[int], origin: int, target: int) -> bool:
    """Raise `prices` until a path of tight arcs leads from `origin` to `target`; False if no way does.

    Prices have to come from `towards` and be dual feasible (none above cost plus price of the next node, for any arc); they
    stay so. The path
    ends in some node: if the best offer of its arcs is above its price, the price rises to it and the path is contracted
    by that node; else the path is extended along the best arc. Prices may be used again for other origins: that of
    an origin which has been served is its distance to the target.
    """
    if prices[origin] >= UNREACHABLE:
        return False
    path, node = [origin], origin
    while node != target:
        best, following = UNREACHABLE, -1
        for _, cost, nxt in arcs[node]:
            offer = cost + prices[nxt]
            if offer < best:
                best, following = offer, nxt
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(following)
        node = path[-1]
    return True


def least_tight_path(arcs: Arcs, prices: Sequence[int], origin: int, target: int) -> list[tuple[object, int, int, int]]:
    """The lexicographically least sequence of labels among all shortest paths, as (label, cost, node, next node).

    After an auction all shortest paths consist of tight arcs, and every tight path to the target is a shortest one. Tight
    arcs make no cycle. Those that lead nowhere are left again, each node at most once.
    """
    path: list[tuple[object, int, int, int]] = []
    dead: set[int] = set()
    node = origin
    while node != target:
        for label, cost, nxt in arcs[node]:
            if nxt not in dead and prices[node] == cost + prices[nxt] < UNREACHABLE:
                path.append((label, cost, node, nxt))
                node = nxt
                break
        else:
            dead.add(node)
            node = path.pop()[2]
    return path
