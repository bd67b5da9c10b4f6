"""Sequential solvers for one component: plain Python and NumPy, with explicit stacks."""

from __future__ import annotations

import heapq
import time
from collections import defaultdict, deque
from collections.abc import Iterator, Sequence

import numpy as np

Edge = tuple[int, int, float]


def strong_components(src: Sequence[int], dst: Sequence[int]) -> list[tuple[int, int]]:
    """(vertex, least vertex of its strong component), by two depth-first passes."""
    ids, flat = np.unique(np.concatenate([np.asarray(src), np.asarray(dst)]), return_inverse=True)
    m, n = len(src), len(ids)
    forward, backward = _adjacency(n, flat[:m], flat[m:]), _adjacency(n, flat[m:], flat[:m])
    seen, order = [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [(root, iter(forward[root]))]
        while stack:
            v, todo = stack[-1]
            nxt = next((w for w in todo if not seen[w]), None)
            if nxt is None:
                order.append(v)
                stack.pop()
            else:
                seen[nxt] = True
                stack.append((nxt, iter(forward[nxt])))
    name = [-1] * n
    for root in reversed(order):
        if name[root] >= 0:
            continue
        members, name[root] = [root], root
        for v in members:
            for w in backward[v]:
                if name[w] < 0:
                    name[w] = root
                    members.append(w)
        least = min(members)
        for v in members:
            name[v] = least
    return [(int(ids[v]), int(ids[c])) for v, c in enumerate(name)]


def _adjacency(n: int, a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    order = np.argsort(a, kind="stable")
    edge = np.searchsorted(a[order], np.arange(n + 1))
    b = b[order]
    return [b[edge[i] : edge[i + 1]].tolist() for i in range(n)]


def reach_slices(src: Sequence[int], dst: Sequence[int], slices: Sequence[int], of: int, rows: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, reached) arrays: all pairs joined by one hop or more whose reached vertex is in one of the slices.

    The vertices in order are cut into ``of`` slices. A slice takes one pass over what leads to it, dependencies first, with
    a bit for each of its vertices, so memory is that of the edges and a few bits a vertex; pairs are given out in batches of about ``rows``.
    """
    ids, flat = np.unique(np.concatenate([np.asarray(src), np.asarray(dst)]), return_inverse=True)
    m, n = len(src), len(ids)
    a, b = flat[:m], flat[m:]
    least = dict(strong_components(a, b))
    names, scc = np.unique(np.array([least[v] for v in range(n)]), return_inverse=True)
    k = len(names)
    members = _adjacency(k, scc, np.arange(n))
    looped = np.bincount(scc, minlength=k) > 1
    looped[scc[a[a == b]]] = True
    pairs = np.unique(np.stack([scc[a], scc[b]], 1)[scc[a] != scc[b]], axis=0).reshape(-1, 2)
    to, back = _adjacency(k, pairs[:, 0], pairs[:, 1]), _adjacency(k, pairs[:, 1], pairs[:, 0])
    turn = np.empty(k, dtype=np.int64)
    turn[topological(k, pairs.tolist())] = np.arange(k)
    edge = [n * i // of for i in range(of + 1)]
    for part in slices:
        low, high = edge[part], edge[part + 1]
        if low == high:
            continue
        stack = np.unique(scc[low:high]).tolist()
        found = set(stack)
        while stack:
            more = [u for u in back[stack.pop()] if u not in found]
            found.update(more)
            stack += more
        order = sorted(found, key=turn.__getitem__)
        at = {c: i for i, c in enumerate(order)}
        # bits[i]: what those before the component reach through it, its own members too.
        bits = np.zeros((len(order), (high - low + 7) // 8), dtype=np.uint8)
        for v in range(low, high):
            bits[at[scc[v]], v - low >> 3] |= 128 >> (v - low & 7)
        for i, c in enumerate(order):
            for d in to[c]:
                if d in at:
                    bits[i] |= bits[at[d]]
        start = np.concatenate([members[c] for c in order]).astype(np.int64)
        row = np.repeat(np.arange(len(order)), [len(members[c]) for c in order])
        step = max(1, rows // (high - low))
        for i in range(0, len(start), step):
            who = start[i : i + step]
            got = np.unpackbits(bits[row[i : i + step]], axis=1, count=high - low)
            own = np.flatnonzero((who >= low) & (who < high) & ~looped[scc[who]])
            got[own, who[own] - low] = 0
            x, y = np.nonzero(got)
            if len(x):
                yield ids[who[x]], ids[low + y]


def longest_layers(src: Sequence[int], dst: Sequence[int]) -> list[tuple[int, int]]:
    """(vertex, 1 + longest chain of dependencies); src depends on dst; the graph has no cycle."""
    ids, flat = np.unique(np.concatenate([np.asarray(src), np.asarray(dst)]), return_inverse=True)
    m, n = len(src), len(ids)
    users, left = _adjacency(n, flat[m:], flat[:m]), np.bincount(flat[:m], minlength=n).tolist()
    layer, ready = [1] * n, deque(v for v in range(n) if not left[v])
    done = 0
    while ready:
        v = ready.popleft()
        done += 1
        for u in users[v]:
            layer[u] = max(layer[u], layer[v] + 1)
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    if done < n:
        raise ValueError("layers need an acyclic graph")
    return [(int(ids[v]), layer[v]) for v in range(n)]


def _clean(edges: Sequence[Edge]) -> dict[tuple[int, int], float]:
    out: dict[tuple[int, int], float] = {}
    for s, d, w in edges:
        if s != d and (s, d) not in out:
            out[s, d] = 1.0 if w is None else float(w)
    return out


def feedback_arcs(edges: Sequence[Edge], exact_vertices: int = 300, seconds: float = 60.0) -> tuple[list[Edge], bool]:
    """Edges of least total weight whose removal leaves no cycle, and whether that is proven.

    Up to 16 vertices: dynamic programming over vertex subsets. Beyond, up to ``exact_vertices``:
    branch and bound over short cycles within the time budget. Else the ordering heuristic.
    Of equal optima the lexicographically largest edge list is cut by the first method.
    """
    price = _clean(edges)
    nodes = sorted({v for e in price for v in e})
    best = heuristic_arcs(price)
    if len(nodes) <= 16:
        return [(s, d, price[s, d]) for s, d in _subset_arcs(nodes, price)], True
    if len(nodes) <= exact_vertices:
        found, proven = _branch(price, best, time.monotonic() + seconds)
        return [(s, d, price[s, d]) for s, d in sorted(found)], proven
    return [(s, d, price[s, d]) for s, d in sorted(best)], False


def _subset_arcs(nodes: list[int], price: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """Order vertices so that the edges pointing backward weigh least: 2^n states."""
    n, at = len(nodes), {v: i for i, v in enumerate(nodes)}
    w = np.zeros((n, n))
    for (s, d), x in price.items():
        w[at[s], at[d]] = x
    size = 1 << n
    cost, last = np.full(size, np.inf), np.full(size, -1, dtype=np.int64)
    cost[0] = 0.0
    # Placing v after the set s cuts v's edges into s.
    into = np.zeros((n, size))
    for v in range(n):
        for j in range(n):
            into[v, 1 << j : 2 << j] = into[v, : 1 << j] + w[v, j]
    order = np.argsort(np.bitwise_count(np.arange(size)), kind="stable")
    for s in order.tolist():
        base = cost[s]
        for v in range(n):
            if not s >> v & 1:
                t, c = s | 1 << v, base + into[v, s]
                if c < cost[t] - 1e-12:
                    cost[t], last[t] = c, v
    placed, s = [], size - 1
    while s:
        v = int(last[s])
        placed.append(v)
        s ^= 1 << v
    rank = {nodes[v]: i for i, v in enumerate(reversed(placed))}
    return sorted(e for e in price if rank[e[0]] > rank[e[1]])


def heuristic_arcs(price: dict[tuple[int, int], float]) -> set[tuple[int, int]]:
    """Strip sinks and sources, else the vertex with most outgoing over incoming edges; then move single
    vertices while the backward weight drops.

    A step costs as much as its vertex has edges, times a logarithm, so large components are fine.
    """
    outs, ins = defaultdict(set), defaultdict(set)
    for s, d in price:
        outs[s].add(d)
        ins[d].add(s)
    nodes = sorted({v for e in price for v in e})
    order = _improved(nodes, _stripped(nodes, outs, ins), outs, ins, price)
    rank = {v: k for k, v in enumerate(order)}
    return {e for e in price if rank[e[0]] > rank[e[1]]}


def _stripped(nodes: list[int], outs: dict[int, set[int]], ins: dict[int, set[int]]) -> list[int]:
    o, i = {v: len(outs[v]) for v in nodes}, {v: len(ins[v]) for v in nodes}
    alive, left, right = set(nodes), [], []
    sinks, sources = {v for v in nodes if not o[v]}, {v for v in nodes if not i[v]}
    queue = [(i[v] - o[v], v) for v in nodes]
    heapq.heapify(queue)

    def drop(v: int) -> None:
        alive.discard(v)
        sinks.discard(v)
        sources.discard(v)
        for d in outs[v]:
            i[d] -= 1
            if d in alive:
                heapq.heappush(queue, (i[d] - o[d], d))
                if not i[d]:
                    sources.add(d)
        for s in ins[v]:
            o[s] -= 1
            if s in alive:
                heapq.heappush(queue, (i[s] - o[s], s))
                if not o[s]:
                    sinks.add(s)

    while alive:
        if sinks or sources:
            to = right if sinks else left
            for v in sorted(sinks or sources):
                drop(v)
                to.append(v)
            continue
        gap, v = heapq.heappop(queue)
        if v in alive and gap == i[v] - o[v]:  # else an old entry
            drop(v)
            left.append(v)
    return left + right[::-1]


def _improved(nodes: list[int], order: list[int], outs: dict[int, set[int]], ins: dict[int, set[int]], price: dict[tuple[int, int], float]) -> list[int]:
    """The order after single moves. Only places beside a neighbour can be better; places are numbers with gaps between them."""
    end = object()
    ring = [end, *order]
    before, after = dict(zip(order, ring)), dict(zip(ring, [*order, end]))
    before[end] = order[-1]
    wide = 1 << 40
    place = {v: k * wide for k, v in enumerate(order)}

    def put(v: int, left: object) -> None:
        """Take v out and put it behind ``left``."""
        after[before[v]], before[after[v]] = after[v], before[v]
        right = after[left]
        before[v], after[v], after[left], before[right] = left, right, v, v
        low = place[left] if left is not end else place[right] - 2 * wide
        high = place[right] if right is not end else low + 2 * wide
        place[v] = (low + high) // 2
        if place[v] == low:
            v, k = after[end], 0
            while v is not end:
                place[v], v, k = k, after[v], k + wide

    improved = True
    while improved:  # each move drops the backward weight, so this ends
        improved = False
        for v in nodes:
            near, here = sorted((place[u], u) for u in outs[v] | ins[v]), place[v]
            gain, best, run = 0.0, None, 0.0
            for x, u in reversed(near):  # earlier: edges to v from there turn backward
                if x < here:
                    run += price.get((u, v), 0.0) - price.get((v, u), 0.0)
                    if run < gain - 1e-12:
                        gain, best = run, u
            run = 0.0
            for x, u in near:
                if x > here:
                    run += price.get((v, u), 0.0) - price.get((u, v), 0.0)
                    if run < gain - 1e-12:
                        gain, best = run, u
            if best is not None:
                put(v, best if place[best] > here else before[best])
                improved = True
    out, v = [], after[end]
    while v is not end:
        out.append(v)
        v = after[v]
    return out


def _short_cycle(price: dict[tuple[int, int], float], cut: set[tuple[int, int]], nodes: Sequence[int]) -> list[tuple[int, int]] | None:
    """A shortest cycle that the cut leaves, as edges."""
    outs = defaultdict(list)
    for s, d in price:
        if (s, d) not in cut:
            outs[s].append(d)
    best: list[tuple[int, int]] | None = None
    for root in nodes:
        came, queue = {root: None}, deque([root])
        while queue:
            v = queue.popleft()
            for w in outs[v]:
                if w == root:
                    path = [(v, w)]
                    while came[v] is not None:
                        path.append((came[v], v))
                        v = came[v]
                    if best is None or len(path) < len(best):
                        best = path[::-1]
                    queue.clear()
                    break
                if w not in came:
                    came[w] = v
                    queue.append(w)
        if best is not None and len(best) == 2:
            break
    return best


def _branch(price, start: set, until: float) -> tuple[set, bool]:
    nodes = sorted({v for e in price for v in e})
    best, weight = set(start), sum(price[e] for e in start)
    stack: list[tuple[frozenset, frozenset, float]] = [(frozenset(), frozenset(), 0.0)]
    while stack:
        if time.monotonic() > until:
            return best, False
        cut, kept, cost = stack.pop()
        if cost >= weight - 1e-12:
            continue
        # Disjoint cycles give a lower bound besides the next branching cycle.
        bound, taken, first = cost, set(cut), None
        while True:
            cycle = _short_cycle(price, taken, nodes)
            if cycle is None:
                break
            first = first or cycle
            free = [e for e in cycle if e not in kept]
            if not free:
                bound = float("inf")
                break
            bound += min(price[e] for e in free)
            taken |= set(cycle)
            if bound >= weight - 1e-12:
                break
        if bound >= weight - 1e-12:
            continue
        if first is None:
            best, weight = set(cut), cost
            continue
        fixed = set(kept)
        for e in sorted((e for e in first if e not in kept), key=lambda e: (price[e], e)):
            stack.append((cut | {e}, frozenset(fixed), cost + price[e]))
            fixed.add(e)
    return best, True


def topological(n: int, edges: Sequence[tuple[int, int]]) -> list[int]:
    """Vertex order with dependencies first; the lowest ready vertex goes next."""
    users, left = defaultdict(list), [0] * n
    for s, d in edges:
        users[d].append(s)
        left[s] += 1
    ready, out = [v for v in range(n) if not left[v]], []
    heapq.heapify(ready)
    while ready:
        v = heapq.heappop(ready)
        out.append(v)
        for u in users[v]:
            left[u] -= 1
            if not left[u]:
                heapq.heappush(ready, u)
    return out
