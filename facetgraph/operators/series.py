"""The partition of one small graph into series, for a task that takes many of them.

Branches are read off a dominator tree: where no cycle is reached, a node's branch is
closed exactly if no edge leaves its subtree of that tree, which sums over the tree tell
without forming any branch. Work is linear in the graph but for the walks up the tree.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator


def _walk(starts: list, to: dict, within: set | None = None) -> dict:
    """Breadth-first distances from starts."""
    found, todo = {n: 0 for n in starts}, deque(starts)
    while todo:
        n = todo.popleft()
        for m in to[n]:
            if m not in found and (within is None or m in within):
                found[m] = found[n] + 1
                todo.append(m)
    return found


def on_cycles(nodes: set, to: dict, of: dict) -> set:
    """The nodes that reach themselves."""
    done, last = set(), []
    for start in nodes:  # nodes by the end of a depth-first walk
        stack = [(start, iter(to[start]))] if start not in done else []
        done.add(start)
        while stack:
            n, rest = stack[-1]
            m = next((x for x in rest if x not in done), None)
            if m is None:
                last.append(n)
                stack.pop()
            else:
                done.add(m)
                stack.append((m, iter(to[m])))
    left, out = set(nodes), set()
    for n in reversed(last):
        if n in left:
            part = set(_walk([n], of, left))
            left -= part
            if len(part) > 1 or n in to[n]:
                out |= part
    return out


def _dominators(clean: set, to: dict, of: dict) -> dict:
    """For each node of clean, which reaches no cycle, the nearest node of clean on all ways to it, None without one; nodes come after those."""
    waiting = {n: sum(m in clean for m in of[n]) for n in clean}
    todo = deque(sorted(n for n, k in waiting.items() if not k))
    above, level = {}, {None: 0}
    while todo:
        n = todo.popleft()
        meet = None
        for i, m in enumerate(of[n]):
            other = m if m in clean else None
            meet = other if i == 0 else meet
            while meet != other:
                if level[meet] >= level[other]:
                    meet = above[meet]
                else:
                    other = above[other]
        above[n], level[n] = meet, level[meet] + 1
        for m in to[n]:
            waiting[m] -= 1
            if not waiting[m]:
                todo.append(m)
    return above


def series_of(nodes: set, edges: list[tuple], fan_in_threshold: int, min_child: int) -> list[tuple]:
    """Rows (node, shared, series, depth, parent, number) as partition() gives them."""
    to, of = defaultdict(list), defaultdict(list)
    for a, b in edges:
        to[a].append(b)
        of[b].append(a)
    cyclic = on_cycles(nodes, to, of)
    shared = {n for n in nodes - cyclic if len(set(of[n])) >= fan_in_threshold}
    out = [(n, True, None, None, None, None) for n in shared]
    to, of, around = defaultdict(list), defaultdict(list), defaultdict(list)
    for a, b in edges:
        if a not in shared and b not in shared:
            to[a].append(b)
            of[b].append(a)
            around[a].append(b)
            around[b].append(a)
    regular = nodes - shared
    clean = regular - set(_walk(list(cyclic), of))
    above = _dominators(clean, to, of)
    size, leaving = dict.fromkeys(clean, 1), defaultdict(int)
    for a in clean:
        for b in to[a]:
            leaving[a] += 1
            leaving[above[b]] -= 1
    for n in reversed(list(above)):
        if above[n] is not None:
            size[above[n]] += size[n]
            leaving[above[n]] += leaving[n]
    parts, home = [], {}
    for start in sorted(regular):
        if start not in home:
            parts.append(_walk([start], around))
            home.update(dict.fromkeys(parts[-1], len(parts) - 1))
    own = [[] for _ in parts]
    for n in above:
        own[home[n]].append(n)
    number = 0
    for part, tree in zip(parts, own):
        sources = [n for n in part if not of[n]]
        root = min(sources or part)
        distance = _walk([root], to)
        heads = {n for n in tree if len(of[n]) == 1 and not leaving[n] and min_child <= size[n] < len(part) and len(set(to[of[n][0]])) > 1}
        outer = {None: None}  # the nearest head above a node, itself counted
        for n in tree:
            outer[n] = n if n in heads else outer[above[n]]
        rank = lambda n: (distance.get(of[n][0], len(part) + 1), of[n][0], n)  # noqa: B023, E731
        # taken branches, those around one, those inside one
        taken, holding, held = set(), set(), set()
        for n in sorted(heads, key=rank):
            if n in holding:
                continue
            chain, m = [n], outer[above[n]]
            while m is not None and m not in taken and m not in holding and m not in held:
                chain.append(m)
                m = outer[above[m]]
            if m is None or m in holding:
                taken.add(n)
                holding.update(chain[1:])
            else:
                held.update(chain)
        # what the root does not reach is counted from the head of the branch around it
        for n in taken:
            if n not in distance:
                distance |= {m: len(part) + 2 + d for m, d in _walk([n], to).items()}
        # a series is known by its head, that of the root by None: the root of a part without sources may be a head, too
        series, depth, inner, name = {None: None}, {None: 0}, defaultdict(list), lambda head: root if head is None else head  # noqa: B023
        parent = {None: None}
        for n in tree:
            outside = series[above[n]]
            if n in taken or n in heads and depth[outside]:
                series[n], depth[n], parent[n] = n, depth[outside] + 1, name(outside)
                inner[outside].append(n)
            else:
                series[n] = outside
        numbers, todo = {}, [None]
        while todo:
            n = todo.pop()
            number += 1
            numbers[n] = number
            todo += sorted(inner[n], key=rank, reverse=True)
        for n in part:
            head = series.get(n)
            out.append((n, False, name(head), depth[head], parent[head], numbers[head]))
    return out


def drawn_of(rows: list[tuple], neighbours: bool) -> Iterator[tuple]:
    """(output_name, src, dst, reference, place, ...) of rows (src, dst, shared, output_name, ...): what the outputs of bundles.py draw.

    A row without dst is a node at home in its output, any other an edge. Nodes are given
    without dst. With neighbours, edges are distinct, and a shared node's output also has
    those between the nodes it shows.
    """
    home, edges, shown = {}, [], defaultdict(set)
    for src, dst, shared, name, *rest in rows:
        if dst is None:
            home[src] = name, shared
        else:
            edges.append((src, dst, *rest))
    edges = [e for e in edges if e[0] in home and e[1] in home]
    drawn = []
    for edge in dict.fromkeys(edges) if neighbours else edges:
        src, dst = edge[:2]
        name, at_dst = home[src][0], home[dst]
        for out in (name, at_dst[0]) if at_dst[1] and src != dst else (name,):
            shown[out].update((src, dst))
            drawn.append((out, edge))
    none = [None] * (len(rows[0]) - 4)
    hubs = {name for name, shared in home.values() if shared}
    for node, (name, _) in home.items():
        yield name, node, None, None, 0, *none
    for name, ends in shown.items():
        for node in ends:
            if home[node][0] != name:
                yield name, node, None, home[node][0], 0 if name in hubs else 1, *none
    if neighbours:
        drawn, leaving = dict.fromkeys(drawn), defaultdict(list)
        for edge in dict.fromkeys(edges):
            leaving[edge[0]].append(edge)
        for name in hubs:
            drawn |= {(name, edge): None for node in shown[name] for edge in leaving[node] if edge[1] in shown[name]}
    for name, (src, dst, *rest) in drawn:
        yield name, src, dst, None, None, *rest
