"""Components, cycles and walks of one small graph, for a task that takes many of them."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator


def components_of(nodes, to: dict) -> list[list]:
    """The strong components of nodes over to[node], followed within nodes only; after those that they lead to."""
    place, low, on, stack, out = {}, {}, set(), [], []
    for start in nodes:
        if start in place:
            continue
        walk = [(start, iter(to.get(start, ())))]
        place[start] = low[start] = len(place)
        stack.append(start)
        on.add(start)
        while walk:
            n, rest = walk[-1]
            for m in rest:
                if m not in nodes:
                    continue
                if m not in place:
                    place[m] = low[m] = len(place)
                    stack.append(m)
                    on.add(m)
                    walk.append((m, iter(to.get(m, ()))))
                    break
                if m in on and place[m] < low[n]:
                    low[n] = place[m]
            else:
                walk.pop()
                if walk and low[n] < low[walk[-1][0]]:
                    low[walk[-1][0]] = low[n]
                if low[n] == place[n]:
                    part = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        part.append(m)
                        if m == n:
                            break
                    out.append(part)
    return out


def _targets(rows) -> tuple[set, dict]:
    """Nodes, and for each its targets once, of rows (src, dst, edge); a row that is no edge is a node twice."""
    nodes, to = set(), defaultdict(dict)
    for src, dst, edge in rows:
        nodes.update((src, dst))
        if edge:
            to[src][dst] = None
    return nodes, to


def strong_of(rows) -> Iterator[tuple]:
    """(node, component, cyclic) as strong_components() gives them."""
    nodes, to = _targets(rows)
    for part in components_of(nodes, to):
        name, several = max(part), len(part) > 1
        for n in part:
            yield n, name, several or n in to.get(n, ())


def _through(start, part: set, to: dict) -> Iterator[list]:
    """The cycles through start within part, by Johnson's rule: a node from which no way led back is not entered before one does."""
    path, blocked, led, waiting = [start], {start}, set(), defaultdict(set)
    walk = [(start, iter(to[start]))]
    while walk:
        n, rest = walk[-1]
        for m in rest:
            if m == start:
                yield [*path, start]
                led.update(path)
            elif m in part and m not in blocked:
                path.append(m)
                blocked.add(m)
                led.discard(m)
                walk.append((m, iter(to.get(m, ()))))
                break
        else:
            if n in led:
                free = [n]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.discard(x)
                        free.extend(waiting.pop(x, ()))
            else:
                for m in to.get(n, ()):
                    if m in part:
                        waiting[m].add(n)
            walk.pop()
            path.pop()


def _short_through(start, part: set, to: dict, max_length: int) -> Iterator[list]:
    """The cycles through start within part of max_length edges at most; only nodes that can still lead back are entered."""
    of = defaultdict(list)
    for n in part:
        for m in to.get(n, ()):
            if m in part:
                of[m].append(n)
    back, todo = {start: 0}, deque([start])
    while todo:
        n = todo.popleft()
        for m in of[n]:
            if m not in back:
                back[m] = back[n] + 1
                todo.append(m)
    path, walk, on = [start], [iter(to[start])], {start}
    while walk:
        for m in walk[-1]:
            if m == start:
                if len(path) <= max_length:
                    yield [*path, start]
            elif m in back and m not in on and len(path) + back[m] <= max_length:
                path.append(m)
                on.add(m)
                walk.append(iter(to.get(m, ())))
                break
        else:
            walk.pop()
            on.discard(path.pop())


def cycles_of(rows, max_length: int | None = None) -> Iterator[tuple]:
    """(cycle,) as simple_cycles() gives them."""
    nodes, to = _targets(rows)
    for n in nodes:
        if to.get(n, {}).pop(n, n) is None:
            yield ([n, n],)
    todo = [set(part) for part in components_of(nodes, to) if len(part) > 1]
    while todo:
        part = todo.pop()
        start = min(part)
        for cycle in _through(start, part, to) if max_length is None else _short_through(start, part, to, max_length):
            yield (cycle,)
        part.discard(start)
        todo += [set(inner) for inner in components_of(part, to) if len(inner) > 1]


#: What a row of a walk's tables is: an internal callable, one that may be expanded, a root, a call.
NODE, ALLOWED, ROOT, CALL = range(4)


def _ordered(value) -> tuple:
    """Nulls first."""
    return (value is not None, value)


def _tables(rows) -> tuple[list, dict, set, set]:
    """Roots, the calls of each callable in order, internal and allowed callables, of rows (what, node, dst, raw, pos)."""
    roots, calls, inside, allowed = {}, defaultdict(list), set(), set()
    for what, node, dst, raw, pos in rows:
        if what == CALL:
            calls[node].append((_ordered(pos), dst, _ordered(raw)))
        elif what == ROOT:
            roots[node] = None
        else:
            (inside if what == NODE else allowed).add(node)
    for sent in calls.values():
        sent.sort()
    return list(roots), {node: [(dst, raw) for _, dst, (_, raw) in sent] for node, sent in calls.items()}, inside, allowed


def _messages(root, calls: dict, inside: set, allowed: set, max_depth: int, show_returns: bool, once: bool) -> Iterator[tuple]:
    """(number, depth, caller, callee, label, kind) of one walk."""
    sent, active = set(), {root}
    walk = [(root, iter(calls.get(root, ())), "", None)]
    shown = [0]
    while walk:
        caller, rest, prefix, answer = walk[-1]
        depth = len(walk) - 1
        for callee, label in rest:
            kind = "call"
            if callee in active:
                kind = "recursive_call"
            elif depth == max_depth and callee in allowed:
                kind, label = "depth_truncated", None if label is None else f"Further calls omitted: {label}"
            if once:
                key = (caller, callee, label, kind)
                if key in sent:
                    continue
                sent.add(key)
            shown[-1] += 1
            number = f"{prefix}{shown[-1]}"
            yield number, depth, caller, callee, label, kind
            back = (None, depth, callee, caller, "return", "return") if show_returns and callee in inside and kind != "depth_truncated" else None
            if kind == "call" and callee in allowed and callee in inside:
                active.add(callee)
                walk.append((callee, iter(calls.get(callee, ())), f"{number}.", back))
                shown.append(0)
                break
            if back:
                yield back
        else:
            walk.pop()
            shown.pop()
            active.discard(caller)
            if answer:
                yield answer


def messages_of(rows, max_depth: int, show_returns: bool, once: bool, owners: bool = False) -> Iterator[tuple]:
    """(root, position, number, depth, caller, callee, label, kind, caller_at, callee_at, met) as expand_sequence() and numbered_messages() give them."""
    roots, calls, inside, allowed = _tables(rows)
    for root in roots:
        at = {_owner(root) if owners else root: 1}
        for position, message in enumerate(_messages(root, calls, inside, allowed, max_depth, show_returns, once), 1):
            caller, callee = message[2:4]
            if owners:
                caller, callee = _owner(caller), _owner(callee)
            n = len(at)
            yield root, position, *message, at[caller], at.setdefault(callee, n + 1), len(at) > n


def _owner(name: str) -> str:
    """The name without its last segment."""
    return name.rpartition(".")[0] if "." in name else name


def continuations_of(rows, max_depth: int, once: bool) -> Iterator[tuple]:
    """(node, turn) as continuations() gives them."""
    roots, calls, inside, allowed = _tables(rows)
    turn, seen = 0, set(roots)
    while roots:
        turn += 1
        cut = {m[3] for root in roots for m in _messages(root, calls, inside, allowed, max_depth, False, once) if m[5] == "depth_truncated"}
        roots = [n for n in cut if n in inside and n in calls and n not in seen]
        seen.update(roots)
        for n in roots:
            yield n, turn


def chains_of(rows, max_depth: int) -> Iterator[tuple]:
    """(root, position, node, depth) as bounded_chain() gives them."""
    roots, calls, _, _ = _tables(rows)
    for root in roots if max_depth else ():
        seen, walk, position = {root}, [iter(calls.get(root, ()))], 0
        while walk:
            for node, _ in walk[-1]:
                if node not in seen:
                    seen.add(node)
                    position += 1
                    yield root, position, node, len(walk)
                    if len(walk) < max_depth:
                        walk.append(iter(calls.get(node, ())))
                        break
            else:
                walk.pop()
