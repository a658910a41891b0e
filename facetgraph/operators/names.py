"""Names of one small graph's facts resolved, for a task that takes many of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator


def _singles(names) -> dict:
    """The names whose last segment stands on one row only, by that segment."""
    n = Counter(name.rsplit(".", 1)[-1] for name in names if name is not None)
    return {end: name for name in names if name is not None and n[end := name.rsplit(".", 1)[-1]] == 1}


def class_relations_of(rows: list[tuple]) -> Iterator[tuple]:
    """(src, dst, relation, pos) of rows (owner, pos, refs, known), as class_graph() has them; a node is src, the rest null.

    A row that is known is a class with its bases, any other a call by a method of its owner.
    """
    names = [owner for owner, _, _, known in rows if known]
    classes, singles, found = set(names), _singles(names), {}
    classes.discard(None)

    def target(ref: str) -> str | None:
        if ref not in found:
            parts = ref.split(".")
            ends = (prefix if (prefix := ".".join(parts[:i])) in classes else singles.get(parts[i - 1]) for i in range(len(parts), 0, -1))
            found[ref] = next((name for name in ends if name is not None), None)
        return found[ref]

    first = {}
    for owner, pos, refs, known in rows:
        if owner is None or not known and owner not in classes:
            continue
        for ref in refs or ():
            if ref is not None:
                dst = target(ref)
                dst = ref if dst is None and known else dst
                if dst is not None and dst != owner and (dst or not known):
                    key = (owner, dst, "inheritance" if known else "uses")
                    first[key] = min((x for x in (pos, first.get(key)) if x is not None), default=None)
    yield from ((name, None, None, None) for name in {*names, *(dst for _, dst, relation in first if relation == "inheritance")})
    yield from ((*key, pos) for key, pos in first.items())


def calls_of(rows: list[tuple]) -> Iterator[tuple]:
    """(src, dst, raw, pos) of rows (caller, parent, raw, pos, callable, known), as call_sequences() has them.

    A row that is known is a callable with its simple name in raw, any other a call.
    """
    n = Counter(name for _, _, name, _, _, known in rows if known)
    singles = {name: qualified for _, _, name, _, qualified, known in rows if known and n[name] == 1}
    callables = {qualified for *_, qualified, known in rows if known and qualified is not None}
    for caller, parent, raw, pos, _, known in rows:
        if not known and caller in callables:
            yield caller, _callable(raw, parent, callables, singles), raw, pos


def _callable(raw: str | None, parent: str | None, callables: set, singles: dict) -> str | None:
    if raw is None or raw in callables:
        return raw
    if parent and raw.startswith(("self.", "cls.")):
        own = f"{parent}.{raw.split('.', 1)[1]}"
        if own in callables:
            return own
    single = None if "." in raw else singles.get(raw)
    return raw if single is None else single


def packages_of(rows: list[tuple]) -> Iterator[tuple]:
    """(src, dst) of rows (module, reference, whole), as package_graph() has them; a node is src, dst null."""
    modules = dict.fromkeys(module for module, _, _ in rows)
    out = set()
    for module, reference, whole in rows:
        if module is None or reference is None:
            continue
        tail = reference.lstrip(".")
        level = len(reference) - len(tail)
        if level:
            package = module.split(".") if whole else module.split(".")[:-1] or [""]
            base = ".".join(package[: max(0, len(package) - (level - 1))])
            name = ".".join(x for x in (base, tail) if x)
        else:
            name = reference
        while name not in modules and "." in name:
            name = name.rpartition(".")[0]
        if name in modules and name != module:
            out.add((module, name))
    yield from ((module, None) for module in modules)
    yield from out
