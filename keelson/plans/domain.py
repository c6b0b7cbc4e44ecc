"""Foreign-key domains and snapshot chains, planned on the driver: both are metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def component(edges: Iterable[tuple[str, str]], table: str) -> set[str]:
    """The tables that foreign keys connect with a table, in either direction."""
    edges = list(edges)
    found, new = {table}, {table}
    while new:
        new = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in new} - found
        found |= new
    return found


def parents_first(edges: Iterable[tuple[str, str]], tables: Iterable[str]) -> list[str]:
    """Tables in an order that has parents before their children (edges are child, parent); a cycle is an error."""
    left = set(tables)
    needs = {t: {p for c, p in edges if c == t and p in left and p != t} for t in left}
    out: list[str] = []
    while left:
        ready = sorted(t for t in left if not needs[t] - set(out))
        if not ready:
            raise ValueError("foreign keys form a cycle")
        out += ready
        left -= set(ready)
    return out


def ancestry(parents: Mapping[int, int | None], start: int, stop: int | None = None) -> list[int]:
    """Snapshots from ``start`` back to ``stop`` (or the root), newest first; a missing parent or a loop is an error."""
    out, now = [], start
    while now is not None:
        if now not in parents or now in out:
            raise ValueError(f"snapshot {now} is missing or repeated")
        out.append(now)
        if now == stop:
            return out
        now = parents[now]
    if stop is not None:
        raise ValueError(f"{stop} is no ancestor of {start}")
    return out


def allowed_operation(operation: str, adds: bool, removes: bool, changes_rows: bool) -> bool:
    """Whether a commit does what its declared operation may: append removes nothing, delete adds nothing, replace changes no row."""
    return {"append": not removes, "delete": not adds, "replace": not changes_rows, "overwrite": True}.get(operation, False)


#: Type changes of a constrained column that keep its key family.
PROMOTIONS = {("int", "bigint"), ("float", "double")}


def allowed_promotion(old: str, new: str) -> bool:
    if old == new or (old, new) in PROMOTIONS:
        return True
    if old.startswith("decimal(") and new.startswith("decimal("):
        (p, s), (q, t) = (map(int, x[8:-1].split(",")) for x in (old, new))
        return s == t and q >= p
    return False
