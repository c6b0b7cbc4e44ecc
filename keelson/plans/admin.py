"""Registering constraints on data, domains and their indexes, catching up, and what is told about them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.model import BYPASSED, FK, INCONSISTENT, ONBOARDING, Constraint, Registry
from keelson.operators import validate
from keelson.plans import domain
from keelson.sources.index_store import IndexStore
from keelson.streaming import commits

HEALTHY, DEGRADED, DISABLED = "healthy", "degraded", "disabled"


def edges(registry: Registry) -> list[tuple[str, str]]:
    return [(c.table, c.parent) for c in registry.constraints.values() if c.kind == FK and c.enabled]


@dataclass
class Onboarding:
    """A report of what the data breaks, or nothing and the indexes are built."""

    table: str | None
    violations: DataFrame | None

    @property
    def code(self) -> str | None:
        return None if self.table is None else ONBOARDING


def scan(registry: Registry, tables: dict[str, DataFrame], wanted: set[str]) -> Onboarding:
    """Check whole tables, parents first; the report is of the first table that breaks a rule."""
    for t in domain.parents_first(edges(registry), wanted):
        own = registry.of_table(t)
        parents = {c.id: tables[c.parent].select(*c.parent_columns) for c in own if c.kind == FK}
        found = validate.onboard_table(tables[t], own, parents).persist()
        if not found.isEmpty():
            return Onboarding(t, found)
        found.unpersist()
    return Onboarding(None, None)


@dataclass
class Domains:
    """Registered constraints, the states of their domains and the index store of each."""

    spark: SparkSession
    registry: Registry
    store: IndexStore
    states: dict[str, str] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)

    def _audit(self, action: str, table: str, detail: str = "") -> None:
        self.events.append({"seq": len(self.events) + 1, "action": action, "table_name": table, "detail": detail})

    def of(self, table: str) -> set[str]:
        return domain.component(edges(self.registry), table)

    def register(self, c: Constraint, tables: dict[str, DataFrame]) -> Onboarding:
        """Scan the domain's data with the new constraint; install its indexes where all holds, else leave everything as it was."""
        trial = Registry(self.registry.schemas, dict(self.registry.constraints), dict(self.registry.versions))
        trial.register(c)
        wanted = domain.component(edges(trial), c.table)
        report = scan(trial, tables, wanted)
        if report.table is None:
            own = Registry(trial.schemas, {k: v for k, v in trial.constraints.items() if v.table in wanted})
            commits.install(self.store, own, tables, self.store.pointer()["epoch"] + 1)
            self.registry.register(c)
            self.states.update(dict.fromkeys(wanted, HEALTHY))
        self._audit("register" if report.table is None else "refuse", c.table, c.label)
        return report

    def drop(self, constraint_id: int) -> None:
        c = self.registry.constraints[constraint_id]
        self.registry.drop(constraint_id)
        self._audit("drop", c.table, c.label)

    def rebuild(self, table: str, tables: dict[str, DataFrame], head: int | None = None) -> Onboarding:
        """Build the indexes of a table's domain again from its data; a domain whose data holds is healthy after that."""
        wanted = self.of(table)
        report = scan(self.registry, tables, wanted)
        if report.table is None:
            own = Registry(self.registry.schemas, {k: v for k, v in self.registry.constraints.items() if v.table in wanted})
            commits.install(self.store, own, tables, self.store.pointer()["epoch"] + 1)
        for t in wanted:
            self.states[t] = HEALTHY if report.table is None else DEGRADED
        self._audit("rebuild", table, self.states[table])
        return report

    def disable(self, table: str) -> None:
        """Commits of the domain are no longer validated until it is rebuilt."""
        for t in self.of(table):
            self.states[t] = DISABLED
        self._audit("disable", table)

    def admit(self, table: str, main: int | None) -> str | None:
        """Why a commit cannot be validated now: the code of a bypassed or degraded domain, None where it can."""
        if self.states.get(table) == DEGRADED:
            return INCONSISTENT
        return None if self.store.check_head(main) == "current" else BYPASSED

    def status(self) -> DataFrame:
        """(table_name, state) of all tables that have one."""
        return self.spark.createDataFrame(sorted(self.states.items()), "table_name string, state string")

    def audit(self, after: int = 0, table: str | None = None) -> DataFrame:
        """Events above a number, of one table or all."""
        rows = [(e["seq"], e["action"], e["table_name"], e["detail"]) for e in self.events if e["seq"] > after and table in (None, e["table_name"])]
        return self.spark.createDataFrame(rows, "seq long, action string, table_name string, detail string")


def report(found: DataFrame) -> DataFrame:
    """One JSON text per (table, code, constraint) with the number of keys and the first of them."""
    total = validate.summary(found, samples=True).orderBy("code", "constraint_id")
    return total.select("table_name", "code", F.to_json(F.struct("code", "constraint", "table_name", "violation_count", "sample_keys")).alias("report"))


def metrics_text(counters: dict[str, int], buckets: DataFrame, name: str) -> str:
    """Counters and one histogram (of ``delta.histogram`` without groups) as text that monitors read."""
    lines = [f"{k} {v}" for k, v in sorted(counters.items())]
    rows = buckets.orderBy("bucket").collect()  # one row a bound
    for r in rows:
        lines.append(f'{name}_bucket{{le="{"+Inf" if r.bound == float("inf") else f"{r.bound:g}"}"}} {r.at_most}')
    if rows:
        lines += [f"{name}_sum {rows[0]['sum']}", f"{name}_count {rows[0]['count']}"]
    return "\n".join(lines) + "\n"


def identify(uuid: str, constrained: dict[str, str]) -> str | None:
    """The constrained table of a commit by its uuid, whatever name the commit gave it."""
    return constrained.get(uuid)


class CannotCatchUp(ValueError):
    """A missed snapshot that does not hold, or more of them than allowed."""


def catch_up(chain: list[int], limit: int, changes: Callable[[int], tuple[DataFrame, DataFrame]], registry: Registry, table: str, store: IndexStore) -> int:
    """Validate the snapshots that a table got without its indexes, oldest first, and move the indexes on with each; how many.

    One that breaks a rule stops it: the indexes then reflect the snapshot before.
    """
    if len(chain) > limit:
        raise CannotCatchUp(f"{len(chain)} snapshots, {limit} allowed")
    for snapshot in chain:
        added, removed = changes(snapshot)
        decision = validate.commit(registry, table, added, removed, commits.indexes_for(store, registry, table))
        if not decision.violations.isEmpty() or not decision.errors.isEmpty():
            raise CannotCatchUp(f"snapshot {snapshot} breaks a rule")
        deltas, values = commits.deltas_of(registry, table, added, removed)
        store.apply_deltas(deltas, store.pointer()["epoch"] + 1, head=snapshot, values=values)
    return len(chain)


def catch_up_order(missed: dict[str, list[tuple[int, dict[str, int | None]]]], heads: dict[str, int | None]) -> list[tuple[str, int]]:
    """The order in which the missed snapshots of a domain's tables can be applied.

    Each snapshot recorded the heads of the other tables that it was validated
    with; a table goes on when these are the present ones. An order that does
    not exist is an error.
    """
    now, left, out = dict(heads), {t: list(s) for t, s in missed.items()}, []
    while any(left.values()):
        ready = next((t for t in sorted(left) if left[t] and all(now.get(o) == h for o, h in left[t][0][1].items())), None)
        if ready is None:
            raise CannotCatchUp("no snapshot was validated with the present heads")
        snapshot, _ = left[ready].pop(0)
        now[ready] = snapshot
        out.append((ready, snapshot))
    return out
