"""Constraints, their registration rules, and violation codes."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Stable codes of violations and errors.
DUPLICATE_PK, DUPLICATE_UNIQUE, MISSING_PARENT, PARENT_DELETED, NULL_VALUE = "INT-003", "INT-004", "INT-005", "INT-006", "INT-007"
INCONSISTENT, UNPROVABLE, ONBOARDING, BYPASSED = "INT-010", "INT-012", "INT-013", "INT-015"
#: All codes with their names.
CODES = {
    "INT-001": "INVALID_CONSTRAINT", "INT-002": "CONSTRAINT_NOT_FOUND", "INT-003": "DUPLICATE_PRIMARY_KEY", "INT-004": "DUPLICATE_UNIQUE_KEY", "INT-005": "FOREIGN_KEY_VIOLATION",
    "INT-006": "REFERENCED_ROW_DELETE", "INT-007": "NOT_NULL_VIOLATION", "INT-008": "CHECK_VIOLATION", "INT-009": "STALE_BASE_SNAPSHOT", "INT-010": "INDEX_DEGRADED", "INT-011": "RECOVERY_REQUIRED",
    "INT-012": "UNSUPPORTED_COMMIT_OPERATION", "INT-013": "ONBOARDING_VIOLATIONS", "INT-014": "VALIDATION_BUDGET_EXCEEDED", "INT-015": "BYPASS_DETECTED", "INT-016": "STORAGE_READ_FAILED",
    "INT-017": "RATE_LIMITED", "INT-018": "SIGNER_UNAVAILABLE",
}
PK, UNIQUE, FK, NOT_NULL = "PRIMARY KEY", "UNIQUE", "FOREIGN KEY", "NOT NULL"

#: Types by key family; types of different families never make equal keys.
FAMILIES = {"boolean": "boolean", "tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "date": "date", "timestamp_ntz": "timestamp", "timestamp": "timestamptz", "string": "string", "binary": "binary", "fixed": "binary", "uuid": "uuid", "timestamp_ns": "timestamp", "timestamptz_ns": "timestamptz"}


class DefinitionError(ValueError):
    """A constraint that cannot be registered."""


def family(kind: str) -> str | None:
    """The key family of a Spark type name; decimals of one scale are one family; None where the type is no key."""
    if kind.startswith("decimal"):
        return f"decimal:{kind.rstrip(')').split(',')[-1]}"
    return FAMILIES.get(kind)


@dataclass(frozen=True)
class Constraint:
    """One constraint. ``nulls_distinct`` is for UNIQUE, ``full`` and the parent for FOREIGN KEY."""

    id: int
    kind: str
    table: str
    columns: tuple[str, ...]
    name: str = ""
    nulls_distinct: bool = True
    full: bool = False
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    enabled: bool = True

    @property
    def duplicate_code(self) -> str:
        return DUPLICATE_PK if self.kind == PK else DUPLICATE_UNIQUE

    @property
    def label(self) -> str:
        return self.name or f"{self.kind.lower().replace(' ', '_')}_{self.table}"


@dataclass
class Registry:
    """Registered constraints and the version of each table's set."""

    schemas: dict[str, dict[str, str]]
    constraints: dict[int, Constraint] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)

    def check(self, c: Constraint) -> None:
        """Refuse empty or repeated keys, unknown columns, types that make no key, and unfit parents."""
        if not c.columns or any(not x for x in c.columns):
            raise DefinitionError("a constraint needs columns with names")
        if len(set(c.columns)) != len(c.columns):
            raise DefinitionError("a column is named twice")
        if c.table not in self.schemas:
            raise DefinitionError(f"unknown table {c.table}")
        own = self.schemas[c.table]
        for x in c.columns:
            if x not in own:
                raise DefinitionError(f"unknown column {x}")
            if c.kind != NOT_NULL and family(own[x]) is None:
                raise DefinitionError(f"{own[x]} cannot be a key")
        if c.kind == NOT_NULL and len(c.columns) != 1:
            raise DefinitionError("NOT NULL is for one column")
        if c.kind == FK:
            self._check_parent(c, own)

    def _check_parent(self, c: Constraint, own: dict[str, str]) -> None:
        if c.parent == c.table:
            raise DefinitionError("a table cannot reference itself")
        if c.parent not in self.schemas:
            raise DefinitionError(f"unknown parent table {c.parent}")
        if len(c.parent_columns) != len(c.columns):
            raise DefinitionError("child and parent keys differ in length")
        if not self.parent_key(c):
            raise DefinitionError("the parent columns are no primary or unique key")
        other = self.schemas[c.parent]
        for x, y in zip(c.columns, c.parent_columns, strict=True):
            if family(own[x]) != family(other[y]):
                raise DefinitionError(f"{x} and {y} are of different families")

    def parent_key(self, c: Constraint) -> Constraint | None:
        """The enabled key that a foreign key references."""
        return next((p for p in self.constraints.values() if p.enabled and p.table == c.parent and p.kind in (PK, UNIQUE) and p.columns == c.parent_columns), None)

    def register(self, c: Constraint) -> None:
        self.check(c)
        if c.id in self.constraints:
            raise DefinitionError(f"constraint {c.id} exists")
        self.constraints[c.id] = c
        self.versions[c.table] = self.versions.get(c.table, 0) + 1

    def drop(self, constraint_id: int) -> None:
        """Remove a constraint that no foreign key references."""
        c = self.constraints[constraint_id]
        if any(f.kind == FK and self.parent_key(f) == c for f in self.constraints.values()):
            raise DefinitionError("a foreign key references it")
        del self.constraints[constraint_id]
        self.versions[c.table] += 1

    def of_table(self, table: str) -> list[Constraint]:
        return [c for c in self.constraints.values() if c.enabled and c.table == table]

    def governing(self, table: str) -> list[Constraint]:
        """A table's own constraints and the foreign keys that reference it."""
        return [c for c in self.constraints.values() if c.enabled and table in (c.table, c.parent)]
