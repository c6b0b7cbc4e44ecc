"""Table metadata as JSON: schemas by field id, partition specs, snapshots, refs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from keelson.sources.locations import PROPERTIES

MAIN = "main"


class BadMetadata(ValueError):
    """Metadata that misses what validation needs."""


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str  # as Spark names it; "nested" where it is no primitive
    required: bool = False
    has_default: bool = False


#: Primitive type names that Spark names otherwise.
SPARK_TYPES = {"long": "bigint", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "timestamp_ns": "timestamp_ns", "timestamptz_ns": "timestamptz_ns"}


def _type(value) -> str:
    if not isinstance(value, str):
        return "nested"
    return SPARK_TYPES.get(value, value.replace(" ", ""))


def _nested_ids(value) -> set[int]:
    """The field ids inside a nested type."""
    if isinstance(value, list):
        return set().union(*map(_nested_ids, value)) if value else set()
    if not isinstance(value, dict):
        return set()
    own = {v for k, v in value.items() if k in ("id", "element-id", "key-id", "value-id")}
    return own.union(*(_nested_ids(v) for v in value.values()))


@dataclass
class Schema:
    id: int
    fields: list[Field]
    nested: set[int] = field(default_factory=set)

    @staticmethod
    def of(raw: dict) -> Schema:
        fields = [Field(f["id"], f["name"], _type(f["type"]), f.get("required", False), f.get("initial-default") is not None) for f in raw["fields"]]
        return Schema(raw.get("schema-id", 0), fields, set().union(*(_nested_ids(f["type"]) for f in raw["fields"])) if raw["fields"] else set())

    def lookup(self, field_id: int) -> Field | str:
        """The top-level field, or ``nested`` or ``missing``."""
        found = next((f for f in self.fields if f.id == field_id), None)
        return found or ("nested" if field_id in self.nested else "missing")

    def names(self, field_ids) -> list[str]:
        out = []
        for i in field_ids:
            f = self.lookup(i)
            if isinstance(f, str):
                raise BadMetadata(f"field {i} is {f}")
            out.append(f.name)
        return out


@dataclass(frozen=True)
class Snapshot:
    id: int
    parent: int | None
    sequence: int
    manifest_list: str | None
    operation: str
    summary: dict

    @staticmethod
    def of(raw: dict) -> Snapshot:
        summary = raw.get("summary") or {}
        return Snapshot(raw["snapshot-id"], raw.get("parent-snapshot-id"), raw.get("sequence-number", 0), raw.get("manifest-list"), summary.get("operation", ""), summary)


@dataclass
class TableMetadata:
    uuid: str
    version: int
    location: str | None
    schemas: dict[int, Schema]
    current_schema: int
    specs: dict[int, list[dict]]
    default_spec: int | None
    default_sort_order: int | None
    last_column: int | None
    last_partition: int | None
    snapshots: dict[int, Snapshot]
    refs: dict[str, int]
    properties: dict[str, str]

    @property
    def main(self) -> int | None:
        return self.refs.get(MAIN)

    @property
    def locations(self) -> list[str]:
        """The folders in which the table's files may lie."""
        return [x for x in (self.location, *(self.properties.get(p) for p in PROPERTIES)) if x]

    def parents(self) -> dict[int, int | None]:
        return {s.id: s.parent for s in self.snapshots.values()}


def read(text: str | bytes) -> TableMetadata:
    """Metadata of format versions 1 to 3. A current snapshot without a ref of that name is main."""
    try:
        raw = json.loads(text)
        schemas = [Schema.of(s) for s in raw.get("schemas") or [raw["schema"]]]
        specs = {s["spec-id"]: s["fields"] for s in raw.get("partition-specs") or [{"spec-id": 0, "fields": raw.get("partition-spec", [])}]}
        refs = {name: r["snapshot-id"] for name, r in (raw.get("refs") or {}).items()}
        current = raw.get("current-snapshot-id")
        if MAIN not in refs and current not in (None, -1):
            refs[MAIN] = current
        return TableMetadata(
            raw["table-uuid"], raw["format-version"], raw.get("location"), {s.id: s for s in schemas}, raw.get("current-schema-id", schemas[-1].id), specs, raw.get("default-spec-id"),
            raw.get("default-sort-order-id"), raw.get("last-column-id"), raw.get("last-partition-id"), {s["snapshot-id"]: Snapshot.of(s) for s in raw.get("snapshots") or []}, refs, raw.get("properties") or {},
        )
    except (KeyError, TypeError, ValueError) as e:
        raise BadMetadata(str(e)) from e
