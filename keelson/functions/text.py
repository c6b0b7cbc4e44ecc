"""Small texts of the control plane: durations, sizes, escapes in paths, domain states."""

from __future__ import annotations

import re
from urllib.parse import quote

#: Units in seconds and in bytes.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
BYTES = {"": 1, "b": 1, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12}
LIMIT = 1 << 64


def _quantity(text: str, units: dict[str, int]) -> int:
    m = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2] not in units:
        raise ValueError(f"cannot read {text!r}")
    n = int(m[1]) * units[m[2]]
    if n >= LIMIT:
        raise ValueError(f"{text!r} is too large")
    return n


def duration(text: str) -> int:
    """Seconds of ``90s``, ``30m``, ``24h``, ``7d``."""
    return _quantity(text, SECONDS)


def byte_size(text: str) -> int:
    """Bytes of ``2GiB`` or ``10 MB``; units in any case, none for bytes."""
    return _quantity(text.lower(), BYTES)


def escaped(name: str) -> str:
    """A name as one segment of a path."""
    return quote(name, safe="-_.~")


def unescaped(text: str) -> str | None:
    """The name of a segment; None where an escape is cut off, no hex, or gives no UTF-8."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def ambiguous(path: str) -> bool:
    """Whether a path may name another resource to someone else who reads it: separators that are escaped or turned round, dots as segments, unreadable escapes."""
    low = path.lower()
    return "\\" in low or "%2f" in low or "%5c" in low or unescaped(path) is None or any(s.replace("%2e", ".") in (".", "..") for s in low.split("/"))


def domain_state(heads: dict[str, int | None]) -> str:
    """The main snapshots of a domain's tables by uuid; a dash for a table without one."""
    return ",".join(f"{u}@{'-' if heads[u] is None else heads[u]}" for u in sorted(heads))


def read_domain_state(text: str) -> dict[str, int | None] | None:
    """What ``domain_state`` wrote; None for anything else."""
    found = [re.fullmatch(r"(.*)@(-|[+-]?[0-9]+)", part, re.S) for part in text.split(",")] if text else []
    return {m[1]: None if m[2] == "-" else int(m[2]) for m in found} if all(found) else None
