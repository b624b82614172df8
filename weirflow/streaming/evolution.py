"""Differences between two versions of a stream's schema, field by field, and which of them a compatibility mode forbids.

A field within structs is named by its path. Each difference is one row of (field, kind, old, new), so that a report, a gate and a test read the same list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

# Promotions that a reader resolves itself.
PROMOTIONS = {("integer", "long"), ("integer", "float"), ("integer", "double"), ("long", "float"), ("long", "double"), ("float", "double"), ("string", "binary"), ("binary", "string")}

#: The kinds of difference that each mode forbids; without a mode, as under BACKWARD.
ALWAYS = frozenset({"retyped", "required"})
FORBIDDEN = {"BACKWARD": ALWAYS | {"removed"}, "FULL": ALWAYS | {"removed"}, "FORWARD": ALWAYS, "NONE": ALWAYS}


@dataclass(frozen=True)
class Difference:
    """``old`` and ``new`` are the types on either side, None where the field is not."""

    field: str
    kind: str
    old: str | None
    new: str | None


def leaves(schema: T.StructType, path: str = "") -> Iterator[tuple[str, T.StructField]]:
    """Fields that are no structs, by path."""
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, f"{path}{f.name}.")
        else:
            yield path + f.name, f


def kinds(old: T.StructField | None, new: T.StructField | None) -> Iterator[str]:
    if old is None:
        yield "added" if new.nullable else "added, required"
    elif new is None:
        yield "removed"
    else:
        if old.dataType != new.dataType:
            yield "widened" if (old.dataType.typeName(), new.dataType.typeName()) in PROMOTIONS else "retyped"
        if old.nullable != new.nullable:
            yield "optional" if new.nullable else "required"


def differences(old: T.StructType, new: T.StructType) -> list[Difference]:
    """All differences, by field."""
    a, b = dict(leaves(old)), dict(leaves(new))
    shown = lambda f: None if f is None else f.dataType.simpleString()
    return [Difference(name, kind, shown(a.get(name)), shown(b.get(name))) for name in sorted(a.keys() | b.keys()) for kind in kinds(a.get(name), b.get(name))]


def breaking(found: list[Difference], mode: str | None = None) -> list[Difference]:
    """Those that readers of the mode do not survive."""
    name = (mode or "BACKWARD").upper()
    if name not in FORBIDDEN:
        raise ValueError(f"no such mode: {mode}; there are {', '.join(FORBIDDEN)}")
    return [d for d in found if d.kind in FORBIDDEN[name]]
