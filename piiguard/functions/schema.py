"""Declared schemas of nested JSON, compiled to one column that names the first value that does not fit.

A schema is made of :class:`Record` (known fields; others are dropped), :class:`List`, :class:`Values` (any names, all values alike),
:class:`Optional` fields (may be missing, but not null), :class:`OneOf` and the kinds of single values. The compiled column
walks a VARIANT in the order of the fields: null where all fits, else a path such as ``$.elements[3].tag``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from piiguard.functions.patterns import bind


@dataclass(frozen=True)
class Kind:
    """A value of one JSON kind; ``good`` and ``bad`` are JSON that fits and that doesn't."""

    kinds: tuple[str, ...] = ()
    good: str = "null"
    bad: str = "null"


def Text() -> Kind:
    return Kind(("STRING",), '"words"', "7")


def Number() -> Kind:
    return Kind(("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "1.5", '"1.5"')


def Flag() -> Kind:
    return Kind(("BOOLEAN",), "true", '"true"')


@dataclass(frozen=True)
class Anything:
    good: str = '[1, {"x": null}]'


@dataclass(frozen=True)
class OneOf:
    words: tuple[str, ...]
    bad: str = '"another"'

    @property
    def good(self) -> str:
        return f'"{self.words[0]}"'


@dataclass(frozen=True)
class Record:
    fields: dict = field(default_factory=dict)
    bad: str = "[]"


@dataclass(frozen=True)
class List:
    of: object
    bad: str = "{}"


@dataclass(frozen=True)
class Values:
    of: object
    bad: str = "[]"


@dataclass(frozen=True)
class Optional:
    of: object


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _faulted(schema, path: Column) -> Callable[[Column], Column]:
    return lambda value: F.struct(first_fault(schema, value, path).alias("fault"))


def first_fault(schema, value: Column, path: Column | None = None) -> Column:
    """The path of the first value that does not fit ``schema``, null if all do; a null ``value`` (no JSON) does not."""
    path = F.lit("$") if path is None else path
    ok = F.lit(None).cast("string")
    if isinstance(schema, Anything):
        return F.when(value.isNull(), path).otherwise(ok)
    if isinstance(schema, Kind):
        of_kind = F.lit(False)
        for kind in schema.kinds:
            of_kind = of_kind | _kind(value).startswith(kind)
        return F.when(F.coalesce(of_kind, F.lit(False)), ok).otherwise(path)
    if isinstance(schema, OneOf):
        known = (_kind(value) == "STRING") & F.try_variant_get(value, "$", "string").isin(*schema.words)
        return F.when(F.coalesce(known, F.lit(False)), ok).otherwise(path)
    if isinstance(schema, Record):
        def fields(members: Column) -> Column:
            found = []
            for name, of in schema.fields.items():
                own, at = F.try_element_at(members, F.lit(name)), F.concat(path, F.lit(f".{name}"))
                inner = of.of if isinstance(of, Optional) else of
                fault = bind(own, _faulted(inner, at))["fault"]
                found.append(F.when(own.isNotNull(), fault) if isinstance(of, Optional) else fault)
            return F.struct(F.coalesce(*found, ok).alias("fault"))

        members = F.try_variant_get(value, "$", "map<string,variant>")
        return F.when(members.isNull(), path).otherwise(bind(members, fields)["fault"])
    if isinstance(schema, List):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = lambda v, i: first_fault(schema.of, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        return F.when(items.isNull(), path).otherwise(F.get(F.array_compact(F.transform(items, each)), F.lit(0)))
    if isinstance(schema, Values):
        members = F.try_variant_get(value, "$", "map<string,variant>")
        each = lambda e: first_fault(schema.of, e["value"], F.concat(path, F.lit("."), e["key"]))
        return F.when(members.isNull(), path).otherwise(F.get(F.array_compact(F.transform(F.map_entries(members), each)), F.lit(0)))
    raise TypeError(f"no schema: {schema}")


def _places(schema, path: str = "$") -> Iterator[tuple[str, object, bool]]:
    """Path, schema and whether it may be missing of every value of the template."""
    if isinstance(schema, Record):
        for name, of in schema.fields.items():
            inner = of.of if isinstance(of, Optional) else of
            yield f"{path}.{name}", inner, isinstance(of, Optional)
            yield from _places(inner, f"{path}.{name}")
    elif isinstance(schema, List):
        yield f"{path}[1]", schema.of, True
        yield from _places(schema.of, f"{path}[1]")
    elif isinstance(schema, Values) and not isinstance(schema.of, Anything):
        yield f"{path}.key", schema.of, True
        yield from _places(schema.of, f"{path}.key")


def faults(schema) -> list[tuple[str, str, str]]:
    """Faults of one value each: its place, the JSON put there, and the path to be named.

    Every value that has a kind gets one of another; every required field is null, and, with its name changed, missing.
    """
    out = []
    for path, of, may_miss in _places(schema):
        if not isinstance(of, Anything):
            out.append((path, of.bad, path))
            out.append((path, "null", path))
        if not may_miss:
            out.append((f"{path}?", "_", path))
    return out


def template(schema, part: Callable[[str, str | Column], Column], concat: Callable[[list], Column], path: str = "$") -> Column:
    """JSON that fits ``schema``; ``part`` gives what stands at a place: the value's JSON, and at ``place?`` what its name is changed by."""
    if isinstance(schema, Record):
        pieces: list = ["{"]
        for i, (name, of) in enumerate(schema.fields.items()):
            inner, at = of.of if isinstance(of, Optional) else of, f"{path}.{name}"
            pieces += [", " * (i > 0) + f'"{name}', part(f"{at}?", ""), '": ', part(at, template(inner, part, concat, at))]
        return concat([*pieces, ', "more": [null]}'])
    if isinstance(schema, List):
        plain = template(schema.of, lambda _, good: F.lit(good) if isinstance(good, str) else good, concat, path)
        return concat(["[", plain, ", ", part(f"{path}[1]", template(schema.of, part, concat, f"{path}[1]")), "]"])
    if isinstance(schema, Values):
        own = template(schema.of, part, concat, f"{path}.key")
        return concat(['{"key": ', own if isinstance(schema.of, Anything) else part(f"{path}.key", own), "}"])
    return F.lit(schema.good)
