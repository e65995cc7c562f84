"""Property schemas: how a property is read from a row's fields, and how a predicate on it reads on those fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import P, all_of, any_of, eq, false, within, without

JAVA_MILLIS = "yyyy-MM-dd HH:mm:ss:SSS"


@lru_cache(4096)
def quoted(name: str) -> Column:
    """A column by its name, with dots as paths into nested fields."""
    return F.col(".".join(f"`{part}`" for part in name.split(".")))


class Property:
    """One property. ``fields`` are the columns it reads; ``known`` the values it can take, if these are few and known."""

    fields: tuple[str, ...] = ()
    known: frozenset[str] | None = None

    def expr(self) -> Column:
        raise NotImplementedError

    def keep(self) -> Column | None:
        """Which rows are elements at all, as far as this property says."""
        return None

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        """The rows whose value meets ``p``; None if no row can."""
        return p.column(self.expr(), kind)

    def at_path(self, path: str) -> Property | None:
        """The property below this one at a dotted path, if there can be one."""
        return None


@dataclass
class Field(Property):
    name: str
    type: str = "STRING"
    include: tuple = ()
    exclude: tuple = ()
    alias: dict[str, str] = field(default_factory=dict)
    nullable: bool = True

    def __post_init__(self) -> None:
        self.fields = (self.name,)
        self.known = frozenset(map(str, self.include)) or None

    def raw(self) -> Column:
        return quoted(self.name)

    def expr(self) -> Column:
        if not self.alias:
            return self.raw()
        c = self.raw().cast("string")
        shown = F.create_map(*[F.lit(x) for kv in self.alias.items() for x in kv])
        return F.coalesce(F.try_element_at(shown, c), c)

    def keep(self) -> Column | None:
        parts = []
        if self.include:
            parts.append(within(*self.include).column(self.raw()))
        if self.exclude:
            parts.append(without(*self.exclude).column(self.raw()))
        if not self.nullable:
            parts.append(self.raw().isNotNull())
        return all_of(parts)

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        if self.known is not None and p.op in ("eq", "within") and not self.known & {str(v) for v in p.values}:
            return None
        if self.alias and p.op in ("eq", "within"):
            # a shown value may come from several sources, and a source with another name shows as itself no more
            shown = [str(v) for v in p.values]
            sources = [k for k, v in self.alias.items() if v in shown] + [v for v in shown if v not in self.alias]
            return within(*sources).column(self.raw())
        return p.column(self.expr(), kind)


@dataclass
class TypedField(Field):
    """enum, uuid and timestamptz columns: text, lower-case text, and times."""

    def expr(self) -> Column:
        if self.type == "uuid":
            return F.lower(self.raw().cast("string"))
        return self.raw().cast("timestamp") if self.type == "timestamptz" else self.raw().cast("string")

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        if self.type == "uuid" and p.op in ("eq", "neq", "within", "without"):
            lower = tuple(str(v).lower() for v in p.values)
            p = {"eq": lambda: eq(lower[0]), "neq": lambda: without(*lower), "within": lambda: within(*lower), "without": lambda: without(*lower)}[p.op]()
        return p.column(self.expr(), kind)


@dataclass
class Json(Field):
    """A column of JSON text: an object as a whole, or below it any path, compared as text."""

    def expr(self) -> Column:
        return F.when(F.substring(F.ltrim(self.raw()), 1, 1) == "{", self.raw())

    def at_path(self, path: str) -> Property:
        return JsonPath(self.name, path)


@dataclass
class JsonPath(Property):
    name: str
    path: str

    def __post_init__(self) -> None:
        self.fields = (self.name,)

    def expr(self) -> Column:
        return F.get_json_object(quoted(self.name), "$." + self.path)


@dataclass
class Static(Property):
    value: Any

    def __post_init__(self) -> None:
        self.known = frozenset([str(self.value)])

    def expr(self) -> Column:
        return F.lit(self.value)

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        holds = p.test(self.value)
        if holds is None:
            return p.column(self.expr(), kind)
        return F.lit(True) if holds else None


@dataclass
class StaticDate(Property):
    value: str
    source: str
    display: str = JAVA_MILLIS

    def expr(self) -> Column:
        return F.date_format(F.to_timestamp(F.lit(self.value), self.source), self.display)


@dataclass
class DateField(Property):
    """A time in one text format (or a time column) shown in another."""

    name: str
    source: str | None
    display: tuple[str, ...] = (JAVA_MILLIS,)

    def __post_init__(self) -> None:
        self.fields = (self.name,)

    def time(self) -> Column:
        return F.try_to_timestamp(quoted(self.name), F.lit(self.source)) if self.source else quoted(self.name).cast("timestamp")

    def expr(self) -> Column:
        return F.date_format(self.time(), self.display[0])

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        if p.op.startswith("date_") or p.op in ("and", "or") and all(isinstance(v, P) and v.op.startswith("date_") for v in p.values):
            return p.column(self.time(), T.TimestampType())
        return p.column(self.expr(), kind)


@dataclass
class Multi(Property):
    """Several children as one list; a predicate asks that one of them meets it."""

    children: list[Property]

    def __post_init__(self) -> None:
        self.fields = tuple(f for c in self.children for f in c.fields)

    def expr(self) -> Column:
        return F.array_compact(F.array(*[c.expr() for c in self.children]))

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        return any_of(x for c in self.children if (x := c.predicate(p, kind)) is not None)


@dataclass
class Concatenate(Property):
    """Children joined by a delimiter; absent if one of them is. A value is split for the scan, and checked as a whole again."""

    children: list[Property]
    delimiter: str = "_"

    def __post_init__(self) -> None:
        self.fields = tuple(f for c in self.children for f in c.fields)

    def expr(self) -> Column:
        parts = [c.expr() for c in self.children]
        return F.when(all_of(x.isNotNull() for x in parts), F.concat_ws(self.delimiter, *[x.cast("string") for x in parts]))

    def predicate(self, p: P, kind: T.DataType | None) -> Column | None:
        whole = p.column(self.expr(), kind)
        if p.op not in ("eq", "within"):
            return whole
        parts = [str(v).split(self.delimiter) for v in p.values]
        if any(len(x) > len(self.children) for x in parts):  # a part holds the delimiter itself
            return whole
        parts = [x for x in parts if len(x) == len(self.children)]
        if not parts:
            return None
        own = [c.predicate(within(*{x[i] for x in parts}), T.StringType()) for i, c in enumerate(self.children)]
        return None if any(x is None for x in own) else all_of([*own, whole])


@dataclass
class Coalesce(Property):
    """The first child that has a value."""

    children: list[Property]

    def __post_init__(self) -> None:
        self.fields = tuple(f for c in self.children for f in c.fields)

    def expr(self) -> Column:
        return F.coalesce(*[c.expr() for c in self.children])


Builder = Callable[[Any, dict[str, Property]], Property | None]
#: Builders of further kinds, asked before the built-in ones, the last registered first.
BUILDERS: list[Builder] = []


def register(builder: Builder) -> None:
    BUILDERS.append(builder)


def build(config: Any, others: dict[str, Property] | None = None) -> Property:
    """The schema that a configuration value stands for. ``others`` are the properties built before it, for references."""
    others = others or {}
    for builder in reversed(BUILDERS):
        found = builder(config, others)
        if found is not None:
            return found
    if isinstance(config, str):
        if config.startswith("$"):
            return others[config[1:]]
        return Field(config[1:]) if config.startswith("@") else Static(config)
    if isinstance(config, list):
        return Multi([build(c, others) for c in config])
    if isinstance(config, dict):
        if "fields" in config:
            children = [build(c, others) for c in config["fields"]]
            return Coalesce(children) if config.get("type") == "coalesce" else Concatenate(children, config.get("delimiter", "_"))
        if "value" in config:
            display = config.get("displayFormat") or JAVA_MILLIS
            return StaticDate(config["value"], config["sourceFormat"], display) if "sourceFormat" in config else Static(config["value"])
        if "schema" in config:  # an index: the routing value itself
            return build(config["schema"], others)
        name = config["field"].removeprefix("@")
        if "sourceFormat" in config or "displayFormats" in config:
            return DateField(name, config.get("sourceFormat"), tuple(config.get("displayFormats") or (JAVA_MILLIS,)))
        kind = str(config.get("type", "STRING"))
        options = {"name": name, "type": kind, "include": tuple(config.get("include", ())), "exclude": tuple(config.get("exclude", ())), "alias": dict(config.get("alias", {})), "nullable": config.get("nullable", True)}
        if kind in ("enum", "uuid", "timestamptz"):
            return TypedField(**options)
        if kind == "jsonb":
            return Json(**options)
        if "alias" in config and isinstance(config["alias"], str):
            raise ValueError("alias maps source values to shown ones")
        return Field(**options)
    return Static(config)


__all__ = ["Property", "Field", "TypedField", "Json", "JsonPath", "Static", "StaticDate", "DateField", "Multi", "Concatenate", "Coalesce", "build", "register", "false"]
