"""Scalar steps as Columns: strings, numbers, dates, lists and maps."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.predicates import P, as_time, predicate

UNITS = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY"}


def _items(v: Any) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(x) for x in v])


def _substring(c: Column, start: int, end: int | None = None) -> Column:
    """From ``start`` to below ``end``; negative ones count from the end."""
    n = F.length(c)
    first = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    last = n if end is None else (F.least(F.lit(end), n) if end >= 0 else n + end)
    return F.when(last > first, F.substring(c, first + 1, last - first)).otherwise(F.when(c.isNotNull(), F.lit("")))


def _each(f: Callable[[Column, P], Column]) -> Callable[..., Column]:
    return lambda c, p: f(c, predicate(p))


#: Step name -> function of the current value and the step's arguments.
SCALARS: dict[str, Callable[..., Column]] = {
    # strings
    "toUpper": lambda c: F.upper(c),
    "toLower": lambda c: F.lower(c),
    "length": lambda c: F.length(c),
    "trim": lambda c: F.trim(c),
    "lTrim": lambda c: F.ltrim(c),
    "rTrim": lambda c: F.rtrim(c),
    "substring": _substring,
    "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)),
    "split": lambda c, sep=" ": F.split(c, "" if sep == "" else re.escape(sep), -1),
    "concat": lambda c, *more: F.concat(c, *[m if isinstance(m, Column) else F.lit(m) for m in more]),
    "reverse": lambda c: F.reverse(c),
    "asString": lambda c: c.cast("string"),
    "format": lambda c, form: F.format_string(form, c),
    # numbers and Booleans
    "asNumber": lambda c: c.try_cast("double"),
    "asLong": lambda c: c.try_cast("long"),
    "asBool": lambda c: c.try_cast("boolean"),
    "abs": lambda c: F.abs(c),
    # dates
    "asDate": lambda c: as_time(c, None),
    "dateAdd": lambda c, unit, n: F.timestamp_add(UNITS[unit.lower()], F.lit(n), c),
    "dateDiff": lambda c, other: F.timestamp_diff("SECOND", other if isinstance(other, Column) else F.lit(other).cast("timestamp"), c),
    # lists
    "conjoin": lambda c, sep: F.array_join(c, sep),
    "all": _each(lambda c, p: F.forall(c, lambda x: p.column(x))),
    "any": _each(lambda c, p: F.exists(c, lambda x: p.column(x))),
    "noneOf": _each(lambda c, p: ~F.exists(c, lambda x: p.column(x))),
    "intersect": lambda c, v: F.array_intersect(c, _items(v)),
    "difference": lambda c, v: F.array_except(c, _items(v)),
    "disjunct": lambda c, v: F.array_union(F.array_except(c, _items(v)), F.array_except(_items(v), c)),
    "merge": lambda c, v: F.array_union(c, _items(v)),
    "combine": lambda c, v: F.concat(c, _items(v)),
    "product": lambda c, v: F.flatten(F.transform(c, lambda x: F.transform(_items(v), lambda y: F.array(x, y)))),
    # per-collection forms of the reducing steps
    "countLocal": lambda c: F.size(c).cast("long"),
    "sumLocal": lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.element_at(c, 1), lambda a, x: a + x),
    "minLocal": lambda c: F.array_min(c),
    "maxLocal": lambda c: F.array_max(c),
    "meanLocal": lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c),
    "orderLocal": lambda c, desc=False: F.sort_array(c, not desc),
    "rangeLocal": lambda c, a, b: F.slice(c, a + 1, max(0, b - a)),
    "limitLocal": lambda c, n: F.slice(c, 1, n),
    "tailLocal": lambda c, n: F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n),
    "dedupLocal": lambda c: F.array_distinct(c),
    "sampleLocal": lambda c, n: F.slice(F.shuffle(c), 1, n),
    # maps
    "keysLocal": lambda c: F.map_keys(c),
    "valuesLocal": lambda c: F.map_values(c),
}

NUMBER, NAME, OTHER = re.compile(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), re.compile(r"[A-Za-z_]\w*"), re.compile(r"[-+*/%^(),]")
FUNCTIONS: dict[str, Callable[..., Column]] = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "signum": F.signum, "cbrt": F.cbrt, "pow": F.pow}


def math_names(text: str) -> list[str]:
    """The variables of an arithmetic expression, in order of their first use."""
    return list(dict.fromkeys(n for n in NAME.findall(re.sub(r"[A-Za-z_]\w*\s*(?=\()", "", text))))


def math_column(text: str, variables: dict[str, Column]) -> Column:
    """An arithmetic expression (+ - * / % ^, parentheses, functions) over ``variables``."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = next((m for r in (NUMBER, NAME, OTHER) if (m := r.match(text, at))), None)
        if m is None:
            raise ValueError(f"{text!r}: unexpected {text[at]!r}")
        tokens.append(m[0])
        at = m.end()
    tokens.append("")
    place = 0

    def peek() -> str:
        return tokens[place]

    def take(wanted: str | None = None) -> str:
        nonlocal place
        if wanted is not None and tokens[place] != wanted:
            raise ValueError(f"{text!r}: {wanted!r} is missing")
        place += 1
        return tokens[place - 1]

    def atom() -> Column:
        t = take()
        if t == "(":
            c = total()
            take(")")
            return c
        if t == "-":
            return -power()
        if NUMBER.fullmatch(t):
            return F.lit(float(t)) if re.search(r"[.eE]", t) else F.lit(int(t))
        if NAME.fullmatch(t):
            if peek() == "(":
                take("(")
                args = [total()]
                while peek() == ",":
                    take(",")
                    args.append(total())
                take(")")
                return FUNCTIONS[t](*args)
            return variables[t]
        raise ValueError(f"{text!r}: unexpected {t!r}")

    def power() -> Column:
        base = atom()
        if peek() == "^":
            take()
            return F.pow(base, power())
        return base

    def term() -> Column:
        c = power()
        while peek() in ("*", "/", "%") and peek():
            op, d = take(), power()
            c = c * d if op == "*" else c / d if op == "/" else c % d
        return c

    def total() -> Column:
        c = term()
        while peek() in ("+", "-") and peek():
            op, d = take(), term()
            c = c + d if op == "+" else c - d
        return c

    found = total()
    take("")
    return found
