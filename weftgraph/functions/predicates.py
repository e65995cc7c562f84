"""The filter language: value predicates that become Columns.

``P.column(col, kind)`` gives a Boolean Column; NULL never matches. Literals are brought to the column's type on the driver, so that
the comparison stays one that a scan can take; a literal that does not fit the type matches nothing.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)
#: Formats in which dates may be written.
DATE_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def false() -> Column:
    return F.lit(False)


class Misfit(ValueError):
    """A literal that a column's type cannot hold."""


def fit(value: Any, kind: T.DataType | None) -> Any:
    """``value`` as a literal for a column of type ``kind``."""
    if kind is None or value is None or isinstance(value, Column):
        return value
    if isinstance(kind, T.StringType):
        return ("true" if value else "false") if isinstance(value, bool) else str(value)
    if isinstance(kind, T.BooleanType):
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "false"):
            return str(value).lower() == "true"
        raise Misfit(value)
    if isinstance(kind, NUMERIC):
        if isinstance(value, bool):
            raise Misfit(value)
        if isinstance(value, (int, float)):
            return value
        text = str(value).strip()
        try:
            return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
        except ValueError as e:
            raise Misfit(value) from e
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(value, (dt.datetime, dt.date)):
            return value
        if isinstance(value, (int, float)):
            raise Misfit(value)
        return parse_time(str(value))
    return value


def parse_time(text: str) -> dt.datetime:
    """A time in ISO form or one of DATE_FORMATS; without an offset it is UTC."""
    for form in ("%d/%m/%Y %H:%M:%S", "%d/%m/%Y"):
        try:
            return dt.datetime.strptime(text, form).replace(tzinfo=dt.UTC)
        except ValueError:
            pass
    try:
        found = dt.datetime.fromisoformat(text)
    except ValueError as e:
        raise Misfit(text) from e
    return found if found.tzinfo else found.replace(tzinfo=dt.UTC)


class P:
    """A predicate over one value. ``make`` gives its Column; ``values`` are its literals, for those who rewrite it."""

    def __init__(self, op: str, values: tuple, make: Callable[[Column, T.DataType | None], Column]) -> None:
        self.op, self.values, self.make = op, values, make

    def column(self, col: Column, kind: T.DataType | None = None) -> Column:
        try:
            return self.make(col, kind)
        except Misfit:
            return false()

    def and_(self, other: P) -> P:
        return P("and", (self, other), lambda c, k: self.column(c, k) & other.column(c, k))

    def or_(self, other: P) -> P:
        return P("or", (self, other), lambda c, k: self.column(c, k) | other.column(c, k))

    def negate(self) -> P:
        return P("not", (self,), lambda c, k: c.isNotNull() & ~self.column(c, k))

    __and__, __or__, __invert__ = and_, or_, negate

    def test(self, value: Any) -> bool | None:
        """The predicate on a constant, where that needs no Spark; None if it does."""
        return _TESTS[self.op](value, self.values) if self.op in _TESTS else None


_TESTS: dict[str, Callable[[Any, tuple], bool]] = {
    "eq": lambda x, v: str(x) == str(v[0]),
    "neq": lambda x, v: str(x) != str(v[0]),
    "within": lambda x, v: str(x) in {str(i) for i in v},
    "without": lambda x, v: str(x) not in {str(i) for i in v},
}


def _compare(op: str, value: Any, make: Callable[[Column, Any], Column]) -> P:
    return P(op, (value,), lambda c, k: false() if value is None else make(c, fit(value, k)))


def _flat(values: tuple) -> tuple:
    return tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else values


def eq(v: Any) -> P:
    return _compare("eq", v, lambda c, x: c == x)


def neq(v: Any) -> P:
    """Not equal; a literal of another type differs from every value that is there."""

    def make(c: Column, k: T.DataType | None) -> Column:
        try:
            return false() if v is None else c != fit(v, k)
        except Misfit:
            return c.isNotNull()

    return P("neq", (v,), make)


def gt(v: Any) -> P:
    return _compare("gt", v, lambda c, x: c > x)


def gte(v: Any) -> P:
    return _compare("gte", v, lambda c, x: c >= x)


def lt(v: Any) -> P:
    return _compare("lt", v, lambda c, x: c < x)


def lte(v: Any) -> P:
    return _compare("lte", v, lambda c, x: c <= x)


def between(a: Any, b: Any) -> P:
    """From ``a``, to below ``b``."""
    return gte(a).and_(lt(b))


def inside(a: Any, b: Any) -> P:
    return gt(a).and_(lt(b))


def outside(a: Any, b: Any) -> P:
    return lt(a).or_(gt(b))


def _fitting(values: Iterable[Any], kind: T.DataType | None) -> list:
    out = []
    for v in values:
        try:
            out.append(fit(v, kind))
        except Misfit:
            continue
    return [v for v in out if v is not None]


def within(*values: Any) -> P:
    values = _flat(values)

    def make(c: Column, k: T.DataType | None) -> Column:
        some = _fitting(values, k)
        return c.isin(some) if some else false()

    return P("within", values, make)


def without(*values: Any) -> P:
    """Present and not among ``values``."""
    values = _flat(values)

    def make(c: Column, k: T.DataType | None) -> Column:
        some = _fitting(values, k)
        return c.isNotNull() & ~c.isin(some) if some else c.isNotNull()

    return P("without", values, make)


def not_(p: P) -> P:
    return p.negate()


def exists() -> P:
    return P("exists", (), lambda c, k: c.isNotNull())


def type_of(name: str) -> P:
    """Present, in a column of this type: string, int, long, float, double, number, boolean, date, list or map."""
    kinds = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "number": NUMERIC, "boolean": T.BooleanType, "date": (T.DateType, T.TimestampType), "list": T.ArrayType, "map": (T.MapType, T.StructType)}
    wanted = kinds[name.lower()]
    return P("type_of", (name,), lambda c, k: c.isNotNull() if isinstance(k, wanted) else false())


def _text(op: str, value: str, make: Callable[[Column], Column]) -> P:
    return P(op, (value,), lambda c, k: make(c.cast("string")))


class TextP:
    """Text predicates with literal operands; ``regex`` finds anywhere."""

    @staticmethod
    def startingWith(v: str) -> P:
        return _text("startingWith", v, lambda c: c.startswith(v))

    @staticmethod
    def endingWith(v: str) -> P:
        return _text("endingWith", v, lambda c: c.endswith(v))

    @staticmethod
    def containing(v: str) -> P:
        return _text("containing", v, lambda c: c.contains(v))

    @staticmethod
    def regex(v: str) -> P:
        return _text("regex", v, lambda c: c.rlike(v))

    @staticmethod
    def notStartingWith(v: str) -> P:
        return TextP.startingWith(v).negate()

    @staticmethod
    def notEndingWith(v: str) -> P:
        return TextP.endingWith(v).negate()

    @staticmethod
    def notContaining(v: str) -> P:
        return TextP.containing(v).negate()

    @staticmethod
    def notRegex(v: str) -> P:
        return TextP.regex(v).negate()


class Text:
    """Text search: globs, whole-value patterns, prefixes and spelling within three edits."""

    @staticmethod
    def like(v: str) -> P:
        glob = re.sub(r"([%_\\])", r"\\\1", v).replace("*", "%").replace("?", "_")
        return _text("like", v, lambda c: c.like(glob))

    @staticmethod
    def regexp(v: str) -> P:
        return _text("regexp", v, lambda c: c.rlike(f"^(?:{v})$"))

    @staticmethod
    def prefix(v: str) -> P:
        return _text("prefix", v, lambda c: c.startswith(v))

    @staticmethod
    def fuzzy(v: str) -> P:
        return _text("fuzzy", v, lambda c: F.levenshtein(c, F.lit(v), 3) >= 0)

    @staticmethod
    def unlike(v: str) -> P:
        return Text.like(v).negate()

    @staticmethod
    def unregexp(v: str) -> P:
        return Text.regexp(v).negate()

    @staticmethod
    def unprefix(v: str) -> P:
        return Text.prefix(v).negate()

    @staticmethod
    def unfuzzy(v: str) -> P:
        return Text.fuzzy(v).negate()


def as_time(c: Column, kind: T.DataType | None) -> Column:
    """A column as a timestamp: text is read in any of DATE_FORMATS or ISO form."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS], F.try_to_timestamp(c))


class Date:
    """Comparisons of times; operands are dates, times or text in a known format."""

    @staticmethod
    def _of(p: P) -> P:
        return P(f"date_{p.op}", p.values, lambda c, k: p.make(as_time(c, k), k if isinstance(k, (T.TimestampType, T.DateType)) else T.TimestampType()))

    @staticmethod
    def eq(v: Any) -> P:
        return Date._of(eq(v))

    @staticmethod
    def neq(v: Any) -> P:
        return Date._of(neq(v))

    @staticmethod
    def gt(v: Any) -> P:
        return Date._of(gt(v))

    @staticmethod
    def gte(v: Any) -> P:
        return Date._of(gte(v))

    @staticmethod
    def lt(v: Any) -> P:
        return Date._of(lt(v))

    @staticmethod
    def lte(v: Any) -> P:
        return Date._of(lte(v))

    @staticmethod
    def between(a: Any, b: Any) -> P:
        return Date.gte(a).and_(Date.lt(b))

    @staticmethod
    def inside(a: Any, b: Any) -> P:
        return Date.gt(a).and_(Date.lt(b))

    @staticmethod
    def outside(a: Any, b: Any) -> P:
        return Date.lt(a).or_(Date.gt(b))

    @staticmethod
    def within(*v: Any) -> P:
        return Date._of(within(*v))

    @staticmethod
    def without(*v: Any) -> P:
        return Date._of(without(*v))


def predicate(value: Any) -> P:
    """A predicate as it is; a list as ``within``; any other value as ``eq``."""
    if isinstance(value, P):
        return value
    return within(*value) if isinstance(value, (list, tuple, set, frozenset)) else eq(value)


def all_of(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, false())
