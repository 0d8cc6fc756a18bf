"""Writing long column expressions as Spark SQL text.

The metric expressions nest lambdas many levels deep. Built with ``Column``
objects, each operator costs several calls into the JVM and one plan takes
seconds to write down; as text it is one ``expr`` call. The names below are
Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = count()


def _quote(text: str) -> str:
    plain = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{plain}'"


def text_of(value: object) -> str:
    """A value as SQL: an expression as it is, anything else as a literal."""
    if isinstance(value, Expr):
        return value.text
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2**31 - 1 else str(value)
    return _quote(str(value))


def _infix(op: str) -> Callable[[Expr, object], Expr]:
    return lambda self, other: Expr(f"({self.text} {op} {text_of(other)})")


class Expr:
    """A piece of SQL with the operators of a column."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    __add__, __sub__, __mul__ = _infix("+"), _infix("-"), _infix("*")
    __truediv__, __mod__ = _infix("/"), _infix("%")
    __lt__, __le__, __gt__, __ge__ = _infix("<"), _infix("<="), _infix(">"), _infix(">=")
    __eq__, __ne__ = _infix("="), _infix("<>")
    __and__, __or__ = _infix("and"), _infix("or")
    __hash__ = None

    def __radd__(self, other: object) -> Expr:
        return Expr(f"({text_of(other)} + {self.text})")

    def __rsub__(self, other: object) -> Expr:
        return Expr(f"({text_of(other)} - {self.text})")

    def __rmul__(self, other: object) -> Expr:
        return Expr(f"({text_of(other)} * {self.text})")

    def __neg__(self) -> Expr:
        return Expr(f"(- {self.text})")

    def __invert__(self) -> Expr:
        return Expr(f"(not {self.text})")

    def __getitem__(self, field: str) -> Expr:
        return Expr(f"{self.text}.`{field}`")

    def alias(self, name: str) -> Expr:
        return Expr(self.text, name)

    def cast(self, ddl: str) -> Expr:
        return Expr(f"cast({self.text} as {ddl})")

    def try_cast(self, ddl: str) -> Expr:
        return Expr(f"try_cast({self.text} as {ddl})")

    def isin(self, *values: object) -> Expr:
        return Expr(f"({self.text} in ({', '.join(map(text_of, values))}))")

    def is_null(self) -> Expr:
        return Expr(f"({self.text} is null)")

    def is_not_null(self) -> Expr:
        return Expr(f"({self.text} is not null)")

    def startswith(self, prefix: str) -> Expr:
        return Expr(f"startswith({self.text}, {text_of(prefix)})")

    @property
    def column(self) -> Column:
        done = F.expr(self.text)
        return done.alias(self.name) if self.name else done


class Case(Expr):
    """``when`` chains; without ``otherwise`` the rest is null."""

    def __init__(self, branches: str):
        super().__init__(f"(case{branches} end)")
        self._branches = branches

    def when(self, condition: Expr, value: object) -> Case:
        return Case(f"{self._branches} when {condition.text} then {text_of(value)}")

    def otherwise(self, value: object) -> Expr:
        return Expr(f"(case{self._branches} else {text_of(value)} end)")


def when(condition: Expr, value: object) -> Case:
    return Case(f" when {condition.text} then {text_of(value)}")


def col(name: str) -> Expr:
    """A column by name, or any SQL expression."""
    return Expr(name)


def lit(value: object) -> Expr:
    return Expr(text_of(value))


def call(function: str, *args: object) -> Expr:
    return Expr(f"{function}({', '.join(map(_argument, args))})")


def _argument(value: object) -> str:
    if not callable(value) or isinstance(value, Expr):
        return text_of(value)
    names = [f"v{next(_names)}" for _ in signature(value).parameters]
    body = value(*map(Expr, names))
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {text_of(body)}"


def struct(*fields: Expr) -> Expr:
    parts = [f"{_quote(f.name)}, {f.text}" for f in fields]
    return Expr(f"named_struct({', '.join(parts)})")


def trim(text: Expr, chars: str = " ") -> Expr:
    return Expr(f"trim(both {_quote(chars)} from {text.text})")


def ltrim(text: Expr, chars: str = " ") -> Expr:
    return Expr(f"trim(leading {_quote(chars)} from {text.text})")


def rtrim(text: Expr, chars: str = " ") -> Expr:
    return Expr(f"trim(trailing {_quote(chars)} from {text.text})")


def __getattr__(name: str) -> Callable[..., Expr]:
    """Any other name is the Spark function of that name."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *args: call(name, *args)
