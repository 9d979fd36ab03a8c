"""Scalar expressions over bands: a small recursive-descent parser that gives Spark columns, never Python functions.

Names are case-insensitive. A comparison or logical operator gives 1 or 0. Where an operand is missing the result is,
and so is a result that is not a number; division by zero is missing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9.]*)|(\|\||&&|<=|>=|==|!=|<<|>>|[-+*/%^()!<>,&|~=]))")


def _number(x: Column) -> Column:
    return F.when(x, 1.0).when(~x, 0.0)


def _true(x: Column) -> Column:
    return x != 0


def _factorial(x: Column) -> Column:
    return F.when((x >= 0) & (x <= 20), F.factorial(F.floor(x).cast("int")).cast("double")).when(x > 20, F.aggregate(F.sequence(F.lit(1), F.floor(F.least(x, F.lit(170.0))).cast("int")), F.lit(1.0), lambda a, v: a * v))


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "abs": (1, F.abs), "acos": (1, F.acos), "asin": (1, F.asin), "atan": (1, F.atan), "atan2": (2, F.atan2), "ceil": (1, lambda x: F.ceil(x).cast("double")), "cos": (1, F.cos),
    "cosh": (1, F.cosh), "exp": (1, F.exp), "fac": (1, _factorial), "floor": (1, lambda x: F.floor(x).cast("double")), "ln": (1, F.ln), "log": (1, F.log10), "log10": (1, F.log10),
    "ncr": (2, lambda n, r: F.round(F.try_divide(_factorial(n), _factorial(r) * _factorial(n - r)))), "npr": (2, lambda n, r: F.round(F.try_divide(_factorial(n), _factorial(n - r)))),
    "pow": (2, F.pow), "sin": (1, F.sin), "sinh": (1, F.sinh), "sqrt": (1, F.sqrt), "tan": (1, F.tan), "tanh": (1, F.tanh), "round": (1, F.round),
    "min": (2, F.least), "max": (2, F.greatest), "iif": (3, lambda c, a, b: F.when(_true(c), a).when(~_true(c), b)), "isnan": (1, lambda x: F.when(x.isNull(), 1.0).otherwise(0.0)),
}
CONSTANTS = {"pi": math.pi, "e": math.e}


def _bits(name: str) -> Callable[[Column, Column], Column]:
    """A bit operator over whole numbers; of truth values it gives what the logical one gives."""
    return lambda a, b: getattr(a.cast("long"), name)(b.cast("long")).cast("double")


class Parser:
    """One expression; names maps what it may refer to, in small letters, to columns."""

    def __init__(self, text: str, names: Mapping[str, Column]):
        self.text, self.names, self.used = text, names, set()
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r} in {text!r}")
            self.tokens.append(next((k, v) for k, v in zip(("number", "name", "mark"), m.groups(), strict=True) if v is not None))
            at = m.end()
        self.at = 0

    def parse(self) -> Column:
        out = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        # neither NaN nor what is too large for a double is a value
        return F.when(F.abs(out) < F.lit(math.inf), out)

    def _take(self, *marks: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" and self.tokens[self.at][1] in marks:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _left(self, operand: Callable[[], Column], operators: dict[str, Callable[[Column, Column], Column]]) -> Column:
        out = operand()
        while (mark := self._take(*operators)) is not None:
            out = operators[mark](out, operand())
        return out

    def _or(self) -> Column:
        return self._left(self._and, {"||": lambda a, b: _number(_true(a) | _true(b)), "|": _bits("bitwiseOR")})

    def _and(self) -> Column:
        return self._left(self._equal, {"&&": lambda a, b: _number(_true(a) & _true(b)), "&": _bits("bitwiseAND")})

    def _equal(self) -> Column:
        return self._left(self._order, {"==": lambda a, b: _number(a == b), "=": lambda a, b: _number(a == b), "!=": lambda a, b: _number(a != b)})

    def _order(self) -> Column:
        ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return self._left(self._shift, {k: (lambda a, b, f=f: _number(f(a, b))) for k, f in ops.items()})

    def _shift(self) -> Column:
        power = lambda b: F.pow(F.lit(2.0), b)
        return self._left(self._sum, {"<<": lambda a, b: a * power(b), ">>": lambda a, b: F.floor(a / power(b)).cast("double")})

    def _sum(self) -> Column:
        return self._left(self._product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def _product(self) -> Column:
        return self._left(self._power, {"*": lambda a, b: a * b, "/": F.try_divide, "%": F.try_mod})

    def _power(self) -> Column:
        return self._left(self._sign, {"^": F.pow})

    def _sign(self) -> Column:
        if (mark := self._take("-", "+", "!", "~")) is None:
            return self._atom()
        x = self._sign()
        return {"-": lambda: -x, "+": lambda: x, "!": lambda: _number(~_true(x)), "~": lambda: F.bitwise_not(x.cast("long")).cast("double")}[mark]()

    def _atom(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.text!r} ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return F.lit(float(value))
        if kind == "mark":
            if value != "(":
                raise ValueError(f"unexpected {value!r} in {self.text!r}")
            out = self._or()
            self._close()
            return out
        name = value.lower()
        if name in FUNCTIONS and self._take("("):
            n, f = FUNCTIONS[name]
            args = [self._or()]
            while self._take(","):
                args.append(self._or())
            self._close()
            if len(args) != n:
                raise ValueError(f"{name} takes {n} values")
            return f(*args)
        if name in self.names:
            self.used.add(name)
            return self.names[name]
        if name in CONSTANTS:
            if self._take("("):
                self._close()
            return F.lit(CONSTANTS[name])
        raise ValueError(f"unknown name {value!r} in {self.text!r}")

    def _close(self) -> None:
        if not self._take(")"):
            raise ValueError(f"a bracket is not closed in {self.text!r}")


def compile_expression(text: str, names: Mapping[str, Column]) -> tuple[Column, set[str]]:
    """The column, and the names that the text refers to."""
    p = Parser(text, names)
    return p.parse(), p.used
