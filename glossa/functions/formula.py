"""Prediction formulas over region totals, compiled to one Column when the query is planned.

Grammar, loosest first: alternatives `|`, conjunctions `&`, one comparison `< > =`, sums and differences with
signs and parentheses; operands are numbers and references `(region;%condition%)`, where the region `*` is the
sum over all regions. A reference to a missing region gives null, so that the item leaves the denominator.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
_TOKEN = re.compile(r"\s*(?:(\(\s*(?:\d+|\*)\s*;\s*%[^%]*%\s*\))|(\d+\.?\d*(?:[eE][+-]?\d+)?)|([-+()<>=&|]))")


class FormulaError(ValueError):
    """A formula that the grammar does not allow."""


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:at + 12]!r}")
        out.append(next((kind, g) for kind, g in zip(("ref", "num", "op"), m.groups()) if g))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, refer: Callable[[str, str], Column]):
        self.rest, self.refer = _tokens(text), refer

    def peek(self) -> str:
        return self.rest[0][1] if self.rest and self.rest[0][0] == "op" else ""

    def take(self, what: str) -> None:
        if self.peek() != what:
            raise FormulaError(f"expected {what}")
        self.rest.pop(0)

    def chain(self, sign: str, below: Callable[[], Column], join: Callable) -> Column:
        out = below()
        while self.peek() == sign:
            self.take(sign)
            out = join(out, below())
        return out

    def either(self) -> Column:
        return self.chain("|", self.both, lambda a, b: a | b)

    def both(self) -> Column:
        return self.chain("&", self.compared, lambda a, b: a & b)

    def compared(self) -> Column:
        saved = list(self.rest)
        if self.peek() == "(":  # parentheses around a whole condition, or around a sum
            try:
                self.take("(")
                inner = self.either()
                self.take(")")
                if self.peek() in ("", "&", "|", ")"):
                    return inner
            except FormulaError:
                pass
            self.rest = saved
        left, sign = self.total(), self.peek()
        if sign not in ("<", ">", "="):
            raise FormulaError("no comparison")
        self.take(sign)
        right = self.total()
        return left < right if sign == "<" else left > right if sign == ">" else F.abs(left - right) <= TOLERANCE

    def total(self) -> Column:
        out = self.term()
        while self.peek() in ("+", "-"):
            sign = self.rest.pop(0)[1]
            out = out + self.term() if sign == "+" else out - self.term()
        return out

    def term(self) -> Column:
        if not self.rest:
            raise FormulaError("unexpected end")
        kind, value = self.rest.pop(0)
        if kind == "num":
            return F.lit(float(value))
        if kind == "ref":
            region, condition = re.fullmatch(r"\(\s*(\d+|\*)\s*;\s*%([^%]*)%\s*\)", value).groups()
            return self.refer(region, condition)
        if value in "+-":
            inner = self.term()
            return inner if value == "+" else -inner
        if value == "(":
            inner = self.total()
            self.take(")")
            return inner
        raise FormulaError(f"unexpected {value}")


def compile_formula(text: str, refer: Callable[[str, str], Column]) -> Column:
    """A boolean Column for a formula; refer(region, condition) gives the Column of a reference."""
    parser = _Parser(text, refer)
    out = parser.either()
    if parser.rest:
        raise FormulaError(f"left over: {parser.rest[0][1]}")
    return out


def region_totals(totals: Column) -> Callable[[str, str], Column]:
    """References into a map from "condition|region" to a total; `*` sums a condition's regions."""

    def refer(region: str, condition: str) -> Column:
        if region != "*":
            return F.element_at(totals, f"{condition}|{int(region)}")
        own = F.map_filter(totals, lambda k, _: k.startswith(f"{condition}|"))
        return F.aggregate(F.map_values(own), F.lit(0.0), lambda a, x: a + x)

    return refer
