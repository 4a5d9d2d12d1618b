"""Arithmetic formulas as Columns: names, numbers, ``+ - * /``, signs and brackets, with the usual precedence, and nothing else."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_]\w*)|([-+*/()]))")


def tokens_of(formula: str) -> list[str]:
    out, at = [], 0
    while at < len(formula.rstrip()):
        m = TOKEN.match(formula, at)
        if not m:
            raise ValueError(f"not arithmetic at {at}: {formula}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def arithmetic(formula: str, value: Callable[[str], Column]) -> Column:
    """The formula over ``value`` of each name; null where a divisor is 0. What isn't a formula raises ValueError before any plan is made."""
    left = tokens_of(formula)[::-1]

    def take(*wanted: str) -> str | None:
        return left.pop() if left and left[-1] in wanted else None

    def chain(part: Callable[[], Column], make: dict[str, Callable[[Column, Column], Column]]) -> Column:
        out = part()
        while op := take(*make):
            out = make[op](out, part())
        return out

    def total() -> Column:
        return chain(product, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def product() -> Column:
        return chain(signed, {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)})

    def signed() -> Column:
        if sign := take("+", "-"):
            inner = signed()
            return -inner if sign == "-" else inner
        if take("("):
            inner = total()
            if not take(")"):
                raise ValueError(f"a bracket is open: {formula}")
            return inner
        if not left or left[-1] in ("*", "/", ")"):
            raise ValueError(f"a value is missing: {formula}")
        word = left.pop()
        return value(word) if word[0].isalpha() or word[0] == "_" else F.lit(float(word))

    out = total()
    if left:
        raise ValueError(f"too much of a formula from {left[-1]} on: {formula}")
    return out
