"""Answers compared in two ways: by their text in a plain form, and by what they come to as numbers, tuples and intervals.

The second way takes an answer apart into tokens and reads them by a small grammar into one rational number: sums, products,
fractions of anything, whole powers, roots that come out even, mixed numbers, decimals and scales such as million. What the
grammar does not read has no value and is compared as text. Each distinct pair of answers is read once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.answers import plain_math

# Units that an answer may end in, and words for powers of ten.
UNITS = ("degree", "centimeter", "cm", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard")
SCALES = {"million": 6, "billion": 9, "trillion": 12}
UNIT = re.compile(rf"(?:{'|'.join(UNITS)})(?:es)?s? *(?:\^\{{?[0-9]+\}}?)?")
TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<command>\\[a-zA-Z]+)|(?P<sign>[-+*/^(){}·×]))")
#: Answers with larger powers are not worked out.
MOST_POWER = 64


class _Reader:
    """Recursive descent over the tokens of one answer; ValueError where the grammar does not fit."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append((m.lastgroup, m[m.lastgroup], bool(re.match(r"\s", text[at:]))))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def kind(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens) or want is not None and self.peek() != want:
            raise ValueError(want)
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Fraction:
        found = self.sum()
        if self.at < len(self.tokens):
            raise ValueError("more follows")
        return found

    def sum(self) -> Fraction:
        found = self.product()
        while self.peek() in ("+", "-"):
            found = found + self.product() if self.take() == "+" else found - self.product()
        return found

    def product(self) -> Fraction:
        if self.peek() in ("-", "+"):
            return -self.product() if self.take() == "-" else self.product()
        found = self.power()
        while (t := self.peek()) is not None:
            if t in ("*", "·", "×", "\\cdot", "\\times"):
                self.take()
                found *= self.signed()
            elif t in ("/", "\\div"):
                self.take()
                found /= self.signed()
            elif t in ("(", "\\sqrt"):
                found *= self.power()
            else:
                break
        return found

    def signed(self) -> Fraction:
        return -self.signed() if self.peek() == "-" and self.take() else self.power()

    def power(self) -> Fraction:
        base = self.atom()
        if self.peek() != "^":
            return base
        self.take()
        up = self.group() if self.peek() in ("{", "(") else self.atom()
        if up.denominator != 1 or abs(up) > MOST_POWER:
            raise ValueError("no whole power")
        return base ** int(up)

    def group(self) -> Fraction:
        if self.peek() not in ("{", "("):
            raise ValueError("no group")
        close = "}" if self.take() == "{" else ")"
        found = self.sum()
        self.take(close)
        return found

    def argument(self) -> Fraction:
        """Of a command: a group, or one digit."""
        if self.peek() == "{":
            return self.group()
        if self.kind() != "number":
            raise ValueError("argument")
        kind, text, space = self.tokens[self.at]
        self.tokens[self.at : self.at + 1] = [(kind, text[0], space)] + ([(kind, text[1:], False)] if len(text) > 1 else [])
        return Fraction(self.take())

    def fraction(self) -> Fraction:
        self.take()
        top = self.argument()
        return top / self.argument()

    def atom(self) -> Fraction:
        if self.kind() == "number":
            found = Fraction(self.take())
            # A whole number before a fraction: a mixed number.
            if found.denominator == 1 and self.peek() in ("\\frac", "\\dfrac", "\\tfrac"):
                return found + self.fraction()
            if found.denominator == 1 and [self.kind(k) for k in range(3)] == ["number", "sign", "number"] and self.tokens[self.at][2] and self.tokens[self.at + 1][1] == "/":
                top = Fraction(self.take())
                self.take()
                return found + top / Fraction(self.take())
            return found
        if self.peek() in ("\\frac", "\\dfrac", "\\tfrac"):
            return self.fraction()
        if self.peek() == "\\sqrt":
            self.take()
            inner = self.argument()
            roots = [math.isqrt(max(0, x)) for x in (inner.numerator, inner.denominator)]
            if inner < 0 or roots[0] ** 2 != inner.numerator or roots[1] ** 2 != inner.denominator:
                raise ValueError("no even root")
            return Fraction(*roots)
        return self.group()


def tidied(answer: str) -> str:
    """Without a text command around it, units, signs of money and of a hundredth, and commas inside numbers; scales as powers."""
    a = answer.strip()
    if m := re.fullmatch(r"\\text\{(.+?)\}", a, re.S):
        a = m[1]
    a = re.sub(r"\\(?:left|right|!|,|;)|\\?[$%]|\^\s*\{?\\circ\}?", "", a)
    for word, tens in SCALES.items():
        a = re.sub(rf"\s*{word}s?", f"*10^{tens}", a)
    a = UNIT.sub("", re.sub(r"\\text\{([^{}]*)\}", r"\1", a))
    while (b := re.sub(r"(\d),(\d{3})(?!\d)", r"\1\2", a)) != a:
        a = b
    a = a.strip()
    return a[1:-1] if a.startswith("{") and a.endswith("}") and "}" not in a[1:-1] else a


def value(answer: str | None) -> Fraction | None:
    """The rational number that an answer comes to, if the grammar reads one."""
    try:
        return _Reader(tidied(answer)).whole() if answer and len(answer) <= 500 else None
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


def by_text(given: str | None, truth: str | None) -> bool:
    """Equal in plain form."""
    a, b = plain_math(given), plain_math(truth)
    return bool(a) and a == b


def parts(answer: str) -> tuple[str, str, list[str]]:
    """Brackets around an answer, and what stands between its commas; an answer that is no tuple is one part without any."""
    a = tidied(answer)
    if len(a) > 2 and a[0] in "([" and a[-1] in ")]" and not set("()[]") & set(a[1:-1]) and "," in a:
        return a[0], a[-1], [x.strip() for x in a[1:-1].split(",")]
    return "", "", [a]


def _plain_fraction(text: str) -> str | None:
    """A fraction of two whole numbers as a/b, however it is written."""
    m = re.fullmatch(r"(-?)(?:\\[dt]?frac\s*\{?(-?\d+)\}?\s*\{(\d+)\}|(\d+)\s*/\s*(\d+))", text.strip())
    return f"{m[1]}{m[2] or m[4]}/{m[3] or m[5]}" if m else None


def by_value(given: str | None, truth: str | None) -> bool:
    """Equal as values: the same brackets, and part by part the same number or, without one, the same text. Of two plain
    fractions one that is not reduced alike is another answer, and so is a number that is not whole where the truth is written
    as one, or the other way about."""
    if not given or not truth or not given.strip() or not truth.strip():
        return False
    (*around, one), (*wanted, two) = parts(given), parts(truth)
    if around != wanted or len(one) != len(two):
        return False

    def same(x: str, y: str) -> bool:
        p, q = _plain_fraction(x), _plain_fraction(y)
        if p and q:
            return p == q
        v, w = value(x), value(y)
        if v is None or w is None:
            return re.sub(r"[\s{}]", "", x).lower() == re.sub(r"[\s{}]", "", y).lower() != ""
        written_whole = [bool(re.fullmatch(r"-?\d+(?:\.0*)?", re.sub(r"\s", "", t))) for t in (x, y)]
        return v == w and written_whole[0] == written_whole[1]

    return all(map(same, one, two))


def answers_equal(given: str | None, truth: str | None) -> bool:
    return by_text(given, truth) or by_value(given, truth)


def compared(rows: DataFrame, given: str, truth: str) -> DataFrame:
    """`rows` with by_text and by_value. Distinct pairs of answers are read once and joined back; the join is left to Spark."""

    @F.pandas_udf("by_text boolean, by_value boolean")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame({"by_text": list(map(by_text, a, b)), "by_value": list(map(by_value, a, b))}).astype(bool)

    pairs = rows.select(F.col(given).alias("_a"), F.col(truth).alias("_b")).distinct().withColumn("_r", read("_a", "_b"))
    met = rows.join(pairs, F.col(given).eqNullSafe(F.col("_a")) & F.col(truth).eqNullSafe(F.col("_b")))
    return met.select(*rows.columns, "_r.by_text", "_r.by_value")
