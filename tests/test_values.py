"""Answers by text and by value, each with cases of its own."""

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.functions import values


@pytest.mark.parametrize(
    ("answer", "want"),
    [("12", 12), ("-3.50", Fraction(-7, 2)), (".5", Fraction(1, 2)), ("1,234,567", 1234567), (r"\frac{3}{4}", Fraction(3, 4)), (r"\dfrac34", Fraction(3, 4)), (r"2\frac{1}{3}", Fraction(7, 3)), ("2 1/3", Fraction(7, 3)), (r"-2\frac13", Fraction(-7, 3)), (r"\frac{1+\frac{1}{2}}{3}", Fraction(1, 2)), ("3 \\cdot 4", 12), ("2^{10}", 1024), ("2^-1", None), (r"\sqrt{\frac{9}{16}}", Fraction(3, 4)), (r"\sqrt{2}", None), (r"3\sqrt{4}", 6), ("45\\%", 45), (r"\$1,500", 1500), (r"30^\circ", 30), ("5 cm", 5), ("12 square feet", None), ("2.5 million", 2500000), (r"10\text{ meters}", 10), ("(2+3)(4)", 20), ("1/0", None), ("", None), (None, None), ("x+1", None), ("9^(9^9)", None), ("1" * 600, None), ("((((" * 200, None)],
)
def test_values(answer, want):
    assert values.value(answer) == want


@pytest.mark.parametrize(
    ("one", "two", "by_text", "by_value"),
    [
        (r"\dfrac12", "1/2", True, True), ("0.5", r"\frac{1}{2}", True, True), ("1.25", r"\frac{5}{4}", False, True), (r"\frac{2}{4}", r"\frac{1}{2}", False, False), ("4.0", "4", False, True), ("8/2", "4", False, False),
        ("(1, 2]", "(1,2]", True, True), ("(1,2)", "[1,2]", False, False), ("(1, 1.25)", r"(1,\frac{5}{4})", False, True), ("(1,2)", "(2,1)", False, False), ("1,234", "1234", True, True), ("(1,2,3)", "(1,2)", False, False),
        ("x = 7", "7", True, False), ("Paris", "paris", False, True), ("50 %", "50", True, True), (None, "1", False, False), ("", "", False, False), ("12 cm", "12", False, True), (r"3\frac{1}{2}", "3.5", False, True), ("north", "south", False, False),
    ],
)
def test_both_ways(one, two, by_text, by_value):
    assert (values.by_text(one, two), values.by_value(one, two)) == (by_text, by_value)
    assert values.answers_equal(one, two) == (by_text or by_value)


@given(st.fractions(max_denominator=999), st.sampled_from([1, 10, 1000]))
@settings(max_examples=200, deadline=None)
def test_every_way_to_write_a_fraction(x, scale):
    sign, top, low = "-" if x < 0 else "", abs(x.numerator), x.denominator
    whole, rest = divmod(top, low)
    forms = [f"{sign}{top}/{low}", rf"{sign}\frac{{{top}}}{{{low}}}", rf"{sign}\frac{{{top * scale}}}{{{low * scale}}}", f"{sign}({top})/({low})", rf"{sign}{top} \div {low}"]
    forms += [rf"{sign}{whole}\frac{{{rest}}}{{{low}}}", f"{sign}{whole} {rest}/{low}"] if whole else []
    assert all(values.value(f) == x for f in forms), forms
    assert values.value(str(Fraction(top * scale, low * scale))) == abs(x)


def test_pairs_are_read_once(spark):
    rows = spark.createDataFrame([(i, ["1.25", "2", None][i % 3], r"\frac{5}{4}") for i in range(60)], "i int, a string, b string").repartition(4)
    got = {r.i: (r.by_text, r.by_value) for r in values.compared(rows, "a", "b").collect()}
    assert got == {i: (False, i % 3 == 0) for i in range(60)}
    assert values.compared(rows.limit(0), "a", "b").count() == 0
