"""Three-valued truth as bit sets: 1 may be false, 2 may be true, 3 both; and comparisons of candidate sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FALSE, TRUE, BOTH = 1, 2, 3


def negate(a: Column) -> Column:
    return (F.shiftright(a.bitwiseAND(2), 1)).bitwiseOR(F.shiftleft(a.bitwiseAND(1), 1))


def both_hold(a: Column, b: Column) -> Column:
    """AND: may be true if both may, may be false if either may."""
    return a.bitwiseAND(b).bitwiseAND(2).bitwiseOR(a.bitwiseOR(b).bitwiseAND(1))


def either_holds(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b).bitwiseAND(2).bitwiseOR(a.bitwiseAND(b).bitwiseAND(1))


def equal(a: Column, b: Column, open_: Column) -> Column:
    """Whether values of two candidate sets are equal: surely only as the same single value, of closed sets."""
    return (
        F.when(open_, F.lit(BOTH))
        .when(~F.arrays_overlap(a, b), F.lit(FALSE))
        .when((F.size(a) == 1) & (F.size(b) == 1), F.lit(TRUE))
        .otherwise(F.lit(BOTH))
    )


def digits(candidates: Column, open_: Column) -> Column:
    """Whether all, none or some of the candidates are digits."""
    each = F.transform(candidates, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit(TRUE)).otherwise(F.lit(FALSE)))
    return F.when(open_, F.lit(BOTH)).otherwise(F.aggregate(each, F.lit(0), lambda n, x: n.bitwiseOR(x)))


def compare(a: Column, op: str, b: Column) -> Column:
    """An exact comparison of decimals as a truth; it may be either with an operand that is not known."""
    ops = {"EQ": a == b, "NE": a != b, "LT": a < b, "LE": a <= b, "GT": a > b, "GE": a >= b}
    return F.when(ops[op], F.lit(TRUE)).when(~ops[op], F.lit(FALSE)).otherwise(F.lit(BOTH))
