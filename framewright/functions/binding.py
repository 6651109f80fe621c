"""A value computed once for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row, also where a lambda inside uses it for every element.

    Left to separate projections or repeated in the expression, the optimiser puts the value's expression into the lambda.
    """
    return F.transform(F.array(value), body)[0]
