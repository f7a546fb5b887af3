"""A value that an expression uses often, worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value bound to a variable: what is inside a branch or a lambda does not work it out again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
