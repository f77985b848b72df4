"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use(column)`` with the column computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(column), use), F.lit(0))
