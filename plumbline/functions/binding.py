"""`let`: evaluate a column once and use it many times inside a higher-order function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row. A column that a lambda refers to can be inlined into the lambda
    (a filter pushed below the projection that made it does that) and is then evaluated once per element; a lambda
    variable can not. Null in, `body(null)` out."""
    return F.get(F.transform(F.array(value), body), 0)
