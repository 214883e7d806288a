"""Name an expression once, so that later uses do not repeat it in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once. Meant for small tables."""
    return F.transform(F.array(value), use)[0]
