"""Expression helpers."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times, also inside lambdas."""
    return F.transform(F.array(value), use)[0]
