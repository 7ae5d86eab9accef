"""Values that are used more than once in an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, for which ``value`` is evaluated once, however often ``f`` names it, in lambdas too.

    What a lambda takes from outside is else evaluated again for each element.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))
