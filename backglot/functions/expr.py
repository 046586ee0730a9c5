"""Small expression helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected column into a lambda body, which would
    evaluate it again for every array element. A lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_strings() -> Column:
    return F.array().cast("array<string>")
