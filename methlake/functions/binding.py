"""Binding a value inside an expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body mentions it.

    A lambda body is evaluated per element, so anything that does not depend on the element is bound outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
