"""Human-readable quantities and sizes as built-in expressions.

Rule: pick the largest unit u_i with x >= base**i, print x / base**i rounded
half-up to 2 decimals (plain decimal text), then a space and the unit.

Fixed values (unit names):
  quantity (base 1000): '', 'thousand', 'million', 'billion', 'trillion', 'quadrillion'
  size (base 1024):     'B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB'
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY_UNITS = ["", "thousand", "million", "billion", "trillion", "quadrillion"]
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def _scaled(x: Column, base: int, units: list[str]) -> Column:
    xd = x.cast("decimal(38,6)")
    expr = None
    for i in reversed(range(len(units))):
        scale = base ** i
        val = F.round(xd / F.lit(scale), 2).cast("decimal(38,2)").cast("string")
        text = F.concat_ws(" ", val, F.lit(units[i])) if units[i] else val
        cond = xd >= F.lit(scale)
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr.otherwise(F.round(xd, 2).cast("decimal(38,2)").cast("string"))


def readable_quantity(x: Column) -> Column:
    """1234567 -> '1.23 million'."""
    return _scaled(x, 1000, QUANTITY_UNITS)


def readable_size(x: Column) -> Column:
    """1536 -> '1.50 KiB'."""
    return _scaled(x, 1024, SIZE_UNITS)
