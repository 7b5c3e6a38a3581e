"""Whole-number arithmetic with defined edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 9223372036854775807


def add_saturating(a: Column, b: Column) -> Column:
    """a + b, or the largest long where that overflows or either is negative."""
    return F.when((a < 0) | (b < 0), F.lit(MOST)).otherwise(F.coalesce(F.try_add(a, b), F.lit(MOST)))


def multiply_saturating(a: Column, b: Column) -> Column:
    return F.when((a < 0) | (b < 0), F.lit(MOST)).otherwise(F.coalesce(F.try_multiply(a, b), F.lit(MOST)))


def ceil_div(a: Column, b: int) -> Column:
    """a over b, rounded up; 0 where a isn't positive."""
    return F.call_function("div", F.greatest(a, F.lit(0)) + (b - 1), F.lit(b))


def tokens(size: Column) -> tuple[Column, Column]:
    """The most and the usual number of tokens of so many bytes."""
    return size, ceil_div(size, 4)


def attempts(calls: Column, modes: int, retries: int) -> Column:
    """HTTP requests at most; overflow raises."""
    return calls * F.lit(modes).cast("long") * F.lit(retries + 1).cast("long")


def back_off(attempt: Column, base: float, most: float = 20.0, retry_after: Column | None = None) -> Column:
    """Seconds to wait: linear in the attempt (from 0), unless the server says; never more than `most`."""
    wait = F.lit(base) * (attempt + 1)
    return F.least(F.coalesce(retry_after, wait) if retry_after is not None else wait, F.lit(most))


def split_descendants(roots: Column, levels: Column, budget: Column) -> Column:
    """Scopes below so many roots that may each be halved `levels` times, as far as the budget goes."""
    return F.least(multiply_saturating(roots, F.call_function("shiftleft", F.lit(1).cast("long"), (levels + 1).cast("int")) - 2), budget)
