"""Column helpers shared by the native text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A plain alias would be inlined by the optimizer into every place that
    uses it, also inside lambdas, where it would run again per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty give none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def window_hashes(tokens: Column, width: int) -> Column:
    """64-bit hash of every run of ``width`` tokens, in order; a text with
    fewer tokens has none."""
    def runs(hashed: Column) -> Column:
        last = F.size(hashed) - F.lit(width - 1)
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1),
            lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(width)])))
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), runs)
