"""The project's token estimate as a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the characters that make text denser in tokens.
DENSE_CHARS = "{}();=<>[]"


def token_estimate(text: Column) -> Column:
    """ceil(len / (4 - 1.5 k / len)) with k dense characters; 0 for empty text, null for null."""
    n = F.length(text)
    k = n - F.length(F.translate(text, DENSE_CHARS, ""))
    return F.when(n == 0, F.lit(0)).otherwise(
        F.ceil(n / (F.lit(4.0) - (k / n) * F.lit(1.5)))
    ).cast("long")
