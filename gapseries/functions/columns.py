"""Scalar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MS_PER_DAY = 86_400_000.0
# 2**32: the hash helpers below give an unsigned 32-bit integer.
HASH_SPACE = 4_294_967_296.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_category(code: str | Column, n: int = 3) -> Column:
    """First ``n`` characters of a code (position 1, so SQL engines agree)."""
    return F.substring(col(code), 1, n)


def indicator(c: str | Column, value) -> Column:
    """1 / 0 for equality, null for a null input."""
    return (col(c) == F.lit(value)).cast("int")


def epoch_days(df: DataFrame, time: str) -> Column:
    """Time as fractional days since the epoch at millisecond precision.

    Milliseconds are floored, as a JVM ``Timestamp.getTime`` does.  Works for
    ``timestamp_ntz`` (no session time zone involved), ``timestamp`` and
    numbers (taken as days already).
    """
    dtype = df.schema[time].dataType
    c = F.col(time)
    if isinstance(dtype, T.TimestampNTZType):
        ms = F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    elif isinstance(dtype, T.TimestampType):
        ms = F.unix_millis(c)
    elif isinstance(dtype, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    else:
        return c.cast("double")
    return ms.cast("double") / F.lit(MS_PER_DAY)


def key_hash(cols: Sequence[str | Column], seed: int | str = 0) -> Column:
    """Unsigned 32-bit hash of a key: first 8 hex digits of md5.

    Layout-independent (unlike ``rand``/``randomSplit``), so a split or a
    sample does not change when the data is repartitioned, and any SQL engine
    with md5 can reproduce it: ``('0x' || substr(md5(k), 1, 8))::BIGINT``.
    """
    parts = [F.lit(str(seed))] + [col(c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def key_unit(cols: Sequence[str | Column], seed: int | str = 0) -> Column:
    """The key hash scaled to [0, 1)."""
    return key_hash(cols, seed) / F.lit(HASH_SPACE)


def uncertainty_band(mean: str | Column, variance: str | Column) -> tuple[Column, Column]:
    """``mean -/+ sqrt(variance)``; negative round-off variance clamps to 0."""
    sd = F.sqrt(F.greatest(col(variance), F.lit(0.0)))
    return col(mean) - sd, col(mean) + sd


def binary_label(c: str | Column, positive) -> Column:
    """1 when the label equals the explicitly named positive class, else 0."""
    return (col(c) == F.lit(positive)).cast("int")


def grid_values(lo: float, hi: float, step: float, accumulate: bool = False) -> list[float]:
    """Inclusive ``lo .. hi by step``.

    Values are ``lo + i * step`` by default; ``accumulate=True`` adds the step
    repeatedly instead (a running double sum), which reproduces the last-digit
    values a sequential double range produces.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    n = int(math.floor(round((hi - lo) / step, 9))) + 1
    if not accumulate:
        return [lo + i * step for i in range(n)]
    out, x = [], lo
    for _ in range(n):
        out.append(x)
        x += step
    return out
