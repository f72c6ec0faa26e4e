"""Scalar column formulas used across the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def identifier(col: Column | str) -> Column:
    """Identifiers are compared trimmed and in upper case; an empty one becomes NULL."""
    text = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(text != "", text)


def is_bad(x: Column) -> Column:
    """NaN or infinite (NULL counts as not bad)."""
    return F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(False))


def finite(x: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(INF)), x)


def bias(long: Column, short: Column) -> Column:
    """Signed share of the long side in [-1, 1]; NULL when both sides are zero."""
    return F.try_divide(long - short, long + short)


def long_short_ratio(long: Column, short: Column, *, infinite: bool = False) -> Column:
    """long/short. A zero short side gives inf (record view) or NULL (analysis view)."""
    empty = F.lit(INF) if infinite else F.lit(None).cast("double")
    return F.when(short == 0, empty).otherwise(F.try_divide(long, short))


def direction(x: Column, tolerance: Column | float) -> Column:
    """RISING / FALLING / FLAT by sign with an absolute tolerance; UNKNOWN when NULL."""
    bound = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return (
        F.when(x.isNull(), "UNKNOWN")
        .when(F.abs(x) <= bound, "FLAT")
        .when(x > 0, "RISING")
        .otherwise("FALLING")
    )


def sufficiency(n: Column, required: int) -> Column:
    """Share of the required history that is present, at most 1."""
    return F.least(n / F.lit(float(required)), F.lit(1.0))


def exceeds(z: Column, threshold: float | None) -> Column:
    """abs(z) > threshold; NULL while either is unknown."""
    if threshold is None:
        return F.lit(None).cast("boolean")
    return F.abs(z) > F.lit(float(threshold))


def half_split_delta(values: Column) -> Column:
    """mean(second half) - mean(first half) of an array; the middle item counts as second half."""
    n = F.size(values)
    mid = F.floor(n / 2).cast("int")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

    first = F.try_divide(total(F.slice(values, F.lit(1), mid)), mid)
    second = F.try_divide(total(F.slice(values, mid + 1, n - mid)), n - mid)
    return F.when(n >= 2, second - first)


def fill_price(price: Column, is_buy: Column, slippage_bps: Column) -> Column:
    """Price moved against the trader by slippage."""
    shift = price * (slippage_bps / F.lit(10000.0))
    return F.when(is_buy, price + shift).otherwise(price - shift)


def micros(interval) -> int:
    """A timedelta or a bar code as microseconds."""
    from perpflow.schema import step_micros

    if hasattr(interval, "total_seconds"):
        return round(interval.total_seconds() * 1_000_000)
    return step_micros(interval)


def profit_factor(gain: Column, loss: Column, wins: Column) -> Column:
    """Gross gain over gross loss: inf with gains only, NULL with neither."""
    return (
        F.when(loss > 0, F.try_divide(gain, loss))
        .when(wins > 0, F.lit(INF))
        .otherwise(F.lit(None).cast("double"))
    )
