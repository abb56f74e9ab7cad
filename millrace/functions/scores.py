"""Popularity signals, calibration and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def static_hot(views: Column, likes: Column, marks: Column, dislikes: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.20 * F.log1p(views) + 0.40 * F.log1p(likes) + 0.30 * F.log1p(marks) - 0.10 * F.log1p(dislikes))


def realtime_hot(views_1h: Column, views_24h: Column, likes_24h: Column, marks_24h: Column) -> Column:
    return 0.20 * F.log1p(views_1h) + 0.25 * F.log1p(views_24h) + 0.35 * F.log1p(likes_24h) + 0.20 * F.log1p(marks_24h)


def unlock_signal(unlocks: Column) -> Column:
    return F.log1p(unlocks)


def calibrate(score: Column, least: float) -> Column:
    """A similarity as a share of the way from ``least`` to 1; 0 below."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))
    if abs(1 - least) < 1e-9:
        return F.when(s >= 1 - 1e-9, 1.0).otherwise(0.0)
    return F.when(s < least, 0.0).otherwise((s - least) / (1 - least))


def min_max(value: Column, over: WindowSpec) -> Column:
    """Place between the window's least and largest value; 0 where all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    flat = (high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, 0.0).otherwise((value - low) / (high - low))


def billionths(value: Column) -> Column:
    """A score in whole billionths: equal for scores that differ by rounding alone, and much cheaper than rounding decimals."""
    return F.floor(value * 1e9 + 0.5)


def popularity_multiplier(factor: Column, popularity: Column) -> Column:
    return F.greatest(F.lit(0.01), 1 + factor * 0.5 * F.log1p(10 * popularity))


def decay(days: Column, rate: float = 0.95) -> Column:
    return F.pow(F.lit(rate), days)


def whole_days(later: Column, earlier: Column) -> Column:
    """Full spans of 24 hours between two times."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)
