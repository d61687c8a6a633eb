"""Scores and the small arithmetic around them, all null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_score(value: Column, mu: Column, sigma: Column, floor: float = 0.0) -> Column:
    """(value − mu) / sigma, null unless sigma exceeds ``floor``."""
    return F.when(sigma > floor, (value - mu) / sigma)


def flat_z_score(value: Column, mu: Column, sigma: Column) -> Column:
    """z-score that reads a series without spread as 0 instead of null."""
    return F.when(sigma > 0, (value - mu) / sigma).otherwise(value * 0.0)


def is_extreme(z: Column, threshold: float) -> Column:
    return F.abs(z) >= threshold


def band(mu: Column, sigma: Column, width: float) -> tuple[Column, Column]:
    return mu - width * sigma, mu + width * sigma


def moves_together(a: Column, b: Column) -> Column:
    """Both strictly above or both strictly below zero; unknown counts as no."""
    return F.coalesce(((a > 0) & (b > 0)) | ((a < 0) & (b < 0)), F.lit(False))


def completeness(observation_count: Column) -> Column:
    return F.when(observation_count > 0, 1.0).otherwise(0.0)
