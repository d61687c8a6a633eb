"""Value-to-category rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(value: Column, steps: list[tuple[float, object]], last) -> Column:
    """First label whose upper bound (exclusive) lies above the value."""
    out = F.lit(last)
    for bound, label in reversed(steps):
        out = F.when(value < bound, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


# Codes of the anomaly scale.
Z_NO_ANOMALY = 6
Z_NO_REGION = 7


def z_code(z: Column, region: Column | None = None) -> Column:
    """0..5 from strongly low to strongly high, 6 without a score, 7 without a region."""
    code = (
        F.when(z <= -2.0, 0).when(z <= -1.5, 1).when(z < 1.5, 2)
        .when(z < 2.0, 3).when(z < 3.0, 4).when(z.isNotNull(), 5)
        .otherwise(Z_NO_ANOMALY)
    )
    if region is None:
        return code
    return F.when(region.isNull(), Z_NO_REGION).otherwise(code)


def flashiness_class(index: Column) -> Column:
    return _steps(index, [(0.1, "Low"), (0.3, "Moderate"), (0.6, "High")], "Very High")


def proximity_class(percent: Column) -> Column:
    return _steps(percent, [(25, "far"), (75, "typical"), (95, "near")], "at record")


def rho_class(rho: Column) -> Column:
    return _steps(F.abs(rho), [(0.58, "weak"), (0.66, "mid")], "strong")


def rho_size(rho: Column) -> Column:
    return 6.0 + 8.0 * (F.abs(rho) - 0.5) / 0.25


def significant(*p_values: Column, level: float = 0.05) -> Column:
    """True when every p-value is below the level; a missing one means no."""
    verdict = F.lit(True)
    for p in p_values:
        verdict = verdict & F.coalesce(p < level, F.lit(False))
    return verdict


def coupling_tier(rho: Column, is_significant: Column) -> Column:
    strength = F.abs(rho)
    return (
        F.when(~is_significant, "not_significant")
        .when(strength >= 0.5, "tight")
        .when(strength >= 0.3, "moderate")
        .otherwise("weak")
    )


def decoupled(rho: Column) -> Column:
    return F.coalesce(F.abs(rho) < 0.2, F.lit(False))


def verified_year(first_year: Column, year: int = 2004) -> Column:
    """``year`` when the record is known to reach back that far, else null."""
    return F.when(first_year <= year, F.lit(year))


def above(value: Column, threshold: Column) -> Column:
    return F.coalesce(value >= threshold, F.lit(False))
