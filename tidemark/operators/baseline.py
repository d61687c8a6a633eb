"""Seasonal baselines over a circular day-of-year window."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from tidemark.functions.calendar import DOY_CYCLE
from tidemark.operators.daily import SERIES, observed
from tidemark.settings import Settings

_BITS = 62  # years per bitmap column
SLOT = [*SERIES, "day_of_year"]


def _year_maps(first: int, last: int) -> list[tuple[str, int]]:
    return [(f"years_{i}", start) for i, start in enumerate(range(first, last + 1, _BITS))]


def day_of_year_stats(raw: DataFrame, cfg: Settings) -> DataFrame:
    """Moments and a bitmap of years per series and day-of-year.

    Fixed-width partial aggregates: at most 366 rows per series and task are
    shuffled, instead of every reading times the window width.
    """
    year, doy = F.year("observed_at"), F.dayofyear("observed_at")
    maps = []
    for name, start in _year_maps(cfg.baseline_start.year, cfg.baseline_end.year):
        here = year.between(start, start + _BITS - 1)
        bit = F.expr(f"shiftleft(1L, year(observed_at) - {start})")
        maps.append(F.bit_or(F.when(here, bit).otherwise(F.lit(0).cast("long"))).alias(name))
    if "year" in raw.columns:  # a stored layer: prune its folders
        raw = raw.filter(F.col("year").between(cfg.baseline_start.year, cfg.baseline_end.year))
    return (
        observed(raw)
        .filter(F.col("observed_at").between(F.lit(cfg.baseline_start), F.lit(cfg.baseline_end)))
        .groupBy(*SERIES, doy.alias("day_of_year"))
        .agg(
            F.count("*").alias("n"),
            F.sum("value").alias("total"),
            (F.var_pop("value") * F.count("*")).alias("m2"),
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            *maps,
        )
    )


def _on_ring(stats: DataFrame, half: int) -> DataFrame:
    """Rows of one year on slots 1−half .. 366+half, every slot 1..366 present.

    Days within ``half`` of the year's ends are repeated beyond the other end;
    missing days are added by extending each row to the next one, values nulled.
    """
    w = Window.partitionBy(*SERIES).orderBy("slot")
    copies = F.array(*[F.col("day_of_year") + k for k in (-DOY_CYCLE, 0, DOY_CYCLE)])
    inside = F.filter(copies, lambda s: s.between(1 - half, DOY_CYCLE + half))
    before, after = F.lag("slot").over(w), F.lead("slot").over(w)
    start = F.when(before.isNull(), F.least("slot", F.lit(1))).otherwise(F.col("slot"))
    stop = F.when(after.isNull(), F.greatest("slot", F.lit(DOY_CYCLE))).otherwise(after - 1)
    values = [c for c in stats.columns if c not in {*SERIES, "day_of_year"}]
    return (
        stats.withColumn("slot", F.explode(inside))
        .withColumn("_span", F.sequence(start, stop))
        .withColumn("at", F.explode("_span"))
        .select(
            *SERIES, "at",
            *[F.when(F.col("at") == F.col("slot"), F.col(v)).alias(v) for v in values],
        )
    )


def _squares_about(mean: Column, parts: Column) -> Column:
    """Sum of squared deviations from ``mean``, pooled over per-day moments."""
    return F.aggregate(
        parts, F.lit(0.0),
        lambda acc, p: acc + p["m2"] + p["n"] * F.pow(p["total"] / p["n"] - mean, F.lit(2.0)),
    )


def seasonal_baselines(raw: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """mu, sigma and number of years per series and day-of-year 1..366.

    An observation counts for every day within ``half_window`` days of its own,
    around the turn of the year too.  Sigma is the sample deviation and null when
    the window has no spread; days nothing reaches keep nulls.
    """
    return baselines_of(day_of_year_stats(raw, cfg), cfg)


def state_schema(cfg: Settings) -> T.StructType:
    """Schema of :func:`day_of_year_stats`."""
    number, count, bits = T.DoubleType(), T.LongType(), T.LongType()
    fields = [("entity_id", T.StringType()), ("metric", T.StringType()), ("day_of_year", T.IntegerType()), ("n", count),
              ("total", number), ("m2", number), ("lo", number), ("hi", number)]
    fields += [(name, bits) for name, _ in _year_maps(cfg.baseline_start.year, cfg.baseline_end.year)]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def merged_stats(left: DataFrame, right: DataFrame, cfg: Settings) -> DataFrame:
    """Moments of the rows behind both frames, each with a slot (series and day-of-year) once at most.

    The squares are pooled about the common mean, so nothing cancels out.
    """
    rest = [f for f in state_schema(cfg).fieldNames() if f not in SLOT]
    sides = []
    for side, df in (("a", left), ("b", right)):
        sides.append(df.select(*[F.col(c).alias(f"{side}_{c}") for c in SLOT], F.struct(*rest).alias(side)))
    same = reduce(and_, [sides[0][f"a_{c}"].eqNullSafe(sides[1][f"b_{c}"]) for c in SLOT])
    both = sides[0].join(sides[1], same, "full_outer")

    def of(c: str) -> tuple[Column, Column]:
        return F.col(f"a.{c}"), F.col(f"b.{c}")

    n_a, n_b = (F.coalesce(x, F.lit(0)) for x in of("n"))
    shift = of("total")[0] / n_a - of("total")[1] / n_b
    plus = {c: F.coalesce(of(c)[0], F.lit(0)) + F.coalesce(of(c)[1], F.lit(0)) for c in ("n", "total", "m2")}
    between = F.when((n_a > 0) & (n_b > 0), shift * shift * n_a * n_b / (n_a + n_b)).otherwise(0.0)
    bits = [c for c in rest if c.startswith("years_")]
    return both.select(
        *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in SLOT],
        plus["n"].alias("n"), plus["total"].alias("total"), (plus["m2"] + between).alias("m2"),
        F.least(*of("lo")).alias("lo"), F.greatest(*of("hi")).alias("hi"),
        *[F.coalesce(of(c)[0], F.lit(0)).bitwiseOR(F.coalesce(of(c)[1], F.lit(0))).alias(c) for c in bits],
    )


def baselines_of(stats: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The baselines from the moments of :func:`day_of_year_stats`, fresh or stored."""
    half = cfg.half_window
    names = [name for name, _ in _year_maps(cfg.baseline_start.year, cfg.baseline_end.year)]
    w = Window.partitionBy(*SERIES).orderBy("at").rangeBetween(-half, half)
    part = F.when(F.col("n").isNotNull(), F.struct("n", "total", "m2"))
    pooled = _on_ring(stats, half).select(
        *SERIES,
        F.col("at").alias("day_of_year"),
        F.sum("n").over(w).alias("n"),
        F.sum("total").over(w).alias("total"),
        F.min("lo").over(w).alias("lo"),
        F.max("hi").over(w).alias("hi"),
        # at most 2·half+1 entries, one per day-of-year in the frame
        F.collect_list(part).over(w).alias("parts"),
        *[F.bit_or(c).over(w).alias(c) for c in names],
    ).filter(F.col("day_of_year").between(1, DOY_CYCLE))
    mu = F.col("total") / F.col("n")
    spread = F.sqrt(_squares_about(mu, F.col("parts")) / (F.col("n") - 1))
    return pooled.select(
        *SERIES,
        "day_of_year",
        mu.alias("mu"),
        F.when((F.col("n") > 1) & (F.col("hi") > F.col("lo")), spread).alias("sigma"),
        reduce(add, [F.bit_count(c) for c in names]).cast("int").alias("n_years"),
    )
