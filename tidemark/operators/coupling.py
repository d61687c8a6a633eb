"""Coupling of a daily series with a second, monthly one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import classify, scores, stats
from tidemark.functions.calendar import doy_month, month_start, period, period_month
from tidemark.settings import Settings

PAIR = ["entity_id", "period"]
ENTITIES_PER_SALT = 4096


def flow_monthly(
    daily: DataFrame, cfg: Settings = Settings(), entities: DataFrame | None = None
) -> DataFrame:
    """Monthly mean of the daily averages; ``n_days`` counts gap days too."""
    rows = daily.filter(F.col("metric") == cfg.flow_metric)
    if entities is not None:
        rows = rows.join(entities.select("entity_id"), "entity_id", "left_semi")
    return rows.groupBy("entity_id", period(F.col("observed_at")).alias("period")).agg(
        F.avg("average").alias("mean_flow_cfs"), F.count("*").alias("n_days")
    )


def location_salts(locations: DataFrame, entities_per_salt: int = ENTITIES_PER_SALT) -> DataFrame:
    """(location, _salts): over how many salts each location's entities are spread; 1 for all but large ones."""
    return locations.filter(F.col("eia_location").isNotNull()).groupBy(F.col("eia_location").alias("location")).agg(
        F.ceil(F.count("*") / entities_per_salt).cast("int").alias("_salts"))


def for_each_entity(
    monthly: DataFrame, locations: DataFrame, entities_per_salt: int = ENTITIES_PER_SALT
) -> DataFrame:
    """Monthly rows of a ``location`` repeated for each entity mapped to it.

    One location may carry most entities, so its entities are spread over as many salts as their number asks for,
    and its few months repeated for each; the months of a small location stay single.
    """
    salts = location_salts(locations, entities_per_salt)
    mapped = locations.select("entity_id", F.col("eia_location").alias("location")).join(salts, "location").select(
        "entity_id", "location", F.pmod(F.xxhash64("entity_id"), F.col("_salts")).cast("int").alias("_salt"))
    return (
        monthly.join(salts, "location")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .join(mapped, ["location", "_salt"])
        .select("entity_id", *[c for c in monthly.columns if c != "location"])
    )


def generation_base(monthly: DataFrame, locations: DataFrame) -> DataFrame:
    """The location's monthly values for each of its entities, unknown ones left out."""
    return for_each_entity(monthly, locations).select(*PAIR, "generation_thousand_mwh").dropna()


def hourly_to_daily(hourly: DataFrame) -> DataFrame:
    """Daily mean of an hourly (ts, value) series; days without a value are left out."""
    return (
        hourly.groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("mean_mw")).dropna()
    )


def daily_to_monthly(daily: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Monthly energy in thousand MWh from daily mean MW, almost complete months only."""
    return (
        daily.groupBy(month_start(F.col("day")).alias("_month"))
        .agg((F.sum("mean_mw") * 24.0 / 1000.0).alias("generation_thousand_mwh"),
             F.count("mean_mw").alias("n_days"))
        .filter(F.col("n_days") >= cfg.min_month_days)
        .select(period(F.col("_month")).alias("period"), "generation_thousand_mwh")
        .dropna()
    )


def entities_at(locations: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Entities of the given locations, or of all."""
    if wanted is not None:
        locations = locations.filter(F.col("eia_location").isin(wanted))
    return locations.select("entity_id")


def newest_month(monthly: DataFrame, locations: DataFrame) -> Column:
    """Newest month with a value at a location that has entities, as a scalar subquery: that of the base, without its rows."""
    known = locations.filter(F.col("entity_id").isNotNull()).select(F.col("eia_location").alias("location")).distinct()
    return (
        monthly.filter(F.col("generation_thousand_mwh").isNotNull()).join(known, "location", "left_semi")
        .agg(F.max("period")).scalar()
    )


def extend_generation(
    base: DataFrame, extension: DataFrame, targets: DataFrame, last: Column | None = None
) -> DataFrame:
    """Append the extension's later months to each target entity.

    Only months after the newest one anywhere in ``base`` are appended, so a month the
    base already has is kept.  ``last`` is that month; without it the base is planned a second time for it.  The
    appended months are one bounded list (twelve a year), attached as a scalar and exploded.
    """
    if last is None:
        last = base.agg(F.max("period")).scalar()
    months = (
        extension.filter(F.col("period") > last)
        .agg(F.collect_list(F.struct("period", "generation_thousand_mwh")))
        .scalar()
    )
    added = (
        targets.select("entity_id", F.explode(months).alias("m"))
        .select("entity_id", "m.period", "m.generation_thousand_mwh")
    )
    return base.unionByName(added)


def aligned_pairs(flow: DataFrame, generation: DataFrame, locations: DataFrame) -> DataFrame:
    """Entity-months present on both sides; an entity without a location row is an error."""
    known = locations.select("entity_id", "confidence", F.lit(True).alias("_known"))
    missing = F.raise_error(F.concat(F.lit("no location row for "), F.col("entity_id")))
    return (
        flow.join(generation, PAIR)
        .join(known, "entity_id", "left")
        .select(
            *PAIR, "mean_flow_cfs", "generation_thousand_mwh",
            F.when(F.col("_known"), F.col("confidence")).otherwise(missing.cast("string"))
            .alias("confidence"),
        )
    )


def monthly_climatology(baselines: DataFrame, metric: str) -> DataFrame:
    """Mean mu and sigma per entity and month of the day-of-year baselines."""
    return (
        baselines.filter(F.col("metric") == metric)
        .groupBy("entity_id", doy_month(F.col("day_of_year")).alias("month"))
        .agg(F.avg("mu").alias("mu_month"), F.avg("sigma").alias("sigma_month"))
    )


def anomalies(pairs: DataFrame, baselines: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Flow against its climatology, generation against its own mean and deviation."""
    whole = Window.partitionBy("entity_id")
    gen = F.col("generation_thousand_mwh")
    return (
        pairs.withColumn("month", period_month(F.col("period")))
        .join(monthly_climatology(baselines, cfg.flow_metric), ["entity_id", "month"], "left")
        .withColumns({
            "anomaly_flow": scores.z_score(
                F.col("mean_flow_cfs"), F.col("mu_month"), F.col("sigma_month"), cfg.spread_floor),
            "anomaly_gen": scores.z_score(
                gen, F.avg(gen).over(whole), F.stddev_samp(gen).over(whole), cfg.spread_floor),
        })
        .drop("mu_month", "sigma_month")
    )


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman per group over complete pairs, with the pair count.

    Meant for groups with a bounded number of rows, such as the months of an entity.
    """
    complete = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).dropna()
    ranked = complete.withColumns({
        "_rx": stats.average_rank(keys, "_x"), "_ry": stats.average_rank(keys, "_y"),
    })
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        stats.pearson(F.col("_x"), F.col("_y")).alias("pearson"),
        stats.pearson(F.col("_rx"), F.col("_ry")).alias("spearman"),
    )


RAW_PAIRING = -1


def pairings(series: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """All (x, y) pairs to correlate, one copy of the series per pairing.

    Pairing −1 holds the values themselves; pairing k holds the flow anomaly with the
    generation anomaly k rows later.  The shift counts the rows that have both
    anomalies, so missing months compress it.
    """
    both = F.col("anomaly_flow").isNotNull() & F.col("anomaly_gen").isNotNull()
    by_time = Window.partitionBy("entity_id", "_both").orderBy("period")

    def pair(k: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(k).alias("pairing"), x.alias("x"), y.alias("y"))

    lagged = [
        pair(k, F.when(F.col("_both"), F.col("anomaly_flow")),
             F.when(F.col("_both"), F.lead("anomaly_gen", k).over(by_time)))
        for k in cfg.lags
    ]
    plain = pair(RAW_PAIRING, F.col("mean_flow_cfs"), F.col("generation_thousand_mwh"))
    return (
        series.withColumn("_both", both)
        .withColumn("_pairs", F.array(plain, *lagged))
        .select("entity_id", F.inline("_pairs"))
    )


def correlation_scan(series: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Pair count, Pearson and Spearman per entity and pairing.

    All pairings go through the same windows, partitioned by entity throughout.
    """
    return rank_correlation(pairings(series, cfg), ["entity_id", "pairing"], "x", "y")


def best_lag(cfg: Settings = Settings()) -> Column:
    """Over scan rows: lag with the strongest rank correlation, the smallest on a draw."""
    usable = (F.col("pairing") != RAW_PAIRING) & (F.col("n") >= cfg.min_pairs)
    strength = F.coalesce(F.abs("spearman"), F.lit(0.0))
    return F.min_by(
        F.struct(F.col("pairing").alias("lag"),
                 F.coalesce("spearman", F.lit(0.0)).alias("spearman")),
        F.when(usable, F.struct(-strength, F.col("pairing"))),
    )


def correlation_raw(
    pairs: DataFrame, baselines: DataFrame, locations: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """All correlation figures per entity; null where there are too few pairs."""

    def figure(c: str, pairing: int) -> Column:
        return F.max(F.when(F.col("pairing") == pairing, F.col(c)))

    tags = {"raw": RAW_PAIRING, "anom": 0}
    found = correlation_scan(anomalies(pairs, baselines, cfg), cfg).groupBy("entity_id").agg(
        *[figure(c, k).alias(f"{c}_{tag}")
          for tag, k in tags.items() for c in ("n", "pearson", "spearman")],
        best_lag(cfg).alias("best"),
    )
    joined = (
        pairs.select("entity_id").distinct()
        .join(found, "entity_id", "left")
        .join(locations.select("entity_id", "eia_location", "confidence"), "entity_id", "left")
    )
    many = F.col("n_raw") >= cfg.min_pairs
    kept = {f"{c}_{tag}": F.when(many & (F.col(f"n_{tag}") >= cfg.min_pairs), F.col(f"{c}_{tag}"))
            for c in ("pearson", "spearman") for tag in tags}
    known = joined.withColumns({
        **kept,
        "n_months": F.coalesce("n_raw", F.lit(0)),
        "eia_location": F.coalesce("eia_location", F.lit("")),
        "confidence": F.coalesce("confidence", F.lit("low")),
        "best_lag": F.when(many, F.col("best.lag")),
        "best_lag_corr": F.when(many, F.col("best.spearman")),
    })
    p_values = {
        f"{c}_{tag}_p": stats.correlation_p(
            F.col(f"{c}_{tag}"), (F.col(f"n_{tag}") - 2).cast("double"))
        for c in ("pearson", "spearman") for tag in tags
    }
    return schemas.conform(known.withColumns(p_values), schemas.CORRELATION_RAW)


def correlation_final(raw: DataFrame) -> DataFrame:
    """Significance, tier and decoupling per entity."""
    rho = F.col("spearman_anom")
    out = raw.withColumns({
        "significant": classify.significant(F.col("pearson_anom_p"), F.col("spearman_anom_p")),
        "decoupled": classify.decoupled(rho),
    }).withColumn("tier", classify.coupling_tier(rho, F.col("significant")))
    return schemas.conform(out, schemas.CORRELATION_FINAL)


def autocorrelation(series: DataFrame, x: str, cfg: Settings = Settings()) -> DataFrame:
    """Lag-1 autocorrelation per entity, by row."""
    by_time = Window.partitionBy("entity_id").orderBy("period")
    shifted = series.filter(F.col(x).isNotNull()).withColumn("_before", F.lag(x).over(by_time))
    return shifted.groupBy("entity_id").agg(
        stats.pearson(F.col(x), F.col("_before")).alias("rho1")
    )


def adjusted_significance(
    pairs: DataFrame, baselines: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """Significance of the anomaly correlation on the effective sample size."""
    series = anomalies(pairs, baselines, cfg).dropna(subset=["anomaly_flow", "anomaly_gen"])
    joined = (
        rank_correlation(series, ["entity_id"], "anomaly_flow", "anomaly_gen")
        .join(autocorrelation(series, "anomaly_flow", cfg), "entity_id")
        .withColumn("n_eff", stats.effective_n(F.col("n"), F.col("rho1")))
    )
    return joined.select(
        "entity_id", "n", "spearman", "rho1", "n_eff",
        stats.correlation_p(F.col("spearman"), F.col("n_eff") - 2).alias("p_adjusted"),
    )


def calendar_month_anomaly(value: str, keys: list[str]) -> Column:
    """Score against the mean and population deviation of the same calendar month.

    A calendar month without spread, or without any value, scores 0 throughout.
    """
    w = Window.partitionBy(*keys, "month")
    x = F.col(value)
    spread = F.stddev_pop(x).over(w)
    return F.when(spread > 0, (x - F.avg(x).over(w)) / spread).otherwise(0.0)


def whole_series_z(value: str, keys: list[str]) -> Column:
    """Score against the mean and sample deviation of the whole series."""
    w = Window.partitionBy(*keys)
    x = F.col(value)
    return scores.flat_z_score(x, F.avg(x).over(w), F.stddev_samp(x).over(w))


def true_spans(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """First and last position of each unbroken run of true rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
    return (
        df.withColumn("_start", starts.cast("int"))
        .withColumn("_run", F.sum("_start").over(w))
        .filter(flag)
        .groupBy(*keys, "_run")
        .agg(F.min(order).alias("span_start"), F.max(order).alias("span_end"),
             F.count("*").alias("n_rows"))
        .drop("_run")
    )
