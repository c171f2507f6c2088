"""Alignment, forward targets, diagnostics, regimes, event studies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.exprs import CONSTANT, as_bool, correlation, full_only, melt, num, ratio, require
from ..functions.scans import average_ranks, halo_window, numbered, running, with_halo
from ..sources.panels import stored
from .returns import market_return

RI = "regime_indicator"


def align(indicator: DataFrame, benchmarks: DataFrame, column: str = RI) -> DataFrame:
    """Dates that both have, with a value of the indicator; benchmark nulls stay."""
    require(indicator, [column], "indicator")
    left = indicator.select("date", F.when(~F.isnan(F.col(column).try_cast("double")), F.col(column).try_cast("double")).alias(RI))
    return left.join(benchmarks.drop(RI), "date").where(F.col(RI).isNotNull())


def label_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_stress_label")]


def tidy(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "metric") -> DataFrame:
    return melt(df, keys, metrics, name, "value")


def spearman_frame(pairs: DataFrame, by: Sequence[str], least: int = 2) -> DataFrame:
    """(by, n_obs, pearson_correlation, spearman_correlation) of the complete pairs x, y of each group."""
    full = pairs.where("x is not null and y is not null")
    ranked = average_ranks(full, by, {"rx": "x", "ry": "y"})
    out = ranked.groupBy(*by).agg(F.count("*").cast("double").alias("n_obs"), correlation("x", "y", least).alias("pearson_correlation"), F.when((F.stddev_pop("x") > CONSTANT) & (F.stddev_pop("y") > CONSTANT), correlation("rx", "ry", least)).alias("spearman_correlation"))
    return pairs.select(*by).distinct().join(out, list(by), "left").fillna(0.0, ["n_obs"])


def contemporaneous_diagnostics(aligned: DataFrame, indicator: str = RI, labels: Sequence[str] | None = None, continuous: Sequence[str] | None = None) -> DataFrame:
    """(diagnostic_type, benchmark, metric, value): the indicator in and out of stress for each label, and its correlations with each benchmark."""
    require(aligned, [indicator], "aligned")
    labels = label_columns(aligned) if labels is None else [c for c in labels if c in aligned.columns]
    continuous = [c for c in aligned.columns if c not in (*labels, indicator, "date") and isinstance(aligned.schema[c].dataType, NumericType)] if continuous is None else [c for c in continuous if c in aligned.columns]
    parts = []
    if labels:
        rows = melt(aligned.withColumn("x", num(indicator)), ["date", "x"], labels, "benchmark", "l").where("x is not null and l is not null")
        inside, outside = F.when(F.col("l") == 1, F.col("x")), F.when(F.col("l") == 0, F.col("x"))
        got = rows.groupBy("benchmark").agg(F.count("x").alias("n"), *[f.alias(n) for s, c in (("1", inside), ("0", outside)) for n, f in ((f"n{s}", F.count(c)), (f"m{s}", F.avg(c)), (f"v{s}", F.var_samp(c)), (f"q{s}", F.percentile(c, 0.5)))])
        got = aligned.sparkSession.createDataFrame([(c,) for c in labels], "benchmark string").join(got, "benchmark", "left").fillna(0, ["n", "n1", "n0"])
        welch = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2), ratio(F.col("m1") - F.col("m0"), F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))))
        metrics = {
            "n_total": F.col("n"), "n_stress": F.col("n1"), "n_non_stress": F.col("n0"), "mean_indicator_stress": F.col("m1"), "mean_indicator_non_stress": F.col("m0"), "median_indicator_stress": F.col("q1"),
            "median_indicator_non_stress": F.col("q0"), "difference_in_means": F.col("m1") - F.col("m0"), "ratio_stress_to_non_stress": ratio(F.col("m1"), F.col("m0")), "welch_t_statistic": welch,
        }
        parts.append(tidy(got.select(F.lit("stress_label").alias("diagnostic_type"), "benchmark", *[c.cast("double").alias(m) for m, c in metrics.items()]), ["diagnostic_type", "benchmark"], list(metrics)))
    if continuous:
        rows = melt(aligned.withColumn("x", num(indicator)), ["date", "x"], continuous, "benchmark", "y").withColumn("y", num("y"))
        got = spearman_frame(rows, ["benchmark"]).withColumn("diagnostic_type", F.lit("continuous_benchmark"))
        parts.append(tidy(got, ["diagnostic_type", "benchmark"], ["n_obs", "pearson_correlation", "spearman_correlation"]))
    return reduce(DataFrame.unionAll, parts)


def forward_targets(returns: DataFrame, horizons: Sequence[int] = (5, 21, 63), market: str | None = None, annualize: bool = False, trading_days: int = 252) -> DataFrame:
    """(date, forward_<target>_<h>d): over the h rows after each date, null unless all have a return. The drawdown is that of the
    arithmetic path that starts at 1."""
    if not horizons:
        raise ValueError("name a horizon")
    if any(h <= 0 for h in horizons):
        raise ValueError("a horizon is a whole number of rows from 1 on")
    if trading_days <= 0:
        raise ValueError("a year has one trading day or more")
    m = with_halo(market_return(returns, market), [], 0, max(horizons))
    out, r = ["own", "date"], F.col("ret")
    for h in horizons:
        w = halo_window([], 1, h)
        vol = full_only(F.stddev_samp("ret"), r, w, h) * (trading_days**0.5 if annualize else 1.0)
        total = full_only(F.sum("ret"), r, w, h)
        path = F.aggregate(F.collect_list("ret").over(w), F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("m"), F.lit(0.0).alias("d")), _path_step, lambda s: s["d"])
        out += [vol.alias(f"forward_realized_volatility_{h}d"), total.alias(f"forward_return_sum_{h}d"), F.abs(total).alias(f"forward_absolute_return_sum_{h}d"), F.when(F.count("ret").over(w) == h, path).alias(f"forward_max_drawdown_{h}d")]
    return m.select(*out).where("own").drop("own")


def _path_step(s: Column, r: Column) -> Column:
    c = s["c"] + r
    m = F.greatest(s["m"], c)
    return F.struct(c.alias("c"), m.alias("m"), F.least(s["d"], c / m - 1).alias("d"))


PREDICTIVE = ("n_obs", "pearson_correlation", "spearman_correlation", "ols_beta", "ols_intercept", "ols_beta_t_stat", "r_squared")


def predictive_power(indicator: DataFrame, targets: DataFrame, column: str = RI) -> DataFrame:
    """(target, metric, value): a line through the indicator and each target; all but n_obs null under three pairs or if a side is constant."""
    names = [c for c in targets.columns if c != "date"]
    rows = melt(indicator.select("date", num(column).alias("x")).join(targets, "date"), ["x"], names, "target", "y").withColumn("y", num("y")).where("x is not null and y is not null")
    ranked = average_ranks(rows, ["target"], {"rx": "x", "ry": "y"})
    got = ranked.groupBy("target").agg(
        F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"), F.avg("x").alias("mx"), F.avg("y").alias("my"), correlation("rx", "ry").alias("spearman_correlation"),
    )
    n, sx, sy, c = (F.col(k) for k in ("n", "sx", "sy", "c"))
    ok = (n >= 3) & (sx > CONSTANT) & (sy > CONSTANT)
    beta = F.when(ok, c / (sx * sx))
    sse = n * (sy * sy - beta * c)
    error = F.when(n > 2, F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 2) / (n * sx * sx)))
    got = got.select("target", n.cast("double").alias("n_obs"), F.when(ok, ratio(c, sx * sy)).alias("pearson_correlation"), F.when(ok, F.col("spearman_correlation")).alias("spearman_correlation"), beta.alias("ols_beta"), (F.col("my") - beta * F.col("mx")).alias("ols_intercept"), F.when(error > 0, beta / error).alias("ols_beta_t_stat"), F.when(ok, ratio(beta * c, sy * sy)).alias("r_squared"))
    every = indicator.sparkSession.createDataFrame([(t,) for t in names], "target string")
    return tidy(every.join(got, "target", "left").fillna(0.0, ["n_obs"]), ["target"], PREDICTIVE)


def event_study(indicator: DataFrame, events: Sequence, before: int = 60, after: int = 60, column: str = RI) -> DataFrame:
    """(event_date, matched_date, relative_day, regime_indicator): rows around the last row at or before each event (the first row, if none is)."""
    if before < 0 or after < 0:
        raise ValueError("an event's window can't have fewer than zero rows on a side")
    spark = indicator.sparkSession
    rows = stored(numbered(indicator.select("date", num(column).alias(RI)), [], ["date"], "n"))
    ev = spark.createDataFrame([(str(e),) for e in events], "e string").select(F.col("e").cast("date").alias("event_date")).distinct()
    # as of: both sides in one order, a date's row before its event, and the last known row carried on to events
    kind = rows.schema["date"].dataType
    both = rows.select(F.struct(F.col("date").alias("d"), F.lit(0).alias("side")).alias("at"), "n", F.lit(None).cast("date").alias("event_date"))
    both = both.unionAll(ev.select(F.struct(F.col("event_date").cast(kind).alias("d"), F.lit(1).alias("side")), F.lit(None).cast("long"), "event_date"))
    found = running(both, [], {"last": ("last", F.col("n"))}, "at").where("event_date is not null").select("event_date", F.coalesce("last", F.lit(0)).alias("own"))
    near = found.select("event_date", "own", F.explode(F.sequence(F.col("own") - before, F.col("own") + after)).alias("n"))
    matched = rows.select(F.col("n").alias("own"), F.col("date").alias("matched_date"))
    return near.join(rows, "n").join(matched, "own").select("event_date", "matched_date", (F.col("n") - F.col("own")).alias("relative_day"), RI)


def regime_classes(indicator: DataFrame, high: float = 0.8, low: float = 0.2, column: str = RI) -> DataFrame:
    """(date, regime_class): by full-sample quantiles; high wins over low, equal quantiles make all normal, nulls stay null."""
    if not 0 <= low < high <= 1:
        raise ValueError("quantiles have to rise from low to high within 0 and 1")
    df = indicator.select("date", num(column).alias("x"))
    df = stored(df)
    df = df.crossJoin(F.broadcast(df.agg(F.percentile("x", F.array(F.lit(low), F.lit(high))).alias("q"))))  # one row
    x, lo, hi = F.col("x"), F.col("q")[0], F.col("q")[1]
    flat = F.abs(hi - lo) <= CONSTANT + 1e-5 * F.abs(lo)
    name = F.when(x.isNull(), None).when(flat, "normal").when(x >= hi, "high_systemic_connectedness").when(x <= lo, "low_systemic_connectedness").otherwise("normal")
    return df.select("date", name.alias("regime_class"))


def regime_summary(indicator: DataFrame, returns: DataFrame | None = None, high: float = 0.8, low: float = 0.2, column: str = RI) -> DataFrame:
    classes = regime_classes(indicator, high, low, column).where("regime_class is not null")
    if returns is None:
        return classes.groupBy("regime_class").agg(F.count("*").alias("n_obs"))
    return classes.join(market_return(returns), "date").groupBy("regime_class").agg(F.count("ret").alias("n_obs"), F.avg("ret").alias("mean_return"), F.stddev_samp("ret").alias("volatility"), F.avg(F.abs("ret")).alias("mean_absolute_return"))


def transition_correlations(indicator: DataFrame, changes: DataFrame, column: str = RI) -> DataFrame:
    names = [c for c in changes.columns if c != "date"]
    rows = melt(indicator.select("date", num(column).alias("x")).join(changes, "date"), ["date", "x"], names, "benchmark", "y").withColumn("y", num("y"))
    return spearman_frame(rows, ["benchmark"], 3).select(F.lit("benchmark_change_correlation").alias("diagnostic_type"), "benchmark", "n_obs", "pearson_correlation", "spearman_correlation")


SUMMARY = ("n_ri_observations", "convergence_rate", "ri_standard_deviation", "correlation_with_vix", "correlation_with_realized_volatility", "correlation_with_average_correlation", "stress_non_stress_ri_difference", "correlation_with_future_realized_volatility", "correlation_with_future_max_drawdown", "high_regime_volatility")


def robustness_summary(indicator: DataFrame, benchmarks: DataFrame, returns: DataFrame | None = None, horizon: int = 21, label: str = "systemic_stress_label", by: Sequence[str] = ()) -> DataFrame:
    """SUMMARY for each group of (by, date, regime_indicator[, graph_lasso_converged])."""
    by = list(by)
    base = indicator.select(*by, "date", num(RI).alias(RI), (as_bool("graph_lasso_converged") if "graph_lasso_converged" in indicator.columns else F.lit(None).cast("double")).alias("ok"))
    base = base.withColumn("q", F.percentile(RI, F.array(F.lit(0.2), F.lit(0.8))).over(Window.partitionBy(*by)))
    df = base.join(benchmarks.drop(RI).withColumn("_b", F.lit(True)), "date", "left")
    if returns is not None:
        t = forward_targets(returns, [horizon]).select("date", F.col(f"forward_realized_volatility_{horizon}d").alias("_fv"), F.col(f"forward_max_drawdown_{horizon}d").alias("_fd"))
        df = df.join(t, "date", "left").join(market_return(returns), "date", "left")
    x = F.col(RI)
    corr = lambda c, least=3: correlation(x, num(c), least) if c in df.columns else F.lit(None).cast("double")
    l = num(label) if label in df.columns else F.lit(None).cast("double")  # noqa: E741
    flat = F.abs(F.col("q")[1] - F.col("q")[0]) <= CONSTANT + 1e-5 * F.abs(F.col("q")[0])
    high = ~flat & (x >= F.col("q")[1])
    return df.groupBy(*by).agg(
        F.count(x).alias(SUMMARY[0]), F.avg("ok").alias(SUMMARY[1]), F.stddev_pop(x).alias(SUMMARY[2]), corr("vix").alias(SUMMARY[3]), corr("realized_volatility").alias(SUMMARY[4]), corr("average_correlation").alias(SUMMARY[5]),
        (F.avg(F.when(l == 1, x)) - F.avg(F.when(l == 0, x))).alias(SUMMARY[6]), corr("_fv").alias(SUMMARY[7]), corr("_fd").alias(SUMMARY[8]), (F.stddev_samp(F.when(high, F.col("ret"))) if returns is not None else F.lit(None).cast("double")).alias(SUMMARY[9]),
    )


def converged_vs_all(indicator: DataFrame, benchmarks: DataFrame, returns: DataFrame | None = None, horizon: int = 21) -> DataFrame:
    """robustness_summary over all windows and over the converged ones."""
    both = indicator.withColumn("sample", F.lit("all_windows")).unionAll(indicator.where(as_bool("graph_lasso_converged") == 1).withColumn("sample", F.lit("converged_only")))
    return robustness_summary(both, benchmarks, returns, horizon, by=["sample"])
