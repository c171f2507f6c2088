"""Exposure rules, overlays, costs and performance. Frames are long; ``by`` names what keeps strategies apart."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import melt, num
from ..functions.quantiles import expanding_quantiles
from ..functions.scans import running, trailing_means, unblocked
from ..sources.panels import stored
from .returns import portfolio_returns
from .stress import BENCHMARKS

#: Fixed metric names, in order.
PERFORMANCE = ("annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "mean_return", "mean_absolute_return", "worst_1pct_return", "worst_5pct_return", "hit_rate", "n_obs")
TURNOVER = ("average_exposure", "time_in_reduced_exposure", "number_of_exposure_changes", "annualized_turnover_proxy", "mean_absolute_exposure_change")
VARIANTS = ("daily", "weekly", "smoothed_5d", "smoothed_10d", "hysteresis", "cooldown_5d", "smoothed_5d_hysteresis")
DIFFERENCES = ("annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "worst_5pct_return")


def check_exposure(high_q: float, extreme_q: float, normal: float, high: float, extreme: float, method: str, min_history: int, variant: str = "daily", exit_q: float = 0.6) -> None:
    if not 0 <= high_q < extreme_q <= 1:
        raise ValueError("quantiles have to rise from high to extreme within 0 and 1")
    if variant in ("hysteresis", "smoothed_5d_hysteresis") and not 0 <= exit_q < high_q:
        raise ValueError("the hysteresis leaves at a quantile below the one it enters at")
    if method not in ("expanding", "full_sample"):
        raise ValueError("unknown method: choose expanding or full_sample")
    if min_history <= 0:
        raise ValueError("min_history: one row or more")
    for name, v in (("normal_exposure", normal), ("high_exposure", high), ("extreme_exposure", extreme)):
        if v < 0 or not math.isfinite(v):
            raise ValueError(f"{name}: a finite number from 0 on")
    if not normal >= high >= extreme:
        raise ValueError("normal_exposure, high_exposure and extreme_exposure have to fall in this order")
    if variant not in VARIANTS:
        raise ValueError(f"unknown rule {variant!r}")


def exposure(scores: DataFrame, by: Sequence[str] = (), *, variant: str = "daily", method: str = "expanding", high_q: float = 0.8, extreme_q: float = 0.9, exit_q: float = 0.6, normal: float = 1.0, high: float = 0.7, extreme: float = 0.5, min_history: int = 20, cooldown: int = 5, thresholds: Column | None = None) -> DataFrame:
    """(by, date, exposure) of (by, date, score): reduced where the score reaches quantiles of its strictly earlier values (or of
    the full sample), by the variant's rule, and shifted by one row.

    thresholds: a column of three fixed levels (high, extreme, exit) to use in place of quantiles."""
    check_exposure(high_q, extreme_q, normal, high, extreme, method, min_history, variant, exit_q)
    made = exposure_by_rule(scores.withColumn("variant", F.lit(variant)), by, rules=(variant,), high_q=high_q, extreme_q=extreme_q, exit_q=exit_q, normal=normal, high=high, extreme=extreme, min_history=min_history, cooldown=cooldown, thresholds=thresholds, method=method)
    return made.drop("variant")


def exposure_by_rule(scores: DataFrame, by: Sequence[str], *, rules: Sequence[str] = VARIANTS, high_q: float = 0.8, extreme_q: float = 0.9, exit_q: float = 0.6, normal: float = 1.0, high: float = 0.7, extreme: float = 0.5, min_history: int = 20, cooldown: int = 5, thresholds: Column | None = None, method: str = "expanding") -> DataFrame:
    """exposure() of (by, variant, date, score), each row under its own variant's rule, in one plan for all rules.

    rules: the variants that occur. Quantiles of earlier values, holds and shifts are scans over blocks of rows, so that one long
    series is spread over tasks as many short ones are."""
    check_exposure(high_q, extreme_q, normal, high, extreme, method, min_history, "hysteresis" if any(r.endswith("hysteresis") for r in rules) else "daily", exit_q)
    keys, v = [*by, "variant"], F.col("variant")
    levels = [high_q, extreme_q, exit_q]
    df = scores.select(*keys, "date", num("score").alias("s"), *([thresholds.alias("q")] if thresholds is not None else []))
    if any(r.startswith("smoothed") for r in rules):
        means = trailing_means(df, keys, "s", {"_m5": 5, "_m10": 10})
        df = means.withColumn("s", F.when(v == "smoothed_10d", F.col("_m10")).when(v.startswith("smoothed"), F.col("_m5")).otherwise(F.col("s"))).drop("_m5", "_m10")
    if thresholds is not None:
        enough = F.lit(True)
    elif method == "full_sample":
        df = stored(df)
        whole = df.groupBy(*keys).agg(F.percentile("s", F.array(*map(F.lit, levels))).alias("q")).select(F.struct(*keys).alias("_key"), "q")
        df, enough = df.join(whole, F.struct(*keys) == F.col("_key")).drop("_key"), F.lit(True)
    else:
        df, enough = expanding_quantiles(df, keys, "s", levels), F.col("earlier") >= min_history
    s, known = F.col("s"), F.coalesce(enough & F.col("s").isNotNull() & F.col("q")[0].isNotNull(), F.lit(False))
    top, second = known & (s >= F.col("q")[1]), known & (s >= F.col("q")[0])
    # with hysteresis the state depends on the past only through holding, so it is the last row's verdict that was not to hold
    said = F.when(top, extreme).when(second, high).when(known & (s < F.col("q")[2]), normal)
    df = df.select(*keys, "date", said.alias("said"), F.when(top, extreme).when(second, high).otherwise(F.lit(normal)).alias("raw"))
    monday = F.when(F.weekday("date") == 0, F.col("raw"))
    df = running(df, keys, {"held": ("last", F.col("said")), "week": ("last", monday), "start": ("first", F.col("raw"))})
    raw = F.when(v.endswith("hysteresis"), F.coalesce("held", F.lit(normal))).when(v == "weekly", F.coalesce("week", "start")).otherwise(F.col("raw"))
    df = df.withColumn("raw", raw)
    if "cooldown_5d" in rules:
        df = stored(unblocked(df).select(*keys, "date", "raw"))
        df = df.where(v != "cooldown_5d").unionByName(cooled(df.where(v == "cooldown_5d"), keys, cooldown))
    return unblocked(running(df, keys, {"exposure": ("lag", F.col("raw"))})).select(*keys, "date", F.coalesce("exposure", F.lit(normal)).alias("exposure"))


#: Doublings of the jumps between two written rounds.
HOPS = 3


def cooled(df: DataFrame, by: Sequence[str], days: int) -> DataFrame:
    """(by, date, raw) with the value held unless a change comes more than ``days`` rows after the last one that was accepted.

    What follows an accepted change depends on its row alone: the next one is the first row more than ``days`` on whose value
    differs. So every row points to the change that would follow it, pointers are composed with themselves until they span the
    series, and the changes are the rows that the pointers reach from the first; log n joins, no row after row."""
    key = F.struct(*[F.col(b) for b in by]) if by else F.lit(0)
    rows = running(df.select(*by, "date", "raw"), by, {"n": ("count", F.lit(1)), "before": ("lag", F.col("raw"))})
    rows = running(rows, by, {"run": ("count", F.when(F.col("raw") != F.col("before"), 1))})
    rows = stored(unblocked(rows).select(*by, "date", "raw", "n", "run", key.alias("key")))
    starts = rows.groupBy("key", "run").agg(F.min("n").alias("start"))
    later = rows.select("key", (F.col("n") - days - 1).alias("n"), F.col("raw").alias("then"), (F.col("run") + 1).alias("run"))
    follow = rows.select("key", "n", "raw").join(later, ["key", "n"]).join(starts, ["key", "run"], "left")
    jump = F.when(F.col("then") != F.col("raw"), F.col("n") + days + 1).otherwise(F.col("start"))
    jumps = stored(follow.select("key", "n", jump.alias("to")).where("to is not null"))
    found, size = stored(starts.where("run = 1").select("key", F.col("start").alias("n"))), 0
    while (now := found.count()) > size:
        size = now
        for _ in range(HOPS):
            found = found.unionAll(found.join(jumps, ["key", "n"]).select("key", F.col("to").alias("n"))).distinct()
            second = jumps.select("key", F.col("n").alias("from"), F.col("to").alias("n"))
            jumps = second.join(jumps, ["key", "n"]).select("key", F.col("from").alias("n"), "to")
        found, jumps = stored(found), stored(jumps)
    changed = rows.join(found.withColumn("changed", F.lit(True)), ["key", "n"], "left").select(*by, "date", "raw", F.when(F.col("changed"), F.col("raw")).alias("change"))
    out = unblocked(running(changed, by, {"held": ("last", F.col("change")), "start": ("first", F.col("raw"))}))
    return out.select(*by, "date", F.coalesce("held", "start").alias("raw"))


def benchmark_exposures(benchmarks: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """(signal, date, exposure) for each benchmark column; drawdown counts negated."""
    found = [c for c in (columns or BENCHMARKS) if c in benchmarks.columns]
    if not found:
        raise ValueError("none of the benchmarks asked for is a column")
    scores = melt(benchmarks, ["date"], found, "signal", "score")
    return exposure(scores.withColumn("score", F.when(F.col("signal") == "drawdown", -F.col("score")).otherwise(F.col("score"))), ["signal"], **options)


def summarize_exposures(exposures: DataFrame, by: str = "signal") -> DataFrame:
    e = num("exposure")
    return exposures.groupBy(F.concat(F.col(by), F.lit("_exposure")).alias("exposure_name")).agg(F.count(e).cast("double").alias("n_obs"), F.avg(e).alias("mean"), F.min(e).alias("min"), F.max(e).alias("max"), F.avg((e < 1.0).cast("double")).alias("share_reduced"), F.avg((e <= 0.5).cast("double")).alias("share_half_or_less")).withColumnRenamed("exposure_name", "exposure")


def apply_overlay(base: DataFrame, exposures: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, date, exposure, ret): base returns (date, ret) that are known, times the exposure (1 where it is null), on common dates.
    If base has ``by`` columns too, they are matched."""
    on = [c for c in by if c in base.columns] + ["date"]
    both = base.where(num("ret").isNotNull()).join(exposures, on)
    e = F.coalesce(num("exposure"), F.lit(1.0))
    return both.select(*by, "date", e.alias("exposure"), (num("ret") * e).alias("ret"))


def with_costs(overlay: DataFrame, by: Sequence[str] = (), bps: Sequence[float] = (0.0, 5.0, 10.0)) -> DataFrame:
    """(by, cost_bps, date, ret): overlay returns less costs on each change of exposure between joined rows."""
    if any(b < 0 for b in bps):
        raise ValueError("costs can't be below zero basis points")
    before = unblocked(running(overlay, by, {"_before": ("lag", F.col("exposure"))}))
    change = F.coalesce(F.abs(F.col("exposure") - F.col("_before")), F.lit(0.0))
    return before.withColumn("c", change).select(*by, F.explode(F.array(*[F.lit(float(b)) for b in bps])).alias("cost_bps"), "date", "ret", "c").withColumn("ret", F.col("ret") - F.col("c") * F.col("cost_bps") / 10_000).drop("c")


def performance(returns: DataFrame, by: Sequence[str] = (), days: int = 252) -> DataFrame:
    """PERFORMANCE of (by, date, ret) for each group; wealth compounds from the first row on."""
    if days <= 0:
        raise ValueError("a year has one trading day or more")
    r = returns.select(*by, "date", num("ret").alias("r")).where("r is not null")
    r = running(r, by, {"w": ("product", 1 + F.greatest(F.col("r"), F.lit(-0.999999)))})
    r = unblocked(running(r, by, {"top": ("max", F.col("w"))})).withColumn("d", F.col("w") / F.col("top") - 1)
    scale = float(days) ** 0.5
    agg = r.groupBy(*by).agg(
        F.max_by("w", "date").alias("w"), F.count("r").alias("n"), (F.stddev_samp("r") * scale).alias("vol"), (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * scale).alias("down"), F.min("d").alias("mdd"), F.avg("r").alias("mean"),
        F.avg(F.abs("r")).alias("mabs"), F.percentile("r", F.array(F.lit(0.01), F.lit(0.05))).alias("q"), F.avg((F.col("r") > 0).cast("double")).alias("hit"),
    )
    ret = F.when(F.col("w") > 0, F.pow("w", F.lit(float(days)) / F.col("n")) - 1)
    over = lambda c: F.when(F.col(c) > 0, F.col("ret") / F.col(c))
    values = {
        "annualized_return": F.col("ret"), "annualized_volatility": F.col("vol"), "sharpe": over("vol"), "sortino": over("down"), "max_drawdown": F.col("mdd"), "calmar": F.when(F.col("mdd") < 0, F.col("ret") / F.abs("mdd")),
        "mean_return": F.col("mean"), "mean_absolute_return": F.col("mabs"), "worst_1pct_return": F.col("q")[0], "worst_5pct_return": F.col("q")[1], "hit_rate": F.col("hit"), "n_obs": F.col("n").cast("double"),
    }
    return agg.withColumn("ret", ret).select(*by, *[v.alias(k) for k, v in values.items()])


def turnover(exposures: DataFrame, by: Sequence[str] = (), days: int = 252) -> DataFrame:
    """TURNOVER of each group's own known exposures."""
    if days <= 0:
        raise ValueError("a year has one trading day or more")
    e = exposures.select(*by, "date", num("exposure").alias("e")).where("e is not null")
    e = unblocked(running(e, by, {"before": ("lag", F.col("e"))})).withColumn("c", F.coalesce(F.abs(F.col("e") - F.col("before")), F.lit(0.0)))
    return e.groupBy(*by).agg(F.avg("e").alias(TURNOVER[0]), F.avg((F.col("e") < 1).cast("double")).alias(TURNOVER[1]), F.sum((F.col("c") > 1e-12).cast("double")).alias(TURNOVER[2]), (F.sum("c") * days / F.count("c")).alias(TURNOVER[3]), F.avg("c").alias(TURNOVER[4]))


def extreme_share(exposures: DataFrame, by: Sequence[str]) -> DataFrame:
    return exposures.groupBy(*by).agg(F.avg((num("exposure") <= 0.5).cast("double")).alias("time_in_extreme_reduction"))


def compare_to_baseline(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(metric, baseline, overlay, overlay_minus_baseline)."""
    side = lambda df, name: melt(performance(df), [], PERFORMANCE, "metric", name)
    return side(base, "baseline").join(side(overlay, "overlay"), "metric", "full_outer").withColumn("overlay_minus_baseline", F.col("overlay") - F.col("baseline"))


def cost_sensitivity(base: DataFrame, exposures: DataFrame, bps: Sequence[float] = (0.0, 5.0, 10.0), days: int = 252, by: Sequence[str] = ()) -> DataFrame:
    """(by, cost_bps, PERFORMANCE, TURNOVER)."""
    by = list(by)
    perf = performance(with_costs(apply_overlay(base, exposures, by), by, bps), [*by, "cost_bps"], days)
    own = turnover(exposures, by, days)
    return perf.join(own, by) if by else perf.crossJoin(F.broadcast(own))


def minus_baseline(metrics: DataFrame, by: Sequence[str], strategy: str = "strategy") -> DataFrame:
    """Adds <metric>_minus_baseline within each group of ``by``."""
    w = Window.partitionBy(*by)
    return metrics.withColumns({f"{c}_minus_baseline": F.col(c) - F.max(F.when(F.col(strategy) == "baseline", F.col(c))).over(w) for c in DIFFERENCES})


def evaluate_signals(returns: DataFrame, signals: DataFrame, bps: Sequence[float] = (0.0, 5.0, 10.0), days: int = 252, **options) -> tuple[DataFrame, DataFrame]:
    """Overlays of each signal column on common dates: (comparison with a baseline row and differences, costs). returns: a panel, or (date, ret)."""
    base = returns if "ret" in returns.columns else portfolio_returns(returns)
    names = [c for c in signals.columns if c != "date"]
    long = melt(signals, ["date"], names, "signal", "score").withColumn("score", num("score"))
    some = long.groupBy("signal").agg(F.count("score").alias("n")).where("n > 0").select("signal")
    e = exposure(long.join(some, "signal", "left_semi"), ["signal"], **options)
    common = base.where(num("ret").isNotNull()).join(signals.select("date"), "date", "left_semi")
    e = e.join(base.select("date"), "date", "left_semi")
    perf = performance(apply_overlay(common, e, ["signal"]), ["signal"], days).join(turnover(e, ["signal"], days), "signal").withColumn("strategy", F.concat("signal", F.lit("_overlay")))
    line = performance(common, [], days).withColumns({"signal": F.lit("baseline"), "strategy": F.lit("baseline")} | {t: F.lit(None).cast("double") for t in TURNOVER})
    out = ["signal", "strategy", *PERFORMANCE, *TURNOVER]
    comparison = minus_baseline(line.select(*out).unionAll(perf.select(*out)), [])
    return comparison, cost_sensitivity(common, e, bps, days, ["signal"]).select("signal", "cost_bps", *PERFORMANCE, *TURNOVER)


def evaluate_variants(returns: DataFrame, scores: DataFrame, columns: Sequence[str] | None = None, variants: Sequence[str] = VARIANTS, bps: Sequence[float] = (0.0, 5.0, 10.0), days: int = 252, keys: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """Each score under each variant, on dates on which all scores and the return are known: (comparison, costs).

    keys: further columns of ``scores`` (and of a return frame that has them) that keep whole evaluations apart."""
    base = returns if "ret" in returns.columns else portfolio_returns(returns)
    keys = list(keys)
    fixed = ("ri", "graph_components_equal_weight_score", "transition_score", "pca_first_eigenvalue_share", "pca_first_eigenvalue_change", "pca_plus_graph_score")
    columns = [c for c in (fixed if columns is None else columns) if c in scores.columns]
    full = stored(scores.select(*keys, "date", *[num(c).alias(c) for c in columns]).dropna(subset=columns).join(base.select("date"), "date", "left_semi"))
    long = melt(full, [*keys, "date"], columns, "score_name", "score")
    by = [*keys, "score_name", "variant"]
    unknown = set(variants) - set(VARIANTS)
    if unknown:
        raise ValueError(f"unknown rule {sorted(unknown)[0]!r}")
    long = long.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    e = stored(exposure_by_rule(long, [*keys, "score_name"], rules=tuple(variants), **options).select(*by, "date", "exposure"))
    overlay = apply_overlay(base, e, by)
    own = turnover(e, by, days)
    comparison = performance(overlay, by, days).join(own, by).join(extreme_share(e, by), by).withColumnRenamed("score_name", "score")
    costs = performance(with_costs(overlay, by, bps), [*by, "cost_bps"], days).join(own, by).withColumnRenamed("score_name", "score")
    return comparison, costs
