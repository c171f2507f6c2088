"""Configuration grids, out-of-sample selection, rolling origins, and the final matrix."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import correlation, melt, num, z_scores
from ..sources.panels import stored
from .components import COMPONENTS, mean_z
from .evaluate import RI, robustness_summary
from .graph import INDICATOR_PARTS, convergence_summary, network_grid, regime_indicator
from .models import ONSET, SampleSplits, sample_period
from .overlay import PERFORMANCE, TURNOVER, apply_overlay, benchmark_exposures, evaluate_variants, exposure, exposure_by_rule, minus_baseline, performance, turnover, with_costs
from .returns import portfolio_returns
from .stress import BENCHMARKS, benchmark_changes, stress_onsets


@dataclass(frozen=True)
class GridConfig:
    config_id: str
    alpha: float | None
    window: int
    partial_corr_threshold: float | None
    laplacian_type: str = "combinatorial"
    network_type: str = "absolute_partial_correlation"
    compute_modularity: bool = False


CONFIG = ("config_id", "alpha", "window", "partial_corr_threshold", "laplacian_type", "network_type", "compute_modularity")
CONFIG_SCHEMA = "config_id string, alpha double, window int, partial_corr_threshold double, laplacian_type string, network_type string, compute_modularity boolean"
SAMPLES = ("all", "development", "validation", "test")


def parameter_grid(alphas: Sequence[float] = (0.05, 0.10, 0.15, 0.20), windows: Sequence[int] = (63, 126, 252), thresholds: Sequence[float] = (0.0, 0.03)) -> list[GridConfig]:
    if not alphas or any(a <= 0 for a in alphas):
        raise ValueError("the grid's alphas: one or more, all above zero")
    if not windows or any(w <= 1 for w in windows):
        raise ValueError("the grid's windows: one or more, of two rows at least")
    if not thresholds or any(t < 0 for t in thresholds):
        raise ValueError("the grid's thresholds: one or more, none below zero")
    return [GridConfig(f"alpha{a:.2f}_window{w}_threshold{t:.2f}", float(a), int(w), float(t)) for a, w, t in product(alphas, windows, thresholds)]


def quick_grid() -> list[GridConfig]:
    return parameter_grid((0.20,), (63,), (0.03,))


def _configs(spark, configs: Sequence[GridConfig]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(c)[k] for k in CONFIG) for c in configs], CONFIG_SCHEMA)


def indicators(returns: DataFrame, configs: Sequence[GridConfig], **fit) -> DataFrame:
    """(config_id, date, features, regime_indicator) of every configuration in one plan."""
    if not configs:
        raise ValueError("a grid needs one configuration or more")
    grid = [{"config_id": c.config_id, "window": c.window, "alpha": c.alpha, "threshold": c.partial_corr_threshold, "with_modularity": c.compute_modularity} for c in configs]
    return regime_indicator(network_grid(returns, grid, **fit), ["config_id"])


def sample_metrics(returns: DataFrame, exposures: DataFrame, by: Sequence[str], splits: SampleSplits, days: int = 252) -> DataFrame:
    """(by, sample, strategy, PERFORMANCE, TURNOVER) of (by, strategy, date, ret) and (by, strategy, date, exposure): each row counts in
    'all' and in its own period before wealth and changes are chained."""
    keys = [*by, "sample", "strategy"]
    split = lambda df: df.withColumn("sample", F.explode(F.array_compact(F.array(F.lit("all"), sample_period(F.col("date"), splits)))))
    every = returns.select(*by, "strategy").distinct().withColumn("sample", F.explode(F.array(*map(F.lit, SAMPLES))))
    out = every.join(performance(split(returns), keys, days), keys, "left").join(turnover(split(exposures), keys, days), keys, "left")
    return out.withColumn("n_obs", F.coalesce("n_obs", F.lit(0.0))).select(*keys, *PERFORMANCE, *TURNOVER)


def transition_summary(indicator: DataFrame, benchmarks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group: difference of the indicator's mean at stress onsets, and its correlations with benchmark changes."""
    found = [c for c in BENCHMARKS if c in benchmarks.columns]
    df = indicator.select(*by, "date", num(RI).alias(RI)).join(stress_onsets(benchmarks, 20), "date", "left")
    if found:
        df = df.join(benchmark_changes(benchmarks), "date", "left")
    x, on = F.col(RI), F.col(ONSET)
    order = ("vix", "realized_volatility", "average_correlation", "average_absolute_correlation", "drawdown")
    return df.groupBy(*by).agg((F.avg(F.when(on == 1, x)) - F.avg(F.when(on == 0, x))).alias("stress_onset_ri_difference"), *[(correlation(x, F.col(f"{c}_change"), 3) if c in found else F.lit(None).cast("double")).alias(f"correlation_with_{c}_change") for c in order])


def grid_tables(ri: DataFrame, returns: DataFrame, benchmarks: DataFrame, configs: Sequence[GridConfig], splits: SampleSplits = SampleSplits(), *, method: str = "expanding", min_history: int = 20, days: int = 252, horizon: int = 21) -> dict[str, DataFrame]:
    """The four robustness tables of indicators (config_id, date, regime_indicator, ...), freshly fitted or cached."""
    named = _configs(ri.sparkSession, configs)
    base = portfolio_returns(returns)
    e = exposure(ri.select("config_id", "date", F.col(RI).alias("score")), ["config_id"], method=method, min_history=min_history).withColumn("strategy", F.lit("ri_overlay"))
    ri_ret = apply_overlay(base, e, ["config_id", "strategy"]).drop("exposure")
    line = named.select("config_id").crossJoin(base.where("ret is not null")).withColumn("strategy", F.lit("baseline")).select("config_id", "strategy", "date", "ret")
    overlay_m = sample_metrics(line.unionAll(ri_ret.select(*line.columns)), e, ["config_id"], splits, days)
    keyed = lambda df: named.join(df, "config_id")
    tables = {"robustness_overlay_metrics": keyed(minus_baseline(overlay_m, ["config_id", "sample"]))}
    if any(c in benchmarks.columns for c in BENCHMARKS):  # the same for every configuration: computed once
        be = benchmark_exposures(benchmarks, method=method, min_history=min_history).withColumn("strategy", F.concat("signal", F.lit("_overlay")))
        bench = sample_metrics(apply_overlay(base, be, ["strategy"]).select("strategy", "date", "ret"), be, [], splits, days)
        both = overlay_m.unionByName(named.select("config_id").crossJoin(bench))
    else:
        both = overlay_m
    tables["robustness_benchmark_comparison"] = keyed(minus_baseline(both, ["config_id", "sample"]))
    summary = robustness_summary(ri, benchmarks, returns, horizon, by=["config_id"])
    tables["robustness_grid_summary"] = keyed(summary.join(transition_summary(ri, benchmarks, ["config_id"]), "config_id"))
    if "graph_lasso_converged" in ri.columns:
        tables["robustness_convergence_summary"] = keyed(convergence_summary(ri, ["config_id"]))
    else:
        empty = ("n_converged", "n_non_converged", "convergence_rate", "graph_lasso_warning_count_total", "graph_lasso_n_iter_mean", "graph_lasso_n_iter_max")
        tables["robustness_convergence_summary"] = keyed(ri.groupBy("config_id").agg(F.count(RI).alias("n_windows"), *[F.lit(None).cast("double").alias(c) for c in empty]))
    return tables


def robustness_grid(returns: DataFrame, benchmarks: DataFrame, configs: Sequence[GridConfig], splits: SampleSplits = SampleSplits(), fit: dict | None = None, **options) -> dict[str, DataFrame]:
    return grid_tables(indicators(returns, configs, **(fit or {})), returns, benchmarks, configs, splits, **options)


def tables_from_indicator(indicator: DataFrame, returns: DataFrame, benchmarks: DataFrame, config: GridConfig | None = None, **options) -> dict[str, DataFrame]:
    config = config or GridConfig("cached_indicator", None, 0, None)
    return grid_tables(indicator.withColumn("config_id", F.lit(config.config_id)), returns, benchmarks, [config], **options)


def run_robustness_grid(returns: DataFrame, benchmarks: DataFrame, alphas: Sequence[float] = (0.10,), windows: Sequence[int] = (126,), thresholds: Sequence[float] = (1e-6,), modularity: Sequence[bool] = (False,), horizon: int = 21, **fit) -> DataFrame:
    """One summary row per alpha, window, threshold and modularity choice."""
    grid = parameter_grid(alphas, windows, thresholds)
    if not modularity:
        raise ValueError("the grid's choices of modularity: one or more")
    configs = [GridConfig(f"{k}", c.alpha, c.window, c.partial_corr_threshold, compute_modularity=bool(m)) for k, (c, m) in enumerate(product(grid, modularity))]
    ri = indicators(returns, configs, **fit)
    return _configs(returns.sparkSession, configs).select("config_id", "alpha", "window", "partial_corr_threshold", "compute_modularity").join(robustness_summary(ri, benchmarks, returns, horizon, by=["config_id"]), "config_id").drop("config_id")


def select_configuration(metrics: DataFrame) -> DataFrame:
    """Validation rows only: the score and the selected configuration (the first by name of those whose scores agree to nine digits); missing values keep a score null and can't be selected."""
    rows = metrics.where("sample = 'validation' and strategy in ('baseline', 'ri_overlay')")
    side = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    o, b = (lambda c: side("ri_overlay", c)), (lambda c: side("baseline", c))
    wide = rows.groupBy("config_id").agg(
        F.first("alpha").alias("alpha"), F.first("window").alias("window"), F.first("partial_corr_threshold").alias("partial_corr_threshold"), o("sharpe").alias("validation_sharpe"), o("calmar").alias("validation_calmar"),
        (o("max_drawdown") - b("max_drawdown")).alias("validation_max_drawdown_reduction"), (b("annualized_volatility") - o("annualized_volatility")).alias("validation_volatility_reduction"),
        (o("worst_5pct_return") - b("worst_5pct_return")).alias("validation_downside_improvement"), o("annualized_turnover_proxy").alias("validation_annualized_turnover_proxy"), F.count_distinct("strategy").alias("_n"),
    ).where("_n = 2").drop("_n")
    parts = ["validation_sharpe", "validation_calmar", "validation_max_drawdown_reduction", "validation_volatility_reduction", "validation_downside_improvement", "validation_annualized_turnover_proxy"]
    z = z_scores(wide, {f"_z{k}": c for k, c in enumerate(parts)}, fill=False)
    z = z.withColumn("selection_score", sum((F.col(f"_z{k}") for k in range(5)), F.lit(0.0)) - 0.25 * F.col("_z5")).drop(*[f"_z{k}" for k in range(6)])
    first = F.row_number().over(Window.orderBy(F.round("selection_score", 9).desc_nulls_last(), "config_id"))
    return z.withColumn("selected", (first == 1) & F.col("selection_score").isNotNull())


def oos_outputs(metrics: DataFrame, comparison: DataFrame, selection: DataFrame) -> dict[str, DataFrame]:
    """Test rows of the selected configuration."""
    if "selected" not in selection.columns:
        raise KeyError("the selection has no column selected")
    chosen = F.broadcast(selection.where("selected").select("config_id"))  # one row
    test = lambda df: df.where("sample = 'test'").join(chosen, "config_id", "left_semi")
    return {"oos_selection_summary": selection, "oos_test_performance": test(metrics), "oos_overlay_comparison": test(comparison)}


@dataclass(frozen=True)
class OriginSplit:
    test_year: int
    selection_start: str
    selection_end: str
    test_start: str
    test_end: str


def origin_splits(years: Sequence[int] = (2020, 2021, 2022, 2023, 2024, 2025), start: str = "2015-07-06") -> list[OriginSplit]:
    return [OriginSplit(y, start, f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in years]


#: Fixed default candidates (name, score), daily rule each; information sets and simplicity for the final matrix.
CANDIDATES = tuple((c, c, "daily") for c in ("ri", "graph_components_equal_weight_score", "transition_score", "pca_score", "pca_plus_graph_score", "excluding_algebraic_connectivity_score"))
MATRIX = {
    "ri": ("benchmarks_plus_ri", 4.0), "graph_components_equal_weight_score": ("benchmarks_plus_graph_components", 3.5), "transition_score": ("benchmarks_plus_graph_components", 5.0), "pca_score": ("benchmarks_plus_pca", 5.0),
    "pca_plus_graph_score": ("benchmarks_plus_pca_plus_graph_components", 2.5), "excluding_algebraic_connectivity_score": ("benchmarks_plus_graph_components", 3.0), "best_low_turnover_score": ("benchmarks_plus_graph_components", 2.5),
}


def split_scores(scores: DataFrame, splits: Sequence[OriginSplit]) -> DataFrame:
    """Scores of every split, keyed by test_year, scaled with the moments of its selection period; rows of either period, with flags."""
    spark = scores.sparkSession
    s = spark.createDataFrame([(x.test_year, x.selection_start, x.selection_end, x.test_start, x.test_end) for x in splits], "test_year int, a string, b string, c string, d string")
    s = s.select("test_year", *[F.col(k).cast("date").alias(k) for k in "abcd"])
    raw = [c for c in COMPONENTS if c in scores.columns]
    wide = [c for c in ("pca_first_eigenvalue_share", "pca_first_eigenvalue_change") if c in scores.columns]
    use = [c for c in dict.fromkeys([*raw, *wide, "ri", "modularity"]) if c in scores.columns]
    day = F.col("date").cast("date")
    df = scores.select("date", *[num(c).alias(c) for c in use]).join(F.broadcast(s), ((day >= F.col("a")) & (day <= F.col("b"))) | ((day >= F.col("c")) & (day <= F.col("d"))))  # splits are a short list of the caller's
    df = df.withColumns({"selecting": (day >= F.col("a")) & (day <= F.col("b")), "testing": (day >= F.col("c")) & (day <= F.col("d"))}).drop(*"abcd")
    by, on = ["test_year"], F.col("selecting")
    parts = [(c, sign) for c, sign in INDICATOR_PARTS if c in scores.columns]
    if "ri" in scores.columns and parts:
        df = z_scores(df, {f"_r{k}": c for k, (c, _) in enumerate(parts)}, by, over=on).withColumn("ri", sum((F.lit(sign) * F.col(f"_r{k}") for k, (_, sign) in enumerate(parts)), F.lit(0.0))).drop(*[f"_r{k}" for k in range(len(parts))])
    blocks = {"graph_components_equal_weight_score": raw, "excluding_algebraic_connectivity_score": [c for c in raw if c != "algebraic_connectivity"], "transition_score": [c for c in raw if c == "laplacian_frobenius_change"], "pca_score": wide}
    for name, columns in blocks.items():
        if columns:
            df = mean_z(df, name, columns, by, on)
    combined = [c for c in ("graph_components_equal_weight_score", "transition_score", "pca_score") if c in df.columns]
    return mean_z(df, "pca_plus_graph_score", combined, by, on) if combined else df


def rolling_origin(returns: DataFrame, scores: DataFrame, specs: Sequence[tuple[str, str, str]] | None = None, splits: Sequence[OriginSplit] | None = None, bps: Sequence[float] = (0.0, 5.0, 10.0), days: int = 252, dynamic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(performance, summary): per split and candidate, thresholds fixed on the selection period, applied to the test year.

    specs: (candidate, score, variant). dynamic: adds best_low_turnover_score, whose score and variant each split selects itself.
    Splits need 20 selection rows and 5 test rows.
    """
    splits = origin_splits() if splits is None else splits
    base = returns if "ret" in returns.columns else portfolio_returns(returns)
    spark = scores.sparkSession
    df = split_scores(scores, splits)
    enough = df.groupBy("test_year").agg(F.sum(F.col("selecting").cast("int")).alias("s"), F.sum(F.col("testing").cast("int")).alias("t")).where("s >= 20 and t >= 5").select("test_year")
    df = stored(df.join(enough, "test_year", "left_semi"))
    specs = [s for s in (CANDIDATES if specs is None else specs) if s[1] in df.columns]
    chosen = spark.createDataFrame([(x.test_year, c, s, v) for x in splits for c, s, v in specs], "test_year int, candidate string, score_name string, variant string")
    chosen = chosen.withColumns({"score": F.col("score_name"), "shown": F.col("variant"), "selected_score": F.lit(""), "selected_variant": F.lit("")})
    if dynamic:
        comparison, _ = evaluate_variants(base, df.where("selecting"), keys=["test_year"])
        best = stored(low_turnover_choice(comparison, ["test_year"]))
        chosen = chosen.unionAll(best.select("test_year", F.lit("best_low_turnover_score"), "score", "variant", F.lit("selection_period_best_low_turnover"), F.lit("dynamic"), "score", "variant"))
    names = [c for c in df.columns if c not in ("test_year", "date", "selecting", "testing")]
    long = melt(df, ["test_year", "date", "selecting", "testing"], names, "score_name", "score").join(chosen.select("test_year", "candidate", "score_name", "variant"), ["test_year", "score_name"])
    key = ["test_year", "candidate"]
    q = F.percentile(F.when(F.col("selecting"), F.col("score")), F.array(*map(F.lit, (0.8, 0.9, 0.6)))).over(Window.partitionBy(*key))
    long = stored(long.withColumn("q", q))
    e = exposure_by_rule(long.select(*key, "variant", "date", "score", F.col("q").alias("levels")), key, thresholds=F.col("levels")).drop("variant")
    e = e.join(df.where("testing").select("test_year", "date"), ["test_year", "date"], "left_semi")
    overlay = apply_overlay(base, e, key)
    perf = performance(with_costs(overlay, key, bps), [*key, "cost_bps"], days).join(turnover(e, key, days), key)
    s = spark.createDataFrame([(x.test_year, x.selection_start, x.selection_end, x.test_start, x.test_end) for x in splits], "test_year int, selection_start string, selection_end string, test_start string, test_end string")
    s = s.select("test_year", *[F.col(k).cast("date").alias(k) for k in s.columns[1:]])
    out = perf.join(chosen.drop("score_name", "variant"), key).join(s, "test_year")
    out = out.select("candidate", "score", F.col("shown").alias("variant"), "selected_score", "selected_variant", F.col("test_year").cast("double").alias("test_year"), "cost_bps", "selection_start", "selection_end", "test_start", "test_end", *PERFORMANCE, *TURNOVER)
    return out, rolling_summary(out)


def low_turnover_choice(comparison: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, score, variant) with the best z(calmar) + z(sharpe) + z(max_drawdown) - z(turnover) / 2; the earliest in order wins ties."""
    columns = {"_c": "calmar", "_s": "sharpe", "_d": "max_drawdown", "_t": "annualized_turnover_proxy"}
    z = z_scores(comparison, columns, list(by)).withColumn("_v", F.col("_c") + F.col("_s") + F.col("_d") - 0.5 * F.col("_t"))
    order = F.array(*map(F.lit, ("ri", "graph_components_equal_weight_score", "transition_score", "pca_first_eigenvalue_share", "pca_first_eigenvalue_change", "pca_plus_graph_score")))
    variants = F.array(*map(F.lit, ("daily", "weekly", "smoothed_5d", "smoothed_10d", "hysteresis", "cooldown_5d", "smoothed_5d_hysteresis")))
    w = Window.partitionBy(*by).orderBy(F.round("_v", 12).desc(), F.array_position(order, F.col("score")), F.array_position(variants, F.col("variant")))
    return z.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*by, "score", "variant")


def select_low_turnover(comparison: DataFrame) -> dict[str, str]:
    """The chosen candidate as a dictionary; the default if there is nothing to choose from."""
    row = low_turnover_choice(comparison).first()
    return {"candidate": "best_low_turnover_score", "score": row["score"] if row else "graph_components_equal_weight_score", "variant": row["variant"] if row else "smoothed_5d_hysteresis"}


def rolling_summary(perf: DataFrame) -> DataFrame:
    metrics = ("annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "worst_5pct_return", "annualized_turnover_proxy")
    yes = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return perf.groupBy("candidate", "score", "variant", "cost_bps").agg(
        F.count_distinct("test_year").cast("double").alias("n_test_years"), *[x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.percentile(m, 0.5).alias(f"median_{m}"))],
        yes(F.col("sharpe") > 0).alias("share_years_positive_sharpe"), yes(F.col("max_drawdown") > -0.2).alias("share_years_drawdown_better_than_20pct"),
    )


def final_matrix(information: DataFrame, summary: DataFrame, candidates: Sequence[str] = tuple(MATRIX)) -> DataFrame:
    """One row per candidate: rolling results, model results of its information set, and the selection score."""
    spark = summary.sparkSession
    rows = [(k, c, *MATRIX.get(c, ("benchmarks_plus_graph_components", 3.0)), c in ("pca_score", "pca_plus_graph_score"), c not in ("pca_score", "best_low_turnover_score")) for k, c in enumerate(candidates)]
    names = spark.createDataFrame(rows, "ord int, candidate string, information_set string, simplicity_interpretability_score double, depends_on_pca boolean, depends_on_graph_components boolean")
    best = summary.withColumn("k", F.row_number().over(Window.partitionBy("candidate", "cost_bps").orderBy(F.col("mean_sharpe").desc_nulls_last(), "score", "variant"))).where("k = 1")
    at = lambda bps, **columns: best.where(F.col("cost_bps") == bps).select("candidate", *[F.col(c).alias(n) for n, c in columns.items()])
    rolled = at(0.0, oos_sharpe="mean_sharpe", oos_calmar="mean_calmar", oos_max_drawdown="mean_max_drawdown", oos_sortino="mean_sortino", oos_worst_5pct="mean_worst_5pct_return", turnover="mean_annualized_turnover_proxy", robustness_across_years="share_years_positive_sharpe")
    info = information.groupBy("information_set").agg(F.max(F.when(F.col("target") == ONSET, F.col("oos_auc"))).alias("oos_stress_onset_auc"), F.max(F.when(F.col("target") == "future_realized_volatility_21d", F.col("oos_r2"))).alias("oos_volatility_prediction_r2"))
    df = names.join(rolled, "candidate", "left").join(at(10.0, cost_10bps_sharpe="mean_sharpe"), "candidate", "left").join(info, "information_set", "left")
    parts = ("oos_sharpe", "oos_calmar", "cost_10bps_sharpe", "robustness_across_years", "turnover")
    df = z_scores(df, {f"_z{k}": c for k, c in enumerate(parts)})
    df = df.withColumn("selection_score", sum((F.col(f"_z{k}") for k in range(4)), F.lit(0.0)) - 0.5 * F.col("_z4")).drop(*[f"_z{k}" for k in range(5)])
    return df.drop("information_set", "ord")


