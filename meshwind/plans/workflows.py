"""The research workflows as bundles of lazy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import melt, num
from ..operators import components, evaluate, graph, models, overlay, returns as ret, selection, stress


def benchmark_table(prices: DataFrame, returns: DataFrame, vix: DataFrame, vol_window: int = 21, corr_window: int = 126, vix_threshold: float = 30.0, drawdown_threshold: float = -0.10) -> DataFrame:
    """Stress benchmarks and labels by date, with the average absolute correlation, which gets no label. prices: (date, value)."""
    both = stress.correlation_scores(returns, corr_window)
    labels = stress.stress_labels(vix, stress.market_drawdown(prices), stress.realized_volatility(returns, vol_window), both.select("date", "average_correlation"), vix_threshold, drawdown_threshold)
    return stress.outer_join(labels, both.select("date", "average_absolute_correlation")).where("date is not null")


def empirical(returns: DataFrame, benchmarks: DataFrame, window: int = 126, alpha: float = 0.10, threshold: float = 1e-6, horizons: Sequence[int] = (5, 21, 63), max_iter: int = 1000) -> dict[str, DataFrame]:
    """Features, indicator, convergence, contemporaneous and predictive diagnostics, regime classes."""
    features = graph.rolling_graph_features(returns, window, alpha, partial_corr_threshold=threshold, max_iter=max_iter)
    ri = graph.regime_indicator(features)
    aligned = evaluate.align(ri, benchmarks)
    return {
        "network_features": features, "regime_indicator": ri, "benchmark_stress_labels": benchmarks, "graph_lasso_convergence_diagnostics": graph.convergence_summary(features), "contemporaneous_diagnostics": evaluate.contemporaneous_diagnostics(aligned),
        "predictive_diagnostics": evaluate.predictive_power(ri, evaluate.forward_targets(returns, horizons)), "regime_class_summary": evaluate.regime_summary(ri, returns),
    }


def overlays(ri: DataFrame, returns: DataFrame, benchmarks: DataFrame) -> dict[str, DataFrame]:
    """Strategy metrics with differences to the baseline, exposure summaries, transition diagnostics, converged windows against all."""
    base = ret.portfolio_returns(returns)
    scores = melt(ri.select("date", F.col("regime_indicator").alias("ri")), ["date"], ["ri"], "signal", "score")
    e = overlay.exposure(scores, ["signal"]).unionAll(overlay.benchmark_exposures(benchmarks))
    perf = overlay.performance(overlay.apply_overlay(base, e, ["signal"]), ["signal"]).select(F.concat("signal", F.lit("_overlay")).alias("strategy"), *overlay.PERFORMANCE)
    line = overlay.performance(base).withColumn("strategy", F.lit("baseline")).select(*perf.columns)
    changes = evaluate.transition_correlations(ri, stress.benchmark_changes(benchmarks))
    onset = evaluate.align(ri.select("date", "regime_indicator"), stress.stress_onsets(benchmarks))
    onset = evaluate.contemporaneous_diagnostics(onset, labels=["stress_onset_label"], continuous=[])
    out = {
        "overlay_performance_comparison": overlay.minus_baseline(line.unionAll(perf), []), "overlay_exposure_summary": overlay.summarize_exposures(e),
        "transition_diagnostics": changes.select("diagnostic_type", "benchmark", "n_obs", "pearson_correlation", "spearman_correlation"), "stress_onset_diagnostics": onset,
    }
    if "graph_lasso_converged" in ri.columns:
        out["non_converged_exclusion_diagnostics"] = evaluate.converged_vs_all(ri, benchmarks, returns)
    return out


def grid_selection(returns: DataFrame, benchmarks: DataFrame, configs, splits: models.SampleSplits = models.SampleSplits(), fit: dict | None = None, **options) -> dict[str, DataFrame]:
    """The robustness grid, its selected configuration, test results, incremental tests and costs of the selected indicator."""
    ri = selection.indicators(returns, configs, **(fit or {}))
    out = selection.grid_tables(ri, returns, benchmarks, configs, splits, **options)
    chosen = selection.select_configuration(out["robustness_overlay_metrics"])
    out |= selection.oos_outputs(out["robustness_overlay_metrics"], out["robustness_benchmark_comparison"], chosen)
    own = ri.join(F.broadcast(chosen.where("selected").select("config_id")), "config_id", "left_semi")  # one row
    out["incremental_information_tests"] = models.incremental_tests(own, benchmarks, returns, splits)
    out["transaction_cost_sensitivity"] = overlay.cost_sensitivity(ret.portfolio_returns(returns), overlay.exposure(own.select("date", F.col("regime_indicator").alias("score"))))
    return out


def consolidation(ri: DataFrame, returns: DataFrame, benchmarks: DataFrame, splits: models.SampleSplits, origins: Sequence[selection.OriginSplit], pca_window: int = 126, min_history: int = 126) -> dict[str, DataFrame]:
    """Spectra, component scores, model ladder, ablations, information sets, low-turnover variants, rolling origins, final matrix."""
    pca = graph.rolling_pca_features(returns, pca_window)
    scores = components.add_component_scores(ri, benchmarks, "expanding", min_history)
    candidates = components.candidate_scores(ri, pca)
    comparison, costs = overlay.evaluate_signals(returns, components.overlay_signals(ri, pca))
    information = models.information_sets(ri, benchmarks, returns, pca, scores, splits)
    algebraic, algebraic_costs = components.algebraic_overlays(ri, returns)
    turn, turn_costs = overlay.evaluate_variants(returns, candidates)
    perf, summary = selection.rolling_origin(returns, candidates, splits=origins, dynamic=True)
    return {
        "pca_baseline_features": pca, "graph_component_scores": scores, "model_ladder_incremental_tests": models.model_ladder(ri, benchmarks, returns, pca, scores, splits), "component_overlay_comparison": comparison, "component_overlay_transaction_costs": costs,
        "graph_component_ablation": models.component_ablation(scores, benchmarks, returns, splits), "information_set_model_comparison": information, "information_set_ranking": models.rank_information_sets(information),
        "algebraic_connectivity_diagnostics": components.algebraic_diagnostics(ri, benchmarks, models.targets(returns, benchmarks, prefix="future"), pca), "algebraic_connectivity_overlay_comparison": algebraic, "algebraic_connectivity_cost_sensitivity": algebraic_costs,
        "turnover_reduction_overlay_comparison": turn, "turnover_reduction_cost_sensitivity": turn_costs, "rolling_origin_oos_performance": perf, "rolling_origin_oos_summary": summary, "final_candidate_selection_matrix": selection.final_matrix(information, summary),
    }


def vix_proxy(orders: DataFrame) -> DataFrame:
    """(date, vix): weekly dispersion of order prices in thousands, a stand-in where no index is at hand."""
    return orders.groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg((F.stddev_samp(num("o_totalprice")) / 1000).alias("vix"))
