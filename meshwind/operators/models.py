"""Regressions and classifications of targets on sets of regressors: one plan for all (target, model) pairs, one group each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import finite, melt, num, row_mean, sign_name, z_scores
from .components import COMPONENTS, CONTROLS
from .evaluate import forward_targets
from .overlay import apply_overlay, exposure, performance, turnover
from .returns import portfolio_returns
from .stress import outer_join, stress_onsets

ONSET = "stress_onset_label"
ORTHOGONAL_COLUMNS = ("orthogonal_average_graph_strength", "orthogonal_algebraic_connectivity", "orthogonal_laplacian_frobenius_change", "orthogonal_largest_eigenvalue_share", "orthogonal_graph_score")


@dataclass(frozen=True)
class SampleSplits:
    development_start: str = "2015-07-06"
    development_end: str = "2019-12-31"
    validation_start: str = "2020-01-01"
    validation_end: str = "2022-12-31"
    test_start: str = "2023-01-01"


def sample_period(date: Column, splits: SampleSplits = SampleSplits()) -> Column:
    """development, validation or test by date, else null; the later period wins."""
    day = lambda s: F.lit(s).cast("date")
    within = lambda a, b: (date >= day(a)) & (date <= day(b))
    return F.when(date >= day(splits.test_start), "test").when(within(splits.validation_start, splits.validation_end), "validation").when(within(splits.development_start, splits.development_end), "development")


def targets(returns: DataFrame, benchmarks: DataFrame, horizons: Sequence[int] = (5, 21), prefix: str = "forward") -> DataFrame:
    """(date, <prefix>_realized_volatility_<h>d, <prefix>_max_drawdown_<h>d, stress_onset_label)."""
    forward = forward_targets(returns, horizons)
    names = [f"{k}_{h}d" for h in horizons for k in ("realized_volatility", "max_drawdown")]
    forward = forward.select("date", *[F.col(f"forward_{n}").alias(f"{prefix}_{n}") for n in names])
    return outer_join(forward, stress_onsets(benchmarks, 20))


def fit_models(design: DataFrame, targets_: DataFrame, specs: Mapping[str, Sequence[str]], splits: SampleSplits = SampleSplits(), lags: int = 5) -> DataFrame:
    """(target, model, n_obs, n_positive, regressors, MODEL_METRICS, coefficients, t_stats) of complete rows; pairs without any row are missing."""
    specs = {m: list(dict.fromkeys(c)) for m, c in specs.items() if c}
    names = [c for c in targets_.columns if c != "date"]
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.array(*[num(c) for c in cols]).alias("x")) for m, cols in specs.items()])
    rows = melt(targets_.join(design, "date").withColumn("_models", models).withColumn("_period", F.coalesce(sample_period(F.col("date"), splits), F.lit(""))), ["date", "_models", "_period"], names, "target", "y")
    rows = rows.where(finite("y").isNotNull()).select("target", "date", "y", "_period", F.explode("_models").alias("m")).select("target", "m.model", "date", "y", "_period", "m.x").where(F.forall("x", lambda v: v.isNotNull()))
    metrics = kernels.MODEL_METRICS

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date")
        y = f["y"].to_numpy(float)
        got = kernels.fit_model(y, np.array([np.asarray(v, float) for v in f["x"]]), f["_period"].to_numpy(), lags, key[0] == ONSET)
        return pd.DataFrame({"target": [key[0]], "model": [key[1]], "n_obs": [float(len(y))], "n_positive": [float((y == 1).sum())], **{m: [got[m]] for m in metrics}, "coefficients": [got["coefficients"]], "t_stats": [got["t_stats"]]})

    schema = "target string, model string, n_obs double, n_positive double, " + ", ".join(f"{m} double" for m in metrics) + ", coefficients array<double>, t_stats array<double>"
    out = rows.groupBy("target", "model").applyInPandas(run, schema)
    regressors = F.create_map(*[x for m, cols in specs.items() for x in (F.lit(m), F.array(*map(F.lit, cols)))])[F.col("model")]
    return out.withColumns({m: finite(m) for m in metrics}).withColumn("regressors", regressors)


def _per_regressor(fits: DataFrame, metrics: Sequence[str]) -> DataFrame:
    rows = fits.select("*", F.explode(F.arrays_zip(F.col("regressors").alias("regressor"), F.col("coefficients").alias("coefficient"), F.col("t_stats").alias("t_stat"))).alias("r"))
    return rows.select("target", "model", "r.regressor", "n_obs", *metrics, finite("r.coefficient").alias("coefficient"), sign_name(F.col("r.coefficient")).alias("coefficient_sign"), finite("r.t_stat").alias("t_stat"))


def incremental_tests(indicator: DataFrame, benchmarks: DataFrame, returns: DataFrame, splits: SampleSplits = SampleSplits(), horizons: Sequence[int] = (5, 21), lags: int = 5, baselines: Sequence[str] = CONTROLS, components: Sequence[str] = COMPONENTS[:4]) -> DataFrame:
    """Baseline, baseline and indicator, baseline and indicator and components, a row per regressor; models without any row get a 'missing' row."""
    base, graph = [c for c in baselines if c in benchmarks.columns], [c for c in components if c in indicator.columns]
    specs = {"baseline": base, "baseline_plus_ri": [*base, "regime_indicator"], "baseline_plus_graph_components": [*base, "regime_indicator", *graph]}
    design = outer_join(benchmarks.select("date", *base), indicator.select("date", "regime_indicator", *graph))
    t = targets(returns, benchmarks, horizons)
    metrics = ["adjusted_r2", "oos_r2", "auc", "brier_score", "oos_auc", "oos_brier_score"]
    got = _per_regressor(fit_models(design, t, specs, splits, lags), metrics)
    every = indicator.sparkSession.createDataFrame([(c, m) for c in t.columns if c != "date" for m in specs if specs[m]], "target string, model string")
    return every.join(got, ["target", "model"], "left").withColumns({"regressor": F.coalesce("regressor", F.lit("model")), "n_obs": F.coalesce("n_obs", F.lit(0.0)), "coefficient_sign": F.coalesce("coefficient_sign", F.lit("missing"))})


def regressor_frame(features: DataFrame, benchmarks: DataFrame, pca: DataFrame | None, scores: DataFrame | None, columns: Sequence[str]) -> DataFrame:
    """Benchmarks, the named graph columns (from features first), and all pca columns, by date of any."""
    own = [c for c in columns if c in features.columns]
    extra = [c for c in columns if scores is not None and c in scores.columns and c not in own]
    frames = [benchmarks.select("date", *[c for c in CONTROLS if c in benchmarks.columns]), features.select("date", *own)]
    if extra:
        frames.append(scores.select("date", *extra))
    if pca is not None:
        frames.append(pca)
    return outer_join(*frames)


def model_ladder(features: DataFrame, benchmarks: DataFrame, returns: DataFrame, pca: DataFrame | None = None, scores: DataFrame | None = None, splits: SampleSplits = SampleSplits(), horizons: Sequence[int] = (5, 21), lags: int = 5) -> DataFrame:
    """M0 to M5, a row per target, model and regressor."""
    design = regressor_frame(features, benchmarks, pca, scores, ("regime_indicator", *COMPONENTS, *ORTHOGONAL_COLUMNS))
    pick = lambda names: [c for c in names if c in design.columns]
    base, graph, wide, ortho = pick(CONTROLS), pick(COMPONENTS), [c for c in design.columns if c.startswith("pca_")], pick(ORTHOGONAL_COLUMNS)
    specs = {"M0_benchmarks": base, "M1_benchmarks_plus_ri": base + pick(["regime_indicator"]), "M2_benchmarks_plus_pca": base + wide, "M3_benchmarks_plus_graph_components": base + graph, "M4_benchmarks_plus_pca_plus_graph_components": base + wide + graph}
    if ortho:
        specs["M5_benchmarks_plus_orthogonal_graph"] = base + ortho
    fits = _reg_only(fit_models(design, targets(returns, benchmarks, horizons), specs, splits, lags))
    return _per_regressor(fits, list(kernels.MODEL_METRICS))


def _reg_only(fits: DataFrame) -> DataFrame:
    """Out-of-sample R2 is for regressions."""
    return fits.withColumn("oos_r2", F.when(F.col("target") != ONSET, F.col("oos_r2")))


def information_sets(features: DataFrame, benchmarks: DataFrame, returns: DataFrame, pca: DataFrame | None = None, scores: DataFrame | None = None, splits: SampleSplits = SampleSplits(), horizons: Sequence[int] = (5, 21), lags: int = 5) -> DataFrame:
    """Nine sets of regressors, a row per target and set."""
    design = regressor_frame(features, benchmarks, pca, scores, ("regime_indicator", *COMPONENTS))
    pick = lambda names: [c for c in names if c in design.columns]
    b, ri, g, p = pick(CONTROLS), pick(["regime_indicator"]), pick(COMPONENTS), [c for c in design.columns if c.startswith("pca_")]
    specs = {"benchmarks_only": b, "ri_only": ri, "pca_only": p, "graph_components_only": g, "pca_plus_graph_components": p + g, "benchmarks_plus_ri": b + ri, "benchmarks_plus_pca": b + p, "benchmarks_plus_graph_components": b + g, "benchmarks_plus_pca_plus_graph_components": b + p + g}
    fits = _reg_only(fit_models(design, targets(returns, benchmarks, horizons, "future"), specs, splits, lags))
    is_class = F.col("target") == ONSET
    signs = F.array_join(F.zip_with("regressors", "coefficients", lambda r, c: F.concat(r, F.lit(":"), sign_name(c))), ";")
    note = F.when(is_class, "classification_scores_are_linear_probability_diagnostics").otherwise("in_sample_metrics_are_diagnostics_only")
    return fits.select("target", F.when(is_class, "classification").otherwise("regression").alias("target_type"), F.col("model").alias("information_set"), "n_obs", F.when(is_class, F.col("n_positive")).alias("n_positive_events"), F.size("regressors").cast("double").alias("n_regressors"), F.array_join("regressors", ",").alias("regressors"), *kernels.MODEL_METRICS, signs.alias("coefficient_signs"), note.alias("diagnostic_note"))


#: Fixed ranking rules: target type, metric, direction, whether only a diagnostic.
RANKED = (("regression", "oos_r2", "max", False), ("regression", "adjusted_r2", "max", True), ("regression", "rmse", "min", True), ("regression", "mae", "min", True), ("regression", "oos_rmse", "min", False), ("regression", "oos_mae", "min", False), ("classification", "oos_auc", "max", False), ("classification", "auc", "max", True), ("classification", "oos_brier_score", "min", False), ("classification", "brier_score", "min", True))
SETS = ("benchmarks_only", "ri_only", "pca_only", "graph_components_only", "pca_plus_graph_components", "benchmarks_plus_ri", "benchmarks_plus_pca", "benchmarks_plus_graph_components", "benchmarks_plus_pca_plus_graph_components")


def rank_information_sets(comparison: DataFrame) -> DataFrame:
    """The best set per target and metric; the first set wins ties."""
    missing = {"target", "information_set", "target_type"} - set(comparison.columns)
    if missing:
        raise KeyError(f"the ranking lacks {sorted(missing)}")
    rules = [r for r in RANKED if r[1] in comparison.columns]
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SETS)), F.col("information_set")), F.lit(0))
    each = comparison.select("target", "target_type", "information_set", place.alias("place"), F.explode(F.array(*[F.struct(F.lit(t).alias("of"), F.lit(m).alias("metric"), F.lit(d).alias("rank_direction"), F.lit(o).alias("diagnostics_only"), num(m).alias("v")) for t, m, d, o in rules])).alias("r")).select("*", "r.*").where("of = target_type and v is not null")
    w = Window.partitionBy("target", "target_type", "metric")
    key = F.when(F.col("rank_direction") == "max", -F.col("v")).otherwise(F.col("v"))
    best = each.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy(key, "place", "information_set"))}).where("k = 1")
    return best.select("target", "target_type", "metric", "rank_direction", F.col("information_set").alias("best_information_set"), F.col("v").alias("best_value"), F.col("n").cast("double").alias("n_candidates"), "diagnostics_only")


ABLATIONS = {
    "all_graph_components": COMPONENTS, "excluding_laplacian_frobenius_change": tuple(c for c in COMPONENTS if c != "laplacian_frobenius_change"), "excluding_algebraic_connectivity": tuple(c for c in COMPONENTS if c != "algebraic_connectivity"),
    "excluding_average_graph_strength": tuple(c for c in COMPONENTS if c != "average_graph_strength"), "excluding_largest_eigenvalue_share": tuple(c for c in COMPONENTS if c != "largest_laplacian_eigenvalue_share"),
    "connectivity_only": ("connectivity_score",), "transition_only": ("transition_score",), "spectral_only": ("spectral_score",),
}


def component_ablation(scores: DataFrame, benchmarks: DataFrame, returns: DataFrame, splits: SampleSplits = SampleSplits(), horizon: int = 21, min_history: int = 20) -> DataFrame:
    """One row per ablation: regression on volatility, classification of stress onsets, and the overlay of the mean z score."""
    specs = {a: [c for c in cols if c in scores.columns] for a, cols in ABLATIONS.items()}
    specs = {a: cols for a, cols in specs.items() if cols}
    used = sorted({c for cols in specs.values() for c in cols})
    base = [c for c in CONTROLS if c in benchmarks.columns]
    t = targets(returns, benchmarks, (horizon,)).select("date", f"forward_realized_volatility_{horizon}d", ONSET)
    fits = fit_models(outer_join(benchmarks.select("date", *base), scores.select("date", *used)), t, {a: base + cols for a, cols in specs.items()}, splits)
    when = lambda onset, c: F.max(F.when((F.col("target") == ONSET) == onset, F.col(c))).alias(c)
    models = fits.groupBy(F.col("model").alias("ablation")).agg(when(False, "adjusted_r2"), when(False, "oos_r2"), when(True, "auc"), when(True, "oos_auc"))
    z = z_scores(scores.select("date", *[num(c).alias(c) for c in used]), {f"_z_{c}": c for c in used})
    long = melt(z.withColumns({a: row_mean([f"_z_{c}" for c in cols]) for a, cols in specs.items()}), ["date"], list(specs), "ablation", "score")
    e = exposure(long, ["ablation"], min_history=min_history)
    perf = performance(apply_overlay(returns if "ret" in returns.columns else portfolio_returns(returns), e, ["ablation"]), ["ablation"])
    perf = perf.select("ablation", F.col("sharpe").alias("overlay_sharpe"), F.col("calmar").alias("overlay_calmar"), F.col("max_drawdown").alias("overlay_max_drawdown"))
    names = scores.sparkSession.createDataFrame([(a, len(cols), ",".join(cols)) for a, cols in specs.items()], "ablation string, component_count long, components string")
    own = turnover(e, ["ablation"]).select("ablation", "annualized_turnover_proxy", "time_in_reduced_exposure")
    return names.join(models, "ablation", "left").join(perf, "ablation", "left").join(own, "ablation", "left")
