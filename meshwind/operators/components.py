"""Component scores, residuals against benchmarks, candidate scores, algebraic-connectivity diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import correlation, finite, melt, num, row_mean, z_scores
from ..functions.scans import average_ranks, blocked
from .evaluate import spearman_frame
from .overlay import evaluate_variants
from .stress import outer_join

#: Fixed column lists, in order.
COMPONENTS = ("average_graph_strength", "algebraic_connectivity", "laplacian_frobenius_change", "largest_laplacian_eigenvalue_share", "weighted_edge_density", "average_node_strength")
CONTROLS = ("vix", "realized_volatility", "drawdown", "average_correlation", "average_absolute_correlation")
ORTHOGONAL = {"average_graph_strength": "orthogonal_average_graph_strength", "algebraic_connectivity": "orthogonal_algebraic_connectivity", "laplacian_frobenius_change": "orthogonal_laplacian_frobenius_change", "largest_laplacian_eigenvalue_share": "orthogonal_largest_eigenvalue_share"}
SIGNALS = ("regime_indicator", "average_graph_strength", "algebraic_connectivity", "laplacian_frobenius_change", "largest_laplacian_eigenvalue_share", "connectivity_score", "transition_score", "spectral_score", "graph_components_equal_weight_score", "pca_first_eigenvalue_share", "pca_first_eigenvalue_change")
CONNECTIVITY = ("average_graph_strength", "algebraic_connectivity", "weighted_edge_density")


def add_component_scores(features: DataFrame, benchmarks: DataFrame | None = None, method: str = "expanding", min_history: int = 60) -> DataFrame:
    """features with z columns, block scores, and with benchmarks the orthogonal columns and their score."""
    _check(method, min_history)
    found = [c for c in COMPONENTS if c in features.columns]
    df = z_scores(features.withColumns({c: num(c) for c in found}), {f"z_{c}": c for c in found})
    z = lambda c: F.col(f"z_{c}") if c in found else F.lit(0.0)
    df = df.withColumns({
        "connectivity_score": sum((z(c) for c in CONNECTIVITY), F.lit(0.0)), "transition_score": z("laplacian_frobenius_change"), "spectral_score": z("largest_laplacian_eigenvalue_share"),
        "graph_components_equal_weight_score": row_mean([f"z_{c}" for c in found]) if found else F.lit(0.0),
    })
    return df if benchmarks is None else df.join(residualize(features, benchmarks, method, min_history), "date", "left")


def _check(method: str, min_history: int) -> None:
    if method not in ("expanding", "full_sample"):
        raise ValueError("unknown method of residuals: choose expanding or full_sample")
    if min_history <= 1:
        raise ValueError("min_history: two rows or more")


def _arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return f["y"].to_numpy(float), np.array([np.asarray(r, float) for r in f["x"]])


def _sums(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, sums): kernels.moment_sums of each group of (component, x, y), in pieces that are added up by Spark."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return f[list(keys)].head(1).assign(sums=[kernels.moment_sums(*_arrays(f))])

    kinds = ", ".join(f"{k} {long.schema[k].dataType.simpleString()}" for k in keys)
    return long.groupBy(*keys).applyInPandas(run, f"{kinds}, sums array<double>")


def _added(window: WindowSpec, width: int) -> Column:
    """Elementwise sum of the arrays of a window; zeros without a row."""
    return F.array(*[F.coalesce(F.sum(F.col("sums")[k]).over(window), F.lit(0.0)) for k in range(width)])


def _expanding(long: DataFrame, min_history: int, controls: int, kind: str) -> DataFrame:
    """(component, date, r): expanding residuals in blocks of dates, each with the moments of all blocks before it."""
    rows = blocked(long, ["component"], ["date"])
    width = 1 + (controls + 1) * (controls + 2)
    before = Window.partitionBy("component").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = _sums(rows, ["component", "_block"]).select("component", "_block", _added(before, width).alias("sums"))

    def run(f: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("date")
        earlier = np.asarray(carry["sums"].iloc[0], float)
        return pd.DataFrame({"component": f["component"], "date": f["date"], "r": kernels.expanding_residuals(*_arrays(f), min_history, earlier)})

    return rows.groupBy("component", "_block").cogroup(carried.groupBy("component", "_block")).applyInPandas(run, f"component string, date {kind}, r double")


def _full_sample(long: DataFrame, controls: int, kind: str) -> DataFrame:
    """(component, date, r): residuals of one fit on all complete rows, from the blocks' moments."""
    rows = blocked(long, ["component"], ["date"])
    width = 1 + (controls + 1) * (controls + 2)
    parts = _sums(rows, ["component", "_block"]).groupBy("component").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    fits = parts.select("component", F.udf(lambda sums: kernels.solve_moments(np.asarray(sums)), "array<double>")("sums").alias("beta"))  # one row a component
    known = F.col("y").isNotNull() & F.forall("x", lambda v: ~F.isnan(v))
    fitted = F.aggregate(F.zip_with("x", F.slice("beta", 2, controls), lambda a, b: a * b), F.col("beta")[0], lambda s, v: s + v)
    return rows.join(F.broadcast(fits), "component").select("component", "date", F.when(known, F.col("y") - fitted).alias("r"))


def residualize(features: DataFrame, benchmarks: DataFrame, method: str = "expanding", min_history: int = 60) -> DataFrame:
    """(date, orthogonal columns, orthogonal_graph_score): residuals of components on the benchmark controls."""
    _check(method, min_history)
    controls = [c for c in CONTROLS if c in benchmarks.columns]
    parts = [c for c in ORTHOGONAL if c in features.columns]
    if not controls or not parts:
        return features.select("date")
    both = features.select("date", *[num(c).alias(c) for c in parts]).join(benchmarks.select("date", F.array(*[F.coalesce(num(c), F.lit(float("nan"))) for c in controls]).alias("x")), "date")
    kind = features.schema["date"].dataType.simpleString()

    long = melt(both, ["date", "x"], parts, "component", "y")
    got = _expanding(long, min_history, len(controls), kind) if method == "expanding" else _full_sample(long, len(controls), kind)
    wide = got.groupBy("date").pivot("component", parts).agg(F.first(finite("r"), ignorenulls=True))
    wide = features.select("date").join(wide.select("date", *[F.col(c).alias(ORTHOGONAL[c]) for c in parts]), "date", "left")
    names = [ORTHOGONAL[c] for c in parts]
    return z_scores(wide, {f"_z{c}": c for c in names}).withColumn("orthogonal_graph_score", row_mean([f"_z{c}" for c in names])).drop(*[f"_z{c}" for c in names])


def overlay_signals(features: DataFrame, pca: DataFrame | None = None) -> DataFrame:
    """(date, the known signals): component scores are computed again without benchmarks."""
    df = add_component_scores(features)
    if pca is not None:
        df = df.join(pca.select("date", *[F.col(c).alias(f"{c}_pca" if c in df.columns else c) for c in pca.columns if c != "date"]), "date", "left")
    found = [c for c in SIGNALS if c in df.columns]
    if not found:
        raise ValueError("none of the known overlay signals is a column")
    return df.select("date", *[num(c).alias(c) for c in found])


def mean_z(df: DataFrame, out: str, columns: Sequence[str], by: Sequence[str] = (), over=None) -> DataFrame:
    """Adds the row mean of the columns' z scores (nulls as zero)."""
    z = {f"_z{k}": c for k, c in enumerate(columns)}
    return z_scores(df, z, by, over=over).withColumn(out, row_mean(list(z))).drop(*z)


def candidate_scores(features: DataFrame, pca: DataFrame | None = None) -> DataFrame:
    """(date, raw components, ri, block scores, pca and combined scores)."""
    found = [c for c in COMPONENTS if c in features.columns]
    df = features.select("date", *[num(c).alias(c) for c in found], *([num("regime_indicator").alias("ri")] if "regime_indicator" in features.columns else []))
    wide = [c for c in ("pca_first_eigenvalue_share", "pca_first_eigenvalue_change") if pca is not None and c in pca.columns]
    if pca is not None:
        df = df.join(pca.select("date", *[num(c).alias(c) for c in wide]), "date", "full_outer")
    blocks = {
        "graph_components_equal_weight_score": found, "excluding_algebraic_connectivity_score": [c for c in found if c != "algebraic_connectivity"], "transition_score": [c for c in found if c == "laplacian_frobenius_change"],
        "algebraic_connectivity_only": [c for c in found if c == "algebraic_connectivity"], "connectivity_block_with_algebraic_connectivity": [c for c in CONNECTIVITY if c in found],
        "connectivity_block_without_algebraic_connectivity": [c for c in CONNECTIVITY if c in found and c != "algebraic_connectivity"], "pca_score": wide,
    }
    for name, columns in blocks.items():
        if columns:
            df = mean_z(df, name, columns)
    combined = [c for c in ("graph_components_equal_weight_score", "transition_score", "pca_score") if c in df.columns]
    return mean_z(df, "pca_plus_graph_score", combined) if combined else df


def algebraic_diagnostics(features: DataFrame, benchmarks: DataFrame, targets: DataFrame, pca: DataFrame | None = None) -> DataFrame:
    """(diagnostic_type, variable, metric, value, n_obs): availability, summary, correlations, predictive power of algebraic connectivity."""
    spark, name = features.sparkSession, "algebraic_connectivity"
    schema = "diagnostic_type string, variable string, metric string, value double, n_obs double"
    if name not in features.columns:
        return spark.createDataFrame([("availability", name, "available", 0.0, 0.0)], schema)
    x = features.select("date", num(name).alias("x"))
    stats = x.agg(F.count("x").cast("double").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.percentile("x", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q"), F.max("x").alias("max"))
    rows = [("availability", "available", F.lit(1.0)), *(("summary", m, c) for m, c in (("mean", F.col("mean")), ("std", F.col("std")), ("min", F.col("min")), ("p25", F.col("q")[0]), ("median", F.col("q")[1]), ("p75", F.col("q")[2]), ("max", F.col("max"))))]
    out = stats.select(F.explode(F.array(*[F.struct(F.lit(t).alias("diagnostic_type"), F.lit(name).alias("variable"), F.lit(m).alias("metric"), c.cast("double").alias("value"), F.col("n").alias("n_obs")) for t, m, c in rows])).alias("r")).select("r.*")
    own = [c for c in ("regime_indicator", "average_graph_strength", "weighted_edge_density", "laplacian_frobenius_change", "largest_laplacian_eigenvalue_share") if c in features.columns]
    frames = [features.select("date", *[num(c).alias(c) for c in own])] if own else []
    if pca is not None and "pca_first_eigenvalue_share" in pca.columns:
        frames.append(pca.select("date", num("pca_first_eigenvalue_share").alias("pca_first_eigenvalue_share")))
    used = [c for c in CONTROLS if c in benchmarks.columns]
    if used:
        frames.append(benchmarks.select("date", *[num(c).alias(c) for c in used]))
    other = outer_join(*frames)
    columns = [c for c in other.columns if c != "date"]
    pairs = melt(other, ["date"], columns, "variable", "y").join(x, "date")
    got = spearman_frame(pairs, ["variable"]).where("n_obs > 0")
    for metric, c in (("pearson", "pearson_correlation"), ("spearman", "spearman_correlation")):
        out = out.unionAll(got.select(F.lit("correlation"), "variable", F.lit(metric), c, "n_obs"))
    names = [c for c in targets.columns if c != "date"]
    pairs = melt(targets, ["date"], names, "variable", "y").join(x, "date").where("x is not null and y is not null")
    pairs = average_ranks(pairs, ["variable"], {"rx": "x"})
    pos, neg = F.sum((F.col("y") == 1).cast("double")), F.sum((F.col("y") == 0).cast("double"))
    auc = F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("rx"))) - pos * (pos + 1) / 2, pos * neg)
    got = pairs.groupBy("variable").agg(correlation("x", "y").alias("c"), auc.alias("a"), F.count("*").cast("double").alias("n_obs"))
    binary = F.col("variable") == "stress_onset_label"
    return out.unionAll(got.select(F.lit("predictive"), "variable", F.when(binary, "auc").otherwise("pearson"), F.when(binary, F.col("a")).otherwise(F.col("c")), "n_obs"))


def algebraic_overlays(features: DataFrame, returns: DataFrame, bps: Sequence[float] = (0.0, 5.0, 10.0), **options) -> tuple[DataFrame, DataFrame]:
    scores = candidate_scores(features)
    wanted = [c for c in ("graph_components_equal_weight_score", "excluding_algebraic_connectivity_score", "algebraic_connectivity_only", "connectivity_block_with_algebraic_connectivity", "connectivity_block_without_algebraic_connectivity") if c in scores.columns]
    if not wanted:
        raise ValueError("none of the scores on algebraic connectivity is there")
    return evaluate_variants(returns, scores, wanted, ("daily",), bps, **options)
