import numpy as np
import pandas as pd
import pytest

from meshwind.functions import kernels as K
from meshwind.functions import scans
from meshwind.operators import components, graph, stress
from pyspark.sql import functions as F


def _values(seed, n=700, p=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) + 5.0
    v[rng.random((n, p)) < 0.15] = np.nan
    v[300:420, 1] = 2.0  # constant for longer than a window
    return v


def test_sliding_moments_equal_each_windows_own():
    v, window = _values(1), 40
    places = np.arange(5, 700)
    frame = pd.DataFrame(v)
    for some, m in K.sliding_moments(v, window, places):
        c = m.correlations()
        assert (m.rows == np.minimum(some + 1, window)).all()
        for at, place in list(enumerate(some))[::37]:
            w = frame.iloc[max(0, place - window + 1) : place + 1]
            want = w.corr(min_periods=2).to_numpy().copy()
            flat = w.std(ddof=0).to_numpy() < 1e-9
            want[flat], want[:, flat] = np.nan, np.nan
            assert np.allclose(c[at], want, atol=1e-9, equal_nan=True)


def test_moments_do_not_drift_over_a_long_series():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(30_000, 2)) * 1e-3 + 1e3
    last = None
    for some, m in K.sliding_moments(v, 60, np.arange(59, 30_000)):
        last = m.correlations()[-1, 0, 1]
    assert last == pytest.approx(np.corrcoef(v[-60:].T)[0, 1], abs=1e-8)


def _merged(a):
    """Greedy merging by its definition: all pairs of groups are compared after each merge."""
    e = a / a.sum()
    groups = {i: {i} for i in range(len(a))}
    share = e.sum(axis=1)
    while True:
        best = None
        for i in sorted(groups):
            for j in sorted(groups):
                between = sum(e[x, y] for x in groups[i] for y in groups[j])
                if i < j and between > 0:
                    gain = round(2 * (between - share[list(groups[i])].sum() * share[list(groups[j])].sum()), 12)
                    if best is None or gain > best[0]:
                        best = (gain, i, j)
        if best is None or best[0] <= 0:
            return sum(e[x, y] for g in groups.values() for x in g for y in g) - sum(share[list(g)].sum() ** 2 for g in groups.values())
        groups[best[1]] |= groups.pop(best[2])


def test_modularity_on_random_graphs():
    rng = np.random.default_rng(7)
    for k in range(300):
        p = int(rng.integers(3, 13 if k % 10 else 31))
        a = np.where(rng.random((p, p)) < rng.uniform(0.1, 0.9), rng.integers(1, 4, (p, p)) if k % 2 else rng.random((p, p)), 0.0)
        a = np.triu(a, 1) + np.triu(a, 1).T
        if a.sum() > 0:
            assert K.modularity(a) == pytest.approx(_merged(a), abs=1e-9)
    assert np.isnan(K.modularity(np.zeros((3, 3)))) and np.isnan(K.modularity(np.ones((1, 1))))


@pytest.mark.parametrize("block", [50_000, 30])
@pytest.mark.parametrize("method", ["expanding", "full_sample"])
def test_residuals_in_blocks_equal_the_definition(spark, monkeypatch, block, method):
    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 2)) * [30.0, 0.05] + [140.0, -0.1]
    x = np.c_[x, 2 * x[:, 0]]  # collinear
    y = x[:, 0] * 0.1 - x[:, 1] + rng.normal(size=100)
    y[[4, 50]] = np.nan
    dates = pd.date_range("2020-01-01", periods=100).date
    none = lambda v: None if np.isnan(v) else float(v)
    features = spark.createDataFrame([(d, none(v)) for d, v in zip(dates, y)], "date date, algebraic_connectivity double")
    benchmarks = spark.createDataFrame([(d, *map(float, r)) for d, r in zip(dates, x)], "date date, vix double, drawdown double, realized_volatility double")
    got = {r["date"]: r["orthogonal_algebraic_connectivity"] for r in components.residualize(features, benchmarks, method, 20).collect()}
    full = [k for k in range(100) if np.isfinite(y[k])]
    for place, k in enumerate(full):
        past = full[:place] if method == "expanding" else full
        design = np.c_[np.ones(len(past)), x[past, :2]]
        want = y[k] - np.r_[1.0, x[k, :2]] @ np.linalg.lstsq(design, y[past], rcond=None)[0] if place >= 20 or method == "full_sample" else None
        assert got[dates[k]] == (want if want is None else pytest.approx(want, abs=1e-6))
    assert got[dates[4]] is None


def test_windows_in_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(4)
    dates = pd.date_range("2020-01-01", periods=220).date
    rows = [(d, f"a{j}", float(v)) for d, r in zip(dates, rng.normal(size=(220, 4)) + rng.normal(size=(220, 1))) for j, v in enumerate(r) if rng.random() > 0.05]
    df = spark.createDataFrame(rows, "date date, asset string, value double")
    wide = df.toPandas().pivot(index="date", columns="asset", values="value")
    got = {r["date"]: r for r in stress.correlation_scores(df, 30).collect()}
    pca = {r["date"]: r for r in graph.rolling_pca_features(df, 30).collect()}
    assert sorted(got) == list(wide.index[29:])
    for d in list(got)[::17]:
        w = wide.loc[:d].iloc[-30:]
        c = w.corr(min_periods=2).to_numpy()[np.triu_indices(4, 1)]
        assert got[d]["average_correlation"] == pytest.approx(c.mean()) and got[d]["average_absolute_correlation"] == pytest.approx(np.abs(c).mean())
        if (w.notna().sum() >= 24).all():
            assert pca[d]["pca_first_eigenvalue"] == pytest.approx(np.linalg.eigvalsh(w.corr().to_numpy())[-1])


def _windows(seed, n=60, p=8, mix=0.4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n + 80, p)) + mix * np.repeat(rng.normal(size=(n + 80, 2)), p // 2, axis=1)
    return np.stack([np.corrcoef(x[k : k + 80].T) for k in range(n)])


def test_components_are_solved_apart():
    s = _windows(1)
    for alpha in (0.05, 0.25, 0.6):
        w, theta, done, sweeps = K.graphical_lasso(s, alpha, tol=1e-10, inner_tol=1e-12)
        whole = K._descend(s, alpha, 1000, 1e-10, 1e-12, "cd", None)
        assert done.all() and np.allclose(theta, whole[1], atol=1e-7) and np.allclose(np.linalg.inv(theta), w, atol=1e-7)
        off = ~np.eye(8, dtype=bool)
        assert (np.abs((w - s)[:, off]) <= alpha + 1e-7).all()
    parts = K.connected(np.abs(s) * (1 - np.eye(8)) > 0.25)
    assert (parts > 0).any(axis=1).any()  # some of the graphs do fall apart
    for a, label in list(zip(s, parts))[::9]:
        seen = {0}
        while more := {int(j) for i in seen for j in np.flatnonzero(np.abs(a[i]) > 0.25)} - seen:
            seen |= more
        assert set(np.flatnonzero(label == 0)) == seen
    alone = K.graphical_lasso(s, 0.99)
    assert (alone[3] == 1).all() and np.allclose(alone[1], np.eye(8))


@pytest.mark.parametrize("mode", ["cd", "lars"])
def test_warm_starts_change_sweeps_only(mode):
    s, alphas = _windows(2, mix=1.0), (0.3, 0.05, 0.1)
    total = {True: 0, False: 0}
    for alpha, theta, done, sweeps in K.fit_windows(s, alphas, 1000, 1e-8, 1e-10, mode):
        cold = K.graphical_lasso(s, alpha, tol=1e-8, inner_tol=1e-10, mode=mode)
        assert done.all() and np.allclose(theta, cold[1], atol=1e-5)
        total[True] += sweeps.sum()
        total[False] += cold[3].sum()
    assert total[True] < total[False]


def test_precision_is_diagonal_where_alpha_exceeds_every_correlation(spark):
    dates = pd.date_range("2020-01-01", periods=40).date
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(d, f"a{j}", float(v)) for d in dates for j, v in enumerate(rng.normal(size=3))], "date date, asset string, value double")
    rows = graph.rolling_graph_features(df, 20, 0.95).collect()
    assert len(rows) == 21 and all(r["number_of_edges"] == 0 and r["graph_lasso_n_iter"] == 1 and r["graph_lasso_converged"] for r in rows)
