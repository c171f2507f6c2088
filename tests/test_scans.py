import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwind.functions import quantiles, scans


def _frame(spark, n, keys=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(None if k == 0 else f"k{k}", int(d), None if rng.random() < 0.2 else float(rng.integers(-4, 5))) for k in range(keys) for d in rng.permutation(n)]
    return rows, spark.createDataFrame(rows, "k string, date long, x double")


@pytest.mark.parametrize("block", [50_000, 7])
@pytest.mark.parametrize("strict", [False, True])
def test_running_equals_loops(spark, monkeypatch, block, strict):
    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rows, df = _frame(spark, 60)
    x = F.col("x")
    kinds = {"sum": x, "product": 1 + x / 10, "max": x, "min": x, "count": x, "last": x, "lag": x}
    got = {(r["k"], r["date"]): r for r in scans.unblocked(scans.running(df, ["k"], {f"r_{k}": (k, v) for k, v in kinds.items()}, strict=strict)).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        seen = []
        for _, d, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            r, before = got[k, d], list(seen)
            seen.append(v)
            known = [y for y in (before if strict else seen) if y is not None]
            assert r["r_count"] == len(known)
            assert r["r_lag"] == (before[-1] if before else None)
            want = {"sum": sum(known), "product": np.prod([1 + y / 10 for y in known]), "max": max(known), "min": min(known), "last": known[-1]} if known else dict.fromkeys(("sum", "product", "max", "min", "last"))
            assert {c: r[f"r_{c}"] for c in want} == pytest.approx(want)


@pytest.mark.parametrize("block", [50_000, 6])
def test_numbers_and_ranks(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rows, df = _frame(spark, 50, 3, 4)
    got = scans.numbered(df, ["k"], ["x"], "n").collect()
    for k in {r[0] for r in rows}:
        own = sorted((r["n"], r["x"]) for r in got if r["k"] == k)
        assert [n for n, _ in own] == list(range(50))
        xs = [-np.inf if x is None else x for _, x in own]
        assert xs == sorted(xs)
    full = df.where("x is not null")
    ranked = scans.average_ranks(full, ["k"], {"rx": "x", "rd": "date"}).toPandas()
    want = ranked.groupby("k", dropna=False)[["x", "date"]].rank()
    assert len(ranked) == full.count()
    assert np.allclose(ranked[["rx", "rd"]], want)


def test_halo_rows_are_whole(spark):
    df = spark.range(100).select(F.col("id").alias("date"))
    rows = scans.with_halo(df, [], 9, 4, size=16).collect()
    assert sorted(r["date"] for r in rows if r["own"]) == list(range(100))
    for r in rows:
        if r["own"]:
            assert {x["date"] for x in rows if x["part"] == r["part"]} >= set(range(max(0, r["date"] - 9), min(100, r["date"] + 5)))
    means = scans.trailing_means(df.withColumn("x", F.col("date") * 1.0), [], "x", {"m": 3}).toPandas().sort_values("date")
    assert np.allclose(means["m"], means["x"].rolling(3, min_periods=1).mean())


def test_wavelet_matrix_against_sorting():
    rng = np.random.default_rng(9)
    for top in (1, 2, 9, 500):
        values = rng.integers(0, top, 200)
        matrix = quantiles.WaveletMatrix(values)
        prefix = rng.integers(1, 201, 300)
        k = (rng.random(300) * prefix).astype(np.int64)
        assert matrix.smallest(prefix, k).tolist() == [sorted(values[:p])[i] for p, i in zip(prefix, k)]
        bound = rng.integers(0, top + 3, 300)
        assert matrix.below(prefix, bound).tolist() == [int((values[:p] < b).sum()) for p, b in zip(prefix, bound)]


@pytest.mark.parametrize("group", [1 << 17, 24])
@pytest.mark.parametrize("by", [["k"], []])
def test_expanding_quantiles_equal_definition(spark, monkeypatch, group, by):
    monkeypatch.setattr(quantiles, "GROUP_ROWS", group)
    monkeypatch.setattr(scans, "BLOCK_ROWS", 40)
    rows, df = _frame(spark, 90, 3 if by else 1, 5)
    levels = [0.0, 0.6, 0.85, 1.0]
    got = {(r["k"] if by else None, r["date"]): r for r in quantiles.expanding_quantiles(df, by, "x", levels).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        seen = []
        for _, d, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            r = got[k, d]
            if v is None:
                assert r["q"] is None and r["earlier"] is None
                continue
            assert r["earlier"] == len(seen)
            assert (r["q"] is None) == (not seen)
            if seen:
                assert r["q"] == pytest.approx(np.quantile(seen, levels).tolist())
            seen.append(v)


def test_empty_frames(spark):
    df = spark.createDataFrame([], "k string, date long, x double")
    assert scans.running(df, ["k"], {"s": ("sum", F.col("x"))}).count() == 0
    assert scans.numbered(df, [], ["date"], "n").count() == 0
    assert quantiles.expanding_quantiles(df, ["k"], "x", [0.5]).count() == 0


def _fold(raw, days):
    """The rule row by row: a value stands until another comes more than ``days`` rows after the last accepted change."""
    out, held, since = [], raw[0], None
    for k, value in enumerate(raw):
        if value != held and (since is None or k - since > days):
            held, since = value, k
        out.append(held)
    return out


@pytest.mark.parametrize("days", [0, 1, 5])
@pytest.mark.parametrize("block", [50_000, 11])
def test_cooldown_equals_fold(spark, monkeypatch, days, block):
    from meshwind.operators.overlay import cooled

    monkeypatch.setattr(scans, "BLOCK_ROWS", block)
    rng = np.random.default_rng(days)
    series = {k: rng.choice([0.5, 0.7, 1.0], 80, p=p).tolist() for k, p in ((None, (0.3, 0.3, 0.4)), ("calm", (0.02, 0.02, 0.96)), ("one", (0, 0, 1)))}
    df = spark.createDataFrame([(k, d, v) for k, vs in series.items() for d, v in enumerate(vs)], "k string, date int, raw double")
    got = {(r["k"], r["date"]): r["raw"] for r in cooled(df, ["k"], days).collect()}
    assert got == {(k, d): v for k, vs in series.items() for d, v in enumerate(_fold(vs, days))}
    alone = {r["date"]: r["raw"] for r in cooled(df.where("k = 'calm'").drop("k"), [], days).collect()}
    assert alone == dict(enumerate(_fold(series["calm"], days)))


def test_no_window_sees_a_whole_series(spark, monkeypatch):
    """With several blocks, windows over rows are partitioned by block; only carries, a row a block, go in one piece."""
    from meshwind.operators import overlay, stress

    monkeypatch.setattr(scans, "BLOCK_ROWS", 40)
    dates = spark.range(200).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"), F.rand(3).alias("x"))
    frames = [
        stress.market_drawdown(dates.select("date", (1 + F.col("x")).alias("value"))), stress.stress_onsets(dates.select("date", (F.col("x") > 0.8).cast("int").alias("systemic_stress_label"))),
        overlay.performance(dates.select("date", (F.col("x") - 0.5).alias("ret"))), overlay.exposure(dates.withColumnRenamed("x", "score"), variant="hysteresis"),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows
        for line in windows:
            assert "_block" in line or "_t" in line, line
