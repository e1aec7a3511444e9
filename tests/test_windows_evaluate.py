import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifline.operators import evaluate as E
from motifline.operators import windows
from motifline.operators.splits import chrono_split
from motifline.plans import experiments as X

K = ["k"]


def numbered(spark, series):
    rows = [(k, i, float(v), len(x), int(v > 1.5)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, pos long, x double, n long, label int").repartition(5)


@pytest.fixture(scope="module")
def series():
    rnd = np.random.default_rng(3)
    return {"a": np.sin(np.arange(2500) / 9) + rnd.normal(0, 0.3, 2500), "b": rnd.normal(size=130), "short": rnd.normal(size=20)}


def errors(train, x, length, k):
    w = np.lib.stride_tricks.sliding_window_view(train, length)
    mean = w.mean(0)
    axes = np.linalg.svd(w - mean, full_matrices=False)[2][:k]
    d = np.lib.stride_tricks.sliding_window_view(x, length) - mean
    return ((d - d @ axes.T @ axes) ** 2).mean(1)


def test_sliding_windows(spark, series):
    got = windows.sliding_windows(numbered(spark, series), K, 30, stride=7, block_rows=300).collect()
    for key, x in series.items():
        mine = {r.start: r.window for r in got if r.k == key}
        assert sorted(mine) == list(range(0, len(x) - 29, 7))
        assert all(np.allclose(v, x[s : s + 30]) for s, v in mine.items())


@pytest.mark.parametrize("length,k", [(2, 1), (30, 3), (100, 2)])
def test_reconstruction_error(spark, series, length, k):
    df = numbered(spark, series)
    fit = windows.reconstruction_fit(df, K, length, k, block_rows=1000)
    got = windows.reconstruction_error(df, fit, K, length, block_rows=1000).collect()
    for key, x in series.items():
        mine = [r.score for r in sorted(got, key=lambda r: r.start) if r.k == key]
        want = errors(x, x, length, k) if len(x) >= length else []
        np.testing.assert_allclose(mine, want, atol=1e-8)


@pytest.mark.parametrize("n,length", [(2, 2), (9, 5), (9, 9), (40, 13), (400, 100), (120, 119), (50, 1)])
def test_products_of_all_windows_from_lag_sums(n, length):
    x = np.random.default_rng(n).normal(size=n)
    w = np.lib.stride_tricks.sliding_window_view(x, length)
    lags = windows.lag_products(x, n, length)
    got = windows.window_products(lags, x[: length - 1], x[n - length + 1 :])
    np.testing.assert_allclose(got, w.T @ w, rtol=0, atol=1e-9)
    split = [windows.lag_products(x[i:], min(7, n - i), length) for i in range(0, n, 7)]
    np.testing.assert_allclose(sum(split), lags, atol=1e-9)


def test_fit_of_long_windows_equals_their_covariance(spark):
    """Length 1000 over 30,000 rows: products of all windows would take a thousand times the values."""
    rnd = np.random.default_rng(6)
    x = np.sin(np.arange(30_000) / 40) + rnd.normal(0, 0.2, 30_000)
    df = spark.createDataFrame([("a", i, float(v), len(x)) for i, v in enumerate(x)], "k string, pos long, x double, n long").repartition(3)
    start = time.perf_counter()
    fit = windows.reconstruction_fit(df, K, 1000, 2, block_rows=10_000).first()
    took = time.perf_counter() - start
    w = np.lib.stride_tricks.sliding_window_view(x, 1000)
    mean = w.mean(0)
    np.testing.assert_allclose(fit.means, mean, atol=1e-9)
    axes, cov = np.array(fit.axes), (w.T @ w) / len(w) - np.outer(mean, mean)
    values = np.linalg.eigvalsh(cov)[::-1][:2]
    np.testing.assert_allclose(np.einsum("ij,jk,ik->i", axes, cov, axes), values, rtol=1e-9)
    assert took < 60


def test_percentile_and_flags(spark, series):
    df = numbered(spark, series).withColumnRenamed("x", "score")
    for p in (0.0, 0.5, 0.95, 1.0):
        limits = windows.percentile_threshold(df, K, p)
        got = {r.k: r.threshold for r in limits.collect()}
        assert got == pytest.approx({k: float(np.percentile(x, 100 * p)) for k, x in series.items()})
    flagged = windows.flag_above(df, limits, K)
    assert flagged.where("pred = 1").count() == 0


@pytest.mark.parametrize("band,cuts", [(1, 2), (3, 4), (20, 8)])
def test_percentile_of_narrowed_ranges(spark, monkeypatch, band, cuts):
    monkeypatch.setattr(windows, "BAND_ROWS", band)
    monkeypatch.setattr(windows, "CUTS", cuts)
    rnd = np.random.default_rng(band)
    made = {"ties": rnd.integers(0, 4, 300).astype(float), "same": np.full(90, 2.5), "one": np.array([-3.0]), "wide": rnd.normal(size=400) ** 9 * 1e200, "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in made.items() for v in x] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, score double").repartition(4)
    for p in (0.0, 0.31, 0.95, 1.0):
        got = {r.k: r.threshold for r in windows.percentile_threshold(df, K, p).collect()}
        assert got == pytest.approx({k: float(np.percentile(x, 100 * p)) for k, x in made.items()})


def test_percentile_sorts_no_scores(spark, series):
    df = numbered(spark, series).withColumnRenamed("x", "score")
    plan = windows.percentile_threshold(df, K)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan


def test_detect_windows_labels_the_last_row(spark, series):
    roles = chrono_split(numbered(spark, series))
    got = X.detect_windows(roles, K, 30, k=2, p=0.9, block_rows=1000).where("k = 'a'").orderBy("end").collect()
    x = series["a"]
    a, b = int(len(x) * 0.6), int(len(x) * 0.6) + int(len(x) * 0.2)
    scores, limit = errors(x[:a], x[b:], 30, 2), np.percentile(errors(x[:a], x[:a], 30, 2), 90)
    assert [r.pred for r in got] == (scores > limit).astype(int).tolist()
    assert [r.label for r in got] == (x[b:][29:] > 1.5).astype(int).tolist()


def pairs(seed=4):
    rnd = random.Random(seed)
    return [("s", i, int(rnd.random() < 0.3), int(rnd.random() < 0.4), int(rnd.random() < 0.5), rnd.randrange(6) / 5) for i in range(300)]


def test_metrics_and_zero_denominators(spark):
    rows = pairs() + [("none", 0, 0, 0, 0, 0.0), ("none", 1, 0, 0, 1, 0.0)]
    df = spark.createDataFrame(rows, "k string, i int, label int, pred int, other int, score double")
    got = {r.k: r for r in E.binary_metrics(df, K).collect()}
    assert (got["none"].accuracy, got["none"].precision, got["none"].recall, got["none"].f1) == (1.0, 0.0, 0.0, 0.0)
    tp = sum(r[2] & r[3] for r in pairs())
    precision, recall = tp / sum(r[3] for r in pairs()), tp / sum(r[2] for r in pairs())
    assert got["s"].f1 == pytest.approx(2 * precision * recall / (precision + recall))
    cells = {(r.label, r.pred): r.cnt for r in E.confusion_matrix(df.where("k = 'none'"), K).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_roc_and_auc(spark):
    rows = pairs()
    df = spark.createDataFrame(rows, "k string, i int, label int, pred int, other int, score double")
    points = E.roc_points(df, K, "score")
    got = points.orderBy(F.desc_nulls_first("threshold")).collect()
    pos, neg = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    want = [(None, 0.0, 0.0)]
    for t in sorted({r[5] for r in rows}, reverse=True):
        hit = [r for r in rows if r[5] >= t]
        want.append((t, sum(1 - r[2] for r in hit) / neg, sum(r[2] for r in hit) / pos))
    assert [(r.threshold, r.fpr, r.tpr) for r in got] == want
    wins = sum((a[5] > b[5]) + 0.5 * (a[5] == b[5]) for a in rows for b in rows if a[2] and not b[2])
    assert E.auc(points, K).first().auc == pytest.approx(wins / pos / neg)


def test_mcnemar(spark):
    df = spark.createDataFrame(pairs(), "k string, i int, label int, pred int, other int, score double")
    row = E.mcnemar_test(E.mcnemar_table(df, K, a="pred", b="other")).first()
    b = sum(r[3] == r[2] != r[4] for r in pairs())
    c = sum(r[4] == r[2] != r[3] for r in pairs())
    stat = (abs(b - c) - 1) ** 2 / (b + c)
    assert (row.a_only, row.b_only) == (b, c)
    assert row.statistic == pytest.approx(stat)
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(stat / 2)), abs=1e-6)
    same = E.mcnemar_test(E.mcnemar_table(df, K, a="pred", b="pred")).first()
    assert same.statistic is None and same.p_value is None


def test_counts_beyond_a_bigint_product(spark):
    from motifline.operators import evaluate as E

    big = spark.createDataFrame([("m", 5_000_000_000, 1)], "k string, a_only long, b_only long")
    row = E.mcnemar_test(big).first()
    assert abs(row.statistic / (4_999_999_998.0**2 / 5_000_000_001) - 1) < 1e-12 and row.significant
    points = spark.createDataFrame(
        [("m", 0.5, 5_000_000_000, 0, 5_000_000_000, 0), ("m", 0.1, 0, 4_000_000_000, 5_000_000_000, 4_000_000_000)],
        "k string, threshold double, pos long, neg long, tp long, fp long",
    )
    assert abs(E.auc(points, ["k"]).first().auc - 1.0) < 1e-12


def test_windows_of_large_values_fit_like_shifted_ones(spark):
    import numpy as np

    from motifline.operators import windows as W

    rnd = np.random.default_rng(5)
    x = rnd.normal(size=400).cumsum() * 0.1 + rnd.normal(size=400)
    rows = [(k, i, 400, float(v + shift)) for k, shift in (("low", 0.0), ("high", 1e8)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, pos long, n long, x double")
    fit = {r.k: r for r in W.reconstruction_fit(df, ["k"], 4).collect()}
    assert np.allclose(fit["low"].axes, fit["high"].axes, atol=1e-5) and np.allclose(np.array(fit["high"].means) - 1e8, fit["low"].means, atol=1e-6)
    assert W.sliding_windows(df, ["k"], 380, block_rows=50).count() == 2 * 21
