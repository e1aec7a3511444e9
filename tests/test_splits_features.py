import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifline.operators import scaling, splits
from motifline.plans.blocks import with_position


def greedy(sizes, k):
    k = min(k, len(sizes))
    loads, out = [0] * k, {}
    for name, size in sorted(sorted(sizes.items(), reverse=True), key=lambda s: -s[1]):
        f = loads.index(min(loads))
        loads[f] += size
        out[name] = f
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_group_kfold_is_greedy(spark, seed):
    rnd = random.Random(seed)
    sizes = {
        "many": {f"g{i:03}": rnd.choice([1, 2, 2, 3, 40]) for i in range(80)},
        "few": {"x": 5, "y": 5, "z": 2},
        "hot": {"big": 500, **{f"s{i}": 1 for i in range(60)}},
    }
    rows = [(d, g) for d, groups in sizes.items() for g, n in groups.items() for _ in range(n)]
    folds = splits.group_kfold(spark.createDataFrame(rows, "d string, g string"), "g", ["d"]).collect()
    for d, groups in sizes.items():
        assert {r.g: r.fold for r in folds if r.d == d} == greedy(groups, 5)
    assert {r.folds for r in folds if r.d == "few"} == {3}


@pytest.mark.parametrize("chunk", [2, 128])
def test_many_sizes_are_walked_in_columns(spark, monkeypatch, chunk):
    monkeypatch.setattr(splits, "CHUNK", chunk)
    rnd = random.Random(chunk)
    sizes = {f"g{i:04}": rnd.choice([rnd.randint(1, 400), 7, 8]) for i in range(500)}
    rows = spark.createDataFrame(list(sizes.items()), "g string, n int").selectExpr("'d' as d", "g", "explode(sequence(1, n))").drop("col")
    folds = splits.group_kfold(rows, "g", ["d"], 7)
    assert {r.g: r.fold for r in folds.collect()} == greedy(sizes, 7)
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("k", [2, 6])
def test_folds_share_one_sort(spark, k, monkeypatch):
    from motifline.plans import blocks

    sorts = []
    monkeypatch.setattr(blocks, "_sorted_parts", lambda *a, f=blocks._sorted_parts, **b: sorts.append(a) or f(*a, **b))
    df = spark.range(200).selectExpr("'d' as d", "id % 9 as g", "id as t", "1 as fold", "2 as folds")
    folds = splits.group_kfold(df, "g", ["d"], k)
    monkeypatch.setattr(blocks, "stage", lambda x, f=blocks.stage: f(x))
    sorts.clear()
    got = splits.fold_roles(df.drop("fold", "folds"), folds, "g", ["d"], ["t"])
    assert len(sorts) == 1 and got.count() == 200 * k


def test_one_group_is_refused(spark):
    with pytest.raises(Exception, match="at least 2 distinct values"):
        splits.group_kfold(spark.createDataFrame([("d", "g")], "d string, g string"), "g", ["d"]).collect()


def test_fold_roles(spark):
    rows = [("d", f"f{i % 4}", i) for i in range(43)]
    df = spark.createDataFrame(rows, "d string, g string, t int")
    folds = splits.group_kfold(df, "g", ["d"], k=3)
    got = splits.fold_roles(df, folds, "g", ["d"], ["t"]).collect()
    assert len(got) == 43 * 3
    test_of = {r.g: r.fold for r in folds.collect()}
    for f in range(3):
        rest = [t for _, g, t in rows if test_of[g] != f]
        cut = len(rest) - int(len(rest) * 0.2)
        for role, want in (("train", rest[:cut]), ("val", rest[cut:]), ("test", [t for _, g, t in rows if test_of[g] == f])):
            mine = sorted((r.pos, r.t, r.n) for r in got if r.fold == f and r.role == role)
            assert [r[1] for r in mine] == want
            assert [r[0] for r in mine] == list(range(len(want)))
            assert {r[2] for r in mine} == {len(want)}


def test_chrono_split_matches_int_of_float(spark):
    df = spark.range(3000).selectExpr("id as i", "cast(sqrt(id) as int) as k")
    got = splits.chrono_split(with_position(df, ["k"], ["i"])).groupBy("k", "role").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("pos").alias("p")).collect()
    sizes = {(r.k, r.role): r.c for r in got}
    assert all(r.c == r.n == r.p + 1 for r in got)
    for k in {r.k for r in got}:
        n = sum(sizes.get((k, role), 0) for role in ("train", "val", "test"))
        assert sizes.get((k, "train"), 0) == int(n * 0.6) and sizes.get((k, "val"), 0) == int(n * 0.2)


def frame(spark, n=500, m=4, seed=5):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, m)) @ rnd.normal(size=(m, m)) + 3
    x[:, -1] = 7.0
    cols = [f"c{i}" for i in range(m)]
    rows = [("s", i, *map(float, r)) for i, r in enumerate(x)]
    schema = "k string, pos long, " + ", ".join(f"{c} double" for c in cols)
    return x, cols, spark.createDataFrame(rows, schema)


def test_scaling_of_constant_and_outside_values(spark):
    x, cols, df = frame(spark)
    for method in ("minmax", "standard"):
        train = df.where("pos < 300")
        got = scaling.scale_apply(df, scaling.scale_fit(train, ["k"], cols, method), ["k"], cols).orderBy("pos").select(cols).toPandas().to_numpy()
        t = x[:300]
        shift, span = (t.min(0), np.ptp(t, 0)) if method == "minmax" else (t.mean(0), t.std(0))
        span[-1] = 1.0
        np.testing.assert_allclose(got, (x - shift) / span, atol=1e-9)
    with pytest.raises(ValueError):
        scaling.scale_fit(df, ["k"], cols, "robust")


@pytest.mark.parametrize("m,k", [(4, 1), (4, 3), (20, 2)])
def test_pca_against_numpy(spark, m, k):
    x, cols, df = frame(spark, m=m)
    fit = scaling.pca_fit(df, ["k"], cols, k)
    got = scaling.pca_apply(df, fit, ["k"], cols, k).orderBy("pos").select(*[f"pc_{i + 1}" for i in range(k)]).toPandas().to_numpy()
    d = x - x.mean(0)
    axes = np.linalg.svd(d, full_matrices=False)[2][:k]
    axes *= np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]
    np.testing.assert_allclose(got, d @ axes.T, atol=1e-7)
