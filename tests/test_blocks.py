import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motifline.plans import blocks
from motifline.plans.blocks import attach, halo, in_block, running_totals, with_position


def skewed(spark, n=4000, seed=1):
    """One key holds most rows, a third of all share one time and some rows are copies."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.8 else f"k{rnd.randrange(30)}"
        rows.append((key, 7 if rnd.random() < 0.3 else rnd.randrange(1000), i, rnd.randrange(5)))
    rows += [("hot", 7, -1, 0)] * 500
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(7)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_positions_match_sorting(spark, parts):
    rows, df = skewed(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = with_position(df, ["k"], ["t", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:3] for r in rows if r[0] == key)
        expected += [(key, *r, i, len(mine)) for i, r in enumerate(mine)]
    assert sorted((r.k, r.t, r.id, r.pos, r.n) for r in got) == sorted(expected)


def test_hot_key_is_sorted_by_several_tasks(spark):
    _, df = skewed(spark)
    parts = blocks._sorted_parts(df, ["k"], ["t", "id"]).where("k = 'hot'").groupBy("_part").count().collect()
    assert len(parts) >= 3
    assert max(r["count"] for r in parts) < 0.5 * sum(r["count"] for r in parts)


def test_many_short_keys_are_numbered_without_range_sort_or_join(spark):
    df = spark.range(2000).selectExpr("id % 300 as k", "hash(id) % 9 as t", "id as x")
    got = with_position(df, ["k"], ["t"], keep=["x"], many=True)
    plan = got.groupBy("k", F.expr("pos div 5")).agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Join" not in plan
    # What is grouped by key and position shares the shuffle.
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(got.collect()) == sorted(with_position(df, ["k"], ["t"], keep=["x"]).collect())


@pytest.mark.parametrize("most_rows", [20, 65_536])
def test_long_keys_among_many_go_the_way_of_the_range_sort(spark, monkeypatch, most_rows):
    rows, df = skewed(spark)
    sorts = []
    monkeypatch.setattr(blocks, "_sorted_parts", lambda *a, f=blocks._sorted_parts, **b: sorts.append(a[0]) or f(*a, **b))
    got = with_position(df, ["k"], [F.expr("nullif(t, 7)"), F.desc("id")], many=True, most_rows=most_rows)
    sizes = {key: sum(r[0] == key for r in rows) for key in {r[0] for r in rows}}
    long = {key for key, size in sizes.items() if size > most_rows}
    assert {r.k for found in sorts for r in found.select("k").distinct().collect()} == long
    expected = with_position(df, ["k"], [F.expr("nullif(t, 7)"), F.desc("id")])
    assert got.columns == expected.columns == ["k", "t", "id", "v", "pos", "n"]
    assert sorted(got.collect()) == sorted(expected.collect())


def test_null_among_many_keys_fails(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, t int")
    with pytest.raises(Exception, match="null in key column k"):
        with_position(df, ["k"], ["t"], many=True).collect()
    with pytest.raises(ValueError):
        with_position(df, [], ["t"], many=True)
    assert with_position(df.where("k = 'b'"), ["k"], ["t"], many=True).collect() == []


def test_null_key_fails(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, t int")
    with pytest.raises(Exception, match="null in key column k"):
        with_position(df, ["k"], ["t"]).collect()
    with pytest.raises(ValueError):
        with_position(df, [], ["t"])


def test_running_totals(spark):
    rows, df = skewed(spark)
    got = running_totals(df.distinct(), ["k"], [F.desc("t"), "id"], {"total": "v"}).collect()
    for key in {r[0] for r in rows}:
        total, expected = 0, {}
        for r in sorted({r for r in rows if r[0] == key}, key=lambda r: (-r[1], r[2])):
            total += r[3]
            expected[r[2]] = total
        assert {r.id: r.total for r in got if r.k == key} == expected


def test_halo_windows_equal_plain_windows(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id div 3 as pos", "hash(id) as v")
    plain = Window.partitionBy("k").orderBy("pos")

    def windows(w):
        return [
            F.lag("v", 2).over(w).alias("back"),
            F.lead("v", 3).over(w).alias("ahead"),
            F.sum("v").over(w.rowsBetween(-2, 3)).alias("total"),
        ]

    expected = df.select("k", "pos", *windows(plain))
    got = halo(df, "pos", 2, 3, 40).select("k", "pos", "_own", *windows(in_block(["k"], "pos"))).where("_own").drop("_own")
    assert sorted(got.collect()) == sorted(expected.collect())
    with pytest.raises(ValueError):
        halo(df, "pos", 2, 5, 40)


def test_salted_attach_equals_broadcast(spark, monkeypatch):
    _, df = skewed(spark)
    stats = df.groupBy("k").agg(F.max("v").alias("top"))
    fast = attach(df, stats, ["k"], F.expr("id % 16"))
    monkeypatch.setattr(blocks, "if_small", lambda t, limit=0: (blocks.stage(t), False))
    salted = attach(df, stats, ["k"], F.expr("id % 16"))
    assert sorted(fast.collect()) == sorted(salted.collect())
    assert salted.count() == df.count()


def test_tables_are_measured(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0], [[1.0], [2.0, 3.0]]), (None, None, None)], "s string, a array<double>, b array<array<double>>")
    assert blocks._measured_bytes(df) >= 2 * 48 + 2 + 16 + 24 - 16
    assert blocks._measured_bytes(df.where("false")) == 0
    assert blocks.if_small(df, 10)[1] is False and blocks.if_small(df)[1] is True


def test_shared_folder_needs_a_setting_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "yarn", "app"

        def getCheckpointDir(self):
            return None

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value

    class Session:
        sparkContext = Context()

    session = Session()
    session.conf = Conf(None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        blocks.shared_folder(session)
    session.conf = Conf("hdfs:///shared/")
    assert blocks.shared_folder(session) == "hdfs:///shared/motifline/app"
