"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from motifline.catalog import queries as Q
from motifline.operators import automaton as A
from motifline.operators import symbols
from motifline.plans import blocks
from motifline.plans import experiments as X


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def roles(spark, sf):
    return Q.event_roles(spark, sf)


def test_scan_reads_only_what_is_used(spark, sf):
    plan = physical(Q.event_rows(spark, sf))
    assert re.search(r"ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>", plan)
    csv_like = physical(Q.csv_rows(spark, sf).where("user_id % 2 = 0 and value > 10").select("event_id"))
    assert "PushedFilters: [IsNotNull(user_id), IsNotNull(value), GreaterThan(value,10.0)]" in csv_like


def test_rows_never_meet_in_one_task(spark, roles):
    rk = ["event_type", "role"]
    segments = symbols.paa(roles, rk, 5)
    steps = X.steps_of(roles, rk)
    counts = A.count_steps(steps, rk)
    for df in (roles, segments, steps, counts, symbols.sax_letters(segments, rk, 4)):
        plan = physical(df)
        for banned in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert banned not in plan
        for window in re.findall(r"Window .*", plan):
            assert "_block" in window


@pytest.mark.parametrize("series", [Q.supplier_series, Q.short_series])
def test_series_of_many_keys_are_shuffled_once(spark, sf, series):
    """Before, the rows were sorted by range, written, and joined with the spans of the keys: by a shuffle, where keys are many."""
    df = series(spark, sf)
    key = df.columns[0]
    used = df if "role" in df.columns else df.withColumn("role", F.lit("train"))
    plan = physical(symbols.paa(used, [key, "role"], 5))
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_small_models_keep_out_loops_and_products(spark, roles):
    counts = X.count_roles(roles, ["event_type"], X.Params(alphabet_size=6, window=4))
    edges = blocks.stage(A.fit_automaton(counts.where("role = 'train'"), ["event_type"]))
    plan = physical(A.score_grams(counts.where("role = 'test'"), edges, ["event_type"]))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def joined_rows(spark, run):
    """Rows that come out of each join of the plans that `run` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out = []
    for i in range(before, store.executionsCount()):
        number = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(j) for j in range(metrics.size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    out.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_nearest_states_form_no_pairs(spark):
    """At window 12 every join gives as many rows as there are words; all pairs would be 250 times as many."""
    words = spark.range(1000).selectExpr("'m' as k", "translate(lpad(conv(hash(id) & 2147483647, 10, 6), 12, '0'), '012345', 'abcdef') as w")
    states, asked = words.where("hash(w) % 2 = 0").selectExpr("k", "w as state"), words.where("hash(w) % 2 <> 0").selectExpr("k", "w as pattern")
    rows = joined_rows(spark, lambda: A.nearest_states(asked, states, ["k"]).collect())
    assert rows and max(rows) <= 1000


def test_joins_beyond_the_broadcast_limit_carry_the_block(spark, roles):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        segments = symbols.paa(roles, ["event_type", "role"], 5)
        plan = physical(symbols.grams(segments, ["event_type", "role"], [4], [3]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
    assert joins and any("_block" in j for j in joins)
    # The join and the window share one exchange: nothing between them shuffles again.
    top = plan[plan.index("Window") : plan.index("SortMergeJoin")]
    assert "Exchange" not in top


@pytest.mark.parametrize("parts", [1, 3])
def test_result_does_not_depend_on_partitions(spark, sf, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(Q.queries()["explain_path_default"](spark, sf).collect(), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert sorted(Q.queries()["explain_path_default"](spark, sf).collect(), key=str) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_letters_of_doubles_do_not_depend_on_partitions(spark, roles):
    rk, old = ["event_type", "role"], spark.conf.get("spark.sql.shuffle.partitions")
    rows = blocks.stage(roles.withColumn("x", F.expr("cast(x as double) / 3 + 1e6")))
    found = []
    try:
        for parts in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            dealt = rows.repartition(parts, F.rand(parts))
            letters = symbols.sax_letters(symbols.paa(dealt, rk, 7), rk, 5, block_rows=200)
            z = symbols.z_normalize(dealt, rk)
            found.append((sorted(letters.select(*rk, "seg", "paa", "z", "letter").collect()), sorted(z.select(*rk, "pos", "z").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert found[0] == found[1] == found[2]


def test_noise_levels_share_the_model(spark, roles):
    table = X.robustness_table(roles, ["event_type"], stds=(0.1,)).collect()
    assert set(table[0].asDict()) == {"event_type", "automaton_original_f1", "automaton_noise_0_1_f1"}
    plain = {r.event_type: r.f1 for r in X.detect(roles, ["event_type"]).collect()}
    assert {r.event_type: r.automaton_original_f1 for r in table} == plain


def test_cross_dataset_options(spark, sf):
    rows = Q.folded(spark, sf).withColumn("dataset", F.lit("events")).select("dataset", "fold", "x", "label", "role", "pos", "n")
    all_folds = X.cross_dataset_matrix(rows, "dataset", ["events"], "fold", range(5)).first()
    own = X.fold_mean(X.detect(rows, ["dataset", "fold"]), ["dataset"]).first()
    assert all_folds.events == pytest.approx(own.f1)
    first = X.cross_dataset_matrix(rows, "dataset", ["events"], "fold", range(5), source_folds="fold0").first()
    assert 0 <= first.events <= 1
    with pytest.raises(ValueError):
        X.cross_dataset_matrix(rows, "dataset", ["events"], source_folds="none")
