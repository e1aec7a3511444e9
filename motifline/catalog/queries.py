"""One registered query per operator, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifline.operators import automaton as A
from motifline.operators import evaluate as E
from motifline.operators import scaling, splits, symbols, windows
from motifline.plans import experiments as X
from motifline.plans.blocks import stage, stage_path, with_position
from motifline.sources import csv, synthetic, tables

ET = ["event_type"]
RK = ["event_type", "role"]
PARAMS = X.Params()
COLS = ["f1", "f2", "f3", "f4"]
LABEL = "cast(value >= 150 as int) as label"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits without negative zero."""
    return df.select(*[F.expr(f"round({c}, {digits}) + 0D").alias(c) if c in cols else c for c in df.columns])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_type", "ts", "event_id", "cast(value as decimal(12,2)) as x", LABEL
    )


def event_series(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    keep = ["x", "label", *more]
    return with_position(event_rows(spark, sf), ET, ["ts", "event_id"], keep=keep, unique=True)


def event_roles(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return splits.chrono_split(event_series(spark, sf, *more))


def event_letters(spark: SparkSession, sf: str) -> DataFrame:
    return symbols.sax_letters(symbols.paa(event_series(spark, sf), ET, 5), ET, 4)


def event_steps(spark: SparkSession, sf: str, a: int = 4, w: int = 3) -> DataFrame:
    used = event_roles(spark, sf).where("role in ('train', 'test')")
    return X.steps_of(used, RK, X.Params(alphabet_size=a, window=w))


def event_edges(spark: SparkSession, sf: str) -> DataFrame:
    return A.fit_automaton(event_steps(spark, sf).where("role = 'train'"), ET)


def event_counts(spark: SparkSession, sf: str, a: int = 4, w: int = 3) -> DataFrame:
    return X.count_roles(event_roles(spark, sf), ET, X.Params(alphabet_size=a, window=w))


def event_pairs(counts: DataFrame) -> DataFrame:
    return counts.where("role = 'test' and length(gram) > window_size").select(
        "event_type", A.gram_previous().alias("s_from"), A.gram_pattern().alias("s_to")
    ).distinct()


def explained(spark: SparkSession, sf: str, a: int = 4, w: int = 3) -> DataFrame:
    return X.explain(event_roles(spark, sf), ET, X.Params(alphabet_size=a, window=w))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return explained(spark, sf).selectExpr(
        "event_type", "time_step", "label", "cast(decision = 'anomaly' as int) as pred", "probability"
    )


FEATURES = {
    "f1": "value as f1",
    "f2": "cast(hour(ts) as double) as f2",
    "f3": "cast(user_id as double) as f3",
    "f4": "cast(get_json_object(props, '$.k') as double) as f4",
}


def feature_roles(spark: SparkSession, sf: str, cols: list[str] = COLS) -> DataFrame:
    features = [FEATURES[c] for c in cols]
    rows = table(spark, sf, "events").selectExpr("event_type", "ts", "event_id", *features, LABEL)
    return splits.chrono_split(with_position(rows, ET, ["ts", "event_id"], keep=[*cols, "label"], unique=True))


def scaled(spark: SparkSession, sf: str, method: str, cols: list[str] = COLS) -> DataFrame:
    rows = feature_roles(spark, sf, cols)
    fit = scaling.scale_fit(rows.where("role = 'train'"), ET, cols, method)
    return scaling.scale_apply(rows, fit, ET, cols)


def projected(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(scaled(spark, sf, "minmax"))
    fit = scaling.pca_fit(rows.where("role = 'train'"), ET, COLS)
    return scaling.pca_apply(rows, fit, ET, COLS)


def sensor_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "'events' as dataset", "event_id", "ts", "user_id % 7 as source_file",
        "concat('valve', user_id % 2 + 1) as source_group", "cast(value as decimal(12,2)) as x", LABEL,
    )


def folded(spark: SparkSession, sf: str) -> DataFrame:
    rows = sensor_rows(spark, sf)
    folds = splits.group_kfold(rows, "source_file", ["dataset"])
    return splits.fold_roles(rows, folds, "source_file", ["dataset"], ["source_group", "source_file", "ts", "event_id"],
                             keep=["event_id", "x", "label"], unique=True)


def two_sources(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").selectExpr(
        "'events' as dataset", "ts as t", "event_id as id", "cast(value as decimal(12,2)) as x", LABEL
    )
    orders = table(spark, sf, "orders").selectExpr(
        "'orders'", "o_orderdate", "o_orderkey", "cast(o_totalprice as decimal(12,2))",
        "cast(o_totalprice >= 400000 as int)",
    )
    return splits.chrono_split(with_position(events.union(orders), ["dataset"], ["t", "id"], keep=["x", "label"], unique=True))


def supplier_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "cast(l_extendedprice as decimal(12,2)) as x", "cast(l_returnflag = 'R' as int) as label",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    return with_position(rows, ["l_suppkey"], order, keep=["x", "label"], many=True)


# The seeds that runs are repeated with.
SEEDS = (42, 123, 2026, 7, 999)


def scaled_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Event roles in hundreds, the size that the noise levels are made for."""
    return event_roles(spark, sf).withColumn("x", F.expr("cast(x / 100 as decimal(14,4))"))


def seed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    roles = scaled_roles(spark, sf)
    test = roles.where("role = 'test'").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    edges = stage(A.fit_automaton(X.steps_of(roles.where("role = 'train'"), ET), ET))
    steps = X.steps_of(X.gaussian_noise(test, ET, 0.2, F.col("seed")).drop("role"), [*ET, "seed"])
    counts = stage(A.count_steps(steps, [*ET, "seed"]))
    return E.binary_metrics(X.flag_counts(counts, edges, ET), [*ET, "seed"], weight="cnt")


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id", "ts", "user_id", "value as sensor_0", "cast(user_id as double) as sensor_1",
        "cast(value >= 150 as int) as anomaly",
    )


CSV_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("sensor_0", T.DoubleType()),
        T.StructField("sensor_1", T.DoubleType()),
        T.StructField("anomaly", T.IntegerType()),
    ]
)


def grouped_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Events through two folders of files with their columns in other orders; a file's number is in its name."""
    rows, root = csv_rows(spark, sf), stage_path(spark)

    def out(odd: int, cols: list[str]) -> None:
        part = rows.where(f"user_id % 2 = {odd}").repartitionById(4, F.expr("cast(user_id div 2 % 4 as int)"))
        part.select(*cols).write.option("header", True).csv(f"{root}/valve{odd + 1}")

    out(0, ["event_id", "sensor_0", "sensor_1", "anomaly"])
    out(1, ["anomaly", "sensor_1", "event_id", "sensor_0"])
    read = csv.read_grouped_csv(spark, root, schema=CSV_SCHEMA)
    return csv.split_roles(read, csv.GROUPED_META, "anomaly", ["event_id"])[0].select(
        "event_id", "source_group", F.regexp_extract("source_file", r"^part-(\d+)-.*\.csv$", 1).cast("int").alias("source_file"), "sensor_0", "sensor_1", "label"
    )


def single_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    rows = csv_rows(spark, sf).selectExpr("event_id", "ts as DATETIME", "sensor_0", "sensor_1", "anomaly as ATT_FLAG")
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    schema = "event_id bigint, DATETIME timestamp_ntz, sensor_0 double, sensor_1 double, ATT_FLAG int"
    read = csv.read_single_csv(spark, path, T.StructType.fromDDL(schema))
    return csv.split_roles(read, csv.TIME_COLUMNS, "ATT_FLAG", ["event_id"])[0].select(
        "event_id", "DATETIME", "label", "sensor_0", "sensor_1"
    )


def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    rows = csv_rows(spark, sf).drop("user_id").withColumnRenamed("ts", "datetime")
    return csv.split_roles(rows, csv.GROUPED_META, "anomaly", ["event_id"])[0]


def column_roles_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = csv_rows(spark, sf).select("event_id", F.col("ts").alias("datetime"), "sensor_0")
    return csv.split_roles(rows, csv.GROUPED_META, "anomaly", ["event_id"])[0]


def synthetic_series(spark: SparkSession, sf: str) -> DataFrame:
    lengths = table(spark, sf, "events").groupBy(*ET).agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(synthetic.synthetic_series(lengths, ET, n_features=2), "sensor_0", "sensor_1")


def changepoint(spark: SparkSession, sf: str) -> DataFrame:
    series = event_series(spark, sf).select("event_type", "pos", "label")
    return synthetic.changepoint_flag(series, ET)


def features_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    rows = event_roles(spark, sf).selectExpr("0 as fold", "role", "event_type", "pos", "cast(x as double) as x", "label")
    tables.write_features(rows, path)
    roles = [tables.read_features(spark, path, fold=0, role=r) for r in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, roles).select("event_type", "role", "pos", "x", "label")


def labels_times_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    rows = event_roles(spark, sf, "ts", "event_id")
    tables.write_labels_times(rows, path, ["event_type", "event_id", "ts", "label"], ["role"])
    schema = "event_type string, event_id bigint, ts timestamp_ntz, label int, role string"
    return spark.read.option("header", True).schema(schema).csv(path).select(
        "event_type", "role", "event_id", "ts", "label"
    )


def automaton_tables(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    tables.save_automaton(stage(event_edges(spark, sf)), ET, path)
    states, edges = tables.load_automaton(spark, path)
    known = states.groupBy(*ET).agg(F.count(F.lit(1)).alias("states"))
    return rounded(edges.select("event_type", "s_from", "s_to", "cnt", "first_seg", "p").join(known, ET), "p")


def automaton_json(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after their way through files of JSON lines, and null targets for states that lead nowhere."""
    path = stage_path(spark)
    tables.automaton_json(stage(event_edges(spark, sf)), ET).write.partitionBy(*ET).text(path)
    lines = spark.read.schema("model string, event_type string").text(path)
    states, edges = tables.states_from_json(lines, ET), tables.edges_from_json(lines, ET)
    return rounded(states.withColumnRenamed("state", "s_from").join(edges, ["event_type", "s_from"], "left"), "p")


def fit_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    rows = feature_roles(spark, sf).where("role = 'train'")
    tables.save_fit(scaling.scale_fit(rows, ET, COLS, "standard"), path)
    fit = tables.load_fit(spark, path)
    return rounded(fit, *fit.columns[1:])


def metrics_files(spark: SparkSession, sf: str) -> DataFrame:
    path, series = stage_path(spark), event_series(spark, sf)
    f1 = X.detect(splits.chrono_split(series), ET).selectExpr("event_type", "'symbols' as experiment", "steps", "f1")
    scores = series.selectExpr("event_type", "cast(x as double) as score")
    limits = windows.percentile_threshold(scores, ET).selectExpr("event_type", "'limits' as experiment", "threshold")
    tables.write_metrics([f1, limits], path)
    schema = "event_type string, experiment string, steps bigint, f1 double, threshold double"
    as_json = spark.read.schema(schema).json(f"{path}/json")
    as_csv = spark.read.option("header", True).schema(schema).csv(f"{path}/csv")
    return rounded(as_json.intersect(as_csv), "f1", "threshold")


def results_files(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    found = X.detect(event_roles(spark, sf), ET)
    tables.write_results(found, path)
    as_json = spark.read.schema(found.schema).json(f"{path}/json").withColumn("format", F.lit("json"))
    as_csv = spark.read.option("header", True).schema(found.schema).csv(f"{path}/csv").withColumn("format", F.lit("csv"))
    return rounded(as_json.unionByName(as_csv), *X.METRICS)


def positions_one_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr("1 as one", "ts", "event_id")
    return with_position(rows, ["one"], ["ts", "event_id"]).select("event_id", "pos")


def group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr("'events' as dataset", "user_id")
    return splits.group_kfold(rows, "user_id", ["dataset"]).select("user_id", "rows", "fold")


def scale_fit(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        fit = scaling.scale_fit(feature_roles(spark, sf).where("role = 'train'"), ET, COLS, method)
        return rounded(fit, *fit.columns[1:])

    return run


def scale_apply(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: rounded(scaled(spark, sf, method).select("event_type", "role", "pos", *COLS), *COLS)


def pca_fit(spark: SparkSession, sf: str) -> DataFrame:
    return flat_axes(scaling.pca_fit(scaled(spark, sf, "minmax").where("role = 'train'"), ET, COLS))


def flat_axes(fit: DataFrame) -> DataFrame:
    cells = [(f"{name}_{c}", f"{field}[{i}] as {name}_{c}") for name, field in (("mean", "means"), ("axis", "axes[0]")) for i, c in enumerate(COLS)]
    return rounded(fit.selectExpr("event_type", *[e for _, e in cells]), *[c for c, _ in cells])


def pca_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark)
    tables.save_fit(scaling.pca_fit(scaled(spark, sf, "minmax").where("role = 'train'"), ET, COLS, k=2), path)
    return flat_axes(tables.load_fit(spark, path))


def nearest(a: int, w: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        counts = event_counts(spark, sf, a, w)
        states = A.state_set(A.fit_automaton(counts.where("role = 'train'"), ET), ET)
        test = counts.where("role = 'test'").select("event_type", A.gram_pattern().alias("pattern")).distinct()
        unseen = test.join(states.withColumnRenamed("state", "pattern"), ["event_type", "pattern"], "left_anti")
        return A.nearest_states(unseen, states, ET)

    return run


def nearest_without_model(spark: SparkSession, sf: str) -> DataFrame:
    counts = event_counts(spark, sf, 6, 4)
    states = A.state_set(A.fit_automaton(counts.where("role = 'train'"), ET), ET)
    test = counts.where("role = 'test'").select(F.expr("event_type || '?'").alias("event_type"), A.gram_pattern().alias("pattern"))
    return A.nearest_states(test, states, ET)


def short_series(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of a part's line items with so few train rows that most series have no model."""
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey",
        "cast(l_extendedprice as decimal(12,2)) as x", "cast(l_returnflag = 'R' as int) as label",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
    return splits.chrono_split(with_position(rows, ["l_partkey"], order, keep=["x", "label"], many=True), train=0.5, val=0.0)


def transition_probability(spark: SparkSession, sf: str) -> DataFrame:
    counts = event_counts(spark, sf, 6, 4)
    edges = A.fit_automaton(counts.where("role = 'train'"), ET)
    return rounded(A.transition_probability(event_pairs(counts), edges, ET), "probability")


def evaluate_transitions(spark: SparkSession, sf: str) -> DataFrame:
    counts = event_counts(spark, sf, 6, 4)
    edges = stage(A.fit_automaton(counts.where("role = 'train'"), ET))
    return rounded(A.evaluate_transitions(event_pairs(counts), edges, ET), "probability")


def justification_json(spark: SparkSession, sf: str) -> DataFrame:
    records = A.justification_json(explained(spark, sf, 6, 4), ET)
    schema = "time_step bigint, state string, pattern string, status string, mapped_to string, probability double, decision string"
    parsed = records.select("event_type", F.from_json("justification", schema).alias("j")).select("event_type", "j.*")
    return rounded(parsed, "probability")


def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = windows.sliding_windows(event_series(spark, sf), ET, 10)
    text = "concat_ws(',', transform(window, v -> cast(cast(v as decimal(12,2)) as string))) as window"
    return found.selectExpr("event_type", "start", text)


def reconstruction_error(spark: SparkSession, sf: str, length: int = 2, digits: int = 4) -> DataFrame:
    roles = event_roles(spark, sf)
    fit = windows.reconstruction_fit(roles.where("role = 'train'"), ET, length)
    scores = windows.reconstruction_error(roles.where("role = 'test'"), fit, ET, length)
    return rounded(scores, "score", digits=digits)


def value_limits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scores = event_series(spark, sf).selectExpr("event_type", "pos", "cast(x as double) as score")
    return scores, windows.percentile_threshold(scores, ET)


def flag_above(spark: SparkSession, sf: str) -> DataFrame:
    return windows.flag_above(*value_limits(spark, sf), ET).select("event_type", "pos", "pred")


def detect_windows(length: int, p: float = 0.95) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = X.detect_windows(event_roles(spark, sf), ET, length, p=p)
        return rounded(E.binary_metrics(found, ET), *X.METRICS)

    return run


def align_pairs(spark: SparkSession, sf: str) -> DataFrame:
    roles = event_roles(spark, sf)
    test = roles.where("role = 'test'").drop("role")
    labels = symbols.align_labels(test, ET, 5, 3).withColumnRenamed("seg", "time_step")
    preds = X.explain(roles, ET).selectExpr("event_type", "time_step", "cast(decision = 'anomaly' as int) as pred")
    return E.align_pairs(labels, preds, ET, "time_step")


def roc(spark: SparkSession, sf: str) -> DataFrame:
    return E.roc_points(flags(spark, sf).withColumn("score", F.expr("1 - probability")), ET, "score")


def mcnemar(aligned: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        roles = event_roles(spark, sf)
        found = X.detect_windows(roles, ET, 2, threshold_role="train" if aligned else "test")
        both = X.compare_detectors(X.explain(roles, ET), found, ET, 5, 3, aligned)
        tested = E.mcnemar_test(E.mcnemar_table(both, ET))
        return rounded(rounded(tested, "statistic"), "p_value", digits=5)

    return run


def skipped_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "cast(l_extendedprice as decimal(12,2)) as x"
    )
    series = with_position(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], keep=["x"], many=True)
    return X.skipped(splits.chrono_split(series), ["l_partkey"])


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return X.detect(folded(spark, sf).drop("dataset"), ["fold"])


def gaussian_noise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.gaussian_noise(event_series(spark, sf), ET, 1.0, seed=7).select("event_type", "pos", "x"), "x")


def robustness(spark: SparkSession, sf: str) -> DataFrame:
    found = X.robustness_table(scaled_roles(spark, sf), ET)
    return found.select(*ET, *[F.expr(f"round(`{c}`, 6) + 0D").alias(c) for c in found.columns[1:]])


def robustness_windows(spark: SparkSession, sf: str) -> DataFrame:
    return X.robustness_table(scaled_roles(spark, sf), ET, length=100)


def cross_dataset(spark: SparkSession, sf: str) -> DataFrame:
    found = X.cross_dataset_matrix(two_sources(spark, sf), "dataset", ["events", "orders"])
    return rounded(found, "events", "orders")


def folds_and_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The grouped dataset in five folds beside one that is split once."""
    folds = folded(spark, sf).withColumn("dataset", F.lit("events"))
    cols = ["dataset", "fold", "x", "label", "role", "pos", "n"]
    orders = two_sources(spark, sf).where("dataset = 'orders'").withColumn("fold", F.lit(0)).select(*cols)
    return folds.select(*cols).union(orders)


def cross_dataset_folds(source_folds: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = X.cross_dataset_matrix(folds_and_orders(spark, sf), "dataset", ["events", "orders"], "fold", range(5), source_folds)
        return rounded(found, "events", "orders")

    return run


def run_all_folds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.fold_mean(X.detect(folds_and_orders(spark, sf), ["dataset", "fold"]), ["dataset"]), *X.METRICS)


def grid_search_folds(spark: SparkSession, sf: str) -> DataFrame:
    found = X.grid_search(folds_and_orders(spark, sf), ["dataset", "fold"], ["dataset"], (3, 5), (3, 4))
    return rounded(found, "unique_states", "f1_score", "accuracy")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.grid_search(event_roles(spark, sf), ET), "f1_score", "accuracy")


def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    entries = seed_metrics(spark, sf).withColumn("experiment", F.lit("automaton"))
    return rounded(X.metrics_summary(entries, ["experiment"], X.METRICS), *X.METRICS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # sources and sinks
        "grouped_csv": grouped_csv,
        "single_csv": single_csv,
        "column_roles": column_roles,
        "column_roles_unlabelled": column_roles_unlabelled,
        "synthetic_series": synthetic_series,
        "changepoint": changepoint,
        "features_roundtrip": features_roundtrip,
        "labels_times_roundtrip": labels_times_roundtrip,
        "automaton_tables": automaton_tables,
        "automaton_json": automaton_json,
        "fit_roundtrip": fit_roundtrip,
        "pca_roundtrip": pca_roundtrip,
        "metrics_files": metrics_files,
        "results_files": results_files,
        # order and splits
        "positions": lambda s, d: event_series(s, d, "event_id").select("event_type", "event_id", "pos", "n"),
        "positions_one_series": positions_one_series,
        "positions_many_series": lambda s, d: supplier_series(s, d).selectExpr("l_suppkey", "pos", "n", "cast(x as double) as x"),
        "chrono_split": lambda s, d: event_roles(s, d, "event_id").select("event_type", "event_id", "role", "pos", "n"),
        "group_kfold": group_kfold,
        "fold_roles": lambda s, d: folded(s, d).select("event_id", "fold", "role", "pos", "n"),
        "distinct_groups": lambda s, d: splits.distinct_groups(table(s, d, "events"), "user_id", ET),
        # scaling and projection
        "minmax_fit": scale_fit("minmax"),
        "minmax_apply": scale_apply("minmax"),
        "standard_fit": scale_fit("standard"),
        "standard_apply": scale_apply("standard"),
        "pca_fit": pca_fit,
        "pca_apply": lambda s, d: rounded(projected(s, d).select("event_type", "role", "pos", "pc_1"), "pc_1"),
        # symbols
        "z_normalize": lambda s, d: rounded(symbols.z_normalize(event_series(s, d), ET).select("event_type", "pos", "z"), "z"),
        "paa": lambda s, d: rounded(symbols.paa(event_series(s, d), ET, 5).drop("n_seg"), "paa"),
        "sax_letters": lambda s, d: rounded(event_letters(s, d).select("event_type", "seg", "z", "letter"), "z"),
        "sax_string": lambda s, d: symbols.sax_string(event_letters(s, d), ET),
        "patterns": lambda s, d: symbols.extract_patterns(event_letters(s, d), ET, 3),
        "unique_states": lambda s, d: symbols.unique_states(symbols.extract_patterns(event_letters(s, d), ET, 3), ET),
        "pattern_labels": lambda s, d: symbols.align_labels(event_series(s, d), ET, 5, 3),
        # automaton
        "transition_counts": lambda s, d: A.transition_counts(event_steps(s, d).where("role = 'train'"), ET),
        "transition_probs": lambda s, d: rounded(event_edges(s, d).select("event_type", "s_from", "s_to", "p"), "p"),
        "state_set": lambda s, d: A.state_set(event_edges(s, d), ET),
        "source_state_count": lambda s, d: A.source_state_count(event_edges(s, d), ET),
        "edit_distance": lambda s, d: event_steps_all(s, d).select(
            "event_type", "role", "seg", F.levenshtein(A.gram_previous(), A.gram_pattern()).alias("distance")
        ),
        "nearest_state": nearest(6, 4),
        "nearest_state_12": nearest(6, 12),
        "nearest_state_no_model": nearest_without_model,
        "nearest_state_all_unseen": nearest(6, 6),
        "transition_probability": transition_probability,
        "evaluate_transitions": evaluate_transitions,
        "explain_path": lambda s, d: rounded(explained(s, d, 6, 4).drop("label"), "probability"),
        "explain_path_default": lambda s, d: rounded(explained(s, d).drop("label"), "probability"),
        "decisions": lambda s, d: explained(s, d).groupBy("event_type", "decision").agg(F.count(F.lit(1)).alias("steps")),
        "path_summary": lambda s, d: rounded(
            A.path_summary(explained(s, d), ET), "path_probability", "log_probability", "confidence"
        ),
        "justification_json": justification_json,
        # windows
        "sliding_windows": sliding_windows,
        "reconstruction_error": reconstruction_error,
        "reconstruction_error_100": lambda s, d: reconstruction_error(s, d, 100),
        "percentile_threshold": lambda s, d: rounded(value_limits(s, d)[1], "threshold"),
        "flag_above": flag_above,
        "detect_windows": detect_windows(2),
        "detect_windows_100": detect_windows(100),
        # evaluation
        "align_pairs": align_pairs,
        "binary_metrics": lambda s, d: rounded(E.binary_metrics(flags(s, d), ET), *X.METRICS),
        "confusion_matrix": lambda s, d: E.confusion_matrix(flags(s, d), ET),
        "roc_points": lambda s, d: rounded(roc(s, d).drop("pos", "neg"), "threshold", "fpr", "tpr"),
        "auc": lambda s, d: rounded(E.auc(roc(s, d), ET), "auc"),
        "mcnemar_aligned": mcnemar(True),
        "mcnemar_positional": mcnemar(False),
        # experiments
        "detect": lambda s, d: rounded(X.detect(event_roles(s, d), ET), *X.METRICS),
        "detect_short_series": lambda s, d: rounded(X.detect(short_series(s, d), ["l_partkey"]), *X.METRICS),
        "detect_many_series": lambda s, d: rounded(
            X.detect(splits.chrono_split(supplier_series(s, d)), ["l_suppkey"]), *X.METRICS
        ),
        "skipped_series": skipped_series,
        "sensor_pipeline": lambda s, d: rounded(X.detect(projected(s, d).withColumnRenamed("pc_1", "x"), ET), *X.METRICS),
        "fold_metrics": lambda s, d: rounded(fold_metrics(s, d), *X.METRICS),
        "fold_mean": lambda s, d: rounded(
            X.fold_mean(fold_metrics(s, d).withColumn("dataset", F.lit("events")), ["dataset"]), *X.METRICS
        ),
        "run_all": lambda s, d: rounded(X.fold_mean(X.detect(two_sources(s, d), ["dataset"]), ["dataset"]), *X.METRICS),
        "run_all_folds": run_all_folds,
        "seed_summary": lambda s, d: rounded(
            X.seed_summary(seed_metrics(s, d), ET), *[f"{c}_{k}" for c in X.METRICS for k in ("mean", "std")]
        ),
        "gaussian_noise": gaussian_noise,
        "robustness": robustness,
        "robustness_windows": robustness_windows,
        "cross_dataset": cross_dataset,
        "cross_dataset_folds": cross_dataset_folds("all"),
        "cross_dataset_first_fold": cross_dataset_folds("fold0"),
        "grid_search": grid,
        "grid_search_folds": grid_search_folds,
        "report_rows": lambda s, d: X.report_rows(grid(s, d), ET),
        "parameter_sensitivity": lambda s, d: X.parameter_sensitivity(grid(s, d), ET),
        "transition_heatmap": lambda s, d: rounded(
            X.transition_heatmap(stage(event_edges(s, d)), ET), *[f"to_{j}" for j in range(20)]
        ),
        "significant_edges": lambda s, d: rounded(X.significant_edges(stage(event_edges(s, d)), ET), "p"),
        "metrics_summary": metrics_summary,
    }


def event_steps_all(spark: SparkSession, sf: str) -> DataFrame:
    steps = X.steps_of(event_roles(spark, sf), RK, X.Params(alphabet_size=6, window=6))
    return steps.where("length(gram) > window_size")
