"""Whole experiments as one plan each: every loop variable is a key column.

Metrics need no per-row scores. Steps are counted by (keys, gram, label) before
the shuffle and the distinct grams are scored, so what is joined grows with the
number of different patterns, not with the length of the series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifline.functions.columns import standard_normal
from motifline.operators.automaton import (
    THRESHOLD,
    count_steps,
    explain_paths,
    fit_automaton,
    score_grams,
    source_state_count,
)
from motifline.operators.evaluate import binary_metrics
from motifline.operators.symbols import grams, paa
from motifline.operators.windows import (
    flag_above,
    percentile_threshold,
    reconstruction_error,
    reconstruction_fit,
)
from motifline.plans.blocks import BLOCK_ROWS, attach, int_div, stage

METRICS = ("accuracy", "precision", "recall", "f1")


@dataclass(frozen=True)
class Params:
    segment_size: int = 5
    alphabet_size: int = 4
    window: int = 3
    threshold: float = THRESHOLD
    block_rows: int = BLOCK_ROWS


def steps_of(
    series: DataFrame,
    keys: Sequence[str],
    params: Params = Params(),
    alphabets: Sequence[int] | None = None,
    windows: Sequence[int] | None = None,
) -> DataFrame:
    """Grams of every series in `series`, one row per step and parameter pair.

    The segments are staged: they are a fraction of the rows and are read twice,
    for the mean and deviation and for the letters.
    """
    return grams(
        stage(paa(series, keys, params.segment_size)),
        keys,
        alphabets or [params.alphabet_size],
        windows or [params.window],
        params.block_rows,
    )


def _role(series: DataFrame, role: str) -> DataFrame:
    return series.where(F.col("role") == role).drop("role")


def count_roles(
    series: DataFrame,
    keys: Sequence[str],
    params: Params = Params(),
    alphabets: Sequence[int] | None = None,
    windows: Sequence[int] | None = None,
) -> DataFrame:
    """Staged step counts of the train and test rows: the one pass an experiment makes over its series."""
    used = series.where(F.col("role").isin("train", "test"))
    steps = steps_of(used, [*keys, "role"], params, alphabets, windows)
    by = [*keys, "role", "alphabet_size", "window_size"]
    return stage(count_steps(steps, by))


def flag_counts(
    counts: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Add `pred` to counted steps; `keys` names the model. Steps without a model count as `score_grams` says."""
    labelled = counts.where("label is not null")
    scores = score_grams(labelled, edges, keys, threshold)
    on = list(dict.fromkeys([*keys, "window_size", "gram"]))
    return labelled.join(scores.select(*on, F.expr("cast(decision = 'anomaly' as int)").alias("pred")), on)


def detect(series: DataFrame, keys: Sequence[str], params: Params = Params()) -> DataFrame:
    """Learn each key's model on its train rows and score its test rows: one row of metrics per key."""
    counts = count_roles(series, keys, params)
    edges = stage(fit_automaton(_role(counts, "train"), keys))
    flags = flag_counts(_role(counts, "test"), edges, keys, params.threshold)
    return binary_metrics(flags, keys, weight="cnt")


def explain(series: DataFrame, keys: Sequence[str], params: Params = Params()) -> DataFrame:
    """Justification of every test step, with its label."""
    steps = stage(steps_of(series.where(F.col("role").isin("train", "test")), [*keys, "role"], params))
    edges = stage(fit_automaton(_role(steps, "train"), keys))
    return explain_paths(_role(steps, "test"), edges, keys, params.threshold).drop(
        "alphabet_size", "window_size"
    )


def skipped(series: DataFrame, keys: Sequence[str], params: Params = Params()) -> DataFrame:
    """Keys without a model: fewer than two train patterns."""
    train = steps_of(series.where(F.col("role") == "train"), keys, params)
    pairs = train.where(F.length("gram") > F.col("window_size")).select(*keys).distinct()
    return series.select(*keys).distinct().join(pairs, list(keys), "left_anti")


def detect_windows(
    series: DataFrame,
    keys: Sequence[str],
    length: int,
    k: int = 1,
    p: float = 0.95,
    threshold_role: str = "train",
    vary: Sequence[str] = (),
    test: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Flags of the reconstruction detector on the test windows.

    `end` is the row a window ends at; its label is that row's. The threshold
    comes from the train or from the test scores. `test` replaces the test rows
    by variants told apart by the columns in `vary`.
    """
    train = _role(series, "train")
    test = _role(series, "test") if test is None else test
    fit = stage(reconstruction_fit(train, keys, length, k, block_rows))
    scores = stage(reconstruction_error(test, fit, [*keys, *vary], length, keys, block_rows))
    if threshold_role == "train":
        limits = percentile_threshold(reconstruction_error(train, fit, keys, length, keys, block_rows), keys, p)
        flagged = flag_above(scores, limits, keys)
    else:
        flagged = flag_above(scores, percentile_threshold(scores, [*keys, *vary], p), [*keys, *vary])
    labels = test.select(*keys, *vary, F.col("pos").alias("end"), F.coalesce("label", F.lit(0)).alias("label"))
    return flagged.withColumn("end", F.col("start") + (length - 1)).join(labels, [*keys, *vary, "end"])


def fold_mean(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in METRICS])


def seed_summary(metrics: DataFrame, by: Sequence[str], cols: Sequence[str] = METRICS) -> DataFrame:
    """Mean and sample standard deviation over the seeds of each experiment."""
    stats = []
    for c in cols:
        stats += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return metrics.groupBy(*by).agg(*stats)


def metrics_summary(entries: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of each metric over the logged entries that have it."""
    return entries.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def gaussian_noise(
    df: DataFrame, keys: Sequence[str], std: float | Column, seed: int | Column = 42, mean: float = 0.0, col: str = "x"
) -> DataFrame:
    """Add N(mean, std) to each value; the draw depends on keys, position and seed only."""
    std = std if isinstance(std, Column) else F.lit(std)
    draw = standard_normal([*[F.col(k) for k in keys], F.col("pos")], seed)
    return df.withColumn(col, F.col(col).cast("double") + F.lit(mean) + std * draw)


def noisy_variants(
    test: DataFrame, keys: Sequence[str], stds: Sequence[float], seed: int = 42
) -> DataFrame:
    """Test series once per noise level in column `std`; level 0 is the original."""
    levels = F.array(*[F.lit(float(s)) for s in [0.0, *stds]])
    variants = test.withColumn("std", F.explode(levels))
    return gaussian_noise(variants, keys, F.col("std"), seed)


def _level_name(std: float) -> str:
    return "original_f1" if std == 0 else f"noise_{std}_f1".replace(".", "_")


def _by_level(f1: DataFrame, by: Sequence[str], stds: Sequence[float], prefix: str) -> DataFrame:
    levels = [0.0, *[float(s) for s in stds]]
    wide = f1.groupBy(*by).pivot("std", levels).agg(F.avg("f1"))
    return wide.select(*by, *[F.col(f"`{s}`").alias(f"{prefix}_{_level_name(s)}") for s in levels])


def robustness_table(
    series: DataFrame,
    keys: Sequence[str],
    stds: Sequence[float] = (0.05, 0.1, 0.2, 0.5),
    by: Sequence[str] | None = None,
    params: Params = Params(),
    seed: int = 42,
    length: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean F1 per dataset on the original and the noisy test series, one column per level.

    Models learn from the unchanged train rows. With `length` the window
    detector's columns are added.
    """
    by = list(by or keys)
    test = noisy_variants(_role(series, "test"), keys, stds, seed)
    edges = stage(fit_automaton(steps_of(_role(series, "train"), keys, params), keys))
    counts = stage(count_steps(steps_of(test, [*keys, "std"], params), [*keys, "std"]))
    flags = flag_counts(counts, edges, keys, params.threshold)
    table = _by_level(binary_metrics(flags, [*keys, "std"], weight="cnt"), by, stds, "automaton")
    if length is None:
        return table
    windows = detect_windows(series, keys, length, vary=["std"], test=test, block_rows=block_rows)
    return table.join(_by_level(binary_metrics(windows, [*keys, "std"]), by, stds, "windows"), by, "left")


def cross_dataset_matrix(
    series: DataFrame,
    dataset_col: str,
    datasets: Sequence[str],
    fold_col: str | None = None,
    folds: Sequence[int] = (0,),
    source_folds: str = "all",
    params: Params = Params(),
) -> DataFrame:
    """Mean F1 of each dataset's model on each dataset's test series.

    One row per `train_dataset`, one column per tested one. With folds, "all"
    averages every source and target fold, matching folds on the diagonal;
    "fold0" takes the models of the first fold only, for all folds of the target. A
    dataset without folds counts with the one fold it has.
    """
    if source_folds not in ("all", "fold0"):
        raise ValueError("source_folds must be 'all' or 'fold0'")
    keys = [dataset_col, *([fold_col] if fold_col else [])]
    steps = count_roles(series, keys, params)
    model = ["train_dataset", "train_fold"]
    edges = stage(
        fit_automaton(_role(steps, "train"), keys)
        .withColumnRenamed(dataset_col, "train_dataset")
        .withColumn("train_fold", F.col(fold_col).cast("int") if fold_col else F.lit(0))
    )
    sources = [(d, f) for d in datasets for f in (folds if source_folds == "all" else [folds[0]])]
    pairs = F.array(*[F.struct(F.lit(d).alias("train_dataset"), F.lit(f).alias("train_fold")) for d, f in sources])
    trained = _role(steps, "train").select(F.col(dataset_col).alias("train_dataset"), (F.col(fold_col).cast("int") if fold_col else F.lit(0)).alias("train_fold")).distinct()
    counts = _role(steps, "test").withColumn("_m", F.explode(pairs)).select("*", "_m.*").drop("_m").join(trained, model, "left_semi")
    if fold_col and source_folds == "all":
        counts = counts.where((F.col("train_dataset") != F.col(dataset_col)) | (F.col("train_fold") == F.col(fold_col)))
    flags = flag_counts(counts, edges, model, params.threshold)
    f1 = binary_metrics(flags, [*model, *keys], weight="cnt")
    return f1.groupBy("train_dataset").pivot(dataset_col, list(datasets)).agg(F.avg("f1"))


def grid_search(
    series: DataFrame,
    keys: Sequence[str],
    by: Sequence[str] | None = None,
    windows: Sequence[int] = (3, 4, 5, 6),
    alphabets: Sequence[int] = (3, 4, 5, 6),
    params: Params = Params(),
) -> DataFrame:
    """Source states, F1 and accuracy for every window and alphabet, averaged over the rest of the key."""
    by = list(by or keys)
    grid = [*keys, "window_size", "alphabet_size"]
    counts = count_roles(series, keys, params, alphabets, windows)
    edges = stage(fit_automaton(_role(counts, "train"), grid))
    flags = flag_counts(_role(counts, "test"), edges, grid, params.threshold)
    metrics = binary_metrics(flags, grid, weight="cnt").join(source_state_count(edges, grid), grid)
    return metrics.groupBy(*by, "window_size", "alphabet_size").agg(
        F.avg("source_states").alias("unique_states"),
        F.avg("f1").alias("f1_score"),
        F.avg("accuracy").alias("accuracy"),
    )


def report_rows(grid: DataFrame, by: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows of the grid in grid order."""
    return grid.orderBy(*by, "window_size", "alphabet_size").limit(rows)


def parameter_sensitivity(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """F1 along the windows, one line per alphabet."""
    return grid.select(*by, "alphabet_size", "window_size", "f1_score").orderBy(*by, "alphabet_size", "window_size")


def _first_states(edges: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first `n` source states of each key by first appearance."""
    seen = edges.groupBy(*keys, "s_from").agg(F.min("first_seg").alias("_first"))
    order = Window.partitionBy(*keys).orderBy("_first")
    # Compared with the row number itself, so that each task keeps the first n before the shuffle.
    top = seen.withColumn("_row", F.row_number().over(order)).where(F.col("_row") <= n)
    return top.withColumn("rank", F.col("_row") - 1).drop("_first", "_row")


def _among_first(edges: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    first = stage(_first_states(edges, keys, n))
    to = first.select(*keys, F.col("s_from").alias("s_to"), F.col("rank").alias("to_rank"))
    return (
        edges.select(*keys, "s_from", "s_to", "p")
        .join(first.withColumnRenamed("rank", "from_rank"), [*keys, "s_from"])
        .join(to, [*keys, "s_to"])
    )


def transition_heatmap(edges: DataFrame, keys: Sequence[str], n: int = 20) -> DataFrame:
    """Dense matrix over the first `n` states: a row per source, a column per target rank.

    `to_j` is the probability of moving to the state whose row has rank j.
    """
    first = _first_states(edges, keys, n).withColumnRenamed("rank", "from_rank")
    cells = _among_first(edges, keys, n).groupBy(*keys, "s_from").pivot("to_rank", list(range(n))).agg(F.first("p"))
    named = cells.select(*keys, "s_from", *[F.col(f"`{j}`").alias(f"to_{j}") for j in range(n)])
    return first.join(named, [*keys, "s_from"], "left").fillna(0.0, [f"to_{j}" for j in range(n)])


def significant_edges(edges: DataFrame, keys: Sequence[str], n: int = 20, p: float = 0.05) -> DataFrame:
    """Edges above probability `p` among the first `n` states."""
    return _among_first(edges, keys, n).where(F.col("p") > p).select(*keys, "s_from", "s_to", "p")


def compare_detectors(
    scored: DataFrame, windows: DataFrame, keys: Sequence[str], segment_size: int, window: int, aligned: bool = True
) -> DataFrame:
    """Pair both detectors' flags on test rows for the McNemar test.

    Time-aligned: a row meets the pattern that ends in its segment and the
    window that ends at the row. Positional: step t meets window t.
    """
    flags = scored.select(*keys, "time_step", (F.col("decision") == "anomaly").cast("int").alias("pred_a"))
    step = int_div("end", segment_size) - (window - 1) if aligned else F.col("start")
    rows = windows.withColumnRenamed("pred", "pred_b").withColumn("time_step", step)
    return rows.join(flags, [*keys, "time_step"]).select(*keys, "end", "label", "pred_a", "pred_b")
