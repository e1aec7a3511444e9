"""Comparing flags with labels and detectors with each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.functions.columns import erfc
from motifline.plans.blocks import attach, running_totals


def align_pairs(labels: DataFrame, flags: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """Pair labels and flags by step; steps only one side has are dropped."""
    return labels.join(flags, [*keys, step])


def _total(condition: str, weight: str | None = None) -> Column:
    return F.expr(f"cast(coalesce(sum(if({condition}, {weight or 1}, 0)), 0) as bigint)")


def _cells(df: DataFrame, keys: Sequence[str], label: str, pred: str, weight: str | None) -> DataFrame:
    return df.groupBy(*keys).agg(
        _total(f"{label} = 1 and {pred} = 1", weight).alias("tp"),
        _total(f"{label} <> 1 and {pred} = 1", weight).alias("fp"),
        _total(f"{label} = 1 and {pred} <> 1", weight).alias("fn"),
        _total(f"{label} <> 1 and {pred} <> 1", weight).alias("tn"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.expr(f"if({b} = 0, 0D, ({a}) / ({b}))")


def binary_metrics(
    df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred", weight: str | None = None
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 on an empty denominator.

    With `weight`, each row stands for that many steps.
    """
    return _cells(df, keys, label, pred, weight).select(
        *keys,
        F.expr("tp + fp + fn + tn").alias("steps"),
        _ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"),
        _ratio("tp", "tp + fp").alias("precision"),
        _ratio("tp", "tp + fn").alias("recall"),
        _ratio("2 * tp", "2 * tp + fp + fn").alias("f1"),
    )


def confusion_matrix(
    df: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred", weight: str | None = None
) -> DataFrame:
    """Counts for all four (label, pred) cells, zeros included."""
    grid = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(f).alias("pred"), F.col(c).alias("cnt"))
            for y, f, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return _cells(df, keys, label, pred, weight).select(*keys, F.explode(grid).alias("_c")).select(*keys, "_c.*")


def roc_points(df: DataFrame, keys: Sequence[str], score: str, label: str = "label") -> DataFrame:
    """False and true positive counts and rates at every distinct score, from the highest.

    A row with a null `threshold` is the origin. `pos` and `neg` count the labels
    at exactly that score.
    """
    counts = df.groupBy(*keys, F.col(score).alias("threshold")).agg(
        _total(f"{label} = 1").alias("pos"), _total(f"{label} <> 1").alias("neg")
    )
    curve = running_totals(counts, keys, [F.desc("threshold")], {"tp": "pos", "fp": "neg"})
    totals = curve.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    origin = totals.select(
        *keys, F.lit(None).cast("double").alias("threshold"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("pos", "neg", "tp", "fp")],
    )
    points = curve.unionByName(origin)
    return attach(points, totals, keys, F.pmod(F.xxhash64("threshold"), F.lit(1024))).select(
        *keys, "threshold", "pos", "neg", "tp", "fp",
        _ratio("fp", "_n").alias("fpr"),
        _ratio("tp", "_p").alias("tpr"),
    )


def auc(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid area under `roc_points`; each point knows its own step, so no ordering is needed."""
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    size = F.sum("pos").cast("double") * F.sum("neg").cast("double")  # the product of two counts may exceed a bigint
    return points.groupBy(*keys).agg(F.when(size == 0, None).otherwise(area / size).alias("auc"))


def mcnemar_table(
    df: DataFrame, keys: Sequence[str], label: str = "label", a: str = "pred_a", b: str = "pred_b"
) -> DataFrame:
    """How often both, only A, only B or neither is right."""
    return df.groupBy(*keys).agg(
        _total(f"{a} = {label} and {b} = {label}").alias("both_correct"),
        _total(f"{a} = {label} and {b} <> {label}").alias("a_only"),
        _total(f"{a} <> {label} and {b} = {label}").alias("b_only"),
        _total(f"{a} <> {label} and {b} <> {label}").alias("neither"),
    )


def mcnemar_test(table: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Continuity-corrected chi-square with one degree of freedom; null when A and B never differ."""
    b, c = F.col("a_only"), F.col("b_only")
    gap = (F.abs(b - c) - 1).cast("double")
    return (
        table.withColumn("statistic", F.when(b + c == 0, None).otherwise(gap * gap / (b + c)))
        .withColumn("p_value", erfc(F.sqrt(F.col("statistic") / 2)))
        .withColumn("significant", F.col("p_value") < alpha)
    )
