"""Prepared series, models and results as files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.operators.automaton import state_set
from motifline.plans.blocks import stage


def write_features(df: DataFrame, path: str, parts: Sequence[str] = ("fold", "role")) -> None:
    """Series with labels and times as Parquet, one folder per fold and role.

    Rows are not regrouped first: each task writes its rows of a folder, so a big
    role never ends in one task.
    """
    df.write.partitionBy(*parts).parquet(path)


def write_labels_times(df: DataFrame, path: str, cols: Sequence[str], parts: Sequence[str] = ("fold", "role")) -> bool:
    """Label and time columns as CSV; nothing is written when there are no rows."""
    rows = stage(df.select(*parts, *cols))
    if rows.isEmpty():
        return False
    micros = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    writer = rows.write.partitionBy(*parts)
    writer.options(header=True, timestampFormat=micros, timestampNTZFormat=micros).csv(path)
    return True


def read_features(spark: SparkSession, path: str, **parts) -> DataFrame:
    """Rows of the given partition values; a missing label counts as 0."""
    df = spark.read.parquet(path)
    for name, value in parts.items():
        df = df.where(F.col(name) == value)
    if "label" not in df.columns:
        return df.withColumn("label", F.lit(0))
    return df.withColumn("label", F.coalesce("label", F.lit(0)))


def save_automaton(edges: DataFrame, keys: Sequence[str], path: str) -> None:
    edges.write.parquet(f"{path}/edges")
    state_set(edges, keys).write.parquet(f"{path}/states")


def load_automaton(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(states, edges) of a saved model; a missing path is an error."""
    return spark.read.parquet(f"{path}/states"), spark.read.parquet(f"{path}/edges")


MODEL = "states array<string>, transition_matrix map<string, map<string, double>>"


def automaton_json(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Models as JSON: a document of `states` and the nested `transition_matrix` for each state.

    All documents of a model, put together, are the model; none grows with it, as a state
    has at most as many targets as there are letters. A state without a target has no
    entry in the matrix.
    """
    leaving = edges.groupBy(*keys, F.col("s_from").alias("state")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("s_to", "p")))).alias("_targets")
    )
    matrix = F.when(F.col("_targets").isNull(), F.expr("map()").cast("map<string, map<string, double>>")).otherwise(F.create_map("state", "_targets"))
    parts = state_set(edges, keys).join(leaving, [*keys, "state"], "left")
    return parts.select(*keys, F.to_json(F.struct(F.array("state").alias("states"), matrix.alias("transition_matrix"))).alias("model"))


def states_from_json(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States (keys, state) of JSON models in any number of documents."""
    return models.select(*keys, F.explode(F.from_json("model", MODEL)["states"]).alias("state")).distinct()


def edges_from_json(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge table (keys, s_from, s_to, p) of JSON models in any number of documents."""
    rows = models.select(*keys, F.explode(F.from_json("model", MODEL)["transition_matrix"]).alias("s_from", "_targets"))
    return rows.select(*keys, "s_from", F.explode("_targets").alias("s_to", "p"))


def save_fit(fit: DataFrame, path: str) -> None:
    fit.write.parquet(path)


def load_fit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "both") -> None:
    """A result table as JSON lines and/or CSV under `path`."""
    if fmt not in ("json", "csv", "both"):
        raise ValueError("fmt must be 'json', 'csv' or 'both'")
    if fmt in ("json", "both"):
        df.write.json(f"{path}/json", ignoreNullFields=False)
    if fmt in ("csv", "both"):
        df.write.option("header", True).csv(f"{path}/csv")


def write_metrics(entries: Sequence[DataFrame], path: str, fmt: str = "both") -> DataFrame | None:
    """Metric entries with differing columns as one table; returns it, or None when there are none."""
    if not entries:
        return None
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), entries)
    write_results(table, path, fmt)
    return table
