"""Generated sensor series whose size follows a table of series lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.functions.columns import standard_normal, uniform
from motifline.plans.blocks import BLOCK_ROWS, halo, in_block


def synthetic_series(
    lengths: DataFrame,
    keys: Sequence[str],
    n_col: str = "n_rows",
    n_features: int = 8,
    span: float = 20.0,
    noise: float = 0.1,
    label_rate: float = 0.05,
    seed: int = 42,
    start: str = "2026-05-01 00:00:00",
) -> DataFrame:
    """`sensor_i` = sin over [0, span] plus Gaussian noise, random labels, one row a minute.

    Rows are made block by block, so a long series is spread over tasks.
    """
    n = F.col(n_col)
    blocks = lengths.select(*keys, n_col, F.expr(f"explode(sequence(0L, ({n_col} - 1) div {BLOCK_ROWS}))").alias("_b"))
    rows = (
        blocks.where(n > 0)
        .repartition(*keys, "_b")
        .select(*keys, n_col, F.expr(f"explode(sequence(_b * {BLOCK_ROWS}, least((_b + 1) * {BLOCK_ROWS}, {n_col}) - 1))").alias("pos"))
    )
    ident = [*[F.col(k) for k in keys], F.col("pos")]
    wave = F.expr(f"sin(pos * {float(span)!r}D / greatest({n_col} - 1, 1))")
    return rows.select(
        *keys,
        "pos",
        F.expr(
            f"timestamp_ntz'{start}' + make_dt_interval(cast(pos div 1440 as int), 0, cast(pos % 1440 as int))"
        ).alias("ts"),
        *[
            (wave + F.lit(noise) * standard_normal([*ident, F.lit(i)], seed)).alias(f"sensor_{i}")
            for i in range(n_features)
        ],
        (uniform([*ident, F.lit("label"), F.lit(seed)]) < label_rate).cast("int").alias("label"),
    )


def changepoint_flag(df: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """1 where the label differs from the row before, 0 on a series' first row."""
    before = F.lag("label").over(in_block(keys, "pos"))
    return (
        halo(df, "pos", 1, 0, block_rows)
        .withColumn("changepoint", F.coalesce((F.col("label") != before).cast("int"), F.lit(0)))
        .where("_own")
        .select(*df.columns, "changepoint")
    )
