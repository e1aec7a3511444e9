"""Scaling and projection, fitted on training rows and applied to all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from motifline.plans.blocks import BLOCK_ROWS, attach, int_div

#: Values of the states that a task holds before it hands them on, and parts in which states of a key meet.
STATE_VALUES, STATE_PARTS = 1 << 22, 64


def _double(c: str):
    return F.col(c).cast("double")


def scale_fit(df: DataFrame, keys: Sequence[str], cols: Sequence[str], method: str = "minmax") -> DataFrame:
    """Per-key shift and divisor of every column: (min, max - min) or (mean, population std).

    A constant column gets divisor 1, so it is only shifted.
    """
    method = method.lower()
    if method not in ("minmax", "standard"):
        raise ValueError(f"unknown scaling method {method!r}: use 'minmax' or 'standard'")
    stats = []
    for c in cols:
        if method == "minmax":
            shift, span = F.min(_double(c)), F.max(_double(c)) - F.min(_double(c))
        else:
            shift, span = F.avg(_double(c)), F.stddev_pop(_double(c))
        stats += [shift.alias(f"{c}_shift"), F.when(span == 0, 1.0).otherwise(span).alias(f"{c}_span")]
    return df.groupBy(*keys).agg(*stats)


def scale_apply(df: DataFrame, fit: DataFrame, keys: Sequence[str], cols: Sequence[str], idx: str = "pos") -> DataFrame:
    """(value - shift) / divisor; values outside the training range are not clipped."""
    scaled = {c: (_double(c) - F.col(f"{c}_shift")) / F.col(f"{c}_span") for c in cols}
    return attach(df, fit, keys, int_div(idx, BLOCK_ROWS)).select(
        *[scaled[c].alias(c) if c in scaled else c for c in df.columns]
    )


def principal_axes(cov: np.ndarray, k: int) -> np.ndarray:
    """First k eigenvectors as rows; the largest loading of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(values)[::-1][:k]].T
    lead = np.argmax(np.round(np.abs(axes), 9), axis=1)
    return axes * np.where(axes[np.arange(len(axes)), lead] < 0, -1.0, 1.0)[:, None]


Moments = tuple[int, np.ndarray, np.ndarray]


def moments_of(x: np.ndarray) -> Moments:
    """Rows, means and centred products of the columns of `x`."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    d = x - mean
    return len(x), mean, d.T @ d


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of both sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if b[0] else a
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _moment_fields(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keys], *T.StructType.fromDDL("n long, means array<double>, products array<double>")])


def _co_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Moments of each key: one state a task and key, met in two steps. Any number of columns; rows with a null take no part."""
    m, schema = len(cols), _moment_fields(df, keys)
    types = [to_arrow_type(f.dataType) for f in schema]

    def rows_of(states: dict) -> pa.RecordBatch:
        columns = [*zip(*states), *zip(*[(n, mean, products.ravel()) for n, mean, products in states.values()])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Moments] = {}
        for b in batches:
            names = pa.table(b.columns[: len(keys)], names=list(keys)) if keys else None
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keys) :]])
            group = names.to_pandas().groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(x), dtype=int)
            order = np.argsort(group, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                key = tuple(names.column(i)[int(rows[0])].as_py() for i in range(len(keys)))
                part = moments_of(x[rows])
                states[key] = merged(states[key], part) if key in states else part
            if len(states) * m * m > STATE_VALUES:
                yield rows_of(states)
                states = {}
        if states:
            yield rows_of(states)

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, products = reduce(merged, [(a, np.asarray(b), np.asarray(c).reshape(m, m)) for a, b, c in zip(pdf["n"], pdf["means"], pdf["products"])])
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in keys}, "n": [n], "means": [mean], "products": [products.ravel()]})

    values = df.select(*keys, *[_double(c).alias(f"_x{i}") for i, c in enumerate(cols)]).dropna(subset=[f"_x{i}" for i in range(m)])
    parts = values.mapInArrow(task, schema)
    few = parts.withColumn("_part", F.pmod(F.xxhash64("n", "means"), F.lit(STATE_PARTS))).groupBy(*keys, "_part")
    return few.applyInPandas(lambda key, f: together(f), schema).groupBy(*keys).applyInPandas(together, schema)


def pca_fit(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int = 1) -> DataFrame:
    """Means and first k principal axes per key.

    One pass: each task keeps count, means and centred products of its rows, and these
    are merged in pairs. Output: keys, means, axes.
    """
    if not 1 <= k <= len(cols):
        raise ValueError("k must be between 1 and the number of columns")
    m = len(cols)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def axes(n: pd.Series, products: pd.Series) -> pd.Series:
        return pd.Series([principal_axes(np.asarray(p).reshape(m, m) / rows, k).tolist() for rows, p in zip(n, products)])

    return _co_moments(df, keys, cols).select(*keys, "means", axes("n", "products").alias("axes"))


def pca_apply(
    df: DataFrame, fit: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int = 1, idx: str = "pos"
) -> DataFrame:
    """Replace `cols` by `pc_1` … `pc_k`: the centred values along each axis."""

    def along(axis: int):
        terms = [
            (_double(c) - F.col("means")[i]) * F.col("axes")[axis][i] for i, c in enumerate(cols)
        ]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total.alias(f"pc_{axis + 1}")

    return attach(df, fit, keys, int_div(idx, BLOCK_ROWS)).select(
        *[c for c in df.columns if c not in cols], *[along(a) for a in range(k)]
    )
