"""Sliding-window detector: reconstruction error against a linear model per key.

Windows overlap almost completely, so they are never shuffled: a task gets one
block of a series plus the rows its last windows reach into and forms the
windows there as views. A fit needs no windows at all, only sums over lags.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifline.operators.scaling import principal_axes
from motifline.plans.blocks import BLOCK_ROWS, attach, halo, in_block, int_div, over_blocks, stage

WINDOWS_AT_ONCE = 4_096
SUM_PARTS = 64
#: Scores that are put in order to find a rank among them, and cuts of a range that holds more.
BAND_ROWS, CUTS = 65_536, 128


def sliding_windows(
    df: DataFrame, keys: Sequence[str], length: int, stride: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Arrays of `length` consecutive values with the position they start at.

    Series shorter than `length` give none.
    """
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be at least 1")
    block_rows = _wide(block_rows, length)
    frame = in_block(keys, "pos").rowsBetween(0, length - 1)
    return (
        halo(df.select(*keys, "pos", F.col("x").cast("double").alias("x")), "pos", 0, length - 1, block_rows)
        .withColumn("window", F.collect_list("x").over(frame))
        .where(F.col("_own") & (F.size("window") == length) & (F.pmod("pos", F.lit(stride)) == 0))
        .select(*keys, F.col("pos").alias("start"), "window")
    )


def _views(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and windows of one block with its trailing halo."""
    pdf = pdf.sort_values("pos")
    x, own = pdf["x"].to_numpy(dtype=float), pdf["_own"].to_numpy()
    if len(x) < length:
        return np.empty(0, dtype=np.int64), np.empty((0, length))
    starts = np.flatnonzero(own[: len(x) - length + 1])
    return pdf["pos"].to_numpy()[starts], np.lib.stride_tricks.sliding_window_view(x, length)[starts]


def _with_keys(out: pd.DataFrame, group: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    """Put the group's key values in front of `out`."""
    keys = {c: np.full(len(out), group[c].iloc[0] if len(group) else None, dtype=object) for c in names}
    return pd.concat([pd.DataFrame(keys, index=out.index), out], axis=1)


def _blocks(df: DataFrame, keys: Sequence[str], length: int, block_rows: int, *more: str) -> DataFrame:
    return halo(df.select(*keys, "pos", F.col("x").cast("double").alias("x"), *more), "pos", 0, length - 1, block_rows).select(
        *keys, "_block", "_own", "pos", "x", *more
    )


def _wide(block_rows: int, length: int) -> int:
    """Blocks are long beside the windows that reach over their end."""
    return max(block_rows, 10 * length)


def lag_products(x: np.ndarray, own: int, length: int) -> np.ndarray:
    """For each lag below `length`, the sum of x[s] * x[s + lag] over the first `own` places; what is missing counts as 0."""
    ahead = np.zeros(own + length - 1)
    ahead[: min(len(x), len(ahead))] = x[: len(ahead)]
    return np.correlate(ahead, ahead[:own], "valid")


def window_products(lags: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Sum of the outer products of all windows of a series, from its lag sums and its first and last length - 1 values.

    The entry (i, i + lag) is the lag's sum without the products that start in the first i
    places or end in the last ones that a window's place i + lag never reaches.
    """
    length = len(lags)
    out = np.empty((length, length))
    for lag in range(length):
        n = length - 1 - lag
        before = np.concatenate([[0.0], np.cumsum(head[:n] * head[lag:])])
        behind = np.concatenate([np.cumsum((tail[:n] * tail[lag:])[::-1])[::-1], [0.0]])
        at = np.arange(n + 1)
        out[at, at + lag] = out[at + lag, at] = lags[lag] - before - behind
    return out


def reconstruction_fit(
    train: DataFrame, keys: Sequence[str], length: int, k: int = 1, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean window and first k principal axes of the training windows of each key.

    Neighbouring windows share all but their ends, so the sum of their products follows
    from one sum for each lag and the ends of the series (`window_products`). Blocks add up
    `length` lag sums over their rows; a few blocks' sums and the ends are all that is
    brought together. Series shorter than `length` give no fit.
    """
    if not 1 <= k <= length:
        raise ValueError("k must be between 1 and length")
    names, key_fields, block_rows = list(keys), [train.schema[c] for c in keys], _wide(block_rows, length)

    def lag_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, pos, own, n = pdf["x"].to_numpy(dtype=float), pdf["pos"].to_numpy(), pdf["_own"].to_numpy(), pdf["_rows"].iloc[0]
        mine = int(own.sum())  # copies follow the block's own rows
        end = own & ((pos < length - 1) | (pos > n - length))
        row = {"lags": [lag_products(x, mine, length)], "total": x[:mine].sum(), "rows": n, "centre": pdf["_centre"].iloc[0], "at": [pos[end]], "ends": [x[end]]}
        return _with_keys(pd.DataFrame(row), pdf, names)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"lags": [np.sum(np.stack(pdf["lags"].to_numpy()), axis=0)], "total": pdf["total"].sum(), "rows": pdf["rows"].iloc[0], "centre": pdf["centre"].iloc[0]}
        return _with_keys(pd.DataFrame({**row, **{c: [np.concatenate(pdf[c].to_numpy())] for c in ("at", "ends")}}), pdf, names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = added(pdf).iloc[0]
        n, ends = int(whole["rows"]), whole["ends"][np.argsort(whole["at"])]
        at = np.sort(whole["at"])
        head, tail = ends[at < length - 1], ends[at > n - length]
        windows = n - length + 1
        # The sum of the values at place i of all windows leaves out i values at the head and the rest at the tail.
        out = np.concatenate([[0.0], np.cumsum(head)]) + np.concatenate([np.cumsum(tail[::-1])[::-1], [0.0]])
        mean = (whole["total"] - out) / windows
        axes = principal_axes(window_products(whole["lags"], head, tail) / windows - np.outer(mean, mean), k)
        row = {c: [pdf[c].iloc[0]] for c in names}
        return pd.DataFrame({**row, "means": [(mean + whole["centre"]).tolist()], "axes": [axes.tolist()]})

    numbers = T.ArrayType(T.DoubleType())
    sums = T.StructType([*key_fields, *T.StructType.fromDDL("lags array<double>, total double, rows long, centre double, at array<long>, ends array<double>")])
    # Values are taken from the key's mean first: sums of large values' squares would lose their differences.
    centre = train.groupBy(*keys).agg(F.avg(F.col("x").cast("double")).alias("_centre"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= length)
    centred = attach(train.drop("_rows"), centre, keys, int_div("pos", BLOCK_ROWS)).withColumn("x", F.col("x").cast("double") - F.col("_centre"))
    parts = _blocks(centred, keys, length, block_rows, "_centre", "_rows").groupBy(*keys, "_block").applyInPandas(lag_sums, sums)
    # Lag sums of one block each, added up in two steps.
    few = parts.withColumn("_part", F.pmod(F.xxhash64("total", "at"), F.lit(SUM_PARTS))).groupBy(*keys, "_part").applyInPandas(lambda key, f: added(f), sums)
    return few.groupBy(*keys).applyInPandas(
        solve, T.StructType([*key_fields, T.StructField("means", numbers), T.StructField("axes", T.ArrayType(numbers))])
    )


def reconstruction_error(
    df: DataFrame,
    fit: DataFrame,
    keys: Sequence[str],
    length: int,
    fit_keys: Sequence[str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean squared difference between each window and its projection on the axes.

    `fit_keys` are the keys of `fit` when it has fewer than the series. Output:
    keys, start, score.
    """
    fit_keys = list(fit_keys if fit_keys is not None else keys)
    names, block_rows = list(keys), _wide(block_rows, length)
    sizes = df.groupBy(*keys).agg(F.max("n").alias("_n"))
    # Own column names: both sides may come from one frame and would be told apart by nothing else.
    model = over_blocks(sizes.join(fit, fit_keys), "_n", block_rows).select(
        *[F.col(c).alias(f"_m_{c}") for c in [*keys, "_block"]], "means", "axes"
    )

    def score(pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(fitted):
            return _with_keys(pd.DataFrame({"start": np.empty(0, dtype=np.int64), "score": np.empty(0)}), pdf, names)
        starts, w = _views(pdf, length)
        axes = np.array([np.asarray(a, dtype=float) for a in fitted["axes"].iloc[0]])
        means = np.asarray(fitted["means"].iloc[0], dtype=float)
        scores = np.empty(len(w))
        for i in range(0, len(w), WINDOWS_AT_ONCE):
            d = w[i : i + WINDOWS_AT_ONCE] - means
            rest = d - (d @ axes.T) @ axes
            scores[i : i + WINDOWS_AT_ONCE] = np.mean(rest * rest, axis=1)
        out = pd.DataFrame({"start": starts, "score": scores})
        return _with_keys(out, pdf, names)

    schema = T.StructType(
        [
            *[df.schema[c] for c in keys],
            T.StructField("start", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return (
        _blocks(df, keys, length, block_rows)
        .groupBy(*keys, "_block")
        .cogroup(model.groupBy(*[f"_m_{c}" for c in [*keys, "_block"]]))
        .applyInPandas(score, schema)
    )


def _in_band(values: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values between `lo` and `hi` of each target, with its number `which`."""
    bands = targets.groupBy(*keys).agg(F.collect_list(F.struct("which", "lo", "hi")).alias("_bands"))
    met = attach(values, bands, keys, F.pmod(F.xxhash64("_x"), F.lit(1024)))
    return met.select(*keys, "_x", F.expr("inline(filter(_bands, b -> _x between b.lo and b.hi))")).select(*keys, "which", "_x")


def _narrowed(values: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets with the part of their band that holds their rank.

    Quantiles cut the band; a cell is the values between two cuts or those equal to one.
    The cuts may be rough: counts of the cells say where the rank lies.
    """
    on = [*keys, "which"]
    inside = _in_band(values, targets, keys)
    grid = F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)])
    cuts = inside.groupBy(*on).agg(F.array_distinct(F.percentile_approx("_x", grid, 8 * CUTS)).alias("_cuts"))
    cell = "2 * size(filter(_cuts, c -> c < _x)) + if(array_contains(_cuts, _x), 1, 0)"
    met = attach(inside, cuts, on, F.pmod(F.xxhash64("_x"), F.lit(1024))).groupBy(*on, F.expr(cell).alias("_cell"))
    cells = met.agg(F.count(F.lit(1)).alias("rows"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    upto = F.sum("rows").over(Window.partitionBy(*on).orderBy("_cell"))  # at most 2 * CUTS + 3 cells
    placed = cells.withColumn("_before", upto - F.col("rows")).join(targets.select(*on, "rank"), on)
    return placed.where("rank >= _before and rank < _before + rows").select(*on, F.expr("rank - _before").alias("rank"), "lo", "hi", "rows")


def percentile_threshold(scores: DataFrame, keys: Sequence[str], p: float = 0.95, score: str = "score") -> DataFrame:
    """Percentile of the scores per key, interpolated linearly between ranks.

    Exact selection without a sort of the scores: the range that holds a rank is narrowed
    by counts until it has at most BAND_ROWS scores or a single value, and only what is in
    it is ordered. Null scores take no part.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be between 0 and 1")
    on = [*keys, "which"]
    values = scores.select(*keys, F.col(score).cast("double").alias("_x")).where("_x is not null")
    whole = stage(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    rank = (F.col("rows") - 1) * F.lit(p)
    # The two neighbouring ranks are looked for side by side.
    targets = whole.withColumn("which", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *on, F.least(F.floor(rank) + F.col("which"), F.col("rows") - 1).alias("rank"), "lo", "hi", "rows"
    )
    wide = F.expr(f"rows > {BAND_ROWS} and lo < hi")
    while not targets.where(wide).isEmpty():
        targets = stage(_narrowed(values, targets.where(wide), keys).unionByName(targets.where(~wide)))
    counted = _in_band(values, targets, keys).groupBy(*on, "_x").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*on).orderBy("_x"))
    found = counted.withColumn("_upto", upto).join(targets.select(*on, "rank"), on).where("rank < _upto and rank >= _upto - _n")
    two = found.groupBy(*keys).agg(F.max(F.expr("if(which = 0, _x, null)")).alias("_low"), F.max(F.expr("if(which = 1, _x, null)")).alias("_next"))
    return two.join(whole, list(keys)).select(*keys, (F.col("_low") + (F.col("_next") - F.col("_low")) * (rank - F.floor(rank))).alias("threshold"))


def flag_above(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """`pred` is 1 where the score is strictly above the key's threshold."""
    salt = F.pmod(F.xxhash64(score), F.lit(1024))
    return attach(scores, thresholds, keys, salt).withColumn("pred", (F.col(score) > F.col("threshold")).cast("int"))
