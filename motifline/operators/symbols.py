"""From numbered series to letters, patterns and pattern labels.

A series frame has key columns, `pos` (0-based), `n` (rows of the key), `x` and
optionally `label`; `with_position` makes one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifline.functions.columns import breakpoints, letter, letter_sql, z_score
from motifline.plans.blocks import BLOCK_ROWS, attach, halo, in_block, int_div, over_blocks


def ordered_stats(df: DataFrame, keys: Sequence[str], col: str, idx: str, *more: Column) -> DataFrame:
    """Mean and population deviation of each key, the same to the last bit on every run.

    Sums of doubles depend on their order, so a block of rows is added up in the order of
    `idx` and the blocks' results in theirs, however the rows are dealt. `more` are further
    aggregates of a block; of each, the largest is kept.
    """
    add = (
        "aggregate(array_sort(collect_list(struct(`{0}` as i, cast(`{1}` as double) as v))), struct(0L as n, 0D as mean, 0D as m2), (a, r) ->"
        " struct(a.n + 1 as n, a.mean + (r.v - a.mean) / (a.n + 1) as mean,"
        " a.m2 + (r.v - a.mean) * (r.v - (a.mean + (r.v - a.mean) / (a.n + 1))) as m2))"
    )
    meet = (
        "aggregate(array_sort(collect_list(struct(_part as i, _sums as s))), struct(0L as n, 0D as mean, 0D as m2), (a, r) -> if(a.n = 0, r.s,"
        " struct(a.n + r.s.n as n, a.mean + (r.s.mean - a.mean) * r.s.n / (a.n + r.s.n) as mean,"
        " a.m2 + r.s.m2 + (r.s.mean - a.mean) * (r.s.mean - a.mean) * a.n * r.s.n / (a.n + r.s.n) as m2)))"
    )
    parts = df.where(F.col(col).isNotNull()).groupBy(*keys, int_div(idx, BLOCK_ROWS).alias("_part")).agg(F.expr(add.format(idx, col)).alias("_sums"), *[c.alias(f"_more{i}") for i, c in enumerate(more)])
    whole = parts.groupBy(*keys).agg(F.expr(meet).alias("_all"), *[F.max(f"_more{i}").alias(f"_more{i}") for i in range(len(more))])
    return whole.select(*keys, F.col("_all.mean").alias("_mean"), F.expr("sqrt(_all.m2 / _all.n)").alias("_std"), *[f"_more{i}" for i in range(len(more))])


def z_normalize(df: DataFrame, keys: Sequence[str], col: str = "x", out: str = "z", idx: str = "pos") -> DataFrame:
    """Population z-score per key; a constant series becomes all 0."""
    stats = ordered_stats(df, keys, col, idx)
    return attach(df, stats, keys, int_div(idx, BLOCK_ROWS)).select(*df.columns, z_score(col).alias(out))


def paa(df: DataFrame, keys: Sequence[str], segment_size: int) -> DataFrame:
    """Means of non-overlapping blocks of `segment_size` values.

    The remainder is dropped; a series shorter than one block gives its mean.
    `seg_label` is 1 when any label in the block equals 1, and null for a series
    shorter than one block. Doubles are added up in the order of their size, so that a mean
    does not depend on how the rows are dealt; sums of other types are exact anyway.
    """
    size = max(segment_size, 1)
    label = "coalesce(label, 0)" if "label" in df.columns else "0"
    rough = isinstance(df.schema["x"].dataType, (T.DoubleType, T.FloatType))
    total = "aggregate(array_sort(collect_list(cast(x as double))), 0D, (a, v) -> a + v)" if rough and size > 1 else "cast(sum(x) as double)"
    return (
        df.where(f"n < {size} or pos < n - n % {size}")
        .groupBy(*keys, F.expr(f"pos div {size}").alias("seg"))
        .agg(
            F.expr(f"if(count(x) = 0, null, {total} / count(x))").alias("paa"),
            F.expr(f"max(if(n >= {size}, cast({label} = 1 as int), null))").alias("seg_label"),
            F.expr(f"max(greatest(n div {size}, 1))").alias("n_seg"),
        )
    )


def _paa_stats(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ordered_stats(segments, keys, "paa", "seg", F.max("n_seg")).withColumnRenamed("_more0", "_n")


def sax_letters(
    segments: DataFrame, keys: Sequence[str], alphabet_size: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add `z` (z-score of the segment means) and its `letter`."""
    breakpoints(alphabet_size)
    stats = over_blocks(_paa_stats(segments, keys), "_n", block_rows)
    return (
        segments.withColumn("_block", int_div("seg", block_rows))
        .join(stats, [*keys, "_block"])
        .select(*segments.columns, z_score("paa").alias("z"))
        .select("*", letter("z", alphabet_size).alias("letter"))
    )


def sax_string(letters: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Letters joined in order, one string per `chunk` of `block_rows` segments.

    Chunks keep the string of a very long series out of one row; the strings of
    a key's chunks, in order, are its whole symbol string.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seg", "letter")))
    return letters.groupBy(*keys, int_div("seg", block_rows).alias("chunk")).agg(
        F.array_join(F.transform(ordered, lambda s: s["letter"]), "").alias("symbols")
    )


def extract_patterns(
    letters: DataFrame, keys: Sequence[str], window: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All runs of `window` letters, stride 1, numbered by their first segment."""
    if window < 1:
        raise ValueError("window must be at least 1")
    order = in_block(keys, "seg")
    return (
        halo(letters.select(*keys, "seg", "letter"), "seg", 0, window - 1, block_rows)
        .withColumn("pattern", F.concat(*[F.lead("letter", j).over(order) for j in range(window)]))
        .where(F.col("_own") & F.col("pattern").isNotNull())
        .select(*keys, "seg", "pattern")
    )


def unique_states(patterns: DataFrame, keys: Sequence[str]) -> DataFrame:
    return patterns.select(*keys, F.col("pattern").alias("state")).distinct()


def align_labels(
    df: DataFrame, keys: Sequence[str], segment_size: int, window: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Label of each pattern: 1 when any raw label under it equals 1."""
    if segment_size < 1 or window < 1:
        raise ValueError("segment_size and window must be at least 1")
    segments = (
        df.where(F.col("pos") < F.col("n") - F.pmod(F.col("n"), F.lit(segment_size)))
        .groupBy(*keys, int_div("pos", segment_size).alias("seg"))
        .agg(F.max((F.coalesce(F.col("label"), F.lit(0)) == 1).cast("int")).alias("label"))
    )
    order = in_block(keys, "seg")
    ahead = [F.lead("label", j).over(order) for j in range(window)]
    return (
        halo(segments, "seg", 0, window - 1, block_rows)
        .withColumn("_last", ahead[-1])
        .withColumn("label", F.greatest(*ahead) if window > 1 else F.col("label"))
        .where(F.col("_own") & F.col("_last").isNotNull())
        .select(*keys, "seg", "label")
    )


def grams(
    segments: DataFrame,
    keys: Sequence[str],
    alphabets: Sequence[int],
    windows: Sequence[int],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Patterns with the one before them, for every alphabet and window asked for.

    Output per step: `alphabet_size`, `window_size`, `seg`, `label` and `gram`.
    `gram` is the pattern preceded by the previous pattern's first letter, so a
    gram of window+1 letters holds both ends of a transition; the first step of
    a series has a gram of just window letters.

    One window pass serves all parameters: the letters of all alphabets travel
    as one short code per segment and the combinations are unfolded afterwards.
    """
    if min(windows) < 1:
        raise ValueError("window must be at least 1")
    for a in alphabets:
        breakpoints(a)
    reach = max(windows) - 1
    stats = over_blocks(_paa_stats(segments, keys), "_n", block_rows)
    code = ", ".join(letter_sql("_z", a) for a in alphabets)
    coded = (
        halo(segments.select(*keys, "seg", "paa", "seg_label"), "seg", 1, reach, block_rows)
        .join(stats, [*keys, "_block"])
        .select(*keys, "_block", "_own", "seg", "seg_label", z_score("paa").alias("_z"))
        .select(*keys, "_block", "_own", "seg", "seg_label", F.expr(f"concat({code})").alias("_code"))
    )
    over = f"over (partition by {', '.join(f'`{k}`' for k in keys)}, _block order by seg)"
    seen = coded.selectExpr(
        *[f"`{k}`" for k in keys], "_block", "_own", "seg",
        f"coalesce(lag(_code, 1) {over}, '') as _before",
        *[f"lead(_code, {j}) {over} as _c{j}" for j in range(reach + 1)],
        *[f"lead(seg_label, {j}) {over} as _y{j}" for j in range(reach + 1)],
    ).where("_own")
    steps = []
    for i, a in enumerate(alphabets, start=1):
        for w in windows:
            gram = ", ".join(f"substring({c}, {i}, 1)" for c in ["_before", *[f"_c{j}" for j in range(w)]])
            label = f"greatest({', '.join(f'_y{j}' for j in range(w))})" if w > 1 else "_y0"
            steps.append(
                f"named_struct('alphabet_size', {a}, 'window_size', {w}, 'gram', concat({gram}), 'label', {label})"
            )
    return (
        seen.select(*keys, "seg", "_block", F.expr(f"inline(array({', '.join(steps)}))"))
        .where("gram is not null")
        .select(*keys, "alphabet_size", "window_size", "seg", "_block", "gram", "label")
    )
