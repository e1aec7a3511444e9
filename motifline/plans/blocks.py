"""Plan shapes that keep a series of any length out of a single task.

A series key may hold a third of all rows, so no plan here collects, sorts or
windows a whole key in one task:

* `with_position` numbers rows through one range sort over (keys, order); where keys are
  many, only the long ones need that, the others are numbered in a window of bounded size;
* `halo` cuts a numbered series into blocks and copies only the edge rows;
* `over_blocks` and `attach` bring one-row-per-key tables to the rows with the
  block number in the join key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 65_536
BROADCAST_BYTES = 64 << 20

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from `spark.checkpoint.dir`.

    Only a local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/motifline/{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_folders:
        _local_folders[sc.applicationId] = tempfile.TemporaryDirectory(prefix="motifline-")
    return _local_folders[sc.applicationId].name


def stage_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends here."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _measured_bytes(df: DataFrame) -> int:
    """Size of the values of `df`: 16 bytes a field, and what strings and arrays hold."""
    parts = [f"count(1) * {16 * len(df.columns)}"]
    for f in df.schema:
        if isinstance(f.dataType, T.StringType):
            parts.append(f"sum(length(`{f.name}`))")
        elif isinstance(f.dataType, T.ArrayType):
            nested = isinstance(f.dataType.elementType, T.ArrayType)
            parts.append(f"8 * sum(size({f'flatten(`{f.name}`)' if nested else f'`{f.name}`'}))")
    return df.agg(F.expr(" + ".join(f"coalesce({p}, 0)" for p in parts)).alias("bytes")).first().bytes


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """Stage a lookup table, measure it, and mark it for broadcast up to `limit` bytes."""
    staged = stage(df)
    small = _measured_bytes(staged) <= limit
    return (F.broadcast(staged) if small else staged), small


def int_div(a: str, b: int) -> Column:
    return F.expr(f"{a} div {b}")


def _without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`df`, which fails where a key column is null."""
    if not keys:
        raise ValueError("at least one key column is needed")
    checked = df
    for k in keys:
        failed = F.raise_error(F.lit(f"null in key column {k}")).cast(df.schema[k].dataType)
        checked = checked.withColumn(k, F.coalesce(F.col(k), failed))
    return checked


def _sorted_parts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    keep: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Staged copy of `df` in (keys, order) order, with the keys and the columns to `keep`.

    `_part` is the sort task, `_row` the row's index inside it. Unless the order
    is `unique`, a hash and the scan id break ties, so copies of one row still
    spread over tasks. The result is written out because range bounds come from
    a sample: computing them twice could give two different answers.
    """
    checked = _without_null_keys(df, keys)
    if unique:
        ordered = checked.orderBy(*keys, *order)
    else:
        copies = checked.withColumn("_copy", F.monotonically_increasing_id())
        ordered = copies.orderBy(*keys, *order, F.xxhash64(*df.columns), "_copy")
    kept = df.columns if keep is None else [*keys, *keep]
    return stage(
        ordered.select(*kept, F.monotonically_increasing_id().alias("_id")).selectExpr(
            *[f"`{c}`" for c in kept], "cast(shiftright(_id, 33) as int) as _part", f"_id & {(1 << 33) - 1}L as _row"
        )
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    keep: Sequence[str] | None = None,
    unique: bool = False,
    pos: str = "pos",
    n: str = "n",
    many: bool = False,
    most_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the 0-based row number `pos` within each key and the key's row count `n`.

    Name the columns to `keep` besides the keys where the order columns are no
    longer needed, and say so when keys and order are `unique`: both spare the
    sort a part of its shuffle and of what it writes.

    The join with the staged spans is a broadcast only while their file is below
    `spark.sql.autoBroadcastJoinThreshold`; else it shuffles by (keys, sort task),
    where no group is larger than one sort task.

    Say `many` when the keys are many and most are short. Keys are counted first, and those
    of up to `most_rows` rows are numbered in one window by key: one shuffle, which what
    is then grouped by key shares, no spans and no join. Their rows are not written, so
    stage the result if it is read more than once. Longer keys, at most one in
    `most_rows` rows, go the way of the range sort.
    """
    if many:
        return _many_positions(df, keys, order, keep, unique, pos, n, most_rows)
    rows = _sorted_parts(df, keys, order, keep, unique)
    kept = [c for c in rows.columns if c not in ("_part", "_row")]
    by_key = Window.partitionBy(*keys)
    spans = (
        rows.groupBy(*keys, "_part")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            "_part",
            (F.sum("_rows").over(by_key.orderBy("_part")) - F.col("_rows") - F.col("_first")).alias("_shift"),
            F.sum("_rows").over(by_key).alias(n),
        )
    )
    return rows.join(stage(spans), [*keys, "_part"]).select(*kept, F.expr("_row + _shift").alias(pos), n)


def _many_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    keep: Sequence[str] | None,
    unique: bool,
    pos: str,
    n: str,
    most_rows: int,
) -> DataFrame:
    short = _without_null_keys(df, keys)
    long = stage(short.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most_rows).select(*keys))
    some_long = not long.isEmpty()
    if some_long:
        short = short.join(F.broadcast(long), list(keys), "left_anti").select(*df.columns)
    kept = df.columns if keep is None else [*keys, *keep]
    # Ties go by the same hash as in the range sort, so a row's position does not depend on the way taken.
    # The rows are dealt first: the hash need not travel.
    short = short.repartition(*keys)
    by_key = Window.partitionBy(*keys).orderBy(*order, *([] if unique else [F.xxhash64(*df.columns)]))
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = short.select(
        *kept, (F.row_number().over(by_key) - 1).cast("long").alias(pos), F.count(F.lit(1)).over(whole).alias(n)
    )
    if not some_long:
        return numbered
    rest = df.join(F.broadcast(long), list(keys), "left_semi").select(*df.columns)
    return numbered.unionByName(with_position(rest, keys, order, keep, unique, pos, n))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: dict[str, str | Column],
    keep: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key: `totals` maps new column -> summed column.

    `keep` are the columns that stay (all without it), `unique` as in `with_position`.
    """
    kept = list(keep if keep is not None else df.columns)
    rows = _sorted_parts(df, keys, order, [c for c in kept if c not in keys], unique)
    spans = rows.groupBy(*keys, "_part").agg(*[F.sum(src).alias(f"_b_{new}") for new, src in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_b_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in totals]
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_row")
    sums = [(F.sum(src).over(inside) + F.col(f"_b_{new}")).alias(new) for new, src in totals.items()]
    return rows.join(stage(spans), [*keys, "_part"]).select(*kept, *sums)


def halo(
    df: DataFrame, idx: str, before: int, after: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut rows into blocks of `block_rows` consecutive `idx` values.

    Rows up to `after` behind a block's end and `before` ahead of its start are
    copied into the block. `_block` is the block, `_own` is false on copies.
    """
    if block_rows < 10 * max(before, after, 1):
        raise ValueError(f"a block of {block_rows} rows is too small for a reach of {max(before, after)}")
    own = f"{idx} div {block_rows}"
    inside = f"{idx} % {block_rows}"
    targets = (
        f"array_compact(array({own}, if({inside} < {after} and {idx} >= {block_rows}, {own} - 1, null),"
        f" if({inside} >= {block_rows - before}, {own} + 1, null)))"
    )
    return df.select("*", F.expr(f"explode({targets})").alias("_block")).select(
        "*", F.expr(f"_block = {own}").alias("_own")
    )


def over_blocks(per_key: DataFrame, n: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Repeat each one-row-per-key record for the blocks of its `n` rows."""
    return per_key.withColumn("_block", F.expr(f"explode(sequence(0L, ({n} - 1) div {block_rows}))"))


def in_block(keys: Sequence[str], idx: str):
    return Window.partitionBy(*keys, "_block").orderBy(idx)


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str], salt: Column, how: str = "inner") -> DataFrame:
    """Join a table with one row per `on` to many rows per `on`.

    Broadcast while the measured table is small. Beyond that the join key gets
    `salt`, and the table is repeated only for the salts its key really has.
    """
    small, fits = if_small(table)
    if fits:
        return rows.join(small, list(on), how)
    salted = rows.withColumn("_salt", salt)
    used = salted.select(*on, "_salt").distinct()
    return salted.join(used.join(small, list(on)), [*on, "_salt"], how).drop("_salt")
