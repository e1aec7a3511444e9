"""Leak-free splits: chronological roles and grouped folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.plans.blocks import BLOCK_ROWS, attach, int_div, running_totals, stage, with_position


def chrono_split(df: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Split numbered series into train, val and test by position.

    Needs `pos` and `n`; replaces them by the position and row count within the role.
    """
    n, pos = F.col("n"), F.col("pos")
    train_end = F.floor(n * F.lit(train))
    val_end = train_end + F.floor(n * F.lit(val))

    def by_role(in_train: Column, in_val: Column, in_test: Column) -> Column:
        return F.when(pos < train_end, in_train).when(pos < val_end, in_val).otherwise(in_test)

    return df.select(
        *[c for c in df.columns if c not in ("pos", "n")],
        by_role(F.lit("train"), F.lit("val"), F.lit("test")).alias("role"),
        by_role(pos, pos - train_end, pos - val_end).alias("pos"),
        by_role(train_end, val_end - train_end, n - val_end).alias("n"),
    )


def distinct_groups(df: DataFrame, group_col: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(group_col).alias("groups"))


def _let(value: str, name: str, body: str) -> str:
    """SQL that uses `value` several times and works it out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _on_level(loads: str, size: str, items: str, body: str) -> str:
    """SQL `body` over `_q` and `_order` after `items` groups of one size went to the lightest folds.

    Group j of a fold is taken at load + j * size: quotient and rest by the size tell when.
    All folds are filled below quotient `_q`, the largest level whose groups are not more
    than there are; it is a minimum over the lightest folds, taken one by one. Those beyond
    it go, by rest and fold number, to the folds in `_order`; `_past` is how many these are.
    """
    sorted_ = f"array_sort(transform({loads}, l -> l div {size}))"
    least = f"aggregate({sorted_}, struct(0L as n, 0L as s, {(1 << 62)}L as q), (a, q) -> struct(a.n + 1 as n, a.s + q as s, least(a.q, ({items} + a.s + q) div (a.n + 1)) as q), a -> a.q)"
    filled = f"aggregate({loads}, 0L, (a, l) -> a + greatest(_q - l div {size}, 0L))"
    order = f"transform(array_sort(filter(transform({loads}, (l, f) -> struct(l % {size} as r, f as f, l div {size} as q)), x -> x.q <= _q)), x -> x.f)"
    return _let(least, "_q", _let(f"{items} - {filled}", "_past", _let(order, "_order", body)))


def _loads_after(loads: str, size: str, items: str) -> str:
    more = f"greatest(_q - l div {size}, 0L) + if(array_position(_order, f) between 1 and _past, 1L, 0L)"
    return _on_level(loads, size, items, f"transform({loads}, (l, f) -> l + {size} * ({more}))")


def _fold_of(loads: str, size: str, rank: str) -> str:
    """Fold of a group that has `rank` others of its size before it."""
    return _on_level(loads, size, rank, "_order[cast(_past as int)]")


CHUNK = 128


def _loads_before(classes: str, folds: str) -> str:
    """SQL array of (size, loads before the groups of that size) for `classes` (size, groups), largest size first.

    A chunk's entries are gathered first and handed on as one: no long list is copied for each class.
    """
    step = f"struct({_loads_after('a.loads', 'c.size', 'c.groups')} as loads, array_append(a.done, struct(c.size as size, a.loads as loads)) as done)"
    none = "cast(array() as array<struct<size: bigint, loads: array<bigint>>>)"
    inner = f"aggregate(slice({classes}, i, {CHUNK}), struct(o.loads as loads, {none} as done), (a, c) -> {step})"
    lists = "cast(array() as array<array<struct<size: bigint, loads: array<bigint>>>>)"
    outer = _let(inner, "m", "struct(m.loads as loads, array_append(o.done, m.done) as done)")
    return f"flatten(aggregate(sequence(1, size({classes}), {CHUNK}), struct(transform(sequence(1, {folds}), x -> 0L) as loads, {lists} as done), (o, i) -> {outer}, o -> o.done))"


def group_kfold(df: DataFrame, group_col: str, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Fold of every group: largest first into the lightest fold.

    Equal sizes go by name, last name first; equal loads by fold number. k is
    lowered to the number of groups. Output: keys, group, rows, fold, folds.

    Only the distinct sizes are walked in order, as column arithmetic in one row of each
    key: at most sqrt(2 * rows) of them for any number of groups. Groups of one size find
    their fold from their rank.
    """
    sizes = df.groupBy(*keys, group_col).agg(F.count(F.lit(1)).alias("rows"))
    ranked = with_position(sizes, [*keys, "rows"], [F.desc(group_col)], unique=True, pos="_rank", n="_same")
    counted = ranked.groupBy(*keys, F.col("rows").alias("size")).agg(F.count(F.lit(1)).alias("groups"))
    largest_first = "transform(array_sort(collect_list(struct(-size as _s, size, groups))), c -> struct(c.size, c.groups))"
    classes = counted.groupBy(*keys).agg(F.expr(largest_first).alias("_classes"), F.sum("groups").alias("_groups"))
    few = f"raise_error('grouped folds need at least 2 distinct values of {group_col}')"
    folds = classes.select(*keys, "_classes", F.expr(f"if(_groups < 2, cast({few} as int), cast(least({k}, _groups) as int))").alias("folds"))
    loads = folds.select(*keys, "folds", F.expr(f"inline({_loads_before('_classes', 'folds')})").alias("rows", "_loads"))
    return attach(ranked, loads, [*keys, "rows"], F.pmod("_rank", F.lit(1024))).select(
        *keys, group_col, "rows", F.expr(_fold_of("_loads", "rows", "_rank")).alias("fold"), "folds"
    )


def fold_roles(
    df: DataFrame,
    folds: DataFrame,
    group_col: str,
    keys: Sequence[str],
    order: Sequence[str],
    val: float = 0.2,
    keep: Sequence[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Long format of all folds: each row once per fold, with its role there.

    A fold's own groups are its test rows. Of the others, in order, the last
    `int(val * rows)` are val and the rest train; when that is 0, val is empty.
    Adds `fold`, `role` and the position `pos` and row count `n` within both;
    `keep` and `unique` are those of `with_position`.

    Rows are sorted and written once, whatever the number of folds, with running counts of
    each fold's own rows. A row's position among the others of a fold is its own less the
    fold's rows before it, so the copies for the folds need no order and are made last.
    """
    staged = stage(folds)
    most = staged.agg(F.max("folds")).first()[0] or 0
    salt = F.pmod(F.xxhash64(*order), F.lit(1024))
    placed = attach(df, staged.select(*keys, group_col, F.col("fold").alias("_test")), [*keys, group_col], salt)
    kept = [*(df.columns if keep is None else [*keys, *keep]), "_test"]
    counts = {f"_upto{f}": F.expr(f"if(_test = {f}, 1L, 0L)") for f in range(most)}
    counted = running_totals(placed, keys, order, {"_upto": F.lit(1).cast("long"), **counts}, kept, unique)
    sizes = staged.groupBy(*keys, "fold", "folds").agg(F.sum("rows").alias("rows")).groupBy(*keys, "folds").agg(
        F.expr("transform(array_sort(collect_list(struct(fold, rows))), x -> x.rows)").alias("_sizes")
    )
    each = (
        attach(counted, sizes, keys, int_div("_upto", BLOCK_ROWS))
        .withColumn("_own", F.array(*counts))
        .withColumn("fold", F.expr("explode(sequence(0, folds - 1))"))
        .withColumns({"_held_out": F.col("fold") == F.col("_test"), "_mine": F.expr("_own[fold]"), "_rows": F.expr("_sizes[fold]")})
        .withColumns({
            "pos": F.expr("if(_held_out, _mine, _upto - _mine) - 1"),
            "n": F.expr("if(_held_out, _rows, aggregate(_sizes, 0L, (a, s) -> a + s) - _rows)"),
        })
    )
    train_end = F.col("n") - F.floor(F.col("n") * F.lit(val))
    in_val = F.col("pos") >= train_end
    return each.select(
        *[c for c in kept if c not in ("_test", "pos", "n", "folds")], "fold",
        F.when(F.col("_held_out"), "test").when(in_val, "val").otherwise("train").alias("role"),
        F.when(~F.col("_held_out") & in_val, F.col("pos") - train_end).otherwise(F.col("pos")).alias("pos"),
        F.when(F.col("_held_out"), F.col("n")).when(in_val, F.col("n") - train_end).otherwise(train_end).alias("n"),
    )
