"""Transition model over patterns, nearest known states and explained paths.

Everything about a step depends only on its `gram` (the pattern and the one
before it). So grams are counted first and only the distinct ones are scored;
rows get their score back through a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifline.operators.nearest import nearest_states
from motifline.plans.blocks import attach

THRESHOLD = 0.05


def gram_pattern() -> Column:
    return F.expr("right(gram, window_size)")


def gram_previous() -> Column:
    return F.expr("if(length(gram) > window_size, left(gram, window_size), null)")


def _and(keys: Sequence[str], *more: str) -> list[str]:
    return list(dict.fromkeys([*keys, *more]))


def count_steps(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps counted by gram and label, with the first segment each was seen at."""
    return steps.groupBy(*_and(keys, "window_size", "gram", "label")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("seg").alias("first_seg")
    )


def transition_counts(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each pattern follows each other one, and where it first did.

    `steps` are rows of `grams`, or the smaller table `count_steps` makes of them.
    """
    counted = steps if "cnt" in steps.columns else count_steps(steps, keys)
    # Counted steps are few, so they go straight to where `transition_probs` needs them.
    return (
        counted.where("length(gram) > window_size")
        .select(*keys, gram_previous().alias("s_from"), gram_pattern().alias("s_to"), "cnt", "first_seg")
        .repartition(*keys, "s_from")
        .groupBy(*keys, "s_from", "s_to")
        .agg(F.sum("cnt").alias("cnt"), F.expr("min(first_seg) - 1").alias("first_seg"))
    )


def transition_probs(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count divided by all transitions leaving the same state."""
    leaving = F.sum("cnt").over(Window.partitionBy(*keys, "s_from"))
    return counts.withColumn("p", F.col("cnt") / leaving)


def fit_automaton(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edge table: keys, s_from, s_to, cnt, first_seg, p.

    Series with fewer than two patterns have no edge and so no model.
    """
    return transition_probs(transition_counts(steps, keys), keys)


def state_set(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every pattern that is the source or the target of an edge."""
    return _ends(edges, keys).distinct()


def source_state_count(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(F.countDistinct("s_from").alias("source_states"))


def resolve_patterns(
    patterns: DataFrame, states: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Patterns with `status`, `mapped_to` (null when seen or without a model) and `resolved`."""
    return nearest_states(patterns, states, keys).selectExpr(
        *[f"`{k}`" for k in keys], "pattern", "if(distance = 0, 'seen', 'unseen') as status",
        "if(distance = 0, null, mapped_to) as mapped_to", "mapped_to as resolved",
    )


def _ends(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    return edges.select(*keys, F.expr("explode(array(s_from, s_to))").alias("state"))


def evaluate_transitions(
    pairs: DataFrame, edges: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Status and mapped state of both ends of each (s_from, s_to), and its probability.

    The probability is 0 when the source or the edge is unknown. A pattern without
    a model is unseen and mapped to nothing.
    """
    wanted = pairs.select(*keys, "s_from", "s_to").distinct()
    ends = wanted.select(*keys, F.explode(F.array("s_from", "s_to")).alias("pattern"))
    resolved = resolve_patterns(ends, _ends(edges, keys), keys)

    def side(name: str) -> DataFrame:
        return resolved.select(
            *keys,
            F.col("pattern").alias(name),
            F.col("status").alias(f"_{name}_status"),
            F.col("mapped_to").alias(f"{name}_mapped"),
            F.col("resolved").alias(f"_{name}"),
        )

    known = edges.select(*keys, F.col("s_from").alias("_s_from"), F.col("s_to").alias("_s_to"), "p")
    return (
        wanted.join(side("s_from"), [*keys, "s_from"], "left")
        .join(side("s_to"), [*keys, "s_to"], "left")
        .join(known, [*keys, "_s_from", "_s_to"], "left")
        .selectExpr(
            *[f"`{k}`" for k in keys], "s_from", "s_to",
            "coalesce(_s_from_status, 'unseen') as s_from_status", "s_from_mapped",
            "coalesce(_s_to_status, 'unseen') as s_to_status", "s_to_mapped",
            "coalesce(p, 0D) as probability",
        )
    )


def transition_probability(pairs: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probability of each (s_from, s_to) as given; 0 when unknown."""
    return pairs.join(edges.select(*keys, "s_from", "s_to", "p"), [*keys, "s_from", "s_to"], "left").withColumn(
        "probability", F.coalesce("p", F.lit(0.0))
    ).drop("p")


def decide(probability: Column, threshold: float = THRESHOLD, first: Column | None = None) -> Column:
    """`normal` from the threshold on; a path's first step has no transition and is always normal."""
    normal = probability >= threshold
    return F.when(normal if first is None else first | normal, "normal").otherwise("anomaly")


def score_grams(
    steps: DataFrame, edges: DataFrame, keys: Sequence[str], threshold: float = THRESHOLD
) -> DataFrame:
    """Score each distinct gram of `steps` against the model with the same `keys`.

    Columns: keys, window_size, gram, pattern, state, status, mapped_to,
    probability, decision. The first step of a path has probability 1. Without a
    model a pattern is unseen, stands for no state, and later steps have probability 0.
    """
    distinct = steps.select(
        *_and(keys, "window_size", "gram"), gram_pattern().alias("pattern"), gram_previous().alias("_previous")
    ).distinct()
    resolved = resolve_patterns(distinct, _ends(edges, keys), keys)
    previous = resolved.select(*keys, F.col("pattern").alias("_previous"), F.col("resolved").alias("_from"))
    known = edges.select(*keys, F.col("s_from").alias("_from"), F.col("s_to").alias("state"), "p")
    return (
        distinct.join(resolved.withColumnRenamed("resolved", "state"), [*keys, "pattern"])
        .join(previous, [*keys, "_previous"], "left")
        .join(known, [*keys, "_from", "state"], "left")
        .selectExpr(
            *[f"`{c}`" for c in _and(keys, "window_size")], "gram", "pattern", "state", "status", "mapped_to",
            "if(_previous is null, 1D, coalesce(p, 0D)) as probability",
        )
        .withColumn("decision", decide(F.col("probability"), threshold, F.expr("length(gram) = window_size")))
    )


def explain_paths(
    steps: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One justification per step of `steps`: time_step plus the columns of `score_grams`.

    `keys` names the model; `steps` may carry more columns. The steps of series
    without a model have null states (see `score_grams`).
    """
    scores = score_grams(steps, edges, keys, threshold)
    return (
        attach(steps, scores, _and(keys, "window_size", "gram"), F.col("_block"))
        .withColumnRenamed("seg", "time_step")
        .drop("gram", "_block")
    )


def path_summary(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Product and mean of the probabilities after the first step (1 when there is none).

    The logarithm is kept beside the product, which underflows on long paths; it
    is null when a probability is 0.
    """
    p = F.when(F.col("time_step") > 0, F.col("probability"))
    return scored.groupBy(*keys).agg(
        F.coalesce(F.product(p), F.lit(1.0)).alias("path_probability"),
        F.when(F.min(p) == 0, None).otherwise(F.coalesce(F.sum(F.log(p)), F.lit(0.0))).alias("log_probability"),
        F.coalesce(F.avg(p), F.lit(1.0)).alias("confidence"),
        F.count(F.lit(1)).alias("steps"),
    )


def justification_json(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each justification as one JSON object with the seven fields of a record."""
    fields = ["time_step", "state", "pattern", "status", "mapped_to", "probability", "decision"]
    record = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return scored.select(*keys, "time_step", record.alias("justification"))
