"""Mixing sources to target weights, with DataFrame functions only.

Token weights of the cells source x language x topic are raked by iterative
proportional fitting: each round scales the cells so that one marginal after the
other meets its target, until none is off by more than TOLERANCE. A cell's factor gives its documents' probability, capped at
one, with a common scale that meets the token budget. A document is drawn by a hash
of its id, so a rerun draws the same ones.

Everything but the final draw works on the cells; documents are summed to cells
before the shuffle, so a source of any size is a few rows.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.llm.common import apart, free_shuffles
from motifline.plans.blocks import stage

DIMENSIONS = ("source", "lang", "topic")
#: Target shares: the corpus' own token shares to these powers, scaled to 1. Below 1, small groups gain.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Raking ends when no marginal is off by this share of its target; targets that
#: can't be met end, with a warning, after MOST_ROUNDS or when STALLED rounds have not taken a tenth off the gap.
TOLERANCE, MOST_ROUNDS, STALLED = 1e-12, 1000, 25
#: Rounds after which the driver lets go of what earlier ones left in its memory.
FREED_EVERY = 8
#: Rounds of the SQL, which has no test of the gap: enough for the tables it is compared on.
ROUNDS, BUDGET, CAP_STEPS = 48, 0.6, 12
WORD = r"[^ \t\n\r]+"


def tokens(text: Column) -> Column:
    """Number of words; 0 for a null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def described(docs: DataFrame) -> DataFrame:
    """`docs` with _n, its words, and its cell _source, _lang, _topic; a null source or language is the group ''.

    The text is searched for words and bars once each; the topic is what it holds.
    """
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumns({"_n": tokens(text), "_bars": F.regexp_count(text, F.lit(r"\|"))})
    topic = (
        F.when(F.col("_n") == 0, "empty")
        .when(text.contains("Licensed under") | text.contains("is licensed under"), "licensed")
        .when(F.col("_bars") * 5 > F.col("_n"), "table")
        .when(text.contains("@") | text.contains("http"), "contact")
        .when(F.col("_n") < 100, "note")
        .when(F.col("_n") < 1000, "article")
        .otherwise("long")
    )
    cell = {"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": topic}
    return counted.withColumns(cell).drop("_bars")


def cells_of(docs: DataFrame) -> DataFrame:
    return _summed(described(docs))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*[f"_{d}" for d in DIMENSIONS]).agg(F.sum("_n").cast("double").alias("tokens")).toDF(*DIMENSIONS, "tokens")


def targets_of(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """For each dimension the shares that its groups shall have: (value, share)."""
    out = {}
    for d, power in powers.items():
        marginal = cells.where("tokens > 0").groupBy(d).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("w"))
        whole = marginal.agg(F.sum("w").alias("all_w"))
        # One row: joined on a constant, no cross join.
        out[d] = marginal.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").select(F.col(d).alias("value"), (F.col("w") / F.col("all_w")).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with `factor`: its token weight times the factor meets the targets' shares of all tokens.

    A cell's factor is the product of one factor for each of its groups; a step sets the
    factors of one dimension. A cell without tokens, or of a group without a target, gets
    the factor 0. Targets of groups without cells can't be met; the others then share
    what is left of their own scale. A marginal's gap before a step is the change of its
    group's factor; a round without a gap above `tolerance` is the last.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    # Each cell has the shares of its groups and the product of their factors, so that a step is one sum for each group.
    state = cells
    for d, target in targets.items():
        state = state.join(target.select(F.col("value").alias(d), F.col("share").alias(f"_share_{d}")), d, "left")
    aimed = reduce(lambda x, y: x & y, [F.col(f"_share_{d}").isNotNull() for d in targets], F.col("tokens") > 0)
    state = stage(state.withColumn("factor", F.when(aimed, 1.0).otherwise(0.0)).withColumn("_gap", F.lit(None).cast("double")))
    gaps = []
    for _ in range(rounds):
        state = state.withColumn("_gap", F.lit(None).cast("double"))
        for d in targets:
            have = state.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor")).alias("_have"), F.max(f"_share_{d}").alias("_aim"))
            change = have.where("_have > 0").select(d, (F.col("_aim") * total / F.col("_have")).alias("_change"))
            gap = F.abs(F.col("_change") - 1) / F.greatest("_change", F.lit(1.0))
            state = state.join(change, d, "left").withColumn("_gap", F.greatest("_gap", gap)).withColumn("factor", F.col("factor") * F.coalesce("_change", F.lit(0.0))).drop("_change")
        state = stage(state)
        gaps.append(state.agg(F.max("_gap")).first()[0] or 0.0)
        if gaps[-1] <= tolerance or len(gaps) > STALLED and gaps[-1] > 0.9 * gaps[-1 - STALLED]:
            break
        if len(gaps) % FREED_EVERY == 0:
            free_shuffles(cells.sparkSession)
    if gaps and gaps[-1] > tolerance:
        warnings.warn(f"raking ended after {len(gaps)} rounds with a marginal off by {gaps[-1]:.1e} of its target", stacklevel=2)
    return state.select(*cells.columns, "factor")


def probabilities(fitted: DataFrame, budget: float = BUDGET, steps: int = CAP_STEPS) -> DataFrame:
    """Cells with `probability` = min(1, scale * factor), the scale such that the share `budget`
    of all tokens is expected to be drawn (or all that can be)."""
    total = fitted.agg(F.sum("tokens")).first()[0] or 0.0
    scale = budget
    for _ in range(steps):  # each step caps more cells and shares the rest among the others
        over = F.col("factor") * scale >= 1
        row = fitted.agg(F.sum(F.when(over, F.col("tokens")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("tokens") * F.col("factor"))).alias("rest")).first()
        if not row.rest:
            break
        scale = max(scale, (budget * total - row.full) / row.rest)
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.col("factor") * F.lit(float(scale))))


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) hashed from the key."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**13))


def _chances(rows: DataFrame, budget: float, powers: dict[str, float], targets: dict[str, DataFrame] | None) -> DataFrame:
    """`rows` of `described` with _probability and _sampled."""
    cells = stage(_summed(rows))
    fitted = stage(rake(cells, targets or targets_of(cells, powers)))
    chances = stage(probabilities(fitted, budget))
    chance = chances.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], F.col("probability").alias("_probability"))
    return rows.join(chance, [f"_{d}" for d in DIMENSIONS]).withColumn("_sampled", uniform(F.col("doc_id")) < F.col("_probability"))


def drawn(docs: DataFrame, budget: float = BUDGET, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """doc_id, _n, _source, _lang, _topic, _probability and _sampled of every row.

    A null or blank text has no tokens and the probability 0. Repeated rows of one id are
    drawn or left together; rows without an id likewise. Texts are read once: what is known
    of them is written without them. An empty table gives an empty one; other columns don't matter.
    """
    used = docs.select("doc_id", "text", "source", "lang")
    return _chances(stage(described(used).drop("text", "source", "lang")), budget, powers, targets)


def sample(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The drawn rows, with the columns of `docs`, whatever the names of those that aren't used.

    Nulls, blank texts and repeated rows as in `drawn`. Texts are read twice, as writing
    them again would cost more disk than the input has.
    """
    run = lambda rows: _chances(described(rows), budget, POWERS, None).where("_sampled").select(*rows.columns)
    return apart(docs, ("doc_id", "text", "source", "lang"), run)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, topic, n_tokens, probability (to six places) and sampled of every row of `drawn`."""
    return drawn(docs).select("doc_id", F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def oracle(rounds: int = ROUNDS, steps: int = CAP_STEPS, budget: float = BUDGET) -> str:
    """`report` over the table documents as SQL: every round and step is one subquery."""
    n = r"len(regexp_extract_all(text, '[^ \t\n\r]+'))"
    pipes = r"len(regexp_extract_all(text, '\|'))"
    parts = [
        f"""described as materialized (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce({n}, 0) as n_tokens,
  case when coalesce({n}, 0) = 0 then 'empty' when contains(text, 'Licensed under') or contains(text, 'is licensed under') then 'licensed'
  when {pipes} * 5 > {n} then 'table' when contains(text, '@') or contains(text, 'http') then 'contact'
  when {n} < 100 then 'note' when {n} < 1000 then 'article' else 'long' end as topic from documents)""",
        "cells as materialized (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from described group by all)",
        "total as materialized (select sum(tokens) as all_tokens from cells)",
    ]
    for d, power in POWERS.items():
        parts.append(f"w_{d} as materialized (select {d}, pow(sum(tokens), {power}) as w from cells where tokens > 0 group by {d})")
        parts.append(f"t_{d} as materialized (select {d}, w / (select sum(w) from w_{d}) as share from w_{d})")
    parts.append("f0 as materialized (select *, case when tokens > 0 then 1.0::double else 0.0::double end as factor from cells)")
    last, k = "f0", 0
    for _ in range(rounds):
        for d in POWERS:
            k += 1
            parts.append(
                f"f{k} as materialized (select c.source, c.lang, c.topic, c.tokens, c.factor * coalesce(t.share * (select all_tokens from total) / nullif(h.have, 0), 0) as factor "
                f"from {last} c left join (select {d}, sum(tokens * factor) as have from {last} group by {d}) h using ({d}) left join t_{d} t using ({d}))"
            )
            last = f"f{k}"
    parts.append(f"s0 as materialized (select {budget}::double as scale)")
    for i in range(steps):
        over = f"factor * (select scale from s{i}) >= 1"
        parts.append(
            f"s{i + 1} as materialized (select greatest((select scale from s{i}), coalesce(({budget} * sum(tokens) - sum(case when {over} then tokens else 0 end)) / nullif(sum(case when {over} then 0 else tokens * factor end), 0), 0)) as scale from {last})"
        )
    parts.append(f"chances as materialized (select *, least(1.0, factor * (select scale from s{steps})) as p from {last})")
    return (
        "with "
        + ",\n".join(parts)
        + """
select doc_id, topic, cast(n_tokens as bigint) as n_tokens, round(p, 6) as probability,
  cast(cast('0x' || substr(md5(concat_ws(':', 'mix', cast(doc_id as varchar))), 1, 13) as bigint) as double) / 4503599627370496.0 < p as sampled
from described join chances using (source, lang, topic)"""
    )
