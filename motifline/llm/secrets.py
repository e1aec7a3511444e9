"""Secret scan over an incremental blob ledger, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger
says which (blob, rule version) pairs were scanned; a run scans each blob that
has an unseen pair once, however many paths or versions carry it, adds the pairs
and the findings to the ledger, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.plans.blocks import stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` must have `least` code points for a match to count."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


# Maximal runs: {32,} and {12,} find exactly the long ones among the runs of `+`.
BASE_RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + ADDED_RULES

#: Matches of a text whose spans are gathered at a time.
CHUNK = 256

SCANNED = "blob string, rules array<string>"
FINDINGS = "blob string, kind string, version int, start int, end int"


def empty_ledger(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], SCANNED), spark.createDataFrame([], FINDINGS)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (kind, version, start, end) of the counting matches, in code points.

    Matches and the pieces between them alternate, so running lengths give positions.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("piece"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match")
    )
    none = F.expr("cast(array() as array<struct<kind:string,version:int,start:int,end:int>>)")
    lists = F.expr("cast(array() as array<array<struct<kind:string,version:int,start:int,end:int>>>)")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["piece"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        counts = x["match"].isNotNull() & (
            F.char_length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least
        )
        span = F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), start.alias("start"), end.alias("end")
        )
        return F.struct(end.alias("at"), F.when(counts, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def chunk(state: Column, i: Column, matches: Column) -> Column:
        # Appending copies a list: spans go to the list of their chunk, and only chunks to the long one.
        part = F.aggregate(F.slice(matches, i, CHUNK), F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.array_append(state["lists"], p["spans"]).alias("lists")))[0]

    def all_spans(matches: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), lists.alias("lists"))
        starts = F.sequence(F.lit(1), F.size(matches), F.lit(CHUNK))
        return F.aggregate(starts, first, lambda s, i: chunk(s, i, matches), lambda s: F.flatten(s["lists"]))

    return F.when(text.rlike(rule.pattern), F.transform(F.array(found), all_spans)[0]).otherwise(none)


def unseen(versions: DataFrame, scanned: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """One row per blob with rule versions not scanned yet: blob, a carrier's key, todo."""
    blobs = versions.groupBy(blob_of(F.col(text)).alias("blob")).agg(F.min(key).alias("_carrier"))
    names = F.array(*[F.lit(r.name) for r in rules])
    # A ledger that other runs appended to may hold several rows of a blob.
    known = scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
    return (
        blobs.join(known, "blob", "left")
        .withColumn("todo", F.array_except(names, F.coalesce("done", F.expr("cast(array() as array<string>)"))))
        .where(F.size("todo") > 0)
        .select("blob", "_carrier", "todo")
    )


def advance(
    versions: DataFrame,
    scanned: DataFrame,
    findings: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger lacks; return the rows to append to `scanned` and `findings`.

    Both are written to the shared folder. `findings` of older rule versions stay in
    the ledger. A null text is an empty one. A blob's text is taken from the row with its
    least key, null where no row has one; key and blob are joined together, so rows
    without a key don't meet each other's blobs.
    """
    del findings  # append-only: what was found before is never read to scan
    todo = stage(unseen(versions, scanned, rules, key, text))
    texts = versions.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"), F.unhex(blob_of(F.col(text))).alias("_blob"))
    carried = texts.join(todo.hint("shuffle_hash"), texts["_key"].eqNullSafe(todo["_carrier"]) & (texts["_blob"] == F.unhex(todo["blob"])))
    per_rule = [F.when(F.array_contains("todo", r.name), spans(F.col("_text"), r)) for r in rules]
    any_rule = "|".join(f"(?:{r.pattern})" for r in rules)
    found = stage(
        # Bound to `todo`, so that it can't run below the join on texts that the ledger knows.
        carried.where(F.when(F.size("todo") > 0, F.col("_text").rlike(any_rule)))
        .select("blob", F.flatten(F.array_compact(F.array(*per_rule))).alias("spans"))
        .where(F.size("spans") > 0)
        .dropDuplicates(["blob"])
        .select("blob", F.explode("spans").alias("s"))
        .select("blob", "s.kind", "s.version", "s.start", "s.end")
    )
    return todo.select("blob", F.col("todo").alias("rules")), found


def by_path(
    versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Findings of the current rule versions at every path that carries the blob.

    One row per row of `versions`: the columns `keep` and `findings`, an array of
    (start, order of the kind, kind, end), sorted; empty for clean texts.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    current = findings.withColumn("_order", order[F.concat_ws("/", "kind", F.col("version").cast("string"))]).where("_order is not null")
    per_blob = current.groupBy("blob").agg(
        F.array_sort(F.collect_set(F.struct("start", F.col("_order").alias("rank"), "kind", "end"))).alias("findings")
    )
    # Staged, so that the join below is a plain one whose hot blobs Spark can split.
    per_blob = stage(per_blob)
    paths = versions.select(*keep, blob_of(F.col(text)).alias("blob"))
    nothing = F.expr("cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)")
    return paths.join(per_blob, "blob", "left").withColumn("findings", F.coalesce("findings", nothing))


def listed(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(paths: DataFrame) -> DataFrame:
    """Digest of `by_path`: counts per base kind, hash of the base spans, all spans."""
    base = F.filter("findings", lambda x: x["rank"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select(
        "doc_id",
        *[count(r.kind) for r in BASE_RULES],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
        "blob",
    )


def scan_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """A first run over `documents`: empty ledger, all rules, findings at every document."""
    _, found = advance(documents, *empty_ledger(spark))
    return report(by_path(documents, found))
