"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm import art, bagminhash, bpe, lexical, lines, merkle, rankbpe, raking, secrets, suffixes, topk, weaklabels, wrappers
from motifline.llm.common import table, tasks_of


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(spark, table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op3_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.judged(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), 16 * tasks_of(spark))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.report(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op9_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.against_edits(table(spark, sf_dir, "documents"), 2 * tasks_of(spark))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return art.trie(table(spark, sf_dir, "conversations")).drop("prefix")


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return rankbpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_line_dedup, op3_bpe_encoding_and_decoding, op4_quality_classifier, op5_minhash_near_dedup, op6_suffix_array_dedup, op7_mixing_sources, op8_html_extraction, op9_exact_top_k_search, op10_document_fingerprints, op11_conversation_prefix_trie, op12_byte_level_bpe, op13_ranked_lexical_search)}


def _span_lists() -> str:
    """For each rule, the list of its spans: pieces and matches alternate."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        counts = f"length(regexp_extract(m[i], '{p}', {r.group})) >= {r.least}"
        parts.append(
            f"select doc_id, {rank} as rank, '{r.kind}' as kind, m[i] as hit, {counts} as counts, "
            f"list_sum(list_transform(list_slice(s, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) as begins "
            f"from (select doc_id, m, s, unnest(generate_series(1, len(m))) as i from (select doc_id, regexp_extract_all(text, '{p}') as m, string_split_regex(text, '{p}') as s from documents where regexp_matches(text, '{p}')))"
        )
    return " union all ".join(parts)


ORACLES = {
    "op1_secret_scans": f"""
with found as (select doc_id, rank, kind, cast(begins as bigint) as pos, cast(begins as bigint) + length(hit) as till from ({_span_lists()}) where counts),
listed as (
  select doc_id,
    count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || pos || ':' || till, ',' order by pos, rank) filter (where rank < {len(secrets.BASE_RULES)}), '') as base,
    string_agg(kind || ':' || pos || ':' || till, ',' order by pos, rank) as spans
  from found group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(coalesce(d.text, '')) as blob
from documents d left join listed using (doc_id)""",
    "op7_mixing_sources": raking.oracle(),
    "op9_exact_top_k_search": """
with whole as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.x, c.x) as bigint) as score
  from whole q join whole c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 5""",
    "op11_conversation_prefix_trie": art.ORACLE,
    "op13_ranked_lexical_search": lexical.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
