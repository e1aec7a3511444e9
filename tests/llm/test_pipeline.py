import public_tokenizers
import test_bagminhash
import test_lines
import test_raking

from pyspark.sql import functions as F

import corpus_pipeline as P
from motifline.llm import bagminhash, bpe, lines, raking, weaklabels


def test_each_stage_does_its_part(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    columns = docs.columns
    good = {r.doc_id: r for r in P.quality(spark, docs, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [d for d in labels if d < 120]
    assert sum((d in good) == bool(labels[d]) for d in known) / len(known) > 0.9
    frame = spark.createDataFrame(list(good.values()), docs.schema)

    lined = P.line_dedup(spark, frame, sf).collect()
    expected = {r[0]: r for r in test_lines.brute([(d, r.text) for d, r in good.items()])}
    assert {str(r.doc_id) for r in lined} == {d for d, r in expected.items() if r[1] == 0 or r[2] + r[3] < r[1]}
    assert all(len(r.text) == expected[str(r.doc_id)][5] for r in lined)
    frame = spark.createDataFrame(lined, docs.schema)

    single = P.near_dedup(spark, frame, sf).collect()
    classes = test_bagminhash.brute_classes([(r.doc_id, r.text) for r in lined])
    assert sorted(str(r.doc_id) for r in single) == sorted({c for _, c, _ in classes})
    frame = spark.createDataFrame(single, docs.schema)

    mixed = P.mixture(spark, frame, sf)
    assert frame.columns == mixed.columns == columns and mixed.count() <= len(single)
    tokens = P.encoding(spark, mixed, sf)
    back = {r.doc_id: r.text for r in bpe.decode(tokens, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert back == {r.doc_id: r.text for r in mixed.collect()}


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "near dedup", "mixture", "encoding"] and P.ORACLE_SQL is None
    assert test_raking


def test_stages_leave_columns_of_any_name_alone(spark, docs):
    names = ["_row", "_new", "_score", "_own", "_topic", "_source", "_lang", "_n", "_judged", "_label", "_other_0", "quality", "tokens"]
    wide = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(n), F.coalesce("text", F.lit("?"))).alias(n) for n in names])
    for step in (weaklabels.keep_good, lines.without_repeats, bagminhash.keep_first, raking.sample):
        kept = step(wide)
        assert kept.columns == wide.columns
        rows = kept.collect()
        assert all(r[n] is not None and r[n].startswith(n) for r in rows for n in names)
        assert rows and all(r["_n"] == "_n" + r["_own"][4:] for r in rows)


def test_stages_let_go_of_what_the_driver_holds(spark, sf, monkeypatch):
    """Plans and broadcast tables of all stages together took more than the driver has."""
    calls = []
    monkeypatch.setattr(P, "free_shuffles", lambda s: calls.append("freed"))
    for module, name in ((weaklabels, "keep_good"), (lines, "without_repeats"), (bagminhash, "keep_first"), (raking, "sample"), (bpe, "encode")):
        monkeypatch.setattr(module, name, lambda docs, *_, n=name, **__: calls.append(n) or docs)
    docs = spark.range(1)
    for _, step in P.STAGES:
        docs = step(spark, docs, sf)
    assert calls == ["keep_good", "freed", "without_repeats", "freed", "keep_first", "freed", "sample", "freed", "encode"]
