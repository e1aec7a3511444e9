import base64
import hashlib

import pytest
import public_tokenizers as P
import regex
from pyspark.sql import functions as F

from motifline.llm import rankbpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(ranks, word):
    """Lowest rank first, leftmost of equals: the definition."""
    parts = [bytes([b]) for b in word.encode()]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def brute(ranks, text):
    return [i for w in regex.findall(P.PATTERN, text) for i in merged(ranks, w)]


TEXTS = ["", " ", "Hello  world, it's 2024!\n\n\tx  ", "Être où ça naïve — 日本語のテキスト 🎉🎉", "a b   c\x85d", "<|endoftext|> 'LL 'll", "aaaa" * 30, " " * 70 + "x", "é́ ﷺ"]


def test_against_the_definition_of_the_merges(ranks, sf):
    c = rankbpe.Coder(PATH, P.PATTERN)
    for t in TEXTS:
        ids = [i for some in c.tokens(t) for i in some]
        assert ids == brute(ranks, t)
        assert c.digests(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("chars", [1, 2, 3, 7, 50])
def test_pieces_have_the_tokens_of_the_whole_text(chars):
    c = rankbpe.Coder(PATH, P.PATTERN)
    for t in [*TEXTS, " ".join(TEXTS), "one  two\n three's.  \n\n four 'll\x1c five " * 20]:
        pieces = list(c.pieces(t, chars))
        assert "".join(pieces) == t
        assert [i for p in pieces for i in c.library.encode_ordinary(p)] == c.library.encode_ordinary(t)


def test_long_texts_with_and_without_a_place_to_cut():
    c = rankbpe.Coder(PATH, P.PATTERN)
    prose = "Long texts are cut where a word ends. " * 40_000
    assert len(list(c.pieces(prose))) > 20
    for t in (prose, "x" * 400_000, " " * 400_000, "日" * 200_000):
        ids = c.library.encode_ordinary(t)
        assert c.digests(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_frames_with_nulls_and_clashing_names(spark, docs):
    df = docs.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(2))
    got = rankbpe.round_trip(df, PATH, P.PATTERN).collect()
    c = rankbpe.Coder(PATH, P.PATTERN)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.doc_id, *c.digests(r.text or ""))) for r in docs.collect())
    encoded = rankbpe.encode(df, PATH, P.PATTERN)
    back = rankbpe.decode(encoded, PATH, P.PATTERN).select("doc_id", F.col("data").cast("string").alias("text"))
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(repr((r.doc_id, r.text or "")) for r in docs.collect())
    assert rankbpe.round_trip(df.where("false"), PATH, P.PATTERN).count() == 0


def test_decoding_gives_raw_bytes(spark, ranks):
    df = spark.createDataFrame([(1, [ranks[b"\xff"], ranks[b"\xc3"]]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.data) for r in rankbpe.decode(df, PATH, P.PATTERN).collect()}
    assert got == {1: b"\xff\xc3", 2: b"", 3: b""}


def test_query(spark, sf):
    from motifline.llm.catalog import queries

    c = rankbpe.Coder(PATH, P.PATTERN)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op12_byte_level_bpe"](spark, sf).collect()}
    assert got == {i: c.digests(t) for i, t in texts.items()}
