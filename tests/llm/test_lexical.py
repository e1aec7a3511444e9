import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifline.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """All scores from the definitions."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in {x for x in items if x[0] is not None and x[1] is not None}:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for item, words in asked.items():
        rows = []
        for i, c in held:
            if i is None:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            score = 0
            for t in words:
                if c[t]:
                    score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                rows.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def got(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as terms", "2 as score", "3 as query").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank", "2 as query")
    return sorted(tuple(r) for r in lexical.search(d, b, k).collect())


def made(seed, n, common=40):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(common)] + ["Été", "naïve", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rnd.choices(vocabulary, weights, k=rnd.choice([3, 10, 60, 400])))) for i in range(n)]


def test_words_follow_the_pattern():
    text = "It's A-Z_0 été ÉTÉ naïve x İ ﬁ\x7f日本 99\x00b [c]"
    assert [w.decode() for w in lexical.words(text)] == terms(text)
    assert lexical.words(None) == lexical.words("") == lexical.words(" .\n") == []


def test_whole_search_equals_brute_force(spark, monkeypatch):
    docs = made(1, 700)
    items = [(i, t) for i, t in made(2, 12)] + [(50, "w1"), (51, "none of these"), (52, "w0 w0 w0 W0, naïve")]
    assert got(spark, docs, items) == brute(docs, items)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 60)
    monkeypatch.setattr(lexical, "LEAF_DOCS", 1)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)
    monkeypatch.setattr(lexical, "BATCH_TERMS", 200)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 90)
    assert got(spark, docs, items, 3) == brute(docs, items, 3)


def test_nulls_ties_copies_and_long_texts(spark):
    docs = [*made(3, 60), (3, "w1 w2"), (3, "w1 w2"), (None, "w1 w2 w3"), (70, None), (71, ""), (72, " .. "), (73, "w5 " * 200_000 + "w1")]
    docs += [(100 + i, "same text of w1") for i in range(90)]  # more ties than places
    items = [(1, "w1 w2"), (1, "w1 w2"), (1, "w9"), (2, None), (None, "w1"), (3, ""), (4, "same of text")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, [(1, None)], items) == [] and got(spark, docs, [(1, None)]) == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lexical.search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_range_maxima_and_block_search(leaf, monkeypatch):
    monkeypatch.setattr(lexical, "LEAF_DOCS", leaf)
    rnd = np.random.default_rng(leaf)
    docs, size = 300, 25
    held = [np.sort(rnd.choice(size, rnd.integers(0, 12), replace=False)) for _ in range(docs)]
    impact = [rnd.integers(1, 50, len(h)) for h in held]
    block = lexical.Block(rnd.permutation(docs), impact, held, size)
    weights = rnd.integers(0, 9, size)
    for _ in range(50):
        a, b = np.sort(rnd.integers(block.begin[3], block.begin[4] + 1, 2))
        value, _ = block.maxima(np.array([[a]]), np.array([[b]]), np.array([2]))
        assert value[0, 0] == 2 * block.impact[a:b].max(initial=0)
    terms_of = rnd.choice(size, 6, replace=False)
    scores, ids, _ = block.search(terms_of, weights[terms_of], 10)
    plain = [(-sum(int(w) * int(i[h == t].sum()) for t, w in zip(terms_of, weights[terms_of])), int(block.ids[d])) for d, (h, i) in enumerate(zip(held, impact))]
    assert list(zip((-scores).tolist(), ids.tolist())) == [p for p in sorted(plain) if p[0] < 0][:10]


def test_bounds_leave_documents_unscored():
    """A few good documents among many poor ones: most intervals are closed by their bound."""
    rnd = np.random.default_rng(5)
    held = [np.array([0, 1, 2]) if d % 500 == 7 else np.array([rnd.integers(0, 3)]) for d in range(5000)]
    block = lexical.Block(np.arange(5000), [np.full(len(h), 90 if len(h) > 1 else 10) for h in held], held, 3)
    scores, ids, scored = block.search(np.arange(3), np.full(3, 5), 5)
    assert ids.tolist() == [7, 507, 1007, 1507, 2007] and scored < 1000


def test_query_columns(spark, sf):
    from motifline.llm.catalog import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = queries()["op13_ranked_lexical_search"](spark, sf)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == brute(docs, items)
