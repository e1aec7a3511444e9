import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from motifline.llm import bagminhash as B


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows, least=0.8):
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= least:
                parent[find(i)] = find(j)
    label = {t: find(i) for i, t in enumerate(texts)}
    first = {}
    for d, t in rows:
        if d is not None:
            first[label[t or ""]] = min(first.get(label[t or ""], d), d)
    size = Counter(label[t or ""] for _, t in rows)
    return sorted((str(d), str(first.get(label[t or ""])), size[label[t or ""]]) for d, t in rows)


def some_rows():
    """Groups around an original whose copies are near it but not near each other, chains, copies, short and empty texts."""
    rnd = random.Random(7)
    words = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        n += 1
        rows.append((n * 7919 % 10_007, text))

    for _ in range(6):
        base = words(300)
        add(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(4):
                copy[rnd.randrange(300)] = words(1)[0]
            add(" ".join(copy))
    chain = words(200)
    for _ in range(6):
        chain = chain[5:] + words(5)
        add("  ".join(chain))
    for _ in range(40):
        add(" ".join(words(rnd.randint(1, 120))))
    loop = words(6)
    for k in (30, 33, 60):
        add(" ".join(loop * k))
    for t in (None, "", " \n", "a b", "a  b", "b a", rows[0][1], rows[0][1]):
        add(t)
    rows += [rows[5], (None, rows[20][1]), (None, "lonely words without id")]
    return rows


def test_bags_equal_brute_force():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["a", "b", "é", "漢", "cd"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)] + ["", " ", "x\n\ny"]
    doc, shingle, weight = B.Shingler(16).bags(texts)
    for i, t in enumerate(texts):
        assert sorted(weight[doc == i].tolist()) == sorted(bag(t).values())
    names = {}
    for i, t in enumerate(texts):
        for h, n in zip(shingle[doc == i].tolist(), weight[doc == i].tolist()):
            names.setdefault(h, set()).update(k for k, v in bag(t).items() if v == n and len(bag(t)) == 1)
    assert all(len(v) <= 1 for v in names.values())


def test_signatures_estimate_weighted_similarity_without_bias():
    rnd = np.random.default_rng(3)
    errors = []
    for _ in range(25):
        h = rnd.integers(0, 2**63, 50).astype(np.uint64)
        a = rnd.choice([1, 1, 2, 3, 5, 9, 40], 50)
        b = np.maximum(a + rnd.choice([0, 0, 0, 1, -1, 3], 50), 0)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.concatenate([np.zeros(50, int), np.ones((b > 0).sum(), int)])
        s = B.signatures(3, doc, np.concatenate([h, h[b > 0]]), np.concatenate([a, b[b > 0]]), 1000)
        errors.append((s[0] == s[1]).mean() - true)
        assert np.isinf(s[2]).all()
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_classes_equal_brute_force(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as label", "3 as _text", "4 as size")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in B.near_duplicates(df).collect())
    assert got == brute_classes(rows)


def test_crowded_bands_give_the_same_classes(spark):
    rows = some_rows()
    rnd = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    for i in range(60):  # one group with every similarity, some edits shared, of different lengths
        copy = list(base[: rnd.randint(105, 120)])
        for _ in range(rnd.choice([1, 2, 3, 5])):
            copy[rnd.randrange(100)] = rnd.choice(["x", "y", f"z{i}"])
        rows.append((20_000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in B.near_duplicates(df).collect()) == brute_classes(rows)


def test_bound_of_large_bands_keeps_pairs_at_exactly_the_threshold():
    assert not 28 >= 0.8 / 1.8 * 63
    assert all(4 * k >= B.common_share(0.8) * (9 * k) for k in range(1, 20_000))
    assert not any(4 * k - 1 >= B.common_share(0.8) * (9 * k) for k in range(1, 20_000))


def test_compared_pairs_of_a_group_of_far_copies_grow_with_its_members(spark, monkeypatch):
    """Copies with about 0.75 in common with a base and less with each other: every pair is a likely candidate."""
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 241):
        copy = list(base)
        for place in rnd.sample(range(5, 145), 5):
            copy[place] = rnd.choice([f"n{i}-{place}", "one", "two", "three"])
        rows.append((i, " ".join(copy)))
    asked, whole = [], B.compared

    def counted(pairs, bags, excess):
        asked.append(pairs.count())
        return whole(pairs, bags, excess)

    monkeypatch.setattr(B, "compared", counted)
    for n in (121, 241):
        got = B.near_duplicates(spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()
        assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == brute_classes(rows[:n])
    star, beyond, star2, beyond2 = asked
    assert star2 < 3 * star and beyond < 4 * 120 and beyond2 < 4 * 240


def test_members_that_share_a_passage_beyond_their_pivot_do_not_all_meet(spark, monkeypatch):
    """Members hold their pivot, one passage that all have, and twelve shingles that only their twin has."""
    made, whole = [], B.shared_beyond

    def counted(beyond, least):
        made.append(whole(beyond, least).count())
        return whole(beyond, least)

    monkeypatch.setattr(B, "shared_beyond", counted)
    for n in (200, 400):
        rows = []
        for i in range(n):
            twin = [1000 + 100 * (i // 2) + j for j in range(12)]
            own = [10**6 + 100 * i + j for j in range(9 + i // 2 % 40)]
            over = [1, 2, 3, 4, 5, *twin, *own]
            rows.append(("b", f"{i:04d}", 100 + len(over), 100, f"{i:04d}", "b", over, [1] * len(over)))
        stars = spark.createDataFrame(rows, "b string, digest string, size long, common long, label string, top string, over array<long>, extra array<long>")
        # Of twins each share 117; that is near enough beside up to 14 of their own.
        near = {(f"{i:04d}", f"{i + 1:04d}") for i in range(0, n, 2) if 117 >= 0.8 * (2 * len(rows[i][6]) + 200 - 117)}
        assert near <= {(min(r), max(r)) for r in B.unmet(stars, 0.8).collect()} and near
    assert made[1] <= 2.2 * made[0] and made[1] <= 12 * 200


def test_one_row_of_each_class_stays(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label")
    kept = B.keep_first(df).collect()
    expected = brute_classes(rows)
    classes = {c for _, c, _ in expected if c != "None"}
    assert sorted(str(r.doc_id) for r in kept) == sorted([*classes, "None"]) and kept[0].asDict().keys() == {"doc_id", "text", "label"}


def test_no_rows_and_no_links(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.near_duplicates(df).count() == 0 and B.keep_first(df).count() == 0
    alone = spark.createDataFrame([(1, "only one")], "doc_id long, text string")
    assert [tuple(r) for r in B.near_duplicates(alone).collect()] == [(1, 1, 1)]


def test_components_of_long_paths(spark):
    links = spark.range(40).select(F.format_string("%03d", "id").alias("a"), F.format_string("%03d", F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([("x", "y"), ("z", "y")], "a string, b string")
    got = {r.node: r.label for r in B.components(links.union(more)).collect()}
    assert {got[f"{i:03d}"] for i in range(41)} == {"000"} and {got[n] for n in "xyz"} == {"x"}


@pytest.mark.parametrize("task", [B._keys_of, B._bags_of])
def test_a_worker_takes_up_few_texts_at_once(task):
    """A batch as large as Spark makes it took 100 MB and more in each worker, beside the executor's heap."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=200)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % i for i in range(len(texts))]), pa.array(texts)], names=["digest", "text"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in task(iter([batch]))) == len(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20
