"""Work and spread of the search for nearest states."""

import random

import numpy as np
from brute import edits, nearest
from pyspark.sql import functions as F

from motifline.operators import automaton as A
from motifline.operators import nearest as N


def words(rnd, n, letters, longest, least=0):
    return sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(least, longest))) for _ in range(n)})


def test_far_words_open_few_nodes(monkeypatch):
    """The nearest of 20,000 words of 12 letters is mostly 4 edits away; without halves nearly every node is in reach."""
    rnd = random.Random(5)
    trie, asked = N.Trie(words(rnd, 20_000, "abcdef", 12, 12)), words(rnd, 20, "abcdef", 12, 12)
    opened, repeat = [], np.repeat
    monkeypatch.setattr(N.np, "repeat", lambda a, n: opened.append(int(n.sum())) or repeat(a, n))
    best, distance = trie.nearest(asked, np.full(len(asked), 99))
    assert [(trie.words[b], d) for b, d in zip(best, distance)] == [(n := nearest(a, trie.words), edits(a, n)) for a in asked]
    # `repeat` is called twice for each step.
    assert sum(opened) / 2 / len(asked) < 20_000


def test_one_trie_searches_many_models():
    rnd = random.Random(3)
    models = {m: words(rnd, 60, "abcd", 8) for m in (3, 5, 11)}
    trie = N.Trie([w for v in models.values() for w in v], [m for m, v in models.items() for _ in v])
    asked = [(rnd.choice((3, 4, 5, 11)), a) for a in words(rnd, 300, "abcdé", 10)]
    best, distance = trie.nearest([a for _, a in asked], np.full(len(asked), 99), np.array([m for m, _ in asked]))
    got = [(trie.words[b], d) if b >= 0 else None for b, d in zip(best, distance)]
    assert got == [(n := nearest(a, models[m]), edits(a, n)) if m in models else None for m, a in asked]


def test_words_farther_than_a_small_number_holds():
    trie = N.Trie(["a" * 300, "b" * 130])
    best, distance = trie.nearest(["c" * 140, "", "a" * 120], np.full(3, 999))
    assert [(trie.words[b][0], d) for b, d in zip(best, distance)] == [("b", 140), ("b", 130), ("b", 130)]


def test_many_small_models_share_few_tasks(spark, monkeypatch):
    """400 models of 3 words were 400 groups, each with a trie of its own."""
    groups = spark.sparkContext.accumulator(0)
    trie = N.Trie

    def counted(*args):
        groups.add(1)
        return trie(*args)

    monkeypatch.setattr(N, "Trie", counted)
    states = spark.range(1200).select((F.col("id") % 400).alias("k"), F.expr("array('abc', 'bcd', 'cde')[cast(id div 400 as int)]").alias("state"))
    asked = spark.range(400).select(F.col("id").alias("k"), F.lit("acc").alias("pattern"))
    got = A.nearest_states(asked, states, ["k"]).collect()
    assert len(got) == 400 and {(r.mapped_to, r.distance) for r in got} == {("abc", 1)}
    assert 0 < groups.value <= 8
