import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import edits, fit, letters, nearest, pattern_labels, patterns, series_rows, walk
from motifline.operators import automaton as A
from motifline.operators import nearest as N
from motifline.operators.splits import chrono_split
from motifline.plans import experiments as X
from motifline.plans.blocks import with_position
from motifline.sources import tables

K = ["k"]


# Words and distances that results must equal.
def test_edit_distance_literals(spark):
    cases = [("abc", "abc", 0), ("abc", "acc", 1), ("abc", "abd", 1), ("abc", "xyz", 3), ("abc", "ab", 1), ("abc", "abcd", 1), ("", "abc", 3)]
    df = spark.createDataFrame(cases, "a string, b string, d int")
    assert df.where(F.levenshtein("a", "b") != F.col("d")).count() == 0
    assert all(edits(a, b) == d for a, b, d in cases)


def test_nearest_state_literals(spark):
    states = spark.createDataFrame([("m", s) for s in ("abc", "bcd", "cde")], "k string, state string")
    asked = spark.createDataFrame([("m", p) for p in ("abc", "acc", "bce", "xyz")], "k string, pattern string")
    got = {r.pattern: (r.resolved, r.status, r.mapped_to) for r in A.resolve_patterns(asked, states, K).collect()}
    assert got == {
        "abc": ("abc", "seen", None), "acc": ("abc", "unseen", "abc"),
        "bce": ("bcd", "unseen", "bcd"), "xyz": ("abc", "unseen", "abc"),
    }
    empty = A.resolve_patterns(asked, states.where("false"), K).collect()
    assert {(r.pattern, r.status, r.mapped_to, r.resolved) for r in empty} == {(p, "unseen", None, None) for p in got}


def test_patterns_of_other_lengths_letters_and_models(spark):
    models = {"m": ["abc", "bcd", "cde"], "mixed": ["a", "abcd", "x-1", "zzzzzzzzzzzz"], "long": ["abcdefghijkl", "mnopqrstuvwx"]}
    asked = [(k, p) for k in [*models, "none"] for p in ("abc", "ab", "abcd", "ABC", "x1", "zzzzzzzzzz", "abcdefghijlk", "qqqqqqqqqqqq")]
    states = spark.createDataFrame([(k, s) for k, v in models.items() for s in v], "k string, state string")
    found = A.nearest_states(spark.createDataFrame(asked, "k string, pattern string"), states, K).collect()
    got = {(r.k, r.pattern): (r.mapped_to, r.distance) for r in found}
    expected = {(k, p): ((nearest(p, models[k]), edits(p, nearest(p, models[k]))) if k in models else (None, None)) for k, p in asked}
    assert len(found) == len(asked) and got == expected


@pytest.mark.parametrize("length", [1, 2, 3, 4, 6, 8, 9, 12])
def test_nearest_state_against_all_pairs(spark, length):
    rnd = random.Random(length)

    def words(n, alphabet):
        return {"".join(rnd.choice(alphabet) for _ in range(length)) for _ in range(n)}

    models = {"dense": words(60, "abcd"), "sparse": words(4, "abcdef"), "far": words(5, "ab")}
    asked = {"dense": words(40, "abcd"), "sparse": words(40, "abcdef"), "far": words(30, "bcd")}
    states = spark.createDataFrame([(k, s) for k, v in models.items() for s in v], "k string, state string")
    unseen = [(k, p) for k, v in asked.items() for p in v - models[k]]
    if not unseen:
        return
    found = A.nearest_states(spark.createDataFrame(unseen, "k string, pattern string"), states, K).collect()
    got = {(r.k, r.pattern): (r.mapped_to, r.distance) for r in found}
    assert got == {(k, p): (nearest(p, models[k]), edits(p, nearest(p, models[k]))) for k, p in unseen}


@pytest.mark.parametrize("shard,asked_at_once,open_pairs", [(1, 2, 3), (6, 10, 40), (40, 65_536, 1 << 19)])
def test_shards_of_a_model_meet_in_the_nearest_state(spark, monkeypatch, shard, asked_at_once, open_pairs):
    monkeypatch.setattr(N, "SHARD_WORDS", shard)
    monkeypatch.setattr(N, "ASKED_AT_ONCE", asked_at_once)
    monkeypatch.setattr(N, "OPEN_PAIRS", open_pairs)
    rnd = random.Random(shard)
    words = lambda n, letters, longest: {"".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest))) for _ in range(n)}
    models = {"m": words(90, "abé", 6), "one": {"ab"}, "head": {"a" * i for i in range(9)} | {""}}
    asked = words(60, "abcé", 7)
    states = spark.createDataFrame([(k, s) for k, v in models.items() for s in v], "k string, state string")
    patterns_ = spark.createDataFrame([(k, p) for k in [*models, "none"] for p in asked], "k string, pattern string")
    got = {(r.k, r.pattern): (r.mapped_to, r.distance) for r in A.nearest_states(patterns_, states, K).collect()}
    expected = {(k, p): ((nearest(p, models[k]), edits(p, nearest(p, models[k]))) if k in models else (None, None)) for k in [*models, "none"] for p in asked}
    assert got == expected


def test_trie_gives_the_first_of_the_nearest_words():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 9))) for _ in range(400)})
    asked = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    trie = N.Trie(words)
    best, distance = trie.nearest(asked, np.full(len(asked), 99))
    assert [(trie.words[b], d) for b, d in zip(best, distance)] == [(n := nearest(a, words), edits(a, n)) for a in asked]
    near, _ = trie.nearest(asked, np.full(len(asked), 1))
    assert [(b if d <= 1 else -1) for b, d in zip(best, distance)] == near.tolist()
    assert N.Trie([]).nearest(["a"], np.array([9]))[0].tolist() == [-1]


@pytest.fixture(scope="module")
def scored(spark):
    rows = series_rows(11, {"a": 900, "b": 260, "c": 45, "tiny": 9})
    df = with_position(spark.createDataFrame(rows, "k string, t int, x double, label int"), K, ["t"])
    return rows, chrono_split(df)


@pytest.mark.parametrize("alphabet,window", [(4, 3), (6, 4), (6, 6)])
def test_explain_against_a_sequential_walk(spark, scored, alphabet, window):
    rows, roles = scored
    params = X.Params(segment_size=3, alphabet_size=alphabet, window=window, block_rows=70)
    got = X.explain(roles, K, params).collect()
    flagged = {r.k: r for r in X.detect(roles, K, params).collect()}
    for key in ("a", "b", "c"):
        x = [r[2] for r in sorted(r for r in rows if r[0] == key)]
        y = [r[3] for r in sorted(r for r in rows if r[0] == key)]
        train_end = int(len(x) * 0.6)
        val_end = train_end + int(len(x) * 0.2)
        edges, states = fit(patterns(letters(x[:train_end], 3, alphabet), window))
        path = walk(patterns(letters(x[val_end:], 3, alphabet), window), edges, states)
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.time_step)
        assert [
            (r.time_step, r.state, r.pattern, r.status, r.mapped_to, r.probability, r.decision) for r in mine
        ] == path
        labels = pattern_labels(y[val_end:], 3, window)
        assert [r.label for r in mine] == labels
        if path:
            right = sum((p[6] == "anomaly") == bool(v) for p, v in zip(path, labels)) / len(path)
            assert flagged[key].accuracy == pytest.approx(right)
    assert not [r for r in got if r.k == "tiny"]
    assert "tiny" in {r.k for r in X.skipped(roles, K, params).collect()}


def steps_from(spark, seqs):
    rows = []
    for key, seq in seqs.items():
        rows += [(key, len(p), i, 0, (seq[i - 1][0] if i else "") + p, 0) for i, p in enumerate(seq)]
    return spark.createDataFrame(rows, "k string, window_size int, seg long, _block long, gram string, label int")


def test_last_train_state_is_seen_but_leads_nowhere(spark):
    train = steps_from(spark, {"m": patterns("aaabbbc", 3)})
    edges = A.fit_automaton(train, K)
    path = A.explain_paths(steps_from(spark, {"m": patterns("bbcc", 3)}), edges, K).orderBy("time_step").collect()
    assert [(r.pattern, r.status, r.probability, r.decision) for r in path] == [
        ("bbc", "seen", 1.0, "normal"), ("bcc", "unseen", 0.0, "anomaly"),
    ]


def test_path_summary(spark):
    train = steps_from(spark, {"m": patterns("abababb", 2), "one": ["ab", "bc"]})
    edges = A.fit_automaton(train, K)
    found = A.explain_paths(steps_from(spark, {"m": patterns("ababa", 2), "one": ["ab"]}), edges, K)
    got = {r.k: r for r in A.path_summary(found, K).collect()}
    assert got["m"].path_probability == pytest.approx((2 / 3) * 1.0 * (2 / 3))
    assert got["m"].confidence == pytest.approx((2 / 3 + 1 + 2 / 3) / 3)
    assert (got["one"].path_probability, got["one"].confidence, got["one"].log_probability) == (1.0, 1.0, 0.0)


def test_justification_keeps_all_seven_fields(spark):
    train = steps_from(spark, {"m": patterns("abababb", 2)})
    found = A.explain_paths(steps_from(spark, {"m": ["ab"]}), A.fit_automaton(train, K), K)
    record = json.loads(A.justification_json(found, K).first().justification)
    assert record == {
        "time_step": 0, "state": "ab", "pattern": "ab", "status": "seen", "mapped_to": None, "probability": 1.0, "decision": "normal",
    }


def test_model_json(spark):
    train = steps_from(spark, {"m": patterns("abababbc", 2)})
    edges = A.fit_automaton(train, K)
    documents = tables.automaton_json(edges, K)
    parts = [json.loads(r.model) for r in documents.collect()]
    assert sorted(s for p in parts for s in p["states"]) == ["ab", "ba", "bb", "bc"]
    matrix = {k: v for p in parts for k, v in p["transition_matrix"].items()}
    assert matrix == {"ab": {"ba": 2 / 3, "bb": 1 / 3}, "ba": {"ab": 1.0}, "bb": {"bc": 1.0}}
    whole = spark.createDataFrame([("m", json.dumps({"states": ["ab", "ba", "bb", "bc"], "transition_matrix": matrix}))], "k string, model string")
    for models in (documents, whole):
        assert {(r.s_from, r.s_to): r.p for r in tables.edges_from_json(models, K).collect()} == {(a, b): p for a, t in matrix.items() for b, p in t.items()}
        assert {r.state for r in tables.states_from_json(models, K).collect()} == {"ab", "ba", "bb", "bc"}


def test_evaluate_transition_of_an_unknown_model(spark):
    pairs = spark.createDataFrame([("x", "ab", "ba")], "k string, s_from string, s_to string")
    edges = A.fit_automaton(steps_from(spark, {"m": patterns("abababb", 2)}), K)
    row = A.evaluate_transitions(pairs, edges, K).first()
    assert (row.s_from_status, row.s_from_mapped, row.s_to_status, row.s_to_mapped, row.probability) == ("unseen", None, "unseen", None, 0.0)
