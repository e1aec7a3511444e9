import hashlib
import random
import re

from motifline.llm import raking as R


def some_docs(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = rnd.choice([0, 5, 60, 150, 1200])
        text = " ".join(rnd.choice(["a", "b|", "c|", "d"]) if rnd.random() < 0.1 else "w" for _ in range(words)) + rnd.choice(["", " Licensed under X", " me@example.org"])
        rows.append((i, text, rnd.choice(["big"] * 8 + ["small", "tiny", None]), rnd.choice(["en"] * 5 + ["de", "fr", None])))
    rows += [(None, "no id here", "big", "en"), (5, None, "big", "en"), (n, "", "empty-source", "en"), (7, rows[7][1], rows[7][2], rows[7][3])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 as topic", "2 as tokens", "3 as probability", "4 as factor")


def brute(docs, rounds=R.ROUNDS, steps=R.CAP_STEPS):
    rows = [r.asDict() for r in docs.collect()]
    for r in rows:
        text = r["text"] or ""
        n = r["n"] = len(re.findall(R.WORD, text))
        pipes = text.count("|")
        r["topic"] = (
            "empty" if not n else "licensed" if "Licensed under" in text or "is licensed under" in text else "table" if pipes * 5 > n
            else "contact" if "@" in text or "http" in text else "note" if n < 100 else "article" if n < 1000 else "long"
        )
        r["cell"] = (r["source"] or "", r["lang"] or "", r["topic"])
    cells = {}
    for r in rows:
        cells[r["cell"]] = cells.get(r["cell"], 0.0) + r["n"]
    total = sum(cells.values())
    factor = {c: float(t > 0) for c, t in cells.items()}
    targets = []
    for d, power in enumerate(R.POWERS.values()):
        have = {}
        for c, t in cells.items():
            if t > 0:
                have[c[d]] = have.get(c[d], 0.0) + t
        whole = sum(h**power for h in have.values())
        targets.append({v: h**power / whole for v, h in have.items()})
    for _ in range(rounds):
        for d in range(3):
            have = {}
            for c, t in cells.items():
                have[c[d]] = have.get(c[d], 0.0) + t * factor[c]
            factor = {c: f * (targets[d].get(c[d], 0.0) * total / have[c[d]] if have[c[d]] else 0.0) for c, f in factor.items()}
    scale = R.BUDGET
    for _ in range(steps):
        full = sum(cells[c] for c, f in factor.items() if f * scale >= 1)
        rest = sum(cells[c] * f for c, f in factor.items() if f * scale < 1)
        if not rest:
            break
        scale = max(scale, (R.BUDGET * total - full) / rest)
    chance = {c: min(1.0, f * scale) for c, f in factor.items()}
    draw = lambda i: int(hashlib.md5(("mix" if i is None else f"mix:{i}").encode()).hexdigest()[:13], 16) / 16**13
    return sorted((str(r["doc_id"]), r["topic"], r["n"], round(chance[r["cell"]], 6), draw(r["doc_id"]) < chance[r["cell"]]) for r in rows), cells, factor, targets


def test_report_equals_brute_force(spark):
    docs = some_docs(spark)
    got = sorted((str(r.doc_id), r.topic, r.n_tokens, r.probability, r.sampled) for r in R.report(docs).collect())
    assert got == brute(docs)[0]


def test_marginals_meet_their_targets(spark):
    docs = some_docs(spark)
    cells = R.cells_of(docs)
    fitted = R.rake(cells, R.targets_of(cells, R.POWERS), rounds=15).collect()
    whole = sum(r.tokens for r in fitted)
    for d, target in zip(R.DIMENSIONS, brute(docs)[3]):
        for value, share in target.items():
            assert abs(sum(r.tokens * r.factor for r in fitted if r[d] == value) / whole - share) < 1e-3


def test_a_round_writes_one_table_and_groups_without_target_get_nothing(spark, monkeypatch):
    """Before, each step of a round was a job of its own that joined the factors of all dimensions."""
    cells = spark.createDataFrame([("a", "x", 4.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "y", 3.0), ("c", "x", 9.0), ("d", "y", 5.0), ("a", None, 7.0)], "source string, lang string, tokens double")
    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5), ("d", 0.0)], "value string, share double"),
        "lang": spark.createDataFrame([("x", 0.25), ("y", 0.75)], "value string, share double"),
    }
    written, whole = [], R.stage
    monkeypatch.setattr(R, "stage", lambda df: written.append(1) or whole(df))
    fitted = R.rake(cells, targets, rounds=60).collect()
    weight = {(r.source, r.lang): r.tokens * r.factor / 31 for r in fitted}
    assert len(fitted) == 7 and weight["c", "x"] == weight["d", "y"] == weight["a", None] == 0
    assert abs(weight["a", "x"] + weight["a", "y"] - 0.5) < 1e-9 and abs(weight["a", "x"] + weight["b", "x"] - 0.25) < 1e-9
    written.clear()
    R.rake(cells, targets, rounds=4, tolerance=-1.0)
    assert len(written) <= 5


def test_production_setting_meets_the_targets(spark):
    groups = [(s, lang, t) for s in "abc" for lang in ("en", "de") for t in "xy"]
    cells = [(*g, float(n)) for g, n in zip(groups, [900, 90, 50, 30, 60, 80, 40, 50, 70, 300, 30, 20])]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens double")
    targets = R.targets_of(table, R.POWERS)
    fitted = R.rake(table, targets).collect()
    whole = sum(c[3] for c in cells)
    for d in R.DIMENSIONS:
        for value, share in targets[d].collect():
            assert abs(sum(r.tokens * r.factor for r in fitted if r[d] == value) / whole / share - 1) < 1e-9


def test_budget_is_met_and_sample_keeps_columns(spark):
    docs = some_docs(spark, 3000, 2)
    rows = R.report(docs).collect()
    whole = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) / whole - R.BUDGET) < 1e-3
    assert abs(sum(r.n_tokens for r in rows if r.sampled) / whole - R.BUDGET) < 0.06
    kept = R.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.sampled for r in rows)


def test_own_targets(spark):
    docs = some_docs(spark)
    targets = {"lang": spark.createDataFrame([("en", 0.25), ("de", 0.75), ("xx", 0.0)], "value string, share double")}
    fitted = R.rake(R.cells_of(docs), targets, rounds=3).collect()
    whole = sum(r.tokens for r in fitted)
    assert abs(sum(r.tokens * r.factor for r in fitted if r.lang == "de") / whole - 0.75) < 1e-9
    assert all(r.factor == 0 for r in fitted if r.lang == "fr")


def test_empty_tables(spark):
    docs = some_docs(spark, 20)
    assert R.report(docs.limit(0)).count() == 0 and R.sample(docs.limit(0)).columns == docs.columns
    blank = spark.createDataFrame([(1, "", "s", "en"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    assert [r.sampled for r in R.report(blank).collect()] == [False, False]
