import random
from hashlib import sha256

import numpy as np

from motifline.llm import suffixes as S


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, hash) by a table of all 50-byte strings."""
    first = {}
    for d, t in rows:
        data = (t or "").encode()
        if d is not None:
            for i in range(len(data) - 49):
                s = data[i : i + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        if d is not None:
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out.append((str(d), len(data), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(out)


def some_rows(seed, n=60, letters="abcdefgh é漢\n"):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(letters) for _ in range(k))
    passages = [word(rnd.choice([20, 49, 50, 51, 80, 200, 400])) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, len(p))
            parts.append(rnd.choice([word(rnd.randint(1, 120)), p, p[cut:], p[:cut], word(3)]))
        rows.append((rnd.randrange(10_000), "".join(parts)))
    base = word(900)
    for _ in range(6):
        at = rnd.randrange(900)
        rows.append((rnd.randrange(10_000), base[:at] + word(4) + base[at + 4 :]))
    rows += [(20_000, "a" * 400), (20_001, "a" * 300), (20_002, "ab" * 99), (20_003, "ba" * 70), (20_004, "\0" * 60), (20_005, "\0" * 70)]
    rows += [rows[3], rows[3], (None, rows[3][1]), (30_000, None), (30_001, ""), (rows[5][0], rows[6][1]), (30_002, rows[8][1])]
    return rows


def test_runs_are_front_coded_and_merge_in_order_without_rereading_prefixes():
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"ab") for _ in range(200)) for _ in range(6)]
    runs, every = [], []
    for t in texts:
        keys = S.keys_at(t, np.arange(180))
        keys[:, : S.HASH] = 0  # so that long prefixes are shared
        keys, _, _ = S.sorted_run(keys, np.zeros(180, np.int64), np.zeros(180, np.int32), np.arange(180))
        runs.append(S.front_coded(keys))
        every += [k.tobytes() for k in keys]
    got = list(S.merged(runs))
    assert [k for _, _, k in got] == sorted(every)
    before = None
    for _, shared, k in got:
        if before is not None:
            true = next((i for i in range(S.KEY) if before[i] != k[i]), S.KEY)
            assert shared == true
        before = k
    assert list(S.merged([])) == [] and [k for _, _, k in S.merged(runs[:1])] == sorted(every[: len(runs[0][0])])


def test_every_string_has_an_anchor_at_the_same_place():
    rnd = random.Random(2)
    for _ in range(60):
        s = bytes(rnd.choice(b"abc") for _ in range(50))
        places = []
        for _ in range(3):
            before = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 90)))
            data = before + s + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 90)))
            at, _ = S.anchors(data)
            places.append({p - len(before) for p in at.tolist() if 0 <= p - len(before) <= S.BEFORE})
        assert set.intersection(*places)


def test_equal_to_brute_force(spark):
    for seed, ranges in ((1, 1), (2, 5), (3, 16)):
        rows = some_rows(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tag", "2 as place", "3 as _text", "4 as lost").repartition(5)
        got = sorted((str(r[0]), *r[1:]) for r in S.without_repeats(df, ranges).collect())
        assert got == brute(rows)


def test_small_flushes(spark, monkeypatch):
    monkeypatch.setattr(S, "ANCHORS_A_FLUSH", 50)
    monkeypatch.setattr(S, "SUFFIXES_A_RUN", 30)
    rows = some_rows(4, letters="ab ")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r[0]), *r[1:]) for r in S.without_repeats(df, 7).collect()) == brute(rows)


def test_no_rows(spark):
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0
    alone = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    assert S.without_repeats(alone, 4).first().n_removed == 0
