import hashlib
import random
import re

from pyspark.sql import functions as F

from motifline.llm import lines as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, s, k):
    for _ in range(k):
        i = rnd.randrange(len(s) + 1)
        s = rnd.choice([s[:i] + rnd.choice("ab é|") + s[i:], s[:i] + s[i + 1 :], s[:i] + rnd.choice("ab é") + s[i + 1 :]])
    return s


def test_within_equals_edit_distance(spark):
    rnd = random.Random(1)
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a", "b"), ("x" * 70, "x" * 71)]
    for _ in range(1500):
        a = "".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 14)))
        pairs.append((a, edited(rnd, a, rnd.randint(0, 4))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for tau in (1, 2, 3):
        got = df.select("a", "b", L.within(F.col("a"), F.col("b"), tau).alias("w"), L.near(F.col("a"), F.col("b"), tau).alias("n")).collect()
        for r in got:
            assert r.w == r.n == (distance(r.a, r.b) <= tau), (tau, r)


def test_segments_and_substrings_miss_no_pair(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(600):
        a = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(6, 30)))
        rows.append((a, edited(rnd, a, rnd.randint(0, 2))))
    lines = [line for pair in rows for line in pair]
    texts = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(lines)], "id long, line string, n int")
    own, all_keys = ([set() for _ in lines] for _ in range(2))
    for r in L.keys_of(texts, 2, 1).collect():
        all_keys[r.id].add(r.key)
        if r.own:
            own[r.id].add(r.key)
    signs = {r.id: r for r in texts.select("id", L.signature(F.col("line")).alias("words"), L.letter_signature(F.col("line")).alias("letters")).collect()}
    near = 0
    for k in range(0, len(lines), 2):
        if distance(lines[k], lines[k + 1]) <= 2:
            near += 1
            assert own[k] & all_keys[k + 1] or own[k + 1] & all_keys[k]
            for name, bits in (("words", L.BITS_AN_EDIT), ("letters", L.PAIRS_AN_EDIT)):
                assert ((signs[k][name] ^ signs[k + 1][name]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 2 * bits
        assert len(own[k]) <= 3 and len(all_keys[k]) <= 12
    assert near > 500


def brute(rows):
    rows_in_order = sorted({(d is None, d or 0, t) for d, t in rows if t and t.strip(" \n")}, key=lambda x: x[:2])
    first = {}
    for none, d, t in rows_in_order:
        for p, line in enumerate(t.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (none, d, p))
    near = {a: [b for b in first if a != b and min(len(a), len(b)) >= L.LEAST and abs(len(a) - len(b)) <= L.TAU and distance(a, b) <= L.TAU] for a in first if len(a) >= L.LEAST}
    out = []
    for d, t in rows:
        n = exact = close = links = 0
        kept = []
        for p, line in enumerate((t or "").split("\n")):
            if not line.strip(" "):
                kept.append(line)
                continue
            n += 1
            if first[line] != (d is None, d or 0, p):
                exact += 1
                continue
            links += len(near.get(line, []))
            if any(first[b] < first[line] for b in near.get(line, [])):
                close += 1
            else:
                kept.append(line)
        text = "\n".join(kept) if t is not None else ""
        out.append((str(d), n, exact, close, links, len(text), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def some_rows():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefghij ") for _ in range(rnd.choice([12, 39, 40, 45, 80, 200]))) for _ in range(25)]
    rows = []
    for i in range(60):
        part = [edited(rnd, rnd.choice(base), rnd.choice([0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 6))]
        rows.append((i * 17 % 1009, "\n".join(part + rnd.choice([[], [""], [" "]]))))
    chain = "q" * 60
    for i in range(5):
        chain = edited(rnd, chain, L.TAU)
        rows.append((2000 + i, chain))
    return rows + [(3000, None), (3001, ""), (3002, " \n "), (None, base[0]), rows[7], rows[7], (3003, rows[9][1]), (3004, "z" * 70_000), (3005, "z" * 70_001 + "\ny")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as place", "3 as id", "4 as at", "length(text) + 0L as n_chars", "'x' as _new1")


def test_report_equals_brute_force(spark):
    rows = some_rows()
    expected = brute([r for r in rows if r[0] not in (3004, 3005)])
    got = L.report(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_exact, r.n_near, r.n_links, r.n_chars_left, r.text_sha256) for r in got if r.doc_id not in (3004, 3005)) == expected
    long = {r.doc_id: r for r in got}
    assert long[3004].n_near == 0 and long[3005].n_near == 1 and long[3005].n_chars_left == 1


def test_lines_two_edits_apart_go_and_three_stay(spark):
    line = "the quick brown fox jumps over a lazy dog"
    changed, longer, three = "the quick brown fix jumps over a lazy dig", line + "..", "the quack brown fax jumps over a lazy dug"
    assert [distance(line, t) for t in (changed, longer, three)] == [2, 2, 3] and distance(changed, three) == 3
    got = L.report(frame(spark, [(1, line), (2, changed), (3, longer), (4, three)])).orderBy("doc_id").collect()
    assert [r.n_near for r in got] == [0, 1, 1, 0] and [r.n_links for r in got] == [2, 1, 1, 0]
    assert [r.n_chars_left for r in got] == [len(line), 0, 0, len(three)]


def test_rows_without_lines_left_go_and_columns_stay(spark):
    df = frame(spark, some_rows())
    rows = L.without_repeats(df).collect()
    by_id = {r.doc_id: r for r in rows}
    assert L.without_repeats(df).columns == df.columns and 3003 not in by_id and by_id[3001].text == "" and by_id[3000].text is None
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert L.without_repeats(df.limit(0)).count() == 0 and L.report(df.limit(0)).count() == 0


def changes_of_one_line(n):
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(60))
    lines = {base: None}
    while len(lines) < n:
        lines[edited(rnd, base, 1).strip()] = None
    return list(lines)


def test_homes_equal_brute_force(spark):
    lines = changes_of_one_line(50)
    rows = [(i, line) for i, line in enumerate(lines)] + [(1000, lines[0]), (1001, lines[0] + "xy"), (1002, lines[0] + "xyz")]
    got = L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_exact, r.n_near, r.n_links, r.n_chars_left, r.text_sha256) for r in got) == brute(rows)


def test_changes_of_one_line_are_linked_without_forming_their_pairs(spark):
    for n in (200, 400):
        lines = changes_of_one_line(n)
        rows = [(i, line) for i, line in enumerate(lines)] + [(1000, lines[0])]
        got = {r.doc_id: r for r in L.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[i].n_links == n - 1 for i in range(n)) and sum(r.n_near for r in got.values()) == n - 1
        texts = spark.createDataFrame([(hash(t), t, len(t), 1 + (t == lines[0])) for t in lines], "id long, line string, n int, times long")
        held = texts.select("id", "times", "line", L.signature(F.col("line")).alias("words"), L.letter_signature(F.col("line")).alias("letters"))
        members = L.members_of(texts)
        assert members.count() < 20 * n
        named = held.join(L.homes_of(members, held), "id", "left").withColumn("home", F.coalesce("home", "id"))
        assert L.candidates(members, named).count() < 20 * n


def test_lines_that_differ_in_a_few_words_do_not_meet(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    base = rnd.choices(words, k=20)
    lines = set()
    for _ in range(120):
        line = list(base)
        for i in rnd.sample(range(10, 20), 2):
            line[i] = rnd.choice(words)
        lines.add(" ".join(line))
    texts = spark.createDataFrame([(hash(t), t, len(t), 1) for t in lines], "id long, line string, n int, times long")
    held = texts.select("id", F.col("id").alias("home"), L.signature(F.col("line")).alias("words"), L.letter_signature(F.col("line")).alias("letters"))
    near = sum(a < b and abs(len(a) - len(b)) <= L.TAU and distance(a, b) <= L.TAU for a in lines for b in lines)
    assert near <= L.candidates(L.members_of(texts), held).count() < 3 * len(lines)


def test_plan_has_no_python(spark, capsys):
    L.report(frame(spark, some_rows())).explain()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", capsys.readouterr().out)


def test_a_text_is_hashed_once_and_not_for_each_line(spark):
    """The whole text went along with each of its lines and was hashed there."""
    plan = L.lines_of(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    kept = re.search(r"Generate posexplode\(.*?\), \[(.*?)\]", plan, re.S)[1]
    assert "_row" in kept and "_tag" in kept and "text" not in kept


def test_lines_of_one_length_look_up_one_way(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(6, 30)))
        i, j = sorted(rnd.sample(range(len(a)), 2))
        b = a[:i] + "z" + a[i:j] + a[j + 1 :]
        rows += [a, b] if rnd.random() < 0.5 else [b, a]
    texts = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(rows)], "id long, line string, n int")
    own, every = ([set() for _ in rows] for _ in range(2))
    for r in L.keys_of(texts, 2, 1).collect():
        every[r.id].add(r.key)
        if r.own:
            own[r.id].add(r.key)
    assert all(own[k] & every[k + 1] or own[k + 1] & every[k] for k in range(0, len(rows), 2))
    assert max(map(len, every)) == 11
