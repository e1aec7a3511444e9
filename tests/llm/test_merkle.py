import random
from collections import Counter
from hashlib import sha256

from motifline.llm import merkle
from motifline.llm.merkle import Tree


def some_text(rnd, paragraphs):
    word = lambda: "".join(rnd.choices("abcdeé漢", k=rnd.randint(1, 8)))
    return "\n".join(" ".join(word() + rnd.choice(["", "", ".", "!"]) for _ in range(rnd.randint(0, 60))) for _ in range(paragraphs))


def test_leaves_cover_the_text_and_the_string_reads_back():
    rnd = random.Random(1)
    for n in range(40):
        text = some_text(rnd, n)
        tree = Tree.of(text)
        assert tree.length == len(text)
        again = Tree.read(str(tree))
        assert (again.root, again.sections, str(again)) == (tree.root, tree.sections, str(tree))


def test_equal_texts_and_only_they_have_equal_roots():
    texts = ["", " ", "\n", "a", "a\n", "a.", "a. ", "x" * 9000, "a b c. d e f.\n\nsecond"]
    assert len({Tree.of(t).root for t in texts}) == len(texts)
    assert all(str(Tree.of(t)) == str(Tree.of(t)) for t in texts)
    assert merkle.likeness(Tree.of(""), Tree.of("")) == 1.0 and merkle.likeness(Tree.of(""), Tree.of("a")) == 0.0


def test_edits_are_located_and_cost_little():
    rnd = random.Random(2)
    text = some_text(rnd, 60)
    for _ in range(30):
        at = rnd.randrange(len(text))
        changed = text[:at] + "INSERTED " + text[at + 3 :]
        a, b = Tree.of(text), Tree.of(changed)
        assert 0.9 < merkle.likeness(a, b) < 1
        spans = merkle.edits(a, b)
        assert spans and any(s <= at < e for s, e, _, _ in spans) and sum(e - s for s, e, _, _ in spans) < 900
        rebuilt, end = "", 0
        for s, e, u, v in spans:
            rebuilt += text[end:s] + changed[u:v]
            end = e
        assert rebuilt + text[end:] == changed


def plain_likeness(a, b):
    """From the printed fingerprints alone: counted sections, then paragraphs, then leaves in common."""
    length = lambda part: sum(int(leaf[8:], 16) for p in part.split(":")[-1].split(",") for leaf in p.rpartition("-")[2].split("."))
    x, y = (Counter(filter(None, f.partition("|")[2].split(";"))) for f in (a, b))
    whole = sum(length(p) * n for c in (x, y) for p, n in c.items())
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    common = 0
    for parts in (lambda s: s.partition(":")[2].split(","), lambda p: p.partition("-")[2].split("."), None):
        common += sum(length(p) * n for p, n in (x & y).items())
        x, y = x - y, y - x
        if parts:
            x, y = (sum((Counter({q: k * n for q, k in Counter(parts(p)).items()}) for p, n in c.items()), Counter()) for c in (x, y))
    return min(2 * common / whole, 1 - 1e-9)


def test_likeness_equals_a_plain_count_over_fingerprints():
    rnd = random.Random(9)
    seen = set()
    for _ in range(60):
        text = some_text(rnd, rnd.randint(0, 12))
        lines = text.split("\n") + some_text(rnd, rnd.randint(0, 4)).split("\n")
        rnd.shuffle(lines)
        at = rnd.randint(0, len(text))
        for other in (text, "\n".join(lines), text[:at] + "new " + text[at:], text + "\n" + text, some_text(rnd, 5), ""):
            a, b = Tree.of(text), Tree.of(other)
            got = merkle.likeness(a, b)
            assert got == merkle.likeness(b, a) == plain_likeness(str(a), str(b)) and 0 <= got <= 1
            seen.add(round(got, 1))
    assert len(seen) > 6


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        t, e, f = Tree.of(text), Tree.of(edited), Tree.of(after)
        out.append((str(doc_id), len(text), sha256(edited.encode()).hexdigest(), str(t), str(e), merkle.likeness(t, e), merkle.likeness(t, f)))
    return sorted(out)


def test_next_document_over_buckets(spark, docs):
    rnd = random.Random(3)
    tables = [docs.collect(), [(i * 7 % 101, some_text(rnd, 5)) for i in range(101)], [(5, "abcdef")], [(None, "abc"), (None, None)], [(3, "same")] * 9]
    for rows in tables:
        rows = [(r[0], r[1]) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for buckets in (1, 3, 16):
            got = sorted((str(r[0]), *r[1:]) for r in merkle.against_edits(df, buckets).collect())
            assert got == brute(rows)


def test_empty_table(spark, docs):
    assert merkle.against_edits(docs.limit(0), 4).count() == 0


def test_fingerprints(spark, docs):
    rows = merkle.fingerprints(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count() and all(r.fingerprint == str(Tree.of(texts[r.doc_id])) for r in rows)
