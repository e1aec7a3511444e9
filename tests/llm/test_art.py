import hashlib
import random
import zlib

import pytest

from motifline.llm import art


def brute(rows):
    """The trie from its definition, with every head as a tuple."""
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            pair = (role or "", text or "")
            tie = hashlib.sha256(f"{len(pair[0].encode())}:{pair[0]}{pair[1]}".encode()).digest()[:16]
            held.setdefault(conv, []).append((turn is not None, turn or 0, tie, pair))
    held = {c: [t[3] for t in sorted(v)] for c, v in held.items()}
    rebuilt = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(held.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in members}
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(kids[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "'x' as key", "2 as n", "3 as prefix").repartition(3)
    return sorted(repr(tuple(r)) for r in art.trie(df).drop("prefix").collect())


def made(seed, convs, texts, longest):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for c in rnd.sample(range(4 * convs), convs) for t in range(rnd.randrange(longest + 1))]


@pytest.mark.parametrize("pages,tree", [(128, 4096), (2, 3), (3, 1)])
def test_equals_the_definition(spark, monkeypatch, pages, tree):
    monkeypatch.setattr(art, "PAGE_TURNS", pages)
    monkeypatch.setattr(art, "TREE_PAGES", tree)
    rows = made(pages, 60, ["a", "b", "é" * 9, None], 14)
    assert got(spark, rows) == brute(rows)


def test_copies_a_common_first_turn_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(art, "PAGE_TURNS", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300, 5) for t in range(4)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(400, 480) for t in range(3)]
    rows += [(c, t, "system", "x" * (t % 7)) for c in (1000, 1005) for t in range(150)]
    assert got(spark, rows) == brute(rows)


def test_nulls_ties_copies_and_empty_tables(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "user", "a"), (1, 0, "user", "a"), (5, 3, "", ""), (6, 1, "user", "ab"), (7, 1, "us", "erab")]
    rows += [(None, 0, "user", "no id"), (8, None, None, "x"), (8, None, None, "x"), (10, 0, "user", "long " * 100_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(None, 0, "a", "b")]) == [] and got(spark, []) == []


def test_radix_tree_holds_what_was_put_in():
    rnd = random.Random(3)
    heads = [bytes(rnd.randrange(256) for _ in range(16)) for _ in range(3)]
    keys = [b"", heads[0], heads[0] + heads[1], heads[2]] + [h[:k] + bytes([i]) + bytes(15 - k) for h in heads for k in (0, 7, 15) for i in range(0, 256, 3)]
    keys = [bytes(k) for k in keys] * 2
    rnd.shuffle(keys)
    tree = art.Tree(lambda a, b: [a[0] + b[0]])
    for k in keys:
        tree.insert(k, [1])
    found = {}
    for prefix, shorter, turns, total, own in tree.turns(art.ROOT):
        found[prefix] = (shorter, turns, total[0], own[0] if own else 0)
    want = {}
    for k in set(keys):
        p = art.ROOT
        for t in range(len(k) // 16 + 1):
            head, before = k[: 16 * t], p
            p = art.longer(art.ROOT, p, k, t) if t else p
            want[p] = (before if t else None, t, sum(x[: len(head)] == head for x in keys), keys.count(head))
    assert found == want


def test_layouts_grow_with_their_children():
    node, layouts = art.Inner(b""), []
    order = list(range(256))
    random.Random(1).shuffle(order)
    for n, byte in enumerate(order, 1):
        node.put(byte, art.Leaf(bytes([byte]), [n]))
        layouts.append(node.layout)
        assert node.get(byte).sums == [n]
    assert [layouts.index(x) for x in (4, 16, 48, 256)] == [0, 4, 16, 48]
    node.put(7, art.Leaf(b"\x07", [0]))
    assert [b for b, _ in node.items()] == list(range(256)) and node.get(7).sums == [0]


def test_query_columns(spark, sf):
    from motifline.llm.catalog import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries()["op11_conversation_prefix_trie"](spark, sf)
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)
