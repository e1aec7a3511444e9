import hashlib
import re
import time

from motifline.llm import secrets

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_every_row_gets_the_brute_force_spans(spark, docs):
    rows = secrets.scan_documents(spark, docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    for r in rows:
        assert r.spans == brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [r.spans.count(k) for k in ("assign", "access", "hex")]


def test_failing_matches_are_dropped_and_not_searched_inside(spark):
    df = spark.createDataFrame([(1, "secret: api_key = 12345678 token=token=abcdefgh PASSWORD='x' password:y")], "doc_id long, text string")
    assert secrets.scan_documents(spark, df).first().spans == brute(df.first().text) == "assign:27:47"


def test_a_later_run_scans_unseen_blobs_and_rule_versions_only(spark, docs):
    scanned, found = secrets.advance(docs, *secrets.empty_ledger(spark), rules=secrets.BASE_RULES)
    again, nothing = secrets.advance(docs, scanned, found, rules=secrets.BASE_RULES)
    assert again.count() == 0 and nothing.count() == 0
    newer = secrets.BASE_RULES[:2] + (secrets.Rule("hex", 2, r"[0-9a-f]{40,}"),)
    more = docs.unionByName(docs.limit(0)).select("doc_id", "text").union(spark.createDataFrame([(9, "token=new-secret")], "doc_id long, text string"))
    pairs, added = secrets.advance(more, scanned, found, rules=newer)
    todo = {r.blob: sorted(r.rules) for r in pairs.collect()}
    fresh = hashlib.sha256(b"token=new-secret").hexdigest()
    assert todo.pop(fresh) == ["access/1", "assign/1", "hex/2"]
    assert todo and all(v == ["hex/2"] for v in todo.values())
    paths = secrets.by_path(more, found.union(added), newer)
    kinds = {r.doc_id: [x.kind for x in r.findings] for r in paths.collect()}
    assert kinds[9] == ["assign"] and kinds[5] == ["assign", "hex"] and kinds[1] == kinds[6] == ["assign", "access"]


def test_empty_table(spark, docs):
    assert secrets.scan_documents(spark, docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, docs, capsys):
    secrets.scan_documents(spark, docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_a_text_of_many_matches_and_rows_without_ids(spark):
    """Two texts of 50,000 matches each, in time that follows their number; null ids don't multiply rows."""
    text = "token=abcdefgh1 x " * 50_000
    rows = [(1, text), (2, "é " + text), *[(None, f"secret: {'k' * i}aaaaaaaa") for i in range(1, 40)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.perf_counter()
    found = secrets.scan_documents(spark, df).collect()
    assert time.perf_counter() - start < 60 and len(found) == len(rows)
    assert sorted((r.doc_id or 0, r.spans) for r in found) == sorted((i or 0, brute(t)) for i, t in rows)
