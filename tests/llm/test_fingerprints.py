"""Merkle fingerprints: equality, likeness, located edits, following documents."""

import hashlib

from tests.conftest import SF0001
from regionpulse.llm import merkle
from tests.llm.conftest import ODD_TEXTS as ALL_ODD

ODD_TEXTS = ALL_ODD[:10]


def expected(rows):
    """(id, text) in order -> rows by the contract, one after the other."""
    rows = [(i, t or "") for i, t in rows]
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + following[:cut]
        a, b = merkle.tree(t), merkle.tree(edited)
        yield (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), str(a), str(b), merkle.likeness(a, b), merkle.likeness(a, merkle.tree(following)))


def test_query_on_whole_table(spark):
    import __spark_entry__ as E

    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect())
    got = sorted(tuple(r) for r in E.queries()["op1_merkle_fingerprints"](spark, SF0001).collect())
    assert got == sorted(expected(rows))
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)


def test_odd_rows_runs_and_ties(docs):
    ids = [9, 9, 3, -4, 8, 1, 70, 2, 5, 6]
    df = docs(ODD_TEXTS, ids=ids, extra="1 AS fingerprint")
    rows = sorted(zip(ids, ODD_TEXTS), key=lambda r: (r[0], r[1] is not None, (r[1] or "").encode()))
    got = sorted(tuple(r) for r in merkle.fingerprints(df).collect())
    assert got == sorted(expected(rows))
    assert merkle.fingerprints(df.limit(0)).collect() == []
    one = merkle.fingerprints(df.filter("doc_id = 70")).collect()
    assert [tuple(r) for r in one] == list(expected([(70, "a b")]))


def test_many_runs(spark):
    df = spark.range(0, 2500, 7).selectExpr("id AS doc_id", "concat('text ', id % 5, '\\n', id) AS text")
    rows = [(i, f"text {i % 5}\n{i}") for i in range(0, 2500, 7)]
    small = merkle.with_following(df, rows_per_run=10)
    runs = {}
    for r in small.collect():
        runs.setdefault(r["run"], []).append((r["ahead"], r["doc_id"]))
    assert len(runs) > 20
    order = sorted(runs)
    for k, run in enumerate(order):
        own = [i for ahead, i in runs[run] if not ahead]
        assert own == sorted(own) and [i for ahead, i in runs[run] if ahead] == [next(i for a, i in runs[order[(k + 1) % len(order)]] if not a)]
    assert sorted(i for v in runs.values() for a, i in v if not a) == [i for i, _ in rows]


def test_null_ids_come_first(spark):
    df = spark.createDataFrame([(None, "n"), (1, "one one one one"), (2, "two two two two")], "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["edited_sha256"] for r in merkle.fingerprints(df).collect()}
    assert got[2] == hashlib.sha256(("two two two two"[:12] + "n").encode()).hexdigest()
    assert got[1] == hashlib.sha256(("one one one one"[:12] + "two").encode()).hexdigest()


def test_roots_and_located_edits():
    lines = [f"paragraph {k} has some words in it. And another sentence." for k in range(60)]
    a = merkle.tree("\n".join(lines))
    assert merkle.parse(str(a)) == a and merkle.likeness(a, str(a)) == 1.0
    changed = lines[:20] + ["paragraph 20 was edited here"] + lines[21:]
    b = merkle.tree("\n".join(changed))
    assert a.root != b.root and merkle.changed(a, b) == ([20], [20])
    inserted = merkle.tree("\n".join([*lines[:5], "new", *lines[5:]]))
    assert merkle.changed(a, inserted) == ([], [5])
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.tree("entirely other text")) == 0
    roots = {merkle.tree(t).root for t in ("", "\n", "a", "a\n", "\na", "a b", "a  b")}
    assert len(roots) == 7 and merkle.tree(None) == merkle.tree("")


def test_repeated_paragraphs_are_counted():
    a, b = merkle.tree("x y\n" * 10 + "z"), merkle.tree("x y\n" * 4 + "z")
    assert len(merkle.changed(a, b)[0]) == 6 and merkle.likeness(a, b) == 2 * 5 / (11 + 5)
