"""Ball-tree search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from regionpulse.llm import ball_tree as bt
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the contract's formula over all documents."""
    found = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = set()
    for item, text in items:
        q = Counter(terms(text))
        scores = []
        for i, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if score > 0:
                scores.append((-score, (i is not None, i), i))
        out |= {(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_query_on_whole_table(spark):
    import __spark_entry__ as E

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    got = E.queries()["op12_ball_tree_search"](spark, SF0001).collect()
    assert len(got) > 5 * len(items) and {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got} == plain(docs, items)


def vectors(rng, rows, n_terms, repeat=1):
    """Rows in a few families, with repeated rows, so that there are ties and nodes of radius 0."""
    families = [rng.sample(range(n_terms), 12) for _ in range(6)]
    made = []
    while len(made) < rows:
        family = rng.choice(families)
        one = {t: rng.choice([1, 500_000, 999_999]) for t in rng.sample(family, rng.randint(1, 9)) + rng.sample(range(n_terms), 2)}
        made += [one] * rng.choice([1, 1, repeat])
    return made[:rows]


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_all_rows_and_bounds_hold(seed):
    rng = random.Random(seed)
    rows = vectors(rng, rng.choice([1, 33, 700]), 80, repeat=40)
    size = [len(r) for r in rows]
    flat = [(t, v) for r in rows for t, v in sorted(r.items())]
    tree = bt.BallTree(np.concatenate([[0], np.cumsum(size)]), np.array([t for t, _ in flat]), np.array([v for _, v in flat]), 80, leaf_rows=8)
    ids = list(range(1000, 1000 - len(rows), -1))
    dense = np.zeros(80, np.int64)
    opened = [0]
    for _ in range(25):
        q = {t: rng.choice([0, 3, 700, 9_000_000]) for t in rng.sample(range(80), rng.randint(1, 12))}
        t = np.array(sorted(q))
        w = np.array([q[x] for x in t])
        best = []
        tree.search(t, w, ids, best, 10, dense)
        scores = [sum(q.get(x, 0) * v for x, v in r.items()) for r in rows]
        want = sorted(((s, -i) for s, i in zip(scores, ids) if s > 0), reverse=True)[:10]
        assert sorted([b[:2] for b in best], reverse=True) == want and not dense.any()
        stack = [tree.root]
        while stack:
            ball = stack.pop()
            inside = tree.order[ball.low:ball.high]
            assert bt.BallTree.bound(ball, t, w.astype(float)) >= max(scores[i] for i in inside)
            stack += ball.children
            opened[0] += 1
    assert sorted(tree.order.tolist()) == list(range(len(rows)))


def test_search_prunes_subtrees(monkeypatch):
    rng = random.Random(1)
    rows = vectors(rng, 4000, 3000)
    size = [len(r) for r in rows]
    flat = [(t, v) for r in rows for t, v in sorted(r.items())]
    tree = bt.BallTree(np.concatenate([[0], np.cumsum(size)]), np.array([t for t, _ in flat]), np.array([v for _, v in flat]), 3000)
    seen = []
    monkeypatch.setattr(bt.BallTree, "bound", staticmethod(lambda ball, t, q, bound=bt.BallTree.bound: seen.append(ball) or bound(ball, t, q)))
    best, family = [], max(rows, key=len)
    tree.search(np.array(sorted(family)), np.full(len(family), 1000), list(range(4000)), best, 10, np.zeros(3000, np.int64))
    assert len(best) == 10 and len(seen) < 120  # of about 250 nodes


def test_odd_rows_ties_blocks_and_clashing_names(spark, docs):
    texts = [*ODD_TEXTS, "alpha beta gamma", "ALPHA beta_gamma", "alpha-beta gamma", *["tie tie word"] * 14, "x" * 3000 + " alpha " * 4000, "İstanbul été Été ÉTÉ", "42 4 2"]
    ids = [None, None, *range(len(texts) - 2, 0, -1)]
    df = docs(texts, ids=ids).selectExpr("*", "1 AS n", "2 AS terms", "'r' AS rank", "0 AS query")
    items = [(1, "Alpha BETA beta gamma"), (2, "tie word nothere"), (3, None), (4, ""), (5, "!? ##"), (6, "word été 42 42 中文字"), (1, "the cat"), (7, "nothere")]
    table = spark.createDataFrame(items, "item_id BIGINT, text STRING").selectExpr("*", "5 AS doc_id", "6 AS score")
    rows = list(zip(ids, texts))
    for block, entries, leaf in ((200_000, 400_000, 32), (1, 1, 2)):
        got = [tuple(r) for r in bt.search(df, table, block_terms=block, tree_entries=entries, leaf_rows=leaf).collect()]
        # null ids come first
        want = plain([(-1 if i is None else i, t) for i, t in rows], items)
        assert {(a, b, -1 if c is None else c, d) for a, b, c, d in got} == want
    assert bt.search(df.limit(0), table).collect() == [] and bt.search(df, table.limit(0)).collect() == []
    assert bt.search(df.filter("text is null"), table).collect() == []


def test_terms():
    for t in [*ODD_TEXTS, "Az09_é-×÷\x7f\x80 ￿", "ŻÓŁĆ zażółć İ"]:
        assert [x.decode() for x in bt.terms_of(t)] == terms(t)
