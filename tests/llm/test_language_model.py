"""Backoff scores against counts kept in plain dictionaries."""

import math
import zlib
from collections import Counter

import pytest

from regionpulse.llm import backoff_lm as lm
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS

MU = lm.BackoffModel().mu


def plain_scores(rows):
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, w in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            one.update(w)
            two.update(zip([0, *w], w))
    n, kinds = sum(one.values()), len(one)
    start = one[None]
    p = lambda x: (one[x] + 0.1) / (n + 0.1 * (kinds + 1))
    out = []
    for i, w in tokens:
        base = sum(math.log10(p(x)) for x in w)
        full = sum(math.log10((two[h, x] + MU * p(x)) / ((start if h == 0 else one[h]) + MU)) for h, x in zip([0, *w], w))
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, len(w), sum(one[x] > 0 for x in w), n, base, full))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


def test_query_on_whole_table(spark):
    import __spark_entry__ as E

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = E.queries()["op7_backoff_scores"](spark, SF0001).collect()
    same(got, plain_scores(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than single words


def test_scores_do_not_depend_on_blocks(spark):
    df = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    same(lm.score(df, lm.BackoffModel(rows_per_block=7)).collect(), plain_scores(rows))


def test_odd_rows(spark, docs):
    ids = [None, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    df = docs(ODD_TEXTS, ids=ids, extra="1.0 AS score")
    same(lm.score(df).collect(), plain_scores(list(zip(ids, ODD_TEXTS))))
    assert lm.score(df.limit(0)).collect() == []
    alone = next(i for i in range(100) if lm.held_out(i))
    only = docs(["no training here"], ids=[alone])  # every probability is that of an unknown word: 0.1 / 0.1
    r = lm.score(only).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_probabilities_of_a_state_sum_to_one():
    """Over all known words and one unknown: the arcs of a state and its failure arc share 1."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b", "b c a", "c c"] * 5)]
    one, two = Counter(), Counter()
    for i, t in rows:
        w = t.split() + [None]
        if not lm.held_out(i):
            one.update(w)
            two.update(zip([0, *w], w))
    n, kinds = sum(one.values()), len(one)
    p = {x: (c + 0.1) / (n + 0.1 * (kinds + 1)) for x, c in one.items()}
    unknown = 0.1 / (n + 0.1 * (kinds + 1))
    assert sum(p.values()) + unknown == pytest.approx(1)
    for h in "abc":
        assert sum((two[h, x] + MU * p[x]) / (one[h] + MU) for x in p) + MU * unknown / (one[h] + MU) == pytest.approx(1)
