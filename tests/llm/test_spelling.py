"""Spelling variants: trie searches against all pairs, counts and chains against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from regionpulse.llm import frequency_trie as ft
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(rows, least_chars=6, least_count=5, lost=199):
    n = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % lost == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= least_chars
    return {w: c for w, c in n.items() if c >= least_count and len(w) >= least_chars}


def plain(counts, dominance=5):
    words = sorted(counts)
    around = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if abs(len(a) - len(b)) < 2 and near(a, b):
                around[a].append(b)
                around[b].append(a)
    form = {}
    for w, others in around.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= dominance * counts[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(around[w]), counts.get(form.get(w))))
    return out


def variants_of(words, rng, letters="abcdeéo"):
    out = set(words)
    for w in words:
        for _ in range(3):
            k = rng.randrange(len(w))
            out |= {w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:], w[:k] + w[k:][::-1]}
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_each_pair_once(seed):
    rng = random.Random(seed)
    words = variants_of({"".join(rng.choices("abcdeéo", k=rng.randint(2, 8))) for _ in range(60)}, rng)
    trie = ft.Trie(words)
    found = Counter(frozenset((w, x)) for w in words for x in trie.near(w))
    assert set(found.values()) <= {1}
    assert set(found) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b)}


def test_reachable_tops_cover_all_near_words():
    rng = random.Random(9)
    words = variants_of({"".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(30)}, rng, "abcdefghij")
    for depth in (1, 2, 4, 1 + ft.GROUPS):
        tops = {w: dict(ft.reachable(ft.path_of(w), depth)) for w in words}
        for i, a in enumerate(words):
            for b in words[i + 1:]:
                if near(a, b):
                    finds = [x for x, y in ((a, b), (b, a)) if (top := ft.path_of(y)[:depth]) in tops[x] and y in ft.Trie([y], depth).near(x, tops[x][top])]
                    assert len(finds) == 1


@pytest.mark.parametrize("most_words", [15, 5000])
def test_pairs_in_small_blocks(spark, most_words):
    rng = random.Random(2)
    one_path = ["".join(rng.sample("abcdefgh", 8)) for _ in range(120)]  # one leaf with many words
    words = variants_of({*one_path, *("".join(rng.choices("abcdeéo", k=7)) for _ in range(30))}, rng)
    table = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(words)], "word STRING, n BIGINT")
    got = ft.near_pairs(table, most_words=most_words, searches_per_task=500).collect()
    number = {w: 5 + k for k, w in enumerate(words)}
    assert all(number[r["a"]] == r["n_a"] and number[r["b"]] == r["n_b"] for r in got)
    assert Counter(frozenset((r["a"], r["b"])) for r in got) == Counter(frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1:] if near(a, b))


def test_query_on_whole_table(spark):
    import __spark_entry__ as E

    counts = plain_counts([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()])
    got = {tuple(r) for r in E.queries()["op13_frequency_trie"](spark, SF0001).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert len(got) == len(counts) > 100 and got == plain(counts)


def test_odd_rows_ties_and_chains(docs):
    texts = [*ODD_TEXTS, "Spelling " * 700 + "spelking " * 90 + "speking " * 11 + "speling " * 700, "ÀÉÎÕÜÿ " * 9 + "ÀÉÎÕÜþ " * 9 + "éclair_éclairs " * 60,
             "banana bananas " * 30 + "banane " * 6 + "Banane " * 20, "word1234 abcdefg-abcdefh " * 10, *["the same repeated spelling"] * 6]
    ids = [None, None, *range(2, len(texts))]
    df = docs(texts, ids=ids).selectExpr("*", "1 AS word", "2 AS n", "'x' AS top", "'h' AS h")
    got = {tuple(r) for r in ft.variants(df, most_words=3).collect()}
    assert got == plain(plain_counts(list(zip(ids, texts))))
    by = {r[0]: r for r in got}
    assert by["speking"][1:3] == ("speling", "speling") and by["spelking"][1] == "spelling"
    assert ft.variants(df.limit(0)).collect() == [] and ft.variants(df.filter("doc_id = 3")).collect() == []


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("x", "w3"), ("y", "z")]
    got = dict(tuple(r) for r in ft.roots(spark.createDataFrame(chain, "word STRING, form STRING")).collect())
    assert got == {**{f"w{k}": "w11" for k in range(11)}, "x": "w11", "y": "z"}
