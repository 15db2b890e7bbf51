"""Near duplicates against all pairs on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionpulse.llm import tensor_minhash as tm
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS


def shingles(text, width=2):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def plain_components(rows, threshold=80):
    """{id: (size, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= threshold * (len(x) + len(y) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_on_whole_table(spark):
    import __spark_entry__ as E

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = E.queries()["op9_tensor_minhash"](spark, SF0001).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def families(seed=0):
    """Chains of edits, copies, short texts, and a large family whose members share most words."""
    rnd = random.Random(seed)
    vocab = [f"v{k}" for k in range(3000)]
    texts = []
    for _ in range(12):
        w = rnd.choices(vocab, k=rnd.choice([6, 20, 80, 300]))
        for _ in range(8):  # each a few edits from the last: links in a chain
            for _ in range(max(1, len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
    passage = " ".join(rnd.choices(vocab, k=100))
    texts += [passage + " " + " ".join(rnd.choices(vocab, k=rnd.choice([5, 10, 25, 40]))) for _ in range(60)]  # near 0.8 on both sides
    texts += [texts[0].upper()] * 4 + ["two words"] * 3 + ["two", "TWO"]
    rnd.shuffle(texts)
    return texts


def test_families_lose_no_link(docs):
    texts = families()
    got = as_dict(tm.near_duplicates(docs(texts)))
    want = plain_components(list(enumerate(texts)))
    # a link near 0.8 is proposed with probability 0.9996; here none is lost
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 60


def test_odd_rows_ties_and_names(spark, docs):
    ids = [5, 5, 1, 2, 3, None, 7, 8, 9, 10, 11, 12]
    df = docs(ODD_TEXTS, ids=ids, extra="1 AS kept")
    got = tm.near_duplicates(df).collect()
    assert len(got) == len(ids) and {r["doc_id"]: r["n_shingles"] for r in got}[3] == 1
    assert next(r for r in got if r["doc_id"] is None)["kept"]
    assert tm.near_duplicates(df.limit(0)).collect() == [] and tm.one_per_group(df.limit(0)).collect() == []
    empty = tm.near_duplicates(docs([None, "", "  "])).collect()
    assert all(r["kept"] and r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in empty)


def test_rows_that_share_an_id_link_their_texts(docs):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    got = as_dict(tm.near_duplicates(docs([a, b, a, b], ids=[4, 4, 2, 9])))
    assert {c for _, c in got.values()} == {2}
    kept = tm.one_per_group(docs([a, b, a, b, "other text", "other text"], ids=[4, 4, 2, 9, 7, 7])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, a), (7, "other text")]


def test_one_document_of_each_group_stays(docs):
    texts = families(3)
    df = docs(texts, extra="'x' AS component_id")
    want = plain_components(list(enumerate(texts)))
    kept = tm.one_per_group(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(300, 300)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["comp"] for r in tm.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, **{k: 200 for k in range(200, 209)}}


def test_minimum_hashes_estimate_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(2 * 2000 * share / (1 + share))  # common elements of two sets of 2000
        a, b = base[:2000], base[2000 - n:4000 - n]
        sig = tm.minimum_hashes([a, b], 600)
        assert abs((sig[0] == sig[1]).mean() - share) < 0.08


def test_recall_of_the_tables():
    """Share of pairs of similarity 0.8 that get a common key."""
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
        sig = tm.minimum_hashes([x[:900], x[100:]], 2 * tm.K * tm.M).reshape(2, 2 * tm.M, tm.K)
        same = (sig[0] == sig[1]).all(axis=1)
        found += same[:tm.M].any() and same[tm.M:].any()
    assert found >= 298


def test_blocks_miss_no_pair(spark):
    """Small blocks give the pairs that one block of the whole bucket gives."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 32, 2 * tm.K * tm.M, dtype=np.uint32)
    sigs, comp = {}, {}
    for rep in range(60):
        sig = base.copy()
        sig[rng.choice(len(sig), 10, replace=False)] = rep  # alike in at least 52 of 72
        sigs[rep], comp[rep] = sig, 0 if rep < 35 else 35 + (rep - 35) % 4
    table = spark.createDataFrame([(r, bytearray(x.tobytes())) for r, x in sigs.items()], "rep BIGINT, sig BINARY")
    # the first common key of a pair depends on its slot: ask under every slot
    rows = [(r, 100, comp[r]) for r in sigs]
    every = spark.createDataFrame(rows, "rep BIGINT, n BIGINT, comp BIGINT").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(tm.M * tm.M - 1)))).withColumn("key", F.col("slot").cast("long"))
    members = every.select("key", "slot", "rep", "n", "comp")
    whole, dealt = (sorted((min(r), max(r)) for r in tm.cross_pairs(members, table, tm.K, tm.M, most=most).collect()) for most in (1000, 7))
    assert whole == dealt and len(set(whole)) == len(whole) and all(comp[a] != comp[b] for a, b in whole)
    band = {r: x.reshape(2 * tm.M, tm.K) for r, x in sigs.items()}
    for a in sigs:
        for b in range(a + 1, 60):
            same = (band[a] == band[b]).all(axis=1)
            if comp[a] != comp[b] and (sigs[a] == sigs[b]).sum() >= 0.55 * 72 and same[:tm.M].any() and same[tm.M:].any():
                assert (a, b) in set(whole)


def test_clashing_names_and_repeated_ids(docs):
    df = docs(["one two three"] * 3 + ["x y z"], ids=[5, 5, 7, 7]).selectExpr("*", "1 AS _at", "2 AS at", "3 AS row", "'k' AS kept", "4 AS n", "5 AS component_id")
    kept = tm.one_per_group(df)
    assert kept.columns == df.columns and [(r["doc_id"], r["_at"], r["row"]) for r in kept.collect()] == [(5, 1, 3)]


def test_scratch_tables_are_removed(spark, docs):
    import os

    from regionpulse.session import checkpoint_dir

    folder = checkpoint_dir(spark).replace("file:", "")
    before = set(os.listdir(folder))
    got = tm.one_per_group(docs(["a b c", "a b c", "d e f"]))
    assert len(set(os.listdir(folder)) - before) == 2 and got.count() == 2


def test_packed_pairs_bring_each_text_once(spark, docs):
    """All pairs of 300 texts, and an id with two texts: the links of ``confirmed`` from far fewer joined rows."""
    texts = [t for t in families(3) if t][:300]
    rows = docs([*texts, texts[1] + " more"], ids=[*range(len(texts)), 0]).selectExpr("doc_id as id", "text")
    pairs = spark.range(len(texts)).selectExpr("id as a").crossJoin(spark.range(len(texts)).selectExpr("id as b")).filter("a < b")
    groups = pairs.coalesce(1).mapInArrow(tm.pair_groups, "pairs binary").withColumn("g", F.monotonically_increasing_id())
    packed = [np.frombuffer(r["pairs"], np.int64).reshape(-1, 2) for r in groups.collect()]
    assert sum(map(len, packed)) == len(texts) * (len(texts) - 1) // 2 and max(len(np.unique(p[:, 0])) for p in packed) <= 100
    assert sum(len(np.unique(p)) for p in packed) < sum(map(len, packed)) / 4
    want = {tuple(r) for r in tm.confirmed(pairs, rows, 2, 80).collect()}
    assert {tuple(r) for r in tm.confirmed_groups(groups, rows, 2, 80).collect()} == want and want


def test_members_of_one_bucket_leave_it_with_units_not_pairs(spark):
    """Members that are alike in pairs but in many components: rows grow with members times units, and lose no pair."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 32, 2 * tm.K * tm.M, dtype=np.uint32)
    sigs = {}
    for rep in range(120):
        sig = base.copy()
        sig[rng.choice(len(sig), 6, replace=False)] = rep
        sigs[rep] = sig
    table = spark.createDataFrame([(r, bytearray(x.tobytes())) for r, x in sigs.items()], "rep BIGINT, sig BINARY")
    comp = {r: 0 if r < 40 else r for r in sigs}
    every = spark.createDataFrame([(r, 100, comp[r], r // 30) for r in sigs], "rep BIGINT, n BIGINT, comp BIGINT, unit BIGINT")
    every = every.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(tm.M * tm.M - 1)))).withColumn("key", F.col("slot").cast("long"))
    pairs = tm.cross_pairs(every.drop("unit"), table, tm.K, tm.M, most=50).distinct().collect()
    tries = {tuple(r) for r in tm.cross_pairs(every, table, tm.K, tm.M, most=50).collect()}
    assert len(pairs) > 4000 and len(tries) <= 4 * 120
    assert all((a, b // 30) in tries or (b, a // 30) in tries for a, b in pairs)


def test_units_give_a_link_to_each_linked_component(spark, docs):
    """Texts against units of 7, one of them tried by more than fit a part, and an id with two texts."""
    texts = [t for t in families(3) if t][:120]
    rows = docs([*texts, texts[1] + " more"], ids=[*range(len(texts)), 0]).selectExpr("doc_id as id", "text")
    pairs = spark.range(len(texts)).selectExpr("id as a").crossJoin(spark.range(len(texts)).selectExpr("id as b")).filter("a != b")
    comp = lambda i: i // 3
    units = spark.range(len(texts)).selectExpr("id as rep", "id div 3 as comp", "id div 7 as unit")
    tries = units.select("rep").crossJoin(units.select("unit").distinct())
    want = {(a, b // 7, comp(b)) for a, b in tm.confirmed(pairs, rows, 2, 80).collect() if comp(a) != comp(b)}
    got = [tuple(r) for r in tm.confirmed_units(tries, units, rows, 2, 80, most=50).collect()]
    linked = {tuple(r) for r in tm.confirmed(pairs, rows, 2, 80).collect()}
    assert want and {(a, b // 7, comp(b)) for a, b in got} == want and set(got) <= linked
    assert tm.confirmed_units(tries.limit(0), units, rows, 2, 80).collect() == []
