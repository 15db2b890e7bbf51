"""Best-two-fit packing: patterns against a bin-by-bin version, places, ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from regionpulse.llm import two_fit
from regionpulse.llm.common import vocabulary
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS

PATH = vocabulary("byte_bpe_50k.json")


def one_by_one(lengths, size):
    """The method with one bin after the other, by plain search."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        b = [left.pop(0)]
        while (x := next((v for v in left if v <= size - sum(b)), None)) is not None:
            left.remove(x)
            b.append(x)
        while len(b) > 1 and sum(b) < size:
            b.sort(reverse=True)
            room = size - sum(b[:-1])
            best = max(((x + y, -y, x, y) for i, x in enumerate(left) for y in left[i + 1:] if x + y <= room), default=(0,))
            if best[0] <= b[-1]:
                break
            left.append(b.pop())
            for x in best[2:]:
                left.remove(x)
                b.append(x)
            left.sort(reverse=True)
        bins.append(tuple(sorted(b, reverse=True)))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_patterns_equal_bin_by_bin(seed):
    rng = random.Random(seed)
    size = rng.choice([20, 50, 64])
    lengths = [rng.randint(1, size if seed % 2 else size // 2) for _ in range(rng.choice([1, 30, 120]))]
    packed = two_fit.patterns(Counter(lengths), size)
    assert Counter(tuple(b) for n, b in packed for _ in range(n)) == Counter(one_by_one(lengths, size))


def test_two_replace_the_smallest():
    # greedy: 10 + 6 + 3 (gap 1); 4 + 0 left for the 3: two pieces 2 + 2 fit exactly
    assert two_fit.patterns({10: 1, 6: 1, 3: 1, 2: 2}, 20)[0] == (1, [10, 6, 2, 2])
    # a pair of one length needs two of it
    assert two_fit.patterns({10: 1, 6: 1, 3: 1, 2: 1}, 20) == [(1, [10, 6, 3]), (1, [2])]
    assert two_fit.patterns({}, 20) == [] and two_fit.patterns({20: 10**12}, 20) == [(10**12, [20])]


def test_huge_counts_take_few_patterns():
    rng = np.random.default_rng(3)
    counts = {k: int(n) for k, n in zip(range(1, 2049), rng.integers(1, 10**9, 2048))}
    packed = two_fit.patterns(counts)
    total = sum(k * n for k, n in counts.items())
    held = Counter()
    for n, b in packed:
        assert sum(b) <= 2048
        for x in b:
            held[x] += n
    assert held == counts and len(packed) < 2 * 2048
    assert sum(n for n, _ in packed) <= 1.01 * total / 2048


def check(rows, texts, size):
    """Pieces rebuild each document's ids, sequences are gapless and within the size."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // size))) and sum(r["length"] for r in parts) == len(ids)
        for r in parts:
            assert r["length"] == size or r["piece"] == 0
            data = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(data) == r["ids_crc32"]
            if "token_ids" in r:
                assert data == bytes(r["token_ids"])
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_seq)


def test_query_on_whole_table(spark):
    import __spark_entry__ as E

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = E.queries()["op11_best_two_fit"](spark, SF0001).collect()
    n = check(rows, texts, 2048)
    lengths = [r["length"] for r in rows]
    assert -(-sum(lengths) // 2048) <= n <= -(-sum(lengths) // 2048) + 1
    assert Counter(lengths) == Counter(x for b in one_by_one(lengths, 2048) for x in b) and n == len(one_by_one(lengths, 2048))


def test_odd_rows_and_sequences(docs):
    texts = [*ODD_TEXTS, "a<|endoftext|>b", "<|endoftext|>" * 70, "<|endoftext|>" * 63, "<|endoftext|>" * 64]
    df = docs(texts).selectExpr("*", "1 AS length", "'x' AS sequence_id", "2 AS _b", "3 AS _key")
    packed = two_fit.pack(df, PATH, size=64, keep_ids=True)
    rows = [r.asDict() for r in packed.collect()]
    n = check(rows, dict(enumerate(texts)), 64)
    whole = two_fit.sequences(packed).collect()
    assert len(whole) == n and all(len(r["token_ids"]) == 4 * r["n_tokens"] <= 256 for r in whole)
    first = {r["sequence_id"]: r for r in whole}
    for r in rows:
        data = bytes(first[r["sequence_id"]]["token_ids"])
        assert data[4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["token_ids"])
    assert two_fit.pack(df.limit(0), PATH).collect() == []


def test_repeated_rows_and_null_ids(docs):
    df = docs(["same text here"] * 40 + [None] * 5, ids=[7] * 30 + [None] * 15)
    rows = two_fit.pack(df, PATH, size=16).collect()
    assert len(rows) == 45 and Counter(r["length"] for r in rows) == {4: 40, 1: 5}
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == 45 and len({s for s, _ in places}) == -(-165 // 16)


def test_encoding_equals_library():
    library, own = Tokenizer.from_file(PATH), two_fit.encoding(PATH)
    rng = random.Random(5)
    pool = list("abzAZ09 '’\t\n\r\x0b 　.,!#é中😀́") + ["'s", "'LL", "<|endoftext|>", "  ", "ſ", "İ", "\x1c", "\x85", "�"]
    for _ in range(1500):
        t = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        assert own.encode_to_numpy(t, allowed_special="all").tolist() == library.encode(t, add_special_tokens=False).ids
