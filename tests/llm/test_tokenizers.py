"""Token counts and BPE against the libraries that the vocabulary files belong to."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from regionpulse.llm.bpe_segment import PairTree, WordBpe, bpe_round_trip
from regionpulse.llm.common import vocabulary
from regionpulse.llm.fst_tokens import TokenCounter, token_counts
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS

PIECES = ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "  ", "\n\n", " the", "ing", "tion", "1", "29", "ß", "中", "é", "ﬁ", "\x1c", " ", "​", "'", " ", "ΑΣ", "Σ ", "İ", "😀", "\t", "x"]


def fuzz(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("chunk", [1 << 15, 7])
def test_counts_equal_the_library(byte_level, chunk):
    counter = TokenCounter(vocabulary("byte_bpe_50k.json"), chunk_chars=chunk)
    texts = [t or "" for t in ODD_TEXTS] + fuzz(1500)
    want = [len(e.ids) for e in byte_level.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts) == want


def test_counts_survive_full_tables(byte_level):
    counter = TokenCounter(vocabulary("byte_bpe_50k.json"))
    counter.transducer.max_states = 50
    for at in range(0, 300, 50):
        texts = fuzz(50, seed=at)
        assert counter.count(texts, most_known=20) == [len(e.ids) for e in byte_level.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose_in_any_grouping(byte_level):
    c = TokenCounter(vocabulary("byte_bpe_50k.json"))
    rnd = random.Random(4)
    for text in fuzz(60, seed=9):
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(3))
        a, b, d = (c.chunk_map(x) for x in (text[:cuts[0]], text[cuts[0]:cuts[2]], text[cuts[2]:]))
        for head, between, tail in (c.compose(c.compose(a, b), d), c.compose(a, c.compose(b, d))):
            text2 = text.replace("<|endoftext|>", "")
            if text2 == text:
                assert c.run(head) + between + (c.run(tail) if tail else 0) == len(byte_level.encode(text, add_special_tokens=False).ids)


def test_count_query_on_whole_table(spark, byte_level):
    import __spark_entry__ as E

    got = {r["doc_id"]: r for r in E.queries()["op3_fst_token_counts"](spark, SF0001).collect()}
    for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect():
        n = len(byte_level.encode(r["text"] or "", add_special_tokens=False).ids)
        x = got.pop(r["doc_id"])
        assert (x["n_tokens"], x["n_bytes"], x["over_limit"]) == (n, len((r["text"] or "").encode()), n > 1024)
    assert not got


def test_counts_of_odd_rows_and_clashing_names(docs, byte_level):
    df = docs(ODD_TEXTS, extra="5 AS n_tokens")
    got = token_counts(df, vocabulary("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(byte_level.encode(t or "", add_special_tokens=False).ids) for t in ODD_TEXTS]
    assert token_counts(df.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def test_words_encode_and_decode_as_the_library(word_level):
    coder = WordBpe(vocabulary("word_bpe_49k.json"))
    texts = [t or "" for t in ODD_TEXTS] + fuzz(1500, seed=3) + ["a" * 3000 + " " + "the" * 2000]
    for text, (ids, said) in zip(texts, coder.encode(texts)):
        want = word_level.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), text[:80]
        assert said == coder.decode(ids) == word_level.decode(want, skip_special_tokens=False)


def test_pair_tree_gives_the_leftmost_lowest_rank():
    rnd = random.Random(2)
    for n in (1, 2, 3, 7, 8, 20):
        ranks = [rnd.randint(0, 5) for _ in range(n)]
        tree = PairTree(list(ranks))
        for _ in range(40):
            assert tree.low[1] == min(ranks) and tree.leftmost() == ranks.index(min(ranks))
            at = rnd.randrange(n)
            ranks[at] = rnd.randint(0, 9)
            tree.set(at, ranks[at])


def test_bpe_query_and_odd_rows(spark, docs, word_level):
    import __spark_entry__ as E

    def digests(text):
        ids = word_level.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(word_level.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in E.queries()["op10_bpe_round_trip"](spark, SF0001).collect()}
    assert got == {r["doc_id"]: digests(r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    odd = docs(ODD_TEXTS, extra="1 AS decoded")
    out = bpe_round_trip(odd, vocabulary("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in out] == [digests(t)[0] for t in ODD_TEXTS]
    assert bpe_round_trip(odd.limit(0), vocabulary("word_bpe_49k.json")).collect() == []


def test_words_of_earlier_batches_stay_known(monkeypatch):
    c, learned = WordBpe(vocabulary("word_bpe_49k.json")), []
    learn = WordBpe.learn
    monkeypatch.setattr(WordBpe, "learn", lambda self, words, **kw: (learned.append(len(words)), learn(self, words, **kw)))
    batches = [[" ".join(f"w{chr(97 + k % 26)}{k:x}" for k in range(i * 50_000, (i + 1) * 50_000))] for i in range(3)]
    first = [c.encode(b) for b in batches][0]
    assert c.encode(batches[0]) == first and learned[0] > 0 and learned[3] == 0
