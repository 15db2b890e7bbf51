"""The corpus pipeline, stage by stage, against what the stages' plain versions keep."""

import hashlib
import struct

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from regionpulse.llm.common import vocabulary
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_native import base_measures, plain_spans
from tests.llm.test_near import plain_components


def stages(spark, docs, sf_dir=SF0001):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        rows = f(spark, out[-1], sf_dir)
        out.append(spark.createDataFrame(rows.collect(), rows.schema))
    return out


def test_stages_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    start, good, single, clean, mixed, coded = (d.collect() for d in stages(spark, docs))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "sanitize", "mix", "encode"]
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in start if not base_measures(r["text"])[-1])
    comp = plain_components([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, c in comp.values()})
    before = {r["doc_id"]: r for r in single}
    for r in clean:
        old = before.pop(r["doc_id"])
        assert r["n_chars"] == len(r["text"]) and not plain_spans(r["text"])
        assert r["text"] == old["text"] or plain_spans(old["text"])
    assert not before
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in mixed} <= texts.keys() and all(r["text"] == texts[r["doc_id"]] for r in mixed)
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    assert len(coded) == len(mixed)
    for r in coded:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        data = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["n_tokens"], bytes(r["token_ids"]), r["ids_sha256"]) == (len(ids), data, hashlib.sha256(data).hexdigest())
    run = corpus_pipeline.run(spark, SF0001)
    assert sorted(r["ids_sha256"] for r in run.select("ids_sha256").collect()) == sorted(r["ids_sha256"] for r in coded)


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows_pass_through(spark, docs, empty):
    long = " ".join(f"word{k}" for k in range(40))
    df = docs([*ODD_TEXTS, long, long], sources=["odd"] * len(ODD_TEXTS) + [None] * 2, ids=[*range(len(ODD_TEXTS)), 50, 50], extra="1 AS n_words")
    out = stages(spark, df.limit(0) if empty else df)
    assert all(d.columns == df.columns for d in out[:-1])
    assert [d.count() for d in out[2:]] == ([0] * 4 if empty else [out[2].count()] * 2 + [out[4].count()] * 2)
    if not empty:
        assert {r["doc_id"] for r in out[2].collect()} == {50} and out[2].count() == 1


def test_entry_works_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as E

    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] + "_" for k in E.queries()}
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not [k for k in E.queries() if k.startswith("op") or k == "pipeline"] and len(E.queries()) > 70 and E.oracle_sql()
