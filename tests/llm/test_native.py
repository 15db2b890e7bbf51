"""The operators made of DataFrame operations, against plain Python on the smallest tables."""

import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from regionpulse.llm import host_rules, interleave, license_scan, mixing, pii_sanitize
from tests.conftest import SF0001
from tests.llm.conftest import ODD_TEXTS

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    return {r["doc_id"]: (r["text"] or "", r["source"]) for r in rows}


def query(spark, name):
    import __spark_entry__ as E

    return E.queries()[name](spark, SF0001)


# ---------------------------------------------------------------- host rules

def base_measures(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    n = len(covered)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_measures_on_whole_table(spark, table):
    got = {r["doc_id"]: r for r in query(spark, "op2_host_quality").collect()}
    assert got.keys() == table.keys()
    for i, (text, _) in table.items():
        assert tuple(got[i][c] for c in COLUMNS) == base_measures(text)
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_measures_of_odd_rows(docs):
    texts = [*ODD_TEXTS, "a b c d e f g h " * 3, "one two three four five six seven eight nine " * 2, "l1 x\nl1 x\n\n \nl2\nl1 x"]
    df = docs(texts, sources=[None] * len(texts), extra="true AS kept")
    got = host_rules.host_quality(df, keep_columns=["doc_id", "kept"]).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == [base_measures(t) for t in texts]
    assert host_rules.host_quality(df.limit(0)).collect() == [] and host_rules.passing(df.limit(0)).collect() == []


def shrunk_rates(fails, sizes):
    rates = [f / n for f, n in zip(fails, sizes)]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    if v <= 1e-12:
        return [m] * len(rates)
    strength = max(m * (1 - m) / v - 1, 0)
    return [(f + strength * m) / (n + strength) for f, n in zip(fails, sizes)]


def test_host_verdicts_shrink_small_hosts(docs):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    hosts = {"large-bad": (9, 1), "large-good": (2, 40), "tiny": (1, 0), None: (0, 12), "other": (1, 20)}
    texts, sources = [], []
    for h, (b, g) in hosts.items():
        texts += [bad] * b + [good] * g
        sources += [h] * (b + g)
    rows = host_rules.host_quality(docs(texts, sources))
    want = dict(zip(hosts, shrunk_rates([b for b, _ in hosts.values()], [b + g for b, g in hosts.values()])))
    verdict = {r["source"]: r["host_failed"] for r in rows.select("source", "host_failed").distinct().collect()}
    assert verdict == {h: r > 0.5 for h, r in want.items()} and verdict["large-bad"] and 0.4 < want["tiny"] < 1
    measured = host_rules.measured(docs(texts, sources)).withColumn("host_key", F.coalesce("source", F.lit("-")))
    rate = {r["host_key"]: r["rate_few_words"] for r in host_rules.host_verdicts(measured).collect()}
    assert all(abs(rate[h or "-"] - want[h]) < 1e-9 for h in hosts)
    kept = host_rules.passing(docs(texts, sources, extra="7 AS n_words"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    assert {r["text"] for r in kept.collect()} == {good} and not kept.filter("source = 'large-bad'").count()


# ---------------------------------------------------------------- interleaving

def test_shards_on_whole_table(spark, table):
    rows = query(spark, "op4_stratified_interleave").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(table)
    by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for r in rows:
        data = table[r["doc_id"]][0].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, query(spark, "op4_stratified_interleave").collect()))


def test_order_equals_a_plain_sort(spark, docs):
    sources = [["big", "mid", "small", None][0 if k % 10 < 6 else 1 if k % 10 < 8 else 2 if k % 10 < 9 else 3] for k in range(403)]
    df = docs([f"text {k % 50}" for k in range(403)], sources, ids=[k // 2 for k in range(403)])
    got = interleave.interleave(df, n_shards=5).orderBy("shard", "slot").collect()

    def key(i, t):
        crc = zlib.crc32(t.encode())
        return int(hashlib.md5(f"{interleave.SEED}|{i}|{crc}".encode()).hexdigest()[:15], 16), i, crc, len(t) + 1

    groups = {}
    for k, s in enumerate(sources):
        groups.setdefault("n" if s is None else "s" + s, []).append(key(k // 2, f"text {k % 50}"))
    order = sorted(((2 * r + 1) / (2 * len(g)), s, *k) for s, g in groups.items() for r, k in enumerate(sorted(g)))
    assert [(r["source_key"], r["doc_id"], r["text_crc32"]) for r in got] == [(o[1], o[3], o[4]) for o in order]
    for s in range(5):  # each shard follows the mixture
        mine = Counter(r["source_key"] for r in got if r["shard"] == s)
        assert all(abs(mine[g] - len(rows) / 5) <= 1.5 for g, rows in groups.items())


def test_interleaving_odd_rows(docs):
    df = docs(ODD_TEXTS + ["same"] * 5, sources=[None] * (len(ODD_TEXTS) + 5), ids=[*range(len(ODD_TEXTS)), *[3] * 5], extra="1 AS shard")
    got = interleave.interleave(df).collect()
    assert len(got) == len(ODD_TEXTS) + 5 and {r["size"] for r in got if r["doc_id"] == 0} == {1}
    assert interleave.interleave(df.limit(0)).collect() == []


# ---------------------------------------------------------------- licences

def plain_scan(text, threshold=0.8):
    norm = re.sub(r"[^a-z0-9\n]+", " ", text.lower())
    lines = norm.split("\n")
    units = lines + ([norm.replace("\n", " ")] if len(lines) > 1 else [])
    found = []
    for u in units:
        w = u.split()
        a = {f"{x} {y}" for x, y in zip(w, w[1:])}
        best = None
        for k, (name, t) in enumerate(license_scan.TEMPLATES):
            b = set(license_scan.plain_bigrams(t))
            d = 2 * len(a & b) / (len(a) + len(b))
            if a and d >= threshold and (best is None or (d, -k) > best[:2]):
                best = (d, -k, name)
        if best:
            found.append(best)
    top = max(found, default=None)
    return ",".join(sorted({f[2] for f in found})), len(found), top and top[2], round(top[0], 6) if top else 0.0


def test_licences_on_whole_table_and_odd_rows(spark, docs, table):
    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["best_license"], r["best_dice"]) for r in query(spark, "op5_license_scan").collect()}
    assert got == {i: plain_scan(t) for i, (t, _) in table.items()} and any(v[1] for v in got.values())
    texts = [*ODD_TEXTS, license_scan.TEMPLATES[2][1].replace(" ", "\n", 7), "prose here\nLICENSED under the Apache license version 2.0\nmore",
             "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "Released under the MIT License!", "All rights reserved."]
    df = docs(texts, extra="'x' AS licenses")
    out = license_scan.scan(df).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_matches"], r["best_license"], r["best_dice"]) for r in out] == [plain_scan(t or "") for t in texts]
    assert out[len(ODD_TEXTS)]["best_license"] == "MIT"
    assert license_scan.scan(df.limit(0)).collect() == []


def test_notices_inside_prose_and_wrapped_whole_licences(docs):
    mit = (license_scan.TEMPLATES[2][1] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
           'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
           "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.")
    prose = "some words of prose that say nothing about terms of use. "
    texts = [prose * 3 + "Licensed under the Apache License, Version 2.0. " + prose * 3,
             "MIT License\n\nCopyright (c) 2020 A Holder\n\n" + textwrap.fill(mit, 80),
             "\n".join(["The licence", *textwrap.wrap(" ".join(f"filler{k}" for k in range(60)) + " " + license_scan.PASSAGES[0][1] + " " + prose, 60)]),
             prose * 3 + license_scan.TEMPLATES[7][1] + " " + prose + "Licensed under CC BY-SA 4.0. " + prose,
             prose * 9, "all that is reserved: rights, under the license of a public software"]
    got = license_scan.scan(docs(texts)).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_matches"], r["best_dice"]) for r in got] == [
        ("Apache-2.0", 1, 1.0), ("MIT", 1, 1.0), ("GPL-2.0", 1, 1.0), ("CC-BY-SA-4.0,GPL-3.0", 2, 1.0), ("", 0, 0.0), ("", 0, 0.0)]
    assert all(plain_scan(t)[1] == 0 for t in texts)


# ---------------------------------------------------------------- personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if n % 2 == 0 else 2 * x - 9 * (x > 4) for n, x in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), no, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TRICKY = ["a@b.cc_x@d.ee mail", "a@b.c.d.e@f.gg", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.0255 99999999999999999999.1.1.1", "é 4111 1111 1111 1111 😀 4111-1111-1111-1112",
          "+1 (555) 010-9999 x +1 2 +44 20 7946 0958 0123 4567 8901", "tel+49.30.1234567@x.de", "4111111111111111@1.2.3.4", "1" * 3000 + "@", "a" * 3000 + "@b", "a.b" * 500 + "@c" + ".d" * 3000, "1-" * 3000 + "1", "+" * 50 + "12345678901"]


def test_spans_on_whole_table_and_tricky_texts(spark, docs, table):
    for i, r in {r["doc_id"]: r for r in query(spark, "op6_pii_sanitize").collect()}.items():
        want = plain_spans(table[i][0])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and r["n_email"] == sum(w[0] == "e" for w in want)
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == want
    texts = [*ODD_TEXTS, *TRICKY]
    df = docs(texts, extra="1 AS spans")
    got = pii_sanitize.find(df).select("doc_id", pii_sanitize.written(F.col("spans")).alias("s")).orderBy("doc_id").collect()
    assert [r["s"] for r in got] == [",".join(plain_spans(t or "")) for t in texts]
    assert pii_sanitize.find(df.limit(0)).collect() == [] and pii_sanitize.sanitize(df.limit(0)).collect() == []


def disclosure_fixture():
    # "zorbon" stands only near one address, in different contexts; "hello" is everywhere;
    # "copied" stands near an address too, but always in the same passage
    near = [f"number{k} zorbon writes as boss@corp.example today" for k in range(4)]
    copies = ["copied text by two@corp.example"] * 6
    plain = [f"hello number{k} nothing here" for k in range(40)] + ["hello boss@corp.example"]
    return near + copies + plain


def test_disclosing_terms(docs):
    texts = disclosure_fixture()
    n = len(texts)
    got = pii_sanitize.find(docs(texts)).orderBy("doc_id").select(pii_sanitize.written(F.col("all_spans")).alias("s")).collect()
    terms = {t[a:b] for t, r in zip(texts, got) for k, a, b in (s.split(":") for s in r["s"].split(",") if s) if k == "term" for a, b in [(int(a), int(b))]}
    n_e, n_te = 5, 4  # writes, today: as often near the address as zorbon
    share = math.log(n * n_te / (4 * n_e)) / math.log(n / n_e)
    assert share >= 0.9 and terms == {"zorbon", "writes", "today"}


def test_sanitized_text(docs):
    texts = [None, "", "plain", *disclosure_fixture(), "ip 10.0.0.1, card 4111 1111 1111 1111; tel +1 555 010 9999 é@x", "+4111111111111111 overlaps"]
    df = docs(texts, extra="1 AS _spans2")
    got = [r["text"] for r in pii_sanitize.sanitize(df).orderBy("doc_id").collect()]
    assert got[:3] == [None, "", "plain"] and got[3] == "number0   as <EMAIL> "
    assert got[-2] == "ip <IP>, card <CARD>; tel <PHONE> é@x"
    assert all("@corp" not in t for t in got if t) and pii_sanitize.sanitize(df).columns == df.columns


def test_condemned_terms_go_from_every_document(docs):
    # far from the address (another line, beyond the reach), and in a document without it
    far = [f"zorbon{' filler' * 30}\nnote{k}\nboss@corp.example" for k in range(4)]
    texts = [*far, "It was Zorbon, and zorbon only"] + [f"filler note{k} here" for k in range(60)]
    clean = {r["doc_id"]: r["text"] for r in pii_sanitize.sanitize(docs(texts)).collect()}
    assert all("zorbon" not in t.lower() for t in clean.values()) and clean[4] == "It was , and  only"
    assert all(clean[k] == f"{' filler' * 30}\nnote{k}\n<EMAIL>" for k in range(4)) and clean[9] == texts[9]
    # condemned near the address, it also goes from another line and another document
    texts = disclosure_fixture()
    texts[0] += "\nagain zorbon"
    texts += ["zorbon elsewhere"]
    clean = [r["text"] for r in pii_sanitize.sanitize(docs(texts)).orderBy("doc_id").collect()]
    assert clean[0] == "number0   as <EMAIL> \nagain " and clean[-1] == " elsewhere"


# ---------------------------------------------------------------- mixing

def water_filled(sizes, weights, most=3):
    """Targets by resharing the excess until none is above its limit."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = most * sizes[i]
            capped.add(i)


def test_mix_on_whole_table(spark, table):
    rows = query(spark, "op8_mix_sources").collect()
    size = {i: len(WORDS.findall(t)) for i, (t, _) in table.items()}
    names = sorted({s for _, s in table.values()}, key=str.encode)
    of = {s: sum(size[i] for i in table if table[i][1] == s) for s in names}
    target = dict(zip(names, water_filled([of[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    taken = Counter()
    for r in rows:
        s = table[r["doc_id"]][1]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(rows) == len(table) and all(abs(taken[s] - target[s]) <= 128 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, query(spark, "op8_mix_sources").collect()))


def test_capped_sources_and_odd_rows(docs):
    texts = ["w " * 400] * 30 + ["v " * 300] * 2 + ["u " * 500] + [None, "", "one"]
    sources = ["a"] * 30 + ["b"] * 2 + ["c"] + [None, "empty", None]
    df = docs(texts, sources, extra="1 AS taken")
    rows = mixing.taken_words(df).collect()
    target = {r["source_size"]: r["target"] for r in rows}
    # order a, b, c, empty, null: weights 5, 2, 1, 5, 2
    want = water_filled([12000, 600, 500, 0, 1], [5, 2, 1, 5, 2])
    assert [round(target[s], 6) for s in (12000, 600, 500, 0, 1)] == [round(w, 6) for w in want]
    assert all(r["taken"] <= 3 * r["size"] for r in rows) and len(rows) == 36
    assert sum(r["taken"] for r in rows if r["source_size"] == 600) <= 1800
    assert mixing.taken_words(df.limit(0)).collect() == [] and mixing.resample(df.limit(0)).collect() == []
    assert {r["taken"] for r in mixing.taken_words(docs([None, ""])).collect()} == {0}


def test_slots_are_a_permutation_and_shards_follow_the_targets(spark, docs):
    mix = mixing.Mixture(block_words=4, shard_slots=64)
    df = docs([f"{'w ' * (5 + k % 13)}" for k in range(600)], [["a", "b", "c"][0 if k % 4 else 1 + k % 3 % 2] for k in range(600)])
    src = mixing.targets(mixing.rows_of(df, mix), mix)
    got = mixing.slots(src, mix).collect()
    info = {r["source_key"]: r for r in src.collect()}
    total = max(r["slot_end"] for r in info.values())
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k // 64, k % 64) for k in range(total)]
    for s, r in info.items():
        uses = Counter(x["block"] for x in got if x["source_key"] == s)
        n = r["slot_end"] - r["slot_start"]
        assert set(uses) <= set(range(r["n_blocks"])) and max(uses.values()) - (min(uses.values()) if len(uses) == r["n_blocks"] else 0) <= 1
        for k in range(total // 64):  # a multinomial draw of 64
            mine = sum(x["source_key"] == s and x["shard"] == k for x in got)
            assert abs(mine - 64 * n / total) <= 5 * math.sqrt(64 * n / total) + 1


@pytest.mark.parametrize("total", [50_000, 100_000])
def test_counts_of_shards_vary_as_a_draw_does(spark, total):
    # the first 30% of the strata are one source
    rows = spark.range(total).select("id", mixing.shuffled(F.col("id"), F.lit(total), "mixing-1").alias("place"))
    assert rows.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first()[:] == (total, 0, total - 1)
    src = spark.createDataFrame([("sa", total // 2, 0, total * 3 // 10), ("sb", total, total * 3 // 10, total)], "source_key STRING, n_blocks BIGINT, slot_start BIGINT, slot_end BIGINT")
    got = mixing.slots(src, mixing.Mixture()).filter("source_key = 'sa'").groupBy("shard").count().collect()
    counts = [r["count"] for r in got if r["shard"] < total // 1024]
    sd = math.sqrt(1024 * 0.3 * 0.7)
    assert len(counts) == total // 1024 and all(abs(c - 1024 * 0.3) < 5 * sd for c in counts)
    assert 0.65 * sd < math.sqrt(sum((c - 1024 * 0.3) ** 2 for c in counts) / len(counts)) < 1.4 * sd


def test_whole_documents_in_the_mix(docs):
    df = docs([f"{'w ' * 50}{k}" for k in range(300)], ["a" if k % 10 else "b" for k in range(300)], extra="1 AS _copies2")
    got = mixing.resample(df)
    n = Counter(r["source"] for r in got.collect())
    assert got.columns == df.columns
    assert abs(n["b"] - 300 * 2 / 7) < 12 and abs(n["a"] - 300 * 5 / 7) < 45  # weights 5 and 2


def test_draws_decide_what_is_taken(spark, docs):
    """Shards hold what the draws gave; summed over shards it is what is taken, and the plan keeps the permutations."""
    mix = mixing.Mixture(block_words=8, shard_slots=32)
    df = docs([f"{'w ' * (3 + 7 * k % 50)}" for k in range(200)], [["a", "b", None][k % 7 % 3] for k in range(200)], extra="1 AS slot").withColumn("block", F.lit(2))
    held = mixing.shards(df, mix).collect()
    sizes = {r["doc_id"]: r for r in mixing.taken_words(df, mix).collect()}
    taken = Counter()
    for r in held:
        taken[r["doc_id"]] += r["words"]
        assert 0 <= r["from_word"] and r["from_word"] + r["words"] <= sizes[r["doc_id"]]["size"] and r["words"] <= 8
    assert all(r["taken"] == taken[i] for i, r in sizes.items())
    assert max(Counter((r["shard"], r["slot"]) for r in held).values()) <= 8 and {r["slot"] for r in held} == set(range(32))
    plan = mixing.taken_words(df, mix)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan
    sources = spark.createDataFrame([("sa", 50, 0, 7000)], "source_key STRING, n_blocks BIGINT, slot_start BIGINT, slot_end BIGINT")
    assert "xxhash64" in mixing.drawn(sources, mix)._jdf.queryExecution().optimizedPlan().toString()
    dealt = mixing.drawn(sources, mix, run=100, slots_per_task=1000)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[source_key[^\]]*\], 7", dealt)  # many tasks make the slots of one row


def test_block_permutations_are_no_shift(spark):
    for size in (1, 2, 7, 64, 1000002):
        n = min(size, 500)
        rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(size), F.lit("sa|0"), mixing.round_keys("mixing-1", F.lit("sa|0"), F.lit(size))).alias("place")).collect()
        places = [r["place"] for r in sorted(rows)]
        assert len(set(places)) == n and all(0 <= p < size for p in places)
        if size > 60:
            assert len({(places[i + 1] - places[i]) % size for i in range(n - 1)}) > n // 3


def test_resample_keeps_clashing_names(docs):
    df = docs([f"{'w ' * 20}{k}" for k in range(40)]).selectExpr("*", "1 AS _copies", "2 AS _taken_key", "3 AS _row_key", "4 AS _copy", "5 AS row", "6 AS key", "7 AS copies")
    got = mixing.resample(df)
    assert got.columns == df.columns and {(r["_copies"], r["_taken_key"], r["_row_key"], r["_copy"], r["row"], r["key"], r["copies"]) for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7)}


# ---------------------------------------------------------------- null ids and clashing names

def with_columns(df, names):
    return df.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])


@pytest.mark.parametrize("ids", ["own", "null"])
def test_condemned_terms_go_whatever_the_ids(docs, ids):
    # the word stands far from the address, in other lines: only whole documents tell
    far = "filler words stand here\n" * 12
    texts = [f"boss{k % 5}@corp.example wrote {k}\n{far}zorbon{k % 5} agreed {k}" for k in range(30)] + [f"nothing {k} of note here" for k in range(60)]
    df = docs(texts, ids=None if ids == "own" else [None] * len(texts))
    left = [r["text"] for r in pii_sanitize.sanitize(df).collect()]
    assert len(left) == 90 and not [t for t in left if "zorbon" in t or "@corp" in t]


def test_sanitize_keeps_clashing_names(docs):
    names = ["_spans", "_id", "_text_id", "_this_text", "row", "row_id", "row_text", "added", "term"]
    df = with_columns(docs(["mail a@b.example now", None, "plain"]), names)
    got = pii_sanitize.sanitize(df)
    assert got.columns == df.columns
    rows = got.orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["mail <EMAIL> now", None, "plain"] and all(r[n] == f"kept {n}" for r in rows for n in names)


def test_scan_and_host_rules_keep_clashing_names(docs):
    df = with_columns(docs(["Released under the MIT License.", "plain text of no license"]), ["_found", "found", "row"])
    rows = license_scan.scan(df).orderBy("doc_id").collect()
    assert rows[0]["licenses"] and not rows[1]["licenses"] and all(r[n] == f"kept {n}" for r in rows for n in ("_found", "found", "row"))
    df = with_columns(docs([" ".join(f"w{k}" for k in range(30)), "few"]), ["_m", "_row", "_text"])
    rows = host_rules.host_quality(df).orderBy("doc_id").collect()
    assert [r["n_words"] for r in rows] == [30, 1] and all(r[n] == f"kept {n}" for r in rows for n in ("_m", "_row", "_text"))
    assert host_rules.passing(df).columns == df.columns
