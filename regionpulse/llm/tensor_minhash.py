"""Near-duplicate detection with tensored MinHash banding.

Each document's set of word shingles gets two small collections of ``m`` band hashes, A
and B, every band made of ``k`` minimum hashes.  Table keys are the m * m pairs (A_i, B_j),
so m * m tables of 2k minimum hashes each cost 2mk minimum hashes instead of 2km^2.  Two
sets with similarity s share a key with probability (1 - (1 - s^k)^m)^2; at the defaults
(k = 3, m = 12) that is 0.9996 at s = 0.8 and higher above.

Sharing a key only proposes a pair.  Links are confirmed on the full sets, as
|intersection| * 100 >= threshold * |union|.  Equal sets are one class from the start.

A combined key can be shared only if both of its bands are, so the 2m band hashes are
counted first, and keys are formed from shared bands only: the same keys, far fewer rows.

Proposals per key, without listing all pairs of a bucket:

1. Every member is checked against the smallest ids of its buckets, one of them first, then
   a few, then the others, each time only against those that are still in another
   component; the confirmed links are closed to components in between.
2. The members that share a smallest id are dealt into units of about 400.  In buckets that
   still hold several components, all pairs from different components are looked at, each
   under its first common key only, filtered by exact size bounds and by the 2mk minimum
   hashes (a pair of similarity 0.8 stays below the filter's 0.55 once in ten million).  What
   leaves a bucket is no list of pairs: it is each member with the units of its possible
   partners.
3. A member is compared on the full sets with all of such a unit at once, over an index of
   the unit's shingles; one link to each other component is kept.

Step 2 deals a bucket in pairs of blocks of bounded size, (members outside the largest
component) x (members inside) and outside x outside, so no task holds a whole bucket and
members of one component are never compared.  A group of thousands of near copies thus
costs a few links and units per member, while no pair of
members of different components is left unchecked.  Nothing is collected to the driver;
components are found by alternating large-star and small-star steps over written tables,
which are removed when the result is written.

Very long texts are one set like any other; columns other than the id and the text are not
read here, and ``one_per_group`` returns them untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regionpulse.llm.common import materialize, small_batches
from regionpulse.session import scratch

K, M, THRESHOLD, WIDTH, SEED = 3, 12, 80, 2, 11
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """64-bit ids of the distinct word shingles of a text; remembers word hashes up to a bound."""

    def __init__(self, width: int = WIDTH, most: int = 150_000):
        self.width, self.most, self.words = width, most, {}

    def word_hashes(self, data: bytes) -> np.ndarray:
        ws = data.split()  # bytes split at exactly the contract's white space
        if len(self.words) > self.most:
            self.words.clear()
        known = self.words
        for w in set(ws).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted ids; a text with fewer words than the width is one shingle, one without words none."""
        h = self.word_hashes((text or "").encode("utf-8", "replace").lower())
        if not len(h):
            return h
        width = min(self.width, len(h))
        out = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            out = _mixed(out * ODD + h[i:len(h) - width + 1 + i])
        return np.unique(out)


def _parameters(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def minimum_hashes(sets: list[np.ndarray], count: int, seed: int = SEED) -> np.ndarray:
    """[set, hash] 32-bit minimum hashes of non-empty sets."""
    a, b = _parameters(count, seed)
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)][:-1])
    out = np.empty((len(sets), count), np.uint32)
    for i in range(count):
        x = flat * a[i] + b[i]
        out[:, i] = np.minimum.reduceat(((x ^ (x >> np.uint64(29))) * ODD >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, count: int) -> DataFrame:
    """(doc_id, n, set_id, sig): size and 128-bit identity of each set, and its minimum hashes (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            sig = iter(minimum_hashes(some, count)) if some else iter(())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "set_id", "sig"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n long, set_id binary, sig binary")


def _bands(sig: list[bytes], k: int, m: int) -> np.ndarray:
    """[set, band] hashes of the 2m bands; a band's number is part of its hash."""
    values = np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), 2 * m, k).astype(np.uint64)
    band = np.zeros(values.shape[:2], np.uint64)
    for i in range(k):
        band = _mixed(band * ODD + values[:, :, i])
    return _mixed(band + np.arange(2 * m, dtype=np.uint64))


def shared_bands(reps: DataFrame, k: int, m: int) -> DataFrame:
    """(rep, bands): numbers of the bands that a set shares with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                band = _bands(batch.column(1).to_pylist(), k, m)
                rows = np.repeat(np.arange(batch.num_rows), 2 * m)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(2 * m, dtype=np.int32), batch.num_rows)), pa.array(band.reshape(-1).view(np.int64))], names=["rep", "band", "hash"])

    bands = reps.select("rep", "sig").mapInArrow(run, "rep long, band int, hash long")
    common = bands.groupBy("hash").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("hash")
    found = bands.join(common, "hash", "left_semi").groupBy("rep").agg(F.collect_set("band").alias("bands"))
    return found.filter(F.exists("bands", lambda b: b < m) & F.exists("bands", lambda b: b >= m))


def table_keys(reps: DataFrame, k: int, m: int) -> DataFrame:
    """(key, slot, rep, n): the combined keys of the listed bands of (rep, n, sig, bands);
    slot = i * m + j for (A_i, B_j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                band = _bands(batch.column(2).to_pylist(), k, m)
                able = np.zeros(band.shape, bool)
                lists = batch.column(3)
                able[np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = True
                row, slot = np.nonzero((able[:, :m, None] & able[:, None, m:]).reshape(batch.num_rows, m * m))
                key = _mixed(band[row, slot // m] * ODD + band[row, m + slot % m]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(slot.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["key", "slot", "rep", "n"])

    return reps.select("rep", "n", "sig", "bands").mapInArrow(run, "key long, slot int, rep long, n long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full sets are linked; ``texts`` has (id, text)."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, set_a = Shingler(width), None, None
        for batch in batches:
            linked = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ta != last:
                    last, set_a = ta, shingle(ta)
                set_b = shingle(tb)
                small, large = (set_a, set_b) if len(set_a) <= len(set_b) else (set_b, set_a)
                if not len(small):
                    linked.append(False)
                    continue
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                linked.append(100 * both >= threshold * (len(set_a) + len(set_b) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def pair_groups(pairs: Iterator[pa.RecordBatch], most: int = 100) -> Iterator[pa.RecordBatch]:
    """(pairs): the (a, b) of each batch in packed lists with at most ``most`` different a each."""
    for batch in pairs:
        ab = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        ab = ab[np.lexsort((ab[:, 1], ab[:, 0]))]
        starts = np.flatnonzero(np.diff(ab[:, 0], prepend=ab[:1, 0] - 1))[::most]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(ab, starts[1:])], pa.binary())], names=["pairs"])


def confirmed_groups(groups: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The linked (a, b) of all packed pairs (g, pairs).  A text comes once to each group that
    names it, not once per pair; every pair of the group is compared on its full sets."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.unique(np.frombuffer(packed, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g, np.int64)), pa.array(ids)], names=["g", "id"])

    def links(packed: bytes, sets: dict[int, list[np.ndarray]]) -> list[tuple[int, int]]:
        out = []
        for a, b in np.frombuffer(packed, np.int64).reshape(-1, 2).tolist():
            for x in sets.get(a, ()):
                for y in sets.get(b, ()):  # rows that share an id: any of their texts
                    small, large = (x, y) if len(x) <= len(y) else (y, x)
                    if len(small):
                        both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                        if 100 * both >= threshold * (len(x) + len(y) - both):
                            out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, packed, sets = Shingler(width), b"", {}

        def found() -> pa.RecordBatch:
            at = np.array(links(packed, sets), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])

        for batch in batches:
            for ident, text, pairs in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)]):
                if pairs is not None:  # stands before the texts of its group
                    yield found()
                    packed, sets = pairs, {}
                else:
                    sets.setdefault(ident, []).append(shingle(text))
        yield found()

    of_text = groups.select("g", "pairs").mapInArrow(named, "g long, id long").join(texts, "id").select("g", "id", "text", F.lit(None).cast("binary").alias("pairs"))
    heads = groups.select("g", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "pairs")
    rows = of_text.unionByName(heads).repartition("g").sortWithinPartitions("g", F.col("id").asc_nulls_first())
    return rows.select("g", "id", "text", "pairs").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest id reachable, for every id that has a link.

    Large-star gives every larger neighbour the smallest one around, small-star does the
    same among the smaller; both keep connectivity, and rounds end when only stars are left."""
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        out = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if larger else met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a != b").distinct()

    now = links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(most_rounds):
        now = materialize(star(star(now, True), False), name)
        # settled: every larger end has one link, and no smaller end is a larger one elsewhere
        ends = now.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.col("b").alias("node"), "n", F.lit(False).alias("hub"))
        hubs = now.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("hub")).distinct()
        seen = ends.union(hubs).groupBy("node").agg(F.count(F.lit(1)).alias("roles"), F.max("n").alias("n")).filter("roles > 1 or n > 1")
        if not seen.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(now.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def units_of(members: DataFrame, most: int = 400) -> DataFrame:
    """(rep, comp, unit): the members (key, slot, rep, n, hub, comp) dealt into units of about
    ``most``, by the smallest id of their buckets; a row per member."""
    each = members.groupBy("rep").agg(F.min("hub").alias("hub"), F.min("comp").alias("comp"))
    per_hub = each.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), "parts")
    return each.join(per_hub, "hub").select("rep", "comp", F.xxhash64("hub", part).alias("unit"))


def confirmed_units(tries: DataFrame, units: DataFrame, texts: DataFrame, width: int, threshold: int, most: int = 2000) -> DataFrame:
    """(a, b): links on the full sets of each member a with the members b of a unit, for all (rep, unit) of
    ``tries``; one b of each component other than a's.  ``units`` has (rep, comp, unit).

    A unit comes once for about ``most`` members that try it, so neither a large unit nor
    one that many try fills a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, place, index = Shingler(width), None, None
        ids, comps, sets = [], [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for unit, part, tries_it, rep, comp, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (unit, part) != place:
                    place, index, ids, comps, sets = (unit, part), None, [], [], []
                found = shingle(text)
                if not tries_it:  # the unit's own members come first
                    ids.append(rep), comps.append(comp), sets.append(found)
                    continue
                if not ids or not len(found):
                    continue
                if index is None:
                    flat, size = np.concatenate(sets), np.array([len(x) for x in sets], np.int64)
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], np.repeat(np.arange(len(sets)), size)[order], size, np.array(comps, np.int64)
                values, owner, size, of = index
                at, end = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
                held = end - at
                places = np.arange(held.sum()) + np.repeat(at - (np.cumsum(held) - held), held)
                both = np.bincount(owner[places], minlength=len(ids))
                linked = np.flatnonzero((100 * both >= threshold * (len(found) + size - both)) & (of != comp))
                out += [(rep, ids[k]) for k in linked[np.unique(of[linked], return_index=True)[1]].tolist()]
            ab = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    parts = tries.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    own = units.join(parts, "unit").select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("tries"), "rep", "comp")
    asking = tries.join(parts, "unit").join(units.select("rep", "comp"), "rep").select("unit", F.pmod(F.xxhash64("rep"), "parts").alias("part"), F.lit(True).alias("tries"), "rep", "comp")
    rows = own.union(asking).join(texts.withColumnRenamed("id", "rep"), "rep").select("unit", "part", "tries", "rep", "comp", "text")
    return rows.repartition("unit", "part").sortWithinPartitions("unit", "part", "tries").mapInArrow(run, "a long, b long").distinct()


def block_pairs(members: DataFrame, most: int = 400) -> DataFrame:
    """(key, x, inside, y, first, second, slot, rep, n, comp): the rows of buckets with several
    components (key, slot, rep, n, comp, any more), dealt to pairs of blocks of about ``most`` rows;
    more columns follow.

    Members outside a bucket's largest component make blocks x; each meets every block y of
    members inside, and every block y >= x of members outside.  ``first`` and ``second`` tell
    on which sides of its pair a row stands."""
    per_comp = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    per_key = per_comp.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all")).filter(F.col("all") > F.col("top.c"))
    blocks = lambda n: F.ceil(n / most).cast("int")
    per_key = per_key.select("key", F.col("top.comp").alias("largest"), blocks(F.col("top.c")).alias("ins"), blocks(F.col("all") - F.col("top.c")).alias("outs"))
    rows = members.join(per_key, "key").withColumn("out", F.col("comp") != F.col("largest"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))).cast("int")
    rows = rows.withColumn("own", own)

    def place(x, inside: bool, y, first, second):
        return F.struct(x.alias("x"), F.lit(inside).alias("inside"), y.alias("y"), first.alias("first"), second.alias("second"))

    me, yes, no = F.col("own"), F.lit(True), F.lit(False)
    with_inside = F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda y: place(me, True, y, yes, no))
    with_outside = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda o: place(F.least(me, o), False, F.greatest(me, o), me <= o, me >= o))
    with_any = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda x: place(x, True, me, no, yes))
    at = F.explode(F.when(F.col("out"), F.concat(with_inside, with_outside)).otherwise(with_any)).alias("at")
    more = [c for c in members.columns if c not in ("key", "slot", "rep", "n", "comp")]
    return rows.select("key", "slot", "rep", "n", "comp", *more, at).select("key", "at.*", "slot", "rep", "n", "comp", *more)


def cross_pairs(members: DataFrame, sigs: DataFrame, k: int, m: int, least: float = 0.55, threshold: int = THRESHOLD, most: int = 400) -> DataFrame:
    """(a, b): pairs of members of one key (key, slot, rep, n, comp) from different components
    that the size bound and the minimum hashes (``sigs``: rep, sig) leave possible, each under its first common key.
    Where members have a ``unit``: (rep, unit), each a once with the units of its b in a pair of blocks."""
    of_units = "unit" in members.columns

    def pairs(rows: list[tuple], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        slot, within = rows[0][6], rows[0][1] == rows[0][3] and not rows[0][2]
        to = np.array([r[11] for r in rows if r[5]], np.int64) if of_units else None
        one, two = ([r for r in rows if r[side]] for side in (4, 5))
        if not one or not two:
            return
        (rep, size, comp), (rep2, size2, comp2) = [[np.array([r[i] for r in some], np.int64) for i in (7, 8, 9)] for some in (one, two)]
        sig, sig2 = [np.frombuffer(b"".join([r[10] for r in some]), np.uint32).reshape(len(some), 2 * k * m) for some in (one, two)]
        for x in np.array_split(np.arange(len(one)), len(one) * len(two) * 2 * k * m // 4_000_000 + 1):
            ok = (comp[x, None] != comp2) & (100 * np.minimum(size[x, None], size2) >= threshold * np.maximum(size[x, None], size2))
            if within:
                ok &= rep[x, None] < rep2
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            same = sig[x[i]] == sig2[j]
            near = same.sum(axis=1) >= least * 2 * k * m
            i, j, same = i[near], j[near], same[near]
            same = same.reshape(-1, 2 * m, k).all(axis=2)
            first = same[:, :m].argmax(axis=1) * m + same[:, m:].argmax(axis=1) == slot
            a, b = rep[x[i[first]]], rep2[j[first]]
            out.append(tuple(np.unique(np.stack([a, to[j[first]]]), axis=1)) if of_units else (a, b))

    names = ["rep", "unit"] if of_units else ["a", "b"]

    def batches_of(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: list = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:4] != key:
                    pairs(rows, out) if len(rows) > 1 else None
                    key, rows = row[:4], []
                rows.append(row)
            yield from batches_of(out)
        out = []
        pairs(rows, out) if len(rows) > 1 else None
        yield from batches_of(out)

    # by the number of partitions in force: the rows of a pair of blocks together, in order
    group = ["key", "x", "inside", "y"]
    dealt = block_pairs(members, most).join(sigs, "rep").select(*group, "first", "second", "slot", "rep", "n", "comp", "sig", *(["unit"] if of_units else [])).repartition(*group).sortWithinPartitions(*group, "rep")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    A null or empty text, or one without words, has an empty set and is linked with
    nothing.  Rows that share an id are one document to the links (linked if any of their
    texts is); a null id can carry no link and is its own, null, component, kept.  Equal
    sets are linked whatever their number.  An empty table gives an empty result; only the
    id and the text are read."""
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark):
        return materialize(_near_duplicates(docs, doc_id, text, width, threshold, k, m), "near-result", keep=True)


def _near_duplicates(docs: DataFrame, doc_id: str, text: str, width: int, threshold: int, k: int, m: int) -> DataFrame:
    sigs = materialize(signatures(docs, doc_id, text, width, 2 * k * m), "near-sets")
    classes = sigs.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    reps = materialize(classes.join(sigs.filter("doc_id is not null").withColumnRenamed("doc_id", "rep"), ["set_id", "rep"]).dropDuplicates(["set_id"]), "near-classes")
    # rows that share an id link their sets
    shared = sigs.filter("set_id is not null and doc_id is not null").select("doc_id", "set_id").distinct().join(classes, "set_id").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a != b").select("a", "b")

    able = materialize(reps.join(shared_bands(reps, k, m), "rep"), "near-able")
    keyed = table_keys(able, k, m)
    hubs = keyed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = materialize(keyed.join(hubs, "key").select("key", "slot", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "near-members")
    hubs_of = (members.filter((F.col("rep") != F.col("hub")) & (100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")))
               .groupBy("rep").agg(F.array_sort(F.collect_set("hub")).alias("hubs")))
    hubs_of = materialize(hubs_of, "near-hubs")  # at most m * m of each
    found = members.select(F.col("rep").alias("id")).distinct()
    texts = materialize(docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text")).join(found, "id", "left_semi"), "near-texts")
    to_hub = hubs_of.select(F.get("hubs", F.lit(0)).alias("a"), F.col("rep").alias("b"))
    first = materialize(confirmed(to_hub, texts, width, threshold).union(shared), "near-links")
    comps = materialize(components(first), "near-comps")

    def joined(more: DataFrame) -> DataFrame:
        """The components of ``comps`` and further links."""
        return materialize(components(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).filter("a != b").union(more)), "near-comps")

    for tried, more in ((1, 7), (8, m * m)):
        tries = hubs_of.filter(F.size("hubs") > tried).select(F.explode(F.slice("hubs", tried + 1, more)).alias("a"), F.col("rep").alias("b"))
        of_a, of_b = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in ("a", "b"))
        apart = tries.join(of_a, "a", "left").join(of_b, "b", "left").filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")
        links = materialize(confirmed(apart, texts, width, threshold), "near-links")
        if links.limit(1).count():
            comps = joined(links)
    placed = members.select("key", "slot", "rep", "n", "hub").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    units = materialize(units_of(placed), "near-units")
    open_ = placed.drop("hub").join(units.select("rep", "unit"), "rep")
    open_ = materialize(open_, "near-open")
    tries = materialize(cross_pairs(open_, reps.select("rep", "sig"), k, m, threshold=threshold).distinct(), "near-tries")
    rest = materialize(confirmed_units(tries, units, texts, width, threshold), "near-links")
    final = (joined(rest) if rest.limit(1).count() else comps).withColumnRenamed("node", "rep")
    of_set = classes.join(final, "rep", "left").select("set_id", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc_id", "n", "set_id").join(of_set, "set_id", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near duplicates (the one with the smallest
    id), all columns as they were.  Of rows that share an id the one with the smallest text
    stays; rows without an id all stay."""
    spark = docs.sparkSession
    with scratch(spark):
        marked = near_duplicates(docs, doc_id, text, **options)
        dropped = materialize(marked.filter("not kept").select(F.col("doc_id").alias(doc_id)).distinct(), "near-dropped", keep=True)
        repeated = materialize(docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).count().filter("count > 1").select(doc_id), "near-repeated", keep=True)
    left = docs.join(dropped, doc_id, "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return left
    once = left.join(repeated, doc_id, "left_anti").select(*docs.columns)
    # whole rows travel in one column, so no name can clash
    rows = left.join(repeated, doc_id, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    order = W.partitionBy(F.col("row").getField(doc_id)).orderBy(F.col("row").getField(text))
    again = rows.select("row", F.row_number().over(order).alias("at")).filter("at = 1").select("row.*")
    return once.unionByName(again)
