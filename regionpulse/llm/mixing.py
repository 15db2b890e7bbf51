"""Mixing sources to target weights (DataFrame operations only).

The documents of each source, in a seeded random order, form one stream of words that is
packed into blocks of ``block_words`` words.  The output is a sequence of slots, one
block each, cut into shards of ``shard_slots`` slots:

1. Targets.  Each source has a weight; targets share ``total`` words by weight, none above
   ``most_repeats`` times its source (what is above goes to the others by weight, until
   none is above: the level where the capped sum meets the total, found in closed form).
2. Source counts per shard.  Every slot draws its source from the target proportions.  The
   uniforms of the draw are stratified (one in each G-th of the unit interval, G slots), so
   that each source's total is within one block of its target: only the strata at the ends
   of a source's run can go either way, and a uniform decides.  A keyed permutation of all
   slots (``shuffled``) deals the strata to the slots, so a shard is a draw of its slots
   without replacement: the counts vary as in a multinomial draw, the variance times
   (G - shard) / (G - 1).
3. Slots to blocks.  The j-th slot of a source, counted through the shards that drew it, takes
   the block at place j of a keyed random permutation of its block numbers, with a new
   permutation after each full pass; no block is used more often than ``most_repeats`` times.
4. Blocks are joined by (source, block number): ``shards`` gives what stands in each slot,
   ``taken_words`` sums what the slots of all shards take of each document.

Nothing ranks or sums a whole source in one task: stream positions come from bucket sums
and running sums inside buckets.

Defined cases: null text: no words; null source: a source of its own, last in order;
documents without words take part with nothing taken; repeated rows are rows of their own;
a corpus without words gives no slots and targets of 0; an empty table an empty result.
A very long text runs through many blocks.  Columns other than the id, text and source are not
read; ``resample`` returns them untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regionpulse.llm.common import join_measured, let, materialize, order_key, source_key, text_or_empty, word_count
from regionpulse.session import scratch

#: weights given to the sources in order, repeating
WEIGHTS = (5, 2, 1)
#: exchanges of a source's permutation of its blocks
BLOCK_ROUNDS = 24
#: exchanges of the permutation that deals slots to shards
ROUNDS = 64


@dataclass(frozen=True)
class Mixture:
    block_words: int = 64
    shard_slots: int = 1024
    most_repeats: int = 3
    weights: tuple[int, ...] = WEIGHTS
    seed: str = "mixing-1"


def round_keys(seed: str, salt: Column, size: Column) -> Column:
    """The keys of the block permutation that ``salt`` (source and pass) names."""
    return F.transform(F.sequence(F.lit(1), F.lit(BLOCK_ROUNDS)), lambda k: F.pmod(order_key(seed, salt, k), size))


def permuted(index: Column, size: Column, salt: Column, keys: Column) -> Column:
    """Place of ``index`` under a keyed random permutation of 0 .. size - 1: ``shuffled``, with
    the rounds' keys made once for many indexes and bits that any engine with md5 can give."""
    def step(x: Column, key: Column) -> Column:
        return let(F.pmod(key - x, size), lambda other: F.when(
            F.substring(F.md5(F.concat_ws("|", salt, key.cast("string"), F.greatest(x, other).cast("string"))), 1, 1) < "8", other).otherwise(x))

    return F.aggregate(keys, index.cast("long"), step)


def shuffled(index: Column, size: Column, seed: str, rounds: int = ROUNDS) -> Column:
    """Place of ``index`` under a keyed random permutation of 0 .. size - 1 (swap or not: in
    each round the places x and K - x modulo the size are exchanged or not by a hashed bit
    of the pair, so every size is permuted exactly and neighbours part)."""
    def step(x: Column, k: Column) -> Column:
        return let(F.pmod(F.pmod(F.xxhash64(F.lit(seed), k), size) - x, size), lambda other: F.when(
            F.xxhash64(F.lit(seed), k, F.greatest(x, other)) % 2 == 0, other).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def uniform(*parts: Column) -> Column:
    """A pseudorandom number in [0, 1) from the given values."""
    return order_key("uniform", *parts) / F.lit(float(1 << 60))


def rows_of(docs: DataFrame, mix: Mixture, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One slim written row per document: (_row, doc_id, source, source_key, size, _key)."""
    t = text_or_empty(text)
    return materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(source).alias("source_key"),
        word_count(t).alias("size"), order_key(mix.seed, F.col(doc_id), F.crc32(F.encode(t, "UTF-8"))).alias("_key")), "mix-rows")


def targets(rows: DataFrame, mix: Mixture, total: float | None = None) -> DataFrame:
    """One row per source: words, weight, target, blocks, and its run of slots in the draw."""
    by_code_point = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    k = len(mix.weights)
    src = (rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
           .withColumn("_i", F.row_number().over(by_code_point) - 1)
           .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.pmod("_i", F.lit(k)) + 1).cast("int"))))
    one = W.partitionBy(F.lit(0))
    cap = mix.most_repeats * F.col("source_size")
    ratio = cap / F.col("weight")
    order = one.orderBy(ratio, "_i")
    want = F.lit(float(total)) if total is not None else F.sum("source_size").over(one)
    before = F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, 0)) - cap
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("_ratio", ratio).withColumn("_level", (want - before) / rest)
    level = F.coalesce(F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(one), F.max("_ratio").over(one))
    src = src.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))
    # blocks, and the real number of slots that meets the target with blocks of the source's mean length
    src = (src.withColumn("n_blocks", F.ceil(F.col("source_size") / mix.block_words))
           .withColumn("_slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)))
    end = F.sum("_slots").over(one.orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    src = src.withColumn("_end", F.round(end, 6))
    cut = F.floor("_end") + F.when(uniform(F.lit(mix.seed), F.floor("_end")) < F.col("_end") - F.floor("_end"), 1).otherwise(0)
    src = src.withColumn("slot_end", cut.cast("long"))
    start = F.coalesce(F.lag("slot_end").over(one.orderBy("_i")), F.lit(0))
    # the two rounded ends may lie one slot too far apart: a slot is left empty then
    return (src.withColumn("slot_start", start.cast("long"))
            .withColumn("slot_end", F.least("slot_end", F.col("slot_start") + mix.most_repeats * F.col("n_blocks")))
            .drop("_ratio", "_level", "_slots", "_end", "_i"))


def drawn(src: DataFrame, mix: Mixture, run: int = 4096, slots_per_task: int = 50_000) -> DataFrame:
    """(shard, source_key, n_blocks, places): the slots of each shard that drew the source, in
    order.  Strata are made in runs, so a source with a third of all slots is spread over
    many rows before they are made, and dealt to an explicit number of tasks: few rows
    become many slots."""
    total = src.agg(F.coalesce(F.max("slot_end"), F.lit(0))).first()[0]
    runs = (src.filter("slot_end > slot_start")
            .withColumn("_run", F.explode(F.expr(f"sequence(0L, (slot_end - slot_start - 1) div {run})")))
            .repartition(max(1, total // slots_per_task), "source_key", "_run"))
    one = runs.withColumn("_j", F.explode(F.expr(f"sequence(_run * {run}, least((_run + 1) * {run}, slot_end - slot_start) - 1)")))
    place = shuffled(F.col("slot_start") + F.col("_j"), F.lit(total), mix.seed)
    dealt = one.select("source_key", "n_blocks", place.alias("_place")).withColumn("shard", F.expr(f"_place div {mix.shard_slots}"))
    return dealt.groupBy("shard", "source_key", "n_blocks").agg(F.array_sort(F.collect_list(F.expr(f"_place % {mix.shard_slots}"))).alias("places"))


def slots(src: DataFrame, mix: Mixture, slots_per_task: int = 50_000) -> DataFrame:
    """(shard, slot, source_key, block): one row per slot."""
    runs = materialize(drawn(src, mix, slots_per_task=slots_per_task), "mix-draws").withColumn("_n", F.size("places").cast("long"))
    # the number of a run's first slot among its source's: sums over stretches of shards, then inside them
    runs = runs.withColumn("_g", F.expr("shard div 1000"))
    sums = runs.groupBy("source_key", "_g").agg(F.sum("_n").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(W.partitionBy("source_key").orderBy("_g").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).drop("_s")
    inside = F.sum("_n").over(W.partitionBy("source_key", "_g").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    runs = runs.withColumn("_in", inside).join(before, ["source_key", "_g"]).withColumn("_j0", F.col("_before") + F.col("_in"))
    total = runs.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    runs = runs.repartition(max(1, total // slots_per_task), "shard", "source_key")
    # the slots of a run that fall into one pass share the keys of its permutation
    passes = runs.withColumn("_pass", F.explode(F.expr("sequence(_j0 div n_blocks, (_j0 + _n - 1) div n_blocks)"))).withColumn("_salt", F.concat_ws("|", "source_key", "_pass"))
    keyed = passes.withColumn("_keys", round_keys(mix.seed, F.col("_salt"), F.col("n_blocks")))
    one = keyed.withColumn("_j", F.explode(F.expr("sequence(greatest(_j0, _pass * n_blocks), least(_j0 + _n, (_pass + 1) * n_blocks) - 1)")))
    block = permuted(F.col("_j") - F.col("_pass") * F.col("n_blocks"), F.col("n_blocks"), F.col("_salt"), F.col("_keys"))
    return one.select("shard", F.get("places", (F.col("_j") - F.col("_j0")).cast("int")).alias("slot"), "source_key", block.alias("block"))


def stream(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` with ``start``: the position of the document's first word in its source's stream."""
    keyed = rows.withColumn("_b", F.floor(F.col("_key") / F.lit(float(1 << 60)) * buckets))
    sums = keyed.groupBy("source_key", "_b").agg(F.sum("size").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(W.partitionBy("source_key").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).drop("_s")
    inside = F.sum("size").over(W.partitionBy("source_key", "_b").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    return keyed.withColumn("_in", inside).join(before, ["source_key", "_b"]).withColumn("start", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def pieces(at: DataFrame, mix: Mixture) -> DataFrame:
    """Rows of ``stream`` with one row per block that a document stands in: ``block``, the
    piece's ``from_word`` in the document and its number of ``words``."""
    size, start, step = F.col("size"), F.col("start"), mix.block_words
    cut = at.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {step}, (start + size - 1) div {step})")))
    begin = F.greatest(start, F.col("block") * step)
    return cut.withColumn("from_word", begin - start).withColumn("words", F.least(start + size, (F.col("block") + 1) * step) - begin)


def _drawn_blocks(docs: DataFrame, mix: Mixture, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = rows_of(docs, mix, doc_id, text, source)
    src = materialize(targets(rows, mix), "mix-sources")
    return stream(rows, max(1, math.isqrt(rows.count()))), src, slots(src, mix)


def shards(docs: DataFrame, mix: Mixture = Mixture(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(shard, slot, doc_id, from_word, words): the pieces of documents in each slot of each shard."""
    at, _, dealt = _drawn_blocks(docs, mix, doc_id, text, source)
    met = dealt.hint("merge").join(pieces(at, mix), ["source_key", "block"])
    return met.select("shard", "slot", "doc_id", "from_word", "words")


def taken_words(docs: DataFrame, mix: Mixture = Mixture(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document: ``taken`` is the number
    of its words that the mix takes, repeats counted."""
    at, src, dealt = _drawn_blocks(docs, mix, doc_id, text, source)
    used = dealt.groupBy("source_key", "block").agg(F.count(F.lit(1)).alias("times"))
    # slots come from a table of a few rows, so Spark would take them for few and broadcast them
    got = (pieces(at, mix).join(used.hint("merge"), ["source_key", "block"])
           .groupBy("source_key", "_key", "doc_id", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    kept = ["doc_id", "size", "source_key", "_key"]
    empty = at.filter("size = 0").select(*kept, F.lit(0).cast("long").alias("taken"))
    met = at.filter("size > 0").alias("r").join(got.alias("g"), (F.col("r.source_key") == F.col("g.source_key")) & (F.col("r._key") == F.col("g._key")) & F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.start") == F.col("g.start")), "left")
    met = met.select(*[f"r.{c}" for c in kept], F.coalesce("g.taken", F.lit(0)).cast("long").alias("taken"))
    return (join_measured(met.unionByName(empty), src.select("source_key", "source_size", "target"), "source_key")
            .select("doc_id", "size", "source_size", "target", "taken", "_key"))


def resample(docs: DataFrame, mix: Mixture = Mixture(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as whole documents in the mix's proportions: each as often as its words were
    taken per word it has, rounded up or down by a number drawn from its id and text, so
    that the expected words of a source are those the mix took.  Columns stay; documents
    without words are not in the mix; equal rows are repeated equally."""
    with scratch(docs.sparkSession):
        taken = (taken_words(docs, mix, doc_id, text, source).filter("size > 0").groupBy("_key").agg((F.sum("taken") / F.sum("size")).alias("times"))
                 .withColumn("copies", F.floor(F.col("times") + uniform(F.lit(mix.seed), F.col("_key"))).cast("int")).filter("copies > 0")
                 .select(F.col("_key").alias("key"), "copies"))
        taken = materialize(taken, "mix-copies", keep=True)
    # the row travels in one column, so no name can clash; a shuffle at every size, as texts grow with the counts
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, order_key(mix.seed, F.col(doc_id), F.crc32(F.encode(text_or_empty(text), "UTF-8"))).alias("key"))
    return keyed.hint("merge").join(taken, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
