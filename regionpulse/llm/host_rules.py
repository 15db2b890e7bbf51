"""Host-level quality rules (DataFrame operations only).

Every document gets a few measures and fails or passes each rule.  Failures are
aggregated by host; a host's failure rate of a rule is shrunk toward the corpus with a
beta prior whose two parameters come from the hosts themselves (method of moments), so a
host with three documents is not condemned by two of them.  The host verdict, a shrunk
rate above the rule's limit, is joined back to its documents.

Defined cases: a null or empty text has no words and fails ``few_words``; a null host is
a host of its own; repeated rows count as often as they occur; an empty table gives an
empty result.  Columns of the input that clash with added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionpulse.llm.common import join_measured, let, materialize, source_key, text_or_empty, words

#: rule -> the highest shrunk failure rate a host may have
HOST_LIMITS = {"few_words": 0.5, "repeats": 0.5, "symbols": 0.5, "dup_lines": 0.5}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8


def repeat_words(ws: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows found twice or more in the array of words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(ws) - window + 1), lambda i: F.xxhash64(F.slice(ws, i, window)))

    def covered(hs: Column) -> Column:
        # (hash, place) sorted; a window is repeated if a neighbour has the same hash
        marked = let(
            F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(F.transform(
                F.filter(F.transform(s, lambda x, k: F.struct(
                    x["i"].alias("i"),
                    (F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])).alias("dup"))),
                    lambda x: x["dup"]),
                lambda x: x["i"])))
        # each repeated window covers its words up to the next repeated one
        return let(marked, lambda p: F.aggregate(
            F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    some = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) < F.size(hs), covered(hs)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(ws) >= window, some).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each whole text and ``base_failed``."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    m = let(words(t), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeat_words(ws).alias("n_repeat_words")))
    return (docs.withColumn("_m", m)
            .withColumn("n_words", F.col("_m.n_words"))
            .withColumn("word_chars", F.col("_m.word_chars"))
            .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")))
            .withColumn("n_repeat_words", F.col("_m.n_repeat_words"))
            .drop("_m")
            .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))


def rule_failures() -> dict[str, Column]:
    """Rule -> whether a measured document fails it."""
    return {
        "few_words": F.col("n_words") < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > F.col("n_words"),
    }


def host_verdicts(measures: DataFrame, host_key: str = "host_key", limits: dict[str, float] | None = None) -> DataFrame:
    """One row per host: documents, shrunk failure rate of each rule, ``host_failed``.

    Prior of a rule: with mean m and variance v of the hosts' rates, the two parameters sum
    to m(1-m)/v - 1 (no spread between hosts: all hosts take the mean; a spread that no
    beta distribution has: no shrinkage)."""
    limits = limits or HOST_LIMITS
    rules = rule_failures()
    hosts = measures.groupBy(host_key).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules.items()])
    prior = hosts.agg(*[x for r in rules for x in (
        F.avg(F.col(f"f_{r}") / F.col("n_docs")).alias(f"m_{r}"), F.var_pop(F.col(f"f_{r}") / F.col("n_docs")).alias(f"v_{r}"))])
    out = hosts.join(F.broadcast(prior))  # one row
    for r in rules:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.greatest(m * (1 - m) / v - 1, F.lit(0.0))
        out = out.withColumn(f"rate_{r}", F.when(v <= 1e-12, m).otherwise((F.col(f"f_{r}") + strength * m) / (F.col("n_docs") + strength)))
    failed = F.lit(False)
    for r in rules:
        failed = failed | (F.col(f"rate_{r}") > limits[r])
    return out.select(host_key, "n_docs", *[f"rate_{r}" for r in rules], failed.alias("host_failed"))


def _judged(rows: DataFrame, text: str, columns: list[str], limits: dict[str, float] | None) -> DataFrame:
    """``columns`` with measures and verdicts; ``rows`` has ``host_key`` and the text.

    The measured rows are written once to the shared folder, as both the hosts' rates and
    the final rows come from them."""
    rows = materialize(measured(rows, text).select(*[f"`{c}`" for c in columns], "host_key", *MEASURES, "base_failed"), "host-measures")
    # the few failing hosts only; all others pass
    bad = host_verdicts(rows, limits=limits).filter("host_failed").select("host_key", "host_failed")
    return (join_measured(rows, bad, "host_key", "left")
            .withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
            .select(*[f"`{c}`" for c in columns], *MEASURES, "base_failed", "host_failed", "kept"))


def host_quality(docs: DataFrame, host: str = "source", text: str = "text", keep_columns: list[str] | None = None,
                 limits: dict[str, float] | None = None) -> DataFrame:
    """``keep_columns`` of ``docs`` (default: all but the text) with the measures,
    ``base_failed``, ``host_failed`` and ``kept``; clashing names are replaced."""
    columns = [c for c in (keep_columns if keep_columns is not None else [c for c in docs.columns if c != text])
               if c not in {*MEASURES, "base_failed", "host_failed", "kept", "host_key"}]
    # the kept columns travel in one, so no name can clash
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0))
    wanted = docs.select(kept.alias("_row"), docs[text].alias("_text"), source_key(host).alias("host_key"))
    judged = _judged(wanted, "_text", ["_row"], limits)
    return judged.select(*[F.col("_row").getField(c).alias(c) for c in columns], *[c for c in judged.columns if c != "_row"])


def passing(docs: DataFrame, host: str = "source", text: str = "text", limits: dict[str, float] | None = None) -> DataFrame:
    """The kept rows of ``docs``, all its columns as they were."""
    wanted = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), docs[text].alias("_text"), source_key(host).alias("host_key"))
    return _judged(wanted, "_text", ["_row"], limits).filter("kept").select("_row.*")
