"""Information-theoretic sanitisation of personal data (DataFrame operations only).

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that
patterns and checks find in whole texts.  A term that stands in documents of an entity can
give it away even when the entity itself is gone.  Corpus counts over documents say how much:
with N documents, n_t with the term, n_e with the entity and n_te with both,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N n_te / (n_t n_e)) / log(N / n_e),

the share of the entity's information content that the term reveals (1: whoever reads the
term knows the entity).  Terms at or above ``disclosure`` in at least ``support`` different
contexts of the entity are condemned.  Different contexts: a thousand copies of one
passage are one context, so a word is not condemned for having been copied.  Counts are
taken twice, and either condemns: over whole documents (a context is a text), and over the
surroundings of the entity within ``reach`` on its line (a context is such a passage).

Every occurrence of a condemned term is a span, in every document, with or without the
entity, unless it lies in an entity's own span.

``sanitize`` generalises entities to their kind and removes disclosing terms.

Defined cases: a null text counts as empty and has no spans (it stays null when
sanitised); kinds may overlap each other, spans of one kind never do; repeated rows get
the same spans each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionpulse.llm.common import join_measured, let, materialize, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"
#: The contract's patterns, written so that a long run is read once: possessive where the
#: next class cannot begin inside the last one, and starting only where a run starts (or
#: where the last match ended).  The matches are the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a cheap sign without which a pattern cannot match
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
TERM_PATTERN = r"[\p{L}\p{N}]{3,}"


@dataclass(frozen=True)
class Disclosure:
    disclosure: float = 0.9
    support: int = 3
    reach: int = 120  # code points on each side of an entity, within its line


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(found: Column) -> Column:
        steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("value"))
        first = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(done: Column, x: Column) -> Column:
            return let(done["at"] + F.length(x["gap"]), lambda start: F.struct(
                (start + F.length(x["value"])).alias("at"),
                F.array_append(done["out"], F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))).alias("out")))
        return F.aggregate(steps, first, step, lambda done: done["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + let(
        F.substring(digits, -i, F.lit(1)).cast("int"),
        lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return ~value.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """What makes two finds the same entity."""
    return F.lower(value) if kind == "email" else _digits(value) if kind in ("card", "phone") else value


def base_spans(text: Column) -> Column:
    """array<struct<start, kind_no, end, entity>> of all valid entities, sorted by start, then kind."""
    return F.sort_array(F.concat(*[_spans_of(text, no, kind) for no, kind in enumerate(KINDS)]))


def _spans_of(text: Column, no: int, kind: str) -> Column:
    found = F.transform(F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.concat(F.lit(f"{kind}:"), _entity(kind, s["value"])).alias("entity")))
    if kind not in SIGNS:
        return found
    return F.when(F.contains(text, F.lit(SIGNS[kind])), found).otherwise(F.array().cast("array<struct<start:int,kind_no:int,end:int,entity:string>>"))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, TERM]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def contexts(text: Column, spans: Column, reach: int) -> Column:
    """For each span the terms around it: array<struct<entity, context, terms: array<struct<start, end, value>>>>."""
    def side(part: Column, offset: Column) -> Column:
        return F.transform(located(part, TERM_PATTERN), lambda t: F.struct((t["start"] + offset).alias("start"), (t["end"] + offset).alias("end"), F.lower(t["value"]).alias("value")))

    def one(s: Column) -> Column:
        # the part of the line before (after) the entity; a word cut by the reach is left out
        before = let(F.substring(text, F.greatest(s["start"] - reach, F.lit(0)) + 1, F.least(s["start"], F.lit(reach))), lambda p: F.substring_index(
            F.when(s["start"] > reach, F.regexp_replace(p, r"^[^\x20\x09-\x0D]+", "")).otherwise(p), "\n", -1))
        after = let(F.substring(text, s["end"] + 1, F.lit(reach + 1)), lambda p: F.substring_index(
            F.when(F.length(p) > reach, F.regexp_replace(p, r"[^\x20\x09-\x0D]+$", "")).otherwise(p), "\n", 1))
        return let(F.struct(before.alias("b"), after.alias("a")), lambda p: F.struct(
            s["entity"].alias("entity"), F.md5(F.concat_ws("\n", p["b"], p["a"])).alias("context"),
            F.filter(F.concat(side(p["b"], s["start"] - F.length(p["b"])), side(p["a"], s["end"])),
                     lambda t: ~F.exists(spans, lambda o: (o["start"] < t["end"]) & (t["start"] < o["end"]))).alias("terms")))
    return F.transform(spans, one)


def _whole(base: DataFrame, n_t: DataFrame, total: int, rule: Disclosure) -> DataFrame:
    """(entity, term): terms that whole documents condemn.

    share >= d needs n_t <= n_te (N / n_e)^(1 - d) <= n_e^d N^(1 - d): more common terms are
    left out before terms meet entities, as are entities and terms in too few texts."""
    entities = base.select("doc_id", "text_id", F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity"))
    n_e = (entities.groupBy("entity", "text_id", "doc_id").count().groupBy("entity").agg(F.count_distinct("text_id").alias("texts"), F.count_distinct("doc_id").alias("n_e"))
           .filter((F.col("texts") >= rule.support) & (F.col("n_e") < total))
           .withColumn("most", F.pow("n_e", F.lit(rule.disclosure)) * F.pow(F.lit(float(total)), F.lit(1 - rule.disclosure)) * (1 + 1e-9)))
    n_e = materialize(n_e.drop("texts"), "pii-entities")
    held = materialize(join_measured(entities, n_e, "entity").distinct(), "pii-held")
    texts = held.groupBy("doc_id", "text_id").agg(F.max("most").alias("_most"))
    words = base.select("doc_id", "text_id", F.explode("words").alias("term")).distinct()
    key = ["doc_id", "text_id"]
    rare = join_measured(join_measured(words, texts, key), n_t.filter(F.col("n_t") >= rule.support), "term").filter("n_t <= _most").select(*key, "term", "n_t")
    both = rare.join(held, key).filter("n_t <= most")
    wanted = materialize(both.groupBy("entity", "term", "text_id").agg(F.count(F.lit(1)).alias("_")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"))
                         .filter(F.col("texts") >= rule.support).select("entity", "term"), "pii-candidates")
    n_te = join_measured(both, wanted, ["entity", "term"], "left_semi").select("entity", "term", "n_t", "n_e", "doc_id").distinct().groupBy("entity", "term", "n_t", "n_e").agg(F.count(F.lit(1)).alias("n_te"))
    return n_te.filter(_share(total) >= rule.disclosure).select("entity", "term")


def _share(total: int) -> Column:
    return F.log(F.lit(float(total)) * F.col("n_te") / (F.greatest("n_t", "n_te") * F.col("n_e"))) / F.log(F.lit(float(total)) / F.col("n_e"))


def condemned(docs: DataFrame, base: DataFrame, rule: Disclosure, text: str = "text") -> DataFrame:
    """(term), written: the terms that disclose some entity.

    ``base``: written rows (doc_id, text_id, spans, near, words) of the texts with entities.
    A document without an id is told from others by its text."""
    base = base.withColumn("doc_id", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.col("text_id").cast("string"))))
    near = base.select("doc_id", F.explode("near").alias("c")).select("doc_id", "c.entity", "c.context", F.explode("c.terms").alias("t"))
    pairs = near.select("entity", F.col("t.value").alias("term"), "context").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"))
    wanted = materialize(pairs.filter(F.col("contexts") >= rule.support).select("entity", "term"), "pii-candidates")
    n_te = near.select("entity", F.col("t.value").alias("term"), "doc_id").join(wanted, ["entity", "term"], "left_semi").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    n_e = near.select("entity", "doc_id").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    of_entities = base.select(F.explode("words").alias("term")).union(wanted.select("term")).distinct()
    in_texts = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(TERM_PATTERN), F.lit(0)))).alias("term"))
    counts = in_texts.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n_t = materialize(counts.join(of_entities, "term", "left_semi"), "pii-counts")
    total = docs.count()
    told = n_te.join(n_e, "entity").join(n_t, "term").filter((F.log(F.lit(float(total)) / F.col("n_e")) > 0) & (_share(total) >= rule.disclosure))
    return materialize(told.select("term").union(_whole(base, n_t, total, rule).select("term")).distinct(), "pii-terms")


def _spans_of_terms(text: Column, spans: Column, terms: Column) -> Column:
    """array of the spans, outside ``spans``, of all occurrences of ``terms``."""
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int,entity:string>>")

    def placed(found: Column) -> Column:
        steps = F.arrays_zip(F.slice(F.split(text, TERM_PATTERN, -1), 1, F.size(found)).alias("gap"), found.alias("value"))

        # only wanted places are appended: the cost of a text is its terms, not their square
        def step(done: Column, x: Column) -> Column:
            return let(done["at"] + F.length(x["gap"]), lambda start: let(start + F.length(x["value"]), lambda end: F.struct(end.alias("at"), F.when(
                F.array_contains(terms, F.lower(x["value"])) & ~F.exists(spans, lambda o: (o["start"] < end) & (start < o["end"])),
                F.array_append(done["out"], F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind_no"), end.alias("end"), F.lit(None).cast("string").alias("entity")))).otherwise(done["out"]).alias("out"))))
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda done: done["out"])

    return let(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), placed)


def disclosing_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text_id, added): the spans of all condemned terms of each text that has any.

    ``rows``: (doc_id, text_id, text, spans).  The distinct terms of every text meet the
    condemned ones; only texts with a hit are read for places."""
    distinct = rows.select("doc_id", "text_id", F.explode(_terms_of(F.col("text"))).alias("term"))
    hits = materialize(join_measured(distinct, terms, "term", "left_semi").groupBy("doc_id", "text_id").agg(F.collect_set("term").alias("_terms")), "pii-hits")
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "_terms")
    met = join_measured(rows, hits, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_id"] == F.col("_text_id")), most=200_000)
    return (met.select("doc_id", "text_id", _spans_of_terms(F.col("text"), F.col("spans"), F.col("_terms")).alias("added")).filter(F.size("added") > 0)
            .dropDuplicates(["doc_id", "text_id"]))


def _terms_of(text: Column) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), lambda t: F.lower(t)))


def _replaced(t: Column, spans: Column, tags: Column) -> Column:
    """The text with each stretch of spans replaced by the tag of the one that starts first."""
    def step(done: Column, s: Column) -> Column:
        new = s["start"] >= done["at"]
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(new, F.concat(
            done["out"], F.substring(t, done["at"] + 1, s["start"] - done["at"]), F.get(tags, s["kind_no"]))).otherwise(done["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda done: F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t))))


def _text_id(text: Column) -> Column:
    return F.xxhash64(text)


def find(docs: DataFrame, rule: Disclosure = Disclosure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_id, spans, all_spans): base spans, and base and term spans, of every row."""
    t = text_or_empty(text)
    rows = docs.select(docs[doc_id].alias("doc_id"), t.alias("text")).withColumn("spans", base_spans(F.col("text")))
    near = F.when(F.size("spans") > 0, contexts(F.col("text"), F.col("spans"), rule.reach))
    # the words of a text with entities, its entities' own left out
    words = F.when(F.size("spans") > 0, _terms_of(_replaced(F.col("text"), F.col("spans"), F.array(*[F.lit("\n") for _ in KINDS]))))
    base = materialize(rows.select("doc_id", _text_id(F.col("text")).alias("text_id"), "spans", near.alias("near"), words.alias("words")), "pii-spans")
    terms = condemned(docs, base.filter("near is not null"), rule, text)
    added = disclosing_spans(rows.withColumn("text_id", _text_id(F.col("text"))), terms)
    return (_with_added(base.select("doc_id", "text_id", "spans"), added)
            .withColumn("all_spans", F.sort_array(F.concat("spans", F.coalesce("added", F.array()))))
            .drop("added"))


def _with_added(rows: DataFrame, added: DataFrame) -> DataFrame:
    added = materialize(added, "pii-added").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "added")
    return join_measured(rows, added, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["text_id"] == F.col("_text_id")), "left").drop("_id", "_text_id")


def sanitize(docs: DataFrame, rule: Disclosure = Disclosure(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities generalised to ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>`` and
    disclosing terms removed; of overlapping spans the one that starts first names the
    whole stretch.  Columns and their order stay."""
    found = find(docs, rule, doc_id, text).filter(F.size("all_spans") > 0).groupBy("doc_id", "text_id").agg(F.first("all_spans").alias("_spans"))
    found = materialize(found, "pii-found").select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), "_spans")
    # the row travels in one column, so no name can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    tagged = docs.select(row.alias("row"), docs[doc_id].alias("row_id"), _text_id(text_or_empty(text)).alias("row_text"))
    met = join_measured(tagged, found, F.col("row_id").eqNullSafe(F.col("_id")) & (F.col("row_text") == F.col("_text_id")), "left", most=200_000)
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS], F.lit(""))
    t = F.col("row").getField(text)
    clean = F.when(F.col("_spans").isNull(), t).otherwise(_replaced(t, F.col("_spans"), tags))
    return met.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
