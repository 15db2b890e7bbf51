"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpulse.session import materialize

__all__ = ["WORD", "documents", "vocabulary", "let", "text_or_empty", "words", "word_count", "source_key", "order_key", "materialize",
           "small_batches", "join_measured"]

#: a word of the contracts: a run without space, tab, newline, \x0B, \x0C or carriage return
WORD = r"[^\x20\x09-\x0D]+"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: inside higher-order functions
    Spark evaluates an outer expression again for every element, a lambda variable not."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_key(source: str = "source") -> Column:
    """A never-null stand-in for a nullable key: equal for equal values, own value for null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def order_key(seed: str, *parts: Column) -> Column:
    """60 seeded pseudorandom bits of the given values, the same in any engine with md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a run of very long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def join_measured(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """Join with ``right`` broadcast only when its counted rows (ids and a few numbers each)
    are at most ``most``; beyond that Spark's own choice, a shuffle that AQE splits on skew.
    Both give the same rows."""
    small = right.limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)
