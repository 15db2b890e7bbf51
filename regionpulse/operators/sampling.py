"""Balanced under-sampling, paired train/test split, stratified folds, standardisation.

Randomness is a seeded hash of each row's key (md5 of "seed,<group values>,<key>"),
so every draw is reproducible, independent of partitioning, and the same in any
engine that has md5.  Windows are partitioned by (group, label): their size is the
number of rows of one group and class, never the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from regionpulse.functions import ntz_epoch_seconds


def _key_text(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    out = []
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    for c in cols:
        dt = types[c]
        if isinstance(dt, T.TimestampNTZType):
            out.append(ntz_epoch_seconds(c).cast("string"))
        elif isinstance(dt, T.TimestampType):
            out.append(F.unix_seconds(F.col(c)).cast("string"))
        else:
            out.append(F.col(c).cast("string"))
    return out


def hash_key(df: DataFrame, seed: int, salt: str, cols: Sequence[str]) -> Column:
    return F.md5(F.concat_ws(",", F.lit(str(seed)), F.lit(salt), *_key_text(df, cols)))


def undersample(
    df: DataFrame,
    label: str = "label",
    by: Sequence[str] = ("region",),
    key: Sequence[str] = ("t",),
    seed: int = 0,
) -> DataFrame:
    """ML1 / ST2: per group keep min(n_pos, n_neg) rows of EACH class, drawn by hash rank.

    Equals "all positives + exactly n_pos negatives" whenever negatives >= positives."""
    by = list(by)
    h = hash_key(df, seed, "sample", [*by, *key])
    rank = F.row_number().over(Window.partitionBy(*by, label).orderBy(h, *key))
    cls = Window.partitionBy(*by)
    n_pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).over(cls)
    n_neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).over(cls)
    out = df.withColumn("_rank", rank).withColumn("_keep", F.least(n_pos, n_neg))
    return out.filter(F.col("_rank") <= F.col("_keep")).drop("_rank", "_keep")


def train_test_split(
    df: DataFrame,
    by: Sequence[str] = ("region",),
    key: Sequence[str] = ("t",),
    test_fraction: float = 0.3,
    seed: int = 0,
    out: str = "is_test",
) -> DataFrame:
    """ML2: per group, the ceil(fraction * n) rows with the smallest hash are the test set.

    One split column serves every feature set, so sparse and dense rows stay paired."""
    by = list(by)
    h = hash_key(df, seed, "split", [*by, *key])
    w = Window.partitionBy(*by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(h, *key))
    n_test = F.ceil(F.lit(test_fraction) * F.count(F.lit(1)).over(w))
    return df.withColumn(out, rank <= n_test)


def cv_folds(
    df: DataFrame,
    k: int = 5,
    label: str = "label",
    by: Sequence[str] = ("region",),
    order: Sequence[str] = ("t",),
    out: str = "fold",
) -> DataFrame:
    """ML4 / WN4: stratified, unshuffled k folds: within each (group, class), rows in
    ``order`` are cut into k contiguous chunks, the first n % k one row larger."""
    w = Window.partitionBy(*by, label).orderBy(*order)
    return df.withColumn(out, (F.ntile(k).over(w) - 1).cast("int"))


def standardize(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = ("region",),
    fit_mask: Column | None = None,
    suffix: str = "",
) -> DataFrame:
    """ML3: z = (x - mean) / population std per group; zero std -> 0.

    ``fit_mask`` selects the rows the moments are fitted on (e.g. the training rows);
    None fits on all rows of the group."""
    by = list(by)
    w = Window.partitionBy(*by)
    out = df
    for c in cols:
        x = F.col(c).cast("double")
        xf = x if fit_mask is None else F.when(fit_mask, x)
        mean = F.avg(xf).over(w)
        std = F.stddev_pop(xf).over(w)
        z = F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))
        out = out.withColumn(f"{c}{suffix}", z)
    return out
