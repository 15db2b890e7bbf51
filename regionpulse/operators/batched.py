"""All fits of an evaluation as rows of one table.

A fit is a value of the key columns: run, region, feature set, raw or standardised, and fold
(-1: the test split).  ``fit_rows`` writes every row of the sample once under each fit, marked
as training or held out; moments for the scaling come from one grouped aggregate.  The models
then train all fits together, so the number of jobs does not depend on the number of fits.

``logistic`` is Newton's method with the fits side by side: one job per iteration sums the
gradient and X'WX of every fit (partial aggregation first, so a fit with a third of all rows
costs no more), and the small linear systems are solved in a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionpulse.config import FEATURES
from regionpulse.session import materialize, scratch

KEYS = ("run", "region", "feature_set", "scaled", "fold")
X = tuple(f"x{k}" for k in range(len(FEATURES)))
TEST_FOLD = -1
SETS = (("sparse", "s_"), ("dynamic", "d_"))


def fit_rows(sample: DataFrame, folds: int, scaled: Sequence[bool] = (False, True), sets=SETS, leaky: bool = False, pooled: str | None = None) -> DataFrame:
    """(KEYS..., held_out, label, x0...): ``sample`` (run, region, label, is_test, fold and the
    prefixed features) under every fit.

    Standardised features are z = (x - mean) / population std with the moments of the
    region's training rows (``leaky``: of all its rows, except for the test split); a
    constant feature is 0.  ``pooled`` names one region that stands for all of them:
    scaling stays per region, the fits are joint."""
    one = F.explode(F.array(*[F.struct(F.lit(name).alias("feature_set"), *[F.col(f"{prefix}{f}").cast("double").alias(x) for x, f in zip(X, FEATURES)])
                              for name, prefix in sets])).alias("one")
    rows = sample.select("run", "region", F.col("label").cast("int").alias("label"), "is_test", F.col("fold").alias("own"), one).select("run", "region", "label", "is_test", "own", "one.*")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(TEST_FOLD), F.lit(folds - 1))))
    rows = rows.withColumn("held_out", F.when(F.col("fold") == TEST_FOLD, F.col("is_test")).otherwise(F.col("own") == F.col("fold"))).drop("is_test", "own")
    by = ["run", "region", "feature_set", "fold"]
    if True in scaled:
        fitted = rows.filter(~F.col("held_out") | (F.lit(leaky) & (F.col("fold") != TEST_FOLD)))
        moments = fitted.groupBy(*by).agg(*[F.avg(x).alias(f"mean_{x}") for x in X], *[F.stddev_pop(x).alias(f"std_{x}") for x in X])
        rows = rows.join(moments, by)
    kinds = []
    for kind in scaled:
        value = {x: F.when(F.col(f"std_{x}") > 0, (F.col(x) - F.col(f"mean_{x}")) / F.col(f"std_{x}")).otherwise(F.lit(0.0)) if kind else F.col(x) for x in X}
        kinds.append(F.struct(F.lit(kind).alias("scaled"), *[v.alias(x) for x, v in value.items()]))
    region = F.lit(pooled).alias("region") if pooled else F.col("region")
    return rows.select("run", region, "feature_set", "fold", "held_out", "label", F.explode(F.array(*kinds)).alias("z")).select("run", "region", "feature_set", "z.scaled", "fold", "held_out", "label", *[f"z.{x}" for x in X])


def solve(rows: Column, n: int) -> Column:
    """The solution of a symmetric positive definite system, given as the rows of the matrix
    with the right side behind: Gauss-Jordan elimination, one step per column."""
    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        scaled = lambda row: F.zip_with(row, pivot, lambda a, b: a - b * F.get(row, k) / F.get(pivot, k))
        return F.transform(m, lambda row, i: F.when(i == k, F.transform(pivot, lambda v: v / F.get(pivot, k))).otherwise(scaled(row)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step), lambda row: F.get(row, F.lit(n)))


def _linear(beta: Column, columns: Sequence[str]) -> Column:
    total = F.get(beta, F.lit(0))
    for k, x in enumerate(columns, 1):
        total = total + F.get(beta, F.lit(k)) * F.col(x)
    return total


def logistic(train: DataFrame, by: Sequence[str] = KEYS, columns: Sequence[str] = X, c: float = 1.0, iterations: int = 60, tolerance: float | None = 1e-9) -> DataFrame:
    """ML6: (by..., beta, moved): the L2-regularised logistic regression of every fit, intercept
    first and free of the penalty; minimises |w|^2 / 2 + c * sum of log losses.

    A step that does not lower the objective is halved until it does.  Iterations end when no
    fit moves by more than ``tolerance`` (relative to its largest coefficient) or after
    ``iterations`` of them; without a tolerance exactly that many run."""
    by, n = list(by), len(columns)
    values = ["one", *columns]
    pairs = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    spark = train.sparkSession
    zeros = F.array_repeat(F.lit(0.0), n + 1)
    with scratch(spark):
        train = materialize(train.select(*by, F.col("label").cast("double").alias("label"), *columns), "newton-rows")
        state = materialize(train.select(*by).distinct().select(*by, zeros.alias("beta"), zeros.alias("base"), F.lit(None).cast("double").alias("best"), zeros.alias("step"), F.lit(True).alias("moved")), "newton-state")
        for _ in range(iterations):
            rows = train.join(state.select(*by, "beta"), by).withColumn("eta", _linear(F.col("beta"), columns)).withColumn("one", F.lit(1.0))
            rows = rows.withColumn("p", 1 / (1 + F.exp(-F.col("eta")))).withColumn("w", F.col("p") * (1 - F.col("p")))
            loss = F.greatest("eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("label") * F.col("eta")
            sums = rows.groupBy(*by).agg(F.sum(loss).alias("loss"), *[F.sum((F.col("label") - F.col("p")) * F.col(v)).alias(f"g{i}") for i, v in enumerate(values)],
                                         *[F.sum(F.col("w") * F.col(values[i]) * F.col(values[j])).alias(f"h{i}_{j}") for i, j in pairs])
            at = sums.join(state, by)
            weights = F.slice("beta", 2, n)
            objective = F.aggregate(weights, c * F.col("loss"), lambda s, b: s + b * b / 2)
            at = at.withColumn("now", objective).withColumn("better", F.col("best").isNull() | (F.col("now") <= F.col("best") + 1e-12 * F.abs("best")))
            system = F.array(*[F.array(*[c * F.col(f"h{min(i, j)}_{max(i, j)}") + (F.lit(1.0 if i else 1e-9) if i == j else F.lit(0.0)) for j in range(n + 1)],
                                       c * F.col(f"g{i}") - (F.get("beta", F.lit(i)) if i else F.lit(0.0))) for i in range(n + 1)])
            step = F.when(F.col("better"), solve(system, n + 1)).otherwise(F.transform("step", lambda s: s / 2))
            at = at.select(*by, F.when(F.col("better"), F.col("beta")).otherwise(F.col("base")).alias("base"), F.when(F.col("better"), F.col("now")).otherwise(F.col("best")).alias("best"), step.alias("step"))
            largest = lambda a: F.array_max(F.transform(a, F.abs))
            moved = largest("step") > (0.0 if tolerance is None else tolerance) * (1 + largest("base"))
            state = materialize(at.select(*by, F.zip_with("base", "step", lambda a, b: a + b).alias("beta"), "base", "best", "step", moved.alias("moved")), "newton-state")
            if tolerance is not None and not state.filter("moved").limit(1).count():
                break
        return materialize(state.select(*by, "beta", "moved"), "newton-betas", keep=True)


def logistic_scores(held: DataFrame, betas: DataFrame, by: Sequence[str] = KEYS, columns: Sequence[str] = X) -> DataFrame:
    """(by..., label, score, prediction) of held-out rows: score is the probability of class 1."""
    by = list(by)
    rows = held.join(betas.select(*by, "beta"), by).withColumn("score", 1 / (1 + F.exp(-_linear(F.col("beta"), columns))))
    return rows.select(*by, "label", "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


def blocks(rows: DataFrame, by: Sequence[str], columns: Sequence[str], block_rows: int, most_rows: int | None = None, seed: int = 0) -> DataFrame:
    """(by..., n, n_blocks, block, label, x): the rows of every fit in blocks of about ``block_rows``
    rows, as arrays, in an order of their content.  With ``most_rows`` a fit with more rows
    is a seeded sample of about that many (``n`` counts all); no model uses that, all train on all rows.

    Equal rows are counted first and their count is spread over the blocks, so a value that
    many rows share fills no block; the blocks depend on the content alone, never on the
    layout of the input."""
    by = list(by)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    equal = rows.groupBy(*by, "label", *columns).agg(F.count(F.lit(1)).alias("times")).join(sizes, by).withColumn("key", F.xxhash64(F.lit(seed), *columns, "label"))
    if most_rows is not None:
        share = F.col("times") * F.lit(float(most_rows)) / F.col("n")
        chance = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        equal = equal.withColumn("times", F.when(F.col("n") <= most_rows, F.col("times")).otherwise(F.floor(share + chance))).filter("times > 0")
    equal = equal.withColumn("n_blocks", F.ceil(F.least("n", F.lit(most_rows or (1 << 62))) / block_rows).cast("int"))
    equal = equal.withColumn("pieces", F.least("times", F.col("n_blocks").cast("long"))).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    part = (F.floor(F.col("times") / F.col("pieces")) + (F.col("piece") < F.col("times") % F.col("pieces")).cast("long")).cast("int")
    dealt = equal.withColumn("block", F.pmod(F.col("key") + F.col("piece"), F.col("n_blocks").cast("long")).cast("int")).withColumn("times", part)
    packed = dealt.groupBy(*by, "n", "n_blocks", "block").agg(F.array_sort(F.collect_list(F.struct("key", "label", *columns, "times"))).alias("r"))
    label = F.flatten(F.transform("r", lambda r: F.array_repeat(r["label"].cast("double"), r["times"])))
    values = F.flatten(F.transform("r", lambda r: F.flatten(F.array_repeat(F.array(*[r[x] for x in columns]), r["times"]))))
    return packed.select(*by, "n", "n_blocks", "block", label.alias("label"), values.alias("x"))
