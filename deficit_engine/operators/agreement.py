"""Agreement between two coding methods: category totals, ICC(1), correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deficit_engine.functions.special import f_quantile, f_upper_tail


def method_totals(hits_x: DataFrame, hits_y: DataFrame) -> DataFrame:
    """sum(score) per category for each method, left-joined on category.

    Output: category, sum_score_x, sum_score_y.
    """
    x = hits_x.groupBy("category").agg(F.sum("score").alias("sum_score_x"))
    y = hits_y.groupBy("category").agg(F.sum("score").alias("sum_score_y"))
    return x.join(y, "category", "left")


def prevalence(totals: DataFrame, cohort: DataFrame,
               cols: tuple[str, ...] = ("sum_score_x", "sum_score_y")) -> DataFrame:
    """Totals divided by the cohort size (a scalar subquery, never a constant)."""
    n = cohort.select(F.count(F.lit(1))).scalar()
    return totals.select("category", *[(F.col(c) / n).alias(c.replace("sum_score", "prev"))
                                       for c in cols])


def to_long(totals: DataFrame, cols: tuple[str, ...] = ("sum_score_x", "sum_score_y")) -> DataFrame:
    """(category, rater, value) from the wide totals."""
    return totals.select("category", *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(["category"], list(cols), "rater", "value")


def icc_oneway(long: DataFrame, subject: str = "category", rater: str = "rater",
               value: str = "value", k: int | None = None) -> DataFrame:
    """One-way single-score ICC(1) with its F statistic.

    Subjects with a missing rating are dropped (complete cases). Mean squares
    come from per-subject moments (``var_pop`` is computed with a stable
    merge, so large totals do not lose precision):
    MSB = k * sum_i (m_i - m)^2 / (n - 1), MSW = sum_i SS_i / (n (k - 1)),
    ICC = (MSB - MSW) / (MSB + (k - 1) MSW), F = MSB / MSW.
    Output: one row n, k, msb, msw, icc, f_value, df1, df2. ``k`` (number
    of raters) is counted from the data unless the caller knows it.
    """
    if k is None:
        k = long.filter(F.col(value).isNotNull()).select(rater).distinct() \
            .select(F.count(F.lit(1))).scalar()
    else:
        k = F.lit(k)
    per = (long.groupBy(subject)
           .agg(F.count(value).alias("c"), F.count(F.lit(1)).alias("r"), F.avg(value).alias("m"),
                (F.var_pop(value) * F.count(value)).alias("ss"))
           .filter((F.col("c") == k) & (F.col("r") == k)))
    agg = per.agg(F.count(F.lit(1)).alias("n"), (F.var_pop("m") * F.count(F.lit(1))).alias("ssb_m"),
                  F.sum("ss").alias("ssw"))
    kk = k.cast("double")
    msb = kk * F.col("ssb_m") / (F.col("n") - 1)
    msw = F.col("ssw") / (F.col("n") * (kk - 1))
    return agg.select(
        F.col("n").cast("long").alias("n"), k.cast("long").alias("k"), msb.alias("msb"),
        msw.alias("msw")).select(
        "n", "k", "msb", "msw",
        F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (kk - 1) * F.col("msw")).alias("icc"),
        F.try_divide(F.col("msb"), F.col("msw")).alias("f_value"),
        (F.col("n") - 1).cast("long").alias("df1"),
        (F.col("n") * (k - 1)).cast("long").alias("df2"))


def icc_inference(icc: DataFrame, level: float = 0.95) -> DataFrame:
    """F test of ICC(1) = 0 against > 0, and the interval of the population ICC.

    ``icc``: output of :func:`icc_oneway`. p_value is the upper tail of F(df1,
    df2); with F_low = f / q(df1, df2) and F_high = f * q(df2, df1), q the
    (1 + level) / 2 quantile, the limits are (F - 1) / (F + k - 1). A perfect
    agreement (no f_value) gives NULLs. Adds p_value, icc_low, icc_high.
    """
    df1, df2, f = F.col("df1").cast("double"), F.col("df2").cast("double"), F.col("f_value")
    limit = lambda x: F.try_divide(x - 1, x + F.col("k") - 1)
    upper = (1 + level) / 2
    return (icc.withColumn("p_value", f_upper_tail(f, df1, df2))
            .withColumn("icc_low", limit(f / f_quantile(upper, df1, df2)))
            .withColumn("icc_high", limit(f * f_quantile(upper, df2, df1))))


def method_correlation(totals: DataFrame, exclude: str | None = None,
                       x: str = "sum_score_x", y: str = "sum_score_y") -> DataFrame:
    """Pearson correlation over complete pairs, optionally without one category."""
    df = totals.dropna(subset=[x, y])
    if exclude is not None:
        df = df.filter(F.col("category") != exclude)
    return df.agg(F.corr(x, y).alias("corr"), F.count(F.lit(1)).cast("long").alias("n"))


def correlations(totals: DataFrame, exclude: str, x: str = "sum_score_x", y: str = "sum_score_y") -> DataFrame:
    """E10 twice in one aggregate: over all categories and without one.

    Output: subset ("all", "without <category>"), n, corr.
    """
    kept = F.col("category") != exclude
    one = totals.dropna(subset=[x, y]).agg(
        F.corr(x, y).alias("a"), F.count(F.lit(1)).alias("n"),
        F.corr(F.when(kept, F.col(x)), F.when(kept, F.col(y))).alias("b"), F.count_if(kept).alias("m"))
    rows = F.array(F.struct(F.lit("all").alias("subset"), F.col("n").cast("long").alias("n"), F.col("a").alias("corr")),
                   F.struct(F.lit(f"without {exclude}").alias("subset"), F.col("m").cast("long").alias("n"), F.col("b").alias("corr")))
    return one.select(F.inline(rows))
