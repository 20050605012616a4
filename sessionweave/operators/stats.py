"""Descriptive statistics, bins and correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def right_closed_bin(value: Column, edges: list[float], labels: list[str], include_lowest: bool = False) -> Column:
    """The label of the bin (a, b] that holds value, the first bin also holding its lower edge on request; NULL outside."""
    out = None
    for k, label in enumerate(labels):
        above = value >= edges[k] if include_lowest and k == 0 else value > edges[k]
        met = above & (value <= edges[k + 1])
        out = F.when(met, label) if out is None else out.when(met, label)
    return out


def bin_table(df: DataFrame, bin_col: str, labels: list[str], value: str, flag: Column | None = None) -> DataFrame:
    """A row for every label, empty ones too: count, share in percent, mean, deviation, median, and the share of flag."""
    extra = [] if flag is None else [F.avg(F.col("flag").cast("double")).alias("flag_share")]
    narrow = [bin_col, F.col(value).cast("double").alias("x")] + ([] if flag is None else [flag.alias("flag")])
    rows = staged(df.where(F.col(bin_col).isNotNull()).select(*narrow))
    median = grouped_quantiles(rows, [bin_col], "x", [0.5]).select(bin_col, F.col("value").alias("median"))
    found = rows.groupBy(bin_col).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), *extra).join(F.broadcast(median), bin_col, "left")  # a row per label
    order = df.sparkSession.createDataFrame([(name, k) for k, name in enumerate(labels)], f"{bin_col} string, ordinal int")
    full = F.broadcast(order).join(found, bin_col, "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row per label
    return full.withColumn("share_percent", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)))


def unpivoted(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """keys, feature, value in long form."""
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.value")


def _folded(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """A row per column from one aggregate over all of them, without a shuffle of long rows."""
    structs = [F.struct(F.lit(c).alias("feature"), *stats(F.col(c).cast("double"))).alias(f"f{k}") for k, c in enumerate(columns)]
    return df.agg(*structs).select(F.explode(F.array(*(f"f{k}" for k in range(len(columns))))).alias("s")).select("s.*")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, count, mean, std (sample), min, exact quartiles, max."""
    rows = staged(df.select(*(F.col(c).cast("double").alias(c) for c in columns)))
    stats = lambda x: [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    found = grouped_quantiles(unpivoted(rows, columns), ["feature"], "value", [0.25, 0.5, 0.75])
    wide = found.groupBy("feature").agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)))
    return _folded(rows, columns, stats).join(F.broadcast(wide), "feature", "left").select("feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def grouped_quantiles(df: DataFrame, groups: list[str], column: str, at: list[float]) -> DataFrame:
    """(groups, p, value), exact and linearly interpolated; groups without values are left out.

    Distinct values are counted and dealt by ranges; their ranks come from the ranges' sums, and only the values at the wanted ranks
    are looked up. No task holds all values of a group.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = staged(counts.repartitionByRange(*groups, "_v").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*groups, "_part").agg(F.sum("_n").alias("_m"))  # a row per partition and group in it
    inside = Window.partitionBy(*(groups or [F.lit(1)]))
    base = sums.select(*groups, "_part", F.coalesce(F.sum("_m").over(inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_m").over(inside).alias("_total"))
    above = Window.partitionBy(*groups, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("_base") + F.coalesce(F.sum("_n").over(above), F.lit(0))
    ranked = dealt.join(base, [*groups, "_part"]).withColumn("_low", low)
    asked = ranked.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in at)))).withColumn("_place", F.col("p") * (F.col("_total") - 1))
    holds = lambda rank: F.when((F.col("_low") <= rank) & (rank < F.col("_low") + F.col("_n")), F.col("_v"))
    found = asked.groupBy(*groups, "p").agg(F.max(holds(F.floor("_place"))).alias("_a"), F.max(holds(F.ceil("_place"))).alias("_b"), F.max("_place").alias("_place"))
    return found.select(*groups, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))).alias("value"))


def quantiles(df: DataFrame, column: str, at: list[float]) -> DataFrame:
    """(p, value), exact and linearly interpolated."""
    return grouped_quantiles(df.select(F.col(column).cast("double").alias(column)), [], column, at)


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    return _folded(df, columns, lambda x: [F.var_samp(x).alias("variance")]).orderBy(F.desc_nulls_last("variance"), "feature")


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, valid, missing, mean, std (sample)."""
    return _folded(df, columns, lambda x: [F.count(x).alias("valid"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")])


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = [F.struct(F.lit(c).alias("feature"), F.count_if(F.col(c).isNull()).alias("missing")).alias(f"f{k}") for k, c in enumerate(columns)]
    return df.agg(*counts).select(F.explode(F.array(*(f"f{k}" for k in range(len(columns))))).alias("s")).select("s.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent rounded to 3 places) by value."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 3).alias("percent")).orderBy("value")


def differences(df: DataFrame, a: str, b: str) -> DataFrame:
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(F.avg(gap).alias("mean_abs"), F.max(gap).alias("max_abs"), F.count_if(gap > 0).alias("n_different"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair, in one pass, each over the rows where both are present."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(both(a, b), both(b, a)).alias("r")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]
    return df.agg(*cells).select(F.explode(F.array(*(f"c{k}" for k in range(len(cells))))).alias("s")).select("s.*")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ranks, ties sharing the mean of theirs.

    Ranks come from the counts of distinct values, which are summed up by ranges of values, so that no window spans all rows.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    dealt = staged(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))  # a row per partition
    inner = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(base), "part")
    ranks = ranked.select("v", (F.col("base") + F.col("inner") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, df[column] == ranks["v"], "left").drop("v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n) over the rows where both are present."""
    rows = staged(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")))
    return average_ranks(average_ranks(rows, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def partial_correlation(df: DataFrame, a: str, b: str, control: str) -> DataFrame:
    """(r, n): correlation of a and b with control's linear part taken out of both."""
    rows = df.select(*(F.col(c).cast("double").alias(n) for c, n in ((a, "a"), (b, "b"), (control, "c")))).dropna()
    r = rows.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"), F.count("*").alias("n"))
    return r.select(((F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.pow("ac", 2)) * (1 - F.pow("bc", 2)))).alias("r"), "n")


def fit_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """slope, intercept, r2, residual_std (sample) of y on x; one row."""
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna()
    fit = rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    residual = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    spread = rows.crossJoin(F.broadcast(fit)).agg(F.stddev_samp(residual).alias("residual_std"))  # fit is one row
    return fit.crossJoin(spread)


def residuals(df: DataFrame, y: str, x: str, out: str = "residual") -> DataFrame:
    fit = df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    return df.crossJoin(F.broadcast(fit)).withColumn(out, F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x))).drop("slope", "intercept")


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation under t with n - 2 degrees of freedom, by the regularised incomplete beta function."""
    if r == 0:
        return 1.0
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-r * r) + b * 2 * math.log(abs(r)))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, r * r) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The incomplete beta function's continued fraction by Lentz's method."""
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n) of equal width between the least and greatest value; empty bins are kept."""
    edges = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = F.greatest((F.col("high") - F.col("low")) / bins, F.lit(1e-300))
    held = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(held, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def box_plot(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """What a box plot draws for each group: n, q1, median, q3, the farthest values within `reach` box heights of the box (low, high), and
    how many lie beyond. Groups without values are left out."""
    rows = staged(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("x")))
    found = grouped_quantiles(rows, [group], "x", [0.25, 0.5, 0.75])
    boxes = found.groupBy(group).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    inside = F.col("x").between(F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    kept = F.when(inside, F.col("x"))
    return rows.join(boxes, group).groupBy(group, "q1", "median", "q3").agg(F.count("*").alias("n"), F.min(kept).alias("low"), F.max(kept).alias("high"), F.count_if(~inside).alias("outliers"))


def heat_map(df: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float]) -> DataFrame:
    """(x_bin, y_bin, n) of a grid whose bins hold their lower edge, the last ones their upper edge too; empty cells are kept, values outside left out."""
    def place(c: str, edges: list[float]) -> Column:
        v = F.col(c).cast("double")
        held = sum((F.when(v >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
        return F.when((v >= edges[0]) & (v <= edges[-1]), held)

    counts = df.select(place(x, x_edges).alias("x_bin"), place(y, y_edges).alias("y_bin")).where("x_bin is not null and y_bin is not null").groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
    each = lambda edges: F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2)))
    grid = df.sparkSession.range(1).select(each(x_edges).alias("x_bin")).select("x_bin", each(y_edges).alias("y_bin"))
    return grid.join(counts, ["x_bin", "y_bin"], "left").na.fill(0, ["n"])


def sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows by the hash of seed and keys: the same ones however the rows are laid out, and nested as n grows."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def by_availability(df: DataFrame, column: str, value: str) -> DataFrame:
    """(available, n, mean, std, min, max) of value among the rows with and without column."""
    x = F.col(value).cast("double")
    return df.groupBy(F.col(column).isNotNull().alias("available")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Duplicates of keys dropped: the row that is least by order stays; with partial aggregation, so a hot key is no bottleneck."""
    rest = [c for c in df.columns if c not in keys]
    least = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order, *(c for c in rest if c not in order))).alias("row"))
    return least.select(*keys, "row.*").select(*df.columns)


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values in order, without NULL."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value")


def token_differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """(difference, n) of two token counts, by difference."""
    return df.groupBy((F.col(a) - F.col(b)).alias("difference")).agg(F.count("*").alias("n")).orderBy("difference")


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation under t with n - 2 degrees of freedom, as `correlation_p_value`, in column expressions: the regularised
    incomplete beta function of n / 2 - 1 and 1/2 by its continued fraction, on the side where it converges fast, in as many rounds as
    the degrees of freedom ask for."""
    a, b = (n.cast("double") - 2) / 2, F.lit(0.5)
    square = r * r
    steps = [F.log((a + k) / (a + k + 0.5)) for k in range(10)]  # brings the argument to where the series below holds
    far = a + 10
    series = 0.5 * F.log(far) - 1 / (8 * far) + 1 / (192 * F.pow(far, 3)) - 1 / (640 * F.pow(far, 5)) + 17 / (14336 * F.pow(far, 7))
    front = F.exp(sum(steps, series) - 0.5 * math.log(math.pi) + a * F.log1p(-square) + F.log(F.abs(r)))
    rounds = F.sequence(F.lit(1), (60 + 4 * F.ceil(F.sqrt(a))).cast("int"))
    near = square < F.lit(1.5) / (a + 2.5)
    beta = F.when(near, 1 - front * _fraction(b, a, square, rounds) / b).otherwise(front * _fraction(a, b, 1 - square, rounds) / a)
    return F.when(r == 0, 1.0).when((n < 3) | F.isnan(r), F.lit(float("nan"))).when(F.abs(r) >= 1, 0.0).otherwise(beta)


def _fraction(a: Column, b: Column, x: Column, rounds: Column) -> Column:
    """`_beta_fraction` with a fixed number of rounds."""
    kept = lambda v: F.when(v == 0, 1e-300).otherwise(v)
    first = 1 / kept(1 - (a + b) * x / (a + 1))

    def turn(s: Column, m: Column) -> Column:
        def half(s: Column, top: Column) -> Column:
            d = 1 / kept(1 + top * s["d"])
            c = kept(1 + top / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # the second half sees the first through a one-element array, so that it is computed once
        return F.get(F.transform(F.array(half(s, even)), lambda t: half(t, odd)), 0)

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(rounds, start, lambda s, m: turn(s, m.cast("double")), lambda s: s["h"])
