"""D12, D17, D19-D21, L1, L2, L24, L20's correlation check: profiling.

Order statistics are exact and come from counted values dealt by range
(``ranks``): the data is read once, no task holds a whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.numeric import hist_bin
from ..session import materialize
from . import ranks

#: An exclusion set of at most this many values is broadcast (a value takes some 40 bytes).
BROADCAST_VALUES = 500_000
#: Shares of one set value when sets are too large to broadcast.
SALTS = 8


def gather(df: DataFrame, cols: list[str] | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """All (or the given) columns to (key, value) rows, value as double, nulls kept."""
    cols = cols or df.columns
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot([], cols, key, value)


def value_counts(long: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value, cnt, cum, n): counts of non-null values with running totals in value order."""
    return ranks.running_counts(ranks.counted(long, key, value), key, value)


def _fivenum(counts: DataFrame, key: str, value: str, few_keys: bool) -> DataFrame:
    def n4(n):
        return F.floor((n + 3) / 2) / 2

    at = {"one": lambda n: F.lit(1), "low_lo": lambda n: F.floor(n4(n)), "low_hi": lambda n: F.ceil(n4(n)),
          "mid_lo": lambda n: F.floor((n + 1) / 2), "mid_hi": lambda n: F.ceil((n + 1) / 2),
          "up_lo": lambda n: F.floor(n + 1 - n4(n)), "up_hi": lambda n: F.ceil(n + 1 - n4(n)), "last": lambda n: n}
    v = ranks.values_at(counts, at, key, value, few_keys)

    def mean(name):
        return (F.col(f"{name}_lo") + F.col(f"{name}_hi")) / 2

    return v.select(key, F.col("one").alias("min"), mean("low").alias("lower_hinge"), mean("mid").alias("median"),
                    mean("up").alias("upper_hinge"), F.col("last").alias("max"), "n")


def fivenum(long: DataFrame, key: str = "key", value: str = "value", few_keys: bool = False) -> DataFrame:
    """Tukey's five numbers per key (min, lower hinge, median, upper hinge, max).

    ``n4 = floor((n+3)/2)/2``; positions 1, n4, (n+1)/2, n+1-n4, n; a
    half-integer position averages its two neighbours (S21)."""
    return _fivenum(ranks.counted(long, key, value), key, value, few_keys)


def quantiles7(long: DataFrame, probs=(0.25, 0.5, 0.75), key: str = "key", value: str = "value",
               names=("q1", "median", "q3")) -> DataFrame:
    """Type-7 (linear) quantiles per key, as R ``quantile``/``summary`` and
    Spark ``percentile`` compute them."""
    v = ranks.values_at(ranks.counted(long, key, value), ranks.quantile_ranks(probs, names), key, value)
    return v.select(key, *[ranks.quantile7(p, name).alias(name) for p, name in zip(probs, names)])


def outlier_values(long: DataFrame, coef: float = 1.5, key: str = "key", value: str = "value",
                   few_keys: bool = False) -> DataFrame:
    """L1: ``boxplot.stats(x)$out`` as a distinct (key, value) set: values beyond
    the hinges by more than ``coef`` hinge spreads.  ``long`` is read once; hinges and set come from
    the counted values."""
    counts = ranks.counted(long, key, value)
    spread = F.col("upper_hinge") - F.col("lower_hinge")
    bounds = _fivenum(counts, key, value, few_keys).select(
        key, (F.col("lower_hinge") - coef * spread).alias("lo"), (F.col("upper_hinge") + coef * spread).alias("hi"))
    return (counts.join(F.broadcast(bounds) if few_keys else bounds, key)
            .where((F.col(value) < F.col("lo")) | (F.col(value) > F.col("hi")))
            .select(key, value))


def exclude_values(df: DataFrame, col: str, values: DataFrame, key: str | None = None,
                   value: str = "value") -> DataFrame:
    """``!x %in% values``: drop rows whose value is in the set; nulls survive
    (an anti join never matches a null key)."""
    v = values.where(F.col("key") == (key or col)).select(F.col(value).alias("_v")) \
        if "key" in values.columns else values.select(F.col(value).alias("_v"))
    return df.join(v.distinct(), F.col(col).cast("double") == F.col("_v"), "left_anti")


def exclude_sets(df: DataFrame, sets: DataFrame, cols: list[str], broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """B15 for several columns in one pass: drop rows of which any of ``cols`` holds a value of its own set
    in ``sets`` (key = column name, value); nulls survive.

    The sets are written once and counted.  Up to ``broadcast_values`` values, each column's set is a hash
    table at every executor and the rows stay where they are: one stage, no exchange of ``df``.  Beyond, the
    tested values of a row leave as (row, column, value) and meet the sets in one join on column, value and a
    salt, so a value that a third of all rows hold is spread over ``SALTS`` tasks; the rows found are then
    dropped by their number.  Both ways give the same rows."""
    sets = materialize(sets.where(F.col("key").isin(list(cols)) & F.col("value").isNotNull()).select("key", "value").distinct())
    if sets.count() <= broadcast_values:
        for c in cols:
            own = sets.where(F.col("key") == c).select(F.col("value").alias("_v"))
            df = df.join(F.broadcast(own), F.col(c).cast("double") == F.col("_v"), "left_anti")
        return df
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    tested = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols]))
    tested = (rows.select("_row", tested.alias("t")).select("_row", "t.*").where(F.col("value").isNotNull())
              .withColumn("_salt", (F.col("_row") % SALTS).cast("int")))
    salted = sets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = tested.join(salted, ["key", "value", "_salt"], "left_semi").select("_row").distinct()
    return rows.join(found, "_row", "left_anti").drop("_row")


def hist_by_key(long: DataFrame, bins: int = 30, key: str = "key", value: str = "value") -> DataFrame:
    """ggplot's default 30 bins per key: width = range / (bins - 1),
    bins centred on multiples of the width, right-closed."""
    v = long.where(F.col(value).isNotNull())
    # per-key range by a (partially aggregated) grouped min/max - one row per key,
    # joined back - never a window holding every row of a column in one task
    widths = v.groupBy(key).agg(((F.max(value) - F.min(value)) / (bins - 1)).alias("_w"))
    v = v.join(widths, key)
    return v.groupBy(key, _bin(F.col(value), F.col("_w")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def _bin(v: Column, width: Column) -> Column:
    return F.when(width > 0, hist_bin(v, width)).otherwise(v)


def hist_columns(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """D17 of a wide table: (key, bin, count), equal to ``hist_by_key`` of its gathered columns.

    All ranges are one row of one aggregate, broadcast back; rows are binned wide and leave as
    (column, bin) pairs that are counted per task before the only exchange of any size."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    widths = wide.agg(*[((F.max(c) - F.min(c)) / (bins - 1)).alias(f"_w_{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), _bin(F.col(c), F.col(f"_w_{i}")).alias("bin")) for i, c in enumerate(cols)])
    binned = wide.crossJoin(F.broadcast(widths)).select(F.explode(pairs).alias("b")).select("b.*")
    return binned.where(F.col("bin").isNotNull()).groupBy("key", "bin").agg(F.count(F.lit(1)).alias("count"))


def keep_numeric(df: DataFrame, exclude: set[str] = frozenset()) -> DataFrame:
    """Numeric columns only (minus ``exclude``: codes the R side holds as factors)."""
    return df.select(*[f.name for f in df.schema.fields
                       if isinstance(f.dataType, NumericType) and f.name not in exclude])


def _summary(long: DataFrame) -> DataFrame:
    """(key, min, q1, median, mean, q3, max, nulls) of column values, all from one table of counted values."""
    counts = ranks.counted(long)
    probs, names = (0.25, 0.5, 0.75), ("q1", "median", "q3")
    at = {"min": lambda n: F.lit(1), "max": lambda n: n} | ranks.quantile_ranks(probs, names)
    v = ranks.values_at(counts, at, few_keys=True)
    v = v.select("key", "min", "max", *[ranks.quantile7(p, name).alias(name) for p, name in zip(probs, names)])
    base = counts.groupBy("key").agg(
        F.try_divide(F.sum(F.col("value") * F.col("cnt")), F.sum(F.when(F.col("value").isNotNull(), F.col("cnt")))).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).cast("long").alias("nulls"))
    return base.join(F.broadcast(v), "key", "left").select("key", "min", "q1", "median", "mean", "q3", "max", "nulls")


def profile_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per numeric column min, quartiles (type 7), median, mean, max, null count."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return _summary(gather(df, cols))


def profile_dates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D20 for date and time columns: the same numbers as times with a resolution of a second (a quartile or
    mean between two seconds is cut to the earlier one, as ``summary`` prints it)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))]
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = [F.timestamp_diff("SECOND", epoch, F.col(c).cast("timestamp_ntz")).cast("double").alias(c) for c in cols]
    out = _summary(gather(df.select(*seconds), cols))
    return out.select("key", *[F.timestamp_add("SECOND", F.floor(c).cast("long"), epoch).alias(c)
                               for c in ("min", "q1", "median", "mean", "q3", "max")], "nulls")


def profile_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """D20 for categoricals: count per (column, level), null level included."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "key", "level")
    return long.groupBy("key", "level").agg(F.count(F.lit(1)).alias("count"))


def missing_patterns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``md.pattern``: one row per observed/missing pattern ('1' observed,
    '0' missing, in column order) with its row count and missing-column count."""
    cols = cols or df.columns
    flags = [F.when(F.col(c).isNull(), "0").otherwise("1") for c in cols]
    pattern = F.concat(*flags) if flags else F.lit("")
    missing = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    return df.groupBy(pattern.alias("pattern"), missing.alias("missing_vars")).agg(
        F.count(F.lit(1)).alias("rows"))


def null_totals(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """D21 margin: nulls per column, one pass."""
    cols = cols or df.columns
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return agg.unpivot([], cols, "key", "nulls")


def _kde_params(v: DataFrame, bw: float | None, key: str, value: str) -> DataFrame:
    """(key, lo, hi, n, bw) of each key; ``v`` is read twice and has no null values.

    Bandwidth: Silverman's rule ``0.9 * min(sd, iqr/1.34) * n^-0.2`` (R ``bw.nrd0``; iqr from type-7 quartiles)."""
    stats = v.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                               F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    if bw is not None:
        return stats.select(key, "lo", "hi", "n", F.lit(float(bw)).alias("bw"))
    q = quantiles7(v, probs=(0.25, 0.75), key=key, value=value, names=("q1", "q3"))
    spread = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    spread = F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    return stats.join(q, key).select(key, "lo", "hi", "n", (0.9 * spread * F.pow(F.col("n"), -0.2)).alias("bw"))


def kde(long: DataFrame, n_points: int = 512, key: str = "key", value: str = "value",
        bw: float | None = None) -> DataFrame:
    """Gaussian kernel density on ``n_points`` points over each key's data range.

    Values are first reduced to distinct (value, count); each distinct value
    then contributes to the fixed grid through a generated index
    (``sequence``), and contributions are summed per grid point with partial
    aggregation - work is O(distinct values x grid) and spread over all tasks.
    ``kde_binned`` is for values with very many distinct ones."""
    v = materialize(long.where(F.col(value).isNotNull()).select(key, value))  # read three times
    counts = v.groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")
    pts = counts.join(_kde_params(v, bw, key, value), key).select(key, value, "cnt", "lo", "hi", "n", "bw", grid)
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n_points - 1)
    u = (x - F.col(value)) / F.col("bw")
    contrib = F.col("cnt") * F.exp(-0.5 * u * u)
    norm = 1.0 / (2.5066282746310002)  # 1 / sqrt(2 pi)
    sums = pts.groupBy(key, "i", "lo", "hi", "n", "bw").agg(F.sum(contrib).alias("_s"))
    return sums.select(key, "i", x.alias("x"),
                       (F.col("_s") * norm / (F.col("n") * F.col("bw"))).alias("density"))


#: Bandwidths after which ``kde_binned`` cuts the kernel: what lies beyond adds less than exp(-32) of its peak.
KDE_REACH = 8.0


def kde_binned(long: DataFrame, n_points: int = 512, key: str = "key", value: str = "value",
               bw: float | None = None) -> DataFrame:
    """L24 by linear binning: (key, i, x, density) as ``kde``, from a histogram on the grid.

    Every value's weight goes to the two grid points around it, by nearness, in one aggregate with partial sums
    of at most keys x grid rows; the weights then meet the kernel within KDE_REACH bandwidths.  The work is
    rows + grid x reach, whatever the number of distinct values.

    The density differs from the exact one by at most ``step**2 / (8 * sqrt(2 pi) * bw**3)`` (interpolating the
    kernel between grid points) and exp(-32) of a kernel's peak.  A key with one distinct value has all its
    points at that value, with the exact density.  Null values are left out; an empty table gives no rows."""
    v = materialize(long.where(F.col(value).isNotNull()).select(key, value))  # read four times
    params = _kde_params(v, bw, key, value).withColumn("step", (F.col("hi") - F.col("lo")) / (n_points - 1))
    params = materialize(params)  # a row per key
    at = F.coalesce(F.try_divide(F.col(value) - F.col("lo"), F.col("step")), F.lit(0.0))
    low = F.least(F.floor(at), F.lit(n_points - 2)).cast("int")
    parts = F.explode(F.array(F.struct(low.alias("j"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("j"), (at - low).alias("w"))))
    weights = v.join(params, key).select(key, parts.alias("p")).groupBy(key, F.col("p.j").alias("j")).agg(F.sum("p.w").alias("w"))
    reach = F.coalesce(F.least(F.ceil(F.try_divide(KDE_REACH * F.col("bw"), F.col("step"))), F.lit(n_points)), F.lit(n_points)).cast("int")
    near = F.sequence(F.greatest(F.col("j") - reach, F.lit(0)), F.least(F.col("j") + reach, F.lit(n_points - 1)))
    met = weights.where("w > 0").join(params, key).select(key, "j", "w", "lo", "step", "n", "bw", F.explode(near).alias("i"))
    u = (F.col("i") - F.col("j")) * F.col("step") / F.col("bw")
    sums = met.groupBy(key, "i").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("_s"))
    points = params.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    norm = 1.0 / (2.5066282746310002)  # 1 / sqrt(2 pi)
    return points.join(sums, [key, "i"], "left").select(
        key, "i", (F.col("lo") + F.col("step") * F.col("i")).alias("x"),
        (F.coalesce("_s", F.lit(0.0)) * norm / (F.col("n") * F.col("bw"))).alias("density"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """L20 check: Pearson correlation of every column pair (one aggregate pass)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    def corr(a, b):  # null for a constant column (ANSI division by zero otherwise fails)
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))

    agg = df.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = agg.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|").getItem(0).alias("col_a"),
                       F.split("pair", r"\|").getItem(1).alias("col_b"), "corr")
