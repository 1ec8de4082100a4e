"""Series as rows (series_id, t, y): differences, sums, autocorrelation, checks, splits. All native expressions.

Every function takes the name of the key column, so that a table may hold any number of series; windows are partitioned
by it. Positions t are dense integers; :func:`densify` makes them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, T, Y = "series_id", "t", "y"


def ordered():
    return Window.partitionBy(KEY).orderBy(T)


def whole():
    return Window.partitionBy(KEY)


def densify(df: DataFrame, fill: float | None = None) -> DataFrame:
    """Adds the missing positions between the first and last of each series; their y is fill."""
    grid = df.groupBy(KEY).agg(F.explode(F.sequence(F.min(T), F.max(T))).alias(T))
    full = grid.join(df, [KEY, T], "left")
    return full if fill is None else full.withColumn(Y, F.coalesce(Y, F.lit(fill)))


def pack(df: DataFrame, exog: list[str] | None = None) -> DataFrame:
    """(series_id, ys): each series as an array in order; with exog also xs, an array of regressors for each place."""
    x = [F.array(*(F.col(c).cast("double") for c in exog)).alias("x")] if exog else []
    rows = df.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(T, Y, *x))).alias("_rows"))
    return rows.select(KEY, F.transform("_rows", lambda r: r[Y]).alias("ys"), *([F.transform("_rows", lambda r: r["x"]).alias("xs")] if exog else []))


def diff(df: DataFrame, lag: int = 1, times: int = 1, column: str | list[str] = Y) -> DataFrame:
    """y (or each of several columns) less its value lag positions before, times over; the first lag * times rows go."""
    if lag < 1 or times < 1:
        raise ValueError("lag and times must be 1 or more")
    columns = [column] if isinstance(column, str) else column
    for _ in range(times):
        df = df.withColumns({c: F.col(c) - F.lag(c, lag).over(ordered()) for c in columns})
    return df.withColumn("_n", F.row_number().over(ordered())).filter(F.col("_n") > lag * times).drop("_n")


def inverse_diff(df: DataFrame, lag: int = 1, times: int = 1, start: float = 0.0, heads: DataFrame | None = None, column: str | list[str] = Y) -> DataFrame:
    """The series whose differences are y (or each of several columns); its first lag * times values are start, t counts from the first of them.

    heads (series_id, t and the columns) gives those values instead, at the lag * times places before each series.
    """
    columns = [column] if isinstance(column, str) else column
    for k in reversed(range(times)):
        if heads is None:
            head = df.groupBy(KEY).agg(F.min(T).alias("_t")).select(KEY, F.explode(F.sequence(F.col("_t") - lag, F.col("_t") - 1)).alias(T), *(F.lit(start).alias(c) for c in columns))
        else:  # what k differences leave of the heads, its last lag values
            known = diff(heads, lag, k, columns) if k else heads
            place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(T)))
            before = known.join(df.groupBy(KEY).agg(F.min(T).alias("_t")), KEY).filter(F.col(T) < F.col("_t"))
            head = before.withColumn("_n", place).filter(F.col("_n") <= lag).select(KEY, T, *columns)
        both = head.unionByName(df.select(KEY, T, *columns))
        along = Window.partitionBy(KEY, F.pmod(F.col(T), F.lit(lag))).orderBy(T)
        df = both.withColumns({c: F.sum(c).over(along) for c in columns})
    return df


def check(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series_id, n, bad, is_constant): values that are null, NaN or infinite in columns; whether y has one value."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(sum((bad(c).cast("long") for c in columns), F.lit(0))).alias("bad"), ((F.min(Y) == F.max(Y)) | (F.count(Y) <= 1)).alias("is_constant"))


def lag_products(df: DataFrame, lags: int, column: str = "e") -> DataFrame:
    """(series_id, n, c0, c1 ...): sums of column times itself k positions before, in one pass."""
    lagged = df.select(KEY, column, *(F.lag(column, k).over(ordered()).alias(f"_{k}") for k in range(1, lags + 1)))
    return lagged.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.col(column) ** 2).alias("c0"), *(F.coalesce(F.sum(F.col(column) * F.col(f"_{k}")), F.lit(0.0)).alias(f"c{k}") for k in range(1, lags + 1)))


def centred(df: DataFrame) -> DataFrame:
    return df.withColumn("e", F.col(Y) - F.avg(Y).over(whole()))


def acf(df: DataFrame, lags: int) -> DataFrame:
    """(series_id, lag, acf) for lags 0 to lags, all over the sum of squares."""
    sums = lag_products(centred(df), lags).filter((F.col("n") > lags) & (F.col("c0") > 0))
    return sums.select(KEY, F.posexplode(F.array(*(F.col(f"c{k}") / F.col("c0") for k in range(lags + 1)))).alias("lag", "acf"))


def pacf(df: DataFrame, lags: int) -> DataFrame:
    """(series_id, lag, pacf) by Levinson and Durbin's recursion over the array of autocorrelations."""
    r = acf(df, lags).groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"]).alias("r"))
    state = "struct<phi:array<double>,v:double,out:array<double>>"

    def step(s: Column, k: Column) -> Column:
        ks = F.sequence(F.lit(1), k - 1)
        dot = F.when(k > 1, F.aggregate(F.arrays_zip(s["phi"].alias("a"), F.transform(ks, lambda j: F.get(F.col("r"), k - j)).alias("b")), F.lit(0.0), lambda acc, x: acc + x["a"] * x["b"])).otherwise(0.0)
        a = F.when(F.abs(s["v"]) < 1e-12, 0.0).otherwise((F.get(F.col("r"), k) - dot) / s["v"])
        flipped = F.transform(F.arrays_zip(s["phi"].alias("a"), F.reverse(s["phi"]).alias("b")), lambda x: x["a"] - a * x["b"])
        return F.struct(F.concat(flipped, F.array(a)).alias("phi"), (s["v"] * (1 - a * a)).alias("v"), F.concat(s["out"], F.array(a)).alias("out")).cast(state)

    first = F.struct(F.array().cast("array<double>").alias("phi"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("out")).cast(state)
    return r.select(KEY, F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(lags)), first, step)["out"]).alias("lag", "pacf"))


def interpolation_grid(points: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, next_x, next_y): each x with one averaged y, and the next larger x and its y.

    x is cut into ranges at quantiles; each range is sorted by a task of its own, and the first point of the next range, of a table with a
    row for each range, follows its last.
    """
    grid = points.groupBy(F.col(x).alias("x")).agg(F.avg(y).alias("y"))
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(points.select(F.col(x).cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("x"))) if cuts else F.lit(0)
    ranges = grid.withColumn("_part", part)
    firsts = ranges.groupBy("_part").agg(F.min(F.struct("x", "y")).alias("_first"))
    firsts = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_after"))
    w = Window.partitionBy("_part").orderBy("x")
    after = F.coalesce(F.lead(F.struct("x", "y")).over(w), F.col("_after"))
    return ranges.join(F.broadcast(firsts), "_part").withColumn("_after", after).select("x", "y", F.col("_after.x").alias("next_x"), F.col("_after.y").alias("next_y"))


def interpolate(values: DataFrame, v: str, grid: list[tuple[float, float]], *, clip: bool = True, constant: bool = False) -> DataFrame:
    """Adds ``approx``: v read off a small literal grid, linearly or by its left neighbour; outside by its ends, or null."""
    xs: dict[float, list[float]] = {}
    for a, b in grid:
        xs.setdefault(float(a), []).append(float(b))
    points = [(a, sum(b) / len(b)) for a, b in sorted(xs.items())]
    return values.withColumn("approx", interpolated(F.col(v), points, clip=clip, constant=constant))


def interpolated(v: Column, points: list[tuple[float, float]], *, clip: bool = True, constant: bool = False) -> Column:
    (x0, y0), (xn, yn) = points[0], points[-1]
    out = F.when(v.isNull() | F.isnan(v), None).when(v < x0, y0 if clip else None).when(v > xn, yn if clip else None)
    for (a, ya), (b, yb) in zip(points, points[1:], strict=False):
        out = out.when(v < b, F.lit(ya) if constant else ya + (yb - ya) * (v - a) / (b - a))
    return out.otherwise(F.lit(yn))


def embed(df: DataFrame, k: int) -> DataFrame:
    """Row i holds y and its k - 1 predecessors: x0 (y itself) to x{k-1}; rows without all of them go."""
    rows = df.select(KEY, T, *(F.lag(Y, j).over(ordered()).alias(f"x{j}") for j in range(k)), F.row_number().over(ordered()).alias("_n"))
    return rows.filter(F.col("_n") >= k).drop("_n")


def train_test_split(df: DataFrame, *, test_size: int | None = None, fraction: float | None = None, train_size: int | None = None) -> DataFrame:
    """Adds ``role``: the last rows of each series are its test."""
    n, place = F.count("*").over(whole()), F.row_number().over(ordered())
    k = F.lit(test_size) if test_size else F.floor(n * F.lit(fraction)) if fraction else n - train_size if train_size else F.floor(n / 4)
    return df.withColumn("role", F.when(place > n - k, "test").otherwise("train"))


def rolling_folds(sizes: DataFrame, *, horizon: int = 1, step: int = 1, initial: int | None = None) -> DataFrame:
    """From (series_id, n): fold, train_lo, train_hi, test_lo, test_hi, half open; the training part grows."""
    first = F.lit(initial) if initial else F.greatest(F.lit(1), F.floor(F.col("n") / 3).cast("int"))
    last = F.col("n").cast("int") - horizon
    ends = sizes.filter(first <= last).select(KEY, F.posexplode(F.sequence(first, last, F.lit(step))).alias("fold", "train_hi"))
    return ends.select(KEY, "fold", F.lit(0).alias("train_lo"), "train_hi", F.col("train_hi").alias("test_lo"), (F.col("train_hi") + horizon).alias("test_hi"))


def sliding_folds(sizes: DataFrame, *, horizon: int = 1, step: int = 1, window: int | None = None) -> DataFrame:
    """As :func:`rolling_folds`, with a training part of constant length."""
    width = F.lit(window) if window else F.greatest(F.lit(3), F.floor(F.col("n") / 5).cast("int"))
    last = F.col("n").cast("int") - horizon - width
    starts = sizes.filter(last >= 0).select(KEY, width.alias("w"), F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("fold", "train_lo"))
    return starts.select(KEY, "fold", "train_lo", (F.col("train_lo") + F.col("w")).alias("train_hi"), (F.col("train_lo") + F.col("w")).alias("test_lo"), (F.col("train_lo") + F.col("w") + horizon).alias("test_hi"))


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """The rows of each fold with their role: an equi-join on the series and a range on t."""
    joined = df.join(folds, KEY).filter((F.col(T) >= F.col("train_lo")) & (F.col(T) < F.col("test_hi")))
    return joined.select(KEY, "fold", T, Y, F.when(F.col(T) < F.col("train_hi"), "train").otherwise("test").alias("role"))
