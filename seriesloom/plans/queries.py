"""One query for each operator over the driver's tables, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom import sources
from seriesloom.functions import stats
from seriesloom.operators import series

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

S = """s AS (SELECT o_orderpriority AS series_id, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, sum(o_totalprice) / 1234577.0 AS y FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1, 2)"""
E = """, e AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS e FROM s)"""
D = """s AS (SELECT event_type AS series_id, ts::DATE AS ds, datediff('day', DATE '2024-01-01', ts::DATE)::INT AS t, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2, 3)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that another order of summing makes no difference; no negative zero."""
    def cut(c: str, kind: str) -> Column:
        return (F.round(c, places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)

    return df.select(*(cut(c, kind) for c, kind in df.dtypes))


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def r(*exprs: str) -> str:
    """SQL for rounded columns: each is 'expression AS name'."""
    return ", ".join(f"round({x.rpartition(' AS ')[0]}, 6) + 0.0 AS {x.rpartition(' AS ')[2]}" for x in exprs)


@register("u1_diff", f"WITH {S}, a AS (SELECT series_id, t, y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS y FROM s) SELECT series_id, t, {r('y AS y')} FROM a WHERE y IS NOT NULL")
def u1(spark, d):
    return rounded(series.diff(sources.monthly_revenue(spark, d), 12))


@register("u1_diff_twice", f"WITH {S}, a AS (SELECT series_id, t, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS y FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, t, {r('y AS y')} FROM a WHERE y IS NOT NULL")
def u1b(spark, d):
    return rounded(series.diff(sources.monthly_revenue(spark, d), 1, 2))


@register("u3_inverse_diff", f"WITH {S}, a AS (SELECT series_id, t, sum(y) OVER (PARTITION BY series_id, t % 3 ORDER BY t) AS y FROM s UNION ALL SELECT series_id, h - 3 AS t, 0.0 AS y FROM (SELECT DISTINCT series_id FROM s), (VALUES (0), (1), (2)) v(h)) SELECT series_id, t::INT AS t, {r('y AS y')} FROM a")
def u3(spark, d):
    return rounded(series.inverse_diff(sources.monthly_revenue(spark, d), 3))


@register("u5_check", f"WITH {S} SELECT series_id, count(*)::BIGINT AS n, sum((y IS NULL OR isnan(y) OR isinf(y))::INT)::BIGINT AS bad, min(y) = max(y) AS is_constant FROM s GROUP BY 1")
def u5(spark, d):
    return series.check(sources.monthly_revenue(spark, d), ["y"])


@register("u7_pack_concat", f"WITH {S} SELECT series_id, (2 * count(*))::INT AS n, {r('2 * sum(y) AS total')} FROM s GROUP BY 1")
def u7(spark, d):
    both = series.pack(sources.monthly_revenue(spark, d)).withColumn("ys", F.concat("ys", "ys"))
    return rounded(both.select("series_id", F.size("ys").alias("n"), F.aggregate("ys", F.lit(0.0), lambda a, x: a + x).alias("total")))


@register("u8_sequence", "SELECT i::INT AS i FROM generate_series(3, 11) g(i)")
def u8(spark, d):
    return spark.range(1).select(F.explode(F.sequence(F.lit(3), F.lit(11))).alias("i"))


@register("u9_acf", f"WITH {S}{E}, k AS (SELECT unnest(generate_series(0, 12)) AS k), p AS (SELECT a.series_id, k.k AS lag, sum(a.e * b.e) AS c FROM e a CROSS JOIN k JOIN e b ON a.series_id = b.series_id AND b.t = a.t - k.k GROUP BY 1, 2), z AS (SELECT series_id, sum(e * e) AS c0 FROM e GROUP BY 1) SELECT series_id, lag::INT AS lag, {r('c / c0 AS acf')} FROM p JOIN z USING (series_id)")
def u9(spark, d):
    return rounded(series.acf(sources.monthly_revenue(spark, d), 12))


@register("u10_pacf", f"WITH {S}{E}, q AS (SELECT series_id, sum(e * e) AS c0, sum(e * e1) AS c1, sum(e * e2) AS c2 FROM (SELECT series_id, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY series_id ORDER BY t)) GROUP BY 1), a AS (SELECT series_id, c1 / c0 AS r1, c2 / c0 AS r2 FROM q) SELECT series_id, 0 AS lag, 1.0::DOUBLE AS pacf FROM a UNION ALL SELECT series_id, 1, {r('r1 AS pacf')} FROM a UNION ALL SELECT series_id, 2, {r('(r2 - r1 * r1) / (1 - r1 * r1) AS pacf')} FROM a")
def u10(spark, d):
    return rounded(series.pacf(sources.monthly_revenue(spark, d), 2))


GRID = [(0, 1), (10, 3), (10, 5), (40, 10), (78, 0)]


@register("i2_interpolate", f"WITH {S} SELECT series_id, t, {r('CASE WHEN t < 10 THEN 1 + 3.0 * t / 10 WHEN t < 40 THEN 4 + 6.0 * (t - 10) / 30 ELSE 10 - 10.0 * (t - 40) / 38 END AS approx')} FROM s")
def i2(spark, d):
    return rounded(series.interpolate(sources.monthly_revenue(spark, d).select("series_id", "t"), "t", [(a, b) for a, b in GRID]))


@register("i1_grid", "WITH g AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y FROM part GROUP BY 1) SELECT x, " + r("y AS y") + ", lead(x) OVER (ORDER BY x) AS next_x, " + r("lead(y) OVER (ORDER BY x) AS next_y") + " FROM g")
def i1(spark, d):
    return rounded(series.interpolation_grid(sources.table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_size", "p_retailprice"))


@register("t4_embed", f"WITH {S} SELECT * FROM (SELECT series_id, t, {r('y AS x0', 'lag(y, 1) OVER (PARTITION BY series_id ORDER BY t) AS x1', 'lag(y, 2) OVER (PARTITION BY series_id ORDER BY t) AS x2')} FROM s) WHERE x2 IS NOT NULL")
def t4(spark, d):
    return rounded(series.embed(sources.monthly_revenue(spark, d), 3))


def _kpss_sql(trend: bool) -> str:
    e = "y - avg(y) OVER p - regr_slope(y, t::DOUBLE) OVER p * (t - avg(t::DOUBLE) OVER p)" if trend else "y - avg(y) OVER p"
    c = stats.KPSS_TREND if trend else stats.KPSS_LEVEL
    steps = " ".join(f"WHEN stat < {b} THEN {pa} + ({pb} - {pa}) * (stat - {a}) / ({b} - {a})" for a, b, pa, pb in zip(c, c[1:], stats.KPSS_P, stats.KPSS_P[1:], strict=False))
    return f"""WITH {S}, e AS (SELECT series_id, t, {e} AS e FROM s WINDOW p AS (PARTITION BY series_id)),
    w AS (SELECT series_id, e, sum(e) OVER o AS c, lag(e, 1) OVER o AS e1, lag(e, 2) OVER o AS e2, lag(e, 3) OVER o AS e3 FROM e WINDOW o AS (PARTITION BY series_id ORDER BY t)),
    q AS (SELECT series_id, count(*)::BIGINT AS n, sum(c * c) / (count(*) * count(*)) / (sum(e * e) / count(*) + 2.0 / count(*) * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3))) AS stat FROM w GROUP BY 1),
    p AS (SELECT series_id, n, stat, CASE WHEN stat < {c[0]} THEN 0.1 {steps} ELSE 0.01 END AS p FROM q)
    SELECT series_id, n, {r('stat AS stat', 'p AS p')}, p < 0.05 AS diff FROM p"""


@register("t1_kpss_level", _kpss_sql(False))
def t1(spark, d):
    return rounded(stats.kpss(sources.monthly_revenue(spark, d)))


@register("t1_kpss_trend", _kpss_sql(True))
def t1b(spark, d):
    return rounded(stats.kpss(sources.monthly_revenue(spark, d), trend=True))


def _level_sql(y: str, name: str) -> str:
    """The KPSS statistic of y with two lags, as of 79 and 78 values."""
    return f"""{name}e AS (SELECT series_id, t, {y} - avg({y}) OVER (PARTITION BY series_id) AS e FROM l WHERE {y} IS NOT NULL), {name}w AS (SELECT series_id, e, sum(e) OVER o AS c, lag(e, 1) OVER o AS e1, lag(e, 2) OVER o AS e2 FROM {name}e WINDOW o AS (PARTITION BY series_id ORDER BY t)), {name} AS (SELECT series_id, sum(c * c) / (count(*) * count(*)) / (sum(e * e) / count(*) + 2.0 / count(*) * (2.0 / 3 * sum(e * e1) + 1.0 / 3 * sum(e * e2))) AS stat FROM {name}w GROUP BY 1)"""


@register("t16_n_diffs", f"WITH {S}, l AS (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS y1 FROM s), {_level_sql('y', 'a')}, {_level_sql('y1', 'b')} SELECT series_id, CASE WHEN a.stat <= 0.463 THEN 0 WHEN b.stat <= 0.463 THEN 1 ELSE 2 END AS d FROM a JOIN b USING (series_id)")
def t16(spark, d):
    return stats.n_diffs(sources.monthly_revenue(spark, d))


@register("d1_decompose_additive", f"WITH {S}, a AS (SELECT series_id, t, y, CASE WHEN count(y) OVER w = 12 THEN avg(y) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)), b AS (SELECT *, avg(y - trend) OVER (PARTITION BY series_id, t % 12) AS seasonal FROM a) SELECT series_id, t, {r('y AS y', 'trend AS trend', 'seasonal AS seasonal', 'y - trend - seasonal AS random')} FROM b")
def d1(spark, d):
    return rounded(stats.decompose(sources.monthly_revenue(spark, d), 12))


@register("d1_decompose_multiplicative", f"WITH {S}, a AS (SELECT series_id, t, y, CASE WHEN count(y) OVER w = 12 THEN avg(y) OVER w END AS trend FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)), b AS (SELECT *, avg(y / trend) OVER (PARTITION BY series_id, t % 12) AS seasonal FROM a) SELECT series_id, t, {r('y AS y', 'trend AS trend', 'seasonal AS seasonal', 'y / trend / seasonal AS random')} FROM b")
def d1b(spark, d):
    return rounded(stats.decompose(sources.monthly_revenue(spark, d), 12, multiplicative=True))


@register("g1_g2_portmanteau", f"WITH {S}{E}, k AS (SELECT unnest(generate_series(1, 4)) AS k), p AS (SELECT a.series_id, k.k, sum(a.e * b.e) AS c FROM e a CROSS JOIN k JOIN e b ON a.series_id = b.series_id AND b.t = a.t - k.k GROUP BY 1, 2), z AS (SELECT series_id, sum(e * e) AS c0, count(*)::BIGINT AS n FROM e GROUP BY 1), q AS (SELECT series_id, n, n * (n + 2) * sum((c / c0) ** 2 / (n - k)) AS lb, n * sum((c / c0) ** 2) AS bp FROM p JOIN z USING (series_id) GROUP BY 1, 2) SELECT series_id, n, {r('lb AS ljung_box', 'bp AS box_pierce')}, 4 AS df, {r('exp(-lb / 2) * (1 + lb / 2) AS ljung_box_p', 'exp(-bp / 2) * (1 + bp / 2) AS box_pierce_p')} FROM q")
def g1(spark, d):
    return rounded(stats.portmanteau(sources.monthly_revenue(spark, d), 4))


@register("g4_jarque_bera", f"WITH {S}{E}, m AS (SELECT series_id, count(*)::BIGINT AS n, avg(e ** 2) AS m2, avg(e ** 3) AS m3, avg(e ** 4) AS m4 FROM e GROUP BY 1), q AS (SELECT series_id, n, m3 / m2 ** 1.5 AS sk, m4 / (m2 * m2) AS ku FROM m), j AS (SELECT *, n / 6.0 * (sk * sk + (ku - 3) ** 2 / 4) AS jb FROM q) SELECT series_id, n, {r('sk AS skewness', 'ku AS kurtosis', 'jb AS jb', 'exp(-jb / 2) AS p')} FROM j")
def g4(spark, d):
    return rounded(stats.jarque_bera(sources.monthly_revenue(spark, d)))


@register("g5_arch_lm", f"WITH {S}, q AS (SELECT series_id, y * y AS a, lag(y * y) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s) SELECT series_id, {r('count(*) * regr_r2(a, b) AS lm')} FROM q WHERE b IS NOT NULL GROUP BY 1")
def g5(spark, d):
    return rounded(stats.arch_lm(sources.monthly_revenue(spark, d)).drop("p"))


@register("m1_train_test_split", f"WITH {S} SELECT series_id, t, {r('y AS y')}, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY t) > count(*) OVER (PARTITION BY series_id) - 12 THEN 'test' ELSE 'train' END AS role FROM s")
def m1(spark, d):
    return rounded(series.train_test_split(sources.monthly_revenue(spark, d), test_size=12))


def _sizes(spark, d):
    return sources.monthly_revenue(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))


@register("m2_rolling_folds", f"WITH {S}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT series_id, unnest(generate_series(greatest(1, n // 3), n - 4, 6)) AS hi FROM n) SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY hi) - 1)::INT AS fold, 0 AS train_lo, hi::INT AS train_hi, hi::INT AS test_lo, (hi + 4)::INT AS test_hi FROM f")
def m2(spark, d):
    return series.rolling_folds(_sizes(spark, d), horizon=4, step=6)


@register("m3_sliding_folds", f"WITH {S}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT series_id, unnest(generate_series(0, n - 6 - 24, 4)) AS lo FROM n) SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY lo) - 1)::INT AS fold, lo::INT AS train_lo, (lo + 24)::INT AS train_hi, (lo + 24)::INT AS test_lo, (lo + 30)::INT AS test_hi FROM f")
def m3(spark, d):
    return series.sliding_folds(_sizes(spark, d), horizon=6, step=4, window=24)


NAIVE = f"""WITH {S}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT series_id, unnest(generate_series(24, n - 6, 6)) AS hi FROM n), fr AS (SELECT f.series_id, f.hi, s.t, s.y, l.y AS p FROM f JOIN s ON s.series_id = f.series_id AND s.t >= hi AND s.t < hi + 6 JOIN s l ON l.series_id = f.series_id AND l.t = s.t - 12), sc AS (SELECT series_id, hi, avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 200 * abs(p - y) / (abs(y) + abs(p)) END) AS smape, avg(abs(p - y)) AS mae, avg((p - y) ** 2) AS mse FROM fr GROUP BY 1, 2)"""


def _fold_scores(spark, d):
    s = sources.monthly_revenue(spark, d)
    rows = series.fold_rows(s, series.rolling_folds(_sizes(spark, d), horizon=6, step=6, initial=24)).filter("role = 'test'")
    before = s.select("series_id", (F.col("t") + 12).alias("t"), F.col("y").alias("y_pred"))
    return stats.errors(rows.join(before, ["series_id", "t"]).withColumnRenamed("y", "y_true"), "series_id", "fold")


@register("m4_cv_scores_naive", f"{NAIVE} SELECT series_id, (row_number() OVER (PARTITION BY series_id ORDER BY hi) - 1)::INT AS fold, {r('smape AS smape', 'mae AS mae', 'mse AS mse', 'sqrt(mse) AS rmse')} FROM sc")
def m4(spark, d):
    return rounded(_fold_scores(spark, d))


@register("m5_cv_summary", f"{NAIVE} SELECT series_id, {r('avg(smape) AS mean', 'coalesce(stddev_samp(smape), 0) AS std')} FROM sc GROUP BY 1")
def m5(spark, d):
    return rounded(stats.cv_summary(_fold_scores(spark, d)))


@register("m6_out_of_fold", f"WITH {S}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT series_id, unnest(generate_series(24, n - 6, 3)) AS hi FROM n), c AS (SELECT DISTINCT f.series_id, g.i AS t FROM f, LATERAL (SELECT unnest(generate_series(hi, hi + 5)) AS i) g) SELECT s.series_id, s.t, {r('CASE WHEN c.t IS NOT NULL THEN l.y END AS pred')} FROM s LEFT JOIN c ON c.series_id = s.series_id AND c.t = s.t LEFT JOIN s l ON l.series_id = s.series_id AND l.t = s.t - 12")
def m6(spark, d):
    s = sources.monthly_revenue(spark, d)
    rows = series.fold_rows(s, series.rolling_folds(_sizes(spark, d), horizon=6, step=3, initial=24)).filter("role = 'test'")
    before = s.select("series_id", (F.col("t") + 12).alias("t"), F.col("y").alias("p"))
    return rounded(stats.out_of_fold(s, rows.join(before, ["series_id", "t"]).withColumnRenamed("p", "pred")))


@register("metrics_snaive", f"WITH {S}, n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, lag(y, 12) OVER (PARTITION BY series_id ORDER BY t) AS p FROM s), h AS (SELECT * FROM n WHERE t >= n - 12), sc AS (SELECT series_id, avg(abs(y - p)) AS scale FROM n WHERE t < n - 12 GROUP BY 1), m AS (SELECT series_id, avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 200 * abs(p - y) / (abs(y) + abs(p)) END) AS smape, avg(abs(p - y)) AS mae, avg((p - y) ** 2) AS mse FROM h GROUP BY 1) SELECT series_id, {r('smape AS smape', 'mae AS mae', 'mse AS mse', 'sqrt(mse) AS rmse', 'mae / scale AS mase')} FROM m JOIN sc USING (series_id)")
def snaive(spark, d):
    s = sources.monthly_revenue(spark, d)
    train = series.train_test_split(s, test_size=12).filter("role = 'train'")
    scores = stats.errors(stats.seasonal_naive(s, 12, 12), "series_id").join(stats.mase_scale(train, 12), "series_id")
    return rounded(scores.withColumn("mase", F.col("mae") / F.col("scale")).drop("scale"))


@register("p1_box_cox", f"WITH {S} SELECT series_id, t, {r('(pow(y + 1, 0.3) - 1) / 0.3 AS z', 'y AS back')} FROM s")
def p1(spark, d):
    z = sources.monthly_revenue(spark, d).select("series_id", "t", stats.box_cox(F.col("y"), 0.3, 1.0).alias("z"))
    return rounded(z.withColumn("back", stats.inverse_box_cox(F.col("z"), 0.3, 1.0)))


@register("p2_log", f"WITH {S} SELECT series_id, t, {r('ln(y + 1) AS z')} FROM s")
def p2(spark, d):
    return rounded(sources.monthly_revenue(spark, d).select("series_id", "t", stats.box_cox(F.col("y"), 0.0, 1.0).alias("z")))


@register("p3_fourier", f"WITH {S} SELECT series_id, t, {r('sin(2 * pi() * (t + 1) / 12) AS sin_1', 'cos(2 * pi() * (t + 1) / 12) AS cos_1', 'sin(4 * pi() * (t + 1) / 12) AS sin_2', 'cos(4 * pi() * (t + 1) / 12) AS cos_2')} FROM s")
def p3(spark, d):
    return rounded(stats.fourier(sources.monthly_revenue(spark, d).drop("y"), 12, 2))


@register("p4_date_features", f"WITH {D} SELECT series_id, ds::VARCHAR AS ds, t, y, " + ", ".join(f"(isodow(ds) = {i + 1})::INT AS {n}" for i, n in enumerate("mon tue wed thu fri sat sun".split())) + ", day(ds)::INT AS day FROM s")
def p4(spark, d):
    return stats.date_features(sources.daily_events(spark, d)).select("series_id", F.col("ds").cast("string").alias("ds"), "t", "y", "mon", "tue", "wed", "thu", "fri", "sat", "sun", "day")


@register("p5_future_dates", f"WITH {D}, l AS (SELECT series_id, max(ds) AS ds FROM s GROUP BY 1) SELECT series_id, h::INT AS h, (ds + to_months(h::INT))::DATE::VARCHAR AS ds FROM l, generate_series(1, 6) g(h)")
def p5(spark, d):
    last = sources.daily_events(spark, d).groupBy("series_id").agg(F.max("ds").alias("ds"))
    return stats.future_dates(last, 6, "month").withColumn("ds", F.col("ds").cast("date").cast("string"))


@register("f5_information_criteria", f"WITH {S}, m AS (SELECT series_id, count(*)::BIGINT AS n, -count(*) / 2.0 * (ln(2 * pi() * var_pop(y)) + 1) AS log_l, 2 AS k FROM s GROUP BY 1) SELECT series_id, n, {r('log_l AS log_l')}, k, {r('-2 * log_l + 4 AS aic', '-2 * log_l + 4 + 12.0 / (n - 3) AS aicc', '-2 * log_l + 2 * ln(n) AS bic', '-2 * log_l + 4 * ln(ln(n)) AS hqic')} FROM m")
def f5(spark, d):
    m = sources.monthly_revenue(spark, d).groupBy("series_id").agg(F.count("*").alias("n"), (-F.count("*") / 2.0 * (F.ln(2 * F.pi() * F.var_pop("y")) + 1)).alias("log_l"), F.lit(2).alias("k"))
    return rounded(stats.information_criteria(m))


@register("f7_random_walk", f"WITH {S}, w AS (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d FROM s), l AS (SELECT series_id, arg_max(y, t) AS last, avg(d * d) AS v FROM w GROUP BY 1) SELECT series_id, h::INT AS h, {r('last AS forecast', 'last - 1.959963984540054 * sqrt(v * h) AS lower', 'last + 1.959963984540054 * sqrt(v * h) AS upper')} FROM l, generate_series(1, 12) g(h)")
def f7(spark, d):
    return rounded(stats.random_walk_forecast(sources.monthly_revenue(spark, d), 12))


@register("f8_psi_weights", "WITH RECURSIVE a(h, w, v) AS (SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT h + 1, 0.5 * w + 0.2 * v + CASE WHEN h = 0 THEN 0.3 ELSE 0 END, w FROM a WHERE h < 11) SELECT h, " + r("sum(w) OVER (ORDER BY h) AS psi") + " FROM a")
def f8(spark, d):
    psi = stats.psi_weights([0.5, 0.2], [0.3], 12, d=1)
    return rounded(spark.createDataFrame(list(enumerate(psi)), "h int, psi double"))


@register("k2_css_residuals", f"WITH RECURSIVE {S}, a(series_id, t, y, e) AS (SELECT series_id, t, y, 0.0::DOUBLE FROM s WHERE t = 0 UNION ALL SELECT s.series_id, s.t, s.y, s.y - 0.6 * a.y - 0.3 * a.e FROM a JOIN s ON s.series_id = a.series_id AND s.t = a.t + 1) SELECT series_id, t, {r('e AS e')} FROM a")
def k2(spark, d):
    return rounded(stats.css_residuals(sources.monthly_revenue(spark, d), [0.6], [0.3]))


@register("a7_candidate_grid", "SELECT p::INT AS p, q::INT AS q, sp::INT AS sp, sq::INT AS sq FROM generate_series(0, 5) a(p), generate_series(0, 5) b(q), generate_series(0, 2) c(sp), generate_series(0, 2) d(sq) WHERE p + q + sp + sq <= 5")
def a7(spark, d):
    return stats.candidate_grid(spark, 5, 5, 2, 2, 5)


for _kind, _sql in (("AO", "CASE WHEN t = 30 THEN 1.0 ELSE 0.0 END"), ("LS", "CASE WHEN t >= 30 THEN 1.0 ELSE 0.0 END"), ("TC", "CASE WHEN t >= 30 THEN pow(0.7, t - 30) ELSE 0.0 END")):
    register(f"o2_outlier_{_kind.lower()}", f"WITH {S} SELECT series_id, t, {r(f'({_sql})::DOUBLE AS x')} FROM s")(lambda spark, d, k=_kind: rounded(stats.outlier_regressor(sources.monthly_revenue(spark, d).drop("y"), k, 30)))


@register("b3_path_summary", "WITH p AS (SELECT l_returnflag AS series_id, l_linenumber AS h, l_extendedprice / 1e4 AS value FROM lineitem) SELECT series_id, h, " + r("avg(value) AS mean", "var_samp(value) AS variance", "quantile_cont(value, 0.025) AS lower", "quantile_cont(value, 0.975) AS upper") + " FROM p GROUP BY 1, 2")
def b3(spark, d):
    paths = sources.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series_id"), F.col("l_linenumber").alias("h"), (F.col("l_extendedprice") / 1e4).alias("value"))
    return rounded(stats.path_summary(paths))


@register("s14_check_shape", f"WITH {S} SELECT series_id, count(y)::BIGINT AS n, {r('min(y) AS low', 'max(y) AS high')}, count(y) = 79 AND min(y) >= 0 AND max(y) <= 1000000 AS fits FROM s GROUP BY 1")
def s14(spark, d):
    return rounded(sources.check_shape(sources.monthly_revenue(spark, d), 79, 0, 1e6))


@register("f2_fit_arima")
def f2(spark, d):
    from seriesloom.plans import models

    return models.fit(sources.monthly_revenue(spark, d), (1, 0, 1)).drop("phi", "theta", "beta")


@register("f7_forecast_airline")
def f7b(spark, d):
    from seriesloom.plans import models

    return models.forecast(sources.monthly_revenue(spark, d), (0, 1, 1), (0, 1, 1, 12))


@register("a1_auto_arima_panel")
def a1(spark, d):
    from seriesloom.plans import models

    return models.search(sources.monthly_revenue(spark, d), most_p=2, most_q=2).drop("phi", "theta", "beta")


@register("p1_box_cox_lambda", f"WITH {S}, g AS (SELECT series_id, k, CASE WHEN k = 0 THEN ln(y) ELSE (pow(y, k / 100.0) - 1) / (k / 100.0) END AS z, ln(y) AS l FROM s, generate_series(-200, 200) a(k) WHERE y > 0), f AS (SELECT series_id, k, -count(*) / 2.0 * ln(var_pop(z)) + (k / 100.0 - 1) * sum(l) AS value FROM g GROUP BY 1, 2) SELECT series_id, arg_max(k, value) / 100.0 AS lam FROM f GROUP BY 1")
def p1b(spark, d):
    return stats.box_cox_lambda(sources.monthly_revenue(spark, d))


@register("t2_adf")
def t2(spark, d):
    from seriesloom.plans import models

    return models.adf(sources.monthly_revenue(spark, d))


@register("t3_phillips_perron")
def t3(spark, d):
    from seriesloom.plans import models

    return models.pp(sources.monthly_revenue(spark, d))


@register("t10_t11_seasonal_strength")
def t10(spark, d):
    from seriesloom.plans import models

    return models.seasonal_strength(sources.monthly_revenue(spark, d), 12)


@register("b2_b3_bootstrap_forecast")
def b2(spark, d):
    from seriesloom.plans import models

    return stats.path_summary(models.bootstrap(sources.monthly_revenue(spark, d), (1, 0, 0), h=6, n=500))


@register("m4_cv_scores_arima")
def m4b(spark, d):
    from seriesloom.plans import models

    s = sources.monthly_revenue(spark, d)
    return models.cross_validate(s, series.rolling_folds(_sizes(spark, d), horizon=6, step=12, initial=36), (1, 0, 0), horizon=6)


def _model(name: str, sql: str | None = None):
    """Registers f(models, monthly revenue) by name."""

    def put(f):
        def query(spark, d):
            from seriesloom.plans import models

            return f(models, sources.monthly_revenue(spark, d))

        register(name, sql)(query)
        return f

    return put


_model("t3_phillips_perron_alpha")(lambda m, s: m.pp(s, coefficient=True))
_model("t7_t8_canova_hansen")(lambda m, s: m.canova_hansen(s, 12))
_model("t9_ocsb")(lambda m, s: m.ocsb(s, 12))
_model("t12_t15_hegy")(lambda m, s: m.hegy(s, 12))
_model("t17_n_seasonal_diffs")(lambda m, s: m.n_seasonal_diffs(s, 12))
_model("t18_find_period")(lambda m, s: m.find_period(s))
_model("f2_fit_with_regressors")(lambda m, s: m.fit(stats.fourier(s, 12, 1), (1, 0, 0), exog=["sin_1", "cos_1"]).drop("phi", "theta", "beta"))
_model("f6_fitted_values")(lambda m, s: m.residuals(s, (1, 0, 1)))
_model("f10_update")(lambda m, s: m.update(s.filter("t < 67"), s.filter("t >= 67"), (1, 0, 0)).drop("phi", "theta", "beta"))
_model("a1_a6_stepwise_seasonal")(lambda m, s: m.auto_arima(s, m.auto.Options(m=12, most_p=2, most_q=2, most_sp=1, most_sq=1)).drop("phi", "theta", "beta"))
_model("a8_approximate_search")(lambda m, s: m.search_trace(s, m.auto.Options(most_p=3, most_q=3, approximate=True)))
_model("a9_holdout_search")(lambda m, s: m.search_trace(s, m.auto.Options(most_p=2, most_q=2, holdout=12)))
_model("b1_simulate")(lambda m, s: m.simulate(s, (1, 0, 0), n=60, draws=20))
_model("b4_b5_parameter_bootstrap")(lambda m, s: m.parameter_bootstrap(s, (1, 0, 0), draws=100))
_model("g6_roots")(lambda m, s: m.characteristic_roots(m.fit(s, (2, 0, 1))))
_model("g7_summary")(lambda m, s: m.summary(s, (1, 0, 1)))
_model("o1_outliers")(lambda m, s: m.outliers(s, kinds=("AO", "LS", "TC", "IO")))
_model("f2_fit_diffuse")(lambda m, s: m.fit(s, (1, 0, 1), method="diffuse").drop("phi", "theta", "beta"))
_model("k7_k8_diffuse_likelihood")(lambda m, s: m.diffuse_likelihood(s, (1, 1, 1)))


@register("p6_p7_pipeline")
def p6(spark, d):
    from seriesloom.plans.pipeline import Fourier, Log, Pipeline

    chain = Pipeline((("log", Log()), ("waves", Fourier(12, 2))), (1, 0, 0), unit="month")
    return chain.fit(sources.monthly_revenue(spark, d)).predict(12)


@register("p5_p8_dated_pipeline")
def p8(spark, d):
    from seriesloom.plans.pipeline import BoxCox, Dates, Pipeline

    s = sources.daily_events(spark, d).select("series_id", "t", "y", F.col("ds").cast("timestamp_ntz").alias("ds"))
    cut = 20
    return Pipeline((("power", BoxCox(shift=1.0)), ("dates", Dates())), (1, 0, 0)).fit(s.filter(f"t < {cut}")).update(s.filter(f"t >= {cut}")).predict(7)


@register("u2_diff_matrix", f"WITH {S} SELECT series_id, t, {r('y AS y', 'x AS x')} FROM (SELECT series_id, t, y - lag(y) OVER w AS y, y * t - lag(y * t) OVER w AS x FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)) WHERE y IS NOT NULL")
def u2(spark, d):
    return rounded(series.diff(sources.monthly_revenue(spark, d).withColumn("x", F.col("y") * F.col("t")), 1, 1, ["y", "x"]))


@register("u3_inverse_diff_heads", f"WITH {S} SELECT series_id, t, {r('y AS y')} FROM s WHERE t >= 12")
def u3b(spark, d):
    s = sources.monthly_revenue(spark, d)
    return rounded(series.inverse_diff(series.diff(s, 12, 2), 12, 2, heads=s.filter("t < 24")).filter("t >= 12").select("series_id", "t", "y"))


_model("k3_exact_ar1", f"WITH {S}, l AS (SELECT series_id, t, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s), q AS (SELECT series_id, count(*) AS n, sum(CASE WHEN b IS NULL THEN 0.75 * y * y ELSE (y - 0.5 * b) ** 2 END) / count(*) AS v FROM l GROUP BY 1) SELECT series_id, {r('-0.5 * (n * (ln(2 * pi() * v) + 1) - ln(0.75)) AS log_l', 'v AS sigma2')} FROM q")(lambda m, s: rounded(m.exact_likelihood(s, [0.5], [])))
_model("t2_adf_no_lags", f"WITH {S}, l AS (SELECT series_id, y - lag(y) OVER w AS d, lag(y) OVER w AS b FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), q AS (SELECT series_id, regr_slope(d, b) AS c, sqrt((regr_syy(d, b) - regr_slope(d, b) * regr_sxy(d, b)) / (regr_count(d, b) - 2) / regr_sxx(d, b)) AS e FROM l GROUP BY 1) SELECT series_id, {r('c / e AS stat')} FROM q")(lambda m, s: rounded(m.adf(s, lags=0).select("series_id", "stat")))
_model("t3_pp_stat", f"""WITH {S}, l AS (SELECT series_id, t, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS b FROM s), g AS (SELECT series_id, regr_slope(y, b) AS c, regr_intercept(y, b) AS a, regr_sxx(y, b) AS x, regr_count(y, b) AS n FROM l GROUP BY 1), u AS (SELECT series_id, t, c, x, n, y - a - c * b AS e FROM l JOIN g USING (series_id) WHERE b IS NOT NULL), v AS (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM u WINDOW w AS (PARTITION BY series_id ORDER BY t)), q AS (SELECT series_id, c, x, n, sum(e * e) / n AS i, sum(e * e) / n + 2.0 / n * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3)) AS o FROM v GROUP BY 1, 2, 3, 4), z AS (SELECT *, sqrt(i * n / (n - 2) / x) AS se FROM q) SELECT series_id, {r('sqrt(i / o) * (c - 1) / se - 0.5 * (o - i) * sqrt(n) * se / sqrt(o * i) AS stat')} FROM z""")(lambda m, s: rounded(m.pp(s).select("series_id", "stat")))
_model("g5_arch_lm_many", f"WITH {S}, q AS (SELECT series_id, y * y AS a, lag(y * y) OVER w AS b, lag(y * y, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), k AS (SELECT series_id, count(*) AS n, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM q WHERE c IS NOT NULL GROUP BY 1), l AS (SELECT series_id, n * (ab * ab + ac * ac - 2 * ab * ac * bc) / (1 - bc * bc) AS lm FROM k) SELECT series_id, {r('lm AS lm', 'exp(-lm / 2) AS p')} FROM l")(lambda m, s: rounded(m.arch_lm(s, 2)))
_model("d2_stl")(lambda m, s: m.stl(s, 12))
_model("d2_stl_rebuilt", f"WITH {S} SELECT series_id, t, {r('y AS y')} FROM s")(lambda m, s: rounded(m.stl(s, 12).select("series_id", "t", (F.col("trend") + F.col("seasonal") + F.col("remainder")).alias("y"))))


# Models whose results have a closed form: what runs is the same kernel, plan and shuffle as for any other order.
WALK = f"WITH {S}, g AS (SELECT series_id, t, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY t) AS d FROM s), w AS (SELECT series_id, max_by(y, t) AS last, avg(d * d) AS v, avg(d) AS drift, var_pop(d) AS dv, count(d) AS n FROM g GROUP BY 1)"
WALK_FIT = WALK + ", l AS (SELECT *, -0.5 * n * (ln(2 * pi() * v) + 1) AS ll FROM w) SELECT series_id, n::INT AS nobs, " + r("v AS sigma2", "ll AS log_l", "2 - 2 * ll AS aic", "2 - 2 * ll + 4.0 / (n - 2) AS aicc", "ln(n) - 2 * ll AS bic") + " FROM l"
_FIT = ("series_id", "nobs", "sigma2", "log_l", "aic", "aicc", "bic")
_model("f2_fit_random_walk", WALK_FIT)(lambda m, s: rounded(m.fit(s, (0, 1, 0)).select(*_FIT)))
_model("f10_update_random_walk", WALK_FIT)(lambda m, s: rounded(m.update(s.filter("t < 67"), s.filter("t >= 67"), (0, 1, 0)).select(*_FIT)))
_model("f6_fitted_random_walk", WALK + f" SELECT series_id, t, {r('y - d AS fitted', 'd AS resid')} FROM g WHERE d IS NOT NULL")(lambda m, s: rounded(m.residuals(s, (0, 1, 0))))
_model("f7_forecast_level_and_error", WALK + f" SELECT series_id, h::INT AS h, {r('last AS forecast', 'last - 1.2815515655446008 * sqrt(v * h) AS lower', 'last + 1.2815515655446008 * sqrt(v * h) AS upper', 'sqrt(v * h) AS std_error')} FROM w, generate_series(1, 6) x(h)")(lambda m, s: rounded(m.forecast(s, (0, 1, 0), h=6, level=0.8, std_error=True)))
_model("f4_drift_fit", WALK + " SELECT series_id, round(drift, 4) + 0.0 AS mean, round(dv, 4) + 0.0 AS sigma2 FROM w")(lambda m, s: rounded(m.fit(s, (0, 1, 0), drift=True).select("series_id", "mean", "sigma2"), 4))
_model("f13_drift_forecast", WALK + " SELECT series_id, h::INT AS h, round(last + h * drift, 4) + 0.0 AS forecast FROM w, generate_series(1, 6) x(h)")(lambda m, s: rounded(m.forecast(s, (0, 1, 0), h=6, drift=True).select("series_id", "h", "forecast"), 4))
_model("p1_box_cox_forecast", f"WITH {S}, g AS (SELECT series_id, t, y, 2 * (sqrt(y) - 1) AS z FROM s), k AS (SELECT *, z - lag(z) OVER (PARTITION BY series_id ORDER BY t) AS d FROM g), w AS (SELECT series_id, max_by(z, t) AS z, avg(d * d) AS v FROM k GROUP BY 1) SELECT series_id, h::INT AS h, {r('(z / 2 + 1) ** 2 AS forecast', '((z + 1.959963984540054 * sqrt(v * h)) / 2 + 1) ** 2 AS upper')} FROM w, generate_series(1, 6) x(h)")(lambda m, s: rounded(m.forecast(s, (0, 1, 0), h=6, power=0.5).select("series_id", "h", "forecast", "upper")))
_model("m4_cv_scores_seasonal_walk", ORACLES["m4_cv_scores_naive"])(lambda m, s: rounded(m.cross_validate(s, series.rolling_folds(s.groupBy("series_id").agg(F.count("*").alias("n")), horizon=6, step=6, initial=24), (0, 0, 0), (0, 1, 0, 12), horizon=6)))
_model("k7_diffuse_random_walk", WALK + ", l AS (SELECT *, -0.5 * n * (ln(2 * pi() * v) + 1) AS ll FROM w) SELECT series_id, " + r("ll AS log_l", "ll AS diffuse") + " FROM l")(lambda m, s: rounded(m.diffuse_likelihood(s, (0, 1, 0)).select("series_id", "log_l", "diffuse")))
_model("k3_exact_ma1", f"WITH RECURSIVE {S}, a(series_id, t, e, v) AS (SELECT series_id, t, y, 1.16::DOUBLE FROM s WHERE t = 0 UNION ALL SELECT s.series_id, s.t, s.y - 0.4 * a.e / a.v, 1.16 - 0.16 / a.v FROM a JOIN s ON s.series_id = a.series_id AND s.t = a.t + 1), q AS (SELECT series_id, count(*) AS n, avg(e * e / v) AS s2, sum(ln(v)) AS lv FROM a GROUP BY 1) SELECT series_id, {r('-0.5 * n * (ln(2 * pi() * s2) + 1) - 0.5 * lv AS log_l', 's2 AS sigma2')} FROM q")(lambda m, s: rounded(m.exact_likelihood(s, [], [0.4])))
_model("t2_adf_one_lag", f"WITH {S}, g AS (SELECT series_id, t, y - lag(y) OVER w AS d, lag(y) OVER w AS b, lag(y) OVER w - lag(y, 2) OVER w AS x FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), f AS (SELECT * FROM g WHERE x IS NOT NULL), c AS (SELECT series_id, regr_slope(d, x) AS c1, regr_intercept(d, x) AS i1, regr_slope(b, x) AS c2, regr_intercept(b, x) AS i2 FROM f GROUP BY 1), p AS (SELECT series_id, d - i1 - c1 * x AS rd, b - i2 - c2 * x AS rb FROM f JOIN c USING (series_id)), k AS (SELECT series_id, sum(rd * rb) / sum(rb * rb) AS beta, sum(rb * rb) AS bb, count(*) AS n FROM p GROUP BY 1), e AS (SELECT p.series_id, sum((rd - beta * rb) ** 2) / (any_value(n) - 3) AS s2 FROM p JOIN k USING (series_id) GROUP BY 1) SELECT series_id, {r('beta / sqrt(s2 / bb) AS stat')} FROM k JOIN e USING (series_id)")(lambda m, s: rounded(m.adf(s, lags=1).select("series_id", "stat")))
_model("t1_kpss_thirty_lags", f"WITH {S}{E}, c AS (SELECT a.series_id, k, sum(a.e * b.e) AS c FROM e a, generate_series(1, 30) x(k), e b WHERE b.series_id = a.series_id AND b.t = a.t - k GROUP BY 1, 2), n AS (SELECT series_id, count(*) AS n, sum(e * e) AS c0 FROM e GROUP BY 1), v AS (SELECT series_id, any_value(c0) / any_value(n) + sum(2.0 / n * (1 - k / 31.0) * c) AS v FROM n JOIN c USING (series_id) GROUP BY 1), p AS (SELECT series_id, sum(z * z) AS walk FROM (SELECT series_id, sum(e) OVER (PARTITION BY series_id ORDER BY t) AS z FROM e) GROUP BY 1) SELECT series_id, {r('walk / (n * n) / v AS stat')} FROM p JOIN n USING (series_id) JOIN v USING (series_id)")(lambda m, s: rounded(stats.kpss(s, lag=30).select("series_id", "stat")))
_model("u4_inverse_diff_matrix", f"WITH {S} SELECT series_id, t, {r('y - first_value(y) OVER w AS y', 'y * t AS x')} FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)")(lambda m, s: rounded(series.inverse_diff(series.diff(s.withColumn("x", F.col("y") * F.col("t")), 1, 1, ["y", "x"]), column=["y", "x"]).select("series_id", "t", "y", "x")))
_model("p1_box_cox_power")(lambda m, s: stats.box_cox_power(s))
_model("a10_failed_series")(lambda m, s: m.auto_arima(s.filter("t < 3 OR series_id LIKE '1%'"), m.auto.Options(most_p=1, most_q=1), failed="keep").select("series_id", "error"))


@register("g6_roots_of_given_models", "WITH c AS (SELECT n_name AS series_id, n_nationkey / 30.0::DOUBLE - 0.4 AS a, -(n_regionkey + 1) / 8.0::DOUBLE AS b, (n_nationkey - 10) / 16.0::DOUBLE AS q FROM nation), k AS (SELECT series_id, CASE WHEN a * a + 4 * b < 0 THEN 1 / sqrt(-b) ELSE least(abs((-a + sqrt(a * a + 4 * b)) / (2 * b)), abs((-a - sqrt(a * a + 4 * b)) / (2 * b))) END AS least_ar, CASE WHEN q = 0 THEN 1e9 ELSE 1 / abs(q) END AS least_ma FROM c) SELECT series_id, " + r("least_ar AS least_ar", "least_ma AS least_ma") + ", least_ar > 1 AS stationary, least_ma > 1 AS invertible FROM k")
def g6_given(spark, d):
    from seriesloom.plans import models

    n = sources.table(spark, d, "nation")
    given = n.select(F.col("n_name").alias("series_id"), F.array(F.col("n_nationkey") / 30.0 - 0.4, -(F.col("n_regionkey") + 1) / 8.0).alias("phi"), F.array((F.col("n_nationkey") - 10) / 16.0).alias("theta"))
    return rounded(models.characteristic_roots(given).withColumns({"least_ma": F.least("least_ma", F.lit(1e9))}))


@register("p6_p7_pipeline_random_walk", WALK + f" SELECT series_id, h::INT AS h, {r('last AS forecast')} FROM w, generate_series(1, 12) x(h)")
def p6_walk(spark, d):
    from seriesloom.plans.pipeline import Log, Pipeline

    chain = Pipeline((("log", Log()),), (0, 1, 0), unit="month")
    return rounded(chain.fit(sources.monthly_revenue(spark, d)).predict(12).select("series_id", "h", "forecast"))


CUSTOMERS = "s AS (SELECT o_custkey::VARCHAR AS series_id, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY 1, 2)"
STEPS = ", g AS (SELECT series_id, y - lag(y) OVER w AS dy, t - lag(t) OVER w AS gap FROM s WINDOW w AS (PARTITION BY series_id ORDER BY t)), v AS (SELECT series_id, avg(dy * dy / gap) AS sigma2, count(*) AS n, sum(ln(gap)) AS logs FROM g WHERE gap IS NOT NULL GROUP BY 1)"


@register("f2_fit_with_gaps", f"WITH {CUSTOMERS}{STEPS} SELECT series_id, n::INT AS nobs, {r('sigma2 AS sigma2', '-0.5 * (n * (ln(2 * pi() * sigma2) + 1) + logs) AS log_l')} FROM v WHERE n >= 2")
def f2_gaps(spark, d):
    """Random walks fitted to customers' orders by month, in which months without orders are missing values."""
    from seriesloom.plans import models

    t = ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1).cast("int")
    s = sources.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("series_id"), t.alias("t")).agg((F.sum("o_totalprice") / 1e6).alias("y"))
    long = s.join(s.groupBy("series_id").count().filter("count >= 3"), "series_id", "left_semi")
    return rounded(models.fit(long, (0, 1, 0), method="diffuse").select("series_id", "nobs", "sigma2", "log_l"))
