"""Chains of transformers before a model: what is done to y is undone on its forecasts, features are functions of place and date.

Steps are immutable. ``fit`` gives a step that knows its parameters (a table of one row for each series, or none), so updates
can't leave a chain half changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import stats
from seriesloom.operators.series import KEY
from seriesloom.plans import models

BOUNDS = ("forecast", "lower", "upper")


@dataclass(frozen=True)
class BoxCox:
    """A power for y: power, or the best of each series. Values of shift and below are an error, or are raised to floor."""

    power: float | None = None
    shift: float = 0.0
    floor: float | None = None
    powers: DataFrame | None = None

    def fit(self, df: DataFrame) -> BoxCox:
        if self.power is not None:
            return replace(self, powers=df.select(KEY).distinct().withColumn("lam", F.lit(float(self.power))))
        return replace(self, powers=stats.box_cox_lambda(df, shift=self.shift))

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col("y") + self.shift
        x = F.when(x > 0, x).when(x <= 0, F.raise_error(F.lit("values must be positive")).cast("double") if self.floor is None else F.lit(self.floor))
        z = F.when(F.abs("lam") < 1e-12, F.ln(x)).otherwise((F.pow(x, F.col("lam")) - 1) / F.col("lam"))
        return df.join(self.powers, KEY).withColumn("y", z).drop("lam")

    def inverse(self, df: DataFrame) -> DataFrame:
        def back(z: Column) -> Column:
            x, lam = z * F.col("lam") + 1, F.col("lam")
            out = F.when(F.abs(lam) < 1e-12, F.exp(z)).when((lam < 0) & (z > -1 / lam), None)
            return out.otherwise(F.signum(x) * F.pow(F.abs(x), 1 / lam)) - self.shift

        return df.join(self.powers, KEY).withColumns({c: back(F.col(c)) for c in BOUNDS}).drop("lam")


def Log(shift: float = 0.0) -> BoxCox:
    return BoxCox(0.0, shift)


@dataclass(frozen=True)
class Fourier:
    """Pairs of waves of period m; t goes on counting in the future."""

    m: int
    k: int | None = None

    def features(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        out = stats.fourier(df, self.m, self.k)
        names = [c for c in out.columns if c not in df.columns]
        even = [c for c in names if not (2 * int(c.split("_")[1]) == self.m and c.startswith("sin"))]
        return out, even


@dataclass(frozen=True)
class Dates:
    """Weekdays (Monday is the base, as a model with a constant needs one) and the day of the month."""

    column: str = "ds"

    def features(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        return stats.date_features(df, self.column), ["tue", "wed", "thu", "fri", "sat", "sun", "day"]


@dataclass(frozen=True)
class Pipeline:
    """Named steps, then a model of one order for every series. Rows are (series_id, t, y), with ds for dates of the given unit."""

    steps: tuple[tuple[str, object], ...]
    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)
    unit: str = "day"

    def __post_init__(self):
        names = [name for name, _ in self.steps]
        if len(set(names)) < len(names):
            raise ValueError("steps need different names")

    def fit(self, df: DataFrame) -> FittedPipeline:
        fitted, y = [], df
        for name, step in self.steps:
            if hasattr(step, "fit"):
                step = step.fit(y)
                y = step.transform(y)
            fitted.append((name, step))
        return FittedPipeline(replace(self, steps=tuple(fitted)), self, df)


@dataclass(frozen=True)
class FittedPipeline:
    fitted: Pipeline
    plan: Pipeline
    train: DataFrame

    def _design(self, df: DataFrame, known: bool) -> tuple[DataFrame, list[str]]:
        names: list[str] = []
        for _, step in self.fitted.steps:
            if hasattr(step, "features"):
                df, more = step.features(df)
                names += more
            elif known:
                df = step.transform(df)
        return df, names

    def future(self, h: int) -> DataFrame:
        """(series_id, h, t), with ds if the series have it, for the h places after each."""
        last = self.train.groupBy(KEY).agg(F.max("t").alias("_t"), *([F.max("ds").alias("ds")] if "ds" in self.train.columns else []))
        rows = last.select(KEY, "_t", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("h")).select(KEY, "h", (F.col("_t") + F.col("h")).alias("t"))
        return rows.join(stats.future_dates(last, h, self.fitted.unit), [KEY, "h"]) if "ds" in self.train.columns else rows

    def predict(self, h: int) -> DataFrame:
        """(series_id, h, forecast, lower, upper) on the scale of y."""
        train, names = self._design(self.train, True)
        future = self._design(self.future(h), False)[0] if names else None
        out = models.forecast(train, self.fitted.order, self.fitted.seasonal, h, exog=names or None, future=future)
        for _, step in reversed(self.fitted.steps):
            if hasattr(step, "inverse"):
                out = step.inverse(out)
        return out

    def update(self, new: DataFrame) -> FittedPipeline:
        """With later rows, the steps' parameters kept."""
        return replace(self, train=self.train.unionByName(new))

    def refit(self, new: DataFrame) -> FittedPipeline:
        """With later rows, everything learnt anew."""
        return self.plan.fit(self.train.unionByName(new))
