"""Rolling-origin monthly forecasts for many series at once.

Facts are summed to months first. From then on a series is bounded by its months, so windows and
arrays per series stay small however many facts lie behind them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrain.functions.exprs import correlation, month_of, ratio, total

METHODS = ("naive", "moving_average", "exponential_smoothing")


@dataclass(frozen=True)
class ForecastConfig:
    """Phases in months, and the grid the smoothing parameters are chosen from."""

    validation_months: int = 6
    test_months: int = 6
    moving_average_window: int = 3
    horizon_months: int = 3
    minimum_training_months: int = 12
    damped: bool = True
    alphas: Sequence[float] = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    betas: Sequence[float] = (0.01, 0.05, 0.1, 0.2, 0.4, 0.6)
    phis: Sequence[float] = (0.8, 0.85, 0.9, 0.95, 0.98)

    def __post_init__(self) -> None:
        for name in (
            "validation_months", "test_months", "moving_average_window", "horizon_months", "minimum_training_months",
        ):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.minimum_training_months < self.moving_average_window:
            raise ValueError("minimum_training_months must cover the moving-average window")
        for name in ("alphas", "betas", "phis"):
            if not getattr(self, name) or not all(0 < v <= 1 for v in getattr(self, name)):
                raise ValueError(f"{name} must hold values in (0, 1]")

    @property
    def required_months(self) -> int:
        return self.minimum_training_months + self.validation_months + self.test_months

    @property
    def backtest_months(self) -> int:
        return self.validation_months + self.test_months

    def grid(self) -> list[tuple[float, float, float]]:
        return list(product(self.alphas, self.betas, self.phis if self.damped else (1.0,)))


# --- series ----------------------------------------------------------------------------------


def monthly_series(
    sales: DataFrame, *, by: Sequence[str] = (), owners: DataFrame | None = None, owner_key: str = "subscription_id"
) -> DataFrame:
    """Net revenue per series and month as ``value``.

    Where the columns of ``by`` belong to an owner of the sales, give ``owners``, unique on ``owner_key``: sales are
    then summed by owner and month before they meet their owners, so a hot owner meets as one row a month. Sales
    without owner fall out.
    """
    if owners is not None:
        per_owner = sales.groupBy(owner_key, F.trunc("sale_date", "month").alias("sale_date")).agg(F.sum("net_revenue").alias("net_revenue"))
        sales = per_owner.join(owners.select(owner_key, *by), owner_key)
    return sales.groupBy(*by, month_of("sale_date").alias("month")).agg(total("net_revenue").alias("value"))


def month_calendar(monthly: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Every month from the first to the last of each series."""
    return (
        monthly.groupBy(*by)
        .agg(F.min("month").alias("_first"), F.max("month").alias("_last"))
        .select(*by, F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    )


def series_problems(monthly: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Months that are missing, or whose value is not positive."""
    missing = month_calendar(monthly, by=by).join(monthly, [*by, "month"], "left_anti")
    low = monthly.filter(F.col("value") <= 0)
    return missing.select(*by, "month", F.lit("missing").alias("problem")).unionByName(
        low.select(*by, "month", F.lit("not positive").alias("problem"))
    )


def fill_months(monthly: DataFrame, *, by: Sequence[str] = (), how: str = "zero") -> DataFrame:
    """Complete a series with zeros or with the previous value, where the caller asks for it."""
    if how not in ("zero", "previous"):
        raise ValueError("how must be 'zero' or 'previous'")
    joined = month_calendar(monthly, by=by).join(monthly, [*by, "month"], "left")
    if how == "zero":
        return joined.na.fill(0.0, ["value"])
    so_far = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("value", F.last("value", ignorenulls=True).over(so_far))


def short_series(monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """Series with fewer months than the phases need."""
    return (
        monthly.groupBy(*by).agg(F.count("*").alias("months")).filter(F.col("months") < config.required_months)
    )


def series_rejects(monthly: DataFrame, *, by: Sequence[str] = (), needed: int = 1) -> DataFrame:
    """Series that no forecast may be made of, with the first reason: gaps, low values, too few months."""
    state = monthly.groupBy(*by).agg(
        F.count("*").alias("months"),
        (F.months_between(F.max("month"), F.min("month")) + 1).cast("long").alias("_span"),
        F.min("value").alias("_least"),
        F.count("value").alias("_known"),
    )
    problem = (
        F.when(F.col("_span") != F.col("months"), "missing months")
        .when((F.col("_least") <= 0) | (F.col("_known") < F.col("months")), "not positive")
        .when(F.col("months") < needed, "too short")
    )
    return state.select(*by, "months", problem.alias("problem")).filter("problem IS NOT NULL AND months > 0")


def require_series(
    monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = (), needed: int | None = None
) -> None:
    """Raise when a series is incomplete, not positive or too short; one pass over the months."""
    needed = config.required_months if needed is None else needed
    rejects = series_rejects(monthly, by=by, needed=needed).limit(5).collect()
    broken = [tuple(r) for r in rejects if r.problem != "too short"]
    if broken:
        raise ValueError(f"Series are not complete and positive, for example {broken}")
    if rejects:
        raise ValueError(f"At least {needed} months are needed; short: {[tuple(r) for r in rejects]}")


def _placed(monthly: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the position of each month in its series, from 0, and the series length."""
    series = Window.partitionBy(*by)
    return monthly.withColumns(
        {
            "_index": F.row_number().over(series.orderBy("month")) - 1,
            "_months": F.count("*").over(series).cast("int"),
        }
    )


# --- one-step forecasts ----------------------------------------------------------------------


def simple_forecasts(monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """For every month, the naive and moving-average forecasts from the months before it."""
    series = Window.partitionBy(*by).orderBy("month")
    earlier = series.rowsBetween(-config.moving_average_window, -1)
    averaged = F.when(F.count("value").over(earlier) == config.moving_average_window, F.avg("value").over(earlier))
    return (
        _placed(monthly, by)
        .withColumns({"naive": F.lag("value").over(series), "moving_average": averaged})
        .unpivot([*by, "month", "value", "_index", "_months"], ["naive", "moving_average"], "method", "forecast")
    )


def _smoothing_states() -> Column:
    """Fold one parameter triple over a series; an array of solved states, one per origin.

    Level and trend are linear in their unknown start values, so each is carried as
    constant + a * start level + b * start trend (``l0 l1 l2`` and ``b0 b1 b2``). The start values
    that minimise the squared one-step errors then have a closed form from nine running sums, at
    every prefix of the series. ``f`` is the one-step forecast in the same three parts.
    """
    sums = ("s11", "s12", "s22", "c1", "c2", "rr", "r", "f1", "f2")
    start = {**dict.fromkeys(("l0", "l1", "l2", "b0", "b1", "b2", *sums), "0D"), "l1": "1D", "b2": "1D"}
    states_type = "array<struct<origin:int,sse:double,level:double,trend:double,bias:double>>"
    f = [f"(s.l{i} + phi * s.b{i})" for i in range(3)]
    rest = f"(y - {f[0]})"
    level = [f"(alpha * y + (1 - alpha) * {f[0]})", f"((1 - alpha) * {f[1]})", f"((1 - alpha) * {f[2]})"]
    det = "nullif(s.s11 * s.s22 - s.s12 * s.s12, 0D)"
    level0 = f"((s.c1 * s.s22 - s.c2 * s.s12) / {det})"
    trend0 = f"((s.c2 * s.s11 - s.c1 * s.s12) / {det})"
    solved = f"""named_struct('origin', s.seen,
        'sse', s.rr - {level0} * s.c1 - {trend0} * s.c2,
        'level', s.l0 + s.l1 * {level0} + s.l2 * {trend0},
        'trend', s.b0 + s.b1 * {level0} + s.b2 * {trend0},
        'bias', (s.r - s.f1 * {level0} - s.f2 * {trend0}) / s.seen)"""
    moved = {
        **{f"l{i}": level[i] for i in range(3)},
        **{f"b{i}": f"beta * ({level[i]} - s.l{i}) + (1 - beta) * phi * s.b{i}" for i in range(3)},
        "s11": f"s.s11 + {f[1]} * {f[1]}",
        "s12": f"s.s12 + {f[1]} * {f[2]}",
        "s22": f"s.s22 + {f[2]} * {f[2]}",
        "c1": f"s.c1 + {f[1]} * {rest}",
        "c2": f"s.c2 + {f[2]} * {rest}",
        "rr": f"s.rr + {rest} * {rest}",
        "r": f"s.r + {rest}",
        "f1": f"s.f1 + {f[1]}",
        "f2": f"s.f2 + {f[2]}",
        "seen": "s.seen + 1",
        # The solved state of a prefix is read before the next observation is folded in.
        "states": f"CASE WHEN s.seen >= _first THEN concat(s.states, array({solved})) ELSE s.states END",
    }

    def struct(fields: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in fields.items()) + ")"

    initial = struct({**start, "seen": "0", "states": f"CAST(array() AS {states_type})"})
    return F.expr(
        f"aggregate(_values, {initial}, (s, y) -> {struct(moved)}, s -> concat(s.states, array({solved})))"
    )


def smoothing_states(monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """Best damped-trend state at each origin of the backtest and at the end of the series.

    Parameters come from a fixed grid by least squared one-step error; start values are solved for
    exactly. One fold per series and parameter triple serves all origins.
    """
    grid = ", ".join(
        f"named_struct('alpha', {a!r}D, 'beta', {b!r}D, 'phi', {p!r}D)" for a, b, p in config.grid()
    )
    series = monthly.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("_points"))
    candidates = series.select(
        *by,
        F.col("_points.value").alias("_values"),
        F.greatest(F.size("_points") - config.backtest_months, F.lit(3)).alias("_first"),
        F.expr(f"inline(array({grid}))"),
    )
    # Spread the folds: there may be few series and many parameter triples.
    spread = candidates.repartition(*by, "alpha", "beta")
    return (
        spread.select(*by, "alpha", "beta", "phi", _smoothing_states().alias("_states"))
        .select(*by, "alpha", "beta", "phi", F.inline("_states"))
        .filter("sse IS NOT NULL")
        .groupBy(*by, "origin")
        .agg(F.min(F.struct("sse", "alpha", "beta", "phi", "level", "trend", "bias")).alias("_best"))
        .select(*by, "origin", "_best.*")
    )


def smoothing_forecasts(monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """One-step smoothing forecasts for the months of the backtest."""
    states = smoothing_states(monthly, config, by=by).withColumnRenamed("origin", "_index")
    return (
        _placed(monthly, by)
        .join(states, [*by, "_index"])
        .select(
            *by,
            "month",
            "value",
            "_index",
            "_months",
            F.lit(METHODS[2]).alias("method"),
            (F.col("level") + F.col("phi") * F.col("trend") + F.col("bias")).alias("forecast"),
        )
    )


def rolling_origin(
    monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = (), check: bool = True
) -> DataFrame:
    """One-step forecasts of every method; a forecast sees only the months before its own.

    Neighbouring rows count as neighbouring months, so unless ``check`` is off a series with gaps is an error.
    """
    if check:
        require_series(monthly, config, by=by, needed=1)
    return simple_forecasts(monthly, config, by=by).unionByName(smoothing_forecasts(monthly, config, by=by))


def _phase(config: ForecastConfig) -> Column:
    from_end = F.col("_months") - F.col("_index")
    return F.when(from_end <= config.test_months, "test").when(from_end <= config.backtest_months, "validation")


def phase_periods(monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()) -> DataFrame:
    """First and last month of the initial training, validation and test phase of each series."""
    return (
        _placed(monthly, by)
        .groupBy(*by, F.coalesce(_phase(config), F.lit("initial_training")).alias("phase"))
        .agg(F.min("month").alias("start_month"), F.max("month").alias("end_month"))
    )


def backtest(
    monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = (), check: bool = True
) -> DataFrame:
    """Validation and test rows of every method.

    Series that are incomplete, not positive or too short are an error. With ``check`` off the short ones have no
    rows; ``series_rejects`` names them all.
    """
    if check:
        require_series(monthly, config, by=by)
    return (
        rolling_origin(monthly, config, by=by, check=False)
        .filter(F.col("_months") >= config.required_months)
        .withColumn("phase", _phase(config))
        .filter("phase IS NOT NULL")
        .select(
            *by,
            "phase",
            "month",
            "method",
            F.col("value").alias("actual_net_revenue"),
            F.col("forecast").alias("forecast_net_revenue"),
            F.abs(F.col("value") - F.col("forecast")).alias("absolute_error"),
        )
    )


def forecast_metrics(
    rows: DataFrame, *, by: Sequence[str] = (), actual: str = "actual_net_revenue", predicted: str = "forecast_net_revenue"
) -> DataFrame:
    """Mean absolute error, root mean squared error, and absolute error over absolute actual."""
    error = F.col(actual) - F.col(predicted)
    return rows.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        ratio(F.sum(F.abs(error)), F.sum(F.abs(F.col(actual)))).alias("wape"),
    )


def _method_rank() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))


def select_method(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """The method with the lowest validation (wape, mae); test rows play no part."""
    scored = forecast_metrics(rows.filter("phase = 'validation'"), by=[*by, "method"])
    best = F.min(F.struct("wape", "mae", _method_rank().alias("_rank"), "method"))
    return scored.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best.method").alias("method"))


# --- the future ------------------------------------------------------------------------------


def future_forecasts(
    monthly: DataFrame, config: ForecastConfig, *, by: Sequence[str] = (), check: bool = True
) -> DataFrame:
    """The months after the series by every method; the moving average feeds on itself.

    Unless ``check`` is off, a series that is incomplete, not positive or too short is an error.
    """
    if check:
        require_series(monthly, config, by=by)
    h, w = config.horizon_months, config.moving_average_window
    series = monthly.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("month", "value"))).alias("_points"), F.max("month").alias("_last")
    ).withColumn("_values", F.col("_points.value"))
    last = F.element_at("_values", -1)

    def average_step(acc: Column, _: Column) -> Column:
        recent = F.slice(acc, -w, w)
        mean = F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / w
        return F.concat(acc, F.array(mean))

    recent = F.slice(F.col("_values"), -w, w)
    averaged = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(h)), recent, average_step), -h, h)
    simple = series.filter(F.size("_values") >= w).select(
        *by,
        "_last",
        F.explode(
            F.array(
                F.struct(F.lit(METHODS[0]).alias("method"), F.array_repeat(last, h).alias("path")),
                F.struct(F.lit(METHODS[1]).alias("method"), averaged.alias("path")),
            )
        ).alias("_m"),
    ).select(*by, "_last", "_m.*")
    ends = _placed(monthly, by).filter(F.col("_index") == F.col("_months") - 1).select(
        *by, F.col("month").alias("_last"), F.col("_months").alias("origin")
    )
    steps = F.transform(
        F.sequence(F.lit(1), F.lit(h)),
        lambda k: F.col("level")
        + F.col("trend") * F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + F.pow(F.col("phi"), i))
        + F.col("bias"),
    )
    smooth = (
        smoothing_states(monthly, config, by=by)
        .join(ends, [*by, "origin"])
        .select(*by, "_last", F.lit(METHODS[2]).alias("method"), steps.alias("path"))
    )
    return simple.unionByName(smooth).select(
        *by, "_last", "method", F.posexplode("path").alias("_k", "forecast_net_revenue")
    ).select(
        *by,
        F.add_months("_last", F.col("_k") + 1).alias("month"),
        "method",
        (F.col("_k") + 1).alias("horizon_month"),
        "forecast_net_revenue",
    )


def selected_future(
    monthly: DataFrame, rows: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()
) -> DataFrame:
    """The future by the method each series selected on its validation rows."""
    chosen = select_method(rows, by=by)
    return future_forecasts(monthly, config, by=by).join(chosen, [*by, "method"], "left_semi")


def selected_test_rows(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Test rows of the selected method, in month order."""
    chosen = select_method(rows, by=by)
    return rows.filter("phase = 'test'").join(chosen, [*by, "method"], "left_semi").orderBy(*by, "month")


def series_facts(monthly: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Length, bounds, growth over the whole series, and correlation with itself a year earlier."""
    year_ago = F.lag("value", 12).over(Window.partitionBy(*by).orderBy("month"))
    growth = ratio(F.max_by("value", "month"), F.min_by("value", "month")) - 1
    return (
        monthly.withColumn("_year_ago", year_ago)
        .groupBy(*by)
        .agg(
            F.count("*").alias("observations"),
            F.min("month").alias("start_month"),
            F.max("month").alias("end_month"),
            growth.alias("overall_growth"),
            correlation("value", "_year_ago").alias("lag_12_correlation"),
        )
    )


def gain_over_naive(rows: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Test errors of the selected method and its relative gain over the naive one."""
    scored = forecast_metrics(rows.filter("phase = 'test'"), by=[*by, "method"])
    naive = scored.filter(F.col("method") == METHODS[0]).select(*by, F.col("wape").alias("_naive"))
    chosen = scored.join(select_method(rows, by=by), [*by, "method"], "left_semi")
    paired = chosen.join(naive, list(by)) if by else chosen.withColumn("_naive", naive.select("_naive").scalar())
    return paired.withColumn(
        "test_wape_improvement_over_naive", ratio(F.col("_naive") - F.col("wape"), "_naive")
    ).drop("_naive")


def forecast_evidence(
    monthly: DataFrame, rows: DataFrame, config: ForecastConfig, *, by: Sequence[str] = ()
) -> DataFrame:
    """Next month and test errors of the selected method as (metric, value, unit) rows."""
    first = selected_future(monthly, rows, config, by=by).filter("horizon_month = 1").select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.lit("next_month_net_revenue").alias("metric"),
                    F.col("forecast_net_revenue").alias("value"),
                    F.lit("currency").alias("unit"),
                )
            )
        ),
    )
    units = {
        "mae": ("test_mae", "currency"),
        "rmse": ("test_rmse", "currency"),
        "wape": ("test_wape", "ratio"),
        "test_wape_improvement_over_naive": ("test_wape_improvement_over_naive", "ratio"),
    }
    errors = gain_over_naive(rows, by=by).select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"), F.lit(unit).alias("unit"))
                    for c, (name, unit) in units.items()
                ]
            )
        ),
    )
    return first.unionByName(errors)
