"""Tables behind the figures; drawing is left to the reader of the table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bias import level_bias, month_bars, monthly_bias, overall_bias, with_errors
from ..operators.features import latest_rows
from ..operators.ordered import arrange, attach
from ..operators.reports import box_summary, histogram
from ..operators.split import sorted_band
from ..schema import DATE, STATION, TARGET
from ..session import ship

#: Points of a line, and cells of a scatter along each axis.
POINTS, CELLS = 500, 64
#: Bins for each point of a line, whose extremes are looked at more closely.
CLOSER = 4


def forecast_chart(
    history: DataFrame, forecasts: DataFrame, rows: int = 30, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Series ``history``, ``forecast``, ``lower``, ``upper`` per station: (series, x, y).

    The last three start at the last actual point, which connects the lines.
    """
    past = latest_rows(history, rows, tiebreak=tiebreak).select(
        STATION, F.lit("history").alias("series"), F.col(DATE).alias("x"), F.col(TARGET).alias("y")
    )
    last = latest_rows(history, 1, tiebreak=tiebreak).select(STATION, F.col(DATE).alias("x"), F.col(TARGET).alias("v"))
    names = ("forecast", "lower", "upper")
    start = last.select(
        STATION,
        F.explode(F.array(*[F.lit(n) for n in names])).alias("series"),
        "x",
        F.col("v").alias("y"),
    )
    ahead = forecasts.select(
        STATION,
        F.col("target_date").alias("x"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("series"), F.col("value" if n == "forecast" else n).alias("y"))
                    for n in names
                ]
            )
        ),
    )
    return past.unionByName(start).unionByName(ahead)


def actual_vs_predicted(predictions: DataFrame) -> DataFrame:
    return predictions.select("model", "side", STATION, DATE, "label", "prediction")


def scatter(predictions: DataFrame) -> DataFrame:
    """Actual against predicted and predicted against residual: (panel, x, y)."""
    points = with_errors(predictions)
    rows = F.array(
        F.struct(F.lit("actual_predicted").alias("panel"), F.col("label").alias("x"), F.col("prediction").alias("y")),
        F.struct(F.lit("predicted_residual").alias("panel"), F.col("prediction").alias("x"), F.col("residual").alias("y")),
    )
    return points.select("model", "side", F.inline(rows))


def error_density(predictions: DataFrame, bins: int = 30, places: int | None = None) -> DataFrame:
    """Density of absolute errors of both sides together, per model, with their mean.

    ``places`` rounds the errors first, so that an error at an edge falls into the same
    bin wherever it is computed.
    """
    errors = with_errors(predictions).select("model", "abs_error")
    if places is not None:
        errors = errors.withColumn("abs_error", F.round("abs_error", places))
    mean = errors.groupBy("model").agg(F.avg("abs_error").alias("mean_error"))
    return histogram(errors, "abs_error", bins, by=("model",)).join(mean, "model")


def bias_bars(predictions: DataFrame) -> DataFrame:
    """Bias per month of the year and MAE per level: (model, panel, item, value)."""
    months = month_bars(monthly_bias(predictions)).select(
        "model", F.lit("month").alias("panel"), F.col("month").cast("string").alias("item"), F.col("bias").alias("value")
    )
    by_level = level_bias(predictions).select(
        "model", F.lit("level").alias("panel"), F.col("level").alias("item"), F.col("mae").alias("value")
    )
    return months.unionByName(by_level)


def test_band(predictions: DataFrame, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Test rows sorted by actual, with one residual spread around the prediction."""
    test = predictions.filter(F.col("side") == "test")
    # one row per model
    spread = F.broadcast(overall_bias(test).select("model", "residual_std"))
    return sorted_band(test.join(spread, "model"), tiebreak=tiebreak)


def split_chart(split: DataFrame) -> dict[str, DataFrame]:
    """Timeline of both sides, the split date and the box summaries."""
    dated = split.select(STATION, DATE, TARGET, "is_train")
    return {
        "timeline": dated,
        "split_date": dated.filter(~F.col("is_train")).groupBy(STATION).agg(F.min(DATE).alias("split_date")),
        "boxes": box_summary(dated),
    }


def target_chart(features: DataFrame, bins: int = 30) -> dict[str, DataFrame]:
    return {
        "timeline": features.select(STATION, DATE, TARGET),
        "histogram": histogram(features, TARGET, bins),
    }


def model_figure(predictions: DataFrame, bars: DataFrame) -> dict[str, DataFrame]:
    """All nine panels of the model figure."""
    band = test_band(predictions)
    points = scatter(predictions)
    lines = actual_vs_predicted(predictions)
    both = bias_bars(predictions)
    return {
        "train_lines": lines.filter(F.col("side") == "train"),
        "test_lines": lines.filter(F.col("side") == "test"),
        "actual_predicted": points.filter(F.col("panel") == "actual_predicted"),
        "predicted_residual": points.filter(F.col("panel") == "predicted_residual"),
        "error_density": error_density(predictions),
        "month_bias": both.filter(F.col("panel") == "month"),
        "level_mae": both.filter(F.col("panel") == "level"),
        "metric_bars": bars,
        "sorted_band": band,
    }


def figure_rows(panels: dict[str, DataFrame]) -> DataFrame:
    """The panels of :func:`model_figure` as one table: panel, model, side, series, item, x, y.

    ``item`` names a bar or a date, ``x`` is a number; one of them is null.
    """
    no_side, no_x, no_item = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")

    def rows(name: str, item: Column, x: Column, series: dict[str, str], side: Column = no_side) -> DataFrame:
        lines = F.array(*[F.struct(F.lit(s).alias("series"), F.col(c).cast("double").alias("y")) for s, c in series.items()])
        placed = panels[name].select(
            F.lit(name).alias("panel"), "model", side.alias("side"), item.cast("string").alias("item"), x.cast("double").alias("x"), F.inline(lines)
        )
        return placed.select("panel", "model", "side", "series", "item", "x", "y")

    side, both = F.col("side"), {"label": "label", "prediction": "prediction"}
    tables = [
        *(rows(n, F.concat_ws(" ", STATION, F.col(DATE).cast("string")), no_x, both, side) for n in ("train_lines", "test_lines")),
        *(rows(n, no_item, F.col("x"), {"points": "y"}, side) for n in ("actual_predicted", "predicted_residual")),
        rows("error_density", no_item, F.col("low"), {"density": "density", "mean_error": "mean_error"}),
        *(rows(n, F.col("item"), no_x, {"bars": "value"}) for n in ("month_bias", "level_mae")),
        rows("metric_bars", F.col("metric"), no_x, {"bars": "value"}, side),
        rows("sorted_band", no_item, F.col("sample"), {**both, "lower": "lower", "upper": "upper"}, F.lit("test")),
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def scatter_cells(points: DataFrame, cells: int = CELLS, by: Sequence[str] = ("model", "side", "panel"), x: str = "x", y: str = "y") -> DataFrame:
    """A scatter of any size as the counts of ``cells`` times ``cells`` equal cells per group.

    Columns: ``by``, ``column``, ``row`` (0-based), ``n``, and the cell's edges ``x_low``,
    ``x_high``, ``y_low``, ``y_high``. The outermost cells begin and end at the extremes;
    empty cells are left out, points without x or y too.
    """
    by = list(by)
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ends = []
    for c in ("_x", "_y"):
        lo, hi = F.min(c), F.max(c)
        ends += [F.when(lo == hi, lo - 0.5).otherwise(lo).alias(f"{c}_lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias(f"{c}_hi")]
    placed = attach(known, known.groupBy(*by).agg(*ends), by)
    size = {c: (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / F.lit(cells) for c in ("_x", "_y")}
    at = {c: F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / size[c]), F.lit(cells - 1)).cast("int") for c in ("_x", "_y")}
    edges = [f"{c}_{e}" for c in ("_x", "_y") for e in ("lo", "hi")]
    counts = placed.groupBy(*by, at["_x"].alias("column"), at["_y"].alias("row"), *edges).agg(F.count(F.lit(1)).alias("n"))

    def edge(c: str, place: Column) -> Column:
        return F.col(f"{c}_lo") + size[c] * place

    return counts.select(
        *by, "column", "row", "n",
        edge("_x", F.col("column")).alias("x_low"), edge("_x", F.col("column") + 1).alias("x_high"),
        edge("_y", F.col("row")).alias("y_low"), edge("_y", F.col("row") + 1).alias("y_high"),
    )


def line_extremes(df: DataFrame, bins: int, y: str = TARGET, keys: Sequence[str] = (STATION,), order: Sequence[str] = (DATE,), **arranged) -> DataFrame:
    """The lowest and the highest row (the first of equal ones) of each of ``bins`` stretches of equal length.

    Columns: ``keys``, ``order``, ``y``, ``position`` (from 1) and ``size`` of the series. Rows
    without a value are left out. A series of any length may lie in one station: rows are
    numbered by segment and the stretches are aggregates.
    """
    keys, order = list(keys), list(order)
    known = df.filter(F.col(y).isNotNull()).select(*keys, *order, y)
    numbered = arrange(known, keys, tuple(order), **arranged).number("position", "size").result()
    stretch = F.floor((F.col("position") - 1) * bins / F.greatest("size", F.lit(bins)))
    row = F.struct(*order, y, "position", "size")
    ends = numbered.filter(F.col("position").isNotNull()).groupBy(*keys, stretch.alias("_bin")).agg(
        F.min_by(row, F.struct(F.col(y), F.col("position"))).alias("low"), F.min_by(row, F.struct(-F.col(y), F.col("position"))).alias("high")
    )
    return ends.select(*keys, F.explode(F.array_distinct(F.array("low", "high"))).alias("r")).select(*keys, "r.*")


def _largest_triangles(x: np.ndarray, y: np.ndarray, points: int) -> np.ndarray:
    """Places of the points that keep a line's shape: of each bucket the one that spans the
    largest triangle with the point kept before and the middle of the next bucket."""
    n = len(x)
    if n <= points or points < 3:
        return np.arange(n) if n <= points else np.array([0, n - 1][:points])
    edges = np.linspace(1, n - 1, points - 1).astype(int)
    kept = [0]
    for i in range(points - 2):
        own = np.arange(edges[i], max(edges[i + 1], edges[i] + 1))
        after = slice(edges[i + 1], edges[i + 2]) if i + 2 < len(edges) else slice(n - 1, n)
        a, cx, cy = kept[-1], x[after].mean(), y[after].mean()
        area = np.abs((x[a] - cx) * (y[own] - y[a]) - (x[a] - x[own]) * (cy - y[a]))
        kept.append(int(own[np.argmax(area)]))
    return np.array([*kept, n - 1])


def thin_line(
    df: DataFrame, points: int = POINTS, y: str = TARGET, keys: Sequence[str] = (STATION,), order: Sequence[str] = (DATE,), **arranged
) -> DataFrame:
    """At most ``points`` rows (four at least) of each line that keep its shape: ``keys``, ``order``, ``y``.

    First and last row, the lowest and the highest are among them. Of each of some ``CLOSER``
    times ``points`` stretches the extremes are found by an aggregate; of these, bounded in
    number, the largest triangles choose. A line that is short enough stays whole.
    """
    if points < 4:
        raise ValueError("a line needs four points")
    ship(df.sparkSession)
    keys, order = list(keys), list(order)
    close = line_extremes(df, points * CLOSER, y, keys, order, **arranged)
    # a line's ends are in its outermost stretches, but not always as their extremes
    known = df.filter(F.col(y).isNotNull()).select(*keys, *order, y).dropna(subset=keys)
    first, last = F.min(F.struct(*order, y)), F.max(F.struct(*order, y))
    ends = known.groupBy(*keys).agg(first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("size"))
    outer = F.array(F.struct("first.*", F.lit(0).cast("long").alias("position")), F.struct("last.*", F.col("size").alias("position")))
    both = close.drop("size").unionByName(ends.select(*keys, F.inline(outer)))
    rows = both.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", y, *order))).alias("rows"))
    places = rows.select(*keys, F.transform("rows", lambda r: r.position).alias("p"), F.transform("rows", lambda r: r[y].cast("double")).alias("v"), "rows")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = len(keys)
            chosen = []
            for p, v in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True):
                x, value = np.array(p, float), np.array(v, float)
                once = np.flatnonzero(np.append(True, np.diff(np.maximum(x, 1.0)) > 0))  # the ends are there twice
                found = once[_largest_triangles(x[once], value[once], points - 2)]
                chosen.append(sorted({*found.tolist(), int(once[np.argmin(value[once])]), int(once[np.argmax(value[once])])}))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(chosen, pa.list_(pa.int32())), batch.column(at + 2)], [*keys, "chosen", "rows"]
            )

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("chosen", T.ArrayType(T.IntegerType())), rows.schema["rows"]])
    kept = places.mapInArrow(choose, schema).select(*keys, F.explode("chosen").alias("_at"), "rows")
    return kept.select(*keys, F.get("rows", F.col("_at")).alias("r")).select(*keys, *[f"r.{c}" for c in (*order, y)])
