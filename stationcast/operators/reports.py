"""Counts, quality figures, histograms and box summaries of a panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DATE, NULL_TOKENS, STATION, TARGET
from .features import latest_rows
from .moments import pair_correlations
from .ordered import MAX_ROWS, attach
from .quantiles import exact_quantiles


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _missing(df: DataFrame, name: str, tokens: Sequence[str]) -> Column:
    cell = _q(name)
    if tokens and dict(df.dtypes)[name] == "string":
        return cell.isNull() | cell.isin(*tokens)
    return cell.isNull()


def missing_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    tokens: Sequence[str] = (),
    only_missing: bool = True,
) -> DataFrame:
    """``column``, ``missing``, ``missing_pct`` from one aggregate over the table."""
    names = list(columns or df.columns)
    rows = F.count(F.lit(1))
    one = df.agg(
        rows.alias("_rows"),
        *[F.count_if(_missing(df, n, tokens)).alias(f"_m{i}") for i, n in enumerate(names)],
    )
    long = one.select(
        "_rows",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column"), F.col(f"_m{i}").alias("missing"))
                    for i, n in enumerate(names)
                ]
            )
        ),
    )
    share = F.round(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), 6)
    out = long.select("column", "missing", share.alias("missing_pct"))
    if only_missing:
        out = out.filter(F.col("missing") > 0)
    return out.orderBy(F.desc("missing"), "column")


def _quality(df: DataFrame, columns: Sequence[str], tokens: Sequence[str], extra: dict) -> DataFrame:
    cells = F.count(F.lit(1)) * len(columns)
    missing = sum((F.count_if(_missing(df, c, tokens)) for c in columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.try_divide((cells - missing) * 100.0, cells), 6).alias("quality"),
        *[e.alias(n) for n, e in extra.items()],
    )


def quality_report(
    before: DataFrame, after: DataFrame, columns_before: Sequence[str], columns_after: Sequence[str]
) -> DataFrame:
    """Rows, columns, share of filled cells before and after cleaning, and the change.

    Missing-value tokens count as missing on both sides, over matching columns.
    One aggregate per side; the one-row results meet as scalar subqueries.
    """
    first = _quality(before, columns_before, NULL_TOKENS, {})
    last = _quality(
        after,
        columns_after,
        NULL_TOKENS,
        {
            "first_date": F.min(DATE),
            "last_date": F.max(DATE),
            "stations": F.count_distinct(STATION),
        },
    )
    rows_before, quality_before = first.select("rows").scalar(), first.select("quality").scalar()
    dropped = F.col("rows_before") - F.col("rows")
    return last.withColumns({"rows_before": rows_before, "quality_before": quality_before}).select(
        "rows_before",
        F.lit(len(columns_before)).alias("columns_before"),
        F.col("rows").alias("rows_after"),
        F.lit(len(columns_after)).alias("columns_after"),
        dropped.alias("rows_dropped"),
        F.round(F.try_divide(dropped * 100.0, F.col("rows_before")), 6).alias("dropped_pct"),
        "first_date",
        "last_date",
        "stations",
        "quality_before",
        F.col("quality").alias("quality_after"),
        F.round(F.col("quality") - F.col("quality_before"), 6).alias("quality_change"),
    )


def row_counts(df: DataFrame) -> DataFrame:
    """Rows per year, per month and per station: ``dimension``, ``item``, ``n``."""
    parts = df.select(
        F.year(DATE).cast("string").alias("year"),
        F.month(DATE).cast("string").alias("month"),
        F.col(STATION).alias("station"),
    )
    sets = parts.groupingSets([["year"], ["month"], ["station"]], "year", "month", "station").agg(
        F.count(F.lit(1)).alias("n"),
        F.grouping("year").alias("_y"),
        F.grouping("month").alias("_m"),
    )
    dimension = F.when(F.col("_y") == 0, "year").when(F.col("_m") == 0, "month").otherwise("station")
    return sets.select(
        dimension.alias("dimension"), F.coalesce("year", "month", "station").alias("item"), "n"
    ).filter(F.col("item").isNotNull())


def histogram(
    df: DataFrame,
    column: str = TARGET,
    bins: int = 30,
    by: Sequence[str] = (),
    edges: Sequence[str] = (),
) -> DataFrame:
    """Equal-width bins from smallest to largest value, the last bin closed.

    A constant column gets the range of half a unit either side. All bins are
    there, empty ones with count 0. Columns: ``by``, ``bin`` (0-based), ``low``,
    ``high``, ``n``, ``density``. ``edges`` names the part of ``by`` that shares
    one range (default: all of it).
    """
    shared = list(edges or by)
    rows = df.filter(F.col(column).isNotNull()).groupBy(*by, *[c for c in shared if c not in by], column)
    rows = rows.agg(F.count(F.lit(1)).alias("_times"))  # equal values are counted before any shuffle
    lo, hi = F.min(column), F.max(column)
    flat = lo == hi
    span = rows.groupBy(*shared).agg(
        F.when(flat, lo - 0.5).otherwise(lo).alias("_lo"),
        F.when(flat, hi + 0.5).otherwise(hi).alias("_hi"),
    )
    if shared:
        placed = attach(rows, span, shared)
    else:
        placed = rows.withColumns(
            {"_lo": span.select("_lo").scalar(), "_hi": span.select("_hi").scalar()}
        )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    index = F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    # counts per (group, bin) are combined before the shuffle
    counts = placed.groupBy(*by, index.alias("bin")).agg(F.sum("_times").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    if by:
        frame = totals.join(span, shared) if shared else totals
    else:
        frame = totals
    if not shared:
        frame = frame.withColumns(
            {"_lo": span.select("_lo").scalar(), "_hi": span.select("_hi").scalar()}
        )
    spine = frame.filter(F.col("_total") > 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    n = F.coalesce("n", F.lit(0).cast("long"))
    return spine.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("low"),
        F.when(F.col("bin") == bins - 1, F.col("_hi"))
        .otherwise(F.col("_lo") + (F.col("bin") + 1) * width)
        .alias("high"),
        n.alias("n"),
        (n / (F.col("_total") * width)).alias("density"),
    )


def box_summary(
    df: DataFrame, column: str = TARGET, by: Sequence[str] = ("is_train",), max_rows: int = MAX_ROWS
) -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR, outlier count, mean and size per group.

    The input is read several times; write an expensive one first.
    """
    quartiles = exact_quantiles(df, [column], [0.25, 0.5, 0.75], by, max_rows)
    boxes = quartiles.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n)
            for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
        ]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # the whiskers end at actual values, so counted values are enough
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    value = F.col("_v")
    inside = value.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        attach(counted, boxes, by)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
            (F.sum(value * F.col("_n")) / F.sum("_n")).alias("mean"),
            F.sum("_n").alias("n"),
        )
    )


def outliers(df: DataFrame, column: str = TARGET, by: Sequence[str] = ("is_train",)) -> DataFrame:
    """The rows beyond the whiskers of :func:`box_summary`."""
    boxes = box_summary(df, column, by).select(*by, "whisker_low", "whisker_high")
    value = F.col(column)
    return (
        attach(df, boxes, by)
        .filter((value < F.col("whisker_low")) | (value > F.col("whisker_high")))
        .drop("whisker_low", "whisker_high")
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair, over rows where both are known.

    ``column_a``, ``column_b``, ``correlation``, both triangles and the diagonal. A constant
    column has no correlation. Works for hundreds of columns.
    """
    return pair_correlations(df, columns).drop("n")


def duplicate_dates(df: DataFrame, by: Sequence[str] = (STATION, DATE)) -> DataFrame:
    """Rows beyond the first per date, with the date range.

    Null dates count as one value. ``by=(DATE,)`` looks at dates across stations.
    """
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        F.sum("_n").alias("rows"),
    )


def plausibility(
    df: DataFrame, column: str = TARGET, threshold: float = 30.0, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The latest value of each station and whether it is above ``threshold``."""
    last = latest_rows(df, 1, tiebreak=tiebreak)
    return last.select(
        STATION,
        DATE,
        F.col(column).alias("last_value"),
        F.coalesce(F.col(column) > threshold, F.lit(False)).alias("plausible"),
    )

