"""Exact quantiles without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .ordered import MAX_PIECES, MAX_ROWS, Sizes, arrange, measure

#: Columns with more values than this are searched between two approximate quantiles.
BRACKET_ROWS = 100_000
ACCURACY = 10_000
#: How far the approximate quantiles lie to either side; three times their error.
REACH = 3 / ACCURACY


def tall(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): ``by``, ``column``, ``value``; nulls left out."""
    return df.unpivot(
        list(by), [F.col(c).cast("double").alias(c) for c in columns], "column", "value"
    ).filter(F.col("value").isNotNull())


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    max_rows: int = MAX_ROWS,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Quantiles with linear interpolation: ``by``, ``column``, ``probability``, ``value``.

    A null in ``by`` is a group like any other. One scan finds two approximate quantiles
    around each wanted rank, the next counts the values below them and keeps only those
    between, about one in 1,700. These are counted by value before the shuffle, and the
    sorted counts tell which values stand at the wanted ranks. Small columns, and tables
    of more groups than can be broadcast, count all their values.
    """
    columns, probabilities = list(columns), [float(p) for p in probabilities]
    value = {c: F.col(c).cast("double") for c in columns}
    edges = [min(max(e, 0.0), 1.0) for p in probabilities for e in (p - REACH, p + REACH)]
    near = durable(
        df.groupBy(*by).agg(
            *[F.count(c).alias(f"_n_{i}") for i, c in enumerate(columns)],
            *[F.percentile_approx(value[c], edges, ACCURACY).alias(f"_q_{i}") for i, c in enumerate(columns)],
        ),
        "near",
    )
    most = [F.coalesce(F.max(f"_n_{i}"), F.lit(0)) for i in range(len(columns))]
    groups, *sizes = near.agg(F.count(F.lit(1)), *most).first()
    largest = max(sizes, default=0)
    bracketed = largest > bracket_rows and groups <= MAX_PIECES

    def bracket(i: int, j: int) -> tuple[Column, Column]:
        """The values to look between; null where there is no limit."""
        wide = F.col(f"_n_{i}") > bracket_rows
        low, high = edges[2 * j] > 0, edges[2 * j + 1] < 1
        return (
            F.when(wide & F.lit(low), F.col(f"_q_{i}")[2 * j]),
            F.when(wide & F.lit(high), F.col(f"_q_{i}")[2 * j + 1]),
        )

    # a struct is never null, so that null groups are series like the others
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("all"))
    keys = ["_group", "column", "_rank"]
    if bracketed:
        brackets = [
            x.alias(f"_{side}_{i}_{j}")
            for i in range(len(columns)) for j in range(len(probabilities))
            for side, x in zip(("low", "high"), bracket(i, j), strict=True)
        ]
        values = [value[c].alias(f"_v_{i}") for i, c in enumerate(columns)]
        if by:
            limits = near.select(*[F.col(c).alias(f"_by_{c}") for c in by], *brackets)
            same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
            rows = df.select(*by, *values).join(F.broadcast(limits), same)
        else:  # one row of numbers
            limits = near.select(*brackets)
            one = limits.first()
            rows = df.select(*values, *[F.lit(one[c]).cast("double").alias(c) for c in limits.columns])
        places = [(i, j) for i in range(len(columns)) for j in range(len(probabilities))]
        below = rows.groupBy(group.alias("_group")).agg(
            *[F.count_if(F.col(f"_v_{i}") < F.col(f"_low_{i}_{j}")).alias(f"_b_{i}_{j}") for i, j in places]
        )
        inside = F.array(*[
            F.when(
                F.col(f"_v_{i}").isNotNull()
                & F.coalesce(F.col(f"_v_{i}") >= F.col(f"_low_{i}_{j}"), F.lit(True))
                & F.coalesce(F.col(f"_v_{i}") <= F.col(f"_high_{i}_{j}"), F.lit(True)),
                F.struct(F.lit(columns[i]).alias("column"), F.lit(j).alias("_rank"), F.col(f"_v_{i}").alias("value")),
            )
            for i, j in places
        ])
        picked = rows.select(group.alias("_group"), F.inline(F.array_compact(inside)))
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(len(probabilities) - 1)))
    if bracketed:
        counted = picked.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_times"))
    else:
        found = tall(df, columns, by).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("_times"))
        counted = found.select(group.alias("_group"), "column", F.lit(0).alias("_rank"), "value", "_times")
    if largest <= max_rows:  # then no column has more distinct values than that either
        sizes = Sizes(largest, largest, max_rows)
    else:
        counted = durable(counted, "counted")
        sizes = measure(counted, keys, max_rows)
    series = arrange(counted, keys, ("value",), (), sizes=sizes)
    ranked = series.running_sum("_times", "_upto").result()
    totals = near.select(
        group.alias("_group"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"_n_{i}").alias("_size")) for i, c in enumerate(columns)
        ])),
    )
    if bracketed:
        wide = below.select(
            "_group",
            F.inline(F.array(*[
                F.struct(F.lit(columns[i]).alias("column"), F.lit(j).alias("_rank"), F.col(f"_b_{i}_{j}").alias("_below"))
                for i, j in places
            ])),
        )
        wanted = totals.join(wide, ["_group", "column"])
    else:
        wanted = totals.select("*", every.alias("_rank"), F.lit(0).cast("long").alias("_below"))
        ranked = ranked.drop("_rank")
    p = F.element_at(F.array(*map(F.lit, probabilities)), F.col("_rank") + 1)
    wanted = wanted.filter(F.col("_size") > 0).withColumns({"probability": p, "_at": (F.col("_size") - 1) * p})
    on = keys if bracketed else keys[:2]
    few = groups * len(columns) * len(probabilities) <= MAX_PIECES
    joined = ranked.join(F.broadcast(wanted) if few else wanted, on)
    upto = F.col("_below") + F.col("_upto")
    first = upto - F.col("_times")  # 0-based rank of the first copy

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < upto), F.col("value")))

    low = F.col("_low")
    picks = joined.groupBy(*keys, "probability", "_at").agg(
        at(F.floor("_at")).alias("_low"), at(F.ceil("_at")).alias("_high")
    )
    result = low + (F.col("_high") - low) * (F.col("_at") - F.floor("_at"))
    return picks.select(*[F.col("_group")[c].alias(c) for c in by], "column", "probability", result.alias("value"))


def medians(df: DataFrame, columns: Sequence[str], max_rows: int = MAX_ROWS) -> DataFrame:
    """``column``, ``median`` of every column that has a value."""
    found = exact_quantiles(df, columns, [0.5], max_rows=max_rows)
    return found.select("column", F.col("value").alias("median"))
