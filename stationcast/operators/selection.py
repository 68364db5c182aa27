"""Choosing and ranking models from the comparison table (one row per model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

# Report figure -> (column, smaller is better).
BEST_BY = {
    "best_test_mae": ("test_mae", True),
    "best_test_r2": ("test_r2", False),
    "best_test_mape": ("test_mape", True),
    "most_consistent": ("cv_std", True),
}
RANKED = {"test_mae": True, "test_rmse": True, "test_r2": False, "test_mape": True}
# Decimals of the short table.
SHORT_PLACES = {"mae": ("test_mae", 2), "r2": ("test_r2", 3), "mape": ("test_mape", 1)}


def _tie(table: DataFrame) -> str:
    """Configuration order when the table has it, else the name."""
    return "rank" if "rank" in table.columns else "model"


def best_per_metric(table: DataFrame) -> DataFrame:
    """``criterion``, ``model``, ``value``; criteria without any value are absent."""
    tie = F.col(_tie(table))
    picks = []
    for name, (column, smaller) in BEST_BY.items():
        value = F.col(column) if smaller else -F.col(column)
        known = F.when(F.col(column).isNotNull(), F.struct(value.alias("v"), tie.alias("t")))
        row = F.struct(F.col("model"), F.col(column).alias("value"))
        picks.append(F.min_by(row, known).alias(name))
    one = table.agg(*picks)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("criterion"), F.col(n)["model"].alias("model"), F.col(n)["value"].alias("value"))
            for n in BEST_BY
        ]
    )
    return one.select(F.inline(rows)).filter(F.col("value").isNotNull())


def selection_score() -> Column:
    """Test error plus spread over the folds; the test error alone without folds."""
    return F.when(F.col("cv_mae").isNotNull(), F.col("test_mae") + F.col("cv_std")).otherwise(
        F.col("test_mae")
    )


def select_best(table: DataFrame) -> DataFrame:
    """The model with the smallest score, or no row for an empty table."""
    scored = table.withColumn("score", selection_score()).filter(F.col("score").isNotNull())
    return scored.orderBy("score", _tie(table)).limit(1)


def rank_models(table: DataFrame) -> DataFrame:
    """``metric``, ``model``, ``value``, ``place``: best first in each metric."""
    tie = _tie(table)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("metric"),
                F.col(c).alias("value"),
                (F.col(c) if smaller else -F.col(c)).alias("_key"),
            )
            for c, smaller in RANKED.items()
        ]
    )
    keep = list(dict.fromkeys(["model", tie]))
    long = table.select(*keep, F.inline(rows)).filter(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("metric").orderBy("_key", tie))
    return long.withColumn("place", place).select("metric", "model", "value", "place")


def metric_bars(table: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 of both sides, one row per bar."""
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.lit(s).alias("side"), F.col(f"{s}_{m}").alias("value"))
            for m in ("mae", "rmse", "r2")
            for s in ("train", "test")
        ]
    )
    return table.select("model", F.inline(rows))


def report_table(table: DataFrame, places: int = 4) -> DataFrame:
    figures = [c for c in table.columns if c not in ("model", "rank")]
    return table.withColumns({c: numbers.report_round(F.col(c), places) for c in figures})


def short_table(table: DataFrame) -> DataFrame:
    """Test MAE, R2 and MAPE with two, three and one decimals."""
    return table.select(
        "model",
        *[numbers.report_round(F.col(c), d).alias(n) for n, (c, d) in SHORT_PLACES.items()],
    )


def detailed_table(table: DataFrame) -> DataFrame:
    """Rows Training, Testing and Cross-Validation per model, with verdicts."""
    null = F.lit(None).cast("double")

    def row(name: str, figures: list[Column], std: Column) -> Column:
        names = ("mae", "rmse", "r2", "mape")
        return F.struct(
            F.lit(name).alias("dataset"),
            *[c.alias(n) for n, c in zip(names, figures)],
            std.alias("mae_std"),
        )

    rows = F.array(
        row("Training", [F.col(f"train_{m}") for m in ("mae", "rmse", "r2", "mape")], null),
        row("Testing", [F.col(f"test_{m}") for m in ("mae", "rmse", "r2", "mape")], null),
        row("Cross-Validation", [F.col("cv_mae"), null, null, null], F.col("cv_std")),
    )
    return table.select(
        "model",
        numbers.r2_verdict(F.col("test_r2")).alias("r2_verdict"),
        numbers.fit_gap_verdict(F.col("train_mae"), F.col("test_mae")).alias("fit_verdict"),
        F.inline(rows),
    ).filter(F.col("mae").isNotNull())
