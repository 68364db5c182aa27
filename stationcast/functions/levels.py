"""Ladders that turn a predicted value into words.

The three ladders treat their edges differently, on purpose: a category closes
its upper edge, a risk level closes its lower edge, and a report level covers
whole numbers only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category by upper edge, with its badge.
CATEGORIES = [
    (50.0, "Baik", "success"),
    (100.0, "Sedang", "warning"),
    (150.0, "Tidak Sehat", "orange"),
    (None, "Sangat Tidak Sehat", "danger"),
]

# Risk level by lower edge, with its colour.
RISKS = [
    (150.0, "Kritis", "danger"),
    (100.0, "Tinggi", "orange"),
    (50.0, "Sedang", "warning"),
    (None, "Rendah", "success"),
]

# Advice shown for each risk level.
RECOMMENDATIONS = {
    "Kritis": "Hindari semua aktivitas di luar ruangan. Tutup jendela dan gunakan pembersih udara.",
    "Tinggi": "Kurangi aktivitas di luar ruangan. Kelompok rentan sebaiknya tetap di dalam ruangan. Gunakan masker jika harus keluar.",
    "Sedang": "Kelompok sensitif (lansia, anak-anak) sebaiknya membatasi aktivitas fisik di luar ruangan.",
    "Rendah": "Kualitas udara baik. Nikmati aktivitas di luar ruangan dengan normal.",
}

# Confidence by upper edge of std / prediction: level, text, badge, percent.
CONFIDENCES = [
    (0.1, "Tinggi", "Model sangat yakin dengan prakiraan ini.", "success", 90),
    (0.25, "Sedang", "Model memiliki keyakinan yang cukup.", "primary", 60),
    (None, "Rendah", "Prakiraan memiliki ketidakpastian tinggi. Harap waspada.", "secondary", 30),
]

# Report levels as closed ranges of the actual value.
REPORT_LEVELS = [
    (0.0, 50.0, "Good"),
    (51.0, 100.0, "Moderate"),
    (101.0, 150.0, "Unhealthy"),
    (151.0, None, "Very Unhealthy"),
]

# Trend words, dead band of 5 either way.
TREND_BAND = 5.0
TREND_TEXT = {"Rising": "Naik", "Falling": "Turun", "Stable": "Stabil"}


def _ladder(steps: Sequence[tuple[Column | None, object]]) -> Column:
    """First true condition wins; the step without a condition is the rest."""
    out = None
    for condition, value in steps:
        if condition is None:
            return out.otherwise(F.lit(value))
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out


def _upto(value: Column, part: int) -> Column:
    return _ladder([(None if s[0] is None else value <= s[0], s[part]) for s in CATEGORIES])


def category(value: Column) -> Column:
    """A missing value falls through to the last step."""
    return _upto(value, 1)


def category_badge(value: Column) -> Column:
    return _upto(value, 2)


def _from(value: Column, part: int) -> Column:
    return _ladder([(None if s[0] is None else value >= s[0], s[part]) for s in RISKS])


def risk_level(value: Column) -> Column:
    """A missing value falls through to the lowest level."""
    return _from(value, 1)


def risk_color(value: Column) -> Column:
    return _from(value, 2)


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def recommendation(level: Column) -> Column:
    return _lookup(RECOMMENDATIONS, level)


def trend_direction(change: Column) -> Column:
    return _ladder(
        [(change > TREND_BAND, "Rising"), (change < -TREND_BAND, "Falling"), (None, "Stable")]
    )


def trend_text(direction: Column) -> Column:
    return _lookup(TREND_TEXT, direction)


def confidence_ratio(value: Column, std: Column) -> Column:
    """Residual spread relative to the prediction, which counts as 1 at least.

    Null whenever either side is null (``greatest`` alone would skip a null).
    """
    return F.when(value.isNotNull(), F.try_divide(std, F.greatest(value, F.lit(1.0))))


def _confidence(value: Column, std: Column, part: int) -> Column:
    ratio = confidence_ratio(value, std)
    return _ladder([(None if s[0] is None else ratio < s[0], s[part]) for s in CONFIDENCES])


def confidence_level(value: Column, std: Column) -> Column:
    return _confidence(value, std, 1)


def confidence_text(value: Column, std: Column) -> Column:
    return _confidence(value, std, 2)


def confidence_badge(value: Column, std: Column) -> Column:
    return _confidence(value, std, 3)


def confidence_percent(value: Column, std: Column) -> Column:
    return _confidence(value, std, 4)


def report_level(actual: Column, contiguous: bool = False) -> Column:
    """Level of an actual value; null in the gaps between the whole-number ranges.

    ``contiguous`` closes the gaps by using the upper edges only.
    """
    if contiguous:
        return _ladder(
            [(actual.isNull(), None)]
            + [(None if hi is None else actual <= hi, name) for _, hi, name in REPORT_LEVELS]
        )
    out = None
    for low, high, name in REPORT_LEVELS:
        inside = actual >= low if high is None else actual.between(low, high)
        out = F.when(inside, F.lit(name)) if out is None else out.when(inside, F.lit(name))
    return out


def risk_columns(value: Column, std: Column, last_actual: Column) -> dict[str, Column]:
    """The whole risk record of one forecast, as columns."""
    change = value - last_actual
    level = risk_level(value)
    return {
        "level": level,
        "color": risk_color(value),
        "recommendation": recommendation(level),
        "trend_val": change,
        "trend_dir": trend_direction(change),
        "conf_level": confidence_level(value, std),
        "conf_desc": confidence_text(value, std),
        "conf_badge": confidence_badge(value, std),
        "ci_width": std * 2,
    }
