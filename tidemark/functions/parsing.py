"""Scalar expressions: text to typed values, keys, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts a CSV reader takes for "missing" in any column.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Placeholders for "no reading" in a feature column.
PLACEHOLDERS = ["--", "*"]
# Plain decimal numbers; keeps Java-only spellings such as '1d' or 'Infinity' out.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number, placeholders included, becomes null."""
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def finite(c: Column) -> Column:
    """Numeric column as double with NaN and infinities turned into null."""
    number = c.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def to_obs_time(c: Column) -> Column:
    """Text to a zone-less timestamp; ISO, ``yyyy/M/d H:mm`` and ``yyyyMMdd`` forms."""
    text = F.translate(F.trim(c), "/", "-")
    compact = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return compact.try_cast("timestamp_ntz")


def safe_key(c: Column) -> Column:
    """Name usable as a file or directory name."""
    return F.translate(c, "/\\:", "___")


def series_key(station: Column, feature: Column) -> Column:
    return F.concat_ws("_", station, feature)


def series_label(station: Column, feature: Column) -> Column:
    return F.concat_ws("-", station, feature)


def has_step(c: Column) -> Column:
    """Null-safe test for the rows of a single forecast step."""
    return F.coalesce(F.contains(c, F.lit("Step")), F.lit(False))


def step_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"Step(\d+)", 1), F.lit("")).try_cast("int")


def model_from_path(c: Column) -> Column:
    """``…/arima_ann_metrics.csv`` -> ``arima_ann``; null for other files."""
    return F.nullif(F.regexp_extract(c, r"([^/]+)_metrics[^/]*(/part-[^/]*)?$", 1), F.lit(""))


def fixed(c: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", c)


def is_significant(p: Column, alpha: float = 0.05) -> Column:
    return p < F.lit(alpha)


def order_hint(stationary: Column) -> Column:
    """Suggested ARIMA order ranges from the stationarity verdict."""

    def hint(p_min, p_max, d, q_min, q_max):
        parts = dict(p_min=p_min, p_max=p_max, d=d, q_min=q_min, q_max=q_max)
        return F.struct(*[F.lit(v).alias(k) for k, v in parts.items()])

    return F.when(stationary, hint(1, 3, 0, 1, 2)).when(~stationary, hint(1, 2, 1, 1, 1))
