"""From a user's table to model inputs: mapping, defaults and padding as column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.exprs import col
from tillwise.functions.vocab import FEATURE_DEFAULTS, MODEL_FEATURES


def number(df: DataFrame, c: str) -> Column:
    """Value as double, NULL when missing, empty or not a number."""
    kind = dict(df.dtypes)[c]
    return col(c).try_cast("double") if kind == "string" else col(c).cast("double")


def feature_default(feature: str, as_of: datetime.date) -> float:
    if feature == "month":
        return float(as_of.month)
    if feature == "quarter":
        return float((as_of.month - 1) // 3 + 1)
    return FEATURE_DEFAULTS.get(feature, 0.0)


def apply_mapping(df: DataFrame, mapping: dict[str, str | None], model_kind: str,
                  as_of: datetime.date, keep: tuple[str, ...] = ()) -> DataFrame:
    """Model inputs of every row.  ``_from_date:column`` reads month or quarter from a date."""
    out: list[Column] = [col(k) for k in keep]
    for f in MODEL_FEATURES[model_kind]:
        src, value = mapping.get(f), None
        if src and src.startswith("_from_date:"):
            name = src[len("_from_date:"):]
            if name in df.columns and f in ("month", "quarter"):
                d = col(name)
                if dict(df.dtypes)[name] == "string":
                    d = F.try_to_timestamp(d)
                value = (F.month(d) if f == "month" else F.quarter(d)).cast("double")
        elif src and src in df.columns:
            value = number(df, src)
        default = F.lit(feature_default(f, as_of))
        out.append((default if value is None else F.coalesce(value, default)).alias(f))
    return df.select(*out)


def pad_revenue_features(df: DataFrame, required: list[str], as_of: datetime.date) -> DataFrame:
    """Fill every revenue-model input that is absent or NULL."""
    def have(c, fallback):
        fb = F.lit(float(fallback))
        return F.coalesce(number(df, c), fb) if c in df.columns else fb

    price, margin = have("price", 0), have("gross_margin_pct", 0.3)
    discount = have("discount_percent", 0)
    share = F.when(margin > 1, margin / 100).otherwise(margin)
    weekday = as_of.weekday()
    fill = {
        "quantity_sold": have("quantity_sold", 1), "price": price, "discount_percent": discount,
        "seasonal_index": have("seasonal_index", 1.0), "gross_margin_pct": margin,
        "month": have("month", as_of.month), "quarter": have("quarter", (as_of.month - 1) // 3 + 1),
        "year": have("year", as_of.year), "week_of_year": have("week_of_year", as_of.isocalendar()[1]),
        "day_of_week": have("day_of_week", weekday),
        "is_weekend": have("is_weekend", 1 if weekday >= 5 else 0),
        "discounted_price": price * (1 - discount / 100), "cost_of_goods": price * (1 - share),
        "rating": F.lit(4.0), "review_count": F.lit(5.0),
    }
    padded = {}
    for f in required:
        default = fill.get(f, F.lit(0.0))
        padded[f] = F.coalesce(number(df, f), default) if f in df.columns else default
    return df.withColumns(padded)


def pad_zero_features(df: DataFrame, required: list[str]) -> DataFrame:
    """Absent, empty or unreadable inputs become 0."""
    zero = F.lit(0.0)
    return df.withColumns({
        f: F.coalesce(number(df, f), zero) if f in df.columns else zero for f in required})
