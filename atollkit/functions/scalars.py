"""Scalar functions of planning data, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """Lower case; space, - and / become _. Null stays null."""
    return F.translate(F.lower(c), " -/", "___")


def replace_chars(c: Column) -> Column:
    """ASCII punctuation out, each run of white space one _, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[!-/:-@\[-`{-~]", ""), r"\s+", "_"))


def safe_project_name(c: Column) -> Column:
    """Trimmed, spaces become _; case is kept."""
    return F.translate(F.trim(c), " ", "_")


def format_eunis(c: Column) -> Column:
    """The first word, cut at a colon; null and empty stay."""
    return F.split_part(F.split_part(F.trim(c), F.lit(" "), F.lit(1)), F.lit(":"), F.lit(1))


def stable_id(c: Column, digits: int = 6) -> Column:
    """The first hexadecimal digits of the SHA-1 as an integer."""
    return F.conv(F.substring(F.sha1(c.cast("binary")), 1, digits), 16, 10).cast("long")


def sensitivity_score(c: Column) -> Column:
    """Low 1, Medium 2, High 3, all else and null 0."""
    return F.when(c == "Low", 1).when(c == "Medium", 2).when(c == "High", 3).otherwise(0)


def scale_level(res: Column, variant: str = "standard") -> Column:
    """Scale of a resolution. standard: to 6 basin, 7 regional, else local; coarse: to 2 basin, 3 to 5 regional, else local."""
    if variant not in ("standard", "coarse"):
        raise ValueError(f"unknown variant {variant!r}")
    low, high = (6, 7) if variant == "standard" else (2, 5)
    return F.when(res <= low, "basin").when(res <= high, "regional").otherwise("local")


def grid_name(area: Column, res: Column) -> Column:
    return F.concat(F.lit("v_h3_"), normalize_name(area), F.lit("_res"), res.cast("string"))


def fmt_date(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yy HH:mm:ss")


def area_from_alias(alias: Column) -> Column:
    """What stands before ' (', trimmed, lower case: joins a grid's alias with a cell's area."""
    return F.lower(F.trim(F.split_part(alias, F.lit(" ("), F.lit(1))))


def unique_feature_name(prefix: str, key: Column) -> Column:
    """prefix and a digest of the key, 32 characters in all; the same key gives the same name."""
    return F.concat(F.lit(prefix), F.substring(F.md5(key.cast("binary")), 1, 32 - len(prefix)))


def bool_text(c: Column) -> Column:
    return F.when(c == "True", True).when(c == "False", False)


def hex_edge_from_area(a: Column) -> Column:
    return F.sqrt(a / (1.5 * math.sqrt(3)))


def hex_width_from_area(a: Column) -> Column:
    return F.sqrt(2 * a / math.sqrt(3))


def square_width_from_area(a: Column) -> Column:
    return F.sqrt(a)


def hex_radius_from_count(n: Column, low: Column, high: Column) -> Column:
    return (high - low) / n / math.sqrt(3)


def null_if_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


#: Texts for missing grid metadata.
METADATA_DEFAULTS = {"description": "No description", "domain": "Unknown domain", "area": "Unknown area", "creation_date": "Unknown date", "created_by": "Unknown", "country": "Unknown"}


def metadata_defaults(df: DataFrame) -> DataFrame:
    """Defaults for missing metadata; a missing alias becomes the grid's name."""
    made = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in METADATA_DEFAULTS.items() if c in df.columns}
    if "alias" in df.columns:
        made["alias"] = F.coalesce("alias", "feature_class_name")
    return df.withColumns(made)
