"""Settings: lines of NAME=value (S9), and what a run says about itself (K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Names whose values a report never shows.
SECRET = "(?i)(^|_)(key|token|secret|password)$"


def pairs(lines: DataFrame) -> DataFrame:
    """(name, value) of lines (column value). Comments, blanks and lines without "=" are passed over; double, then single quotes
    around a value go; names that are set already, elsewhere, are the caller's to keep (a left join)."""
    line = strip(F.regexp_replace("value", "^﻿", ""))
    value = F.regexp_replace(strip(F.substring(line, F.instr(line, "=") + 1, F.length(line))), '^"+|"+$', "")
    rows = lines.where(~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("=")))
    out = rows.select(strip(F.substring_index(line, "=", 1)).alias("name"), F.regexp_replace(value, "^'+|'+$", "").alias("value"))
    return out.where("name != ''")


def masked(name: Column, value: Column) -> Column:
    """A setting as reports show it."""
    return F.when(name.rlike(SECRET), "***").otherwise(value)


def report(settings: Column, usage: Column) -> Column:
    """K6: a run's JSON of settings (map of texts, secrets masked) and usage (map of numbers)."""
    return F.to_json(F.struct(F.transform_values(settings, masked).alias("settings"), usage.alias("usage")))
