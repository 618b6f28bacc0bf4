"""What a column is: target, id, datetime, boolean, numeric, text or categorical; and whether its extremes matter."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from quartzite.plans.config import CleanOptions
from quartzite.plans.stats import ColumnStats, is_integer, is_number, is_text, is_time

# Names of label columns, of identifiers, and of quantities whose extremes are the point.
TARGET_NAMES = {"target", "label", "labels", "y", "outcome", "class", "classlabel"}
ID_NAME = re.compile(r"(?:^|[_\s])(?:id|uuid|guid|key)s?$|^(?:id|index|pk)$", re.I)
SENSITIVE_NAME = re.compile(r"fraud|anomal|aqi|pm2|pm10|ozone|temperature|temp_|price|amount|balance|salary|income|level|risk|score", re.I)
LEAST_UNIQUE = 20


def is_target(name: str, options: CleanOptions) -> bool:
    folded = re.sub(r"[\s_]", "", name).lower()
    return name == options.target_column or folded in TARGET_NAMES or bool(re.search(r"_(?:target|label)$", name, re.I))


def looks_like_text(s: ColumnStats) -> bool:
    return (s.length or 0) > 25 or ((s.spaces or 0) >= 3 and s.n > 0 and (s.distinct or 0) / s.n > 0.6)


def role(s: ColumnStats, options: CleanOptions) -> str:
    unique = s.n >= LEAST_UNIQUE and s.distinct == s.n
    if is_target(s.name, options):
        return "target"
    if s.name in options.id_columns or ID_NAME.search(s.name):
        return "id"
    if is_time(s.dtype):
        return "datetime"
    if isinstance(s.dtype, T.BooleanType):
        return "boolean"
    if is_number(s.dtype):
        return "id" if is_integer(s.dtype) and unique else "numeric"
    if is_text(s.dtype):
        return "text" if looks_like_text(s) else "id" if unique else "categorical"
    return "text"


def sensitive(name: str) -> bool:
    return bool(SENSITIVE_NAME.search(name))
