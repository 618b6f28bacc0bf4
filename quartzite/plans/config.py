"""Options of a clean, checked when made."""

from __future__ import annotations

import difflib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CleanOptions:
    column_names: bool = True
    strip_whitespace: bool = True
    normalize_sentinels: bool = True
    extra_sentinels: tuple[str, ...] = ()
    drop_empty_columns: bool = True
    drop_empty_rows: bool = True
    fix_dtypes: bool = True
    numeric_threshold: float = 0.9
    datetime_threshold: float = 0.9
    decimal: str = "."
    thousands: str = ","
    drop_constant_columns: bool = False
    drop_duplicates: bool = True
    duplicate_subset: tuple[str, ...] | None = None
    duplicate_keep: str = "first"
    duplicate_threshold: float = 0.10
    order_by: str | None = None
    time_index: str | None = None
    allow_timeseries_duplicates: bool = False
    strategy: str = "balanced"
    missing_threshold_low: float = 0.05
    missing_threshold_medium: float = 0.30
    missing_threshold_high: float = 0.60
    missing_indicators: bool | str = "auto"
    impute: str | None = None
    outliers: str | None = None
    outlier_action: str | None = "auto"
    outlier_method: str = "iqr"
    outlier_factor: float | None = None
    optimize_memory: bool = False
    category_threshold: float = 0.5
    preserve_columns: tuple[str, ...] = ()
    target_column: str | None = None
    id_columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        choices = {
            "strategy": ("conservative", "balanced", "aggressive"),
            "duplicate_keep": ("first", "last", "drop", "aggregate"),
            "impute": (None, "auto", "mean", "median", "mode"),
            "outliers": (None, "clip", "flag"),
            "outlier_action": (None, "auto", "cap", "remove", "flag"),
            "outlier_method": ("iqr", "zscore", "auto", "isolation_forest"),
        }
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        if not 0 <= self.missing_threshold_low <= self.missing_threshold_medium <= self.missing_threshold_high <= 1:
            raise ValueError("missing thresholds must rise from 0 to 1")
        if len(self.decimal) != 1 or len(self.thousands) != 1 or self.decimal == self.thousands:
            raise ValueError("decimal and thousands must be two different characters")
        if self.outlier_factor is not None and self.outlier_factor <= 0:
            raise ValueError("outlier_factor must be positive")

    @classmethod
    def of(cls, options: CleanOptions | None = None, **given) -> CleanOptions:
        known = {f.name for f in fields(cls)}
        for name in given:
            if name not in known:
                near = difflib.get_close_matches(name, known, 1)
                raise TypeError(f"unknown option {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return replace(options or cls(), **given)
