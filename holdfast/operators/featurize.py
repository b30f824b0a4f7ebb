"""Typing raw columns as features in one projection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import assign_value, clean_numeric, map_category, to_boolean


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns to retype, in place.

    flags: column -> value that means True; categories: column -> {category: number};
    amounts: column -> number that replaces blanks.
    """

    flags: Mapping[str, Any] = field(default_factory=dict)
    categories: Mapping[str, Mapping[Any, Any]] = field(default_factory=dict)
    amounts: Mapping[str, float] = field(default_factory=dict)

    def columns(self) -> dict[str, Column]:
        names = [*self.flags, *self.categories, *self.amounts]
        if len(names) != len(set(names)):
            raise ValueError("a column appears under more than one rule")
        return {
            **{name: to_boolean(name, value) for name, value in self.flags.items()},
            **{name: map_category(name, mapping) for name, mapping in self.categories.items()},
            **{name: clean_numeric(name, value) for name, value in self.amounts.items()},
        }


def featurize(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Apply every rule of the spec in one projection; other columns pass through."""
    return df.withColumns(spec.columns())


def assign_where(df: DataFrame, mask: Column, column: str, value: Any) -> DataFrame:
    """Overwrite ``column`` with ``value`` on the rows the mask selects, keeping the column's type.

    A value of another type is refused here: the mixed CASE would otherwise fail, or change the column, at run time.
    """
    assigned = value if isinstance(value, Column) else F.lit(value)
    old = df.schema[column].dataType
    new = df.select(assigned.alias("value")).schema["value"].dataType
    if new != old and value is not None:
        raise TypeError(f"{column} is {old.simpleString()}, the assigned value is {new.simpleString()}")
    return df.withColumn(column, assign_value(column, mask, assigned))
