"""Small column-expression helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, BooleanType


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c) -> Column:
    return col(c).cast("double")


def sdiv(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(dbl(a), dbl(b))


def rnd(c, d: int) -> Column:
    return F.round(dbl(c), d)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns in schema order (booleans count as non-numeric)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType)
            and f.name not in exclude]


def non_numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    num = set(numeric_columns(df))
    return [f.name for f in df.schema.fields if f.name not in num and f.name not in exclude]


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """Fold NaN into NULL so aggregates treat both as missing."""
    cols = cols if cols is not None else [f.name for f in df.schema.fields
                                          if f.dataType.typeName() in ("double", "float")]
    return df.select(*[
        (F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c) if c in cols else F.col(c))
        for c in df.columns])


def unpivot_numeric(df: DataFrame, ids: list[str], features: list[str],
                    feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Long form (ids..., feature, value DOUBLE); one row per input row and feature."""
    casted = df.select(*ids, *[dbl(c).alias(c) for c in features])
    return casted.unpivot(ids, features, feature_col, value_col)


def unpivot_string(df: DataFrame, ids: list[str], features: list[str],
                   feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    casted = df.select(*ids, *[col(c).cast("string").alias(c) for c in features])
    return casted.unpivot(ids, features, feature_col, value_col)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys come from ``left``."""
    named = {k: f"_right_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(named)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[r]) for k, r in named.items()])
    return left.join(right, cond, how).drop(*named.values())


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a global aggregate (exactly one row) to every row.

    ``one_row`` must be the result of an ungrouped ``agg``; it is broadcast,
    so each row of ``df`` meets exactly one partner.
    """
    return df.join(F.broadcast(one_row), how="cross")
