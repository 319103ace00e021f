"""Column-set operators: flatten, drop, rename, null normalisation, append."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trailmill.functions.numeric import not_nan


def quoted(*path: str) -> str:
    return ".".join(f"`{part}`" for part in path)


def without(*columns: str) -> str:
    """All columns but these, as one projection item."""
    return f"* EXCEPT ({', '.join(map(quoted, columns))})" if columns else "*"


def derive(df: DataFrame, new: Mapping[str, str]) -> DataFrame:
    """``df`` with the columns in ``new`` replaced or added, at the end.

    One projection: every expression sees the columns as they were.
    """
    replaced = [c for c in df.schema.names if c in new]
    return df.selectExpr(without(*replaced), *[f"{x} AS {quoted(c)}" for c, x in new.items()])


def _leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    for field in schema.fields:
        path = (*prefix, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, path)
        else:
            yield path


def flatten_structs(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every nested struct field as its own column; arrays stay as they are."""
    return df.selectExpr(
        *[f"{quoted(*path)} AS {quoted(separator.join(path))}" for path in _leaves(df.schema)]
    )


def drop_suffixed(df: DataFrame, suffix: str = "_str") -> DataFrame:
    return df.selectExpr(without(*[c for c in df.schema.names if c.endswith(suffix)]))


def title_headers(df: DataFrame) -> DataFrame:
    """``Total_Time`` becomes ``Total Time``."""
    return df.toDF(*[c.replace("_", " ").title() for c in df.schema.names])


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column; other columns untouched."""

    def clean(field: T.StructField) -> str:
        name = quoted(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            kind = field.dataType.simpleString()
            return f"cast({not_nan(name)} as {kind}) AS {name}"
        return name

    return df.selectExpr(*map(clean, df.schema.fields))


def append(pages: Iterable[DataFrame]) -> DataFrame:
    """Bag union by column name; columns a page lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Only the columns the target table has, in its order and types."""
    present = set(df.schema.names)
    return df.selectExpr(
        *[
            f"cast({quoted(f.name)} as {f.dataType.simpleString()}) AS {quoted(f.name)}"
            for f in target.fields
            if f.name in present
        ]
    )
