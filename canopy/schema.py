"""Kinds of input, told from the schema, and checks of values done in one aggregate query."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class InputKind(Enum):
    SETS = "sets"  # (id, on ARRAY<integer>): members or set bits
    STRINGS = "strings"  # (id, tokens ARRAY<STRING>)
    DENSE = "dense"  # (id, v ARRAY<FLOAT or DOUBLE>)
    MATRIX = "matrix"  # (i, j, d): precomputed distances


METRICS = ("jaccard", "cosine", "euclidean", "precomputed")


def kind_of(df: DataFrame) -> InputKind:
    """The kind of a dataset's second column; (i, j, d) is a matrix of distances."""
    if {"i", "j", "d"} <= set(df.columns):
        return InputKind.MATRIX
    field = df.schema.fields[1]
    if not isinstance(field.dataType, T.ArrayType):
        raise TypeError(f"{field.name} is {field.dataType.simpleString()}; an array is needed")
    element = field.dataType.elementType
    if isinstance(element, T.StringType):
        return InputKind.STRINGS
    if isinstance(element, (T.FloatType, T.DoubleType)):
        return InputKind.DENSE
    if isinstance(element, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return InputKind.SETS
    raise TypeError(f"arrays of {element.simpleString()} are no input")


def check(df: DataFrame, kind: InputKind, width: int | None = None) -> int:
    """Number of rows; raises ValueError if values break the kind's rules or ids repeat."""
    c = F.col(df.columns[1])
    bad = {
        InputKind.SETS: F.exists(c, lambda x: x.isNull() | (x < 0)),
        InputKind.STRINGS: F.exists(c, lambda x: x.isNull()),
        InputKind.DENSE: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
        InputKind.MATRIX: F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf")) if kind is InputKind.MATRIX else F.lit(False),
    }[kind]
    size = F.lit(0) if kind is InputKind.MATRIX else F.size(c)
    id_col = df.columns[0]
    n, broken, low, high, ids = df.agg(F.count(F.lit(1)), F.sum(bad.cast("long")), F.min(size), F.max(size), F.count_distinct(id_col)).first()
    if broken:
        raise ValueError(f"{broken} rows have values that {kind.value} can't have")
    if kind is InputKind.DENSE and low != high:
        raise ValueError(f"vectors have {low} to {high} elements")
    if width is not None and kind is InputKind.DENSE and n and high != width:
        raise ValueError(f"vectors have {high} elements; the model has {width}")
    if kind is not InputKind.MATRIX and ids != n:
        raise ValueError("ids must be unique and not null")
    return n


def binary_sets(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, on)`` from 0/1 vectors; any other value is an error."""
    v = F.col(vec_col)
    ok = F.forall(v, lambda x: x.isin(0, 1))
    on = F.filter(F.transform(v, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return df.select(F.col(id_col).alias("id"), F.when(ok, on).otherwise(F.raise_error(F.lit("binary input must hold only 0 and 1"))).alias("on"))
