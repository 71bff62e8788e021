"""Symbol tables: label, symbol rows, label 0 being epsilon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = "<eps>"


class SymbolConflict(ValueError):
    pass


def symbol_table(df: DataFrame, symbol: str, order: str) -> DataFrame:
    """label, symbol: labels from 1 in the order in which symbols first occur. The vocabulary, not the rows, is sorted."""
    first = df.filter(F.col(symbol).isNotNull()).groupBy(F.col(symbol).alias("symbol")).agg(F.min(order).alias("o")).filter(F.col("symbol") != EPSILON)
    labels = first.select(F.row_number().over(Window.orderBy("o", "symbol")).cast("long").alias("label"), "symbol")
    return df.sparkSession.createDataFrame([(0, EPSILON)], "label long, symbol string").unionByName(labels)


def add_symbol(table: DataFrame, symbol: str, label: int | None = None) -> DataFrame:
    """The table with one more symbol, at the next label or a given one; a label or symbol that means something else is an error."""
    same = table.filter((F.col("symbol") == symbol) | (F.col("label") == (-1 if label is None else label))).collect()
    if any(r["symbol"] == symbol and label in (None, r["label"]) for r in same) and len(same) == 1:
        return table
    if same:
        raise SymbolConflict(f"{symbol!r} and label {label} don't go together")
    at = label if label is not None else table.agg(F.max("label")).first()[0] + 1
    return table.unionByName(table.sparkSession.createDataFrame([(at, symbol)], "label long, symbol string"))


def with_labels(df: DataFrame, table: DataFrame, symbol: str, to: str = "label") -> DataFrame:
    return df.join(table.select(F.col("symbol").alias(symbol), F.col("label").alias(to)), symbol, "left")


def with_symbols(df: DataFrame, table: DataFrame, label: str, to: str = "symbol") -> DataFrame:
    return df.join(table.select(F.col("label").alias(label), F.col("symbol").alias(to)), label, "left")
