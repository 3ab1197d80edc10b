"""Dimension tables: latest rows, upserts, and lookups as left joins with at most one match."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order (a total one, for a repeatable result).

    Rows are combined before the shuffle, so a key with many changes stays one row of each task there.
    """
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row_"))
    return last.select(*key, "row_.*").select(*rows.columns)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The same without the columns of order."""
    return last_rows(rows, key, order).drop(*order)


def upserted(old: DataFrame, new: DataFrame, key: str, honour_deletes: bool = False) -> DataFrame:
    """old with the rows of new (one for each key, its kind in kind_) put in; deletes keep their row unless honoured."""
    stays = old.join(new.select(key), key, "left_anti")
    comes = new.where(F.col("kind_") != "delete") if honour_deletes else new
    return stays.select(*old.columns).unionByName(comes.select(*old.columns))


def one_for_each(dim: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key, the smallest by its other columns in their order: the same in every run."""
    rest = [c for c in dim.columns if c not in key]
    if not rest:
        return dim.distinct()
    return dim.groupBy(*key).agg(F.min(F.struct(*rest)).alias("row_")).select(*key, "row_.*").select(*dim.columns)


class Store(Protocol):
    """A dimension that finds the rows of given keys by itself, as sources.keyed.KeyedTable does."""

    key: str

    def rows_of(self, rows: DataFrame, column: str) -> DataFrame: ...

    def read(self) -> DataFrame: ...


def look_up(rows: DataFrame, dim: DataFrame | Store, on: dict[str, str], take: dict[str, Column], unique: bool = False) -> DataFrame:
    """rows with columns from the dimension row that matches on (column of rows -> key of dim).

    take: new or replaced column -> expression over the dimension; where no row matches, replaced columns stay and new
    ones are null. unique: dim has one row for each key already. A store is asked for the keys of rows, which are to be kept
    (persisted) where they cost much, and reads little else; on other columns than its key it is read whole.
    """
    if not isinstance(dim, DataFrame):
        column = next((c for c, k in on.items() if k == dim.key), None)
        dim, unique = (dim.rows_of(rows, column), len(on) == 1) if column else (dim.read(), False)
    d = dim if unique else one_for_each(dim, list(on.values()))
    d = d.select(*(F.col(k).alias(f"key_{i}_") for i, k in enumerate(on.values())), *(c.alias(f"take_{i}_") for i, c in enumerate(take.values())), F.lit(True).alias("met_"))
    kind = lambda c: rows.schema[c].dataType
    # a key of another type is made the rows' type once, in the dimension; what isn't such a value matches nothing
    d = d.withColumns({f"key_{i}_": F.col(f"key_{i}_").try_cast(kind(c)) for i, c in enumerate(on) if d.schema[f"key_{i}_"].dataType != kind(c)})
    same = [F.col(c) == F.col(f"key_{i}_") for i, c in enumerate(on)]
    joined = rows.join(d, same, "left")
    new = {n: F.when(F.col("met_"), F.col(f"take_{i}_")).otherwise(F.col(n)) if n in rows.columns else F.col(f"take_{i}_") for i, n in enumerate(take)}
    return joined.withColumns(new).select(*rows.columns, *(n for n in new if n not in rows.columns))
