"""Helpers that work inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer may copy a projected expression into a filter or a lambda
    that uses it, which repeats costly array work per element.  A generator
    of one row is not copied.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(one))


def keep_first(df: DataFrame, items: Column, key, out: str) -> DataFrame:
    """Add ``out``: ``items`` without later elements whose key came before.

    Sorts by (key, position), keeps the first of each run, and restores the
    order.  ``key`` maps an element to its key.
    """
    tagged = F.transform(
        items, lambda x, i: F.struct(key(x).alias("k"), i.alias("pos"), x.alias("item"))
    )
    rank = fresh("_sorted", df.columns)
    df = settle(df, **{rank: F.sort_array(tagged)})
    runs = F.filter(
        F.col(rank),
        lambda e, i: (i == 0) | (F.get(rank, i - 1)["k"] != e["k"]),
    )
    ordered = F.sort_array(F.transform(runs, lambda e: F.struct(e["pos"], e["item"])))
    return settle(df, **{out: F.transform(ordered, lambda e: e["item"])}).drop(rank)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
