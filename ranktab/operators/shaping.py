"""Column alignment, replication and appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranktab.schema import MISSPELT


def fix_spelling(df: DataFrame) -> DataFrame:
    """Rename misspelt columns; a no-op where they are absent."""
    return df.withColumnsRenamed({k: v for k, v in MISSPELT.items() if k in df.columns})


def align_columns(df: DataFrame | None, target: list[str]) -> DataFrame | None:
    """Keep the columns that ``target`` names, in its order."""
    if df is None:
        return None
    return df.select(*[F.col(f"`{c}`") for c in target if c in df.columns])


def add_missing_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add only the columns that are not there yet."""
    return df.withColumns({name: e for name, e in new.items() if name not in df.columns})


def combine_frames(
    current: DataFrame | None, new: DataFrame | None, key: str
) -> DataFrame | None:
    """The same for two frames of one key: columns of ``new`` that ``current`` lacks."""
    if current is None or new is None:
        return new if current is None else current
    extra = [c for c in new.columns if c not in current.columns]
    if not extra:
        return current
    return current.join(new.select(key, *extra), key, "left")


def replicate(df: DataFrame, times: int, out: str = "copy") -> DataFrame:
    """Every row ``times`` times, numbered from 0; narrow, nothing is shuffled."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(out))


def expand_training(
    train: DataFrame,
    aux: DataFrame | None = None,
    train_times: int = 3,
    aux_times: int = 2,
) -> DataFrame:
    """Replicated training rows, then replicated auxiliary rows.

    Auxiliary columns that training lacks are dropped, missing ones are NULL.
    """
    expanded = replicate(train, train_times)
    if aux is None:
        return expanded
    more = replicate(align_columns(aux, train.columns), aux_times)
    return expanded.unionByName(more, allowMissingColumns=True)
