"""Tables written to the folder that all executors share, and joins with small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.tables import discard, shared_dir, written

#: Rows up to which a table is broadcast; beyond it the join is left to shuffles.
BROADCAST_ROWS = 20_000


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join that broadcasts ``small`` only when a count shows it has at most ``most`` rows."""
    held = small.select([F.col(c).alias(f"__{c}") for c in on] + [c for c in small.columns if c not in on])
    fits = len(held.limit(most + 1).select(F.lit(1)).take(most + 1)) <= most
    same = [left[c].eqNullSafe(held[f"__{c}"]) for c in on]
    return left.join(F.broadcast(held) if fits else held, same, how).drop(*[f"__{c}" for c in on])


def join_counted(left: DataFrame, counted: DataFrame, on: list[str], n: str, share: int = 1000, least: int = 1000) -> DataFrame:
    """Inner join with a table that has each key ``on`` once and in ``n`` how many rows of ``left`` have it.

    Keys with more than one row in ``share`` of all (and more than ``least``), at most
    ``share`` of them, are broadcast, so no task gets all rows of a hot key; the others meet by sort and merge.
    ``counted`` is read several times and should be a written table.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(least, total // share)
    others = [c for c in counted.columns if c not in on]
    few = counted.filter(hot).select(*[F.col(c).alias(f"__{c}") for c in counted.columns])
    same = [left[c] == few[f"__{c}"] for c in on]
    cold = left.join(F.broadcast(few.select([f"__{c}" for c in on])), same, "left_anti").join(counted.filter(~hot).hint("merge"), on).select(*left.columns, *others)
    warm = left.join(F.broadcast(few), same).select(*left.columns, *[F.col(f"__{c}").alias(c) for c in others])
    return cold.unionByName(warm)


__all__ = ["discard", "join_counted", "join_small", "shared_dir", "written"]
