"""Joins against a side with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` to ``small`` whose keys are unique.

    Nothing runs while the plan is built: adaptive execution broadcasts the smaller side if its
    measured size allows and otherwise splits the partitions of hot keys.  ``how`` may be inner, left,
    left_semi or left_anti, which leave every row of ``big`` at most once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    return big.join(small, on, how)
