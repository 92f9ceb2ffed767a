"""Joins whose hot keys are dealt to several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def met(rows: DataFrame, side: DataFrame, key: str, salt: list[str]) -> DataFrame:
    """``rows`` joined with ``side``, which has each ``key`` once: rows of a key are dealt to ``SALTS`` tasks by ``salt``, since a hub or a component may hold a third of them."""
    dealt = rows.withColumn("_s", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    return dealt.join(side.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_s"]).drop("_s")


__all__ = ["SALTS", "met"]
