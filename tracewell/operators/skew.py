"""Equi-joins that survive hot keys.

A task's share is R = max(`HOT_ROWS`, 1/`HOT_SHARE` of the probe rows). A key of
more than R rows is hot; there are fewer than `HOT_SHARE` of them whatever the
data, so that list is bounded, and it is the only thing that is broadcast. A hot
key of n probe rows is spread over ceil(n / R) tasks, and its (small) build rows
are repeated as often: fewer than 2 `HOT_SHARE` repetitions over all keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import distinct_names

HOT_SHARE = 1 << 16
#: Below this many probe rows for a key no task is at risk, and a key is not salted.
HOT_ROWS = 50_000


def hot_keys(counts: DataFrame, keys: list[str], count: str = "n", salts: str = "_salts") -> DataFrame:
    """Hot keys and over how many tasks each is spread, from per-key counts."""
    share = F.greatest(F.lit(HOT_ROWS), F.ceil(counts.agg(F.sum(count) / HOT_SHARE).scalar()))
    return counts.where(F.col(count) > share).select(*keys, F.ceil(F.col(count) / share).cast("int").alias(salts))


def skew_join(
    probe: DataFrame,
    build: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """`probe` joined to `build` on `keys`, which are few per key on the build side.

    `spread`: an expression over probe columns that differs within a hot key.
    `counts`: rows of each key of the probe side as (keys, n), where known.
    `how`: inner, left, left_semi or left_anti, seen from the probe side. Null
    keys match nothing.
    """
    if counts is None:
        counts = probe.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    name = distinct_names([*probe.columns, *build.columns], ["_salts", "_salt"])
    salts, salt = name["_salts"], name["_salt"]
    hot = hot_keys(counts, keys, salts=salts)
    many = F.coalesce(F.col(salts), F.lit(1))
    left = probe.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(F.xxhash64(spread), many).cast("int")).drop(salts)
    right = build.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), many - 1))).drop(salts)
    return left.join(right, [*keys, salt], how).drop(salt)
