"""References to records that do not exist at the time of the reference.

Keys are range-partitioned in the space of their 64-bit hash, which spreads any
keys evenly. Each range holds its parents as arrays sorted by that hash; batches
of references are probed by a vectorised binary search, and a second hash of the
key settles equal first hashes. Only misses leave the probe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import squash_id
from tracewell.session import written

#: Lifetimes in one range's arrays: 4 arrays of 8 bytes, 3.2 MB in a Python worker.
RANGE_ROWS = 100_000
#: References a task probes, at most about; hot ranges are split into slices of this size.
SLICE_ROWS = 500_000
#: Stands for a missing time, which must not be null (see below).
TIMELESS = -(2**62)
#: A slice holds 1/MOST_SLICED of the references at least, so that the list of sliced ranges is bounded.
MOST_SLICED = 1 << 16
PROBED = "ref_table string, record_id string, target_key string, at_us long, reason string"


def wall_micros(c: Column) -> Column:
    """Microseconds since 1970 as the clock shows them, whatever the session's time zone."""
    t = c.cast("timestamp_ntz")
    day = F.unix_date(t.cast("date")).cast("long") * 86_400_000_000
    return day + F.hour(t).cast("long") * 3_600_000_000 + F.minute(t).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def parents(df: DataFrame, key: Column, created: str, deleted: str) -> DataFrame:
    """Lifetimes of parent records: (k1, k2, born, died), repeated rows once.

    A null `created` means from the start of time, a null `deleted` that the
    record lasts. Null keys are no parents.
    """
    return (
        df.select(key.alias("_k"), wall_micros(F.col(created)).alias("_c"), wall_micros(F.col(deleted)).alias("_d"))
        .where(F.col("_k").isNotNull())
        .select(
            F.xxhash64("_k").alias("k1"),
            F.xxhash64(F.lit(7), F.col("_k")).alias("k2"),
            F.coalesce("_c", F.lit(-(2**62))).alias("born"),
            F.coalesce("_d", F.lit(2**63 - 1)).alias("died"),
        )
    )


def references(df: DataFrame, name: str, record: Column, key: Column, shown: Column, at: str) -> DataFrame:
    """References of one table: (ref_table, record_id, target_key, at_us, k1, k2). Null keys are none."""
    return (
        df.select(F.lit(name).alias("ref_table"), record.cast("string").alias("record_id"), shown.alias("target_key"), F.coalesce(wall_micros(F.col(at)), F.lit(TIMELESS)).alias("at_us"), key.alias("_k"))
        .where(F.col("_k").isNotNull())
        .select("ref_table", "record_id", "target_key", "at_us", F.xxhash64("_k").alias("k1"), F.xxhash64(F.lit(7), F.col("_k")).alias("k2"))
    )


def _range_of(c: Column, ranges: int) -> Column:
    """The range of a 64-bit hash: equal, ordered intervals of the hash space."""
    # The top 32 bits as a number from 0, so that the product stays within 64 bits.
    return F.shiftright((F.shiftright(c, 32) + F.lit(2**31)) * F.lit(ranges), 32).cast("int")


def _pack(lives: pd.DataFrame) -> pd.DataFrame:
    """A range's lifetimes as four arrays sorted by the first hash, in one value.

    (A column of arrays would cost a nested null for each reference beside it.)
    """
    ordered = lives.sort_values(["k1", "k2", "born", "died"])
    arrays = np.stack([ordered[n].to_numpy(np.int64) for n in ("k1", "k2", "born", "died")])
    return pd.DataFrame({"range_no": [lives["range_no"].iloc[0]], "parents": [arrays.tobytes()]})


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misses of a partition sorted by (range, slice, references last)."""
    at, arrays = None, None
    none = [np.empty(0, np.int64)] * 4
    for pdf in batches:
        group = pdf["range_no"].to_numpy().astype(np.int64) * 2**31 + pdf["slice_no"].to_numpy()
        edges = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *edges], [*edges, len(pdf)]):
            if start == end:
                continue
            part = pdf.iloc[start:end]
            if group[start] != at:
                at, arrays = group[start], none
            held = part["parents"].notna().to_numpy()
            for packed in part.loc[held, "parents"]:
                arrays = list(np.frombuffer(packed, np.int64).reshape(4, -1))
            refs = part.loc[~held]
            if len(refs):
                yield _misses(refs, *arrays)


def _misses(refs: pd.DataFrame, k1: np.ndarray, k2: np.ndarray, born: np.ndarray, died: np.ndarray) -> pd.DataFrame:
    key, check = refs["k1"].to_numpy(np.int64), refs["k2"].to_numpy(np.int64)
    when = refs["at_us"].to_numpy(np.int64)
    timed = when != TIMELESS
    low, high = np.searchsorted(k1, key, "left"), np.searchsorted(k1, key, "right")
    known = np.zeros(len(refs), bool)
    alive, ended = known.copy(), known.copy()
    step, open_ = 0, np.flatnonzero(low < high)
    while len(open_):
        i = low[open_] + step
        same = k2[i] == check[open_]
        known[open_] |= same
        alive[open_] |= same & (born[i] <= when[open_]) & (when[open_] < died[i])
        ended[open_] |= same & (died[i] <= when[open_])
        step += 1
        # Only what can still change is followed: most keys have one or two lifetimes.
        open_ = open_[(low[open_] + step < high[open_]) & ~alive[open_]]
    reason = np.where(~known, "missing", np.where(ended, "deleted", "late"))
    miss = ~alive & (timed | ~known)
    out = refs.loc[miss, ["ref_table", "record_id", "target_key", "at_us"]].copy()
    out["reason"] = reason[miss]
    return out


def orphan_references(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """References whose target has no time of life that contains their time.

    `refs` from `references`, `lives` from `parents`. reason: `missing` if the
    target has no row at all, else `deleted` if some time of life ended at or
    before the reference, else `late`. A reference without time is a case only
    if its target is missing. Repeated references come out once.

    Returns ref_table, record_id, target_key, month_key (null without time) and
    reason. Without parents every reference is missing; without references the
    result is empty.
    """
    spark = refs.sparkSession
    lives = lives.distinct()
    asked = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = max(3 * asked, -(-lives.count() // RANGE_ROWS))
    refs = refs.withColumn("range_no", _range_of(F.col("k1"), ranges))
    sizes = written(refs.groupBy("range_no").agg(F.count(F.lit(1)).alias("n")))  # one row a range
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Fewer than MOST_SLICED ranges can hold more than 1/MOST_SLICED of the rows: that bounds the broadcast.
    least = max(SLICE_ROWS, -(-total // MOST_SLICED))
    # As many tasks as slices need, whatever the session's number of partitions.
    tasks = max(asked, -(-total // least))
    hot = sizes.where(F.col("n") > least).select("range_no", F.ceil(F.col("n") / least).cast("int").alias("slices"))
    packed = lives.withColumn("range_no", _range_of(F.col("k1"), ranges)).groupBy("range_no").applyInPandas(_pack, "range_no int, parents binary")
    arrays = (
        packed.join(F.broadcast(hot), "range_no", "left")
        .select("range_no", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices"), F.lit(1)) - 1)).alias("slice_no"), "parents")
        # No nulls beside the references' numbers: with nulls 64-bit numbers would reach pandas as floats.
        .withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long"), "at_us": F.lit(TIMELESS)})
    )
    probing = refs.join(F.broadcast(hot), "range_no", "left").withColumn(
        "slice_no", F.pmod(F.xxhash64("record_id", "target_key"), F.coalesce(F.col("slices"), F.lit(1))).cast("int")
    )
    both = probing.drop("slices").unionByName(arrays, allowMissingColumns=True)
    placed = both.repartition(tasks, "range_no", "slice_no").sortWithinPartitions("range_no", "slice_no", F.col("parents").isNull())
    misses = placed.select("range_no", "slice_no", "ref_table", "record_id", "target_key", "at_us", "k1", "k2", "parents").mapInPandas(_probe, PROBED)
    month = F.when(F.col("at_us") != TIMELESS, F.date_format(F.date_from_unix_date(F.floor(F.col("at_us") / 86_400_000_000).cast("int")), "yyyy-MM"))
    return misses.select("ref_table", "record_id", "target_key", month.alias("month_key"), "reason").distinct()


def orphan_rates(misses: DataFrame) -> DataFrame:
    """Orphans per table, month and reason: n_orphans and n_targets (distinct keys)."""
    return misses.groupBy("ref_table", "month_key", "reason").agg(
        F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("target_key").alias("n_targets")
    )


def declaration_key(repository: Column, path: Column, number: Column) -> Column:
    """The key of a declaration; null where path or number is missing."""
    whole = (squash_id(path).isNotNull()) & number.isNotNull()
    return F.when(whole, F.concat(F.lit("d:"), F.coalesce(squash_id(repository), F.lit("")), F.lit("|"), squash_id(path), F.lit("#"), number.cast("string")))


def evidence_orphans(links: DataFrame, edges: DataFrame, candidates: DataFrame, entities: DataFrame, nodes: DataFrame, declarations: DataFrame) -> DataFrame:
    """`orphan_references` of links to entities, edges to nodes and call candidates to declarations."""
    entity, target = squash_id(F.col("t.entity_id")), squash_id(F.col("target"))
    spread = links.select("link_id", "recorded_at", F.explode("targets").alias("t"))
    cands = candidates.select("record_id", "repository_id", "recorded_at", F.explode("candidates").alias("c"))
    decl = declaration_key(F.col("repository_id"), F.col("c.relative_path"), F.col("c.declaration_id"))
    shown = F.concat_ws("#", squash_id(F.col("c.relative_path")), F.col("c.declaration_id").cast("string"))
    refs = (
        references(spread, "links", F.col("link_id"), F.concat(F.lit("e:"), entity), entity, "recorded_at")
        .unionByName(references(edges, "edges", F.col("edge_id"), F.concat(F.lit("n:"), target), target, "recorded_at"))
        .unionByName(references(cands, "call_candidates", F.col("record_id"), decl, shown, "recorded_at"))
    )
    lives = (
        parents(entities, F.concat(F.lit("e:"), squash_id(F.col("entity_id"))), "created_at", "deleted_at")
        .unionByName(parents(nodes, F.concat(F.lit("n:"), squash_id(F.col("node_id"))), "created_at", "deleted_at"))
        .unionByName(parents(declarations, declaration_key(F.col("repository_id"), F.col("relative_path"), F.col("declaration_id")), "created_at", "deleted_at"))
    )
    return orphan_references(refs, lives)
