"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import canonical_path, digest_hex, known
from tracewell.operators.skew import skew_join


def standing_deliveries(rows: DataFrame, source: str, number: str, delivery: str, at: str) -> DataFrame:
    """One row per snapshot: the delivery that stands for it and the number that follows.

    Of several deliveries the one with the latest `at` stands (null is earliest;
    ties go to the greater delivery name). Columns: source, number, delivery,
    `_next` (null for the last), `_first`, `_rows` (of all its deliveries).
    """
    # Collapsed on the map side: what is shuffled is one row per delivery and task.
    each = rows.groupBy(source, number).agg(F.max(F.struct(F.col(at), F.col(delivery))).alias("_d"), F.count(F.lit(1)).alias("_rows"))
    order = Window.partitionBy(source).orderBy(number)
    return each.select(
        source,
        number,
        F.col("_d").getField(delivery).alias(delivery),
        F.lead(number).over(order).alias("_next"),
        (F.row_number().over(order) == 1).alias("_first"),
        "_rows",
    )


def diff_snapshots(
    rows: DataFrame,
    source: str,
    number: str,
    delivery: str,
    at: str,
    key: dict[str, Column],
    compared: dict[str, Column],
) -> DataFrame:
    """Records added, removed or changed between each two consecutive snapshots.

    Every row of a standing delivery is emitted twice, as the later side of its
    own snapshot and as the earlier side of the next one; one aggregation by
    (source, later number, key) classifies from the hashes of each side. The key
    holds the record, so no group grows with the data.

    `key`: expressions that name a record within a snapshot. `compared`:
    expressions whose known values make a change when they differ. Null compared
    values are unknown and never make a change. Where a delivery holds one key
    several times, its greatest known hash of each compared value counts. Rows
    without source, number or key value are no records. An empty table gives an
    empty result; other columns are ignored, whatever their names.

    Returns source, number, the keys and change_kind.
    """
    plain = rows.select(
        F.col(source).alias("_s"),
        F.col(number).alias("_n"),
        F.col(delivery).alias("_v"),
        F.col(at).alias("_t"),
        *[e.alias(f"_k{i}") for i, e in enumerate(key.values())],
        *[F.when(e.isNotNull(), F.xxhash64(e)).alias(f"_h{i}") for i, e in enumerate(compared.values())],
    ).where(F.col("_s").isNotNull() & F.col("_n").isNotNull())
    standing = standing_deliveries(plain.select("_s", "_n", "_v", "_t"), "_s", "_n", "_v", "_t")
    hashes = [f"_h{i}" for i in range(len(compared))]
    keys = [f"_k{i}" for i in range(len(key))]
    # A snapshot may hold any share of the rows, so the join to its standing delivery is salted.
    kept = skew_join(
        plain,
        standing.select("_s", "_n", F.col("_v").alias("_sv"), "_next", "_first"),
        ["_s", "_n"],
        F.col("_k0"),
        counts=standing.select("_s", "_n", F.col("_rows").alias("n")),
    ).where(F.col("_v").eqNullSafe(F.col("_sv")))
    sides = kept.select(
        "_s",
        *keys,
        *hashes,
        F.explode(
            F.array(
                F.struct(F.when(~F.col("_first"), F.col("_n")).alias("at"), F.lit(True).alias("later")),
                F.struct(F.col("_next").alias("at"), F.lit(False).alias("later")),
            )
        ).alias("_side"),
    ).where(F.col("_side.at").isNotNull() & F.col(keys[0]).isNotNull())
    later = F.col("_side.later")
    seen = sides.groupBy("_s", F.col("_side.at").alias("_n"), *keys).agg(
        F.max(later).alias("_new"),
        F.max(~later).alias("_old"),
        *[F.max(F.when(later, F.col(h))).alias(f"{h}n") for h in hashes],
        *[F.max(F.when(~later, F.col(h))).alias(f"{h}o") for h in hashes],
    )
    differs = F.lit(False)
    for h in hashes:
        differs = differs | F.coalesce(F.col(f"{h}n") != F.col(f"{h}o"), F.lit(False))
    kind = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").when(differs, "changed")
    return seen.select(
        F.col("_s").alias(source),
        F.col("_n").alias(number),
        *[F.col(k).alias(name) for k, name in zip(keys, key)],
        kind.alias("change_kind"),
    ).where(F.col("change_kind").isNotNull())


def file_changes(files: DataFrame) -> DataFrame:
    """`diff_snapshots` for the `files` table: canonical path, digest and object key."""
    return diff_snapshots(
        files,
        "repository_id",
        "snapshot_no",
        "delivery_id",
        "delivered_at",
        key={"relative_path": canonical_path(F.col("relative_path"))},
        compared={"content_digest": digest_hex(F.col("content_digest")), "object_key": known(F.col("object_key"))},
    )
