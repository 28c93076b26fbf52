"""Integrity of derived tables: every check gives the rows that are wrong, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, id_: str) -> DataFrame:
    return df.groupBy(F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("reason"))


def verify_links(links: DataFrame, entities: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Links whose outcome does not fit their targets, whose rule is unknown, or that name an unknown entity."""
    n = F.coalesce(F.size(F.filter("targets", lambda t: t.isNotNull())), F.lit(0))
    want = F.when(F.col("outcome") == "exact", n == 1).when(F.col("outcome") == "ambiguous", n > 1).when(F.col("outcome").isin("unresolved", "out_of_scope"), n == 0).otherwise(False)
    bad = links.where(~want).select(F.col("link_id").alias("id"), F.lit("cardinality").alias("reason"))
    if rules is not None:
        bad = bad.unionByName(links.where(~F.col("rule_id").isin(rules)).select(F.col("link_id").alias("id"), F.lit("rule").alias("reason")))
    named = links.select("link_id", F.explode("targets").alias("t")).where("t.entity_id is not null").select("link_id", F.lower(F.trim("t.entity_id")).alias("entity_id"))
    lost = named.join(entities.select(F.lower(F.trim("entity_id")).alias("entity_id")).distinct(), "entity_id", "left_anti")
    return bad.unionByName(lost.select(F.col("link_id").alias("id"), F.lit("entity").alias("reason"))).distinct()


def verify_candidates(records: DataFrame) -> DataFrame:
    """Records whose outcome does not fit their candidates, or whose candidates repeat."""
    members = F.transform("candidates", lambda c: F.struct(c.relative_path.alias("p"), c.declaration_id.alias("d")))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    want = F.when(F.col("outcome") == "single_candidate", n == 1).when(F.col("outcome") == "multiple_candidates", n > 1).when(F.col("outcome").isin("no_candidate", "out_of_scope"), n == 0).otherwise(False)
    bad = records.where(~want).select(F.col("record_id").alias("id"), F.lit("cardinality").alias("reason"))
    twice = records.where(F.size(F.array_distinct(members)) < F.size(members)).select(F.col("record_id").alias("id"), F.lit("repeated candidate").alias("reason"))
    return bad.unionByName(twice).distinct()


def verify_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Duplicate ids, edges without an end, candidate edges without a set and facts with one."""
    known = nodes.select("node_id").distinct()
    out = duplicate_ids(nodes, "node_id").unionByName(duplicate_ids(edges, "edge_id"))
    for end in ("source", "target"):
        lost = edges.join(known.withColumnRenamed("node_id", end), end, "left_anti")
        out = out.unionByName(lost.select(F.col("edge_id").alias("id"), F.lit(f"no {end}").alias("reason")))
    mixed = edges.where((F.col("evidence_class") == "candidate") != F.col("candidate_set_id").isNotNull())
    return out.unionByName(mixed.select(F.col("edge_id").alias("id"), F.lit("evidence").alias("reason"))).distinct()


def verify_temporal(temporal: DataFrame, tail: int | None = 128) -> DataFrame:
    """Paths whose counts, order or tail cannot be right."""
    size = F.col("n_changes") if tail is None else F.least(F.col("n_changes"), F.lit(tail))
    wrong = (F.col("n_changes") < 1) | (F.size("tail") != size) | ~(F.array_sort("tail") == F.col("tail"))
    return temporal.where(wrong).select(F.concat_ws(":", "repository_id", "path").alias("id"), F.lit("tail").alias("reason"))


def verify_fold(sessions: DataFrame, investigations: DataFrame) -> DataFrame:
    """Investigations whose totals are not those of their sessions, or that have none."""
    sums = sessions.where("investigation is not null").groupBy("investigation").agg(F.sum("n_events").alias("_e"), F.count(F.lit(1)).alias("_s"))
    j = investigations.join(sums, "investigation", "full_outer")
    wrong = ~(F.col("n_events").eqNullSafe(F.col("_e")) & F.col("n_sessions").eqNullSafe(F.col("_s")))
    return j.where(wrong).select(F.col("investigation").alias("id"), F.lit("totals").alias("reason"))
