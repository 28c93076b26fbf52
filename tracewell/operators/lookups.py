"""Exact lookups over fact, link, candidate and graph tables. Filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(df: DataFrame, column: str, value) -> DataFrame:
    """All rows of one value, case-sensitive; nulls match nothing."""
    return df.where(F.col(column) == value)


def declarations_named(declarations: DataFrame, name: str) -> DataFrame:
    return where_equal(declarations, "decl_name", name)


def test_declarations(declarations: DataFrame) -> DataFrame:
    """Declarations that carry test evidence."""
    return declarations.where(F.size("test_evidence") > 0)


def import_items_targeting(items: DataFrame, target: str) -> DataFrame:
    return where_equal(items, "target", target)


def calls_named(calls: DataFrame, written: str) -> DataFrame:
    return where_equal(calls, "written", written)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def from_file(records: DataFrame, path: str) -> DataFrame:
    """Links or candidates whose origin is the file."""
    return records.where(F.col("origin.relative_path") == path)


def into_file(records: DataFrame, array: str, path: str) -> DataFrame:
    """Records with any target (or candidate) in the file."""
    return records.where(F.exists(array, lambda t: F.coalesce(t.relative_path == path, F.lit(False))))


def into_declaration(records: DataFrame, array: str, path: str, declaration: int) -> DataFrame:
    return records.where(F.exists(array, lambda t: F.coalesce((t.relative_path == path) & (t.declaration_id == declaration), F.lit(False))))


def with_outcome(records: DataFrame, outcome: str) -> DataFrame:
    return where_equal(records, "outcome", outcome)


def cardinality_outcome(candidates: Column, out_of_scope: Column) -> Column:
    """The only constructor of a candidate outcome: 0, 1 or n candidates are never collapsed."""
    n = F.when(candidates.isNull(), 0).otherwise(F.size(candidates))
    return F.when(out_of_scope, "out_of_scope").when(n == 0, "no_candidate").when(n == 1, "single_candidate").otherwise("multiple_candidates")


def link_outcome(targets: Column, out_of_scope: Column) -> Column:
    """The only constructor of a link outcome: 0 unresolved, 1 exact, n ambiguous."""
    n = F.when(targets.isNull(), 0).otherwise(F.size(targets))
    return F.when(out_of_scope, "out_of_scope").when(n == 0, "unresolved").when(n == 1, "exact").otherwise("ambiguous")


def canonical_set(c: Column) -> Column:
    """Sorted without repetitions."""
    return F.array_sort(F.array_distinct(c))


def node_by_id_or_key(nodes: DataFrame, term: str) -> DataFrame:
    """The node of this id, or else of this key."""
    hit = nodes.where((F.col("node_id") == term) | (F.col("node_key") == term))
    best = F.when(F.col("node_id") == term, 0).otherwise(1)
    return hit.orderBy(best, "node_id").limit(1)


#: Which columns a domain looks in.
DOMAINS = ("id", "name", "path", "entity", "any")


def find_nodes(nodes: DataFrame, term: str, domain: str) -> DataFrame:
    """All nodes a term names in a domain; a path also by its end after a `/`."""
    by_id = (F.col("node_id") == term) | (F.col("node_key") == term)
    by_name = (F.col("label") == term) & F.col("node_kind").isin("declaration", "call", "import")
    by_path = (F.col("relative_path") == term) | F.col("relative_path").endswith("/" + term)
    by_entity = (F.col("node_kind") == "entity") & (F.col("label") == term)
    chosen = {"id": by_id, "name": by_name, "path": by_path, "entity": by_entity, "any": by_id | by_name | by_path | by_entity}[domain]
    return nodes.where(F.coalesce(chosen, F.lit(False)))


def edges_matching(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None, evidence: str | None = None, language: str | None = None) -> DataFrame:
    """Edges by kind, evidence class and language (of the target, or else the source)."""
    out = edges
    if kinds is not None:
        out = out.where(F.col("edge_kind").isin(kinds))
    if evidence is not None:
        out = out.where(F.col("evidence_class") == evidence)
    if language is not None:
        lang = nodes.select(F.col("node_id"), F.col("language"))
        out = (
            out.join(lang.toDF("target", "_tl"), "target", "left")
            .join(lang.toDF("source", "_sl"), "source", "left")
            .where(F.coalesce("_tl", "_sl") == language)
            .select(*edges.columns)
        )
    return out
