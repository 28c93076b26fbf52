"""The evidence graph from facts, entities, links and candidates: nodes, and edges by kind.

Ids follow from content, so that a part can be built again alone. Both ends of
every edge are nodes; what would dangle is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I

NODE = ["node_id", "repository_id", "node_key", "node_kind", "relative_path", "label"]
EDGE = ["edge_id", "repository_id", "edge_kind", "evidence_class", "rule_id", "source", "target", "upstream_id", "candidate_set_id"]


def file_key(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def declaration_key(path: Column, number: Column) -> Column:
    return F.concat(F.lit("decl:"), path, F.lit("#"), number.cast("string"))


def entity_key(entity: Column) -> Column:
    return F.concat(F.lit("ent:"), F.lower(F.trim(entity)))


def call_key(path: Column, number: Column) -> Column:
    return F.concat(F.lit("call:"), path, F.lit("#"), number.cast("string"))


def node_id(repository: Column, key: Column) -> Column:
    return I.content_id("gn", repository, key)


def _nodes(df: DataFrame, kind: str, key: Column, path: Column, label: Column) -> DataFrame:
    n = df.select("repository_id", key.alias("node_key"), F.lit(kind).alias("node_kind"), path.alias("relative_path"), label.alias("label")).where("node_key is not null")
    # Rows of one key may differ in their label: the least one counts, aggregated on the map side.
    one = n.groupBy("repository_id", "node_key", "node_kind").agg(F.min("relative_path").alias("relative_path"), F.min("label").alias("label"))
    return one.select(node_id(F.col("repository_id"), F.col("node_key")).alias("node_id"), *NODE[1:])


def graph_nodes(declarations: DataFrame, entities: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Nodes of all files, declarations, entities and calls that the tables name: NODE."""
    path = F.col("relative_path")
    origin = lambda df: df.select("repository_id", F.col("origin.relative_path").alias("relative_path"))
    targets = links.select("repository_id", F.explode("targets").alias("t"))
    met = candidates.select("repository_id", F.explode("candidates").alias("t"))
    held = entities.select("repository_id", F.explode("files").alias("relative_path"))
    parts = [declarations.select("repository_id", "relative_path"), held, origin(links), origin(candidates)]
    parts += [x.select("repository_id", F.col("t.relative_path").alias("relative_path")) for x in (targets, met)]
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    files = files.where("relative_path is not null").distinct()
    named = declarations.select("repository_id", "relative_path", "declaration_id", "decl_name")
    for x in (targets, met):
        named = named.unionByName(x.select("repository_id", F.col("t.relative_path").alias("relative_path"), F.col("t.declaration_id").alias("declaration_id"), F.lit(None).cast("string").alias("decl_name")))
    owners = entities.select("repository_id", "entity_id", F.col("entity_key").alias("name")).unionByName(targets.select("repository_id", F.col("t.entity_id").alias("entity_id"), F.lit(None).cast("string").alias("name")))
    calls = candidates.where("origin.fact_kind = 'call'").select("repository_id", "origin.relative_path", F.col("origin.fact_id").alias("fact_id"), "written")
    return (
        _nodes(files, "file", file_key(path), path, I.basename(path))
        .unionByName(_nodes(named, "declaration", declaration_key(path, F.col("declaration_id")), path, F.col("decl_name")))
        .unionByName(_nodes(owners, "entity", entity_key(F.col("entity_id")), F.lit(None).cast("string"), F.col("name")))
        .unionByName(_nodes(calls, "call", call_key(path, F.col("fact_id")), path, F.col("written")))
    )


def _edges(df: DataFrame, kind: Column | str, source: Column, target: Column, evidence: str = "fact", rule: Column | None = None, upstream: Column | None = None, candidate_set: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    e = df.select(
        "repository_id",
        kind.alias("edge_kind"),
        F.lit(evidence).alias("evidence_class"),
        (F.concat(F.lit("graph."), kind) if rule is None else rule).alias("rule_id"),
        node_id(F.col("repository_id"), source).alias("source"),
        node_id(F.col("repository_id"), target).alias("target"),
        (none if upstream is None else upstream).alias("upstream_id"),
        (none if candidate_set is None else candidate_set).alias("candidate_set_id"),
        source.alias("_s"),
        target.alias("_t"),
    ).where("_s is not null and _t is not null")
    return e.drop("_s", "_t").distinct().select(I.content_id("ge", F.col("edge_kind"), F.col("source"), F.col("target"), F.col("upstream_id")).alias("edge_id"), *EDGE[1:])


def contains_edges(declarations: DataFrame) -> DataFrame:
    """A file contains its declarations."""
    path = F.col("relative_path")
    return _edges(declarations, "contains", file_key(path), declaration_key(path, F.col("declaration_id")))


def member_edges(entities: DataFrame) -> DataFrame:
    """A file is a member of the entities that list it."""
    held = entities.select("repository_id", "entity_id", F.explode("files").alias("relative_path"))
    return _edges(held, "member_of", file_key(F.col("relative_path")), entity_key(F.col("entity_id")))


def manifest_edges(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """A file is owned by the manifest of the nearest folder around it. `manifests`: repository_id, root, relative_path."""
    from tracewell.operators.joins import nearest_ancestor

    near = nearest_ancestor(files.select("repository_id", "relative_path").distinct(), manifests.select("repository_id", "root"), ["repository_id"], "relative_path", "root")
    owned = near.join(manifests.select("repository_id", "root", F.col("relative_path").alias("manifest")), ["repository_id", "root"]).where("manifest <> relative_path")
    return _edges(owned, "owned_by_manifest", file_key(F.col("relative_path")), file_key(F.col("manifest")))


def link_edges(links: DataFrame) -> DataFrame:
    """One edge per target of each link, from the file it starts in; several targets are candidates of one set."""
    spread = links.select("repository_id", "link_id", "link_kind", "rule_id", "outcome", F.col("origin.relative_path").alias("p"), F.explode("targets").alias("t"))
    target = F.when(F.col("t.entity_id").isNotNull(), entity_key(F.col("t.entity_id"))).when(F.col("t.declaration_id").isNotNull(), declaration_key(F.col("t.relative_path"), F.col("t.declaration_id"))).otherwise(file_key(F.col("t.relative_path")))
    same = lambda df, evidence, group: _edges(df, F.col("link_kind"), file_key(F.col("p")), target, evidence, F.col("rule_id"), F.col("link_id"), group)
    sure = F.coalesce(F.col("outcome") == "exact", F.lit(False))
    return same(spread.where(sure), "fact", None).unionByName(same(spread.where(~sure), "candidate", F.concat(F.lit("set-"), "link_id")))


def candidate_edges(candidates: DataFrame) -> DataFrame:
    """From each call to its candidates, all of one set."""
    spread = candidates.where("origin.fact_kind = 'call'").select("repository_id", "record_id", "rule_id", F.col("origin.relative_path").alias("p"), F.col("origin.fact_id").alias("fact_id"), F.explode("candidates").alias("c"))
    target = declaration_key(F.col("c.relative_path"), F.col("c.declaration_id"))
    return _edges(spread, "call_candidate", call_key(F.col("p"), F.col("fact_id")), target, "candidate", F.col("rule_id"), F.col("record_id"), F.concat(F.lit("set-"), "record_id"))
