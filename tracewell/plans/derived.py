"""Queries of tables that are written, built or derived, each with its SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I
from tracewell.operators import build, joins, links, lookups, memory, packet, sessions, snapshots, symbols, verify
from tracewell.operators import query as text_query
from tracewell.plans import events as event_plans
from tracewell.plans.core import SQL_P1
from tracewell.plans.events import SEEN, seen
from tracewell.plans.reference import D, E_, N, _terms, declarations, edges, entities, nodes
from tracewell.session import own_folder
from tracewell.sources import jsonl, repository
from tracewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


# written as JSON lines in stages, and read by schema


def _published(s: SparkSession, d: str, name: str, source: str | None = None) -> DataFrame:
    where = os.path.join(own_folder(s), f"{name}-{uuid.uuid4().hex}")
    df = table(s, d, source or name)
    jsonl.publish(df.limit(0), where, "json")  # a former version, which the next one replaces
    jsonl.publish(df, where, "json")
    return jsonl.read_table(s, where, name)


for _name, _key, _more, _sql in (
    ("links", "link_id", lambda df: [F.coalesce(F.size("targets"), F.lit(-1)).alias("n"), F.col("origin.fact_id").alias("fact_id")], "coalesce(len(targets), -1) AS n, origin.fact_id AS fact_id"),
    ("call_candidates", "record_id", lambda df: [F.coalesce(F.size("candidates"), F.lit(-1)).alias("n"), F.col("origin.relative_path").alias("path")], "coalesce(len(candidates), -1) AS n, origin.relative_path AS path"),
    ("entities", "entity_id", lambda df: [F.coalesce(F.size("files"), F.lit(-1)).alias("n"), F.col("entity_key")], "coalesce(len(files), -1) AS n, entity_key"),
    ("nodes", "node_id", lambda df: [F.col("node_key"), F.col("label")], "node_key, label"),
    ("edges", "edge_id", lambda df: [F.col("source"), F.col("target")], "source, target"),
):
    query(f"published_{_name}", f"SELECT {_key} AS id, repository_id, {_sql} FROM {_name}")(lambda s, d, n=_name, k=_key, m=_more: (lambda df: df.select(F.col(k).alias("id"), "repository_id", *m(df)))(_published(s, d, n)))


@query("published_events", "SELECT event_id, event_type, sequence, payload, origin.runtime AS runtime FROM agent_events")
def _(s, d):
    return _published(s, d, "events", "agent_events").select("event_id", "event_type", "sequence", "payload", F.col("origin.runtime").alias("runtime"))


_TABLES = ["links", "edges", "nodes", "entities", "call_candidates"]


@query("table_manifest", " UNION ALL ".join(f"SELECT '{t}' AS table_name, 1 AS version, count(*) AS n_rows FROM {t}" for t in _TABLES))
def _(s, d):
    return jsonl.manifest({t: table(s, d, t) for t in _TABLES}).drop("digest")


@query("table_manifest_checked", "SELECT 'links' AS table_name, 'rows' AS reason UNION ALL SELECT 'nodes', 'digest' UNION ALL SELECT 'entities', 'missing'")
def _(s, d):
    # One table has lost a row, one has another content, one is not there any more.
    known = jsonl.manifest({t: table(s, d, t) for t in _TABLES})
    now = {t: table(s, d, t) for t in _TABLES if t != "entities"}
    least = now["links"].agg(F.min("link_id")).first()[0]
    now["links"] = now["links"].where(F.col("link_id") != least)
    now["nodes"] = now["nodes"].withColumn("label", F.upper("label"))
    return jsonl.verify(now, known)


# the graph from its parts

_R = "repository_id"


def _id(key: str) -> str:
    return f"'gn-' || substr(sha256(repository_id || chr(10) || {key}), 1, 16)"


def _edge(rows: str, kind: str, upstream: str = "''") -> str:
    return f"SELECT 'ge-' || substr(sha256({kind} || chr(10) || source || chr(10) || target || chr(10) || {upstream}), 1, 16) AS edge_id, repository_id, source, target FROM ({rows})"


@query("build_contains", _edge(f"SELECT DISTINCT {_R}, {_id("'file:' || relative_path")} AS source, {_id("'decl:' || relative_path || '#' || declaration_id")} AS target FROM {D} WHERE relative_path IS NOT NULL AND declaration_id IS NOT NULL AND {_R} IS NOT NULL", "'contains'"))
def _(s, d):
    return build.contains_edges(declarations(s, d).where("repository_id is not null")).select("edge_id", _R, "source", "target")


@query("build_member_of", _edge(f"SELECT DISTINCT {_R}, {_id("'file:' || f")} AS source, {_id("'ent:' || lower(trim(entity_id))")} AS target FROM (SELECT {_R}, entity_id, unnest(files) AS f FROM entities WHERE deleted_at IS NULL) WHERE f IS NOT NULL", "'member_of'"))
def _(s, d):
    return build.member_edges(entities(s, d)).select("edge_id", _R, "source", "target")


@query(
    "build_owned_by_manifest",
    f"""WITH m AS (SELECT DISTINCT repository_id, regexp_extract(relative_path, '^([^/]*)/', 1) AS root FROM {D} WHERE relative_path LIKE '%/%/%'), f AS (SELECT DISTINCT repository_id, relative_path FROM {D})
    SELECT DISTINCT f.repository_id, {_id("'file:' || f.relative_path").replace("repository_id ||", "f.repository_id ||")} AS source, {_id("'file:' || m.root || '/go.mod'").replace("repository_id ||", "f.repository_id ||")} AS target FROM f JOIN m ON m.repository_id = f.repository_id AND f.relative_path LIKE m.root || '/%'""",
)
def _(s, d):
    # Every first folder that has a folder below is taken to hold a manifest.
    f = declarations(s, d).select(_R, "relative_path").distinct()
    roots = f.where("relative_path like '%/%/%'").select(_R, F.substring_index("relative_path", "/", 1).alias("root")).distinct()
    return build.manifest_edges(f, roots.withColumn("relative_path", F.concat("root", F.lit("/go.mod")))).select(_R, "source", "target")


_LINKED = f"""SELECT DISTINCT repository_id, link_id, link_kind, outcome, {_id("'file:' || p")} AS source, {_id("CASE WHEN t.entity_id IS NOT NULL THEN 'ent:' || lower(trim(t.entity_id)) WHEN t.declaration_id IS NOT NULL THEN 'decl:' || t.relative_path || '#' || t.declaration_id ELSE 'file:' || t.relative_path END")} AS target
    FROM (SELECT repository_id, link_id, link_kind, outcome, origin.relative_path AS p, unnest(targets) AS t FROM links) WHERE p IS NOT NULL AND repository_id IS NOT NULL AND coalesce(t.entity_id, t.relative_path) IS NOT NULL"""


@query("build_links", f"SELECT link_id, link_kind, source, target, CASE WHEN outcome = 'exact' THEN 'fact' ELSE 'candidate' END AS evidence_class, CASE WHEN outcome = 'exact' THEN NULL ELSE 'set-' || link_id END AS candidate_set_id FROM ({_LINKED})")
def _(s, d):
    e = build.link_edges(table(s, d, "links").where("repository_id is not null"))
    return e.select(F.col("upstream_id").alias("link_id"), F.col("edge_kind").alias("link_kind"), "source", "target", "evidence_class", "candidate_set_id").distinct()


@query(
    "build_call_candidates",
    f"""SELECT DISTINCT record_id, {_id("'call:' || p || '#' || n")} AS source, {_id("'decl:' || c.relative_path || '#' || c.declaration_id")} AS target FROM (SELECT repository_id, record_id, origin.relative_path AS p, origin.fact_id AS n, unnest(candidates) AS c FROM call_candidates WHERE origin.fact_kind = 'call')
    WHERE p IS NOT NULL AND n IS NOT NULL AND c.relative_path IS NOT NULL AND c.declaration_id IS NOT NULL AND repository_id IS NOT NULL""",
)
def _(s, d):
    return build.candidate_edges(table(s, d, "call_candidates").where("repository_id is not null")).select(F.col("upstream_id").alias("record_id"), "source", "target").distinct()


def _built(s, d):
    held = lambda n: table(s, d, n).where("repository_id is not null")
    return build.graph_nodes(held("declarations"), held("entities"), held("links"), held("call_candidates"))


@query(
    "build_nodes",
    """WITH t AS (SELECT repository_id, unnest(targets) AS t FROM links), c AS (SELECT repository_id, unnest(candidates) AS t FROM call_candidates), k AS (
    SELECT repository_id, 'file' AS kind, 'file:' || relative_path AS key FROM declarations UNION SELECT repository_id, 'file', 'file:' || f FROM (SELECT repository_id, unnest(files) AS f FROM entities) UNION SELECT repository_id, 'file', 'file:' || origin.relative_path FROM links UNION SELECT repository_id, 'file', 'file:' || origin.relative_path FROM call_candidates
    UNION SELECT repository_id, 'file', 'file:' || t.relative_path FROM t UNION SELECT repository_id, 'file', 'file:' || t.relative_path FROM c UNION SELECT repository_id, 'declaration', 'decl:' || relative_path || '#' || declaration_id FROM declarations UNION SELECT repository_id, 'declaration', 'decl:' || t.relative_path || '#' || t.declaration_id FROM t
    UNION SELECT repository_id, 'declaration', 'decl:' || t.relative_path || '#' || t.declaration_id FROM c UNION SELECT repository_id, 'entity', 'ent:' || lower(trim(entity_id)) FROM entities UNION SELECT repository_id, 'entity', 'ent:' || lower(trim(t.entity_id)) FROM t UNION SELECT repository_id, 'call', 'call:' || origin.relative_path || '#' || origin.fact_id FROM call_candidates WHERE origin.fact_kind = 'call')
    SELECT 'gn-' || substr(sha256(repository_id || chr(10) || key), 1, 16) AS node_id, kind AS node_kind, key AS node_key FROM k WHERE key IS NOT NULL AND repository_id IS NOT NULL""",
)
def _(s, d):
    return _built(s, d).select("node_id", "node_kind", "node_key")


@query(
    "link_projection",
    f"SELECT DISTINCT link_id, link_kind, source, target FROM ({_LINKED})",
)
def _(s, d):
    # Over the nodes that the tables themselves give: each link has both ends.
    return joins.project_links(table(s, d, "links").where("repository_id is not null"), _built(s, d))


# history from snapshots: a change of a file is a commit that touches it

_HISTORY = f"(SELECT c.*, max(c.snapshot_no) OVER (PARTITION BY c.repository_id) AS newest FROM ({SQL_P1}) c)"


def _history(s, d):
    c = snapshots.file_changes(table(s, d, "files"))
    top = c.groupBy(_R).agg(F.max("snapshot_no").alias("newest"))
    change = F.when(F.col("change_kind") == "added", "A").when(F.col("change_kind") == "removed", "D").otherwise("M")
    return c.join(top, _R).select(_R, (F.col("newest") - F.col("snapshot_no")).alias("position"), F.col("snapshot_no").cast("string").alias("commit"), (F.col("snapshot_no") * 86_400).alias("at"), change.alias("change"), F.col("relative_path").alias("path"))


@query("file_history", f"SELECT repository_id, relative_path AS path, count(*) AS n_changes, CAST(min(snapshot_no) AS VARCHAR) AS first_commit, CAST(max(snapshot_no) AS VARCHAR) AS last_commit, string_agg(CAST(snapshot_no AS VARCHAR), ',' ORDER BY snapshot_no) AS tail FROM {_HISTORY} GROUP BY 1, 2")
def _(s, d):
    t = repository.file_temporal(_history(s, d), None)
    return t.select(_R, "path", "n_changes", "first_commit", "last_commit", F.array_join(F.transform("tail", lambda x: F.floor(x / 86_400).cast("string")), ",").alias("tail"))


@query(
    "file_change_measures",
    f"""SELECT repository_id, relative_path AS path, CASE WHEN count(*) > 1 THEN (max(snapshot_no) - min(snapshot_no)) * 86400 // (count(*) - 1) END AS mean_interval, count(*) FILTER (snapshot_no >= max_no - 3) AS changes_3d,
    CAST(floor(count(*) * 31557600 * 1000000 / ((max_no + 1 - min(snapshot_no)) * 86400)) AS BIGINT) AS frequency_e6 FROM (SELECT *, max(snapshot_no) OVER () AS max_no FROM ({SQL_P1})) GROUP BY 1, 2, max_no""",
)
def _(s, d):
    h = _history(s, d)
    head = h.agg(F.max("at")).scalar()
    t = repository.file_temporal(h, None)
    m = repository.change_measures(t, head + 86_400, [])
    near = repository.recent_changes(h, head, 3).withColumnRenamed("n", "changes_3d")
    return m.join(near, [_R, "path"], "left").select(_R, "path", "mean_interval", F.coalesce("changes_3d", F.lit(0)).alias("changes_3d"), "frequency_e6")


@query("file_last_change", f"SELECT repository_id, relative_path AS path, CAST(max(snapshot_no) AS VARCHAR) AS last_commit FROM {_HISTORY} WHERE relative_path = (SELECT min(relative_path) FROM ({SQL_P1})) GROUP BY 1, 2")
def _(s, d):
    h = _history(s, d)
    least = h.agg(F.min("path")).scalar()
    return lookups.where_equal(repository.file_temporal(h, None), "path", least).select(_R, "path", "last_commit")


@query("verify_history", f"SELECT repository_id || ':' || relative_path AS id, 'tail' AS reason FROM ({SQL_P1}) GROUP BY repository_id, relative_path HAVING count(*) > 1 AND count(*) % 2 = 0")
def _(s, d):
    # Tails of paths with an even number of changes, more than one, are turned round.
    t = repository.file_temporal(_history(s, d), None)
    turned = t.withColumn("tail", F.when(F.col("n_changes") % 2 == 0, F.reverse("tail")).otherwise(F.col("tail")))
    return verify.verify_temporal(turned, None)


# joins and rollups


@query(
    "covering_scopes",
    f"""WITH u AS (SELECT DISTINCT repository_id, relative_path, scope_id, span.byte_start AS pos FROM scopes), b AS (SELECT DISTINCT repository_id, relative_path, scope_id, span.byte_start AS a, span.byte_end AS z FROM scopes WHERE scope_kind IN ('function', 'method')),
    m AS (SELECT u.repository_id, u.relative_path, u.scope_id, u.pos, max(struct_pack(a := b.a, i := b.scope_id)) AS m FROM u JOIN b ON u.repository_id = b.repository_id AND u.relative_path = b.relative_path AND b.a <= u.pos AND u.pos < b.z GROUP BY 1, 2, 3, 4)
    SELECT u.repository_id, u.relative_path, u.scope_id, u.pos, m.m.i AS binding_id FROM u LEFT JOIN m ON m.repository_id = u.repository_id AND m.relative_path = u.relative_path AND m.scope_id = u.scope_id AND m.pos = u.pos""",
)
def _(s, d):
    t = table(s, d, "scopes")
    keys = [_R, "relative_path"]
    uses = t.select(*keys, "scope_id", F.col("span.byte_start").alias("pos")).distinct()
    held = t.where(F.col("scope_kind").isin("function", "method")).select(*keys, F.col("scope_id").alias("binding_id"), F.col("span.byte_start").alias("byte_start"), F.col("span.byte_end").alias("byte_end")).distinct()
    return joins.covering_binding(uses, held, keys, "pos")


@query(
    "recipes_in_names",
    f"""WITH r AS (SELECT DISTINCT structural_kind || '|' || entity_key AS recipe_id, list_distinct({_terms("string_split(entity_key, ':')[2]")}) AS terms FROM entities WHERE deleted_at IS NULL), q AS (SELECT DISTINCT decl_name AS query_id, list_distinct({_terms("decl_name")}) AS terms FROM {D} WHERE decl_name IS NOT NULL)
    SELECT q.query_id, r.recipe_id FROM (SELECT recipe_id, terms, unnest(terms) AS t FROM r) r JOIN (SELECT query_id, terms, unnest(terms) AS t FROM q) q ON q.t = r.t GROUP BY 1, 2, r.terms HAVING count(*) = len(r.terms)""",
)
def _(s, d):
    r = entities(s, d).select(F.concat_ws("|", "structural_kind", "entity_key").alias("recipe_id"), I.identifier_terms(F.split("entity_key", ":").getItem(1)).alias("terms")).distinct()
    q = declarations(s, d).where("decl_name is not null").select(F.col("decl_name").alias("query_id"), I.identifier_terms(F.col("decl_name")).alias("terms")).distinct()
    return joins.subset_match(r, q)


_OLD = "(SELECT DISTINCT repository_id, relative_path, content_digest FROM files WHERE snapshot_no % 2 = 1)"


@query(
    "source_version_states",
    f"""WITH i AS {_OLD}, s AS (SELECT DISTINCT repository_id, relative_path, content_digest FROM files WHERE snapshot_no % 2 = 0) SELECT repository_id, relative_path, content_digest,
    CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.repository_id = s.repository_id AND i.relative_path = s.relative_path AND i.content_digest = s.content_digest) THEN 'exact' WHEN NOT EXISTS (SELECT 1 FROM i WHERE i.repository_id = s.repository_id AND i.relative_path = s.relative_path) THEN 'unknown' WHEN content_digest IS NULL THEN 'assumed' ELSE 'unresolved' END AS version_state FROM s""",
)
def _(s, d):
    f = table(s, d, "files").select(_R, "snapshot_no", "relative_path", "content_digest")
    half = lambda n: f.where(F.col("snapshot_no") % 2 == n).drop("snapshot_no").distinct()
    return symbols.source_versions(half(0), half(1)).select(_R, "relative_path", "content_digest", "version_state")


@query("reused_views", f"SELECT v.relative_path, v.content_digest, v.content_digest IN (SELECT content_digest FROM {_OLD} WHERE content_digest IS NOT NULL) AS reused FROM (SELECT DISTINCT relative_path, content_digest FROM files WHERE snapshot_no % 2 = 0 AND content_digest IS NOT NULL) v")
def _(s, d):
    f = table(s, d, "files").where("content_digest is not null").select("snapshot_no", "relative_path", "content_digest")
    return symbols.reused_files(f.where("snapshot_no % 2 = 0").drop("snapshot_no").distinct(), f.where("snapshot_no % 2 = 1"))


@query(
    "rebound_symbols",
    """WITH o AS (SELECT DISTINCT repository_id || '|' || relative_path || '|' || declaration_id AS id, repository_id || '|' || coalesce(decl_name, '?') AS q, decl_kind AS k, scope_id AS s FROM declarations WHERE deleted_at IS NOT NULL), n AS (SELECT DISTINCT repository_id || '|' || relative_path || '|' || declaration_id AS id, repository_id || '|' || coalesce(decl_name, '?') AS q, decl_kind AS k, scope_id AS s FROM declarations WHERE deleted_at IS NULL),
    m AS (SELECT o.id AS old_id, n.id AS new_id, CAST(o.k IS NOT DISTINCT FROM n.k AS INT) + CAST(o.s IS NOT DISTINCT FROM n.s AS INT) AS score FROM o JOIN n ON n.q = o.q), b AS (SELECT old_id, max(score) AS score FROM m GROUP BY 1), t AS (SELECT m.old_id, m.score, count(*) AS n, min(new_id) AS new_id FROM m JOIN b ON b.old_id = m.old_id AND b.score = m.score GROUP BY 1, 2)
    SELECT o.id AS old_id, CASE WHEN t.n = 1 THEN t.new_id END AS new_id, CASE WHEN t.n IS NULL THEN 'gone' WHEN t.n > 1 THEN 'ambiguous' WHEN t.score = 2 THEN 'same' ELSE 'changed' END AS state FROM o LEFT JOIN t ON t.old_id = o.id""",
)
def _(s, d):
    t = table(s, d, "declarations").select(F.concat_ws("|", _R, "relative_path", F.col("declaration_id").cast("string")).alias("id"), F.concat_ws("|", _R, F.coalesce("decl_name", F.lit("?"))).alias("q"), "decl_kind", "scope_id", F.col("deleted_at").isNull().alias("lasts"))
    part = lambda c: t.where(c).drop("lasts").distinct()
    return symbols.rebind(part(~F.col("lasts")), part(F.col("lasts")), "q", ["decl_kind", "scope_id"])


@query("view_validity", f"SELECT s.view_id, CASE WHEN c.f1 IS NULL THEN 'missing' WHEN s.f1 IS DISTINCT FROM c.f1 THEN 'f1' WHEN s.f2 IS DISTINCT FROM c.f2 THEN 'f2' END AS reason FROM (SELECT repository_id AS view_id, count(DISTINCT snapshot_no) AS f1, max(content_digest) AS f2 FROM files GROUP BY 1) s LEFT JOIN (SELECT repository_id AS view_id, count(DISTINCT snapshot_no) AS f1, max(content_digest) AS f2 FROM files WHERE snapshot_no > 1 GROUP BY 1) c ON c.view_id = s.view_id")
def _(s, d):
    f = table(s, d, "files")
    prints = lambda df: df.groupBy(F.col(_R).alias("view_id")).agg(F.countDistinct("snapshot_no").alias("f1"), F.max("content_digest").alias("f2"))
    return symbols.validity(prints(f), prints(f.where("snapshot_no > 1")), ["f1", "f2"])


@query("class_inheritance", "WITH RECURSIVE p AS (SELECT DISTINCT repository_id || '|' || relative_path || '|' || scope_id AS c, repository_id || '|' || relative_path || '|' || parent_scope_id AS q FROM scopes WHERE parent_scope_id IS NOT NULL AND scope_kind = 'class'), w AS (SELECT c AS class, q AS ancestor, 1 AS level FROM p UNION SELECT w.class, p.q, w.level + 1 FROM w JOIN p ON p.c = w.ancestor WHERE w.level < 64) SELECT class, ancestor, min(level) AS level FROM w WHERE class <> ancestor OR level = 1 GROUP BY 1, 2")
def _(s, d):
    at = lambda c: F.concat_ws("|", _R, "relative_path", F.col(c).cast("string"))
    return links.inheritance_levels(table(s, d, "scopes").where("parent_scope_id is not null and scope_kind = 'class'").select(at("scope_id").alias("class"), at("parent_scope_id").alias("parent")).distinct())


@query("path_utility", f"SELECT path, count(*) AS n, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_used FROM (SELECT session, path, count(*) FILTER (okind = 'explicit_read') AS r FROM {SEEN} GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    return sessions.utility_counts(sessions.exposures(seen(s, d)), ["path"], "n_reads")


@query("path_evidence_rollup", f"SELECT path, max(CASE okind WHEN 'explicit_read' THEN 5 WHEN 'search_snippet' THEN 2 ELSE 0 END) AS strength, max(number / 1000.0) AS similarity, coalesce(string_agg(DISTINCT investigation, ',' ORDER BY investigation), '') AS investigations FROM {SEEN} GROUP BY 1")
def _(s, d):
    kind = F.when(F.col("kind") == "explicit_read", "contained").when(F.col("kind") == "search_snippet", "mentioned").otherwise("?")
    return symbols.path_evidence(seen(s, d).select("path", kind.alias("evidence"), (F.col("number") / 1000).alias("similarity"), "investigation"))


@query("session_list", f"SELECT DISTINCT session FROM {event_plans.EV} WHERE session IS NOT NULL")
def _(s, d):
    return lookups.distinct_sorted(event_plans.events(s, d), "session")


@query("changed_memory_entries", f"WITH a AS (SELECT session AS entry, sha256(string_agg(DISTINCT path, chr(10) ORDER BY path)) AS digest FROM {SEEN} GROUP BY 1), b AS (SELECT session AS entry, sha256(string_agg(DISTINCT path, chr(10) ORDER BY path)) AS digest FROM {SEEN} WHERE number % 5 > 0 GROUP BY 1) SELECT a.entry, a.digest FROM a LEFT JOIN b ON b.entry = a.entry WHERE a.digest IS DISTINCT FROM b.digest")
def _(s, d):
    # Stored is what was known before every fifth event.
    now = seen(s, d)
    return memory.changed_entries(memory.digests(memory.entries(now)), memory.digests(memory.entries(now.where("number % 5 > 0"))))


@query("composed_memory", "WITH d AS (SELECT DISTINCT repository_id AS entry, CASE decl_kind WHEN 'function' THEN 'same' WHEN 'method' THEN 'changed' WHEN 'class' THEN 'ambiguous' ELSE 'gone' END AS state, declaration_id, relative_path FROM declarations) SELECT 'q' AS query, entry, 0.5 :: DOUBLE AS similarity, count(*) FILTER (state = 'same') AS n_same, count(*) FILTER (state = 'changed') AS n_changed, count(*) FILTER (state = 'ambiguous') AS n_ambiguous, count(*) FILTER (state = 'gone') AS n_gone FROM d WHERE entry IS NOT NULL GROUP BY 2")
def _(s, d):
    state = F.when(F.col("decl_kind") == "function", "same").when(F.col("decl_kind") == "method", "changed").when(F.col("decl_kind") == "class", "ambiguous").otherwise("gone")
    r = table(s, d, "declarations").where("repository_id is not null").select(F.col(_R).alias("entry"), state.alias("state"), "declaration_id", "relative_path").distinct()
    return text_query.compose_memory(r.select(F.lit("q").alias("query"), "entry", F.lit(0.5).alias("similarity")).distinct(), r.select("entry", "state"))


@query("policy_reordered", f"WITH p AS (SELECT edge_kind AS g, edge_id, row_number() OVER (PARTITION BY edge_kind ORDER BY edge_id) - 1 AS pos, (length(target) % 7) / 7.0 AS rate FROM {E_} WHERE target IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY pos >= 3, CASE WHEN pos >= 3 THEN -floor(rate / 0.25) END, pos) - 1 AS new_position FROM p) SELECT g, edge_id, new_position FROM o")
def _(s, d):
    from pyspark.sql import Window

    e = edges(s, d).where("target is not null")
    p = e.select(F.col("edge_kind").alias("g"), "edge_id", (F.row_number().over(Window.partitionBy("edge_kind").orderBy("edge_id")) - 1).alias("pos"), ((F.length("target") % 7) / 7.0).alias("rate"))
    return text_query.policy_order(p, ["g"], "pos", "rate", 3, 0.25).select("g", "edge_id", "new_position")


@query("scorer_reranked", f"WITH p AS (SELECT node_kind AS g, node_id, label, row_number() OVER (PARTITION BY node_kind ORDER BY node_id) - 1 AS pos, length(label) / 20.0 AS x FROM {N} WHERE label IS NOT NULL), c AS (SELECT *, CASE WHEN x BETWEEN 0 AND 1 THEN x END AS score FROM p) SELECT g, node_id, row_number() OVER (PARTITION BY g ORDER BY score DESC NULLS LAST, pos) - 1 AS new_position, count(*) OVER (PARTITION BY g) > 1 AS reranked FROM c")
def _(s, d):
    import pandas as pd
    from pyspark.sql import Window

    n = nodes(s, d).where("label is not null")
    p = n.select(F.col("node_kind").alias("g"), "node_id", "label", (F.row_number().over(Window.partitionBy("node_kind").orderBy("node_id")) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("node_kind")).alias("n"))
    scores = text_query.scored(p, "label", lambda x: pd.Series([len(t) / 20.0 for t in x])).select("g", "node_id", "score")
    ranked = text_query.rerank(p, ["g"], "pos", scores, "node_id")
    return ranked.select("g", "node_id", "new_position", text_query.needs_rerank(F.col("n"), F.lit(False), F.lit(False)).alias("reranked"))


@query("packets_parsed", f"WITH e AS {E_}, n AS {N}, r AS (SELECT DISTINCT e.edge_id, e.edge_kind, e.source, e.target, e.evidence_class, e.candidate_set_id FROM e JOIN n a ON a.node_id = e.source JOIN n b ON b.node_id = e.target WHERE a.repository_id = b.repository_id), q AS (SELECT repository_id AS query, count(DISTINCT node_id) AS n_facts FROM n WHERE repository_id IS NOT NULL GROUP BY 1), c AS (SELECT n.repository_id AS query, count(DISTINCT (edge_kind, source, target, evidence_class, candidate_set_id)) AS n_relations FROM r JOIN n ON n.node_id = r.source GROUP BY 1) SELECT q.query, n_facts, coalesce(n_relations, 0) AS n_relations FROM q LEFT JOIN c ON c.query = q.query")
def _(s, d):
    n, e = nodes(s, d).where("repository_id is not null"), edges(s, d)
    facts = n.select(F.col(_R).alias("query"), "node_id", "node_kind", "node_key", "label")
    rel = e.join(n.select(F.col("node_id").alias("source"), F.col(_R).alias("query")), "source").select("query", "edge_kind", "source", "target", "evidence_class", "candidate_set_id")

    def read(batches):
        import pandas as pd

        for pdf in batches:
            read_ = [packet.parse_packet(t) for t in pdf["packet"]]
            yield pd.DataFrame({"query": [p.query for p in read_], "n_facts": [len(p.facts) for p in read_], "n_relations": [len(p.relations) for p in read_]})

    return packet.render_packets(facts, rel).select("packet").mapInPandas(read, "query string, n_facts long, n_relations long")


@query("packets_for_people", f"SELECT repository_id AS query, string_agg(line, chr(10) ORDER BY line) AS packet FROM (SELECT DISTINCT repository_id, '  ' || node_kind || '  ' || node_key || '  ' || coalesce(label, '') AS line FROM {N} WHERE node_kind = 'file' AND repository_id IS NOT NULL) GROUP BY 1")
def _(s, d):
    n = nodes(s, d).where("node_kind = 'file' and repository_id is not null").select(F.col(_R).alias("query"), "node_kind", "node_key", "label")
    none = edges(s, d).limit(0).select(F.lit("q").alias("query"), "edge_kind", "source", "target", "evidence_class", "candidate_set_id")
    return packet.packet_human(n, none)


@query("source_witnesses", "SELECT DISTINCT f.file_id AS finding_id, CASE WHEN f.file_id % 3 = 2 THEN 'missing' WHEN f.file_id % 3 = 1 THEN 'stale' ELSE 'current' END AS state, CASE WHEN f.file_id % 3 = 0 THEN substr(relative_path, 2, 6) END AS text FROM source_files f WHERE length(relative_path) >= 7")
def _(s, d):
    # The bytes of a path stand for those of a file; a third of the sources are of another version, a third are gone.
    f = table(s, d, "source_files").where("length(relative_path) >= 7").select("file_id", _R, "relative_path").distinct()
    key = F.concat_ws("|", "relative_path", F.col("file_id").cast("string"))
    wanted = f.select(F.col("file_id").alias("finding_id"), _R, key.alias("relative_path"), F.lit("d1").alias("content_digest"), F.lit(1).alias("byte_start"), F.lit(7).alias("byte_end"))
    held = f.where("file_id % 3 <> 2").select(_R, key.alias("relative_path"), F.when(F.col("file_id") % 3 == 0, "d1").otherwise("d0").alias("content_digest"), F.col("relative_path").cast("binary").alias("content"))
    return symbols.source_witness(wanted, held)


@query("declaration_facet_digests", f"SELECT DISTINCT repository_id, relative_path, declaration_id, sha256(decl_name) AS name_digest, sha256(substr(relative_path, 1, 3)) AS head_digest, sha256(substr(relative_path, 4)) AS body_digest FROM {D} WHERE decl_name IS NOT NULL AND repository_id IS NOT NULL AND length(relative_path) > 3")
def _(s, d):
    t = declarations(s, d).where("decl_name is not null and repository_id is not null and length(relative_path) > 3")
    spans = t.select(_R, "relative_path", "declaration_id", F.col("decl_name").alias("name"), F.lit(0).alias("byte_start"), F.lit(3).alias("body_start"), F.length("relative_path").alias("byte_end")).distinct()
    return symbols.declaration_facets(spans, t.select(_R, "relative_path", F.col("relative_path").cast("binary").alias("content")).distinct())


@query("nodes_by_id_or_key", f"(SELECT node_id, node_key FROM {N} WHERE node_key = (SELECT min(node_key) FROM {N}) ORDER BY node_id LIMIT 1)")
def _(s, d):
    n = nodes(s, d)
    return lookups.node_by_id_or_key(n, n.agg(F.min("node_key")).first()[0]).select("node_id", "node_key")


@query("distinct_gaps", f"SELECT DISTINCT disposition_kind AS family, label AS node FROM {N} WHERE disposition_kind IS NOT NULL UNION SELECT DISTINCT disposition_kind, NULL FROM {N} WHERE disposition_kind IS NOT NULL")
def _(s, d):
    n = nodes(s, d).where("disposition_kind is not null")
    return text_query.gap_signatures(n.select(F.col("disposition_kind").alias("family")), n.select(F.col("disposition_kind").alias("family"), F.col("label").alias("node")))


@query("gap_totals", f"SELECT family, reason, intent, count(*) AS n FROM (SELECT disposition_kind AS family, language AS reason, node_kind AS intent FROM {N} WHERE disposition_kind IS NOT NULL) GROUP BY GROUPING SETS ((), (family), (reason), (intent))")
def _(s, d):
    return sessions.gap_report(nodes(s, d).where("disposition_kind is not null").select(F.col("disposition_kind").alias("family"), F.col("language").alias("reason"), F.col("node_kind").alias("intent")))


@query("mention_totals", "SELECT repository_id, relative_path, count(DISTINCT doc_id) AS n_owners FROM (" + r"""WITH w AS (SELECT doc_id, repository_id, unnest(regexp_split_to_array(text, '[\s`''"()\[\]{}<>,;]+')) AS w FROM documents WHERE text IS NOT NULL),
    p AS (SELECT DISTINCT doc_id, repository_id, regexp_replace(regexp_replace(w, '^\./|[.:!?*]+$', '', 'g'), '(?:#L?\d+(?:-L?\d+)?|:\d+(?:[:-]\d+)?)$', '') AS relative_path FROM w WHERE regexp_matches(w, '[./]'))
    SELECT DISTINCT p.doc_id, p.repository_id, p.relative_path FROM p JOIN (SELECT DISTINCT repository_id, relative_path FROM files) f ON f.repository_id = p.repository_id AND f.relative_path = p.relative_path""" + ") GROUP BY 1, 2")
def _(s, d):
    return sessions.mention_counts(sessions.path_mentions(table(s, d, "documents"), "doc_id", "text", table(s, d, "files")), "doc_id")
