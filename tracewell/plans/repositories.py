"""Queries from source text to facts, links and candidates, and over streams."""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I
from tracewell.operators import candidates, dedup, extract, graph, links, packet, sessions
from tracewell.plans import reference
from tracewell.session import checkpoint_dir, kept
from tracewell.sources.repository import language_by_path
from tracewell.sources.tables import table
from tracewell.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def sources(s, d):
    """Source files as they are: rows repeat whole, so what is derived from them is made distinct, not the texts."""
    f = table(s, d, "source_files")
    return f.select("repository_id", "relative_path", language_by_path(F.col("relative_path")).alias("lang"), "source_text")


def paths(s, d):
    return table(s, d, "source_files").select("repository_id", "relative_path").distinct()


def facts(s, d):
    """Facts of all source files, parsed once for an application."""
    keys = ["repository_id", "relative_path"]
    return kept(s, "facts", d, lambda: extract.source_facts(sources(s, d), keys, "lang", "source_text").dropDuplicates([*keys, "fact_kind", "fact_id"]))


def _flat(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn(array, F.array_join(array, ","))


@query("source_facts")
def _(s, d):
    return facts(s, d)


@query("source_fact_counts")
def _(s, d):
    return facts(s, d).groupBy("fact_kind", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("n_names"))


for _name, _rule in {
    "links_python_relative": lambda f, p: links.python_relative_imports(f, p),
    "links_python_absolute": lambda f, p: links.python_absolute_imports(f, p),
    "links_rust_modules": lambda f, p: links.rust_module_files(f, p),
    "links_rust_uses": lambda f, p: links.rust_use_paths(f, p),
    "links_go_packages": lambda f, p: links.go_packages(f),
    "links_php_hierarchy": lambda f, p: links.php_hierarchy(f),
    "links_php_uses": lambda f, p: links.php_uses(f),
    "links_php_namespaces": lambda f, p: links.php_namespaces(f),
}.items():
    query(_name)(lambda s, d, rule=_rule: _flat(rule(facts(s, d), paths(s, d)), "targets"))


@query("links_go_imports")
def _(s, d):
    # No go.mod is among the files: every repository is taken as the module of its own name.
    return _flat(links.go_imports(facts(s, d), _modules(s, d)), "targets")


def _modules(s, d):
    return paths(s, d).select("repository_id").distinct().select("repository_id", F.concat(F.lit("example.com/"), "repository_id").alias("module"), F.lit("").alias("root"))


@query("rust_crate_tree")
def _(s, d):
    return links.rust_crate_tree(facts(s, d), paths(s, d))


for _name, _rule in {
    "candidates_go_package": lambda f, p, m: candidates.go_package_calls(f),
    "candidates_go_imported": lambda f, p, m: candidates.go_imported_calls(f, m),
    "candidates_rust_local": lambda f, p, m: candidates.rust_local_calls(f, links.rust_use_paths(f, p)),
    "candidates_rust_paths": lambda f, p, m: candidates.rust_path_calls(f, p),
    "candidates_php_functions": lambda f, p, m: candidates.php_function_calls(f),
    "candidates_php_members": lambda f, p, m: candidates.php_member_calls(f),
    "call_candidates_all": candidates.all_candidates,
}.items():
    query(_name)(lambda s, d, rule=_rule: _flat(rule(facts(s, d), paths(s, d), _modules(s, d)), "candidates"))


@query("rule_registry", "SELECT count(*) AS n_rules, count(*) FILTER (rule LIKE '%.call.%') AS n_candidate_rules FROM (SELECT unnest(['rust.mod.standard_file', 'rust.use.crate_path', 'rust.use.non_crate_path', 'go.package.same_directory', 'go.import.local_module', 'go.import.external', 'python.relative_import.package_path', 'python.absolute_import.local_candidate', 'python.absolute_import.external', 'php.namespace.declaration', 'php.use.qualified_name', 'php.use.external', 'php.use.non_class_import', 'php.class.extends', 'php.class.implements', 'php.class.uses_trait', 'rust.call.local_function_candidate', 'rust.call.imported_function_candidate', 'rust.call.structural_path_function_candidate', 'go.call.package_local_function_candidate', 'go.call.imported_package_function_candidate', 'php.call.namespace_function_candidate', 'php.call.imported_function_candidate', 'php.call.construction_class_candidate', 'php.call.static_method_candidate', 'php.call.lexical_self_method_candidate', 'php.call.lexical_this_method_candidate', 'php.call.typed_receiver_method_candidate', 'php.call.inherited_method_candidate', 'php.call.parent_method_candidate', 'php.call.parent_construction_candidate']) AS rule)")
def _(s, d):
    return links.rule_registry(s).agg(F.count(F.lit(1)).alias("n_rules"), F.count_if(F.col("rule_id").contains(".call.")).alias("n_candidate_rules"))


@query("recovery_regions")
def _(s, d):
    return extract.recovery_regions(sources(s, d), ["repository_id", "relative_path"], "lang", "source_text").distinct()


@query(
    "path_mentions",
    r"""WITH w AS (SELECT doc_id, repository_id, unnest(regexp_split_to_array(text, '[\s`''"()\[\]{}<>,;]+')) AS w FROM documents WHERE text IS NOT NULL),
    p AS (SELECT DISTINCT doc_id, repository_id, regexp_replace(regexp_replace(w, '^\./|[.:!?*]+$', '', 'g'), '(?:#L?\d+(?:-L?\d+)?|:\d+(?:[:-]\d+)?)$', '') AS relative_path FROM w WHERE regexp_matches(w, '[./]'))
    SELECT DISTINCT p.doc_id, p.repository_id, p.relative_path FROM p JOIN (SELECT DISTINCT repository_id, relative_path FROM files) f ON f.repository_id = p.repository_id AND f.relative_path = p.relative_path""",
)
def _(s, d):
    return sessions.path_mentions(table(s, d, "documents"), "doc_id", "text", table(s, d, "files"))


@query("answer_packets")
def _(s, d):
    n, e = reference.nodes(s, d), reference.edges(s, d)
    near = graph.neighbourhood(e, n, n.where("node_kind = 'entity'").select("node_id"), None)
    keys = n.select("node_id", "node_kind", "node_key", "label")
    shown = near.select(F.col("seed").alias("query"), "node_id").unionByName(near.select(F.col("seed").alias("query"), F.col("seed").alias("node_id"))).distinct().join(keys, "node_id")
    rel = near.select(F.col("seed").alias("query"), "edge_id").join(e, "edge_id").select("query", "edge_kind", "source", "target", "evidence_class", "candidate_set_id")
    return packet.render_packets(shown, rel)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The event table read as a stream of its files."""
    path = f"{d}/agent_events.parquet"
    schema = s.read.parquet(path).schema
    return s.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path if os.path.isdir(path) or not glob.glob(path) else path + "*")


def _folder(s: SparkSession, what: str) -> str:
    return f"{checkpoint_dir(s)}/tracewell-{s.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


_ID = "nullif(regexp_replace(lower({}), '^\\s+|\\s+$', '', 'g'), '')"
_EVENT = f"coalesce({_ID.format('session_id')}, nullif(regexp_extract({_ID.format('event_id')}, '^(.*):0*([0-9]+)$', 1), '')) AS session, coalesce(sequence, CAST(nullif(regexp_extract({_ID.format('event_id')}, '^(.*):0*([0-9]+)$', 2), '') AS BIGINT)) AS number"


def _events_once(s: SparkSession, d: str) -> DataFrame:
    """The stream with each event of a day once: (at, day, event_type)."""
    session, number = dedup.event_identity(F.col("event_id"), F.col("session_id"), F.col("sequence"))
    e = _stream(s, d).select(F.col("received_at").cast("timestamp").alias("at"), "event_type", session.alias("session"), number.alias("number"))
    return ingest.once_within(e.withColumn("day", F.date_trunc("day", "at")), "at", ["day", "session", "number", "event_type"])


@query("stream_event_types", f"SELECT event_type, count(*) AS n FROM (SELECT DISTINCT date_trunc('day', received_at) AS day, {_EVENT}, event_type FROM agent_events) GROUP BY 1")
def _(s, d):
    return ingest.drain(ingest.running_counts(_events_once(s, d), ["event_type"]), _folder(s, "cp"), "update", _folder(s, "out"), ["event_type"])


@query("stream_daily_activity", f"SELECT day::TIMESTAMP AS window_start, event_type, count(*) AS n FROM (SELECT DISTINCT date_trunc('day', received_at) AS day, {_EVENT}, event_type FROM agent_events) GROUP BY 1, 2")
def _(s, d):
    counted = ingest.drain(ingest.windowed_activity(_events_once(s, d), watermark=None), _folder(s, "cp"), "update", _folder(s, "out"), ["window_start", "event_type"])
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "envelope_reasons",
    r"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(trim(event_id), '') = '' THEN 'event_id empty' WHEN coalesce(trim(session_id), '') = '' THEN 'session_id empty' WHEN event_id IS DISTINCT FROM concat_ws(':', session_id, CAST(sequence AS VARCHAR)) THEN 'event_id does not match' WHEN coalesce(trim(event_type), '') = '' THEN 'type empty'
    WHEN NOT (contains(coalesce(event_time, ''), 'T') AND (ends_with(coalesce(event_time, ''), 'Z') OR contains(coalesce(event_time, ''), '+'))) THEN 'timestamp' WHEN sequence IS NULL OR sequence < 0 THEN 'sequence' END AS reason FROM agent_events) GROUP BY 1""",
)
def _(s, d):
    return table(s, d, "agent_events").groupBy(ingest.envelope_error().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingested_events",
    r"""WITH v AS (SELECT * FROM agent_events WHERE coalesce(trim(session_id), '') <> '' AND event_id = concat_ws(':', session_id, CAST(sequence AS VARCHAR)) AND coalesce(trim(event_type), '') <> '' AND contains(event_time, 'T') AND (ends_with(event_time, 'Z') OR contains(event_time, '+')) AND sequence >= 0)
    SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM v) GROUP BY 1""",
)
def _(s, d):
    # The log as a stream of JSON lines, taken in twice from its start: what is committed stays single.
    where, log = _folder(s, "json"), _folder(s, "log")
    table(s, d, "agent_events").drop("delivery_id", "batch_id", "received_at").write.json(where)
    for _ in range(2):
        ingest.ingest(ingest.read_events(s, where), log, _folder(s, "cp")).awaitTermination()
    return ingest.replay(s, log).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
