"""Queries over the event log, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import identifiers
from tracewell.operators import memory, sessions, symbols, verify
from tracewell.session import kept
from tracewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ID = "nullif(regexp_replace(lower({}), '^\\s+|\\s+$', '', 'g'), '')"
_J = "json_extract_string(payload, '$.{}')"
#: One delivery of each event, with what the folds read.
EV = f"""(SELECT delivery_id, session, number, investigation, repository, event_type, at_us,
  {_J.format("path")} AS path, {_J.format("observation_kind")} AS okind, CAST({_J.format("line_start")} AS BIGINT) AS line_start, CAST({_J.format("line_end")} AS BIGINT) AS line_end,
  {_J.format("tool_call_id")} AS call, {_J.format("repository_operation")} AS operation, {_J.format("category")} AS category, {_J.format("tool_name")} AS tool_name, {_J.format("outcome")} AS outcome, {_J.format("model")} AS model, CAST({_J.format("ok")} AS BOOLEAN) AS ok,
  CAST({_J.format("input_tokens")} AS BIGINT) AS input_tokens, CAST({_J.format("output_tokens")} AS BIGINT) AS output_tokens, CAST({_J.format("output_bytes")} AS BIGINT) AS output_bytes
  FROM (SELECT *, row_number() OVER (PARTITION BY session, number ORDER BY received_at, delivery_id) AS k FROM (
    SELECT delivery_id, received_at, event_type, payload, {_ID.format("investigation_id")} AS investigation, {_ID.format("repository_id")} AS repository,
    epoch_us(TRY_CAST(trim(event_time) AS TIMESTAMPTZ)) AS at_us,
    coalesce({_ID.format("session_id")}, nullif(regexp_extract({_ID.format("event_id")}, '^(.*):0*([0-9]+)$', 1), '')) AS session,
    coalesce(sequence, CAST(nullif(regexp_extract({_ID.format("event_id")}, '^(.*):0*([0-9]+)$', 2), '') AS BIGINT)) AS number
    FROM agent_events)) WHERE k = 1)"""
SEEN = f"(SELECT * FROM {EV} WHERE event_type = 'source_observed' AND coalesce(path, '') <> '')"
FOLD = f"""(SELECT session, arg_min(investigation, number) FILTER (investigation IS NOT NULL) AS investigation, arg_min(repository, number) FILTER (repository IS NOT NULL) AS repository,
  count(*) AS n_events, min(number) AS first_number, max(number) AS last_number, min(at_us) AS started_us, max(at_us) AS ended_us,
  count(*) FILTER (event_type = 'model_call_completed') AS model_calls,
  coalesce(sum(input_tokens) FILTER (event_type = 'model_call_completed'), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens) FILTER (event_type = 'model_call_completed'), 0)::BIGINT AS output_tokens,
  count(*) FILTER (event_type = 'tool_call_started') AS tool_calls, count(*) FILTER (event_type = 'tool_call_completed' AND NOT ok) AS failed_tool_calls,
  count(*) FILTER (event_type = 'source_observed' AND coalesce(path, '') <> '') AS observations, count(*) FILTER (event_type = 'source_observed' AND okind = 'explicit_read') AS explicit_reads,
  max(CASE WHEN event_type = 'session_completed' THEN 1 ELSE 0 END) AS completed, max(CASE WHEN event_type = 'task_outcome' AND regexp_matches(coalesce(outcome, 'unknown'), 'fail|timeout') THEN 1 ELSE 0 END) AS failed FROM {EV} GROUP BY 1)"""


def events(s, d):
    """The clean log, which every fold starts from: written once for an application."""
    return kept(s, "clean-events", d, lambda: sessions.clean_events(table(s, d, "agent_events")))


def seen(s, d):
    return sessions.observations(events(s, d))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("p5_kept", f"SELECT session, number, event_type FROM {EV}")
def _(s, d):
    return sessions.clean_events(table(s, d, "agent_events")).select("session", "number", "event_type")


@query("session_fold", f"SELECT * FROM {FOLD}")
def _(s, d):
    return sessions.session_fold(events(s, d))


@query("session_parts_merged", f"SELECT * FROM {FOLD}")
def _(s, d):
    # Folded by halves and merged: equal to the whole fold.
    e = events(s, d)
    odd = F.col("number") % 2 == 1
    return sessions.merge_parts(sessions.session_fold(e.where(odd)).unionByName(sessions.session_fold(e.where(~odd))))


@query(
    "investigation_fold",
    f"""SELECT investigation, count(*) AS n_sessions, sum(n_events)::BIGINT AS n_events, sum(model_calls)::BIGINT AS model_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(tool_calls)::BIGINT AS tool_calls, min(started_us) AS started_us, max(ended_us) AS ended_us,
    CASE WHEN max(failed) = 1 THEN 'failed' WHEN min(completed) = 1 THEN 'completed' WHEN max(completed) = 1 THEN 'partial' ELSE 'open' END AS state FROM {FOLD} WHERE investigation IS NOT NULL GROUP BY 1""",
)
def _(s, d):
    return sessions.investigation_fold(sessions.session_fold(events(s, d)))


@query("usage_per_model", f"SELECT session, coalesce(model, 'unknown') AS model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM {EV} WHERE event_type = 'model_call_completed' GROUP BY 1, 2")
def _(s, d):
    m = events(s, d).where("event_type = 'model_call_completed'")
    return m.groupBy("session", F.coalesce("p.model", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum("p.input_tokens").alias("input_tokens"), F.sum("p.output_tokens").alias("output_tokens"))


@query("calls_per_tool", f"SELECT session, coalesce(tool_name, 'unknown') AS tool, count(*) AS calls FROM {EV} WHERE event_type = 'tool_call_started' GROUP BY 1, 2")
def _(s, d):
    return events(s, d).where("event_type = 'tool_call_started'").groupBy("session", F.coalesce("p.tool_name", F.lit("unknown")).alias("tool")).agg(F.count(F.lit(1)).alias("calls"))


@query("path_exposures", f"SELECT session, path, count(*) AS n, count(*) FILTER (okind = 'explicit_read') AS n_reads, count(*) FILTER (okind = 'search_snippet') AS n_snippets, min(number) AS first_number, max(number) AS last_number FROM {SEEN} GROUP BY 1, 2")
def _(s, d):
    return sessions.exposures(seen(s, d))


@query(
    "observed_ranges",
    f"""WITH r AS (SELECT session, path, line_start, max(line_end) AS line_end FROM {SEEN} WHERE line_start <= line_end GROUP BY 1, 2, 3),
    m AS (SELECT *, CASE WHEN line_start <= max(line_end) OVER (PARTITION BY session, path ORDER BY line_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY session, path ORDER BY line_start ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT session, path, min(line_start) AS line_start, max(line_end) AS line_end FROM i GROUP BY session, path, island""",
)
def _(s, d):
    return sessions.observed_ranges(seen(s, d))


@query("path_activity", f"SELECT repository, path, count(*) AS n, count(*) FILTER (okind = 'explicit_read') AS n_reads, count(DISTINCT session) AS n_sessions, count(DISTINCT investigation) AS n_investigations, min(at_us) AS first_us, max(at_us) AS last_us FROM {SEEN} GROUP BY 1, 2")
def _(s, d):
    return sessions.path_activity(seen(s, d))


DAILY = f"(SELECT repository, path, at_us // 86400000000 AS day, count(*) AS n, count(*) FILTER (okind = 'explicit_read') AS n_reads, count(DISTINCT investigation) AS n_investigations FROM {SEEN} WHERE at_us IS NOT NULL GROUP BY 1, 2, 3)"


@query("path_daily_buckets", f"WITH d AS {DAILY} SELECT d.* FROM d JOIN (SELECT repository, path, max(day) AS newest FROM d GROUP BY 1, 2) m ON m.repository = d.repository AND m.path = d.path WHERE day >= newest - 400")
def _(s, d):
    return sessions.daily_buckets(seen(s, d))


for _days in (7, 90):

    @query(
        f"path_activity_{_days}_days",
        f"""WITH x AS (SELECT *, at_us // 86400000000 AS day FROM {SEEN} WHERE at_us IS NOT NULL), m AS (SELECT repository, max(day) AS newest FROM x GROUP BY 1)
        SELECT x.repository, path, count(*) AS n, count(*) FILTER (okind = 'explicit_read') AS n_reads, count(DISTINCT investigation) AS n_investigations FROM x JOIN m ON m.repository = x.repository WHERE day >= newest - {_days} GROUP BY 1, 2""",
    )
    def _(s, d, days=_days):
        return sessions.sliding_activity(seen(s, d), days)


@query(
    "follow_ups",
    f"""WITH m AS (SELECT session, call FROM {EV} WHERE event_type = 'context_artifact_presented' AND call IS NOT NULL),
    e AS (SELECT session, number, row_number() OVER (PARTITION BY session ORDER BY number) AS at, CASE WHEN event_type = 'context_artifact_presented' THEN 'artifact' WHEN event_type = 'source_observed' THEN 'verification'
      WHEN event_type <> 'tool_call_started' OR (session, call) IN (SELECT session, call FROM m) THEN 'no' WHEN operation IN ('discovery_search', 'discovery_list') THEN 'discovery' WHEN operation = 'source_read' THEN 'verification' WHEN operation IN ('edit', 'build', 'test', 'runtime') THEN 'task_action'
      WHEN operation IS NULL AND category IN ('search', 'directory_list') THEN 'discovery' WHEN operation IS NULL AND category = 'file_read' THEN 'verification' ELSE 'unclassified' END AS kind FROM {EV} WHERE number IS NOT NULL),
    w AS (SELECT a.session, a.number AS start, e.at - a.at AS k, e.kind FROM e a LEFT JOIN e ON e.session = a.session AND e.at > a.at AND e.at <= a.at + 64 WHERE a.kind = 'artifact'),
    x AS (SELECT *, min(CASE WHEN kind IN ('artifact', 'task_action') THEN k END) OVER (PARTITION BY session, start) AS stop FROM w),
    f AS (SELECT session, start, count(kind) AS n_after, list(DISTINCT kind) AS seen FROM x WHERE stop IS NULL OR k <= stop GROUP BY 1, 2)
    SELECT session, start, n_after, coalesce(list_contains(seen, 'verification'), false) AS verified, CASE WHEN list_contains(seen, 'discovery') THEN 'discovery' WHEN list_contains(seen, 'artifact') THEN 'artifact' WHEN list_contains(seen, 'verification') THEN 'verification' WHEN list_contains(seen, 'task_action') THEN 'task_action' WHEN list_contains(seen, 'unclassified') THEN 'unclassified' ELSE 'none' END AS outcome FROM f""",
)
def _(s, d):
    return sessions.follow_ups(events(s, d))


@query(
    "output_percentiles",
    f"""WITH v AS (SELECT event_type, list_sort(list(output_bytes)) AS l FROM {EV} WHERE output_bytes IS NOT NULL GROUP BY 1)
    SELECT event_type, len(l) AS n, l[len(l)] AS most, l[CAST(floor((len(l) - 1) * 0.5) AS BIGINT) + 1] AS p50, l[CAST(floor((len(l) - 1) * 0.95) AS BIGINT) + 1] AS p95, l[CAST(floor((len(l) - 1) * 0.99) AS BIGINT) + 1] AS p99 FROM v""",
)
def _(s, d):
    flat = events(s, d).select("event_type", F.col("p.output_bytes").alias("v"))
    return sessions.floor_percentiles(flat, ["event_type"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(
    "tool_failure_rates",
    f"""WITH x AS (SELECT repository, count(*) AS n, count(*) FILTER (NOT ok) AS hits FROM {EV} WHERE event_type = 'tool_call_completed' AND ok IS NOT NULL GROUP BY 1), g AS (SELECT sum(hits) / sum(n) AS g FROM x)
    SELECT repository, n, hits, CASE WHEN n >= 5 THEN (hits + 3 * g) / (n + 3) ELSE g END AS rate FROM x, g""",
)
def _(s, d):
    t = events(s, d).where("event_type = 'tool_call_completed' and p.ok is not null").select("repository", (~F.col("p.ok")).alias("failed"))
    return sessions.shrunken_rates(t, ["repository"], "failed")


@query("mined_tool_sets", f"SELECT terms, count(*) AS n FROM (SELECT session, string_agg(DISTINCT tool_name, ',' ORDER BY tool_name) AS terms FROM {EV} WHERE event_type = 'tool_call_started' AND tool_name IS NOT NULL GROUP BY 1) GROUP BY 1 HAVING count(*) >= 2")
def _(s, d):
    t = events(s, d).where("event_type = 'tool_call_started' and p.tool_name is not null").select("session", F.col("p.tool_name").alias("tool"))
    return sessions.mined_recipes(t, ["session"], "tool")


@query(
    "similar_sessions",
    f"""WITH p AS (SELECT DISTINCT session AS entry, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path FROM {SEEN}), z AS (SELECT entry, count(*) AS size FROM p GROUP BY 1),
    h AS (SELECT a.entry AS query, b.entry, count(*) AS shared FROM p a JOIN p b ON a.path = b.path AND a.entry <> b.entry GROUP BY 1, 2)
    SELECT query, h.entry, shared, shared / (z.size + q.size - shared) AS similarity FROM h JOIN z ON z.entry = h.entry JOIN z q ON q.entry = h.query
    WHERE query IN (SELECT session FROM (SELECT session, min(delivery_id) AS first FROM {EV} GROUP BY 1) WHERE first % 20 = 0)""",
)
def _(s, d):
    # The sessions whose first delivery id is divisible by 20 are asked, against all, by the folders they read in.
    e = events(s, d)
    asked = e.groupBy(F.col("session").alias("entry")).agg(F.min("delivery_id").alias("first")).where("first % 20 = 0").select("entry")
    read = sessions.observations(e).withColumn("path", identifiers.directory(F.col("path")))
    return memory.similar_entries(memory.entries(read), asked)


@query("session_digests", f"SELECT entry, sha256(string_agg(path, chr(10) ORDER BY path)) AS digest FROM (SELECT DISTINCT session AS entry, path FROM {SEEN}) GROUP BY 1")
def _(s, d):
    return memory.digests(memory.entries(seen(s, d)))


#: What was read explicitly stands for symbols, what search snippets showed for observations; the first folder of a path stands for its file.
EXPOSED = f"""WITH o AS (SELECT session || ':' || number AS observation_id, repository AS repository_id, regexp_extract(path, '^([^/]*)/', 1) AS relative_path, line_start, line_end FROM {SEEN} WHERE line_end >= line_start AND okind = 'search_snippet'),
    d AS (SELECT DISTINCT repository AS repository_id, regexp_extract(path, '^([^/]*)/', 1) AS relative_path, number AS declaration_id, line_start - 1 AS a, line_end AS b FROM {SEEN} WHERE line_end >= line_start AND okind = 'explicit_read'),
    m AS (SELECT o.observation_id, d.*, CASE WHEN NOT (line_start - 1 < b AND a < line_end) THEN 'none' WHEN a <= line_start - 1 AND line_end <= b AND NOT (a = line_start - 1 AND b = line_end) THEN 'inside' WHEN line_start - 1 <= a AND b <= line_end THEN 'covers' ELSE 'partial' END AS overlap FROM o JOIN d ON d.repository_id = o.repository_id AND d.relative_path = o.relative_path)
    SELECT observation_id, repository_id, relative_path, declaration_id, overlap, row_number() OVER (PARTITION BY observation_id ORDER BY b - a, declaration_id) - 1 AS depth FROM m WHERE overlap <> 'none'"""


@query("symbol_exposures", EXPOSED)
def _(s, d):
    return symbols.symbol_exposures(_observed(s, d), _declared(s, d))


def _folder():
    return F.regexp_extract("path", "^([^/]*)/", 1).alias("relative_path")


def _observed(s, d):
    o = seen(s, d).where("kind = 'search_snippet'")
    return o.select(F.concat_ws(":", "session", F.col("number").cast("string")).alias("observation_id"), F.col("repository").alias("repository_id"), _folder(), "line_start", "line_end", "session", "investigation")


def _declared(s, d):
    r = seen(s, d).where("kind = 'explicit_read' and line_end >= line_start")
    span = F.struct((F.col("line_start") - 1).alias("row_start"), (F.col("line_end") - 1).alias("row_end"))
    return r.select(F.col("repository").alias("repository_id"), _folder(), F.col("number").alias("declaration_id"), span.alias("span")).distinct()


@query(
    "symbol_activity",
    f"""SELECT x.repository_id, x.relative_path, declaration_id, count(*) AS n, count(*) FILTER (overlap = 'inside') AS n_inside, count(*) FILTER (overlap = 'covers') AS n_covers, count(*) FILTER (overlap = 'partial') AS n_partial, count(DISTINCT session) AS n_sessions, count(DISTINCT investigation) AS n_investigations
    FROM ({EXPOSED}) x JOIN (SELECT session || ':' || number AS observation_id, session, investigation FROM {SEEN}) o ON o.observation_id = x.observation_id GROUP BY 1, 2, 3""",
)
def _(s, d):
    o = _observed(s, d)
    return symbols.symbol_activity(symbols.symbol_exposures(o, _declared(s, d)), o)


@query(
    "verify_fold",
    f"""WITH f AS {FOLD}, i AS (SELECT investigation, count(*) AS s, sum(n_events) AS n FROM f WHERE investigation IS NOT NULL GROUP BY 1), p AS (SELECT investigation, count(*) AS s, sum(n_events) AS n FROM f WHERE investigation IS NOT NULL AND first_number % 2 = 1 GROUP BY 1)
    SELECT i.investigation AS id, 'totals' AS reason FROM i LEFT JOIN p ON p.investigation = i.investigation WHERE i.s IS DISTINCT FROM p.s OR i.n IS DISTINCT FROM p.n""",
)
def _(s, d):
    # Sessions that begin at an even number are withheld: their investigations must be found out.
    f = sessions.session_fold(events(s, d))
    return verify.verify_fold(f.where("first_number % 2 = 1"), sessions.investigation_fold(f))


@query("sessions_derived_late", f"SELECT * FROM {FOLD}")
def _(s, d):
    # Every third event comes after the others: equal to the whole fold.
    e = events(s, d)
    late = F.coalesce(F.col("number") % 3 == 1, F.lit(False))
    return sessions.derive_incrementally(sessions.session_fold(e.where(~late)), e, e.where(late))


@query("event_type_counts", f"SELECT event_type, count(*) AS n FROM {EV} GROUP BY 1")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
