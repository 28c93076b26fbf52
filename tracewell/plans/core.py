"""Queries and SQL of the data-processing problems of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.operators import dedup, hierarchy, nested, orphans, snapshots
from tracewell.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.file_changes(table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.evidence_orphans(*(table(spark, d, n) for n in ("links", "edges", "call_candidates", "entities", "nodes", "declarations")))


def p2_orphan_rates(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rates(p2_found(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.scope_hierarchy(table(spark, d, "scopes"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.scope_descendants(table(spark, d, "scopes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.analysis_facts(table(spark, d, "analysis_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_events(table(spark, d, "agent_events"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_orphan_rates": p2_orphan_rates, "p3_found": p3_found, "p3_descendants": p3_descendants, "p4_found": p4_found, "p5_found": p5_found}

_ID = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"

SQL_P1 = r"""
WITH f AS (
  SELECT repository_id, snapshot_no, delivery_id, delivered_at,
    array_to_string(list_filter(string_split(replace(relative_path, '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/') AS relative_path,
    nullif(regexp_extract(lower(content_digest), '([0-9a-f]{64})\s*$', 1), '') AS digest,
    nullif(trim(object_key), '') AS object_key
  FROM files
), deliveries AS (
  SELECT repository_id, snapshot_no, arg_max(delivery_id, delivered_at) AS delivery_id FROM f GROUP BY 1, 2
), ordered AS (
  SELECT *, lead(snapshot_no) OVER w AS next_no, lag(snapshot_no) OVER w AS prev_no
  FROM deliveries WINDOW w AS (PARTITION BY repository_id ORDER BY snapshot_no)
), rows AS (
  SELECT f.repository_id, f.snapshot_no, f.relative_path, o.next_no, o.prev_no, max(f.digest) AS digest, max(f.object_key) AS object_key
  FROM f JOIN ordered o USING (repository_id, snapshot_no, delivery_id) GROUP BY 1, 2, 3, 4, 5
), old AS (SELECT * FROM rows WHERE next_no IS NOT NULL), new AS (SELECT * FROM rows WHERE prev_no IS NOT NULL)
SELECT coalesce(new.repository_id, old.repository_id) AS repository_id,
  coalesce(new.snapshot_no, old.next_no) AS snapshot_no,
  coalesce(new.relative_path, old.relative_path) AS relative_path,
  CASE WHEN old.repository_id IS NULL THEN 'added' WHEN new.repository_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new FULL JOIN old ON new.repository_id = old.repository_id AND new.snapshot_no = old.next_no AND new.relative_path = old.relative_path
WHERE old.repository_id IS NULL OR new.repository_id IS NULL OR new.digest <> old.digest OR new.object_key <> old.object_key
"""

SQL_P2 = rf"""
WITH refs AS (
  SELECT 'links' AS ref_table, link_id AS record_id, NULL AS repository_id, {_ID.format("t.entity_id")} AS target_key, recorded_at
  FROM (SELECT link_id, recorded_at, unnest(targets) AS t FROM links)
  UNION ALL SELECT 'edges', edge_id, NULL, {_ID.format("target")}, recorded_at FROM edges
  UNION ALL SELECT 'call_candidates', record_id, repository_id, lower(trim(c.relative_path)) || '#' || c.declaration_id, recorded_at
  FROM (SELECT record_id, repository_id, recorded_at, unnest(candidates) AS c FROM call_candidates)
), lives AS (
  SELECT 'links' AS ref_table, NULL AS repository_id, {_ID.format("entity_id")} AS target_key, created_at, deleted_at FROM entities
  UNION SELECT 'edges', NULL, {_ID.format("node_id")}, created_at, deleted_at FROM nodes
  UNION SELECT 'call_candidates', repository_id, lower(trim(relative_path)) || '#' || declaration_id, created_at, deleted_at FROM declarations
)
SELECT r.ref_table, r.record_id, r.target_key, strftime(r.recorded_at, '%Y-%m') AS month_key,
  CASE WHEN count(l.target_key) = 0 THEN 'missing' WHEN coalesce(bool_or(l.deleted_at <= r.recorded_at), false) THEN 'deleted' ELSE 'late' END AS reason
FROM (SELECT DISTINCT * FROM refs WHERE target_key IS NOT NULL) r
LEFT JOIN lives l ON l.ref_table = r.ref_table AND l.target_key = r.target_key AND l.repository_id IS NOT DISTINCT FROM r.repository_id
GROUP BY r.ref_table, r.record_id, r.target_key, r.repository_id, r.recorded_at
HAVING NOT coalesce(bool_or(l.created_at <= r.recorded_at AND (l.deleted_at IS NULL OR r.recorded_at < l.deleted_at)), false)
"""

SQL_P5 = rf"""
WITH e AS (
  SELECT delivery_id, received_at,
    coalesce({_ID.format("session_id")}, nullif(regexp_extract({_ID.format("event_id")}, '^(.*):0*([0-9]+)$', 1), '')) AS session,
    coalesce(sequence, CAST(nullif(regexp_extract({_ID.format("event_id")}, '^(.*):0*([0-9]+)$', 2), '') AS BIGINT)) AS number
  FROM agent_events
)
SELECT delivery_id, session || ':' || number AS event_id
FROM (SELECT *, row_number() OVER (PARTITION BY session, number ORDER BY received_at, delivery_id) AS k FROM e)
WHERE k > 1
"""

SQL_P3 = r"""
WITH RECURSIVE latest AS (
  SELECT repository_id, relative_path, scope_id, arg_max(coalesce(parent_scope_id, -9), ingested_at) AS parent_id
  FROM scopes GROUP BY 1, 2, 3
), s AS (
  SELECT l.repository_id, l.relative_path, l.scope_id, p.scope_id AS parent_id
  FROM latest l LEFT JOIN latest p ON p.repository_id = l.repository_id AND p.relative_path = l.relative_path AND p.scope_id = l.parent_id
), down AS (
  SELECT repository_id, relative_path, scope_id, [scope_id] AS path FROM s WHERE parent_id IS NULL
  UNION ALL SELECT s.repository_id, s.relative_path, s.scope_id, list_append(d.path, s.scope_id)
  FROM s JOIN down d ON s.repository_id = d.repository_id AND s.relative_path = d.relative_path AND s.parent_id = d.scope_id
), below AS (
  SELECT repository_id, relative_path, a AS scope_id, count(*) - 1 AS n FROM (SELECT repository_id, relative_path, unnest(path) AS a FROM down) GROUP BY 1, 2, 3
), lost AS (SELECT s.* FROM s ANTI JOIN down d USING (repository_id, relative_path, scope_id)
), up AS (
  SELECT repository_id, relative_path, scope_id, parent_id AS spot FROM lost
  UNION SELECT u.repository_id, u.relative_path, u.scope_id, l.parent_id
  FROM up u JOIN lost l ON u.repository_id = l.repository_id AND u.relative_path = l.relative_path AND u.spot = l.scope_id
)
SELECT repository_id, relative_path, scope_id, path[1] AS root_scope_id, len(path) - 1 AS scope_depth,
  array_to_string(path, '/') AS scope_path, n AS n_descendants, 'ok' AS status
FROM down JOIN below USING (repository_id, relative_path, scope_id)
UNION ALL
SELECT repository_id, relative_path, scope_id, -1, -1, '', -1, CASE WHEN bool_or(spot = scope_id) THEN 'cycle' ELSE 'below_cycle' END
FROM up GROUP BY 1, 2, 3
"""

_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE [] :: JSON[] END"
_FACTS = {"declaration": ("declarations", "declaration_id", "$.name", "test_evidence", "kind"), "import": ("imports", "import_id", "$.module", "import_item", "target"), "call": ("calls", "call_id", "$.callee.written", "type_argument", "written")}
_PARTS = {"declaration": "test_evidence", "import": "items", "call": "type_arguments"}
SQL_P4 = f"""
WITH r AS (
  SELECT DISTINCT record_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN (payload :: JSON) ->> '$' ELSE payload END END AS p FROM analysis_records
), b AS (
  SELECT record_id, coalesce(json_extract(p, '$.envelope.body.files'), json_extract(p, '$.files')) AS v FROM r WHERE json_valid(p)
), f AS (
  SELECT record_id, unnest({_LIST.format("v")}) AS f FROM b
), g AS (
  SELECT record_id, f ->> '$.file.relative_path' AS relative_path, coalesce(json_extract(f, '$.facts'), f) AS f FROM f
), x AS (
  {" UNION ALL ".join(f"SELECT record_id, relative_path, '{k}' AS fact_kind, '{part}' AS part, '{pn}' AS part_name, '$.{idf}' AS id_path, '{name}' AS name_path, '$.{_PARTS[k]}' AS parts_path, unnest({_LIST.format(f"json_extract(f, '$.{arr}')")}) AS x FROM g" for k, (arr, idf, name, part, pn) in _FACTS.items())}
), facts AS (
  SELECT record_id, relative_path, fact_kind, part, part_name, CAST(trim(json_extract_string(x, id_path)) AS BIGINT) AS fact_id,
    CASE WHEN fact_kind = 'import' THEN coalesce(json_extract_string(x, name_path), '') ELSE json_extract_string(x, name_path) END AS fact_name, json_extract(x, parts_path) AS v FROM x
), parts AS (
  SELECT record_id, relative_path, part, part_name, fact_id, unnest(l) AS y, generate_subscripts(l, 1) - 1 AS item_index FROM (SELECT *, {_LIST.format("v")} AS l FROM facts)
)
SELECT DISTINCT record_id, relative_path, fact_kind, fact_id, CAST(-1 AS BIGINT) AS item_index, fact_name FROM facts
UNION SELECT DISTINCT record_id, relative_path, part, fact_id, CAST(item_index AS BIGINT), json_extract_string(y, '$.' || part_name) FROM parts
"""

SQL = {
    "p4_found": SQL_P4,
    "p1_found": SQL_P1,
    "p2_found": SQL_P2,
    "p2_orphan_rates": f"SELECT ref_table, month_key, reason, count(*) AS n_orphans, count(DISTINCT target_key) AS n_targets FROM (SELECT DISTINCT * FROM ({SQL_P2})) GROUP BY 1, 2, 3",
    "p3_found": SQL_P3,
    "p3_descendants": f"SELECT repository_id, relative_path, CAST(unnest(string_split(scope_path, '/')[:-2]) AS BIGINT) AS ancestor_id, scope_id FROM ({SQL_P3}) WHERE status = 'ok' AND scope_depth > 0",
    "p5_found": SQL_P5,
}
