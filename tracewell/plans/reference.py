"""Queries over the fact, link, candidate and graph tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I
from tracewell.functions.text import squash_id
from tracewell.operators import graph, joins, lookups, symbols, verify
from tracewell.operators import query as text_query
from tracewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rows repeat in the tables; a query starts from distinct rows, and from the nodes and declarations that last.
N = "(SELECT DISTINCT node_id, repository_id, node_key, node_kind, language, relative_path, label, disposition_kind FROM nodes WHERE deleted_at IS NULL)"
D = "(SELECT DISTINCT repository_id, relative_path, declaration_id, scope_id, decl_kind, decl_name, span, flags, test_evidence FROM declarations WHERE deleted_at IS NULL)"
S = "(SELECT DISTINCT repository_id, relative_path, scope_id, parent_scope_id, scope_kind, scope_name, span FROM scopes)"
E_ = "(SELECT DISTINCT edge_id, repository_id, edge_kind, evidence_class, rule_id, lower(trim(source)) AS source, nullif(regexp_replace(lower(target), '^\\s+|\\s+$', '', 'g'), '') AS target, candidate_set_id, outcome FROM edges)"
L = "(SELECT DISTINCT link_id, repository_id, link_kind, rule_id, language, origin, outcome, targets, reason FROM links)"
C = "(SELECT DISTINCT record_id, repository_id, rule_id, language, origin, written, outcome, candidates, reason FROM call_candidates)"
T = "(SELECT DISTINCT entity_id, repository_id, structural_kind, language, entity_key, files FROM entities WHERE deleted_at IS NULL)"
F_ = "(SELECT DISTINCT repository_id, snapshot_no, relative_path, language, source_bytes, truncated, content_digest, analysis_status FROM files)"


def nodes(s, d):
    return table(s, d, "nodes").where("deleted_at is null").select("node_id", "repository_id", "node_key", "node_kind", "language", "relative_path", "label", "disposition_kind").distinct()


def declarations(s, d):
    return table(s, d, "declarations").where("deleted_at is null").select("repository_id", "relative_path", "declaration_id", "scope_id", "decl_kind", "decl_name", "span", "flags", "test_evidence").distinct()


def scopes(s, d):
    return table(s, d, "scopes").select("repository_id", "relative_path", "scope_id", "parent_scope_id", "scope_kind", "scope_name", "span").distinct()


def edges(s, d):
    e = table(s, d, "edges")
    return e.select("edge_id", "repository_id", "edge_kind", "evidence_class", "rule_id", squash_id(F.col("source")).alias("source"), squash_id(F.col("target")).alias("target"), "candidate_set_id", "outcome").distinct()


def links(s, d):
    return table(s, d, "links").select("link_id", "repository_id", "link_kind", "rule_id", "language", "origin", "outcome", "targets", "reason").distinct()


def candidates(s, d):
    return table(s, d, "call_candidates").select("record_id", "repository_id", "rule_id", "language", "origin", "written", "outcome", "candidates", "reason").distinct()


def entities(s, d):
    return table(s, d, "entities").where("deleted_at is null").select("entity_id", "repository_id", "structural_kind", "language", "entity_key", "files").distinct()


def files(s, d):
    return table(s, d, "files").select("repository_id", "snapshot_no", "relative_path", "language", "source_bytes", "truncated", "content_digest", "analysis_status").distinct()


def _terms(column: str) -> str:
    """The SQL of `identifier_terms`: blanks at every boundary, then divided at what is no letter or digit."""
    out = column
    for a, b in ((r"\p{Ll}", r"\p{Lu}"), (r"\p{Lu}", r"\p{Lu}\p{Ll}"), (r"\p{L}", r"\p{N}"), (r"\p{N}", r"\p{L}")):
        for _ in range(2):  # boundaries may overlap
            out = f"regexp_replace({out}, '({a})({b})', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({out}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda x: x <> '')"


def _ranked(query: str, terms: list[str], k: int) -> str:
    want = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    text = "CASE WHEN node_kind IN ('declaration', 'entity') THEN label WHEN node_kind = 'file' THEN relative_path END"
    return f"""WITH n AS (SELECT *, {_terms("label")} AS own, {_terms("coalesce(relative_path, '')")} AS way, {_terms(f"coalesce({text}, '')")} AS held FROM {N}),
    s AS (SELECT node_id, node_key, CASE WHEN lower(label) = '{query}' THEN 1000 ELSE 0 END + CASE WHEN len(list_intersect(list_distinct(own), {want})) = {len(terms)} THEN 400 ELSE 0 END + 100 * len(list_intersect(list_distinct(own), {want})) + 30 * len(list_intersect(list_distinct(way), {want}))
      + CASE node_kind WHEN 'declaration' THEN 20 WHEN 'entity' THEN 15 WHEN 'file' THEN 10 WHEN 'import' THEN 4 WHEN 'call' THEN 2 ELSE 0 END AS score FROM n WHERE list_has_any(held, {want}))
    SELECT node_id, node_key, CAST(score AS INT) AS score, row_number() OVER (ORDER BY score DESC, node_key, node_id) AS rank, count(*) OVER () AS total FROM s ORDER BY score DESC, node_key, node_id LIMIT {k}"""


TRAILS = f"""(WITH RECURSIVE e AS {E_}, w AS (SELECT node_id AS seed, node_id, 0 AS depth, [] :: VARCHAR[] AS trail FROM {N} WHERE node_kind = 'entity' UNION ALL SELECT w.seed, e.target, w.depth + 1, list_append(w.trail, e.edge_id) FROM w JOIN e ON e.source = w.node_id WHERE w.depth < {graph.PATH_DEPTH} AND NOT list_contains(w.trail, e.edge_id))
    SELECT seed, node_id, depth, trail FROM w WHERE depth > 0)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_DECL = "repository_id, relative_path, declaration_id"
DK = ["repository_id", "relative_path", "declaration_id"]

# exact lookups


def _least(df: DataFrame, column: str):
    """The least value of a column: what an exact lookup asks for."""
    return df.agg(F.min(column)).scalar()


@query("lookup_declarations_named", f"SELECT {_DECL}, decl_kind FROM {D} WHERE decl_name = (SELECT min(decl_name) FROM {D})")
def _(s, d):
    c = declarations(s, d)
    return lookups.declarations_named(c, _least(c, "decl_name")).select(*DK, "decl_kind")


@query("lookup_import_items", f"SELECT node_id, relative_path FROM {N} WHERE node_kind = 'import' AND label = (SELECT min(label) FROM {N} WHERE node_kind = 'import')")
def _(s, d):
    i = nodes(s, d).where("node_kind = 'import'").withColumnRenamed("label", "target")
    return lookups.import_items_targeting(i, _least(i, "target")).select("node_id", "relative_path")


@query("lookup_calls_named", f"SELECT record_id, origin.relative_path AS relative_path, outcome FROM {C} WHERE written = (SELECT min(written) FROM call_candidates)")
def _(s, d):
    c = candidates(s, d)
    return lookups.calls_named(c, _least(c, "written")).select("record_id", F.col("origin.relative_path").alias("relative_path"), "outcome")


@query("lookup_test_declarations", f"SELECT {_DECL}, len(test_evidence) AS n_evidence FROM {D} WHERE len(test_evidence) > 0")
def _(s, d):
    return lookups.test_declarations(declarations(s, d)).select(*DK, F.size("test_evidence").alias("n_evidence"))


@query("lookup_file_by_path", f"SELECT repository_id, snapshot_no, source_bytes FROM {F_} WHERE relative_path = (SELECT min(relative_path) FROM files)")
def _(s, d):
    f = files(s, d)
    return lookups.where_equal(f, "relative_path", _least(f, "relative_path")).select("repository_id", "snapshot_no", "source_bytes")


@query("lookup_distinct_names", "SELECT DISTINCT decl_name FROM declarations WHERE deleted_at IS NULL AND decl_name IS NOT NULL")
def _(s, d):
    return lookups.distinct_sorted(declarations(s, d), "decl_name")


@query("lookup_distinct_import_targets", f"SELECT DISTINCT label FROM {N} WHERE node_kind = 'import' AND label IS NOT NULL")
def _(s, d):
    return lookups.distinct_sorted(nodes(s, d).where("node_kind = 'import'"), "label")


@query("lookup_distinct_callees", "SELECT DISTINCT written FROM call_candidates WHERE written IS NOT NULL")
def _(s, d):
    return lookups.distinct_sorted(candidates(s, d), "written")


for _name, _frame, _sql, _col, _values in (
    ("links_with_outcome", links, L, "outcome", ["exact", "ambiguous", "unresolved", "out_of_scope"]),
    ("candidates_with_outcome", candidates, C, "outcome", ["no_candidate", "single_candidate", "multiple_candidates", "out_of_scope"]),
    ("links_of_kind", links, L, "link_kind", ["use_path", "import_path", "module_file"]),
    ("links_by_rule", links, L, "rule_id", ["rust.import.util_path"]),
    ("candidates_by_rule", candidates, C, "rule_id", ["go.call.local"]),
):
    for _v in _values:
        _id = "link_id" if _frame is links else "record_id"
        query(f"{_name}_{_v.replace('.', '_')}", f"SELECT {_id}, repository_id, rule_id FROM {_sql} WHERE {_col} = '{_v}'")(
            lambda s, d, f=_frame, c=_col, v=_v, i=_id: lookups.where_equal(f(s, d), c, v).select(i, "repository_id", "rule_id")
        )


_TARGETS = "(SELECT {i} AS id, unnest({a}) AS t FROM {t})"
for _prefix, _frame, _sql, _id, _array in (("links", links, L, "link_id", "targets"), ("candidates", candidates, C, "record_id", "candidates")):
    _spread = _TARGETS.format(i=_id, a=_array, t=_sql)
    query(f"{_prefix}_from_file", f"SELECT {_id} AS id, outcome FROM {_sql} WHERE origin.relative_path = (SELECT min(origin.relative_path) FROM {_sql})")(
        lambda s, d, f=_frame, i=_id: (lambda r: lookups.from_file(r, _least(r, "origin.relative_path")).select(F.col(i).alias("id"), "outcome"))(f(s, d))
    )
    query(f"{_prefix}_into_file", f"SELECT DISTINCT id FROM {_spread} WHERE t.relative_path = (SELECT min(t.relative_path) FROM {_spread})")(
        lambda s, d, f=_frame, i=_id, a=_array: (lambda r: lookups.into_file(r, a, r.select(F.explode(a).alias("t")).agg(F.min("t.relative_path")).first()[0]).select(F.col(i).alias("id")))(f(s, d))
    )
    query(
        f"{_prefix}_into_declaration",
        f"WITH m AS (SELECT min(struct_pack(p := t.relative_path, n := t.declaration_id)) AS m FROM {_spread} WHERE t.relative_path IS NOT NULL AND t.declaration_id IS NOT NULL) SELECT DISTINCT id FROM {_spread}, m WHERE t.relative_path = m.m.p AND t.declaration_id = m.m.n",
    )(
        lambda s, d, f=_frame, i=_id, a=_array: (
            lambda r: (lambda m: lookups.into_declaration(r, a, m.p, m.n).select(F.col(i).alias("id")))(
                r.select(F.explode(a).alias("t")).where("t.relative_path is not null and t.declaration_id is not null").agg(F.min(F.struct(F.col("t.relative_path").alias("p"), F.col("t.declaration_id").alias("n")))).first()[0]
            )
        )(f(s, d))
    )


@query("candidates_per_file", f"SELECT origin.relative_path AS relative_path, count(*) AS n, count(*) FILTER (outcome = 'single_candidate') AS n_single FROM {C} GROUP BY 1")
def _(s, d):
    return candidates(s, d).groupBy(F.col("origin.relative_path").alias("relative_path")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "single_candidate").alias("n_single"))


@query("lookup_entity", f"SELECT entity_id, entity_key FROM {T} WHERE entity_id = (SELECT min(entity_id) FROM entities WHERE deleted_at IS NULL)")
def _(s, d):
    e = entities(s, d)
    return e.join(F.broadcast(e.agg(F.min("entity_id").alias("entity_id"))), "entity_id").select("entity_id", "entity_key")


@query("find_nodes_by_name", f"SELECT node_id, node_key FROM {N} WHERE label = (SELECT min(label) FROM {N} WHERE node_kind = 'call') AND node_kind IN ('declaration', 'call', 'import')")
def _(s, d):
    n = nodes(s, d)
    return lookups.find_nodes(n, _least(n.where("node_kind = 'call'"), "label"), "name").select("node_id", "node_key")


@query("find_nodes_by_path", f"WITH m AS (SELECT regexp_extract(min(relative_path), '[^/]*$') AS m FROM {N} WHERE node_kind = 'declaration') SELECT node_id, node_key FROM {N}, m WHERE relative_path = m OR ends_with(relative_path, '/' || m)")
def _(s, d):
    n = nodes(s, d)
    term = n.where("node_kind = 'declaration'").agg(I.basename(F.min("relative_path"))).first()[0]
    return lookups.find_nodes(n, term, "path").select("node_id", "node_key")


@query("edges_matching", f"SELECT e.edge_id FROM {E_} e LEFT JOIN {N} t ON t.node_id = e.target LEFT JOIN {N} f ON f.node_id = e.source WHERE e.edge_kind IN ('contains', 'call_candidate') AND coalesce(t.language, f.language) = 'python'")
def _(s, d):
    return lookups.edges_matching(edges(s, d), nodes(s, d), ["contains", "call_candidate"], None, "python").select("edge_id")


# aggregations


@query("links_per_outcome", f"SELECT outcome, count(*) AS n FROM {L} GROUP BY 1")
def _(s, d):
    return links(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("links_per_rule", f"SELECT rule_id, count(*) AS n FROM {L} GROUP BY 1")
def _(s, d):
    return links(s, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("candidate_cardinality", f"SELECT count(*) FILTER (outcome = 'no_candidate') AS n_none, count(*) FILTER (outcome = 'single_candidate') AS n_single, count(*) FILTER (outcome = 'multiple_candidates') AS n_multiple, count(*) FILTER (outcome = 'out_of_scope') AS n_out FROM {C}")
def _(s, d):
    is_ = lambda v: F.count_if(F.col("outcome") == v)
    return candidates(s, d).agg(is_("no_candidate").alias("n_none"), is_("single_candidate").alias("n_single"), is_("multiple_candidates").alias("n_multiple"), is_("out_of_scope").alias("n_out"))


@query("candidates_per_rule", f"SELECT rule_id, count(*) AS n FROM {C} GROUP BY 1")
def _(s, d):
    return candidates(s, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("graph_node_stats", f"SELECT node_kind, language, disposition_kind, count(*) AS n FROM {N} GROUP BY 1, 2, 3")
def _(s, d):
    return nodes(s, d).groupBy("node_kind", "language", "disposition_kind").agg(F.count(F.lit(1)).alias("n"))


@query("graph_edge_stats", f"SELECT evidence_class, edge_kind, count(*) AS n, count(DISTINCT candidate_set_id) AS n_sets FROM {E_} GROUP BY 1, 2")
def _(s, d):
    return edges(s, d).groupBy("evidence_class", "edge_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("candidate_set_id").alias("n_sets"))


@query("language_stats", f"SELECT language, count(*) AS n_files, sum(source_bytes) AS n_bytes, count(*) FILTER (truncated) AS n_truncated FROM {F_} GROUP BY 1")
def _(s, d):
    return files(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("source_bytes").alias("n_bytes"), F.count_if("truncated").alias("n_truncated"))


@query("coverage_totals", f"SELECT analysis_status, count(*) AS n FROM {F_} GROUP BY 1")
def _(s, d):
    return files(s, d).groupBy("analysis_status").agg(F.count(F.lit(1)).alias("n"))


@query("declaration_inventory", f"SELECT repository_id, count(*) AS n, count(DISTINCT relative_path) AS n_files, count(DISTINCT decl_kind) AS n_kinds, string_agg(DISTINCT decl_kind, ',' ORDER BY decl_kind) AS kinds FROM {D} GROUP BY 1")
def _(s, d):
    return declarations(s, d).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("relative_path").alias("n_files"), F.countDistinct("decl_kind").alias("n_kinds"), F.array_join(F.sort_array(F.collect_set("decl_kind")), ",").alias("kinds"))


@query("graph_digest", f"SELECT repository_id, CAST(sum(CAST('0x' || substr(md5(node_id || '|' || node_key || '|' || node_kind), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM {N} GROUP BY 1")
def _(s, d):
    # A sum of hashes of the nodes' lines: their order does not matter, and no repository is gathered in one value.
    line = F.concat_ws("|", "node_id", "node_key", "node_kind")
    word = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(38,0)")
    return nodes(s, d).groupBy("repository_id").agg(F.sum(word).cast("decimal(38,0)").cast("string").alias("digest"))


@query("flag_counts", f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM {D}) GROUP BY 1")
def _(s, d):
    return declarations(s, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("disposition_report", f"SELECT language, node_kind, disposition_kind, count(*) AS n FROM {N} WHERE disposition_kind IS NOT NULL GROUP BY GROUPING SETS ((), (language), (node_kind, disposition_kind))")
def _(s, d):
    n = nodes(s, d).where("disposition_kind is not null")
    return n.groupingSets([[], ["language"], ["node_kind", "disposition_kind"]], "language", "node_kind", "disposition_kind").agg(F.count(F.lit(1)).alias("n"))


# joins


@query(
    "innermost_callable",
    f"""WITH c AS (SELECT DISTINCT {_DECL}, decl_kind, span FROM {D}) SELECT d.repository_id, d.relative_path, d.declaration_id, arg_min(o.declaration_id, (o.span.byte_end - o.span.byte_start) * 1000000000 + o.declaration_id) AS owner_id
    FROM c d JOIN c o ON o.repository_id = d.repository_id AND o.relative_path = d.relative_path AND o.span.byte_start <= d.span.byte_start AND d.span.byte_end <= o.span.byte_end
    WHERE o.decl_kind IN ('function', 'method') AND d.decl_kind NOT IN ('function', 'method') GROUP BY 1, 2, 3""",
)
def _(s, d):
    c = declarations(s, d).select(*DK, "decl_kind", "span").distinct()
    callable_ = F.col("decl_kind").isin("function", "method")
    return joins.innermost_owner(c.where(~callable_), c.where(callable_), ["repository_id", "relative_path"], "declaration_id", "declaration_id")


@query(
    "declaration_nesting",
    f"""SELECT a.repository_id, a.relative_path, a.declaration_id, count(b.declaration_id) AS n_holders FROM (SELECT DISTINCT {_DECL}, span FROM {D}) a
    LEFT JOIN (SELECT DISTINCT {_DECL}, span FROM {D}) b ON a.repository_id = b.repository_id AND a.relative_path = b.relative_path AND a.declaration_id <> b.declaration_id AND b.span.byte_start <= a.span.byte_start AND a.span.byte_end <= b.span.byte_end GROUP BY 1, 2, 3""",
)
def _(s, d):
    return joins.nesting_depth(declarations(s, d).select(*DK, "span").distinct(), ["repository_id", "relative_path"], "declaration_id")


@query(
    "declaration_node_join",
    f"SELECT d.repository_id, d.relative_path, d.declaration_id, n.node_id FROM (SELECT DISTINCT {_DECL} FROM {D}) d JOIN {N} n ON n.repository_id = d.repository_id AND n.node_key = 'decl:' || d.relative_path || '#' || d.declaration_id",
)
def _(s, d):
    k = declarations(s, d).select(*DK).distinct().withColumn("node_key", F.concat(F.lit("decl:"), F.col("relative_path"), F.lit("#"), F.col("declaration_id").cast("string")))
    return k.join(nodes(s, d).select("repository_id", "node_key", "node_id"), ["repository_id", "node_key"]).select(*DK, "node_id")


@query(
    "nearest_package_root",
    f"""WITH e AS (SELECT DISTINCT repository_id, regexp_extract(unnest(files), '^(.*)/[^/]*$', 1) AS root FROM {T}), f AS (SELECT DISTINCT repository_id, relative_path FROM {D})
    SELECT f.repository_id, f.relative_path, arg_max(e.root, length(e.root)) AS root FROM f JOIN e ON e.repository_id = f.repository_id AND (e.root = '' OR f.relative_path LIKE e.root || '/%') GROUP BY 1, 2""",
)
def _(s, d):
    held = entities(s, d).select("repository_id", F.explode("files").alias("f"))
    roots = held.select("repository_id", I.directory(F.col("f")).alias("root")).distinct()
    return joins.nearest_ancestor(declarations(s, d).select("repository_id", "relative_path").distinct(), roots, ["repository_id"], "relative_path", "root")


@query("same_directory_members", f"SELECT repository_id, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS dir, language, count(DISTINCT relative_path) AS n_files FROM {N} WHERE node_kind = 'file' GROUP BY 1, 2, 3")
def _(s, d):
    f = nodes(s, d).where("node_kind = 'file'")
    return f.groupBy("repository_id", I.directory(F.col("relative_path")).alias("dir"), "language").agg(F.countDistinct("relative_path").alias("n_files"))


@query(
    "name_resolution",
    f"""SELECT c.record_id, count(DISTINCT d.relative_path || '#' || d.declaration_id) AS n_named
    FROM {C} c LEFT JOIN {D} d ON d.repository_id = c.repository_id AND d.decl_name = c.written GROUP BY 1""",
)
def _(s, d):
    # Declarations are counted per name before the join: a common name meets its calls once each.
    named = declarations(s, d).groupBy("repository_id", F.col("decl_name").alias("written")).agg(F.countDistinct("relative_path", "declaration_id").alias("n"))
    return candidates(s, d).select("record_id", "repository_id", "written").join(named, ["repository_id", "written"], "left").select("record_id", F.coalesce("n", F.lit(0)).alias("n_named"))


@query(
    "snapshot_states",
    """WITH f AS (SELECT repository_id, snapshot_no, relative_path, max(content_digest) AS g FROM files WHERE repository_id IS NOT NULL AND snapshot_no IS NOT NULL AND relative_path IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT repository_id, snapshot_no, lead(snapshot_no) OVER (PARTITION BY repository_id ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT repository_id, snapshot_no FROM f)),
    c AS (SELECT f.repository_id, f.snapshot_no, relative_path, g FROM f JOIN m ON m.repository_id = f.repository_id AND m.next_no = f.snapshot_no), p AS (SELECT f.repository_id, m.next_no AS snapshot_no, relative_path, g FROM f JOIN m ON m.repository_id = f.repository_id AND m.snapshot_no = f.snapshot_no WHERE m.next_no IS NOT NULL)
    SELECT coalesce(c.repository_id, p.repository_id) AS repository_id, coalesce(c.snapshot_no, p.snapshot_no) AS snapshot_no, coalesce(c.relative_path, p.relative_path) AS relative_path,
    CASE WHEN p.repository_id IS NULL THEN 'added' WHEN c.repository_id IS NULL THEN 'deleted' WHEN c.g IS NOT DISTINCT FROM p.g THEN 'reused' ELSE 'changed' END AS state
    FROM c FULL JOIN p ON c.repository_id = p.repository_id AND c.snapshot_no = p.snapshot_no AND c.relative_path = p.relative_path""",
)
def _(s, d):
    # Each snapshot against the next: both sides under the number of the later one.
    f = table(s, d, "files").where("repository_id is not null and snapshot_no is not null and relative_path is not null").groupBy("repository_id", "snapshot_no", "relative_path").agg(F.max("content_digest").alias("g"))
    order = Window.partitionBy("repository_id").orderBy("snapshot_no")
    m = table(s, d, "files").where("repository_id is not null and snapshot_no is not null").select("repository_id", "snapshot_no").distinct().select("*", F.lead("snapshot_no").over(order).alias("next_no"), F.lag("snapshot_no").over(order).alias("prior_no"))
    j = f.join(m, ["repository_id", "snapshot_no"])
    now = j.where("prior_no is not null").select("repository_id", "snapshot_no", "relative_path", "g")
    before = j.where("next_no is not null").select("repository_id", F.col("next_no").alias("snapshot_no"), "relative_path", "g")
    return joins.incremental_snapshot(now, before, ["repository_id", "snapshot_no", "relative_path"], ["g"])


@query(
    "innermost_callable_of_scopes",
    f"""WITH i AS (SELECT DISTINCT repository_id, relative_path, scope_id, span FROM {S} WHERE scope_kind NOT IN ('function', 'method', 'closure', 'lambda')), o AS (SELECT DISTINCT repository_id, relative_path, scope_id, span FROM {S} WHERE scope_kind IN ('function', 'method', 'closure', 'lambda'))
    SELECT i.repository_id, i.relative_path, i.scope_id, arg_min(o.scope_id, (o.span.byte_end - o.span.byte_start) * 1000000000 + o.scope_id) AS owner_id
    FROM i JOIN o ON o.repository_id = i.repository_id AND o.relative_path = i.relative_path AND o.span.byte_start <= i.span.byte_start AND i.span.byte_end <= o.span.byte_end GROUP BY 1, 2, 3""",
)
def _(s, d):
    k = ["repository_id", "relative_path"]
    all_ = scopes(s, d)
    callable_ = F.col("scope_kind").isin("function", "method", "closure", "lambda")
    pick = lambda c: all_.where(c).select(*k, "scope_id", "span").distinct()
    return joins.innermost_owner(pick(~callable_), pick(callable_), k, "scope_id", "scope_id")


# windows, ranking, sets


@query(
    "per_path_symbol_cap",
    f"SELECT repository_id, relative_path, declaration_id, k FROM (SELECT {_DECL}, row_number() OVER (PARTITION BY repository_id, relative_path ORDER BY span.byte_end - span.byte_start DESC, declaration_id) AS k FROM (SELECT DISTINCT {_DECL}, span FROM {D})) WHERE k <= 2",
)
def _(s, d):
    w = Window.partitionBy("repository_id", "relative_path").orderBy(F.desc(joins.span_length("span")), "declaration_id")
    return declarations(s, d).select(*DK, "span").distinct().withColumn("k", F.row_number().over(w)).where("k <= 2").select(*DK, "k")


@query(
    "depth_by_span",
    f"SELECT {_DECL}, row_number() OVER (PARTITION BY repository_id, relative_path ORDER BY span.byte_end - span.byte_start, declaration_id) - 1 AS depth FROM (SELECT DISTINCT {_DECL}, span FROM {D})",
)
def _(s, d):
    w = Window.partitionBy("repository_id", "relative_path").orderBy(joins.span_length("span"), "declaration_id")
    return declarations(s, d).select(*DK, "span").distinct().select(*DK, (F.row_number().over(w) - 1).alias("depth"))


@query("ranked_seeds", _ranked("apply batch", ["apply", "batch"], 50))
def _(s, d):
    return graph.ranked_seeds(nodes(s, d), "apply batch", ["apply", "batch"], I.identifier_terms, 50)


@query("running_budget", f"SELECT repository_id, relative_path, n_bytes, total FROM (SELECT repository_id, relative_path, n_bytes, sum(n_bytes) OVER (PARTITION BY repository_id ORDER BY n_bytes DESC, relative_path) AS total FROM (SELECT repository_id, relative_path, max(source_bytes) AS n_bytes FROM files GROUP BY 1, 2)) WHERE total <= 1000000")
def _(s, d):
    f = table(s, d, "files").groupBy("repository_id", "relative_path").agg(F.max("source_bytes").alias("n_bytes"))
    w = Window.partitionBy("repository_id").orderBy(F.desc("n_bytes"), "relative_path").rowsBetween(Window.unboundedPreceding, 0)
    return f.withColumn("total", F.sum("n_bytes").over(w)).where("total <= 1000000")


@query("canonical_candidate_sets", f"SELECT record_id, string_agg(DISTINCT c.relative_path || '#' || c.declaration_id, ',' ORDER BY c.relative_path || '#' || c.declaration_id) AS members FROM (SELECT record_id, unnest(candidates) AS c FROM {C}) WHERE c.relative_path IS NOT NULL AND c.declaration_id IS NOT NULL GROUP BY 1")
def _(s, d):
    member = F.transform(F.filter("candidates", lambda c: c.relative_path.isNotNull() & c.declaration_id.isNotNull()), lambda c: F.concat_ws("#", c.relative_path, c.declaration_id.cast("string")))
    return candidates(s, d).where(F.col("candidates").isNotNull()).select("record_id", F.array_join(lookups.canonical_set(member), ",").alias("members")).where("members <> ''")


@query("candidate_outcomes", f"SELECT CASE WHEN outcome = 'out_of_scope' THEN 'out_of_scope' WHEN coalesce(len(candidates), 0) = 0 THEN 'no_candidate' WHEN len(candidates) = 1 THEN 'single_candidate' ELSE 'multiple_candidates' END AS derived, outcome, count(*) AS n FROM {C} GROUP BY 1, 2")
def _(s, d):
    derived = lookups.cardinality_outcome(F.col("candidates"), F.col("outcome") == "out_of_scope")
    return candidates(s, d).groupBy(derived.alias("derived"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("link_outcomes", f"SELECT CASE WHEN outcome = 'out_of_scope' THEN 'out_of_scope' WHEN coalesce(len(targets), 0) = 0 THEN 'unresolved' WHEN len(targets) = 1 THEN 'exact' ELSE 'ambiguous' END AS derived, outcome, count(*) AS n FROM {L} GROUP BY 1, 2")
def _(s, d):
    derived = lookups.link_outcome(F.col("targets"), F.col("outcome") == "out_of_scope")
    return links(s, d).groupBy(derived.alias("derived"), "outcome").agg(F.count(F.lit(1)).alias("n"))


# graph


@query("node_degrees", f"SELECT node_id, sum(o) AS n_out, sum(i) AS n_in FROM (SELECT source AS node_id, 1 AS o, 0 AS i FROM {E_} UNION ALL SELECT target, 0, 1 FROM {E_}) GROUP BY 1")
def _(s, d):
    return graph.degrees(edges(s, d))


@query("graph_callers", f"SELECT target AS declaration, source AS caller, candidate_set_id FROM {E_} WHERE edge_kind = 'call_candidate'")
def _(s, d):
    return graph.callers(edges(s, d))


@query("graph_callees", f"SELECT a.target AS call, a.source AS callable, b.target AS callee, b.candidate_set_id FROM {E_} a JOIN {E_} b ON b.source = a.target WHERE a.edge_kind = 'contains' AND b.edge_kind = 'call_candidate'")
def _(s, d):
    return graph.callees(edges(s, d))


_NEAR = f"""WITH n AS {N}, e AS {E_}, s AS (SELECT node_id FROM n WHERE node_kind = 'entity'), b AS (
    SELECT s.node_id AS seed, 'outgoing' AS direction, edge_kind, edge_id, target AS node_id FROM e JOIN s ON e.source = s.node_id UNION ALL SELECT s.node_id, 'incoming', edge_kind, edge_id, source FROM e JOIN s ON e.target = s.node_id)
    SELECT seed, direction, edge_kind, edge_id, node_id, node_key FROM (SELECT b.*, n.node_key, row_number() OVER (PARTITION BY seed ORDER BY edge_id, direction DESC) AS k FROM b JOIN n USING (node_id))"""


@query("graph_neighbourhood", _NEAR)
def _(s, d):
    n = nodes(s, d)
    return graph.neighbourhood(edges(s, d), n, n.where("node_kind = 'entity'").select("node_id"), None)


@query("graph_neighbourhood_top", _NEAR + " WHERE k <= 2")
def _(s, d):
    n = nodes(s, d)
    return graph.neighbourhood(edges(s, d), n, n.where("node_kind = 'entity'").select("node_id"), 2)


@query(
    "graph_bounded_search",
    f"""WITH RECURSIVE e AS {E_}, w AS (SELECT node_id AS seed, node_id, 0 AS depth FROM {N} WHERE node_kind = 'entity' UNION SELECT w.seed, e.target, w.depth + 1 FROM w JOIN e ON e.source = w.node_id WHERE w.depth < {graph.BFS_DEPTH} AND e.target IS NOT NULL)
    SELECT seed, node_id, min(depth) AS depth FROM w GROUP BY 1, 2""",
)
def _(s, d):
    e = edges(s, d).where("target is not null")
    return graph.bounded_search(e, nodes(s, d).where("node_kind = 'entity'").select("node_id"), graph.BFS_DEPTH, None)


@query(
    "graph_trails",
    f"""WITH RECURSIVE e AS {E_}, w AS (SELECT node_id AS seed, node_id, 0 AS depth, [] :: VARCHAR[] AS trail FROM {N} WHERE node_kind = 'entity' UNION ALL SELECT w.seed, e.target, w.depth + 1, list_append(w.trail, e.edge_id) FROM w JOIN e ON e.source = w.node_id WHERE w.depth < {graph.PATH_DEPTH} AND NOT list_contains(w.trail, e.edge_id))
    SELECT seed, node_id, depth, array_to_string(trail, '>') AS trail FROM w WHERE depth > 0""",
)
def _(s, d):
    t = graph.bounded_trails(edges(s, d), nodes(s, d).where("node_kind = 'entity'").select("node_id"), graph.PATH_DEPTH)
    return t.withColumn("trail", F.array_join("trail", ">"))


@query(
    "trail_evidence",
    f"""SELECT trail_id, min(CASE WHEN evidence_class = 'fact' THEN 1 ELSE 0 END) AS fact_only, max(CASE WHEN evidence_class = 'candidate' THEN 1 ELSE 0 END) AS has_candidate, count(DISTINCT candidate_set_id) AS n_candidate_sets
    FROM (SELECT array_to_string(trail, '>') AS trail_id, unnest(trail) AS edge_id FROM {TRAILS}) t JOIN {E_} e ON e.edge_id = t.edge_id GROUP BY 1""",
)
def _(s, d):
    e = edges(s, d)
    return graph.trail_evidence(graph.bounded_trails(e, nodes(s, d).where("node_kind = 'entity'").select("node_id"), graph.PATH_DEPTH), e)


_WAYS = f"""WITH RECURSIVE e AS {E_}, n AS {N}, w AS (SELECT node_id AS seed, node_id, 0 AS depth, [] :: VARCHAR[] AS trail, [] :: VARCHAR[] AS passed FROM n WHERE node_kind = 'entity' UNION ALL SELECT w.seed, e.target, w.depth + 1, list_append(w.trail, e.edge_id), list_append(w.passed, w.node_id) FROM w JOIN e ON e.source = w.node_id WHERE w.depth < {graph.PATH_DEPTH} AND NOT list_contains(w.trail, e.edge_id)),
    x AS (SELECT DISTINCT a.node_id AS seed, b.node_id AS goal FROM n a JOIN n b ON a.repository_id = b.repository_id WHERE a.node_kind = 'entity' AND b.node_kind = 'file'),
    f AS (SELECT w.seed, x.goal, depth, trail FROM w JOIN x ON x.seed = w.seed AND x.goal = w.node_id WHERE depth > 0 AND NOT list_contains(passed, x.goal))"""


def _pairs(s, d):
    n = nodes(s, d)
    ends = n.where("node_kind = 'entity'").select("repository_id", F.col("node_id").alias("seed")).join(n.where("node_kind = 'file'").select("repository_id", F.col("node_id").alias("goal")), "repository_id")
    return ends.select("seed", "goal").distinct()


@query("graph_paths_between", _WAYS + " SELECT seed, goal, depth, array_to_string(trail, '>') AS trail FROM f")
def _(s, d):
    # Every pair of an entity and a file of its repository is asked for.
    return graph.paths_between(edges(s, d), _pairs(s, d)).withColumn("trail", F.array_join("trail", ">"))


@query(
    "graph_routes",
    _WAYS + """, l AS (SELECT seed, goal, depth, depth - row_number() OVER (PARTITION BY seed, goal ORDER BY depth) AS skip FROM (SELECT DISTINCT seed, goal, depth FROM f)), k AS (SELECT * FROM (SELECT *, min(skip) OVER (PARTITION BY seed, goal) AS least FROM l) WHERE skip = least)
    SELECT f.seed, f.goal, f.depth, array_to_string(trail, '>') AS trail, row_number() OVER (PARTITION BY f.seed, f.goal ORDER BY f.depth, trail) AS rank FROM f JOIN k ON k.seed = f.seed AND k.goal = f.goal AND k.depth = f.depth QUALIFY rank <= 5""",
)
def _(s, d):
    return graph.routes(edges(s, d), _pairs(s, d), most=5).withColumn("trail", F.array_join("trail", ">"))


# integrity


@query("integrity_duplicate_ids", "SELECT id, 'duplicate id' AS reason FROM (SELECT node_id AS id FROM (SELECT DISTINCT node_id, created_at FROM nodes) GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT entity_id FROM (SELECT DISTINCT entity_id, created_at FROM entities) GROUP BY 1 HAVING count(*) > 1)")
def _(s, d):
    # Records that live twice have their id twice.
    lives = lambda t, i: table(s, d, t).select(i, "created_at").distinct()
    return verify.duplicate_ids(lives("nodes", "node_id"), "node_id").unionByName(verify.duplicate_ids(lives("entities", "entity_id"), "entity_id"))


@query("integrity_candidate_sets", f"SELECT edge_id AS id, 'evidence' AS reason FROM {E_} WHERE evidence_class = 'candidate' AND ends_with(edge_id, '0')")
def _(s, d):
    # Edges whose id ends in 0 have lost their set; all nodes they name are there.
    e = edges(s, d).withColumn("candidate_set_id", F.when(~F.col("edge_id").endswith("0"), F.col("candidate_set_id")))
    ends = e.select(F.col("source").alias("node_id")).unionByName(e.select(F.col("target").alias("node_id"))).where("node_id is not null").distinct()
    return verify.verify_graph(ends, e).where("reason = 'evidence'")


@query("integrity_dangling_edges", f"SELECT edge_id FROM {E_} e WHERE NOT EXISTS (SELECT 1 FROM {N} n WHERE n.node_id = e.target) OR NOT EXISTS (SELECT 1 FROM {N} n WHERE n.node_id = e.source)")
def _(s, d):
    e, n = edges(s, d), nodes(s, d).select("node_id")
    no_target = e.join(n.withColumnRenamed("node_id", "target"), "target", "left_anti").select("edge_id")
    return no_target.unionByName(e.join(n.withColumnRenamed("node_id", "source"), "source", "left_anti").select("edge_id")).distinct()


# scalar functions over the names of the tables


@query("identifier_terms", f"SELECT decl_name, array_to_string({_terms('decl_name')}, ' ') AS terms FROM (SELECT DISTINCT decl_name FROM declarations WHERE deleted_at IS NULL)")
def _(s, d):
    return declarations(s, d).select("decl_name").distinct().select("decl_name", F.array_join(I.identifier_terms(F.col("decl_name")), " ").alias("terms"))


@query("path_parts", f"SELECT DISTINCT relative_path, regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(relative_path, '[^/]*$') AS base, len(string_split(relative_path, '/')) AS n_parts FROM {D}")
def _(s, d):
    p = declarations(s, d).select("relative_path").distinct()
    return p.select("relative_path", I.directory(F.col("relative_path")).alias("dir"), I.basename(F.col("relative_path")).alias("base"), F.size(F.split("relative_path", "/")).alias("n_parts"))


@query("content_ids", f"SELECT DISTINCT node_key, 'gn-' || substr(sha256(node_kind || chr(10) || node_key), 1, 16) AS id FROM {N}")
def _(s, d):
    return nodes(s, d).select("node_key", I.content_id("gn", F.col("node_kind"), F.col("node_key")).alias("id")).distinct()


@query("span_relations", f"SELECT {_DECL}, span.byte_end - span.byte_start AS n_bytes, span.row_end - span.row_start + 1 AS n_rows FROM (SELECT DISTINCT {_DECL}, span FROM {D})")
def _(s, d):
    return declarations(s, d).select(*DK, "span").distinct().select(*DK, joins.span_length("span").alias("n_bytes"), (F.col("span.row_end") - F.col("span.row_start") + 1).alias("n_rows"))


@query("reason_heads", f"SELECT regexp_extract(reason, '^[^( ]+') AS head, count(*) AS n FROM {L} WHERE reason IS NOT NULL GROUP BY 1")
def _(s, d):
    return links(s, d).where("reason is not null").groupBy(I.reason_head(F.col("reason")).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@query("token_estimates", "SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def _(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", I.token_estimate(F.col("text")).cast("long").alias("tokens"))


# text queries, symbols, integrity


@query("text_query", "SELECT *, true AS complete, NULL :: VARCHAR AS reason FROM (" + _ranked("apply batch", ["apply", "batch"], 20) + ")")
def _(s, d):
    return text_query.run(text_query.QueryPlan("apply batch", max_results=20), nodes(s, d))


_SEEDS = f"SELECT node_id FROM ({_ranked('apply batch', ['apply', 'batch'], 20)})"


@query(
    "text_query_related",
    f"""WITH n AS {N}, e AS {E_}, s AS ({_SEEDS}), b AS (SELECT s.node_id AS seed, 'outgoing' AS direction, edge_kind, edge_id, target AS node_id FROM e JOIN s ON e.source = s.node_id UNION ALL SELECT s.node_id, 'incoming', edge_kind, edge_id, source FROM e JOIN s ON e.target = s.node_id),
    k AS (SELECT b.*, n.node_key FROM b JOIN n USING (node_id)), l AS (SELECT *, lag(node_id) OVER w AS pn, lag(edge_kind) OVER w AS pk FROM k WINDOW w AS (PARTITION BY seed ORDER BY node_key, direction, edge_kind, edge_id))
    SELECT seed, direction, edge_kind, edge_id, node_id, node_key FROM l WHERE NOT coalesce(pn = node_id AND pk = edge_kind, false)""",
)
def _(s, d):
    plan, n = text_query.QueryPlan("apply batch", intent="related", max_results=20), nodes(s, d)
    return text_query.expand(plan, text_query.run(plan, n), n, edges(s, d), None, None)


_CALLED = f"(SELECT min(n.label) AS label FROM {N} n JOIN {E_} e ON e.target = n.node_id WHERE e.edge_kind = 'call_candidate' AND n.node_kind = 'declaration')"


def _target(s, d):
    """The least name of a declaration that something may call."""
    met = edges(s, d).where("edge_kind = 'call_candidate'").select(F.col("target").alias("node_id"))
    return nodes(s, d).where("node_kind = 'declaration'").join(met, "node_id", "left_semi").agg(F.min("label")).first()[0]


@query("text_query_callers", f"""WITH n AS {N}, t AS (SELECT node_id FROM n WHERE label = (SELECT label FROM {_CALLED}) AND node_kind IN ('declaration', 'call', 'import')) SELECT t.node_id AS seed, e.edge_id, e.source AS node_id FROM t JOIN {E_} e ON e.target = t.node_id AND e.edge_kind = 'call_candidate' JOIN n ON n.node_id = e.source""")
def _(s, d):
    n = nodes(s, d)
    plan = text_query.QueryPlan("who calls it", intent="callers", target=_target(s, d), max_results=100_000)
    return text_query.expand(plan, text_query.run(plan, n), n, edges(s, d), None, None).select("seed", "edge_id", "node_id")


@query("text_query_target", f"""WITH n AS {N} SELECT node_id, count(*) OVER () AS total, true AS complete FROM n WHERE label = (SELECT label FROM {_CALLED}) AND node_kind IN ('declaration', 'call', 'import')""")
def _(s, d):
    plan = text_query.QueryPlan("who calls it", intent="callers", target=_target(s, d), max_results=100_000)
    return text_query.run(plan, nodes(s, d)).select("node_id", F.col("total").cast("long").alias("total"), "complete")


@query("text_query_paths", f"""WITH RECURSIVE e AS {E_}, m AS (SELECT arg_min(source, edge_id) AS a, arg_min(target, edge_id) AS b FROM e WHERE source IN (SELECT node_id FROM {N}) AND target IN (SELECT node_id FROM {N}) AND source <> target), w AS (SELECT a AS node_id, 0 AS depth, [] :: VARCHAR[] AS trail, [] :: VARCHAR[] AS passed FROM m UNION ALL SELECT e.target, w.depth + 1, list_append(w.trail, e.edge_id), list_append(w.passed, w.node_id) FROM w JOIN e ON e.source = w.node_id WHERE w.depth < 3 AND NOT list_contains(w.trail, e.edge_id)),
    f AS (SELECT depth, trail FROM w, m WHERE w.node_id = m.b AND NOT list_contains(passed, m.b)) SELECT depth, array_to_string(trail, '>') AS trail, row_number() OVER (ORDER BY depth, trail) AS rank FROM f QUALIFY rank <= 2""")
def _(s, d):
    # From the source of the first edge between two nodes to its target.
    n, e = nodes(s, d), edges(s, d)
    ids = n.select("node_id").distinct()
    whole = e.where("source <> target").join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    first = whole.agg(F.min(F.struct("edge_id", "source", "target")).alias("m")).first().m
    plan = text_query.QueryPlan("path between them", intent="paths", target=first.source, to=first.target)
    return text_query.plan_routes(plan, n, e).select("depth", F.array_join("trail", ">").alias("trail"), "rank")


@query("packet_budget", f"SELECT repository_id, node_id, size FROM (SELECT *, sum(size) OVER (PARTITION BY repository_id ORDER BY node_key, node_id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT repository_id, node_id, node_key, length(node_key) AS size FROM {N})) WHERE used <= 2000")
def _(s, d):
    n = nodes(s, d).select("repository_id", "node_id", "node_key", F.length("node_key").alias("size"))
    return text_query.fit_budget(n, ["repository_id"], ["node_key", "node_id"], "size", 2000).select("repository_id", "node_id", "size")


@query(
    "scope_chain_pairs",
    f"""WITH RECURSIVE latest AS (SELECT repository_id, relative_path, scope_id, arg_max(coalesce(parent_scope_id, -9), ingested_at) AS parent_id FROM scopes GROUP BY 1, 2, 3),
    s AS (SELECT l.repository_id, l.relative_path, l.scope_id, p.scope_id AS parent_id FROM latest l LEFT JOIN latest p ON p.repository_id = l.repository_id AND p.relative_path = l.relative_path AND p.scope_id = l.parent_id),
    down AS (SELECT repository_id, relative_path, scope_id, [scope_id] AS path FROM s WHERE parent_id IS NULL UNION ALL SELECT s.repository_id, s.relative_path, s.scope_id, list_prepend(s.scope_id, d.path) FROM s JOIN down d ON s.repository_id = d.repository_id AND s.relative_path = d.relative_path AND s.parent_id = d.scope_id)
    SELECT repository_id, relative_path, scope_id, generate_subscripts(path, 1) - 1 AS level, unnest(path) AS outer_id FROM down
    UNION ALL SELECT repository_id, relative_path, scope_id, 0, scope_id FROM s WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.repository_id = s.repository_id AND d.relative_path = s.relative_path AND d.scope_id = s.scope_id)""",
)
def _(s, d):
    from tracewell.operators.hierarchy import latest_rows

    newest = latest_rows(table(s, d, "scopes"), ["repository_id", "relative_path", "scope_id"], "ingested_at", ["parent_scope_id"])
    return symbols.scope_chains(newest)


@query(
    "lexical_candidates",
    f"""WITH x AS ({SQL["scope_chain_pairs"]}), n AS (SELECT repository_id, relative_path, scope_id, arg_max(struct_pack(p := coalesce(parent_scope_id, -9), k := scope_kind, n := scope_name), struct_pack(t := ingested_at, p := coalesce(parent_scope_id, -9), k := scope_kind, n := scope_name)) AS r FROM scopes GROUP BY 1, 2, 3),
    m AS (SELECT u.repository_id, u.relative_path, u.scope_id AS use_id, x.level, d.scope_id AS declaration_id FROM n u JOIN x ON x.repository_id = u.repository_id AND x.relative_path = u.relative_path AND x.scope_id = u.scope_id JOIN n d ON d.repository_id = u.repository_id AND d.relative_path = u.relative_path AND d.r.p = x.outer_id AND d.r.n = u.r.n WHERE d.r.k IN ('function', 'method', 'class', 'struct', 'closure'))
    SELECT repository_id, relative_path, use_id, level, declaration_id FROM m QUALIFY level = min(level) OVER (PARTITION BY repository_id, relative_path, use_id)""",
)
def _(s, d):
    from tracewell.operators.hierarchy import latest_rows

    # A named scope is a declaration of its parent, and uses its own name from within.
    newest = latest_rows(table(s, d, "scopes"), ["repository_id", "relative_path", "scope_id"], "ingested_at", ["parent_scope_id", "scope_kind", "scope_name"])
    decls = newest.select("repository_id", "relative_path", F.col("parent_scope_id").alias("scope_id"), F.col("scope_id").alias("declaration_id"), F.col("scope_kind").alias("decl_kind"), F.col("scope_name").alias("decl_name"))
    uses = newest.where("scope_name is not null").select(F.concat_ws("#", "repository_id", "relative_path", F.col("scope_id").cast("string")).alias("use_id"), "repository_id", "relative_path", "scope_id", F.col("scope_name").alias("name"))
    found = symbols.lexical_candidates(uses, decls, symbols.scope_chains(newest), ["function", "method", "class", "struct", "closure"])
    at = lambda n: F.split("use_id", "#").getItem(n)
    return found.select(at(0).alias("repository_id"), at(1).alias("relative_path"), at(2).cast("long").alias("use_id"), "level", "declaration_id")


@query("verify_links", f"""WITH l AS {L}, bad AS (SELECT link_id AS id, 'cardinality' AS reason FROM l WHERE NOT coalesce(CASE outcome WHEN 'exact' THEN coalesce(len(targets), 0) = 1 WHEN 'ambiguous' THEN coalesce(len(targets), 0) > 1 ELSE coalesce(len(targets), 0) = 0 END, false)),
    lost AS (SELECT link_id AS id, 'entity' AS reason FROM (SELECT link_id, lower(trim(t.entity_id)) AS e FROM (SELECT link_id, unnest(targets) AS t FROM l) WHERE t.entity_id IS NOT NULL) WHERE e NOT IN (SELECT lower(trim(entity_id)) FROM entities))
    SELECT DISTINCT * FROM bad UNION SELECT DISTINCT * FROM lost""")
def _(s, d):
    return verify.verify_links(links(s, d), table(s, d, "entities"))


@query("verify_candidates", f"""WITH c AS {C} SELECT DISTINCT record_id AS id, 'cardinality' AS reason FROM c WHERE NOT CASE outcome WHEN 'single_candidate' THEN coalesce(len(candidates), 0) = 1 WHEN 'multiple_candidates' THEN coalesce(len(candidates), 0) > 1 ELSE coalesce(len(candidates), 0) = 0 END
    UNION SELECT record_id, 'repeated candidate' FROM c WHERE len(list_distinct(list_transform(candidates, lambda x: coalesce(x.relative_path, '?') || '#' || coalesce(x.declaration_id, -1)))) < len(candidates)""")
def _(s, d):
    return verify.verify_candidates(candidates(s, d))


@query("verify_graph", f"""WITH n AS {N}, e AS {E_}
    SELECT id, 'duplicate id' AS reason FROM (SELECT node_id AS id FROM n GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT edge_id FROM e GROUP BY 1 HAVING count(*) > 1)
    UNION SELECT edge_id, 'no source' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.node_id = e.source) UNION SELECT edge_id, 'no target' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.node_id = e.target)
    UNION SELECT edge_id, 'evidence' FROM e WHERE (evidence_class = 'candidate') <> (candidate_set_id IS NOT NULL)""")
def _(s, d):
    return verify.verify_graph(nodes(s, d), edges(s, d))


@query("declaration_locators", f"SELECT DISTINCT repository_id, regexp_extract(relative_path, '\\.([^./]+)$', 1) || ':' || relative_path || ':' || decl_kind || ':' || coalesce(decl_name, '') AS locator FROM {D}")
def _(s, d):
    return symbols.declaration_locators(declarations(s, d)).select("repository_id", "locator").distinct()


@query("binding_reach")
def _(s, d):
    from tracewell.operators import links as link_rules
    from tracewell.operators.hierarchy import latest_rows

    newest = latest_rows(table(s, d, "scopes"), ["repository_id", "relative_path", "scope_id"], "ingested_at", ["parent_scope_id", "scope_kind"])
    return link_rules.closure_reach(symbols.scope_chains(newest), newest, ["closure", "lambda"])
