"""Queries of the scalar functions over the names, paths and spans of the tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import identifiers as I
from tracewell.operators import dedup, sessions
from tracewell.operators import query as text_query
from tracewell.plans.reference import C, D, E_, N, T, _terms, candidates, declarations, edges, entities, nodes
from tracewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

P = "(SELECT DISTINCT relative_path AS p FROM declarations WHERE deleted_at IS NULL AND relative_path IS NOT NULL)"
W = "(SELECT DISTINCT written AS w FROM call_candidates WHERE written IS NOT NULL)"
X = "(SELECT DISTINCT decl_name AS x FROM declarations WHERE deleted_at IS NULL AND decl_name IS NOT NULL)"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def paths(s, d):
    return declarations(s, d).where("relative_path is not null").select(F.col("relative_path").alias("p")).distinct()


def names(s, d):
    return declarations(s, d).where("decl_name is not null").select(F.col("decl_name").alias("x")).distinct()


def calls(s, d):
    return candidates(s, d).where("written is not null").select(F.col("written").alias("w")).distinct()


_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in I.SUFFIXES) + "]"


@query(
    "morph_variants",
    f"""WITH t AS (SELECT DISTINCT unnest({_terms("x")}) AS t FROM {X}), v AS (SELECT t, unnest({_SUFFIXES}) AS s FROM t), b AS (SELECT t, s, left(t, length(t) - length(s)) AS b FROM v WHERE ends_with(t, s) AND length(t) - length(s) >= 3),
    a AS (SELECT t, t AS v FROM t UNION SELECT t, b FROM b UNION SELECT t, b || 'e' FROM b UNION SELECT t, b || 'y' FROM b WHERE s = 'ies') SELECT t AS term, string_agg(v, ' ' ORDER BY v) AS variants FROM a GROUP BY 1""",
)
def _(s, d):
    terms = names(s, d).select(F.explode(I.identifier_terms(F.col("x"))).alias("term")).distinct()
    return terms.select("term", F.array_join(I.morph_variants(F.col("term")), " ").alias("variants"))


@query("lowercase_keys", f"SELECT lower(label) AS key, count(*) AS n FROM {N} WHERE label IS NOT NULL GROUP BY 1")
def _(s, d):
    return nodes(s, d).where("label is not null").groupBy(F.lower("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("query_normal_forms", "SELECT item_id, lower(trim(regexp_replace(item_text, '[ \\t\\n\\f\\r]+', ' ', 'g'))) AS form FROM eval_items WHERE item_text IS NOT NULL")
def _(s, d):
    return table(s, d, "eval_items").where("item_text is not null").select("item_id", I.query_normal_form(F.col("item_text")).alias("form"))


@query("question_bodies", "SELECT item_id, trim(item_text) AS body, CASE WHEN item_id % 2 = 0 THEN trim(item_text) ELSE trim(item_text) || '!' END AS framed FROM eval_items WHERE item_text IS NOT NULL AND item_text NOT LIKE '%QUESTION:%' AND item_text NOT LIKE '%INSTRUCTIONS:%' AND trim(item_text, chr(9) || chr(10) || chr(13) || ' ') = trim(item_text)")
def _(s, d):
    e = table(s, d, "eval_items").where("item_text is not null and item_text not like '%QUESTION:%' and item_text not like '%INSTRUCTIONS:%' and regexp_replace(item_text, '^[\\t\\n\\r ]+|[\\t\\n\\r ]+$', '') = trim(item_text)")
    framed = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("x QUESTION: "), "item_text", F.lit(" INSTRUCTIONS: y"))).otherwise(F.concat(F.lit("QUESTION:"), F.trim("item_text"), F.lit("!")))
    return e.select("item_id", I.question_body(F.col("item_text")).alias("body"), I.question_body(framed).alias("framed"))


@query("identifier_like", f"SELECT x AS name, length(x) >= 3 AND regexp_matches(x, '_|::|\\p{{Lu}}|\\p{{N}}') AS is_identifier FROM {X}")
def _(s, d):
    return names(s, d).select(F.col("x").alias("name"), I.is_identifier_like(F.col("x")).alias("is_identifier"))


@query("rust_module_folders", f"SELECT p AS path, CASE WHEN regexp_extract(p, '[^/]*$') IN ('mod.rs', 'lib.rs', 'main.rs') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE regexp_replace(p, '\\.rs$', '') END AS folder FROM {P} WHERE p LIKE '%.rs'")
def _(s, d):
    return paths(s, d).where("p like '%.rs'").select(F.col("p").alias("path"), I.rust_module_dir(F.col("p")).alias("folder"))


@query("python_modules", f"SELECT p AS path, replace(regexp_replace(regexp_replace(p, '\\.pyi?$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM {P} WHERE p LIKE '%.py'")
def _(s, d):
    return paths(s, d).where("p like '%.py'").select(F.col("p").alias("path"), I.python_module(F.col("p")).alias("module"))


@query(
    "relative_bases",
    f"""WITH q AS (SELECT p, string_split(p, '/')[:-2] AS parts FROM {P}), l AS (SELECT p, parts, unnest([1, 2, 3]) AS level FROM q)
    SELECT p AS path, level, CASE WHEN len(parts) - (level - 1) >= 1 THEN array_to_string(parts[: len(parts) - (level - 1)], '/') END AS base FROM l""",
)
def _(s, d):
    p = paths(s, d).select(F.col("p").alias("path"), F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("level"))
    return p.select("path", "level", I.relative_base(I.directory(F.col("path")), F.col("level")).alias("base"))


@query("path_ancestors", f"SELECT DISTINCT p AS path, a AS folder FROM (SELECT p, unnest(list_transform(range(0, len(string_split(p, '/'))), lambda n: array_to_string(string_split(p, '/')[:n], '/'))) AS a FROM {P})")
def _(s, d):
    return paths(s, d).select(F.col("p").alias("path"), F.explode(I.ancestors(F.col("p"))).alias("folder")).distinct()


@query("glob_matches", f"SELECT p AS path FROM {P} WHERE regexp_full_match(p, '[^/]*/[^/]*/[^/]*_[^/]*\\.py')")
def _(s, d):
    return paths(s, d).where(I.glob_segment(F.col("p"), "*/*/*_*.py")).select(F.col("p").alias("path"))


_NAME = "replace(regexp_replace(p, '\\.[^./]*$', ''), '/', chr(92))"


@query(
    "php_names",
    f"""WITH n AS (SELECT p, {_NAME} AS n FROM {P} WHERE p LIKE '%.php') SELECT p AS path, string_split(n, chr(92))[-1] AS last,
    CASE WHEN lower(string_split(n, chr(92))[1]) = 'app' THEN 'Main' || n[4:] ELSE 'Root' || chr(92) || n END AS full, n AS absolute, 'Root' || n[10:] AS here FROM (SELECT p, n, 'namespace' || chr(92) || n AS w FROM n) n2 JOIN n USING (p, n)""".replace("'Root' || n[10:]", "'Root' || chr(92) || n"),
)
def _(s, d):
    name = F.translate(F.regexp_replace("p", r"\.[^./]*$", ""), "/", "\\")
    n = paths(s, d).where("p like '%.php'").select(F.col("p").alias("path"), name.alias("n"))
    aliases, own = F.create_map(F.lit("app"), F.lit("Main")), F.lit("Root")
    return n.select(
        "path",
        I.php_last_segment(F.col("n")).alias("last"),
        I.php_class_fqn(F.col("n"), own, aliases).alias("full"),
        I.php_class_fqn(F.concat(F.lit("\\"), "n"), own, aliases).alias("absolute"),
        I.php_class_fqn(F.concat(F.lit("namespace\\"), "n"), own, aliases).alias("here"),
    )


@query(
    "php_hints",
    f"""WITH h AS (SELECT x, '?' || x || '|int| Array |self' AS h FROM {X}) SELECT x AS name, array_to_string(list_filter([x, 'int', 'Array', 'self'], lambda a: lower(a) NOT IN ('int', 'float', 'string', 'bool', 'array', 'callable', 'iterable', 'object', 'mixed', 'void', 'never', 'null', 'false', 'true', 'static')), ',') AS classes, 0 AS n_both FROM h""",
)
def _(s, d):
    hint = F.concat(F.lit("?"), "x", F.lit("|int| Array |self"))
    return names(s, d).select(F.col("x").alias("name"), F.array_join(I.php_hint_classes(hint), ",").alias("classes"), F.size(I.php_hint_classes(F.concat("x", F.lit("&B")))).alias("n_both"))


@query("go_selectors", f"SELECT w AS written, regexp_extract(w, '^([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)\\.([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)$', 1) AS operand, regexp_extract(w, '^([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)\\.([\\p{{L}}_][\\p{{L}}\\p{{N}}_]*)$', 2) AS name, regexp_matches(w, '^\\p{{Lu}}') AS exported FROM (SELECT w FROM {W} UNION SELECT 'pkg.' || w FROM {W} UNION SELECT upper(w) FROM {W})")
def _(s, d):
    c = calls(s, d)
    w = F.col("w")
    every = c.unionByName(c.select(F.concat(F.lit("pkg."), w).alias("w"))).unionByName(c.select(F.upper(w).alias("w"))).distinct()
    operand, name = I.go_selector(w)
    return every.select(w.alias("written"), operand.alias("operand"), name.alias("name"), I.go_exported(w).alias("exported"))


@query("go_mod_modules", f"SELECT DISTINCT repository_id, 'example.com/' || repository_id AS module FROM {D}")
def _(s, d):
    r = declarations(s, d).select("repository_id").distinct()
    text = F.concat(F.lit("// a comment\n\n  module \"example.com/"), "repository_id", F.lit("\"\n\ngo 1.22\nrequire module v1\n"))
    return r.select("repository_id", I.go_mod_directive(text).alias("module"))


@query("digest_tags", f"SELECT x AS name, 'sha256:' || sha256(x) AS tag FROM {X}")
def _(s, d):
    return names(s, d).select(F.col("x").alias("name"), I.sha256_tag(F.col("x")).alias("tag"))


_E = "nullif(regexp_replace(lower({}), '^\\s+|\\s+$', '', 'g'), '')"


@query("event_identities", f"SELECT delivery_id, coalesce({_E.format('session_id')}, nullif(regexp_extract({_E.format('event_id')}, '^(.*):0*([0-9]+)$', 1), '')) AS session, coalesce(sequence, CAST(nullif(regexp_extract({_E.format('event_id')}, '^(.*):0*([0-9]+)$', 2), '') AS BIGINT)) AS number FROM agent_events")
def _(s, d):
    return dedup.identified_events(table(s, d, "agent_events")).select("delivery_id", "session", "number")


@query("event_instants", "SELECT delivery_id, epoch_us(TRY_CAST(trim(event_time) AS TIMESTAMPTZ)) AS at_us FROM agent_events")
def _(s, d):
    return table(s, d, "agent_events").select("delivery_id", sessions.event_instant(F.col("event_time")).alias("at_us"))


@query("record_days", "SELECT DISTINCT edge_id, recorded_at, date_diff('day', DATE '1970-01-01', CAST(recorded_at AS DATE)) AS day, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS written FROM edges WHERE recorded_at IS NOT NULL")
def _(s, d):
    e = table(s, d, "edges").where("recorded_at is not null").select("edge_id", "recorded_at").distinct()
    return e.select("edge_id", "recorded_at", I.day_index(F.col("recorded_at")).cast("long").alias("day"), I.rfc3339(F.unix_seconds(F.col("recorded_at").cast("timestamp"))).alias("written"))


@query(
    "span_meetings",
    f"""WITH b AS (SELECT DISTINCT repository_id, relative_path, declaration_id, span, body_span FROM declarations WHERE deleted_at IS NULL AND body_span IS NOT NULL)
    SELECT repository_id, relative_path, declaration_id, span.byte_start <= body_span.byte_start AND body_span.byte_end <= span.byte_end AS holds, span.byte_start < body_span.byte_end AND body_span.byte_start < span.byte_end AS meets,
    body_span.byte_start <= span.byte_start AND span.byte_start < body_span.byte_end AS visible, CASE WHEN NOT (body_span.byte_start < span.byte_end AND span.byte_start < body_span.byte_end) THEN 'none'
    WHEN span.byte_start <= body_span.byte_start AND body_span.byte_end <= span.byte_end AND NOT (span.byte_start = body_span.byte_start AND span.byte_end = body_span.byte_end) THEN 'inside' WHEN body_span.byte_start <= span.byte_start AND span.byte_end <= body_span.byte_end THEN 'covers' ELSE 'partial' END AS overlap FROM b""",
)
def _(s, d):
    b = table(s, d, "declarations").where("deleted_at is null and body_span is not null").select("repository_id", "relative_path", "declaration_id", "span", "body_span").distinct()
    at = lambda c, e: F.col(f"{c}.byte_{e}")
    ends = (at("body_span", "start"), at("body_span", "end"), at("span", "start"), at("span", "end"))
    return b.select(
        "repository_id", "relative_path", "declaration_id", I.range_contains("span", "body_span").alias("holds"), I.range_overlaps(*ends).alias("meets"),
        I.visible_at(F.array("body_span"), at("span", "start")).alias("visible"), I.overlap_class(*ends).alias("overlap"),
    )


@query("offset_lines", "SELECT DISTINCT file_id, k AS byte_offset, (SELECT count(*) FROM (SELECT unnest(string_split(left(relative_path, k + 1), '/')))) - 1 AS line FROM (SELECT file_id, relative_path, unnest(range(0, length(relative_path))) AS k FROM source_files) WHERE substr(relative_path, k + 1, 1) <> '/'")
def _(s, d):
    # Lines of a text are taken as the parts of a path: each begins after a slash.
    f = table(s, d, "source_files").select("file_id", "relative_path").distinct()
    chars = F.sequence(F.lit(0), F.length("relative_path") - 1)
    starts = F.filter(chars, lambda k: (k == 0) | (F.substring("relative_path", k, F.lit(1)) == "/"))
    spread = f.select("file_id", "relative_path", starts.alias("starts"), F.explode(chars).alias("byte_offset"))
    return spread.where(F.substring("relative_path", F.col("byte_offset") + 1, F.lit(1)) != "/").select("file_id", F.col("byte_offset").cast("long").alias("byte_offset"), I.line_of(F.col("starts"), F.col("byte_offset")).cast("long").alias("line"))


@query("packet_quotes", "SELECT item_id, '\"' || replace(replace(replace(replace(item_text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '\"' AS quoted FROM eval_items WHERE item_text IS NOT NULL")
def _(s, d):
    return table(s, d, "eval_items").where("item_text is not null").select("item_id", I.packet_quote(F.col("item_text")).alias("quoted"))


@query("test_shaped_names", f"SELECT DISTINCT relative_path, decl_name FROM {D} WHERE regexp_matches(lower(decl_name), '^test|_test$|tests?$') OR regexp_matches(lower(relative_path), '(^|/)tests?/|_test\\.|(^|/)test_|\\.spec\\.|\\.test\\.')")
def _(s, d):
    return declarations(s, d).where(F.coalesce(I.test_shaped(F.col("decl_name"), F.col("relative_path")), F.lit(False))).select("relative_path", "decl_name").distinct()


@query("question_priorities", f"SELECT edge_kind, 4 * count(*) + 3 * count(DISTINCT source) + 2 * count(DISTINCT target) - count(DISTINCT rule_id) - count(DISTINCT candidate_set_id) AS priority FROM {E_} GROUP BY 1")
def _(s, d):
    n = lambda c: F.countDistinct(c)
    return edges(s, d).groupBy("edge_kind").agg(I.question_priority(F.count(F.lit(1)), n("source"), n("target"), n("rule_id"), n("candidate_set_id")).alias("priority"))


@query(
    "name_path_jaccard",
    f"""WITH t AS (SELECT DISTINCT decl_name, relative_path, list_distinct({_terms("decl_name")}) AS a, list_distinct({_terms("relative_path")}) AS b FROM {D} WHERE decl_name IS NOT NULL)
    SELECT decl_name, relative_path, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END :: DOUBLE AS similarity FROM t""",
)
def _(s, d):
    t = declarations(s, d).where("decl_name is not null").select("decl_name", "relative_path").distinct()
    return t.select("decl_name", "relative_path", I.jaccard(F.array_distinct(I.identifier_terms(F.col("decl_name"))), F.array_distinct(I.identifier_terms(F.col("relative_path")))).alias("similarity"))


@query(
    "manifest_alias_table",
    f"""WITH t AS (SELECT DISTINCT repository_id, structural_kind AS role, lower(entity_key) AS term FROM {T}), k AS (SELECT *, row_number() OVER (PARTITION BY repository_id, role ORDER BY term) AS k FROM t WHERE term IS NOT NULL),
    r AS (SELECT repository_id, role, string_agg(term, ',' ORDER BY term) FILTER (k <= 4) AS terms, count(*) FILTER (k <= 4) AS n FROM k GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY repository_id ORDER BY role ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT repository_id, role, terms FROM u WHERE used <= 12""",
)
def _(s, d):
    m = entities(s, d).where("entity_key is not null").select("repository_id", F.col("structural_kind").alias("role"), F.col("entity_key").alias("term"))
    return text_query.manifest_aliases(m).withColumn("terms", F.array_join("terms", ","))


@query("question_anchors", f"SELECT x AS name, CASE WHEN regexp_matches(x, '[\\p{{L}}\\p{{N}}](?:_|::|\\.|/)[\\p{{L}}\\p{{N}}]|\\p{{Ll}}\\p{{Lu}}|\\p{{L}}\\p{{N}}|^_+\\p{{L}}') THEN x ELSE '' END AS anchors, 'callers' AS intent FROM {X} WHERE NOT regexp_matches(x, '[\\s,;()`''\"?!]')")
def _(s, d):
    q = names(s, d).where(~F.col("x").rlike(r"[\s,;()`'\"?!]")).select(F.col("x").alias("name"), F.concat(F.lit("Who calls "), "x", F.lit("? And why")).alias("q"))
    return q.select("name", F.array_join(text_query.anchors(F.col("q")), " ").alias("anchors"), text_query.intent_of(F.col("q")).alias("intent"))


@query("relevant_edges", f"SELECT 'callers' AS intent, edge_id FROM {E_} WHERE edge_kind LIKE 'call%' UNION ALL SELECT 'manifest_or_config', edge_id FROM {E_} WHERE edge_kind IN ('contains', 'member_of') UNION ALL SELECT 'path_or_flow', edge_id FROM {E_}")
def _(s, d):
    out = None
    for intent in ("callers", "manifest_or_config", "path_or_flow"):
        one = edges(s, d).where(text_query.edge_relevant(intent, F.lit("incoming"), F.col("edge_kind"))).select(F.lit(intent).alias("intent"), "edge_id")
        out = one if out is None else out.unionByName(one)
    return out
