"""Which declarations an observation of lines touched, and where a name is declared around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.identifiers import overlap_class
from tracewell.operators import hierarchy


def symbol_exposures(seen: DataFrame, declarations: DataFrame) -> DataFrame:
    """Observed line ranges against declarations of the same file.

    `seen`: observation_id, repository_id, relative_path, line_start, line_end
    (from 1, both ends included); `declarations`: their keys and `span`. Returns
    observation_id, declaration_id, overlap and depth (0 is the innermost).
    """
    s = seen.where("line_start is not null and line_end >= line_start")
    met = s.join(declarations.select("repository_id", "relative_path", "declaration_id", "span"), ["repository_id", "relative_path"])
    kind = overlap_class(F.col("line_start") - 1, F.col("line_end"), F.col("span.row_start"), F.col("span.row_end") + 1)
    hit = met.withColumn("overlap", kind).where("overlap <> 'none'").withColumn("_n", F.col("span.row_end") - F.col("span.row_start"))
    depth = F.row_number().over(Window.partitionBy("observation_id").orderBy("_n", "declaration_id")) - 1
    return hit.select("observation_id", "repository_id", "relative_path", "declaration_id", "overlap", depth.alias("depth"))


def symbol_activity(exposures: DataFrame, seen: DataFrame) -> DataFrame:
    """Per declaration: exposures by class, distinct sessions and investigations."""
    j = exposures.join(seen.select("observation_id", "session", "investigation"), "observation_id")
    return j.groupBy("repository_id", "relative_path", "declaration_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("overlap") == "inside").alias("n_inside"),
        F.count_if(F.col("overlap") == "covers").alias("n_covers"),
        F.count_if(F.col("overlap") == "partial").alias("n_partial"),
        F.countDistinct("session").alias("n_sessions"),
        F.countDistinct("investigation").alias("n_investigations"),
    )


def scope_chains(scopes: DataFrame) -> DataFrame:
    """(repository_id, relative_path, scope_id, level, outer_id): each scope and what lies around it, level 0 itself."""
    tree = ["repository_id", "relative_path"]
    solved = hierarchy.solve_hierarchy(scopes, tree, "scope_id", "parent_scope_id")
    up = F.reverse("path")
    return solved.select(*tree, "scope_id", F.posexplode(F.when(F.size("path") > 0, up).otherwise(F.array("scope_id"))).alias("level", "outer_id"))


def lexical_candidates(uses: DataFrame, declarations: DataFrame, chains: DataFrame, kinds: list[str]) -> DataFrame:
    """Declarations of a used name in the nearest scope around it that has one.

    `uses`: use_id, repository_id, relative_path, scope_id, name. The first level
    with a declaration of `kinds` wins; all of that level are kept, so the number
    of rows of a use tells 0, 1 or n.
    """
    chain = uses.join(chains, ["repository_id", "relative_path", "scope_id"])
    decls = declarations.where(F.col("decl_kind").isin(kinds)).select("repository_id", "relative_path", F.col("scope_id").alias("outer_id"), F.col("decl_name").alias("name"), "declaration_id")
    met = chain.join(decls, ["repository_id", "relative_path", "outer_id", "name"])
    best = met.groupBy("use_id").agg(F.min("level").alias("level"))
    return met.join(best, ["use_id", "level"]).select("use_id", "level", "declaration_id")


def source_versions(seen: DataFrame, indexed: DataFrame) -> DataFrame:
    """exact (this digest is indexed), assumed (no digest was seen), unresolved (another digest) or unknown (no such path)."""
    d = indexed.select("repository_id", "relative_path", "content_digest").distinct()
    paths = d.select("repository_id", "relative_path").distinct().withColumn("_p", F.lit(True))
    hit = d.withColumn("_d", F.lit(True))
    state = F.when(F.col("_d"), "exact").when(F.col("_p").isNull(), "unknown").when(F.col("content_digest").isNull(), "assumed").otherwise("unresolved")
    return seen.join(paths, ["repository_id", "relative_path"], "left").join(hit, ["repository_id", "relative_path", "content_digest"], "left").withColumn("version_state", state).drop("_p", "_d")


def rebind(old: DataFrame, new: DataFrame, name: str, facets: list[str]) -> DataFrame:
    """Where a remembered symbol is in a later version: by qualified name, the candidate with most equal facets.

    Returns old_id, new_id and state: same (all facets equal), changed, ambiguous (several equally good) or gone.
    """
    o = old.select(F.col("id").alias("old_id"), name, *[F.col(f).alias(f"_o{f}") for f in facets])
    n = new.select(F.col("id").alias("new_id"), name, *[F.col(f).alias(f"_n{f}") for f in facets])
    score = F.lit(0)
    for f in facets:
        score = score + F.col(f"_o{f}").eqNullSafe(F.col(f"_n{f}")).cast("int")
    met = o.join(n, name).select("old_id", "new_id", score.alias("score"))
    best = met.groupBy("old_id").agg(F.max("score").alias("score"))
    top = met.join(best, ["old_id", "score"]).groupBy("old_id", "score").agg(F.count(F.lit(1)).alias("n"), F.min("new_id").alias("new_id"))
    state = F.when(F.col("n").isNull(), "gone").when(F.col("n") > 1, "ambiguous").when(F.col("score") == len(facets), "same").otherwise("changed")
    return o.select("old_id").join(top, "old_id", "left").select("old_id", F.when(F.col("n") == 1, F.col("new_id")).alias("new_id"), state.alias("state"))


def validity(stored: DataFrame, current: DataFrame, fingerprints: list[str]) -> DataFrame:
    """The first fingerprint that differs per view, null for a valid one."""
    c = current.select("view_id", *[F.col(f).alias(f"_c{f}") for f in fingerprints])
    reason = F.when(F.col(f"_c{fingerprints[0]}").isNull(), "missing")
    for f in fingerprints:
        reason = reason.when(~F.col(f).eqNullSafe(F.col(f"_c{f}")), f)
    return stored.join(c, "view_id", "left").select("view_id", reason.alias("reason"))


def reused_files(view: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of a view whose facts are stored under the same digest, whatever the view: (relative_path, content_digest, reused)."""
    have = stored.select("content_digest").distinct().withColumn("_h", F.lit(True))
    return view.join(have, "content_digest", "left").select("relative_path", "content_digest", F.coalesce("_h", F.lit(False)).alias("reused"))




def declaration_locators(declarations: DataFrame) -> DataFrame:
    """`language:path:kind:name` of each declaration."""
    ext = F.regexp_extract("relative_path", r"\.([^./]+)$", 1)
    return declarations.withColumn("locator", F.concat_ws(":", ext, "relative_path", "decl_kind", F.coalesce("decl_name", F.lit(""))))


def declaration_facets(spans: DataFrame, sources: DataFrame) -> DataFrame:
    """Digests of each declaration's name, head and body from the text of its file.

    `spans`: repository_id, relative_path, declaration_id, name, byte_start, body_start, byte_end; `sources`: the keys and content (binary).
    Declarations whose span lies outside the text have null digests.
    """
    j = spans.join(sources, ["repository_id", "relative_path"])
    piece = lambda a, b: F.expr(f"substring(content, {a} + 1, {b} - {a})")
    inside = (F.col("byte_start") >= 0) & (F.col("byte_end") <= F.length("content"))
    middle = "least(coalesce(body_start, byte_end), byte_end)"
    return j.select(
        "repository_id",
        "relative_path",
        "declaration_id",
        F.sha2("name", 256).alias("name_digest"),
        F.when(inside, F.sha2(piece("byte_start", middle), 256)).alias("head_digest"),
        F.when(inside, F.sha2(piece(middle, "byte_end"), 256)).alias("body_digest"),
    )


def source_witness(wanted: DataFrame, sources: DataFrame, most: int | None = 2000) -> DataFrame:
    """The bytes a finding rests on: (finding_id, state, text).

    `wanted`: finding_id, repository_id, relative_path, content_digest,
    byte_start, byte_end; `sources`: keys, content_digest, content. current:
    the digest is that of the source; stale: it is another; missing: no source.
    A slice is cut to `most` bytes, part of the packet's format (None: whole).
    """
    s = sources.select("repository_id", "relative_path", F.col("content_digest").alias("_d"), "content")
    j = wanted.join(s, ["repository_id", "relative_path"], "left")
    state = F.when(F.col("_d").isNull(), "missing").when(F.col("_d") != F.col("content_digest"), "stale").otherwise("current")
    size = "byte_end - byte_start" if most is None else f"least(byte_end - byte_start, {most})"
    text = F.expr(f"cast(substring(content, byte_start + 1, {size}) as string)")
    return j.select("finding_id", state.alias("state"), F.when(state == "current", text).alias("text"))


#: Kinds of evidence, the strongest first.
EVIDENCE = ["exact_link", "contained", "single_candidate", "multiple_candidates", "mentioned", "near"]


def path_evidence(rows: DataFrame) -> DataFrame:
    """Per path: the strongest kind of evidence, the greatest similarity and who says so.

    `rows`: path, evidence, similarity, investigation.
    """
    rank = F.array_position(F.array(*[F.lit(e) for e in EVIDENCE]), F.col("evidence"))
    strength = F.when(rank > 0, F.lit(len(EVIDENCE)) - rank + 1).otherwise(0)
    return rows.groupBy("path").agg(F.max(strength).alias("strength"), F.max("similarity").alias("similarity"), F.array_join(F.sort_array(F.collect_set("investigation")), ",").alias("investigations"))


def query_signature(queries: DataFrame, known: DataFrame, terms, stop: list[str]) -> DataFrame:
    """(query_id, terms, identifiers, paths) of each query: terms without stop words, identifier-like words, known paths it names."""
    words = F.filter(F.split("text", r"[\s,;()`'\"?!]+"), lambda w: w != "")
    ids = F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"_|::|\p{Lu}|\p{N}"))))
    plain = F.array_sort(F.array_distinct(F.filter(terms(F.col("text")), lambda t: ~t.isin(stop))))
    said = queries.select("query_id", F.explode(words).alias("path")).join(known.select("path").distinct(), "path").groupBy("query_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    none = F.array().cast("array<string>")
    return queries.select("query_id", plain.alias("terms"), ids.alias("identifiers")).join(said, "query_id", "left").withColumn("paths", F.coalesce("paths", none))
